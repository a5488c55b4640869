"""Vectorised helpers over Arrow batches of text: chunks of whole documents, word and shingle hashes.

Every helper works on whole texts. A null text is an empty one. Memory follows the chunk size, or the
longest single document where that is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
SHINGLE = 5
_U = np.uint64
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per worker, grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, _U(base))
        have[0] = _U(1)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def text_chunks(column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; offsets start at 0."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    at = 0
    for part in parts:
        part = part.cast(pa.large_binary()).fill_null(b"")
        n = len(part)
        if n == 0:
            continue
        _, offs, data = part.buffers()
        offsets = np.frombuffer(offs, np.int64)[part.offset : part.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, side="right")) - 1)
            yield at + i, at + j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        at += n


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """C[i]: polynomial hash of the first i bytes, so any span's hash is a difference."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * powers(BASE, len(raw)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    inverse = powers(BASE_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * PLACE[63])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and the first word of every document (one more entry than documents)."""
    space = SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = edge.copy()
    before[1:] |= np.append(space, True)[: len(raw)]
    starts = np.flatnonzero(~space & before[:-1])
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, and the first word of every document."""
    low = LOWER[raw]
    starts, ends, first = words(low, offsets)
    return span_hash(prefix_hash(low), starts, ends), first


def shingle_hashes(hashed: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of every document, in order, and their offsets.

    A document with fewer words has one run, the whole sequence; without words it has none.
    """
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(made)])
    full = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for k in range(size):
        full += hashed[k : k + len(full)] * PLACE[k]
    full = mix(full)
    doc = np.repeat(np.arange(len(made)), made)
    out = np.zeros(ends[-1], np.uint64)
    long_enough = count[doc] >= size
    out[long_enough] = full[(first[doc] + np.arange(ends[-1]) - ends[doc])[long_enough]]
    short = np.flatnonzero((count > 0) & (count < size))
    total = count[short].astype(np.uint64)
    for k in range(size - 1):
        own = np.minimum(first[short] + k, max(len(hashed) - 1, 0))
        total += np.where(count[short] > k, hashed[own] * PLACE[k], _U(0)) if len(short) else _U(0)
    out[ends[short]] = mix(total)
    return out, ends


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, and their offsets."""
    out, ends = shingle_hashes(*word_hashes(raw, offsets), size)
    made = np.diff(ends)
    for d in np.flatnonzero(made > 1):
        out[ends[d] : ends[d + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[ends[:-1][made > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[ends]
