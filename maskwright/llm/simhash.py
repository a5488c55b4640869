"""SimHash near duplicates: deletion-variant signatures of fewer segments than differing bits.

With at most four differing bits and three segments, some segment differs in one bit at most. Every segment is
indexed as a whole and once for every bit with that bit left out; equal entries are brought together and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.graph import connected_components
from maskwright.session import materialize, work_partitions

SHINGLE, SEED, BITS = 4, 42, 64
#: Differing bits of a link; first bits of the segments, and the end.
DISTANCE = 4
CUTS = (0, 21, 42, 64)
#: Shingles counted at once; fingerprints of an entry above which pairs are compared in blocks of tasks, and up to
#: which all of them are compared at once; rows compared together; largest list of crowded entries that is broadcast.
PIECE, BLOCK, FEW, GATHERED, BROADCAST_BYTES = 1 << 15, 1024, 8, 1 << 16, 8 << 20


def _fingerprint(text: str | None) -> int:
    """Bits set in over half of the XXH64 values of a text's four-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    wide = min(SHINGLE, len(words))
    ends = end[wide - 1 :].tolist()
    starts = (end - size)[: len(ends)].tolist()
    count = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), PIECE):
        h = np.array([digest(flat[s:e], SEED) for s, e in zip(starts[at : at + PIECE], ends[at : at + PIECE])], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint of every whole text, as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], names=["doc_id", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, bits long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def entries() -> list[tuple[int, int]]:
    """(mask, bit) of every index entry: whole segments (bit 0), and segments without one of their bits."""
    out = []
    for first, end in zip(CUTS, CUTS[1:]):
        whole = (1 << end) - (1 << first)
        out.append((_signed(whole), 0))
        out += [(_signed(whole & ~(1 << k)), _signed(1 << k)) for k in range(first, end)]
    return out


WHOLE = [k for k, (_, bit) in enumerate(entries()) if bit == 0]


def _entries_of(bits: Column, numbers: list[int]) -> Column:
    """(entry, rest) of a fingerprint for the index entries `numbers`; `rest` is what the entry keeps."""
    masks = [entries()[k][0] for k in numbers]
    return F.array(*[F.struct(F.lit(k).cast("short").alias("entry"), bits.bitwiseAND(F.lit(m)).alias("rest")) for k, m in zip(numbers, masks)])


def _crowded(distinct: DataFrame) -> tuple[DataFrame, int]:
    """(entry, rest, blocks) of index entries that may hold more than `BLOCK` fingerprints, and how many they are.

    An entry without a bit holds two whole segments, so its size follows from theirs.
    """
    whole = distinct.select(F.inline(_entries_of(F.col("bits"), WHOLE))).groupBy("entry", "rest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK // 2)
    made = None
    for number, upto in zip(WHOLE, [*WHOLE[1:], len(entries())]):
        part = whole.where(F.col("entry") == number).select("n", F.inline(_entries_of(F.col("rest"), [*range(number, upto)])))
        made = part if made is None else made.unionByName(part)
    sized = made.groupBy("entry", "rest").agg(F.sum("n").alias("n")).select("entry", "rest", F.ceil((F.col("n") + BLOCK // 2) / BLOCK).cast("int").alias("blocks"))
    return materialize(sized.withColumn("one", F.lit(True)), "one")


_ONES = np.array([bin(k).count("1") for k in range(1 << 16)], np.uint8)


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which fingerprints (uint64) differ in `DISTANCE` bits at most."""
    return _ONES[np.ascontiguousarray(x ^ y)[:, None].view(np.uint16)].sum(1) <= DISTANCE


def _tile(bits: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that hold the tile's fingerprints together, fewer than there are; `other` [i, j] rows are a pair to try when they differ in it."""
    part = np.arange(len(bits))
    for x in range(len(bits)):
        y = np.flatnonzero(part[x + 1 :] != part[x]) + x + 1
        y = y[(other[y] != other[x]).all(1)]
        for k in y[_near(bits[y], bits[x])]:
            if part[k] != part[x]:
                part[part == part[k]] = part[x]
                yield x, k


def _compare(rows: pa.Table) -> pa.RecordBatch:
    """Links inside whole index entries: all near pairs of small ones, a spanning forest of larger ones."""
    entry, bits = rows["entry"].to_numpy(), rows["bits"].to_numpy().view(np.uint64)
    key = np.stack([entry.astype(np.int64), *[rows[c].to_numpy() for c in ("rest", "i", "j")]], 1)
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    size = np.diff(np.append(edge, len(key)))
    left_out = np.array([bit for _, bit in entries()], np.int64).view(np.uint64)[entry]
    side = (bits & left_out) != 0
    first, second = [], []
    for gap in range(1, FEW):  # pairs of rows that stand so far apart in an entry of few
        at = np.concatenate([edge[size == n][:, None] + np.arange(n - gap) for n in range(gap + 1, FEW + 1)] or [edge[:0]], axis=None)
        block = rows["block"].to_numpy()
        tried = ((left_out[at] == 0) | (side[at] != side[at + gap])) & ((key[at, 2] == key[at, 3]) | (block[at] != block[at + gap]))
        at = at[tried]
        at = at[_near(bits[at], bits[at + gap])]
        first.append(at)
        second.append(at + gap)
    for at, n in zip(edge[size > FEW].tolist(), size[size > FEW].tolist()):
        span = slice(at, at + n)
        apart = np.arange(n) if left_out[at] == 0 else side[span].astype(int)
        blocks = np.arange(n) if key[at, 2] == key[at, 3] else rows["block"].slice(at, n).to_numpy()
        found = np.array([*_tile(bits[span], np.stack([apart, blocks], 1))], np.int64).reshape(-1, 2) + at
        first.append(found[:, 0])
        second.append(found[:, 1])
    a, b = (bits[np.concatenate(x).astype(np.int64)].view(np.int64) for x in (first, second))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares rows that come in order of their entries; an entry (or its pair of blocks) is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < GATHERED:
            continue
        rows = pa.Table.from_batches(held)
        key = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("entry", "rest", "i", "j")], 1)
        edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if len(edge):
            yield _compare(rows.slice(0, int(edge[-1])))
            held = rows.slice(int(edge[-1])).to_batches()
    if held:
        yield _compare(pa.Table.from_batches(held))


def components_of(distinct: DataFrame) -> DataFrame:
    """(bits, component) of all different fingerprints (`bits`): the smallest number that links of `DISTANCE` bits reach.

    Equal index entries meet by one shuffle. A pair whose segments agree is tried in the whole segment's entry; an entry
    without a bit brings together only fingerprints that differ there. Entries that may be large are dealt out as pairs
    of blocks, and every tile gives fewer links than it has fingerprints.
    """
    index = distinct.select("bits", F.inline(_entries_of(F.col("bits"), [*range(len(entries()))])))
    crowded, n_crowded = _crowded(distinct)
    if n_crowded == 0:
        dealt = index.select("*", *[F.lit(0).alias(c) for c in ("block", "i", "j")])
    else:
        sized = index.join(F.broadcast(crowded) if n_crowded * 16 <= BROADCAST_BYTES else crowded, ["entry", "rest"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = (
            sized.withColumn("block", F.expr("cast(pmod(xxhash64(bits), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("bits", "entry", "rest", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        )
    placed = dealt.repartition(work_partitions(distinct.sparkSession), "entry", "rest", "i", "j").sortWithinPartitions("entry", "rest", "i", "j")
    links, _ = materialize(placed.mapInArrow(_links, "a long, b long").distinct())
    reached = connected_components(links).select(F.col("doc_id").alias("bits"), F.col("component_id").alias("component"))
    return distinct.join(reached, "bits", "left").select("bits", F.coalesce("component", "bits").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Words are runs of anything but white space with A-Z lower-cased; a fingerprint bit is set when over half of the
    XXH64 values (seed 42) of the four-word shingles have it (the whole sequence where it is shorter). Documents are
    linked at `DISTANCE` or fewer differing bits; `component_id` is the smallest id that links reach.

    Null and empty texts and texts without words have the fingerprint zero and are linked like others. Repeated rows
    (same id) each give a row. Null ids: the component of documents that have ids (null if none has). Extra columns
    are ignored; an empty table gives no rows. Equal fingerprints collapse before any search.
    """
    printed, _ = materialize(fingerprints(docs, id_col, text_col))
    distinct, _ = materialize(printed.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    grouped, _ = materialize(components_of(distinct.select("bits")).join(distinct, "bits"))
    named = grouped.join(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("bits", "component_id")
    hexed = F.lpad(F.lower(F.hex("bits")), 16, "0")
    return printed.join(named, "bits").select("doc_id", hexed.alias("fingerprint"), "component_id")
