"""Document fingerprints that are sums of wide vectors hashed from paragraphs.

Every paragraph adds a vector: four lanes of its whole text modulo 2**64, and 256 lanes modulo 2**16 that count
its word triples with a sign. A sum does not depend on the order of paragraphs, equal multisets have equal sums,
and inserting or deleting a paragraph adds or subtracts its vector. The counting lanes of two documents have an
angle close to that of their triples, which gives a likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.bytesops import CHUNK_BYTES, mix, prefix_hash, shingle_hashes, span_hash, text_chunks, word_hashes
from maskwright.session import work_partitions

EXACT, LANES, RUN = 4, 256, 3
#: Bytes of text in a stretch of neighbouring documents, and the most stretches.
STRETCH_BYTES, STRETCHES = 32 << 20, 10_000
_SALT = np.random.default_rng(99).integers(1, 1 << 62, EXACT, dtype=np.uint64)
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def paragraph_vectors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed vectors (exact lanes, counting lanes) of the texts between `offsets`; paragraphs end at line feeds."""
    n = len(offsets) - 1
    feeds = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    # texts may be empty: every text has one paragraph more than line feeds
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, side="right") - 1])
    begin = np.concatenate([offsets[:-1], feeds + 1])
    by = np.lexsort((begin, owner))
    owner, begin = owner[by], begin[by]
    end = np.append(begin[1:] - 1, offsets[-1])
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = offsets[owner[last] + 1]
    whole = span_hash(prefix_hash(raw), begin, end)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    exact = np.stack([np.add.reduceat(mix(whole + salt), first) for salt in _SALT], 1)

    inside = np.append(starts[starts <= len(raw)], len(raw)) if len(starts) else np.array([0, len(raw)])
    hashed, first_word = word_hashes(raw, inside)
    runs, ends = shingle_hashes(hashed, first_word, RUN)
    text = np.searchsorted(offsets, inside[:-1], side="right") - 1
    text = np.repeat(text, np.diff(ends))
    sign = ((runs >> np.uint64(8)) & np.uint64(1)).astype(np.float64) * 2 - 1
    lanes = np.bincount(text * LANES + (runs & np.uint64(LANES - 1)).astype(np.int64), sign, n * LANES).reshape(n, LANES)
    return exact, (lanes.astype(np.int64) & 0xFFFF).astype("<u2")


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of whole texts, in chunks of bounded size."""
    parts = [paragraph_vectors(raw, offsets) for _, _, raw, offsets in text_chunks(pa.array(texts, pa.large_string()), CHUNK_BYTES)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def combined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], delete: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Vectors after inserting (or deleting) the paragraphs of `b`."""
    return (a[0] - b[0], a[1] - b[1]) if delete else (a[0] + b[0], a[1] + b[1])


def _shown(v: tuple[np.ndarray, np.ndarray]) -> list[str]:
    return [base64.b64encode(e.astype("<u8").tobytes() + c.tobytes()).decode() for e, c in zip(*v)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosine of the counting lanes, 0 to 1; equal fingerprints have 1, and so has nothing else."""
    x, y = a[1].view("<i2").astype(float), b[1].view("<i2").astype(float)
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    near = np.clip((x * y).sum(1) / np.where(size > 0, size, 1), 0, 1 - 1e-9)
    return np.where((a[0] == b[0]).all(1) & (a[1] == b[1]).all(1), 1.0, near)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, every stretch ended by the first document of the next one."""
    kept: tuple | None = None  # the last row of what was read, with its vectors

    def rows(ids: list, texts: list[str], v: tuple) -> pa.RecordBatch:
        # text i is followed by text i + 1
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts[:-1], texts[1:])]
        e = vectors(edited)
        head, tail = (v[0][:-1], v[1][:-1]), (v[0][1:], v[1][1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_shown(head)), pa.array(_shown(e)),
                pa.array(likeness(head, e)), pa.array(likeness(head, tail)),
            ],
            names=[c.split()[0] for c in RESULT.split(", ")],
        )

    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            ids, texts, ended = (c.to_pylist() for c in part.columns)
            v = vectors(texts)
            if kept is not None:
                ids, texts, ended = [kept[0], *ids], [kept[1], *texts], [False, *ended]
                v = (np.concatenate([kept[2], v[0]]), np.concatenate([kept[3], v[1]]))
            start = 0
            for end in [k for k, x in enumerate(ended) if x]:
                if end > start:
                    yield rows(ids[start : end + 1], texts[start : end + 1], (v[0][start : end + 1], v[1][start : end + 1]))
                start = end + 1
            if len(ids) - start > 1:
                yield rows(ids[start:], texts[start:], (v[0][start:], v[1][start:]))
            kept = (ids[-1], texts[-1], v[0][-1:], v[1][-1:]) if start < len(ids) else None


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document by ascending id, of the first after the last. Likeness is that of fingerprints.

    Null texts are empty. Null ids come first. Rows with one id follow each other by text; repeated rows each give
    a row. A single document is its own next one. Extra columns are ignored; an empty table gives no rows.

    Texts move once: stretches of ids (bounds are a quantile sketch, they only lay out the work) are sorted each in
    one task, and the first document of a stretch is sent to the one before as well.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    wanted = int(min(STRETCHES, max(work_partitions(spark), size // STRETCH_BYTES + 1)))
    bounds = np.unique(texts.approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 1 / (4 * wanted)) or [0])

    @F.pandas_udf("int")
    def stretch(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0), side="left")).astype(np.int32))

    placed = texts.withColumn("stretch", stretch("doc_id"))
    least = placed.groupBy("stretch").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least")).collect()
    order = sorted(least, key=lambda r: r["stretch"])
    firsts = [(order[k]["least"]["doc_id"], order[k]["stretch"], order[k - 1]["stretch"]) for k in range(len(order))]
    starts = spark.createDataFrame(firsts, "first_id long, own int, before int")
    following = (
        placed.join(F.broadcast(starts), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("stretch") == F.col("own")))
        .groupBy("before", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("before").alias("stretch"))
    )
    rows = placed.withColumn("ended", F.lit(False)).unionByName(following.withColumn("ended", F.lit(True)))
    return (
        rows.repartition(wanted, "stretch").sortWithinPartitions("stretch", "ended", F.col("doc_id").asc_nulls_first(), "text")
        .select("doc_id", "text", "ended").mapInArrow(_compare, RESULT)
    )
