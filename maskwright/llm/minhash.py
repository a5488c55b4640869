"""Near-duplicate documents: SetSketch registers, register bands, joint likelihood, exact confirmation.

A register is the exponentially spaced, truncated minimum of exponential values of a set's members, so the
registers of a union are the maxima of registers. Sets that resemble each other share register values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.bytesops import PLACE, mix, shingle_sets, text_chunks
from maskwright.llm.graph import connected_components
from maskwright.session import materialize

REGISTERS = 96
MOST_BANDS = 64
#: Bands are chosen so that a pair right at the threshold shares none of them with at most this chance.
MISSED = 5e-5
#: Registers step by this factor, scaled so that 16 bits hold sets of any size.
STEP = 1.001
SCALE = 20.0
TOP = 65_535
#: A pair is given up when its best likelihood at the threshold is below the best of all by this (five standard deviations).
LIKELIHOOD_DROP = 12.5
BLOCK = 512
#: Elements (and one more per so many) by which 32-bit hashes may misjudge an intersection; in doubt the whole sets decide.
SLACK, SLACK_PER = 2, 4000
BROADCAST_IDS = 1_000_000

_seeded = np.random.default_rng(77)
XOR = _seeded.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
TIMES = _seeded.integers(0, 1 << 62, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALT = _seeded.integers(1, 1 << 62, MOST_BANDS, dtype=np.uint64)


@cache
def band_plan(percent: int) -> np.ndarray:
    """The registers of every band: seeded subsets, every register in equally many bands.

    The longest bands are taken with which a pair at the threshold is missed rarely enough; the chance is that of
    all numbers of equal registers, because bands share registers.
    """
    share = percent / 100
    for rows in (8, 6, 4, 3, 2, 1):
        for bands in range(REGISTERS // rows, MOST_BANDS + 1, REGISTERS // rows):
            missed = sum(
                comb(REGISTERS, k) * share**k * (1 - share) ** (REGISTERS - k) * (1 - comb(k, rows) / comb(REGISTERS, rows)) ** bands
                for k in range(REGISTERS + 1)
            )
            if missed <= MISSED or rows == 1:
                order = np.random.default_rng(78)
                return np.concatenate([order.permutation(REGISTERS) for _ in range(bands * rows // REGISTERS)]).reshape(bands, rows)
    return np.arange(MOST_BANDS)[:, None]


def registers(members: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of registers for every non-empty set (hashes of its members between two offsets)."""
    smallest = np.empty((len(offsets) - 1, REGISTERS), np.float64)
    scratch = np.empty(len(members), np.uint64)
    for j in range(REGISTERS):
        np.bitwise_xor(members, XOR[j], out=scratch)
        np.multiply(scratch, TIMES[j], out=scratch)
        smallest[:, j] = np.minimum.reduceat(scratch, offsets[:-1])
    waiting = -np.log1p(-(smallest + 0.5) / 2.0**64) / SCALE
    return np.clip(np.floor(1 - np.log(waiting) / np.log(STEP)), 0, TOP).astype("<u2")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, same_a, same_b, registers): equal word shingle sets have equal `same_a`, `same_b`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in text_chunks(batch.column(1)):
                members, ends = shingle_sets(raw, offsets)
                size = np.diff(ends)
                some = size > 0
                regs = [None] * (j - i)
                same_a, same_b = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if some.any():
                    bounds = np.append(ends[:-1][some], ends[-1])
                    rows = registers(members, bounds)
                    for k, row in zip(np.flatnonzero(some), rows):
                        regs[k] = row.tobytes()
                    same_a[some] = np.add.reduceat(mix(members ^ PLACE[10]), bounds[:-1])
                    same_b[some] = np.add.reduceat(mix(members ^ PLACE[11]), bounds[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(same_a.view(np.int64)), pa.array(same_b.view(np.int64)), pa.array(regs, pa.binary())],
                    names=["doc_id", "n_shingles", "same_a", "same_b", "registers"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, same_a long, same_b long, registers binary")


def band_keys(rows: np.ndarray, percent: int) -> np.ndarray:
    """One key for every band of every row of registers."""
    plan = band_plan(percent)
    out = np.empty((len(rows), len(plan)), np.uint64)
    wide = mix(rows.astype(np.uint64) + np.uint64(1))
    for b, chosen in enumerate(plan):
        out[:, b] = mix((wide[:, chosen] * PLACE[: len(chosen)]).sum(1, dtype=np.uint64) + BAND_SALT[b])
    return out


def _rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, REGISTERS)


def _bands(sketched: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id) for every band of every sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_rows(batch.column(1).to_pylist()), percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "doc_id"]
                )

    return sketched.select("doc_id", "registers").mapInArrow(run, "key long, doc_id long")


def joint_likely(rows_a: np.ndarray, rows_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose similarity may reach the threshold: joint likelihood of larger, smaller and equal registers.

    For sets of known sizes the chances that a register of one is larger, smaller or equal depend on the
    similarity alone; the likelihood is maximised on a grid, with and without the threshold.
    """
    more = (rows_a > rows_b).sum(1)[:, None]
    less = (rows_a < rows_b).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 81)[None, :] * top
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / np.log(STEP)
    larger, smaller = chance(u - v * grid), chance(v - u * grid)
    log = lambda p: np.log(np.clip(p, 1e-12, 1))
    score = more * log(larger) + less * log(smaller) + same * log(1 - larger - smaller)
    at_least = np.where(grid >= threshold, score, -np.inf)
    at_least[:, -1] = np.where(top[:, 0] >= threshold, score[:, -1], -np.inf)
    return at_least.max(1) >= score.max(1) - LIKELIHOOD_DROP


def shingle_blobs(docs: DataFrame, ids: DataFrame, n_ids: int, short: bool = False) -> DataFrame:
    """(doc_id, members): the whole shingle set of every document named in `ids`, from its text; 32-bit hashes if `short`."""
    wanted = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in text_chunks(batch.column(1)):
                members, ends = shingle_sets(raw, offsets)
                if short:  # the upper halves of sorted hashes are sorted
                    members = (members >> np.uint64(32)).astype(np.uint32)
                blobs = [members[ends[k] : ends[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(blobs, pa.binary())], names=["doc_id", "members"])

    return docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, members binary")


def confirm(pairs: DataFrame, sketched: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on whole sets."""
    one = sketched.select("doc_id", "n_shingles", "registers")
    near = (
        pairs.join(one.toDF("a", "n_a", "regs_a"), "a").join(one.toDF("b", "n_b", "regs_b"), "b")
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    )

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if len(a) == 0:
            return pd.Series([], dtype=bool)
        parts = [
            joint_likely(_rows(a[k : k + 4096]), _rows(b[k : k + 4096]), n_a[k : k + 4096].to_numpy(float), n_b[k : k + 4096].to_numpy(float), percent / 100)
            for k in range(0, len(a), 4096)
        ]
        return pd.Series(np.concatenate(parts))

    near, _ = materialize(near.where(likely("regs_a", "regs_b", "n_a", "n_b")).select("a", "b", "n_a", "n_b"))
    ids = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
    ids, n_ids = materialize(ids.withColumn("one", F.lit(True)), "one")
    sets, _ = materialize(shingle_blobs(docs, ids, n_ids))

    @F.pandas_udf("long")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_shared(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(x, y)], dtype="int64")

    both = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = common("set_a", "set_b")
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), shared.alias("both")).where(
        F.col("both") * 100 >= (F.col("n") - F.col("both")) * percent
    ).select("a", "b")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _across(active: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a band and are links but for a few hash collisions.

    `active`: key, doc_id, component_id, n_shingles, registers, members, block, block pair (i, j). A key's
    documents are compared in pairs of blocks of bounded size, so a crowded key is spread over tasks. A pair is
    tried in its first common band only, by sets of 32-bit hashes. Once a pair that no collision could undo has
    joined its components, their other pairs are passed over; doubtful pairs join nothing, but come out too.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table["doc_id"].to_numpy(), table["component_id"].to_numpy().copy()
        size, block = table["n_shingles"].to_numpy().astype(float), table["block"].to_numpy()
        i, j, key = table["i"][0].as_py(), table["j"][0].as_py(), table["key"][0].as_py()
        rows = _rows(table["registers"].to_pylist())
        members = [np.frombuffer(m, np.uint32) for m in table["members"].to_pylist()]
        keys = band_keys(rows, percent).view(np.int64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = []
        for x in left:
            y = right[(comp[right] != comp[x]) & ((i != j) | (ids[right] > ids[x]))]
            y = y[np.minimum(size[y], size[x]) * 100 >= np.maximum(size[y], size[x]) * percent]
            if len(y):
                y = y[keys[x][(keys[y] == keys[x]).argmax(1)] == key]
            if len(y):
                y = y[joint_likely(np.broadcast_to(rows[x], (len(y), REGISTERS)), rows[y], np.full(len(y), size[x]), size[y], percent / 100)]
            for k in y:
                if comp[k] == comp[x]:
                    continue
                both, total = _shared(members[x], members[k]), len(members[x]) + len(members[k])
                slack = SLACK + total // SLACK_PER
                if 100 * (both + slack) >= percent * (total - both - slack):
                    links.append((int(min(ids[x], ids[k])), int(max(ids[x], ids[k]))))
                    if 100 * (both - slack) >= percent * (total - both + slack):
                        comp[comp == comp[k]] = comp[x]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return active.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Words are runs of anything but white space with A-Z lower-cased; the set holds distinct five-word
    shingles, or the whole sequence when it is shorter. Documents are linked when 100 * intersection >=
    percent * union. `component_id` is the smallest id that links reach, `kept` says that it is the own one.

    Null and empty texts and texts without words: zero shingles, no link, kept. Repeated rows (same id):
    each gives a row. Null ids: the component of equal documents with an id (else null), not kept. Extra columns are ignored; an empty table gives no rows.

    Equal sets collapse first. In every band all members are tried against the smallest id; documents of a
    band that are still in different components are then compared in blocks. Only links are written out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched, _ = materialize(sketches(texts))
    usable = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes, _ = materialize(
        usable.groupBy("same_a", "same_b", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    )
    firsts = usable.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    firsts, _ = materialize(firsts)

    bands = _bands(firsts, percent)
    crowded = bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    active, _ = materialize(bands.join(crowded, "key"))
    stars = active.where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    links, _ = materialize(confirm(stars, firsts, texts, percent))
    reached = connected_components(links)

    labelled = active.join(reached, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    mixed = labelled.groupBy("key").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x != y").select("key")
    ids, n_ids = materialize(labelled.join(mixed, "key", "left_semi").groupBy("doc_id").agg(F.lit(True).alias("one")), "one")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    open_rows = (
        labelled.join(mixed, "key", "left_semi")
        .withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
        .join(firsts.select("doc_id", "n_shingles", "registers"), "doc_id").join(shingle_blobs(texts, ids, n_ids, short=True), "doc_id")
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            "key", "doc_id", "component_id", "n_shingles", "registers", "members", "block",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )
    doubtful, _ = materialize(_across(open_rows, percent).distinct())
    final = connected_components(links.unionByName(confirm(doubtful, firsts, texts, percent)))

    by_class = classes.join(final.withColumnRenamed("doc_id", "class_id"), "class_id", "left").select(
        "same_a", "same_b", "n_shingles", F.coalesce("component_id", "class_id").alias("component_id")
    )
    return (
        sketched.join(by_class, ["same_a", "same_b", "n_shingles"], "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )
