"""Removal of long byte strings that occur more than once, by sorting sampled suffixes.

Every possible start of a string belongs to the anchor (the 32-byte gram of smallest hash) of its window, so
equal strings have equal anchors at equal distance. Starts are handled in blocks: all windows of a block share
a core of bytes, and only blocks whose core occurs more than once go on. Their right contexts and mirrored left
contexts are ordered by deep-shallow sorting: multikey quicksort on eight-byte words to a shallow depth, then
blind tries (which branch at first differences only) for the groups that are still tied. Two starts hold the
same string exactly when both orders keep them together deeply enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.bytesops import BASE_INVERSE, PLACE, mix, powers, prefix_hash, span_hash, text_chunks
from maskwright.session import materialize, work_partitions

LENGTH = 400
GRAM = 32
#: Starts in a block: half of the windows' possible distances to their anchor.
BLOCK = 185
SIDE = BLOCK - 1
CORE = LENGTH - SIDE
SHALLOW_WORDS = 2
#: Distinct contexts of a core that one task may hold; more are decided by counting hashed strings.
GROUP_LIMIT = 4096
BATCH_ROWS = 32_768
BROADCAST_KEYS = 1_000_000

_U = np.uint64


def tied_runs(order_keys: np.ndarray) -> np.ndarray:
    """Start flags of runs of equal values."""
    flags = np.ones(len(order_keys), bool)
    flags[1:] = order_keys[1:] != order_keys[:-1]
    return flags


def deep_shallow_order(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order of byte rows inside their groups (`group` must be ascending).

    Shallow: multikey quicksort, one big-endian word at a time, only for rows that are still tied. Deep: for
    every tied group a blind trie, built level by level for all groups at once: members branch off the group's
    first member at their first difference, and members that share that branch form the next level's groups.
    """
    n, width = rows.shape
    order = np.arange(n)
    if n == 0:
        return order
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    word = padded.view(">u8")
    segment = np.cumsum(tied_runs(group)) - 1
    for k in range(min(SHALLOW_WORDS, word.shape[1])):
        size = np.bincount(segment)
        at = np.flatnonzero(size[segment] > 1)
        if not len(at):
            return order
        key = word[order[at], k].astype(np.uint64)
        by = np.lexsort((key, segment[at]))
        order[at] = order[at][by]
        key = key[by]
        starts = np.ones(n, bool)
        starts[1:] = segment[1:] != segment[:-1]
        inner = np.zeros(len(at), bool)
        inner[1:] = (key[1:] != key[:-1]) & (segment[at][1:] == segment[at][:-1])
        starts[at[inner]] = True
        segment = np.cumsum(starts) - 1
    while True:
        size = np.bincount(segment)
        at = np.flatnonzero(size[segment] > 1)
        if not len(at):
            return order
        own = segment[at]
        first = np.flatnonzero(tied_runs(own))
        lead = np.repeat(order[at[first]], np.diff(np.append(first, len(at))))
        mine = order[at]
        shared = common_length(rows, mine, lead)
        inside = np.minimum(shared, width - 1)
        here, there = rows[mine, inside], rows[lead, inside]
        side = np.where(shared == width, 1, np.where(here < there, 0, 2)).astype(np.int64)
        depth = np.where(side == 2, width - shared, np.where(side == 1, 0, shared)).astype(np.int64)
        key = (side << 40) | (depth << 16) | np.where(side == 1, 0, here).astype(np.int64)
        by = np.lexsort((key, own))
        order[at] = mine[by]
        key, side = key[by], side[by]
        starts = np.ones(n, bool)
        starts[1:] = segment[1:] != segment[:-1]
        inner = np.zeros(len(at), bool)
        inner[1:] = (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        starts[at[inner]] = True
        starts[at[side == 1]] = True  # equal to the first member: ordered
        segment = np.cumsum(starts) - 1


def common_length(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a[i] and b[i]."""
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 8192):
        differ = rows[a[k : k + 8192]] != rows[b[k : k + 8192]]
        out[k : k + 8192] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(h) - width + 1], out[width - have : width - have + len(h) - width + 1])


def _anchored(raw: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of the runs of starts that share an anchor, for whole documents."""
    reach = LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none
    inverse = powers(BASE_INVERSE, len(raw))
    h = mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: len(raw) - GRAM + 1])
    low = _window_min(h, reach)
    valid = np.zeros(len(low) + 1, np.int8)
    size = np.diff(offsets)
    fits = size >= LENGTH
    np.add.at(valid, offsets[:-1][fits], 1)
    np.add.at(valid, offsets[1:][fits] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    bounds = offsets[:-1][fits]
    change[bounds] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(low)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    anchor = np.empty(len(first), np.int64)
    for k in range(0, len(first), 4096):
        x = first[k : k + 4096]
        anchor[k : k + 4096] = x + (h[x[:, None] + np.arange(reach)] == low[x][:, None]).argmax(1)
    late = np.flatnonzero(last > anchor)
    if len(late):  # the same gram stands more than once in these windows
        more = [np.delete(anchor, late)], [np.delete(first, late)], [np.delete(last, late)]
        for r in late:
            x, y = first[r], last[r]
            at = x + np.flatnonzero(h[x : y + reach] == low[x])
            at = at[: np.searchsorted(at, y) + 1]
            more[0].append(at)
            more[1].append(np.append(x, at[:-1] + 1))
            more[2].append(np.minimum(at, y))
        anchor, first, last = (np.concatenate(m) for m in more)
    return anchor, first, last


def _block_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, core's first byte in it, left and right bytes, core hash, hash of core and sides) of every block."""
    prefix = prefix_hash(raw)
    anchor, first, last = _anchored(raw, offsets, prefix)
    low, high = (anchor - last) // BLOCK, (anchor - first) // BLOCK
    which = np.concatenate([anchor - BLOCK * b for b in range(int(high.max(initial=0)) + 1)]) if len(anchor) else anchor
    used = np.concatenate([(low <= b) & (b <= high) for b in range(int(high.max(initial=0)) + 1)]) if len(anchor) else np.zeros(0, bool)
    at = np.unique(which[used])
    doc = np.searchsorted(offsets, at, side="right") - 1
    left = np.minimum(SIDE, at - offsets[doc])
    right = np.minimum(SIDE, offsets[doc + 1] - at - CORE)
    core = span_hash(prefix, at, at + CORE)
    full = mix(span_hash(prefix, at - left, at + CORE + right) + (left * 256 + right).astype(np.uint64) * PLACE[20])
    return doc, at - offsets[doc], left, right, core, full


def blocks(texts: DataFrame) -> DataFrame:
    """(core, whole, text_key, at, ext) of every block of `texts` (text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, _, raw, offsets in text_chunks(batch.column(1)):
                doc, at, left, right, core, full = _block_rows(raw, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(keys[i + doc]), pa.array(at, pa.int32()), pa.array(left * 256 + right, pa.int32())],
                    names=["core", "whole", "text_key", "at", "ext"],
                )

    return texts.mapInArrow(run, "core long, whole long, text_key long, at int, ext int")


def _sides(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(core, whole, n, ext, left, right): the bytes beside the core of each block in `wanted`, from whole texts."""
    places = wanted.groupBy("text_key", "unnamed", "carrier").agg(F.collect_list(F.struct("at", "core", "whole", "n", "ext")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(0)[k].as_buffer()
                raw = np.frombuffer(text, np.uint8)
                place = batch.column(1)[k].values
                at, ext = place.field("at").to_numpy().astype(np.int64), place.field("ext").to_numpy()
                around = np.zeros(len(raw) + 2 * SIDE, np.uint8)
                around[SIDE : SIDE + len(raw)] = raw
                for p in range(0, len(at), 16_384):
                    own = slice(p, p + 16_384)
                    left = around[at[own, None] + np.arange(SIDE)]
                    right = around[at[own, None] + np.arange(SIDE) + SIDE + CORE]
                    blob = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIDE), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [place.field("core")[own], place.field("whole")[own], place.field("n")[own], pa.array(ext[own]), blob(left), blob(right)],
                        names=["core", "whole", "n", "ext", "left", "right"],
                    )

    return (
        texts.join(places, ["text_key", "unnamed", "carrier"]).select(F.encode("text", "UTF-8").alias("raw"), "places")
        .mapInArrow(run, "core long, whole long, n long, ext int, left binary, right binary")
    )


def _masks(core: np.ndarray, n: np.ndarray, ext: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row i, column t: the string that starts t bytes into block i occurs elsewhere. `core` must be ascending."""
    rows = len(core)
    deepest = np.arange(BLOCK)
    valid = (deepest >= SIDE - (ext // 256)[:, None]) & (deepest <= (ext % 256)[:, None])
    out = valid & (n > 1)[:, None]
    by_right = deep_shallow_order(core, right)
    mirrored = np.ascontiguousarray(left[:, ::-1])
    by_left = deep_shallow_order(core, mirrored)
    depth = lambda order, data: np.where(core[order[1:]] == core[order[:-1]], common_length(data, order[1:], order[:-1]), -1)
    right_depth, left_depth = depth(by_right, right), depth(by_left, mirrored)
    right_class, left_class = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    for t in range(BLOCK):
        right_class[by_right] = np.append(0, np.cumsum(right_depth < t))
        left_class[by_left] = np.append(0, np.cumsum(left_depth < SIDE - t))
        at = np.flatnonzero(valid[:, t])
        key = left_class[at] * _U(rows) + right_class[at]
        by = np.argsort(key)
        key = key[by]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        out[at[by[same[:-1] | same[1:]]], t] = True
    return out


def _resolve(rows: DataFrame, partitions: int) -> DataFrame:
    """(core, whole, mask) of the blocks of cores with several contexts, each core in one task."""

    def done(table: pa.Table) -> pa.RecordBatch:
        side = lambda name: np.frombuffer(b"".join(table[name].to_pylist()), np.uint8).reshape(-1, SIDE)
        found = _masks(table["core"].to_numpy(), table["n"].to_numpy(), table["ext"].to_numpy(), side("left"), side("right"))
        hit = np.flatnonzero(found.any(1))
        packed = np.packbits(found[hit], axis=1)
        return pa.RecordBatch.from_arrays(
            [table["core"].take(hit).combine_chunks(), table["whole"].take(hit).combine_chunks(), pa.array([x.tobytes() for x in packed], pa.binary())],
            names=["core", "whole", "mask"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            rows += batch.num_rows
            if rows < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(waiting)
            core = table["core"].to_numpy()
            cut = int(np.searchsorted(core, core[-1]))  # the last core may go on
            if cut:
                yield done(table.slice(0, cut))
                waiting = table.slice(cut).to_batches()
                rows -= cut
        if waiting:
            yield done(pa.Table.from_batches(waiting))

    return rows.repartition(partitions, "core").sortWithinPartitions("core").mapInArrow(run, "core long, whole long, mask binary")


def _count_strings(rows: DataFrame) -> DataFrame:
    """As `_resolve`, for cores of very many contexts: every string is hashed and counted, no core is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            core, whole = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ext = batch.column(3).to_numpy()
            side = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIDE)
            both = np.concatenate([side(4), side(5)], 1)
            prefix = prefix_hash(np.ascontiguousarray(both).ravel())
            t = np.arange(BLOCK)
            starts = np.arange(len(core))[:, None] * (2 * SIDE) + t
            strings = mix(span_hash(prefix, starts, starts + SIDE) + core.view(np.uint64)[:, None] * PLACE[21] + t.astype(np.uint64) * PLACE[22])
            valid = (t >= SIDE - (ext // 256)[:, None]) & (t <= (ext % 256)[:, None])
            row, place = np.nonzero(valid)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core[row]), pa.array(whole[row]), pa.array(place, pa.int32()), pa.array(strings[row, place].view(np.int64)), batch.column(2).take(pa.array(row))],
                names=["core", "whole", "t", "string", "n"],
            )

    strings = rows.select("core", "whole", "n", "ext", "left", "right").mapInArrow(run, "core long, whole long, t int, string long, n long")
    again = strings.groupBy("string").agg(F.sum("n").alias("total")).where("total > 1")
    hits = strings.join(again, "string", "left_semi").groupBy("core", "whole").agg(F.collect_set("t").alias("ts"))

    @F.pandas_udf("binary")
    def packed(ts):
        import pandas as pd

        def one(places):
            flags = np.zeros(BLOCK, bool)
            flags[np.asarray(places, int)] = True
            return np.packbits(flags).tobytes()

        return pd.Series([one(x) for x in ts], dtype=object)

    return hits.select("core", "whole", packed("ts").alias("mask"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the covered bytes out of every text."""
    for batch in batches:
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for k in range(batch.num_rows):
            raw = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint8)
            place = batch.column(2)[k].values
            at, ext = place.field("at").to_numpy().astype(np.int64), place.field("ext").to_numpy()
            deepest = np.arange(BLOCK)
            flags = (deepest >= SIDE - (ext // 256)[:, None]) & (deepest <= (ext % 256)[:, None])
            masked = place.field("mask")
            partly = np.flatnonzero(masked.is_valid().to_numpy(zero_copy_only=False))
            if len(partly):
                packed = np.frombuffer(b"".join(masked.take(pa.array(partly)).to_pylist()), np.uint8).reshape(len(partly), -1)
                flags[partly] = np.unpackbits(packed, axis=1, count=BLOCK).astype(bool)
            row, t = np.nonzero(flags)
            edge = np.zeros(len(raw) + 1, np.int64)
            start = np.unique(at[row] - SIDE + t)
            edge[start] += 1
            np.subtract.at(edge, start + LENGTH, 1)
            covered = np.cumsum(edge[:-1]) > 0
            out["doc_id"].append(batch.column(0)[k].as_py())
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(covered.sum()))
            out["n_spans"].append(int((covered[1:] & ~covered[:-1]).sum() + covered[:1].sum()))
            out["kept_sha256"].append(hashlib.sha256(raw[~covered].tobytes()).hexdigest())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    Every byte covered by a 400-byte string that starts anywhere else too, in the same or another document, is
    removed; strings do not cross documents and are judged on the input. Copies of a text count as other places.

    Null texts are empty. Texts below 400 bytes lose nothing. Repeated rows each give a row (and are each other's
    copies). Null ids stay null. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    long_texts = texts.where(F.octet_length("text") >= LENGTH)
    found, _ = materialize(blocks(long_texts.select("text_key", "text")))

    contexts = found.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min("ext").alias("ext"), F.min(F.struct("text_key", "at")).alias("place"))
    # stored, so that both sides of the join are plain shuffles and Spark can split a core that very many contexts share
    per_core, _ = materialize(contexts.groupBy("core").agg(F.count("*").alias("contexts"), F.sum("n").alias("total")).where("total > 1").drop("total"))
    open_blocks, _ = materialize(contexts.join(per_core, "core").select("core", "whole", "n", "ext", "place.text_key", "place.at", "contexts"))

    # the row that gives a text's bytes: that of its smallest id, or one for all rows without an id
    unnamed = long_texts.where("doc_id IS NULL").groupBy("text_key").agg(F.first("text").alias("text"), F.lit(True).alias("unnamed"), F.lit(0).cast("long").alias("carrier"))
    carrying = long_texts.where("doc_id IS NOT NULL").select("text_key", "text", F.lit(False).alias("unnamed"), F.col("doc_id").alias("carrier")).unionByName(unnamed)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("carrier")))
    carriers = long_texts.groupBy("text_key").agg(best.alias("best")).select("text_key", "best.*")
    mixed = open_blocks.where("contexts > 1").join(carriers, "text_key")
    decided = _resolve(_sides(carrying, mixed.where(F.col("contexts") <= GROUP_LIMIT)), work_partitions(spark))
    crowded = mixed.where(F.col("contexts") > GROUP_LIMIT)
    if not open_blocks.where(F.col("contexts") > GROUP_LIMIT).isEmpty():
        decided = decided.unionByName(_count_strings(_sides(carrying, crowded)))
    decided = decided.unionByName(open_blocks.where("contexts = 1").select("core", "whole", F.lit(None).cast("binary").alias("mask")))

    marks = (
        found.join(decided, ["core", "whole"])
        .groupBy("text_key").agg(F.collect_set(F.struct("at", "ext", "mask")).alias("marks"))
    )
    marks, n_marked = materialize(marks.withColumn("one", F.lit(True)), "one")
    keys = marks.select("text_key")
    keys = F.broadcast(keys) if n_marked <= BROADCAST_KEYS else keys
    touched = (
        texts.join(keys, "text_key", "left_semi").join(marks, "text_key")
        .select("doc_id", F.encode("text", "UTF-8").alias("raw"), "marks")
        .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
    whole = texts.join(keys, "text_key", "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )
    return touched.unionByName(whole)
