"""Spelling variants: words one edit apart, by tiles of padded code-point matrices.

Two words are one edit apart when their common prefix and common suffix together reach the longer length less
one. Matrices of code points, one filled from the left and one from the right, give both lengths for whole tiles
of words at once. Tiles hold words that share a prefix and a suffix which every edit must leave untouched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.session import materialize, work_partitions

RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: Every so many-th run of a document (by its hash) loses a code point.
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: A word is cut into so many parts; an edit touches one, and the others are the key.
PARTS = 3
#: Words of a key beyond this many are compared in pairs of blocks; cells of a tile's comparison; rows gathered for tiles.
BLOCK, CELLS, GATHERED = 2048, 1 << 22, 1 << 14
HELD_WORDS = 200_000
BROADCAST_BYTES = 8 << 20


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): damaged runs of the documents, counted until `HELD_WORDS` different ones are held."""
    count: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        long = [(w, n) for w, n in count.items() if len(w) >= LEAST_LENGTH]
        count.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            doc, text = doc.as_py(), text.as_py()
            if not text:
                continue
            head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            # a code point above U+00FF is no part of a run, so that one byte stands for every code point
            for run, n in Counter(RUN.findall(text.encode("latin-1", "replace").lower())).items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
                if h % DAMAGED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                count[run] += n
            if len(count) > HELD_WORDS:
                yield flush()
    yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least `LEAST_LENGTH` code points that occur `LEAST_COUNT` times or more in all documents."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(_runs, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _index(words: DataFrame) -> DataFrame:
    """(key, longest, word, n): for pairs whose longer word has `longest` letters, a key for each part that may hold the edit.

    With cuts c[0] = 0 .. c[PARTS] = longest, an edit after p common letters stands in the part i with
    c[i] <= p < c[i + 1]; then the first c[i] and the last longest - c[i + 1] letters agree.
    """
    entries = []
    for more in (0, 1):
        longest = F.char_length("word") + more
        for i in range(PARTS):
            first = (longest * i / PARTS).cast("int")
            last = longest - (longest * (i + 1) / PARTS).cast("int")
            key = F.xxhash64(longest, F.lit(i), F.substr("word", F.lit(1), first), F.when(last > 0, F.substr("word", F.char_length("word") - last + 1, last)).otherwise(""))
            entries.append(F.struct(key.alias("key"), longest.alias("longest"), F.lit(i).alias("part")))
    return words.select("word", "n", F.explode(F.array(*entries)).alias("e")).select("e.key", "e.longest", "e.part", "word", "n")


def code_points(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of the words' code points, filled from the left and from the right (reversed), and the lengths."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    within = np.arange(width)[None, :] < size[:, None]
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    left[within] = flat
    right[within] = np.frombuffer(b"".join(w[::-1] for w in words), np.uint8)
    return left, right, size


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns that agree before the first that does not, row by row."""
    apart = x != y
    at = apart.argmax(1)
    return np.where(apart[np.arange(len(x)), at], at, x.shape[1])


def near_pairs(left: np.ndarray, right: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, longest: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows are one edit apart, have the longer length `longest`, and are due in this `part`."""
    wide = np.maximum(size[i], size[j])
    short = np.minimum(size[i], size[j])
    out = (wide == longest) & (wide - short <= 1)
    at = np.flatnonzero(out)
    prefix = np.minimum(_common(left[i[at]], left[j[at]]), short[at])
    suffix = np.minimum(_common(right[i[at]], right[j[at]]), short[at])
    near = (prefix + suffix >= wide[at] - 1) & ((prefix < wide[at]) | (wide[at] != short[at]))
    # a pair stands under several keys when the letters around its edit repeat; it counts in the first of them
    lowest = np.full(len(at), PARTS)
    for k in reversed(range(PARTS)):
        holds = (prefix >= wide[at] * k // PARTS) & (suffix >= wide[at] - wide[at] * (k + 1) // PARTS)
        lowest = np.where(holds, k, lowest)
    out[at] = near & (lowest == part[at])
    return out


def _tiles(start: np.ndarray, end: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, bucket) of all pairs inside the buckets [start, end), a bounded number at once."""
    size = end - start
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    after = end[row] - place - 1
    total = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(total, total[at] + cells, "right")) - 1)
        n = after[at:to]
        first = np.repeat(place[at:to], n)
        other = first + 1 + np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        yield first, other, np.repeat(row[at:to], n)
        at = to


def _compare(rows: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best): near words of whole buckets, summed up word by word."""
    key = np.stack([rows[c].to_numpy() for c in ("key", "i", "j")], 1)
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    end = np.append(edge[1:], len(key))
    longest, part, n, side = (rows[c].to_numpy() for c in ("longest", "part", "n", "block"))
    words = [w.encode("latin-1") for w in rows["word"].to_pylist()]
    width = int(longest.max())
    left, right, size = code_points(words, width)
    found = []
    for i, j, bucket in _tiles(edge, end, max(1, CELLS // width)):
        mixed = (key[i, 1] == key[i, 2]) | (side[i] != side[j])
        i, j, bucket = i[mixed], j[mixed], bucket[mixed]
        near = near_pairs(left, right, size, i, j, longest[edge[bucket]], part[edge[bucket]])
        found.append((i[near], j[near]))
    a = np.concatenate([x for p in found for x in p] or [np.zeros(0, np.int64)])
    b = np.concatenate([x for i, j in found for x in (j, i)] or [np.zeros(0, np.int64)])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays(
        [rows["word"].take(pa.array(a[first])).combine_chunks().cast(pa.string()), pa.array(many, pa.int64()), pa.array(n[b[first]], pa.int64()), rows["word"].take(pa.array(b[first])).combine_chunks().cast(pa.string())],
        names=["word", "n_near", "best_n", "best"],
    )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares rows that come in order of their buckets; a bucket is never cut."""
    held: list[pa.RecordBatch] = []
    n_held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, GATHERED):
            piece = batch.slice(at, GATHERED)
            held.append(piece)
            n_held += piece.num_rows
            if n_held < GATHERED:
                continue
            rows = pa.Table.from_batches(held)
            key = np.stack([rows[c].to_numpy() for c in ("key", "i", "j")], 1)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if not len(edge):
                continue
            yield from _by_length(rows.slice(0, edge[-1]))
            held = rows.slice(edge[-1]).to_batches()
            n_held = len(rows) - int(edge[-1])
    if n_held:
        yield from _by_length(pa.Table.from_batches(held))


def _by_length(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Matrices are as wide as their longest word, so words of one length go together."""
    longest = rows["longest"].to_numpy()
    for w in np.unique(np.minimum(longest, 32)):
        chosen = np.flatnonzero(np.minimum(longest, 32) == w)
        if w < 32:
            yield _compare(rows.take(pa.array(chosen)))
        else:
            for exact in np.unique(longest[chosen]):
                yield _compare(rows.take(pa.array(np.flatnonzero(longest == exact))))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of `words` (word, n) that has others one edit apart.

    `best` has the largest n, the smallest in code-point order among equals. Keys with more than `BLOCK` words
    are dealt out as pairs of blocks; only sums for each word leave a tile, never its pairs.
    """
    spark = words.sparkSession
    index = _index(words)
    crowded, n_crowded = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK).withColumn("one", F.lit(True)), "one")
    if n_crowded == 0:
        dealt = index.select("*", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        blocks = F.coalesce(F.ceil(F.col("rows") / BLOCK), F.lit(1)).cast("int")
        cut = index.join(F.broadcast(crowded) if n_crowded * 16 <= BROADCAST_BYTES else crowded, "key", "left").withColumn("blocks", blocks)
        dealt = (
            cut.withColumn("block", F.expr("cast(pmod(xxhash64(word), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("key", "longest", "part", "word", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        )
    placed = dealt.repartition(work_partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = placed.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best")
    )


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from every `word` by `form`, by doubled pointers.

    A form is at least `TIMES` as frequent as its word, so that chains are short and never closed.
    """
    steps, moved = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "moved")
    while moved:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        steps, moved = materialize(
            steps.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "moved"
        )
    return steps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased are the words; a run whose hash with its
    document's id is a multiple of `DAMAGED` loses one code point. A word's form is the most frequent word one edit
    away, if that is at least twice as frequent; the root is the last of its chain of forms.

    Null and empty texts have no words. A null id counts as an empty one. Repeated rows count each time. Ties of
    forms go to the smallest word. Extra columns are ignored; an empty table gives no rows.
    """
    words, _ = materialize(word_counts(docs, id_col, text_col))
    near, _ = materialize(near_words(words))
    formed, _ = materialize(words.join(near, "word", "left").withColumn("fits", F.coalesce(F.col("best_n") >= TIMES * F.col("n"), F.lit(False))).select(
        "word", F.when(F.col("fits"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best_n")).alias("form_n")
    ))
    roots = followed(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
