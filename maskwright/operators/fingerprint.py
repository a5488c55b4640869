"""Fingerprints of tables, files and memberships, and freshness from comparing them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.digest import Sha256, resumable
from maskwright.session import materialize, shared_dir, work_partitions

#: Files of up to this many bytes are hashed by one expression; larger ones split by split.
WHOLE_FILE = 64 * 2**20
#: Bytes of a stored piece of a file, and of a row group, which a writer holds in memory.
PIECE, ROW_GROUP = 2**18, 16 * 2**20
#: Names that make Spark's text reader decompress.
COMPRESSED = r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def canonical_row(df: DataFrame, columns: list[str], decimals: int = 6) -> Column:
    """Sorted-key JSON text of a row without spaces; floating numbers as fixed-decimal text."""
    types = dict(df.dtypes)
    parts = []
    for c in sorted(columns):
        value = fixed(F.col(c), decimals) if types[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit(""))
        parts.append(value.alias(c))
    return F.to_json(F.struct(*parts))


def table_fingerprint(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """One row (table, rows, digest, columns) for a projection, independent of row order.

    Row hashes are added up as four 32-bit quarters of sha256 plus the row count, so the digest is a
    plain aggregate: partial sums in every task, no sort and no list of all rows. Rows that occur
    twice count twice.
    """
    columns = columns or df.columns
    hashed = df.select(F.sha2(canonical_row(df, columns), 256).alias("h"))
    quarters = [
        F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"q{i}") for i in range(4)
    ]
    sums = hashed.agg(F.count("*").alias("rows"), *quarters)
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.coalesce(F.col(f"q{i}"), F.lit(0)).cast("string") for i in range(4)])
    return sums.select(
        F.lit(name).alias("table"), "rows", F.sha2(text, 256).alias("digest"), F.lit(",".join(sorted(columns))).alias("columns")
    )


def _bounds(column: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    """Where the values of a binary column begin and end, and the buffer that they lie in."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1], data


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, at, line) joined to pieces (file, at, seq, n, content); a split's lines follow one another."""
    seq = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        files, at = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        codes = files.indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])]))
        ends, data = _bounds(batch.column(2))
        cuts = [int(ends[k]) for k in [*first, len(at)]]
        cut = [(k, z, min(PIECE, y - z)) for k, x, y in zip(first.tolist(), cuts, cuts[1:]) for z in range(x, y, PIECE)]
        rows, content = np.array([k for k, _, _ in cut]), [data.slice(z, m).to_pybytes() for _, z, m in cut]
        yield pa.RecordBatch.from_arrays(
            [files.take(pa.array(rows)).cast(pa.string()), pa.array(at[rows]), pa.array(range(seq, seq + len(rows)), pa.int64()), pa.array([len(c) for c in content], pa.int64()), pa.array(content, pa.binary())],
            names=["file", "at", "seq", "n", "content"],
        )
        seq += len(rows)


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests taken on: (file, size, total, state) from rows (file, size, total, state, content), where a file's state comes before its pieces."""
    file = sha = size = total = None
    row = lambda: pa.RecordBatch.from_pydict({"file": [file], "size": [size], "total": [total], "state": [sha.state]})
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends, data = _bounds(batch.column(4))
        ends = ends.tolist()
        for k, name in enumerate(batch.column(0).to_pylist()):
            if name != file:
                if file is not None:
                    yield row()
                file, size, total, state = name, *(batch.column(c)[k].as_py() for c in (1, 2, 3))
                sha = Sha256(state)
                if state is None and size - total >= 2:
                    sha.update(_address(BYTE_ORDER_MARK), len(BYTE_ORDER_MARK))
            elif ends[k + 1] > ends[k]:
                sha.update(data.address + ends[k], min(ends[k + 1] - ends[k], size - sha.length))
    if file is not None:
        yield row()


def _address(raw: bytes) -> int:
    return pa.py_buffer(raw).address


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"file": [], "digest": []}
        for r in batch.to_pylist():
            sha = Sha256(r["state"])
            if sha.length != r["size"] or r["size"] - r["total"] not in (-1, 0, 2, 3):
                raise ValueError(f"{r['total']} bytes of {r['file']} were read; expected {r['size']}")
            out["file"].append(r["file"])
            out["digest"].append(sha.hexdigest())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("file", pa.string()), ("digest", pa.string())]))


def _large_digests(large: DataFrame, n: int, lines: DataFrame, whole: int) -> DataFrame:
    """(file, digest) of the `n` files above `whole` bytes, split by split: a task goes through one split of a file and hands on the digest's state."""
    spark = lines.sparkSession
    stored = f"{shared_dir(spark).rstrip('/')}/maskwright/pieces-{uuid.uuid4().hex}"
    wanted = lines.where(F.col("size") > whole).join(F.broadcast(large.select("file")), "file", "left_semi")
    cut = wanted.select("file", "at", "line").mapInArrow(_pieces, "file string, at long, seq long, n long, content binary")
    cut.write.partitionBy("at").option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", False).parquet(stored)
    pieces = spark.read.schema("file string, seq long, n long, content binary, at long").parquet(stored)
    totals = pieces.groupBy("file").agg(F.sum("n").alias("total"))
    state = "file string, size long, total long, state binary"
    # a file of which nothing was read is an error at the end, not a missing row
    states, _ = materialize(large.join(totals, "file", "left").select("file", "size", F.coalesce("total", F.lit(0)).alias("total"), F.lit(None).cast("binary").alias("state")))
    tasks = min(work_partitions(spark), 4 * n)
    for r in pieces.select("at").distinct().orderBy("at").collect():  # splits of the largest file
        split = pieces.where(F.col("at") == r["at"]).select("file", "seq", "content")
        rows = states.select("*", F.lit(-1).cast("long").alias("seq"), F.lit(bytearray()).alias("content")).unionByName(split, allowMissingColumns=True)
        ordered = rows.repartition(tasks, "file").sortWithinPartitions("file", "seq").select("file", "size", "total", "state", "content")
        states, _ = materialize(ordered.mapInArrow(_advance, state))
    return states.mapInArrow(_finished, "file string, digest string")


def file_digests(files: DataFrame, lines: DataFrame, whole: int = WHOLE_FILE) -> DataFrame:
    """(name, digest, bytes): SHA-256 of each file of a binaryFile scan, by base name.

    Files of up to `whole` bytes are hashed as they are. Larger ones, of any size, come from `lines` (of `file_lines`): their splits
    are hashed one after another, each in a task of its own that takes up where the last one ended. Files whose names Spark's
    reader would decompress by, and all files where OpenSSL cannot be reached, are hashed whole, up to Spark's 2 GB a value, which
    is also the longest stretch without a line feed that `lines` can hold.
    """
    name = F.element_at(F.split("path", "/"), -1)
    hashed = lambda rows: rows.select(name.alias("name"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))
    if not resumable():
        return hashed(files)
    # asked for in this form, sizes and names keep Spark from opening the other files
    small, above = files.where(F.col("length") <= whole), files.where(F.col("length") > whole)
    packed = F.lower(F.col("_metadata.file_name")).rlike(COMPRESSED)
    large, n = materialize(above.where(~packed).select(F.col("_metadata.file_path").alias("file"), name.alias("name"), F.col("length").alias("size"), F.lit(True).alias("_row")), "_row")
    digests = hashed(small).unionByName(hashed(above.where(packed)))
    if n == 0:
        return digests
    return digests.unionByName(_large_digests(large, n, lines, whole).join(large, "file").select("name", "digest", F.col("size").alias("bytes")))


def files_of_split(files: DataFrame, split: DataFrame, key: str = "name") -> DataFrame:
    """One digest over the files that the split names, and how many are absent."""
    joined = split.select(key).distinct().join(files, key, "left")
    quarters = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", key, "digest"), 256), 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"q{i}") for i in range(4)]
    sums = joined.agg(F.count("*").alias("files"), F.count(F.when(F.col("digest").isNull(), 1)).alias("absent"), *quarters)
    text = F.concat_ws(":", F.col("files").cast("string"), *[F.col(f"q{i}").cast("string") for i in range(4)])
    return sums.select("files", "absent", F.sha2(text, 256).alias("digest"))


def membership_fingerprint(membership: DataFrame, by: list[str], key: str = "sample_id") -> DataFrame:
    """Digest and size of the key set of each group, independent of order and computed by sums."""
    h = F.sha2(F.col(key).cast("string"), 256)
    quarters = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"q{i}") for i in range(4)]
    sums = membership.groupBy(*by).agg(F.count("*").alias("n"), *quarters)
    text = F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"q{i}").cast("string") for i in range(4)])
    return sums.select(*by, "n", F.sha2(text, 256).alias("digest"))


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """absent, obsolete or reusable per table, with the names of the differing parts."""
    parts = ["rows", "digest", "columns"]
    left = stored.select("table", *[F.col(p).alias(f"s_{p}") for p in parts], F.lit(True).alias("_s"))
    right = current.select("table", *[F.col(p).alias(f"c_{p}") for p in parts])
    joined = right.join(left, "table", "full_outer")
    differing = F.filter(F.array(*[F.when(~F.col(f"s_{p}").eqNullSafe(F.col(f"c_{p}")), F.lit(p)) for p in parts]), lambda p: p.isNotNull())
    status = F.when(F.col("_s").isNull(), "absent").when(F.size(differing) > 0, "obsolete").otherwise("reusable")
    return joined.select("table", status.alias("status"), F.when(F.col("_s").isNull(), "").otherwise(F.array_join(differing, ",")).alias("differing"))


@dataclass(frozen=True)
class Remembered:
    """What was stored of a table before a run: sums for each hash bucket, and a hash of every row beside its key, by bucket."""

    table: str
    key: str
    columns: tuple[str, ...]
    buckets: int
    path: str


def _row_hashes(df: DataFrame, key: str, columns: tuple[str, ...], buckets: int) -> DataFrame:
    text = canonical_row(df, list(columns))
    return df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.col(key).cast("string").alias("key"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def _bucket_sums(rows: DataFrame) -> DataFrame:
    """(bucket, n, h, g): counts and sums of both hashes, cut to 32 bits before they are added."""
    part = lambda c: F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), part("h").alias("h"), part("g").alias("g"))


def remember(df: DataFrame, table: str, key: str, columns: list[str] | None = None, buckets: int = 256) -> Remembered:
    """Store fingerprints of the projection of `df` to `columns` (all by default), to be compared after a run."""
    columns_ = tuple(columns or df.columns)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/maskwright/remembered-{uuid.uuid4().hex}"
    _row_hashes(df, key, columns_, buckets).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema("key string, h long, g long, bucket int").parquet(f"{path}/rows")
    _bucket_sums(stored).write.parquet(f"{path}/sums")
    return Remembered(table, key, columns_, buckets, path)


def changed_rows(before: Remembered, df: DataFrame) -> DataFrame:
    """(table, key, change): keys whose rows were `added`, `removed` or `changed` since `before`; equal rows count as often as they stand.

    The table is read once for its bucket sums. Only buckets that differ are compared row by row, and only their stored
    rows are read. No change gives no rows.
    """
    spark = df.sparkSession
    rows = _row_hashes(df, before.key, before.columns, before.buckets)
    old, _ = materialize(spark.read.schema("bucket int, n long, h long, g long").parquet(f"{before.path}/sums"))
    new, _ = materialize(_bucket_sums(rows))
    same = ["bucket", "n", "h", "g"]
    differing = sorted(r["bucket"] for r in old.select(*same).exceptAll(new.select(*same)).unionByName(new.select(*same).exceptAll(old.select(*same))).select("bucket").distinct().collect())  # at most `buckets`
    if not differing:
        return spark.createDataFrame([], "table string, key string, change string")
    stored = spark.read.schema("key string, h long, g long, bucket int").parquet(f"{before.path}/rows").where(F.col("bucket").isin(differing))
    count = lambda d, n: d.groupBy("key", "h", "g").agg(F.count("*").alias(n))
    both = count(stored, "was").join(count(rows.where(F.col("bucket").isin(differing)), "now"), ["key", "h", "g"], "full_outer").fillna(0, ["was", "now"])
    moved = both.where("was != now").groupBy("key").agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    change = F.when(F.col("was") == 0, "added").when(F.col("now") == 0, "removed").otherwise("changed")
    return moved.select(F.lit(before.table).alias("table"), "key", change.alias("change"))


def descendants(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Transitive closure (ancestor, descendant) of a small edge table, each stage included."""
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("ancestor")).distinct()
    closure, size = materialize(nodes.select("ancestor", F.col("ancestor").alias("descendant"), F.lit(True).alias("_row")), "_row")
    for _ in range(max_rounds):
        step = closure.join(edges, F.col("descendant") == F.col("parent")).select("ancestor", F.col("child").alias("descendant"))
        grown, grown_size = materialize(closure.unionByName(step).distinct().withColumn("_row", F.lit(True)), "_row")
        if grown_size == size:
            return grown
        closure, size = grown, grown_size
    raise RuntimeError(f"closure still grew after {max_rounds} rounds")
