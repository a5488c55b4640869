"""WARC archives written and read back by an index of byte ranges.

The index comes first: archive, offset, length, URL and digest of every record follow from the records' sizes
before anything is written. Spark's text writer then writes the archives (a record's closing blank lines are
the line separator), and readers turn the index entries of chosen records into few long, sorted ranges.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import materialize, shared_dir

#: Fixed values of the format.
VERSION, NEWLINE = "WARC/1.1", "\r\n"
SEPARATOR = NEWLINE + NEWLINE
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
#: Ranges closer than GAP are read as one, up to READ_BYTES (or one record, where that is larger).
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Bytes of records that a reading task is meant for.
TASK_BYTES = 32 << 20
#: Records that are inflated at once.
INFLATED_ROWS = 256


RECORD_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def _described(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"),
    )


def _placed(described: DataFrame, firsts: DataFrame, archives: int) -> DataFrame:
    """Adds type, reference and header of every record, and its archive. Depends on the row alone, so index and archives agree."""
    first = F.when(F.col("payload_bytes") >= LEAST_REVISIT_BYTES, F.col("first_id"))
    rows = described.join(firsts, "payload_digest", "left").withColumn("refers_to", F.when(first.isNotNull() & ~F.col("page_id").eqNullSafe(first), first))
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(NEWLINE))
    safe_url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(VERSION + NEWLINE),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", safe_url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", name(F.col("refers_to"))), line("WARC-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(NEWLINE),
    )
    return rows.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to",
        header.alias("header"), F.expr(f"cast(pmod(xxhash64(page_id, url, payload_digest), {archives}) as int)").alias("archive"),
    ).withColumn("length", F.octet_length("header") + F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0))


def _offset() -> Column:
    """Bytes before a record in its archive; rows that tie in this order are equal records."""
    before = Window.partitionBy("archive").orderBy("page_id", "url", "payload_digest").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.col("length") + len(SEPARATOR)).over(before), F.lit(0)).cast("long")


def write_archives(
    pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record for every page under `directory` and return the index.

    Index: page_id, url, record_type, refers_to, payload_bytes, payload_digest, archive, offset, length. Of pages
    with equal payloads of at least 100 bytes, the smallest id is a response and the others revisit it.

    Null html is an empty payload, a null URL gives no target line. Null ids are written as 'none'; they revisit a
    page with an id, or are responses where there is none. Rows that repeat an id are all responses when that id
    is the smallest. Extra columns are ignored; an empty table writes no archive.

    The index is stored first. Archives are files of about `archive_bytes` (one file each, larger only by what
    single records exceed it), each sorted in one task.
    """
    described = _described(pages, id_col, url_col, html_col)
    narrow = described.drop("html")
    firsts, _ = materialize(
        narrow.where(F.col("payload_bytes") >= LEAST_REVISIT_BYTES).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n")
    )
    total = narrow.agg(F.sum("payload_bytes")).first()[0] or 0
    archives = int(total // archive_bytes) + 1
    index, _ = materialize(
        _placed(described, firsts, archives).drop("html", "header").withColumn("offset", _offset())
    )
    # a revisit has no body, so its html ends here, before any shuffle; what is shuffled is deflated
    record = F.concat("header", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(""))
    keys = "archive int, page_id long, url string, payload_digest string, length long"
    (
        _placed(described, firsts, archives)
        .select("archive", "page_id", "url", "payload_digest", F.col("length").cast("long").alias("length"), record.cast("binary").alias("record"))
        .mapInArrow(_deflated, f"{keys}, record binary")
        .select("archive", _offset().alias("offset"), "record")
        .mapInArrow(_inflated, "archive int, offset long, record string")
        .sortWithinPartitions("archive", "offset").select("archive", "record")
        .write.partitionBy("archive").option("lineSep", SEPARATOR).text(directory)
    )
    return index


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        small = pa.array([zlib.compress(r) for r in batch.column("record").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], small], names=batch.schema.names)


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records again, a few at a time: a batch of small columns may hold large records."""
    for batch in batches:
        for at in range(0, batch.num_rows, INFLATED_ROWS):
            own = batch.slice(at, INFLATED_ROWS)
            records = pa.array([zlib.decompress(r) for r in own.column("record").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], records], names=batch.schema.names)


def _ranges(path: np.ndarray, offset: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of entries, sorted by file and offset, that are read at once."""
    i = 0
    for k in range(1, len(path) + 1):
        if (
            k == len(path) or path[k] != path[i] or offset[k] - (offset[k - 1] + length[k - 1]) > GAP
            or offset[k] + length[k] - offset[i] > READ_BYTES
        ):
            yield i, k
            i = k


def _parse(record: bytes) -> tuple:
    head, _, payload = record.partition(SEPARATOR.encode())
    fields = dict(line.split(": ", 1) for line in head.decode().split(NEWLINE)[1:])
    number = lambda name: None if fields[name] == "<urn:page:none>" else int(fields[name][10:-1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if len(payload) != int(fields["Content-Length"]):
        raise ValueError(f"record {fields['WARC-Record-ID']} has {len(payload)} bytes; expected {fields['Content-Length']}")
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), "revisit", number("WARC-Refers-To"), int(fields["WARC-Payload-Length"]), digest, None
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have the digest {digest} of its header")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), "response", None, len(payload), digest, payload


def _open(uri: str):
    """A random-access file of any store that Arrow knows."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    store, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_file(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, file = None, None
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        path = batch.column(0).to_pylist()
        offset, length = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for i, j in _ranges(path, offset, length):
            if path[i] != opened:
                opened, file = path[i], _open(path[i])
            block = file.read_at(int(offset[j - 1] + length[j - 1] - offset[i]), int(offset[i]))
            rows = [_parse(block[offset[k] - offset[i] : offset[k] - offset[i] + length[k]]) for k in range(i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_records(chosen: DataFrame, directory: str) -> DataFrame:
    """The records of the index entries in `chosen`: ids, URL, type, reference, full payload's size and digest, payload.

    A revisit has no payload of its own. Every response is checked against its digest. Entries are spread by
    stretches of their archives, so a large archive is read by many tasks.
    """
    spark = chosen.sparkSession
    size = chosen.agg(F.sum("length")).first()[0]
    if size is None:
        return spark.createDataFrame([], RECORD_SCHEMA)
    # the entries are few bytes, what they point at is not: the number of tasks follows the latter
    tasks = max(spark.sparkContext.defaultParallelism, int(size // TASK_BYTES) + 1)
    files = spark.read.format("binaryFile").load(directory).select("path", F.col("archive").cast("int").alias("archive"))
    places = (
        chosen.join(files, "archive").select("path", "offset", F.col("length").cast("long").alias("length"))
        .repartition(tasks, "path", F.expr(f"offset div {READ_BYTES}")).sortWithinPartitions("path", "offset")
    )
    return places.mapInArrow(_read, RECORD_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read every record back by the index."""
    directory = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc/{uuid.uuid4().hex}"
    return read_records(write_archives(pages, directory), directory)
