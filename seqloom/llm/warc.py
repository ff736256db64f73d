"""WARC archives through a chunked record table.

A payload is a run of rows (record, chunk number, bytes), each with the length and digests of the payload
up to its end, so no step behind the source holds more of a payload than a chunk. The last chunk's
figures are the payload's, and equal payloads are found on them before any header is written.

Writing: Spark's text sink with ``\\r\\n`` as line separator writes one chunk a row. Payloads go out in
HTTP chunked transfer coding, whose chunks end with that very separator, so the files are plain WARC 1.1
(gzip over the whole file). The digest is that of the decoded payload, as the standard has it.
Reading: the same lines, in file order, run through a parser that again gives out chunks and carries
digests. Both work on any store that Spark reads, and a lost task is run again by Spark.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.skew import join_spread, work_partitions
from seqloom.session import new_shared_path, register, release, stored

CHUNK_BYTES = 1 << 20
#: Bytes of payload in one Arrow batch, about.
BATCH_BYTES = 8 << 20
#: Fixed values of the WARC 1.1 and HTTP formats.
EOL = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
HTTP_HEAD = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"
CHUNKED = f"Transfer-Encoding: chunked{EOL}"
LAST_CHUNK = f"0{EOL}{EOL}"
DATE = "1970-01-01T00:00:00Z"
#: Record identifiers are ``<urn:x-row:ROW:ID>``; an absent id is written so.
URN, ABSENT = "urn:x-row:", "~"

_CHUNK_FIELDS = [
    ("row", pa.int64()),
    ("chunk", pa.int64()),
    ("data", pa.binary()),
    ("n_bytes", pa.int64()),
    ("sha1", pa.string()),
    ("sha256", pa.string()),
    ("last", pa.bool_()),
]


def base32_sha1(digest: hashlib._Hash) -> str:
    return base64.b32encode(digest.digest()).decode()


class _Batches:
    """Rows gathered into Arrow batches of a bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 200
        if self.size >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.size = [], 0


def chunk_table(rows: DataFrame, record_id: Column, payload: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The payloads of ``rows`` as chunk rows, stored: the columns above, and ``id`` and ``url`` on the last chunk.

    ``payload`` is text (taken as UTF-8) or binary; null is an empty payload, which has one empty chunk.
    ``rows`` needs a column ``url``. ``row`` tells repeated rows apart.
    """
    named = rows.select(
        F.monotonically_increasing_id().alias("row"),
        record_id.alias("id"),
        F.col("url").cast("string").alias("url"),
        payload.cast("binary").alias("payload"),
    )
    # The kind of id is kept: an Arrow type of its own would have to be guessed for each Spark type.
    id_type = dict(named.dtypes)["id"]
    source = named.withColumn("id", F.col("id").cast("string"))
    schema = pa.schema([*_CHUNK_FIELDS, ("id", pa.string()), ("url", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches(schema)
        for batch in batches:
            for row, name, url, value in zip(*batch.columns):
                whole = value.as_buffer() if value.is_valid else pa.py_buffer(b"")
                short, long = hashlib.sha1(), hashlib.sha256()
                at, chunk = 0, 0
                while True:
                    part = whole.slice(at, min(chunk_bytes, whole.size - at))
                    short.update(part)
                    long.update(part)
                    at += part.size
                    last = at >= whole.size
                    yield from out.add(
                        (
                            row.as_py(),
                            chunk,
                            part.to_pybytes(),
                            at,
                            base32_sha1(short),
                            long.hexdigest(),
                            last,
                            name.as_py() if last else None,
                            url.as_py() if last else None,
                        ),
                        part.size,
                    )
                    if last:
                        break
                    chunk += 1
        yield from out.flush()

    ddl = "row long, chunk long, data binary, n_bytes long, sha1 string, sha256 string, last boolean, id string, url string"
    table = source.mapInArrow(cut, ddl).withColumn("id", F.col("id").cast(id_type))
    return stored(table, "warc-chunks", compression="zstd")


def decide(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per record: ``row, id, url, payload_bytes, payload_digest, refers_row, refers_id``.

    Of records with equal payloads (length and SHA-256) of at least ``min_bytes``, the one with the
    smallest id is the response and the others refer to it. Records without an id come last; of
    repeated ids one is the response.
    """
    index = chunks.where("last").select("row", "id", "url", "n_bytes", "sha1", "sha256")
    copies = (
        index.where(F.col("n_bytes") >= min_bytes)
        .groupBy("sha256", "n_bytes")
        .agg(F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "row")).alias("keep"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    judged = join_spread(index, copies, ["sha256", "n_bytes"], "row", "left")
    refers = F.col("keep.row") != F.col("row")
    return judged.select(
        "row",
        "id",
        "url",
        F.col("n_bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.when(refers, F.col("keep.row")).alias("refers_row"),
        F.when(refers, F.col("keep.id")).alias("refers_id"),
    )


def _urn(row: str, record_id: str) -> Column:
    shown = F.coalesce(F.url_encode(F.col(record_id).cast("string")), F.lit(ABSENT))
    return F.concat(F.lit(f"<{URN}"), F.col(row).cast("string"), F.lit(":"), shown, F.lit(">"))


def _coded_size(n_bytes: Column, chunk_bytes: int) -> Column:
    """Bytes of a payload in chunked transfer coding."""
    rest = n_bytes % chunk_bytes
    whole = F.floor(n_bytes / chunk_bytes) * (len(f"{chunk_bytes:X}") + 2 * len(EOL) + chunk_bytes)
    return whole + F.when(rest > 0, F.length(F.hex(rest)) + 2 * len(EOL) + rest).otherwise(0) + len(LAST_CHUNK)


def write_archives(
    rows: DataFrame,
    record_id: Column,
    payload: Column,
    path: str | None = None,
    min_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    archives: int | None = None,
) -> str:
    """Write a record for each of ``rows`` to gzipped WARC files below ``path``; returns the folder.

    A response holds the payload, a revisit refers to the response with the same payload. Line ends
    in a URL are percent-coded; a null URL gives no target field. An empty table gives no record.
    ``archives`` files are written (default: as many as shuffle partitions); a record lies whole in one.
    """
    spark = rows.sparkSession
    if path is None:
        path = register(new_shared_path(spark, "warc"))
    chunks = chunk_table(rows, record_id, payload, chunk_bytes)
    # An explicit number of partitions on both sides is kept by the join and is neither merged nor split
    # while it runs, so a record's chunks stay together.
    n = archives or work_partitions(rows)
    records = decide(chunks, min_bytes).withColumnRenamed("row", "record_row").repartition(n, "record_row")
    placed = chunks.select("row", "chunk", "data", "last").repartition(n, "row")
    joined = placed.join(records, F.col("row") == F.col("record_row")).where("refers_row IS NULL OR chunk = 0")
    revisit = F.col("refers_row").isNotNull()
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    head = F.concat(
        F.lit(VERSION + EOL),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn("row", "id")),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _urn("refers_row", "refers_id")))).otherwise(""),
        line("Content-Type", F.lit(HTTP_TYPE)),
        line(
            "Content-Length",
            F.when(revisit, len(HTTP_HEAD) + len(EOL))
            .otherwise(len(HTTP_HEAD + CHUNKED) + len(EOL) + _coded_size(F.col("payload_bytes"), chunk_bytes))
            .cast("string"),
        ),
        F.lit(EOL + HTTP_HEAD),
        F.when(revisit, EOL).otherwise(CHUNKED + EOL),
    )
    opening = F.when(F.col("chunk") == 0, head).otherwise("").cast("binary")
    size = F.octet_length("data")
    body = F.when(~revisit & (size > 0), F.concat(F.concat(F.hex(size), F.lit(EOL)).cast("binary"), F.col("data"))).otherwise(F.lit(b""))
    # The separator behind the row is the last line end of what the row holds.
    closing = (
        F.when(revisit, EOL)
        .when(F.col("last"), F.concat(F.when(size > 0, EOL).otherwise(""), F.lit(LAST_CHUNK + EOL)))
        .otherwise("")
        .cast("binary")
    )
    out = joined.sortWithinPartitions("row", "chunk").select(F.concat(opening, body, closing).cast("string").alias("value"))
    out.write.option("lineSep", EOL).option("compression", "gzip").text(path)
    release(chunks)
    return path


class ArchiveError(ValueError):
    """An archive that is not WARC, or not read from its start."""


class Parser:
    """The records of one archive, line by line, as chunk rows.

    Rows are (record_id, record_type, target_uri, refers_to, declared digest, chunk, data, n_bytes,
    digest, last). A record that the archive's end cuts off gives no row with ``last``.
    """

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes = chunk_bytes
        self.state = self.between

    def feed(self, line: bytes) -> Iterator[tuple]:
        return self.state(line) or ()

    def end(self) -> Iterator[tuple]:
        if self.state not in (self.between, self.fields):
            return [self.row(False)]
        return ()

    def between(self, line: bytes):
        if line:
            if not line.startswith(b"WARC/"):
                raise ArchiveError(f"a record must start with its version, not with {line[:40]!r}")
            self.header: dict[str, str] = {}
            self.state = self.fields

    def fields(self, line: bytes):
        if line:
            name, _, value = line.partition(b":")
            self.header[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
            return None
        try:
            self.left = int(self.header["content-length"])
        except (KeyError, ValueError):
            raise ArchiveError(f"no usable Content-Length in {self.header.get('warc-record-id')}") from None
        self.chunk, self.held, self.size, self.total = 0, [], 0, 0
        self.digest = hashlib.sha1()
        self.coded = False
        http = self.header.get("content-type", "").startswith("application/http")
        if not self.left:
            return self.finish()
        self.state = self.http if http else self.plain
        return None

    def took(self, n: int) -> None:
        self.left = max(0, self.left - n)

    def http(self, line: bytes):
        self.took(len(line) + 2)
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower():
            self.coded = True
        if not self.left:
            return self.finish()
        if not line:
            self.state = self.chunk_size if self.coded else self.plain
        return None

    def plain(self, line: bytes):
        if len(line) >= self.left:
            if len(line) > self.left:
                raise ArchiveError(f"the block of {self.header.get('warc-record-id')} is longer than declared")
            out = list(self.add(line))
            return [*out, *self.finish()]
        if len(line) + 2 > self.left:
            raise ArchiveError(f"the block of {self.header.get('warc-record-id')} ends inside a line end")
        out = list(self.add(line + b"\r\n"))
        self.took(len(line) + 2)
        return out if self.left else [*out, *self.finish()]

    def chunk_size(self, line: bytes):
        try:
            self.need = int(line.split(b";")[0], 16)
        except ValueError:
            raise ArchiveError(f"bad chunk size in {self.header.get('warc-record-id')}") from None
        self.state = self.chunk_data if self.need else self.trailer

    def chunk_data(self, line: bytes):
        if len(line) == self.need:
            self.state = self.chunk_size
            return list(self.add(line))
        if len(line) + 2 > self.need:
            raise ArchiveError(f"a chunk of {self.header.get('warc-record-id')} does not end where it says")
        self.need -= len(line) + 2
        return list(self.add(line + b"\r\n"))

    def trailer(self, line: bytes):
        return None if line else self.finish()

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.size >= self.chunk_bytes:
            yield self.row(False)
        self.held.append(data)
        self.size += len(data)

    def finish(self) -> list[tuple]:
        self.state = self.between
        return [self.row(True)]

    def row(self, last: bool) -> tuple:
        data = b"".join(self.held)
        self.digest.update(data)
        self.total += len(data)
        get = self.header.get
        out = (
            get("warc-record-id"),
            get("warc-type"),
            get("warc-target-uri"),
            get("warc-refers-to"),
            (get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            self.chunk,
            data,
            self.total,
            base32_sha1(self.digest),
            last,
        )
        self.chunk, self.held, self.size = self.chunk + 1, [], 0
        return out


_READ_DDL = (
    "archive string, record_id string, record_type string, target_uri string, refers_to string, "
    "declared_digest string, chunk long, data binary, n_bytes long, digest string, last boolean"
)


def read_archives(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The records of all archives below ``path`` as chunk rows, with running length and digest.

    Any WARC 1.x files: whole-file or per-record gzip, payloads in chunked coding or not. A task
    reads a gzipped archive from its start; a plain one must fit one file split, else the job fails.
    Memory holds a chunk and one run of bytes without ``\\r\\n``, which the writer above keeps to a chunk.
    A record cut off by the end of its archive has no row with ``last``. ``with_data=False`` leaves the
    bytes out (null).
    """
    fields = [("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string())]
    fields += [("refers_to", pa.string()), ("declared_digest", pa.string()), ("chunk", pa.int64()), ("data", pa.binary())]
    schema = pa.schema([*fields, ("n_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parser, at = _Batches(schema), Parser(chunk_bytes), None

        def given(rows):
            for row in rows:
                size = len(row[6])
                yield from out.add((at, *row) if with_data else (at, *row[:6], None, *row[7:]), size)

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                if (name := name.as_py()) != at:
                    yield from given(parser.end())
                    parser, at = Parser(chunk_bytes), name
                yield from given(parser.feed(value.as_py()))
        yield from given(parser.end())
        yield from out.flush()

    lines = spark.read.schema("value string").option("lineSep", EOL).text(path)
    return lines.select(F.col("_metadata.file_path"), F.col("value").cast("binary")).mapInArrow(parse, _READ_DDL)


def urn_row(urn: Column) -> Column:
    """The row number in a record identifier of the writer."""
    return F.split_part(urn, F.lit(":"), F.lit(3)).cast("long")


def urn_id(urn: Column) -> Column:
    """The id in a record identifier of the writer, as a string; null if the record has none."""
    shown = F.rtrim(F.split_part(urn, F.lit(":"), F.lit(4)), F.lit(">"))
    return F.when(shown != ABSENT, F.url_decode(shown))


def resolve(records: DataFrame) -> DataFrame:
    """One row per whole record, revisits with the length of the payload they stand for.

    Takes the rows of ``read_archives``. Columns: ``record_id, record_type, target_uri, payload_bytes,
    payload_digest, refers_to``. A revisit has no payload of its own: digest and length are those of
    the record it refers to, whose digest must be the declared one, else both are null.
    """
    spark = records.sparkSession
    whole = stored(records.where("last").drop("data", "archive", "chunk", "last"), "warc-records")
    revisits = whole.where("record_type = 'revisit'")
    # Only the records referred to are repeated for the spread join.
    wanted = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    targets = whole.join(wanted, "record_id", "left_semi").select(
        F.col("record_id").alias("refers_to"), F.col("n_bytes").alias("full_bytes"), F.col("digest").alias("full_digest")
    )
    found = join_spread(revisits.withColumn("_spread", F.xxhash64("record_id")), targets, ["refers_to"], "_spread", "left")
    same = F.col("full_digest") == F.col("declared_digest")
    columns = ["record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to"]
    out = whole.where("record_type <> 'revisit'").select(
        "record_id", "record_type", "target_uri", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "refers_to"
    )
    return out.unionByName(
        found.withColumns({"payload_bytes": F.when(same, F.col("full_bytes")), "payload_digest": F.when(same, F.col("full_digest"))}).select(*columns)
    )

