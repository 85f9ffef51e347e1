"""WARC: pages become records of whole-file gzip archives; a normaliser inflates each such file once, as a stream, and rewrites it with each record as a gzip member of its own and a sidecar offset index.

Archives of any writer can be normalised: records are parsed by the standard, with header names in any case, white space
around values, and lines that go on in the next. Payloads that are equal are stored once: the response is that of the
largest page id, the others are revisit records that refer to it. Only digests that several pages have are joined, so
payloads don't move.

A null payload counts as empty. Rows that repeat the response's page id are responses too; a null page id is less than any
other, and refers like any other; among null ids alone all are responses. A payload of any length makes one record, held
whole by its task. An empty table makes no archive; extra columns, of any name, are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spheric.llm.common import new_folder, remove_folder, shipped, sized, stored

#: Uncompressed bytes in an archive, more or less: a record is never cut.
ARCHIVE_BYTES = 32 << 20
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: No date is recorded for a page.
DATE = b"1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response with its payload, or, with refers_to, a revisit without one. Line ends can't enter a header."""
    revisit = refers_to is not None
    block = HTTP + (b"" if revisit else payload)
    target = "".join(c if c.isprintable() else "%" + c.encode().hex().upper() for c in url or "")
    lines = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%d>" % page_id if page_id is not None else b"WARC-Record-ID: <urn:page:none>",
        b"WARC-Target-URI: " + target.encode(), b"WARC-Date: " + DATE, b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % size,
        *([b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to] if revisit else []),
        b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(lines) + END + block + END


def parse_record(raw: io.BufferedIOBase) -> tuple[dict[str, str], bytes, bytes] | None:
    """The next record's headers by small name, its block and its raw bytes; None at the end."""
    head = []
    while (line := raw.readline()) in (b"\r\n", b"\n"):
        pass  # some writers leave more lines than two between records
    while line:
        head.append(line)
        if line in (b"\r\n", b"\n"):
            break
        line = raw.readline()
    if not head:
        return None
    if not head[0].startswith(b"WARC/") or head[-1] not in (b"\r\n", b"\n"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    name = ""
    for line in head[1:-1]:
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            fields[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise ValueError(f"not a header of a WARC record: {text[:80]}")
        name = name.strip().lower()
        fields[name] = value.strip()
    size = int(fields["content-length"])
    block = raw.read(size)
    end = raw.read(4)
    if end != END or len(block) != size:
        raise ValueError("a WARC record is cut short")
    return fields, block, b"".join(head) + block + end


def normalise(monolith: io.BufferedIOBase, out, level: int = 6) -> list[tuple[str, int, int, int]]:
    """Inflates a gzip file once and writes each of its records to out as a member of its own; returns (record id, offset, packed bytes, raw bytes) for each."""
    index, at = [], 0
    with gzip.GzipFile(fileobj=monolith, mode="rb") as inflated:
        stream = io.BufferedReader(inflated, 1 << 20)
        while (found := parse_record(stream)) is not None:
            fields, _, raw = found
            pack = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = pack.compress(raw) + pack.flush()
            out.write(member)
            index.append((fields.get("warc-record-id", ""), at, len(member), len(raw)))
            at += len(member)
    return index


def classify(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, payload, refers_to): of equal payloads of least_bytes or more all but the largest id refer to it.

    What is joined has one row for each payload that several rows have, and so a payload that very many pages share is no skew while it is broadcast, and else the other side's, which adaptive execution splits.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    digest = F.unhex(F.sha1(F.col("payload").cast("binary")))
    equal = rows.where(F.octet_length("payload") >= least_bytes).groupBy(digest.alias("d")).agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "largest")
    joined = rows.withColumn("d", digest).join(sized(stored(equal, "equal-payloads")), "d", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def write_monoliths(pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Writes classify's rows to folder as gzip files of one member each; returns rows (archive)."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, stream, name, size = None, None, "", 0

        def put() -> pa.RecordBatch:
            stream.close()
            held.close()
            return pa.RecordBatch.from_pydict({"archive": [name]})

        for part in parts:
            for i in range(0, part.num_rows, 256):
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in part.slice(i, 256).columns), strict=True):
                    raw = payload.encode()
                    record = record_bytes(page_id, url, b"" if refers_to is not None else raw, digest_of(raw), len(raw), refers_to)
                    if stream is not None and size + len(record) > archive_bytes:
                        yield put()
                        stream = None
                    if stream is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0  # a task that runs twice leaves a file that no list names
                        held = fs.open_output_stream(f"{root}/{name}", compression=None)
                        stream = gzip.GzipFile(fileobj=held, mode="wb", compresslevel=1, mtime=0)
                    stream.write(record)
                    size += len(record)
        if stream is not None:
            yield put()

    shipped(pages.sparkSession)
    return stored(classify(pages, **columns).mapInArrow(write, "archive string"), "monoliths")


def normalise_archives(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Normalises the archives (archive), files of source, to folder, each with its index beside it; returns rows (archive, records). One task inflates a file, as a stream."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), (to, where) = FileSystem.from_uri(source), FileSystem.from_uri(folder)
        to.create_dir(where, recursive=True)
        for part in parts:
            for name in part.column(0).to_pylist():
                made = f"{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(f"{root}/{name}", compression=None) as monolith, to.open_output_stream(f"{where}/{made}", compression=None) as out:
                    index = normalise(monolith, out)
                with to.open_output_stream(f"{where}/{made}.idx", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [made], "records": [len(index)]})

    n = int(shipped(archives.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    return stored(archives.select("archive").repartition(n, "archive").mapInArrow(work, "archive string, records long"), "archives")


def write_archives(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Writes classify's rows to whole-file archives and normalises these to folder; returns rows (archive, records). The whole files go once all are normalised."""
    spark = pages.sparkSession
    source = new_folder(spark, "monoliths")
    made = normalise_archives(write_monoliths(pages, source, **options), source, folder)
    remove_folder(spark, source)
    return made


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rows (page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to), each record found by its offset. A revisit's payload is null."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)

        def number(x: str | None) -> int | None:
            return int(x[10:-1]) if x and x != "<urn:page:none>" else None

        for part in parts:
            for name in part.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}.idx", compression=None) as stream:
                    index = [json.loads(x) for x in stream.read().decode().splitlines()]
                with fs.open_input_file(f"{root}/{name}") as file:
                    rows = []
                    for i, (_, at, packed, _) in enumerate(index):
                        file.seek(at)
                        fields, block, _ = parse_record(io.BytesIO(zlib.decompress(file.read(packed), 31)))
                        response = fields["warc-type"] == "response"
                        payload = block[block.index(END) + 4 :] if response else None
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if response and digest_of(payload) != digest:
                            raise ValueError(f"record {i} of {name} isn't what its digest says")
                        rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], payload, len(payload) if response else int(fields["x-payload-length"]), digest, number(fields.get("warc-refers-to"))))
                        if len(rows) == 500 or i + 1 == len(index):
                            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
                            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])
                            rows = []

    n = int(shipped(archives.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    dealt = archives.select("archive").repartition(n, "archive")
    return dealt.mapInArrow(read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of pages, from the archives."""
    folder = new_folder(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
