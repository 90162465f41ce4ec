"""WARC archives of individually compressed records under an embedded Zstandard dictionary.

An archive is one file: a skippable frame that holds a dictionary built from the records
of that very archive, then one Zstandard frame per record. Any reader that knows the
skippable frame can decompress a record by its offset alone.

Pages are dealt out evenly by ``page_id`` and written by many tasks, which start a new
archive when one is full, so a task holds the records of one archive at most. Each attempt
of a task writes files of its own names; the returned index lists those of the attempts
that counted, and readers open no others. A lost executor costs its tasks only.

Of records with equal payloads the one with the smallest ``page_id`` is stored whole, the
others refer to it. Payloads below ``least_bytes`` are always stored.

Defined results: a null ``html`` is an empty payload; a null ``url`` an empty target; a null
``page_id`` is written and comes last among equal payloads; rows that repeat the smallest
``page_id`` with the same payload are all responses. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.llm.stages import stored
from orgweft.session import shared_folder

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
BROADCAST_NAMES = 100_000
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One record: WARC header, HTTP header and payload; a revisit ends with its HTTP header."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        lines.insert(2, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary built from all records of an archive; fewer bytes where they hold little."""
    total = sum(map(len, records))
    if len(records) >= 8 and total >= 16 * 1024:
        try:
            return zstandard.train_dictionary(
                min(size, total // 8), records, k=1024, d=8, f=18, accel=5, level=LEVEL
            ).as_bytes()
        except zstandard.ZstdError:  # too few or too similar records to select from
            pass
    return b"".join(records)[-size:]


def encode(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """An archive's bytes, and offset and length of each record's frame in it."""
    content = dictionary(records)
    shared = zstandard.ZstdCompressionDict(content)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
    out = [struct.pack("<II", SKIPPABLE, len(content)) + content]
    at, places = len(out[0]), []
    for one in records:
        frame = compressor.compress(one)
        places.append((at, len(frame)))
        out.append(frame)
        at += len(frame)
    return b"".join(out), places


def decode(archive: bytes) -> Iterator[bytes]:
    """The records of an archive in order; a record's header tells where it ends."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    shared = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(
        memoryview(archive)[8 + size :], read_across_frames=True
    )
    data = reader.read()
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        length = int(data[at:head].rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
        end = head + 4 + length + 4
        yield data[at:end]
        at = end


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the size of the full payload, and the payload that the record holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if headers["WARC-Type"] == "response":
        if len(payload) != size or f"sha1:{digest(payload)}" != headers["WARC-Payload-Digest"]:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return headers, size, payload


def _page(urn: str):
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


INDEX = "archive string, page_id bigint, offset bigint, length bigint"
RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
    "payload_bytes bigint, payload binary"
)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors reach (a local path has no scheme)."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, archive_bytes: int):
    def write(batches):
        target, root = _place(folder)
        waiting, ids, size = [], [], 0

        def flush():
            data, places = encode(waiting)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with target.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            columns = [
                pa.array([name] * len(ids)),
                pa.array(ids, pa.int64()),
                pa.array([p[0] for p in places], pa.int64()),
                pa.array([p[1] for p in places], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "page_id", "offset", "length"])

        for batch in batches:
            for row in batch.to_pylist():
                one = record(row["page_id"], row["url"] or "", row["payload"], row["refers_to"])
                if waiting and size + len(one) > archive_bytes:
                    yield flush()
                    waiting, ids, size = [], [], 0
                waiting.append(one)
                ids.append(row["page_id"])
                size += len(one)
        if waiting:
            yield flush()

    return write


def referred(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: each page with the response it revisits, if any.

    Digests are reduced to their smallest page before they meet the pages again, and only
    digests of several pages take part in that second step, without their payloads.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    small = stored(
        rows.where(F.octet_length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("sha")),
        "digests",
    )
    first = stored(
        small.groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("sha", "first"),
        "responses",
    )
    links = (
        small.join(first, "sha")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to"))
        .distinct()
    )
    return rows.join(
        links,
        F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha1("payload") == F.col("_sha")),
        "left",
    ).select("page_id", "url", "payload", "refers_to")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives of ``pages`` and return their index: ``archive, page_id, offset,
    length``. The index is stored beside the archives and names the ones that count.
    """
    target, root = _place(folder)
    target.create_dir(root, recursive=True)
    index = referred(pages, least_bytes).mapInArrow(_writer(folder, archive_bytes), INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def _reader(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for data in decode(content.as_py()):
                headers, size, payload = parse(data)
                refers = headers.get("WARC-Refers-To")
                rows.append(
                    {
                        "page_id": _page(headers["WARC-Record-ID"]),
                        "url": headers["WARC-Target-URI"],
                        "record_type": headers["WARC-Type"],
                        "refers_to": None if refers is None else _page(refers),
                        "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                        "payload_bytes": size,
                        "payload": payload,
                    }
                )
                if len(rows) == 512:
                    yield _records(rows)
                    rows = []
            if rows:
                yield _records(rows)


def _records(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        rows,
        pa.schema(
            [
                ("page_id", pa.int64()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("payload_digest", pa.string()),
                ("payload_bytes", pa.int64()),
                ("payload", pa.binary()),
            ]
        ),
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives that the folder's index lists; a revisit has no payload."""
    named = stored(spark.read.parquet(f"{folder}/index").select("archive").distinct(), "archives")
    if named.count() <= BROADCAST_NAMES:
        named = F.broadcast(named)  # else the archives are shuffled to meet their names
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.warc.zst")
        .load(folder)
        .select("content", F.element_at(F.split("path", "/"), -1).alias("archive"))
    )
    return files.join(named, "archive", "left_semi").select("content").mapInArrow(
        _reader, RECORDS
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read these back, and describe each
    record as its archive has it.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write(pages, folder, least_bytes)
    return read(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
