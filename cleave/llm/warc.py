"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Method.  Each writer task trains a dictionary on its own first records (at most ``TRAIN_BYTES``), puts it in a skippable
frame with magic 0x184D2A5D and appends one frame per record, rolling to a new archive at ``roll_bytes``.  A file appears
under its final name only when it is whole, and a task that is run again writes the same name, so lost executors leave no
half archives.  The reader loads the dictionary from the leading frame, walks the block headers to find each frame's end,
decodes one frame at a time and checks version, mandatory headers, Content-Length, the closing line breaks and digests.

Equal payloads are found by SHA-256 with a grouped minimum of the page ids; only ids and digests take part.

Edge cases.  A null html is an empty payload.  Equal payloads below ``least`` bytes stay responses.  A null page_id never
is what others refer to, unless all equal records have none; then all are responses.  Rows that repeat the smallest page_id
are all responses.  An archive without a dictionary frame, or with a compressed dictionary, can be read.  An empty table
gives an empty result.  Extra columns are not read.  A page of any length is one record, held whole by its task.  A cut frame, a missing header, a
wrong length or digest, and a revisit that refers to nothing are ValueErrors.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.session import bounded_batches, materialise, scratch_path

#: Fixed values of the Zstandard format: frame magic, magic of the skippable frame with the dictionary, dictionary magic.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
#: A writer trains its dictionary of at most DICTIONARY_BYTES on its first records up to TRAIN_BYTES.
DICTIONARY_BYTES, TRAIN_BYTES = 32 << 10, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")
READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The bytes of one record; a revisit has the HTTP header as its block and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{'' if refers_to is None else refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or None where the samples are too few or too small for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its block headers."""
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        if end > len(data):
            raise ValueError(f"skippable frame at {at} is cut off")
        return end
    if magic != FRAME:
        raise ValueError(f"no Zstandard frame at {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 if flags & 4 else 0
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def _id(value: str) -> int | None:
    tail = value.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def parse(raw: bytes) -> tuple:
    """The columns of READ_SCHEMA from one decoded record; ValueError for whatever is wrong with it."""
    cut = raw.find(b"\r\n\r\n")
    lines = raw[:cut].decode("utf-8").split("\r\n") if cut >= 0 else [""]
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line[:60]!r}")
        head[name.strip()] = value.strip()
    for name in MANDATORY:
        if name not in head:
            raise ValueError(f"{name} is missing")
    if not head["Content-Length"].isdigit():
        raise ValueError("bad Content-Length")
    size = int(head["Content-Length"])
    block = raw[cut + 4 : cut + 4 + size]
    if len(block) != size or raw[cut + 4 + size :] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no HTTP header")
    full = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = head.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    kind = head["WARC-Type"]
    if kind == "revisit":
        if "WARC-Refers-To" not in head:
            raise ValueError("WARC-Refers-To is missing")
        return _id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), None, full, digest, kind, _id(head["WARC-Refers-To"])
    found = hashlib.sha256(payload).hexdigest()
    if digest and found != digest or full != len(payload):
        raise ValueError("the payload doesn't fit its digest or length")
    return _id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), payload, full, found, kind, None


def read_archive(data: bytes) -> Iterator[tuple]:
    """The parsed records of one archive."""
    view, at, dictionary = memoryview(data), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        at = frame_end(view, 0)
        raw = bytes(view[8:at])
        if struct.unpack_from("<I", raw)[0] == FRAME:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        if struct.unpack_from("<I", view, at)[0] == FRAME:
            yield parse(decoder.decompress(view[at:end], max_output_size=0) if zstandard.frame_content_size(view[at:end]) >= 0 else decoder.decompressobj().decompress(view[at:end]))
        at = end


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """``page_id, digest, first``: what is to be written as a revisit of page ``first``."""
    ids = pages.where(F.col("size") >= least).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    return ids.distinct().join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))


def write_archives(pages: DataFrame, folder: str, least: int = 100, level: int = 3, roll_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> int:
    """Write ``page_id, url, html`` rows as archives under ``folder``; the number of records."""
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    again = materialise(revisits(rows, least), "warc-revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first", F.lit(True).alias("again"))
    both = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    both = both.select("page_id", "url", F.when(F.col("again").isNull(), F.col("payload")).alias("payload"), "digest", "size", "first", F.col("again").isNotNull().alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, level, roll_bytes)
        for batch in batches:
            for r in batch.to_pylist():
                writer.add(record(r["page_id"], r["url"], r["payload"] or b"", r["digest"], r["size"], r["first"], r["again"], date))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([writer.records])], names=["n"])

    return both.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class _Writer:
    """The archives of one task."""

    def __init__(self, folder: str, level: int, roll_bytes: int) -> None:
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.task, self.level, self.roll = TaskContext.get(), level, roll_bytes
        self.waiting: list[bytes] = []
        self.held = self.records = self.files = self.size = 0
        self.out = None

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.out is None:
            self.waiting.append(raw)
            self.held += len(raw)
            if self.held >= TRAIN_BYTES:
                self._open()
        else:
            self._put(raw)

    def _put(self, raw: bytes) -> None:
        frame = self.coder.compress(raw)
        self.out.write(frame)
        self.size += len(frame)
        if self.size >= self.roll:
            self._shut()

    def _open(self) -> None:
        self.fs.create_dir(self.folder, recursive=True)
        name = f"{self.folder}/part-{self.task.partitionId():06d}-{self.files:04d}.warc.zst"
        self.name, self.temp = name, f"{self.folder}/_{os.path.basename(name)}.{self.task.taskAttemptId()}"
        self.out, self.size = self.fs.open_output_stream(self.temp), 0
        dictionary = train(self.waiting)
        self.coder = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_content_size=True, write_checksum=True)
        if dictionary:
            raw = dictionary.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        waiting, self.waiting, self.held = self.waiting, [], 0
        for i, raw in enumerate(waiting):
            self._put(raw)
            if self.out is None:
                self.waiting, self.held = waiting[i + 1 :], sum(map(len, waiting[i + 1 :]))
                break

    def _shut(self) -> None:
        self.out.close()
        self.out = None
        self.fs.move(self.temp, self.name)
        self.files += 1

    def close(self) -> None:
        while self.waiting:
            self._open()
        if self.out is not None:
            self._shut()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives under ``folder``, columns READ_SCHEMA."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("content")
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in read_archive(content.as_py()):
                    rows.append(row)
                    held += len(row[2] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """All records of ``pages`` as read back from archives written in the shared folder."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    if not write_archives(pages, folder):
        return spark.createDataFrame([], READ_SCHEMA)
    return read_archives(spark, folder)


def op6_warc_zstandard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
