"""WARC archives as seekable Zstandard bundles.

Pages with equal payloads are found by digest; the one with the smallest page_id becomes a response
record, the others revisit it. Pages meet the table of first copies by digest and page_id together, so
a payload that a third of all pages share is spread out, and a revisit leaves its payload behind. Each
task writes bundles: records are grouped into independent Zstandard frames, a seek table in a
skippable frame ends the file (the public seekable format), and an index maps each record's
WARC-Record-ID to its bundle, frame and place in the frame. Record ids follow from the record's content,
so a rerun gives the same ones. Files are first written under a name of their own and then renamed, so
a lost or repeated task leaves nothing half-written behind; only bundles that the index names count.
Reading back opens a bundle through its seek table, decodes each frame that the index asks for once, and
parses the records at their offsets; bundles are dealt to tasks by their number.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import mark, materialize, new_folder, release, small_batches
from mnemoflow.llm.textkit import tidied

#: Bytes of records in a frame and of payloads in a bundle, roughly (one record may exceed either).
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 64 << 20, 3
#: Fixed values of the seekable format: skippable frame magic and footer magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
INDEX = "record_id string, page_id long, bundle string, frame int, start long, length long"
#: A payload is hot if more than one page in so many has it, so fewer than so many payloads are hot. Bundles that a task reads at most.
HOT, BUNDLES = 10_000, 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same for the same page, url and payload, in every run."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, digest)))}"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, ident: str, date: str = DATE) -> bytes:
    """One WARC record: a response, or without a payload a revisit, which carries the payload's digest and size alone."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:page:" + str(page_id))
    kind = "revisit" if payload is None else "response"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """A file of frames with a seek table at its end."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        import zstandard

        self.fs, self.path, self.out = fs, path, fs.open_output_stream(path + ".part")
        self.zstd, self.frames, self.buffer, self.size = zstandard.ZstdCompressor(level=LEVEL), [], bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, place in the frame and length of the record."""
        if self.buffer and len(self.buffer) + len(data) > FRAME_BYTES:
            self._flush()
        at = (len(self.frames), len(self.buffer), len(data))
        self.buffer += data
        self.size += len(data)
        return at

    def _flush(self) -> None:
        packed = self.zstd.compress(bytes(self.buffer))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.buffer)))
        self.buffer = bytearray()

    def close(self) -> None:
        if self.buffer:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class BundleReader:
    """Random access by the seek table at the end of the file."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        import zstandard

        self.file, self.zstd = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{path} has no plain seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.offsets = [0]
        self.sizes = []
        for packed, plain in struct.iter_unpack("<II", table):
            self.offsets.append(self.offsets[-1] + packed)
            self.sizes.append(plain)

    def frame(self, k: int) -> bytes:
        return self.zstd.decompress(self.file.read_at(self.offsets[k + 1] - self.offsets[k], self.offsets[k]), max_output_size=self.sizes[k])


def _writer(folder: str):
    """Rows (page_id, url, html, sha1, size, first): html is null in revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        bundle, rows = None, []

        def done() -> pa.RecordBatch:
            bundle.close()
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "page_id", "bundle", "frame", "start", "length"])

        for batch in batches:
            for page_id, url, html, sha1, size, first in zip(*batch.columns, strict=True):
                if bundle is None:
                    bundle, rows = BundleWriter(fs, f"{base}/bundle-{uuid.uuid4().hex}.warc.zst"), []
                page_id, url, payload = page_id.as_py(), url.as_py(), html.as_py()
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                ident = record_id(page_id, url, digest)
                place = bundle.add(record(page_id, url, None if payload is None else payload.encode(), size.as_py(), digest, first.as_py(), ident))
                rows.append((ident, page_id, bundle.path.rpartition("/")[2], *place))
                if bundle.size >= BUNDLE_BYTES:
                    yield done()
                    bundle = None
        if bundle is not None:
            yield done()

    return run


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes all pages as bundles into ``folder`` (a URI that all executors reach and pyarrow can open) and returns the index.

    pages: page_id (long), url, html; other columns are not read. The index: record_id (the record's
    WARC-Record-ID), page_id, bundle (file name), frame, start and length of the record in the decoded
    frame. Payloads below ``least_bytes`` are all responses.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long"), "key": F.sha2("html", 256)})
    large = F.col("size") >= least_bytes
    first = materialize(pages.where(large).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    total = first.agg(F.sum("n")).first()[0] or 0
    # The response of a payload is its first page; the others are found by the absence of a partner.
    one = first.select(F.col("key").alias("f_key"), "first", F.lit(True).alias("response"))
    met = pages.join(one, (F.col("key") == F.col("f_key")) & F.col("page_id").eqNullSafe(F.col("first")), "left")
    small = ["page_id", "url", "html", "sha1", "size"]
    own = F.coalesce("response", ~large)
    met = materialize(met.select("key", "page_id", "url", F.when(own, F.col("html")).alias("html"), "sha1", "size", own.alias("own")), "records")
    again = met.where("NOT own")
    often = F.col("n") * HOT > total
    hot, others = (first.where(c).select("key", "first") for c in (often, ~often & (F.col("n") > 1)))
    revisits = again.join(F.broadcast(hot), "key").unionByName(again.join(F.broadcast(hot.select("key")), "key", "left_anti").join(others, "key"))
    rows = met.where("own").select(*small, F.lit(None).cast("long").alias("first")).union(revisits.select(*small, "first"))
    return materialize(rows.mapInArrow(tidied(_writer(folder)), INDEX), "index")


def _reader(folder: str):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(key: tuple[pa.Scalar, ...], table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        bundle = BundleReader(fs, f"{base}/{key[0].as_py()}")
        held, data, out, bytes_out = -1, b"", [], 0
        index = pa.Table.from_batches(list(table)).sort_by([("frame", "ascending"), ("start", "ascending")])
        for ident, frame, start, length in zip(*(index[c].to_pylist() for c in ("record_id", "frame", "start", "length")), strict=True):
            if frame != held:
                held, data = frame, bundle.frame(frame)
            h, payload = parse(data[start : start + length])
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            if h["warc-record-id"] != f"<{ident}>" or h["warc-type"] == "response" and payload_digest(payload) != digest:
                raise ValueError(f"damaged record in {key[0].as_py()}, frame {frame}")
            size = len(payload) if h["warc-type"] == "response" else int(h["x-payload-length"])
            page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
            text = payload.decode() if h["warc-type"] == "response" else None
            out.append((page and int(page), h["warc-target-uri"], size, digest, h["warc-type"], None if refers in (None, "None") else int(refers), text))
            bytes_out += len(payload)
            if bytes_out > 4 * FRAME_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, bytes_out = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names (all, or those left by a filter): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    A task reads a few bundles, one after the other and frame by frame; a record without the id that the
    index gives it, or a response whose payload does not have its digest, raises an error.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    bundles = index.select("bundle").distinct().count()
    tasks = max(1, min(bundles, max(4 * index.sparkSession.sparkContext.defaultParallelism, math.ceil(bundles / BUNDLES))))
    return index.repartition(tasks, "bundle").groupBy("bundle").applyInArrow(_reader(folder), schema)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages into a new folder of the shared space and reads them back.

    A null html is an empty payload; a null url becomes a urn. Of equal payloads all rows with the
    smallest page_id are responses; rows with a null page_id revisit it, or are responses if no row of
    theirs has an id. Equal rows give a record each, with the same record id. An empty table writes no bundle and gives no
    rows.
    """
    spark, began = pages.sparkSession, mark()
    folder = new_folder(spark, "warc")
    index = write_archive(pages, folder, least_bytes)
    release(spark, began, keep=("warc", "index"))
    return read_archive(index, folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), d AS (
  SELECT page_id, first, octet_length(b)::BIGINT AS payload_bytes, unhex(sha1(b))::BIT::VARCHAR AS bits FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (ascii(bits[5 * i + j + 1]) - 48) * (16 >> j)))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d
"""
