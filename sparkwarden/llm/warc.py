"""Web archives in seekable Zstandard bundles.

A bundle is a file of WARC records cut into independent Zstandard frames, with the
seek table of the public seekable format as its last, skippable frame. Any
Zstandard reader can read a bundle from front to back. A reader that wants one
record opens its frame only: the index maps a record identifier to its bundle,
frame, and place within the frame, and the seek table says where the frame starts.

Records with equal payloads are stored once: the one with the smallest page id is
the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.session import shared_dir

from .tables import small_batches, stored

MIN_SHARED_BYTES = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
LEVEL = 3
SUFFIX = ".warc.zst"

# Fixed values of the WARC 1.1 and the seekable Zstandard formats.
WARC_DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
END = b"\r\n"

INDEX_SCHEMA = (
    "record_id string, page_id long, bundle string, frame long, frame_offset long, offset_in_frame long, length long"
)


def classified(pages: DataFrame) -> DataFrame:
    """Pages with digest, size, record type and the page a revisit refers to.

    Columns: page_id, url, html (never null: a null payload is empty), payload_bytes,
    payload_digest, record_type, refers_to. Payloads under MIN_SHARED_BYTES are
    always responses, as are pages without id and every row of the smallest page id
    of a payload. Payloads are shuffled once, by page id, which also evens out the
    bundles; what meets by digest are page ids.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"),
    )
    firsts = (
        hashed.where(F.col("payload_bytes") >= MIN_SHARED_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("payload_digest", "_first")
    )
    # The few revisits (page, digest); a digest of many pages is split by the skew join.
    revisits = stored(
        hashed.select("page_id", "payload_digest").join(firsts, "payload_digest").where("page_id > _first").distinct(), "revisits"
    )
    marked = hashed.join(revisits.hint("shuffle_hash"), ["page_id", "payload_digest"], "left")
    return marked.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(F.col("_first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("_first").alias("refers_to"),
    )


def _header_value(text: str) -> str:
    """One line: control characters and blanks as percent escapes, the rest as it is."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record_bytes(record_id: str, row: dict) -> bytes:
    """A WARC record: headers, block, two line ends."""
    payload = row["html"].encode("utf-8")
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_header_value(row['url'])}")
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {row['refers_to']}"]
    return "\r\n".join(head).encode("utf-8") + END + END + block + END + END


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers (lower-case names), block and the place after the record that starts at `at`."""
    end = data.index(END + END, at)
    lines = data[at:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    start = end + 2 * len(END)
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != END + END:
        raise ValueError(f"record at {at} does not end after its block")
    return headers, data[start:stop], stop + 4


class BundleWriter:
    """Writes one bundle: records gather to frames of about `frame_bytes`, the seek table closes the file."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.offset, self.held, self.held_bytes = 0, [], 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, frame's offset in the file, record's offset in the frame)."""
        if self.held_bytes and self.held_bytes + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.offset, self.held_bytes
        self.held.append(record)
        self.held_bytes += len(record)
        return place

    def flush(self) -> None:
        if not self.held:
            return
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.held))
        self.sink.write(packed)
        self.frames.append((len(packed), self.held_bytes))
        self.offset += len(packed)
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


FOOTER_BYTES = 9


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of every frame, from the end of a bundle."""
    n, descriptor, magic = struct.unpack("<IBI", tail[-FOOTER_BYTES:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    if len(tail) < FOOTER_BYTES + n * width:
        raise ValueError("the tail does not hold the whole seek table")
    table, offset = [], 0
    start = len(tail) - FOOTER_BYTES - n * width
    for k in range(n):
        packed, plain = struct.unpack_from("<II", tail, start + k * width)
        table.append((offset, packed, plain))
        offset += packed
    return table


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _opened(folder)
        part, writer, name, hidden, rows = 0, None, None, None, []

        def finish() -> pa.RecordBatch:
            writer.close()
            # A bundle appears whole, under a name that a second attempt of the task writes again.
            store.move(f"{root}/{hidden}", f"{root}/{name}")
            fields = list(zip(*rows))
            types = [pa.string(), pa.int64(), pa.string()] + [pa.int64()] * 4
            names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(fields, types)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"pages-{task.partitionId():06d}-{part:04d}{SUFFIX}"
                    hidden = f".{name}.{task.taskAttemptId()}"
                    writer, rows, part = BundleWriter(store.open_output_stream(f"{root}/{hidden}"), frame_bytes), [], part + 1
                record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{len(rows)}')}"
                record = record_bytes(record_id, row)
                rows.append((record_id, row["page_id"], name, *writer.add(record), len(record)))
                if writer.offset >= bundle_bytes:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return write


def in_fixed_order(records: DataFrame) -> DataFrame:
    """Each partition in an order that its rows alone decide; rows alike in it are the same record."""
    return records.sortWithinPartitions("page_id", "url", "payload_digest")


def write_archives(
    pages: DataFrame, folder: str, *, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Writes `pages` (page_id, url, html) as bundles in `folder` and returns the stored index.

    `folder` must be seen by driver and executors alike (a URI pyarrow can open, or
    a path on a shared mount). The index has a row per record: record_id, page_id,
    bundle, frame, frame_offset (in the file), offset_in_frame, length. A record
    longer than a frame has a frame of its own. A null html is an empty payload, a
    null url gives a record without target, a null page_id one without page id.
    Repeated rows are all written. Empty input writes no bundle.

    A task writes its rows in a fixed order, so a second attempt of it writes the same
    bundles again and the index holds whichever attempt came last.
    """
    small_batches(pages.sparkSession)
    store, root = _opened(folder)
    store.create_dir(root, recursive=True)
    records = in_fixed_order(classified(pages))
    return stored(records.mapInArrow(_writer(folder, frame_bytes, bundle_bytes), INDEX_SCHEMA), "warc-index")


RECORD_SCHEMA = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, record_id string, bundle string"
)


def _record_row(headers: dict, block: bytes, bundle: str, payloads: bool) -> dict:
    http, _, payload = block.partition(END + END)
    length = next(int(h.split(b":")[1]) for h in http.split(END) if h.lower().startswith(b"content-length"))
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {bundle}: {headers['warc-record-id']}")
    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return {
        "page_id": None if page is None else int(page),
        "url": headers.get("warc-target-uri"),
        "payload": payload if payloads and kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": None if refers is None else int(refers),
        "record_id": headers["warc-record-id"].strip("<>"),
        "bundle": bundle,
    }


_TYPES = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("record_id", pa.string()),
        ("bundle", pa.string()),
    ]
)


def _reader(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                buffer = content.as_buffer()
                bundle = path.rsplit("/", 1)[-1]
                # Frame by frame: what is held decompressed is one frame.
                for offset, packed, _ in seek_table(memoryview(buffer)):
                    frame = zstandard.ZstdDecompressor().decompress(buffer[offset : offset + packed].to_pybytes())
                    at, rows = 0, []
                    while at < len(frame):
                        headers, block, at = parse_record(frame, at)
                        rows.append(_record_row(headers, block, bundle, payloads))
                    yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)

    return read


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """Every record of every bundle in `folder`; payload digests and lengths are checked against the content.

    A revisit has no payload of its own (null); its length and digest are those of
    the payload it refers to.
    """
    small_batches(spark)  # by bytes: a bundle or two at a time
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    return files.select("path", "content").mapInArrow(_reader(payloads), RECORD_SCHEMA)


def _open_bundle(store: pafs.FileSystem, path: str) -> tuple[pa.NativeFile, list[tuple[int, int, int]]]:
    """The bundle and its seek table, which is all that is read of it."""
    source = store.open_input_file(path)
    size = source.size()
    n = struct.unpack("<IBI", source.read_at(FOOTER_BYTES, size - FOOTER_BYTES))[0]
    tail = min(size, FOOTER_BYTES + 12 * n)
    return source, seek_table(source.read_at(tail, size - tail))


def _fetcher(folder: str, payloads: bool):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        held, source, table = None, None, []
        for batch in batches:
            for want in batch.to_pylist():
                if want["bundle"] != held:
                    if source is not None:
                        source.close()
                    held = want["bundle"]
                    source, table = _open_bundle(store, f"{root}/{held}")
                offset, packed, _ = table[want["frame"]]
                frame = zstandard.ZstdDecompressor().decompress(source.read_at(packed, offset))
                rows = []
                for record in want["records"]:
                    at = record["offset_in_frame"]
                    headers, block, _ = parse_record(frame[at : at + record["length"]])
                    row = _record_row(headers, block, held, payloads)
                    if row["record_id"] != record["record_id"]:
                        raise ValueError(f"the index does not belong to {held}: {record['record_id']}")
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)
        if source is not None:
            source.close()

    return fetch


# Frames that stand together are fetched by one task, and a task fetches about so many bytes of records.
FRAMES_TOGETHER = 8
TASK_BYTES = 64 << 20


def fetch_records(wanted: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of index rows `wanted`: their frames only are read, each of them once.

    `wanted` is read twice. Rows of an index that does not belong to the bundles in
    `folder` are an error; repeated rows give repeated records, no rows none.
    """
    small_batches(wanted.sparkSession)
    total = wanted.agg(F.sum("length")).first()[0] or 0
    near = wanted.withColumn("_near", F.expr(f"frame div {FRAMES_TOGETHER}")).repartition(1 + total // TASK_BYTES, "bundle", "_near")
    records = F.sort_array(F.collect_list(F.struct("offset_in_frame", "length", "record_id"))).alias("records")
    frames = near.groupBy("bundle", "_near", "frame").agg(records).sortWithinPartitions("bundle", "frame")
    return frames.select("bundle", "frame", "records").mapInArrow(_fetcher(folder, payloads), RECORD_SCHEMA)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages to a fresh archive in the shared folder and reads every record back through the index, without payloads."""
    folder = shared_dir(pages.sparkSession, "warc")
    return fetch_records(write_archives(pages, folder), folder, payloads=False)
