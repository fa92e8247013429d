"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about FRAME_BYTES, which are compressed independently of each other, so a reader
decompresses one frame to get at a record, and records of a frame share what they have in common. A bundle ends with a seek table
in a skippable frame (the layout of the public zstd seekable format, without checksums): plain zstd tools
still read the file, and a reader finds every frame from the footer. An index maps each record
to its bundle, its frame, and its place in the decompressed frame.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import attach, discard, settle, shared_folder

#: Magic numbers of skippable frames and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: A frame is closed once it holds this many bytes before compression, a bundle once it holds this many compressed ones.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 256 << 20
LEVEL = 3
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, number: str, url: str | None, payload: bytes, digest: str, refers: str | None, name: str) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but the digest and length of it. The record's own id is made of name, as page ids may repeat or be null."""
    body = payload if kind == "response" else b""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", number),
        ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", refers or "")]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = np.array(frames, "<u4").tobytes()
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def read_seek_table(f) -> list[tuple[int, int]]:
    """(offset, compressed length) of each frame of an open bundle, from its footer."""
    end = f.size()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    f.seek(end - 9 - 8 * n)
    sizes = np.frombuffer(f.read(8 * n), "<u4").reshape(-1, 2)[:, 0].astype(np.int64)
    return list(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist()))


#: Where bundles stand until the index that names them is whole.
DRAFTS = "_drafts"


def place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


class Bundle:
    """A file being written, among the drafts. Each attempt of a task has its own; which of them count, the index tells."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, path = place(folder)
        self.fs.create_dir(f"{path}/{DRAFTS}", recursive=True)
        self.name, self.at, self.frames = name, 0, []
        self.out = self.fs.open_output_stream(f"{path}/{DRAFTS}/{name}", compression=None)  # frames are compressed already

    def add(self, raw: bytes, frame: bytes) -> tuple[int, int]:
        """Append a frame; its place in the seek table and its size."""
        self.out.write(frame)
        self.frames.append((len(frame), len(raw)))
        self.at += len(frame)
        return len(self.frames) - 1, len(raw)

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def publish(index: DataFrame, folder: str) -> int:
    """Move the bundles that a settled index names out of the drafts, and delete the rest, which repeated or lost tasks have left; gives their number.

    Each bundle is moved on its own and a move that was done is passed over, so the job can be repeated. Readers of the folder see each record once.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                draft, final = fs.get_file_info([f"{path}/{DRAFTS}/{name}", f"{path}/{name}"])
                if draft.type == pyarrow.fs.FileType.File:
                    fs.move(draft.path, final.path)
                elif final.type != pyarrow.fs.FileType.File:
                    raise FileNotFoundError(f"the index names {name}, which was not written")
            yield batch

    moved = index.select("bundle").distinct().mapInArrow(move, "bundle string").count()
    fs, path = place(folder)
    if fs.get_file_info(f"{path}/{DRAFTS}").type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(f"{path}/{DRAFTS}")
    return moved


INDEX = "page_id long, bundle string, frame int, record_offset long, record_length long"


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write records (page_id, url, html, first, revisit) to bundles among the drafts of folder; gives the index, one row per record.

    A task that is repeated writes bundles of other names, and only the rows of one attempt are in the index once it is settled; publish shows those bundles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        label = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        packer, bundle, number = zstandard.ZstdCompressor(level=LEVEL), None, 0
        held: list[tuple[int | None, bytes]] = []  # the records of the open frame
        size, written = 0, 0

        def close_frame() -> pa.RecordBatch:
            nonlocal bundle, number, held, size
            if bundle is None:
                bundle = Bundle(folder, f"{label}-{number:04d}.warc.zst")
                number += 1
            raw = b"".join([r for _, r in held])
            frame, _ = bundle.add(raw, packer.compress(raw))
            length = np.array([len(r) for _, r in held], np.int64)
            n = len(held)
            rows = [pa.array([page for page, _ in held], pa.int64()), pa.array([bundle.name] * n), pa.array(np.full(n, frame, np.int32)), pa.array(np.cumsum(length) - length), pa.array(length)]
            held, size = [], 0
            if bundle.at >= BUNDLE_BYTES:
                bundle.close()
                bundle = None
            return pa.RecordBatch.from_arrays(rows, [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for page, url, text, first, revisit in zip(*[batch.column(c) for c in ("page_id", "url", "html", "first", "revisit")]):
                page, url, first = page.as_py(), url.as_py(), first.as_py()
                payload = (text.as_py() or "").encode()
                raw = record("revisit" if revisit.as_py() else "response", "" if page is None else str(page), url, payload, digest32(payload), None if first is None else str(first), f"{folder}/{label}/{written}")
                written += 1
                held.append((page, raw))
                size += len(raw)
                if size >= FRAME_BYTES:
                    yield close_frame()
        if held:
            yield close_frame()
        if bundle:
            bundle.close()

    return records.mapInArrow(run, INDEX)


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of the index name: page_id, kind, payload (empty for revisits), payload_bytes, payload_digest, refers_to, and their places.

    Any part of the index will do: one row reads one frame. A bundle is opened once for its rows in a partition, a frame
    found in the seek table and decompressed once, and a record taken from its place there and checked: its length, its id, and a response's digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        fs, path = place(folder)
        name, f, frames, at, raw = None, None, [], None, b""
        for batch in batches:
            rows, taken = [], 0
            for page, bundle, frame, start, length in zip(*[batch.column(c).to_pylist() for c in ("page_id", "bundle", "frame", "record_offset", "record_length")]):
                if bundle != name:
                    if f:
                        f.close()
                    name, f, at = bundle, fs.open_input_file(f"{path}/{bundle}"), None
                    frames = read_seek_table(f)
                if frame != at:
                    offset, size = frames[frame]
                    f.seek(offset)
                    at, raw = frame, unpacker.decompress(f.read(size))
                fields, body = parse(raw[start : start + length])
                kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                number = lambda k: int(fields[k]) if fields.get(k) else None  # noqa: B023, E731
                if number("X-Page-Id") != page or (kind == "response" and digest32(body) != stated):
                    raise ValueError(f"{name}: the record at {start} of frame {frame} is another or was damaged")
                rows.append((page, int(fields["X-Payload-Length"]), stated, kind, number("X-Refers-To-Page-Id"), body, name, frame, start, length))
                taken += len(body)
                if taken > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], NAMES)
                    rows, taken = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], NAMES)
        if f:
            f.close()

    bundles = index.select("bundle").distinct().count()
    # rows of the index are little to Spark and much to read: without a count of partitions all might go to one task
    by_bundle = index.repartition(max(1, bundles), "bundle").sortWithinPartitions("bundle", "frame", "record_offset")
    return by_bundle.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, bundle string, frame int, record_offset long, record_length long")


#: Bytes of payloads after which a batch of records that were read goes on.
BATCH = 1 << 20
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "bundle", "frame", "record_offset", "record_length"]


def archive(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Write a record per page and read the archives back: (records read, index, folder).

    Of records with equal payloads of at least least_bytes bytes, the one with the smallest
    page id is the response and the others revisit it; smaller payloads are all responses. Null html is an
    empty payload; a null url is an empty target. A record with a null id revisits the smallest id; if a payload has only
    null ids, its records are responses. Repeated rows (same id and payload) are the same page and alike in type.
    An empty table writes nothing and reads nothing. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    alike = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("weight")).where("weight > 1")
    alike = settle(alike.withColumn("shared", F.lit(True)), "alike")
    total = spark.read.schema(alike.schema).parquet(alike.settled_at).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    marked = attach(rows, F.col("sha"), alike, "sha", "weight", total, F.struct("page_id", "sha"))
    revisit = F.coalesce(F.col("shared") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    marked = marked.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("first"), revisit.alias("revisit"))
    index = settle(write(marked, folder), "warc-index")
    publish(index, folder)
    discard(alike)
    return read(index, folder), index, folder
