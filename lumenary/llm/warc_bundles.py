"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames of about a megabyte of records each, and a skippable frame
at its end that lists the frames' sizes (the public seekable format), so any Zstandard reader reads it whole
and a seek reads one frame. The index maps a record to its bundle, frame and place in the frame.

Tasks write bundles under names of their own attempt, so a repeated task leaves no half bundle in the index.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import shuffle_partitions, whole
from lumenary.session import cut_lineage, work_path

#: Bytes of records in a frame and in a bundle, before compression; a larger record is a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
LEVEL = 3
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0

# The seekable format's numbers, and names that the WARC standard gives.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"

INDEX = "record string, bundle string, frame int, start long, length long"
RECORDS = "bundle string, frame int, start long, record string, record_type string, uri string, digest string, refers_to string, payload_bytes long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    """Line ends and the escape sign itself as %XX, so that a value can't end its header."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def original_value(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(record: str, uri: str | None, date: str, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """One record; `payload` is None for a revisit of `refers_to`, whose full size and digest are stated."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <{RECORD_URN}{header_value(record)}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {header_value(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        lines += [f"WARC-Refers-To: <{RECORD_URN}{header_value(refers_to or '')}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], int, bytes]]:
    """(start, headers, payload size as stated, payload) of each record of a frame."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:cut].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        begin = cut + 4
        end = begin + int(headers["Content-Length"])
        body = data.index(b"\r\n\r\n", begin, end) + 4
        http = dict(line.split(": ", 1) for line in data[begin : body - 4].decode().split("\r\n")[1:])
        yield at, headers, int(http["Content-Length"]), data[body:end]
        at = end + 4


class BundleWriter:
    """Appends records to one bundle; `close` adds the seek table."""

    def __init__(self, out) -> None:
        self.out, self.frames, self.pending, self.size, self.total = out, [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, start) of the record."""
        if self.size and self.size + len(record) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.pending.append(record)
        self.size += len(record)
        self.total += len(record)
        return at

    def flush(self) -> None:
        if self.size:
            packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(b"".join(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def read_frames(source) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the table at the end of an open bundle."""
    end = source.size()
    source.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("a bundle without a seek table")
    source.seek(end - 9 - 8 * n)
    offset, out = 0, []
    for packed, size in struct.iter_unpack("<II", source.read(8 * n)):
        out.append((offset, packed, size))
        offset += packed
    return out


def deduplicated(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(id, uri, html, refers_to): html is null where a row revisits an equal payload of a smaller id."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("uri"), whole(F.col(html_col).cast("string")).alias("html"))
    rows = rows.withColumns({"key": F.sha2("html", 256), "size": F.octet_length("html")})
    first = cut_lineage(rows.groupBy("key", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter(f"n > 1 AND size >= {least}"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    joined = rows.join(first.drop("n"), ["key", "size"], "left")
    return joined.select("id", "uri", "html", F.when(again, F.col("first")).alias("refers_to"))


def write_bundles(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z",
    least: int = LEAST_REVISIT,
) -> DataFrame:
    """Write one record per row below `folder` and return the index (record, bundle, frame, start, length).

    Of equal payloads of `least` bytes or more the smallest id is the response and the others revisit it. A
    null html is an empty payload; rows that repeat the smallest id are responses each; a null id is larger
    than all and stands as an empty record name; a null url is left out. Other columns are not read.
    """
    rows = deduplicated(pages, id_col, url_col, html_col, least)
    rows = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("record"), "uri", "html", F.col("refers_to").cast("string").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, writer, number = f"bundle-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", None, 0
        for batch in batches:
            index = []
            for record, uri, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                payload = html.as_py().encode()
                first = refers_to.as_py() is None
                data = record_bytes(record.as_py(), uri.as_py(), date, payload if first else None, len(payload), payload_digest(payload), refers_to.as_py())
                if writer is not None and writer.total + len(data) > BUNDLE_BYTES:
                    writer.close()
                    writer, number = None, number + 1
                if writer is None:
                    bundle = f"{name}-{number}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{root}/{bundle}", compression=None))
                frame, start = writer.add(data)
                index.append((record.as_py(), bundle, frame, start, len(data)))
            columns = list(zip(*index)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["record", "bundle", "frame", "start", "length"])
        if writer is not None:
            writer.close()

    return cut_lineage(rows.mapInArrow(write, INDEX))


def frames_of(bundles: DataFrame, folder: str) -> DataFrame:
    """(bundle, frame, offset, packed) of every frame of the bundles, from their seek tables."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                with store.open_input_file(f"{root}/{bundle}") as source:
                    found = read_frames(source)
                yield pa.RecordBatch.from_pydict(
                    {
                        "bundle": pa.array([bundle] * len(found), pa.string()),
                        "frame": pa.array(range(len(found)), pa.int32()),
                        "offset": pa.array([x[0] for x in found], pa.int64()),
                        "packed": pa.array([x[1] for x in found], pa.int64()),
                    }
                )

    return bundles.select("bundle").mapInArrow(tables, "bundle string, frame int, offset long, packed long")


def read_records(frames: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the frames; a response's digest is taken anew from its payload and must hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for bundle, frame, offset, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with store.open_input_file(f"{root}/{bundle}") as source:
                    source.seek(offset)
                    data = zstandard.ZstdDecompressor().decompress(source.read(packed))
                rows = []
                for start, headers, size, payload in parse_records(data):
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
                        raise ValueError(f"damaged payload in {bundle}, frame {frame}, at {start}")
                    name, target = (headers.get(h) for h in ("WARC-Record-ID", "WARC-Refers-To"))
                    uri = headers.get("WARC-Target-URI")
                    rows.append(
                        (bundle, frame, start, own_name(name), kind, None if uri is None else original_value(uri), digest,
                         None if target is None else own_name(target), size, payload if payloads and kind == "response" else None)
                    )
                kinds = (pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary())
                names = [x.split()[0] for x in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # frames are dealt anew, in a fixed number of parts: their rows are small, what they stand for isn't
    parts = shuffle_partitions(frames.sparkSession)
    return frames.select("bundle", "frame", "offset", "packed").repartition(parts, "bundle", "frame").mapInArrow(read, RECORDS)


def own_name(urn: str) -> str:
    return original_value(urn[1 + len(RECORD_URN) : -1])


def fetch(index: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """Records named in `wanted` (record); only the frames that hold one of them are read."""
    places = index.join(wanted.select("record").distinct(), "record", "left_semi").select("bundle", "frame", "start").distinct()
    frames = frames_of(places.select("bundle").distinct(), folder).join(places.select("bundle", "frame").distinct(), ["bundle", "frame"], "left_semi")
    return read_records(frames, folder).join(places, ["bundle", "frame", "start"], "left_semi")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to the shared folder, and every record as read back from the bundles."""
    folder = work_path(pages.sparkSession, "warc")
    index = write_bundles(pages, folder, id_col, url_col, html_col)
    return read_records(frames_of(index.select("bundle").distinct(), folder), folder, payloads=False)
