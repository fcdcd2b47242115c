"""Content-addressed media payloads in tar shards.

A payload becomes an 8-bit greyscale PNG named by its SHA-256 in a tar file; rows carry digest,
shard, offset and length. Each writing task has shards of its own and stores a digest once in
each, so payloads are never shuffled. Metadata columns come from range reads of the PNG header
alone, features from a range read of the item.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import new_path, written

#: Samples in a row of the image; payloads are padded to a positive multiple of it.
ROW = 576
PAD = 255
#: A shard is closed once it holds so many bytes.
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
READ = "doc_id long, n_bytes long, digest string, shard string, offset long, length long, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes) -> bytes:
    n = max(1, -(-len(text) // ROW)) * ROW
    return text + bytes([PAD]) * (n - len(text))


def to_png(payload: bytes) -> bytes:
    """Rows of ROW 8-bit grey samples, filter 0: lossless, and the same bytes for the same payload."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    """Width and height from the first HEADER_BYTES bytes."""
    if header[:8] != _SIGNATURE or header[12:16] != b"IHDR" or header[24:29] != bytes([8, 0, 0, 0, 0]):
        raise ValueError("not a PNG of 8-bit grey samples")
    return struct.unpack(">II", header[16:24])


def from_png(data: bytes) -> bytes:
    width, height = png_size(data)
    at, body = 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are written here")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Share of the samples, in thousandths, in each sixteenth of the range."""
    counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return "-".join(map(str, counts * 1000 // len(payload)))


class _Shards:
    """Tar files of one task. A retried task writes files of other names; rows name only those
    of the attempt that Spark accepts."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.out = None

    def add(self, data: bytes, digest: str) -> tuple[str, int]:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.seen = self.files.open_output_stream(f"{self.folder}/{self.name}"), {}
            self.at = 0
        if digest not in self.seen:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.seen[digest] = self.at + len(head)
            self.at += len(head) + len(data) + -len(data) % 512
        found = self.name, self.seen[digest]
        if self.at >= SHARD_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = None
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                shards = shards or _Shards(folder)
                data = to_png(payload_of(raw))
                digest = hashlib.sha256(data).hexdigest()
                rows.append((len(raw), digest, *shards.add(data, digest), len(data)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shards:
            shards.close()

    return write


def _reader(folder: str, whole: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        name, shard, known = None, None, {}
        for batch in batches:
            out = []
            for at, offset, length in zip(*(batch.column(k).to_pylist() for k in ("shard", "offset", "length")), strict=True):
                if at != name:
                    if shard:
                        shard.close()
                    name, shard, known = at, files.open_input_file(f"{root}/{at}"), {}
                if offset not in known:
                    if len(known) >= 10_000:
                        known.clear()
                    width, height = png_size(shard.read_at(HEADER_BYTES, offset))
                    item = (width, height, width * height)
                    if whole:
                        data = shard.read_at(length, offset)
                        payload = from_png(data)
                        item += (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload))
                    known[offset] = item
                out.append(known[offset])
            types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())[: 8 if whole else 3]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            names = ["width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], batch.schema.names + names[: len(types)])
        if shard:
            shard.close()

    return read


def write_media(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text (null: empty) and return the index: doc_id, n_bytes, digest, shard,
    offset, length. Equal texts have equal digests; repeated rows stay and those of one
    task point to the same item. A very long text is one item, held in memory whole; an empty
    table writes no shard and gives no rows; other columns aren't stored."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(docs.mapInArrow(_writer(folder), INDEX), "media-index")


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and payload_bytes, from HEADER_BYTES bytes an item."""
    return index.mapInArrow(_reader(folder, False), ",".join(READ.split(",")[:9]))


def read_media(index: DataFrame, folder: str) -> DataFrame:
    """The index with the header's columns and, from the stored bytes, digests and features."""
    return index.mapInArrow(_reader(folder, True), READ)


def store_and_read_back(df: DataFrame) -> DataFrame:
    """``write_media`` to the shared folder, then ``read_media`` of it: a row for each row."""
    folder = new_path(df.sparkSession, "media")
    return read_media(write_media(df, folder), folder)
