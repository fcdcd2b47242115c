"""Token ids in ORC: run-length encoded integer columns, row indexes, Bloom filters on the id.

Documents are range-partitioned by id and sorted, so files and stripes hold disjoint id ranges in
ascending order: a lookup reads the stripes whose index and Bloom filter admit the id, and a scan
splits at stripes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import new_path, written

SCHEMA = "doc_id long, position long, ids array<int>"
#: Words kept with their ids by each worker, and as many that were used before those.
CACHE_WORDS = 600_000
#: Text bytes encoded into one Arrow batch.
CHUNK_BYTES = 4 << 20


#: What a tokenizer file must say for its texts to be encoded by words. White space
#: is dropped and parts words only, letters are lower-cased, and marks are cut from letters.
BY_WORDS = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "split": {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    "bytes": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
}


def by_words(path: str) -> bool:
    """Whether a text's ids under the tokenizer file are those of its words one after another."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    rules = (said["normalizer"] or {}).get("normalizers"), (said["pre_tokenizer"] or {}).get("pretokenizers")
    marked = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in said["added_tokens"])
    return marked and rules == (BY_WORDS["normalizers"], [BY_WORDS["split"], BY_WORDS["bytes"]])


class _Words(dict):
    """Ids of a blank-free piece of text as little-endian bytes. Under a tokenizer file of which
    ``by_words`` holds, a text's ids are those of its pieces, and a letter's or digit's word
    serves before any marks; under others whole texts are encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.encode, self.older, self.by_words = Tokenizer.from_file(path).encode, {}, by_words(path)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(b".,;:!?%$&*#|")
            if len(core) < len(word) and b"<|" not in word and core.decode()[-1:].isalnum():
                ids = self[core] + self[word[len(core) :]]
            else:
                ids = pack(f"<{len(got)}I", *got) if (got := self.encode(word.decode(), add_special_tokens=False).ids) else b""
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def text(self, raw: bytes) -> bytes:
        if not self.by_words:
            got = self.encode(raw.decode(), add_special_tokens=False).ids
            return np.array(got, "<u4").tobytes()
        # A-Z are lower-cased by the tokenizer too, but for its special tokens
        pieces = raw.split() if b"<|" in raw else raw.lower().split()
        return b"".join(map(self.__getitem__, pieces))


_of_worker: dict[str, _Words] = {}


def _words(path: str) -> _Words:
    """Kept from task to task of a worker."""
    if path not in _of_worker:
        _of_worker[path] = _Words(path)
    return _of_worker[path]


def _encoder(tokenizer_path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, position = _words(tokenizer_path), 0
        for batch in batches:
            ids, blobs, lengths, held = batch.column(0), [], [], 0
            first = 0
            for i, text in enumerate(batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                blob = words.text(raw) + end
                blobs.append(blob)
                lengths.append(len(blob) // 4)
                held += len(blob)
                if held >= CHUNK_BYTES or i + 1 == batch.num_rows:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                    values = pa.array(np.frombuffer(b"".join(blobs), "<i4"))
                    n = len(blobs)
                    yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(np.arange(position, position + n)), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "position", "ids"])
                    position, first, blobs, lengths, held = position + n, i + 1, [], [], 0

    return encode


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", index_stride: int = 1000, stripe_bytes: int = 16 << 20) -> None:
    """Encode each whole text (null: empty), append ``end_id`` and write ORC in ascending id
    order, one file a range of ids. Rows without an id come first; rows of one id go by their
    text's CRC, and equal rows follow each other, in any order. Very long texts are one row with
    all their ids; an empty table gives files without rows; other columns aren't written."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("crc"))
    ordered = docs.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc").select("doc_id", "text")
    (
        ordered.mapInArrow(_encoder(tokenizer_path, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, position in the file, ids; filters on doc_id prune stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, at = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "position", "file", "n_tokens", "ids_crc32"])


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32. A file's start is the sum of the files before it (a row a file); a document's is
    a running sum in its file."""
    read = read_tokens(spark, path).select("doc_id", "position", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"), "ids")
    rows = written(read.mapInArrow(_summary, "doc_id long, position long, file long, n_tokens long, ids_crc32 long"), "token-spans")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    by_file = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("total").over(by_file), F.lit(0)).alias("file_start"))
    in_file = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
        .join(starts, "file")
        .select("doc_id", (F.col("file_start") + F.col("_before")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def encode_and_read_back(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``write_tokens`` to the shared folder, then ``token_spans`` of the files: a row for each row."""
    spark = df.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(df, path, tokenizer_path, end_id)
    return token_spans(spark, path)
