"""Removal of repeated passages with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words; a word goes if a window over it starts earlier elsewhere.
Each text's windows are cut into runs that share the place of the least hash (the leftmost of
equal ones) of the ``SHINGLE``-word shingles inside a window (winnowing). Equal windows have equal
least shingles in equal places, so comparing runs under one shingle finds every repeat, at one row
for about eight windows. A run's row holds the shingle's hash and the hash of all words its
windows cover.

Copies weigh little: of equal rows of one Arrow batch only the first is merged. Shingles that very
many rows have under different spans (a line that all texts share) are dealt by shingle and span
instead of the shingle.

The index is a list of immutable runs in Parquet files sorted by shingle hash. A batch writes a
run of its own and is merge-joined with those before it; a second stage verifies the windows of
shingles that appear under different spans, from the texts, with two independent 64-bit hashes.
Before a batch, more than ``fanout`` runs are compacted into one that holds the first row of
each (shingle, span).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import copy_of, forget, new_path
from tidemark.llm.text_hash import sliding_min, span_hashes, text_bytes, window_hashes, word_hashes, words

WINDOW = 20
SHINGLE = 6
RUN = "id long, copy long, start int, n int, h long, s long, again boolean"
HIT = "id long, copy long, run int, start int, n int, first boolean"
#: A null id counts as the least.
NO_ID = -(2**63)


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: Windows handled at once; a place in them takes the low 24 bits of a shingle's rank.
_PIECE = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)


def runs_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and least shingles of a text's runs, from its word hashes."""
    out = []
    for low in range(0, len(h) - WINDOW + 1, _PIECE):
        shingles = window_hashes(h[low : low + _PIECE + WINDOW - 1], SHINGLE)
        least = sliding_min(shingles & ~_PLACE | np.arange(len(shingles), dtype=np.uint64), WINDOW - SHINGLE + 1)
        at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        out.append((at + low, np.diff(np.concatenate([at, [len(least)]])), shingles[(least[at] & _PLACE).astype(np.int64)]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RUN. ``again``: an earlier row of this Arrow batch has the same shingle and span;
    such rows are known repeats and needn't be merged, so copies weigh once a batch."""
    for batch in batches:
        rows, starts, counts, shingles, spans = [], [], [], [], []
        for i, text in enumerate(batch.column(2)):
            h = word_hashes(text_bytes(text))
            if len(h) < WINDOW:
                continue
            at, n, least = runs_of(h)
            rows.append(np.full(len(at), i))
            starts.append(at)
            counts.append(n)
            shingles.append(least)
            spans.append(span_hashes(h, at, at + n + WINDOW - 1))
        if not rows:
            continue
        row, start, n, h, s = map(np.concatenate, (rows, starts, counts, shingles, spans))
        ids, copies = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row].astype(np.int64)
        order = np.lexsort((start, copies, ids, s, h))
        row, start, n, h, s, ids, copies = (x[order] for x in (row, start, n, h, s, ids, copies))
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (s[1:] == s[:-1])])
        same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (copies[1:] == copies[:-1]) & (start[1:] == start[:-1])]) & again
        keep = ~same  # a repeated row is the same document once more
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(copies[keep]), pa.array(start[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)), _int64(h[keep]), _int64(s[keep]), pa.array(again[keep])], [c.split()[0] for c in RUN.split(", ")])


def _distinct(columns: list[np.ndarray], last: list | None) -> tuple[list[np.ndarray], list]:
    """Sorted columns without rows that repeat the row before (a repeated row of the table is the
    same document), and the last row; ``last`` is that of the batch before."""
    same = np.ones(len(columns[0]), bool)
    for k, c in enumerate(columns):
        same &= np.concatenate([[last is not None and last[k] == c[0]], c[1:] == c[:-1]])
    return [c[~same] for c in columns], [c[-1] for c in columns]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (id, copy, run, start, n, key, sub) sorted by key, sub and order of appearance:
    with ``first`` false those that repeat an earlier row's key and sub, and with ``first`` true
    the first of each sub if its key has several. Holds one row besides the batch."""
    names = [c.split()[0] for c in HIT.split(", ")]
    last = pending = row = None  # of the key before: (key, sub), and its first row if it has one sub so far
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, row = _distinct([c.to_numpy() for c in batch.columns], row)
        if not len(columns[0]):
            continue
        if pending is not None:
            columns = [np.concatenate([p, c]) for p, c in zip(pending, columns, strict=True)]
        key, sub = columns[5], columns[6]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_sub = new_key | np.concatenate([[True], sub[1:] != sub[:-1]])
        open_group = pending is None and last is not None and key[0] == last[0]  # its key has several subs
        if open_group:
            new_sub[0] = sub[0] != last[1]
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, new_sub) > 1
        if open_group:
            several[0] = True
        tail = group == group[-1]
        pending = None
        first = new_sub & several[group]
        if not several[-1]:
            at = int(np.argmax(tail))
            pending = [c[at : at + 1] for c in columns]
        last = key[-1], sub[-1]
        out = first | ~new_sub
        yield pa.RecordBatch.from_arrays([*(pa.array(c[out]) for c in columns[:5]), pa.array(first[out])], names)


#: Rows of windows looked through together for copies.
_HELD = 1 << 17


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the given runs of a text, by two hashes. ``again``: an earlier one of those
    held together has the same."""

    def flushed(held: list[tuple]) -> pa.RecordBatch:
        ids, copies, runs, start, one, two = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((start, copies, ids, runs, two, one))
        ids, copies, runs, start, one, two = (c[order] for c in (ids, copies, runs, start, one, two))
        (one, two, runs, ids, copies, start), _ = _distinct([one, two, runs, ids, copies, start], None)
        again = np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(copies), pa.array(runs), pa.array(start), pa.array(np.ones(len(ids), np.int32)), _int64(one), _int64(two), pa.array(again)], ["id", "copy", "run", "start", "n", "key", "sub", "again"])

    held, rows = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            h = word_hashes(text_bytes(batch.column(3)[i]))
            at = np.array(batch.column(4)[i].values.field("start")), np.array(batch.column(4)[i].values.field("n"))
            start = np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(*at, strict=True)]))
            one, two = window_hashes(h, WINDOW)[start], window_hashes(h, WINDOW, other=True)[start]
            held.append((*(np.full(len(start), batch.column(c)[i].as_py(), t) for c, t in ((0, np.int64), (1, np.int64), (2, np.int32))), start.astype(np.int32), one, two))
            rows += len(start)
            if rows >= _HELD:
                yield flushed(held)
                held, rows = [], 0
    if held:
        yield flushed(held)


_ORDER = ["key", "sub", "run", "id", "copy", "start"]


def _merged(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions(*_ORDER).mapInArrow(_repeats, HIT)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``_ORDER`` with ``again``: whether the row before has the same key and sub."""
    last = row = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, row = _distinct([c.to_numpy() for c in batch.columns], row)
        key, sub = columns[5:]
        if not len(key):
            continue
        again = np.concatenate([[last == (key[0], sub[0])], (key[1:] == key[:-1]) & (sub[1:] == sub[:-1])])
        last = key[-1], sub[-1]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:6]), pa.array(again)], ["id", "copy", "run", "start", "n", "key", "again"])


#: Keys taken as hot: the most frequent, by a sketch, of at least so many rows. What they are
#: changes the tasks, not the result.
HOT_KEYS, HOT_ROWS = 500, 2000


def _hot(rows: DataFrame) -> list[int]:
    row = rows.agg(F.expr(f"approx_top_k(key, {HOT_KEYS}, {HOT_KEYS * 20})").alias("top")).first()
    return sorted(x["item"] for x in row.top or [] if x["item"] is not None and x["count"] >= HOT_ROWS)


def _merged_spread(rows: DataFrame, hot: list[int]) -> DataFrame:
    """As ``_merged``, with the rows of hot keys dealt by key and sub."""
    if not hot:
        return _merged(rows)
    is_hot = F.col("key").isin(hot)
    some = rows.where(is_hot)
    folded = some.repartition("key", "sub").sortWithinPartitions(*_ORDER).mapInArrow(_folded, "id long, copy long, run int, start int, n int, key long, again boolean")
    several = some.groupBy("key").agg((F.min("sub") < F.max("sub")).alias("several"))  # a row a hot key
    folded = folded.join(F.broadcast(several), "key").where("again OR several")
    return _merged(rows.where(~is_hot)).unionByName(folded.select("id", "copy", "run", "start", "n", (~F.col("again")).alias("first")))


class PassageIndex:
    """Runs in a folder that all executors share. Rows of an earlier run count as earlier, then
    the id, the copy (texts of one id) and the start decide."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder or new_path(spark, "passages"), fanout
        self.runs: list[tuple[int, str]] = []  # number of the batch, path
        self.batches = 0

    def _read(self, runs: list[tuple[int, str]]) -> DataFrame:
        frames = [self.spark.read.schema(RUN).parquet(path).withColumn("run", F.lit(k)) for k, path in runs]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def ingest(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """Write the batch's run and return (id, copy, start, n) of its windows that repeat one
        of an earlier run or an earlier one of the batch: windows start .. start + n - 1.
        Both frames have (id, copy, text); ``texts`` holds every batch so far."""
        if len(self.runs) > self.fanout:
            self.compact()
        number, path = self.batches, f"{self.folder}/run-{self.batches}"
        batch.mapInArrow(_spans, RUN).sortWithinPartitions("h", "s").write.parquet(path)
        self.batches += 1
        self.runs.append((number, path))
        rows = self._read(self.runs)
        known = rows.where(F.col("again") & (F.col("run") == number)).select("id", "copy", "start", "n")
        new = rows.where(~F.col("again")).select("id", "copy", "run", "start", "n", F.col("h").alias("key"), F.col("s").alias("sub"))
        merged = _merged_spread(new, _hot(new))
        # what is asked twice of one plan is worked out once: the hits are small beside the runs
        folder = f"{self.folder}/hits-{number}"
        merged.write.parquet(folder)
        hits = self.spark.read.schema(HIT).parquet(folder)
        spans = hits.where(~F.col("first") & (F.col("run") == number)).select("id", "copy", "start", "n")
        open_runs = hits.where("first").groupBy("id", "copy", "run").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
        found = texts.join(open_runs, ["id", "copy"]).select("id", "copy", "run", "text", "spans")
        folder = f"{self.folder}/windows-{number}"
        found.mapInArrow(_windows, "id long, copy long, run int, start int, n int, key long, sub long, again boolean").write.parquet(folder)
        windows = self.spark.read.schema("id long, copy long, run int, start int, n int, key long, sub long, again boolean").parquet(folder)
        exact = _merged(windows.where("NOT again").drop("again")).where(~F.col("first") & (F.col("run") == number)).select("id", "copy", "start", "n")
        copied = windows.where(F.col("again") & (F.col("run") == number)).select("id", "copy", "start", "n")
        return known.unionByName(spans).unionByName(exact).unionByName(copied)

    def compact(self) -> None:
        """One run for all so far, with the first row of each shingle and span. The old files go
        with the index's folder, as frames returned before read them."""
        rows = self._read(self.runs)
        order = F.struct("run", "id", "copy", "start")
        first = rows.groupBy("h", "s").agg(F.min(order).alias("o"), F.min_by("n", order).alias("n"))
        path, number = f"{self.folder}/compact-{self.batches}", self.runs[-1][0]
        first.select("o.id", "o.copy", "o.start", "n", "h", "s", F.lit(False).alias("again")).sortWithinPartitions("h", "s").write.parquet(path)
        self.runs = [(number, path)]

    def drop(self) -> None:
        forget(self.spark, self.folder)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = text_bytes(text)
            starts, ends = words(raw)
            gone = np.zeros(len(starts) + 1, np.int64)
            if spans.is_valid and len(spans):
                a, n = (spans.values.field(k).to_numpy() for k in ("start", "n"))
                np.add.at(gone, a, 1)
                np.add.at(gone, a + n + WINDOW - 1, -1)
            keep = np.cumsum(gone)[:-1] == 0
            data = raw.tobytes()
            kept = data.split() if keep.all() else [data[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
            out.append((len(starts), len(starts) - len(kept), b" ".join(kept)))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([c.decode() for c in columns[2]], pa.string()), pa.array([hashlib.sha256(c).hexdigest() for c in columns[2]], pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), copy_of(text_col).alias("copy"), text.alias("text")]


def remove_passages(df: DataFrame, batches: int = 3, fanout: int = 1, share: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept, kept_sha256: a row for each row, ingested in ``batches``
    ranges of the id, in ascending order, about ``share`` of the rows in each but the last.

    Null texts, empty ones and those of fewer than WINDOW words lose nothing. A null id is the
    least id. Rows of one id with other texts are documents in the order of a hash of the text;
    a row that repeats id and text is the same document again and gets the same result. Very
    long texts are read whole; an empty table gives an empty one; other columns aren't read.
    """
    texts = df.select(*_keys(id_col, text_col))
    bounds = df.stat.approxQuantile(id_col, [share * k for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(b) for b in bounds}), None]
    index, found = PassageIndex(df.sparkSession, fanout=fanout), []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        so_far = texts.where(F.lit(True) if high is None else F.col("id") <= high)
        found.append(index.ingest(so_far.where(F.lit(True) if low is None else F.col("id") > low), so_far))
    spans = found[0]
    for f in found[1:]:
        spans = spans.unionByName(f)
    spans = spans.groupBy("id", "copy").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = texts.join(spans, ["id", "copy"], "left").select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
