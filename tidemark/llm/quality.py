"""Supervised subword embeddings for document quality.

Words, pairs of neighbouring words and the words' character n-grams are hashed to learned vectors;
a document is the average of the vectors of all its features, a softmax layer scores it. Training
is plain stochastic gradient descent in numpy on a bounded sample of labelled rows, in one task
on an executor: the driver gets one number a bucket. As the score is linear in the average,
scoring needs no more than these numbers. Features are worked out for many texts at once, in
pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text_hash import mix, span_hashes


@dataclass(frozen=True)
class QualityModel:
    """``gain``: of each bucket, what its vector adds to the logit of label 1; ``bias``: the rest."""

    gain: np.ndarray
    bias: float
    ngrams: tuple[int, ...]


@dataclass(frozen=True)
class Training:
    """Bounds and rates. ``sample``: labelled rows learned from at most, those least by a hash of
    the id, whatever the length of their texts."""

    sample: int = 5000
    buckets: int = 1 << 16
    dim: int = 8
    ngrams: tuple[int, ...] = (3, 4)
    epochs: int = 12
    batch: int = 16
    rate: float = 2.0
    seed: int = 7


_BLANKS = np.array([0x20, *range(0x09, 0x0E)], np.uint32)
_MARK = np.uint32(0x20)
#: Characters handled at once. A longer text is cut behind the last blank of each piece, and a
#: word that fills a piece at the piece's end.
PIECE = 1 << 18
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def pieces_of(text: str | None) -> Iterator[np.ndarray]:
    """Code points of a text, blanks as marks, in pieces of up to PIECE; none of an empty text."""
    at, end = 0, len(text or "")
    while at < end:
        stop = min(at + PIECE, end)
        codes = np.frombuffer(text[at:stop].encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[np.isin(codes, _BLANKS)] = _MARK
        if stop < end and len(blanks := np.flatnonzero(codes == _MARK)):
            codes = codes[: blanks[-1] + 1]
        at += len(codes)
        yield codes


def features_of(codes: np.ndarray, owner: np.ndarray, buckets: int, ngrams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of ``codes`` and the owners of their first places. Codes begin and
    end with a mark and have one between owners, whose numbers ascend.

    Features are each word, each pair of neighbouring words of an owner, and each n-gram of the
    characters of a word between two marks. A pair's hash is that of the difference of its words'
    hashes: all words that follow themselves share a bucket, so repetition can be learned.
    """
    inside = codes != _MARK
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    wide = codes.astype(np.uint64)
    hashed, owners = [], []
    if len(starts):
        words = span_hashes(mix(wide * _A), starts, ends)
        pairs = owner[starts[1:]] == owner[starts[:-1]]
        hashed += [words, mix((words[1:] - words[:-1])[pairs] + _B)]
        owners += [owner[starts], owner[starts[:-1][pairs]]]
    for n in ngrams:
        if len(codes) < n:
            continue
        within = inside[1 : len(codes) - n + 2].copy()  # all but the first and last are in a word
        for k in range(2, n - 1):
            within &= inside[k : len(codes) - n + 1 + k]
        at = np.flatnonzero(within)
        h = wide[at] + np.uint64(n << 32)
        for k in range(1, n):
            h = h * _A + wide[at + k]
        hashed.append(mix(h))
        # a mark before a word belongs to the word's owner
        owners.append(owner[at + 1])
    if not hashed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate(hashed) % np.uint64(buckets)).astype(np.int64), np.concatenate(owners)


def _gathered(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and owners (row numbers) of many texts, about PIECE characters at once."""
    codes, owner, held = [], [], 0
    mark = np.array([_MARK])
    for i, text in enumerate(texts):
        for piece in pieces_of(text):
            codes += [mark, piece]
            owner.append(np.full(len(piece) + 1, i))
            held += len(piece)
            if held >= PIECE:
                yield np.concatenate([*codes, mark]), np.concatenate([*owner, [i]])
                codes, owner, held = [], [], 0
    if codes:
        yield np.concatenate([*codes, mark]), np.concatenate([*owner, owner[-1][-1:]])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: CRC-32 of the id as text is a multiple of 5. A row without an id
    has no label and counts as learned from (false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _sample(documents: DataFrame, labels: DataFrame, label: str, opts: Training) -> DataFrame:
    """(doc_id, y, text): labelled documents learned from, drawn among those that have a text's row."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = rows.join(documents.select("doc_id"), "doc_id", "left_semi")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(opts.sample)  # so many rows are broadcast at most
    found = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max((F.col("y") > 0).cast("int")).alias("y"))


def _counted(opts: Training):
    """Each row's buckets and how often it has them: at most a number a bucket, however long the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                total = np.zeros(opts.buckets, np.int64)
                for codes, owner in _gathered(iter([batch.column(1)[i].as_py()])):
                    total += np.bincount(features_of(codes, owner, opts.buckets, opts.ngrams)[0], minlength=opts.buckets)
                at = np.flatnonzero(total)
                packed = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), total[at].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), *packed], ["doc_id", "y", "buckets", "counts"])

    return run


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], opts: Training) -> tuple[np.ndarray, float]:
    """Gains and bias from (label, buckets, counts) of the examples, in their order."""
    y = np.array([t for t, _, _ in examples], np.int64)
    share = y.mean() if len(y) else 0.5
    if not 0 < share < 1:
        return np.zeros(opts.buckets), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    rng = np.random.default_rng(opts.seed)
    vectors = rng.uniform(-1 / opts.dim, 1 / opts.dim, (opts.buckets, opts.dim))
    out, bias = rng.normal(0, 0.1, (opts.dim, 2)), np.zeros(2)
    steps, step = opts.epochs * -(-len(y) // opts.batch), 0
    for _ in range(opts.epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), opts.batch):
            rate = opts.rate * (1 - step / steps)
            step += 1
            ids = order[k : k + opts.batch]
            f = np.concatenate([examples[d][1] for d in ids])
            w = np.concatenate([examples[d][2] / max(examples[d][2].sum(), 1) for d in ids])
            r = np.repeat(np.arange(len(ids)), [len(examples[d][1]) for d in ids])
            mean = np.stack([np.bincount(r, w * vectors[f, j], len(ids)) for j in range(opts.dim)], 1)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1  # the gradient of the loss by the logits
            back = p @ out.T
            out -= rate * mean.T @ p
            bias -= rate * 0.1 * p.sum(0)
            for j in range(opts.dim):
                vectors[:, j] -= rate * np.bincount(f, w * back[r, j], opts.buckets)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def _fitted(opts: Training):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            rows += [(i, t, np.frombuffer(b, np.int32), np.frombuffer(c, np.float32)) for i, t, b, c in zip(*columns, strict=True)]
        rows.sort(key=lambda r: r[0])
        gain, bias = fit([r[1:] for r in rows], opts)
        yield pa.RecordBatch.from_arrays([pa.array([gain.astype(np.float64).tobytes()], pa.binary()), pa.array([bias])], ["gain", "bias"])

    return run


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", opts: Training = Training()) -> QualityModel:
    """Labels of one class only, or none, give a model that returns their share (0.5 for none).
    A repeated label of an id counts once, as the largest; null labels don't count. Of texts
    that share an id the least is learned from; a null text has no features. Very long texts are
    learned from whole, in pieces."""
    counted = _sample(documents, labels, label, opts).select("doc_id", "text", "y")
    kind = dict(documents.dtypes)["doc_id"]
    counted = counted.mapInArrow(_counted(opts), f"doc_id {kind}, y int, buckets binary, counts binary")
    # all in one task: no more than ``sample`` rows of a number a bucket
    row = counted.coalesce(1).mapInArrow(_fitted(opts), "gain binary, bias double").first()
    gain, bias = (np.frombuffer(row.gain), row.bias) if row else fit([], opts)
    return QualityModel(gain, bias, opts.ngrams)


def scores_of(texts: list[str | None], model: QualityModel) -> np.ndarray:
    """The score of each text: the probability of label 1. Texts without words get the bias alone."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for codes, owner in _gathered(iter(texts)):
        f, of = features_of(codes, owner, len(model.gain), model.ngrams)
        low = int(owner[0])
        size = int(owner[-1]) - low + 1
        total[low : low + size] += np.bincount(of - low, model.gain[f], size)
        n[low : low + size] += np.bincount(of - low, minlength=size)
    logit = model.bias + total / np.maximum(n, 1)
    return np.round(1 / (1 + np.exp(-np.clip(logit, -500, 500))), 9)


def score(df: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with ``name``: 0 to 1, of the whole text. Null and empty texts, and texts of blanks,
    get the bias alone; equal texts have equal scores; repeated rows stay; an empty table gives an
    empty one. A column of that name is replaced, others keep their names and values."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: one number a bucket
    columns = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                scores = scores_of(texts.slice(k, 256).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    own = df.select(*columns)
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())]))
