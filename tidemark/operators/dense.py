"""Dense features: embeddings by an injected embedder, pooling, standardisation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol as Interface

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.protocol import Protocol


class Embedder(Interface):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A stand-in that needs no model: signed hashes of a text's words, scaled to length 1."""

    def __init__(self, model_id: str, dim: int = 64):
        self.model_id, self.dim = model_id, dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(f"{self.model_id}\0{word}".encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
            row /= max(np.sqrt((row * row).sum()), 1e-9)
        return out.astype(np.float16)


def vintage_for(test_year: int, protocol: Protocol = Protocol()) -> str:
    """The model version whose training text ends before the test year."""
    return protocol.model_template.format(year=test_year - 1)


def mean_pool(hidden: Column, mask: Column, dim: int) -> Column:
    """Mean of the vectors whose mask is 1, over at least one."""
    kept = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x * m)), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / kept)


def _runner(factory: Callable[[str], Embedder], model_id: str, batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = None
        for frame in frames:
            embedder = embedder or factory(model_id)
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                vectors = np.asarray(embedder.embed(part["headline"].tolist())).astype(np.float16).astype(np.float32)
                yield pd.DataFrame({"year": part["year"].to_numpy(), "headline": part["headline"].to_numpy(), "vector": list(vectors)})

    return run


class EmbeddingCache:
    """Vectors of distinct headlines: a Parquet table a model version, partitioned by year."""

    def __init__(self, spark: SparkSession, path: str, factory: Callable[[str], Embedder], protocol: Protocol = Protocol()):
        self.spark, self.path, self.factory, self.protocol = spark, path, factory, protocol

    def _folder(self, model_id: str) -> str:
        return f"{self.path}/{model_id.replace('/', '__')}"

    def _read(self, model_id: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("headline string, vector array<float>, year int").parquet(self._folder(model_id))
        except AnalysisException:
            return None

    def vectors(self, rows: DataFrame, model_id: str, fill: bool = False) -> DataFrame:
        """year, headline, embedding of the rows' years. Years without a cache are embedded in one
        job, each headline once a year; a cached year that lacks headlines is an error, or with
        ``fill`` is completed."""
        dated = rows.select(F.year("signal_date").alias("year"), "headline").distinct()
        years = [r.year for r in dated.select("year").distinct().collect()]  # a row a year
        lacking, cache = dated, self._read(model_id)
        if cache is not None:
            cache = cache.where(F.col("year").isin(years))
            lacking = dated.join(cache, ["year", "headline"], "left_anti")
            if not fill and (short := lacking.join(F.broadcast(cache.select("year").distinct()), "year", "left_semi").first()):
                raise ValueError(f"the embedding cache of {model_id}, {short.year} lacks headlines; delete it and run again")
        new = lacking.mapInPandas(_runner(self.factory, model_id, self.protocol.embed_batch), "year int, headline string, vector array<float>")
        new.write.mode("append").partitionBy("year").parquet(self._folder(model_id))
        return self._read(model_id).where(F.col("year").isin(years)).select("year", "headline", F.col("vector").alias("embedding"))

    def embed(self, rows: DataFrame, model_id: str, fill: bool = False) -> DataFrame:
        """``rows`` with ``embedding``."""
        return with_vectors(rows, self.vectors(rows, model_id, fill))


def with_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """``rows`` with the embedding of their year and headline; those without one drop out."""
    found = vectors.withColumnsRenamed({"year": "_year", "headline": "_headline"})
    return rows.join(found, (F.year(rows["signal_date"]) == found["_year"]) & (rows["headline"] == found["_headline"])).select(*rows.columns, "embedding")


def moments_of(train: DataFrame, column: str) -> DataFrame:
    """place, mean, scale (population deviation, 1 where it is 0): a row a feature."""
    wide = train.select(F.posexplode(column).alias("place", "x"))
    deviation = F.stddev_pop(F.col("x").cast("double"))
    return wide.groupBy("place").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.when(deviation > 0, deviation).otherwise(1.0).alias("scale"))


def standardise(train: DataFrame, others: list[DataFrame], column: str) -> list[DataFrame]:
    """Each frame with ``features``: the column by the training rows' moments, as a vector."""
    rows = moments_of(train, column).orderBy("place").collect()  # a row a feature
    mean, scale = F.array(*(F.lit(r["mean"]) for r in rows)), F.array(*(F.lit(r["scale"]) for r in rows))
    centred = F.zip_with(F.zip_with(column, mean, lambda x, m: x - m), scale, lambda x, s: x / s)
    return [f.withColumn("features", array_to_vector(centred)) for f in (train, *others)]
