"""Seeded samples and permutations that don't depend on the partitioning."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _draw(column: str, seed: int) -> Column:
    """A seeded hash of a value's text."""
    return F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))))


def seeded_sample(values: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct values, those least by a seeded hash: a top-n, not a sort."""
    return values.select(column).distinct().orderBy(_draw(column, seed), column).limit(n)


def _numbered(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``df`` with ``_i``, the row's place by the seeded hash of the id. Rows are numbered in 256
    buckets by the hash's first two digits, so no task orders them all."""
    drawn = df.withColumn("_h", _draw(id_col, seed)).withColumn("_b", F.substring("_h", 1, 2))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    placed = drawn.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)))
    return placed.join(F.broadcast(offsets), "_b").withColumn("_i", F.col("_i") + F.col("_o")).drop("_o", "_b", "_h")  # 256 rows are broadcast


def shuffle_labels(rows: DataFrame, seed: int, label: str = "y", id_col: str = "row_id") -> DataFrame:
    """``rows`` with the labels permuted over all rows (a shuffle within days would keep each
    day's share): the k-th row by one seeded hash takes the label of the k-th by another."""
    taken = _numbered(rows.select(id_col, label), id_col, seed + 1_000_003).select("_i", F.col(label).alias("_label"))
    return _numbered(rows, id_col, seed).join(taken, "_i").withColumn(label, F.col("_label")).select(*rows.columns)


def probe_days(start: date, end: date, n: int) -> list[date]:
    """n weekdays spread evenly from the first to the last of the span."""
    days = [d for k in range((end - start).days + 1) if (d := start + timedelta(days=k)).weekday() < 5]
    if not 2 <= n <= len(days):
        raise ValueError(f"the number of days must be from 2 to {len(days)}")
    return [days[round(k * (len(days) - 1) / (n - 1))] for k in range(n)]
