"""TF-IDF features: vocabulary and weights from the training rows alone."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import ngrams, tokens


def term_counts(rows: DataFrame, text: str = "headline", id_col: str = "row_id", span: tuple[int, int] = (1, 1), known: DataFrame | None = None) -> DataFrame:
    """row id, term, tf, and the columns of ``known``, if given, of whose terms alone there are
    rows. The texts are dealt by id once; counting, and windows of a row, need no other shuffle."""
    words = rows.select(id_col, tokens(F.col(text)).alias("_w")).repartition(id_col)
    terms = words.select(id_col, F.explode(ngrams(F.col("_w"), *span)).alias("term"))
    extra = [] if known is None else [c for c in known.columns if c != "term"]
    if known is not None:
        terms = terms.join(F.broadcast(known), "term")  # at most max_features rows
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), *(F.first(c).alias(c) for c in extra))


def vocabulary(train: DataFrame, text: str = "headline", id_col: str = "row_id", span: tuple[int, int] = (1, 1), min_df: int = 5, max_features: int = 50_000) -> DataFrame:
    """term, df, total, idf of at most ``max_features`` terms in ``min_df`` rows at least, those of
    the largest totals (then by name)."""
    n = train.agg(F.count(F.lit(1)).alias("n"))
    counts = term_counts(train, text, id_col, span).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = counts.where(F.col("df") >= min_df).orderBy(F.col("total").desc(), "term").limit(max_features)
    rows = n.first()[0]
    return kept.withColumn("idf", F.log((F.lit(1.0) + rows) / (1 + F.col("df"))) + 1)


def weights(rows: DataFrame, terms: DataFrame, text: str = "headline", id_col: str = "row_id", span: tuple[int, int] = (1, 1)) -> DataFrame:
    """row id, term, weight: (1 + ln tf) idf, each row scaled to length 1; unknown terms drop out."""
    raw = term_counts(rows, text, id_col, span, terms).withColumn("_r", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_r") * F.col("_r")).over(Window.partitionBy(id_col)))
    return raw.withColumn("weight", F.col("_r") / norm)


def features(rows: DataFrame, terms: DataFrame, text: str = "headline", id_col: str = "row_id", span: tuple[int, int] = (1, 1), folder: str | None = None) -> DataFrame:
    """``rows`` with ``features``, a sparse vector over ``terms`` in their order by name; a row
    without a known term has no entries. Vectors are assembled by SQL as the struct that a vector is
    stored as, written, and read as vectors."""
    size = terms.count()
    numbered = terms.orderBy("term").coalesce(1).withColumn("_at", F.monotonically_increasing_id().cast("int"))
    # rounded, as a column that is constant but for the last bits would stall the optimiser, which
    # scales columns by their deviation
    entry = F.struct(F.col("_at"), F.round("weight", 12).alias("weight"))
    packed = weights(rows, numbered, text, id_col, span).groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    part = lambda k, t: F.coalesce(F.transform("_e", lambda e: e[k]), F.expr(f"cast(array() AS array<{t}>)"))
    joined = rows.join(packed, id_col, "left")
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(max(size, 1)).alias("size"), part("_at", "int").alias("indices"), part("weight", "double").alias("values"))
    path = f"{folder or _folder(rows)}/features-{uuid.uuid4().hex}"
    joined.select(*rows.columns, vector.alias("features")).write.parquet(path)
    return rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("features", VectorUDT())])).parquet(path)


def _folder(rows: DataFrame) -> str:
    """The shared folder that the session names; a temporary one only without, on one machine."""
    spark = rows.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or "file://" + tempfile.mkdtemp(prefix="tidemark-")
