"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these (space, tab to carriage return).
BLANKS = r"[\x20\x09-\x0D]"

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The URI in ``spark.checkpoint.dir``; only a session on one machine (tests) may lack it and
    gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is removed when the driver ends, as the
    frames that read it are lazy and may be used until then."""
    path = f"{shared_folder(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a path that no frame reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _forget_all() -> None:
    for spark, path in _written:
        try:
            forget(spark, path)
        except Exception:  # the session is gone already
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: later plans start from the files,
    which outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a file that are numbered together by plans that go by the files' order.
CHUNK = 65_536


def in_order(df: DataFrame, chunk: str, row: str) -> DataFrame:
    """``df`` with its rows' order as two columns: ``chunk``, the file (by the number of the part,
    then the path) and the stretch of CHUNK rows in it, and ``row`` within the file. So a sorted
    frame that was written has its order again when it is read. A frame that isn't just a table of
    Parquet files is written first."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or plan.relation().toString() != "parquet":
        df = written(df, "ordered")
    file = df.metadataColumn("_metadata")
    path, index = file.getField("file_path"), file.getField("row_index")
    part = F.coalesce(F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(-1))
    # beyond five digits a name's length comes first; the rest of the name is the same in a job's parts
    return df.withColumns({chunk: F.struct(part.alias("part"), F.length(path).alias("length"), path.alias("path"), F.floor(index / F.lit(CHUNK)).alias("at")), row: index})


def copy_of(text_col: str) -> Column:
    """Tells rows apart that repeat a document id with another text; null and empty are equal."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Tasks that the rows of one key are dealt over.
SPREAD = 32


def spread_join(many: DataFrame, one: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """``many`` with the columns of ``one``, which has a row or few a key. A key that many rows
    share is dealt over SPREAD tasks by a hash of ``by``; rows of ``one`` go to those they are needed in."""
    keys = [key] if isinstance(key, str) else key
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    wanted = salted.select(*keys, "_salt").distinct().join(one, keys)
    return salted.join(wanted, [*keys, "_salt"], how).drop("_salt")


def task_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bind(value: Column, then) -> Column:
    """``then`` of ``value``, worked out once: a lambda's variable isn't replaced by its
    expression, as the optimizer does with a column that is used in one place."""
    return F.element_at(F.transform(F.array(value), then), 1)
