"""Daily price files: zip members and CSVs in any column order."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def extract_prices(archive: str | Path, out_dir: str | Path) -> int:
    """Write the archive's CSVs, without the folders of macOS metadata, and return their number."""
    out, written = Path(out_dir), 0
    out.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if name.endswith(".csv") and not name.startswith("__MACOSX/"):
                (out / name.rsplit("/", 1)[-1]).write_bytes(z.read(name))
                written += 1
    return written


def load_prices(spark: SparkSession, folder: str) -> DataFrame:
    """ticker (the file's name), date, close, adj_close, volume; unreadable rows drop out.

    A file, which holds one ticker's days, is one row of the scan and is split by its own header, so
    files of any number of column orders take one scan and none is read for its header first. A
    file with rows but without one of the columns is an error.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.csv").select("value", F.col("_metadata.file_name").alias("file"))
    lines = files.withColumn("lines", F.split("value", r"\r?\n|\r"))
    lines = lines.select("file", _cells(F.lower(F.col("lines")[0])).alias("header"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    rows = lines.where(F.trim("line") != "").select("file", "header", _cells(F.col("line")).alias("cells"))

    def cell(name: str) -> Column:
        missing = F.raise_error(F.concat(F.lit(f"no column {name} in "), F.col("file"))).cast("long")
        return F.get("cells", (F.coalesce(F.nullif(F.array_position("header", name), F.lit(0)), missing) - 1).cast("int"))

    number = lambda name: cell(name).try_cast("double")
    ticker = F.regexp_extract(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), r"^(.*)\.csv$", 1)
    out = rows.select(ticker.alias("ticker"), F.try_to_date(cell("date"), "yyyy-MM-dd").alias("date"), number("close").alias("close"), number("adj close").alias("adj_close"), number("volume").alias("volume"))
    return out.where(" AND ".join(f"{c} IS NOT NULL" for c in out.columns))


def _cells(line: Column) -> Column:
    """A line's cells: commas within quotes don't part them; blanks, quotes and byte-order marks go."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda c: F.btrim(c, F.lit(' "\ufeff')))
