"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash, are cut into blocks of ``block_bytes``. Of a
source with weight w, block j is released at floor(j / w) and due by ceil((j + 1) / w); in each
slot the released block that is due first goes. As the weights fill every slot, all blocks
meet their deadlines, so after any number of slots a source is less than one block away from its
share. Weights are multiples of 1 / period, and the schedule repeats after a period.

Sources beyond ``GROUP`` are dealt into groups by a hash: groups are scheduled like sources, and
a group's slots are scheduled among its sources, so a source is less than a block a level away
from its share. Each group's period is worked out in a task of its own, whatever the amount of
data and the number of sources.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import fresh, task_count, written

#: So many sources or groups are scheduled together, on average.
GROUP = 10_000
PLANNED = "name string, above string, slots int, length int, total double, places array<int>"


def slots_of(weights: dict, period: int) -> dict:
    """Whole slots of a period, at least one for each positive weight, by largest remainders."""
    positive = {k: w for k, w in weights.items() if w > 0}
    total, spare = sum(positive.values()), period - len(positive)
    if spare < 0:
        raise ValueError(f"{len(positive)} sources don't fit {period} slots")
    exact = {k: spare * w / total for k, w in positive.items()}
    slots = {k: 1 + int(x) for k, x in exact.items()}
    left = period - sum(slots.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))[:left]:
        slots[k] += 1
    return slots


def schedule(slots: dict) -> list:
    """The source of each slot of a period: earliest deadline first among released blocks, the
    heavier source and then the name deciding between equal deadlines."""
    period = sum(slots.values())
    due = lambda k, j: -(-(j + 1) * period // slots[k])
    waiting = [(0, i, k, 0) for i, k in enumerate(sorted(slots, key=str))]  # release, tie, source, block
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(k, j), -slots[k], i, k, j))
        deadline, _, i, k, j = heapq.heappop(ready)
        assert t < deadline, "weights that fill the period meet every deadline"
        out.append(k)
        if j + 1 < slots[k]:
            heapq.heappush(waiting, ((j + 1) * period // slots[k], i, k, j + 1))
    return out


def tempered(totals: dict, power: float) -> dict:
    """Weights in proportion to a power of the sources' bytes."""
    return {k: float(max(b, 1)) ** power for k, b in totals.items()}


def _planned(period: int):
    """Arrow rows (name, above, weight) of a group to its period: rows of ``PLANNED``."""
    def plan(rows: pa.Table) -> pa.Table:
        given = dict(sorted(zip(rows["name"].to_pylist(), rows["weight"].to_pylist(), strict=True)))
        slots = slots_of(given, max(period, 10 * len(given)))
        places: dict = {k: [] for k in slots}
        for t, k in enumerate(schedule(slots)):
            places[k].append(t)
        n, total, above = len(slots), sum(given.values()), rows["above"][0].as_py()
        columns = [list(slots), [above] * n, list(slots.values()), [sum(slots.values())] * n, [total] * n, list(places.values())]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32())]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["name", "above", "slots", "length", "total", "places"])

    return plan


def _levels(weights: DataFrame, period: int, group: int) -> list[DataFrame]:
    """Periods of the sources in their groups, of the groups in theirs, and so on up to one group."""
    levels, n = [], weights.count()
    while n:
        groups = -(-n // group)
        named = weights.withColumn("above", F.pmod(F.xxhash64("name"), F.lit(groups)).cast("string"))
        levels.append(written(named.groupBy("above").applyInArrow(_planned(period), PLANNED), "periods"))
        if groups == 1:
            break
        weights = levels[-1].select(F.col("above").alias("name"), F.col("total").alias("weight")).distinct()
        n = weights.count()
    return levels


def _slotted(blocks: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``blocks`` (name, block, ...) with ``slot``; null for sources that have none."""
    out = blocks.withColumns({"_at": F.col("name"), "slot": F.col("block")})
    for planned in levels:
        shares = planned.select(F.col("name").alias("_at"), F.col("above").alias("_above"), F.col("slots").alias("_k"), F.col("length").alias("_length"))
        # a row a slot of the period, so that the blocks of a large source aren't joined as one key
        places = planned.select(F.col("name").alias("_at"), F.posexplode("places").alias("_r", "_t"))
        out = out.join(shares, "_at", "left").withColumn("_r", (F.col("slot") % F.col("_k")).cast("int")).join(places, ["_at", "_r"], "left")
        out = out.withColumns({"slot": F.expr("slot div _k") * F.col("_length") + F.col("_t"), "_at": F.col("_above")})
        out = out.drop("_above", "_k", "_length", "_r", "_t")
    return out.drop("_at") if levels else out.drop("_at").withColumn("slot", F.lit(None).cast("long"))


def _name(source: Column) -> Column:
    """A source as a string that isn't null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix(df: DataFrame, weights: dict | None = None, power: float = 0.7, block_bytes: int = 16_384, period: int = 1000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", group: int = GROUP) -> DataFrame:
    """``df`` with ``block`` (of its source), ``slot`` (its block's place in the mixture),
    ``place`` (bytes of its source before it) and ``taken``: whether its slot comes before the
    first that lacks its block, so that the taken documents have the target weights. Columns of
    these names are replaced.

    Weights default to the given power of each source's bytes; sources without a weight get no
    slot (``slot`` null, not taken). A null source is a source; null and empty texts have size 1, as any text
    its bytes plus 1. A very long document covers several blocks and goes whole in the slot of its
    first; the blocks that begin inside it are empty. So a source is less than a block and its
    longest document from its share. Repeated rows are documents of their own, in any order; ties
    of the hash go by id, size and CRC. An empty table gives an empty one.

    The order is that of a hash, whose first bits deal a source's rows into buckets, each sorted
    by itself; the number of buckets changes the tasks, not the result.
    """
    spark = df.sparkSession
    df = df.drop("block", "slot", "place", "taken")
    size, rank, crc, bucket, source, offset, first, slots, before = fresh(df, "size0", "rank0", "crc0", "bucket0", "source0", "offset0", "first0", "slots0", "before0")
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = max(4, (task_count(spark) - 1).bit_length())
    keyed = df.withColumns({size: F.octet_length(text).cast("long") + 1, crc: F.crc32(text), source: _name(F.col(source_col))})
    keyed = keyed.withColumn(rank, F.shiftrightunsigned(F.xxhash64(id_col, crc), 1))
    keyed = keyed.withColumn(bucket, F.shiftrightunsigned(rank, 63 - bits).cast("int"))
    # written once: texts aren't read again for totals, offsets and blocks
    parts = written(keyed.groupBy(F.col(source).alias("name"), F.col(bucket).alias("b")).agg(F.sum(size).alias("bytes")), "parts")
    totals = parts.groupBy("name").agg(F.sum("bytes").alias("bytes"))
    if weights:
        given = [("" if k is None else f"={k}", float(w)) for k, w in weights.items() if w > 0]
        wanted = totals.join(spark.createDataFrame(given, "name string, weight double"), "name").select("name", "weight")
    else:
        wanted = totals.select("name", F.pow(F.greatest("bytes", F.lit(1)).cast("double"), F.lit(float(power))).alias("weight"))
    levels = _levels(wanted, period, group)
    so_far = Window.partitionBy("name").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("o", F.coalesce(F.sum("bytes").over(so_far), F.lit(0)))
    begin, last = F.expr(f"o div {block_bytes}"), F.expr(f"(o + bytes - 1) div {block_bytes}")
    blocks = _slotted(offsets.select("name", "b", "o", begin.alias("first"), F.explode(F.sequence(begin, last)).alias("block")), levels)
    # the blocks that a bucket's rows begin in, by bucket: no more numbers than blocks and buckets
    held = blocks.groupBy("name", "b", "o", "first").agg(F.sort_array(F.collect_list(F.struct("block", "slot"))).alias("slots"))
    held = held.select(F.col("name").alias(source), F.col("b").alias(bucket), F.col("o").alias(offset), F.col("first").alias(first), F.col("slots.slot").alias(slots))
    end = _slotted(totals.select("name", F.expr(f"(bytes + {block_bytes - 1}) div {block_bytes}").alias("block")), levels).agg(F.min("slot")).first()[0] or 0
    within = Window.partitionBy(source, bucket).orderBy(rank, id_col, size, crc).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn(before, F.coalesce(F.sum(size).over(within), F.lit(0))).join(held, [source, bucket])
    placed = placed.withColumn("place", F.col(before) + F.col(offset)).withColumn("block", F.floor(F.col("place") / F.lit(block_bytes)))
    out = placed.withColumn("slot", F.get(slots, (F.col("block") - F.col(first)).cast("int"))).withColumn("taken", F.coalesce(F.col("slot") < F.lit(end), F.lit(False)))
    return out.select(*df.columns, "block", "slot", "place", "taken")


def taken(df: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, with the columns of ``df``; those named like a column of
    ``mix`` are replaced."""
    return mix(df, **options).where("taken").select(*df.columns)


def mixture(df: DataFrame, **options) -> DataFrame:
    """All rows of ``df`` in the order of their slots. A source that has run out leaves its slots
    unused, so the others go on at their relative weights; rows without a slot come last. Columns
    named like those of ``mix`` keep the values of ``df``."""
    names = ["block", "slot", "place", "taken"]
    aside = fresh(df, *(f"{c}_of_df" for c in names))
    held = {c: a for c, a in zip(names, aside, strict=True) if c in df.columns}
    mixed = mix(df.withColumnsRenamed(held), **options).orderBy(F.col("slot").asc_nulls_last(), "place")
    return mixed.select(*(F.col(held.get(c, c)).alias(c) for c in df.columns))
