"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

An item of L words is compared with windows of L words, at any offset. A window that reaches the
wanted similarity holds that share of an item's shingles, so only windows around so many places
with shingles of items of their length are fingerprinted. Fingerprints have 64 bits, of the
windows' words by their counts, cut into ``BLOCKS`` blocks. Two within ``RADIUS`` bits differ by
``PROBES`` bits or fewer in some block, and each item is indexed under all such values of each of its
blocks: a join by length, block and value finds every pair within the radius, whichever item
it was that a shingle pointed to. Candidates are written, and verified by the exact similarity of
their shingle multisets, each shingle weighted by its count.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import bind, copy_of, fresh, spread_join, written

SHINGLE = 5
BLOCKS, PROBES = 6, 2
#: Words of a pair at the limit of 0.8 agree to 0.9 at least, where a bit differs with probability
#: 0.144: more than 17 of 64 do about once in 600 such pairs, and less often the nearer they are.
RADIUS = BLOCKS * (PROBES + 1) - 1


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingle(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(size)), *([] if size == SHINGLE else [F.lit(size)]))


def _shingles(w: Column, size: int = SHINGLE) -> Column:
    places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.expr("cast(array() AS array<int>)"))
    return F.transform(places, lambda i: _shingle(w, i, size))


def _of_length(w: Column) -> Column:
    """Shingles of an item or window; of fewer words than SHINGLE, all of them as one."""
    out = _shingles(w)
    for n in range(1, SHINGLE):
        out = F.when(F.size(w) == n, F.array(_shingle(w, F.lit(0), n))).otherwise(out)
    return out


def simhash(features: Column) -> Column:
    """64 bits, each the sign of the sum of the features' bits; a repeated one weighs more."""
    def bits(hs: Column) -> Column:
        one = lambda b: F.aggregate(hs, F.lit(0), lambda a, h: a + F.when(F.bit_get(h, b) == 1, 1).otherwise(-1)) > 0
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(one(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))

    return bind(features, bits)


def _print(w: Column) -> Column:
    return simhash(F.transform(w, lambda x: F.xxhash64(x)))


_CUTS = [(k * 64 // BLOCKS, (k + 1) * 64 // BLOCKS) for k in range(BLOCKS)]


def _block(print_: Column, k: int) -> Column:
    low, high = _CUTS[k]
    return F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << high - low) - 1)).cast("int")


def _masks(k: int) -> list[int]:
    """All values of a block's width with PROBES bits set or fewer."""
    width = _CUTS[k][1] - _CUTS[k][0]
    return [sum(1 << b for b in chosen) for n in range(PROBES + 1) for chosen in combinations(range(width), n)]


def _first_block(x: Column) -> Column:
    """The first block in which two prints with this difference are within PROBES bits."""
    return F.coalesce(*(F.when(F.bit_count(_block(x, k)) <= PROBES, F.lit(k)) for k in range(BLOCKS)))


def _common(one: Column, two: Column) -> Column:
    times = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    return F.aggregate(F.array_distinct(one), F.lit(0), lambda a, x: a + F.least(times(one, x), times(two, x)))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Items that have words, with their length, shingles and fingerprint. An item of fewer words
    than a shingle is one shingle, and found only as it stands."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    return items.select("item_id", F.size("w").alias("length"), _of_length(F.col("w")).alias("shingles"), _print(F.col("w")).alias("print"))


def _index(items: DataFrame) -> DataFrame:
    """Each item under every value of a block that is within PROBES bits of its own."""

    def probes(k: int) -> Column:
        own = _block(F.col("print"), k)
        return F.transform(F.array(*map(F.lit, _masks(k))), lambda m: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(m).alias("value")))

    return items.select("item_id", "length", F.col("print").alias("item_print"), F.inline(F.concat(*map(probes, range(BLOCKS)))))


def _windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, copy, length, at, start, window: the words of the windows whose (length, at) a document
    has in ``wanted``. Only the texts of these documents are cut into words; repeated rows count once."""
    wanted = wanted.withColumnsRenamed({"id": "_id", "copy": "_copy"})
    held = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))).dropDuplicates(["id", "copy"])
    held = held.select("id", "copy", words(F.col("text")).alias("w"), "wanted").select("id", "copy", "w", F.inline("wanted"))
    start = F.greatest(F.col("at"), F.lit(0))
    end = F.least(F.col("at") + F.col("length"), F.size("w"))
    return held.select("id", "copy", "length", "at", start.alias("start"), F.slice("w", start + 1, end - start).alias("window"))


def _seeds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, copy, length, place): each place of a text whose shingle an item of that length has."""
    short = [r.length for r in items.where(F.col("length") < SHINGLE).select("length").distinct().collect()]  # four rows at most

    def of_size(size: int) -> DataFrame:
        some = items.where(F.col("length") == size if size < SHINGLE else F.col("length") >= size)
        # a row a shingle, whatever the number of items that have it; the planner broadcasts it while it is small
        known = some.select("length", F.explode(F.array_distinct("shingles")).alias("h")).groupBy("h").agg(F.collect_set("length").alias("lengths"))
        places = docs.select("id", "copy", F.posexplode(_shingles(F.col("w"), size)).alias("place", "h"))
        return places.join(known, "h").select("id", "copy", F.explode("lengths").alias("length"), "place")

    return reduce(DataFrame.unionByName, map(of_size, [SHINGLE, *sorted(short)]))


def _starts(percent: int) -> Column:
    """Starts of the windows of a length that may reach ``percent`` with an item. A window needs
    that share of an item's shingles, so that many neighbours among ``places`` lie within it."""
    size = F.least(F.col("length"), F.lit(SHINGLE))
    least = F.greatest(F.ceil((F.col("length") - size + 1) * percent / F.lit(100)).cast("int"), F.lit(1))
    last = lambda i: F.get("places", i + least - 1)
    span = F.col("length") - size
    runs = F.filter(F.sequence(F.lit(0), F.size("places") - least), lambda i: last(i) - F.get("places", i) <= span)
    return F.when(F.size("places") >= least, F.array_distinct(F.flatten(F.transform(runs, lambda i: F.sequence(last(i) - span, F.get("places", i))))))


def contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy, item_id, similarity, start: for each document and item of which it holds a
    window of at least ``percent`` hundredths similarity, its best window (the first of equal).

    Null and empty texts hold nothing, items without words are held by nothing, an empty benchmark
    finds nothing. Rows of one id with other texts are told apart by ``copy`` (a hash of the
    text); repeated rows give one row. Very long texts are read whole. A window at the edge of a
    text may be shorter than its item. Other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = documents.select(F.col(id_col).alias("id"), copy_of(text_col).alias("copy"), text.alias("text"))
    items = items_of(benchmark)
    held = _seeds(texts.select("id", "copy", words(F.col("text")).alias("w")), items)
    held = held.groupBy("id", "copy", "length").agg(F.sort_array(F.collect_set("place")).alias("places"))
    held = held.select("id", "copy", "length", F.explode(_starts(percent)).alias("at"))
    held = held.groupBy("id", "copy").agg(F.collect_list(F.struct("length", "at")).alias("wanted"))
    prints = _windows(texts, held).select("id", "copy", "length", "at", _print(F.col("window")).alias("print"))
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("value")) for k in range(BLOCKS)))
    ours = prints.select("id", "copy", "length", "at", "print", F.inline(blocks))
    pairs = spread_join(ours, _index(items), ["length", "block", "value"], "id")
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    # each pair once, under the first block that brings it; fingerprints alone are joined, as the
    # shingles of all windows in each of their blocks would fill the memory of the tasks
    close = pairs.where((F.bit_count(apart) <= RADIUS) & (_first_block(apart) == F.col("block"))).select("id", "copy", "length", "at", "item_id", "item_print")
    close = written(close, "near-windows")
    near = _windows(texts, close.groupBy("id", "copy").agg(F.collect_set(F.struct("length", "at")).alias("wanted")))
    near = near.select(F.col("id").alias("_id"), F.col("copy").alias("_copy"), F.col("length").alias("_length"), F.col("at").alias("_at"), "start", _of_length(F.col("window")).alias("own"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")) & (F.col("length") == F.col("_length")) & (F.col("at") == F.col("_at"))
    known = items.select(F.col("item_id").alias("_item"), F.col("length").alias("_size"), F.col("print").alias("_print"), F.col("shingles").alias("other"))
    its = F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("length") == F.col("_size")) & (F.col("item_print") == F.col("_print"))
    close = close.join(near, same).join(known, its)
    scored = close.withColumn("common", _common(F.col("own"), F.col("other")))
    scored = scored.withColumn("total", F.size("own") + F.size("other") - F.col("common"))
    good = scored.where(F.col("common") * 100 >= F.col("total") * percent).withColumn("similarity", F.col("common") / F.col("total"))
    best = good.groupBy("id", "copy", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "copy", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("start"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, that hold no item. Repeated rows stay or go together."""
    own, copy = fresh(documents, "id0", "copy0")
    found = contaminated(documents, benchmark, percent, id_col, text_col).select(F.col(id_col).alias(own), F.col("copy").alias(copy)).distinct()
    return documents.join(found, documents[id_col].eqNullSafe(found[own]) & (copy_of(text_col) == found[copy]), "left_anti")
