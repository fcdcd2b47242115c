"""Near-duplicates by bottom-k sketches of one hash function, confirmed on full shingle sets.

A document's set is its distinct word shingles, hashed by one function. Its sketch retains the k
least values, with k so large that two sets of Jaccard similarity 0.8 must share retained values:
any order of the values shared by all sets puts the j-th common value of such a pair among the
first n - ceil(0.8 n) + j of both. Inverted lists of the retained values generate overlaps;
pairs whose union sketch holds too few common values for 0.8 are dropped; the others are
compared exactly.

* Equal sets are one class from the start.
* A retained value in more than ``LONG`` classes (a passage that many texts share, or a large
  group of near copies) makes no pairs. Sketches hold a twentieth of the set more than needed, so
  classes with few such values still meet under others. The rest, both sides of which have many,
  are compared by whole sets with the rarest value first, where each list links its members
  to one centre; members that stay apart from it are compared with those that the place of the
  value in both sets and the sets' sizes don't exclude.

Lists never become all their pairs: short ones are bounded by ``LONG``, long ones are stars.
Neither way drops a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import SPREAD, copy_of, fresh, spread_join, written
from tidemark.llm.components import connected_components
from tidemark.llm.text_hash import mix, span_hashes, text_bytes, window_hashes, word_hashes

#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Classes in an inverted list that makes pairs.
LONG = 16
NO_ID = -(2**63)


def shingle_set(raw: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words, A-Z lower-cased; with fewer
    words than ``size`` the whole sequence is one; none without words."""
    h = word_hashes(raw, lower=True)
    if len(h) < size:
        return span_hashes(h, np.array([0]), np.array([len(h)])) if len(h) else h
    return np.unique(window_hashes(h, size))


def needed(n, percent: int = PERCENT):
    """Values that a set of n shares at least with any set it is linked to."""
    return (n * percent + 99) // 100


def surplus(n):
    """Common retained values that a linked pair has at least, by the lesser of its two."""
    return 1 + (n + 19) // 20


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, kept, seen = [], [], [], set()
            for text in batch.column(2):
                values = shingle_set(text_bytes(text), size)
                n.append(len(values))
                own = int(mix(np.add.reduce(mix(values ^ np.uint64(0x1B873593CC9E2D51)), keepdims=True) + np.uint64(len(values)))[0].view(np.int64)) if len(values) else 0
                ids.append(own)
                k = len(values) - needed(len(values)) + surplus(len(values))
                kept.append((values[:k] >> np.uint64(16)).tobytes() if len(values) and own not in seen else None)
                seen.add(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), pa.array(kept, pa.binary())], ["id", "copy", "n", "cls", "kept"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.array([len(b.as_buffer()) // 8 for b in batch.column(2)], np.int64)
        values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        cls, n = np.repeat(batch.column(0).to_numpy(), lengths), np.repeat(batch.column(1).to_numpy(), lengths)
        for k in range(0, len(values), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(values[part]), pa.array(cls[part]), pa.array(n[part])], ["v", "cls", "n"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (v, cls, n) sorted by v and cls: pairs (a < b) under one value with their number and the
    common values they need, and (a, null) with the number of a's values in long lists. Holds a
    list of up to LONG classes besides the batch."""
    v0, c0, n0 = (np.zeros(0, t) for t in (np.int64, np.int64, np.int32))
    long_v = last_c = None
    for batch in _with_end(batches):
        if batch is None:
            v, c, n = v0, c0, n0
            if not len(v):
                return
        else:
            v, c, n = (np.concatenate([x, y.to_numpy()]) for x, y in zip((v0, c0, n0), batch.columns, strict=True))
            if not len(v):
                continue
        fresh = np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])])
        if long_v is not None and v[0] == long_v and c[0] == last_c:
            fresh[0] = False  # that class was counted with the batch before
        v, c, n = v[fresh], c[fresh], n[fresh]
        if not len(v):
            continue
        group = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
        sizes = np.bincount(group)
        is_long = sizes > LONG
        if long_v is not None and v[0] == long_v:
            is_long[0] = True
        held = 0
        if batch is not None and not is_long[-1]:  # the last list may go on
            held = int(sizes[-1])
        v0, c0, n0 = (x[len(x) - held :] for x in (v, c, n))
        if batch is not None:
            long_v, last_c = (v[-1], c[-1]) if is_long[-1] else (None, None)
        v, c, n, group = (x[: len(x) - held] for x in (v, c, n, group))
        if not len(v):
            continue
        out = []
        many = is_long[group]
        own, count = np.unique(c[many], return_counts=True)
        out.append((own, None, count, np.zeros(len(own), np.int64)))
        few = ~many & (sizes[group] > 1)
        v, c, n = v[few], c[few], n[few]
        pairs = []
        for d in range(1, LONG):
            if len(v) <= d:
                break
            at = np.flatnonzero(v[d:] == v[:-d])
            m, w = n[at], n[at + d]
            at = at[100 * np.minimum(m, w) >= PERCENT * np.maximum(m, w)]
            pairs.append(np.stack([c[at], c[at + d], surplus(np.minimum(n[at], n[at + d]).astype(np.int64))], 1))
        if pairs and len(p := np.concatenate(pairs)):
            p, count = np.unique(p, axis=0, return_counts=True)
            out.append((p[:, 0], p[:, 1], count, p[:, 2]))
        for a, b, count, need in out:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(count), pa.array(need)], ["a", "b", "common", "need"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack(text_bytes(t).tobytes()) for t in batch.column(2)], pa.binary())], ["cls", "n", "packed"])


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for cls, n, packed in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                values = shingle_set(np.frombuffer(unpack(packed.as_py()), np.uint8), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), cls.as_py())), pa.array(np.full(len(values), n.as_py(), np.int32))], ["v", "cls", "n"])

    return run


def _jaccard(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            last, both, total = None, [], []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, one = a, shingle_set(np.frombuffer(unpack(x.as_py()), np.uint8), size)
                two = shingle_set(np.frombuffer(unpack(y.as_py()), np.uint8), size)
                both.append(len(np.intersect1d(one, two, assume_unique=True)))
                total.append(len(one) + len(two) - both[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(both, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "both", "total"])

    return run


def _ceil_share(c: Column, percent: int) -> Column:
    return F.floor((c * percent + 99) / 100)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs with the sizes of intersection and union of their full sets. The pairs of a class are
    dealt over SPREAD tasks."""
    pairs = written(pairs.select("a", "b").withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int")), "pairs")
    one, two = (texts.select(F.col("cls").alias(c), F.col("packed").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    one = pairs.select("a", "deal").distinct().join(one, "a")
    return pairs.join(two, "b").join(one, ["a", "deal"]).select("a", "b", "x", "y").mapInArrow(_jaccard(size), "a long, b long, both long, total long")


def _links(confirmed: DataFrame) -> DataFrame:
    return confirmed.where(F.col("both") * 100 >= F.col("total") * PERCENT).select("a", "b")


def _split_pairs(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose classes are not known to be connected."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    apart = pairs.join(a, "a", "left").join(b, "b", "left")
    return apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def _classes(df: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, copy, n, cls) of each row, and (cls, id, copy) of the first document of the component
    of each class."""
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), copy_of(text_col).alias("copy"), F.col(text_col).alias("text"))
    docs = written(texts.mapInArrow(_sketches(size), "id long, copy long, n int, cls long, kept binary"), "sketches")
    classes = docs.where("n > 0").groupBy("cls").agg(F.min(F.struct("id", "copy")).alias("m"), F.max("n").alias("n"))
    lists = docs.where("kept IS NOT NULL").select("cls", "n", "kept").mapInArrow(_unpacked, "v long, cls long, n int")
    overlaps = lists.repartition("v").sortWithinPartitions("v", "cls").mapInArrow(_overlaps, "a long, b long, common long, need long")
    overlaps = written(overlaps.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("need").alias("need")), "overlaps")
    crowded = overlaps.where("b IS NULL").select(F.col("a").alias("cls"), F.col("common").alias("q"))
    qa, qb = (crowded.select(F.col("cls").alias(c), F.col("q").alias(f"q{c}")) for c in "ab")
    # of the union sketch: common values seen, and those that long lists may hide
    pairs = overlaps.where("b IS NOT NULL").join(qa, "a", "left").join(qb, "b", "left")
    pairs = written(pairs.where(F.col("common") + F.least(F.coalesce("qa", F.lit(0)), F.coalesce("qb", F.lit(0))) >= F.col("need")).select("a", "b"), "pairs")
    rest = classes.join(crowded, "cls").where(F.col("q") > _ceil_share(F.col("n"), 4)).select("cls")
    rest = written(rest, "crowded")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(rest).distinct()
    holders = classes.join(wanted, "cls").select("cls", "n", "m.id", "m.copy")
    once = texts.join(holders, ["id", "copy"]).select("cls", "n", "text")
    packed = written(once.mapInArrow(_compressed, "cls long, n int, packed binary").dropDuplicates(["cls"]), "packed")

    # classes with many values in long lists: whole sets, rarest value first
    values = packed.join(rest, "cls", "left_semi").mapInArrow(_whole_sets(size), "v long, cls long, n int")
    values = written(values, "values")
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("cls").orderBy("df", "v")
    prefix = spread_join(values, common, "v", "cls").withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("n") - _ceil_share(F.col("n"), PERCENT) + 1)
    # a list's centre is its member with the least share of values of its own: of near copies the
    # text that the others were made from
    own = F.sum((F.col("df") == 1).cast("int")).over(Window.partitionBy("cls")) / F.col("n")
    prefix = written(prefix.withColumn("own", own).where("df > 1").select("v", "cls", "n", "k", "own"), "prefix")
    centre = prefix.groupBy("v").agg(F.min_by("cls", F.struct("own", "cls")).alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("v", "a")
    starred = written(spread_join(prefix, centre, "v", "cls").select("v", "a", F.col("cls").alias("b"), "n", "k"), "starred")
    # first a star of each list and, for short lists' pairs, each class's least partner
    least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = written(_confirmed(starred.where("a <> b").select("a", "b").unionByName(least).distinct(), packed, size), "confirmed")
    roots = connected_components(_links(first))
    # then what may still connect two components
    other = _split_pairs(pairs.join(least, ["a", "b"], "left_anti"), roots)
    late = written(_links(_confirmed(other.unionByName(_beyond(starred, roots)).distinct(), packed, size)), "links")
    if late.limit(1).collect():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
    grouped = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "m")
    named = grouped.groupBy("root").agg(F.min("m").alias("first"))
    return docs.select("id", "copy", "n", "cls"), spread_join(grouped, named, "root", "cls").select("cls", "first")


def _beyond(starred: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of a list's members that aren't known to be connected and may be linked.

    Under a value at places k and l (from 1, rarest first) of sets of n >= m values, a pair whose
    rarest common value this is shares at most min(n - k, m - l) + 1 values, and a linked pair
    shares 80/180 of n + m at least. So the smaller set's place lies in the first ninth of it, and
    m is at most 9/4 (n - k + 1) - n. Sizes are dealt into steps of a fiftieth, part of the
    join's key, so that a set meets those of fitting sizes only. Members of the
    component of the list's centre are compared with others only, never with one another.
    """
    root = roots.withColumnRenamed("node", "b")
    placed = spread_join(starred, root, "b", "v", "left").select("v", "a", F.col("b").alias("cls"), "n", "k", F.coalesce("root", "b").alias("root"))
    placed = written(placed, "placed")
    hub = placed.groupBy("v").agg(F.min(F.when(F.col("cls") == F.col("a"), F.col("root"))).alias("hub"))
    placed = written(spread_join(placed, hub, "v", "cls").withColumn("apart", F.col("root") != F.col("hub")), "placed")
    left = F.col("n") - F.col("k") + 1
    step = lambda m: F.floor(F.log(F.greatest(m.cast("double"), F.lit(1.0))) / F.lit(0.02)).cast("int")
    most = F.least(F.col("n").cast("double"), left * 100 / F.lit(PERCENT) + left - F.col("n"))
    fewest = F.col("n") * PERCENT / F.lit(100)
    larger = placed.where(most >= fewest - F.lit(1e-6)).withColumn("step", F.explode(F.sequence(step(fewest - F.lit(1e-6)), step(most + F.lit(1e-6)))))
    smaller = placed.where((100 + PERCENT) * left >= 2 * PERCENT * F.col("n")).withColumn("step", step(F.col("n"))).select("v", "step", *(F.col(c).alias(f"{c}1") for c in ("cls", "n", "k", "root", "apart")))
    shared = F.least(left, F.col("n1") - F.col("k1") + 1)
    possible = (F.col("root") != F.col("root1")) & ((F.col("n") > F.col("n1")) | ((F.col("n") == F.col("n1")) & (F.col("cls") < F.col("cls1")))) & (shared * (100 + PERCENT) >= (F.col("n") + F.col("n1")) * PERCENT)
    met = [larger.where(x).join(smaller.where(y), ["v", "step"]).where(possible) for x, y in (("apart", "true"), ("NOT apart", "apart1"))]
    return met[0].unionByName(met[1]).select(F.least("cls", "cls1").alias("a"), F.greatest("cls", "cls1").alias("b"))


def _real(c: Column) -> Column:
    return F.when(c != NO_ID, c)


def near_duplicates(df: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links, itself included), kept
    (doc_id = component_id): a row for each row.

    Null and empty texts and texts of blanks have the empty set and no links: their component is
    their own id. Copies share a component. A null id is the least: its component, and that of
    texts linked with it, is null, and a null id is kept. Rows that repeat an id are compared as
    documents of their own and share the id's fate in ``kept``. Very long texts are compared
    whole; an empty table gives an empty one; columns other than the two are not read.
    """
    docs, firsts = _classes(df, size, id_col, text_col)
    joined = spread_join(docs.where("n > 0"), firsts, "cls", "id", "left").select("id", "n", F.col("first.id").alias("component"))
    joined = joined.unionByName(docs.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return joined.select(_real(F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), _real(F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def first_documents(df: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are the first of their component, by id and then a hash of the text.

    Of rows that repeat id and text one stays, the least by a hash of their other columns (maps
    aside). Texts without words are linked with nothing: those of different ids, and all without
    an id, stay. A null id is the least. Columns keep their names and values.
    """
    docs, firsts = _classes(df, size, id_col, text_col)
    joined = spread_join(docs.where("n > 0"), firsts, "cls", "id", "left").where((F.col("first.id") == F.col("id")) & (F.col("first.copy") == F.col("copy")))
    stay = joined.select("id", "copy").unionByName(docs.where("n = 0").select("id", "copy")).distinct()
    own, copy, rank = fresh(df, "id0", "copy0", "rank0")
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    keyed = df.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), copy: copy_of(text_col)})
    kept = keyed.join(stay.withColumnsRenamed({"id": own, "copy": copy}), [own, copy], "left_semi")
    wordless = ~F.rlike(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    unnamed = F.col(id_col).isNull() & wordless
    # rows without id and words have no key in common, so that any number of them is dealt evenly
    ranked = kept.where(~unnamed).withColumn(rank, F.row_number().over(Window.partitionBy(own, copy).orderBy(F.xxhash64(*hashed)))).where(F.col(rank) == 1)
    return ranked.select(*df.columns).unionByName(keyed.where(unnamed).select(*df.columns))
