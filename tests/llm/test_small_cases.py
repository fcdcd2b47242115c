"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each
operator and each stage."""

import importlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import _shared, decontaminate, licenses, media_shards, mixing, neardup, passages, pii, quality, sharding, token_orc

LONG = "word " * 30_000
ROWS = [
    (None, "a text without an id, of some words more than five", "s0"),
    (1, None, None),
    (2, "", "s0"),
    (3, " \t\n ", "s0"),
    (4, "same words here for two of the documents", "s1"),
    (5, "same words here for two of the documents", "s1"),
    (5, "same words here for two of the documents", "s1"),
    (5, "the same id with another text of several words", "s1"),
    (6, LONG, "s0"),
    (7, "éè \U0001f600 x@y.example.com +1 (212) 555-0100", "s0"),
]
CLASHES = ["score", "_score", "size", "_size", "size0", "bucket0", "_bucket", "rank0", "id", "id0", "copy", "text_crc32", "block", "slot", "h", "w", "n", "cls", "spans", "kept", "path", "shard", "_text", "first0"]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def apply(spark, name, df):
    import public_tokenizers

    return {
        "pii": lambda: pii.find_personal_data(df),
        "decontaminate": lambda: decontaminate.contaminated(df, benchmark(spark, [(1, "the same id with another text"), (2, None), (3, "too short")])),
        "neardup": lambda: neardup.near_duplicates(df, size=4),
        "quality": lambda: quality.score(df, quality.train(df, labels(spark, [(1, 0, 0), (4, 1, 0), (5, 1, None), (None, 1, 1), (7, None, 0)]))),
        "licenses": lambda: licenses.scan_licenses(df, F.concat_ws("/", "source", F.col("doc_id").cast("string"))),
        "media": lambda: media_shards.store_and_read_back(df),
        "tokens": lambda: token_orc.encode_and_read_back(df, public_tokenizers.path("word_bpe_49k.json"), 2),
        "passages": lambda: passages.remove_passages(df),
        "mixing": lambda: mixing.mix(df, block_bytes=64),
        "sharding": lambda: sharding.shard_documents(df),
    }[name]()


NAMES = ["pii", "neardup", "quality", "licenses", "media", "tokens", "passages", "mixing", "sharding"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(spark, docs, name):
    got = apply(spark, name, docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(r.doc_id or 0 for r in got) == sorted(r[0] or 0 for r in ROWS)


@pytest.mark.parametrize("name", [*NAMES, "decontaminate"])
def test_empty_table(spark, none, name):
    assert apply(spark, name, none).collect() == []


def test_decontaminate_odd_rows(spark, docs):
    got = apply(spark, "decontaminate", docs).collect()
    assert [(r.doc_id, r.item_id, r.similarity) for r in got] == [(5, 1, 1.0)]
    assert decontaminate.clean_documents(docs, benchmark(spark, [(1, "the same id with another text")])).count() == len(ROWS) - 1
    assert decontaminate.contaminated(docs, benchmark(spark)).count() == 0


#: Columns that an operator says it replaces or adds.
SAID = {"quality": {"score"}, "mixing": {"block", "slot"}, "sharding": {"size", "text_crc32", "shard", "slot"}}


@pytest.mark.parametrize("name", SAID)
def test_other_columns_keep_their_values(spark, docs, name):
    for r in apply(spark, name, docs).collect():
        assert all(r[c] == f"own {c}" for c in CLASHES if c not in SAID[name])


@pytest.mark.parametrize("name", ["mixing", "sharding"])
def test_results_do_not_depend_on_partitions(spark, name):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 AS int)) AS text", "concat('s', id % 7) AS source")
    old, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 16, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, apply(spark, name, df.repartition(5)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] == got[2]


def test_stages_with_odd_rows(spark, docs, tmp_path):
    """Each stage by itself on nulls, ties, repeated rows, a long text and clashing columns."""
    pipeline = importlib.import_module("corpus_pipeline")
    labels(spark, [(1, 0, 0), (4, 1, 0), (7, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark, [(1, "the same id with another text"), (2, "")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, every = dict(pipeline.STAGES), sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    got = {name: stage(spark, docs, str(tmp_path)) for name, stage in stages.items()}
    for name, out in got.items():
        said = SAID["sharding"] if name == "sharding" else set()
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES if c not in said)
        kept = sorted((r.doc_id or 0, r.text or "") for r in rows)
        if name in ("mixing", "sharding"):
            assert kept == every
        if name == "decontamination":
            assert kept == [r for r in every if "another text" not in r[1]]
        if name == "near_dedup":  # 4, 5 and 5 are copies of one another: 4 stays, once
            assert kept == [r for r in every if r[0] != 5 or "another" in r[1]]


def test_repeated_rows_leave_the_near_dedup_once(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    text = "one text of more than five words"
    rows = [(1, text, "a")] * 3 + [(2, text, "a"), (None, None, "a"), (None, "", "b"), (3, "", "b"), (3, "", "b")]
    out = pipeline.distinct_documents(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "").collect()
    assert sorted((r.doc_id or 0, r.text or "", r.source) for r in out) == [(0, "", "a"), (0, "", "b"), (1, text, "a"), (3, "", "b")]


def test_stages_keep_columns_and_rows(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = [(k, f"document {k} has its own words {' '.join(f'{k}x{j}' for j in range(30))}", "en", f"s{k % 2}", 10) for k in range(12)] + [(None, None, None, None, None), (99, "", "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels(spark, [(1, 1, 0), (2, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark, [(1, " ".join(f"3x{j}" for j in range(20)))]).write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert out.columns[:5] == df.columns and (name == "sharding" or out.columns == df.columns)
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
        if name == "decontamination":
            assert {r.doc_id for r in out.collect()} == {r[0] for r in rows} - {3}
        if name in ("quality", "near_dedup"):
            assert out.count() == len(rows)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert got and 3 not in {r.doc_id for r in got}


@pytest.mark.parametrize("files", [True, False])
def test_shards_keep_the_order_of_the_mixture(spark, tmp_path, monkeypatch, files):
    """The last two stages as the pipeline runs them, over several files, and unwritten; a hot source,
    a source of one row, a null one and a repeated row."""
    pipeline = importlib.import_module("corpus_pipeline")
    monkeypatch.setattr(pipeline, "STAGES", pipeline.STAGES[-2:])
    rows = [(k, f"{k} " * 500, "ab"[k % 5 == 0]) for k in range(600)] + [(600, "one", "c"), (601, "null", None), (7, "7 " * 500, "a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the mixture is one file
        want = [r.doc_id for r in mixing.mixture(df).collect()]
        if files:
            got = pipeline.run(spark, str(tmp_path)).collect()
        else:
            got = pipeline.sharded_documents(spark, mixing.mixture(spark.read.parquet(f"{tmp_path}/documents.parquet")), "").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    shard_of = {r.doc_id: r.shard for r in got}
    assert len(got) == len(want) == 603 and set(shard_of.values()) == set(range(8))
    for s in range(8):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert own == list(enumerate(k for k in want if shard_of[k] == s))


def test_order_of_files_and_of_stretches_in_them(spark, tmp_path, monkeypatch):
    """Parts by number, beyond five digits too, files of a part by name, other files first."""
    names = ["a", "part-00002-x-c000", "part-00010-x-c000", "part-00010-x-c001", "part-99999-x-c000", "part-100000-x-c000", "part-100001-x-c000"]
    for k, name in enumerate(names):
        spark.range(100 * k, 100 * k + 100, numPartitions=1).selectExpr("id AS doc_id", "'t' AS text").write.parquet(f"{tmp_path}/{name}")
        (part,) = (tmp_path / name).glob("part-*")
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / f"{name}.parquet")
    monkeypatch.setattr(_shared, "CHUNK", 16)
    got = sharding.shard_documents(spark.read.parquet(f"{tmp_path}/all"), keep_order=True).collect()
    assert len(got) == 700
    for s in range(8):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert own == list(enumerate(sorted(r.doc_id for r in got if r.shard == s)))
