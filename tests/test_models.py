from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import dense, model, sampling, splits, tfidf
from tidemark.protocol import Protocol


def rows(spark, texts, day=date(2012, 1, 3)):
    return spark.createDataFrame([(k, t, day) for k, t in enumerate(texts)], "row_id long, headline string, signal_date date")


def test_splits(spark):
    s = splits.walk_forward_splits([2013])[0]
    assert (s.select, s.validate, s.refit) == ((2009, 2011), 2012, (2009, 2012))
    days = [date(2010, 12, 30), date(2010, 12, 31), date(2011, 12, 29), date(2011, 12, 30), date(2012, 1, 3)]
    panel = spark.createDataFrame([(k, d) for k, d in enumerate(days)], "row_id long, signal_date date")
    cal = panel.select(F.col("signal_date").alias("date"))
    kept = lambda *a: sorted(r.row_id for r in splits.select_years(panel, *a).collect())
    assert kept(2010, 2011) == [0, 1, 2, 3] and kept(2010, 2011, cal) == [0, 1, 2] and kept(1990, 1991, cal) == []


def test_tfidf_by_hand(spark):
    texts = ["aa bb bb", "aa cc", "aa", "", None, "bb aa"]
    vocab = tfidf.vocabulary(rows(spark, texts), min_df=2)
    idf = {r.term: r.idf for r in vocab.collect()}
    assert idf == {"aa": pytest.approx(np.log(7 / 5) + 1), "bb": pytest.approx(np.log(7 / 3) + 1)}
    f = {r.row_id: r.features for r in tfidf.features(rows(spark, texts), vocab).collect()}
    w = np.array([idf["aa"], (1 + np.log(2)) * idf["bb"]])
    assert f[0].toArray() == pytest.approx(w / np.linalg.norm(w)) and f[3].numNonzeros() == 0 and f[1].toArray() == pytest.approx([1, 0])


def test_vocabulary_is_cut_by_total_then_name(spark):
    got = [r.term for r in tfidf.vocabulary(rows(spark, ["bb aa cc", "cc bb aa"]), min_df=1, max_features=2).collect()]
    assert sorted(got) == ["aa", "bb"]
    terms = {r.term for r in tfidf.vocabulary(rows(spark, ["ab cd", "x"]), span=(1, 2), min_df=1).collect()}
    assert terms == {"ab", "cd", "ab cd"}


def test_tokens_are_unicode(spark):
    got = rows(spark, ["Ünïted_1 a éé!"]).select(text.tokens(F.col("headline")).alias("t")).first().t
    assert got == ["ünïted_1", "éé"]


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = (x @ [1, -1, 0.5] + rng.normal(size=80) > 0).astype(int)
    df = spark.createDataFrame([(k, [float(v) for v in row], int(t)) for k, (row, t) in enumerate(zip(x, y, strict=True))], "row_id long, e array<double>, y int")
    from pyspark.ml.functions import array_to_vector

    plain = lambda tr, ev, p, year: [f.withColumn("features", array_to_vector("e")) for f in (tr, *ev)]
    (got,) = model.fit_predict(plain, df, [df], {"C": 0.5}, 2000)
    w, one = np.zeros(4), np.c_[x, np.ones(80)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-one @ w))
        grad = one.T @ (p - y) + np.r_[w[:3] / 0.5, 0]
        w -= np.linalg.solve(one.T @ (one * (p * (1 - p))[:, None]) + np.diag([2, 2, 2, 0]), grad)
    assert [r.p for r in got.orderBy("row_id").collect()] == pytest.approx(1 / (1 + np.exp(-one @ w)), abs=1e-3)
    with pytest.raises(ValueError, match="both labels"):
        model.fit_predict(plain, df.where("y = 1"), [df], {"C": 1}, 2000)


def test_standardise_uses_population_scale(spark):
    train = spark.createDataFrame([(0, [1.0, 7.0]), (1, [3.0, 7.0])], "row_id int, e array<double>")
    test = spark.createDataFrame([(2, [5.0, 9.0])], "row_id int, e array<double>")
    _, got = dense.standardise(train, [test], "e")
    assert got.first().features.toArray() == pytest.approx([3.0, 2.0])


def test_embedding_cache(spark, tmp_path):
    calls = []

    class Fake:
        def __init__(self, model_id):
            self.model_id = model_id

        def embed(self, texts):
            return np.array([[len(t), 1.0] for t in texts], np.float16)

    cache = dense.EmbeddingCache(spark, str(tmp_path), Fake)
    panel = rows(spark, ["a", "bbb", "a"]).unionByName(rows(spark, ["cc"], date(2011, 1, 3)).withColumn("row_id", F.lit(9).cast("long")))
    got = {r.row_id: r.embedding for r in cache.embed(panel, "m/1").collect()}
    assert got == {0: [1.0, 1.0], 1: [3.0, 1.0], 2: [1.0, 1.0], 9: [2.0, 1.0]}
    assert spark.read.parquet(str(tmp_path / "m__1/year=2012")).count() == 2 and not calls
    with pytest.raises(ValueError, match="lacks"):
        cache.embed(rows(spark, ["new"]), "m/1")
    assert cache.embed(rows(spark, ["new"]), "m/1", fill=True).count() == 1
    later = rows(spark, ["a", "bbb", "new"]).unionByName(rows(spark, ["dddd"], date(2013, 1, 3)))
    assert sorted(r.embedding[0] for r in cache.embed(later, "m/1").collect()) == [1.0, 3.0, 3.0, 4.0]  # only 2013 is new
    assert spark.read.parquet(str(tmp_path / "m__1/year=2012")).count() == 3
    assert dense.vintage_for(2013).endswith("20121231")


def test_block_featurizer(spark, tmp_path):
    """A block is embedded once; rows outside it and caches that lack part of it are errors."""
    p = Protocol(test_years=(2013,), train_years=1)
    frame = rows(spark, ["up", "down it goes"]).withColumn("signal_date", F.lit("2012-05-02").cast("date"))
    panel = frame.unionByName(frame.withColumns({"headline": F.concat("headline", F.lit(" x")), "signal_date": F.lit("2013-05-02").cast("date")}))
    cache = dense.EmbeddingCache(spark, str(tmp_path), dense.HashingEmbedder, p)
    run = model.dense_featurizer(cache, panel, p)
    first, second = run(frame, [panel], {"C": 1.0}, 2013)
    assert first.count() == 2 and second.count() == 4
    with pytest.raises(ValueError, match="outside"):
        run(frame, [rows(spark, ["not of the panel"]).withColumn("signal_date", F.lit("2012-05-03").cast("date"))], {"C": 1.0}, 2013)
    more = panel.unionByName(rows(spark, ["a later row"]).withColumn("signal_date", F.lit("2012-05-03").cast("date")))
    with pytest.raises(ValueError, match="lacks"):
        model.dense_featurizer(cache, more, p)(frame, [panel], {"C": 1.0}, 2013)
    assert model.by_features(p.tfidf_grid) == [[0, 1, 2], [3, 4, 5]] and model.by_features(p.dense_grid) == [list(range(6))]


def test_best_config_of_a_table(spark):
    v = [(0, 0.1), (1, 0.3), (1, float("nan")), (2, 0.3), (0, 0.2), (3, None), (4, float("inf"))]
    df = spark.createDataFrame(v, "config int, mean_ic double")
    assert [r.best_config for r in model.best_config_of(df).collect()] == [1] and model.best_config_of(df.where("config > 2")).collect() == []


def test_mean_pool(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0]), ([[1.0, 2.0]], [0.0])], "h array<array<double>>, m array<double>")
    assert [r.v for r in df.select(dense.mean_pool(F.col("h"), F.col("m"), 2).alias("v")).collect()] == [[2.0, 3.0], [0.0, 0.0]]


def test_shuffled_labels(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") < 200).cast("int").alias("y"))
    a, b = ({r.row_id: r.y for r in sampling.shuffle_labels(f, 1).collect()} for f in (df, df.repartition(5)))
    assert a == b and sum(a.values()) == 200 and 50 < sum(a[k] for k in range(200)) < 110


def test_probe_days_and_best_config():
    got = sampling.probe_days(date(2022, 1, 1), date(2023, 12, 28), 6)
    assert got[0] == date(2022, 1, 3) and got[-1] == date(2023, 12, 28) and len(set(got)) == 6 and all(d.weekday() < 5 for d in got)
    with pytest.raises(ValueError):
        sampling.probe_days(date(2022, 1, 1), date(2022, 1, 5), 9)
    v = [{"config": c, "mean_ic": x} for c, x in ((0, 0.1), (1, 0.3), (1, float("nan")), (2, 0.3), (0, 0.2), (3, None))]
    assert model.best_config(v) == 1
    with pytest.raises(ValueError):
        model.best_config(v[2:3])


def test_lexicon(spark):
    p = rows(spark, ["Profit surges", "plunge"]).withColumns({"ticker": F.lit("A"), "ret_next_excess": F.lit(0.1), "liquidity_tercile": F.lit(1)})
    one = lambda x: x / (x * x + 15) ** 0.5
    assert model.lexicon_scores(p).first().score == pytest.approx((one(3.6) + one(-2.3)) / 2)
    cases = {
        "not good": -0.74 * 1.9, "good": 1.9, "no one here sees gains": 1.6, "never was it good": -0.74 * 1.9, "very good": 2.2, "slightly bad": -1.6,
        "not very good": -0.74 * 2.2, "surges sharply": 2.0, "quiet": 0.0, "": 0.0,
    }
    got = {r.headline: r.p for r in rows(spark, list(cases)).select("headline", text.polarity(text.tokens(F.col("headline"))).alias("p")).collect()}
    assert got == {k: pytest.approx(one(v)) for k, v in cases.items()}
    own = rows(spark, ["zig zag"]).select(text.polarity(text.tokens(F.col("headline")), {"zig": 2.0}).alias("p"))
    assert own.first().p == pytest.approx(one(2.0))
    assert Protocol().tfidf_grid[3] == {"ngram": (1, 2), "C": 0.1}
