"""The twelve steps on a small world whose headlines tell the next day's sign."""

import json
import zipfile
from dataclasses import replace
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from tidemark.cli import main, parser
from tidemark.plans.gates import Gates, Refused, embed_projection, years_needed
from tidemark.plans.page import Results, build_page
from tidemark.plans.report import build_report, event_study_svg
from tidemark.plans.research import Research
from tidemark.protocol import Protocol
from tidemark.sources.datasets import headline_file
from tidemark.sources.results import read_json, write_json

P = replace(
    Protocol(), calendar_min_tickers=5, volume_window=3, test_years=(2013,), tfidf_grid=({"ngram": (1, 1), "C": 1.0},), min_names=5, min_df=2, holdout_train_years=(2012, 2012),
    holdout_start=date(2013, 7, 1), holdout_end=date(2013, 12, 20), min_holdout_days=10, max_embed_hours=0.0, train_years=2,
)
TICKERS = [f"T{k}" for k in range(8)]


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    days = [d for k in range(0, 1096) if (d := date(2011, 1, 3) + timedelta(days=k)).weekday() == 0]  # Mondays are the sessions
    rng = np.random.default_rng(0)
    up = rng.random((len(TICKERS), len(days))) < 0.5
    lines, feed = ["idx,title,date,stock"], []
    with zipfile.ZipFile(root / "p.zip", "w") as z:
        for i, t in enumerate(TICKERS):
            price, rows = 50.0, []
            for k, d in enumerate(days):
                rows.append(f"{d},{1000 + i},1,1,1,{price:.6f},{price:.6f}")
                word, offset = "surge" if up[i, k] else "plunge", f"{datetime(d.year, d.month, d.day, 10, tzinfo=ZoneInfo(P.zone)):%:z}"
                lines.append(f"{k},{t} {word} today,{d} 10:00:00{offset},{t}")
                if d >= P.holdout_start:
                    feed.append({"title": f"{t} {word} today", "time_published": f"{d:%Y%m%d}T100000", "ticker_sentiment": [{"ticker": t, "relevance_score": "0.9"}]})
                price *= 1.02 if up[i, k] else 0.98
            z.writestr(f"full/{t}.csv", "date,volume,open,high,low,close,adj close\n" + "\n".join(rows))
    (root / "n.csv").write_text("\n".join(lines) + "\n")
    return root, feed


@pytest.fixture
def quick(spark):
    """Many small plans: less time goes into running them than into compiling them."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_steps(spark, world, quick):
    root, feed = world

    def fetch(p):
        return {"feed": [x for x in feed if p["time_from"] <= x["time_published"][:13] < p["time_to"]]}

    r = Research(spark, root, P, fetch=fetch)
    with pytest.raises(Refused, match="not recorded"):
        r.run("tfidf")
    assert r.gate_g1(str(root / "n.csv"), "CC0", True)["pass"]
    r.prices(str(root / "p.zip"))
    r.panel(str(root / "n.csv"))
    assert not r.gate_g4()["pass"]
    g2 = r.gate_g2(4, 25)
    assert g2["years_with_headlines"] == [2013] and g2["pass"]
    assert r.collect_feed() > 170 and r.collect_feed() == 0
    assert r.holdout_panel()["pass"]
    assert r.run("tfidf")["mean_ic"] > 0.5
    with pytest.raises(Refused, match="frozen"):
        r.holdout_panel()
    with pytest.raises(Refused, match="null"):
        r.holdout()
    assert abs(r.run("tfidf", null=True)["mean_ic"]) < 1
    r.lexicon()
    assert read_json(root / "results/vader.json")["overall"]["hit_rate"] > 0.6
    write_json(root / "results/tfidf_null.json", {"overall": {"ic_t": 3.0}})
    with pytest.raises(Refused, match="leaks"):
        r.holdout()
    write_json(root / "results/tfidf_null.json", {"overall": {"ic_t": 0.5, "days": 1}})
    with pytest.raises(Refused, match="holdout"):
        r.summarize()
    assert r.holdout()["mean_ic"] > 0.5
    r.summarize()
    text = r.report().read_text()
    assert "| tfidf |" in text and "## Limitations" in text and (root / "results/event_study.svg").exists()
    assert "NaN" not in (root / "results/summary.json").read_text()


def test_gate_order(tmp_path):
    g = Gates(tmp_path)
    for name in ("G1", "G2ab", "G2c"):
        g.record(name, {"pass": True})
    with pytest.raises(Refused, match="G4"):
        g.primary()
    g.record("G4", {"pass": True})
    assert g.primary() == "chrono"
    g.record("G1", {"pass": False})
    with pytest.raises(Refused, match="failed"):
        g.primary()
    write_json(tmp_path / "chrono_null.json", {"overall": {"ic_t": None}})
    with pytest.raises(Refused, match="leaks"):
        g.require_clean_null("chrono")
    with pytest.raises(Refused, match="frozen"):
        g.record("G4", {"pass": True})


def test_projection():
    p = Protocol()
    assert len(years_needed(p)) == 9 and years_needed(p)[2013] == list(range(2009, 2014))
    counts = dict.fromkeys(range(2009, 2021), 10_000)
    good = embed_projection(counts, counts, 100.0, 100.0, 64.0)
    assert good["pass"] and good["headlines_to_embed"] == 44 * 10_000 and good["largest_block_rows"] == 50_000
    assert not embed_projection(counts, counts, 1.0, 100.0, 64.0)["pass"]
    assert not embed_projection(counts, counts, 100.0, 6.0, 64.0)["pass"]
    assert not embed_projection(counts, counts, 100.0, 100.0, 1.0)["pass"]


def test_commands():
    assert parser().parse_args(["run", "--model", "tfidf", "--null"]).null
    assert parser().parse_args(["vader"]).command == "vader"


def test_svg_and_json(tmp_path):
    assert event_study_svg([{"q": 1, "offset": k, "cum_r": k / 100} for k in (-1, 0, 1)]).count("polyline") == 1
    write_json(tmp_path / "x.json", {"a": float("nan"), "t": datetime(2020, 1, 1)})
    assert json.loads((tmp_path / "x.json").read_text())["a"] is None and read_json(tmp_path / "no.json") == {}


def test_page(tmp_path):
    """Panels name the missing step; synthetic results fill them all and are marked; a broken file is a missing one."""
    main(["--root", str(tmp_path), "page"])
    page = tmp_path / "results/index.html"
    text = page.read_text()
    assert text.count("Not run yet") == 6 and "run --model chrono" in text and "Synthetic" not in text
    main(["--root", str(tmp_path), "sample-results"])
    main(["--root", str(tmp_path), "page"])
    text = page.read_text()
    assert "Not run yet" not in text and "Synthetic numbers" in text and text.count("<svg") == 1 and text.count("<section>") == 7
    files = {f.name: f.read_text() for f in (tmp_path / "results").glob("*.json")}
    assert len(files) == 10 and all("synthetic, not a measurement" in t for t in files.values())
    main(["--root", str(tmp_path), "sample-results"])
    assert files == {f.name: f.read_text() for f in (tmp_path / "results").glob("*.json")}
    build_report(tmp_path / "results", tmp_path / "REPORT.md")
    assert "| chrono |" in (tmp_path / "REPORT.md").read_text()
    (tmp_path / "results/summary.json").write_text('{"bar": {')
    write_json(tmp_path / "results/gates.json", {"G4": {"pass": False}})
    write_json(tmp_path / "results/deviations.json", {"deviations": ["<b>"]})
    build_page(tmp_path / "results", page)
    assert Results(tmp_path / "results").primary == "tfidf" and "&lt;b&gt;" in page.read_text() and page.read_text().count("Not run yet") == 3
    with pytest.raises(FileExistsError):
        main(["--root", str(tmp_path), "sample-results"])


def test_headline_file():
    assert headline_file("hdfs://x/n.csv") == "hdfs://x/n.csv"
    assert headline_file(None, P, lambda name: f"/cache/{name.split('/')[-1]}") == f"/cache/{P.dataset.split('/')[-1]}/{P.dataset_file}"
    assert parser().parse_args(["panel"]).file is None
