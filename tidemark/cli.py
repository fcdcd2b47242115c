"""python -m tidemark.cli COMMAND: the twelve steps, in order."""

from __future__ import annotations

import argparse
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    top.add_argument("--root", type=Path, default=Path("."), help="folder of data/ and results/")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, text, *aliases: sub.add_parser(name, help=text, aliases=aliases)
    c = add("gate-g1", "1. licence, offsets and midnight share of the headlines")
    c.add_argument("--file", help="headline CSV; without it the protocol's dataset is fetched")
    c.add_argument("--licence", required=True)
    c.add_argument("--licence-ok", action="store_true")
    add("prices", "2. price files to calendar and returns").add_argument("--zip", required=True)
    add("panel", "3. next-day and same-day panels").add_argument("--file", help="as for gate-g1")
    add("gate-g4", "4. speed, disk and memory of the embeddings")
    c = add("gate-g2", "5. probe of the holdout feed")
    c.add_argument("--days", type=int, default=6)
    c.add_argument("--daily-limit", type=int, required=True)
    add("collect-feed", "6. collect the holdout feed; goes on where it stopped", "collect-av").add_argument("--pause", type=float, default=0.0)
    add("holdout-panel", "7. holdout panel")
    c = add("run", "8. walk-forward run of a model")
    c.add_argument("--model", choices=["chrono", "tfidf"], required=True)
    c.add_argument("--null", action="store_true")
    add("lexicon", "9. unfitted lexicon, also with the same-day join", "vader")
    add("holdout", "10. the primary model on the holdout")
    add("summarize", "11. publish bar and robustness")
    add("report", "12. REPORT.md")
    add("page", "results/index.html from whatever results there are")
    add("sample-results", "synthetic results in results/, to look at the page").add_argument("--seed", type=int, default=0)
    return top


def _without_spark(args: argparse.Namespace) -> None:
    from tidemark.plans.page import build_page
    from tidemark.plans.sample_results import write_sample_results

    results = args.root / "results"
    results.mkdir(parents=True, exist_ok=True)
    if args.command == "sample-results":
        write_sample_results(results, args.seed)
    else:
        build_page(results, results / "index.html")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command in ("page", "sample-results"):  # these need no Spark
        return _without_spark(args)
    from pyspark.sql import SparkSession

    from tidemark.plans.research import Research
    from tidemark.sources.datasets import headline_file

    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    r = Research(spark, args.root)
    steps = {
        "gate-g1": lambda: r.gate_g1(headline_file(args.file, r.protocol), args.licence, args.licence_ok),
        "prices": lambda: r.prices(args.zip),
        "panel": lambda: r.panel(headline_file(args.file, r.protocol)),
        "gate-g4": r.gate_g4,
        "gate-g2": lambda: r.gate_g2(args.days, args.daily_limit),
        "collect-feed": lambda: r.collect_feed(args.pause),
        "holdout-panel": r.holdout_panel,
        "run": lambda: r.run(args.model, args.null),
        "lexicon": r.lexicon,
        "holdout": r.holdout,
        "summarize": r.summarize,
        "report": r.report,
    }
    steps[{"collect-av": "collect-feed", "vader": "lexicon"}.get(args.command, args.command)]()


if __name__ == "__main__":
    main()
