"""A static page of the result files: panels that say which step is missing where there is no file."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

from tidemark.plans.gates import GATES
from tidemark.plans.report import RUN, event_study_svg, shown
from tidemark.sources.results import plain, read_json

STYLE = "body{font-family:sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{border-bottom:1px solid #ccc;padding:.3em .8em;text-align:right}td:first-child,th:first-child{text-align:left}.absent{color:#777}.synthetic{background:#fde68a;padding:.5em}"
#: What each condition of the bar asks, by its fixed name.
ASKED = {
    "1_ic_t_ge_2": "t of the daily rank correlations at least 2",
    "2_net_sharpe_ge_0_5": "net Sharpe ratio at least 0.5",
    "3_lag_ic_le_half": "mean correlation a session later at most half of it",
    "4_holdout_ic_gt_0": "mean correlation on the holdout above 0",
}
NUMBERS = ("days", "mean_ic", "ic_t", "net_sharpe")


class Absent(Exception):
    """A panel's numbers aren't there; carries the command that makes them."""


class Results:
    """Result files by name. One that is missing or half written is empty."""

    def __init__(self, folder: Path):
        self.folder = folder

    def __getitem__(self, name: str) -> dict:
        try:
            found = plain(read_json(self.folder / f"{name}.json"))
        except (json.JSONDecodeError, UnicodeDecodeError):
            return {}
        return found if isinstance(found, dict) else {}

    @property
    def primary(self) -> str:
        """The summary's primary model, or before there is one what gate G4 says."""
        return self["summary"].get("primary") or ("tfidf" if self["gates"].get("G4", {}).get("pass") is False else "chrono")


def grid(columns: dict[str, str], records: list[dict]) -> str:
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    return "\n".join(["<table>", line("th", columns.values()), *(line("td", (shown(r.get(k)) for k in columns)) for r in records), "</table>"])


def _told(holds: object) -> str:
    return "not recorded" if holds is None else "yes" if holds else "no"


def _bar(r: Results) -> str:
    bar = r["summary"].get("bar") or {}
    if not bar.get("conditions"):
        raise Absent("summarize")
    records = [{"asked": ASKED.get(k, k), "value": c.get("value"), "holds": _told(c.get("pass"))} for k, c in bar["conditions"].items()]
    verdict = "All conditions hold." if bar.get("publish") else "Not all conditions hold."
    return f"<p><b>{verdict}</b></p>" + grid({"asked": "Condition", "value": "Value", "holds": "Holds"}, records)


def _study(r: Results) -> str:
    rows = r["summary"].get("event_study")
    if not rows:
        raise Absent("summarize")
    places: dict[int, dict] = {}
    for row in rows:
        places.setdefault(row["offset"], {"offset": row["offset"]})[str(row["q"])] = round(row["cum_r"] * 1e4, 1)
    columns = {"offset": "Session"} | {q: f"Quintile {q}, bps" for q in sorted({str(row["q"]) for row in rows})}
    return event_study_svg(rows) + grid(columns, [places[k] for k in sorted(places)])


def _models(r: Results) -> str:
    names = dict.fromkeys((r.primary, f"{r.primary}_null", "tfidf", "tfidf_null", "vader", "old_bug_vader"))
    records = [{"run": n} | overall for n in names if (overall := r[n].get("overall"))]
    if not records:
        raise Absent(f"run --model {r.primary}")
    return grid({k: RUN[k] for k in ("run", *NUMBERS, "hit_rate")}, records)


def _years(r: Results) -> str:
    years = r[r.primary].get("by_year")
    if not years:
        raise Absent(f"run --model {r.primary}")
    return grid({"test_year": "Test year"} | {k: RUN[k] for k in NUMBERS}, years)


def _robustness(r: Results) -> str:
    s, held = r["summary"], r["holdout"]
    if not s:
        raise Absent("summarize")
    checks = {"Mean correlation a session later": s.get("mean_lag_ic"), "Deflated Sharpe ratio": s.get("deflated_sharpe"), "Mean correlation on the holdout": held.get("mean_ic"), "Days of the holdout": held.get("days")}
    out = grid({"check": "Check", "value": "Value"}, [{"check": k, "value": v} for k, v in checks.items()])
    return out + (grid({"tercile": "Liquidity tercile"} | {k: RUN[k] for k in NUMBERS}, s["terciles"]) if s.get("terciles") else "")


def _gates(r: Results) -> str:
    gates = r["gates"]
    if not any(g in gates for g in GATES):
        raise Absent("gate-g1")
    records = [{"gate": g, "holds": _told(gates.get(g, {}).get("pass")), "at": gates.get(g, {}).get("recorded_at")} for g in sorted(GATES)]
    return grid({"gate": "Gate", "holds": "Passed", "at": "Recorded"}, records)


def _changes(r: Results) -> str:
    changes = [c if isinstance(c, str) else json.dumps(c) for c in r["deviations"].get("deviations", [])]
    return "<ul>" + "".join(f"<li>{escape(c)}</li>" for c in changes) + "</ul>" if changes else "<p>None.</p>"


PANELS = {
    "Publish bar": _bar,
    "Around the signal date": _study,
    "Models": _models,
    "By test year": _years,
    "Robustness": _robustness,
    "Gates": _gates,
    "Changes to the protocol": _changes,
}


def build_page(results: Path, out: Path) -> None:
    """Every panel from the files in ``results``; files marked as synthetic are said to be so."""
    r = Results(results)
    body = []
    for title, panel in PANELS.items():
        try:
            inner = panel(r)
        except Absent as step:
            inner = f'<p class="absent">Not run yet: <code>python -m tidemark.cli {escape(str(step))}</code></p>'
        body.append(f"<section><h2>{title}</h2>{inner}</section>")
    synthetic = any("_synthetic" in r[f.stem] for f in results.glob("*.json"))
    banner = ['<p class="synthetic">Synthetic numbers, not measurements.</p>'] if synthetic else []
    head = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Headline signals</title><style>{STYLE}</style></head><body>'
    out.write_text("\n".join([head, "<h1>Headline signals</h1>", f"<p>Primary model: <code>{escape(r.primary)}</code></p>", *banner, *body, "</body></html>"]) + "\n")
