"""Synthetic result files in the shapes of the steps, to look at the page and the report before
any step has run. Numbers come from simulated daily correlations and returns; each file says so."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

import numpy as np

from tidemark.operators.evaluate import publish_bar
from tidemark.plans.gates import GATES
from tidemark.protocol import Protocol
from tidemark.sources.results import write_json

MARK = "synthetic, not a measurement"
#: Daily mean of the simulated correlations of each run.
STRENGTH = {"chrono": 0.012, "chrono_null": 0.0, "tfidf": 0.006, "tfidf_null": 0.0, "vader": 0.002, "old_bug_vader": 0.04}


def _simulated(rng: np.random.Generator, strength: float, days: int, protocol: Protocol) -> dict:
    ic, turnover = rng.normal(strength, 0.14, days), rng.uniform(1.6, 1.9, days)
    gross = ic * 0.02 + rng.normal(0.0, 0.004, days)
    net = gross - protocol.cost * turnover / 10
    sharpe = lambda x: float(x.mean() / x.std(ddof=1) * np.sqrt(protocol.trading_days))
    return {"days": days, "mean_ic": float(ic.mean()), "ic_t": float(ic.mean() / ic.std(ddof=1) * np.sqrt(days)), "net_sharpe": sharpe(net), "gross_sharpe": sharpe(gross), "mean_turnover": float(turnover.mean())}


def write_sample_results(folder: Path, seed: int = 0, protocol: Protocol = Protocol()) -> None:
    """All result files, the same for a seed; refuses a folder that holds other results."""
    if any(MARK not in f.read_text() for f in folder.glob("*.json")):
        raise FileExistsError(f"{folder} holds results that aren't synthetic")
    rng = np.random.default_rng(seed)
    put = lambda name, payload: write_json(folder / f"{name}.json", {"_synthetic": MARK} | payload)
    overall = {}
    for name, strength in STRENGTH.items():
        overall[name] = _simulated(rng, strength, 225 * len(protocol.test_years), protocol)
        if "vader" in name:
            put(name, {"overall": overall[name] | {"hit_rate": float(0.5 + strength)}})
        else:
            put(name, {"overall": overall[name], "by_year": [{"test_year": y} | _simulated(rng, strength, 225, protocol) for y in protocol.test_years]})
    held = _simulated(rng, STRENGTH["chrono"], 480, protocol)
    put("holdout", {"model": "chrono", "params": protocol.dense_grid[2], "days": held["days"], "mean_ic": held["mean_ic"]})
    lag = float(rng.normal(0.001, 0.0005))
    first = overall["chrono"]
    study = []
    for q in range(1, 6):
        daily = [0.0 if k < 0 else (q - 3) * 6e-4 * 0.25**k for k in protocol.offsets]
        study += [{"q": q, "offset": k, "mean_r": m, "cum_r": c} for k, m, c in zip(protocol.offsets, daily, np.cumsum(daily).tolist(), strict=True)]
    terciles = [{"tercile": t} | _simulated(rng, 0.006 * t, 225 * len(protocol.test_years), protocol) for t in (1, 2, 3)]
    bar = publish_bar(first["ic_t"], first["net_sharpe"], first["mean_ic"], lag, held["mean_ic"])
    put("summary", {"primary": "chrono", "bar": bar, "mean_lag_ic": lag, "deflated_sharpe": float(rng.uniform(0.6, 0.95)), "terciles": terciles, "event_study": study})
    at = datetime(2024, 1, 1, tzinfo=UTC).isoformat()
    put("gates", {g: {"pass": True, "recorded_at": at} for g in GATES})
    put("deviations", {"deviations": []})
