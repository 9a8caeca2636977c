"""The volatility report against plain loops over one symbol's bars."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest

from tidewright.operators import bootstrap
from tidewright.plans import stand_ins, volatility

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


def logistic(y, x):
    """(intercept, slope, mean, scale) by Newton steps over rows in memory."""
    n, k, mean, sd = len(x), sum(y), np.mean(x), np.std(x)
    prior = (k + 0.5) / (n + 1)
    b, m = math.log(prior / (1 - prior)), 1.0
    if not sd > 1e-12:
        return b, 0.0, mean, 1.0
    if k in (0, n):
        return b, 0.0, mean, sd
    z = (np.array(x) - mean) / sd
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(b + m * z, -30, 30)))
        c = np.maximum(p * (1 - p), 1e-8)
        g, h = np.array([(p - y).sum(), ((p - y) * z).sum()]), np.array([[c.sum() + 1e-6, (c * z).sum()], [(c * z).sum(), (c * z * z).sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        b, m = np.clip(b - step[0], -20, 20), np.clip(m - step[1], -20, 20)
        if np.abs(step).max() < 1e-7:
            break
    return b, m, mean, sd


def apply(fit, x):
    b, m, mean, sd = fit
    return 1 / (1 + math.exp(-max(-30, min(30, b + m * (x - mean) / sd))))


def platt(rows):
    """Intercept and slope on logits, within bounds; rows (p, label)."""
    x, y = np.array([(math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))), label) for p, label in rows]).T
    if len(set(y)) < 2:
        return 0.0, 1.0
    at = np.array([0.0, 1.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(at[0] + at[1] * x, -20, 20)))
        w = q * (1 - q)
        at = np.clip(at + np.linalg.solve([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-6]], [(y - q).sum(), ((y - q) * x).sum()]), -20, 20)
    return max(-2, min(2, at[0])), max(0.75, min(1.25, at[1]))


def area(y, x):
    pos, neg = x[y == 1], x[y == 0]
    return ((pos[:, None] > neg[None]).sum() + (pos[:, None] == neg[None]).sum() / 2) / (len(pos) * len(neg)) if len(pos) and len(neg) else None


def sessions_of(bars):
    """Rows of (date, month, label, next return, raw, rolling, ewma, previous)."""
    out, variance = [], 0.0
    for i, (day, o, hi, lo, c) in enumerate(bars):
        if i:
            variance = (1 - 2 / 21) * variance + 2 / 21 * math.log(c / o) ** 2
        if i < 60 or i + 1 >= len(bars):
            continue
        last = bars[i - 19 : i + 1]
        usual = np.median([abs(x[4] / x[1] - 1) for x in last])
        ahead = bars[i + 1][4] / bars[i + 1][1] - 1
        moves = [math.log(bars[k][4] / bars[k - 1][4]) for k in range(i - 19, i + 1)]
        out.append((day, day.strftime("%Y-%m"), int(abs(ahead) > usual), ahead, np.mean([(x[2] - x[3]) / x[4] for x in last]), np.std(moves), math.sqrt(variance), abs(c / o - 1)))
    return out


def earned(e, r, cost):
    equity = peak = 1.0
    before, worst, net, turns = 0.0, 0.0, [], []
    for a, b in zip(e, r, strict=True):
        turns.append(abs(a - before))
        net.append(a * b - cost / 10_000 * turns[-1])
        equity *= 1 + net[-1]
        peak, before = max(peak, equity), a
        worst = min(worst, equity / peak - 1)
    sd = np.std(net, ddof=1)
    return {"average_exposure": np.mean(e), "average_daily_return": np.mean(net), "sharpe": math.sqrt(252) * np.mean(net) / sd, "cagr": equity ** (252 / len(e)) - 1 if equity > 0 else -1.0, "max_drawdown": worst, "turnover": np.mean(turns), "final_equity": equity}


def brute(bars, replicates):
    rows = sessions_of(bars)
    months = sorted({r[1] for r in rows})
    first = {m: next(i for i, r in enumerate(rows) if r[1] == m) for m in months}
    found = defaultdict(list)
    for i, (day, month, label, ahead, *scores) in enumerate(rows):
        at = months.index(month)
        if at < 6:
            continue
        since = first[months[at - 6]]
        upto = since - 1 if since > 1 else 1
        p = []
        for k, x in enumerate(scores):
            fit = logistic([r[2] for r in rows[:upto]], [r[4 + k] for r in rows[:upto]])
            p.append(apply(fit, x))
            if k == 0:
                b, m = platt([(apply(fit, r[4]), r[2]) for r in rows[since : first[month] - 1]])
                q = min(max(p[0], 1e-6), 1 - 1e-6)
                p.append(1 / (1 + math.exp(-(b + m * math.log(q / (1 - q))))))
        for s, v in enumerate(zip(p, [p[0], p[1], *scores[1:]], strict=True)):
            found[s].append((day, label, ahead, *v))
    out = {}
    for s, name in enumerate(volatility.SCORES):
        y, p, score = (np.array([r[c] for r in found[s]]) for c in (1, 3, 4))
        q, bins = np.clip(p, 1e-7, 1 - 1e-7), np.minimum((p * 10).astype(int), 9)
        ece = sum(abs(y[bins == k].mean() - p[bins == k].mean()) * (bins == k).mean() for k in set(bins))
        balanced = ((p[y == 1] >= 0.5).mean() + (p[y == 0] < 0.5).mean()) / 2
        logits = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
        values = {"auc": area(y, p), "log_loss": -np.mean(np.where(y == 1, np.log(q), np.log(1 - q))), "brier": np.mean((p - y) ** 2), "balanced_accuracy": balanced, "ece": ece, "calibration_slope": logistic(y, logits)[1]}
        out |= {("classification", name, "all", k): v for k, v in values.items()}
        years = np.array([r[0].year for r in found[s]])
        for t in set(years):
            here = years == t
            out |= {("by year", name, str(t), k): v for k, v in {"rows": here.sum(), "accuracy": ((p >= 0.5) == (y == 1))[here].mean(), "auc": area(y[here], p[here]), "log_loss": -np.mean(np.where(y == 1, np.log(q), np.log(1 - q))[here])}.items()}
        n, areas = len(y), []
        for r in range(replicates):
            pick = [(int(a) + k) % n for a in bootstrap.starts(volatility.SEED + s, r, -(-n // 20), n) for k in range(20)][:n]
            a = area(y[pick], score[pick])
            areas += [a] if a is not None else []
        out["bootstrap", name, "all", "auc_lower_2_5_percentile"] = sorted(areas)[int(0.025 * (len(areas) - 1))]
    ahead, raw = np.array([r[2] for r in found[0]]), np.array([r[3] for r in found[0]])
    order, n = np.argsort(raw, kind="stable"), len(raw)
    for b in range(5):
        move = np.abs(ahead[order[b * n // 5 : (b + 1) * n // 5]])
        out |= {("risk quintiles", "raw_model", str(b), "mean_next_abs_return"): move.mean(), ("risk quintiles", "raw_model", str(b), "fraction_above_2_percent"): (move > 0.02).mean()}
    threshold = np.sort(raw)[int(0.75 * (n - 1))]
    out["protocol", "top_quartile_threshold", "all", "threshold"] = threshold
    calm = np.clip(1 - np.array([r[3] for r in found[1]]), 0.25, 1)
    follow = np.clip(0.15 / (np.maximum([r[4] for r in found[3]], 1e-6) * math.sqrt(252)), 0.25, 1)
    ways = {"model": calm, "exposure_matched_buy_and_hold": np.full(n, calm.mean()), "ewma_risk_target": follow, "top_quartile_50_percent_overlay": np.where(raw >= threshold, 0.5, 1.0)}
    for name, e in ways.items():
        for cost in (0, 5, 10, 20):
            out |= {("strategy", name, str(cost), k): v for k, v in earned(e, ahead, cost).items()}
    return out


def test_report_equals_loops(spark):
    # real days damped, so that equity stays in range of a double
    daily = stand_ins.daily(spark, DATA).selectExpr("symbol", "date", "100 + open / 1e4 AS open", "100 + high / 1e4 AS high", "100 + low / 1e4 AS low", "100 + close / 1e4 AS close", "volume")
    found = volatility.report(volatility.predictions(volatility.samples(daily, "1-URGENT")), replicates=40).collect()
    bars = [(r.date, r.open, r.high, r.low, r.close) for r in daily.where("symbol = '1-URGENT'").orderBy("date").collect()]
    want = brute(bars, 40)
    assert len(found) == len(want)
    for r in found:
        expected = want[r.section, r.name, r.at, r.metric]
        assert r.value == (None if expected is None else pytest.approx(expected, rel=1e-6, abs=1e-7)), r
