"""Hazard models and their scores against plain versions over expanded rows."""

import random

import numpy as np
import pytest

from severa.operators import hazard

EDGES = (30, 60, 120, 200)
SCHEMA = "day int, followup_days int, next_gap_days int, a double, b double, still double, place string"


def _events(n=400, seed=3):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        a, place = rnd.gauss(5, 3), rnd.choice(["x", "y", "z", None])
        gap = 31 + int(rnd.expovariate(1 / (40 if a > 5 else 160))) if rnd.random() < 0.8 else None
        rows.append((rnd.randint(0, 600), 200 if rnd.random() < 0.6 else rnd.randint(0, 200), gap, a if rnd.random() < 0.9 else None, float("nan") if i % 50 == 0 else rnd.random() * 1000, 7.0, place))
    return rows


def _expanded(rows, cutoff):
    out = []
    for day, follow, gap, a, b, still, place in rows:
        follow = min(follow, cutoff - day)
        for k, (low, high) in enumerate(zip(EDGES, EDGES[1:], strict=False)):
            if day < cutoff and follow >= high and (gap is None or gap > low):
                out.append((k, [0.0 if v is None or v != v else v for v in (a, b, still)], place, int(gap is not None and gap <= high)))
    return out


def _plain_fit(rows, cutoff, levels, ridge=1.0):
    rows = _expanded(rows, cutoff)
    x = np.array([r[1] for r in rows])
    mean, std = x.mean(0), x.std(0)
    x = np.where(std > 1e-9, (x - mean) / np.where(std > 1e-9, std, 1), 0)
    k = np.eye(len(EDGES) - 1)[[r[0] for r in rows]]
    place = np.array([[r[2] == v for v in levels] for r in rows], float)
    d, y = np.hstack([np.ones((len(rows), 1)), k, x, place]), np.array([r[3] for r in rows])
    penalty = np.full(d.shape[1], ridge)
    penalty[0] = 0
    beta = np.zeros(d.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-d @ beta))
        beta -= np.linalg.solve(d.T @ (d * (mu * (1 - mu))[:, None]) + np.diag(penalty), d.T @ (mu - y) + penalty * beta)
    return beta, mean, std


def test_hazards_are_those_of_a_plain_fit(spark):
    rows = _events()
    events = spark.createDataFrame(rows, SCHEMA).repartition(5)
    train = hazard.training_rows(events, {1: 350, 2: 700})
    model = hazard.fit_hazards(train, ("a", "b", "still"), "place", EDGES)
    assert model.levels == ("x", "y", "z")
    for fold, cutoff in ((1, 350), (2, 700)):
        beta, mean, std = _plain_fit(rows, cutoff, model.levels)
        assert np.abs(model.coefficients[fold] - beta).max() < 1e-6
        assert np.abs(model.means[fold] - mean).max() < 1e-9
    judged = events.selectExpr("2 as fold", "*")
    got = {(r.day, r.a, r.place): r.curve for r in hazard.risk_curves(model, judged, "place").collect()}
    for day, _, _, a, b, _, place in rows[:60]:
        x = (np.array([a or 0.0, 0.0 if b != b else b]) - mean[:2]) / std[:2]
        level = beta[7 + model.levels.index(place)] if place else 0
        h = 1 / (1 + np.exp(-(beta[0] + beta[1:4] + x @ beta[4:6] + level)))
        assert np.allclose(got[day, a, place], 1 - np.cumprod(1 - h), atol=1e-9)


def test_odd_training_rows(spark):
    events = spark.createDataFrame(_events(60), SCHEMA)
    with pytest.raises(ValueError, match="nobody at risk"):
        hazard.fit_hazards(hazard.training_rows(events.limit(0), {1: 350}), ("a",), None, EDGES)
    with pytest.raises(ValueError, match="levels"):
        hazard.fit_hazards(hazard.training_rows(events, {1: 700}), ("a",), "place", EDGES, most_levels=2)
    # Nothing ever happens: the ridge keeps the weights, and the intercept alone goes far down.
    never = hazard.training_rows(events.selectExpr("day", "200 as followup_days", "cast(null as int) as next_gap_days", "cast(null as double) as a"), {1: 2000})
    with pytest.raises(ArithmeticError):
        hazard.fit_hazards(never, ("a",), None, EDGES, most_steps=5)


def test_life_tables(spark):
    rows = _events()
    events = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "cast(day % 3 as int) as bucket")
    got = {(r.fold, r.bucket): r.curve for r in hazard.life_tables(hazard.training_rows(events, {1: 150, 2: 700}), "bucket", EDGES).collect()}
    for fold, cutoff in ((1, 150), (2, 700)):
        whole = _expanded(rows, cutoff)
        for bucket in range(3):
            own, left, want = _expanded([r for r in rows if r[0] % 3 == bucket], cutoff), 1.0, []
            for k in range(3):
                y = [r[3] for r in own if r[0] == k] or [r[3] for r in whole if r[0] == k] or [0]
                left *= 1 - sum(y) / len(y)
                want.append(1 - left)
            assert np.allclose(got[fold, bucket], want)


def test_brier_curves(spark):
    rows = [(k, r[1], r[2], [0.1 + 0.2 * k, 0.3, 0.5]) for k in (0, 1) for r in _events(seed=9 + k)]
    judged = hazard.durations(spark.createDataFrame(rows, "fold int, followup_days int, next_gap_days int, curve array<double>"))
    scores = hazard.brier_curves(judged, ["fold"], EDGES)
    got = {(r.fold, r.tau): r.brier for r in scores.collect()}
    for fold in (0, 1):
        own = [(g, True) if g is not None and g <= f else (f, False) for k, f, g, _ in rows if k == fold]
        curve = [0.1 + 0.2 * fold, 0.3, 0.5]

        def chance(before, own=own):
            g = 1.0
            for t in sorted({t for t, _ in own if t < before}):
                g *= 1 - sum(u == t and not o for u, o in own) / sum(u >= t for u, _ in own)
            return max(0.05, g)

        want = []
        for tau, risk in zip(EDGES[1:], curve, strict=True):
            loss = [(1 - risk) ** 2 / chance(t) if o and t <= tau else risk**2 / chance(tau) if t >= tau else 0.0 for t, o in own]
            want.append(sum(loss) / len(loss))
            assert abs(got[fold, tau] - want[-1]) < 1e-9
        area = sum((b - a) * (u + v) / 2 for a, b, u, v in zip(EDGES[1:], EDGES[2:], want, want[1:], strict=False)) / (EDGES[-1] - EDGES[1])
        found = hazard.integrated_brier(scores, ["fold"]).where(f"fold = {fold}").first()
        assert abs(found.integrated_brier - area) < 1e-9 and abs(found.brier - want[-1]) < 1e-9
