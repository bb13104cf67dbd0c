"""Discrete-time hazard of the next event: life tables and logistic regression over intervals at risk, fitted for every
fold at once, and censoring-aware scores of the risk curves that they give."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.staging import stage

#: Ends of the intervals in days from an event's start; the first interval begins at the first of them, and no repeat is
#: nearer than that.
EDGES = (30, 60, 90, 120, 150, 180, 210, 240, 270, 300, 330, 365)


def training_rows(events: DataFrame, cutoffs: dict[int, int]) -> DataFrame:
    """events (day, followup_days, next_gap_days, any others) -> a row for each fold and event that starts before the
    fold's cutoff day, with followup: the days that are known by then. Outcomes after the cutoff stay unseen, as an
    interval counts only where followup covers it whole."""
    folds = F.explode(F.map_from_arrays(F.array(*map(F.lit, cutoffs)), F.array(*map(F.lit, cutoffs.values()))))
    rows = events.select("*", folds.alias("fold", "cutoff")).where("day < cutoff")
    return rows.withColumn("followup", F.least("followup_days", F.col("cutoff") - F.col("day"))).drop("cutoff")


def _at_risk(low: int, high: int) -> Column:
    gap = F.col("next_gap_days")
    return (F.col("followup") >= high) & (gap.isNull() | (gap > low))


def life_tables(rows: DataFrame, bucket: str, edges: tuple[int, ...] = EDGES) -> DataFrame:
    """training rows with a small whole-number bucket -> fold, bucket, curve: the chance of a repeat by the end of each
    interval. A cell in which nobody was at risk takes its interval's hazard over all buckets, or else 0."""
    spans = list(pairwise(edges))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _at_risk(*s).alias("in"), F.coalesce(F.col("next_gap_days") <= s[1], F.lit(False)).alias("hit")) for k, s in enumerate(spans)]))
    counts = rows.select("fold", bucket, cells.alias("c")).groupBy("fold", bucket, "c.k").agg(F.count_if("c.in").alias("n"), F.count_if(F.col("c.in") & F.col("c.hit")).alias("hits"))
    pooled = counts.groupBy("fold", "k").agg(F.coalesce(F.sum("hits") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("pooled"))
    hazards = counts.join(pooled, ["fold", "k"]).groupBy("fold", bucket).agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce(F.col("hits") / F.nullif("n", F.lit(0)), F.col("pooled")).alias("h")))).alias("hs"))
    return hazards.select("fold", bucket, _cumulative(F.transform("hs", lambda x: x["h"])).alias("curve"))


def _cumulative(hazards: Column) -> Column:
    """One minus the running product of what the hazards leave."""
    left = F.aggregate(hazards, F.array(F.lit(1.0)), lambda a, h: F.array_append(a, F.element_at(a, -1) * (1 - h)))
    return F.transform(F.slice(left, 2, F.size(hazards)), lambda x: 1 - x)


@dataclass(frozen=True)
class Hazards:
    """Coefficients by fold: the intercept, one for each interval, one for each standardised feature, one for each level."""

    features: tuple[str, ...]
    levels: tuple[str, ...]
    edges: tuple[int, ...]
    means: dict[int, np.ndarray]
    scales: dict[int, np.ndarray]
    coefficients: dict[int, np.ndarray]


def _design(batch: pa.RecordBatch, features: tuple[str, ...], level: str | None, levels: tuple[str, ...], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
    x = (x - mean) / scale
    if level is None:
        return x
    names = batch.column(level).to_numpy(zero_copy_only=False)
    return np.hstack([x, names[:, None] == np.array(levels, dtype=object)[None, :]])


def _sums(x: np.ndarray, followup: np.ndarray, gap: np.ndarray, edges: tuple[int, ...], beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian over intervals at risk, flat. The rows of an event differ by their interval only, so no
    row for each interval is made: features meet the weights summed over an event's intervals."""
    low, high = np.array(edges[:-1]), np.array(edges[1:])
    k, p = len(low), x.shape[1]
    gap = np.where(np.isnan(gap), np.inf, gap)[:, None]
    risk = (followup[:, None] >= high) & (gap > low)
    y = risk & (gap <= high)
    eta = beta[0] + beta[1 : 1 + k] + (x @ beta[1 + k :])[:, None]
    mu = 1 / (1 + np.exp(-eta))
    loss = np.where(risk, np.logaddexp(0, eta) - y * eta, 0).sum()
    r, w = np.where(risk, mu - y, 0), np.where(risk, mu * (1 - mu), 0)
    gradient = np.concatenate([[r.sum()], r.sum(0), x.T @ r.sum(1)])
    hessian = np.zeros((1 + k + p, 1 + k + p))
    hessian[0, 0], hessian[0, 1 : 1 + k], hessian[0, 1 + k :] = w.sum(), w.sum(0), x.T @ w.sum(1)
    hessian[1 : 1 + k, 1 : 1 + k] = np.diag(w.sum(0))
    hessian[1 : 1 + k, 1 + k :] = w.T @ x
    hessian[1 + k :, 1 + k :] = x.T @ (x * w.sum(1)[:, None])
    upper = np.triu(hessian)
    return np.concatenate([[loss], gradient, (upper + np.triu(upper, 1).T).ravel()])


def fit_hazards(rows: DataFrame, features: tuple[str, ...], level: str | None = None, edges: tuple[int, ...] = EDGES, ridge: float = 1.0, tolerance: float = 1e-9, most_steps: int = 60, most_levels: int = 1000) -> Hazards:
    """Logistic regression of the repeat in each interval at risk, for every fold of training rows at once.

    Reweighted least squares: tasks add up the normal equations of their rows, one aggregation adds those of the tasks, and
    the driver solves one small system a fold, so a step is one job whatever the folds. Features are standardised over
    intervals at risk; null counts as 0, a feature that doesn't vary has no weight. All coefficients but the intercept
    carry the ridge, which also settles intervals and levels without an event. A level that is null or was not met in
    training adds nothing. A step that raises the penalised loss is halved. No convergence within `most_steps`, more levels
    than `most_levels`, or a fold in which nobody is at risk is an error."""
    spans = list(pairwise(edges))
    at_risk = sum((_at_risk(*s).cast("int") for s in spans[1:]), _at_risk(*spans[0]).cast("int"))
    numbers = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features]
    kept = [F.col("fold").cast("int"), F.col("followup").cast("double"), F.col("next_gap_days").cast("double").alias("gap"), *numbers]
    kept += [F.col(level).cast("string").alias(level)] if level else []
    risked = stage(rows.withColumn("_m", at_risk).where("_m > 0").select("_m", *kept), "hazard")
    m = F.col("_m")
    moments = risked.groupBy("fold").agg(F.sum("_m").alias("n"), *[F.sum(m * F.col(f)) / F.sum(m) for f in features]).collect()
    means = {r[0]: np.array(r[2:], float) for r in moments}
    wanted = {r[0] for r in rows.select(F.col("fold").cast("int")).distinct().collect()}
    if wanted - set(means) or not means:
        raise ValueError(f"nobody at risk in folds {sorted(wanted - set(means))}")
    centre = F.broadcast(rows.sparkSession.createDataFrame([(f, v.tolist()) for f, v in means.items()], "fold int, _c array<double>"))
    spread = risked.join(centre, "fold").groupBy("fold").agg(*[F.sqrt(F.sum(m * F.pow(F.col(f) - F.col("_c")[i], 2)) / F.sum(m)) for i, f in enumerate(features)]).collect()
    scales = {r[0]: np.where(np.array(r[1:], float) > 1e-9 * (1 + np.abs(means[r[0]])), np.array(r[1:], float), np.inf) for r in spread}
    found = [] if level is None else [r[0] for r in risked.where(F.col(level).isNotNull()).select(level).distinct().limit(most_levels + 1).collect()]
    if len(found) > most_levels:
        raise ValueError(f"{level} has more than {most_levels} levels")
    levels = tuple(sorted(found))
    size = 1 + len(spans) + len(features) + len(levels)
    penalty = np.full(size, ridge)
    penalty[0] = 0.0

    def normal_equations(beta: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                folds = batch.column("fold").to_numpy(zero_copy_only=False)
                for f in np.unique(folds).tolist():
                    if f not in beta:  # settled
                        continue
                    own = batch.filter(pa.array(folds == f))
                    x = _design(own, features, level, levels, means[f], scales[f])
                    gap = own.column("gap").to_numpy(zero_copy_only=False).astype(float)
                    part = _sums(x, own.column("followup").to_numpy(zero_copy_only=False), gap, edges, beta[f])
                    sums[f] = sums[f] + part if f in sums else part
            yield pa.RecordBatch.from_pydict({"fold": pa.array(list(sums), pa.int32()), "part": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})

        parts = risked.mapInArrow(of_task, "fold int, part array<double>").select("fold", F.posexplode("part").alias("i", "v"))
        out = {f: np.zeros(1 + size + size * size) for f in beta}
        for r in parts.groupBy("fold", "i").agg(F.sum("v").alias("v")).collect():  # a fold's numbers are few and bounded
            out[r["fold"]][r["i"]] = r["v"]
        return out

    best = {f: (np.inf, np.zeros(size)) for f in means}
    trial = {f: np.zeros(size) for f in means}
    for _ in range(most_steps):
        for f, s in normal_equations(trial).items():
            b = trial[f]
            loss = s[0] + (penalty * b * b).sum() / 2
            if loss > best[f][0] + 1e-9 * (1 + abs(best[f][0])):
                trial[f] = (b + best[f][1]) / 2
                continue
            best[f] = (loss, b)
            step = np.linalg.solve(s[1 + size :].reshape(size, size) + np.diag(penalty), s[1 : 1 + size] + penalty * b)
            if np.abs(step).max() < tolerance:
                del trial[f]
            else:
                trial[f] = b - step
        if not trial:
            return Hazards(features, levels, edges, means, scales, {f: b for f, (_, b) in best.items()})
    raise ArithmeticError(f"folds {sorted(trial)} did not settle in {most_steps} steps")


def risk_curves(model: Hazards, events: DataFrame, level: str | None = None) -> DataFrame:
    """events with fold -> with curve, the chance of a repeat by the end of each interval. An event of a fold without a
    model is left out."""
    k, p = len(model.edges) - 1, len(model.features)
    rows = []
    for f, b in model.coefficients.items():
        weights = b[1 + k : 1 + k + p] / model.scales[f]
        base = b[0] + b[1 : 1 + k] - (weights * model.means[f]).sum()
        rows.append((f, base.tolist(), weights.tolist(), dict(zip(model.levels, b[1 + k + p :].tolist(), strict=True))))
    table = F.broadcast(events.sparkSession.createDataFrame(rows, "fold int, _base array<double>, _weights array<double>, _levels map<string,double>"))  # a row a fold
    x = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.col("_weights")[i] for i, f in enumerate(model.features)]
    score = sum(x[1:], x[0])
    if level is not None:
        score = score + F.coalesce(F.col("_levels")[F.col(level).cast("string")], F.lit(0.0))
    hazards = F.transform("_base", lambda b: 1 / (1 + F.exp(-(b + F.col("_score")))))
    return events.join(table, "fold").withColumn("_score", score).withColumn("curve", _cumulative(hazards)).drop("_base", "_weights", "_levels", "_score")


def durations(events: DataFrame) -> DataFrame:
    """Adds time and observed: the days to the next event where follow-up saw it, else the follow-up."""
    seen = F.coalesce(F.col("next_gap_days") <= F.col("followup_days"), F.lit(False))
    return events.withColumns({"time": F.when(seen, F.col("next_gap_days")).otherwise(F.col("followup_days")), "observed": seen})


def brier_curves(rows: DataFrame, keys: list[str], edges: tuple[int, ...] = EDGES, floor: float = 0.05) -> DataFrame:
    """rows (keys, time, observed, curve) -> keys, tau, brier: Graf's score at the end of every interval, rows weighted by
    the inverse chance of not being censored before, each key's own. Times are whole days up to the horizon, so the table
    of chances has at most a row for each key and day; a horizon takes the last day before it."""
    by_time = rows.groupBy(*keys, "time").agg(F.count("*").alias("n"), F.count_if(~F.col("observed")).alias("c"))
    by = Window.partitionBy(*keys)
    stay = by_time.withColumn("f", 1.0 - F.col("c") / F.sum("n").over(by.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)))
    factors = F.collect_list("f").over(by.orderBy("time").rowsBetween(Window.unboundedPreceding, -1))
    through = lambda a: F.aggregate(a, F.lit(1.0), lambda x, y: x * y)
    chances = stay.withColumn("before", through(factors)).withColumn("after", F.col("before") * F.col("f"))
    g = chances.select(*keys, "time", F.greatest(F.lit(floor), "before").alias("g"))
    at = lambda tau: F.greatest(F.lit(floor), F.coalesce(F.max_by("after", F.when(F.col("time") < tau, F.col("time"))), F.lit(1.0)))
    g_taus = chances.groupBy(*keys).agg(F.array(*[at(t) for t in edges[1:]]).alias("g_taus"))
    weighed = rows.join(F.broadcast(g), [*keys, "time"]).join(F.broadcast(g_taus), keys)
    cells = weighed.select(*keys, "time", "observed", "g", F.posexplode(F.arrays_zip(F.array(*map(F.lit, edges[1:])).alias("tau"), F.col("curve"), F.col("g_taus"))).alias("k", "z"))
    died, tau, risk = F.col("observed") & (F.col("time") <= F.col("z.tau")), F.col("z.tau"), F.col("z.curve")
    loss = F.when(died, F.pow(1 - risk, 2) / F.col("g")).when(F.col("time") >= tau, F.pow(risk, 2) / F.col("z.g_taus")).otherwise(0.0)
    return cells.groupBy(*keys, tau.alias("tau")).agg(F.avg(loss).alias("brier"))


def integrated_brier(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tau, brier) -> keys, integrated_brier (trapezoids over the horizons, by their span) and brier at the last."""
    up = Window.partitionBy(*keys).orderBy("tau")
    area = (F.lead("tau").over(up) - F.col("tau")) * (F.lead("brier").over(up) + F.col("brier")) / 2
    return scores.withColumn("area", area).groupBy(*keys).agg((F.sum("area") / (F.max("tau") - F.min("tau"))).alias("integrated_brier"), F.max_by("brier", "tau").alias("brier"))
