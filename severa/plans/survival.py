"""Hazards of repeat filings, learnt for every year on what was known by its first day and judged on it (ML21-ML23)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from severa.operators import events as ev, hazard
from severa.operators.models import FEATURES
from severa.plans.events import _EV, AS_OF, event_dataset
from severa.plans.registry import query
from severa.staging import stage

YEARS = range(1996, 2001)


def first_day(year: int) -> int:
    return (datetime.date(year, 1, 1) - ev.EPOCH).days


def _events(spark, sf):
    """Events with the number of earlier ones in levels; they are read by several jobs."""
    return stage(event_dataset(spark, sf).withColumn("bucket", F.least("prior_events", F.lit(3)).cast("int")), "events")


def _judged(events):
    """The events of every fold's own year, with what follow-up saw of them."""
    year = F.year(F.date_add(F.lit(ev.EPOCH), F.col("day")))
    return hazard.durations(events.withColumn("fold", year.cast("int")).where(F.col("fold").between(YEARS[0], YEARS[-1])))


@query("ml21_hazard_risks")
def hazard_risks(spark, sf):
    """The chance that each company files again, by horizon from its last event, by a model of all that is known today."""
    events = _events(spark, sf)
    model = hazard.fit_hazards(hazard.training_rows(events, {0: (AS_OF - ev.EPOCH).days}), FEATURES, "state")
    last = events.where("next_gap_days is null").withColumn("fold", F.lit(0))
    curve = hazard.risk_curves(model, last, "state")
    return curve.select("company", "day", *[F.round(F.col("curve")[hazard.EDGES.index(d) - 1], 6).alias(f"risk_{d}") for d in (90, 180, 365)])


_SPANS = "iv AS (SELECT k, 30 + 30 * k AS lo, CASE WHEN k = 10 THEN 365 ELSE 60 + 30 * k END AS hi FROM (SELECT unnest(range(0, 11)) AS k))"
_LIFE = f"""{_EV}, {_SPANS}, fo AS (SELECT fold, CAST(make_date(fold, 1, 1) - DATE '1970-01-01' AS INT) AS c0, CAST(make_date(fold + 1, 1, 1) - DATE '1970-01-01' AS INT) AS c1 FROM (SELECT CAST(unnest(range(1996, 2001)) AS INT) AS fold)),
  tr AS (SELECT fold, least(prior_events, 3) AS b, least(11515 - day, 365, c0 - day) AS fu, next_gap_days AS gap FROM e JOIN fo ON day < c0),
  ce AS (SELECT fold, b, k, count(*) AS n, count(*) FILTER (gap <= hi) AS hits FROM tr, iv WHERE fu >= hi AND (gap IS NULL OR gap > lo) GROUP BY ALL),
  po AS (SELECT fold, k, sum(hits) / sum(n) AS h FROM ce GROUP BY ALL), bk AS (SELECT DISTINCT fold, b FROM tr),
  hz AS (SELECT bk.fold, bk.b, iv.k, iv.hi, coalesce(ce.hits / ce.n, po.h, 0) AS h FROM bk CROSS JOIN iv LEFT JOIN ce ON ce.fold = bk.fold AND ce.b = bk.b AND ce.k = iv.k LEFT JOIN po ON po.fold = bk.fold AND po.k = iv.k),
  cu AS (SELECT fold, b, hi AS tau, 1 - list_reduce(list_prepend(1.0::DOUBLE, list(1 - h) OVER (PARTITION BY fold, b ORDER BY k)), lambda x, y: x * y) AS risk FROM hz),
  te AS (SELECT fold, least(prior_events, 3) AS b, least(11515 - day, 365) AS fu, next_gap_days AS gap FROM e JOIN fo ON day >= c0 AND day < c1),
  du AS (SELECT fold, b, CASE WHEN gap <= fu THEN gap ELSE fu END AS t, coalesce(gap <= fu, false) AS o FROM te),
  bt AS (SELECT fold, t, count(*) AS n, count(*) FILTER (NOT o) AS c FROM du GROUP BY ALL),
  sv AS (SELECT fold, t, 1 - c / sum(n) OVER (PARTITION BY fold ORDER BY t DESC) AS f FROM bt),
  gb AS (SELECT fold, t, greatest(0.05, list_reduce(list_prepend(1.0::DOUBLE, coalesce(list(f) OVER (PARTITION BY fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])), lambda x, y: x * y)) AS g FROM sv),
  gt AS (SELECT fo.fold, iv.hi AS tau, greatest(0.05, list_reduce(list_prepend(1.0::DOUBLE, coalesce(list(f ORDER BY t) FILTER (t IS NOT NULL), [])), lambda x, y: x * y)) AS g FROM fo CROSS JOIN iv LEFT JOIN sv ON sv.fold = fo.fold AND sv.t < iv.hi GROUP BY ALL),
  br AS (SELECT du.fold, cu.tau, count(*) AS n, avg(CASE WHEN o AND du.t <= cu.tau THEN pow(1 - risk, 2) / gb.g WHEN du.t >= cu.tau THEN pow(risk, 2) / gt.g ELSE 0 END) AS brier FROM du JOIN cu ON cu.fold = du.fold AND cu.b = du.b JOIN gb ON gb.fold = du.fold AND gb.t = du.t JOIN gt ON gt.fold = du.fold AND gt.tau = cu.tau GROUP BY ALL)"""


def _life_scores(events):
    tables = hazard.life_tables(hazard.training_rows(events, {y: first_day(y) for y in YEARS}), "bucket")
    rows = _judged(events).join(F.broadcast(tables), ["fold", "bucket"])  # a row for each fold and level
    return hazard.brier_curves(rows, ["fold"])


@query("ml22_brier_by_horizon", f"{_LIFE} SELECT fold, tau, round(brier, 8) AS brier FROM br")
def brier_by_horizon(spark, sf):
    """Brier scores of the life table's risk curve at every horizon, weighted for censoring."""
    return _life_scores(_events(spark, sf)).withColumn("brier", F.round("brier", 8))


@query("ml22_integrated_brier", f"{_LIFE}, s AS (SELECT *, lead(tau) OVER w AS t2, lead(brier) OVER w AS b2 FROM br WINDOW w AS (PARTITION BY fold ORDER BY tau)) SELECT fold, round(sum((t2 - tau) * (brier + b2) / 2) / (max(tau) - min(tau)), 8) AS integrated_brier, round(max_by(brier, tau), 8) AS brier FROM s GROUP BY 1")
def integrated(spark, sf):
    """The same scores integrated over the horizons."""
    return hazard.integrated_brier(_life_scores(_events(spark, sf)), ["fold"]).withColumns({c: F.round(c, 8) for c in ("integrated_brier", "brier")})


@query("ml23_hazard_backtest")
def hazard_backtest(spark, sf):
    """Life table and logistic hazard, refitted for every year on follow-up cut at its first day, side by side."""
    events = _events(spark, sf)
    train, judged = hazard.training_rows(events, {y: first_day(y) for y in YEARS}), _judged(events)
    tables = hazard.life_tables(train, "bucket")
    curves = {
        "life_table": judged.join(F.broadcast(tables), ["fold", "bucket"]),
        "hazard_logreg": hazard.risk_curves(hazard.fit_hazards(train, FEATURES, "state"), judged, "state"),
    }
    rows = None
    for name, found in curves.items():
        own = found.select("fold", F.lit(name).alias("model"), "time", "observed", "curve")
        rows = own if rows is None else rows.unionByName(own)
    rows = stage(rows, "curves")
    scores = hazard.integrated_brier(hazard.brier_curves(rows, ["fold", "model"]), ["fold", "model"])
    sizes = rows.groupBy("fold", "model").agg(F.count("*").alias("n_test"), F.avg(F.element_at("curve", -1)).alias("mean_risk"))
    known = train.groupBy("fold").agg(F.count("*").alias("n_train"))
    return scores.join(sizes, ["fold", "model"]).join(known, "fold")
