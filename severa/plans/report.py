"""The report on repeat-filing models: what each feature is worth, and which model is chosen (ML18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from severa.operators import importance, models
from severa.plans.events import event_dataset
from severa.plans.more import _labelled
from severa.plans.registry import oracle_of, query
from severa.staging import stage

RULE = ("prior_events", "prior_notices_1y", "state_days")


def _keyed(rows):
    return rows.withColumn("id", F.concat_ws(":", "company", "day"))


_DEALT = """t AS (SELECT concat_ws(':', company, day) AS id, prior_events AS a, prior_notices_1y AS b, label AS y FROM ds WHERE labelled), r AS (SELECT unnest(range(0, 5)) AS rep),
  i AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY md5('0|' || rep || '|' || id), id) AS i, row_number() OVER (PARTITION BY rep ORDER BY md5('1|' || rep || '|' || id), id) AS j FROM t, r),
  m AS (SELECT x.rep, x.y, x.a, x.b, z.a AS a2, z.b AS b2 FROM i x JOIN i z ON z.rep = x.rep AND z.j = x.i),
  v AS (SELECT 'prior_events' AS feature, rep, y, 3 * a2 + b AS s FROM m UNION ALL SELECT 'prior_notices_1y', rep, y, 3 * a + b2 FROM m UNION ALL SELECT 'state_days', rep, y, 3 * a + b FROM m UNION ALL SELECT 'none', 0, y, 3 * a + b FROM t),
  c AS (SELECT feature, rep, s, sum(y) AS p, count(*) AS n FROM v GROUP BY ALL),
  q AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY feature, rep) AS pos FROM c WINDOW w AS (PARTITION BY feature, rep ORDER BY s DESC)),
  ap AS (SELECT feature, rep, sum(p / pos * tp / k) AS ap FROM q GROUP BY ALL)"""


@query("ml18_rule_importance", f"WITH RECURSIVE ds AS ({oracle_of('ml10_event_dataset')}), {_DEALT} SELECT x.feature, round(avg(w.ap - x.ap), 8) + 0.0 AS mean, round(stddev_pop(w.ap - x.ap), 8) AS std FROM ap x, ap w WHERE w.feature = 'none' AND x.feature <> 'none' GROUP BY 1")
def rule_importance(spark, sf):
    """What two counts are worth to a rule made of them; a third, which it doesn't use, is worth nothing."""
    rows = stage(_keyed(event_dataset(spark, sf).where("labelled")).select("id", "label", *RULE), "labelled")
    rule = lambda d: d.withColumn("score", 3 * F.col("prior_events") + F.col("prior_notices_1y"))
    found = importance.permutation_importance(rows, rule, "id", RULE, "label")
    return found.select("feature", *[(F.round(c, 8) + 0.0).alias(c) for c in ("mean", "std")])


@query("ml18_importance")
def model_importance(spark, sf):
    """What each feature is worth on 1999 to the model learnt before it."""
    rows = stage(_keyed(_labelled(spark, sf)), "labelled")
    model = models.fit(rows.where("year < 1999"))
    return importance.permutation_importance(rows.where("year = 1999"), lambda d: models.predict(model, d), "id", models.FEATURES, "label")


@query("ml18_model_choice")
def model_choice(spark, sf):
    """Trees against the regression on two years' events, each scored by models learnt before its year: over both, and
    without the year that has most of them."""
    rows = stage(_keyed(_labelled(spark, sf)), "labelled")
    scored = None
    for year in (1998, 1999):
        own = rows.where(F.col("year") == year).select("id", "company", "year", "label", *models.FEATURES)
        for kind in ("logreg", "gbm"):
            found = models.predict(models.fit(rows.where(F.col("year") < year), kind), own)
            own = own.join(found.select("id", F.col("score").alias(kind)), "id")
        own = own.select("id", "company", "year", "label", "logreg", "gbm")
        scored = own if scored is None else scored.unionByName(own)
    scored = stage(scored, "scored")
    most = scored.groupBy("year").count().agg(F.max_by("year", F.struct("count", "year")).alias("most"))
    rest = scored.join(F.broadcast(most), F.col("year") != F.col("most"))
    gains = [importance.precision_gain(d, "company", "gbm", "logreg", "label").withColumn("events", F.lit(name)) for name, d in (("all", scored), ("without the largest year", rest))]
    return importance.choose(gains[0].unionByName(gains[1]), "gbm", "logreg")
