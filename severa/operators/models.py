"""Repeat-filing models: fits, calibration, clustered bootstrap, censoring-aware scores, promotion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.operators.graph import connected_components
from severa.staging import stage

FEATURES = ("day_notices", "day_states", "day_layoffs", "prior_notices_1y", "prior_notices_3y", "prior_events", "prior_layoffs", "prior_states", "days_since_prev", "state_notices_90d", "us_notices_90d", "state_days")


def fit(train: DataFrame, kind: str = "logreg", features: tuple[str, ...] = FEATURES):
    """A pipeline fitted on labelled rows; missing values count as 0."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw")
    if kind == "gbm":
        stages = [assembler, GBTClassifier(featuresCol="raw", labelCol="label", maxIter=20, maxDepth=4, seed=7)]
    else:
        stages = [assembler, StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=50, regParam=0.01)]
    return Pipeline(stages=stages).fit(_numbers(train, features))


def _numbers(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def predict(model, rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    return model.transform(_numbers(rows, features)).withColumn("score", vector_to_array("probability")[1]).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def calibrate(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Platt's scaling learnt on `rows` (score, label) and applied to `scored`."""
    assembler = VectorAssembler(inputCols=["_logit"], outputCol="_logits")
    model = LogisticRegression(featuresCol="_logits", labelCol="label", maxIter=50).fit(assembler.transform(rows.withColumn("_logit", logit(F.col("score")))))
    a, b = float(model.coefficients[0]), float(model.intercept)
    return scored.withColumn("score", 1 / (1 + F.exp(-(F.lit(a) * logit(F.col("score")) + b))))


def poisson_weight(key: Column, replicate: Column) -> Column:
    """How often a replicate draws the key: a Poisson(1) number by a hash."""
    u = (F.pmod(F.xxhash64(key.cast("string"), replicate), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cut, total, weight = 0.36787944117144233, 0.0, F.lit(0)
    term = cut
    for k in range(1, 9):
        total += term
        weight = weight + F.when(u > total, 1).otherwise(0)
        term /= k
    return weight


def poisson_draws(hashed: np.ndarray, replicate: int) -> np.ndarray:
    """`poisson_weight` in a replicate of keys, as text, whose xxhash64 is given: the replicate goes into the hash after it."""
    a, b, c, d = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = hashed.view(np.uint64) + (d + np.uint64(4)) ^ np.array([replicate], np.uint64) * a
    h = (h << np.uint64(23) | h >> np.uint64(41)) * b + c
    h = (h ^ h >> np.uint64(33)) * b
    h = (h ^ h >> np.uint64(29)) * c
    u = (((h ^ h >> np.uint64(32)) & np.uint64((1 << 30) - 1)).astype(np.float64) + 0.5) / (1 << 30)
    terms = np.cumprod([0.36787944117144233, *(1 / k for k in range(1, 8))])
    return np.searchsorted(np.cumsum(terms), u)


def clustered_bootstrap(rows: DataFrame, key: str, value: str, replicates: int = 200) -> DataFrame:
    """Mean of value with a 95 % interval by drawing keys, not rows: every key's weight in a replicate is a Poisson(1)
    number by a hash, so no key's rows come together; sums by key are taken first."""
    sums = rows.groupBy(key).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    each = sums.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weight = poisson_weight(F.col(key), F.col("replicate"))
    means = each.groupBy("replicate").agg((F.sum(F.col("s") * weight) / F.sum(F.col("n") * weight)).alias("m"))
    point = sums.agg((F.sum("s") / F.sum("n")).alias("point"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")).join(F.broadcast(point))


def brier_ipcw(rows: DataFrame, tau: float, floor: float = 0.05) -> DataFrame:
    """Graf's Brier score at tau of rows (time, observed, risk): those followed are weighted by the chance of not being
    censored before."""
    by_time = rows.groupBy("time").agg(F.count("*").alias("n"), F.count_if(~F.col("observed")).alias("c"))
    later = Window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    stay = by_time.withColumn("risk_n", F.sum("n").over(later)).withColumn("f", 1.0 - F.col("c") / F.col("risk_n"))
    before = F.aggregate(F.collect_list("f").over(up), F.lit(1.0), lambda a, x: a * x)
    g = stay.select("time", F.greatest(F.lit(floor), before).alias("g"))
    at_tau = stay.where(F.col("time") < tau).agg(F.greatest(F.lit(floor), F.coalesce(F.product("f"), F.lit(1.0))).alias("g_tau"))
    died = F.col("observed") & (F.col("time") <= tau)
    loss = F.when(died, F.pow(1 - F.col("risk"), 2) / F.col("g")).when(F.col("time") >= tau, F.pow(F.col("risk"), 2) / F.col("g_tau")).otherwise(0.0)
    return rows.join(g, "time").join(F.broadcast(at_tau)).agg(F.avg(loss).alias("brier"))


def promotion_reasons(rows: Column, ece: Column, precision: Column, live: float | None = None, least_rows: int = 1000, most_ece: float = 0.05, least_gain: float = 0.0) -> Column:
    """Reasons not to promote a model, from its metrics; none if it may go live."""
    better = F.lit(True) if live is None else precision >= live + least_gain
    return F.array_compact(F.array(F.when(rows < least_rows, "too few rows"), F.when(ece > most_ece, "badly calibrated"), F.when(~better, "no better than the live model")))


def precision_by_slice(rows: DataFrame, slice_: str, score: str, label: str) -> DataFrame:
    """slice, n, average_precision (of distinct scores) and base rate of every slice."""
    cells = rows.groupBy(slice_, score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    whole = Window.partitionBy(slice_)
    down = whole.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    curve = cells.withColumns({"tp": F.sum("p").over(down), "k": F.sum("n").over(down), "pos": F.sum("p").over(whole)})
    return curve.groupBy(slice_).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("p") / F.col("pos") * F.col("tp") / F.col("k")), 9).alias("average_precision"), F.round(F.sum("p") / F.sum("n"), 9).alias("base"))


def rolling_backtest(rows: DataFrame, bucket: str, start: str, label: str, horizon: int, years: range) -> DataFrame:
    """fold, n, brier, base: each year's rows judged by the rates of their bucket among rows that were known by its first
    day, their horizon having passed. Counts by bucket and year of knowledge are taken once and summed over years."""
    known = F.year(F.date_add(F.col(start), horizon))
    counts = rows.groupBy(bucket, known.alias("known")).agg(F.sum(label).alias("hits"), F.count("*").alias("n"))
    folds = counts.withColumn("fold", F.explode(F.array(*map(F.lit, years)))).where(F.col("known") < F.col("fold"))
    rates = folds.groupBy("fold", bucket).agg((F.sum("hits") / F.sum("n")).alias("risk"))
    judged = rows.withColumn("fold", F.year(start)).join(F.broadcast(rates), ["fold", bucket])
    return judged.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("risk") - F.col(label), 2)), 8).alias("brier"), F.round(F.avg(label), 8).alias("base"))


def by_component(pairs: DataFrame, positive: Column, folds: int) -> DataFrame:
    """pairs (a, b, any others) -> with component and fold: nodes that positive pairs join, directly or through others, are
    one component; a pair belongs to that of its a, and a component to one fold."""
    roots = connected_components(pairs.where(positive))
    found = pairs.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("component", F.coalesce("root", "a")).drop("root")
    return found.withColumn("fold", F.pmod(F.xxhash64("component"), F.lit(folds)).cast("int"))


def cross_fitted(rows: DataFrame, features: tuple[str, ...], label: str, fold: str, folds: int, kind: str = "logreg") -> DataFrame:
    """rows with a fold below `folds` -> with raw and score. Rows whose label is null teach nothing. Each fold's model is
    fitted on the labelled rows of the others; a labelled row's raw score is that of the model that has not seen its fold,
    any other's is the mean of all. One calibrator, Platt's scaling, is fitted on the raw scores of all labelled rows, which
    are out of fold, and gives every row its score. A fold whose others hold one label only is an error. A fold column of
    text names groups, each of which is dealt whole to one fold by its hash."""
    if dict(rows.dtypes)[fold] == "string":
        dealt = rows.withColumn("_fold", F.pmod(F.xxhash64(fold), F.lit(folds)).cast("int"))
        return cross_fitted(dealt, features, label, "_fold", folds, kind).drop("_fold")
    rows = stage(rows, "cross-fit")
    known = rows.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    counts = {r[fold]: (r["n"], r["p"]) for r in known.groupBy(fold).agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}
    for f in range(folds):
        n, p = (sum(c[i] for g, c in counts.items() if g != f) for i in (0, 1))
        if not 0 < p < n:
            raise ValueError(f"the folds beside fold {f} hold one label only")
    out = rows
    for f in range(folds):
        model = fit(known.where(F.col(fold) != f), kind, features)
        own = [c for c in out.columns if c not in features]
        numbers = out.withColumns({f"_{c}": F.col(c) for c in features})  # predict overwrites them
        out = predict(model, numbers, features).select(*own, *[F.col(f"_{c}").alias(c) for c in features], F.col("score").alias(f"score_{f}"))
    each = [F.col(f"score_{f}") for f in range(folds)]
    unseen = F.element_at(F.array(*each), F.col(fold) + 1)
    raw = F.when(F.col(label).isNotNull(), unseen).otherwise(sum(each[1:], each[0]) / folds)
    out = stage(out.withColumn("raw", raw).drop(*[f"score_{f}" for f in range(folds)]), "cross-fit")
    learnt = out.where(F.col(label).isNotNull()).select(F.col("raw").alias("score"), F.col(label).cast("double").alias("label"))
    return calibrate(learnt, out.withColumn("score", F.col("raw")))


def _uno(rows: pa.Table) -> pa.Table:
    """Cells (time, risk, n, died, weight) -> concordant and all weight."""
    time, risk, n, died, weight = (rows.column(c).to_numpy() for c in ("time", "risk", "n", "died", "weight"))
    times, t = np.unique(time, return_inverse=True)
    risks, r = np.unique(risk, return_inverse=True)
    later = np.zeros((len(times) + 1, len(risks)))
    np.add.at(later, (t, r), n)
    later = np.cumsum(later[::-1], 0)[::-1]  # at t: those whose time is t or later
    below = np.cumsum(later, 1) - later
    w = died * weight
    concordant = (w * (below[t + 1, r] + later[t + 1, r] / 2)).sum()
    return pa.table({"concordant": [concordant], "pairs": [(w * later[t + 1].sum(1)).sum()]})


def uno_concordance(rows: DataFrame, tau: int, floor: float = 0.05) -> DataFrame:
    """Uno's C up to tau of rows (time, observed, risk): of pairs in which one repeats before the other's time, the share in
    which the higher risk does, ties a half, each weighted by the inverse squared chance of not being censored before.

    Rows are counted by day and risk first: a cell for each day up to tau and each level of risk is all that one task
    gets, so risk must come in levels."""
    cut = rows.select(F.least(F.col("time"), F.lit(tau)).cast("long").alias("time"), (F.col("observed") & (F.col("time") < tau)).alias("observed"), F.col("risk").cast("double").alias("risk"))
    by_time = cut.groupBy("time").agg(F.count("*").alias("n"), F.count_if(~F.col("observed")).alias("c"))
    stay = by_time.withColumn("f", 1.0 - F.col("c") / F.sum("n").over(Window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)))
    before = F.aggregate(F.collect_list("f").over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0), lambda a, x: a * x)
    g = stay.select("time", F.pow(F.greatest(F.lit(floor), before), -2).alias("weight"))
    cells = cut.groupBy("time", "risk").agg(F.count("*").alias("n"), F.count_if(F.col("observed")).alias("died")).join(g, "time")
    return cells.groupBy().applyInArrow(_uno, "concordant double, pairs double").select((F.col("concordant") / F.col("pairs")).alias("concordance"))


def tier(risk: Column, least: dict[str, float], rest: str) -> Column:
    """The first tier whose least risk is reached, else `rest`."""
    out = F.lit(rest)
    for name, bound in reversed(least.items()):
        out = F.when(risk >= bound, name).otherwise(out)
    return out


def strict_json(*fields: Column) -> Column:
    """An object of the fields in which null and what is not a finite number are null."""
    body = F.struct(*fields)
    return F.regexp_replace(F.to_json(body, {"ignoreNullFields": "false"}), r':"(?:NaN|-?Infinity)"', ":null")
