"""Models, names, overrides and the remaining roll-ups (ML13-ML35, PRJ16-PRJ37, FN04-FN33, JN, AGG, DIM, RAD, CLI)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from severa.functions import names
from severa.grouping import fold_groups
from severa.operators import linkage, models, timeline
from severa.operators import events as ev
from severa.operators.filters import active, counted
from severa.operators.graph import connected_components
from severa.operators.ranking import equal_bins
from severa.plans.adapter import COMPANIES, NC, N, companies, notices, table, with_
from severa.plans.events import _DUR, event_dataset
from severa.plans.registry import oracle_of, query
from severa.plans.reports import sector_scores
from severa.staging import stage

AS_OF = datetime.date(2001, 7, 12)
COUNTED = "NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN'"


@query("prj16_quarters", f"{N} SELECT year(notice_date) || '-Q' || quarter(notice_date) AS period, count(*) AS n FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY 1")
def quarters(spark, sf):
    rows = counted(notices(spark, sf)).where("notice_date is not null")
    return rows.groupBy(timeline.period_of(F.date_format("notice_date", "yyyy-MM"), "quarter").alias("period")).agg(F.count("*").alias("n"))


@query("prj17_month_spine", f"{N} SELECT unnest(generate_series(date_trunc('month', min(notice_date))::TIMESTAMP, date_trunc('month', max(notice_date))::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM notices WHERE {COUNTED}")
def month_spine(spark, sf):
    return timeline.month_spine(counted(notices(spark, sf)))


@query("prj21_search_names", "SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN 'UPDATED' ELSE c_name END AS name, CASE c_custkey % 4 WHEN 1 THEN 'Shop ' || c_custkey || 'x' END AS trade FROM customer WHERE c_custkey % 4 <> 2")
def search_names(spark, sf):
    k = F.col("c_custkey")
    short = F.regexp_replace("c_name", "#", "Q")
    raw = F.when(k % 4 == 0, F.concat(F.lit("**RESCINDED** "), short, F.lit(" (Remote) Distribution Center"))).when(k % 4 == 1, F.concat(short, F.lit(", dba Shop "), k.cast("string"), F.lit("x"))).otherwise(F.concat(short, F.lit(" 12 Main St, Town OH 43004")))
    rows = table(spark, sf, "customer").where("c_custkey % 4 <> 2").select("c_custkey", names.search_name(raw).alias("n"), names.trade_name(raw).alias("trade"))
    return rows.select("c_custkey", F.regexp_replace("n", "Q", "#").alias("name"), "trade")


@query("prj30_city_from_tail", "WITH p AS (SELECT s_suppkey, string_split(s_name, '#')[1] AS w, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, n_name AS city FROM p")
def city_from_tail(spark, sf):
    """The longest run of up to four last words that names a known place of the state."""
    t = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    words = F.split(F.concat(F.lit("12 Main St "), F.col("n_name")), " ")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size(words))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.size(words) - k + 1, k), " ").alias("tail")))
    places = F.broadcast(table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("place")))
    rows = t.select("s_suppkey", "s_nationkey", F.explode(tails).alias("t"))
    return rows.join(places, F.expr("s_nationkey = n_nationkey and t.tail = place")).groupBy("s_suppkey").agg(F.max_by("place", "t.k").alias("city"))


@query("prj34_staffing_cascade", "WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size || '' END AS four, CASE WHEN p_size % 2 = 0 THEN p_type END AS three, p_brand FROM part), f AS (SELECT p_size || '' AS k, min(p_brand) AS v FROM part WHERE p_size % 6 = 0 GROUP BY 1), t AS (SELECT p_type AS k, min(p_brand) AS v FROM part WHERE p_type <> 'PROMO' GROUP BY 1) SELECT p_partkey, coalesce(f.v, t.v, p_brand) AS pattern, CASE WHEN f.v IS NOT NULL THEN 4 WHEN t.v IS NOT NULL THEN 3 ELSE 2 END AS digits FROM p LEFT JOIN f ON f.k = four LEFT JOIN t ON t.k = three")
def staffing_cascade(spark, sf):
    p = table(spark, sf, "part")
    f = F.broadcast(p.where("p_size % 6 = 0").groupBy(F.col("p_size").cast("string").alias("four")).agg(F.min("p_brand").alias("f")))
    t = F.broadcast(p.where("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("three")).agg(F.min("p_brand").alias("t")))
    rows = p.select("p_partkey", "p_brand", F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).alias("four"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("three"))
    rows = rows.join(f, "four", "left").join(t, "three", "left")
    return rows.select("p_partkey", F.coalesce("f", "t", "p_brand").alias("pattern"), F.when(F.col("f").isNotNull(), 4).when(F.col("t").isNotNull(), 3).otherwise(2).alias("digits"))


@query("jn14_latest_models", "SELECT event_type AS model, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS run_id, max(ts) AS created FROM events GROUP BY 1")
def latest_models(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("run_id"), F.max("ts").alias("created"))


@query("jn28_location_promotion", "WITH l AS (SELECT s_suppkey AS id, s_nationkey AS st, s_suppkey % 10 AS city, CASE WHEN s_suppkey % 4 <> 0 THEN '1' || s_suppkey % 3 END AS zip FROM supplier), w AS (SELECT DISTINCT c_nationkey AS st, c_custkey % 10 AS city, '1' || c_custkey % 3 AS zip FROM customer), x AS (SELECT st, city, zip, min(id) AS id FROM l WHERE zip IS NOT NULL GROUP BY ALL), e AS (SELECT st, city, min(id) AS id FROM l WHERE zip IS NULL GROUP BY ALL HAVING count(*) = 1), f AS (SELECT st, city, min(zip) AS zip FROM w LEFT JOIN x USING (st, city, zip) WHERE x.id IS NULL GROUP BY ALL) SELECT w.st, w.city, w.zip, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN e.id IS NOT NULL AND f.zip = w.zip THEN 'promoted' ELSE 'new' END AS how, coalesce(x.id, CASE WHEN f.zip = w.zip THEN e.id END) AS id FROM w LEFT JOIN x USING (st, city, zip) LEFT JOIN e ON e.st = w.st AND e.city = w.city LEFT JOIN f ON f.st = w.st AND f.city = w.city")
def location_promotion(spark, sf):
    """Wanted (state, city, zip): the exact row; else the city's one row without a ZIP, which the smallest new ZIP takes;
    else a new row."""
    k = F.col("s_suppkey")
    known = table(spark, sf, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("st"), (k % 10).alias("city"), F.when(k % 4 != 0, F.concat(F.lit("1"), (k % 3).cast("string"))).alias("zip"))
    want = table(spark, sf, "customer").select(F.col("c_nationkey").alias("st"), (F.col("c_custkey") % 10).alias("city"), F.concat(F.lit("1"), (F.col("c_custkey") % 3).cast("string")).alias("zip")).distinct()
    exact = known.where("zip is not null").groupBy("st", "city", "zip").agg(F.min("id").alias("exact"))
    bare = known.where("zip is null").groupBy("st", "city").agg(F.min("id").alias("bare"), F.count("*").alias("n")).where("n = 1").drop("n")
    met = want.join(exact, ["st", "city", "zip"], "left")
    first = met.where("exact is null").groupBy("st", "city").agg(F.min("zip").alias("first"))
    rows = met.join(bare, ["st", "city"], "left").join(first, ["st", "city"], "left")
    takes = F.col("exact").isNull() & F.col("bare").isNotNull() & (F.col("first") == F.col("zip"))
    return rows.select("st", "city", "zip", F.when(F.col("exact").isNotNull(), "exact").when(takes, "promoted").otherwise("new").alias("how"), F.coalesce("exact", F.when(takes, F.col("bare"))).alias("id"))


@query("jn30_series_upsert", "WITH u AS (SELECT user_id AS series, CAST(ts AS DATE) AS period, value, event_id FROM events) SELECT series, period, arg_max(value, event_id) AS value FROM u GROUP BY ALL")
def series_upsert(spark, sf):
    """The last value of each series and period wins."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("series"), F.col("ts").cast("date").alias("period")).agg(F.max_by("value", "event_id").alias("value"))


@query("jn38_suggestion_sides", f"{NC} SELECT coalesce(c.canonical_company_id, c.company_id) AS root, count(DISTINCT c.company_id) AS members, count(n.notice_id) AS notices, coalesce(string_agg(DISTINCT n.state, ',' ORDER BY n.state), '') AS states FROM companies c LEFT JOIN notices n ON n.company_id = c.company_id AND NOT is_superseded GROUP BY 1")
def suggestion_sides(spark, sf):
    c = companies(spark, sf).select("company_id", F.coalesce("canonical_company_id", "company_id").alias("root"))
    rows = c.join(active(notices(spark, sf)).select("company_id", "notice_id", "state"), "company_id", "left")
    return rows.groupBy("root").agg(F.count_distinct("company_id").alias("members"), F.count("notice_id").alias("notices"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"))


@query("agg40_sector_months", f"{NC} SELECT left(c.naics_code, 2) AS sector2, strftime(notice_date, '%Y-%m') AS month, count(*) AS every_notice, count(*) FILTER (closure_category IS DISTINCT FROM 'Non-WARN') AS counted FROM notices n JOIN companies c USING (company_id) WHERE NOT is_superseded AND notice_date IS NOT NULL AND c.naics_code IS NOT NULL GROUP BY ALL")
def sector_months(spark, sf):
    """Both series: the scorecards' monthly one keeps Non-WARN notices, their totals don't."""
    c = companies(spark, sf).where("naics_code is not null").select("company_id", F.substring("naics_code", 1, 2).alias("sector2"))
    rows = active(notices(spark, sf)).where("notice_date is not null").join(c, "company_id")
    return rows.groupBy("sector2", F.date_format("notice_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("every_notice"), F.count_if(~F.col("closure_category").eqNullSafe("Non-WARN")).alias("counted"))


@query("agg42_ranked_scorecards", oracle_of("agg41_sector_scores"))
def ranked_scorecards(spark, sf):
    """Worst first, then by sector."""
    return sector_scores(spark, sf).orderBy("rank")


@query("fn04_name_ratio")
def name_ratio(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.round(names.ratio_udf("c_name", F.concat("c_mktsegment", F.expr("right(c_name, 6)"))), 6).alias("ratio"))


@query("fn11_poisson", "WITH k AS (SELECT DISTINCT CAST(l_quantity AS INT) AS k FROM lineitem) SELECT k, round(list_sum(list_transform(range(0, k + 1), lambda i: exp(-20.0::DOUBLE + i * ln(20.0::DOUBLE) - lgamma(i + 1.0::DOUBLE)))), 9) AS cdf FROM k")
def poisson_cdf(spark, sf):
    k = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("k")).distinct()
    terms = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.struct(F.exp(F.lit(-20.0)).alias("t"), F.exp(F.lit(-20.0)).alias("s")), lambda a, i: F.struct((a["t"] * 20.0 / i).alias("t"), (a["s"] + a["t"] * 20.0 / i).alias("s")), lambda a: a["s"])
    return k.select("k", F.round(terms, 9).alias("cdf"))


@query("fn15_metrics_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2 AS half FROM events WHERE event_type = 'purchase'")
def metrics_json(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'purchase'")
    return rows.select("event_id", (F.get_json_object("props", "$.k").cast("double") / 2).alias("half"))


@query("fn23_stitched", f"{N}, h AS (SELECT strftime(notice_date, '%Y-%m') AS month, count(*) AS n FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY 1), f AS (SELECT strftime(DATE '2001-08-01' + to_months(CAST(r AS INT)), '%Y-%m') AS month, 100 + r AS p FROM range(6) t(r)) SELECT month, n AS actual, NULL::BIGINT AS projected FROM h UNION ALL SELECT month, NULL, p FROM f")
def stitched(spark, sf):
    h = timeline.over_time(counted(notices(spark, sf))).select(F.col("period").alias("month"), F.col("notice_count").alias("actual"))
    f = spark.range(6).select(F.date_format(F.add_months(F.lit(datetime.date(2001, 8, 1)), F.col("id").cast("int")), "yyyy-MM").alias("month"), (F.col("id") + 100).alias("projected"))
    return h.unionByName(f, allowMissingColumns=True)


@query("fn29_claims")
def claims(spark, sf):
    """What may be said of each state; null where nothing is."""
    from severa.plans.outlook import state_trends

    return state_trends(spark, sf).select("state", "claim", "q")


def _override(rows: dict[str, list]) -> list[tuple[int, int]]:
    """One component's automatic links and its decisions, newest first -> node, target."""
    each = list(zip(rows["seq"], rows["a"], rows["b"], rows["separate"], strict=True))
    links = {a: b for seq, a, b, _ in each if seq < 0}
    fixed: set[int] = set()

    def under(x: int, top: int) -> bool:
        seen = set()
        while x in links and x not in seen:
            seen.add(x)
            x = links[x]
            if x == top:
                return True
        return False

    for _, a, b, keep in sorted((r for r in each if r[0] >= 0), key=lambda r: -r[0]):
        if a in fixed or (not keep and a == b):
            continue
        if keep:
            links.pop(a, None)
        else:
            if under(b, a):
                if b in fixed:
                    continue
                links.pop(b, None)
            links[a] = b
        fixed.add(a)
    return sorted(links.items())


@query("fn33_overrides")
def overrides(spark, sf):
    """Decisions over automatic merges: order matters only inside a component, so each is folded by itself."""
    c = companies(spark, sf)
    auto = c.where("canonical_company_id is not null").select(F.col("company_id").alias("a"), F.col("canonical_company_id").alias("b"), F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("separate"))
    k = F.col("company_id")
    made = c.where("company_id % 10 = 4").select(k.alias("a"), F.when(k % 20 == 4, k + 1).otherwise(k).alias("b"), k.alias("seq"), (k % 20 != 4).alias("separate"))
    rows = auto.union(made)
    roots = connected_components(rows).withColumnRenamed("node", "a")
    grouped = rows.join(roots, "a", "left").withColumn("root", F.coalesce("root", "a"))
    return fold_groups(grouped, "root", _override, "node long, target long", ["node", "target"])


def _labelled(spark, sf):
    return event_dataset(spark, sf).where("labelled").withColumn("year", F.year(F.date_add(F.lit(ev.EPOCH), F.col("day"))))


@query("ml13_model_scores")
def model_scores(spark, sf):
    """Both models learnt before 1999 and measured on 1999."""
    rows = stage(_labelled(spark, sf), "labelled")
    train, test = rows.where("year < 1999"), rows.where("year = 1999")
    out = None
    for kind in ("logreg", "gbm"):
        scored = models.predict(models.fit(train, kind), test)
        each = ev.average_precision(scored, "score", "label").withColumn("model", F.lit(kind))
        out = each if out is None else out.unionByName(each)
    return out


@query("ml15_calibrated")
def calibrated(spark, sf):
    """Learnt before 1998, calibrated on 1998, measured in ten bins on 1999."""
    rows = stage(_labelled(spark, sf), "labelled")
    model = models.fit(rows.where("year < 1998"))
    scored = models.calibrate(models.predict(model, rows.where("year = 1998")), models.predict(model, rows.where("year = 1999")))
    bins = equal_bins(scored.select("score", "label", "company", "day"), [F.col("score"), F.col("company"), F.col("day")], 10)
    return bins.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("predicted"), F.avg("label").alias("observed"))


@query("ml17_bootstrap")
def bootstrap(spark, sf):
    return models.clustered_bootstrap(_labelled(spark, sf).select("company", F.col("label").cast("double").alias("label")), "company", "label")


@query("ml22_brier", f"{_DUR}, xx AS (SELECT CAST(t AS DOUBLE) AS t, o, 0.3::DOUBLE AS risk FROM d), c AS (SELECT t, count(*) AS n, count(*) FILTER (NOT o) AS c FROM xx GROUP BY 1), s AS (SELECT t, 1 - c / sum(n) OVER (ORDER BY t DESC) AS f FROM c), g AS (SELECT t, greatest(0.05, coalesce(list_reduce(list_prepend(1.0::DOUBLE, list(f) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), lambda a, b: a * b), 1)) AS g FROM s), u AS (SELECT greatest(0.05, list_reduce(list_prepend(1.0::DOUBLE, list(f ORDER BY t)), lambda a, b: a * b)) AS gt FROM s WHERE t < 180) SELECT round(avg(CASE WHEN o AND xx.t <= 180 THEN pow(1 - risk, 2) / g WHEN xx.t >= 180 THEN pow(risk, 2) / gt ELSE 0 END), 8) AS brier FROM xx JOIN g ON g.t = xx.t, u")
def brier(spark, sf):
    last = (AS_OF - ev.EPOCH).days
    rows = event_dataset(spark, sf).select(F.coalesce("next_gap_days", F.lit(last) - F.col("day")).cast("double").alias("time"), F.col("next_gap_days").isNotNull().alias("observed"), F.lit(0.3).alias("risk"))
    return models.brier_ipcw(rows, 180).select(F.round("brier", 8).alias("brier"))


@query("ml25_blocking_union", f"{with_(COMPANIES)}, k AS (SELECT company_id, 'u' || unique_id AS key FROM companies WHERE unique_id IS NOT NULL UNION SELECT company_id, 'w' || website FROM companies WHERE website IS NOT NULL) SELECT DISTINCT a.company_id AS a, b.company_id AS b FROM k a JOIN k b ON b.key = a.key AND a.company_id < b.company_id")
def blocking_union(spark, sf):
    c = companies(spark, sf)
    keys = c.select("company_id", F.concat(F.lit("u"), "unique_id").alias("key")).union(c.select("company_id", F.concat(F.lit("w"), "website")))
    return linkage.key_pairs(keys, "company_id", "key", once=True).select("a", "b")


@query("ml25_blocking_families")
def blocking_families(spark, sf):
    """The three families over all companies: trigram neighbours, first word in a state, rare words."""
    states = notices(spark, sf).where("company_id is not null").groupBy("company_id").agg(F.collect_set("state").alias("states"))
    rows = companies(spark, sf).join(states, "company_id", "left")
    return linkage.candidate_pairs(rows.select(F.col("company_id").alias("node"), "name", F.coalesce("states", F.array().cast("array<string>")).alias("states")))


@query("ml31_suggestion_write", f"{with_(COMPANIES)}, old AS (SELECT company_id AS id, CASE WHEN company_id % 3 = 0 THEN 'accepted' ELSE 'open' END AS status, 0.5::DOUBLE AS score FROM companies WHERE company_id % 4 < 2), new AS (SELECT company_id AS id, 0.9::DOUBLE AS score FROM companies WHERE company_id % 4 IN (1, 2)) SELECT id, coalesce(CASE WHEN old.status <> 'open' THEN old.status END, 'open') AS status, CASE WHEN old.status <> 'open' THEN old.score ELSE new.score END AS score FROM old FULL JOIN new USING (id) WHERE old.status <> 'open' OR new.id IS NOT NULL")
def suggestion_write(spark, sf):
    """Decided suggestions stay as they are, open ones are replaced by the new set."""
    c = companies(spark, sf).select(F.col("company_id").alias("id"))
    old = c.where("id % 4 < 2").select("id", F.when(F.col("id") % 3 == 0, "accepted").otherwise("open").alias("was"), F.lit(0.5).alias("old"))
    new = c.where("id % 4 in (1, 2)").select("id", F.lit(0.9).alias("new"))
    rows = old.join(new, "id", "full_outer")
    decided = F.coalesce(F.col("was") != "open", F.lit(False))
    return rows.where(decided | F.col("new").isNotNull()).select("id", F.when(decided, F.col("was")).otherwise("open").alias("status"), F.when(decided, F.col("old")).otherwise(F.col("new")).alias("score"))


@query("ml35_scored_once", "WITH e AS (SELECT user_id AS company, CAST(ts AS DATE) AS t0 FROM events GROUP BY ALL), done AS (SELECT company, t0 FROM e WHERE (company + day(t0)) % 3 = 0) SELECT company, t0 FROM e WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.company = e.company AND d.t0 = e.t0)")
def scored_once(spark, sf):
    """Open events without a score of this version."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("company"), F.col("ts").cast("date").alias("t0")).distinct()
    return e.join(e.where("(company + day(t0)) % 3 = 0"), ["company", "t0"], "left_anti")


@query("dim06_place_names", "SELECT DISTINCT regexp_replace(c_mktsegment || CASE c_nationkey % 4 WHEN 0 THEN ' city' WHEN 1 THEN ' town' WHEN 2 THEN ' CDP' ELSE '' END, ' (city|town|village|CDP|borough)$', '') AS place FROM customer")
def place_names(spark, sf):
    k = F.col("c_nationkey") % 4
    raw = F.concat("c_mktsegment", F.when(k == 0, " city").when(k == 1, " town").when(k == 2, " CDP").otherwise(""))
    return table(spark, sf, "customer").select(F.regexp_replace(raw, " (city|town|village|CDP|borough)$", "").alias("place")).distinct()


@query("dim08_crosswalk", "WITH s AS (SELECT DISTINCT p_size * 100 AS sic FROM part) SELECT sic, CASE WHEN sic % 300 = 0 THEN 'X' || sic WHEN sic < 1000 THEN '11' WHEN sic < 1500 THEN '21' WHEN sic < 1800 THEN '23' WHEN sic < 4000 THEN '31' ELSE '48' END AS naics FROM s")
def crosswalk(spark, sf):
    """The exact code where the table has one, else the sector of the range that the code lies in."""
    sic = table(spark, sf, "part").select((F.col("p_size") * 100).alias("sic")).distinct()
    exact = sic.where("sic % 300 = 0").select("sic", F.concat(F.lit("X"), F.col("sic").cast("string")).alias("exact"))
    sector = F.when(F.col("sic") < 1000, "11").when(F.col("sic") < 1500, "21").when(F.col("sic") < 1800, "23").when(F.col("sic") < 4000, "31").otherwise("48")
    return sic.join(exact, "sic", "left").select("sic", F.coalesce("exact", sector).alias("naics"))


@query("rad02_mix_reason", f"{N} SELECT notice_id, CASE WHEN naics_code IS NULL THEN 'no_naics' WHEN left(naics_code, 2) = '99' THEN 'no_pattern' ELSE 'ok' END AS reason FROM notices WHERE NOT is_superseded")
def mix_reason(spark, sf):
    code = F.col("naics_code")
    return active(notices(spark, sf)).select("notice_id", F.when(code.isNull(), "no_naics").when(F.substring(code, 1, 2) == "99", "no_pattern").otherwise("ok").alias("reason"))


@query("cli05_delta_cells", f"{N}, w AS (SELECT employer, count(*) FILTER (year(notice_date) = 2000) AS cur, count(*) FILTER (year(notice_date) = 1999) AS prior FROM notices WHERE {COUNTED} GROUP BY 1) SELECT employer, CASE WHEN prior = 0 AND cur > 0 THEN 'new' WHEN prior = 0 THEN '-' ELSE CAST(CAST(round_even((cur - prior) / prior * 100, 0) AS INT) AS VARCHAR) || '%' END AS cell FROM w")
def delta_cells(spark, sf):
    y = F.year("notice_date")
    w = counted(notices(spark, sf)).groupBy("employer").agg(F.count_if(y == 2000).alias("cur"), F.count_if(y == 1999).alias("prior"))
    pct = F.concat(F.bround((F.col("cur") - F.col("prior")) / F.col("prior") * 100, 0).cast("int").cast("string"), F.lit("%"))
    return w.select("employer", F.when((F.col("prior") == 0) & (F.col("cur") > 0), "new").when(F.col("prior") == 0, "-").otherwise(pct).alias("cell"))


@query("str02_weekly_due", "WITH s AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) SELECT user_id, seen FROM s WHERE seen <= TIMESTAMP '2024-02-05' - INTERVAL 7 DAY OR user_id % 2 = 0")
def weekly_due(spark, sf):
    """Daily subscriptions are always due, weekly ones after seven days."""
    s = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return s.where((F.col("seen") <= F.lit("2024-01-29").cast("timestamp_ntz")) | (F.col("user_id") % 2 == 0))
