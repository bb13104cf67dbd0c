"""Record linkage over companies, names and vectors (ML24-ML34, FN03-FN17, JN36, ERS01)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from severa.functions import text
from severa.functions.likeness import name_similarity
from severa.operators import linkage as lk
from severa.operators.filters import active
from severa.plans.adapter import COMPANIES, NC, NL, N, companies, locations, notices, table, with_
from severa.plans.registry import query

_NAMES = "nm AS (SELECT p_partkey AS id, lower(p_name) AS name FROM part WHERE p_partkey % 10 = 3)"


@query("fn03_similarity", r"""WITH w AS (SELECT p_partkey, p_name, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) AS w FROM part), g AS (SELECT p_partkey, list_distinct(flatten(list(list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2])))) AS g FROM w GROUP BY 1)
  SELECT p_partkey, round(CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))) END, 8) AS similarity FROM g, (SELECT g AS q FROM g WHERE p_partkey = 1)""")
def similarity(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", text.trigrams(F.col("p_name")).alias("g"))
    asked = parts.where("p_partkey = 1").select(F.col("g").alias("q"))
    return parts.join(F.broadcast(asked)).select("p_partkey", F.round(text.similarity(F.col("g"), F.col("q")), 8).alias("similarity"))


@query("fn05_name_similarity", "SELECT c_custkey, round(jaro_winkler_similarity(lower(c_name), lower(c_mktsegment || right(c_name, 4))), 6) AS similarity FROM customer")
def name_similarities(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(name_similarity(F.lower("c_name"), F.lower(F.concat("c_mktsegment", F.expr("right(c_name, 4)")))), 6).alias("similarity"))


@query("fn06_nearest_names", r"""WITH p AS (SELECT p_partkey AS id, lower(p_name) AS name FROM part), w AS (SELECT id, unnest(list_filter(regexp_split_to_array(name, '\s+'), lambda x: x <> '')) AS w FROM p), g AS (SELECT id, unnest(list_transform(range(1, length(w) + 1), lambda i: (' ' || w || ' ')[i:i + 2])) AS term FROM w),
  tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT id, term, tf * (ln((1 + (SELECT count(DISTINCT id) FROM g)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM r),
  d AS (SELECT a.id AS node, b.id AS other, round(sum(a.w * b.w), 8) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY ALL)
  SELECT node, round(cosine, 6) AS cosine, n AS ties FROM (SELECT node, max(cosine) AS cosine, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cosine DESC, other) AS i FROM d WHERE cosine >= 0.5) WHERE i <= 10 GROUP BY 1)""")
def nearest_names(spark, sf):
    """Every fiftieth name against all: its best cosine and how many of its ten nearest pass."""
    terms = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(lk.char_grams(F.col("p_name"))).alias("term"))
    w = lk.tfidf(terms, "id")
    near = lk.cosine_neighbours(w.where("id % 50 = 0"), w, "id")
    return near.groupBy("node").agg(F.round(F.max("cosine"), 6).alias("cosine"), F.count("*").alias("ties"))


@query("fn08_distance", f"{NL} SELECT a.location_id AS a, b.location_id AS b, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat::DOUBLE - a.lat::DOUBLE) / 2), 2) + cos(radians(a.lat::DOUBLE)) * cos(radians(b.lat::DOUBLE)) * pow(sin(radians(b.lon::DOUBLE - a.lon::DOUBLE) / 2), 2)))), 6) AS km FROM locations a JOIN locations b ON a.location_id = b.location_id - 1 WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL")
def distance(spark, sf):
    p = locations(spark, sf).where("lat is not null").select("location_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    a, b = p.select(F.col("location_id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo")), p.select(F.col("location_id").alias("b"), "lat", "lon")
    return a.join(b, F.expr("a = b - 1")).select("a", "b", F.round(lk.haversine_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 6).alias("km"))


@query("fn09_date_ranges", f"{N}, r AS (SELECT employer, min(notice_date) AS a, max(notice_date) AS b FROM notices WHERE notice_date IS NOT NULL GROUP BY 1), s AS (SELECT state, min(notice_date) AS a, max(notice_date) AS b FROM notices WHERE year(notice_date) = 1998 GROUP BY 1) SELECT employer, state, greatest(0, least(r.b, s.b) - greatest(r.a, s.a) + 1) / (least(r.b - r.a, s.b - s.a) + 1) AS overlap, round(ln(1 + greatest(0, greatest(r.a, s.a) - least(r.b, s.b))), 8) AS gap_log FROM r JOIN s ON s.state = 'S' || lpad(CAST(length(employer) % 25 AS VARCHAR), 2, '0')")
def date_ranges(spark, sf):
    n = notices(spark, sf).where("notice_date is not null")
    r = n.groupBy("employer").agg(F.min("notice_date").alias("ra"), F.max("notice_date").alias("rb"))
    s = n.where("year(notice_date) = 1998").groupBy("state").agg(F.min("notice_date").alias("sa"), F.max("notice_date").alias("sb"))
    rows = r.withColumn("state", F.concat(F.lit("S"), F.lpad((F.length("employer") % 25).cast("string"), 2, "0"))).join(s, "state")
    both = F.datediff(F.least("rb", "sb"), F.greatest("ra", "sa"))
    return rows.select("employer", "state", (F.greatest(F.lit(0), both + 1) / (F.least(F.datediff("rb", "ra"), F.datediff("sb", "sa")) + 1)).alias("overlap"), F.round(F.log1p(F.greatest(F.lit(0), -both)), 8).alias("gap_log"))


@query("fn10_acronyms", r"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: w[1]), '') AS acronym, array_to_string(regexp_extract_all(p_name || ' #' || p_partkey, '\d+'), ',') AS numbers FROM part")
def acronyms(spark, sf):
    words = F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "").alias("acronym"), F.array_join(F.regexp_extract_all(F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")), F.lit(r"\d+"), F.lit(0)), ",").alias("numbers"))


@query("jn36_blocks", f"{NC}, k AS (SELECT DISTINCT company_id, state || ':' || substr(CAST(notice_date AS VARCHAR), 1, 10) AS key FROM notices WHERE company_id IS NOT NULL AND notice_date IS NOT NULL) SELECT DISTINCT a.company_id AS a, b.company_id AS b FROM k a JOIN k b ON b.key = a.key AND a.company_id < b.company_id")
def blocks(spark, sf):
    k = notices(spark, sf).where("company_id is not null and notice_date is not null").select("company_id", F.concat_ws(":", "state", F.col("notice_date").cast("string")).alias("key"))
    return lk.key_pairs(k, "company_id", "key", once=True).select("a", "b")


@query("ml24_profiles", f"{NL} SELECT company_id, count(*) AS n_notices, CAST(coalesce(sum(layoff_count), 0) AS BIGINT) AS layoffs, string_agg(DISTINCT n.state, ',' ORDER BY n.state) AS states, string_agg(DISTINCT l.city, ',' ORDER BY l.city) AS cities, count(DISTINCT zip) AS zips, min(notice_date) AS first, max(notice_date) AS last FROM notices n JOIN locations l USING (location_id) WHERE NOT is_superseded AND company_id IS NOT NULL GROUP BY 1")
def profiles(spark, sf):
    place = locations(spark, sf).select("location_id", "city", "zip")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rows = active(notices(spark, sf)).where("company_id is not null").join(place, "location_id")
    return rows.groupBy("company_id").agg(F.count("*").alias("n_notices"), F.coalesce(F.sum("layoff_count"), F.lit(0)).alias("layoffs"), joined("state").alias("states"), joined("city").alias("cities"), F.count_distinct("zip").alias("zips"), F.min("notice_date").alias("first"), F.max("notice_date").alias("last"))


def _pairs(spark, sf):
    c = companies(spark, sf).select("company_id", F.col("unique_id").alias("key"))
    return lk.key_pairs(c, "company_id", "key").select("a", "b")


# 1 for one unique id, 0 for two different ones, of the pairs that carry it.
def _label():
    return F.when(F.col("x.unique_id") == F.col("y.unique_id"), 1).when(F.col("x.unique_id").isNotNull() & F.col("y.unique_id").isNotNull(), 0)


@query("ml27_weak_labels", f"{with_(COMPANIES)} SELECT a.company_id AS a, b.company_id AS b, CASE WHEN a.unique_id = b.unique_id THEN 1 WHEN a.unique_id IS NOT NULL AND b.unique_id IS NOT NULL THEN 0 END AS label FROM companies a JOIN companies b ON a.parent_group_key = b.parent_group_key AND a.company_id < b.company_id")
def weak_labels(spark, sf):
    c = companies(spark, sf)
    return lk.key_pairs(c, "company_id", "parent_group_key", "unique_id").select("a", "b", _label().alias("label"))


@query("ml26_pair_features", f"{NC}, st AS (SELECT company_id, list_distinct(list(state)) AS states, count(*) AS n FROM notices WHERE company_id IS NOT NULL GROUP BY 1) SELECT a.company_id AS a, b.company_id AS b, round(len(list_intersect(x.states, y.states)) / (len(x.states) + len(y.states) - len(list_intersect(x.states, y.states))), 8) AS state_jaccard, round(ln(1 + least(x.n, y.n)), 8) AS least_log, CAST(coalesce(a.website = b.website, false) AS INT) AS same_site FROM companies a JOIN companies b ON a.unique_id = b.unique_id AND a.company_id < b.company_id JOIN st x ON x.company_id = a.company_id JOIN st y ON y.company_id = b.company_id")
def pair_features(spark, sf):
    c = companies(spark, sf).select("company_id", "website")
    st = notices(spark, sf).where("company_id is not null").groupBy("company_id").agg(F.collect_set("state").alias("states"), F.count("*").alias("n")).join(c, "company_id")
    side = lambda x: st.select(F.col("company_id").alias(x), F.col("states").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.col("website").alias(f"w{x}"))
    rows = _pairs(spark, sf).join(side("a"), "a").join(side("b"), "b")
    jac = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return rows.select("a", "b", F.round(jac, 8).alias("state_jaccard"), F.round(F.log1p(F.least("na", "nb")), 8).alias("least_log"), F.coalesce(F.col("wa") == F.col("wb"), F.lit(False)).cast("int").alias("same_site"))


@query("ml29_clusters")
def clusters(spark, sf):
    """Average linkage over pairs scored by their names' similarity; one unique id is a must-link, two are a cannot-link."""
    c = companies(spark, sf).select(F.col("company_id").alias("node"), "name", F.col("unique_id").alias("uid"), "parent_group_key")
    return lk.cluster_names(c, "parent_group_key", 0.97, 0.9)


@query("fn16_b_cubed", "WITH m AS (SELECT c_custkey % 211 AS pred, c_custkey % 422 AS gold FROM customer), s AS (SELECT *, count(*) OVER (PARTITION BY pred, gold) AS b, count(*) OVER (PARTITION BY pred) AS p, count(*) OVER (PARTITION BY gold) AS g FROM m), r AS (SELECT count(*) AS n, avg(b / p) AS precision, avg(b / g) AS recall FROM s) SELECT n, round(precision, 8) AS precision, round(recall, 8) AS recall, round(2 * precision * recall / (precision + recall), 8) AS f1 FROM r")
def b_cubed(spark, sf):
    out = lk.b_cubed(table(spark, sf, "customer").select((F.col("c_custkey") % 211).alias("pred"), (F.col("c_custkey") % 422).alias("gold")))
    return out.select("n", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query("fn17_pair_agreement", "WITH m AS (SELECT c_custkey % 211 AS pred, c_custkey % 422 AS gold FROM customer), two AS (SELECT count(*) * (count(*) - 1) // 2 AS k, 'b' AS w FROM m GROUP BY pred, gold UNION ALL SELECT count(*) * (count(*) - 1) // 2, 'p' FROM m GROUP BY pred UNION ALL SELECT count(*) * (count(*) - 1) // 2, 'g' FROM m GROUP BY gold) SELECT CAST(sum(k) FILTER (w = 'b') AS BIGINT) AS both, CAST(sum(k) FILTER (w = 'p') AS BIGINT) AS pred_pairs, CAST(sum(k) FILTER (w = 'g') AS BIGINT) AS gold_pairs FROM two")
def pair_agreement(spark, sf):
    return lk.pair_agreement(table(spark, sf, "customer").select((F.col("c_custkey") % 211).alias("pred"), (F.col("c_custkey") % 422).alias("gold")))


@query("ml30_merge_suggestions", f"{with_(COMPANIES)}, p AS (SELECT a.parent_group_key AS g, least(coalesce(a.canonical_company_id, a.company_id), coalesce(b.canonical_company_id, b.company_id)) AS root, greatest(coalesce(a.canonical_company_id, a.company_id), coalesce(b.canonical_company_id, b.company_id)) AS other, (a.company_id + b.company_id) % 100 / 100.0::DOUBLE AS s FROM companies a JOIN companies b ON a.parent_group_key = b.parent_group_key AND a.company_id < b.company_id) SELECT root, other, count(*) AS pairs, round(avg(s), 8) AS score FROM p WHERE root <> other GROUP BY ALL HAVING avg(s) >= 0.8")
def merge_suggestions(spark, sf):
    c = companies(spark, sf).withColumn("head", F.coalesce("canonical_company_id", "company_id"))
    pairs = lk.key_pairs(c, "company_id", "parent_group_key", "head")
    rows = pairs.select(F.least("x.head", "y.head").alias("root"), F.greatest("x.head", "y.head").alias("other"), ((F.col("a") + F.col("b")) % 100).alias("s")).where("root <> other")
    # Hundredths are added as whole numbers: a mean of just 0.8 passes, in whatever order its pairs come.
    sums = rows.groupBy("root", "other").agg(F.count("*").alias("pairs"), F.sum("s").alias("total")).where("total >= 80 * pairs")
    return sums.select("root", "other", "pairs", F.round(F.col("total") / (100 * F.col("pairs")), 8).alias("score"))


@query("ml34_remapped_keys", "WITH e AS (SELECT c_custkey AS node, c_custkey - c_custkey % 13 AS cluster FROM customer) SELECT node, 'e' || min(node) OVER (PARTITION BY cluster) AS key FROM e")
def remapped_keys(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") - F.col("c_custkey") % 13).alias("cluster"))
    return e.select("node", F.concat(F.lit("e"), F.min("node").over(Window.partitionBy("cluster")).cast("string")).alias("key"))


@query("ers01_gold_sample", "WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, CAST(floor(l_discount * 100) AS INT) // 3 AS band FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5(a || ':' || b), a, b) AS i FROM (SELECT DISTINCT * FROM p)) SELECT band, a, b FROM r WHERE i <= 40")
def gold_sample(spark, sf):
    """Forty pairs of each score band, by a hash of the pair."""
    p = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.expr("cast(floor(l_discount * 100) as int) div 3").alias("band")).distinct()
    order = Window.partitionBy("band").orderBy(F.md5(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"))), "a", "b")
    return p.withColumn("i", F.row_number().over(order)).where("i <= 40").select("band", "a", "b")


@query("knn_embeddings", "WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q, vec_id AS other, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS cosine FROM q, embeddings WHERE vec_id <> q) SELECT q, other, cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, other) AS i FROM d) WHERE i <= 10")
def knn_embeddings(spark, sf):
    """The ten nearest vectors of every fiftieth one, which is a stated query set, against all."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return lk.vector_neighbours(e, F.col("id") % 50 == 0)
