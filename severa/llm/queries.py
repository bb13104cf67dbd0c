"""The registered queries over the text operators, and the DuckDB oracles of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from severa.staging import shared_dir

from . import toxicity
from .centroid_clustering import cluster_vectors
from .decontamination import decontaminate
from .hard_negatives import mine
from .jaccard_join import jaccard_join
from .license_scan import scan_licenses
from .quality_rules import quality_rules
from .source_mix import mix_sources
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens
from .url_filters import filter_urls
from .vector_search import nearest
from .warc_revisits import header_text, resolve_revisits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 20-word window that occurs earlier, by document."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), width=20)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (c.p IS NULL) AS kept
  FROM word LEFT JOIN cov c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, similarity 0.8 or more."""
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), n=5, threshold=0.8).select("doc_id", "class_id", "n_links")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all 13-word windows of the benchmark's items."""
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), width=13)
    return out.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
met AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in a mix of sources that weigh 5, 2, 1."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc.doc_id", "size", "source_size", "target", "taken", "copies")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from the labels of four fifths of the doc_ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, weights)
    held = F.coalesce(F.crc32(F.col("doc.doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Each page as a full response, and for two thirds of them a later revisit under another form of its URL."""
    page = pages.select("page_id", "url", F.md5("html").alias("tag"), F.sha2("html", 256).alias("sha"))
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(t0) + s)
    p = F.col("page_id")
    first = (p * 7919) % 864000
    text = lambda c: c.cast("string")
    age = lambda n: F.concat(F.lit("max-age="), text(60 * (n % 4)))
    tag = F.concat(F.lit('"'), F.substring("tag", 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), text(p % 28))
    some = lambda *kv: F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv]), lambda _, v: v.isNotNull())
    full = page.select(
        (p * 2).alias("capture_id"), "url", at(first).alias("fetched"), F.lit("response").alias("kind"), F.when(p % 29 == 0, 503).otherwise(200).alias("status"),
        some("content-type", "text/html", "etag", F.when(p % 10 != 4, tag), "last-modified", modified, "server", F.concat(F.lit("s"), text(p % 3)), "cache-control", age(p), "date", text(first)).alias("headers"),
        F.col("sha").alias("digest"),
    )
    later = first + 3600 * (1 + p % 50) - 40 * 3600 * (p % 17 == 0).cast("int")
    url = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    revisit = page.where("page_id % 3 <> 0").select(
        (p * 2 + 1).alias("capture_id"), F.when(p % 2 == 0, F.regexp_replace(url, "^https?:", "http:")).otherwise(url).alias("url"), at(later).alias("fetched"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        some("etag", F.when(p % 7 == 0, F.lit('"stale"')).when(p % 5 != 0, F.concat(F.lit("W/"), tag)), "last-modified", F.when(p % 4 != 0, modified), "cache-control", age(p + 1), "date", text(later), "set-cookie", "a=1", "server", "edge").alias("headers"),
        F.when(p % 8 == 0, F.col("sha")).alias("digest"),
    )
    return full.unionByName(revisit)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures derived from the pages, with every revisit resolved."""
    out = resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    return out.select("capture.capture_id", "url_key", "verdict", "ref_id", header_text(F.col("headers")).alias("headers"), "digest")


OP4 = r"""
WITH page AS (SELECT page_id AS p, url, '"' || substr(md5(html), 1, 16) || '"' AS tag, sha256(html) AS sha, (page_id * 7919) % 864000 AS first FROM pages),
cap AS (
  SELECT p * 2 AS capture_id, url, first AS at_s, 'response' AS kind, CASE WHEN p % 29 = 0 THEN 503 ELSE 200 END AS status,
    CASE WHEN p % 10 <> 4 THEN tag END AS etag, 'day ' || (p % 28) AS modified, 'text/html' AS ctype, 's' || (p % 3) AS server,
    'max-age=' || (60 * (p % 4)) AS cache, CAST(first AS VARCHAR) AS date, NULL AS cookie, sha AS digest FROM page
  UNION ALL
  SELECT p * 2 + 1, CASE WHEN p % 2 = 0 THEN regexp_replace(u, '^https?:', 'http:') ELSE u END, later, 'revisit', 304,
    CASE WHEN p % 7 = 0 THEN '"stale"' WHEN p % 5 <> 0 THEN 'W/' || tag END, CASE WHEN p % 4 <> 0 THEN 'day ' || (p % 28) END, NULL, 'edge',
    'max-age=' || (60 * ((p + 1) % 4)), CAST(later AS VARCHAR), 'a=1', CASE WHEN p % 8 = 0 THEN sha END
  FROM (SELECT *, regexp_replace(url, '#.*$', '') || '#again' AS u,
    first + 3600 * (1 + p % 50) - 40 * 3600 * CAST(p % 17 = 0 AS INT) AS later FROM page WHERE p % 3 <> 0)),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM cap),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
  regexp_replace(regexp_replace(regexp_extract(b, '[?](.*)$', 1), '(^|&)(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS q FROM bare),
c AS (SELECT *, hp || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key,
  (CAST(at_s AS HUGEINT) + 1000000000) * 1000000000000 + capture_id AS o FROM keyed),
f AS (SELECT * FROM c WHERE kind = 'response' AND status = 200),
j AS (SELECT c.*, f.capture_id AS f_id, f.etag AS f_etag, f.modified AS f_mod, f.ctype AS f_ctype, f.server AS f_server, f.digest AS f_digest
  FROM c ASOF LEFT JOIN f ON c.url_key = f.url_key AND c.o > f.o),
v AS (SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN f_id IS NULL THEN 'no_response'
  WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = f_etag THEN 'resolved' ELSE 'mismatch' END
  WHEN modified IS NOT NULL AND f_mod IS NOT NULL THEN CASE WHEN modified = f_mod THEN 'resolved' ELSE 'mismatch' END
  WHEN digest IS NOT NULL THEN CASE WHEN digest = f_digest THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS verdict FROM j),
h AS (SELECT *, verdict = 'resolved' AS r FROM v)
SELECT capture_id, url_key, verdict, CASE WHEN r THEN f_id END AS ref_id,
  concat_ws(';', 'cache-control=' || cache, 'content-type=' || CASE WHEN r THEN f_ctype ELSE ctype END, 'date=' || date,
    'etag=' || CASE WHEN r THEN coalesce(etag, f_etag) ELSE etag END, 'last-modified=' || CASE WHEN r THEN f_mod ELSE modified END,
    'server=' || CASE WHEN r THEN f_server ELSE server END, 'set-cookie=' || CASE WHEN r THEN NULL ELSE cookie END) AS headers,
  CASE WHEN r THEN f_digest ELSE digest END AS digest
FROM h
"""


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of the pages: hosts listed and unlisted, whole domains, and directories."""
    hosts = pages.select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)).alias("host")).distinct().where("host <> ''")
    n = F.length("host")
    day = lambda d: F.timestamp_add("DAY", d, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    entry = lambda name, pattern, action, d: F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), day(d).alias("at"))
    host = F.col("host")
    domain = F.regexp_extract("host", "([^.]+[.][^.]+)$", 1)
    some = F.array(
        F.when(n % 3 == 0, entry("hosts", host, "add", n % 20)), F.when(n % 3 == 0, entry("hosts", host, "remove", n % 20 + 6)), F.when(n % 6 == 0, entry("hosts", host, "add", n % 20 + 8)),
        F.when(n % 7 == 0, entry("domains", domain, "add", n % 5 + 10)), F.when(n % 11 == 0, entry("domains", domain, "remove", n % 5 + 14)),
        F.when(n % 4 == 1, entry("paths", F.concat(host, F.lit("/en/")), "add", F.lit(3))), F.when(n % 4 == 1, entry("paths", F.concat(host, F.lit("/en/")), "remove", F.lit(25))),
    )
    return hosts.select(F.explode(F.array_compact(some)).alias("e")).select("e.*")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the list entries active when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_add("HOUR", (F.col("page_id") * 31 % 720).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    out = filter_urls(pages.withColumn("fetched", fetched), list_entries(pages))
    return out.select("capture.page_id", "n_active", F.array_join("lists", ",").alias("lists"), "blocked")


OP5 = r"""
WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages),
h AS (SELECT host, len(host) AS n, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain FROM hosts WHERE host <> ''),
e AS (SELECT 'hosts' AS list, host AS pattern, 1 AS on_, n % 20 AS d FROM h WHERE n % 3 = 0
  UNION SELECT 'hosts', host, 0, n % 20 + 6 FROM h WHERE n % 3 = 0 UNION SELECT 'hosts', host, 1, n % 20 + 8 FROM h WHERE n % 6 = 0
  UNION SELECT 'domains', domain, 1, n % 5 + 10 FROM h WHERE n % 7 = 0 UNION SELECT 'domains', domain, 0, n % 5 + 14 FROM h WHERE n % 11 = 0
  UNION SELECT 'paths', host || '/en/', 1, 3 FROM h WHERE n % 4 = 1 UNION SELECT 'paths', host || '/en/', 0, 25 FROM h WHERE n % 4 = 1),
t AS (SELECT * FROM (SELECT *, coalesce(lag(on_) OVER (PARTITION BY list, pattern ORDER BY d, on_ DESC), 0) AS was FROM e) WHERE on_ <> was),
s AS (SELECT list, pattern, on_, d AS since, lead(d) OVER (PARTITION BY list, pattern ORDER BY d, on_ DESC) AS until FROM t),
span AS (SELECT list, pattern, since * 24 AS since, until * 24 AS until FROM s WHERE on_ = 1 AND (until IS NULL OR until > since)),
p AS (SELECT page_id, page_id * 31 % 720 AS hour, lower(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')) AS b FROM pages),
q AS (SELECT *, regexp_replace(regexp_extract(b, '^([^/]*)', 1), ':[0-9]+$', '') AS host, regexp_extract(b, '^[^/]*(/.*)?$', 1) AS path FROM p),
m AS (SELECT page_id, list FROM q JOIN span ON hour >= since AND (until IS NULL OR hour < until)
  AND (host = pattern OR ends_with(host, '.' || pattern) OR (contains(pattern, '/') AND starts_with(host || path, pattern))))
SELECT page_id, count(list) AS n_active, coalesce(string_agg(DISTINCT list, ',' ORDER BY list), '') AS lists, count(list) > 0 AS blocked
FROM p LEFT JOIN m USING (page_id) GROUP BY page_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of every document and the verdict of its language's and source's fences."""
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8 = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(*) AS n_rep FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM tri) WHERE c > 1) GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS n_lines,
  CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
    - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length FROM f),
x AS (SELECT doc_id, lang, source, 'symbols' AS feature, 20 AS room, symbols AS v FROM g UNION ALL SELECT doc_id, lang, source, 'dup_lines', 250, dup_lines FROM g
  UNION ALL SELECT doc_id, lang, source, 'repeats', 150, repeats FROM g UNION ALL SELECT doc_id, lang, source, 'word_length', 1000, word_length FROM g),
y AS (SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin_,
  count(*) OVER (PARTITION BY lang, source, feature) AS n_own, count(*) OVER (PARTITION BY lang, feature) AS n_lang FROM x),
z AS (SELECT *, CASE WHEN n_own >= 100 THEN 0 WHEN n_lang >= 100 THEN 1 ELSE 2 END AS level FROM y),
q0 AS (SELECT lang, source, feature, quantile_disc(bin_, 0.25) AS a, quantile_disc(bin_, 0.75) AS b FROM y GROUP BY ALL),
q1 AS (SELECT lang, feature, quantile_disc(bin_, 0.25) AS a, quantile_disc(bin_, 0.75) AS b FROM y GROUP BY ALL),
q2 AS (SELECT feature, quantile_disc(bin_, 0.25) AS a, quantile_disc(bin_, 0.75) AS b FROM y GROUP BY ALL),
fence AS (SELECT z.doc_id, v, room, CASE level WHEN 0 THEN q0.a WHEN 1 THEN q1.a ELSE q2.a END AS a, CASE level WHEN 0 THEN q0.b WHEN 1 THEN q1.b ELSE q2.b END AS b
  FROM z JOIN q0 ON z.feature = q0.feature AND z.lang IS NOT DISTINCT FROM q0.lang AND z.source IS NOT DISTINCT FROM q0.source
  JOIN q1 ON z.feature = q1.feature AND z.lang IS NOT DISTINCT FROM q1.lang JOIN q2 ON z.feature = q2.feature),
ok AS (SELECT doc_id, bool_and(v BETWEEN a - greatest(3 * (b - a), room) AND b + greatest(3 * (b - a), room)) AS inside FROM fence GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND inside AS kept
FROM f JOIN ok USING (doc_id)
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by word_bpe_49k, through a cache that begins empty."""
    from public_tokenizers import path

    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path("word_bpe_49k.json"), cache)
    return out.select("doc.doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of repositories, one for each source: every ninth is its directory's licence file."""
    d = F.col("doc_id")
    name = F.when(d % 9 == 0, "LICENSE.txt").otherwise(F.concat(F.lit("f"), d.cast("string"), F.lit(".txt")))
    top, mid = F.concat(F.lit("p"), (d % 40).cast("string")), F.concat(F.lit("q"), ((d / 40).cast("long") % 10).cast("string"))
    path = F.when(d % 5 == 0, F.concat_ws("/", top, name)).otherwise(F.concat_ws("/", top, mid, name))
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), path.alias("path"), "text")
    return scan_licenses(files).select("file.doc_id", "file.path", "own", "cosine", "inherited", "from_dir", "license")


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest inner products of every twentieth vector, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty centroids, five rounds, over all vectors of 64 components."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, seed=2)


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
_INTEGERS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def _op12_sql(rounds: int = 5) -> str:
    """Every round in full: distances to all centroids, the nearest, and the floors of the means."""
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, {_INTEGERS} AS v FROM embeddings WHERE len(embedding) = 64 AND {_USABLE})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM v QUALIFY c < 40)",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""d{i} AS MATERIALIZED (SELECT v.vec_id, v.v, c, CAST(list_sum(list_transform(list_zip(v.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i}),
a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if i < rounds:
            ctes.append(f"""s{i} AS (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has its label moved on by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


OP13 = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTEGERS} AS v FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (pipeline, op1_decontamination, op2_source_mix, op3_toxicity, op4_warc_revisits, op5_url_filters, op6_substring_dedup, op7_jaccard_join, op8_quality_rules, op9_token_counts, op10_license_scan, op11_vector_search, op12_centroid_clustering, op13_hard_negatives)}
ORACLES = {"op1_decontamination": OP1, "op4_warc_revisits": OP4, "op5_url_filters": OP5, "op6_substring_dedup": OP6, "op8_quality_rules": OP8, "op12_centroid_clustering": _op12_sql(), "op13_hard_negatives": OP13}
