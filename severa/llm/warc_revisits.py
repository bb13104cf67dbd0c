"""WARC: not-modified revisits resolved to the latest earlier full response of the same canonical URL.

The as-of join is blocked in time: each URL's last full response of every block is carried forward over the URL's blocks
(a row each), and only inside a block do captures meet one another. A URL that holds a large share of all captures is
thereby spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may update in a stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., no scheme, port 80/443, fragment, tracking parameters or trailing slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(bare, "[?](.*)$", 1), f"(^|&)({TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")


def resolve_revisits(captures: DataFrame, permitted: tuple[str, ...] = PERMITTED, block: str = "1 hour") -> DataFrame:
    """captures (capture_id, url, fetched timestamp, kind 'response'|'revisit', status, headers map with lower-case
    names, digest, any others) -> capture (a struct of all the columns), url_key, verdict, ref_id, headers, digest.

    A full response is one with status 200 and a digest. A revisit takes the latest full response of its canonical URL
    that was fetched earlier (at the same moment, with a smaller capture_id, then digest, then headers) and nothing before it:
    'resolved' if the strong parts of both ETags agree, or, where one has none, both Last-Modified, or else both digests;
    'mismatch' if the first of these that both have differs; 'unvalidated' if they share none; 'no_response' without an
    earlier one. Resolved headers are the response's, with the permitted ones of the revisit put in. Responses have
    verdict 'response', and null or unreadable URLs or times 'no_response'. Repeated rows each get a result."""
    from_rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("c"))
    rows = from_rows.where("c.fetched is not null and c.url is not null").select("c", canonical_url(F.col("c.url")).alias("url_key"), F.window("c.fetched", block).start.alias("block"))
    full = (F.col("c.kind") == "response") & (F.col("c.status") == 200) & F.col("c.digest").isNotNull()
    stored = F.struct(F.col("c.fetched").alias("fetched"), F.col("c.capture_id").alias("capture_id"), F.col("c.headers").alias("headers"), F.col("c.digest").alias("digest"))
    rows = rows.withColumn("full", F.when(full, stored))
    unknown = from_rows.where("c.fetched is null or c.url is null").select("c", F.lit(None).cast("string").alias("url_key"), F.lit(None).cast(rows.schema["full"].dataType).alias("ref"))

    rows = rows.withColumn("tie", F.coalesce(F.concat_ws("|", F.col("c.digest").cast("string"), header_text(F.col("c.headers"))), F.lit("")))
    order = F.struct("c.fetched", "c.capture_id", "tie")
    blocks = rows.groupBy("url_key", "block").agg(F.max_by("full", F.when(F.col("full").isNotNull(), order)).alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("url_key", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("url_key", "block").orderBy("c.fetched", "c.capture_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(inside))
    met = near.join(carried, ["url_key", "block"], "left").select("c", "url_key", F.coalesce("near", "carried").alias("ref"))

    own = F.col("c.headers")
    ref = F.col("ref.headers")
    modified = lambda h: F.try_element_at(h, F.lit("last-modified"))
    agrees = (
        F.when(_tag(own).isNotNull() & _tag(ref).isNotNull(), _tag(own) == _tag(ref))
        .when(modified(own).isNotNull() & modified(ref).isNotNull(), modified(own) == modified(ref))
        .when(F.col("c.digest").isNotNull(), F.col("c.digest") == F.col("ref.digest"))
    )
    verdict = (
        F.when(F.col("c.kind") == "response", "response").when(F.col("ref").isNull(), "no_response")
        .when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unvalidated")
    )
    new = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*permitted))
    merged = F.map_concat(F.map_filter(F.coalesce(ref, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    done = met.unionByName(unknown).withColumn("verdict", F.when(F.col("url_key").isNull() & (F.col("c.kind") != "response"), "no_response").otherwise(verdict))
    resolved = F.col("verdict") == "resolved"
    return done.select(F.col("c").alias("capture"), "url_key", "verdict", F.when(resolved, F.col("ref.capture_id")).alias("ref_id"), F.when(resolved, merged).otherwise(own).alias("headers"), F.when(resolved, F.col("ref.digest")).otherwise(F.col("c.digest")).alias("digest"))


def header_text(headers: Column) -> Column:
    """name=value of each header in the order of names, joined by ';'."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
