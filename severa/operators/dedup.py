"""Worksite merge, supersession, upsert, get-or-create and company consolidation, set-based."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.operators.ranking import row_numbers
from severa.staging import drop_staged, stage


def merge_worksites(rows: DataFrame, ordinal: Column) -> DataFrame:
    """One row a notice_id: rows alike in address, count and effective date count once, the counts of the rest add up
    (null only if all are), the first row by ordinal stands for the notice."""
    each = rows.groupBy("notice_id", "address", "layoff_count", "effective_date").agg(F.min(F.struct(ordinal.alias("ord"), "employer", "state", "notice_date")).alias("first"))
    return each.groupBy("notice_id").agg(F.min("first").alias("first"), F.sum("layoff_count").alias("layoff_count"), F.count("*").alias("worksites")).select("notice_id", "first.employer", "first.state", "first.notice_date", "layoff_count", "worksites")


#: The cases of supersession in order: what else must hold of a pair with one (state, employer, date), with `o` the older
#: version, which goes, and `k` the one that is kept.
CASES = (
    # the same worksite with and without a ZIP
    "o.city = k.city AND o.zip IS NULL AND k.zip IS NOT NULL AND o.layoff_count <=> k.layoff_count",
    # an amended count, scraped later
    "o.city = k.city AND o.zip <=> k.zip AND NOT (o.layoff_count <=> k.layoff_count) AND o.scraped_at < k.scraped_at",
    # the same address, one of them without a ZIP
    "o.address = k.address AND o.zip IS NULL AND k.zip IS NOT NULL",
    # no place at all beside one with a place
    "o.city IS NULL AND k.city IS NOT NULL AND o.layoff_count <=> k.layoff_count",
)


def supersession_pairs(notices: DataFrame) -> DataFrame:
    """All pairs by case: key, case, o_id, k_id. All pairs share state, normalised employer and date, an equi-join; rows that
    lack one of them pair with nothing."""
    rows = notices.where("notice_date is not null and state is not null and employer is not null").withColumn("key", F.concat_ws("|", "state", F.lower(F.trim("employer")), F.col("notice_date").cast("string")))
    # Only keys with two rows or more can make a pair. Both sides of the self-join then share one exchange by key.
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    pairs = rows.alias("o").join(rows.alias("k"), F.expr("o.key = k.key AND o.notice_id <> k.notice_id"))
    hits = F.array_compact(F.array(*[F.when(F.expr(c), i) for i, c in enumerate(CASES)]))
    return pairs.select("o.key", F.explode(hits).alias("case"), F.col("o.notice_id").alias("o_id"), F.col("k.notice_id").alias("k_id"))


#: What both sides of a case have in common beside the key (null equals null where it is said), and what each side must be.
_CASE_SIDES = (
    (("city",), ("layoff_count",), "city IS NOT NULL AND zip IS NULL", "city IS NOT NULL AND zip IS NOT NULL"),
    (("city",), ("zip",), "city IS NOT NULL", "city IS NOT NULL"),
    (("address",), (), "address IS NOT NULL AND zip IS NULL", "address IS NOT NULL AND zip IS NOT NULL"),
    ((), ("layoff_count",), "city IS NULL", "city IS NOT NULL"),
)


def pairs_of_case(notices: DataFrame, case: int) -> DataFrame:
    """The pairs of one case alone, as `supersession_pairs` gives them: o_id, k_id. What the case wants equal is a key of the
    join and what it wants of one side is asked of that side before, so that no pair is made that the case doesn't hold but
    for the times and counts of amended ones."""
    alike, alike_or_null, old, kept = _CASE_SIDES[case]
    rows = notices.dropna(subset=["notice_date", "state", "employer"])
    named = [F.col("state").alias("_s"), F.lower(F.trim("employer")).alias("_e"), F.col("notice_date").alias("_d"), *alike]
    # Null equals null by a flag beside a value in its place, so that each remains a plain key of the join.
    named += [c for k in alike_or_null for c in (F.col(k).isNull().alias(f"_no_{k}"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}"))]
    extra = ["layoff_count", "scraped_at"] if case == 1 else []
    side = lambda ok, n: rows.where(ok).select(*named, F.col("notice_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in extra])
    met = side(old, "o_id").join(side(kept, "k_id"), ["_s", "_e", "_d", *alike, *[p + k for k in alike_or_null for p in ("_no_", "_")]]).where("o_id <> k_id")
    if case == 1:
        met = met.where("NOT (o_id_layoff_count <=> k_id_layoff_count) AND o_id_scraped_at < k_id_scraped_at")
    return met.select("o_id", "k_id")


def resolve_supersession(pairs: DataFrame) -> DataFrame:
    """Greedy over the cases of each key, ties by ids: a pair is skipped if either side has already gone. -> superseded_id,
    by_id, case.

    Rounds of joins: an open pair is taken if it is the least that takes its older side away and comes before the least that
    would take the other side, as nothing before it can then touch either; pairs after one that took a side of theirs are
    closed. The least open
    pair of a key always qualifies, so rounds end, and chains of versions in the order of their ids need one. A row is a
    pair throughout, and no key is gathered."""
    rows = pairs.select("key", F.struct("case", "o_id", "k_id").alias("p"))
    now, taken = stage(rows, "open"), []
    while not now.isEmpty():
        least = now.groupBy("key", F.col("p.o_id").alias("id")).agg(F.min("p").alias("m"))
        own = least.select("key", F.col("m.k_id").alias("k_id"), "m")
        other = least.select("key", F.col("id").alias("k_id"), F.col("m").alias("mk"))
        took = stage(own.join(other, ["key", "k_id"], "left").where("mk is null or m < mk").select("key", "m"), "taken")
        taken.append(took)
        rest = now
        for side in ("o_id", "k_id"):
            gone = F.expr(f"n.key = g.key and n.p.{side} = g.m.o_id and g.m <= n.p")
            rest = rest.alias("n").join(took.alias("g"), gone, "left_anti")
        new = stage(rest, "open")
        drop_staged(now)
        now = new
    drop_staged(now)
    all_taken = reduce(DataFrame.unionByName, taken) if taken else rows.select("key", F.col("p").alias("m"))
    return all_taken.select(F.col("m.o_id").alias("superseded_id"), F.col("m.k_id").alias("by_id"), F.col("m.case").alias("case"))


def _by_least(rows: DataFrame, keys: list[str], old: Column, kept: Column, case: int) -> DataFrame:
    """In every group the `old` rows give way to the smallest `kept` one. No row is both, so the case takes no kept row away
    and a group needs no more than that smallest id."""
    least = rows.where(kept).groupBy(*keys).agg(F.min("notice_id").alias("by_id")).alias("l")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    return rows.where(old).alias("r").join(least, same).select(F.col("r.notice_id").alias("superseded_id"), "by_id", F.lit(case).alias("case"))


def supersede(notices: DataFrame) -> DataFrame:
    """notices -> superseded_id, by_id, case: what `resolve_supersession` makes of all pairs, without making them all.

    Cases come one after another. In three of them the older side lacks what the kept side has, so the smallest kept id of a
    group decides. Only amended counts pair versions with one another, by rounds, among notices of one key, city and ZIP."""
    need = ["notice_date", "state", "employer"]
    rows = notices.dropna(subset=need).withColumn("key", F.concat_ws("|", "state", F.lower(F.trim("employer")), F.col("notice_date").cast("string")))
    several = rows.groupBy("key").count().where("count > 1").select("key")
    alive = stage(rows.join(several, "key").select("key", "notice_id", "city", "zip", "address", "layoff_count", "scraped_at"), "versions")
    out = []

    def settle(found: DataFrame) -> None:
        nonlocal alive
        out.append(found := stage(found, "superseded"))
        alive = alive.join(found.select(F.col("superseded_id").alias("notice_id")), "notice_id", "left_anti")

    c = F.col
    settle(_by_least(alive.where("city is not null"), ["key", "city", "layoff_count"], c("zip").isNull(), c("zip").isNotNull(), 0))
    o, k = alive.alias("o"), alive.alias("k")
    amended = o.join(k, F.expr("o.key = k.key AND o.city = k.city AND o.zip <=> k.zip AND o.notice_id <> k.notice_id AND o.scraped_at < k.scraped_at AND NOT (o.layoff_count <=> k.layoff_count)"))
    settle(resolve_supersession(amended.select("o.key", F.lit(1).alias("case"), c("o.notice_id").alias("o_id"), c("k.notice_id").alias("k_id"))))
    settle(_by_least(alive.where("address is not null"), ["key", "address"], c("zip").isNull(), c("zip").isNotNull(), 2))
    out.append(_by_least(alive, ["key", "layoff_count"], c("city").isNull(), c("city").isNotNull(), 3))
    return reduce(DataFrame.unionByName, out)


def upsert(stored: DataFrame, new: DataFrame, key: str, fill: list[str], update: list[str]) -> DataFrame:
    """All rows of either: `fill` columns keep the stored value where there is one, `update` columns take the new one
    where there is one. Adds is_new."""
    rows = stored.alias("s").join(new.alias("n"), F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer")
    return rows.select(
        F.coalesce(f"s.{key}", f"n.{key}").alias(key),
        *[F.coalesce(f"s.{c}", f"n.{c}").alias(c) for c in fill],
        *[F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in update],
        F.col(f"s.{key}").isNull().alias("is_new"),
    )


def mint_ids(known: DataFrame, wanted: DataFrame, key: str, id_column: str) -> DataFrame:
    """Ids for keys: the known ones, and for the others the numbers after the largest known id in the order of the key."""
    missing = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")
    top = known.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top"))
    numbered = row_numbers(missing, [F.col(key)], "n").crossJoin(F.broadcast(top))
    return known.select(key, id_column).unionByName(numbered.select(key, (F.col("top") + F.col("n")).cast("long").alias(id_column)))


def shared_names(companies: DataFrame, rank: Column) -> DataFrame:
    """companies (company_id, name_key, unique_id, domain) -> for each name: n, uids, domains, one (whether its companies
    are one) and name_head, the company of the highest rank."""
    names = companies.groupBy("name_key").agg(F.count("*").alias("n"), F.count_distinct("unique_id").alias("uids"), F.count_distinct(F.nullif("domain", F.lit(""))).alias("domains"), F.max_by("company_id", rank).alias("name_head"))
    return names.withColumn("one", (F.col("uids") < 2) | (F.col("domains") == 1))


def consolidate(companies: DataFrame, name_key: Column, totals: DataFrame) -> DataFrame:
    """company_id -> survivor_id: companies that share a unique id are one; then those that share a name, unless the name
    has two unique ids or more with more than one web domain between them. The survivor is enriched, most confident, has
    most notices, then the smallest id."""
    rows = companies.join(totals, "company_id", "left").withColumn("name_key", name_key)
    rank = F.struct(F.col("enriched").cast("int").alias("a"), F.coalesce("confidence", F.lit(0.0)).alias("b"), F.coalesce("notice_count", F.lit(0)).alias("c"), (-F.col("company_id")).alias("d"))
    by_uid = rows.where("unique_id is not null").groupBy("unique_id").agg(F.max_by("company_id", rank).alias("uid_head"))
    rows = rows.join(by_uid, "unique_id", "left").withColumn("head", F.coalesce("uid_head", "company_id"))
    heads = rows.where("head = company_id")
    names = shared_names(heads, rank).where("one").select("name_key", "name_head")
    of_head = heads.join(names, "name_key", "left").select(F.col("company_id").alias("head"), F.coalesce("name_head", "company_id").alias("survivor_id"))
    return rows.select("company_id", "head").join(of_head, "head").select("company_id", "survivor_id")


def flatten_chains(links: DataFrame, node: str, target: str, spark_stage) -> DataFrame:
    """Chains of node -> target to their roots by pointer jumping: each round doubles the hops. A cycle's nodes all take
    its smallest node."""
    now = spark_stage(links.where(f"{target} is not null and {node} <> {target}").select(F.col(node).alias("node"), F.col(target).alias("root"), F.least(node, target).alias("low")), "chains")
    rounds, size = 0, now.count()
    while (1 << rounds) <= size:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("low").alias("low2"))
        met = now.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("next"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("root").alias("was"))
        moved = met.where("next <> was").limit(1).count()
        now = spark_stage(met.select("node", F.col("next").alias("root"), "low"), "chains")
        rounds += 1
        if not moved:
            break
    inside = now.select(F.col("node").alias("root")).withColumn("cyclic", F.lit(True))
    return now.join(inside, "root", "left").select("node", F.when(F.col("cyclic"), F.col("low")).otherwise(F.col("root")).alias("root"))
