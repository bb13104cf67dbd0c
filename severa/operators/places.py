"""Places of notices: cities out of addresses and labels, and locations that turn out to be one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tails(text: Column, most: int = 4) -> Column:
    """The last one to `most` words of a text: an array of (words, tail)."""
    words = F.filter(F.split(text, r"[\s,]+"), lambda w: w != "")
    reach = F.least(F.lit(most), F.size(words))
    each = F.transform(F.sequence(F.lit(1), reach), lambda n: F.struct(n.alias("words"), F.array_join(F.slice(words, F.size(words) - n + 1, n), " ").alias("tail")))
    return F.when(reach > 0, each)


def city_from_tail(rows: DataFrame, key: str, state: str, text: str, places: DataFrame) -> DataFrame:
    """rows and places (state, city, any others) -> key and the place's columns but the state, for the longest tail of the
    text that is a city of the row's state; rows without one are left out."""
    known = places.select(F.col("state").alias("_state"), F.lower("city").alias("_tail"), *[c for c in places.columns if c != "state"])
    asked = rows.select(key, F.col(state).alias("_state"), F.explode(tails(F.col(text))).alias("t")).select(key, "_state", "t.words", F.lower("t.tail").alias("_tail"))
    met = asked.join(known, ["_state", "_tail"])
    best = F.max_by(F.struct(*[c for c in places.columns if c != "state"]), "words")
    return met.groupBy(key).agg(best.alias("place")).select(key, "place.*")


def split_label(rows: DataFrame, key: str, label: str, state: str, places: DataFrame) -> DataFrame:
    """Labels 'employer - city' or 'employer (city)' -> key, employer, city: split only where what follows is a city of the
    state, else the whole label is the employer and the city is null."""
    pattern = r"^(.+?)\s*(?:[-–]|\()\s*([^()–-]+?)\)?\s*$"
    cut = rows.select(key, F.col(state).alias("_state"), F.col(label).alias("_label"), F.regexp_extract(label, pattern, 1).alias("_head"), F.lower(F.regexp_extract(label, pattern, 2)).alias("_tail"))
    known = places.select(F.col("state").alias("_state"), F.lower("city").alias("_tail"), "city").distinct()
    met = cut.join(known, ["_state", "_tail"], "left")
    return met.select(key, F.when(F.col("city").isNotNull(), F.col("_head")).otherwise(F.col("_label")).alias("employer"), "city")


def rebind(locations: DataFrame, found: DataFrame) -> DataFrame:
    """locations (location_id, state, city, zip) and ZIPs found for some (location_id, zip) -> location_id, zip, target_id.

    A ZIP fills a location that has none. Locations that then agree in state, city and ZIP are twins: all go to the smallest
    id of those that had the ZIP before, else to the smallest id. A location without a city or ZIP is its own target."""
    filled = locations.join(found.select("location_id", F.col("zip").alias("new")), "location_id", "left")
    filled = filled.select("location_id", "state", "city", F.coalesce("zip", "new").alias("zip"), F.when(F.col("zip").isNotNull(), F.col("location_id")).alias("had"))
    whole = filled.where("state is not null and city is not null and zip is not null")
    heads = whole.groupBy("state", "city", "zip").agg(F.coalesce(F.min("had"), F.min("location_id")).alias("target_id"))
    return filled.join(heads, ["state", "city", "zip"], "left").select("location_id", "zip", F.coalesce("target_id", "location_id").alias("target_id"))
