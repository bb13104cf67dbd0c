"""What a notice letter's text says: affected workers, dates, ZIP codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOUN = r"(?:employees|workers|positions|associates|individuals|people|team members)"
_NUMBER = r"(\d{1,3}(?:,\d{3})+|\d{1,5})"
#: From the most explicit statement down; a tier that names two numbers says nothing.
TIERS = (
    (rf"(?i)total of (?:approximately )?{_NUMBER} (?:\w+ )?{_NOUN}", rf"(?i)(?:number of )?{_NOUN} affected: ?{_NUMBER}"),
    (rf"(?i)(?:affect|lay(?:ing)? off|terminat\w+|impact\w*) (?:approximately |about )?{_NUMBER} (?:\w+ )?{_NOUN}",),
    (rf"(?i){_NUMBER} (?:\w+ )?{_NOUN}[^.]*(?:laid off|terminated|affected|layoff)",),
)


def affected_workers(text: Column) -> Column:
    """The number that the first tier with any number gives, or null if that tier disagrees with itself."""
    flat = F.regexp_replace(text, r"\s+", " ")
    sets = []
    for tier in TIERS:
        found = F.concat(*[F.regexp_extract_all(flat, F.lit(p), F.lit(1)) for p in tier])
        sets.append(F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, ",", "").cast("long"))))
    chosen = F.coalesce(*[F.when(F.size(s) > 0, s) for s in sets])
    return F.when(F.size(chosen) == 1, chosen[0])


def zip_codes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2} (\d{5})(?:-\d{4})?\b"), F.lit(1)))


def first_date(text: Column) -> Column:
    found = F.regexp_extract(text, r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("MMMM d, yyyy")).cast("date")


def occupations(text: Column, total: Column) -> Column:
    """Lines 'title  count' of a letter as an array of (title, n), if their counts add up to the letter's total; else empty.
    A title is followed by two blanks or more, or by a tab."""
    line = r"(?m)^\s*([A-Za-z][^\n\t]*?)(?:\t| {2,})\s*(\d{1,5})\s*$"
    titles, counts = (F.regexp_extract_all(text, F.lit(line), F.lit(i)) for i in (1, 2))
    rows = F.transform(F.arrays_zip(titles.alias("t"), counts.alias("n")), lambda r: F.struct(F.trim(r["t"]).alias("title"), r["n"].cast("long").alias("n")))
    whole = F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r["n"])
    return F.when(whole == total, rows).otherwise(F.array().cast("array<struct<title:string,n:bigint>>"))


def labelled_count(text: Column) -> Column:
    """The number after a form's label for affected workers, or null."""
    label = rf"(?i)(?:total )?number (?:of )?affected(?: workers| employees)?\s*:\s*{_NUMBER}\b"
    return F.regexp_replace(F.regexp_extract(text, label, 1), ",", "").try_cast("bigint")
