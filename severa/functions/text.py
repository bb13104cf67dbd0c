"""Row-level text coercion: keys, dates, numbers, categories and names."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms at the end of a company name, and county suffixes.
LEGAL = "inc incorporated llc llp lllp lp ltd limited corp corporation co company plc pllc pc pa lc gmbh sa ag nv bv".split()
COUNTY_SUFFIXES = (" county", " parish", " borough", " census area", " municipality")


def norm(s: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def blank(s: Column) -> Column:
    return s.isNull() | (F.trim(s) == "")


def as_str(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def as_int(s: Column) -> Column:
    """Thousands commas only before exactly three digits; a decimal is cut."""
    plain = F.regexp_replace(F.trim(s), r"(?<=\d),(?=\d{3}\b)", "")
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double").try_cast("bigint"))


def as_date(s: Column, as_of: datetime.date) -> Column:
    """ISO, US and long forms; years before 1988 or over two ahead of as_of are typos."""
    d = F.coalesce(*[F.try_to_timestamp(F.trim(s), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "yyyyMMdd")])
    return F.when(F.year(d).between(1988, as_of.year + 2), d)


def city_from_address(address: Column) -> Column:
    """The part before the last of an address of three comma-separated parts or more."""
    parts = F.split(address, ",")
    return F.when(F.size(parts) >= 3, F.trim(F.try_element_at(parts, F.lit(-2))))


def zip_from(zip_code: Column, address: Column) -> Column:
    first = lambda s: F.nullif(F.regexp_extract(s, r"\b(\d{5})(?:-\d{4})?\b", 1), F.lit(""))
    return F.coalesce(first(zip_code), first(address))


def zip_of_address(address: Column) -> Column:
    """The ZIP that an address ends in, else its last number of five digits; one that it begins with is a house number."""
    five = r"\b(\d{5})(?:-\d{4})?\b"
    last = F.regexp_extract(address, rf"{five}\s*$", 1)
    inner = F.try_element_at(F.regexp_extract_all(address, F.lit(rf"(?<=\S\s{{0,9}}){five}"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.nullif(last, F.lit("")), inner)


def notice_key(state: Column, employer: Column, notice_date: Column, city: Column, zip_code: Column) -> Column:
    """Stable 32-digit id; address and count are no part of it."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", part(F.upper(state)), part(norm(employer)), part(notice_date.cast("string")), part(norm(city)), part(norm(zip_code))), 256), 1, 32)


def closure_category(raw: Column) -> Column:
    """Closure, Layoff, or null where the text names neither or both."""
    s = F.lower(F.trim(raw))
    closed = s.rlike(r"clos|shut|\bcl\b")
    laid = s.rlike(r"layoff|lay off|lay-off|reduction|in force|rif|downsiz|furlough|\b(lo|wr)\b")
    return F.when(closed & ~laid, "Closure").when(laid & ~closed, "Layoff")


def closure_label(category: Column) -> Column:
    return F.when(category == "Closure", "Closure").when(category == "Layoff", "Mass layoff").otherwise("WARN notice")


def clean_naics(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"\b(\d{2,8})\b", 1), F.lit(""))


def county_name(county: Column) -> Column:
    """One spelling for a county: plain apostrophes, no qualifier in brackets or after a dash, no suffix."""
    c = F.trim(F.regexp_replace(F.regexp_replace(county, "’", "'"), r"\s+", " "))
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\([^)]*\)", ""), r"\s+-\s+.*$", ""))
    c = F.regexp_replace(c, r"(?i)\s+co\.?$", " County")
    return F.nullif(F.trim(F.regexp_replace(c, "(?i)(" + "|".join(COUNTY_SUFFIXES) + ")$", "")), F.lit(""))


def company_key(name: Column) -> Column:
    """Comparison key of a company: no site number in brackets at the front or after a number sign, no punctuation, no
    leading 'the', no trailing legal forms. Where nothing is left, the name with only its punctuation gone."""
    squeeze = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\w\s]", " "), r"\s+", " "))
    sites = r"^\W*\d+\W*\)|#\W?\d+"
    s = F.regexp_replace(squeeze(F.regexp_replace(name, sites, " ")), r"^the (?=.)", "")
    s = F.trim(F.regexp_replace(s, r"(^|\s)(" + "|".join(LEGAL) + r")(\s+(" + "|".join(LEGAL) + r"))*$", ""))
    return F.coalesce(F.when(s != "", s).otherwise(squeeze(name)), F.lit(""))


def website_domain(url: Column) -> Column:
    """Bare host of a website, or '' where there is none with a dot."""
    s = F.regexp_replace(F.lower(F.trim(url)), "^([a-z][a-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", ""), r"\.$", "")
    return F.coalesce(F.when(host.contains("."), host), F.lit(""))


def trigrams(s: Column) -> Column:
    """Distinct three-character grams of each word, padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Shared share of two trigram sets."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))
