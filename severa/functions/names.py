"""Cleaning of company names for look-ups, in column functions, and the likeness of two names.

A filed name may hold more than the company: a status before it; a site's number, a remark in brackets, the kind of site or
a street address after it; how the filer relates to another company; another name. A name is split into its words, each
word is told by what it is, words that belong to a filing are taken off the front and the end, and the rest ends before the
first cue of an address, a relation or a list of subsidiaries.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Stems of the words by which a filing says what became of an earlier one.
STATUS = ("amend", "cancel", "correct", "rescind", "revis", "supplement", "updat", "withdr")
ALIAS = ("doing business as", "d/b/a", "dba", "also known as", "a/k/a", "aka", "formerly known as", "f/k/a", "fka", "n/k/a")
#: First words of a remark after a comma on how the filer relates to another company.
RELATED = ("branch", "contractor", "division", "formerly", "franchise", "franchisee", "member", "operated", "operator", "subsidiary")
GROUP = ("affiliates", "affiliate", "divisions", "subsidiaries", "subsidiary")
#: A kind of site is one of the first and one of the second.
SITES = (("call", "data", "design", "distribution", "fulfillment", "logistics", "service", "support"), ("center", "centre", "hub"))

_ALIAS = r"(?i)^(.+?)[\s,;(]+(?:" + "|".join(ALIAS) + r")\b[.:]?\s*(.+)$"


def _plain(name: Column) -> Column:
    """Without the commonest character references and with single blanks."""
    s = F.coalesce(name, F.lit(""))
    for reference, character in (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(reference), F.lit(character))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _bare(word: Column) -> Column:
    """Letters and digits of a word, in lower case."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def _word(words: Column, at: Column) -> Column:
    """The bare word at a place counted from 0; nothing past the end."""
    return F.coalesce(_bare(F.get(words, at)), F.lit(""))


def _without_front(words: Column) -> Column:
    """From the first word that is neither a status, nor a number in brackets, nor punctuation alone."""
    in_front = lambda w: (_bare(w) == "") | _bare(w).rlike("^(?:" + "|".join(STATUS) + r")\p{L}+$") | (w.startswith("(") & _bare(w).rlike(r"^\d+$"))
    first = F.array_min(F.transform(words, lambda w, i: F.when(~in_front(w), i)))
    return F.when(first.isNull(), words).otherwise(F.slice(words, first + 1, F.size(words)))


def _without_site_numbers(words: Column) -> Column:
    numbered = lambda i: F.get(words, i).startswith("#") & _word(words, i).rlike(r"^\d*$")
    store = lambda i: (_word(words, i) == "store") & (_word(words, i + 1) == "no") & _word(words, i + 2).rlike(r"^\d+$")
    hit = lambda i: numbered(i) | ((i > 0) & (_word(words, i) != "") & F.get(words, F.greatest(i - 1, F.lit(0))).eqNullSafe("#") & _word(words, i).rlike(r"^\d+$"))
    inside = lambda i: store(i) | ((i > 0) & store(F.greatest(i - 1, F.lit(0)))) | ((i > 1) & store(F.greatest(i - 2, F.lit(0))))
    return F.filter(words, lambda w, i: ~F.coalesce(hit(i) | inside(i), F.lit(False)))


def _before_cues(words: Column) -> Column:
    """Up to the first word of a relation, of a list of a group's companies, of an address that ends the name, or of a
    bracket that nothing closes."""
    n = F.size(words)
    related = lambda i: F.get(words, F.greatest(i - 1, F.lit(0))).endswith(",") & F.when(_word(words, i).isin("a", "an"), _word(words, i + 1)).otherwise(_word(words, i)).isin(*RELATED)
    group = lambda i: (_word(words, i) == "and") & _word(words, i + 1).isin("its", "their", "all") & F.exists(F.slice(words, i + 3, 3), lambda w: _bare(w).isin(*GROUP))
    state, code = F.get(words, F.greatest(n - 2, F.lit(0))), F.get(words, n - 1)
    posted = state.rlike("^[A-Z]{2}$") & code.rlike(r"^\d{5}\b")
    street = lambda i: posted & (i < n - 2) & _word(words, i).rlike(r"^\d+$")
    opened = lambda i: F.get(words, i).rlike(r"^[(\[]") & ~F.exists(F.slice(words, i + 1, n), lambda w: w.rlike(r"[)\]]"))
    end = F.array_min(F.transform(words, lambda w, i: F.when((i > 0) & (related(i) | group(i) | street(i) | opened(i)), i)))
    return F.when(end.isNull(), words).otherwise(F.slice(words, 1, end))


_NAME, _BRACKET, _SITE, _END = 0, 1, 2, 3


def _without_end(words: Column) -> Column:
    """Without remarks in brackets, long numbers, kinds of site, conjunctions and punctuation at the end: words are read
    from the last, and the first that is none of these ends the reading. `held` is a word that may name a site."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(_END).alias("in"), F.lit("").alias("held"))
    state = lambda kept, at, held: F.struct(kept.alias("kept"), F.lit(at).alias("in"), held.alias("held"))

    def step(s: Column, w: Column) -> Column:
        return _let(_bare(w), lambda word: _step(s, w, word))

    def _step(s: Column, w: Column, word: Column) -> Column:
        none = F.lit("")
        keep = state(F.array_append(s["kept"], w), _NAME, none)
        skip = state(s["kept"], _END, none)
        closes = w.rlike(r"[)\]]\W*$")
        ends = (word == "") | word.rlike(r"^\d{3,}$") | (word == "and")
        read = F.when(closes, F.when(w.rlike(r"^[(\[]"), skip).otherwise(state(s["kept"], _BRACKET, none)))
        read = read.when(ends, skip).when(word.isin(*SITES[1]), state(s["kept"], _SITE, w)).otherwise(keep)
        out = F.when(s["in"] == _NAME, keep).when(s["in"] == _BRACKET, F.when(w.rlike(r"^[(\[]"), skip).otherwise(s))
        return out.when(s["in"] == _SITE, F.when(word.isin(*SITES[0]), skip).otherwise(state(F.array_append(F.array_append(s["kept"], s["held"]), w), _NAME, none))).otherwise(read)

    done = lambda s: F.reverse(F.when(s["in"] == _SITE, F.array_append(s["kept"], s["held"])).otherwise(s["kept"]))
    return F.aggregate(F.reverse(words), start, step, done)


def _clean(s: Column) -> Column:
    """The company's own words, or all if none would stay."""
    words = F.split(s, " ")
    for rule in (_without_front, _without_site_numbers, _before_cues, _without_end):
        words = _let(words, rule)
    name = F.regexp_replace(F.array_join(words, " "), r"^[*\s]+|[*\s,;&]+$", "")
    return _let(name, lambda n: F.when(n == "", s).otherwise(n))


def search_name(name: Column) -> Column:
    """The company without what a filing adds to its name; never nothing where there is a name."""
    main = _let(_plain(name), lambda s: F.when(s.rlike(_ALIAS), F.regexp_extract(s, _ALIAS, 1)).otherwise(s))
    return _let(main, _clean)


def trade_name(name: Column) -> Column:
    """What follows the first marker of a trade or other name, cleaned, unless it is the name itself."""
    trade = _let(F.regexp_replace(F.regexp_extract(_plain(name), _ALIAS, 2), r"[)\],]+$", ""), _clean)
    return _let(trade, lambda t: F.when((t != "") & (F.lower(t) != F.lower(search_name(name))), t))


def fuse_initials(tokens: Column) -> Column:
    """Runs of single letters as one token: a, b, c, co -> abc, co."""
    joined = F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) == 1, F.concat(F.lit("\x01"), t, F.lit("\x01"))).otherwise(t)), " ")
    return F.filter(F.split(F.replace(F.replace(joined, F.lit("\x01 \x01"), F.lit("")), F.lit("\x01"), F.lit("")), " "), lambda t: t != "")


#: Words that tell companies apart too little to prove that two names mean the same one.
COMMON = tuple("the of and for a an in group holding holdings international national american united states usa us services service solutions systems company center".split())


def significant_tokens(key: Column) -> Column:
    """Distinct words of a comparison key, initials fused, without common words and single characters."""
    return F.array_distinct(F.filter(fuse_initials(F.split(key, " ")), lambda t: (F.length(t) > 1) & ~t.isin(*COMMON)))


def is_unsearchable(key: Column) -> Column:
    """Whether a key has no word that a look-up could go by."""
    return F.size(significant_tokens(F.coalesce(key, F.lit("")))) == 0


def match_is_consistent(asked: Column, found: Column) -> Column:
    """Whether two keys share a telling word, or, where one has none, are equal."""
    a, b = significant_tokens(asked), significant_tokens(found)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), asked == found).otherwise(F.arrays_overlap(a, b))


def alternative_queries(name: Column) -> Column:
    """Up to two further names to look up: the trade name, and the name before its first comma, dash or slash."""
    shorter = lambda main: F.trim(F.regexp_extract(main, r"^(.+?)(?:,|\s[-–/]\s)", 1))
    short = _let(search_name(name), lambda main: F.when((F.length(shorter(main)) > 3) & (F.lower(shorter(main)) != F.lower(main)), shorter(main)))
    return F.slice(F.array_distinct(F.array_compact(F.array(trade_name(name), short))), 1, 2)


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters in longest matching blocks."""
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)], dtype=float)
