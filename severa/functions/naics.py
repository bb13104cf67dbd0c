"""Industry codes: sectors, subsectors and the filters built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: NAICS 2022 sectors, id, official title and two-digit prefixes.
SECTORS = [
    ("11", "Agriculture, Forestry, Fishing and Hunting", ("11",)),
    ("21", "Mining, Quarrying, and Oil and Gas Extraction", ("21",)),
    ("22", "Utilities", ("22",)),
    ("23", "Construction", ("23",)),
    ("31-33", "Manufacturing", ("31", "32", "33")),
    ("42", "Wholesale Trade", ("42",)),
    ("44-45", "Retail Trade", ("44", "45")),
    ("48-49", "Transportation and Warehousing", ("48", "49")),
    ("51", "Information", ("51",)),
    ("52", "Finance and Insurance", ("52",)),
    ("53", "Real Estate and Rental and Leasing", ("53",)),
    ("54", "Professional, Scientific, and Technical Services", ("54",)),
    ("55", "Management of Companies and Enterprises", ("55",)),
    ("56", "Administrative and Support and Waste Management and Remediation Services", ("56",)),
    ("61", "Educational Services", ("61",)),
    ("62", "Health Care and Social Assistance", ("62",)),
    ("71", "Arts, Entertainment, and Recreation", ("71",)),
    ("72", "Accommodation and Food Services", ("72",)),
    ("81", "Other Services (except Public Administration)", ("81",)),
    ("92", "Public Administration", ("92",)),
]
PREFIXES = {p: sector for sector, _, ps in SECTORS for p in ps}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def sector_of(code: Column) -> Column:
    """Sector id by the code's first two digits, or null."""
    return _lookup(PREFIXES, F.substring(code, 1, 2))


def sector_name(sector: Column) -> Column:
    return _lookup({s: n for s, n, _ in SECTORS}, sector)


def subsector_of(code: Column) -> Column:
    """First three digits where the sector is known, or null."""
    return F.when((F.length(code) >= 3) & sector_of(code).isNotNull(), F.substring(code, 1, 3))


def if_trusted(code: Column, confidence: Column) -> Column:
    """The code, or null if enrichment gave it less than full confidence; without a confidence it is the filing's own."""
    return F.when(confidence.isNull() | (confidence >= 1.0), code)


def industry_filter(code: Column, industry: str | None = None, subsector: str | None = None, known_subsectors: frozenset[str] | None = None) -> Column:
    """A three-digit subsector, if known, wins over the sector; an unknown pair filters nothing."""
    if subsector and len(subsector) == 3 and subsector[:2] in PREFIXES and (known_subsectors is None or subsector in known_subsectors):
        return F.substring(code, 1, 3) == subsector
    prefixes = [p for p, s in PREFIXES.items() if s == industry]
    return F.substring(code, 1, 2).isin(prefixes) if prefixes else F.lit(True)
