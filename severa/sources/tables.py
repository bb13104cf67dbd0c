"""Readers of source files as rows: delimited files by column synonyms, JSON series, HTML tables, bundles, office files."""

from __future__ import annotations

import csv
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from severa.functions import text
from severa.grouping import in_frames

#: Names that sources give the fields of a notice.
SYNONYMS = {
    "employer": ("employer", "company", "company name", "employer name", "business name"),
    "notice_date": ("notice date", "date of notice", "warn date", "received date", "date received"),
    "effective_date": ("effective date", "layoff date", "date of layoff", "separation date"),
    "layoff_count": ("no. of employees", "number of employees", "employees affected", "number affected", "workers", "count"),
    "city": ("city", "location", "town"),
    "address": ("address", "street address"),
    "closure": ("layoff/closure", "closure/layoff", "type", "closure type", "notice type"),
}

_PARSERS: dict[str, Callable[[bytes], list[dict]]] = {}


def parser(state: str) -> Callable:
    """Register a parser of a state's file: bytes -> rows as dicts of strings."""

    def keep(f: Callable[[bytes], list[dict]]) -> Callable[[bytes], list[dict]]:
        _PARSERS[state.upper()] = f
        return f

    return keep


def parser_of(state: str) -> Callable[[bytes], list[dict]]:
    return _PARSERS[state.upper()]


def states() -> list[str]:
    return sorted(_PARSERS)


def by_synonyms(rows: DataFrame, as_of, synonyms: dict = SYNONYMS) -> DataFrame:
    """Rows of any headers -> the notice's fields as typed columns; rows without an employer or a date are dropped."""
    plain = {" ".join(c.lower().split()): c for c in rows.columns}

    def pick(field: str) -> Column:
        found = [text.as_str(F.col(f"`{plain[s]}`").cast("string")) for s in synonyms[field] if s in plain]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = rows.select(
        pick("employer").alias("employer"), text.as_date(pick("notice_date"), as_of).alias("notice_date"), text.as_date(pick("effective_date"), as_of).alias("effective_date"),
        text.as_int(pick("layoff_count")).alias("layoff_count"), pick("city").alias("city"), pick("address").alias("address"), text.closure_category(pick("closure")).alias("closure_category"),
    )
    return out.where("employer is not null and notice_date is not null")


def read_delimited(spark: SparkSession, path: str, as_of, separator: str = ",") -> DataFrame:
    return by_synonyms(spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").option("sep", separator).csv(path), as_of)


SERIES = "struct<Results:struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string>>>>>>"


def series_rows(payload: Column) -> Column:
    """A labour-statistics response -> array of (series_id, period 'YYYY-MM', value); yearly means and non-numbers go."""
    parsed = F.from_json(payload, SERIES)
    each = F.flatten(F.transform(parsed["Results"]["series"], lambda s: F.transform(s["data"], lambda d: F.struct(s["seriesID"].alias("series_id"), F.concat(d["year"], F.lit("-"), F.substring(d["period"], 2, 2)).alias("period"), d["value"].try_cast("double").alias("value"), d["period"].alias("raw")))))
    good = F.filter(each, lambda r: r["raw"].rlike("^M(0[1-9]|1[0-2])$") & r["value"].isNotNull())
    return F.transform(good, lambda r: F.struct(r["series_id"], r["period"], r["value"]))


def year_windows(first: Column, last: Column, span: int) -> Column:
    """Consecutive windows of at most `span` years."""
    return F.transform(F.sequence(first, last, F.lit(span)), lambda y: F.struct(y.alias("from_year"), F.least(y + span - 1, last).alias("to_year")))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(html: str) -> list[list[list[str]]]:
    found = _Tables()
    found.feed(html)
    return found.tables


def table_rows(cells: list[list[str]], wanted: tuple[str, ...] = ("employer", "company")) -> list[dict[str, str]]:
    """Rows under the first row that names a wanted column, by its headers."""
    for i, row in enumerate(cells):
        heads = [" ".join(c.lower().split()) for c in row]
        if any(w in h for h in heads for w in wanted):
            return [dict(zip(heads, r, strict=False)) for r in cells[i + 1 :] if any(r)]
    return []


def read_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages -> the rows of their tables: all columns of the page but html, and row (map<string,string>)."""
    keys = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = ((*[r[k] for k in keys], row) for r in batch.to_dict("records") for t in html_tables(r[html] or "") for row in table_rows(t))
            yield from in_frames(out, [*keys, "row"])

    return pages.select(*keys, html).mapInPandas(run, f"{schema}, row map<string,string>")


def untar(content: bytes) -> list[tuple[str, bytes]]:
    """Members of a gzipped bundle by name."""
    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
        return [(m.name, tar.extractfile(m).read()) for m in sorted((m for m in tar.getmembers() if m.isfile()), key=lambda m: m.name)]


def sniff(content: bytes, name: str = "") -> str:
    """pdf, docx, xlsx, html, csv or text, by the first bytes and then the name."""
    if content[:4] == b"%PDF":
        return "pdf"
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
        return "xlsx" if any(n.startswith("xl/") for n in names) else "docx" if any(n.startswith("word/") for n in names) else "zip"
    if content[:512].lstrip()[:1] == b"<":
        return "html"
    return "csv" if name.lower().endswith(".csv") else "text"


def xlsx_cells(content: bytes) -> list[list[str]]:
    """The first sheet's cells as text, from the file's own XML."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")] if "xl/sharedStrings.xml" in names else []
        sheet = ElementTree.fromstring(z.read(sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]))
    rows = []
    for r in sheet.iter(f"{space}row"):
        row: list[str] = []
        for c in r.iter(f"{space}c"):
            column = 0
            for ch in (x for x in c.get("r", "") if x.isalpha()):
                column = column * 26 + ord(ch) - 64
            row += [""] * max(0, column - 1 - len(row))
            value = c.find(f"{space}v")
            inline = "".join(t.text or "" for t in c.iter(f"{space}t"))
            row.append(shared[int(value.text)] if c.get("t") == "s" and value is not None else inline or (value.text if value is not None else ""))
        rows.append(row)
    return rows


def docx_text(content: bytes) -> str:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in body.iter(f"{space}p"))


def parse_files(files: DataFrame) -> DataFrame:
    """files (state, path, content) -> state, path, row (map<string,string>), each file by its state's parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((s, p, row) for s, p, c in zip(batch["state"], batch["path"], batch["content"], strict=True) for row in parser_of(s)(bytes(c)))
            yield from in_frames(rows, ["state", "path", "row"])

    return files.select("state", "path", "content").mapInPandas(run, "state string, path string, row map<string,string>")


def read_trimmed(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """A delimited file by its headers in lower case without the blanks around them; values are trimmed too."""
    rows = spark.read.option("header", True).option("sep", separator).option("ignoreLeadingWhiteSpace", False).csv(path)
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip().lower()) for c in rows.columns])


def read_files(spark: SparkSession, path: str, state: str) -> DataFrame:
    """Files of a state through its registered parser: path, row."""
    parse = parser_of(state)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from in_frames(((p, row) for p, c in zip(batch["path"], batch["content"], strict=True) for row in parse(bytes(c))), ["path", "row"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row map<string,string>")


@parser("CA")
def _workbook(content: bytes) -> list[dict]:
    return table_rows(xlsx_cells(content))


@parser("AL")
def _page(content: bytes) -> list[dict]:
    return [row for t in html_tables(content.decode("utf-8", "replace")) for row in table_rows(t)]


@parser("KY")
def _delimited(content: bytes) -> list[dict]:
    return table_rows(list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace")))))
