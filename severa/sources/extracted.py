"""Rows out of text, pages, bundles and workbooks that were fetched before."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.grouping import fold_groups
from severa.sources.tables import untar


def column_rows(pages: DataFrame, key: str, body: str, columns: tuple[str, ...]) -> DataFrame:
    """Texts of tables with fixed columns -> key and the columns as text, a row for each line under the first line that
    names them all. Columns are parted by two blanks or more; lines of another number of columns are no rows."""
    lines = F.transform(F.split(F.col(body), "\n"), lambda s: F.split(F.trim(s), " {2,}"))
    heads = F.transform(lines, lambda c: F.transform(c, F.lower))
    named = lambda c: F.size(F.array_intersect(c, F.array(*map(F.lit, columns)))) == len(columns)
    at = pages.select(key, lines.alias("lines"), F.array_position(F.transform(heads, named), True).cast("int").alias("at"), heads.alias("heads")).where("at > 0")
    each = at.select(key, F.col("heads")[F.col("at") - 1].alias("head"), F.explode(F.slice("lines", F.col("at") + 1, F.size("lines"))).alias("cells"))
    rows = each.where(F.size("cells") == F.size("head")).withColumn("row", F.map_from_arrays("head", "cells"))
    return rows.select(key, *[F.col("row")[c].alias(c) for c in columns])


def _plain(s: Column) -> Column:
    s = F.regexp_replace(s, "<[^>]*>", " ")
    for reference, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(reference), F.lit(character))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def html_text(html: Column) -> Column:
    """A page's text: no scripts, styles or tags, single blanks. Character references stay."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def listing(pages: DataFrame, html: str) -> DataFrame:
    """Search pages -> url, name, cells: the table rows that link somewhere, with the texts of their other cells."""
    rows = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("tr"))
    link = r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    cells = F.regexp_extract_all(F.regexp_replace("tr", r"(?is)<td\b[^>]*>\s*<a\b.*?</td>", ""), F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    return rows.where(F.col("tr").rlike(link)).select(F.regexp_extract("tr", link, 1).alias("url"), _plain(F.regexp_extract("tr", link, 2)).alias("name"), F.transform(cells, _plain).alias("cells"))


def fields(html: Column) -> Column:
    """Labels and values of a detail page's lists as a map, labels in lower case without a colon; the last of equals wins."""
    pair = r"(?is)<dt\b[^>]*>(.*?)</dt>\s*<dd\b[^>]*>(.*?)</dd>"
    labels, values = (F.regexp_extract_all(html, F.lit(pair), F.lit(i)) for i in (1, 2))
    entries = F.transform(F.arrays_zip(labels.alias("k"), values.alias("v")), lambda e: F.struct(F.lower(F.regexp_replace(_plain(e["k"]), ":$", "")).alias("k"), _plain(e["v"]).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def sniffed(content: Column, name: Column) -> Column:
    """pdf, zip (workbooks and documents are zips), html, csv or text, by the first bytes and then the name."""
    head = F.substring(content, 1, 512)
    start = F.regexp_replace(F.decode(F.substring(head, 1, 64), "ISO-8859-1"), r"^[\s\x{FEFF}]+", "")
    return F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf").when(F.substring(content, 1, 2) == F.lit(b"PK"), "zip").when(start.startswith("<"), "html").when(F.lower(name).endswith(".csv"), "csv").otherwise("text")


def bundle(files: DataFrame, key: str) -> DataFrame:
    """files (key, member, content) -> key, content: a gzipped bundle of each key's files, which one task holds."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for name, content in zip(rows["member"], rows["content"], strict=True):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(bytes(content)))
        return pd.DataFrame({key: [rows[key].iloc[0]], "content": [out.getvalue()]})

    return files.groupBy(key).applyInPandas(pack, f"{key} {files.schema[key].dataType.simpleString()}, content binary")


def members(bundles: DataFrame, key: str) -> DataFrame:
    """Bundles (key, content) -> key, member, content, by name inside a bundle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, content in zip(batch[key], batch["content"], strict=True):
                found = untar(bytes(content))
                yield pd.DataFrame({key: [k] * len(found), "member": [n for n, _ in found], "content": [c for _, c in found]})

    return bundles.select(key, "content").mapInPandas(run, f"{key} {bundles.schema[key].dataType.simpleString()}, member string, content binary")


def workbooks(rows: DataFrame, key: str, columns: list[str], title: str) -> DataFrame:
    """rows -> key, path, content: a workbook of each key's rows under a title line and the headers, as inline text."""

    def cell(value: str) -> str:
        return f'<c t="inlineStr"><is><t>{escape(value or "")}</t></is></c>'

    def write(own: dict[str, list]) -> list[tuple]:
        lines = [[title], columns, *zip(*(own[c] for c in columns), strict=True)]
        body = "".join(f"<row>{''.join(map(cell, line))}</row>" for line in lines)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
        return [(own[key][0], out.getvalue())]

    return fold_groups(rows, key, write, "path string, content binary", ["path", "content"])
