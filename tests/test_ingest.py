"""Readers of extracted sources, places and alerting rules on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from severa.operators import enrich, places
from severa.sources import extracted, letters, sinks

D = datetime.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_column_rows(spark):
    texts = [
        (1, "Title\n\n Company   Notice Date   Affected \nA & B Co   1/2/2020   5\n\nC   3/4/2021   7\nPage 1 of 2\nnote of  two"),
        (2, "no header  at all\nA  1/2/2020  5"), (3, None), (4, ""), (5, "Company  Notice Date  Affected"),
    ]
    pages = spark.createDataFrame(texts, "page int, body string")
    rows = extracted.column_rows(pages, "page", "body", ("company", "notice date", "affected")).collect()
    assert sorted(map(tuple, rows)) == [(1, "A & B Co", "1/2/2020", "5"), (1, "C", "3/4/2021", "7")]


def test_pages(spark):
    html = '<TABLE><tr><th>x</th></tr><tr class="a"><td><a class="b" href="/n/1">R&amp;D <b>Ltd</b></a></td><td> 1/2/2020 </td><td></td></tr></TABLE>'
    rows = extracted.listing(spark.createDataFrame([(html,), (None,), ("",)], "html string"), "html").collect()
    assert [(r.url, r["name"], r.cells) for r in rows] == [("/n/1", "R&D Ltd", ["1/2/2020", ""])]
    assert one(spark, extracted.fields(F.lit("<dl><dt>City:</dt> <dd>A</dd><dt>city</dt><dd>B <i>C</i></dd><dt>Empty</dt><dd></dd></dl>"))) == {"city": "B C", "empty": ""}
    assert one(spark, extracted.fields(F.lit("<p>none</p>"))) == {}
    assert one(spark, extracted.html_text(F.lit("<script>var a='<b>';</script><p>one<br>two</p>\n<style>p{}</style>"))) == "one two"
    kinds = [(b"%PDF-1.7", "a"), (b"PK\x03\x04", "b.xlsx"), (b"\n<html>", "c"), (b"a,b", "D.CSV"), (b"", "e"), (b"plain", None)]
    got = spark.createDataFrame(kinds, "c binary, n string").select(extracted.sniffed(F.col("c"), F.col("n")).alias("k")).collect()
    assert [r.k for r in got] == ["pdf", "zip", "html", "csv", "text", "text"]


def test_letters(spark):
    letter = "Positions:\nClerk\t12\nSenior Clerk (night)   3\nTotal affected employees: fifteen\n"
    assert [tuple(x) for x in one(spark, letters.occupations(F.lit(letter), F.lit(15)))] == [("Clerk", 12), ("Senior Clerk (night)", 3)]
    assert one(spark, letters.occupations(F.lit(letter), F.lit(16))) == [] and one(spark, letters.occupations(F.lit("nothing"), F.lit(4))) == []
    assert one(spark, letters.labelled_count(F.lit("Number Affected: 1,204"))) == 1204 and one(spark, letters.labelled_count(F.lit("Number Affected: n/a"))) is None


def test_places(spark):
    known = spark.createDataFrame([("S", "Port Lane", 1), ("S", "Lane", 2), ("T", "Lane", 3)], "state string, city string, id int")
    rows = spark.createDataFrame([(1, "S", "5 Main St, PORT LANE"), (2, "S", "9 Long lane"), (3, "T", "9 Port Lane"), (4, "T", "nowhere"), (5, "S", None), (6, None, "Lane"), (7, "S", "")], "k int, state string, address string")
    assert {r.k: (r.city, r.id) for r in places.city_from_tail(rows, "k", "state", "address", known).collect()} == {1: ("Port Lane", 1), 2: ("Lane", 2), 3: ("Lane", 3)}
    labels = spark.createDataFrame([(1, "S", "Acme - Lane"), (2, "S", "Acme (Lane)"), (3, "S", "Acme - West"), (4, "S", "Acme"), (5, "S", None)], "k int, state string, label string")
    got = {r.k: (r.employer, r.city) for r in places.split_label(labels, "k", "label", "state", known).collect()}
    assert got == {1: ("Acme", "Lane"), 2: ("Acme", "Lane"), 3: ("Acme - West", None), 4: ("Acme", None), 5: (None, None)}
    sites = spark.createDataFrame([(1, "S", "A", None), (2, "S", "A", "1"), (3, "S", "B", None), (4, "S", "B", None), (5, "S", None, "1"), (6, "S", "C", None)], "location_id long, state string, city string, zip string")
    found = spark.createDataFrame([(1, "1"), (2, "9"), (3, "7"), (4, "7"), (5, "1")], "location_id long, zip string")
    assert {r.location_id: (r.zip, r.target_id) for r in places.rebind(sites, found).collect()} == {1: ("1", 2), 2: ("1", 2), 3: ("7", 3), 4: ("7", 3), 5: ("1", 5), 6: (None, 6)}


def test_rules(spark):
    runs = spark.createDataFrame([("a", i, s) for i, s in enumerate(["ok", "bad", "ok", "ok"])] + [("b", 0, None), ("b", 1, None), ("c", 0, "ok"), ("c", 1, None)], "k string, i int, status string")
    assert {(r.k, r.status, r.streak) for r in enrich.streaks(runs, "k", "status", ["i"]).collect()} == {("a", "ok", 2), ("b", None, 2), ("c", None, 1)}
    tries = spark.createDataFrame([(1, 500), (1, 429), (2, 500), (3, None), (3, 200)], "n int, status int")
    assert {(r.n, r.done) for r in enrich.post_states(tries, ["n"]).collect()} == {(1, True), (2, False), (3, True)}
    rows = spark.createDataFrame([(1, D(2020, 1, 1), datetime.datetime(2020, 1, 5)), (2, D(2019, 1, 1), datetime.datetime(2020, 1, 5)), (3, None, datetime.datetime(2020, 1, 5)), (4, D(2020, 2, 1), datetime.datetime(2020, 1, 5))], "i int, notice_date date, scraped_at timestamp")
    assert [r.i for r in enrich.fresh(rows, 183).collect()] == [1]
    seen = spark.createDataFrame([("u", 1, "x"), ("u", 2, "x"), ("u", 3, None), ("u", 4, None), ("v", 1, None)], "u string, i int, c string")
    assert sorted((r.u, r.i) for r in enrich.changes(seen, ["u"], ["i"], F.col("c")).collect()) == [("u", 1), ("u", 3)]
    assert one(spark, sinks.gauge("g", F.lit(3), state=F.lit('a"b\\c'))) == 'g{state="a\\"b\\\\c"} 3'
    assert one(spark, sinks.feed_item(F.lit("a<b & c"), F.lit("1"), F.lit(D(2020, 3, 4)))) == '<item><title>a&lt;b &amp; c</title><guid isPermaLink="false">1</guid><pubDate>Wed, 04 Mar 2020 00:00:00 GMT</pubDate></item>'


def test_bundles_and_workbooks(spark):
    files = spark.createDataFrame([("k", "b.txt", b"2"), ("k", "a.txt", b""), ("l", "c", b"\x00x")], "key string, member string, content binary")
    got = [(r.key, r.member, bytes(r.content)) for r in extracted.members(extracted.bundle(files, "key"), "key").collect()]
    assert sorted(got) == [("k", "a.txt", b""), ("k", "b.txt", b"2"), ("l", "c", b"\x00x")]
