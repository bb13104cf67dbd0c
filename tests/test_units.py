"""Invariants and operators on hand-made rows."""

import datetime
import io
import math
import random
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from severa.functions import names, naics, text
from severa.functions import likeness
from severa.operators import dedup, events, filters, linkage, outlook, standing, timeline, validate
from severa.operators.graph import connected_components
from severa.sources import letters, sinks, tables
from severa.staging import stage
from severa.streaming import streams

D = datetime.date
NOTICE = "notice_id long, state string, employer string, notice_date date, layoff_count long, closure_category string, is_superseded boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def notices(spark):
    rows = [(1, "CA", "A", D(2024, 1, 1), 100, "Layoff", False), (2, "CA", "A", D(2024, 3, 31), None, None, False), (3, "CA", "B", D(2024, 4, 1), 7, "Non-WARN", False), (4, "NY", "B", D(2024, 2, 29), 5, "Closure", True), (5, "NY", "C", None, 9, "Closure", False)]
    return spark.createDataFrame(rows, NOTICE)


def test_counting_rules(notices):
    got = {r.state: (r.notice_count, r.layoff_total) for r in filters.counted(notices).groupBy("state").agg(*filters.totals()).collect()}
    assert got == {"CA": (2, 100), "NY": (1, 9)}
    assert filters.counted(notices, after=D(2024, 1, 1), before=D(2024, 3, 31)).count() == 2
    assert filters.counted(notices, "Non-WARN").count() == 1
    assert filters.listed(notices, min_layoffs=0).count() == 4 and filters.listed(notices, min_layoffs=7).count() == 3
    assert filters.listed(notices, bbox=(1, None, 2, 3)).count() == 4
    assert filters.counted(notices.limit(0)).groupBy("state").agg(*filters.totals()).count() == 0
    assert [r.notice_count for r in timeline.over_time(filters.counted(notices)).orderBy("period").collect()] == [1, 1]


def test_pace_projection(spark):
    periods = spark.createDataFrame([("2024-01", 5, 50), ("2024-02", 4, 40)], "period string, notice_count long, layoff_total long")
    last = lambda d, **o: [r.projected_notices for r in timeline.project_pace(periods, d, **o).orderBy("period").collect()][-1]
    assert last(D(2024, 2, 10)) == 12  # 4 * 29 / 10 = 11.6
    assert last(D(2024, 2, 29)) is None and last(D(2024, 2, 2)) is None
    assert last(D(2024, 2, 10), before=D(2024, 2, 5)) is None and last(D(2024, 2, 10), after=D(2024, 2, 3)) is None
    assert last(D(2024, 3, 10)) is None


@pytest.mark.parametrize(("raw", "want"), [("1,604", 1604), ("50, 60", None), ("12.9", 12), (" 7 ", 7), ("", None), (None, None), ("1e3", 1000), ("n/a", None), ("1,23", None)])
def test_as_int(spark, raw, want):
    assert one(spark, text.as_int(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("Layoff and Closure", None), ("CL", "Closure"), ("clinic", None), ("Red in Force", "Layoff"), ("wr", "Layoff"), ("Shutdown", "Closure"), (None, None), ("lay-off", "Layoff")])
def test_closure(spark, raw, want):
    assert one(spark, text.closure_category(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("The Boeing Company", "boeing"), ("Inc", "inc"), ("(77) Harbor Diner", "harbor diner"), ("Depot 8 Cafe #12", "depot 8 cafe"), ("Acme Co., Inc.", "acme"), (None, "")])
def test_company_key(spark, raw, want):
    assert one(spark, text.company_key(F.lit(raw).cast("string"))) == want


def test_text_functions(spark):
    assert one(spark, text.website_domain(F.lit("http://user@WWW.Boeing.com:80/x"))) == "boeing.com"
    assert one(spark, text.website_domain(F.lit("N/A"))) == ""
    assert one(spark, text.county_name(F.lit("Cook  (and other counties)"))) == "Cook"
    assert one(spark, text.county_name(F.lit("Balto Co."))) == "Balto"
    assert one(spark, text.city_from_address(F.lit("1 Main St, San Diego, CA 92101"))) == "San Diego"
    assert one(spark, text.zip_from(F.lit("x"), F.lit("a 123456 b 92101-0001"))) == "92101"
    assert one(spark, text.as_date(F.lit("3/7/2024"), D(2024, 1, 1))) == D(2024, 3, 7)
    assert one(spark, text.as_date(F.lit("0225-01-01"), D(2024, 1, 1))) is None
    assert sorted(one(spark, text.trigrams(F.lit("cat")))) == ["  c", " ca", "at ", "cat"]
    assert one(spark, naics.sector_of(F.lit("3361"))) == "31-33" and one(spark, naics.subsector_of(F.lit("99123"))) is None


def test_gate_and_rules(spark, notices):
    gate = validate.batch_gate(notices, ["state"], 1, 10).collect()
    assert {r.state: r.passes for r in gate} == {"CA": True, "NY": False}
    rows = spark.createDataFrame([(D(2025, 1, 1), None), (D(2024, 1, 1), None), (D(2025, 1, 1), D(2025, 2, 1))], "notice_date date, effective_date date")
    got = [(r.notice_date, r.effective_date) for r in validate.insert_rules(rows, D(2024, 6, 1)).collect()]
    assert got == [(D(2024, 6, 1), D(2025, 1, 1)), (D(2024, 1, 1), D(2024, 3, 1)), (D(2024, 6, 1), D(2025, 2, 1))]


VERSION = "notice_id long, state string, employer string, notice_date date, layoff_count long, scraped_at long, address string, city string, zip string"


def superseded(spark, *rows):
    table = spark.createDataFrame([(i, "CA", e, D(2024, 1, 1), n, s, a, c, z) for i, e, n, s, a, c, z in rows], VERSION)
    return {(r.superseded_id, r.by_id, r.case) for r in dedup.resolve_supersession(dedup.supersession_pairs(table)).collect()}


def test_supersession(spark):
    assert superseded(spark, (1, "Acme ", 5, 0, None, "X", None), (2, "acme", 5, 1, None, "X", "1")) == {(1, 2, 0)}
    assert superseded(spark, (1, "A", 5, 0, None, "X", "1"), (2, "A", 6, 1, None, "X", "1")) == {(1, 2, 1)}
    assert superseded(spark, (1, "A", 5, 3, "m", "X", None), (2, "A", 6, 1, "m", "Y", "1")) == {(1, 2, 2)}
    assert superseded(spark, (1, "A", 5, 0, None, None, None), (2, "A", 5, 0, None, "X", "1")) == {(1, 2, 3)}
    # 1 falls to 2 in an earlier case, so 3 can't fall to 1
    assert superseded(spark, (1, "A", 5, 0, None, "X", None), (2, "A", 5, 1, None, "X", "1"), (3, "A", 9, -1, None, "X", None)) == {(1, 2, 0)}
    assert superseded(spark, (1, "A", 5, 0, None, "X", None), (2, "B", 5, 0, None, "X", "1")) == set()


def test_worksites(spark):
    rows = spark.createDataFrame([(1, "E1", "S", D(2024, 1, 1), "a", 5, None, 0), (1, "E2", "S", D(2024, 1, 1), "a", 5, None, 1), (1, "E3", "S", D(2024, 1, 1), "b", 5, None, 2), (2, "F", "S", D(2024, 1, 1), "a", None, None, 0)], "notice_id long, employer string, state string, notice_date date, address string, layoff_count long, effective_date date, ord int")
    got = {r.notice_id: (r.employer, r.layoff_count, r.worksites) for r in dedup.merge_worksites(rows, F.col("ord")).collect()}
    assert got == {1: ("E1", 10, 2), 2: ("F", None, 1)}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", None), (2, None, 3)], "id long, f string, u long")
    new = spark.createDataFrame([(1, "b", 5), (2, "c", None), (3, "d", 1)], "id long, f string, u long")
    first = dedup.upsert(old, new, "id", ["f"], ["u"])
    assert {(r.id, r.f, r.u, r.is_new) for r in first.collect()} == {(1, "a", 5, False), (2, "c", 3, False), (3, "d", 1, True)}
    again = dedup.upsert(first.drop("is_new"), new, "id", ["f"], ["u"])
    assert {(r.id, r.f, r.u) for r in again.collect()} == {(r.id, r.f, r.u) for r in first.collect()} and again.where("is_new").count() == 0


def test_components_and_chains(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for a, b in pairs if a != b for n in (a, b)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    links = [(i, i + 1) for i in range(10, 40)] + [(1, 2), (2, 3), (3, 1), (5, 2), (50, None), (60, 60)]
    chains = {r.node: r.root for r in dedup.flatten_chains(spark.createDataFrame(links, "n long, t long"), "n", "t", stage).collect()}
    assert chains == {**{i: 40 for i in range(10, 40)}, 1: 1, 2: 1, 3: 1, 5: 1}


def test_minted_ids(spark):
    known = spark.createDataFrame([("b", 7)], "key string, id long")
    wanted = spark.createDataFrame([("c",), ("a",), ("b",), (None,), ("a",)], "key string")
    assert {r.key: r.id for r in dedup.mint_ids(known, wanted, "key", "id").collect()} == {"b": 7, "a": 8, "c": 9}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=40), st.integers(0, 60))
def test_anchor_rule(days, gap):
    """The streaming form's rule, which the fold shares: chained from starts."""
    start, opened = None, []
    for d in sorted(set(days)):
        if start is None or d > start + gap:
            start = d
            opened.append(d)
    assert all(b > a + gap for a, b in zip(opened, opened[1:], strict=False)) and opened[0] == min(days)


def test_anchored_starts(spark):
    assert one(spark, events.anchored_starts(F.array(*[F.lit(x) for x in (1, 5, 40, 60, 75)]), 30)) == [1, 40, 75]


def test_events_never_read_the_future(spark):
    rows = [(c, "CA" if d % 2 else "NY", D(2020, 1, 1) + datetime.timedelta(d), 10, "Layoff") for c, d in ((1, 0), (1, 10), (1, 45), (1, 45), (2, 45), (1, 500), (None, 45))]
    table = spark.createDataFrame(rows, "company long, state string, notice_date date, layoff_count long, closure_category string")
    whole = {(r.company, r.day): r for r in events.build_events(table, D(2022, 1, 1)).collect()}
    cut = {(r.company, r.day): r for r in events.build_events(table, D(2020, 3, 1)).collect()}
    base = (D(2020, 1, 1) - D(1970, 1, 1)).days
    assert set(whole) == {(1, base), (1, base + 45), (1, base + 500), (2, base + 45)}
    seen = ("day_notices", "prior_notices_1y", "prior_layoffs", "prior_events", "prior_states", "us_notices_90d", "state_notices_90d", "days_since_prev")
    assert all(getattr(whole[k], f) == getattr(cut[k], f) for k in cut for f in seen)
    r = whole[(1, base + 45)]
    assert (r.day_notices, r.prior_notices_1y, r.prior_layoffs, r.prior_events, r.next_gap_days, r.label) == (2, 2, 20, 1, 455, 0)


def test_coverage_mask(spark):
    def usable(counts, unseen=0):
        rows = [("k", f"{2000 + i // 12}-{i % 12 + 1:02}", n, i >= unseen) for i, n in enumerate(counts)]
        out = events.usable_months(spark.createDataFrame(rows, "state string, month string, n long, seen boolean"), "state", "month", "n", "seen")
        return [r.usable for r in out.orderBy("month").collect()]

    assert usable([0, 9, 8, 9, 0, 0, 9, 9, 10, 9, 0, 0], unseen=1) == [False, True, True, True, False, False, True, True, True, True, False, False]
    assert usable([1, 0, 2, 0, 1, 1]) == [True] * 6  # single zeros are usual at a level of one
    assert usable([2, 2, 2, 0, 0, 0, 0, 2, 2, 2, 2]) == [True] * 3 + [False] * 4 + [True] * 4
    assert usable([2, 2, 2, 0, 0, 0, 2, 2, 2, 2]) == [True] * 10  # exp(-6) is over a thousandth
    assert usable([40] * 8 + [12]) == [True] * 8 + [False]
    assert usable([40] * 8 + [0] * 7) == [True] * 8 + [False] * 7  # six at the end, the seventh as a run of zeros
    assert usable([0, 0], unseen=2) == [False, False]
    got = one(spark, events.poisson_cdf(F.lit(900), F.lit(1000.0)))
    assert abs(got - 0.000675) < 1e-4 and abs(one(spark, events.poisson_cdf(F.lit(2), F.lit(3.0))) - 8.5 * math.exp(-3)) < 1e-3


def test_q_values(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = {r.p: r.q for r in events.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()}
    assert got == pytest.approx({0.01: 0.04, 0.03: 0.04 / 3 * 4, 0.04: 0.04 / 3 * 4, 0.5: 0.5})


def test_q_values_over_ranges(spark):
    """Null keys and p, ties, and a key whose tests lie in several ranges, against the plain rule; no window holds a key."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, 0.5, 0.001, rnd.random()])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, key string, p double").repartition(7)
    for keys in ((), ("key",)):
        got = events.benjamini_hochberg(df, "p", *keys)
        assert got.columns == ["id", "key", "p", "q"]
        want = {}
        for key in ({r[1] for r in rows} if keys else {0}):
            own = sorted((r for r in rows if not keys or r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
            least = 1.0
            for i in range(len(own), 0, -1):
                least = least if own[i - 1][2] is None else min(least, own[i - 1][2] * len(own) / i)
                want[own[i - 1][0]] = least
        assert {r.id: r.q for r in got.collect()} == want
    plan = events.benjamini_hochberg(df, "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan and "_range" in plan


def test_t_tail():
    for t, df, want in ((2.0, 10, 0.0733880), (1.0, 1, 0.5), (0.0, 5, 1.0), (4.5, 30, 0.0000958)):
        assert outlook.t_tail(t, df) == pytest.approx(want, abs=1e-6)


def months(n):
    return [f"{2010 + i // 12}-{i % 12 + 1:02d}" for i in range(n)]


def poisson(rnd, lam):
    limit, k, p = math.exp(-lam), 0, rnd.random()
    while p > limit:
        p *= rnd.random()
        k += 1
    return k


def test_trend_finds_what_is_planted_and_little_else():
    rnd = random.Random(2)
    planted = outlook.fit_trend([poisson(rnd, 10 * 1.5 ** (i / 12)) for i in range(36)], months(36))
    assert planted["p"] < 0.01 and 0.2 < planted["coef"] < 0.6
    false = sum(outlook.fit_trend([poisson(rnd, 12) for _ in range(36)], months(36))["p"] < 0.05 for _ in range(200))
    assert false / 200 <= 0.09
    assert outlook.fit_trend([1] * 10, months(10)) is None and outlook.fit_trend([0] * 40, months(40)) is None


def test_forecasts():
    flat = outlook.forecast([20 + i % 3 for i in range(40)])
    assert flat and all(lo <= p <= hi and 15 <= p <= 27 for p, lo, hi in flat[1])
    season = outlook.forecast([30 + 20 * (i % 12 == 5) for i in range(60)])
    assert season[0] == "ets-seasonal" and max(p for p, _, _ in season[1]) >= 40
    assert outlook.forecast([1, 2, 3]) is None


def test_linkage(spark):
    assert likeness.jaro_winkler(np.array(["martha", "a"], object), np.array(["marhta", "b"], object)) == pytest.approx([0.9611, 0], abs=1e-4)
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.85), (1, 3, 0.1), (4, 5, 0.95)], "a long, b long, score double")
    got = {r.node: r.cluster for r in linkage.cluster_pairs(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    capped = {r.node: r.cluster for r in linkage.cluster_pairs(pairs, most=2).collect()}
    assert capped == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_files(spark, tmp_path):
    html = b"<html><table><tr><td>Notices</td></tr><tr><th>Company</th><th>Workers</th></tr><tr><td>A &amp; B</td><td>5<br>6</td></tr></table></html>"
    assert tables.table_rows(tables.html_tables(html.decode())[0]) == [{"company": "A & B", "workers": "5 6"}]
    (tmp_path / "al.html").write_bytes(html)
    assert [r.row["company"] for r in tables.read_files(spark, f"file://{tmp_path}/al.html", "al").collect()] == ["A & B"]
    sheet = b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Company</t></is></c><c r="C2" t="inlineStr"><is><t>No.</t></is></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>Acme</t></is></c><c r="C3"><v>12</v></c></row></sheetData></worksheet>'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert tables.parser_of("ca")(book.getvalue()) == [{"company": "Acme", "": "", "no.": "12"}]
    assert (tables.sniff(book.getvalue()), tables.sniff(html), tables.sniff(b"%PDF-1.4"), tables.sniff(b"a,b", "x.csv")) == ("xlsx", "html", "pdf", "csv")
    bundle = io.BytesIO()
    with tarfile.open(fileobj=bundle, mode="w:gz") as tar:
        for name in ("b", "a"):
            info = tarfile.TarInfo(name)
            info.size = 1
            tar.addfile(info, io.BytesIO(name.encode()))
    assert tables.untar(bundle.getvalue()) == [("a", b"a"), ("b", b"b")]
    (tmp_path / "x.csv").write_text('Company,Notice Date,No. of Employees,Layoff/Closure\n"Acme, Inc",2024-01-05,"1,200",Closure\n,2024-01-06,5,\nB,bad,5,\n')
    got = tables.read_delimited(spark, f"file://{tmp_path}/x.csv", D(2024, 1, 1)).collect()
    assert [(r.employer, r.layoff_count, r.closure_category) for r in got] == [("Acme, Inc", 1200, "Closure")]


def test_letters(spark):
    say = lambda s: one(spark, letters.affected_workers(F.lit(s)))
    assert say("A total of 73 employees; we will affect 5 employees.") == 73
    assert say("will affect 205 employees in A. will affect 206 employees in B.") is None
    assert say("laying off approximately 1,530 hourly workers") == 1530 and say("nothing") is None


def test_snapshot_guard(spark, notices, tmp_path):
    path = f"file://{tmp_path}/snap"
    assert sinks.snapshot(notices, path, "2024-01-01") == 5
    with pytest.raises(ValueError, match="not written"):
        sinks.snapshot(notices.limit(2), path, "2024-01-02")
    assert sinks.snapshot(notices, path, "2024-01-02") == 5 and sinks.days(spark, path) == [("2024-01-01", 5), ("2024-01-02", 5)]
    sinks.mirror(notices, f"file://{tmp_path}/mirror")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/mirror/csv").count() == 5


@pytest.fixture
def timers(spark):
    """The state store that keeps timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams_keep_state_by_bucket(spark, tmp_path, timers):
    """More keys than buckets, a null key beside key 0 and triggers that go on from state: as plain rules say, in a row of state a bucket."""
    rnd = random.Random(3)
    keys = [None, *range(1200)]
    rows = [(k, i, 86_400.0 * day + rnd.randint(0, 9)) for i, (k, day) in enumerate((k, day) for day in (9000, 9003, 9009, 9300) for k in keys for _ in range(rnd.randint(0, 2)))]
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[2], r[1]))
    allowed, starts, times, last = {}, set(), {}, {}
    for k, i, t in order:
        times[k] = [x for x in times.get(k, []) if x > t - 5 * 86_400]
        allowed[i] = len(times[k]) < 2
        times[k] += [t] * allowed[i]
        if k not in last or t // 86_400 > last[k] + 5:
            last[k] = int(t // 86_400)
            starts.add((k, last[k]))
    df = spark.createDataFrame(rows, "key long, event_id long, t double")
    for name, stream, want in (
        ("limits", lambda d: streams.limited(d, "key", 2, 5 * 86_400.0), set(allowed.items())),
        ("starts", lambda d: streams.anchored_events(d.select("key", F.floor(F.col("t") / 86_400).cast("int").alias("day")), 5), starts),
    ):
        held = []
        for step, end in enumerate((9005, 9100, 9400)):
            df.where(f"t < 86400D * {end}" + (f" and t >= 86400D * {(9005, 9100)[step - 1]}" if step else "")).write.parquet(f"file://{tmp_path}/{name}/in/step={step}")
            source = spark.readStream.schema("key long, event_id long, t double, step int").parquet(f"file://{tmp_path}/{name}/in")
            q = stream(source).writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}/out").option("checkpointLocation", f"file://{tmp_path}/{name}/at").trigger(availableNow=True).start()
            q.awaitTermination(120)
            held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        got = spark.read.parquet(f"file://{tmp_path}/{name}/out")
        assert {tuple(r) for r in got.select(*(("event_id", "allowed") if name == "limits" else ("key", "start"))).collect()} == want and got.count() == len(want)
        assert 0 < max(held) <= streams.BUCKETS + 1
    assert {r.event_id: r.allowed for r in streams.limited(df, "key", 2, 5 * 86_400.0).collect()} == allowed


def test_streams_agree_with_tables(spark, tmp_path, timers):
    rows = [(k, i, 1000.0 + t) for i, (k, t) in enumerate((i % 3, (i * 37) % 500) for i in range(120))]
    want, windows = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        w = windows[k] = [x for x in windows.get(k, []) if x > t - 60]
        want[i] = len(w) < 4
        if want[i]:
            w.append(t)
    schema = "key long, event_id long, t double"
    table = spark.createDataFrame(rows, schema)
    assert {r.event_id: r.allowed for r in streams.limited(table, "key", 4).collect()} == want
    table.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    assert {r.event_id: r.allowed for r in run_stream(streams.limited(source, "key", 4), "limited")} == want
    days = source.select("key", (F.col("t") / 10).cast("int").alias("day"))
    starts = {(r.key, r.start) for r in run_stream(streams.anchored_events(days, 7), "anchored")}
    folded = table.groupBy("key").agg(F.array_sort(F.collect_set((F.col("t") / 10).cast("int"))).alias("d")).select("key", F.explode(events.anchored_starts(F.col("d"), 7)).alias("start"))
    assert starts == {(r.key, r.start) for r in folded.collect()}
    stamped = source.withColumn("ts", F.timestamp_seconds(F.col("t") * 1000))
    counts = run_stream(streams.daily_counts(stamped, "key"), "daily", "complete")
    assert sum(r.calls for r in counts) == 120
    once = run_stream(streams.first_seen(stamped.withColumn("day", (F.col("t") / 100).cast("int")), "day", "ts", "30 days"), "once")
    assert len({r.day for r in once}) == len(once)


def test_state_goes_when_its_window_has_passed(spark, tmp_path):
    """Three triggers, each from the checkpoint of the one before: what the timers have cleared decides nothing."""
    day = 86_400.0
    slices = [[(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 4, 5.0)], [(3, 5, 10 * day)], [(1, 6, 10 * day + 1), (2, 7, 10 * day + 2), (3, 8, 10 * day + 3), (3, 9, 10 * day + 4)]]
    frames = [spark.createDataFrame(x, "key long, event_id long, t double").coalesce(1) for x in slices]
    out = streams.run_in_steps(frames, lambda source: streams.limited(source, "key", 2, 60.0), f"file://{tmp_path}/limited")
    assert {r.event_id: r.allowed for r in out.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True, 9: False}
    days = [spark.createDataFrame(x, "key long, day int").coalesce(1) for x in ([(1, 10), (1, 15), (2, 13)], [(1, 17), (2, 50)], [(1, 51), (2, 57), (2, 58)])]
    out = streams.run_in_steps(days, lambda source: streams.anchored_events(source, 7), f"file://{tmp_path}/anchored")
    assert sorted((r.key, r.start) for r in out.collect()) == [(1, 10), (1, 51), (2, 13), (2, 50), (2, 58)]


def test_standing_queries_of_odd_rows(spark):
    t = lambda h: datetime.datetime(2001, 1, 1, h)
    subs = spark.createDataFrame([(1, t(1)), (2, t(3)), (3, t(9)), (4, None), (5, t(1))], "sub_id long, seen timestamp")
    rows = spark.createDataFrame([(t(1),), (t(3),), (t(3),), (t(5),), (None,)], "at timestamp")
    got = {r.sub_id: (r.fresh, r.next_seen) for r in standing.since_marks(subs, rows, "at").collect()}
    assert got == {1: (3, t(5)), 2: (1, t(5)), 3: (0, None), 4: (0, None), 5: (3, t(5))}
    assert {r.fresh for r in standing.since_marks(subs, rows.limit(0), "at").collect()} == {0}

    rnd = random.Random(3)
    pick = lambda *x: rnd.choice([*x, None])
    asked = [(i, pick("a", "b"), pick("x", "y"), pick(1, 5, 9)) for i in range(60)]
    there = [(pick("a", "b", "c"), pick("x", "y"), pick(0, 1, 5, 7, 9), D(2001, 1, rnd.randrange(1, 28))) for _ in range(40)]
    df = standing.filter_matches(spark.createDataFrame(asked, "sub_id long, w_s string, w_c string, w_n long"), spark.createDataFrame(there, "s string, c string, n long, day date"), {"w_s": "s", "w_c": "c"}, ("w_n", "n"), "day")
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, s, c, n in asked:
        days = [d for a, b, m, d in there if (s is None or a == s) and (c is None or b == c) and (n is None or (m is not None and m >= n))]
        if days:
            want[i] = (len(days), max(days))
    assert {r.sub_id: (r.matches, r.latest) for r in df.collect()} == want


def test_run_log(spark, notices):
    class Log(dict):
        def done(self, i):
            return self.get(i) == "ok"

        def add(self, i, how):
            self[i] = how

    log, seen = Log(), []
    run = streams.run_log(lambda df: seen.append(df.count()), log)
    run(notices, 1)
    run(notices, 1)
    assert seen == [5] and log == {1: "ok"}
    with pytest.raises(ZeroDivisionError):
        streams.run_log(lambda df: 1 / 0, log)(notices, 2)
    assert log[2] == "failed"


def test_series_is_skipped_when_broken(spark):
    body = '{"Results":{"series":[{"seriesID":"A","data":[{"year":"2024","period":"M01","value":"1.5"},{"year":"2024","period":"M13","value":"2"},{"year":"2024","period":"M02","value":"-"}]}]}}'
    assert [tuple(r) for r in one(spark, tables.series_rows(F.lit(body)))] == [("A", "2024-01", 1.5)]
    assert one(spark, tables.series_rows(F.lit("no json"))) is None


def test_pandas_udf_takes_nulls():
    assert likeness.name_similarity.func(pd.Series(["a", None]), pd.Series(["a", None])).tolist() == [1.0, 1.0]


@pytest.mark.parametrize(
    ("raw", "name", "trade"),
    [
        ("* Amended - Corrected: Northwind Foods", "Northwind Foods", None),
        ("Northwind Foods, dba Fresh Corner", "Northwind Foods", "Fresh Corner"),
        ("Quill &amp; Ink LLC (Remote workers) Fulfillment Centre", "Quill & Ink LLC", None),
        ("Blue Kite Air 1200 Ocean Ave, Suite 4, Bayport NJ 07001", "Blue Kite Air", None),
        ("Tall Pine Burgers, a franchisee of Big Pine and its subsidiaries", "Tall Pine Burgers", None),
        ("(12) Lantern Hotel #88 [closed]", "Lantern Hotel", None),
        ("Updated", "Updated", None),
        (None, "", None),
    ],
)
def test_search_names(spark, raw, name, trade):
    c = F.lit(raw).cast("string")
    assert (one(spark, names.search_name(c)), one(spark, names.trade_name(c))) == (name, trade)


def test_name_tokens(spark):
    key = lambda s: F.lit(s)
    assert one(spark, names.significant_tokens(key("a b c of harbor group x"))) == ["abc", "harbor"]
    assert one(spark, names.is_unsearchable(key("the company"))) and not one(spark, names.is_unsearchable(key("harbor")))
    assert one(spark, names.match_is_consistent(key("harbor foods"), key("foods international"))) and not one(spark, names.match_is_consistent(key("harbor"), key("tower")))
    assert one(spark, names.alternative_queries(key("Harbor Foods, Inc. dba Corner Shop"))) == ["Corner Shop", "Harbor Foods"]


def test_trend_same_as_spark_glm(spark):
    """The fitted slope against Spark's own Poisson regression, with an offset, and its error without serial correlation."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rnd = random.Random(8)
    names_of, exposure = months(48), [50.0 + i % 7 for i in range(48)]
    counts = [poisson(rnd, exposure[i] / 5 * 1.2 ** (i / 12) * (1 + (i % 12) / 20)) for i in range(48)]
    got = outlook.fit_trend(counts, names_of, offset=exposure)
    rows = [(float(y), i / 12, float(np.log(e)), *[float(i % 12 == m) for m in range(1, 12)]) for i, (y, e) in enumerate(zip(counts, exposure, strict=True))]
    columns = ["y", "trend", "log_exposure", *(f"m{m}" for m in range(1, 12))]
    table = VectorAssembler(inputCols=["trend", *columns[3:]], outputCol="x").transform(spark.createDataFrame(rows, columns))
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x", labelCol="y", offsetCol="log_exposure", maxIter=50, tol=1e-10).fit(table)
    assert got["coef"] == pytest.approx(float(model.coefficients[0]), abs=1e-6)
    fitted = np.array([r.prediction for r in model.transform(table).orderBy("trend").collect()])
    pearson = (np.array(counts) - fitted) / np.sqrt(fitted)
    scale = float((pearson**2).sum()) / (48 - 13) * outlook.variance_factor(pearson)
    assert got["se"] == pytest.approx(model.summary.coefficientStandardErrors[0] * math.sqrt(scale), rel=1e-4)
    assert got["p"] < 0.05


def test_variance_factor():
    import numpy as np

    assert outlook.variance_factor(np.zeros(30)) == 1.0
    assert outlook.variance_factor(np.array([1.0, -1.0] * 20)) == pytest.approx((1 + 1 / 40) / (1 - 1 / 40))  # negative counts as none
    assert outlook.variance_factor(np.arange(100.0)) == pytest.approx(19.0)  # at most 0.9


def test_running_sums_and_vector_neighbours(spark):
    import numpy as np

    from severa.operators.ranking import running_sums

    rows = spark.createDataFrame([(i, i * i % 13) for i in range(500)], "i int, v int").repartition(7)
    got = {r.i: r.s for r in running_sums(rows, [F.desc("i")], {"s": "v"}).collect()}
    assert got == {i: sum(j * j % 13 for j in range(i, 500)) for i in range(500)}
    rnd = np.random.default_rng(4)
    v = np.round(rnd.normal(size=(300, 6)), 1)
    v[7] = v[3]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    near = linkage.vector_neighbours(table, F.col("id") % 10 == 0, k=4, block=37).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cosine = np.round(unit @ unit.T, 6)
    for q in range(0, 300, 10):
        want = sorted((-cosine[q, d], d) for d in range(300) if d != q)[:4]
        assert sorted((-r.cosine, r.other) for r in near if r.q == q) == [(pytest.approx(c), d) for c, d in want]


def test_promotion_and_tiers(spark):
    from severa.operators import models

    reasons = models.promotion_reasons(F.lit(10), F.lit(0.2), F.lit(0.5), live=0.6)
    assert one(spark, reasons) == ["too few rows", "badly calibrated", "no better than the live model"]
    assert one(spark, models.promotion_reasons(F.lit(5000), F.lit(0.01), F.lit(0.5))) == []
    assert one(spark, models.tier(F.lit(0.6), {"high": 0.9, "elevated": 0.5}, "baseline")) == "elevated"
    assert one(spark, models.strict_json(F.lit(float("inf")).alias("a"), F.lit(None).cast("int").alias("b"))) == '{"a":null,"b":null}'


def test_zip_is_not_the_house_number(spark):
    from severa.operators import enrich

    given = {"12345 Main St, Town3, ST 10045": "10045", "12345 Main St, Town": None, "12345 A St, B, CA 92101-1234": "92101", "12345 A St, B, CA 92101, USA": "92101", "92101": "92101"}
    rows = spark.createDataFrame([(a, None, None) for a in given], "address string, city string, zip string")
    assert {r.address: r.zip for r in enrich.apply_enrichers(rows, ["city", "zip"]).collect()} == given


def test_cross_fit_never_sees_its_group(spark):
    from severa.operators import models

    rows = spark.createDataFrame([(f"g{i % 20}", float(i % 3), float(i % 3 == 0)) for i in range(400)], "g string, x double, y double")
    out = models.cross_fitted(rows, ("x",), "y", "g", 4).collect()
    assert len(out) == 400 and sum((r.score >= 0.5) == (r.y == 1.0) for r in out) >= 380
