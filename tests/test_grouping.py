"""Small groups are folded inside a task, whole, and what is sent on is bounded."""

import pandas as pd

from severa.grouping import fold_groups, in_frames, whole_groups
from severa.sources import extracted, tables

from conftest import TINY


def plan(df):
    return df._jdf.queryExecution().toString()


def test_whole_groups_go_on_over_frames():
    frames = [pd.DataFrame({"k": [1, 1, 2], "v": [1, 2, 3]}), pd.DataFrame({"k": [], "v": []}), pd.DataFrame({"k": [2, 2], "v": [4, 5]}), pd.DataFrame({"k": [2, 3], "v": [6, 7]})]
    assert [(g["k"][0], g["v"]) for g in whole_groups(frames, "k")] == [(1, [1, 2]), (2, [3, 4, 5, 6]), (3, [7])]
    assert [(g["k"][0], g["v"]) for g in whole_groups([pd.DataFrame({"k": [None, None, "a"], "v": [1, 2, 3]})], "k")] == [(None, [1, 2]), ("a", [3])]
    assert list(whole_groups([], "k")) == []


def test_fold_groups(spark):
    rows = spark.range(20_000).selectExpr("id % 3000 as k", "id as v")
    got = fold_groups(rows, "k", lambda g: [(g["k"][0], sum(g["v"]), len(g["v"]))], "k long, total long, n long", ["k", "total", "n"])
    want = rows.groupBy("k").agg({"v": "sum", "*": "count"}).collect()
    assert sorted(map(tuple, got.collect())) == sorted((r["k"], r["sum(v)"], r["count(1)"]) for r in want)


def test_overrides_call_python_once_a_task(spark):
    """F31."""
    from severa.plans.more import _override, overrides

    df = overrides(spark, TINY)
    assert "FlatMapGroupsInPandas" not in plan(df)
    assert _override({"a": [1, 2, 1], "b": [0, 0, 5], "seq": [-1, -1, 7], "separate": [False, False, False], "root": [0] * 3}) == [(1, 5), (2, 0)]
    assert _override({"a": [1, 1], "b": [0, 1], "seq": [-1, 7], "separate": [False, True], "root": [0] * 2}) == []


def test_workbooks_call_python_once_a_task(spark):
    """F21."""
    rows = spark.createDataFrame([("b", "x & y", "1"), ("a", None, "2"), ("b", "z", "3")], "path string, Company string, Affected string")
    books = extracted.workbooks(rows, "path", ["Company", "Affected"], title="T")
    assert "FlatMapGroupsInPandas" not in plan(books)
    assert {r.path: sorted(map(tuple, tables.xlsx_cells(bytes(r.content))[2:])) for r in books.collect()} == {"a": [("", "2")], "b": [("x & y", "1"), ("z", "3")]}


def test_parsed_rows_are_sent_on_in_small_frames():
    """a batch of large files is not held parsed."""
    made = []

    def rows():
        for i in range(2500):
            made.append(i)
            yield (i,)

    frames = in_frames(rows(), ["i"])
    assert len(next(frames)) == 1000 and len(made) == 1000
    assert [len(f) for f in frames] == [1000, 500]
    assert [f.columns.tolist() for f in in_frames([], ["i"])] == [["i"]]

    class Files:  # hands over the function that a task runs
        select = lambda self, *c: self
        mapInPandas = staticmethod(lambda run, schema: run)

    page = "<table><tr><th>Employer</th></tr>" + "<tr><td>x</td></tr>" * 700 + "</table>"
    batch = pd.DataFrame({"state": ["AL"] * 3, "path": list("abc"), "content": [page.encode()] * 3})
    assert [len(f) for f in tables.parse_files(Files())(iter([batch]))] == [1000, 1000, 100]


def test_pairs_of_several_keys_once(spark):
    """pairs that share several keys come once, and no pair is shuffled."""
    from severa.operators.linkage import key_pairs

    rows = spark.range(600).selectExpr("id % 60 as n", "concat('k', cast(id % 7 as string)) as k").union(spark.sql("select 1L, cast(null as string) union all select 2L, 'alone'"))
    pairs = key_pairs(rows, "n", "k", block=4, once=True).select("a", "b")
    got = [tuple(r) for r in pairs.collect()]
    want = {tuple(r) for r in key_pairs(rows, "n", "k", block=4).select("a", "b").collect()}
    assert len(got) == len(set(got)) and set(got) == want == {(a, b) for a in range(60) for b in range(a + 1, 60)}
    assert "HashAggregate(keys=[a" not in plan(pairs)
