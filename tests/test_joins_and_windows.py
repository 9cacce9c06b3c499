"""Joins by date and membership, window shares and falls of paths, against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, order, ranges

D = dt.date(2020, 1, 1)


def day(i):
    return None if i is None else D + dt.timedelta(days=i)


def test_as_of_join_equals_a_scan(spark):
    """Years as blocks: rows are carried within a block, over blocks without rows, and from the one before."""
    r = random.Random(1)
    right = [(r.choice([1, 2, 3, None]), r.choice([None, *range(0, 2500, 7)]), i, f"v{i}") for i in range(400)] + [(9, 5, 400, "a"), (9, 5, 401, "b"), (9, None, 402, "undated")]
    left = [(r.choice([1, 2, 3, 4, None]), r.choice([None, *range(-30, 2600, 3)]), i) for i in range(500)] + [(9, 4, 900), (9, 5, 901), (9, 2000, 902), (9, None, 903)]
    a = spark.createDataFrame([(k, day(x), i) for k, x, i in left], "code int, as_of date, n int").repartition(3)
    b = spark.createDataFrame([(k, day(x), i, v) for k, x, i, v in right], "code int, trade_date date, arrival int, value string").repartition(4)

    def want(k, x):
        seen = [(at, i, v) for c, at, i, v in right if c == k and at is not None and x is not None and at <= x] if k is not None else []
        return max(seen)[2] if seen else None

    out = joins.reference_row(a, b, ["code"], "as_of", "arrival")
    assert out.columns == ["code", "as_of", "n", "match"]
    assert {x.n: x.match and x.match.value for x in out.collect()} == {i: want(k, x) for k, x, i in left}
    assert joins.reference_row(a.limit(0), b, ["code"], "as_of", "arrival").count() == 0
    assert joins.reference_row(a, b.limit(0), ["code"], "as_of", "arrival").where("match is not null").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    undated = b.drop("trade_date")
    last = {k: max((i, v) for c, _, i, v in right if c == k)[1] for k in (1, 2, 3, 9)}
    assert {x.n: x.match and x.match.value for x in joins.reference_row(a, undated, ["code"], "as_of", "arrival").collect()} == {i: last.get(k) for k, _, i in left}


def test_visible_counts(spark):
    r = random.Random(2)
    events = [(r.choice([1, 2, 3]), r.choice([None, *range(60)])) for _ in range(200)]
    asked = [0, 10, 10, 30, 59, 90]
    got = joins.visible_counts(spark.createDataFrame([(k, day(x)) for k, x in events], "code int, ann date"), spark.createDataFrame([(day(x),) for x in asked], "as_of date"), ["code"], "ann")
    want = {(day(d), k): (len(s), day(max(s))) for d in set(asked) for k in (1, 2, 3) if (s := [x for c, x in events if c == k and x is not None and x <= d])}
    assert {(x.as_of, x.code): (x.n, x.last_day) for x in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_outer_frame_and_sets(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (None, 1, 4.0)], "code int, day int, close double")
    b = spark.createDataFrame([(1, 1, 5.0, 1), (3, 1, 6.0, 2), (None, 1, 7.0, 3)], "code int, day int, close double, pe int")
    out = joins.outer_frame(a, b, ["code", "day"])
    assert out.columns == ["code", "day", "close", "close_basic", "pe"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1, 2.0, 5.0, 1), (2, 1, 3.0, None, None), (3, 1, None, 6.0, 2), (None, 1, 4.0, None, None), (None, 1, None, 7.0, 3)], key=str)
    assert joins.outer_frame(a.drop("code", "day"), b, ["code"]).count() == 6
    assert [x.code for x in joins.members(a, b, ["code"]).collect()] == [1]
    assert sorted((x.code for x in joins.others(a, b, ["code"]).collect()), key=str) == [2, None]


def test_overlap_flags(spark):
    rows = lambda x: spark.createDataFrame([(d, c) for d, cs in x.items() for c in cs], "day int, code int")
    left = rows({1: [*range(100), 5, None], 2: range(100), 3: [1], 4: range(100)})
    right = rows({1: range(100), 2: range(3, 100), 5: [1], 4: range(2, 102)})
    got = {x.day: (x.left_n, x.right_n, x.both_n, x.left_only, x.right_only, round(x.coverage, 6), x.warnings, x.status) for x in joins.overlap(left, right, ["day"], "code", least=90).collect()}
    both = "abnormally_low_symbol_count|low_join_coverage"
    assert got == {1: (100, 100, 100, 0, 0, 1.0, "", "PASS"), 2: (100, 97, 97, 3, 0, 0.97, "low_join_coverage", "FAIL"), 3: (1, 0, 0, 1, 0, 0.0, both, "FAIL"), 4: (100, 100, 98, 2, 2, 0.98, "", "PASS"), 5: (0, 1, 0, 0, 1, 0.0, both, "FAIL")}


def test_not_larger_counts_every_window():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 300):
        x = r.integers(0, max(1, n // 3), n).astype(float)
        x[r.random(n) < 0.1] = np.nan
        lo = np.sort(r.integers(0, n + 1, n))
        hi = np.maximum(lo, np.minimum(n, lo + r.integers(0, 40, n)))
        total, count = order.not_larger(x, lo, hi)
        for i in range(n):
            w = x[lo[i] : hi[i]]
            assert total[i] == (~np.isnan(w)).sum() and (np.isnan(x[i]) or count[i] == (w <= x[i]).sum())


@pytest.mark.parametrize(("window", "by_rows"), [((-7, -1), True), ((-6, 0), True), ((-7, -1), False), ((0, 0), False)])
def test_window_shares_over_blocks(spark, window, by_rows):
    """Blocks of eight rows, gaps in the sessions, unknown values, ties, and an entity with most of the rows."""
    r = random.Random(4)
    rows = [(c, i, r.choice([None, float("nan"), 1.0, 2.0, 3.0, r.random()])) for c, n in ((1, 90), (2, 5), (3, 1)) for i in sorted(r.sample(range(200), n))]
    rows += [(None, 3, 1.0), (None, 4, 2.0)]
    frame = spark.createDataFrame(rows, "code int, idx int, x double").repartition(4)
    got = {(g.code, g.idx): (g.s, g.t) for g in order.window_shares(frame, {"s": "x", "t": "x"}, window, 3 if window[0] else 1, count_rows=by_rows, block=8).collect()}
    assert len(got) == len(rows)
    for c in (1, 2, 3, None):
        mine = sorted((i, x) for k, i, x in rows if k == c)
        for n, (i, x) in enumerate(mine):
            near = mine[max(0, n + window[0]) : max(0, n + window[1] + 1)] if by_rows else [m for m in mine if i + window[0] <= m[0] <= i + window[1]]
            held = [m[1] for m in near if m[1] is not None and m[1] == m[1]]
            want = None if x is None or x != x or len(held) < (3 if window[0] else 1) else sum(h <= x for h in held) / len(held)
            assert got[c, i] == (want, want)
    assert order.window_shares(frame.limit(0), {"s": "x"}, window).count() == 0
    with pytest.raises(ValueError, match="window"):
        order.window_shares(frame, {"s": "x"}, (-9, 1))


def test_deepest_fall_equals_a_walk(spark):
    r = random.Random(5)
    path = {c: {i: r.choice([None, 0.0, r.uniform(1, 9)]) if r.random() < 0.3 else r.uniform(1, 9) for i in range(100) if r.random() < 0.8} for c in (1, 2)}
    asked = [(c, a, a + h, h) for c in (1, 2, 3) for a in range(0, 90, 3) for h in (1, 2, 7, 20, 64, 300)] + [(1, 5, 5, 0), (1, None, 5, -1)]
    quotes = spark.createDataFrame([(c, i, x) for c, p in path.items() for i, x in p.items()], "code int, idx int, x double")
    entries = spark.createDataFrame(asked, "code int, a int, b int, h int")
    got = {(g.code, g.a, g.b): g.drawdown for g in ranges.deepest_fall(entries, ranges.fall_blocks(quotes, "x", F.lit(400)), "a", "b").collect()}
    for c, a, b, _ in asked:
        p = path.get(c, {})
        want = None
        if a is not None and a < b and p.get(a) is not None and p.get(b) is not None:
            peak, want = 0.0, 0.0
            for i in range(a, b + 1):
                if p.get(i) is not None:
                    peak = max(peak, p[i])
                    want = min(want, p[i] / peak - 1) if peak > 0 else want
        assert (got[c, a, b] is None) == (want is None) and (want is None or abs(got[c, a, b] - want) < 1e-12)
