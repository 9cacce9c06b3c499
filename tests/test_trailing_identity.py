"""Growth, margins and trailing sums within one identity, on small tables with numbers of our own."""

import datetime as dt

import pytest

from tests.test_identity import SCHEMA, D, P, at, report
from tidemark.operators import pit, trailing

DAY, LATER = D(2023, 5, 1), D(2024, 1, 1)
CUMULATIVE = [10.0, 30.0, 60.0, 100.0, 11.0, 32.0, 63.0]  # quarters 10 20 30 40 11 21 31


def reports(change=None, **other):
    """Seven quarters a day apart, of which number `change` has another part of its identity."""
    return [report(P + i, x, DAY + dt.timedelta(days=i), **(other if i == change else {})) for i, x in enumerate(CUMULATIVE)]


#: Another identity in the fifth quarter, which is a quarter by itself, and what a sum over it says.
OTHERS = {
    11: ({"report_family": "raw:x", "scope": "parent_only"}, "report_family_mismatch"), 12: ({"statement_type": "Notes"}, "statement_type_mismatch"), 13: ({"scope": "parent_only"}, "scope_mismatch"),
    14: ({"unit": "cny:1000"}, "unit_mismatch"), 15: ({"accounting": "raw:ifrs"}, "accounting_semantics_mismatch"), 16: ({"accounting": "raw:ifrs", "unit": "cny:1000"}, "unit_mismatch"),
}
FIFTH = DAY + dt.timedelta(days=4)
CASES = {
    1: reports(), 2: [r for i, r in enumerate(reports()) if i != 1], 3: [*reports(), report(P + 4, 11.0, FIFTH, kind="3")], 4: [*reports(), report(P + 4, 12.0, FIFTH, kind="3")],
    5: [*reports(), report(P + 4, 12.0, DAY + dt.timedelta(days=9), kind="3")], **{k: [*reports(4, **o), report(P + 5, 21.0, DAY, kind="2", duration="SINGLE_QUARTER")] for k, (o, _) in OTHERS.items()},
}


@pytest.fixture(scope="module")
def series(spark):
    """All cases as entities of one table, as known on three days."""
    rows = spark.createDataFrame([(k, *r[1:]) for k, rs in CASES.items() for r in rs], SCHEMA)
    out = trailing.quarter_series(pit.as_of_identity(rows, at(spark, DAY, DAY + dt.timedelta(days=5), LATER)), "revenue")
    return spark.createDataFrame(out.collect(), out.schema)


@pytest.fixture(scope="module")
def sums(series):
    return trailing.trailing_by_identity(series).collect()


def of(rows, code, day=LATER):
    return {(r.pn - P, r.duration): r for r in rows if r.code == code and r.as_of == day}


def test_four_consecutive_quarters(sums):
    got = of(sums, 1)
    assert [(got[i, "SINGLE_QUARTER"].ttm, got[i, "SINGLE_QUARTER"].ttm_reason, got[i, "SINGLE_QUARTER"].run) for i in range(7)] == [(None, "missing_quarter", 1), (None, "missing_quarter", 2), (None, "missing_quarter", 3), (100.0, None, 4), (101.0, None, 5), (102.0, None, 6), (103.0, None, 7)]
    last = got[6, "SINGLE_QUARTER"]
    assert last.source_quarters == "|".join(str(P + i) for i in (3, 4, 5, 6)) and last.availability_dates == "20230504|20230505|20230506|20230507"


def test_a_gap_breaks_the_run(sums):
    got = of(sums, 2)
    # the third quarter has no sum before it, the fourth has
    assert got[2, "UNKNOWN"].ttm_reason == "unsupported_duration_semantics" and got[3, "SINGLE_QUARTER"].run == 1
    assert [got[i, "SINGLE_QUARTER"].ttm_reason for i in (3, 4, 5)] == ["missing_quarter", "missing_quarter", "period_semantics_mismatch"]
    assert got[6, "SINGLE_QUARTER"].ttm == 103.0


@pytest.mark.parametrize("code", sorted(OTHERS))
def test_a_quarter_of_another_identity(sums, code):
    got = of(sums, code)
    assert got[3, "SINGLE_QUARTER"].ttm == 100.0 and got[4, "SINGLE_QUARTER"].ttm is None and got[4, "SINGLE_QUARTER"].run == 1
    assert got[5, "SINGLE_QUARTER"].ttm is None and got[5, "SINGLE_QUARTER"].ttm_reason == OTHERS[code][1]


@pytest.mark.parametrize(("code", "ttm"), [(3, 101.0), (4, None), (5, 102.0)])
def test_versions_of_one_identity(sums, code, ttm):
    """Of one day and flag, equal values count once, and different ones leave the quarter unknown; the later day wins."""
    got = [r for r in sums if r.code == code and r.as_of == LATER and r.pn == P + 4]
    assert len(got) == 2 and {r.ttm for r in got} == {ttm} and {r.ttm_reason for r in got} == {None if ttm else "missing_quarter"}


def test_as_of_ignores_what_comes_later(sums):
    """Before the last quarter's day there is no such row, and sums stand at the one before."""
    got = of(sums, 1, DAY + dt.timedelta(days=5))
    assert max(i for i, _ in got) == 5 and got[5, "SINGLE_QUARTER"].ttm == 102.0
    assert [i for i, _ in of(sums, 1, DAY)] == [0]


def test_growth_of_single_quarters(series):
    yoy = {r.pn - P: (r.growth, r.reason) for r in trailing.growth_by_identity(series, 4).collect() if r.code == 14 and r.as_of == LATER and r.report_type == "1"}
    assert yoy[0] == (None, "missing_comparable_period") and yoy[4] == (None, "unit_mismatch") and yoy[5] == (None, "unsupported_duration_semantics")
    qoq = {r.pn - P: (r.growth, r.reason) for r in trailing.growth_by_identity(series, 1).collect() if r.code == 14 and r.as_of == LATER and r.report_type == "1"}
    assert qoq[1] == (1.0, None) and qoq[3][0] == pytest.approx(1 / 3) and qoq[4] == (None, "unit_mismatch")


def test_margins(spark):
    rows = [(*report(P + i, x, DAY, **o), n) for i, x, n, o in ((0, 10.0, 1.0, {}), (1, 0.0, 1.0, {}), (2, -5.0, 1.0, {}), (3, None, 1.0, {}), (4, 20.0, 4.0, {}), (5, 20.0, 4.0, {}), (6, 20.0, None, {}), (7, 20.0, 4.0, {"unit": "cny:1000"}), (8, 50.0, 20.0, {"unit": "UNKNOWN"}))]
    frame = spark.createDataFrame(rows, SCHEMA + ", profit double")
    got = {r.pn - P: (r.margin, r.margin_reason, r.margin_change, r.change_reason) for r in trailing.margin_by_identity(pit.as_of_identity(frame, at(spark, LATER)), "profit", "revenue").collect()}
    assert got[0] == (0.1, None, None, "missing_comparable_period") and got[4] == (0.2, None, 0.1, None)
    assert got[1][:2] == (None, "invalid_denominator") and got[2][:2] == (None, "negative_denominator") and got[3][:2] == (None, "missing_value")
    assert got[5] == (0.2, None, None, "invalid_denominator") and got[6] == (None, "missing_value", None, "missing_value")
    assert got[7] == (0.2, None, None, "unit_mismatch") and got[8][:2] == (None, "unknown_unit") and got[8][3] == "unknown_unit"


def test_no_rows(series):
    out = trailing.trailing_by_identity(series.limit(0))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
