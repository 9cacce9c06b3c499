"""Reports told apart by identity, on small tables with numbers of our own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import coverage_bucket, redact
from tidemark.functions import identity as I
from tidemark.operators import pit

D = dt.date
SCHEMA = "code int, pn int, end_date date, available date, notice date, update_flag string, ord int, report_type string, duration string, report_family string, statement_type string, scope string, unit string, accounting string, revenue double"


def report(pn, value, day, flag="0", order=1, notice=None, kind="1", **other):
    own = {"duration": "CUMULATIVE_YTD", "report_family": "source_default", "statement_type": "INCOME_STATEMENT", "scope": "consolidated", "unit": "cny:1", "accounting": "source_default"} | other
    return (1, pn, D(pn // 4, 3 * (pn % 4 + 1), 28), day, notice, flag, order, kind, *own.values(), value)


def at(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "as_of date")


def known(spark, rows, *days):
    return pit.as_of_identity(spark.createDataFrame(rows, SCHEMA), at(spark, *days))


P = 2020 * 4


def test_versions_of_one_day(spark):
    """Announced later wins, then the larger flag (none counts as -1), then what arrived later; null is a value of a key."""
    day = D(2020, 5, 1)
    rows = [report(P, 1.0, day, None, 9), report(P, 2.0, day, "0", 1), report(P + 1, 3.0, day, "1", 1), report(P + 1, 4.0, day, "0", 2, D(2020, 4, 30)), report(P + 2, 5.0, day, "1", 1), report(P + 2, 6.0, day, "1", 2), report(P + 3, 7.0, day, kind=None), report(P + 3, 8.0, day, kind="1"), report(P + 3, 9.0, None)]
    got = sorted((r.pn - P, r.report_type, r.revenue) for r in known(spark, rows, D(2020, 6, 1)).collect() if r.report_type) + [(r.pn - P, None, r.revenue) for r in known(spark, rows, D(2020, 6, 1)).collect() if not r.report_type]
    assert got == [(0, "1", 2.0), (1, "1", 4.0), (2, "1", 6.0), (3, "1", 8.0), (3, None, 7.0)]
    assert known(spark, rows, D(2020, 4, 30)).count() == 0


def test_versions_are_current_for_years(spark):
    rows = [report(P, 1.0, D(2018, 12, 31)), report(P, 2.0, D(2021, 1, 1), "1")]
    got = {str(r.as_of): r.revenue for r in known(spark, rows, D(2018, 12, 30), D(2018, 12, 31), D(2019, 6, 1), D(2020, 12, 31), D(2021, 1, 1), D(2029, 1, 1)).collect()}
    assert got == {"2018-12-31": 1.0, "2019-06-01": 1.0, "2020-12-31": 1.0, "2021-01-01": 2.0, "2029-01-01": 2.0}
    assert "NestedLoop" not in known(spark, rows, D(2020, 1, 1))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("other", "reason"),
    [
        ({}, None), ({"duration": "SINGLE_QUARTER"}, "period_semantics_mismatch"), ({"report_family": "raw:x"}, "report_family_mismatch"), ({"statement_type": "Notes"}, "statement_type_mismatch"), ({"scope": "parent_only"}, "scope_mismatch"),
        ({"unit": "cny:1000"}, "unit_mismatch"), ({"accounting": "raw:ifrs"}, "accounting_semantics_mismatch"), ({"unit": "cny:1000", "scope": "parent_only"}, "scope_mismatch"),
    ],
)
def test_comparable_period(spark, other, reason):
    day = D(2021, 5, 1)
    rows = known(spark, [report(P, 10.0, day, **other), report(P + 4, 15.0, day)], D(2021, 6, 1))
    got = {r.pn: r for r in pit.match_comparable(rows, "revenue", 4).collect()}
    assert got[P].reason == "missing_comparable_period" and got[P + 4].reason == reason
    assert got[P + 4].growth == (0.5 if reason is None else None)


def test_the_best_candidate_explains(spark):
    """Of several rows of the period the one that agrees longest decides; one that agrees wholly is the match."""
    day = D(2021, 5, 1)
    near, far = report(P, 10.0, day, unit="cny:1000"), report(P, 20.0, day, duration="SINGLE_QUARTER")
    one = known(spark, [near, far, report(P + 4, 15.0, day)], D(2021, 6, 1))
    assert {r.pn: r.reason for r in pit.match_comparable(one, "revenue", 4).collect() if r.pn == P + 4} == {P + 4: "unit_mismatch"}
    two = known(spark, [near, far, report(P, 30.0, day), report(P + 4, 15.0, day)], D(2021, 6, 1))
    assert [r.growth for r in pit.match_comparable(two, "revenue", 4).collect() if r.pn == P + 4] == [-0.5]


def test_unknown_and_refused(spark):
    day = D(2021, 5, 1)
    rows = known(spark, [report(P, 10.0, day), report(P + 1, 15.0, day), report(P + 2, 15.0, day, unit="UNKNOWN"), report(P + 2, 20.0, day, duration="SINGLE_QUARTER"), report(P + 3, 30.0, day, duration="SINGLE_QUARTER")], D(2021, 6, 1))
    got = {(r.pn - P, r.duration): (r.reason, r.growth) for r in pit.match_comparable(rows, "revenue", 1).collect()}
    assert got[1, "CUMULATIVE_YTD"] == ("qoq_requires_validated_single_quarter", None) and got[2, "CUMULATIVE_YTD"][0] == "unknown_unit"
    assert got[2, "SINGLE_QUARTER"][0] == "period_semantics_mismatch" and got[3, "SINGLE_QUARTER"] == (None, 0.5)


def test_single_quarters_within_one_identity(spark):
    day = D(2021, 5, 1)
    rows = known(spark, [report(P, 10.0, day), report(P + 1, 25.0, day), report(P + 2, 40.0, day, unit="cny:1000"), report(P + 3, None, day, unit="cny:1000"), report(P + 5, 7.0, day), report(P + 6, 9.0, day, duration="SINGLE_QUARTER"), report(P + 7, 1.0, day, duration="POINT_IN_TIME")], D(2021, 6, 1))
    got = {r.pn - P: (r.quarter_value, r.reason, r.source_periods) for r in pit.quarters_by_identity(rows, "revenue").collect()}
    assert got[0] == (10.0, None, str(P)) and got[1] == (15.0, None, f"{P + 1}|{P}") and got[6] == (9.0, None, str(P + 6))
    assert [got[i][1] for i in (2, 3, 5, 7)] == ["unit_mismatch", "missing_value", "missing_preceding_cumulative_period", "unsupported_duration_semantics"]


def test_words_and_labels(spark):
    rows = spark.createDataFrame([("quarterly", "1"), ("stock", None), ("Fiscal YTD", "1"), (None, "2"), ("odd", None)], "w string, t string")
    none = F.lit(None)
    got = [r.d for r in rows.select(I.duration("income", [F.col("w")], F.col("t"), none.cast("date"), F.lit(2020), F.lit(2)).alias("d")).collect()]
    assert got == ["UNKNOWN", "POINT_IN_TIME", "CUMULATIVE_YTD", "SINGLE_QUARTER", "UNKNOWN"]
    one = rows.limit(1).select(I.unit(F.lit("in thousand CNY")).alias("a"), I.unit(F.lit("cny:5")).alias("b"), I.scope([F.lit("raw:x")], none).alias("c"), I.scope([], none, [F.lit("no")]).alias("d"), I.accounting(F.lit("a"), F.lit("b")).alias("e"), coverage_bucket(F.lit(0.9)).alias("f"), redact(F.lit("k=abc Authorization: Bearer x host='h.lan' https://u/v"), "abc").alias("g")).first()
    assert tuple(one) == ("cny:1000", "cny:5", "raw:x", "parent_only", "UNKNOWN", "[0.90,1.00]", "k=<redacted> <redacted-authorization> host='<redacted-host>' <redacted-url>")
