"""Observations of several series by identity, and the next periods of each date, on small tables with numbers of our own."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_identity import SCHEMA, D, P, at, report
from tests.test_trailing_identity import DAY, LATER, reports
from tidemark.functions import identity as I
from tidemark.operators import observed, pit

FIRST = D(2020, 1, 1)


def ahead(rows, days):
    """By definition: of an entity's periods whose day is later, the first two."""
    out = set()
    for day in days:
        for code in {r[0] for r in rows}:
            later = sorted(pn for k, pn, d in rows if k == code and d and d > day)
            out |= {(day, code, pn, i + 1) for i, pn in enumerate(later[:2])}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_next_periods(spark, seed):
    """Days in and out of the order of periods, equal days, days that are unknown, entities with one period."""
    r = random.Random(seed)
    rows = [(k, pn, None if r.random() < 0.1 else FIRST + dt.timedelta(days=pn * 60 + r.choice([0, 0, 1, 200, -150, 700]))) for k in range(12) for pn in range(r.choice([1, 2, 15]))]
    days = [FIRST + dt.timedelta(days=d) for d in (-400, -1, 0, 59, 60, 61, 300, 500, 777, 3000)]
    first = spark.createDataFrame(rows, "code int, pn int, first_day date")
    out = pit.next_periods(first, at(spark, *days))
    assert {(x.as_of, x.code, x.pn, x.nth) for x in out.collect()} == ahead(rows, days)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert pit.next_periods(first, at(spark, *days).limit(0)).count() == 0
    assert pit.next_periods(first.limit(0), at(spark, *days)).count() == 0


def test_duration_words(spark):
    words = {
        "Quarterly": "SINGLE_QUARTER", "single-quarter": "SINGLE_QUARTER", "a quarter, single": "SINGLE_QUARTER", "quarters": "UNKNOWN", "FY": "CUMULATIVE_YTD", "fy2020": "UNKNOWN", "Year to date": "CUMULATIVE_YTD",
        "q3 YTD": "CUMULATIVE_YTD", "ytd q3": "UNKNOWN", "semi_cumulative": "CUMULATIVE_YTD", "stock": "POINT_IN_TIME", "stocks": "UNKNOWN", "at a point": "POINT_IN_TIME", "n/a": "UNKNOWN", "": None, "nan": None,
    }
    frame = spark.createDataFrame([(w,) for w in [*words, None]], "w string").withColumn("d", I.duration_word(F.col("w")))
    assert {r.w: r.d for r in frame.collect()} == {**words, None: None}


#: Entities: one identity; a quarter missing; two identities at the last period; versions of one identity that differ; a value unknown.
CASES = {
    1: reports(), 2: [x for i, x in enumerate(reports()) if i != 1], 3: [*reports(), report(P + 6, 70.0, DAY, scope="parent_only")],
    4: [report(P, 10.0, DAY), report(P, 12.0, DAY, kind="1", duration="SINGLE_QUARTER")], 5: [report(P, None, DAY), report(P + 1, 5.0, DAY)],
}


@pytest.fixture(scope="module")
def known(spark):
    rows = spark.createDataFrame([(k, *r[1:]) for k, rs in CASES.items() for r in rs], SCHEMA)
    return pit.as_of_identity(rows, at(spark, DAY, LATER)).withColumn("profit", F.when(F.col("code") == 1, F.col("revenue") - 20).otherwise(F.col("revenue") * 0.1))


@pytest.fixture(scope="module")
def obs(spark, known):
    out = observed.observations(observed.quarter_rows(known, ["revenue", "profit"]), known, "profit", "revenue")
    return spark.createDataFrame(out.collect(), out.schema)


def told(obs, code, series, metric, day=LATER):
    return {r.pn - P: (r.value, r.reason) for r in obs.where(F.col("value").isNotNull() | F.col("reason").isNotNull()).collect() if (r.code, r.series, r.metric, r.as_of) == (code, series, metric, day)}


def test_observations(obs):
    assert [told(obs, 1, "revenue", "level")[i][0] for i in range(7)] == [10, 20, 30, 40, 11, 21, 31]
    # profit runs from the year's start too: -10, 10, 40, 80
    assert [told(obs, 1, "profit", "level")[i][0] for i in range(4)] == [-10, 20, 30, 40]
    assert told(obs, 1, "revenue", "yoy")[4] == (0.1, None) and told(obs, 1, "revenue", "yoy")[3] == (None, "missing_comparable_period")
    assert told(obs, 1, "revenue", "qoq")[1] == (1.0, None) and told(obs, 1, "profit", "qoq")[1] == (None, "negative_denominator") and told(obs, 1, "profit", "qoq")[4] == (None, "sign_transition")
    assert told(obs, 1, "revenue", "ttm")[6] == (103.0, None) and told(obs, 1, "profit", "ttm")[2] == (None, "missing_quarter")
    assert told(obs, 1, "profit", "margin")[0] == (-1.0, None) and told(obs, 1, "profit", "margin_change")[4] == (round(-9 / 11 + 1, 6), None)
    assert not told(obs, 1, "revenue", "margin")


def test_observations_that_lack_something(obs):
    assert told(obs, 2, "revenue", "level")[2] == (None, "missing_preceding_cumulative_period") and told(obs, 2, "profit", "level")[2][1] == "missing_preceding_cumulative_period"
    # both reports tell of one quarter by itself, of which they don't agree
    assert told(obs, 4, "revenue", "level") == {0: (None, "ambiguous_observation")}
    assert told(obs, 5, "revenue", "level") == {0: (None, "missing_value"), 1: (None, "missing_value")} and told(obs, 5, "profit", "margin") == {0: (None, "missing_value"), 1: (0.1, None)}
    assert set(told(obs, 1, "revenue", "level", DAY)) == {0}


def test_groups(obs):
    got = {(r.code, r.series, r.metric): (r.pn - P, r.value, r.reason) for r in observed.latest_group(obs).collect() if r.as_of == LATER}
    assert got[1, "revenue", "yoy"] == (6, round(1 / 30, 6), None) and got[1, "revenue", "ttm"] == (6, 103.0, None)
    assert {v for k, v in got.items() if k[0] == 3} == {(6, None, "ambiguous_period_chain")} and len({k[1:] for k in got}) == 10


def test_trends(obs):
    got = {(r.code, r.series, r.metric, r.scope): r for r in observed.trends(obs).collect() if r.as_of == LATER and r.duration == "SINGLE_QUARTER"}
    last = got[1, "revenue", "level", "consolidated"]
    # 10 20 30 40 11 21 31: up by ten twice at the end
    assert (last.pn - P, last.n, last.value, last.change, last.acceleration, last.length, last.direction) == (6, 7, 31.0, 10.0, 0.0, 2, "up")
    # the quarter after a gap has no change; the last one has, and no acceleration counts across the gap
    gap = got[2, "revenue", "level", "consolidated"]
    assert (gap.n, gap.direction, gap.length) == (5, "up", 2)
    assert (1, "revenue", "margin", "consolidated") not in got


def test_series_share_exchanges(known):
    """A second series adds rows, not exchanges; without rows there is nothing."""

    def exchanges(values):
        return observed.quarter_rows(known, values)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(["revenue"]) == exchanges(["revenue", "profit"])
    none = known.limit(0)
    empty = observed.observations(observed.quarter_rows(none, ["revenue", "profit"]), none, "profit", "revenue")
    assert empty.count() == 0 and observed.trends(empty).count() == 0 and observed.latest_group(empty).count() == 0
