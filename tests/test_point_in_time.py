"""Cases of revised facts, with numbers of our own."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import finite, growth, norm_date, sign_transition
from tidemark.operators import pit

D = dt.date


def facts(spark):
    rows = [
        (1, 2020, 1, 8080, D(2020, 4, 20), 0, 10.0), (1, 2020, 2, 8081, D(2020, 8, 1), 0, 25.0), (1, 2020, 2, 8081, D(2020, 9, 1), 1, 27.0),
        (1, 2020, 4, 8083, D(2021, 3, 1), 0, 60.0), (2, 2020, 1, 8080, D(2020, 4, 20), 0, 1.0), (2, 2020, 1, 8080, D(2020, 4, 20), 1, 2.0), (2, 2020, 2, 8081, None, 0, 9.0),
    ]
    return spark.createDataFrame(rows, "code int, yr int, q int, pn int, ann_date date, update_flag int, revenue double")


def at(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "as_of date")


def known(spark, *days):
    out = pit.as_of(facts(spark), at(spark, *days), ["code", "yr", "q"], "ann_date", ["update_flag"])
    return {(str(r.as_of), r.code, r.q): r.revenue for r in out.collect()}


def test_nothing_before_the_first_day_and_all_on_it(spark):
    got = known(spark, D(2020, 4, 19), D(2020, 4, 20))
    assert got == {("2020-04-20", 1, 1): 10.0, ("2020-04-20", 2, 1): 2.0}  # versions of one day: the last flag


def test_revision_on_its_day(spark):
    got = known(spark, D(2020, 8, 31), D(2020, 9, 1))
    assert got["2020-08-31", 1, 2] == 25.0 and got["2020-09-01", 1, 2] == 27.0
    assert ("2020-09-01", 2, 2) not in got  # no availability, never known


def test_rows_order_and_future_rows_do_not_matter(spark):
    f = facts(spark)
    future = f.withColumn("ann_date", F.lit(D(2030, 1, 1))).withColumn("revenue", F.lit(-1.0))
    a = pit.as_of(f, at(spark, D(2021, 6, 1)), ["code", "yr", "q"], "ann_date", ["update_flag"])
    b = pit.as_of(future.union(f.orderBy(F.rand(3))), at(spark, D(2021, 6, 1)), ["code", "yr", "q"], "ann_date", ["update_flag"])
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_missing_quarter_breaks_the_chain(spark):
    k = pit.as_of(facts(spark), at(spark, D(2021, 6, 1)), ["code", "yr", "q"], "ann_date", ["update_flag"])
    s = {(r.code, r.q): (r.sq_revenue, r.reason) for r in pit.quarters(k, ["revenue"]).collect()}
    assert s[1, 1] == (10.0, None) and s[1, 2] == (17.0, None) and s[1, 4] == (None, "missing_preceding_cumulative_period")
    t = pit.trailing_sum(pit.quarters(k, ["revenue"]), "sq_revenue").collect()
    assert all(r.ttm is None and r.ttm_reason == "missing_quarter" for r in t)


def test_growth_reasons(spark):
    g, why = growth(F.col("c"), F.col("p"))
    rows = spark.createDataFrame([(2.0, 1.0), (-1.0, 1.0), (1.0, 0.0), (1.0, -2.0), (None, 1.0)], "c double, p double").select(g.alias("g"), why.alias("w"), sign_transition(F.col("p"), F.col("c")).alias("s")).collect()
    assert [r.w for r in rows] == [None, "sign_transition", "invalid_denominator", "negative_denominator", "missing_value"]
    assert rows[0].g == 1.0 and rows[1].s == "POSITIVE_TO_NEGATIVE" and rows[2].s == "ZERO_TO_POSITIVE" and rows[3].s == "NEGATIVE_TO_POSITIVE" and rows[4].s == "UNKNOWN"


def test_dates_and_numbers(spark):
    rows = spark.createDataFrame([("20200131",), ("20200230",), (" 20200131.0",), ("2020-01-31",), ("x",), (None,)], "t string").select(norm_date(F.col("t")).alias("d"), finite(F.col("t")).alias("n")).collect()
    assert [str(r.d) for r in rows] == ["2020-01-31", "None", "2020-01-31", "2020-01-31", "None", "None"]
    assert rows[4].n is None
