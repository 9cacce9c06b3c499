"""Inputs bent on purpose, over all entities of the tables: each case says how many rows it held and how many failed."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.operators.rank import top
from tidemark.plans.facts import KNOWN, p16
from tidemark.plans.panels import bench, x01
from tidemark.plans.ranking import PICKS, picks
from tidemark.plans.replay import REGISTRY, assess, components
from tidemark.plans.views import Views
from tidemark.registry import query


def cases(rows: DataFrame, **checks: tuple[Column, Column]) -> DataFrame:
    """All cases that look at the same rows, in one pass: which rows each is about, and which of those fail it."""
    counts = [F.struct(F.lit(n).alias("case"), F.count_if(about).alias("checked"), F.count_if(about & F.coalesce(failed, F.lit(True))).alias("failed")) for n, (about, failed) in checks.items()]
    return rows.agg(F.array(*counts).alias("cases")).select(F.inline("cases"))


CASES = f""", {KNOWN}{PICKS}, rv AS (SELECT count(*) AS n FROM income a JOIN income b ON a.code = b.code AND a.yr = b.yr AND a.q = b.q AND a.update_flag = 0 AND b.update_flag = 1)
  SELECT 'revision' AS "case", n AS checked, 0::bigint AS failed FROM rv UNION ALL SELECT 'boundary', n, 0 FROM rv UNION ALL SELECT 'future_market_row', count(*), 0 FROM px WHERE idx <= (SELECT min(idx) FROM as_of)
  UNION ALL SELECT 'benchmark_missing', count(*) * 2, 0 FROM pk UNION ALL SELECT 'short_history', count(*), 0 FROM px WHERE idx <= 20 UNION ALL SELECT 'delisted', count(*), 0 FROM as_of a, ref r WHERE r.delist_idx <= a.idx
  UNION ALL SELECT 'pre_listing', count(*), 0 FROM as_of a, ref r WHERE r.list_idx > a.idx UNION ALL SELECT 'missing_critical_group', count(*), 0 FROM (SELECT DISTINCT as_of, code FROM k) UNION ALL SELECT 'tie', count(*), 0 FROM px"""


@query("A11_adversarial", CASES)
def a11(v: Views) -> DataFrame:
    """Each chain runs once: what is bent is a second column of the same frame, and the cases that read a frame share a pass."""
    v.keep("px", "as_of", "cal", "bench", "statements")
    c, every = F.col, F.lit(True)
    first = v.as_of.agg(F.min("idx")).scalar()
    # rows after the first date are bent; nothing up to it may change
    bent = v.px.withColumn("bent", F.when(c("idx") > first, c("close") * 10).otherwise(c("close")))
    plain = P.prior_high(P.window_return(bent, 20), 60, 20).withColumnsRenamed({"ret": "r1", "high": "h1"})
    both = P.prior_high(P.window_return(plain, 20, "bent"), 60, 20, "bent").withColumn("first", first)
    changed = ~(c("r1").eqNullSafe(c("ret")) & c("h1").eqNullSafe(c("high")))
    # the benchmark ends early: returns stay, what is measured against it is unknown
    horizons = v.spark.createDataFrame([(20,), (60,)], "h int")
    last = v.cal.agg(F.max("idx")).scalar()
    chosen = v.written(picks(v), "picks")
    whole, cut = (P.forward(chosen, v.px, b, horizons, last).select("as_of", "code", "h", *[c(x).alias(x + n) for x in ("status", "gross", "excess")]) for n, b in (("1", bench(v)), ("2", bench(v).where("idx < 0"))))
    lost = whole.join(cut, ["as_of", "code", "h"])
    universe = x01(v).join(v.ref.select("code", "list_idx", "delist_idx"), "code").join(F.broadcast(v.as_of), "as_of")
    blank = components(v).withColumns({f: F.lit(None).cast("double") for f in REGISTRY["attention"]})
    # of rows that tie, the code decides; the place by code alone comes from the same frame
    tied = top(v.px.withColumn("score", F.lit(1.0)), ["idx"], [c("score").desc(), c("code")]).withColumn("place", F.row_number().over(Window.partitionBy("idx").orderBy("code")))
    told = (
        cases(p16(v), revision=(every, ~(c("before_first_empty") & c("day_before_is_first") & c("on_revision_differs"))), boundary=(every, ~c("first_visible"))),
        cases(both, future_market_row=(c("idx") <= c("first"), changed), short_history=(c("idx") <= 20, c("r1").isNotNull())),
        cases(lost, benchmark_missing=(every, ~(c("status1").eqNullSafe(c("status2")) & c("gross1").eqNullSafe(c("gross2")) & c("excess2").isNull()))),
        cases(universe, delisted=(c("delist_idx") <= c("idx"), c("reason").isNull()), pre_listing=(c("list_idx") > c("idx"), c("reason").isNull())),
        cases(assess(v, blank), missing_critical_group=(every, c("critical") == 0)),
        cases(tied, tie=(every, c("rank") != c("place"))),
    )
    return functools.reduce(DataFrame.unionByName, told)
