"""Queries on schedules, anchors of windows, and whether the scan of each date may be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.checks import a09_full
from tidemark.plans.history import MONTHS, months
from tidemark.plans.panels import bench
from tidemark.plans.replay import RANKED, ranked
from tidemark.plans.views import Views
from tidemark.registry import query

#: The calendar at hand ends with this session, and the benchmark lacks every fortieth.
END, BACK = 320, 20
ANCHORS = f"""cb AS (SELECT b.close, c.idx FROM bench b JOIN cal c USING (session_date) WHERE c.idx % 40 <> 0), gr AS (SELECT a.as_of, a.idx, least(a.idx, {END}) AS anchor, r.code FROM as_of a CROSS JOIN ref r),
  qs AS (SELECT code, min(idx) AS first, min(CASE WHEN idx > {END} THEN idx END) AS beyond FROM quotes GROUP BY code), bs AS (SELECT min(idx) AS beyond FROM cb WHERE idx > {END})"""


@query("W05_window_anchor", f""", {ANCHORS}, an AS (SELECT g.as_of, g.code, g.anchor, CASE WHEN s.first IS NULL OR s.first > g.idx THEN 'stock_no_market_history' WHEN s.beyond <= g.idx OR bs.beyond <= g.idx THEN 'calendar_stale'
    WHEN q0.raw IS NULL OR q0.raw <= 0 THEN CASE WHEN h.code IS NOT NULL THEN 'stock_suspended_at_as_of' ELSE 'stock_stale_at_as_of' END WHEN b0.close IS NULL THEN 'benchmark_stale_at_as_of' WHEN g.anchor <= {BACK} THEN 'insufficient_benchmark_history'
    WHEN q1.raw IS NULL THEN 'stock_missing_at_window_start' WHEN b1.close IS NULL THEN 'benchmark_missing_at_window_start' WHEN q1.raw <= 0 OR b1.close <= 0 THEN 'invalid_window_price' END AS reason, q0.raw AS s0, q1.raw AS s1, b0.close AS m0, b1.close AS m1
    FROM gr g CROSS JOIN bs LEFT JOIN qs s ON s.code = g.code LEFT JOIN quotes q0 ON q0.code = g.code AND q0.idx = g.anchor LEFT JOIN quotes q1 ON q1.code = g.code AND q1.idx = g.anchor - {BACK} LEFT JOIN cb b0 ON b0.idx = g.anchor LEFT JOIN cb b1 ON b1.idx = g.anchor - {BACK}
    LEFT JOIN (SELECT DISTINCT code, idx FROM halts WHERE kind = 'S') h ON h.code = g.code AND h.idx = g.anchor)
  SELECT as_of, code, reason, round(CASE WHEN reason IS NULL THEN s0 / s1 - m0 / m1 END, 6) AS excess FROM an""")
def w05_anchor(v: Views) -> DataFrame:
    """The excess return of a window that ends on each date's anchor session, or the first of eight reasons why there is none."""
    v.keep("px", "as_of", "cal", "bench")
    c, quotes = F.col, v.over(v.px, "quotes")
    marks = bench(v).where("idx % 40 <> 0").select("idx", "close")
    held = quotes.groupBy("code").agg(F.min("idx").alias("first"), F.min(F.when(c("idx") > END, c("idx"))).alias("beyond"))
    grid = v.ref.select("code").join(F.broadcast(v.as_of.select("as_of", "idx"))).withColumn("anchor", F.least("idx", F.lit(END))).withColumn("start", c("anchor") - BACK)
    price = lambda at, name: quotes.select("code", c("idx").alias(at), c("raw").alias(name))
    mark = lambda at, name: F.broadcast(marks.select(c("idx").alias(at), c("close").alias(name)))
    halted = v.halts.where("kind = 'S'").select("code", c("idx").alias("anchor"), F.lit(True).alias("halted")).distinct()
    rows = grid.join(held, "code", "left").join(price("anchor", "s0"), ["code", "anchor"], "left").join(price("start", "s1"), ["code", "start"], "left").join(mark("anchor", "m0"), "anchor", "left").join(mark("start", "m1"), "start", "left").join(halted, ["code", "anchor"], "left")
    later = marks.where(c("idx") > END).agg(F.min("idx")).scalar()
    reason = (
        F.when(c("first").isNull() | (c("first") > c("idx")), "stock_no_market_history").when((c("beyond") <= c("idx")) | (later <= c("idx")), "calendar_stale")
        .when(c("s0").isNull() | (c("s0") <= 0), F.when(c("halted"), "stock_suspended_at_as_of").otherwise("stock_stale_at_as_of")).when(c("m0").isNull(), "benchmark_stale_at_as_of").when(c("anchor") <= BACK, "insufficient_benchmark_history")
        .when(c("s1").isNull(), "stock_missing_at_window_start").when(c("m1").isNull(), "benchmark_missing_at_window_start").when((c("s1") <= 0) | (c("m1") <= 0), "invalid_window_price")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select("as_of", "code", "reason", F.round(F.when(c("reason").isNull(), c("s0") / c("s1") - c("m0") / c("m1")), 6).alias("excess"))


PINNED = ("1997-03-01", "1999-09-01")
TARGETS = f"""{MONTHS}, tg AS (SELECT month, regime, CASE WHEN n = (t - 1) // 2 + 1 THEN 'lower_median' END AS a, CASE WHEN month IN ({', '.join(f"DATE '{p}'" for p in PINNED)}) THEN 'pinned' END AS b, CASE WHEN month = last THEN 'latest' END AS c
  FROM (SELECT *, row_number() OVER (PARTITION BY year(month), regime ORDER BY month) AS n, count(*) OVER (PARTITION BY year(month), regime) AS t, max(month) OVER () AS last FROM ms))"""


@query("P22_sample_targets", f"{TARGETS} SELECT month, regime, concat_ws('|', a, b, c) AS roles FROM tg WHERE coalesce(a, b, c) IS NOT NULL")
def p22_targets(v: Views) -> DataFrame:
    """Of each year and regime the lower median month, with the pinned ones and the latest."""
    c, w = F.col, Window.partitionBy(F.year("month"), "regime")
    last = months(v).agg(F.max("month")).scalar()
    rows = months(v).withColumns({"n": F.row_number().over(w.orderBy("month")), "t": F.count("*").over(w)})
    roles = F.concat_ws("|", F.when(F.expr("n = (t - 1) div 2 + 1"), "lower_median"), F.when(c("month").cast("string").isin(*PINNED), "pinned"), F.when(c("month") == last, "latest"))
    return rows.select("month", "regime", roles.alias("roles")).where("roles <> ''")


SPACED = 3


@query("K06_review_months", f"{MONTHS} SELECT regime, month, n::bigint AS position FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY month) - 1 AS n, count(*) OVER (PARTITION BY regime) AS t FROM ms) WHERE n IN (0, (t - 1) // 2, t - 1)")
def k06_months(v: Views) -> DataFrame:
    """Of each regime three months spread evenly from its first to its last; the number is the operator's own."""
    w = Window.partitionBy("regime")
    rows = months(v).withColumns({"n": F.row_number().over(w.orderBy("month")) - 1, "t": F.count("*").over(w)})
    spread = F.exists(F.sequence(F.lit(0), F.lit(SPACED - 1)), lambda i: F.col("n") == F.floor(i * (F.col("t") - 1) / (SPACED - 1)))
    return rows.where(spread).select("regime", "month", F.col("n").cast("long").alias("position"))


@query("X20_audited_dates", f""", {RANKED}, {MONTHS[2:]}, ru AS (SELECT as_of, count(*) AS n, max(rank) - count(*) AS gap, count(*) FILTER (attention IS NULL OR expectation IS NULL) AS incomplete, count(*) FILTER (gate = 'rejected') AS rejected, round(avg(score), 4) AS mean FROM rk GROUP BY as_of),
  le AS (SELECT as_of, count(*) FILTER (ann_date > as_of OR end_date > as_of) AS leaks FROM k GROUP BY as_of), ri AS (SELECT a.as_of, count(*) AS missing FROM as_of a JOIN ref r ON NOT EXISTS (SELECT 1 FROM px p WHERE p.code = r.code AND p.idx = a.idx) GROUP BY a.as_of)
  SELECT a.as_of, m.regime, CASE WHEN coalesce(ru.n, 0) = 0 THEN 'UNAVAILABLE' WHEN le.leaks > 0 OR ru.gap <> 0 THEN 'FAILED' WHEN ru.incomplete = ru.n THEN 'INCOMPLETE' ELSE 'READY' END AS status, coalesce(ru.n, 0) AS n, coalesce(ri.missing, 0) AS missing_inputs, ru.incomplete, ru.rejected, ru.mean
  FROM as_of a LEFT JOIN ru ON ru.as_of = a.as_of LEFT JOIN le ON le.as_of = a.as_of LEFT JOIN ri ON ri.as_of = a.as_of LEFT JOIN (SELECT month, regime FROM ms) m ON m.month = date_trunc('month', a.as_of)::date""")
def x20_audited(v: Views) -> DataFrame:
    """Each date's scan with its regime, the inputs that lack, and what the audit of leaks and ranks says of it."""
    c = F.col
    audit = a09_full(v).select("as_of", "n", (c("late_available") + c("late_period")).alias("leaks"), "rank_gap")
    parts = v.once("ranked", lambda: ranked(v)).groupBy("as_of").agg(F.count_if(c("attention").isNull() | c("expectation").isNull()).alias("incomplete"), F.count_if(c("gate") == "rejected").alias("rejected"), F.round(F.avg("score"), 4).alias("mean"))
    dates = v.as_of.select("as_of", "idx")
    lacking = v.ref.select("code").join(F.broadcast(dates)).join(v.px.select("code", "idx"), ["code", "idx"], "left_anti").groupBy("as_of").agg(F.count("*").alias("missing"))
    rows = dates.join(audit, "as_of", "left").join(parts, "as_of", "left").join(lacking, "as_of", "left").withColumn("month", F.to_date(F.date_trunc("month", "as_of"))).join(F.broadcast(months(v).select("month", "regime")), "month", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "UNAVAILABLE").when((c("leaks") > 0) | (c("rank_gap") != 0), "FAILED").when(c("incomplete") == n, "INCOMPLETE").otherwise("READY")
    return rows.select("as_of", "regime", status.alias("status"), n.alias("n"), F.coalesce("missing", F.lit(0)).alias("missing_inputs"), "incomplete", "rejected", "mean")
