"""Queries on the panel of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import positive_penalty, spike_penalty
from tidemark.operators import panel as P
from tidemark.plans.views import Views
from tidemark.registry import query


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


WIN = "OVER (PARTITION BY code ORDER BY idx RANGE BETWEEN {a} PRECEDING AND {b} PRECEDING)"


@query("P25_session_axis", " SELECT session_date, idx FROM cal")
def p25(v: Views) -> DataFrame:
    days = v.table("lineitem").select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("session_date")).distinct()
    return days.withColumn("idx", F.row_number().over(Window.orderBy("session_date")))


@query("P19_monthly_schedule", " SELECT date_trunc('month', session_date)::date AS month, min(session_date) AS as_of FROM cal WHERE day(session_date) >= 15 GROUP BY 1")
def p19(v: Views) -> DataFrame:
    """Per month the first open session on or after the 15th."""
    return v.cal.where(F.dayofmonth("session_date") >= 15).groupBy(F.to_date(F.date_trunc("month", "session_date")).alias("month")).agg(F.min("session_date").alias("as_of"))


@query("P24_period_spine", " SELECT o.code, y AS yr, s.q, make_date(y::int, (s.q * 3)::int, CASE WHEN s.q IN (1, 4) THEN 31 ELSE 30 END) AS end_date, r.code IS NOT NULL AS reported FROM (SELECT c_nationkey AS code, unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS y FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) o CROSS JOIN (SELECT unnest(range(1, 5)) AS q) s LEFT JOIN q_first r ON r.code = o.code AND r.yr = y AND r.q = s.q")
def p24(v: Views) -> DataFrame:
    """Q1 to FY of every year from an entity's first to its last, and whether it reported them."""
    years = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("code")).agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    spine = years.select("code", F.explode(F.sequence("a", "b")).alias("yr")).select("code", "yr", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("q"))
    held = v.q_first.select("code", "yr", "q", F.lit(True).alias("r"))
    end = F.last_day(F.make_date("yr", F.col("q") * 3, F.lit(1)))
    return spine.join(held, ["code", "yr", "q"], "left").select("code", F.col("yr").cast("long").alias("yr"), F.col("q").cast("long").alias("q"), end.alias("end_date"), F.coalesce("r", F.lit(False)).alias("reported"))


BENCH = "bx AS (SELECT b.*, c.idx FROM bench b JOIN cal c USING (session_date))"
REGIME = f""", {BENCH}, rg AS (SELECT *, close / lag(close, 60) OVER w - 1 AS change, close / max(close) OVER (ORDER BY idx ROWS 251 PRECEDING) - 1 AS fall, count(CASE WHEN close > 0 THEN 1 END) OVER (ORDER BY idx ROWS 251 PRECEDING) AS n FROM bx WINDOW w AS (ORDER BY idx)),
  reg AS (SELECT *, CASE WHEN n < 252 THEN NULL WHEN change >= 0.1 AND fall > -0.2 THEN 'bull' WHEN change <= -0.1 OR fall <= -0.2 THEN 'bear' ELSE 'range' END AS regime FROM rg)"""


def bench(v: Views) -> DataFrame:
    return v.bench.join(v.cal, "session_date")


@query("P20_regime", f"{REGIME} SELECT session_date, round(change, 6) AS change, round(fall, 6) AS fall, regime FROM reg")
def p20(v: Views) -> DataFrame:
    return P.regime(bench(v), 60, 252).select("session_date", *r6("change", "fall"), "regime")


@query("P21_schedule_regime", f"{REGIME} SELECT s.month, s.as_of, r.regime FROM (SELECT date_trunc('month', session_date)::date AS month, min(session_date) AS as_of FROM cal WHERE day(session_date) >= 15 GROUP BY 1) s JOIN reg r ON r.session_date = s.as_of")
def p21(v: Views) -> DataFrame:
    return p19(v).join(P.regime(bench(v), 60, 252).select(F.col("session_date").alias("as_of"), "regime"), "as_of")


@query("W01_percent_rank", " SELECT code, idx, round(percent_rank() OVER (PARTITION BY code ORDER BY pe), 6) AS pr FROM px")
def w01(v: Views) -> DataFrame:
    return v.px.select("code", "idx", F.round(F.percent_rank().over(Window.partitionBy("code").orderBy("pe")), 6).alias("pr"))


@query("W02_count_over", " SELECT code, idx, count(*) OVER (PARTITION BY code) AS n FROM px")
def w02(v: Views) -> DataFrame:
    return v.px.select("code", "idx", F.count("*").over(Window.partitionBy("code")).alias("n"))


@query("W06_window_return", f", {BENCH} SELECT p.code, p.idx, round(p.close / a.close - 1, 6) AS ret, round(p.close / a.close - 1 - (b.close / c.close - 1), 6) AS excess FROM px p LEFT JOIN px a ON a.code = p.code AND a.idx = p.idx - 20 JOIN bx b ON b.idx = p.idx LEFT JOIN bx c ON c.idx = p.idx - 20")
def w06(v: Views) -> DataFrame:
    b = bench(v)
    b = b.withColumn("bret", F.col("close") / F.lag("close", 20).over(Window.orderBy("idx")) - 1).select("idx", "bret")
    return P.window_return(v.px, 20).join(F.broadcast(b), "idx").select("code", "idx", *r6("ret"), F.round(F.col("ret") - F.col("bret"), 6).alias("excess"))


@query("W07_prior_high", f" SELECT code, idx, round(close / CASE WHEN n >= 60 THEN high END - 1, 6) AS below_high FROM (SELECT *, max(close) {WIN.format(a=252, b=1)} AS high, count(close) {WIN.format(a=252, b=1)} AS n FROM px)")
def w07(v: Views) -> DataFrame:
    return P.prior_high(v.px, 252, 60).select("code", "idx", *r6("below_high"))


@query("W08_median_ratio", f" SELECT code, idx, round(vol / CASE WHEN n >= 20 THEN m END, 6) AS ratio FROM (SELECT *, median(vol) {WIN.format(a=60, b=1)} AS m, count(vol) {WIN.format(a=60, b=1)} AS n FROM px)")
def w08(v: Views) -> DataFrame:
    return P.prior_median_ratio(v.px, "vol", 60, 20).select("code", "idx", *r6("ratio"))


@query("W10_self_percentile", " SELECT code, idx, round(CASE WHEN len(b) >= 21 THEN len(list_filter(b, lambda x: x <= turnover)) / len(b) END, 6) AS pct FROM (SELECT *, coalesce(list(turnover) OVER (PARTITION BY code ORDER BY idx ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), []) AS b FROM px)")
def w10(v: Views) -> DataFrame:
    return P.self_percentile(v.px.select("code", "idx", "turnover"), "turnover", 252, 21).select("code", "idx", *r6("pct"))


@query("W12_cross_percentile", " SELECT code, idx, round(CASE WHEN count(*) OVER (PARTITION BY idx) >= 20 THEN cume_dist() OVER (PARTITION BY idx ORDER BY turnover) END, 6) AS pct FROM px")
def w12(v: Views) -> DataFrame:
    return P.cross_percentile(v.px, "idx", "turnover", 20).select("code", "idx", *r6("pct"))


@query("W14_trailing_mean", " SELECT code, idx, round(avg(vol) OVER (PARTITION BY code ORDER BY idx ROWS 19 PRECEDING), 6) AS mean FROM px")
def w14(v: Views) -> DataFrame:
    return P.trailing_mean(v.px, "vol", 20).select("code", "idx", *r6("mean"))


@query("W17_cap_terciles", " SELECT idx, code, CASE WHEN p <= 1/3 THEN 'small' WHEN p <= 2/3 THEN 'mid' ELSE 'large' END AS bucket FROM (SELECT idx, code, (row_number() OVER (PARTITION BY idx ORDER BY vol, code) - 0.5) / count(*) OVER (PARTITION BY idx) AS p FROM px WHERE vol > 0)")
def w17(v: Views) -> DataFrame:
    from tidemark.operators.rank import terciles

    return terciles(v.px, ["idx"], "vol", "code").select("idx", "code", "bucket")


@query("W18_forward_eligible", " SELECT session_date, idx + 20 <= max(idx) OVER () AS h20, idx + 60 <= max(idx) OVER () AS h60, idx + 120 <= max(idx) OVER () AS h120, idx + 250 <= max(idx) OVER () AS h250, greatest(0, idx + 250 - max(idx) OVER ()) AS censored FROM cal")
def w18(v: Views) -> DataFrame:
    """Which horizons end within the calendar, and how many sessions the longest one lacks."""
    last = v.cal.agg(F.max("idx")).scalar()
    return v.cal.select("session_date", *[(F.col("idx") + h <= last).alias(f"h{h}") for h in (20, 60, 120, 250)], F.greatest(F.lit(0), F.col("idx") + 250 - last).alias("censored"))


@query("W19_nth_session", " SELECT a.as_of, c.session_date AS target FROM as_of a LEFT JOIN cal c ON c.idx = a.idx + 20")
def w19(v: Views) -> DataFrame:
    return v.as_of.join(v.cal.select((F.col("idx") - 20).alias("idx"), F.col("session_date").alias("target")), "idx", "left").select("as_of", "target")


@query("X12_crowding_penalties", f" SELECT code, idx, round(CASE WHEN r IS NOT NULL THEN least(greatest(r, 0) / 0.3, 1) END, 6) AS momentum, round(CASE WHEN s IS NOT NULL THEN least(greatest(s - 1, 0) / 2.0, 1) END, 6) AS spike FROM (SELECT p.code, p.idx, p.close / a.close - 1 AS r, p.vol / CASE WHEN p.n >= 20 THEN p.m END AS s FROM (SELECT *, median(vol) {WIN.format(a=60, b=1)} AS m, count(vol) {WIN.format(a=60, b=1)} AS n FROM px) p LEFT JOIN px a ON a.code = p.code AND a.idx = p.idx - 20)")
def x12(v: Views) -> DataFrame:
    px = P.prior_median_ratio(P.window_return(v.px, 20), "vol", 60, 20)
    return px.select("code", "idx", F.round(positive_penalty(F.col("ret"), 0.3), 6).alias("momentum"), F.round(spike_penalty(F.col("ratio"), 3.0), 6).alias("spike"))


@query("X01_universe", " SELECT a.as_of, r.code, CASE WHEN r.name LIKE 'ST%' THEN 'st_status' WHEN r.delist_idx <= a.idx THEN 'delisted_by_as_of' WHEN r.board = '.BJ' THEN 'bse_excluded' WHEN r.list_idx > a.idx THEN 'listed_after_as_of' WHEN a.idx - r.list_idx < 17 THEN 'new_listing' WHEN m.n IS NULL THEN 'unknown_liquidity' WHEN m.m < 40 THEN 'low_liquidity' WHEN t.code IS NULL THEN 'suspended_on_as_of' END AS reason FROM as_of a CROSS JOIN ref r LEFT JOIN (SELECT a.as_of, p.code, count(*) AS n, avg(vol) AS m FROM as_of a JOIN px p ON p.idx <= a.idx AND p.idx > a.idx - 20 GROUP BY 1, 2) m ON m.as_of = a.as_of AND m.code = r.code LEFT JOIN px t ON t.code = r.code AND t.idx = a.idx")
def x01(v: Views) -> DataFrame:
    """One decision for each entity and date; the first rule that fails gives the reason."""
    grid = v.ref.join(F.broadcast(v.as_of))
    # dates stand among an entity's sessions as rows without a volume; a frame of 20 sessions ends at each
    both = v.px.select("code", "idx", "vol").unionByName(grid.select("code", "idx", "as_of"), allowMissingColumns=True)
    near = P.sessions(-19, 0)
    mean = both.withColumns({"m": F.avg("vol").over(near), "traded": F.count("vol").over(P.sessions(0, 0)) > 0})
    liquid = mean.where("as_of is not null").select("as_of", "code", "m", "traded")
    why = (
        F.when(F.col("name").startswith("ST"), "st_status").when(F.col("delist_idx") <= F.col("idx"), "delisted_by_as_of").when(F.col("board") == ".BJ", "bse_excluded")
        .when(F.col("list_idx") > F.col("idx"), "listed_after_as_of").when(F.col("idx") - F.col("list_idx") < 17, "new_listing").when(F.col("m").isNull(), "unknown_liquidity")
        .when(F.col("m") < 40, "low_liquidity").when(~F.coalesce("traded", F.lit(False)), "suspended_on_as_of")
    )
    return grid.join(liquid, ["as_of", "code"], "left").select("as_of", "code", why.alias("reason"))
