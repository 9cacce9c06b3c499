"""Queries on attention, sessions and reactions of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bounded, coverage_bucket, mean_known, positive_penalty, spike_penalty
from tidemark.operators import pit
from tidemark.operators.attention import FIELDS, Limits
from tidemark.operators.attention import low_attention as low_attention_gates
from tidemark.operators.joins import on_dates
from tidemark.operators.order import Figure, window_figures
from tidemark.plans.panels import BENCH, bench
from tidemark.plans.views import Views
from tidemark.registry import query


@query("F15_bounded", " SELECT event_id, round(50 + 50 * tanh(value * 0.02), 4) AS score FROM events")
def f15(v: Views) -> DataFrame:
    return v.events.select("event_id", F.round(bounded(F.col("value"), 0.02), 4).alias("score"))


@query("F16_mean_known", " SELECT p_partkey, round(CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_retailprice WHEN p_partkey % 2 = 0 THEN p_size ELSE (p_size + p_retailprice) / 2 END, 6) AS mean FROM part")
def f16(v: Views) -> DataFrame:
    size, price = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("double")), F.when(F.col("p_partkey") % 2 != 0, F.col("p_retailprice"))
    return v.part.select("p_partkey", F.round(mean_known(size, price), 6).alias("mean"))


@query("F17_penalties", " SELECT event_id, round(CASE WHEN value IS NOT NULL THEN least(greatest(value, 0) / 50, 1) END, 6) AS positive, round(CASE WHEN value IS NOT NULL THEN least(greatest(value - 1, 0) / 49, 1) END, 6) AS spike FROM events")
def f17(v: Views) -> DataFrame:
    return v.events.select("event_id", F.round(positive_penalty(F.col("value"), 50.0), 6).alias("positive"), F.round(spike_penalty(F.col("value"), 50.0), 6).alias("spike"))


@query("F21_coverage_bucket", " SELECT user_id, CASE WHEN c < 0.25 THEN '[0.00,0.25)' WHEN c < 0.5 THEN '[0.25,0.50)' WHEN c < 0.75 THEN '[0.50,0.75)' WHEN c < 0.9 THEN '[0.75,0.90)' ELSE '[0.90,1.00]' END AS bucket FROM (SELECT user_id, count(DISTINCT ts::date) / 30 AS c FROM events GROUP BY user_id)")
def f21(v: Views) -> DataFrame:
    share = v.events.groupBy("user_id").agg((F.count_distinct(F.to_date("ts")) / 30).alias("c"))
    return share.select("user_id", coverage_bucket(F.col("c")).alias("bucket"))


HOLES = "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN l_partkey % 3 <> 0 THEN l_tax END AS tax, CASE WHEN l_suppkey % 4 <> 0 THEN l_discount END AS discount FROM lineitem"
NEWEST = "l_shipdate DESC, (tax IS NOT NULL)::int + (discount IS NOT NULL)::int DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, {c} DESC"


@query("W04_session_coalesce", f", ho AS ({HOLES}) SELECT l_orderkey, l_linenumber, first(tax ORDER BY {NEWEST.format(c='tax')}) FILTER (tax IS NOT NULL) AS tax, first(discount ORDER BY {NEWEST.format(c='discount')}) FILTER (discount IS NOT NULL) AS discount FROM ho GROUP BY 1, 2")
def w04(v: Views) -> DataFrame:
    """One row a key, each column from the newest and then most complete row that has it; aggregated before the exchange."""
    rows = v.lineitem.withColumn("tax", F.when(F.col("l_partkey") % 3 != 0, F.col("l_tax"))).withColumn("discount", F.when(F.col("l_suppkey") % 4 != 0, F.col("l_discount")))
    full = F.col("tax").isNotNull().cast("int") + F.col("discount").isNotNull().cast("int")
    order = F.struct("l_shipdate", full.alias("full"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pick = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("x"))))["x"].alias(c)
    return rows.groupBy("l_orderkey", "l_linenumber").agg(pick("tax"), pick("discount"))


SUSPENDED = "(code * 31 + idx) % 97 = 0"
AXIS = f""", {BENCH}, bl AS (SELECT a.as_of, max(b.idx) AS last FROM as_of a JOIN bx b ON b.idx <= a.idx WHERE b.idx % 40 <> 0 GROUP BY 1),
  sl AS (SELECT a.as_of, p.code, max(p.idx) AS last FROM as_of a JOIN px p ON p.idx <= a.idx AND p.idx > a.idx - 60 AND NOT ((p.code * 31 + p.idx) % 97 = 0) GROUP BY 1, 2)"""


@query("W05_session_axis", f"{AXIS} SELECT a.as_of, r.code, CASE WHEN bl.last IS NULL THEN 'missing_benchmark_endpoint' WHEN sl.last IS NULL THEN 'stock_no_market_history' WHEN bl.last < a.idx THEN 'benchmark_stale_at_as_of' WHEN sl.last < a.idx AND (r.code * 31 + a.idx) % 97 = 0 THEN 'stock_suspended_at_as_of' WHEN sl.last < a.idx THEN 'stock_stale_at_as_of' END AS reason, a.idx - sl.last AS gap FROM as_of a CROSS JOIN ref r LEFT JOIN bl ON bl.as_of = a.as_of LEFT JOIN sl ON sl.as_of = a.as_of AND sl.code = r.code")
def w05(v: Views) -> DataFrame:
    """Whether each entity and the benchmark end on the anchor session of each date, or why not."""
    dates = F.broadcast(v.as_of.select("as_of", F.col("idx").alias("at")))
    marks = bench(v).where("idx % 40 <> 0").select("idx").join(dates, F.col("idx") <= F.col("at")).groupBy("as_of").agg(F.max("idx").alias("b_last"))
    near = v.px.where(f"not ({SUSPENDED})").select("code", "idx").join(dates, (F.col("idx") <= F.col("at")) & (F.col("idx") > F.col("at") - 60))
    last = near.groupBy("as_of", "code").agg(F.max("idx").alias("s_last"))
    grid = v.ref.select("code").crossJoin(F.broadcast(v.as_of)).join(F.broadcast(marks), "as_of", "left").join(last, ["as_of", "code"], "left")
    reason = (
        F.when(F.col("b_last").isNull(), "missing_benchmark_endpoint").when(F.col("s_last").isNull(), "stock_no_market_history").when(F.col("b_last") < F.col("idx"), "benchmark_stale_at_as_of")
        .when((F.col("s_last") < F.col("idx")) & F.expr(SUSPENDED), "stock_suspended_at_as_of").when(F.col("s_last") < F.col("idx"), "stock_stale_at_as_of")
    )
    return grid.select("as_of", "code", reason.alias("reason"), (F.col("idx") - F.col("s_last")).alias("gap"))


ATTENTION = """av AS (SELECT code, idx, len(list_filter(lt, lambda x: x <= turnover)) / len(lt) AS t, len(list_filter(la, lambda x: x <= amount)) / len(la) AS a, CASE WHEN n = 20 AND m > 0 THEN vol / m END AS v
  FROM (SELECT *, list(turnover) OVER w AS lt, list(amount) OVER w AS la, count(vol) OVER p AS n, avg(vol) OVER p AS m FROM px WINDOW w AS (PARTITION BY code ORDER BY idx ROWS 251 PRECEDING), p AS (PARTITION BY code ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))),
  ats AS (SELECT *, CASE WHEN v IS NOT NULL THEN 100 * (0.4 * (1 - t) + 0.4 * (1 - a) + 0.2 * (1 - least(v, 3) / 3)) END AS score FROM av)"""


def attention(v: Views, only: Column | None = None) -> DataFrame:
    """Turnover and amount among an entity's own last 252 rows, and volume against its last 20; with `only`, a condition, of the rows that meet it."""
    w = Window.partitionBy("code").orderBy("idx")
    prior = w.rowsBetween(-20, -1)
    px = v.px.select("code", "idx", "vol", "turnover", "amount").withColumns({"n": F.count("vol").over(prior), "m": F.avg("vol").over(prior), "asked": F.lit(True) if only is None else only})
    rows = window_figures(px, {"t": Figure("share", "turnover", (-251, 0)), "a": Figure("share", "amount", (-251, 0))}, only="asked")
    rows = rows.select("code", "idx", "t", "a", F.when((F.col("n") == 20) & (F.col("m") > 0), F.col("vol") / F.col("m")).alias("v"))
    score = 100 * (0.4 * (1 - F.col("t")) + 0.4 * (1 - F.col("a")) + 0.2 * (1 - F.least("v", F.lit(3.0)) / 3))
    return rows.withColumn("score", F.when(F.col("v").isNotNull(), score))


@query("X08_attention", f", {ATTENTION} SELECT code, idx, round(t, 6) AS t, round(a, 6) AS a, round(v, 6) AS v, round(score, 4) AS score FROM ats")
def x08(v: Views) -> DataFrame:
    return attention(v).select("code", "idx", *[F.round(c, 6).alias(c) for c in ("t", "a", "v")], F.round("score", 4).alias("score"))


LOW = """lw AS (SELECT *, cume_dist() OVER (PARTITION BY idx ORDER BY turnover) AS ct, cume_dist() OVER (PARTITION BY idx ORDER BY amount) AS ca,
    CASE WHEN len(lt) >= 21 THEN len(list_filter(lt, lambda x: x <= turnover)) / len(lt) END AS st, CASE WHEN len(la) >= 21 THEN len(list_filter(la, lambda x: x <= amount)) / len(la) END AS sa,
    CASE WHEN n >= 20 AND md > 0 THEN least(vol / md, 10) END AS surge
    FROM (SELECT *, coalesce(list(turnover) OVER w, []) AS lt, coalesce(list(amount) OVER w, []) AS la, count(vol) OVER m AS n, median(vol) OVER m AS md, avg(vol) OVER (PARTITION BY code ORDER BY idx ROWS 19 PRECEDING) AS mv,
      lead(idx) OVER (PARTITION BY code ORDER BY idx) AS nxt FROM px WINDOW w AS (PARTITION BY code ORDER BY idx ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY code ORDER BY idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))),
  lg AS (SELECT a.as_of, r.code, CASE WHEN l.idx IS NULL THEN 'no_data' WHEN (r.code * 31 + a.idx) % 97 = 0 THEN 'suspended_session' WHEN a.idx - l.idx > 10 THEN 'stale' WHEN l.idx < a.idx THEN 'no_observation' ELSE 'traded' END AS status,
    ct, ca, st, sa, surge, mv, CASE WHEN l.idx = a.idx THEN 1.0 END AS seen FROM as_of a CROSS JOIN ref r LEFT JOIN lw l ON l.code = r.code AND l.idx <= a.idx AND (l.nxt IS NULL OR l.nxt > a.idx)),
  lo AS (SELECT *, CASE WHEN status = 'traded' AND st IS NOT NULL AND sa IS NOT NULL THEN 100 * ((1 - ct) + (1 - ca) + (1 - st) + (1 - sa)) / 4 END AS score, coalesce(surge >= 2, false) AS surging, coalesce(status = 'traded' AND mv >= 40, false) AS liquid FROM lg),
  lc AS (SELECT *, CASE WHEN score IS NULL THEN CASE WHEN status IN ('suspended_session', 'stale', 'no_observation') THEN 'B' ELSE 'C' END WHEN NOT liquid THEN 'B' WHEN surging THEN 'not_low_attention' WHEN ct <= 0.3 AND ca <= 0.3 THEN 'A' ELSE 'not_low_attention' END AS class FROM lo)"""


def low_attention(v: Views) -> DataFrame:
    """Attention on each date against other entities and an entity's own past; unknown unless all four shares are known.

    Only the rows that are an entity's last on some date are told of. Among them are all rows of the dates' own sessions,
    so that cross-sections of these are whole; no other session's is asked for.
    """
    w = Window.partitionBy("code").orderBy("idx")
    v.keep("as_of")
    px = v.px.select("code", "idx", "vol", "turnover", "amount").withColumns({"mv": F.avg("vol").over(w.rowsBetween(-19, 0)), "nxt": F.lead("idx").over(w)})
    px = px.crossJoin(F.broadcast(v.as_of.agg(F.collect_set("idx").alias("dates"))))  # one row
    px = px.withColumn("asked", F.exists("dates", lambda d: (d >= F.col("idx")) & (F.col("nxt").isNull() | (d < F.col("nxt"))))).drop("dates")
    px = window_figures(px, {"st": Figure("share", "turnover", (-252, -1), 21), "sa": Figure("share", "amount", (-252, -1), 21), "md": Figure("median", "vol", (-60, -1), 20)}, only="asked")
    px = px.select("code", "idx", "nxt", "turnover", "amount", "mv", "st", "sa", F.when(F.col("md") > 0, F.least(F.col("vol") / F.col("md"), F.lit(10.0))).alias("surge"))
    day, whole = Window.partitionBy("idx"), F.array_contains(v.as_of.agg(F.collect_set("idx")).scalar(), F.col("idx"))
    px = px.withColumn("ct", F.when(whole, F.cume_dist().over(day.orderBy("turnover")))).withColumn("ca", F.when(whole, F.cume_dist().over(day.orderBy("amount"))))
    dates = F.broadcast(v.as_of.select("as_of", F.col("idx").alias("at")))
    last = px.join(dates, (F.col("idx") <= F.col("at")) & (F.col("nxt").isNull() | (F.col("nxt") > F.col("at")))).drop("at")
    grid = v.ref.select("code").crossJoin(F.broadcast(v.as_of.select("as_of", F.col("idx").alias("at")))).join(last, ["as_of", "code"], "left")
    halted = (F.col("code") * 31 + F.col("at")) % 97 == 0
    status = F.when(F.col("idx").isNull(), "no_data").when(halted, "suspended_session").when(F.col("at") - F.col("idx") > 10, "stale").when(F.col("idx") < F.col("at"), "no_observation").otherwise("traded")
    grid = grid.withColumn("status", status)
    traded = F.col("status") == "traded"
    score = 100 * ((1 - F.col("ct")) + (1 - F.col("ca")) + (1 - F.col("st")) + (1 - F.col("sa"))) / 4
    grid = grid.withColumns({"score": F.when(traded, score), "surging": F.coalesce(F.col("surge") >= 2, F.lit(False)), "liquid": F.coalesce(traded & (F.col("mv") >= 40), F.lit(False))})
    quiet = (F.col("ct") <= 0.3) & (F.col("ca") <= 0.3)
    case = (
        F.when(F.col("score").isNull() & F.col("status").isin("suspended_session", "stale", "no_observation"), "B").when(F.col("score").isNull(), "C").when(~F.col("liquid"), "B")
        .when(F.col("surging"), "not_low_attention").when(quiet, "A").otherwise("not_low_attention")
    )
    return grid.withColumn("class", case)


@query("X09_low_attention", f", {LOW} SELECT as_of, code, status, round(score, 4) AS score, surging, liquid, round(CASE WHEN liquid THEN score END, 4) AS opportunity FROM lc")
def x09(v: Views) -> DataFrame:
    return low_attention(v).select("as_of", "code", "status", F.round("score", 4).alias("score"), "surging", "liquid", F.round(F.when(F.col("liquid"), F.col("score")), 4).alias("opportunity"))


@query("X11_attention_cases", f", {LOW} SELECT as_of, class, code, row_number() OVER (PARTITION BY as_of, class ORDER BY round(score, 4) DESC NULLS LAST, code) AS position FROM lc")
def x11(v: Views) -> DataFrame:
    w = Window.partitionBy("as_of", "class").orderBy(F.round("score", 4).desc_nulls_last(), "code")
    return low_attention(v).select("as_of", "class", "code", F.row_number().over(w).cast("long").alias("position"))


REACTION = f""", {BENCH}, di AS (SELECT code, pn, CAST(min(ann_date) + CAST(max(code % 3) AS int) AS date) AS actual FROM income GROUP BY code, pn),
  dl AS (SELECT a.as_of, a.idx AS at, d.code, d.pn, d.actual FROM as_of a JOIN di d ON d.actual <= a.as_of QUALIFY row_number() OVER (PARTITION BY a.as_of, d.code ORDER BY d.actual DESC, d.pn DESC) = 1),
  dr AS (SELECT l.*, (SELECT min(idx) FROM cal WHERE session_date > l.actual) AS i0 FROM dl l)"""


@query("X13_disclosure_reaction", f"{REACTION} SELECT d.as_of, d.code, d.pn, CASE WHEN d.i0 IS NULL OR d.i0 + 4 > d.at THEN 'incomplete_window' WHEN p0.close IS NULL OR p1.close IS NULL THEN 'missing_price' ELSE 'observed' END AS status, round(CASE WHEN d.i0 + 4 <= d.at THEN p1.close / p0.close - 1 - (b1.close / b0.close - 1) END, 6) AS excess FROM dr d LEFT JOIN px p0 ON p0.code = d.code AND p0.idx = d.i0 LEFT JOIN px p1 ON p1.code = d.code AND p1.idx = d.i0 + 4 LEFT JOIN bx b0 ON b0.idx = d.i0 LEFT JOIN bx b1 ON b1.idx = d.i0 + 4")
def x13(v: Views) -> DataFrame:
    """Excess over the five sessions after the latest disclosure, if all of them lie on or before the date."""
    disclosed = v.income.groupBy("code", "pn").agg(F.expr("date_add(min(ann_date), cast(max(code % 3) as int))").alias("actual"))
    latest = pit.as_of(disclosed, v.as_of.select("as_of", F.col("idx").alias("at")), ["code"], "actual", ["pn"])
    spans = v.cal.withColumn("before", F.lag("session_date").over(Window.orderBy("idx"))).select(F.col("idx").alias("i0"), "session_date", "before")
    after = latest.join(F.broadcast(spans), (F.col("actual") < F.col("session_date")) & (F.col("before").isNull() | (F.col("actual") >= F.col("before"))), "left").drop("session_date", "before").withColumn("i1", F.col("i0") + 4)
    price = lambda i, p: v.px.select("code", F.col("idx").alias(i), F.col("close").alias(p))
    mark = lambda i, b: F.broadcast(bench(v).select(F.col("idx").alias(i), F.col("close").alias(b)))
    out = after.join(price("i0", "p0"), ["code", "i0"], "left").join(price("i1", "p1"), ["code", "i1"], "left").join(mark("i0", "b0"), "i0", "left").join(mark("i1", "b1"), "i1", "left")
    inside = F.col("i1") <= F.col("at")
    status = F.when(~F.coalesce(inside, F.lit(False)), "incomplete_window").when(F.col("p0").isNull() | F.col("p1").isNull(), "missing_price").otherwise("observed")
    return out.select("as_of", "code", "pn", status.alias("status"), F.round(F.when(inside, F.col("p1") / F.col("p0") - F.col("b1") / F.col("b0")), 6).alias("excess"))


#: Amounts and turnovers with gaps and days without trade; some entities are listed late, on a day of their own.
GAPS = """gp AS (SELECT code, session_date AS day, vol, CASE WHEN (code * 3 + idx) % 23 <> 0 THEN turnover END AS turnover, CASE WHEN (code + idx) % 17 = 0 THEN NULL WHEN (code + idx) % 19 = 0 THEN 0 ELSE amount END AS amount FROM px)"""
FLOOR = 45000.0
CROSS = ", ".join(f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY day) >= 20 THEN cume_dist() OVER (PARTITION BY day, {c} IS NULL ORDER BY {c}) END AS cross_{k}" for k, c in FIELDS.items())
OWN = ", ".join(f"CASE WHEN {c} IS NOT NULL AND len(l{c}) >= 21 THEN len(list_filter(l{c}, lambda x: x <= {c})) / len(l{c}) END AS self_{k}" for k, c in FIELDS.items())
LISTS = ", ".join(f"coalesce(list({c}) FILTER ({c} IS NOT NULL) OVER own, []) AS l{c}" for c in FIELDS.values())
GATES = f"""{GAPS}, ls AS (SELECT r.code, CASE WHEN r.code % 11 = 0 THEN c.session_date END AS list_day FROM ref r LEFT JOIN cal c ON c.idx = 95 + r.code % 9),
  gc AS (SELECT *, {CROSS} FROM gp), go AS (SELECT g.* FROM gc g JOIN ls l USING (code) WHERE l.list_day IS NULL OR g.day >= l.list_day),
  gs AS (SELECT * , {OWN} FROM (SELECT *, {LISTS}, CASE WHEN count(vol) OVER b >= 20 THEN median(vol) OVER b END AS bv, CASE WHEN count(turnover) OVER b >= 20 THEN median(turnover) OVER b END AS bt, avg(amount) OVER (PARTITION BY code ORDER BY day ROWS 19 PRECEDING) AS ma FROM go
    WINDOW own AS (PARTITION BY code ORDER BY day ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY code ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))),
  gq AS (SELECT a.as_of, (SELECT max(session_date) FROM px WHERE session_date <= a.as_of) AS session, l.code, l.list_day FROM as_of a CROSS JOIN ls l),
  gj AS (SELECT q.as_of, q.session, q.list_day, q.code, s.* EXCLUDE (code) FROM gq q ASOF LEFT JOIN gs s ON s.code = q.code AND s.day <= q.as_of),
  g1 AS (SELECT *, CASE WHEN day IS NULL THEN 'no_data' WHEN day = session THEN 'traded' WHEN session - day > 10 THEN 'stale' ELSE 'suspended_session' END AS status, coalesce(as_of - list_day < 120, false) AS young FROM gj),
  g2 AS (SELECT *, status = 'traded' AS t, CASE status WHEN 'stale' THEN 'stale_data' WHEN 'suspended_session' THEN status WHEN 'traded' THEN CASE WHEN young THEN 'new_listing' END ELSE 'missing_history' END AS self_reason,
    concat_ws('|', CASE WHEN ma IS NULL THEN 'unknown_liquidity' WHEN ma < {FLOOR} THEN 'low_liquidity' END, CASE WHEN status = 'traded' AND amount IS NULL THEN 'unknown_current_liquidity' WHEN status = 'traded' AND amount <= 0 THEN 'no_trading_activity' END, CASE WHEN young THEN 'new_listing' END, CASE WHEN status <> 'traded' THEN 'no_session_at_decision' END) AS liquidity_reasons FROM g1),
  g3 AS (SELECT as_of, code, status, liquidity_reasons, self_reason, CASE WHEN self_reason IS NULL THEN self_turnover END AS self_turnover, CASE WHEN self_reason IS NULL THEN self_amount END AS self_amount, CASE WHEN self_reason IS NULL THEN self_volume END AS self_volume,
    CASE WHEN t THEN cross_turnover END AS cross_turnover, CASE WHEN t THEN cross_amount END AS cross_amount, CASE WHEN t THEN cross_volume END AS cross_volume, CASE WHEN t AND bv <> 0 THEN vol / bv END AS raw, CASE WHEN t AND bt <> 0 THEN turnover / bt END AS change FROM g2),
  g4 AS (SELECT *, CASE WHEN raw >= 2 OR change >= 2 THEN true WHEN raw IS NOT NULL OR change IS NOT NULL THEN false END AS surge, 100 * ((1 - cross_turnover) + (1 - cross_amount) + (1 - self_turnover) + (1 - self_amount)) / 4 AS score FROM g3)"""
SHARES = [f"{a}_{k}" for a in ("self", "cross") for k in FIELDS]


@query("X09_gates", f", {GATES} SELECT as_of, code, status, liquidity_reasons, self_reason, {', '.join(f'round({x}, 6) AS {x}' for x in SHARES)}, round(CASE WHEN raw IS NOT NULL THEN least(raw, 10.0) END, 6) AS abnormal_volume, coalesce(raw > 10, false) AS capped, round(change, 6) AS baseline_change, surge AS attention_surge, round(score, 4) AS score, CASE WHEN score IS NOT NULL THEN liquidity_reasons = '' AND status = 'traded' AND NOT coalesce(surge, false) END AS opportunity FROM g4")
def x09_gates(v: Views) -> DataFrame:
    """Attention with every gate: status, liquidity, listing age, population, both baselines, surge, score and opportunity."""
    px = v.keep("px", "cal", "as_of").px
    c = F.col
    amount = F.when((c("code") + c("idx")) % 17 == 0, None).when((c("code") + c("idx")) % 19 == 0, 0.0).otherwise(c("amount"))
    rows = px.select("code", c("session_date").alias("day"), "vol", F.when((c("code") * 3 + c("idx")) % 23 != 0, c("turnover")).alias("turnover"), amount.alias("amount"))
    listed = v.ref.select("code", (95 + c("code") % 9).cast("int").alias("idx")).join(v.cal, "idx", "left").select("code", F.when(c("code") % 11 == 0, c("session_date")).alias("list_day"))
    out = low_attention_gates(rows, on_dates(listed, v.as_of, "as_of"), Limits(least_amount=FLOOR))
    return out.select("as_of", "code", "status", "liquidity_reasons", "self_reason", *[F.round(x, 6).alias(x) for x in [*SHARES, "abnormal_volume"]], "capped", F.round("baseline_change", 6).alias("baseline_change"), "attention_surge", F.round("score", 4).alias("score"), "opportunity")
