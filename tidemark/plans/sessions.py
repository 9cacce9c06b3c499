"""Queries on sessions, prices and references: lookups, windows, attention, outcomes and corpus audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import window_shares
from tidemark.operators.rank import top
from tidemark.plans.panels import WIN
from tidemark.plans.ranking import OUT, PICKS, outcomes, picks
from tidemark.plans.views import Views
from tidemark.registry import query
from tidemark.sources import stamp


@query("S03_projected_read", " SELECT o_orderkey, o_orderdate::date AS day, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def s03(v: Views) -> DataFrame:
    rows = v.orders.where("o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'")
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


@query("S04_bounded_frames", " SELECT a.as_of, p.code, count(*) AS n, min(p.session_date) AS first_day, max(p.session_date) AS last_day FROM as_of a JOIN px p ON p.idx <= a.idx AND p.idx > a.idx - 60 GROUP BY 1, 2")
def s04(v: Views) -> DataFrame:
    """What the last 60 sessions before each date hold of each entity."""
    dates = F.broadcast(v.as_of.select("as_of", F.col("idx").alias("at")))
    rows = v.px.join(dates, (F.col("idx") <= F.col("at")) & (F.col("idx") > F.col("at") - 60))
    return rows.groupBy("as_of", "code").agg(F.count("*").alias("n"), F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"))


@query("S08_provenance_stamp", " SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') AS retrieved_at, CASE WHEN o_orderkey % 3 = 0 THEN 'exchange' ELSE 'orders' END AS source, 'batch' AS source_api FROM orders")
def s08(v: Views) -> DataFrame:
    """Rows of two feeds, each with when and by what it was fetched: the day after its own."""
    at = F.date_format(F.date_add("o_orderdate", 1), "yyyyMMdd")
    return stamp(v.orders.select("o_orderkey", "o_orderdate"), F.when(F.col("o_orderkey") % 3 == 0, "exchange").otherwise("orders"), "batch", at).drop("o_orderdate")


@query("F24_reference_predicates", " SELECT code, board = '.BJ' AS is_bse, name LIKE 'ST%' AS is_st, delist_idx IS NULL AS listed FROM ref")
def f24(v: Views) -> DataFrame:
    return v.ref.select("code", F.col("board").endswith(".BJ").alias("is_bse"), F.ltrim("name").startswith("ST").alias("is_st"), F.isnull("delist_idx").alias("listed"))


@query("P23_latest_open", " SELECT d AS day, (SELECT max(session_date) FROM cal WHERE session_date <= d) AS session_date FROM (SELECT DISTINCT o_orderdate::date AS d FROM orders)")
def p23(v: Views) -> DataFrame:
    """The latest session on or before each day: both kinds of dates in one sorted run."""
    days = v.orders.select(F.to_date("o_orderdate").alias("day")).distinct().select("day", F.lit(None).cast("date").alias("s"))
    both = days.unionByName(v.cal.select(F.col("session_date").alias("day"), F.col("session_date").alias("s")))
    w = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("session_date", F.max("s").over(w)).where("s is null").select("day", "session_date")


@query("J03_exact_reference", " SELECT a.as_of, p.code, p.close FROM as_of a JOIN px p ON p.idx = a.idx")
def j03(v: Views) -> DataFrame:
    return v.px.join(F.broadcast(v.as_of.select("as_of", "idx")), "idx").select("as_of", "code", "close")


ADJ = "ad AS (SELECT code, idx, CASE WHEN idx > 180 AND code % 7 = 0 THEN 2.0 ELSE 1.0 END AS factor FROM px UNION ALL SELECT code, idx, 3.0 FROM px WHERE (code + idx) % 50 = 0), af AS (SELECT code, idx, count(DISTINCT factor) AS n, max(factor) AS factor FROM ad GROUP BY 1, 2)"


def adjusted(v: Views) -> DataFrame:
    """Prices times the factor of their own day; factors that differ leave it unknown."""
    rule = F.when((F.col("idx") > 180) & (F.col("code") % 7 == 0), 2.0).otherwise(1.0)
    factors = v.px.select("code", "idx", rule.alias("factor")).union(v.px.where((F.col("code") + F.col("idx")) % 50 == 0).select("code", "idx", F.lit(3.0)))
    one = factors.groupBy("code", "idx").agg(F.count_distinct("factor").alias("n"), F.max("factor").alias("factor"))
    out = v.px.join(one, ["code", "idx"], "left")
    return out.withColumn("reason", F.when(F.col("n") > 1, "ambiguous_adj_factor")).withColumn("adjusted", F.when(F.col("n") == 1, F.col("close") * F.col("factor")))


@query("J04_adjustment_merge", f", {ADJ} SELECT code, idx, CASE WHEN n = 1 THEN factor::double END AS factor, CASE WHEN n > 1 THEN 'ambiguous_adj_factor' END AS reason FROM px LEFT JOIN af USING (code, idx)")
def j04(v: Views) -> DataFrame:
    return adjusted(v).select("code", "idx", F.when(F.col("n") == 1, F.col("factor")).alias("factor"), "reason")


@query("E01_adjusted_prices", f", {ADJ} SELECT code, idx, CASE WHEN n = 1 THEN close * factor::double END AS adjusted FROM px LEFT JOIN af USING (code, idx)")
def e01(v: Views) -> DataFrame:
    return adjusted(v).select("code", "idx", "adjusted")


@query("J11_name_lookup", f"{PICKS} SELECT as_of, rank, code, s_name AS name FROM pk LEFT JOIN supplier ON s_suppkey = code")
def j11(v: Views) -> DataFrame:
    return picks(v).join(v.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")), "code", "left").select("as_of", "rank", "code", "name")


@query("G04_date_counts", " SELECT l_shipdate::date AS day, count(*) AS n FROM lineitem GROUP BY 1")
def g04(v: Views) -> DataFrame:
    return v.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))


@query("G19_union_by_name", " SELECT 'orders' AS kind, o_custkey AS party, o_orderkey AS ref_key FROM orders UNION ALL SELECT 'customers', c_custkey, NULL FROM customer")
def g19(v: Views) -> DataFrame:
    a = v.orders.select(F.lit("orders").alias("kind"), F.col("o_custkey").alias("party"), F.col("o_orderkey").alias("ref_key"))
    return a.unionByName(v.customer.select(F.lit("customers").alias("kind"), F.col("c_custkey").alias("party")), allowMissingColumns=True)


@query("G20_joint_diagnostic", f"{OUT} SELECT h, gross > 0 AS gained, excess > 0 AS ahead, count(*) AS n FROM ob WHERE status = 'observed' AND excess IS NOT NULL GROUP BY 1, 2, 3")
def g20(v: Views) -> DataFrame:
    rows = outcomes(v).where("status = 'observed' and excess is not null")
    return rows.groupBy(F.col("h").cast("int").alias("h"), (F.col("gross") > 0).alias("gained"), (F.col("excess") > 0).alias("ahead")).agg(F.count("*").alias("n"))


@query("W03_session_dedupe", " SELECT l_orderkey, l_linenumber, max(l_partkey * 1000000 + l_suppkey) AS row_key FROM lineitem GROUP BY 1, 2")
def w03(v: Views) -> DataFrame:
    """Of the rows of one key the one with the largest row key."""
    return v.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("row_key"))


@query("W09_valuation_percentile", f" SELECT code, idx, round(CASE WHEN len(b) >= 20 THEN len(list_filter(b, lambda x: x <= pe)) / len(b) END, 6) AS pct FROM (SELECT *, coalesce(list(pe) {WIN.format(a=252, b=1)}, []) AS b FROM px WHERE pe > 0)")
def w09(v: Views) -> DataFrame:
    """The share of an entity's positive values in the previous 252 sessions that are not larger."""
    rows = window_shares(v.px.where("pe > 0").select("code", "idx", "pe"), {"pct": "pe"}, (-252, -1), 20, count_rows=False)
    return rows.select("code", "idx", F.round("pct", 6).alias("pct"))


@query("W11_trailing_percentile", " SELECT code, idx, round(len(list_filter(b, lambda x: x <= turnover)) / len(b), 6) AS pct FROM (SELECT *, list(turnover) OVER (PARTITION BY code ORDER BY idx ROWS 251 PRECEDING) AS b FROM px WHERE turnover > 0)")
def w11(v: Views) -> DataFrame:
    """As W10, with the row itself and positive values only."""
    rows = window_shares(v.px.where("turnover > 0").select("code", "idx", "turnover"), {"pct": "turnover"}, (-251, 0))
    return rows.select("code", "idx", F.round("pct", 6).alias("pct"))


@query("W13_prior_row_ratio", " SELECT code, idx, round(vol / CASE WHEN n >= 20 AND m <> 0 THEN m END, 6) AS ratio FROM (SELECT *, median(vol) OVER w AS m, count(vol) OVER w AS n FROM px WINDOW w AS (PARTITION BY code ORDER BY idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))")
def w13(v: Views) -> DataFrame:
    w = Window.partitionBy("code").orderBy("idx").rowsBetween(-60, -1)
    rows = v.px.withColumn("n", F.count("vol").over(w)).withColumn("m", F.percentile("vol", F.lit(0.5)).over(w))
    return rows.select("code", "idx", F.round(F.when((F.col("n") >= 20) & (F.col("m") != 0), F.col("vol") / F.col("m")), 6).alias("ratio"))


@query("K07_first_of_year", " SELECT year(session_date)::int AS yr, min(session_date) AS first_session, count(*) AS sessions FROM cal GROUP BY 1")
def k07(v: Views) -> DataFrame:
    return v.cal.groupBy(F.year("session_date").alias("yr")).agg(F.min("session_date").alias("first_session"), F.count("*").alias("sessions"))


@query("K08_latest_reference", " SELECT o_custkey AS code, o_orderkey AS ref_key FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def k08(v: Views) -> DataFrame:
    """The last snapshot row of each code, pre-aggregated before the exchange."""
    last = F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"]
    return v.orders.groupBy(F.col("o_custkey").alias("code")).agg(last.alias("ref_key"))


@query("X02_suspended", " SELECT a.as_of, r.code, EXISTS (SELECT 1 FROM halts h WHERE h.code = r.code AND h.idx = a.idx AND h.kind = 'S') AS suspended FROM as_of a CROSS JOIN ref r")
def x02(v: Views) -> DataFrame:
    """Whether a dated table of halts has the entity on the day; of typed rows only halts count, not their ends."""
    grid = v.ref.select("code").join(F.broadcast(v.as_of.select("as_of", "idx")))
    halts = v.halts.where("kind = 'S'").select("code", "idx", F.lit(True).alias("halted"))
    return grid.join(halts, ["code", "idx"], "left").select("as_of", "code", F.coalesce("halted", F.lit(False)).alias("suspended"))


@query("X10_population", " SELECT a.as_of, p.code, p.session_date FROM (SELECT a.as_of, max(c.idx) AS idx FROM as_of a JOIN px c ON c.idx <= a.idx GROUP BY 1) a JOIN px p ON p.idx = a.idx JOIN ref r ON r.code = p.code WHERE r.board <> '.BJ'")
def x10(v: Views) -> DataFrame:
    """Entities that may be invested in and traded in the last session on or before each date."""
    held = v.px.select("idx").distinct()
    at = v.as_of.select("as_of", F.col("idx").alias("at")).join(F.broadcast(held), F.col("idx") <= F.col("at")).groupBy("as_of").agg(F.max("idx").alias("idx"))
    return v.px.join(F.broadcast(at), "idx").join(v.ref.where("board <> '.BJ'").select("code"), "code", "left_semi").select("as_of", "code", "session_date")


@query("E03_delist_adjusted", f"{OUT} SELECT as_of, code, h, round(CASE WHEN gross IS NULL AND status <> 'incomplete_market_window' AND d.delist_idx > o.idx AND d.delist_idx <= o.idx + h THEN -1.0 ELSE CASE WHEN status = 'observed' THEN gross END END, 6) AS adjusted FROM (SELECT ob.*, a.idx FROM ob JOIN as_of a USING (as_of)) o JOIN ref d USING (code)")
def e03(v: Views) -> DataFrame:
    """An entity delisted before the exit and without a price there is taken to have lost all."""
    rows = outcomes(v).join(v.ref.select("code", "delist_idx"), "code")
    gone = F.col("gross").isNull() & (F.col("status") != "incomplete_market_window") & (F.col("delist_idx") > F.col("idx")) & (F.col("delist_idx") <= F.col("exit_idx"))
    return rows.select("as_of", "code", F.col("h").cast("int").alias("h"), F.round(F.when(gone, -1.0).otherwise(F.col("gross")), 6).alias("adjusted"))


@query("E12_stability_segments", f"{OUT} SELECT h, CASE WHEN b >= 0.05 THEN 'up' WHEN b <= -0.05 THEN 'down' ELSE 'flat' END AS regime, count(*) AS n, round(avg(gross), 6) AS mean FROM (SELECT h, gross, gross - excess AS b FROM ob WHERE excess IS NOT NULL AND status = 'observed') GROUP BY 1, 2")
def e12(v: Views) -> DataFrame:
    """Outcomes by what the benchmark did over the same sessions."""
    b = F.col("gross") - F.col("excess")
    rows = outcomes(v).where("excess is not null")
    return rows.groupBy(F.col("h").cast("int").alias("h"), F.when(b >= 0.05, "up").when(b <= -0.05, "down").otherwise("flat").alias("regime")).agg(F.count("*").alias("n"), F.round(F.avg("gross"), 6).alias("mean"))


@query("A10_determinism", " SELECT as_of, count(*) AS n, 0::bigint AS differing FROM (SELECT a.as_of, p.code, row_number() OVER (PARTITION BY a.as_of ORDER BY p.vol DESC, p.code) AS rank FROM as_of a JOIN px p ON p.idx = a.idx) WHERE rank <= 20 GROUP BY 1")
def a10(v: Views) -> DataFrame:
    """Two runs of one ranking, compared row by row."""
    a = picks(v).select("as_of", "code", F.col("rank").alias("ra"))
    b = top(v.px.join(v.as_of, "idx").repartition("code"), ["as_of"], [F.col("vol").desc(), F.col("code")], 20).select("as_of", "code", F.col("rank").alias("rb"))
    both = a.join(b, ["as_of", "code"], "full_outer")
    return both.groupBy("as_of").agg(F.count("ra").alias("n"), F.count_if(~F.col("ra").eqNullSafe(F.col("rb"))).alias("differing"))


@query("A14_size_attribution", " SELECT event_type, count(*) AS n, sum(length(props))::bigint AS chars FROM events GROUP BY 1")
def a14(v: Views) -> DataFrame:
    return v.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("chars"))


@query("A15_symbol_history", " SELECT r.code, p.lo AS price_from, p.hi AS price_to, f.lo AS line_from, f.hi AS line_to FROM ref r LEFT JOIN (SELECT code, min(session_date) AS lo, max(session_date) AS hi FROM px GROUP BY 1) p USING (code) LEFT JOIN (SELECT l_suppkey AS code, min(l_shipdate)::date AS lo, max(l_shipdate)::date AS hi FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) f USING (code)")
def a15(v: Views) -> DataFrame:
    prices = v.px.groupBy("code").agg(F.min("session_date").alias("price_from"), F.max("session_date").alias("price_to"))
    lines = v.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("code")).agg(F.to_date(F.min("l_shipdate")).alias("line_from"), F.to_date(F.max("l_shipdate")).alias("line_to"))
    return v.ref.select("code").join(prices, "code", "left").join(lines, "code", "left")


@query("A19_acceptance_gate", " SELECT l_linenumber AS unit, CASE WHEN bool_or(l_quantity <= 0) OR min(l_shipdate) < TIMESTAMP '1995-01-01' OR max(l_shipdate) >= TIMESTAMP '2001-11-01' THEN 'quarantine' ELSE 'accepted' END AS route, count(*) AS n FROM lineitem GROUP BY 1")
def a19(v: Views) -> DataFrame:
    """A batch with fatal values or dates out of its range is set aside whole."""
    fatal = F.bool_or(F.col("l_quantity") <= 0) | (F.min("l_shipdate") < F.lit("1995-01-01").cast("timestamp")) | (F.max("l_shipdate") >= F.lit("2001-11-01").cast("timestamp"))
    return v.lineitem.groupBy(F.col("l_linenumber").alias("unit")).agg(F.when(fatal, "quarantine").otherwise("accepted").alias("route"), F.count("*").alias("n"))
