"""Queries that join frames by key, date and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.plans.views import Views
from tidemark.registry import query

DAILY, BASIC = "(code + idx) % 5 <> 0", "(code + idx) % 7 <> 0"


@query("J01_full_outer", f" SELECT code, idx, a.close, a.vol, b.close AS close_basic, b.pe FROM (SELECT code, idx, close, vol FROM px WHERE {DAILY}) a FULL JOIN (SELECT code, idx, close * 2 AS close, pe FROM px WHERE {BASIC}) b USING (code, idx)")
def j01(v: Views) -> DataFrame:
    """Prices and valuations of each session, with rows that only one side has; both have a close."""
    daily = v.px.where(DAILY).select("code", "idx", "close", "vol")
    basic = v.px.where(BASIC).select("code", "idx", (F.col("close") * 2).alias("close"), "pe")
    return J.outer_frame(daily, basic, ["code", "idx"])


#: A dated reference: prices, some sessions of which have no date, and some days two rows.
REFERENCE = """rd AS (SELECT code, CASE WHEN (code + idx) % 11 <> 0 THEN session_date END AS trade_date, close, idx * 2 AS arrival FROM px WHERE (code * 7 + idx) % 4 <> 0
  UNION ALL SELECT code, session_date, close * 2, idx * 2 + 1 FROM px WHERE (code + idx) % 13 = 0)"""


@query("J02_as_of_reference", f", {REFERENCE} SELECT a.as_of, r.code, d.trade_date AS last_date, d.close FROM (as_of a CROSS JOIN ref r) ASOF LEFT JOIN (SELECT * FROM rd WHERE trade_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY arrival DESC) = 1) d ON d.code = r.code AND d.trade_date <= a.as_of")
def j02(v: Views) -> DataFrame:
    """The reference row that held on each date, for every entity and date; none before the first."""
    px = v.px
    dated = F.when((F.col("code") + F.col("idx")) % 11 != 0, F.col("session_date"))
    first = px.where("(code * 7 + idx) % 4 <> 0").select("code", dated.alias("trade_date"), "close", (F.col("idx") * 2).alias("arrival"))
    again = px.where("(code + idx) % 13 = 0").select("code", F.col("session_date").alias("trade_date"), (F.col("close") * 2).alias("close"), (F.col("idx") * 2 + 1).alias("arrival"))
    grid = J.on_dates(v.ref.select("code"), v.as_of, "as_of")
    out = J.reference_row(grid, first.unionByName(again), ["code"], "as_of", "arrival")
    return out.select("as_of", "code", F.col("match.trade_date").alias("last_date"), F.col("match.close").alias("close"))


@query("J02_undated_reference", " SELECT c_custkey AS code, o.o_orderkey AS ref_key, o.o_orderstatus AS status FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) o ON o_custkey = c_custkey")
def j02_undated(v: Views) -> DataFrame:
    """Of a reference that isn't dated, the row that arrived last."""
    ref = v.orders.select(F.col("o_custkey").alias("code"), "o_orderkey", "o_orderstatus")
    left = v.customer.select(F.col("c_custkey").alias("code"), F.current_date().alias("day"))
    out = J.reference_row(left, ref, ["code"], "day", "o_orderkey")
    return out.select("code", F.col("match.o_orderkey").alias("ref_key"), F.col("match.o_orderstatus").alias("status"))


@query("J07_population", " SELECT p.code, p.idx FROM px p WHERE EXISTS (SELECT 1 FROM ref r WHERE r.code = p.code AND r.board <> '.BJ') AND NOT EXISTS (SELECT 1 FROM halts h WHERE h.code = p.code AND h.idx = p.idx AND h.kind = 'S')")
def j07(v: Views) -> DataFrame:
    """Sessions of the entities that may be held, without those on which they were halted."""
    rows = J.members(v.px.select("code", "idx"), v.ref.where("board <> '.BJ'"), ["code"])
    return J.others(rows, v.halts.where("kind = 'S'"), ["code", "idx"])


@query("J10_overlap", """ SELECT idx, left_n, right_n, both_n, left_n - both_n AS left_only, right_n - both_n AS right_only, round(coverage, 6) AS coverage, warnings, CASE WHEN warnings = '' THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (SELECT *, concat_ws('|', CASE WHEN least(left_n, right_n) < 20 THEN 'abnormally_low_symbol_count' END, CASE WHEN coverage < 0.98 THEN 'low_join_coverage' END) AS warnings
    FROM (SELECT *, both_n / greatest(left_n, right_n) AS coverage FROM (SELECT idx, count(a.code) AS left_n, count(b.code) AS right_n, count(CASE WHEN a.code = b.code THEN 1 END) AS both_n
      FROM (SELECT code, idx FROM px WHERE (code + idx) % 53 <> 0) a FULL JOIN (SELECT code, idx FROM px WHERE (code + idx) % 59 <> 0) b USING (code, idx) GROUP BY idx)))""")
def j10(v: Views) -> DataFrame:
    """Entities that two datasets have on each session, of which each lacks a few; at least 20 are expected."""
    left, right = v.px.where("(code + idx) % 53 <> 0"), v.px.where("(code + idx) % 59 <> 0")
    return J.overlap(left, right, ["idx"], "code", least=20).withColumn("coverage", F.round("coverage", 6)).select("idx", "left_n", "right_n", "both_n", "left_only", "right_only", "coverage", "warnings", "status")
