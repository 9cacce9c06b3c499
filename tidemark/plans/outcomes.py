"""Queries on forward outcomes with every status, and their summaries by horizon and segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.operators.rank import top
from tidemark.operators.segments import by_dimension, segment_figures
from tidemark.plans.evaluation import FOLLOW, MEMBER, followed, members
from tidemark.plans.panels import bench
from tidemark.plans.ranking import PICKS
from tidemark.plans.views import Views
from tidemark.registry import query

HORIZONS = (20, 60, 120, 250)
OBSERVED = PICKS + f""", hz AS (SELECT unnest({list(HORIZONS)}) AS h), bx AS (SELECT b.*, c.idx FROM bench b JOIN cal c USING (session_date)), qa AS (SELECT *, raw * factor AS adj FROM quotes),
  fo AS (SELECT k.as_of, k.code, k.idx, k.rank, k.vol, h, CASE WHEN k.idx + h > (SELECT max(idx) FROM cal) THEN 'incomplete_market_window' WHEN NOT EXISTS (SELECT 1 FROM quotes z WHERE z.code = k.code) THEN 'missing_price_history'
      WHEN a.code IS NULL THEN 'missing_entry_price' WHEN a.raw IS NULL OR a.raw <= 0 THEN 'invalid_entry_price' WHEN a.adj IS NULL THEN 'missing_adjustment_factor_entry'
      WHEN x.code IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM halts t WHERE t.code = k.code AND t.idx = k.idx + h AND t.kind = 'S') THEN 'suspended_at_exit' ELSE 'missing_horizon_price' END
      WHEN x.raw IS NULL OR x.raw <= 0 THEN 'invalid_exit_price' WHEN x.adj IS NULL THEN 'missing_adjustment_factor_exit' ELSE 'observed' END AS status,
    x.adj / a.adj - 1 AS g, b1.close / b0.close - 1 AS benchmark
    FROM pk k CROSS JOIN hz LEFT JOIN qa a ON a.code = k.code AND a.idx = k.idx LEFT JOIN qa x ON x.code = k.code AND x.idx = k.idx + h LEFT JOIN bx b0 ON b0.idx = k.idx LEFT JOIN bx b1 ON b1.idx = k.idx + h),
  wy AS (SELECT f.as_of, f.code, f.h, z.adj / max(z.adj) OVER (PARTITION BY f.as_of, f.code, f.h ORDER BY z.idx) - 1 AS fall FROM fo f JOIN qa z ON z.code = f.code AND z.idx BETWEEN f.idx AND f.idx + f.h AND z.adj IS NOT NULL WHERE f.status = 'observed'),
  lo AS (SELECT as_of, code, h, min(fall) AS drawdown FROM wy GROUP BY ALL),
  fw AS (SELECT *, gross - benchmark AS excess, net - benchmark AS net_excess FROM (SELECT *, CASE WHEN status = 'observed' THEN g END AS gross, CASE WHEN status = 'observed' THEN greatest(-1.0, g - 0.003) END AS net FROM fo) LEFT JOIN lo USING (as_of, code, h))"""


def observed(v: Views) -> DataFrame:
    """Outcomes of the first 20 by volume at each horizon; the panel is written once, since entries, exits and ways all read it."""
    px = v.keep("px", "as_of", "cal", "bench").px
    rows = v.written(top(px.join(F.broadcast(v.as_of), "idx"), ["as_of"], [F.col("vol").desc(), F.col("code")], 20).select("as_of", "code", "idx", "vol", "rank"), "entries")
    quotes = v.over(px, "quotes")
    last = v.cal.agg(F.max("idx")).scalar()
    horizons = v.spark.createDataFrame([(h,) for h in HORIZONS], "h int")
    return P.forward_observation(rows, quotes, v.halts.where("kind = 'S'"), bench(v), horizons, last)


NUMBERS = ("gross", "net", "benchmark", "excess", "net_excess", "drawdown")


@query("E02_observation", f"{OBSERVED} SELECT as_of, code, rank, h, status, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)} FROM fw")
def e02_observation(v: Views) -> DataFrame:
    return observed(v).select("as_of", "code", "rank", "h", "status", *[F.round(c, 6).alias(c) for c in NUMBERS])


MEMBERS = "('member_from_snapshot', 'member_from_history')"
FULL = f"""{OBSERVED}, {FOLLOW}, v1 AS (SELECT as_of, code, bool_or(CASE WHEN nth = 1 THEN improved END) AS improved, bool_or(CASE WHEN nth = 1 THEN improved END) AND bool_or(CASE WHEN nth = 2 THEN improved END) AS lasting FROM fl GROUP BY ALL),
  fr AS MATERIALIZED (SELECT f.*, {MEMBER.replace('k.', 'f.')} AS membership, CASE WHEN f.code % 5 <> 0 THEN CAST(r2.industry AS text) END AS industry, CASE WHEN f.rank % 4 <> 0 THEN f.vol END AS cap, v1.improved, v1.lasting
    FROM fw f LEFT JOIN (SELECT * FROM ref WHERE code % 13 <> 0) r ON r.code = f.code LEFT JOIN ref r2 ON r2.code = f.code LEFT JOIN v1 ON v1.as_of = f.as_of AND v1.code = f.code),
  co AS (SELECT h, as_of, avg(gross) AS m FROM fr GROUP BY ALL HAVING avg(gross) IS NOT NULL), cw AS (SELECT h, as_of, m, product(1 + m) OVER (PARTITION BY h ORDER BY as_of) AS w FROM co),
  cd AS (SELECT h, min(w / greatest(1.0, p) - 1) AS d, avg(m) AS top FROM (SELECT *, max(w) OVER (PARTITION BY h ORDER BY as_of) AS p FROM cw) GROUP BY h),
  rc AS (SELECT h, string_agg(status || '=' || n, '|' ORDER BY status) AS reasons FROM (SELECT h, status, count(*) AS n FROM fr WHERE status <> 'observed' GROUP BY ALL) GROUP BY h),
  mc AS (SELECT h, string_agg(membership || '=' || n, '|' ORDER BY membership) AS members FROM (SELECT h, membership, count(*) AS n FROM fr GROUP BY ALL) GROUP BY h)"""


def described(v: Views) -> DataFrame:
    """Outcomes with membership, exposures and what the next reports said."""
    votes = followed(v).groupBy("as_of", "code").agg(*[F.bool_or(F.when(F.col("nth") == i, F.col("improved"))).alias(n) for i, n in ((1, "improved"), (2, "second"))])
    rows = observed(v)
    known = members(v).select("as_of", "code", "membership")
    industry = v.ref.select("code", F.when(F.col("code") % 5 != 0, F.col("industry").cast("string")).alias("industry"))
    rows = rows.join(known, ["as_of", "code"], "left").join(industry, "code", "left").join(votes, ["as_of", "code"], "left")
    return rows.withColumn("cap", F.when(F.col("rank") % 4 != 0, F.col("vol"))).withColumn("lasting", F.col("improved") & F.col("second"))


@query("E11_candidates", f"{FULL} SELECT as_of, code, rank, h, status, round(gross, 6) AS gross, round(net_excess, 6) AS net_excess, round(drawdown, 6) AS drawdown, membership, industry, cap, improved, lasting, CASE WHEN improved IS NULL THEN 'unknown' WHEN improved AND lasting THEN 'persistent' WHEN improved AND NOT lasting THEN 'false_turnaround' WHEN improved THEN 'awaiting_second' ELSE 'not_improved' END AS follow_through FROM fr")
def e11_candidates(v: Views) -> DataFrame:
    """Every candidate at every horizon: the market's outcome, what it was exposed to, and what its next two reports said."""
    up, both = F.col("improved"), F.col("lasting")
    said = F.when(up.isNull(), "unknown").when(up & both, "persistent").when(up & ~both, "false_turnaround").when(up, "awaiting_second").otherwise("not_improved")
    return described(v).select("as_of", "code", "rank", "h", "status", *[F.round(c, 6).alias(c) for c in ("gross", "net_excess", "drawdown")], "membership", "industry", "cap", "improved", "lasting", said.alias("follow_through"))


def _stats(prefix: str, x: str) -> list:
    c = F.col(x)
    return [F.avg(c).alias("mean_" + prefix), F.percentile(c, F.lit(0.5)).alias("median_" + prefix), (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))).alias(prefix + "_iqr"), F.avg((c > 0).cast("double")).alias(prefix + "_hit_rate")]


def _stats_sql(prefix: str, x: str) -> str:
    return f"avg({x}) AS mean_{prefix}, median({x}) AS median_{prefix}, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS {prefix}_iqr, avg(CASE WHEN {x} > 0 THEN 1.0 WHEN {x} IS NOT NULL THEN 0.0 END) AS {prefix}_hit_rate"


PARTS = {"return": "gross", "net_return": "net", "benchmark_return": "benchmark", "excess_return": "excess", "net_excess_return": "net_excess"}
ROUNDED = [n.format(p) for p in PARTS for n in ("mean_{}", "median_{}", "{}_iqr", "{}_hit_rate")] + ["missing_rate", "coverage", "mean_candidate_drawdown", "worst_candidate_drawdown", "fundamental_improvement_rate", "fundamental_persistence_rate", "market_cap_mean", "mean_top_n_return", "max_drawdown"]
WHOLE = ["h", "candidate_count", "snapshot_count", "observed_count", "missing_count", "benchmark_observed_count", "benchmark_missing_count", "member_count", "member_missing_count", "fundamental_observed_count", "fundamental_missing_count", "fundamental_improved_count", "fundamental_next_two_count", "industry_count", "industry_missing_count", "market_cap_missing_count"]


@query("G07_horizon_report", f"""{FULL}, sm AS (SELECT h, count(*) AS candidate_count, count(DISTINCT as_of) AS snapshot_count, count(gross) AS observed_count, count(*) - count(gross) AS missing_count, (count(*) - count(gross)) / count(*) AS missing_rate, count(gross) / count(*) AS coverage,
    {', '.join(_stats_sql(p, x) for p, x in PARTS.items())}, count(benchmark) AS benchmark_observed_count, count(*) - count(benchmark) AS benchmark_missing_count, avg(drawdown) AS mean_candidate_drawdown, min(drawdown) AS worst_candidate_drawdown,
    count(*) FILTER (membership IN {MEMBERS}) AS member_count, count(*) FILTER (membership NOT IN {MEMBERS}) AS member_missing_count, count(improved) AS fundamental_observed_count, count(*) - count(improved) AS fundamental_missing_count, count(*) FILTER (improved) AS fundamental_improved_count,
    avg(CASE WHEN improved THEN 1.0 WHEN NOT improved THEN 0.0 END) AS fundamental_improvement_rate, count(lasting) AS fundamental_next_two_count, avg(CASE WHEN lasting THEN 1.0 WHEN NOT lasting THEN 0.0 END) AS fundamental_persistence_rate,
    count(DISTINCT industry) AS industry_count, count(*) FILTER (industry IS NULL) AS industry_missing_count, avg(cap) AS market_cap_mean, count(*) FILTER (cap IS NULL) AS market_cap_missing_count FROM fr GROUP BY h),
  al AS (SELECT sm.*, cd.top AS mean_top_n_return, cd.d AS max_drawdown, coalesce(rc.reasons, '') AS reasons, mc.members FROM sm LEFT JOIN cd USING (h) LEFT JOIN rc USING (h) LEFT JOIN mc USING (h))
  SELECT {', '.join(WHOLE)}, reasons, members, {', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED)} FROM al""")
def g07_report(v: Views) -> DataFrame:
    """All that is told of a horizon: counts, returns, benchmark, excess, falls, membership, reports and exposures."""
    rows = v.written(described(v), "outcomes")
    share = lambda c: F.avg(F.col(c).cast("double"))
    member = F.col("membership").isin("member_from_snapshot", "member_from_history")
    sums = rows.groupBy("h").agg(
        F.count("*").alias("candidate_count"), F.count_distinct("as_of").alias("snapshot_count"), F.count("gross").alias("observed_count"), *[s for p, x in PARTS.items() for s in _stats(p, x)], F.count("benchmark").alias("benchmark_observed_count"),
        F.avg("drawdown").alias("mean_candidate_drawdown"), F.min("drawdown").alias("worst_candidate_drawdown"), F.count_if(member).alias("member_count"), F.count_if(~member).alias("member_missing_count"), F.count("improved").alias("fundamental_observed_count"),
        F.count_if("improved").alias("fundamental_improved_count"), share("improved").alias("fundamental_improvement_rate"), F.count("lasting").alias("fundamental_next_two_count"), share("lasting").alias("fundamental_persistence_rate"),
        F.count_distinct("industry").alias("industry_count"), F.count_if(F.col("industry").isNull()).alias("industry_missing_count"), F.avg("cap").alias("market_cap_mean"), F.count_if(F.col("cap").isNull()).alias("market_cap_missing_count"),
    )
    n = F.col("candidate_count")
    sums = sums.withColumns({"missing_count": n - F.col("observed_count"), "missing_rate": (n - F.col("observed_count")) / n, "coverage": F.col("observed_count") / n, "benchmark_missing_count": n - F.col("benchmark_observed_count"), "fundamental_missing_count": n - F.col("fundamental_observed_count")})
    cohorts = rows.groupBy("h", "as_of").agg(F.avg("gross").alias("m")).where("m is not null")
    falls = P.compounded_drawdown(cohorts, "h", "as_of", "m").withColumnRenamed("drawdown", "max_drawdown").join(cohorts.groupBy("h").agg(F.avg("m").alias("mean_top_n_return")), "h")
    listed = lambda c, rows: rows.groupBy("h", c).agg(F.count("*").alias("n")).groupBy("h").agg(F.array_join(F.array_sort(F.collect_list(F.concat(c, F.lit("="), "n"))), "|").alias("x"))
    reasons, kinds = listed("status", rows.where("status <> 'observed'")).withColumnRenamed("x", "reasons"), listed("membership", rows).withColumnRenamed("x", "members")
    out = sums.join(falls, "h", "left").join(reasons, "h", "left").join(kinds, "h", "left")
    return out.select(*WHOLE, F.coalesce("reasons", F.lit("")).alias("reasons"), "members", *[F.round(c, 6).alias(c) for c in ROUNDED])


@query("G11_exposures", f"{FULL} SELECT h, coalesce(industry, 'missing') AS industry, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY h), 6) AS share, round(avg(cap), 6) AS cap_mean, count(*) FILTER (cap IS NULL) AS cap_missing, count(*) FILTER (cap < 100) AS small, count(*) FILTER (cap >= 100 AND cap < 200) AS mid, count(*) FILTER (cap >= 200) AS large FROM fr GROUP BY h, coalesce(industry, 'missing')")
def g11_exposures(v: Views) -> DataFrame:
    """Shares of industries among candidates, and their sizes by fixed cuts."""
    cap = F.col("cap")
    g = described(v).groupBy("h", F.coalesce("industry", F.lit("missing")).alias("industry")).agg(F.count("*").alias("n"), F.round(F.avg(cap), 6).alias("cap_mean"), F.count_if(cap.isNull()).alias("cap_missing"), F.count_if(cap < 100).alias("small"), F.count_if((cap >= 100) & (cap < 200)).alias("mid"), F.count_if(cap >= 200).alias("large"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("h")), 6))


DIMS = ("yr", "regime", "bucket", "industry", "h")
#: One dimension at a time, and none.
CUTS = "GROUPING SETS ((variant), " + ", ".join(f"(variant, {d})" for d in DIMS) + ")"
MEASURES = "count(*) AS n, count(gross) AS observed, count(gross) / count(*) AS coverage, avg(gross) AS mean, median(gross) AS median, avg(CASE WHEN gross > 0 THEN 1.0 WHEN gross IS NOT NULL THEN 0.0 END) AS hit, CASE WHEN count(gross) >= 2 THEN stddev_pop(gross) END AS std, CASE WHEN count(gross) >= 2 THEN quantile_cont(gross, 0.75) - quantile_cont(gross, 0.25) END AS iqr, min(gross) AS least, max(gross) AS most, avg(excess) AS mean_excess"
SEGMENT = f"""{FULL}, sv AS (SELECT unnest(['all', 'even']) AS variant), sr AS MATERIALIZED (SELECT variant, year(as_of) AS yr, CASE WHEN benchmark >= 0.05 THEN 'up' WHEN benchmark <= -0.05 THEN 'down' WHEN benchmark IS NOT NULL THEN 'flat' END AS regime,
    CASE WHEN cap IS NULL THEN 'missing' WHEN cap < 100 THEN 'small' WHEN cap < 200 THEN 'mid' ELSE 'large' END AS bucket, coalesce(industry, 'missing') AS industry, h, gross, excess FROM fr CROSS JOIN sv WHERE variant = 'all' OR rank % 2 = 0),
  sg AS MATERIALIZED (SELECT variant, {', '.join(DIMS)}, CAST(grouping_id({', '.join(DIMS)}) AS bigint) AS gid, {MEASURES} FROM sr GROUP BY {CUTS})"""
FIGURES = ("coverage", "mean", "median", "hit", "std", "iqr", "least", "most", "mean_excess")


@query("G13_segment_metrics", f"{SEGMENT} SELECT s.variant, s.gid, {', '.join('s.' + d for d in DIMS)}, s.n, s.observed, {', '.join(f'round(s.{c}, 6) AS {c}' for c in FIGURES)}, round(s.mean - b.mean, 6) AS delta FROM sg s LEFT JOIN sg b ON b.variant = 'all' AND b.gid = s.gid AND {' AND '.join(f'b.{d} IS NOT DISTINCT FROM s.{d}' for d in DIMS)}")
def g13_metrics(v: Views) -> DataFrame:
    """Two variants over all outcomes and by year, regime, size, industry and horizon, each against the first."""
    cap, b = F.col("cap"), F.col("benchmark")
    both = F.explode(F.when(F.col("rank") % 2 == 0, F.array(F.lit("all"), F.lit("even"))).otherwise(F.array(F.lit("all"))))
    dims = {
        "yr": F.year("as_of"), "regime": F.when(b >= 0.05, "up").when(b <= -0.05, "down").when(b.isNotNull(), "flat"),
        "bucket": F.when(cap.isNull(), "missing").when(cap < 100, "small").when(cap < 200, "mid").otherwise("large"), "industry": F.coalesce("industry", F.lit("missing")), "h": F.col("h"),
    }
    long = v.written(by_dimension(described(v).withColumn("variant", both), dims, ["variant", "gross", "excess"]), "dimensions")
    sets = v.written(segment_figures(long, ["variant", "dim", "seg"], "gross", "excess"), "segments")
    base = sets.where("variant = 'all'").select("dim", F.col("seg").alias("base_seg"), F.col("mean").alias("base"))
    out = sets.join(base, (sets["dim"] == base["dim"]) & F.col("seg").eqNullSafe(F.col("base_seg")), "left").select(sets["*"], "base")
    own = {d: F.when(F.col("dim") == d, F.col("seg")) for d in DIMS} | {d: F.when(F.col("dim") == d, F.col("seg").cast("int")) for d in ("yr", "h")}
    gid = F.lit(2 ** len(DIMS) - 1)
    for i, d in enumerate(DIMS):
        gid = F.when(F.col("dim") == d, 2 ** len(DIMS) - 1 - 2 ** (len(DIMS) - 1 - i)).otherwise(gid)
    return out.select("variant", gid.cast("long").alias("gid"), *[own[d].alias(d) for d in DIMS], "n", "observed", *[F.round(c, 6).alias(c) for c in FIGURES], F.round(F.col("mean") - F.col("base"), 6).alias("delta"))
