"""Whether what one variant gains over another repeats over years, regimes and horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.plans.panels import bench
from tidemark.plans.ranking import _alt, picks
from tidemark.plans.views import Views
from tidemark.registry import query

# What a decision needs.
LEAST_TOTAL, LEAST_SEGMENT, LEAST_COVERAGE, LEAST_YEARS, LEAST_REGIMES, LEAST_HORIZONS, LEAST_SHARE, LEAST_GAIN, LARGEST_LOSS, ALIKE, TOLERANCE = 100, 20, 0.80, 2, 2, 2, 2 / 3, 0.0, -0.02, 0.95, 0.002
DIMS = ("year", "regime", "horizon")
HORIZONS = (20, 60, 120)


def _picked(variant: str, order: str) -> str:
    return f"SELECT '{variant}' AS variant, a.as_of, p.code, p.idx FROM as_of a JOIN px p ON p.idx = a.idx QUALIFY row_number() OVER (PARTITION BY a.as_of ORDER BY p.{order} DESC, p.code) <= 20"


OUTCOMES = f"""bx AS (SELECT b.*, c.idx FROM bench b JOIN cal c USING (session_date)), pv AS (SELECT * FROM ({_picked('volume', 'vol')}) UNION ALL SELECT * FROM ({_picked('turnover', 'turnover')})),
  ov AS (SELECT k.variant, k.as_of, k.code, h, x.close / p.close - 1 AS gross, b1.close / b0.close - 1 AS mark FROM pv k CROSS JOIN (SELECT unnest({list(HORIZONS)}) AS h) LEFT JOIN px p ON p.code = k.code AND p.idx = k.idx LEFT JOIN px x ON x.code = k.code AND x.idx = k.idx + h LEFT JOIN bx b0 ON b0.idx = k.idx LEFT JOIN bx b1 ON b1.idx = k.idx + h),
  od AS (SELECT variant, gross, 'year' AS dim, CAST(year(as_of) AS text) AS seg FROM ov UNION ALL SELECT variant, gross, 'horizon', CAST(h AS text) FROM ov UNION ALL SELECT variant, gross, 'regime', CASE WHEN mark >= 0.05 THEN 'bull' WHEN mark <= -0.05 THEN 'bear' ELSE 'range' END FROM ov WHERE mark IS NOT NULL),
  sv AS (SELECT dim, seg, variant, count(gross) AS n, count(gross) / count(*) AS cover, avg(gross) AS m FROM od GROUP BY ALL),
  sd AS (SELECT a.dim, a.seg, round(a.m - b.m, 9) AS d FROM sv a JOIN sv b ON b.dim = a.dim AND b.seg = a.seg WHERE a.variant = 'turnover' AND b.variant = 'volume' AND least(a.n, b.n) >= {LEAST_SEGMENT} AND least(a.cover, b.cover) >= {LEAST_COVERAGE}),
  so AS (SELECT count(*) AS samples, count(gross) AS observed, count(gross) / count(*) AS coverage FROM ov WHERE variant = 'turnover'),
  ol AS (SELECT avg(shared / every) AS overlap, count(*) AS pairs FROM (SELECT as_of, h, count(*) FILTER (n = 2) AS shared, count(*) AS every FROM (SELECT as_of, h, code, count(*) AS n FROM ov GROUP BY ALL) GROUP BY as_of, h)),
  sx AS (SELECT {', '.join(f"count(*) FILTER (dim = '{d}') AS {d}s, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) FILTER (dim = '{d}') AS {d}_share" for d in DIMS)}, median(d) AS median, min(d) AS worst, max(d) AS best, CASE WHEN count(*) >= 2 THEN stddev_pop(d) END AS spread, count(DISTINCT sign(d)) FILTER (dim = 'regime' AND d <> 0) AS signs FROM sd),
  sy AS (SELECT *, years >= {LEAST_YEARS} AND regimes >= {LEAST_REGIMES} AND horizons >= {LEAST_HORIZONS} AS broad, coalesce(year_share >= {LEAST_SHARE} AND regime_share >= {LEAST_SHARE} AND horizon_share >= {LEAST_SHARE}, false) AS repeated FROM sx, so, ol),
  sz AS (SELECT *, observed >= {LEAST_TOTAL} AND coverage >= {LEAST_COVERAGE} AND broad AND repeated AND coalesce(median > {LEAST_GAIN} AND worst >= {LARGEST_LOSS}, false) AS eligible FROM sy)"""


@query("E13_assessment", f""", {OUTCOMES} SELECT samples, observed, round(coverage, 6) AS coverage, round(overlap, 6) AS overlap, pairs, years, regimes, horizons, {', '.join(f'round({d}_share, 6) AS {d}_share' for d in DIMS)}, round(median, 6) AS median, round(worst, 6) AS worst, round(best, 6) AS best, round(spread, 6) AS spread, eligible,
  CASE WHEN eligible THEN 'stable_positive' WHEN overlap >= {ALIKE} AND abs(median) <= {TOLERANCE} THEN 'redundant' WHEN signs > 1 THEN 'highly_regime_dependent' WHEN broad AND median <= 0 THEN 'ineffective' WHEN years + regimes + horizons > 0 THEN 'unstable' ELSE 'insufficient_evidence' END AS class,
  concat_ws('|', CASE WHEN observed < {LEAST_TOTAL} THEN 'insufficient_total_observations' END, CASE WHEN coverage < {LEAST_COVERAGE} THEN 'coverage_below_threshold' END, CASE WHEN NOT broad THEN 'insufficient_year_regime_or_horizon_breadth' END, CASE WHEN NOT repeated THEN 'positive_effect_not_broadly_repeated' END, CASE WHEN worst < {LARGEST_LOSS} THEN 'material_segment_regression' END, CASE WHEN eligible THEN 'precommitted_cross_segment_rule_passed' END) AS reasons FROM sz""")
def e13_assessment(v: Views) -> DataFrame:
    """One variant against the other: gains of segments with enough outcomes, how often they are positive, the class and its reasons."""
    c = F.col
    v.keep("px", "as_of", "cal", "bench")
    last = v.cal.agg(F.max("idx")).scalar()
    horizons = v.spark.createDataFrame([(h,) for h in HORIZONS], "h int")
    both = picks(v).select(F.lit("volume").alias("variant"), "as_of", "code", "idx").unionByName(_alt(v).select(F.lit("turnover").alias("variant"), "as_of", "code", "idx"))
    rows = v.written(P.forward(both, v.px, bench(v), horizons, last).select("variant", "as_of", "code", "h", "gross", (c("b1") / c("b0") - 1).alias("mark")), "variants")
    regime = F.when(c("mark") >= 0.05, "bull").when(c("mark") <= -0.05, "bear").when(c("mark").isNotNull(), "range")
    cuts = F.array(*[F.struct(F.lit(d).alias("dim"), x.alias("seg")) for d, x in (("year", F.year("as_of").cast("string")), ("regime", regime), ("horizon", c("h").cast("string")))])
    of = lambda n: F.when(c("variant") == n, c("gross"))
    long = rows.select("variant", "gross", F.inline(cuts)).where("seg is not null")
    sides = {"a": "turnover", "b": "volume"}
    seg = long.groupBy("dim", "seg").agg(*[x for k, n in sides.items() for x in (F.count(of(n)).alias("n" + k), (F.count(of(n)) / F.count_if(c("variant") == n)).alias("c" + k), F.avg(of(n)).alias("m" + k))])
    deltas = seg.where((F.least("na", "nb") >= LEAST_SEGMENT) & (F.least("ca", "cb") >= LEAST_COVERAGE)).select("dim", "seg", F.round(c("ma") - c("mb"), 9).alias("d"))
    d, of_dim = c("d"), lambda n: c("dim") == n
    shares = [x for n in DIMS for x in (F.count_if(of_dim(n)).alias(n + "s"), F.avg(F.when(of_dim(n), (d > 0).cast("double"))).alias(n + "_share"))]
    s = deltas.agg(*shares, F.percentile(d, F.lit(0.5)).alias("median"), F.min(d).alias("worst"), F.max(d).alias("best"), F.when(F.count("*") >= 2, F.stddev_pop(d)).alias("spread"), F.count_distinct(F.when(of_dim("regime") & (d != 0), F.signum(d))).alias("signs"))
    own = rows.where("variant = 'turnover'").agg(F.count("*").alias("samples"), F.count("gross").alias("observed"), F.try_divide(F.count("gross"), F.count("*")).alias("coverage"))
    members = rows.groupBy("as_of", "h", "code").agg(F.count("*").alias("n")).groupBy("as_of", "h").agg((F.count_if(c("n") == 2) / F.count("*")).alias("o"))
    alike = members.agg(F.avg("o").alias("overlap"), F.count("*").alias("pairs"))
    s = s.join(F.broadcast(own)).join(F.broadcast(alike))  # one row each
    broad = (c("years") >= LEAST_YEARS) & (c("regimes") >= LEAST_REGIMES) & (c("horizons") >= LEAST_HORIZONS)
    repeated = F.coalesce((c("year_share") >= LEAST_SHARE) & (c("regime_share") >= LEAST_SHARE) & (c("horizon_share") >= LEAST_SHARE), F.lit(False))
    s = s.withColumns({"broad": broad, "repeated": repeated})
    gains = F.coalesce((c("median") > LEAST_GAIN) & (c("worst") >= LARGEST_LOSS), F.lit(False))
    s = s.withColumn("eligible", (c("observed") >= LEAST_TOTAL) & (c("coverage") >= LEAST_COVERAGE) & c("broad") & c("repeated") & gains)
    label = (
        F.when(c("eligible"), "stable_positive").when((c("overlap") >= ALIKE) & (F.abs("median") <= TOLERANCE), "redundant").when(c("signs") > 1, "highly_regime_dependent")
        .when(c("broad") & (c("median") <= 0), "ineffective").when(F.expr("years + regimes + horizons > 0"), "unstable").otherwise("insufficient_evidence")
    )
    reasons = F.concat_ws("|", F.when(c("observed") < LEAST_TOTAL, "insufficient_total_observations"), F.when(c("coverage") < LEAST_COVERAGE, "coverage_below_threshold"), F.when(~c("broad"), "insufficient_year_regime_or_horizon_breadth"), F.when(~c("repeated"), "positive_effect_not_broadly_repeated"), F.when(c("worst") < LARGEST_LOSS, "material_segment_regression"), F.when(c("eligible"), "precommitted_cross_segment_rule_passed"))
    figures = ("coverage", "overlap", *(n + "_share" for n in DIMS), "median", "worst", "best", "spread")
    return s.select("samples", "observed", "pairs", "years", "regimes", "horizons", "eligible", *[F.round(x, 6).alias(x) for x in figures], label.alias("class"), reasons.alias("reasons"))
