"""Queries that score and rank entities on many dates at once, with variants, explanations, samples and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bounded, mean_known, positive_penalty, sign_transition, spike_penalty
from tidemark.operators import panel as P
from tidemark.operators import pit
from tidemark.operators.order import Figure, window_figures
from tidemark.operators.rank import top
from tidemark.plans.attention import ATTENTION, attention
from tidemark.plans.fundamentals import FUND_SQL, KNOWN_ALL, QUALITY, TREND_ALL, SHIFTED, fundamentals, quality, trends
from tidemark.plans.history import MONTHS, months
from tidemark.plans.panels import WIN, bench
from tidemark.plans.views import Views
from tidemark.registry import query

# Weights of the components, cumulative variants, and the cap on penalties.
WEIGHTS = {"fundamental": 0.30, "trend": 0.20, "quality": 0.20, "attention": 0.15, "expectation": 0.15}
VARIANTS = {
    "fundamental_only": ("fundamental", "trend"),
    "quality_added": ("fundamental", "trend", "quality"),
    "attention_added": ("fundamental", "trend", "quality", "attention"),
    "expectation_added": ("fundamental", "trend", "quality", "attention", "expectation"),
}
CAP = 50
GROWTHS, MARGINS = ("revenue_yoy", "profit_yoy", "operating_yoy"), ("gross_margin", "operating_margin", "net_margin")


def mean_sql(*e: str) -> str:
    return f"(coalesce({', 0) + coalesce('.join(e)}, 0)) / nullif({' + '.join(f'({x} IS NOT NULL)::int' for x in e)}, 0)"


def bounded_sql(e: str, scale: float) -> str:
    return f"(50 + 50 * tanh({e} * {scale}))"


# What counts as a full penalty for excess returns over 20 and 60 sessions and for spikes of volume and turnover, and when a crowd is flagged.
EXCESS_20, EXCESS_60, SPIKE, FLAGGED = 0.15, 0.30, 2.0, 70
PENALTIES = ("repricing_20d", "repricing_60d", "high_proximity", "volume_spike_penalty", "turnover_spike_penalty")
TRENDS = ("yoy_acceleration", "qoq_acceleration", "consecutive_improvement", "transition", "margin_inflection")


def spike_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x} - 1, 0) / {SPIKE - 1}, 1) END"


def over_median_sql(x: str, n: str, m: str) -> str:
    return f"CASE WHEN {n} >= 20 AND {m} <> 0 THEN {x} / {m} END"


CROWDING = f"""cb AS (SELECT b.close, c.idx FROM bench b JOIN cal c USING (session_date)),
  cm AS (SELECT *, median(CASE WHEN vol > 0 THEN vol END) {WIN.format(a=60, b=1)} AS mv, count(CASE WHEN vol > 0 THEN 1 END) {WIN.format(a=60, b=1)} AS nv, median(CASE WHEN turnover > 0 THEN turnover END) {WIN.format(a=60, b=1)} AS mt, count(CASE WHEN turnover > 0 THEN 1 END) {WIN.format(a=60, b=1)} AS nt,
    max(close) {WIN.format(a=252, b=1)} AS hi, count(close) {WIN.format(a=252, b=1)} AS nh FROM px),
  ce AS (SELECT m.code, m.idx, CASE WHEN p2.close > 0 THEN m.close / p2.close - 1 END - (b0.close / b2.close - 1) AS e20, CASE WHEN p6.close > 0 THEN m.close / p6.close - 1 END - (b0.close / b6.close - 1) AS e60, CASE WHEN nh >= 126 AND hi > 0 THEN m.close / hi END AS near,
    {over_median_sql("m.vol", "nv", "mv")} AS vs, {over_median_sql("m.turnover", "nt", "mt")} AS ts FROM cm m LEFT JOIN px p2 ON p2.code = m.code AND p2.idx = m.idx - 20 LEFT JOIN px p6 ON p6.code = m.code AND p6.idx = m.idx - 60
    LEFT JOIN cb b0 ON b0.idx = m.idx LEFT JOIN cb b2 ON b2.idx = m.idx - 20 LEFT JOIN cb b6 ON b6.idx = m.idx - 60),
  cy AS (SELECT code, idx, CASE WHEN e20 IS NOT NULL THEN least(greatest(e20, 0) / {EXCESS_20}, 1) END AS repricing_20d, CASE WHEN e60 IS NOT NULL THEN least(greatest(e60, 0) / {EXCESS_60}, 1) END AS repricing_60d, CASE WHEN near IS NOT NULL THEN least(greatest(near, 0), 1) END AS high_proximity,
    {spike_sql("vs")} AS volume_spike_penalty, {spike_sql("ts")} AS turnover_spike_penalty FROM ce),
  cw AS (SELECT *, 100 * ({" + ".join(PENALTIES)}) / 5 AS crowding FROM cy)"""
UP, DOWN = "('NEGATIVE_TO_POSITIVE', 'ZERO_TO_POSITIVE')", "('POSITIVE_TO_NEGATIVE', 'ZERO_TO_NEGATIVE')"
COMPONENTS = f"""{TREND_ALL}, fx AS (SELECT s.as_of, s.code, s.pn, {', '.join(f'{e} AS {n}' for n, e in FUND_SQL.items())}{SHIFTED}), fu AS (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY as_of, code ORDER BY pn DESC) = 1),
  {QUALITY}, {ATTENTION}, {CROWDING},
  tz AS (SELECT as_of, code, max(CASE WHEN metric = 'yoy_revenue' THEN c - pc END) AS yoy_acceleration, max(CASE WHEN metric = 'qoq_revenue' THEN c - pc END) AS qoq_acceleration, max(CASE WHEN metric = 'yoy_revenue' THEN length END) AS consecutive_improvement,
    max(CASE WHEN metric = 'net_margin' THEN c - pc END) AS margin_inflection, max(CASE WHEN metric = 'yoy_profit' THEN value - c END) AS a, max(CASE WHEN metric = 'yoy_profit' AND c IS NOT NULL THEN value END) AS b FROM tt GROUP BY 1, 2),
  tw AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a < 0 AND b > 0 THEN 'NEGATIVE_TO_POSITIVE' WHEN a > 0 AND b < 0 THEN 'POSITIVE_TO_NEGATIVE' WHEN a = 0 AND b > 0 THEN 'ZERO_TO_POSITIVE' WHEN a = 0 AND b < 0 THEN 'ZERO_TO_NEGATIVE' WHEN a <> 0 AND b = 0 THEN 'TO_ZERO' ELSE 'NONE' END AS transition FROM tz),
  cp AS (SELECT f.as_of, f.code, f.pn, {', '.join('f.' + x for x in (*GROWTHS, *MARGINS))}, {', '.join('tw.' + x for x in TRENDS)}, ats.t AS turnover_percentile, ats.a AS amount_percentile, ats.v AS abnormal_volume, {', '.join('cw.' + x for x in PENALTIES)}, cw.crowding,
    {mean_sql(*[bounded_sql(g, 1.5) for g in GROWTHS], *[bounded_sql(m, 2.0) for m in MARGINS])} AS fundamental,
    {mean_sql(bounded_sql('yoy_acceleration', 0.02), bounded_sql('qoq_acceleration', 0.02), 'least(100, consecutive_improvement * 25)', f"CASE WHEN transition IN {UP} THEN 80 WHEN transition IN {DOWN} THEN 20 WHEN transition = 'NONE' THEN 50 END", bounded_sql('margin_inflection', 5.0))} AS trend,
    q.score AS quality, ats.score AS attention, 100 - cw.crowding AS expectation,
    q.flags, q.gate, least({CAP}, len(list_filter(string_split(q.flags, '|'), lambda x: x LIKE '%pressure')) * 10 + len(list_filter(string_split(q.flags, '|'), lambda x: x <> '' AND x NOT LIKE '%pressure')) * 15) AS penalty
    FROM fu f JOIN as_of d ON d.as_of = f.as_of LEFT JOIN tw ON tw.as_of = f.as_of AND tw.code = f.code LEFT JOIN qg q ON q.as_of = f.as_of AND q.code = f.code LEFT JOIN ats ON ats.code = f.code AND ats.idx = d.idx LEFT JOIN cw ON cw.code = f.code AND cw.idx = d.idx)"""


def crowding(v: Views, only: Column | None = None) -> DataFrame:
    """Five penalties of each entity and session, all of which a crowd's score needs: excess returns over 20 and 60 sessions, nearness to the former high, and spikes of volume and turnover.

    With `only`, a condition on rows of the panel, windows hold all rows, but only those that meet it are told of.
    """
    c = F.col
    px = v.px.select("code", "idx", "close", "vol", "turnover").withColumns({"v": F.when(c("vol") > 0, c("vol")), "t": F.when(c("turnover") > 0, c("turnover")), "asked": F.lit(True) if only is None else only})
    for n in (20, 60):
        px = P.at_offset(px, "close", -n, f"then_{n}")
    # one pass in which an entity's rows meet once
    px = window_figures(px, {"vm": Figure("median", "v", (-60, -1), 20), "tm": Figure("median", "t", (-60, -1), 20), "high": Figure("max", "close", (-252, -1), 126)}, count_rows=False, only="asked")
    px = px.withColumns({"vs": c("vol") / c("vm"), "ts": c("turnover") / c("tm")})
    own = bench(v).select("idx", c("close").alias("b_0"))
    marks = own
    for n in (20, 60):
        marks = marks.join(F.broadcast(own.select((c("idx") + n).alias("idx"), c("b_0").alias(f"b_{n}"))), "idx", "left")
    px = px.join(F.broadcast(marks), "idx", "left")
    excess = {n: F.when(c(f"then_{n}") > 0, c("close") / c(f"then_{n}") - 1) - (c("b_0") / c(f"b_{n}") - 1) for n in (20, 60)}
    near = F.when(c("high") > 0, c("close") / c("high"))
    parts = (positive_penalty(excess[20], EXCESS_20), positive_penalty(excess[60], EXCESS_60), F.when(near.isNotNull(), F.least(F.greatest(near, F.lit(0.0)), F.lit(1.0))), spike_penalty(c("vs"), SPIKE), spike_penalty(c("ts"), SPIKE))
    out = px.select("code", "idx", *[x.alias(n) for n, x in zip(PENALTIES, parts, strict=True)])
    return out.withColumn("crowding", 100 * sum((c(n) for n in PENALTIES[1:]), c(PENALTIES[0])) / 5)


def trend_inputs(v: Views) -> DataFrame:
    """The five inputs of the trend component at each date's latest period."""
    c = F.col
    of = lambda m, x: F.max(F.when(c("metric") == m, x))
    rows = trends(v).groupBy("as_of", "code").agg(
        of("yoy_revenue", c("acceleration")).alias("yoy_acceleration"), of("qoq_revenue", c("acceleration")).alias("qoq_acceleration"), of("yoy_revenue", c("run_length")).alias("consecutive_improvement"),
        of("net_margin", c("acceleration")).alias("margin_inflection"), of("yoy_profit", c("value") - c("change")).alias("a"), of("yoy_profit", F.when(c("change").isNotNull(), c("value"))).alias("b"),
    )
    label = sign_transition(c("a"), c("b"))
    return rows.withColumn("transition", F.when(label != "UNKNOWN", label)).drop("a", "b")


def components(v: Views) -> DataFrame:
    """The inputs and the five components of each entity on each date, with the flags and what they cost."""
    c = F.col
    v.keep("px", "as_of", "cal", "bench", "statements")
    fund = pit.latest(fundamentals(v), ["as_of", "code"], "pn")
    fund = fund.select("as_of", "code", "pn", *GROWTHS, *MARGINS, mean_known(*[bounded(c(g), 1.5) for g in GROWTHS], *[bounded(c(m), 2.0) for m in MARGINS]).alias("fundamental"))
    turned = F.when(c("transition").isin("NEGATIVE_TO_POSITIVE", "ZERO_TO_POSITIVE"), 80.0).when(c("transition").isin("POSITIVE_TO_NEGATIVE", "ZERO_TO_NEGATIVE"), 20.0).when(c("transition") == "NONE", 50.0)
    lasting = F.when(c("consecutive_improvement").isNotNull(), F.least(F.lit(100.0), c("consecutive_improvement") * 25.0))
    tr = trend_inputs(v)
    tr = tr.select("as_of", "code", *TRENDS, mean_known(bounded(c("yoy_acceleration"), 0.02), bounded(c("qoq_acceleration"), 0.02), lasting, turned, bounded(c("margin_inflection"), 5.0)).alias("trend"))
    flags = F.filter(F.split("flags", r"\|"), lambda x: x != "")
    cost = F.aggregate(flags, F.lit(0), lambda a, x: a + F.when(x.endswith("pressure"), 10).otherwise(15))
    qu = quality(v).select("as_of", "code", c("score").cast("double").alias("quality"), "flags", "gate", F.least(F.lit(CAP), cost).alias("penalty"))
    dates = F.broadcast(v.as_of.select("as_of", "idx"))
    on_date = F.array_contains(v.as_of.agg(F.collect_set("idx")).scalar(), c("idx"))
    at = attention(v, on_date).join(dates, "idx").select("as_of", "code", c("t").alias("turnover_percentile"), c("a").alias("amount_percentile"), c("v").alias("abnormal_volume"), c("score").alias("attention"))
    crowd = crowding(v, on_date).join(dates, "idx").select("as_of", "code", *PENALTIES, "crowding", (100 - c("crowding")).alias("expectation"))
    for part in (tr, qu, at, crowd):
        fund = fund.join(part, ["as_of", "code"], "left")
    return fund


def scored(parts: DataFrame, groups: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Raw score over what is known, the final score, and whether something was missing."""
    c = F.col
    total = sum((F.when(c(g).isNotNull(), WEIGHTS[g]).otherwise(0.0) for g in groups), F.lit(0.0))
    raw = F.when(total > 0, sum((F.coalesce(c(g), F.lit(0.0)) * WEIGHTS[g] for g in groups), F.lit(0.0)) / total)
    cost = F.coalesce("penalty", F.lit(0)) if "quality" in groups else F.lit(0)
    return raw, F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw - cost))), ~mean_all(groups)


def mean_all(groups: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & F.col(g).isNotNull()
    return out


def score_sql(groups: tuple[str, ...]) -> str:
    weight = " + ".join(f"CASE WHEN {g} IS NOT NULL THEN {WEIGHTS[g]}::double ELSE 0 END" for g in groups)
    value = " + ".join(f"coalesce({g}, 0) * {WEIGHTS[g]}::double" for g in groups)
    cost = "coalesce(penalty, 0)" if "quality" in groups else "0"
    return f"greatest(0, least(100, ({value}) / nullif({weight}, 0) - {cost}))"


ALL = VARIANTS["expectation_added"]
SCORES = f"{COMPONENTS}, sc AS (SELECT *, CASE WHEN fundamental IS NULL AND trend IS NULL AND quality IS NULL AND attention IS NULL AND expectation IS NULL THEN NULL ELSE {score_sql(ALL)} END AS score FROM cp)"
RANKED = f"{SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY gate = 'rejected', round(score, 4) DESC NULLS LAST, code) AS rank FROM sc)"


def ranked(v: Views) -> DataFrame:
    """Entities of each date by score, those that the gate rejects last."""
    parts = components(v)
    raw, score, partial = scored(parts, ALL)
    rows = parts.withColumns({"raw": raw, "score": score, "partial": partial})
    return top(rows, ["as_of"], [F.col("gate") == "rejected", F.round("score", 4).desc_nulls_last(), F.col("code")])


@query("X15_turnaround_score", f", {SCORES} SELECT as_of, code, {', '.join(f'round({g}, 4) AS {g}' for g in ALL)}, penalty, round(score, 4) AS score FROM sc")
def x15(v: Views) -> DataFrame:
    parts = components(v)
    _, score, _ = scored(parts, ALL)
    return parts.select("as_of", "code", *[F.round(g, 4).alias(g) for g in ALL], F.col("penalty").cast("long").alias("penalty"), F.round(score, 4).alias("score"))


@query("X17_variants", f", {COMPONENTS}, vs AS ({' UNION ALL '.join(f'''SELECT '{n}' AS variant, as_of, code, {score_sql(g)} AS score FROM cp WHERE {' OR '.join(x + ' IS NOT NULL' for x in g)}''' for n, g in VARIANTS.items())}) SELECT variant, as_of, code, round(score, 4) AS score, row_number() OVER (PARTITION BY variant, as_of ORDER BY round(score, 4) DESC, code) AS rank FROM vs QUALIFY rank <= 10")
def x17(v: Views) -> DataFrame:
    """Four cumulative sets of components scored in one pass over the same components."""
    parts = components(v)
    each = F.array(*[F.struct(F.lit(n).alias("variant"), scored(parts, g)[1].alias("score")) for n, g in VARIANTS.items()])
    rows = parts.select("as_of", "code", F.inline(each)).where("score is not null").withColumn("score", F.round("score", 4))
    return top(rows, ["variant", "as_of"], [F.col("score").desc(), F.col("code")], 10).select("variant", "as_of", "code", "score", "rank")


@query("X18_replay", f", {RANKED} SELECT as_of, rank, code, pn, round(score, 4) AS score, gate = 'rejected' AS rejected FROM rk")
def x18(v: Views) -> DataFrame:
    """The whole scan on every date: components, score, gate and rank in one plan."""
    return ranked(v).select("as_of", "rank", "code", "pn", F.round("score", 4).alias("score"), (F.col("gate") == "rejected").alias("rejected"))


@query("S12_top_n", f", {RANKED}, {MONTHS[2:]} SELECT m.month, r.as_of, m.regime, r.code, r.rank, round(r.score, 4) AS score FROM rk r JOIN (SELECT month, regime FROM ms) m ON m.month = date_trunc('month', r.as_of)::date WHERE r.gate <> 'rejected' AND r.rank <= 5")
def s12(v: Views) -> DataFrame:
    """The first five eligible rows of each snapshot, with the month and regime of the schedule."""
    rows = ranked(v).where("gate <> 'rejected' and rank <= 5").withColumn("month", F.to_date(F.date_trunc("month", "as_of")))
    return rows.join(F.broadcast(months(v).select("month", "regime")), "month").select("month", "as_of", "regime", "code", "rank", F.round("score", 4).alias("score"))


@query("X19_explanations", f", {RANKED} SELECT as_of, rank, code, concat_ws('|', {', '.join(f'''CASE WHEN {g} IS NOT NULL THEN '{g}' END''' for g in ALL)}) AS evidence, flags, penalty FROM rk WHERE rank <= 20")
def x19(v: Views) -> DataFrame:
    """What each of the first twenty rests on: known components, flags and their cost."""
    held = F.concat_ws("|", *[F.when(F.col(g).isNotNull(), g) for g in ALL])
    return ranked(v).where("rank <= 20").select("as_of", "rank", "code", held.alias("evidence"), "flags", F.col("penalty").cast("long").alias("penalty"))


@query("K01_ordered", f", {KNOWN_ALL}, {QUALITY} SELECT as_of, code, row_number() OVER (PARTITION BY as_of ORDER BY prev_inventories ASC NULLS LAST, profit DESC NULLS FIRST, code) AS position FROM qa")
def k01(v: Views) -> DataFrame:
    """An order with its directions and the place of nulls stated."""
    from tidemark.plans.fundamentals import known_all

    w = Window.partitionBy("as_of", "code").orderBy("pn")
    rows = pit.latest(known_all(v).withColumn("before", F.lag("inventories").over(w)), ["as_of", "code"], "pn")
    return top(rows, ["as_of"], [F.col("before").asc_nulls_last(), F.col("profit").desc_nulls_first(), F.col("code")], name="position").select("as_of", "code", "position")


@query("K06_review_sample", f", {RANKED}, rv AS (SELECT *, (fundamental IS NULL)::bigint + (trend IS NULL)::bigint + (quality IS NULL)::bigint + (attention IS NULL)::bigint + (expectation IS NULL)::bigint AS unknown FROM rk), ro AS (SELECT as_of, code, 'top' AS role, rank <= 3 AND gate <> 'rejected' AS taken FROM rv UNION ALL SELECT as_of, code, 'best_ineligible', gate = 'rejected' AND row_number() OVER (PARTITION BY as_of, gate = 'rejected' ORDER BY rank) = 1 FROM rv UNION ALL SELECT as_of, code, 'most_unknown', row_number() OVER (PARTITION BY as_of ORDER BY unknown DESC, code) = 1 FROM rv UNION ALL SELECT as_of, code, 'boundary', rank = 11 FROM rv) SELECT as_of, role, code FROM ro WHERE taken")
def k06(v: Views) -> DataFrame:
    """Rows for review: the best, the best rejected, the least known and the first beyond the cut, marked in one pass."""
    c = F.col
    rows = ranked(v).withColumn("unknown", sum((c(g).isNull().cast("int") for g in ALL), F.lit(0)))
    rows = rows.withColumn("a", F.row_number().over(Window.partitionBy("as_of", c("gate") == "rejected").orderBy("rank"))).withColumn("b", F.row_number().over(Window.partitionBy("as_of").orderBy(c("unknown").desc(), "code")))
    bad = c("gate") == "rejected"
    roles = F.array(F.when((c("rank") <= 3) & ~bad, "top"), F.when(bad & (c("a") == 1), "best_ineligible"), F.when(c("b") == 1, "most_unknown"), F.when(c("rank") == 11, "boundary"))
    return rows.select("as_of", "code", F.explode(F.filter(roles, lambda x: x.isNotNull())).alias("role")).select("as_of", "role", "code")


@query("X20_validation", f", {RANKED} SELECT a.as_of, CASE WHEN count(r.code) = 0 THEN 'UNAVAILABLE' WHEN count(r.attention) = 0 OR count(r.quality) = 0 THEN 'INCOMPLETE' WHEN count(DISTINCT r.rank) <> count(r.code) THEN 'FAILED' ELSE 'READY' END AS status, count(r.code) AS n, count(*) FILTER (r.gate = 'rejected') AS rejected, round(avg(r.score), 4) AS mean FROM as_of a LEFT JOIN rk r ON r.as_of = a.as_of GROUP BY a.as_of")
def x20(v: Views) -> DataFrame:
    """Per date whether the scan is whole, with its counts."""
    g = ranked(v).groupBy("as_of").agg(F.count("code").alias("n"), F.count("attention").alias("a"), F.count("quality").alias("q"), F.count_distinct("rank").alias("d"), F.count_if(F.col("gate") == "rejected").alias("rejected"), F.round(F.avg("score"), 4).alias("mean"))
    rows = v.as_of.select("as_of").join(g, "as_of", "left").fillna(0, ["n", "rejected"])
    status = F.when(F.col("n") == 0, "UNAVAILABLE").when(F.expr("a = 0 or q = 0"), "INCOMPLETE").when(F.col("d") != F.col("n"), "FAILED").otherwise("READY")
    return rows.select("as_of", status.alias("status"), "n", "rejected", "mean")


@query("X12_crowding", f", {CROWDING} SELECT code, idx, {', '.join(f'round({p}, 6) AS {p}' for p in PENALTIES)}, round(crowding, 4) AS crowding, round(100 - crowding, 4) AS expectation, round(crowding, 4) >= {FLAGGED} AS flagged FROM cw")
def x12_crowding(v: Views) -> DataFrame:
    rows = crowding(v)
    score = F.round("crowding", 4)
    return rows.select("code", "idx", *[F.round(p, 6).alias(p) for p in PENALTIES], score.alias("crowding"), F.round(100 - F.col("crowding"), 4).alias("expectation"), (score >= FLAGGED).alias("flagged"))


NUMBERS = (*GROWTHS, *MARGINS, "yoy_acceleration", "qoq_acceleration", "margin_inflection")


@query("X14_components", f", {COMPONENTS} SELECT as_of, code, {', '.join(f'round({x}, 6) AS {x}' for x in NUMBERS)}, consecutive_improvement, transition, round(fundamental, 4) AS fundamental, round(trend, 4) AS trend FROM cp")
def x14_components(v: Views) -> DataFrame:
    """Eleven inputs and the two components that are means of what is known of them."""
    numbers = [F.round(x, 6).alias(x) for x in NUMBERS]
    return components(v).select("as_of", "code", *numbers, F.col("consecutive_improvement").cast("long").alias("consecutive_improvement"), "transition", *[F.round(x, 4).alias(x) for x in ("fundamental", "trend")])


# The fields that each group of features must have.
REGISTRY = {
    "fundamental": (*GROWTHS, *MARGINS),
    "trend": TRENDS,
    "quality": ("quality", "gate"),
    "attention": ("turnover_percentile", "amount_percentile", "abnormal_volume", "attention"),
    "expectation_crowding": (*PENALTIES, "expectation"),
}
FIELDS = [f for fields in REGISTRY.values() for f in fields]
CRITICAL = [g for g in REGISTRY if g != "quality"]


def _group_sql(part: str, fields: tuple[str, ...]) -> str:
    valid = " + ".join(f"({f} IS NOT NULL)::bigint" for f in fields)
    missing = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in sorted(fields))
    return f"SELECT as_of, code, '{part}' AS part, {valid} AS valid, {len(fields)} AS required, concat_ws('|', {missing}) AS missing FROM cp"


GROUPS = f"{COMPONENTS}, gp AS ({' UNION ALL '.join(_group_sql(*x) for x in REGISTRY.items())})"


def groups(v: Views, vectors: DataFrame | None = None) -> DataFrame:
    """Of each group of each entity and date: how many of the required fields are known, and which aren't."""
    registry = F.broadcast(v.spark.createDataFrame([(f, g) for g, fields in REGISTRY.items() for f in fields], "field string, part string"))
    long = (components(v) if vectors is None else vectors).select("as_of", "code", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("known")) for f in FIELDS])))
    missing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("known"), F.col("field")))), "|")
    return long.join(registry, "field").groupBy("as_of", "code", "part").agg(F.count_if("known").alias("valid"), F.count("*").alias("required"), missing.alias("missing"))


@query("G14_group_coverage", f", {GROUPS} SELECT as_of, code, part, valid, required::bigint AS required, round(valid / required, 6) AS coverage, CASE WHEN valid = required THEN 'COMPLETE' WHEN valid > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS status, missing FROM gp")
def g14_groups(v: Views) -> DataFrame:
    status = F.when(F.col("valid") == F.col("required"), "COMPLETE").when(F.col("valid") > 0, "PARTIAL").otherwise("UNKNOWN")
    return groups(v).select("as_of", "code", "part", "valid", "required", F.round(F.col("valid") / F.col("required"), 6).alias("coverage"), status.alias("status"), "missing")


OVERALL = f"""{GROUPS}, ov AS (SELECT as_of, code, sum(valid)::bigint AS valid, string_agg(part, '|' ORDER BY part) FILTER (valid = 0) AS unknown, string_agg(part, '|' ORDER BY part) FILTER (valid < required) AS incomplete, count(*) FILTER (valid = 0 AND part <> 'quality') AS critical FROM gp GROUP BY 1, 2),
  oc AS (SELECT *, valid / {len(FIELDS)} AS coverage, CASE WHEN critical > 0 OR valid / {len(FIELDS)} < 0.25 THEN 'INSUFFICIENT' WHEN valid / {len(FIELDS)} >= 0.9 THEN 'HIGH' WHEN valid / {len(FIELDS)} >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ov)"""


def assessed(v: Views) -> DataFrame:
    return assess(v, components(v))


def assess(v: Views, vectors: DataFrame) -> DataFrame:
    """All 23 required fields of each entity and date, the groups that lack some, and how far the evidence can be relied on."""
    none = F.col("valid") == 0
    named = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("part")))), "|")
    rows = groups(v, vectors).groupBy("as_of", "code").agg(F.sum("valid").alias("valid"), named(none).alias("unknown"), named(F.col("valid") < F.col("required")).alias("incomplete"), F.count_if(none & F.col("part").isin(*CRITICAL)).alias("critical"))
    share = F.col("valid") / len(FIELDS)
    confidence = F.when((F.col("critical") > 0) | (share < 0.25), "INSUFFICIENT").when(share >= 0.9, "HIGH").when(share >= 0.75, "MEDIUM").otherwise("LOW")
    return rows.withColumns({"coverage": share, "confidence": confidence})


@query("G14_evidence_assessment", f", {OVERALL} SELECT as_of, code, valid, round(coverage, 6) AS coverage, coalesce(unknown, '') AS unknown, coalesce(incomplete, '') AS incomplete, confidence FROM oc")
def g14_assessment(v: Views) -> DataFrame:
    return assessed(v).select("as_of", "code", "valid", F.round("coverage", 6).alias("coverage"), "unknown", "incomplete", "confidence")


@query("X16_evidence_gate", f", {OVERALL} SELECT as_of, code, CASE WHEN critical > 0 THEN 'critical_unknown' WHEN coverage < 0.5 THEN 'low_coverage' WHEN confidence = 'INSUFFICIENT' THEN 'low_confidence' END AS reason FROM oc")
def x16_gate(v: Views) -> DataFrame:
    reason = F.when(F.col("critical") > 0, "critical_unknown").when(F.col("coverage") < 0.5, "low_coverage").when(F.col("confidence") == "INSUFFICIENT", "low_confidence")
    return assessed(v).select("as_of", "code", reason.alias("reason"))


@query("G15_snapshot_report", f", {OVERALL} SELECT as_of, count(*) AS n, count(*) FILTER (critical > 0) AS critical, round(avg(coverage), 6) AS mean_coverage, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium, count(*) FILTER (confidence = 'LOW') AS low, count(*) FILTER (confidence = 'INSUFFICIENT') AS insufficient FROM oc GROUP BY as_of")
def g15_report(v: Views) -> DataFrame:
    levels = [F.count_if(F.col("confidence") == x.upper()).alias(x) for x in ("high", "medium", "low", "insufficient")]
    return assessed(v).groupBy("as_of").agg(F.count("*").alias("n"), F.count_if(F.col("critical") > 0).alias("critical"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), *levels)
