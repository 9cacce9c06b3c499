"""Queries on nested payloads: a content-addressed store, warnings at any depth, and large artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quality import INVALID_TOKENS, evidence_category
from tidemark.operators import nested
from tidemark.operators import panel as P
from tidemark.operators.preparation import prepared, refusals
from tidemark.plans.checks import REASON, STATUS
from tidemark.plans.facts import GROWTH, SINGLE
from tidemark.plans.history import _growth
from tidemark.plans.panels import bench
from tidemark.plans.ranking import _alt, picks
from tidemark.plans.stability import HORIZONS, OUTCOMES
from tidemark.plans.stored import RANKED, place, variants
from tidemark.plans.views import Views
from tidemark.registry import query
from tidemark.sources import artifact

PARTS = """pr AS (SELECT *, sha256('object:"name":"' || region || '"') AS region_ref FROM payloads), pn AS (SELECT *, sha256('object:"name":"' || nation || '","region":->' || region_ref) AS nation_ref FROM pr),
  pe AS (SELECT *, sha256('object:"code":' || code || ',"nation":->' || nation_ref) AS entity_ref, sha256('object:"flag":"A","n":' || a) AS ra, sha256('object:"flag":"N","n":' || nn) AS rn, sha256('object:"flag":"R","n":' || r) AS rr FROM pn),
  pl AS (SELECT *, sha256('array:->' || ra || ',->' || rn || ',->' || rr) AS lines_ref FROM pe), pp AS (SELECT *, sha256('object:"entity":->' || entity_ref || ',"lines":->' || lines_ref) AS root_ref FROM pl),
  ed AS (SELECT DISTINCT * FROM (SELECT root_ref AS parent, 'entity' AS at, entity_ref AS child FROM pp UNION ALL SELECT root_ref, 'lines', lines_ref FROM pp UNION ALL SELECT entity_ref, 'nation', nation_ref FROM pp UNION ALL SELECT nation_ref, 'region', region_ref FROM pp
    UNION ALL SELECT lines_ref, '0', ra FROM pp UNION ALL SELECT lines_ref, '1', rn FROM pp UNION ALL SELECT lines_ref, '2', rr FROM pp)),
  nd AS (SELECT DISTINCT * FROM (SELECT root_ref AS ref_id, 'object' AS kind, 3 AS height FROM pp UNION ALL SELECT entity_ref, 'object', 2 FROM pp UNION ALL SELECT nation_ref, 'object', 1 FROM pp UNION ALL SELECT region_ref, 'object', 0 FROM pp
    UNION ALL SELECT lines_ref, 'array', 1 FROM pp UNION ALL SELECT unnest([ra, rn, rr]), 'object', 0 FROM pp))"""


@query("A13_graph", f", {PARTS} SELECT n.ref_id, n.kind, n.height, (SELECT count(*) FROM ed WHERE child = n.ref_id) AS uses FROM nd n")
def a13_graph(v: Views) -> DataFrame:
    """Every distinct part of the payloads once, under the hash of its content, how high it stands and how many others refer to it."""
    _, nodes, entries = nested.store(v.payloads, "code", "payload")
    uses = entries.where("child is not null").groupBy(F.col("child").alias("ref_id")).agg(F.count("*").alias("uses"))
    return nested.merged(nested.merged(nested.expand(nodes, entries), nodes, "ref_id"), uses, "ref_id", "left").select("ref_id", "kind", "height", F.coalesce("uses", F.lit(0)).alias("uses"))


@query("A13_integrity", " SELECT code, CASE WHEN region = 'ASIA' THEN 'below' WHEN region = 'EUROPE' AND (SELECT count(*) FROM payloads WHERE nation = 'FRANCE') > 0 THEN 'loop' ELSE 'ok' END AS status, CASE WHEN region <> 'ASIA' AND NOT (region = 'EUROPE' AND (SELECT count(*) FROM payloads WHERE nation = 'FRANCE') > 0) THEN payload END AS payload FROM payloads")
def a13_integrity(v: Views) -> DataFrame:
    """Payloads from a store in which one part is missing and another refers back to what refers to it."""
    roots, nodes, entries = nested.store(v.payloads, "code", "payload")
    named = lambda x: entries.where((F.col("name") == "name") & (F.col("text") == f'"{x}"')).select("ref_id")
    back = named("EUROPE").join(named("FRANCE").select(F.col("ref_id").alias("child")))  # one row each
    entries = entries.unionByName(back.select("ref_id", F.lit("up").alias("at"), F.lit("up").alias("name"), F.lit(None).cast("string").alias("text"), "child"))
    out = nested.expand(nodes.join(named("ASIA"), "ref_id", "left_anti"), entries)
    return nested.merged(roots, out, "ref_id", "left").select("code", "status", F.col("json").alias("payload"))


#: What an evidence holds beside its value: warnings at several depths, and what only looks like one.
NOTE = """CASE (code * 5 + pn) % 13 WHEN 0 THEN '{"metadata":{"code":' || CAST(code AS varchar(20)) || ',"checks":[{"pit_warning":true}]}}' WHEN 1 THEN '{"metadata":{"pit_warning":[]},"provenance":{"reason":"ok"}}'
  WHEN 2 THEN '{"provenance":{"chain":[{"warnings":["none","future unsafe rows"]},' || CAST(pn AS varchar(20)) || ']}}' WHEN 3 THEN '{"config":{"pit_is_safe":false}}' WHEN 4 THEN '{"config":{"pit_is_safe":true,"note":"pit_warning"}}'
  WHEN 5 THEN '{"components":{"a":{"b":{"c":[[{"Reason":"PIT-unsafe input"}]]}}}}' WHEN 6 THEN '{"config":{"Future-Unsafe":0,"warning":"late"}}' WHEN 7 THEN 'not json' WHEN 8 THEN '{"components":[[1,2],[{"old_pit_unsafe_flag":"yes"}]]}' END"""


@query("F20_nested_warnings", f""", {SINGLE}, {GROWTH.format(v='sq_revenue', lag=4)}, st AS (SELECT as_of, code, pn, {STATUS} AS status, {REASON} AS reason, CASE WHEN why IS NULL THEN (v - base) / base END AS value, {NOTE} AS note FROM g),
  jt AS (SELECT s.as_of, s.code, s.pn, replace(lower(CASE WHEN t.path SIMILAR TO '.*\\[[0-9]+\\]' OR t.fullkey SIMILAR TO '.*\\[[0-9]+\\]' THEN regexp_extract(t.fullkey, '([^.\\[\\]]+)(\\[[0-9]+\\])+$', 1) ELSE t.key END), '-', '_') AS name, t.type, replace(replace(lower(CAST(t.value AS text)), '-', '_'), ' ', '_') AS said, CAST(t.value AS text) AS value, t.key, t.fullkey FROM st s, json_tree(CASE WHEN json_valid(s.note) THEN s.note END) t WHERE s.note IS NOT NULL),
  jn AS (SELECT * REPLACE (CASE WHEN fullkey LIKE '%]' THEN name ELSE replace(lower(key), '-', '_') END AS name) FROM jt WHERE key IS NOT NULL),
  jh AS (SELECT as_of, code, pn, bool_or(CASE WHEN name IN ('pit_warning', 'pit_unsafe', 'future_unsafe', 'future_unsafe_warning') OR (name LIKE '%pit%' AND (name LIKE '%warning%' OR name LIKE '%unsafe%')) THEN value NOT IN ('false', '0', '[]', '{{}}', '""', 'null')
      WHEN name LIKE '%safe%' AND name LIKE '%pit%' AND value = 'false' THEN true WHEN name IN ('warnings', 'warning', 'reason') AND type = 'VARCHAR' THEN regexp_matches(said, 'pit_warning|pit_unsafe|future_unsafe') ELSE false END) AS warned FROM jn GROUP BY ALL),
  sl AS (SELECT st.*, coalesce(warned, false) AS warned, coalesce(lower(trim(status)), 'missing') AS s, coalesce(reason, '') AS r FROM st LEFT JOIN jh ON jh.as_of = st.as_of AND jh.code = st.code AND jh.pn = st.pn)
  SELECT as_of, code, pn, warned, CASE WHEN warned THEN 'invalid' WHEN s LIKE '%unsupported%' OR r LIKE '%unsupported%' THEN 'unsupported' WHEN regexp_matches(r, '{"|".join(INVALID_TOKENS)}') OR s = 'stale' THEN 'invalid' WHEN value IS NULL THEN CASE WHEN s IN ('insufficient_history', 'stale') THEN 'invalid' ELSE 'missing' END
    WHEN s IN ('known', 'valid') THEN 'valid' WHEN s = 'missing' THEN 'missing' ELSE 'invalid' END AS category FROM sl""")
def f20_nested(v: Views) -> DataFrame:
    """Evidence by status, reason and value, and by what is nested in it at any depth."""
    v.keep("as_of")
    rows = v.written(_growth(v).withColumnRenamed("reason", "why").select("as_of", "code", "pn", F.expr(STATUS).alias("status"), F.expr(REASON).alias("reason"), F.col("growth").alias("value"), F.expr(NOTE).alias("note")), "evidence")
    keys = ["as_of", "code", "pn"]
    found = nested.pit_warnings(rows, keys, "note")
    warned = F.coalesce(F.col("warnings") > 0, F.lit(False))
    return rows.join(found, keys, "left").select(*keys, warned.alias("warned"), evidence_category(F.col("status"), F.col("reason"), F.col("value"), warned).alias("category"))


@query("S11_artifacts", f"""{RANKED} SELECT variant, '{{"top":20,"variant":"' || variant || '"}}' AS config, 'fp-' || variant AS fingerprint, '["a","b"]' AS snapshots, strftime(as_of, '%Y%m%d') AS day, code, rank FROM vr""")
def s11_artifacts(v: Views) -> DataFrame:
    """One document of each variant with all its observations in one array, read back by as many tasks as its bytes fill."""
    rows = variants(v).select("variant", F.date_format("as_of", "yyyyMMdd").alias("day"), "code", "rank")
    nth = F.row_number().over(Window.partitionBy("variant").orderBy("day", "rank"))
    lines = rows.withColumn("n", nth).select("variant", "n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), F.to_json(F.struct("day", "code", "rank"))).alias("line"))
    name = F.col("variant")
    head = F.concat(F.lit('{"configuration":{"variant":"'), name, F.lit('","top":20},"provenance":{"evaluation_config_fingerprint":"fp-'), name, F.lit('","scan_snapshot_ids":["b","a"]},"observations":['))
    ends = rows.select("variant").distinct().select("variant", F.inline(F.array(F.struct(F.lit(0).alias("n"), head.alias("line")), F.struct(F.lit(2**31 - 1).alias("n"), F.lit("]}").alias("line")))))
    path = place(v, "artifacts")
    # a document is one file, which one task writes row by row
    lines.unionByName(ends).repartition("variant").sortWithinPartitions("variant", "n").select("variant", "line").write.partitionBy("variant").text(path)
    out = None
    for label in ("volume", "turnover"):
        got = artifact(v.spark, f"{path}/variant={label}", label)
        out = got if out is None else out.unionByName(got)
    return out.select("variant", F.col("_artifact_evaluation_config").alias("config"), F.col("_artifact_evaluation_fingerprint").alias("fingerprint"), F.col("_artifact_snapshot_ids").alias("snapshots"), "day", F.col("code").cast("long").alias("code"), F.col("rank").cast("long").alias("rank"))


CAMPAIGNS = 8
OBSERVED = f"""{OUTCOMES}, cp AS (SELECT k AS campaign, variant, code, as_of, CAST(as_of AS text) AS day, CASE WHEN k = 2 AND code % 5 = 0 THEN 'x' ELSE CAST(1 + code % 20 AS text) END AS rank, h, gross, CASE WHEN k = 7 AND code % 3 = 0 THEN NULL ELSE mark END AS mark,
    CASE WHEN code % 4 <> 0 THEN 10.0 * code END AS cap, CASE WHEN k <> 7 THEN CAST(as_of AS text) || CASE WHEN k = 4 AND variant = 'turnover' AND h = 20 THEN 'b' ELSE 'a' END END AS snapshot_id, CASE WHEN k <> 7 THEN 'cfg' || CASE WHEN k = 5 AND code % 2 = 0 THEN '2' ELSE '1' END END AS evaluation_config,
    CASE WHEN k <> 7 THEN variant || CASE WHEN k = 6 AND code % 2 = 0 THEN '2' ELSE '1' END END AS score_config FROM ov, (SELECT unnest(range({CAMPAIGNS})) AS k) WHERE NOT (k = 1 AND variant = 'turnover')),
  cq AS (SELECT * FROM cp UNION ALL SELECT * FROM cp WHERE campaign = 3 AND code % 7 = 0)"""


def campaigns(v: Views) -> DataFrame:
    """Observations of two variants in eight campaigns: one is whole, the others have something missing or mixed."""
    c = F.col
    v.keep("px", "as_of", "cal", "bench")
    last = v.cal.agg(F.max("idx")).scalar()
    horizons = v.spark.createDataFrame([(h,) for h in HORIZONS], "h int")
    both = picks(v).select(F.lit("volume").alias("variant"), "as_of", "code", "idx").unionByName(_alt(v).select(F.lit("turnover").alias("variant"), "as_of", "code", "idx"))
    rows = P.forward(both, v.px, bench(v), horizons, last).select("variant", "as_of", "code", "h", "gross", (c("b1") / c("b0") - 1).alias("mark"))
    rows = rows.withColumn("campaign", F.explode(F.sequence(F.lit(0), F.lit(CAMPAIGNS - 1)))).where("not (campaign = 1 and variant = 'turnover')")
    k, day = c("campaign"), c("as_of").cast("string")
    rows = rows.select(
        "campaign", "variant", "code", day.alias("as_of_date"), F.when((k == 2) & (c("code") % 5 == 0), "x").otherwise((1 + c("code") % 20).cast("string")).alias("rank"), c("h").alias("horizon"), c("gross").alias("forward_return"), F.when(~((k == 7) & (c("code") % 3 == 0)), c("mark")).alias("benchmark_return"),
        F.when(c("code") % 4 != 0, 10.0 * c("code")).alias("market_cap"), F.when(k != 7, F.concat(day, F.when((k == 4) & (c("variant") == "turnover") & (c("h") == 20), "b").otherwise("a"))).alias("snapshot_id"), F.when(k != 7, F.when((k == 5) & (c("code") % 2 == 0), "cfg2").otherwise("cfg1")).alias("evaluation_config"),
        F.when(k != 7, F.concat("variant", F.when((k == 6) & (c("code") % 2 == 0), "2").otherwise("1"))).alias("score_config"), F.when(c("code") % 9 != 0, "goods").alias("industry"),
    )
    rows = prepared(rows, (100.0, 500.0), ("small", "mid", "large"))
    return v.written(rows.unionByName(rows.where("campaign = 3 and code % 7 = 0")), "campaigns")


@query("E12_preparation", f""", {OBSERVED}, r1 AS (SELECT campaign, count(DISTINCT variant) AS variants, count(*) FILTER (rank = 'x') AS bad, count(DISTINCT evaluation_config) AS configs, count(score_config) AS scores, count(*) FILTER (mark IS NULL) AS no_regime, count(*) FILTER (cap IS NULL) AS no_bucket, count(*) FILTER (code % 9 = 0) AS no_industry, count(*) FILTER (gross IS NULL) AS no_return FROM cq GROUP BY 1),
  r2 AS (SELECT campaign, max(n) AS repeats FROM (SELECT campaign, variant, code, day, h, count(*) AS n FROM cq GROUP BY ALL) GROUP BY 1), r3 AS (SELECT campaign, count(DISTINCT ids) FILTER (len(ids) > 0) AS snapshots FROM (SELECT campaign, variant, coalesce(list_sort(list(DISTINCT snapshot_id) FILTER (snapshot_id IS NOT NULL)), []) AS ids FROM cq GROUP BY ALL) GROUP BY 1),
  r4 AS (SELECT campaign, max(n) AS mixed FROM (SELECT campaign, variant, count(DISTINCT score_config) AS n FROM cq GROUP BY ALL) GROUP BY 1),
  rf AS (SELECT *, CASE WHEN variants < 2 THEN 'missing_variants' WHEN bad > 0 THEN 'invalid_values' WHEN repeats > 1 THEN 'duplicate_observations' WHEN snapshots > 1 THEN 'different_snapshots' WHEN configs > 1 THEN 'different_configurations' WHEN mixed > 1 THEN 'mixed_score_configurations' END AS refused FROM r1 JOIN r2 USING (campaign) JOIN r3 USING (campaign) JOIN r4 USING (campaign))
  SELECT CAST(campaign AS int) AS campaign, refused, CASE WHEN refused IS NOT NULL THEN '' ELSE concat_ws('|', CASE WHEN snapshots = 0 THEN 'pit_snapshot_provenance_missing' END, CASE WHEN configs = 0 THEN 'evaluation_config_provenance_missing' END, CASE WHEN scores = 0 THEN 'score_config_provenance_missing' END, CASE WHEN no_regime > 0 THEN 'regime_unavailable_for_some_observations' END,
    CASE WHEN no_bucket > 0 THEN 'market_cap_bucket_unavailable_for_some_observations' END, CASE WHEN no_industry > 0 THEN 'industry_unavailable_for_some_observations' END, CASE WHEN no_return > 0 THEN 'forward_window_missing_for_some_candidates' END) END AS warnings FROM rf""")
def e12_preparation(v: Views) -> DataFrame:
    """Which campaigns may be compared, the first thing that refuses the others, and what the rest lack."""
    return refusals(campaigns(v), ("volume", "turnover"))


@query("E12_segments", f", {OBSERVED} SELECT CAST(campaign AS int) AS campaign, CAST(year(as_of) AS int) AS year, CASE WHEN mark > 0.05 THEN 'bull' WHEN mark < -0.05 THEN 'bear' WHEN mark IS NOT NULL THEN 'range' ELSE 'unknown' END AS regime, CASE WHEN cap < 100 THEN 'small' WHEN cap < 500 THEN 'mid' WHEN cap IS NOT NULL THEN 'large' ELSE 'unknown' END AS bucket, count(*) AS n, count(gross) AS observed FROM cq GROUP BY ALL")
def e12_segments_full(v: Views) -> DataFrame:
    """Observations by year, regime and size, as they are compared."""
    return campaigns(v).groupBy("campaign", "year", "regime", "bucket").agg(F.count("*").alias("n"), F.count("forward_return").alias("observed"))
