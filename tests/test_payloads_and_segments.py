"""Nested payloads, large JSON arrays, segment figures and checks of campaigns, on small inputs of our own."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.operators import nested, preparation, segments
from tidemark.sources import json_array


def test_quantiles_are_exact(spark):
    """Few and many values, ties, one value, negative and unknown ones, a null key, and one group with most of the rows."""
    r = random.Random(1)
    groups = {"a": [r.gauss(0, 1) for _ in range(400)], "b": [1.0] * 50 + [2.0], "c": [5.0], None: [r.choice([-1.0, 0.0, 3.0]) for _ in range(31)], "d": [0.1, 1e9, 1e9 + 1, -1e9]}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("e", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(4)
    for bins in (1, 7, 1024):
        got = {x.g: x.q for x in segments.quantiles(frame, ["g"], "x", (0.0, 0.25, 0.5, 0.9, 1.0), bins).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert got[k] == pytest.approx(np.quantile(v, [0, 0.25, 0.5, 0.9, 1]).tolist(), rel=1e-12, abs=1e-12)
    assert segments.quantiles(frame.limit(0), ["g"], "x", (0.5,)).count() == 0


def test_segment_figures(spark):
    rows = spark.createDataFrame([("v", 2020, 1.0, 0.5), ("v", 2020, 3.0, None), ("v", 2021, -1.0, 0.1), ("v", None, None, None)], "variant string, y int, x double, e double")
    long = segments.by_dimension(rows, {"y": F.col("y")}, ["variant", "x", "e"])
    got = {(r.dim, r.seg): (r.n, r.observed, r.mean, r.median, r.hit, r.std, r.iqr, r.least, r.most, r.mean_excess) for r in segments.segment_figures(long, ["variant", "dim", "seg"], "x", "e").collect()}
    assert got["overall", None][:4] == (4, 3, 1.0, 1.0) and got["overall", None][6] == 2.0
    assert got["y", "2020"] == (2, 2, 2.0, 2.0, 1.0, 1.0, 1.0, 1.0, 3.0, 0.5) and got["y", "2021"] == (1, 1, -1.0, -1.0, 0.0, None, None, -1.0, -1.0, 0.1)
    assert got["y", None] == (1, 0, None, None, None, None, None, None, None, None)


NESTED = {"b": {"x": 1.5, "y": [1, {"z": None}]}, "a": 'q"t'}


def test_flattened(spark):
    frame = spark.createDataFrame([(1, json.dumps(NESTED)), (2, "[]"), (3, "no json"), (4, None), (5, "7"), (6, '{"e":{},"f":[[]]}')], "k int, p string")
    got = {(r.k, r.path): (r.name, r.kind, json.loads(r.value)) for r in nested.flattened(frame, ["k"], "p").collect()}
    assert {p: v for (k, p), v in got.items() if k == 1} == {"$.a": ("a", "value", 'q"t'), "$.b": ("b", "object", NESTED["b"]), "$.b.x": ("x", "value", 1.5), "$.b.y": ("y", "array", NESTED["b"]["y"]), "$.b.y[0]": ("y", "value", 1), "$.b.y[1]": ("y", "object", {"z": None}), "$.b.y[1].z": ("z", "value", None)}
    assert {(k, p) for k, p in got if k != 1} == {(6, "$.e"), (6, "$.f"), (6, "$.f[0]")}


def test_pit_warnings(spark):
    cases = {
        '{"a":{"pit_warning":[0]}}': True, '{"a":{"pit_warning":[]}}': False, '{"a":[{"Reason":"has PIT-warning x"}]}': True, '{"warnings":["ok",{"b":1},"future unsafe"]}': True, '{"x":{"pit_is_safe":false}}': True,
        '{"x":{"pit_is_safe":true},"note":"pit_warning"}': False, '{"pit-unsafe":{"a":{"reason":"ok"}}}': True, '{"pit_unsafe":0.0}': False, '{"future_unsafe":""}': False, "[]": False, "x": False, '{"warning":{"a":"pit_warning"}}': False,
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "k int, p string")
    hit = {r.k for r in nested.pit_warnings(frame, ["k"], "p").collect()}
    assert hit == {i for i, w in enumerate(cases.values()) if w}


def test_store_and_expand(spark):
    """Equal payloads have one root whatever the order of their names; expansion gives back what was stored."""
    turned = {"a": NESTED["a"], "b": {"y": NESTED["b"]["y"], "x": NESTED["b"]["x"]}}
    texts = [json.dumps(NESTED), json.dumps(turned), "[]", "no json", None, '{"e":{},"f":[[],{}]}', "7", '{"b":{"x":1.5,"y":[1,{"z":null}]}}', '{"a\\"b":["1",1,true]}']
    roots, nodes, entries = nested.store(spark.createDataFrame(list(enumerate(texts)), "k int, p string"), "k", "p")
    ref = {r.k: r.ref_id for r in roots.collect()}
    assert ref[0] == ref[1] and sorted(k for k, x in ref.items() if x is None) == [3, 4, 6]
    done = {r.ref_id: (r.status, r.json, r.height) for r in nested.expand(nodes, entries).collect()}
    assert all(s == "ok" for s, _, _ in done.values()) and len(done) == nodes.count()
    for k, t in enumerate(texts):
        if ref[k]:
            assert json.loads(done[ref[k]][1]) == json.loads(t)
    assert done[ref[0]][2] == 3 and done[ref[2]][2] == 0 and done[ref[5]][2] == 2
    # a part that is missing, and one that refers back
    leaf = next(r.ref_id for r in entries.where("name = 'z'").collect())
    part = nested.expand(nodes.where(F.col("ref_id") != leaf), entries)
    status = {r.ref_id: r.status for r in part.collect()}
    assert status[ref[0]] == status[ref[7]] == "below" and status[ref[5]] == "ok" and sorted(status.values()).count("dangling") == 1
    looped = nested.expand(nodes, entries.union(spark.createDataFrame([(leaf, "up", "up", None, ref[0])], entries.schema)))
    status = {r.ref_id: r.status for r in looped.collect()}
    assert status[ref[0]] == status[leaf] == status[ref[7]] == "loop" and status[ref[8]] == "ok"


def test_large_arrays_are_split_anywhere(spark, tmp_path):
    """Documents of every shape, compact and indented, read in splits of a few hundred bytes."""
    r = random.Random(2)

    def one(i):
        return {"day": "2020", "n": i, "s": r.choice(["a}b", 'c\\"{[', '"q"', "x]},{", "", "}}}\\"]), "deep": {"a": [{"b": "}"}, {}], "c": {}}}

    docs = {
        "a": {"config": {"x": [1, {"y": 2}], "s": '"observations"'}, "observations": [one(i) for i in range(40)], "provenance": {"ids": ["p", "q}"]}}, "b": [one(i) for i in range(7)], "c": {"observations": [], "z": 1}, "d": {"observations": [one(1)]},
        "e": {"cfg": "s", "observations": [one(1), {}]}, "f": {"nothing": {"a": 1}}, "g": [], "h": {"k": {"observations": [{"no": 1}]}, "observations": [{"yes": 1}], "t": [{"a": 1}]},
    }
    for k, v in docs.items():
        (tmp_path / f"{k}1.json").write_text(json.dumps(v, separators=(",", ":")))
        (tmp_path / f"{k}2.json").write_text(json.dumps(v, indent=1) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows, headers = json_array.elements(spark, str(tmp_path))
        got, head = {}, {x.file[-7:-5]: json.loads(x.json) for x in headers.collect()}
        for x in rows.collect():
            got.setdefault(x.file[-7:-5], {})[x.element] = json.loads(x.json)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for k, v in docs.items():
        for n in "12":
            want = v if isinstance(v, list) else v.get("observations", [])
            assert [x for _, x in sorted(got.get(k + n, {}).items())] == want
            assert head.get(k + n) == (None if isinstance(v, list) else v | ({"observations": []} if "observations" in v else {}))


def test_artifact(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"configuration": {"z": 1, "a": {"c": 2, "b": 3}}, "observations": [{"code": "A", "r": 1}, {"code": "B", "more": [1.5]}], "provenance": {"scan_snapshot_ids": ["t", "s"], "evaluation_config_fingerprint": "fp"}}))
    got = [r.asDict() for r in sources.artifact(spark, str(tmp_path), "full").orderBy("code").collect()]
    assert [(r["code"], r["r"], r["more"], r["variant"]) for r in got] == [("A", 1, None, "full"), ("B", None, [1.5], "full")]
    assert {(r["_artifact_evaluation_config"], r["_artifact_evaluation_fingerprint"], r["_artifact_snapshot_ids"]) for r in got} == {('{"a":{"b":3,"c":2},"z":1}', "fp", '["s","t"]')}


def test_campaigns_are_refused(spark):
    base = {"campaign": "ok", "variant": "x", "code": 1, "as_of_date": "20200131", "rank": "1", "horizon": "20", "forward_return": "0.1", "benchmark_return": 0.06, "market_cap": 5.0, "snapshot_id": "s1", "evaluation_config": "c", "score_config": "f", "industry": "i"}
    rows = []
    for name, changes in {
        "ok": [{}, {"variant": "y"}, {"variant": "z", "rank": "no"}], "missing": [{}], "bad": [{}, {"variant": "y", "as_of_date": "20200230"}], "twice": [{}, {}, {"variant": "y"}], "snap": [{}, {"variant": "y", "snapshot_id": "s2"}], "snap_null": [{}, {"variant": "y", "snapshot_id": None}],
        "cfg": [{}, {"variant": "y", "evaluation_config": "d"}], "mix": [{}, {"code": 2, "score_config": "g"}, {"variant": "y"}], "bare": [{"snapshot_id": None, "evaluation_config": None, "score_config": None, "industry": None, "market_cap": None, "benchmark_return": None, "forward_return": "nan"}, {"variant": "y", "snapshot_id": None, "evaluation_config": None, "score_config": None}],
    }.items():
        rows += [base | {"campaign": name} | c for c in changes]
    schema = ", ".join(f"{k} {'double' if k in ('benchmark_return', 'market_cap') else 'int' if k == 'code' else 'string'}" for k in base)
    table = preparation.prepared(spark.createDataFrame([tuple(r.values()) for r in rows], schema), (10.0, 20.0), ("small", "mid", "large"))
    got = {r.campaign: (r.refused, r.warnings) for r in preparation.refusals(table, ("x", "y")).collect()}
    everything = "pit_snapshot_provenance_missing|evaluation_config_provenance_missing|score_config_provenance_missing|regime_unavailable_for_some_observations|market_cap_bucket_unavailable_for_some_observations|industry_unavailable_for_some_observations|forward_window_missing_for_some_candidates"
    assert got == {"ok": (None, ""), "missing": ("missing_variants", ""), "bad": ("invalid_values", ""), "twice": ("duplicate_observations", ""), "snap": ("different_snapshots", ""), "snap_null": (None, ""), "cfg": ("different_configurations", ""), "mix": ("mixed_score_configurations", ""), "bare": (None, everything)}
    marks = spark.createDataFrame([(x, c) for x, c in ((0.05, 10.0), (-0.05, 20.0), (0.0501, 9.9), (-0.06, None))], "benchmark_return double, market_cap double").selectExpr("*", "'20200131' as as_of_date", "'1' as rank", "'20' as horizon", "'x' as forward_return")
    assert [(r.regime, r.bucket, r.industry) for r in preparation.prepared(marks, (10.0, 20.0), ("small", "mid", "large")).collect()] == [("range", "mid", "unknown"), ("range", "large", "unknown"), ("bull", "small", "unknown"), ("bear", "unknown", "unknown")]
