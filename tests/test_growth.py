"""What grows with the input, seen in the plans that Spark ran: nothing large is collected by the driver to be broadcast, nothing is read twice or sorted for nothing."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import nested, order


def plans(spark, run):
    """The physical plans, as they ended, of all that run() executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    run()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    found = store.executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]


@pytest.fixture(scope="module")
def payloads(spark):
    texts = [json.dumps({"a": {"b": {"n": i % 3}, "c": i}, "d": [{"x": i % 2}, {"y": i % 5}]}) for i in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "k int, p string")


def test_stores_are_not_broadcast(spark, payloads):
    """parts and references go from task to task, also those of a small store, in which one part is missing and one leads back."""

    def run():
        roots, nodes, entries = nested.store(payloads, "k", "p")
        leaf = next(r.ref_id for r in entries.where("name = 'x'").collect())
        out = nested.expand(nodes.where(F.col("ref_id") != leaf), entries)
        assert {r.status: r["count"] for r in out.groupBy("status").count().collect()}.keys() == {"ok", "dangling", "below"}
        assert nested.merged(roots, out, "ref_id", "left").count() == 60

    seen = plans(spark, run)
    assert len(seen) > 10 and any("SortMergeJoin" in p for p in seen)
    assert not [p for p in seen if "BroadcastExchange" in p]


def test_window_figures_equal_a_loop(spark):
    """F3, F4, F6 to F9: medians, maxima and shares of the rows that are asked for, over all rows, in blocks and across them; unknown values, ties, windows without rows."""
    r = random.Random(5)
    rows = [(c, i, r.choice([None, float("nan"), 1.0, 2.0, r.random(), r.random() * 9]), r.random() < 0.3) for c in range(5) for i in range(1, 90) if r.random() < 0.8]
    frame = spark.createDataFrame(rows + [(9, 3, 1.0, True), (9, 4, None, None)], "code long, idx int, x double, asked boolean").repartition(3)
    for by_rows, block, only in ((True, 16, "asked"), (False, 16, "asked"), (False, 4096, None), (True, 4096, "asked")):
        figures = {"m": order.Figure("median", "x", (-12, -1), 3), "h": order.Figure("max", "x", (-15, -1), 2), "s": order.Figure("share", "x", (-9, 0), 2)}
        got = {(g.code, g.idx): (g.m, g.h, g.s) for g in order.window_figures(frame, figures, count_rows=by_rows, block=block, only=only).collect()}
        want = {}
        for code in {x[0] for x in rows} | {9}:
            own = sorted((x for x in [*rows, (9, 3, 1.0, True), (9, 4, None, None)] if x[0] == code), key=lambda x: x[1])
            place = {x[1]: n if by_rows else x[1] for n, x in enumerate(own)}
            for x in own:
                near = lambda a, b: [y[2] for y in own if place[x[1]] + a <= place[y[1]] <= place[x[1]] + b and y[2] is not None and y[2] == y[2]]  # noqa: B023, E731
                m, h, s = near(-12, -1), near(-15, -1), near(-9, 0)
                known = x[2] is not None and x[2] == x[2]
                if x[3] or not only:
                    want[code, x[1]] = (np.median(m) if len(m) >= 3 else None, max(h) if len(h) >= 2 else None, sum(y <= x[2] for y in s) / len(s) if known and len(s) >= 2 else None)
        assert got == want


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="the tables are not here")
def test_batches_are_not_broadcast(spark):
    """batches are checked and routed by tasks that are dealt by number of rows."""
    seen = plans(spark, lambda: registry.queries()["A19_routed_batches"](spark, "/root/testdata/sf0.001").collect())
    assert any("REPARTITION_BY_NUM" in p for p in seen)
    assert not [p for p in seen if "BroadcastHashJoin" in p]
