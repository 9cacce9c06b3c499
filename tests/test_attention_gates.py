"""Every gate of low attention on a small market, against plain loops."""

import datetime as dt
import random
import statistics

from tidemark.operators.attention import FIELDS, Limits, low_attention

D = dt.date(2020, 1, 1)
LIMITS = Limits(own_window=12, own_least=4, listing_days=30, population=3, base_window=6, base_least=3, cap=3.0, stale_days=4, amount_window=5, least_amount=20.0, surge=2.0)


def day(i):
    return D + dt.timedelta(days=i)


def test_gates_equal_a_loop(spark):
    r = random.Random(1)
    px = {(c, i): [r.choice([None, 0.0, 1.0, 5.0, r.uniform(1, 60)]), r.choice([None, 0.0, r.uniform(1, 9)]), r.choice([None, 0.0, r.uniform(5, 90)])] for c in range(1, 7) for i in range(60) if r.random() < (0.2 if c == 6 else 0.85) and not (c == 5 and 30 < i < 50)}
    px |= {(7, i): [1.0, 1.0, 1.0] for i in range(3)}
    listed = {1: None, 2: 10, 3: 25, 4: None, 5: 0, 6: None, 7: 0, 8: None}
    asked = [(a, c) for a in (0, 8, 20, 33, 36, 45, 59, 70) for c in listed]
    rows = spark.createDataFrame([(c, day(i), *x) for (c, i), x in px.items()], "code int, day date, vol double, turnover double, amount double").repartition(3)
    grid = spark.createDataFrame([(day(a), c, None if listed[c] is None else day(listed[c])) for a, c in asked], "as_of date, code int, list_day date")
    got = {((x.as_of - D).days, x.code): x for x in low_attention(rows, grid, LIMITS).collect()}
    assert len(got) == len(asked)
    at = {"vol": 0, "turnover": 1, "amount": 2}
    for a, c in asked:
        session = max(i for _, i in px if i <= a)
        mine = sorted(i for k, i in px if k == c and i <= a and (listed[c] is None or i >= listed[c]))
        last = mine[-1] if mine else None
        status = "no_data" if last is None else "traded" if last == session else "stale" if session - last > LIMITS.stale_days else "suspended_session"
        age = None if listed[c] is None else a - listed[c]
        young, traded, x = age is not None and age < LIMITS.listing_days, status == "traded", got[a, c]
        value = lambda i, f, c=c: px[c, i][at[f]]
        amounts = [value(i, "amount") for i in mine[-LIMITS.amount_window :] if value(i, "amount") is not None]
        gates = ["unknown_liquidity"] if not amounts else ["low_liquidity"] if sum(amounts) / len(amounts) < LIMITS.least_amount else []
        if traded:
            now = value(last, "amount")
            gates += ["unknown_current_liquidity"] if now is None else ["no_trading_activity"] if now <= 0 else []
        gates += (["new_listing"] if young else []) + ([] if traded else ["no_session_at_decision"])
        assert (x.status, x.liquidity_reasons) == (status, "|".join(gates))
        missing = {"stale": "stale_data", "suspended_session": status, "no_data": "missing_history", "traded": None}[status]
        assert x.self_reason == (missing or ("new_listing" if young else None))
        shares = {}
        for k, f in FIELDS.items():
            own = cross = None
            if traded and value(last, f) is not None:
                past = [value(i, f) for i in mine[:-1][-LIMITS.own_window :] if value(i, f) is not None]
                every = [v[at[f]] for (_, i), v in px.items() if i == session and v[at[f]] is not None]
                own = sum(p <= value(last, f) for p in past) / len(past) if len(past) >= LIMITS.own_least and not young else None
                cross = sum(p <= value(last, f) for p in every) / len(every) if len(every) >= LIMITS.population else None
            assert (x[f"self_{k}"], x[f"cross_{k}"]) == (own, cross)
            shares |= {"self_" + k: own, "cross_" + k: cross}
        ratios = []
        for f in ("vol", "turnover"):
            past = [value(i, f) for i in mine[:-1][-LIMITS.base_window :] if value(i, f) is not None] if traded else []
            base = statistics.median(past) if len(past) >= LIMITS.base_least else None
            ratios.append(value(last, f) / base if base and value(last, f) is not None else None)
        known = [q for q in ratios if q is not None]
        surge = any(q >= LIMITS.surge for q in known) if known else None
        assert (x.abnormal_volume, x.capped, x.baseline_change, x.attention_surge) == (None if ratios[0] is None else min(ratios[0], LIMITS.cap), ratios[0] is not None and ratios[0] > LIMITS.cap, ratios[1], surge)
        core = [shares[k] for k in ("cross_turnover", "cross_amount", "self_turnover", "self_amount")]
        score = None if None in core else 100 * sum(1 - q for q in core) / 4
        assert (x.score is None) == (score is None) and (score is None or abs(x.score - score) < 1e-9)
        assert x.opportunity == (None if score is None else not gates and traded and not surge)
    assert {x.status for x in got.values()} == {"traded", "suspended_session", "stale", "no_data"} and {x.opportunity for x in got.values()} == {True, False, None}
