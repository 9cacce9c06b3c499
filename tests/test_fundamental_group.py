"""Twenty features of the latest statements by identity, on small tables with numbers of our own."""

import pytest

from tests.test_identity import D, P
from tidemark.operators import fundamental as G

DAY = D(2023, 5, 1)
PARTS = {"duration": "CUMULATIVE_YTD", "report_family": "source_default", "statement_type": "S", "scope": "consolidated", "unit": "cny:1", "accounting": "source_default"}
SCHEMA = "as_of date, code int, dataset string, pn int, available date, update_flag string, report_type string, " + ", ".join(c + " string" for c in PARTS) + ", " + ", ".join(x + " double" for x in G.VALUES)


def income(pn, revenue=100.0, profit=10.0, gross=30.0, operating=12.0, **other):
    return statement("income", pn, {"revenue": revenue, "profit": profit, "gross": gross, "operating": operating}, other)


def cash(pn, cfo, **other):
    return statement("cashflow", pn, {"cfo": cfo}, other)


def balance(pn, assets=1000.0, equity=400.0, inventories=50.0, receivables=20.0, **other):
    return statement("balancesheet", pn, {"assets": assets, "equity": equity, "inventories": inventories, "receivables": receivables}, {"duration": "POINT_IN_TIME"} | other)


def statement(dataset, pn, values, other):
    own = {"kind": "1", "flag": "0", "day": DAY} | other
    parts = [own.get(c, x) for c, x in PARTS.items()]
    return (dataset, pn, own["day"], own["flag"], own["kind"], *parts, *[values.get(x) for x in G.VALUES])


YEAR = [income(P + 3, 80.0, 8.0, 20.0, 10.0), balance(P + 3, inventories=40.0, receivables=0.0), income(P + 7), balance(P + 7), cash(P + 5, 5.0), cash(P + 6, 9.0), cash(P + 7, 15.0)]
CASES = {
    1: YEAR,
    # two identities of the latest income statement; another unit a year before; an older balance sheet
    2: [*YEAR, income(P + 7, unit="cny:1000")],
    3: [income(P + 3, unit="cny:1000"), balance(P + 6), income(P + 7), cash(P + 7, 1.0)],
    # statements on another basis, nothing a year before, a denominator of zero, one below it
    4: [income(P + 7, revenue=-5.0, profit=0.0), cash(P + 7, 3.0), balance(P + 7, equity=0.0, scope="parent_only")],
    5: [income(P + 7, profit=0.0), cash(P + 7, 3.0, duration="SINGLE_QUARTER"), cash(P + 6, 2.0, duration="SINGLE_QUARTER"), balance(P + 7, equity=0.0)],
    # no income statement; values that are null; a part that isn't known
    6: [cash(P + 6, -2.0), cash(P + 7, 3.0), balance(P + 3), balance(P + 7, inventories=None)],
    7: [income(P + 3), income(P + 7, revenue=None, accounting="UNKNOWN")],
    # one identity in two types of report: the one available later stands, then the larger flag
    8: [income(P + 7, revenue=1.0), income(P + 7, revenue=2.0, kind="2", day=D(2023, 6, 1)), balance(P + 7, assets=5.0, flag="1"), balance(P + 7, assets=9.0, kind="2")],
}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(DAY, k, *r) for k, rs in CASES.items() for r in rs], SCHEMA)


@pytest.fixture(scope="module")
def got(frame):
    return {(r.code, r.feature): (None if r.value is None else round(r.value, 6), r.reason) for r in G.fundamental_group(frame).collect()}


def test_all_features_of_one_identity(got):
    want = {
        "revenue_level": 100, "net_profit_level": 10, "operating_cash_flow": 15, "revenue_yoy": 0.25, "net_profit_yoy": 0.25, "operating_profit_yoy": 0.2, "inventory_yoy": 0.25, "gross_margin": 0.3, "operating_margin": 0.12,
        "net_margin": 0.1, "gross_margin_yoy_change": 0.05, "operating_margin_yoy_change": -0.005, "net_margin_yoy_change": 0, "operating_cash_flow_change": 0.5, "cfo_to_profit": 1.5, "roe": 0.025, "roa": 0.01, "asset_turnover": 0.1, "fundamental_data_status": 1,
    }
    for n, x in want.items():
        assert got[1, n] == (x, None), n
    assert got[1, "receivables_yoy"] == (None, "invalid_denominator")
    assert {n for k, n in got if k == 1} == set(G.FEATURES) and len(G.FEATURES) == 20 and len(got) == 20 * len(CASES)


def test_latest_period_of_several_identities(got):
    for n in ("revenue_level", "revenue_yoy", "gross_margin", "net_margin_yoy_change"):
        assert got[2, n] == (None, "ambiguous_period_chain")
    assert got[2, "roe"] == got[2, "cfo_to_profit"] == (None, "period_alignment_mismatch")
    assert got[2, "operating_cash_flow"] == (15, None) and got[2, "fundamental_data_status"] == (1, None)


def test_periods_that_do_not_compare(got):
    assert got[3, "revenue_level"] == (100, None) and got[3, "revenue_yoy"] == got[3, "net_margin_yoy_change"] == (None, "unit_mismatch")
    assert got[3, "roa"] == (None, "period_alignment_mismatch") and got[3, "inventory_yoy"] == (None, "missing_comparable_period")
    assert got[3, "operating_cash_flow_change"] == (None, "missing_preceding_cumulative_period") and got[3, "cfo_to_profit"] == (0.1, None)
    assert got[4, "revenue_yoy"] == (None, "missing_comparable_period") and got[4, "net_margin"] == (None, "negative_denominator")
    assert got[4, "cfo_to_profit"] == (None, "invalid_denominator") and got[4, "roe"] == (None, "period_alignment_mismatch")


def test_statements_that_are_aligned(got):
    # a single quarter of cash flow and a sum from the year's start aren't; a point in time goes with both
    assert got[5, "cfo_to_profit"] == (None, "period_alignment_mismatch") and got[5, "operating_cash_flow_change"] == (0.5, None)
    assert got[5, "roe"] == (None, "invalid_denominator") and got[5, "roa"] == (0, None) and got[5, "asset_turnover"] == (0.1, None)


def test_what_is_missing(got):
    assert got[6, "fundamental_data_status"] == (None, "no_income_history") and got[6, "revenue_level"] == got[6, "revenue_yoy"] == got[6, "net_margin"] == (None, "missing_value")
    assert got[6, "cfo_to_profit"] == got[6, "roe"] == (None, "period_alignment_mismatch") and got[6, "inventory_yoy"] == (None, "missing_value") and got[6, "receivables_yoy"] == (0, None)
    assert got[3, "receivables_yoy"] == (None, "missing_comparable_period") and got[7, "roe"] == (None, "missing_current_period") and got[7, "operating_cash_flow"] == (None, "missing_value")
    # a value that is missing comes before a part that isn't known
    assert got[7, "revenue_yoy"] == (None, "missing_value") and got[7, "net_profit_yoy"] == (None, "unknown_accounting_semantics") and got[7, "net_profit_level"] == (10, None)
    assert got[8, "revenue_level"] == (2, None) and got[8, "asset_turnover"] == (0.4, None)


def test_empty_and_repeated(frame, got):
    assert G.fundamental_group(frame.limit(0)).count() == 0
    twice = G.fundamental_group(frame.unionByName(frame)).collect()
    assert {(r.code, r.feature): (None if r.value is None else round(r.value, 6), r.reason) for r in twice} == got and len(twice) == len(got)
