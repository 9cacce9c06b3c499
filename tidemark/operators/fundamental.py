"""The features of an entity's latest statements: levels, growth, margins and ratios across statements, each by identity.

Reports are long: one row for each report of a `dataset` (income, cashflow or balancesheet), with its identity and all
values, of which it has those of its dataset. Only an entity's latest period counts, so that each dataset is cut to one
row for each date before it meets the period a year before; values are compared as they were reported, and cash flow
over one quarter as single quarters. Number of exchanges: independent of the number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import growth
from tidemark.operators import pit, trailing

BY = ("as_of", "code")
DATASETS = {"income": ("revenue", "profit", "gross", "operating"), "cashflow": ("cfo",), "balancesheet": ("assets", "equity", "inventories", "receivables")}
VALUES = tuple(x for names in DATASETS.values() for x in names)
#: What two statements of one period must have in common, beside a duration that is alike or a point in time.
ALIKE = ("report_family", "scope", "unit", "accounting")
#: Names of the features.
LEVELS = {"revenue_level": "revenue", "net_profit_level": "profit", "operating_cash_flow": "cfo"}
GROWTHS = {"revenue_yoy": "revenue", "net_profit_yoy": "profit", "operating_profit_yoy": "operating", "inventory_yoy": "inventories", "receivables_yoy": "receivables"}
MARGINS = {"gross_margin": "gross", "operating_margin": "operating", "net_margin": "profit"}
RATIOS = {"cfo_to_profit": ("cfo", "profit"), "roe": ("profit", "equity"), "roa": ("profit", "assets"), "asset_turnover": ("revenue", "assets")}
FEATURES = (*LEVELS, *GROWTHS, *MARGINS, *(m + "_yoy_change" for m in MARGINS), "operating_cash_flow_change", *RATIOS, "fundamental_data_status")


def latest_statements(reports: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The latest period of each entity and dataset; `one` tells whether one identity alone reports it.

    Of reports of one identity that differ in their type, the one available last stands, then the one with the larger
    update flag, then the larger values.
    """
    keys = [*by, "dataset"]
    kind, flag = F.struct(*trailing.PARTS), F.coalesce(F.col("update_flag").try_cast("double"), F.lit(-1.0))
    whole = F.struct(*trailing.PARTS, *VALUES)
    per = reports.groupBy(*keys, "pn").agg(F.min(kind).alias("low"), F.max(kind).alias("high"), F.max(F.struct("available", flag.alias("flag"), whole.alias("row"))).alias("best"))
    per = per.select(*keys, "pn", F.col("low").eqNullSafe(F.col("high")).alias("one"), F.col("best.row").alias("row"))
    return per.groupBy(*keys).agg(F.max_by(F.struct("pn", "one", "row"), "pn").alias("x")).select(*keys, "x.pn", "x.one", "x.row.*")


def cash_growth(reports: DataFrame, last: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Growth of the latest single quarter of cash flow on the quarter before, or the first reason against it."""
    at = last.where("dataset = 'cashflow' and one").select(*by, F.col("pn").alias("last_pn"))
    near = reports.where("dataset = 'cashflow'").join(at, list(by)).where("pn between last_pn - 2 and last_pn")
    quarters = trailing.quarter_series(near, "cfo", [*by, "last_pn"])
    rows = pit.match_comparable(quarters.withColumn("own_reason", F.col("reason")), "quarter_value", 1, [*by, "last_pn"], ["report_type", "own_reason"])
    rows = rows.where("pn = last_pn").withColumn("reason", F.coalesce("own_reason", "reason"))
    return rows.groupBy(*by).agg(F.max(F.struct("growth", "reason")).alias("q"))


def fundamental_group(reports: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row for each entity and feature, with a value or the reason why there is none.

    Reasons, the first one counts: several identities report the latest period (ambiguous_period_chain), a statement or
    value that is missing (missing_value), what comparable periods, growth and margins refuse. Ratios across statements
    need statements of one period and identity (period_alignment_mismatch). Entities without any report have no row;
    fundamental_data_status is 1 where there is an income statement.
    """
    keys = [*by, "dataset"]
    last = latest_statements(reports, by)
    keep = [*keys, "pn", "one", *trailing.PARTS, *VALUES]
    met = pit._explained(last.select(*keep), F.col("pn") - 4, keep, keys, VALUES, reports)
    before = F.coalesce(pit.unknown_part(), pit._mismatch(F.col("matched"), "missing_comparable_period"))
    part = F.struct("pn", "one", *trailing.PARTS, *VALUES, F.col("other").alias("then"), pit.unknown_part().alias("unknown"), before.alias("before"))
    wide = met.groupBy(*by).agg(*[F.max(F.when(F.col("dataset") == d, part)).alias(d) for d in DATASETS])
    wide = wide.join(cash_growth(reports, last, by), list(by), "left")
    home = {x: d for d, names in DATASETS.items() for x in names}
    now = lambda x: F.col(f"{home[x]}.{x}")
    then = lambda x: F.col(f"{home[x]}.then.{x}")
    many = lambda d: F.when(~F.col(d + ".one"), "ambiguous_period_chain")
    lacks = lambda *xs: F.coalesce(many(home[xs[0]]), *[F.when(now(x).isNull(), "missing_value") for x in xs])
    out: dict[str, tuple[Column, Column]] = {n: (now(x), lacks(x)) for n, x in LEVELS.items()}
    for n, x in GROWTHS.items():
        g, why = growth(now(x), then(x))
        out[n] = g, F.coalesce(lacks(x), F.col(home[x] + ".before"), why)
    for n, x in MARGINS.items():
        own, why = trailing.margin(now(x), now("revenue"))
        old, old_why = trailing.margin(then(x), then("revenue"))
        out[n] = own, F.coalesce(lacks(x, "revenue"), why, F.col("income.unknown"))
        out[n + "_yoy_change"] = own - old, F.coalesce(lacks(x, "revenue"), F.col("income.before"), why, old_why)
    out["operating_cash_flow_change"] = F.col("q.growth"), F.coalesce(many("cashflow"), F.when(F.col("cashflow").isNull(), "missing_value"), F.col("q.reason"))

    def aligned(other: str) -> Column:
        a, b = F.col("income"), F.col(other)
        point = F.lit("POINT_IN_TIME")
        same = a["one"] & b["one"] & (a["pn"] == b["pn"]) & (a["duration"].eqNullSafe(b["duration"]) | (a["duration"] == point) | (b["duration"] == point))
        for c in ALIKE:
            same = same & a[c].eqNullSafe(b[c])
        return F.coalesce(same, F.lit(False))

    for n, (x, y) in RATIOS.items():
        other = home[y] if home[x] == "income" else home[x]
        lost = F.coalesce(many(other), F.when(F.col(other).isNull(), "missing_current_period")) if other == "balancesheet" else F.lit(None).cast("string")
        why = F.when(now(y) == 0, "invalid_denominator").when(now(x).isNull() | now(y).isNull(), "missing_value")
        out[n] = now(x) / F.when(now(y) != 0, now(y)), F.when(~aligned(other), F.coalesce(lost, F.lit("period_alignment_mismatch"))).otherwise(why)
    out["fundamental_data_status"] = F.lit(1.0), F.when(F.col("income").isNull(), "no_income_history")
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.when(out[n][1].isNull(), out[n][0]).alias("value"), out[n][1].alias("reason")) for n in FEATURES])
    return wide.select(*by, F.inline(rows))
