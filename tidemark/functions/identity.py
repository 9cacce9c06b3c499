"""Expressions that tell what a reported row is: duration, scope, unit, statement and family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, DEFAULT = "UNKNOWN", "source_default"

# Report types 1 to 8 and the words for durations, scopes and units.
SINGLE_TYPES, CUMULATIVE_TYPES = ("2", "3", "7", "8"), ("1", "4", "5", "6")
DURATIONS = {
    "SINGLE_QUARTER": "single|quarter(ly)?|.*single.*quarter.*|.*quarter.*single.*",
    "CUMULATIVE_YTD": "annual|fy|.*ytd|.*(cumulative|yeartodate).*",
    "POINT_IN_TIME": "stock|instant|.*(point|snapshot).*",
}
YES, NO = ("1", "true", "yes", "y"), ("0", "false", "no", "n")
CONSOLIDATED_TYPES, PARENT_TYPES = ("1", "2", "3", "4"), ("5", "6", "7", "8")
CONSOLIDATED = ("consolidated", "consolidation", "合并", "合并报表")
PARENT = ("parent", "parentonly", "parentcompany", "母公司", "母公司报表")
UNSUPPORTED = ("unknown", "unsupported", "na", "n/a")
UNITS = {"cny:1": ("cny", "rmb", "yuan", "元", "人民币"), "cny:1000": ("thousandcny", "thousandrmb", "千元"), "cny:1000000": ("millioncny", "millionrmb", "百万元")}


def token(c: Column) -> Column:
    """Lower case, with single spaces in place of white space, hyphens and underscores; null if nothing is said."""
    text = F.trim(F.regexp_replace(F.lower(F.regexp_replace(c.cast("string"), r"^(\d+)\.0+$", "$1")), r"[\s_-]+", " "))
    return F.when(~text.isin("", "nan", "nat", "none", "<na>"), text)


def agreed(values: Sequence[Column]) -> Column:
    """What all that is said agrees on; UNKNOWN where it differs, null where nothing is said."""
    said = F.array_distinct(F.filter(F.array(*values), lambda x: x.isNotNull()))
    return F.when(F.size(said) > 1, UNKNOWN).when(F.size(said) == 1, F.element_at(said, 1))


def _by_type(report_type: Column, first: tuple[str, ...], a: str, second: tuple[str, ...], b: str) -> Column:
    t = token(report_type)
    return F.when(t.isin(*first), a).when(t.isin(*second), b)


def compact(c: Column) -> Column:
    return F.replace(token(c), F.lit(" "), F.lit(""))


def duration_word(c: Column) -> Column:
    """The duration whose pattern a word or phrase fits, UNKNOWN if none; null where nothing is said."""
    w = compact(c)
    fits = [F.when(w.rlike(f"(?s)^({pattern})$"), name) for name, pattern in DURATIONS.items()]
    return F.when(w.isNotNull(), F.coalesce(*fits, F.lit(UNKNOWN)))


def said_yes(c: Column, yes: str, no: str, more: Sequence[str] = ()) -> Column:
    """What a flag means; UNKNOWN if it is neither yes nor no, null where nothing is said."""
    t = token(c)
    return F.when(t.isin(*YES, *more), yes).when(t.isin(*NO), no).when(t.isNotNull(), UNKNOWN)


def duration(dataset: str, explicit: Sequence[Column], report_type: Column, start: Column, year: Column, quarter: Column, single: Sequence[Column] = (), cumulative: Sequence[Column] = ()) -> Column:
    """SINGLE_QUARTER, CUMULATIVE_YTD, POINT_IN_TIME or UNKNOWN.

    single and cumulative are flags. What columns say must agree with one another and with the report type; a row that says nothing goes by its report
    type, then by its first day, then by its data set. Balance sheets are points in time only.
    """
    said = agreed([duration_word(c) for c in explicit] + [said_yes(c, "SINGLE_QUARTER", "CUMULATIVE_YTD", ("single", "single quarter")) for c in single] + [said_yes(c, "CUMULATIVE_YTD", "SINGLE_QUARTER", ("cumulative", "ytd")) for c in cumulative])
    typed = _by_type(report_type, SINGLE_TYPES, "SINGLE_QUARTER", CUMULATIVE_TYPES, "CUMULATIVE_YTD")
    if dataset == "balancesheet":
        return F.when(said.isNull() | ((said == "POINT_IN_TIME") & typed.isNull()), "POINT_IN_TIME").otherwise(UNKNOWN)
    day = F.when(start == F.make_date(year, F.lit(1), F.lit(1)), "CUMULATIVE_YTD").when(start == F.make_date(year, quarter * 3 - 2, F.lit(1)), "SINGLE_QUARTER")
    silent = F.coalesce(typed, day, F.lit("CUMULATIVE_YTD" if dataset in ("income", "cashflow") else UNKNOWN))
    return F.when(said.isNull(), silent).when(typed.isNotNull() & (typed != said), UNKNOWN).otherwise(said)


def raw(c: Column) -> Column:
    """A word that no list knows, marked once."""
    t = token(c)
    return F.when(t.startswith("raw:"), t).otherwise(F.concat(F.lit("raw:"), t))


def scope(named: Sequence[Column], report_type: Column, consolidated: Sequence[Column] = ()) -> Column:
    """What named columns and flags agree on, else what the report type says; consolidated holds flags."""

    def one(c: Column) -> Column:
        word = compact(c)
        return F.when(word.isin(*CONSOLIDATED), "consolidated").when(word.isin(*PARENT), "parent_only").when(word.isin(*UNSUPPORTED), UNKNOWN).when(word == "sourcedefault", DEFAULT).when(word.isNotNull(), raw(c))

    said = [one(c) for c in named] + [said_yes(c, "consolidated", "parent_only") for c in consolidated]
    return F.coalesce(agreed(said), _by_type(report_type, CONSOLIDATED_TYPES, "consolidated", PARENT_TYPES, "parent_only"), F.lit(DEFAULT))


def unit(c: Column) -> Column:
    word = compact(c)
    out = F.when(word.isNull() | (word == "sourcedefault"), DEFAULT).when(word.isin(*UNSUPPORTED), UNKNOWN).when(word.startswith("cny:"), token(c))
    for name, words in UNITS.items():
        out = out.when(word.isin(*words) | (word.contains(words[0]) if "1000" in name else F.lit(False)), name)
    return out.otherwise(raw(c))


def accounting(*named: Column) -> Column:
    """What named columns agree on."""

    def one(c: Column) -> Column:
        t = token(c)
        return F.when(t == "source default", DEFAULT).when(t.isin(*UNSUPPORTED), UNKNOWN).when(t.isNotNull(), raw(c))

    return F.coalesce(agreed([one(c) for c in named]), F.lit(DEFAULT))


# The statement that a data set holds.
STATEMENTS = {"income": "INCOME_STATEMENT", "cashflow": "CASH_FLOW_STATEMENT", "balancesheet": "BALANCE_SHEET"}


def statement(dataset: str, named: Column) -> Column:
    return F.when(token(named).isNull(), STATEMENTS.get(dataset, UNKNOWN)).when(token(named).isin("unknown", "unsupported"), UNKNOWN).otherwise(F.trim(named))


def family(report_type: Column, named: Column | None = None) -> Column:
    """A family named by a column, else that of the report type."""
    typed = F.coalesce(F.concat(F.lit("report_type:"), token(report_type)), F.lit(DEFAULT))
    if named is None:
        return typed
    t = token(named)
    said = F.when(t.isin("unknown", "unsupported"), UNKNOWN).when(t.startswith("report type:"), F.concat(F.lit("report_type:"), F.substring(t, 13, 1000))).otherwise(raw(named))
    return F.when(t.isNotNull(), said).otherwise(typed)


def first_problem(**parts: Column) -> Column:
    """The first part that isn't known, by the order given."""
    return F.coalesce(*[F.when(c.isNull() | (c == UNKNOWN), f"unknown_{n}") for n, c in parts.items()])
