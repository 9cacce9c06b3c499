"""Expression builders: dates, guarded arithmetic, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_date(c: Column) -> Column:
    """A date from YYYYMMDD text, an integer or float of those digits, or ISO text; anything else is null."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"^(\d+)\.0+$", "$1")
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")).when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-M-d"))


def date_text(c: Column) -> Column:
    return F.date_format(norm_date(c), "yyyyMMdd")


def finite(c: Column) -> Column:
    """A finite double, or null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_change(cur: Column, prev: Column) -> Column:
    """Relative change, where the former value is positive and the present one not negative."""
    return F.when((prev > 0) & (cur >= 0), (cur - prev) / prev)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def loose_bool(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "t"), True).when(t.isNotNull() & (t != ""), False)


def first_of(*names: str) -> tuple[Column, Column]:
    """The first value of a row that isn't null, and the name of its column."""
    source = F.lit(None).cast("string")
    for n in reversed(names):
        source = F.when(F.col(n).isNotNull(), F.lit(n)).otherwise(source)
    return F.coalesce(*[F.col(n) for n in names]), source


def bounded(v: Column, scale: float) -> Column:
    return F.lit(50.0) + F.lit(50.0) * F.tanh(v * scale)


def mean_known(*cols: Column) -> Column:
    """The mean of what is known; null if nothing is."""
    known = F.filter(F.array(*cols), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def positive_penalty(x: Column, t: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)) / t, F.lit(1.0)))


def spike_penalty(x: Column, t: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x - 1, F.lit(0.0)) / max(t - 1, 1e-4), F.lit(1.0)))


def sign_transition(prev: Column, cur: Column) -> Column:
    """How the sign changed; NONE if it didn't."""
    was, new = F.signum(prev), F.signum(cur)
    label = F.when(was == new, "NONE").when(new == 0, "TO_ZERO").otherwise(F.concat(_side(was), F.lit("_TO_"), _side(new)))
    return F.when(prev.isNull() | cur.isNull(), "UNKNOWN").otherwise(label)


def _side(sign: Column) -> Column:
    return F.when(sign > 0, "POSITIVE").when(sign < 0, "NEGATIVE").otherwise("ZERO")


def growth(cur: Column, prev: Column) -> tuple[Column, Column]:
    """Guarded growth and its reason: a change of sign, a zero and a negative base are refused, in this order."""
    reason = (
        F.when(cur.isNull() | prev.isNull(), "missing_value")
        .when((prev > 0) & (cur < 0), "sign_transition")
        .when(prev == 0, "invalid_denominator")
        .when(prev < 0, "negative_denominator")
    )
    return F.when(reason.isNull(), (cur - prev) / prev), reason


def coverage_bucket(c: Column) -> Column:
    """The quarter, half, three quarters or nine tenths that a share reaches."""
    steps = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    out = F.when(c.isNull(), None)
    for low, high in zip(steps, steps[1:]):
        out = out.when((c < high) | (high == 1.0), f"[{low:.2f},{high:.2f}{']' if high == 1.0 else ')'}")
    return out


# What is taken out of logs, and what stands for it.
REDACTIONS = ((r"\b(?:proxy-)?authorization\s*[:=]\s*(?:bearer\s+)?\S+", "<redacted-authorization>"), (r"(\bhost\s*=\s*['\"]?)[^,'\")\s]+", "{1}<redacted-host>"), (r"https?://[^\s'\"<>\]\[)]+", "<redacted-url>"))


def redact(c: Column, secret: Column | str | None = None) -> Column:
    """A caller's secret, authorization headers, hosts and addresses as placeholders, in this order."""
    if secret is not None:
        s = F.lit(secret) if isinstance(secret, str) else secret
        c = F.when(F.length(s) > 0, F.replace(c, s, F.lit("<redacted>"))).otherwise(c)
    for pattern, by in REDACTIONS:
        c = F.regexp_replace(c, "(?i)" + pattern, by.replace("{1}", "$1"))
    return c


def version_id(dataset: str, *cols: str) -> Column:
    """A stable identity of a row's values."""
    return F.concat(F.lit(dataset + ":"), F.substring(F.sha2(F.to_json(F.struct(*sorted(cols))), 256), 1, 20))


def period_number(year: Column, quarter: Column) -> Column:
    """Quarters as consecutive integers, for tests of continuity; null for a quarter that isn't one."""
    return F.when(quarter.between(1, 4), year * 4 + quarter - 1)


def fiscal_period(c: Column) -> tuple[Column, Column]:
    """The end of the quarter meant by YYYYQn, YYYYH1, YYYYFY or a quarter-end date, and its number year * 4 + quarter - 1; else null."""
    text = F.upper(F.trim(c.cast("string")))
    quarter = F.when(text.rlike(r"^\d{4}Q[1-4]$"), F.substring(text, 6, 1).try_cast("int")).when(text.rlike(r"^\d{4}H1$"), 2).when(text.rlike(r"^\d{4}(FY|H2)$"), 4)
    named = F.last_day(F.make_date(F.substring(text, 1, 4).try_cast("int"), quarter * 3, F.lit(1)))
    dated = norm_date(c)
    end = F.coalesce(named, F.when(F.date_format(dated, "MM-dd").isin("03-31", "06-30", "09-30", "12-31"), dated))
    return end, period_number(F.year(end), F.quarter(end))


def first_available(*candidates: tuple[str, Column]) -> tuple[Column, Column]:
    """The first candidate that parses as a date, and its name."""
    dates = [(n, norm_date(c)) for n, c in candidates]
    source = F.lit(None).cast("string")
    for n, d in reversed(dates):
        source = F.when(d.isNotNull(), n).otherwise(source)
    return F.coalesce(*[d for _, d in dates]), source


def evidence_class(value: Column, reason: Column) -> Column:
    """valid, missing, unsupported or invalid, from a value and the reason given for its absence."""
    return F.when(value.isNotNull() & reason.isNull(), "valid").when(reason.isNull() | reason.startswith("missing"), "missing").when(reason.startswith("unsupported"), "unsupported").otherwise("invalid")
