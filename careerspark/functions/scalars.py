"""Small column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- numbers ---------------------------------------------------------------

def round_half_up(c: str | Column, digits: int = 0) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: one arithmetic rule that other SQL engines repeat bit for bit."""
    scale = float(10 ** digits)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    """Banker's rounding, for callers that want ties to go to the even digit."""
    return F.bround(as_col(c), digits)


def thousandths(c: str | Column) -> Column:
    """A rate as whole thousandths, so that bands compare integers and leave no gap between .399 and .400."""
    return F.floor(as_col(c) * F.lit(1000.0) + F.lit(0.5)).cast("long")


def ratio(num: str | Column, den: str | Column) -> Column:
    """Double division; NULL when the denominator is 0."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def mirrored(n: str | Column, flag: Column) -> Column:
    """Counts negated on one side of a population pyramid."""
    return F.when(flag, -as_col(n)).otherwise(as_col(n))


# ---- text ------------------------------------------------------------------

def prefix(c: str | Column, n: int) -> Column:
    return F.substring(as_col(c), 1, n)


def title_case(c: str | Column) -> Column:
    return F.initcap(as_col(c))


def full_name(*parts: str | Column) -> Column:
    """Name parts joined by a blank; a missing part is left out, not written as text."""
    return F.concat_ws(" ", *[as_col(p) for p in parts])


def replace_first(c: str | Column, text: str, replacement: str) -> Column:
    """Replace only the first occurrence of a literal text."""
    at = F.instr(as_col(c), text)
    return F.when(
        at > 0,
        F.concat(
            F.substring(as_col(c), F.lit(1), at - 1),
            F.lit(replacement),
            F.substring(as_col(c), at + len(text), F.length(as_col(c))),
        ),
    ).otherwise(as_col(c))


def percent_label(share: str | Column, above: float | None = None) -> Column:
    """``0.4567`` -> ``46%``; NULL unless the share is above the floor (labels too small to draw)."""
    share = as_col(share)
    text = F.concat(F.floor(share * 100.0 + 0.5).cast("string"), F.lit("%"))
    return text if above is None else F.when(share > above, text)


def trimmed_number(c: str | Column, digits: int = 3) -> Column:
    """``0.35`` -> ``.350``, ``-0.012`` -> ``-.012``."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", round_half_up(c, digits)), r"^(-?)0\.", "$1.")
    return F.when(as_col(c).isNotNull(), text)


# ---- dates -----------------------------------------------------------------

def parse_date(c: str | Column, fmt: str) -> Column:
    """Text to date; values that do not parse become NULL."""
    return F.try_to_date(as_col(c), fmt)


def year_date(c: str | Column) -> Column:
    """1 January of a year."""
    return F.make_date(as_col(c).cast("int"), F.lit(1), F.lit(1))


def weeks_between(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(as_col(later), as_col(earlier)) / F.lit(7.0)


def years_from_weeks(weeks: str | Column) -> Column:
    """52 weeks count as one year, on purpose."""
    return as_col(weeks) / F.lit(52.0)


def date_lit(text: str) -> Column:
    return F.lit(text).cast("date")


# ---- conditions ------------------------------------------------------------

def if_else(cond: Column, yes, no) -> Column:
    """Two branches; a NULL condition gives NULL instead of the second branch."""
    return F.when(cond, yes).when(~cond, no)


def not_in(c: str | Column, values: Iterable) -> Column:
    """Exclusion that keeps NULLs."""
    c = as_col(c)
    return c.isNull() | ~c.isin(list(values))


# ---- aggregates under a null policy ----------------------------------------

def _policy(c: Column, value: Column, null_policy: str) -> Column:
    if null_policy == "skip":
        return value
    if null_policy == "propagate":
        return F.when(F.count(c) == F.count(F.lit(1)), value)
    raise ValueError(f"null_policy must be 'skip' or 'propagate', not {null_policy!r}")


def mean_of(c: str | Column, null_policy: str = "skip") -> Column:
    return _policy(as_col(c), F.avg(as_col(c)), null_policy)


def min_of(c: str | Column, null_policy: str = "skip") -> Column:
    return _policy(as_col(c), F.min(as_col(c)), null_policy)


def max_of(c: str | Column, null_policy: str = "skip") -> Column:
    return _policy(as_col(c), F.max(as_col(c)), null_policy)
