"""Scalar expressions that Spark has no single function for, all native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Jobs that stand for a size class of establishments, and the code prefixes of the sectors.
JOBS_BY_CLASS = {
    "0 a 5 personas": 0,
    "6 a 10 personas": 0,
    "11 a 30 personas": 20,
    "31 a 50 personas": 40,
    "51 a 100 personas": 75,
    "101 a 250 personas": 175,
    "251 y más personas": 500,
}
SECTOR_PREFIXES = {
    "manufacturing": ["31", "32", "33"],
    "retail": ["46"],
    "education": ["61"],
    "health": ["62"],
    "government": ["931"],
}
#: Size classes too small to count as employers.
SMALL_CLASSES = ("0 a 5 personas", "6 a 10 personas")


#: The municipalities of the study area (fixed values).
MUNICIPALITIES = ("039", "044", "051", "070", "097", "098", "101", "120", "009", "124")


def zfill(c: Column, width: int) -> Column:
    """Left-padded with zeros, never cut."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null, unlike greatest() and least()."""
    out = c if low is None else F.when(c < low, F.lit(low)).otherwise(c)
    return out if high is None else F.when(out > high, F.lit(high)).otherwise(out)


def safe_ratio(a: Column, b: Column, least: float = 0.01, cap: float | None = None) -> Column:
    """a / b with b no less than `least` and the result no more than `cap`."""
    return clip(a / clip(b.cast("double"), low=least), high=cap)


def mapped(c: Column, values: dict, default=0) -> Column:
    """The value of a key; `default` for other keys and null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def first_prefix(c: Column, prefixes: dict[str, list[str]], other: str = "other") -> Column:
    """The first name one of whose prefixes begins the text; `other` if none does or the text is null."""
    out = F.lit(other)
    for name, codes in reversed(prefixes.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.startswith(c, F.lit(p)) for p in codes]), F.lit(name)).otherwise(out)
    return out


def number_or(c: Column, default: float = 0.0) -> Column:
    """The number a text holds, `default` where it holds none."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_corr(a: Column, b: Column, default: float | None = None) -> Column:
    """Pearson correlation over rows where both are present; `default` for constant columns (Spark's own would raise)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    r = F.when(spread > 0, F.covar_pop(x, y) / F.when(spread > 0, spread))
    return r if default is None else F.coalesce(r, F.lit(default))
