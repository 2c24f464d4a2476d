"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: stage labels and their codes
STAGE_CODES = {"wake": 0, "w": 0, "n1": 1, "n2": 2, "n3": 3, "n4": 3, "rem": 4, "r": 4, "art": -1, "artefact": -1, "uns": -2, "unscored": -2}
STAGE_GROUPS = {"N1": (1,), "N2": (2,), "N3": (3,), "NREM": (1, 2, 3)}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_nan(c: Column | str) -> Column:
    """True for a numeric NaN; false for null and for what isn't numeric."""
    return F.coalesce(F.isnan(col(c).try_cast("double")), F.lit(False))


def finite(c: Column | str) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def clean_id(c: Column | str) -> Column:
    """Trimmed text without a trailing ".0"; null where blank or "nan"."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), r"^(\d+)\.0$", "$1")
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def stage_code(label: Column | str, codes: dict[str, int] | None = None, strict: bool = True) -> Column:
    """The code of a stage label: integers pass, labels are trimmed and lowered; unknown ones raise, or are null."""
    text = F.lower(F.trim(col(label).cast("string")))
    table = F.create_map(*(F.lit(x) for pair in (codes or STAGE_CODES).items() for x in pair))
    # a failing cast costs far more than the pattern
    code = F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text.cast("int")), F.try_element_at(table, text))
    return F.when(code.isNull() & strict, F.raise_error(F.concat(F.lit("unknown stage label: "), F.coalesce(text, F.lit("null"))))).otherwise(code).cast("int")


def first_max(*columns: str) -> Column:
    """The name of the first column that holds the largest value; NaN and null are passed over; null if all are."""
    values = F.array(*(F.when(finite(c), F.col(c)) for c in columns))
    names = F.array(*(F.lit(c) for c in columns))
    return F.when(F.array_max(values).isNotNull(), F.element_at(names, F.array_position(values, F.array_max(values)).cast("int")))


def in_band(f: Column | str, lo: float, hi: float, half_open: bool = False) -> Column:
    f = col(f)
    return (f >= lo) & ((f < hi) if half_open else (f <= hi))


def increasing(a: Column | str) -> Column:
    """Whether an array's values rise strictly."""
    a = col(a)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.forall(F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: y > x), lambda ok: ok)


def two_sided_gaussian(f: Column, amp: Column, mu: Column, left: Column, right: Column) -> Column:
    return amp * F.exp(-F.pow(f - mu, 2) / (2 * F.pow(F.when(f < mu, left).otherwise(right), 2)))
