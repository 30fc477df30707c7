"""Column expressions for cleaning, coding and display.

All are built-in Catalyst expressions, so they stay inside whole-stage codegen
and are safe under ANSI mode (``try_cast`` instead of ``cast`` on text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import NONE_VALUE, SearchSpace

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_sentinel(c: ColumnOrName, sentinel: str = NONE_VALUE) -> Column:
    """B1: '' or missing -> sentinel ("None" is a real category)."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(sentinel))


def lenient_numeric(c: ColumnOrName) -> Column:
    """B2: parse a number; bad text, blank and NaN -> null."""
    v = _c(c).cast("string").try_cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))   # one reference to v: no duplicated parse


_NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def as_number(df, c: str) -> Column:
    """Double value of ``c`` in ``df``: typed numerics directly (NaN -> null), text leniently."""
    if dict(df.dtypes).get(c, "string").startswith(_NUMERIC_TYPES):
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return lenient_numeric(c)


def code_map(c: ColumnOrName, mapping: dict[str, int]) -> Column:
    """Category -> code; unmapped -> null."""
    col = _c(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(col == F.lit(k), F.lit(v)) if out is None
               else out.when(col == F.lit(k), F.lit(v)))
    return out.otherwise(F.lit(None).cast("int")).cast("int")


def flag_default(c: ColumnOrName, yes: str = "Yes") -> Column:
    """Yes -> 1, anything else (No, blank, missing, junk) -> 0."""
    return F.when(_c(c) == F.lit(yes), F.lit(1)).otherwise(F.lit(0))


TRUTHY = ("yes", "1", "true", "1.0")


def normalize_flag(c: ColumnOrName) -> Column:
    """1 / yes / true / "1" in any case -> 'Yes', else 'No'."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return F.when(s.isin(*TRUTHY), F.lit("Yes")).otherwise(F.lit("No"))


def is_truthy(c: ColumnOrName) -> Column:
    s = F.lower(F.trim(_c(c).cast("string")))
    return F.coalesce(s.isin(*TRUTHY), F.lit(False))


def lenient_int(c: ColumnOrName, default: int = 0) -> Column:
    """int(float(x)) truncating toward zero; bad text / NaN -> default."""
    return F.coalesce(lenient_numeric(c).try_cast("int"), F.lit(default))


def fill_constant(c: ColumnOrName, value, cast: str | None = "int") -> Column:
    """Missing -> constant (then cast)."""
    out = F.coalesce(_c(c), F.lit(value))
    return out.cast(cast) if cast else out


def option_cost(option: ColumnOrName, space: SearchSpace) -> Column:
    """Slots taken by the option value: the double-cost value 2, none 0, others 1."""
    o = _c(option)
    return (F.when(o.isNull() | (o == F.lit(NONE_VALUE)) | (o == F.lit("")), F.lit(0))
             .when(o == F.lit(space.double_cost_option), F.lit(2))
             .otherwise(F.lit(1)))


def slot_cost(space: SearchSpace, types: dict | None = None) -> Column:
    """Option cost + count + number of slot flags set.

    Flags in form spelling count when exactly 'Yes'; already-typed 0/1 flags
    (pass ``types`` = dict(df.dtypes)) count when 1.
    """
    def flag(f):
        if types is not None and types.get(f, "string").startswith(_NUMERIC_TYPES):
            return F.when(F.col(f) == 1, F.lit(1)).otherwise(F.lit(0))
        return flag_default(F.col(f).cast("string"))
    parts = [option_cost(space.option_field, space),
             F.coalesce(F.col(space.count_field).cast("int"), F.lit(0))]
    parts += [flag(f) for f in space.slot_flags]
    return reduce(lambda a, b: a + b, parts).cast("int")


def range_bucket(c: ColumnOrName) -> Column:
    """Piecewise label <=3, <=6, <=9, else (sums above 12 land in the last)."""
    x = _c(c)
    return (F.when(x <= 3, F.lit("0-3")).when(x <= 6, F.lit("4-6"))
             .when(x <= 9, F.lit("7-9")).otherwise(F.lit("10-12")))


def outcome_label(positives: ColumnOrName, size: int = 4) -> Column:
    """Negatives in a batch of ``size`` -> '0k'..'4k'."""
    return F.concat((F.lit(size) - _c(positives)).cast("int").cast("string"), F.lit("k"))


def cap_value(c: ColumnOrName, cap: int = 4) -> Column:
    """min(n, cap)."""
    return F.least(_c(c), F.lit(cap))


def decision(c: ColumnOrName, threshold: float) -> Column:
    """C >= threshold."""
    return _c(c) >= F.lit(threshold)


def round_display(c: ColumnOrName, digits: int = 2, half_even: bool = False) -> Column:
    """Display rounding. ``half_even`` reproduces Python's round on exact ties."""
    return F.bround(_c(c), digits) if half_even else F.round(_c(c), digits)


def round_fast(c: ColumnOrName, digits: int) -> Column:
    """``F.round`` of a double, value for value: only large values and those near a tie take its BigDecimal."""
    x = _c(c)
    scaled = F.abs(x) * F.lit(10.0 ** digits)
    whole = F.floor(scaled + 0.5)
    plain = (scaled < 1e9) & (F.abs(scaled - whole) < 0.499999)
    return F.when(plain, F.when(x < 0, -whole).otherwise(whole) / F.lit(10.0 ** digits)).otherwise(F.round(x, digits))


def sigmoid(z: ColumnOrName) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def int_key(c: ColumnOrName) -> Column:
    """Numeric -> truncated integer text key."""
    return _c(c).try_cast("bigint").cast("string")
