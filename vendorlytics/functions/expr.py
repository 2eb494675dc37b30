"""Column-expression helpers.  All return ``Column`` objects, so they run inside
whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as double; NULL when ``den`` is 0 or NULL (SQLite rule)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def elapsed_months(end: str | Column, start: str | Column) -> Column:
    """Whole calendar months between two dates: 12*(y2-y1) + (m2-m1)."""
    e, s = col(end), col(start)
    return (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))


def month_text(d: str | Column) -> Column:
    """Date or timestamp -> ``yyyy-MM`` text."""
    return F.date_format(col(d), "yyyy-MM")


def month_start(month: str | Column) -> Column:
    """``yyyy-MM`` text -> first day of that month (NULL stays NULL)."""
    return F.to_date(F.concat(col(month), F.lit("-01")))


def shift_minutes(ts: str | Column, minutes: int) -> Column:
    """Timestamp + fixed minutes (UTC to a fixed-offset local time)."""
    return F.timestamp_add("MINUTE", F.lit(minutes), col(ts))


def strip_chars(c: str | Column, chars: str) -> Column:
    """Remove every occurrence of each character in ``chars``."""
    return F.translate(col(c), chars, "")


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def ilike(c: str | Column, pattern: str) -> Column:
    """Case-insensitive LIKE (SQLite's LIKE ignores ASCII case)."""
    return col(c).ilike(pattern)


def first_match(cases: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """Searched CASE: first true predicate wins; no ``otherwise`` -> NULL."""
    expr = None
    for pred, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(pred, v) if expr is None else expr.when(pred, v)
    if otherwise is not None:
        expr = expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return expr


_OPS = {
    "<": lambda c, b: c < b,
    "<=": lambda c, b: c <= b,
    ">": lambda c, b: c > b,
    ">=": lambda c, b: c >= b,
}


def band(value: str | Column, bands: Sequence, default: int = 0) -> Column:
    """Score banding: ``bands`` is a sequence of ``Band(op, bound, points)``,
    evaluated in order; unmatched or NULL input -> ``default``."""
    v = col(value)
    return first_match(((_OPS[b.op](v, F.lit(b.bound)), b.points) for b in bands), F.lit(default))


def bucket(value: str | Column, bounds: Sequence[tuple[float, str]], top_label: str) -> Column:
    """Ascending threshold buckets: ``value < bound -> label``; ``>= last`` ->
    ``top_label``; NULL -> NULL."""
    v = col(value)
    cases = [(v < F.lit(b), label) for b, label in bounds]
    cases.append((v >= F.lit(bounds[-1][0]), top_label))
    return first_match(cases)


def typed_null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def sum_money(df, name: str) -> Column:
    """``exact_sum`` of column ``name`` of ``df`` (type taken from its schema)."""
    return exact_sum(name, df.schema[name].dataType)


def exact_sum(c: str | Column, dtype) -> Column:
    """``sum`` of a money column.  Decimals stay decimals from input to total
    (ten more digits than the input, 38 at most), so no value or total that the
    input type can hold is lost, with ANSI mode on or off."""
    if not isinstance(dtype, T.DecimalType):
        return F.sum(col(c))
    return F.sum(col(c)).cast(f"decimal(38,{dtype.scale})")
