"""Cells: typed columns as text, normalising, and when two cells differ. All but float text is JVM-side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.options import DiffError, Options

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_EDGE = r"(?U)\A\s++|(?<!\s)\s++\z"


def number_text(value: float, digits: str) -> str:
    """Shortest digits, plain for exponents -7 to 20, else d.ddde+N; no sign on zero."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return "0"
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    mantissa, _, power = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    figures = (whole + part).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + part) - len(figures))
    figures = figures.rstrip("0")
    n = len(figures)
    if n <= point <= 21:
        return sign + figures + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    e = point - 1
    return f"{sign}{figures[0]}{'.' + figures[1:] if n > 1 else ''}e{'+' if e >= 0 else '-'}{abs(e)}"


@F.pandas_udf(T.StringType())
def _double_text(xs: pd.Series) -> pd.Series:
    return xs.map(lambda x: number_text(x, repr(float(x))), na_action=None)


@F.pandas_udf(T.StringType())
def _float_text(xs: pd.Series) -> pd.Series:
    import numpy as np

    return xs.map(lambda x: number_text(float(x), str(np.float32(x))), na_action=None)


def canonical_text(col: Column, kind: T.DataType, name: str = "") -> Column:
    """A typed column as text; nested and interval types are refused by name."""
    if isinstance(kind, T.StringType):
        return col
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        raise DiffError(f"column {name}: {kind.simpleString()} can't be compared; only flat columns can")
    if isinstance(kind, T.DoubleType):
        return F.when(col.isNotNull(), _double_text(F.coalesce(col, F.lit(0.0))))
    if isinstance(kind, T.FloatType):
        return F.when(col.isNotNull(), _float_text(F.coalesce(col, F.lit(0.0).cast("float"))))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.regexp_replace(F.date_format(col, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(whole, part, F.lit("" if isinstance(kind, T.TimestampNTZType) else "Z"))
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    return col.cast("string")


def normalise(cell: Column, opt: Options) -> Column:
    """Empty is absent; then trim, lower case, and empty is absent again, as asked."""
    out = F.nullif(cell, F.lit(""))
    if opt.trim:
        out = F.regexp_replace(out, _EDGE, "")
    if opt.ignore_case:
        out = F.lower(out)
    return F.nullif(out, F.lit("")) if opt.empty_is_null and opt.trim else out


def as_number(cell: Column) -> Column:
    """A finite number, or null."""
    bare = F.trim(F.regexp_replace(cell, _EDGE, ""))
    value = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def differs(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Distinct, unless a tolerance is set and both are numbers: then apart by more than it."""
    plain = ~a.eqNullSafe(b)
    if tolerance <= 0:
        return plain
    x, y = as_number(a), as_number(b)
    return F.when(plain & x.isNotNull() & y.isNotNull(), F.abs(x - y) > tolerance).otherwise(plain)


def packed(cells: list[Column]) -> Column:
    """Texts as one text, which sorts as they do one after the other and is small where they are short.

    \\x00 stands between them. An absent cell is nothing, an empty one \\x01; in others \\x00 is \\x01\\x01 and \\x01 is \\x01\\x02.
    """
    changed = [F.replace(F.replace(c, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01")) for c in cells]
    return F.concat_ws("\x00", *[F.when(c == "", F.lit("\x01")).otherwise(F.coalesce(x, F.lit(""))) for c, x in zip(cells, changed, strict=True)])


def unpackable(text: Column, cells: list[Column]) -> Column:
    """A packed text, and its cells beside it where they had to change in it or where splitting would mend malformed bytes."""
    plain = F.when(F.contains(text, F.lit("\x01\x01")) | F.contains(text, F.lit("\x01\x02")) | ~F.is_valid_utf8(text), F.array(*cells))
    return F.struct(text.alias("text"), plain.alias("plain"))


def unpacked(col: Column) -> Column:
    """The cells as an array; absent ones may come back empty, which ``normalise`` makes absent again."""
    return F.coalesce(col["plain"], F.split(F.replace(col["text"], F.lit("\x01"), F.lit("")), "\x00", -1))
