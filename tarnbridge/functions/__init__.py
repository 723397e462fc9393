"""Column functions: date arithmetic as each dialect means it, and canonical values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Date parts and their abbreviations.
PARTS = {
    **dict.fromkeys(("year", "yy", "yyyy"), "YEAR"), **dict.fromkeys(("quarter", "qq", "q"), "QUARTER"), **dict.fromkeys(("month", "mm", "m"), "MONTH"), **dict.fromkeys(("week", "wk", "ww"), "WEEK"),
    **dict.fromkeys(("day", "dd", "d", "dayofyear", "dy", "y"), "DAY"), **dict.fromkeys(("hour", "hh"), "HOUR"), **dict.fromkeys(("minute", "mi", "n"), "MINUTE"), **dict.fromkeys(("second", "ss", "s"), "SECOND"),
    **dict.fromkeys(("millisecond", "ms"), "MILLISECOND"), **dict.fromkeys(("microsecond", "mcs"), "MICROSECOND"),
}
#: Microseconds in a part.
MICROS = {"HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000, "MILLISECOND": 1000, "MICROSECOND": 1}


def _epoch(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def date_diff(part: str, a: Column, b: Column) -> Column:
    """Boundaries of part crossed from a to b, as an integer."""
    p = PARTS[part.lower()]
    if p == "YEAR":
        return F.year(b) - F.year(a)
    if p == "QUARTER":
        return 4 * (F.year(b) - F.year(a)) + F.quarter(b) - F.quarter(a)
    if p == "MONTH":
        return 12 * (F.year(b) - F.year(a)) + F.month(b) - F.month(a)
    if p == "DAY":
        return F.datediff(F.to_date(b), F.to_date(a))
    if p == "WEEK":  # weeks begin on Sunday
        sunday = lambda c: F.date_sub(F.to_date(c), F.dayofweek(c) - 1)
        return F.floor(F.datediff(sunday(b), sunday(a)) / 7).cast("int")
    crossed = F.floor(_epoch(b) / MICROS[p]) - F.floor(_epoch(a) / MICROS[p])
    return crossed.cast("int" if p in ("HOUR", "MINUTE", "SECOND") else "long")


def elapsed_diff(part: str, a: Column, b: Column) -> Column:
    """Field differences for years and months; for shorter parts the elapsed time in them, rounded half up."""
    p = PARTS[part.lower()]
    if p in ("YEAR", "MONTH"):
        return date_diff(part, a, b)
    return F.round((_epoch(b) - _epoch(a)) / {"DAY": 86_400_000_000, **MICROS}[p]).cast("int" if p in ("DAY", "HOUR", "MINUTE", "SECOND") else "long")


def canonical(c: Column, kind: T.DataType) -> Column:
    """A value's text, equal for equal values of either side; null stays null.

    Numbers are written as decimals without trailing zeros; a floating number that has no exact short decimal, in the
    shortest form that reads back as the same number. Both zeros are one. Times are in ISO form, bytes are base64 with a
    mark, text is as it is; nested values are JSON.
    """
    if isinstance(kind, T.DecimalType):
        text = c.cast("string")
        return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = c.cast("double").cast("string")
        exact = text.try_cast("decimal(38,18)")
        plain = F.regexp_replace(exact.cast("string"), r"\.?0+$", "")
        return F.when(exact.cast("double") == c.cast("double"), plain).otherwise(text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("base64:"), F.base64(c))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def repair_integer(c: Column) -> Column:
    """An integer from up to 8 little-endian bytes (signed)."""
    hexed = F.hex(c)
    pairs = F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda i: F.substring(F.rpad(hexed, 16, "0"), 2 * i - 1, F.lit(2)))
    unsigned = F.conv(F.array_join(pairs, ""), 16, -10).cast("long")
    n, shift = F.octet_length(c), 64 - 8 * F.octet_length(c)
    return F.when(n == 0, None).when(n >= 8, unsigned).otherwise(F.call_function("shiftright", F.call_function("shiftleft", unsigned, shift), shift))


def str_number(x: Column, length: int = 10, decimals: int = 0, right: bool = False) -> Column:
    """STR(): the number with so many decimals, padded to length; right-aligned if asked."""
    text = F.round(x.cast(T.DecimalType(38, max(decimals, 6))), decimals).cast(T.DecimalType(38, decimals)).cast("string")
    return F.lpad(text, length, " ") if right else F.rpad(text, length, " ")
