"""Values as a report shows them, and texts read as numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as text: digits with or without a point and an exponent, or a word for what isn't finite. Stricter than a
#: cast, which also takes the suffixes of other languages ("1d", "2f").
NUMBER = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)\s*$"


def finite(number: Column) -> Column:
    """Whether a double is neither NaN nor infinite; null for null."""
    return ~F.isnan(number) & (F.abs(number) != float("inf"))


def formatted(number: Column, decimals: int = 6) -> Column:
    """At most so many decimals (one at least), no zeros at the end, no minus before zero; ``unknown`` for null, NaN and infinities."""
    x = number.cast("double")
    text = F.rtrim(F.rtrim(F.format_string(f"%.{decimals}f", F.round(x, decimals)), F.lit("0")), F.lit("."))
    return F.when(x.isNotNull() & finite(x), F.when(text == "-0", "0").otherwise(text)).otherwise("unknown")


def as_number(value: Column) -> Column:
    """A double of any column, null where its text is no number."""
    return F.when(value.cast("string").rlike(NUMBER), value.try_cast("double"))


def as_time(value: Column) -> Column:
    """A time of a text, date or time, in UTC where the session is; null where it is none."""
    return value.try_cast("timestamp")
