"""Number formatting with exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = 134217729.0  # 2**27 + 1: splits a double into two halves without loss


def fixed(c: Column, digits: int, plus: bool = False) -> Column:
    """``c`` with a fixed number of decimals, rounded on its exact binary value.

    The JVM's own formatter rounds the shortest decimal text instead, which turns 0.0355
    (just below the tie in binary) into 0.036.
    """
    scale = 10**digits
    x = F.abs(c)
    low = F.floor(x * float(scale))
    high_half = x * SPLITTER - (x * SPLITTER - x)
    low_half = x - high_half
    beyond_tie = (high_half * (2.0 * scale) - (low * 2 + 1)) + low_half * (2.0 * scale)
    units = (
        F.when(beyond_tie > 0, low + 1).when(beyond_tie < 0, low).otherwise(low + F.pmod(low, F.lit(2)))
    ).cast("bigint")
    sign = F.when(c < 0, "-").otherwise("+" if plus else "")
    whole, part = F.floor(units / F.lit(scale)), F.pmod(units, F.lit(scale))
    text = F.format_string(f"%d.%0{digits}d", whole.cast("bigint"), part) if digits else units.cast("string")
    return F.concat(sign, text)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def float_text(c: Column) -> Column:
    """Double as text the way JSON writers print it: plain between 1e-4 and 1e16, else ``1e-05``."""
    text = c.cast("string")
    plain = F.regexp_replace(c.cast("decimal(38,20)").cast("string"), r"0+\z", "")
    plain = F.regexp_replace(plain, r"\.\z", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0\z", "")
    power = F.regexp_extract(text, r"E-?([0-9]+)\z", 1)
    sign = F.when(text.contains("E-"), "e-").otherwise("e+")
    scientific = F.concat(mantissa, sign, F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    size = F.abs(c)
    return F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific)
