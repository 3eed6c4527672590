"""Fixed-point forms that do not depend on the order of a sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int = 6) -> Column:
    """Nearest multiple of 10**-digits; the tie point lies off decimal fractions, so noise in a sum cannot flip it."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.49987)).cast("double") / F.lit(scale)


def nanos(x: Column) -> Column:
    """A price as a whole number of 10**-9, which takes off the noise that a sum has beyond."""
    return F.floor(x * F.lit(1e9) + F.lit(0.49987))


def cents_of(x: Column, n: Column) -> Column:
    """Two decimals as Python rounds a double: by its exact binary value, ties to even. ``n``: ``nanos(x)``, best a column of
    its own, as it is read more than once. From 8 * 10**9 on, and for NaN and infinities, the price itself."""
    rest = F.pmod(n, F.lit(10_000_000))
    below = (n - rest) / F.lit(1e7)
    # of a decimal tie, the double nearest to it decides; its 200th part's error is found exactly, by Dekker's splitting
    odd = below * 2 + 1
    tie = odd / F.lit(200.0)
    high = tie * F.lit(134217729.0) - (tie * F.lit(134217729.0) - tie)
    error = (high * F.lit(200.0) - odd) + (tie - high) * F.lit(200.0)
    up = F.when(rest != 5_000_000, rest > 5_000_000).otherwise((error > 0) | ((error == 0) & (below % 2 != 0)))
    return F.when(F.abs(x) < 8e9, (below + up.cast("double")) / F.lit(100.0)).otherwise(x)


def cents(x: Column) -> Column:
    return cents_of(x, nanos(x))


def _nearest(size: Column, digits: int) -> Column:
    """A double from 0 to 2**40 rounded to decimals by its exact binary value, ties to even.

    The product with the power of ten is split into the nearest double and its exact error
    (Dekker's method), so that a decimal tie which the double only comes near goes to the
    side on which the double lies.
    """
    scale = 10.0**digits
    product = size * F.lit(scale)
    high = size * F.lit(134217729.0) - (size * F.lit(134217729.0) - size)
    error = (high * F.lit(scale) - product) + (size - high) * F.lit(scale)
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return (whole + up.cast("double")) / F.lit(scale)


def printed(x: Column, digits: int) -> Column:
    """Text of a double with fixed decimals, rounded by its exact binary value and ties to even, as C and Python print it.

    From 2**40 on, where the splitting may not fit, and for NaN and infinities, the text is Spark's own.
    """
    size = F.abs(x)
    near = F.format_string(f"%.{digits}f", _nearest(size, digits))
    return F.when(size < 2.0**40, F.concat(F.when(x < 0, "-").otherwise(""), near)).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def shortest(x: Column) -> Column:
    """The shortest text that gives a double back, as Python prints it: plain from 1e-4 to below 1e16, else with an exponent of two digits or more."""
    text, size = x.cast("string"), F.abs(x)
    sign = F.when(x < 0, "-").otherwise("")
    parts = F.regexp_extract(text, r"^-?(\d+)\.(\d+)E(-?\d+)$", 1), F.regexp_extract(text, r"^-?(\d+)\.(\d+)E(-?\d+)$", 2), F.regexp_extract(text, r"E(-?\d+)$", 1)
    rest, power = F.regexp_replace(parts[1], "0+$", ""), F.when(parts[2] == "", 0).otherwise(parts[2].try_cast("int"))
    digits = F.concat(parts[0], rest)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    after = F.substr(rest, power + 1, F.lit(40))
    large = F.concat(parts[0], F.rpad(F.substr(rest, F.lit(1), F.greatest(power, F.lit(0))), F.greatest(power, F.lit(0)), F.lit("0")), F.lit("."), F.when(after == "", "0").otherwise(after))
    raised = F.concat(parts[0], F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    odd = F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf")))
    plain = F.when(~text.contains("E"), text).otherwise(F.concat(sign, F.when((size >= 1e-4) & (size < 1e16), F.when(power < 0, small).otherwise(large)).otherwise(raised)))
    return F.coalesce(odd, plain)
