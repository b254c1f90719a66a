"""Number rendering that agrees with C-style formatting of IEEE doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_text(value: Column, decimals: int) -> Column:
    """``%.<decimals>f`` of a double, rounded half-even on its exact binary value.

    ``format_string`` rounds the shortest decimal form half-up, which differs on values such as
    0.125. Here the fraction is scaled and the rounding error of that product is recovered exactly
    (splitting the factor in two 26-bit halves), so near-ties fall on the right side.
    """
    if not 1 <= decimals <= 8:
        raise ValueError("decimals must be between 1 and 8")
    scale = F.lit(float(10**decimals))
    x = F.abs(value)
    whole = F.floor(x)
    part = x - whole
    carrier = part * F.lit(134217729.0)
    high = carrier - (carrier - part)
    scaled = part * scale
    error = (high * scale - scaled) + (part - high) * scale
    down = F.floor(scaled)
    rest = scaled - down
    tie_up = (error > 0) | ((error == 0) & (down % 2 == 1))
    up = (rest > F.lit(0.5)) | ((rest == F.lit(0.5)) & tie_up)
    units = down + F.when(up, F.lit(1)).otherwise(F.lit(0))
    carry = units == 10**decimals
    digits = F.concat(
        F.when(carry, whole + 1).otherwise(whole).cast("string"),
        F.lit("."),
        F.lpad(F.when(carry, F.lit(0)).otherwise(units).cast("string"), decimals, "0"),
    )
    # outside BIGINT there is no fraction left to round
    text = F.when(x >= F.lit(2.0**63), F.format_string(f"%.{decimals}f", x)).otherwise(digits)
    # Spark compares -0.0 and 0.0 as equal, but prints the sign, as C does
    negative = value.cast("string").startswith("-")
    return F.when(negative, F.concat(F.lit("-"), text)).otherwise(text)


def float_text(value: Column) -> Column:
    """Shortest decimal form of a double, with an exponent only below 1e-4 and from 1e16 on.

    Spark prints an exponent outside 1e-3..1e7 already.
    """
    java = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(value.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), "\\.0$", "")
    power = F.substring_index(java, "E", -1).try_cast("int")
    exponent = F.concat(
        mantissa,
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(power).cast("string"),
    )
    return (
        F.when(~F.contains(java, F.lit("E")), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )
