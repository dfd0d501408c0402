"""Number-to-text Column helpers with Python and JavaScript rounding and layout."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int, ties: str = "even") -> Column:
    """Text with `digits` decimals, rounding the exact binary value.

    `ties` is "even" (Python's `:.nf`) or "up" (JavaScript's `toFixed`).
    `format_string` rounds the shortest decimal text instead (1.005 gives 1.01). Here a
    scaled value that ends in exactly .5 is moved off the tie in the direction of the
    error its multiplication made. The expression repeats `value` little, to keep the
    generated code small.
    """
    if ties not in ("even", "up"):
        raise ValueError("ties must be 'even' or 'up'")
    value = value.cast("double")
    size = F.abs(value)
    scale = F.lit(float(10**digits))
    product = size * scale
    # The single-precision part and the rest of a number both have exact products.
    high = size.cast("float").cast("double")
    error = (high * scale - product) + (size - high) * scale
    if ties == "up":
        nudge = F.when(error >= 0, 0.25).otherwise(-0.25)
    else:
        nudge = F.signum(error) * F.lit(0.25)
    off_tie = F.when(product % F.lit(1.0) == 0.5, nudge).otherwise(0.0)
    units = F.rint(product + off_tie).try_cast("bigint").cast("decimal(19,0)")
    text = (units * F.lit(Decimal(1).scaleb(-digits))).cast("string")
    large = F.format_string(f"%.{digits}f", size)
    sign = F.when(value < 0, "-")
    if ties == "even":
        # Python writes the sign of a negative zero, JavaScript does not.
        sign = sign.when((value == 0) & value.cast("string").startswith("-"), "-")
    return F.when(value.isNotNull(), F.concat(sign.otherwise(""), F.coalesce(text, large)))


def exponential(value: Column, digits: int = 2) -> Column:
    """Text like JavaScript's `toExponential(digits)`: no zero padding of the exponent."""
    text = F.format_string(f"%.{digits}e", value.cast("double"))
    return F.when(value.isNotNull(), F.regexp_replace(text, r"e([+-])0(\d)$", "e$1$2"))


def _digits(size: Column) -> Column:
    """Significant digits of a number below 1e-3, whose text is in scientific notation."""
    mantissa = F.substring_index(size.cast("string"), "E", 1)
    return F.rtrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0"))


def _sign(value: Column) -> Column:
    return F.when(value < 0, "-").otherwise("")


def _positional(value: Column, decimals: int) -> Column:
    """A number written without exponent, keeping at least one decimal."""
    text = value.cast(f"decimal(38,{decimals})").cast("string")
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def _scientific(text: Column, before: str, after: str) -> Column:
    """Java's scientific text with another exponent mark and without a ".0" mantissa."""
    short = F.replace(text, F.lit(".0" + before), F.lit(before))
    return F.replace(short, F.lit(before), F.lit(after))


def number_text(value: Column) -> Column:
    """Shortest text of a double as Python's `str` writes it; NULL stays NULL."""
    value = value.cast("double")
    size, text = F.abs(value), value.cast("string")
    padded = F.regexp_replace(text, r"E-(\d)$", "E-0$1")
    small = _scientific(padded, "E-", "e-")
    return (
        F.when((size < 1e7) & (size >= 1e-3) | (size == 0), text)
        .when((size >= 1e-4) & (size < 1e16), _positional(value, 21))
        .otherwise(F.replace(F.replace(small, F.lit(".0E"), F.lit("E")), F.lit("E"), F.lit("e+")))
    )


def js_number_text(value: Column) -> Column:
    """Shortest text of a double as JavaScript writes it; NULL stays NULL."""
    value = value.cast("double")
    size, text = F.abs(value), value.cast("string")
    zeros = F.when(size < 1e-5, "0.00000").when(size < 1e-4, "0.0000").otherwise("0.000")
    return (
        F.when((size < 1e7) & (size >= 1e-3) | (size == 0), _whole(text))
        .when(size < 1e-6, _scientific(text, "E-", "e-"))
        .when(size < 1e-3, F.concat(_sign(value), zeros, _digits(size)))
        .when(size < 1e21, _whole(_positional(value, 10)))
        .otherwise(_scientific(text, "E", "e+"))
    )


def _whole(text: Column) -> Column:
    """Text without a trailing ".0"."""
    return F.regexp_replace(text, r"\.0$", "")
