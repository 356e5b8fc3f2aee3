"""Numbers: lenient parsing, exact rounding, printable floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: cells a CSV reader takes as "no value" ----------------------------------
BLANK_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# --------------------------------------------------------------------------------------------

NUMERIC_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def blank_to_null(text: Column) -> Column:
    return F.when(~text.isin(*BLANK_CELLS), text)


def number(text: Column) -> Column:
    """Decimal text to a double; anything else, ``nan`` included, is null."""
    return F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))


def real(value: Column) -> Column:
    """NaN to null."""
    return F.nanvl(value, F.lit(None).cast("double"))


def python_round(value: Column, digits: int) -> Column:
    """Round to ``digits`` (1 to 3) places by the exact binary value, ties to even.

    Spark's ``round`` works on the shortest decimal text, so 0.35 becomes 0.4 although the stored
    double is below the tie. Here the fraction is held as an integer multiple of 2**-53 and
    compared with the half-way point in integer arithmetic.
    """
    scale = 10**digits
    size = F.abs(value)
    whole = F.floor(size).cast("bigint")
    scaled = (size - whole.cast("double")) * F.lit(float(2**53))
    ticks = F.floor(scaled).cast("bigint")
    product = ticks * F.lit(scale).cast("bigint")
    steps = F.shiftright(product, 53)
    # Way left to the half-way point in ticks, against the part of a tick the integer dropped.
    gap = (F.lit(2**52) - (product - F.shiftleft(steps, 53))).cast("double")
    beyond = (scaled - ticks.cast("double")) * F.lit(float(scale))
    step_up = (beyond > gap) | ((beyond == gap) & (F.pmod(steps, F.lit(2).cast("bigint")) == 1))
    rounded = (whole * F.lit(scale).cast("bigint") + steps + step_up.cast("bigint")).cast("double") / F.lit(float(scale))
    exact = F.when(value < 0, -rounded).otherwise(rounded)
    return F.when(size < F.lit(1e12), exact).otherwise(value)


def float_text(value: Column) -> Column:
    """A double as plain decimal text with at least one decimal place."""
    plain = F.regexp_replace(value.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(value)
    small_or_large = (size != 0.0) & ((size < 1e-3) | (size >= 1e7)) & (size >= 1e-4) & (size < 1e16)
    return F.when(small_or_large, plain).otherwise(value.cast("string"))
