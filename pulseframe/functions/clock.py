"""Text and epoch values to zone-less wall-clock timestamps.

Every parser yields null on bad input, so a broken row can be set aside instead of failing the
job, and none depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the vendor date layouts, as one pattern ---------------------------------
US_TEXT = r"^(\d{1,2})/(\d{1,2})/(\d{4})( \d{1,2}:\d{2}(?::\d{2})?)?(?: [AaPp][Mm])?$"
PLAIN_LENGTH = len("2026-04-01 07:00:00")
# --------------------------------------------------------------------------------------------


def _clock_from_micros(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def _hours(count: Column) -> Column:
    return F.make_dt_interval(F.lit(0), count)


def iso_clock(text: Column) -> Column:
    """ISO date or date-time; a zone offset is dropped and the clock reading kept."""
    return F.trim(text).try_cast("timestamp_ntz")


def us_clock(text: Column) -> Column:
    """Month-first dates with an optional 12- or 24-hour time; ISO text is accepted too.

    The date is rearranged for the cast, which returns null on bad text; a date formatter per layout
    would raise an exception inside for each layout that does not match.
    """
    plain = F.trim(text)
    shown = F.regexp_replace(plain, US_TEXT, "$3-$1-$2$4").try_cast("timestamp_ntz")
    half = F.upper(F.substring(plain, -2, 2))
    return (
        F.when(half == "PM", shown + _hours(F.when(F.hour(shown) < 12, 12).otherwise(0)))
        .when(half == "AM", shown - _hours(F.when(F.hour(shown) == 12, 12).otherwise(0)))
        .otherwise(shown)
    )


def offset_clock(text: Column) -> Column:
    """``2026-04-01 07:00:00 +0200`` or the same without an offset: the clock reading."""
    return text.try_cast("timestamp_ntz")


def _instant(text: Column) -> Column:
    """Microseconds since 1970; text without an offset counts as UTC."""
    zone = F.when(F.length(text) <= PLAIN_LENGTH, " Z").otherwise("")
    return F.unix_micros(F.concat(text, zone).try_cast("timestamp"))


def clock_minutes(start: Column, end: Column) -> Column:
    """Minutes between two offset-bearing texts as instants, never below zero."""
    elapsed = (_instant(end) - _instant(start)).cast("double") / F.lit(60_000_000.0)
    return F.when(elapsed > 0.0, elapsed).when(elapsed <= 0.0, 0.0)


def epoch_nanos(text: Column) -> Column:
    """Nanoseconds since 1970 (text or number) to a UTC clock reading, to the nearest microsecond."""
    nanos = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    thousand = F.lit(1000).cast("bigint")
    shifted = nanos + F.lit(500).cast("bigint")
    return _clock_from_micros(F.call_function("div", shifted - F.pmod(shifted, thousand), thousand))
