"""Hand-kept CSV: one measurement per line under flexible headers."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.clock import us_clock
from pulseframe.functions.numbers import blank_to_null, number
from pulseframe.sources.canonical import canonical, unreadable, with_absent
from pulseframe.sources.csv_files import NAMED_FILES, header_of, read_by_header

# ---- fixed values: header aliases, required columns, defaults ------------------------------
ALIASES = {"date": "timestamp", "user_id": "source_user_id"}
REQUIRED = ("timestamp", "metric", "value")
DEFAULTS = {"unit": "unit", "source": "manual", "source_user_id": "manual-user"}
# --------------------------------------------------------------------------------------------


def normalized_name(header: str) -> str:
    name = header.strip().lower()
    return ALIASES.get(name, name)


def normalize_headers(frame: DataFrame) -> DataFrame:
    """Trim, lower-case and alias the headers; of two that become equal the last one stays."""
    last = {normalized_name(header): header for header in frame.columns}
    return frame.select(*[F.col(f"`{header}`").alias(name) for name, header in last.items()])


def require_columns(columns: list[str]) -> None:
    missing = sorted(set(REQUIRED) - {normalized_name(column) for column in columns})
    if missing:
        raise ValueError(f"manual CSV lacks required columns: {', '.join(missing)}")


def read_manual(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows, and the files that lack a required column."""

    def is_header(names):
        names = F.transform(names, lambda name: F.lower(F.trim(name)))
        dated = F.array_contains(names, "timestamp") | F.array_contains(names, "date")
        return dated & F.array_contains(names, "metric") & F.array_contains(names, "value")

    return read_by_header(spark, paths, [*REQUIRED, *DEFAULTS], "metric", is_header, normalized_name)


def manual_file_events(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """A file without the required columns is an error, or is set aside where ``strict`` is off."""
    rows, headless = read_manual(spark, paths)
    events = manual_events(rows)
    if not strict:
        return events.unionByName(unreadable(headless, "manual"))
    named = headless.take(NAMED_FILES)
    if named:
        require_columns(header_of(spark, unquote(named[0].file)))
        raise ValueError(f"no header line in: {', '.join(row.file for row in named)}")
    return events


def manual_events(frame: DataFrame) -> DataFrame:
    require_columns(frame.columns)
    rows = with_absent(normalize_headers(frame), list(DEFAULTS))

    def text(name: str):
        return F.coalesce(blank_to_null(F.col(name)), F.lit(DEFAULTS[name]))

    return canonical(
        rows,
        timestamp=us_clock(F.col("timestamp")),
        metric=blank_to_null(F.col("metric")),
        value=number(F.col("value")),
        unit=text("unit"),
        source=text("source"),
        user=text("source_user_id"),
        metadata={"input": F.lit("manual_csv")},
    )
