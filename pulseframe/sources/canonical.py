"""The common shape every source is brought to, and the split into good and set-aside rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.numbers import real
from pulseframe.schema import EVENT, EVENT_COLUMNS, USER


def computed_once(*columns: Column) -> Column:
    """The columns out of a generator, for use in a ``select`` of their own.

    Catalyst copies a projected expression into every place that refers to it, filters included, and
    parsing is too costly for that; it does not look through a generator.
    """
    return F.inline(F.array(F.struct(*columns)))


def canonical(
    frame: DataFrame,
    *,
    timestamp: Column,
    metric: Column,
    value: Column,
    unit: Column,
    source: Column,
    user: Column,
    metadata: dict[str, Column],
    broken: Column | None = None,
) -> DataFrame:
    """Select the event columns plus ``reject_reason``, the first required field that is unusable.

    ``broken`` marks rows that stand for a whole unreadable document.
    """
    fields = F.struct(*[metadata[name].alias(name) for name in sorted(metadata)])
    shaped = frame.select(
        computed_once(
            timestamp.alias("timestamp"),
            metric.alias("metric"),
            real(value).alias("value"),
            unit.alias("unit"),
            source.alias("source"),
            user.alias(USER),
            F.to_json(fields).alias("metadata_json"),
            F.coalesce(F.lit(False) if broken is None else broken, F.lit(False)).alias("broken"),
        )
    )
    reason = F.coalesce(F.when(F.col("broken"), "document"), *[F.when(F.col(name).isNull(), F.lit(name)) for name in ("timestamp", "metric", "value", USER)])
    return shaped.select(*EVENT_COLUMNS, reason.alias("reject_reason"))


def unreadable(files: DataFrame, source: str) -> DataFrame:
    """Set-aside rows that name files (column ``file``, as Spark escapes names) without a usable header."""
    name = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    empty = {field.name: F.lit(None).cast(field.dataType).alias(field.name) for field in EVENT.fields}
    empty["source"] = F.lit(source).alias("source")
    empty["metadata_json"] = F.to_json(F.struct(name.alias("file"))).alias("metadata_json")
    return files.select(*empty.values(), F.lit("header").alias("reject_reason"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).select(*EVENT_COLUMNS)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select(*EVENT_COLUMNS, "reject_reason")


def lookup(table: dict[str, str], key: Column) -> Column:
    """A small fixed mapping as a map literal; null for unknown keys."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def with_absent(frame: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """Add the listed columns as null where the input lacks them."""
    return frame.withColumns({name: F.lit(None).cast(kind) for name in columns if name not in frame.columns})
