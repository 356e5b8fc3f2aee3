"""Overview and pairs kept up to date by what a delivery changes, not by recomputing all users and all history.

Users are dealt to parts by hash. The overview lies in a folder per part and month; the state, one row per user, in a folder per part. The
state holds what is needed to go on after the user's last day: the last 29 rows, which the 30-row windows reach back to and whose last row
pairs with the next one at lag 1, and the moments of each pair of metrics (count, means, sums of squares and of products about the means).

``refresh`` takes the imports not folded in yet and looks at the users they name:

- *Going on*: all changed days come after the user's last day. Rolling scores are computed from the 29 rows and the new ones; moments of the new
  samples are merged with the stored ones (Chan's formula). No older overview row is read.
- *Late*: a changed day is not after the last one. The user's days are merged anew from the day totals of all imports, rows are scored
  from the first changed one to 29 rows after the last changed one, and the moments are taken anew.

Only folders of parts (and months) with changed rows are rewritten, by dynamic partition overwrite; rows of other users in them are carried
over. A refresh that was stopped halfway is repeated by the next one: imports count as folded in only after all folders are written, a part
whose state is already written finds its users late, and late users are computed from the day totals alone. So a repeat gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe import schema
from pulseframe.functions.numbers import real
from pulseframe.functions.wellbeing import health_score
from pulseframe.operators.correlation import MIN_SAMPLES, PAIRS, at_lag, pair_names, pair_samples
from pulseframe.operators.daily import finish_partials, merge_partials
from pulseframe.operators.overview import overview_from_wide
from pulseframe.operators.rolling import WINDOW_ROWS
from pulseframe.plans.store import EventStore
from pulseframe.schema import CORRELATED_METRICS, OVERVIEW_COLUMNS, PAIR_COLUMNS, USER, WIDE_METRICS
from pulseframe.session import scratch

#: Rows before a row that its windows reach back to.
REACH = WINDOW_ROWS - 1

_PART, _MONTH = T.StructField("part", T.IntegerType()), T.StructField("month", T.StringType())
_MOMENTS = T.StructType([T.StructField("pair", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("mean_x", "mean_y", "xx", "yy", "xy")]])
_TAIL = T.StructType([T.StructField("day", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in WIDE_METRICS]])
OVERVIEW = T.StructType([*schema.OVERVIEW_DAILY.fields, _PART, _MONTH])
STATE = T.StructType([T.StructField(USER, T.StringType()), T.StructField("last_day", T.DateType()), T.StructField("tail", T.ArrayType(_TAIL)), T.StructField("moments", T.ArrayType(_MOMENTS)), _PART])
FOLDED = T.StructType([T.StructField("import_id", T.StringType())])
_TABLES = {"overview": (OVERVIEW, ("part", "month")), "state": (STATE, ("part",)), "folded": (FOLDED, ())}


def moments(samples: DataFrame) -> DataFrame:
    """One row (user, moments) per user of (x, y) samples, the moments by pair. Rows of one user share a partition here, so there is no further
    exchange. The mean of a constant is the constant itself, so that merging keeps its square sum 0."""

    def mean(c: str) -> Column:
        return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c))

    n = F.count(F.lit(1))
    found = samples.groupBy(USER, "pair").agg(
        n.alias("n"), mean("x").alias("mean_x"), mean("y").alias("mean_y"),
        (F.var_pop("x") * n).alias("xx"), (F.var_pop("y") * n).alias("yy"), (F.covar_pop("x", "y") * n).alias("xy"),
    )
    return found.groupBy(USER).agg(F.sort_array(F.collect_list(F.struct(*_MOMENTS.fieldNames()))).alias("moments"))  # 42 at most


def merged_moments(old: Column, new: Column) -> Column:
    """Moments by pair of two sets of samples of a user, or of the one that is not null."""

    def by_pair(side: Column) -> Column:
        return F.map_from_entries(F.transform(side, lambda m: F.struct(m["pair"], m)))

    def merged(pair: Column, a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        weight = a["n"].cast("double") * b["n"] / n

        def shift(c: str) -> Column:
            return b[f"mean_{c}"] - a[f"mean_{c}"]

        means = [(a[f"mean_{c}"] + shift(c) * b["n"] / n).alias(f"mean_{c}") for c in "xy"]
        sums = [(a[p + q] + b[p + q] + shift(p) * shift(q) * weight).alias(p + q) for p, q in ("xx", "yy", "xy")]
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(pair.alias("pair"), n.alias("n"), *means, *sums))

    both = F.sort_array(F.map_values(F.map_zip_with(by_pair(old), by_pair(new), merged)))
    return F.coalesce(both, old, new)


def pairs_from_moments(found: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Correlations of moments, by the rules of ``correlation_pairs``."""
    ratio = real(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))
    bounded = F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    rows = found.select(USER, "pair", bounded.alias("correlation"), F.col("n").cast("int").alias("sample_size"))
    return rows.where((F.col("sample_size") >= min_samples) & F.col("correlation").isNotNull()).select(USER, *pair_names(), "correlation", "sample_size")


class IncrementalTables:
    """The derived tables of a store, refreshed import by import. ``parts`` is fixed when the tables are first written."""

    def __init__(self, store: EventStore, parts: int = 64) -> None:
        self.store, self.spark, self.parts = store, store.spark, parts
        self.root = f"{store.root}/incremental"
        for table, (kind, folders) in _TABLES.items():
            self.spark.createDataFrame([], kind).write.mode("ignore").partitionBy(*folders).parquet(self._path(table))

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[table][0]).parquet(self._path(table))

    # ---- scans -----------------------------------------------------------------------------

    def overview(self, user: str | None = None) -> DataFrame:
        table = self._read("overview")
        if user is not None:
            table = table.where((F.col("part") == self._part(F.lit(user))) & (F.col(USER) == user)).orderBy("day")
        return table.drop("part", "month")

    def pairs(self, user: str | None = None, lag_days: int | None = None) -> DataFrame:
        state = self._read("state")
        if user is not None:
            state = state.where((F.col("part") == self._part(F.lit(user))) & (F.col(USER) == user))
        return at_lag(pairs_from_moments(_unpacked(state)), lag_days).select(*PAIR_COLUMNS)

    def _part(self, user: Column) -> Column:
        return F.pmod(F.xxhash64(user), F.lit(self.parts)).cast("int")

    # ---- refresh ---------------------------------------------------------------------------

    def pending(self) -> list[str]:
        """Imports with day totals that are not folded in: a row per import since the last refresh."""
        known = self.store.import_runs().select("import_id").distinct()
        return sorted(r.import_id for r in known.join(self._read("folded"), "import_id", "left_anti").collect())

    def refresh(self) -> list[int]:
        """Fold in all pending imports; returns the parts that were rewritten."""
        imports = self.pending()
        if not imports:
            return []
        spark, staging = self.spark, scratch(self.spark, "incremental-refresh")

        def staged(frame: DataFrame, name: str) -> DataFrame:
            frame.write.parquet(f"{staging}/{name}")
            return spark.read.schema(frame.schema).parquet(f"{staging}/{name}")

        totals = self.store.day_totals()
        fresh = merge_partials(totals.where(F.col("import_id").isin(imports)))
        fresh = staged(fresh.withColumn("part", self._part(F.col(USER))), "totals")
        parts = sorted(r.part for r in fresh.select("part").distinct().collect())  # as many as there are parts, at most
        state = self._read("state").where(F.col("part").isin(parts))
        users = fresh.groupBy(USER, "part").agg(F.min("day").alias("first"))
        last = state.select(USER, "last_day", "tail")
        users = staged(users.join(last, USER, "left").withColumn("late", F.coalesce(F.col("first") <= F.col("last_day"), F.lit(False))), "users")

        days = staged(self._days(fresh, totals, users), "days")
        folders = {"part": self._part(F.col(USER)), "month": F.date_format("day", "yyyy-MM")}
        scored = staged(self._scored(days).withColumns(folders), "scored")
        kept = state.join(users.where("late"), USER, "left_anti")
        samples = pair_samples(scored.select(USER, "day", *CORRELATED_METRICS, "fresh"), "fresh")
        going_on = kept.join(users, USER, "left_semi")
        self._write_overview(scored)
        self._write_state(kept.join(users, USER, "left_anti"), scored, going_on, moments(samples))
        spark.createDataFrame([(i,) for i in imports], FOLDED).write.mode("append").parquet(self._path("folded"))
        return parts

    def _days(self, fresh: DataFrame, totals: DataFrame, users: DataFrame) -> DataFrame:
        """Days of the changed users with the six metrics: those that windows and moments need. ``changed`` marks the days that the imports
        name, ``fresh`` those whose samples are not in the moments kept."""
        columns = (USER, "day", *WIDE_METRICS)
        going_on = finish_partials(fresh.join(users.where("NOT late"), USER, "left_semi"))
        tails = users.where("NOT late").select(USER, F.inline("tail")).select(*columns)
        # A user who goes on has no day of these imports in earlier ones; a late one is merged anew from all of them.
        late = finish_partials(merge_partials(totals.join(users.where("late"), USER, "left_semi")))
        named = fresh.select(USER, "day", F.lit(True).alias("changed"))
        late = late.join(named, [USER, "day"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
        yes, no = F.lit(True), F.lit(False)
        return (
            going_on.select(*columns, yes.alias("changed"), yes.alias("fresh"))
            .union(tails.select(*columns, no, no))
            .union(late.select(*columns, "changed", yes))
        )

    def _scored(self, days: DataFrame) -> DataFrame:
        """Overview rows of these days. ``rewritten`` marks those from a user's first changed row to 29 rows after the last changed one; the
        windows of rows before the first are not complete and not used."""
        order = Window.partitionBy(USER).orderBy("day")
        whole = Window.partitionBy(USER)
        place = days.withColumn("place", F.row_number().over(order))
        edge = F.when(F.col("changed"), F.col("place"))
        place = place.withColumns({"from": F.min(edge).over(whole), "to": F.max(edge).over(whole) + REACH})
        place = place.withColumn("rewritten", F.col("place").between(F.col("from"), F.col("to")))
        marks = ("fresh", "rewritten")
        # Only rows from 29 before the first changed one on to the last rewritten one go through the windows. Other rows of late users enter
        # the moments by their values and score alone, in which no window has a part.
        windowed = F.col("place").between(F.col("from") - REACH, F.col("to"))
        scored = overview_from_wide(place.where(windowed).select(USER, "day", *WIDE_METRICS, *marks), *marks)
        others = place.where(~windowed).select(USER, "day", *WIDE_METRICS, *marks)
        others = others.withColumn("health_score", health_score(F.col("steps"), F.col("sleep_minutes"), F.col("active_minutes")))
        return scored.unionByName(others, allowMissingColumns=True).where(F.col("day").isNotNull())

    def _write_overview(self, scored: DataFrame) -> None:
        rows = scored.where("rewritten").select(*OVERVIEW_COLUMNS, F.current_timestamp().alias("updated_at"), "part", "month")
        touched = rows.select("part", "month").distinct()
        folders = touched.collect()  # bounded by parts and months; known here, so that no other folder is listed or read
        old = self._read("overview").where(F.col("part").isin({f.part for f in folders}) & F.col("month").isin({f.month for f in folders}))
        old = old.join(F.broadcast(touched), ["part", "month"], "left_semi").join(rows.select(USER, "day"), [USER, "day"], "left_anti")
        self._overwrite(old.select(*rows.columns).union(rows), "overview")

    def _write_state(self, others: DataFrame, scored: DataFrame, going_on: DataFrame, new: DataFrame) -> None:
        newest = Window.partitionBy(USER).orderBy(F.col("day").desc())
        tail = scored.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= REACH)
        tail = tail.groupBy(USER).agg(F.max("day").alias("last_day"), F.sort_array(F.collect_list(F.struct("day", *WIDE_METRICS))).alias("tail"))
        rows = tail.join(going_on.select(USER, F.col("moments").alias("old")), USER, "left")
        # Moments are far larger than the rows that their size is estimated from, too large for a broadcast.
        rows = rows.join(new.withColumnRenamed("moments", "new").hint("merge"), USER, "left")
        rows = rows.withColumns({"moments": merged_moments(F.col("old"), F.col("new")), "part": self._part(F.col(USER))})
        self._overwrite(others.select(*STATE.fieldNames()).union(rows.select(*STATE.fieldNames())), "state")

    def _overwrite(self, frame: DataFrame, table: str) -> None:
        """Replace the folders that the frame has rows for. Rows are clustered so that each folder gets few files."""
        folders = _TABLES[table][1]
        writer = frame.repartition(*folders).sortWithinPartitions(*folders, USER).write.mode("overwrite").partitionBy(*folders)
        writer.option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{USER}", "true").parquet(self._path(table))


def _unpacked(state: DataFrame) -> DataFrame:
    return state.select(USER, F.inline("moments"))
