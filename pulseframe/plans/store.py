"""Parquet tables: raw events, import audit, mergeable day totals, overview and pairs.

Every import lives in a folder of its own named by its id, and is written with ``overwrite``: doing
the same import again after a lost driver replaces the half-done one and counts nothing twice. The
audit row comes last.

Overview and pairs are written to a new folder each time, and readers find the current folders in one small file. A refresh writes both and
then replaces that file, so readers see the old pair or the new one, also if a refresh is stopped halfway.

``compact`` merges the folders of many small imports into a few clustered files, a generation, with the import id as a column. One small file
again names the generations, the import folders that are merged already (hidden, until they are deleted) and the imports done again since
(their rows in generations do not count), so that every import counts once at any moment.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe import schema
from pulseframe.files import delete_folder, delete_folders, read_small_file, replace_small_file
from pulseframe.operators.correlation import at_lag, correlation_pairs
from pulseframe.operators.daily import daily_partials, finish_partials, merge_partials
from pulseframe.operators.overview import overview_from_wide
from pulseframe.operators.ranking import latest_user, pair_order, users
from pulseframe.schema import USER
from pulseframe.session import scratch
from pulseframe.sources.loader import parse_files, sample_files

BY_IMPORT: dict[str, T.StructType] = {
    "raw_events": schema.RAW_EVENTS,
    "daily_partials": schema.DAILY_PARTIALS,
    "import_runs": schema.IMPORT_RUNS,
}
DERIVED: dict[str, T.StructType] = {
    "overview_daily": schema.OVERVIEW_DAILY,
    "correlation_pairs": schema.CORRELATION_PAIRS,
}


class NoUsableEvents(ValueError):
    """An import from which no event could be taken."""


class EventStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        for table, kind in BY_IMPORT.items():
            folders = [name for name in ("import_id", "rejected") if name in kind.names]
            spark.createDataFrame([], kind).write.mode("ignore").partitionBy(*folders).parquet(self._path(table))

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str) -> DataFrame:
        if table in BY_IMPORT:
            state = self._merged_state()
            folders = self._folders(table, state)
            return folders.unionByName(self._generations(table, state)) if state["generations"] else folders
        folder = self._current().get(table)
        return self.spark.read.schema(DERIVED[table]).parquet(folder) if folder else self.spark.createDataFrame([], DERIVED[table])

    def _current(self) -> dict[str, str]:
        """Folders of the derived tables, as the pointer names them."""
        versions = read_small_file(self.spark, self._path("derived/current.json"))
        return {table: f"{self._path('derived')}/{version}/{table}" for table, version in json.loads(versions or "{}").items()}

    def _merged_state(self) -> dict[str, list[str]]:
        state = read_small_file(self.spark, self._path("merged/current.json"))
        return json.loads(state) if state else {"generations": [], "hidden": [], "again": []}

    def _switch_merged(self, state: dict[str, list[str]]) -> None:
        replace_small_file(self.spark, self._path("merged/current.json"), json.dumps(state))

    def _folders(self, table: str, state: dict[str, list[str]]) -> DataFrame:
        """Rows of the imports that have folders of their own; hidden folders are not read."""
        rows = self.spark.read.schema(BY_IMPORT[table]).parquet(self._path(table))
        return rows.where(~F.col("import_id").isin(state["hidden"])) if state["hidden"] else rows

    def _generations(self, table: str, state: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self._path('merged')}/{generation}/{table}" for generation in state["generations"]]
        kind = BY_IMPORT[table]
        tables = [self.spark.read.schema(kind).parquet(path) for path in paths] or [self.spark.createDataFrame([], kind)]
        rows = reduce(DataFrame.unionByName, tables)
        return rows.where(~F.col("import_id").isin(state["again"])) if state["again"] else rows

    def _write_import(self, frame: DataFrame, table: str, import_id: str, *folders: str) -> str:
        """Write one import's folder. A bloom filter lets a user filter skip row groups."""
        path = f"{self._path(table)}/import_id={import_id}"
        writer = frame.write.mode("overwrite").partitionBy(*folders)
        if USER in frame.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{USER}", "true")
        writer.parquet(path)
        return path

    # ---- imports ---------------------------------------------------------------------------

    def append_events(self, events: DataFrame, source: str, file_count: int, import_id: str | None = None, skip_known: bool = False) -> dict:
        """Add events under a fresh import id and return the audit row; no usable event is an error.

        Rows with a ``reject_reason`` go to a folder of their own in the same write, so the input is
        parsed once. Counts and day totals are taken from the written files. With ``skip_known``, events
        that an earlier import or the same one holds already are left out; if none is new, nothing is
        written and the audit row counts 0.
        """
        merged = import_id is not None and self._hide_if_merged(import_id)
        import_id = import_id or str(uuid.uuid4())
        if skip_known:
            given = self._staged(events)
            events = self._unknown(given, import_id)
            if events.isEmpty() and not given.isEmpty():
                return {"import_id": import_id, "source": source, "file_count": file_count, "record_count": 0, "user_count": 0, "created_at": None}
        reason = F.col("reject_reason") if "reject_reason" in events.columns else F.lit(None).cast("string").alias("reject_reason")
        stamped = events.select(
            *schema.EVENT_COLUMNS, reason, F.current_timestamp().alias("ingested_at"), reason.isNotNull().alias("rejected")
        )
        path = self._write_import(
            stamped.sortWithinPartitions("rejected", USER, "timestamp"), "raw_events", import_id, "rejected"
        )
        stored = T.StructType([field for field in schema.RAW_EVENTS.fields if field.name != "import_id"])
        usable = self.spark.read.schema(stored).parquet(path).where(~F.col("rejected"))
        audit = usable.agg(
            F.lit(source).alias("source"),
            F.lit(file_count).cast("int").alias("file_count"),
            F.count(F.lit(1)).alias("record_count"),
            F.countDistinct(USER).alias("user_count"),
            F.current_timestamp().alias("created_at"),
        )
        row = audit.first()
        if not row.record_count:
            raise NoUsableEvents("the import holds no usable events")
        self._write_import(daily_partials(usable), "daily_partials", import_id)
        self._write_import(self.spark.createDataFrame([row], audit.schema), "import_runs", import_id)
        if merged:
            state = self._merged_state()
            hidden = [i for i in state["hidden"] if i != import_id]
            self._switch_merged({**state, "hidden": hidden, "again": sorted({*state["again"], import_id})})
        return {"import_id": import_id, **row.asDict()}

    def _hide_if_merged(self, import_id: str) -> bool:
        """Whether a generation holds the rows of an import; they count until the import done again is complete, its folder does not."""
        state = self._merged_state()
        if not state["generations"] or self._generations("import_runs", state).where(F.col("import_id") == import_id).isEmpty():
            return False
        self._switch_merged({**state, "hidden": sorted({*state["hidden"], import_id})})
        return True

    def compact(self, most_generations: int = 8) -> int:
        """Merge the import folders into one generation of clustered files, and all generations once there are more than ``most_generations``;
        returns the number of folders merged. Rows, import ids, audit rows and set-aside rows stay as they are.

        Files are of the advised partition size, by user and time, so that there are as many as the bytes need, whatever the number of imports.
        A run stopped anywhere changes nothing for readers and can be run again: a generation counts from the switch on, which also hides the
        merged folders; they and replaced generations stay for those who read them until the next run. New imports may run meanwhile;
        repeating a merged import or a second ``compact`` may not. Imports without an audit row are not complete and stay as they are.
        The ids of imports not merged yet come to the driver.
        """
        state = self._merged_state()
        self._drop_replaced(state)
        state = {**state, "hidden": []}
        done = self._folders("import_runs", state).select("import_id").distinct()
        ids = sorted(row.import_id for row in done.collect())
        everything = len(state["generations"]) + bool(ids) > most_generations or bool(state["again"])
        if not ids and not everything:
            self._switch_merged(state)
            return 0
        generation = uuid.uuid4().hex
        for table, kind in BY_IMPORT.items():
            rows = self._folders(table, state).where(F.col("import_id").isin(ids))
            if everything:
                rows = rows.unionByName(self._generations(table, state))
            by_user = USER in kind.names
            folders = [name for name in ("rejected",) if name in kind.names]
            order = [name for name in ("rejected", USER, "timestamp", "day") if name in kind.names]
            rows = rows.hint("rebalance", F.col(USER)) if by_user else rows.hint("rebalance")
            writer = (rows.sortWithinPartitions(*order) if order else rows).write.partitionBy(*folders)
            if by_user:
                writer = writer.option(f"parquet.bloom.filter.enabled#{USER}", "true")
            writer.parquet(f"{self._path('merged')}/{generation}/{table}")
        before, kept = set(state["generations"]), [] if everything else state["generations"]
        self._switch_merged({"generations": [*kept, generation], "hidden": ids, "again": [] if everything else state["again"]})
        delete_folders(self.spark, self._path("merged"), keep={*before, generation})
        return len(ids)

    def _drop_replaced(self, state: dict[str, list[str]]) -> None:
        """Delete what nothing reads: hidden import folders, generations that are not current."""
        for table in BY_IMPORT:
            for import_id in state["hidden"]:
                delete_folder(self.spark, f"{self._path(table)}/import_id={import_id}")
        if state["generations"]:
            delete_folders(self.spark, self._path("merged"), keep=set(state["generations"]))

    def _staged(self, frame: DataFrame) -> DataFrame:
        path = scratch(self.spark, "delivery")
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _unknown(self, events: DataFrame, import_id: str) -> DataFrame:
        """Events, each once, that no other import holds. Events are compared by two hashes of all their columns; of the earlier ones only
        those in the delivery's span of time are read, which row groups are sorted by."""
        mark = [F.xxhash64(F.lit(seed), *schema.EVENT_COLUMNS).alias(f"mark_{seed}") for seed in (1, 2)]
        names = [f"mark_{seed}" for seed in (1, 2)]
        span = events.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
        known = self.raw_events().where(F.col("import_id") != import_id).where(F.col("timestamp").between(F.lit(span.first), F.lit(span.last)))
        return events.select("*", *mark).dropDuplicates(names).join(known.select(*mark), names, "left_anti").drop(*names)

    def import_files(self, paths: list[str], source: str, import_id: str | None = None, strict: bool = True, skip_known: bool = False) -> dict:
        """Parse files of one source, append the usable rows and set the others aside."""
        return self.append_events(parse_files(self.spark, paths, source, strict), source, len(paths), import_id, skip_known)

    def bootstrap_sample(self, folder: str) -> dict | None:
        """Load the tracker sample files into an empty store; otherwise do nothing."""
        if self.has_events():
            return None
        paths = sample_files(self.spark, folder)
        if not paths:
            return None
        audit = self.import_files(paths, "fitbit")
        self.refresh()
        return audit

    # ---- derived tables --------------------------------------------------------------------

    def refresh(self, rebuild: bool = False) -> None:
        """Replace overview and pairs together. ``rebuild`` goes back to the raw events; the day totals of all
        imports give the same result from far fewer bytes."""
        totals = daily_partials(self.raw_events()) if rebuild else merge_partials(self.day_totals())
        version = uuid.uuid4().hex
        overview = self._write_derived(overview_from_wide(finish_partials(totals)), "overview_daily", version)
        self._write_derived(correlation_pairs(overview), "correlation_pairs", version)
        self._switch(version, *DERIVED)

    def _write_derived(self, frame: DataFrame, table: str, version: str) -> DataFrame:
        """Write one version of a table, which nothing points to yet, and read it back."""
        kind, path = DERIVED[table], f"{self._path('derived')}/{version}/{table}"
        stamped = frame.withColumn("updated_at", F.current_timestamp()).select(*kind.fieldNames())
        stamped.write.option(f"parquet.bloom.filter.enabled#{USER}", "true").parquet(path)
        return self.spark.read.schema(kind).parquet(path)

    def _switch(self, version: str, *tables: str) -> None:
        """Make a version of these tables current. The one before stays for those who read it; older ones go."""
        pointer = self._path("derived/current.json")
        before = json.loads(read_small_file(self.spark, pointer) or "{}")
        after = {**before, **dict.fromkeys(tables, version)}
        replace_small_file(self.spark, pointer, json.dumps(after))
        delete_folders(self.spark, self._path("derived"), keep={*before.values(), *after.values()})

    def replace_overview(self, overview: DataFrame) -> None:
        version = uuid.uuid4().hex
        self._write_derived(overview, "overview_daily", version)
        self._switch(version, "overview_daily")

    def replace_pairs(self, pairs: DataFrame) -> None:
        version = uuid.uuid4().hex
        self._write_derived(pairs, "correlation_pairs", version)
        self._switch(version, "correlation_pairs")

    # ---- scans -----------------------------------------------------------------------------

    def raw_events(self, user: str | None = None) -> DataFrame:
        events = self._read("raw_events").where(~F.col("rejected")).drop("rejected", "reject_reason")
        return events if user is None else events.where(F.col(USER) == user)

    def import_runs(self) -> DataFrame:
        return self._read("import_runs")

    def import_users(self) -> DataFrame:
        """The users of each import, in order; rows rather than one list, as an import may hold any number."""
        return self.day_totals().select("import_id", USER).distinct().orderBy("import_id", USER)

    def quarantine(self) -> DataFrame:
        """Rows set aside, with the field that made them unusable."""
        return self._read("raw_events").where("rejected").drop("rejected")

    def overview(self, user: str | None = None) -> DataFrame:
        """All overview rows, or those of one user in day order."""
        table = self._read("overview_daily")
        return table if user is None else table.where(F.col(USER) == user).orderBy("day")

    def pairs(self, user: str | None = None, lag_days: int | None = None) -> DataFrame:
        """All pairs, or those of one user, strongest first."""
        table = at_lag(self._read("correlation_pairs"), lag_days)
        return table if user is None else table.where(F.col(USER) == user).orderBy(*pair_order())

    def day_totals(self) -> DataFrame:
        """Mergeable totals, one row per import, user and day: every event is behind one of them."""
        return self._read("daily_partials")

    def has_events(self) -> bool:
        return not self.day_totals().isEmpty()

    def users(self) -> DataFrame:
        return users(self.day_totals())

    def latest_user(self) -> DataFrame:
        return latest_user(self.day_totals(), "last_event")

    def latest_user_overview(self) -> DataFrame:
        newest = F.broadcast(self.latest_user())
        return self._read("overview_daily").join(newest, USER, "left_semi").orderBy("day")


def load_sample_overview(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """Import a folder of tracker CSV files and return the newest user's overview."""
    store = EventStore(spark, root)
    store.import_files(sample_files(spark, folder), "fitbit")
    store.refresh()
    return store.latest_user_overview()
