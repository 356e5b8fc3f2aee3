"""Pick up new export files from a landing folder and bring the tables up to date."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.plans.incremental import IncrementalTables
from pulseframe.plans.store import EventStore, NoUsableEvents
from pulseframe.sources.infer import classify_files

FILE_DDL = "path string, modificationTime timestamp, length long, content binary"


def import_new_files(
    spark: SparkSession,
    landing: str,
    store: EventStore,
    checkpoint: str,
    files_per_batch: int = 1000,
    refresh: bool = True,
    tables: IncrementalTables | None = None,
    skip_known: bool = False,
) -> None:
    """Import every file not seen before, then refresh the derived tables once: those in ``tables`` by what the new files change, if given, or
    else those of the store. With ``skip_known``, events that the store holds already are left out.

    The stream carries file names only; each micro-batch reads its files with the batch readers, one
    import per vendor. The import id follows from checkpoint, batch and vendor, so a batch repeated
    after a failure replaces its own rows. Files of unknown kind are left alone; unreadable ones are
    named in the store's quarantine and do not hold up the others.
    """

    def import_batch(batch: DataFrame, batch_id: int) -> None:
        rows = classify_files(batch.select("path")).where(F.col("source").isNotNull()).collect()
        by_source: dict[str, list[str]] = {}
        for row in rows:
            by_source.setdefault(row.source, []).append(unquote(row.path))
        for source, paths in sorted(by_source.items()):
            import_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{checkpoint}/{batch_id}/{source}"))
            try:
                store.import_files(sorted(paths), source, import_id, strict=False, skip_known=skip_known)
            except NoUsableEvents:
                continue

    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_DDL)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
        .select("path")
    )
    query = (
        files.writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if refresh:
        (tables or store).refresh()
