"""The fixture feed as a stream: files of batches that land in a folder are applied to the stored league as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tanteo.plans.import_job import import_fixtures
from tanteo.sources.snapshots import SnapshotStore

BATCH_SCHEMA = "batch_id bigint, payload string"


def start_feed(
    store: SnapshotStore, folder: str, checkpoint: str, run_at: str, max_rows: int | None = None, source: str = "la federación",
    files_per_trigger: int | None = None, app: str = "feed", interval: str | None = None,
) -> StreamingQuery:
    """Start the feed over JSON lines of (batch_id, payload) in ``folder``.

    A micro-batch is one run of ``import_fixtures``, numbered by the batch id that the stream's checkpoint keeps: a micro-batch that
    is repeated after a restart finds its number applied and changes nothing. Batches take effect in the order in which their files
    came, inside a micro-batch in the order of their ids, so a folder gives the same tables in any number of micro-batches if
    its files come in the order of the ids, with different file times. Without ``interval`` the stream ends when all files present are read.
    """
    reader = store.spark.readStream.schema(BATCH_SCHEMA)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def apply(batches: DataFrame, number: int) -> None:
        import_fixtures(store, number, batches, run_at, max_rows, source, app)

    writer = reader.json(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
