"""Notes that arrive as a stream: an extension, since batch ingest is the model.

Each micro-batch is merged into a notes table by key; the table is written as a new version
beside the old one and the pointer moves last, so a batch that is retried gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class NotesTable:
    """A table of notes kept as numbered versions; the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        names = [s.getPath() for s in system.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Version epoch + 1 is the newest version before it with the batch merged in; a repeat writes it again.

        Of a note the row that arrived last counts, so a late row never replaces a newer one; of equal times the batch's does.
        Versions before the one read here go: no repeat reads them.
        """
        before = [v for v in self._versions() if v <= epoch]
        rows = batch.withColumn("_new", F.lit(1))
        if before:
            rows = self.spark.read.parquet(f"{self.path}/v{before[-1]}").withColumn("_new", F.lit(0)).unionByName(rows)
        newest = rows.groupBy("memory_id").agg(F.max_by(F.struct(*batch.columns), F.struct("arrived", "_new")).alias("row")).select("row.*")
        newest.write.mode("overwrite").parquet(f"{self.path}/v{epoch + 1}")
        for version in before[:-1]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{version}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def start(notes: DataFrame, table: NotesTable, checkpoint: str) -> StreamingQuery:
    """Merge a stream of notes (memory_id, arrived, ...) into the table until all available input is read."""
    return notes.writeStream.foreachBatch(lambda batch, epoch: table.merge(batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, minutes: int = 10, late: str = "30 minutes") -> DataFrame:
    """Events of each type in tumbling windows of event time, with late rows up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
