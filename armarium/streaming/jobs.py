"""Incremental runs as Structured Streaming jobs. Each job drains what has arrived and stops; its progress
lives in the checkpoint, so a restart continues where the last committed batch ended."""
from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..constants import HAMMING_THRESHOLD, RETENTION_DAYS, TOP_MATCHES
from ..operators import dedup, match, merge
from ..operators.topk import top_k
from ..session import stored


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, sink: str | None = None, mode: str = "append") -> None:
    """Process everything available, then stop."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("parquet").option("path", sink)).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, keep: Column) -> None:
    """Cursor ingest: new files since the last run are filtered and appended; the cursor is the checkpoint."""
    drain(file_stream(spark, source, schema).where(keep), checkpoint, sink=sink)


def unique_events(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop replays of a key that arrive within the watermark delay."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_flow(stream: DataFrame, time: str, width: str, delay: str, by: str, start: str = "0 days") -> DataFrame:
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return t.groupBy(F.window(time, width, startTime=start).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), by, "n")


class BatchLog:
    """Rows that batches leave behind, one folder each, below a path that outlives the run. A replayed batch
    overwrites its own folder, and nothing else is ever rewritten. ``by`` names columns to partition by."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: list[str] | None = None):
        self.spark, self.path, self.by = spark, path, by or []
        self.schema = StructType.fromDDL(schema)

    def put(self, df: DataFrame, batch: int) -> None:
        df.select(self.schema.names).write.mode("overwrite").partitionBy(*self.by).parquet(f"{self.path}/batch={batch}")

    def read(self, before: int | None = None) -> DataFrame:
        """The rows of all batches, or of those before one; none where no batch has ended yet."""
        whole = StructType([*self.schema.fields, StructField("batch", IntegerType())])
        try:
            out = self.spark.read.schema(whole).option("basePath", self.path).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            out = self.spark.createDataFrame([], whole)
        return out if before is None else out.where(F.col("batch") < before)

    def newest(self, keys: list[str]) -> DataFrame:
        """The row that the last batch with the key left."""
        rest = [c for c in self.schema.names if c not in keys]
        return self.read().groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")


def upsert_windows(stream: DataFrame, log: BatchLog, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run an update-mode aggregate into a keyed result: the newest batch of a key wins."""
    drain(stream, checkpoint, each=lambda df, i: log.put(df, i), mode="update")
    return log.newest(keys)


def keyed_updates(stream: DataFrame, key: str, time: str, version: str, payload: list[str], delay: str, log: BatchLog, checkpoint: str) -> DataFrame:
    """The last version of every key's payload, whatever order replays arrive in.

    The state is Spark's own: one row for each key whose time is above the watermark, so it is bounded by the
    delay and not by the history. A batch writes only the keys that it changed; a replay that comes later than
    the delay changes nothing."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    last = t.groupBy(key, time).agg(F.max(version).alias(version), *[F.max_by(c, version).alias(c) for c in payload])
    drain(last, checkpoint, each=lambda df, i: log.put(df, i), mode="update")
    return log.newest([key, time])


def apply_change_stream(stream: DataFrame, state: DataFrame, log: BatchLog, checkpoint: str) -> DataFrame:
    """Soft-delete change feed over a keyed table. What the changes of a key come to is kept in the state store;
    a batch writes the keys that it touched, and the table is the given one under the newest of them."""
    drain(merge.change_summary(stream), checkpoint, each=lambda df, i: log.put(df, i), mode="update")
    return merge.apply_summary(state, log.newest(["key"]))


KEPT = "stored_id bigint, fp bigint, created_at timestamp, day date"
FOUND = "item bigint, original bigint"
ALERTS = "spec_id bigint, offer_id bigint, score double"


def near_duplicate_stream(texts: DataFrame, kept: BatchLog, found: BatchLog, checkpoint: str, threshold: int = HAMMING_THRESHOLD, days: int = RETENTION_DAYS) -> DataFrame:
    """Near-duplicates of each batch of ``(item, text, created_at)`` against the kept fingerprints inside the
    retention window, counted back from the batch's newest text. Kept fingerprints are logged by day, so that
    what has aged out is never read; expired days may be deleted."""
    def run(df: DataFrame, i: int) -> None:
        fps = dedup.fingerprints(df.select("item", "text"), "item").join(df.select("item", "created_at"), "item")
        df = dedup.cut_lineage(fps)
        today = df.agg(F.to_date(F.max("created_at"))).first()[0]
        since = today - timedelta(days=days) if today else None
        known = kept.read(before=i).where(F.col("day") >= F.lit(since)).select("stored_id", "fp", F.struct("batch", "stored_id").alias("pos"))
        dups = dedup.cut_lineage(dedup.deduplicate(df.select("item", "fp"), known, threshold))
        found.put(dups, i)
        kept.put(df.join(dups, "item", "left_anti").select(F.col("item").alias("stored_id"), "fp", "created_at", F.to_date("created_at").alias("day")), i)

    drain(texts, checkpoint, each=run)
    return found.read()


def match_alert_stream(offers: DataFrame, wants: DataFrame, alerts: BatchLog, checkpoint: str, k: int = TOP_MATCHES) -> DataFrame:
    """What enters the ``k`` best matches of a standing want, over all offers so far, is an alert once.

    Whatever is among the best now was an alert when it came, so the best so far are read from the alerts of
    the wants that the batch matches; nothing else is stored and nothing is rewritten."""
    def run(df: DataFrame, i: int) -> None:
        fresh = stored(match.match_wants(wants, df, k).select("spec_id", "offer_id", "score"), "fresh")
        before = alerts.read(before=i)
        order = [F.col("score").desc(), F.col("offer_id").desc()]
        touched = before.join(fresh.select("spec_id").distinct(), "spec_id", "left_semi")
        both = top_k(touched.select("spec_id", "offer_id", "score"), ["spec_id"], order, k).drop("rn").withColumn("_known", F.lit(True))
        both = both.unionByName(fresh.withColumn("_known", F.lit(False)))
        # rows of a want are in one partition from here on: what is known is told by a window, not by a join on both ids
        known = F.max("_known").over(Window.partitionBy("spec_id", "offer_id")) & F.col("spec_id").isNotNull() & F.col("offer_id").isNotNull()
        both = both.repartition("spec_id").withColumn("_seen", known).where(F.col("_known") | ~F.col("_seen")).drop("_seen")
        alerts.put(top_k(both, ["spec_id"], order, k).where(~F.col("_known")), i)

    drain(offers, checkpoint, each=run)
    return alerts.read()
