"""Structured Streaming versions of the counts, velocities and scoring.

Every stream writes to a parquet sink (or a parquet state table through
``foreachBatch``) under the session's checkpoint folder, with its own
checkpoint location, so a restarted query resumes exactly once. Triggers use
``availableNow`` for bounded runs; the same code runs with a processing-time
trigger on a live source.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from trendspark.session import cut_lineage, scratch_path, spread


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    run = f"{name}-{uuid.uuid4().hex}"
    return scratch_path(spark, f"streams/{run}/out"), scratch_path(spark, f"streams/{run}/checkpoint")


def source(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Schema-declared parquet stream (never inferred)."""
    # the file source takes a folder or a glob; a single file is named as a
    # one-file glob (the source would otherwise use the file as its basePath)
    if path.endswith(".parquet"):
        path = path[:-1] + "[" + path[-1] + "]"
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream into a parquet sink and return the sink as a table."""
    spark = df.sparkSession
    out, ckpt = _paths(spark, name)
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt)
         .option("path", out).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def window_counts(events: DataFrame, ts: str, keys: list[str], length: str, slide: str | None,
                  watermark: str) -> DataFrame:
    """Counts per event-time window (tumbling or sliding) and key, rows
    later than the watermark dropped; append mode emits closed windows only."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (e.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"))


def _latest_state(spark: SparkSession, root: str, before_epoch: int) -> DataFrame | None:
    """The newest committed epoch partition of the state table (None when the
    table does not exist yet). Read from storage, not from driver memory, so a
    restarted query continues from its last state."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    t = spark.read.parquet(root)  # any read error rises: a broken state must not restart the counts
    last = t.where(F.col("epoch") < before_epoch).agg(F.max("epoch")).first()[0]
    return None if last is None else t.where(F.col("epoch") == last).drop("epoch")


def merge_counts_batch(root: str, key_cols: list[str]):
    """X2 helper: a foreachBatch function that merges the batch's counts into
    a state table partitioned by epoch. Each batch overwrites only its own
    epoch partition (dynamic partition overwrite), so a retried batch is
    idempotent, and the previous state is found in the table itself."""

    def fn(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        agg = batch.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n"))
        cur = _latest_state(spark, root, epoch_id)
        if cur is not None:
            agg = cur.unionByName(agg).groupBy(*key_cols).agg(F.sum("n").alias("n"))
        (agg.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(root))
        # A retry of this batch reads the epoch before it; older states are of no use.
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/epoch={epoch_id - 2}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return fn


def run_foreach_batch(df: DataFrame, name: str, key_cols: list[str]) -> DataFrame:
    spark = df.sparkSession
    out, ckpt = _paths(spark, name)
    q = (df.writeStream.foreachBatch(merge_counts_batch(out, key_cols)).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    last = _latest_state(spark, out, 1 << 62)
    if last is None:
        return spark.createDataFrame([], df.select(*key_cols).schema.add("n", "long"))
    return last


STATE_OUT = "topic int, year int, n_kt long, velocity double, gap int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State of streams started inside lies in RocksDB, on disk, as ``transformWithState`` needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def running_velocity(rows: DataFrame, year_range: tuple[int, int], idle_ms: int | None = None) -> DataFrame:
    """``transformWithState`` keyed by topic over (topic, year) rows, in update mode.

    Each partition first counts its rows per (topic, year), so the shuffle to
    the state operator carries counts and a hot topic is no hot task. The state is a
    map from year to count: a batch reads and writes the years it touches, and emits
    those whose count, velocity or gap has changed (all years of the calendar
    ``year_range`` when a topic is first seen). With ``idle_ms`` a timer
    clears a topic that had no rows for so long. Functions and processor are nested, so
    Python workers need no import of this package."""
    lo, hi = year_range

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pdf.groupby(["topic", "year"], as_index=False).size().rename(columns={"size": "n"})

    class Velocity(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.counts = handle.getMapState("counts", "year int", "n long")

        def of(self, year):
            return self.counts.getValue((year,))[0] if self.counts.containsKey((year,)) else 0

        def handleInputRows(self, key, rows, timerValues):
            more = {}
            for pdf in rows:
                for y, c in zip(pdf["year"], pdf["n"]):
                    more[int(y)] = more.get(int(y), 0) + int(c)
            changed = set() if self.counts.exists() else set(range(lo, hi + 1))
            for y, c in more.items():
                old = self.of(y)
                self.counts.updateValue((y,), (old + c,))
                changed |= {y, y + 1}
                z = y + 1
                while not old and z <= hi and not self.of(z):  # the gap after this year begins here now
                    changed.add(z)
                    z += 1
            if idle_ms:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            out = []
            for y in sorted(changed):
                if lo <= y <= hi:
                    n, gap = self.of(y), 0
                    while y - gap >= lo and not self.of(y - gap):
                        gap += 1
                    prev = self.of(y - 1) if y > lo else None
                    v = 0.0 if prev is None else (n - prev) / (prev + 1.0)
                    out.append((int(key[0]), y, n, round(v, 4), gap))
            yield pd.DataFrame(out, columns=["topic", "year", "n_kt", "velocity", "gap"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.counts.clear()
            yield pd.DataFrame({"topic": [], "year": [], "n_kt": [], "velocity": [], "gap": []})

        def close(self):
            pass

    counted = rows.select("topic", "year").mapInPandas(count, "topic int, year int, n long")
    return counted.groupBy("topic").transformWithStateInPandas(
        Velocity(), STATE_OUT, "Update", "ProcessingTime" if idle_ms else "None")


def latest_per_key(table: DataFrame, keys: list[str], order: str = "epoch") -> DataFrame:
    """Final view of an update-mode sink: the last emitted row per key."""
    return (table.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in table.columns if c not in keys]),
                                              F.col(order)).alias("_r"))
            .select(*keys, "_r.*"))


def run_update_to_table(df: DataFrame, name: str, paths: tuple[str, str] | None = None) -> DataFrame:
    """Update-mode stream into an append-only parquet table (one file set per
    epoch, stamped); ``latest_per_key`` gives the final view. With the ``paths`` (output, checkpoint)
    of an earlier run it goes on from there."""
    spark = df.sparkSession
    out, ckpt = paths or _paths(spark, name)

    def fn(batch: DataFrame, epoch_id: int) -> None:
        # one partition per epoch, overwritten on retry: idempotent
        (batch.withColumn("_epoch", F.lit(epoch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_epoch").parquet(out))

    with rocksdb_state(spark):
        q = (df.writeStream.foreachBatch(fn).outputMode("update").option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(out)


def run_batches(df: DataFrame, name: str, fn_batch, spread_by: str | None = None) -> DataFrame:
    """Apply ``fn_batch(batch_df) -> DataFrame`` to every micro-batch (stream-
    static joins and batch-level argmax) and append the results. ``spread_by``: column
    by which a batch is dealt to the tasks first, as a file is one task otherwise."""
    spark = df.sparkSession
    out, ckpt = _paths(spark, name)

    def fn(batch: DataFrame, epoch_id: int) -> None:
        # read, tokenised and spread over the tasks once, however often ``fn_batch`` uses it
        batch = cut_lineage(spread(batch, spread_by) if spread_by else batch, f"{name}-batch")
        (fn_batch(batch).withColumn("_epoch", F.lit(epoch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_epoch").parquet(out))

    q = df.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
