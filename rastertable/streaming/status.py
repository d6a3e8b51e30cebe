"""Streams of tile updates and scenes: folding to the latest status, progress rates, incremental screening, availability."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rastertable.functions.pixels import all_valid


def latest_status(log: DataFrame, key: str = "tile_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last status of each tile of a batch of updates: (key, status, ts, tie)."""
    last = log.groupBy(key).agg(F.max(F.struct(ts, tie, "status")).alias("__u"))
    return last.select(key, F.col("__u.status").alias("status"), F.col(f"__u.{ts}").alias(ts), F.col(f"__u.{tie}").alias(tie))


def fold_status(stream: DataFrame, path: str, checkpoint: str, key: str = "tile_id", ts: str = "ts", tie: str = "event_id") -> StreamingQuery:
    """Folds an update stream into a table of the latest status.

    Each micro-batch is reduced to one row a tile and merged with the version before. Two folders take turns, so that a batch that is
    run again after a failure writes the same version anew and no older one is kept; ``folded`` reads the newest.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        new = latest_status(batch, key, ts, tie)
        if epoch:
            before = batch.sparkSession.read.schema(new.schema).parquet(f"{path}/turn={(epoch - 1) % 2}")
            new = latest_status(new.unionByName(before), key, ts, tie)
        new.withColumn("version", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/turn={epoch % 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that ``fold_status`` wrote."""
    turns = spark.read.parquet(path)
    return turns.join(F.broadcast(turns.agg(F.max("version").alias("version"))), "version", "left_semi").drop("turn", "version")  # one row


def progress_rate(log: DataFrame, window: str = "1 hour", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """For each tumbling window: updates, those that are valid, rejected and failed, and updates a minute. Streams and batches alike."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    hits = {f"n_{s}": F.count(F.when(F.col("status") == s, 1)) for s in ("valid", "rejected", "failed")}
    out = rows.groupBy(F.window(ts, window)).agg(F.count("*").alias("n_done"), *[c.alias(k) for k, c in hits.items()])
    minutes = (F.unix_timestamp("window.end") - F.unix_timestamp("window.start")) / 60.0
    return out.select(F.col("window.start").alias("start"), "n_done", *hits, (F.col("n_done") / minutes).alias("per_minute"))


def progress_stream(log: DataFrame, path: str, checkpoint: str, window: str = "1 hour", ts: str = "ts", late: str = "1 hour") -> StreamingQuery:
    """Progress rates as updates arrive: windows that a micro-batch changed are written as a version of their own.

    The watermark drops updates that come more than ``late`` after the newest, and with them the state of windows that are over.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    rates = progress_rate(log, window, ts, late)
    return rates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rates(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each window that ``progress_stream`` wrote."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("start", "version")]
    newest = rows.groupBy("start").agg(F.max_by(F.struct(*values), "version").alias("__r"))
    return newest.select("start", *[F.col(f"__r.{c}").alias(c) for c in values])


def incremental_screen(stream: DataFrame, screen: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "id", ts: str | None = None, within: str = "1 day") -> StreamingQuery:
    """Screens cells once as they arrive; each micro-batch writes a version folder of its own.

    Ids that an earlier version has are left out by an anti-join with the table, so the stream keeps no state for them; with an
    event time a repeated id within ``within`` is dropped before that.
    """
    rows = stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key]) if ts else stream

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates([key])
        if epoch:
            done = batch.sparkSession.read.parquet(path).where(F.col("version") < epoch).select(key)
            new = new.join(done, key, "left_anti")
        screen(new).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def availability_updates(obs: DataFrame, bands: Sequence[str], by: Sequence[str] = ("gx", "gy", "y"), usable: Column | None = None) -> DataFrame:
    """The stateful aggregate behind the stream of availability; on a batch it is the final result."""
    ok = all_valid(*map(F.col, bands))
    if usable is not None:
        ok = F.when(usable, ok).otherwise(0)
    return obs.groupBy(*by).agg(F.max(ok).alias("available"))


def availability_stream(obs: DataFrame, bands: Sequence[str], path: str, checkpoint: str, by: Sequence[str] = ("gx", "gy", "y"), usable: Column | None = None) -> StreamingQuery:
    """Availability as scenes arrive: changed pixels of each micro-batch are written as a version of their own; the largest value of a pixel is current."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return availability_updates(obs, bands, by, usable).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
