"""Streams whose state and whose work for a micro-batch stay bounded: keyed upserts, screening of new ids, availability that ends with its year."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rastertable.functions.pixels import all_valid
from rastertable.sources import keyed
from rastertable.sources.registry import apply_updates
from rastertable.streaming.status import latest_status, progress_rate

#: Pixels along the side of a block; the state of a block and year is two bits a pixel.
SIDE = 64
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_keyed(stream: DataFrame, path: str, checkpoint: str, key: str = "tile_id", ts: str = "ts", tie: str = "event_id", buckets: int = keyed.BUCKETS) -> StreamingQuery:
    """Folds an update stream into a keyed table of the latest status: a micro-batch rewrites the buckets of its tiles alone.

    Read it with ``folded_keyed``. A micro-batch that is run again writes the same table.
    """
    schema = latest_status(stream, key, ts, tie).schema

    def write(batch: DataFrame, epoch: int) -> None:
        keyed.merge(batch, path, epoch, key, lambda held, new: latest_status(latest_status(new, key, ts, tie).unionByName(held), key, ts, tie), schema, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded_keyed(spark: SparkSession, path: str, key: str = "tile_id", kind: str = "long", ts: str = "ts", time: str = "timestamp", tie: str = "event_id") -> DataFrame:
    return keyed.current(spark, path, f"{key} {kind}, status string, {ts} {time}, {tie} long")


def progress_keyed(log: DataFrame, path: str, checkpoint: str, window: str = "1 hour", ts: str = "ts", late: str = "1 hour", buckets: int = 8) -> StreamingQuery:
    """As ``progress_stream``, but a window has one row in a keyed table: a micro-batch replaces the windows that it changed, and what is superseded is dropped.

    Read it with ``keyed.current`` and ``progress_rate(log).schema``.
    """
    rates = progress_rate(log, window, ts, late)
    schema, spark = rates.schema, log.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        keyed.merge(batch, path, epoch, "start", lambda held, new: held.join(new.select("start"), "start", "left_anti").unionByName(new), schema, buckets)
        keyed.vacuum(spark, path)

    return rates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_tiles(updates: DataFrame, path: str, number: int, fields: Sequence[str], schema, now: Column | None = None, key: str = "tile_id", buckets: int = keyed.BUCKETS) -> list[int]:
    """``apply_updates`` on a keyed registry: only the buckets of the updated tiles are read and written. Unknown tiles are not added."""
    return keyed.merge(updates, path, number, key, lambda held, new: apply_updates(held, new, fields, now, key), schema, buckets)


def screen_new(stream: DataFrame, screen: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, schema: str, key: str = "id", order: Sequence[str] = (), buckets: int = keyed.BUCKETS) -> StreamingQuery:
    """Screens each id once as it arrives. Who is done is asked of a filter first, see ``keyed.undone``; the stream keeps no state.

    Of several rows of an id in a micro-batch the first in ``order`` (then by all columns) counts. ``schema`` is that of the screened rows, as DDL.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        others = [c for c in batch.columns if c != key]
        first = batch.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order, *others)).alias("__r"))
        new = keyed.undone(first.select(key, "__r.*"), path, epoch, key, schema, buckets)
        keyed.commit(screen(new), path, epoch, key, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class BlockAvailability(StatefulProcessor):
    """State of a block of pixels and a year: which pixels were seen and which were available. It ends when the watermark passes the year."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bits = handle.getValueState("bits", "seen binary, good binary")

    def _rows(self, key: tuple, at: np.ndarray, good: np.ndarray, final: bool) -> pd.DataFrame:
        bx, by, y = (int(k) for k in key)
        return pd.DataFrame({"gx": bx * SIDE + at % SIDE, "gy": by * SIDE + at // SIDE, "y": np.full(len(at), y, np.int64), "available": good.astype(np.int32), "final": np.full(len(at), final)})

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.bits.exists():
            return np.zeros(SIDE * SIDE, bool), np.zeros(SIDE * SIDE, bool)
        return tuple(np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in self.bits.get())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = int(datetime(int(key[2]) + 1, 1, 1, tzinfo=UTC).timestamp() * 1000)
        if end <= timerValues.getCurrentWatermarkInMs():  # late: the year is over and its result stands
            return
        seen, good = self._held()
        before = seen.copy(), good.copy()
        for part in rows:
            at = (part["gy"].to_numpy() % SIDE) * SIDE + part["gx"].to_numpy() % SIDE
            seen[at] = True
            good[at[part["ok"].to_numpy() == 1]] = True
        changed = np.flatnonzero((seen != before[0]) | (good != before[1]))
        if len(changed):
            self.bits.update((np.packbits(seen).tobytes(), np.packbits(good).tobytes()))
            if not before[0].any():
                self.handle.registerTimer(end)
            yield self._rows(key, changed, good[changed], False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, good = self._held()
        at = np.flatnonzero(seen)
        self.bits.clear()
        yield self._rows(key, at, good[at], True)

    def close(self) -> None:
        pass


def availability_by_year(obs: DataFrame, bands: Sequence[str], path: str, checkpoint: str, ts: str = "ts", late: str = "30 days", usable: Column | None = None) -> StreamingQuery:
    """Availability of pixels and years as scenes arrive, with state that ends.

    ``obs`` has gx, gy, the event time ``ts`` (UTC) and the bands. Pixels are grouped in blocks of ``SIDE`` by ``SIDE``; a block's state
    of a year is written out as final and dropped when the watermark, ``late`` behind the newest scene, passes the end of the year.
    Scenes of a year that is over change nothing. Changed pixels of running years are written by each micro-batch.
    """
    ok = all_valid(*map(F.col, bands))
    ok = F.when(usable, ok).otherwise(0) if usable is not None else ok
    rows = obs.withWatermark(ts, late).select(ts, F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), ok.cast("int").alias("ok"))
    rows = rows.withColumns({"bx": F.floor(F.col("gx") / SIDE), "by": F.floor(F.col("gy") / SIDE), "y": F.year(ts).cast("long")})
    out = rows.groupBy("bx", "by", "y").transformWithStateInPandas(BlockAvailability(), "gx long, gy long, y long, available int, final boolean", "Update", "EventTime")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").partitionBy("final").parquet(f"{path}/version={epoch}")

    spark = obs.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # the store that timers need; read when the query starts
    try:
        return out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def availability_now(spark: SparkSession, path: str) -> DataFrame:
    """(gx, gy, y, available, final): years that are over as written, running years merged from the micro-batches' changes."""
    rows = spark.read.schema("gx long, gy long, y long, available int, version long, final boolean").parquet(path)
    over = rows.where("final").select("gx", "gy", "y", "available", "final")
    ended = over.select("y").distinct()
    running = rows.where("NOT final").join(ended, "y", "left_anti").groupBy("gx", "gy", "y").agg(F.max("available").alias("available"))
    return over.unionByName(running.withColumn("final", F.lit(False)))
