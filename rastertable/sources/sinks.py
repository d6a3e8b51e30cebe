"""Writers. Spark's commit protocol makes each write whole or absent, so nothing is renamed by hand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(screened: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Valid and rejected rows as partitions of one table."""
    screened.write.mode(mode).partitionBy("valid").parquet(path)


def append_checkpoint(batch: DataFrame, path: str) -> None:
    """Adds a screened batch; on resume an anti-join leaves out what is there."""
    batch.write.mode("append").parquet(path)


def export_stack(stack: DataFrame, path: str, bands: Sequence[str], keys: Sequence[str] = ("tile_id",), partition: str = "region") -> None:
    """Writes band values as floats, the pixels of a tile together, partitioned by region.

    Tiles are dealt by a hash of their id, so a large region is written by many tasks.
    """
    out = stack.withColumns({b: F.col(b).cast("float") for b in bands}).repartition(*keys).sortWithinPartitions(partition, *keys)
    out.write.mode("overwrite").partitionBy(partition).parquet(path)


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").json(path)
