"""Tables with one row a key that are changed in place of being rewritten, and append-only tables that know who is done.

A keyed table has its rows in hash buckets; a merge rewrites the buckets that its batch touches, each under the batch's number, and then the
manifest that names the current number of every bucket. Readers follow the newest manifest, so a merge is seen whole or not at all. A
batch that is run again starts from the manifest before its own and writes the same files anew.

A done table keeps each batch in a folder of its number and beside it a filter of its ids: one 64-bit word for each few ids, with ``BITS``
bits of an id set in one word (a blocked Bloom filter), all by column functions. New ids are looked up in the words; only those that the words
may hold are compared with ids, and only with the buckets they fall in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Bits that an id sets in its word, and words of a filter for each bucket; about 4 ids to a word keep false hits below 2 %.
BITS = 4
WORDS_PER_BUCKET = 1 << 12


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name=<number>`` that were written whole."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    found = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith(f"{name}=")]
    done = [int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done)


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """The current number of each bucket, at most one for each; a manifest has as many rows as the table has buckets."""
    return {r.bucket: r.number for r in spark.read.schema("bucket int, number long").parquet(f"{path}/manifest/batch={number}").collect()}


def _rows(spark: SparkSession, path: str, schema, places: dict[int, int]) -> DataFrame:
    paths = [f"{path}/rows/bucket={b}/number={n}" for b, n in sorted(places.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(batch: DataFrame, path: str, number: int, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame], schema, buckets: int = BUCKETS) -> list[int]:
    """Merges batch ``number`` into the keyed table at ``path``: combine(rows of the touched buckets, batch) replaces those buckets.

    ``combine`` returns at most one row a key, in ``schema``, and only keys of the two tables. Numbers grow; a repeated one changes
    nothing. Returns the buckets that were written.
    """
    spark = batch.sparkSession
    earlier = [n for n in _numbers(spark, f"{path}/manifest", "batch") if n < number]
    before = _manifest(spark, path, earlier[-1]) if earlier else {}
    touched = sorted(r[0] for r in batch.select(bucket_of(key, buckets)).distinct().collect())  # at most ``buckets`` rows
    if touched:
        held = _rows(spark, path, schema, {b: before[b] for b in touched if b in before})
        out = combine(held, batch).withColumns({"bucket": bucket_of(key, buckets), "number": F.lit(number).cast("long")})
        dealt = out.repartition(min(len(touched), max(spark.sparkContext.defaultParallelism, len(touched) // 4)), "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "number").parquet(f"{path}/rows")
    after = before | dict.fromkeys(touched, number)
    spark.createDataFrame(sorted(after.items()), "bucket int, number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
    return touched


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a keyed table as its newest manifest names them."""
    numbers = _numbers(spark, f"{path}/manifest", "batch")
    return _rows(spark, path, schema, _manifest(spark, path, numbers[-1]) if numbers else {})


def vacuum(spark: SparkSession, path: str) -> int:
    """Drops what neither of the two newest manifests names; a batch that may run again needs the one before it. Returns the folders dropped."""
    numbers = _numbers(spark, f"{path}/manifest", "batch")
    kept = {(b, n) for k in numbers[-2:] for b, n in _manifest(spark, path, k).items()}
    fs, rows = _fs(spark, f"{path}/rows")
    dropped = 0
    for bucket in fs.listStatus(rows) if fs.exists(rows) else []:
        if bucket.isDirectory() and bucket.getPath().getName().startswith("bucket="):
            b = int(bucket.getPath().getName().split("=")[1])
            for version in fs.listStatus(bucket.getPath()):
                n = int(version.getPath().getName().split("=")[1])
                if (b, n) not in kept and n < max(numbers, default=0):
                    fs.delete(version.getPath(), True)
                    dropped += 1
    for n in numbers[:-2]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/batch={n}"), True)
    return dropped


# Who is done -----------------------------------------------------------------------------------------------------


def _word(key: str, buckets: int) -> dict[str, Column]:
    """An id's bucket, its word in the filter and its bits in that word."""
    h = F.xxhash64(F.lit(77), key)
    bits = F.lit(0).cast("long")
    for k in range(BITS):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")))
    return {"bucket": bucket_of(key, buckets), "__word": F.pmod(F.shiftrightunsigned(h, 24), F.lit(WORDS_PER_BUCKET)).cast("int"), "__bits": bits}


def commit(batch: DataFrame, path: str, number: int, key: str, buckets: int = BUCKETS) -> None:
    """Writes batch ``number`` of a done table and its filter. The folder of a batch is replaced whole, so running it again changes nothing."""
    rows = batch.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
    ids = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/rows/batch={number}")
    words = ids.select(key).withColumns(_word(key, buckets)).groupBy("bucket", "__word").agg(F.bit_or("__bits").alias("__bits"))
    words.write.mode("overwrite").parquet(f"{path}/filter/batch={number}")


def _done(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    numbers = [n for n in _numbers(spark, f"{path}/filter", "batch") if before is None or n < before]
    paths = [f"{path}/rows/batch={n}" for n in numbers]
    placed = f"{schema}, batch long, bucket int"
    return spark.read.schema(placed).option("basePath", f"{path}/rows").parquet(*paths) if paths else spark.createDataFrame([], placed)


def done_rows(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows of a done table whose batch was written whole, or those of batches below ``before``; ``schema`` as DDL."""
    return _done(spark, path, schema, before).drop("batch", "bucket")


def undone(batch: DataFrame, path: str, number: int, key: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``batch`` whose id no batch below ``number`` has.

    Filters of all earlier batches are read, two bytes an id; ids are read only of the buckets that hits fall in.
    """
    spark = batch.sparkSession
    numbers = [n for n in _numbers(spark, f"{path}/filter", "batch") if n < number]
    if not numbers:
        return batch
    words = spark.read.schema("bucket int, __word int, __bits long").parquet(*[f"{path}/filter/batch={n}" for n in numbers])
    known = words.groupBy("bucket", "__word").agg(F.bit_or("__bits").alias("__known"))
    marked = batch.select(key).distinct().withColumns(_word(key, buckets)).join(known, ["bucket", "__word"])
    hits = marked.where(F.col("__known").bitwiseAND(F.col("__bits")) == F.col("__bits")).select(key, "bucket")
    places = [r.bucket for r in hits.select("bucket").distinct().collect()]  # at most ``buckets`` rows
    if not places:
        return batch
    ids = _done(spark, path, schema, number).where(F.col("bucket").isin(places))
    return batch.join(hits.join(ids.select(key), key, "left_semi").select(key), key, "left_anti")
