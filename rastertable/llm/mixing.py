"""Operator 4: mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Sources in order of code point (null last) have weights 5, 2, 1, repeating. Targets share the total of all sizes by weight; a
target stops at ``MOST`` = 3 times its source's size and the excess is shared again by weight until none is above.

Slot i of the schedule has the point frac(i * golden ratio), and the source in whose part of the cumulative targets the point
falls. Slots of a source are ranked; each source's documents, in the order of a hash of doc_id and text, form blocks of ``BLOCK`` words; slot
rank r takes block r modulo the source's number of blocks, so that a source larger than its target is cut and a smaller one
repeats. Sums over a source run over hash buckets and the ranks over stretches of slots, so that no task holds a source.

Null texts, and texts without words, have size 0 and take nothing. A null source is a source of its own. Equal rows are
kept as often as they occur and each has its own place. Other columns are not read. Tables without words give takes of 0; empty tables give no rows.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertable.llm.components import split_join
from rastertable.llm.shared import written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 32
#: Hash buckets of a source, over which its running sums go.
BUCKETS = 4096
#: Slots of the schedule that one ranking stretch holds.
STRETCH = 1 << 12
#: Equal cells of the unit interval, by which points find their source.
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"

getcontext().prec = 60
_GOLDEN = (Decimal(5).sqrt() - 1) / 2
_LOW, _HIGH = float(_GOLDEN), float(_GOLDEN * 2**20 % 1)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place): place orders the documents of a source."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("place"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target), one row for each source; ``sized`` has source and size.

    Filling to the caps is a closed form: sources in order of cap / weight are capped as long as the level that the rest
    would have is above their own.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    number = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (number % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighted = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST))
    everything = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, whole = everything.rowsBetween(Window.unboundedPreceding, -1), everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighted.withColumn("level", left / open_weight)
    #: The first source whose cap the level does not reach sets the level of all that follow.
    first = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(whole)
    return levels.withColumn("final", first).select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), "cap").alias("target"))


def points(slot: Column) -> Column:
    """frac(slot * golden ratio); the slot's high and low parts apart, so that large numbers keep their digits."""
    high, low = F.floor(slot / F.lit(1 << 20)), slot % F.lit(1 << 20)
    return F.pmod(high * F.lit(_HIGH) + low * F.lit(_LOW), F.lit(1.0))


def schedule(quotas: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source, rank): which source each slot takes, and the slot's number among those of its source.

    ``quotas`` has source and quota (its share of the slots). A rank is the number within a stretch of slots plus the
    source's slots in the stretches before. Sources are few beside slots; their running sums are one small window.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    up = ordered.rowsBetween(Window.unboundedPreceding, 0)
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = quotas.where("quota > 0").withColumn("hi", F.sum("quota").over(up) / F.sum("quota").over(every))
    shares = shares.withColumn("lo", F.coalesce(F.lag("hi").over(ordered), F.lit(0.0))).withColumn("hi", F.when(F.lead("hi").over(ordered).isNull(), 2.0).otherwise(F.col("hi")))
    spanned = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))
    cells = shares.select("source", "lo", "hi", F.explode(spanned).alias("cell"))
    slots = quotas.sparkSession.range(n_slots).select(F.col("id").alias("slot"), points(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "source", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    numbered = dealt.withColumn("own", F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1)
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    bases = counts.select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return numbered.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t"))).select("slot", "source", (F.col("base") + F.col("own")).alias("rank"))


def ordered(sized: DataFrame) -> DataFrame:
    """``sized``, a written table, with ``order``: the hash of ``place`` and, for rows that are repeated very often, of the copy's number.

    Copies are numbered within the table's partitions and these one after the other, so that no task holds all copies of a row.
    """
    share = sized.count() // BUCKETS + 1
    often = sized.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > share).select("place", F.lit(True).alias("often"))
    marked = sized.withColumn("part", F.spark_partition_id()).join(F.broadcast(often), "place", "left")  # at most BUCKETS rows
    hot = marked.where("often")
    sums = hot.groupBy("place", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("place", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("place", "part").orderBy("place"))
    copies = hot.withColumn("own", own).join(bases, ["place", "part"]).withColumn("copy", F.col("base") + F.col("own"))
    rest = marked.where("often IS NULL").withColumn("copy", F.lit(0).cast("long"))
    names = ["doc_id", "source", "size", "place"]
    return rest.select(*names, "copy").union(copies.select(*names, "copy")).select(*names, F.xxhash64("place", "copy").alias("order"))


def placed(sized: DataFrame) -> DataFrame:
    """``sized`` with ``at``, the words of its source before the document, in the order of ``order``.

    The sum within a hash bucket of the source plus the buckets before it.
    """
    bucketed = ordered(sized).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = bucketed.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = run.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("doc_id", "source", "size", "place", (F.col("base") + F.col("own")).alias("at"))


def pieces(positions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, block, doc_id, at, from_word, words): the words of each document in each block of its source."""
    spanned = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))
    cut = positions.where("size > 0").withColumn("block", F.explode(spanned))
    lo, hi = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("source", "block", "doc_id", "at", (lo - F.col("at")).alias("from_word"), (hi - lo).alias("words"))


def mix(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as (placed documents, targets, takes).

    takes has a row for each piece that a slot takes: slot, source, doc_id, at, from_word and words; ordered by slot it is
    the mixed stream. (source, at) tells documents with words apart, equal rows too.
    """
    sized = written(sizes(docs), "sizes")
    quotas = written(targets(sized), "targets")
    n_blocks = F.ceil(F.col("source_size") / block)
    quotas_in_blocks = quotas.where("source_size > 0").select("source", n_blocks.alias("n_blocks"), (F.col("target") / F.col("source_size") * n_blocks).alias("quota"))
    n_slots = round(quotas_in_blocks.agg(F.sum("quota")).first()[0] or 0)
    plan = schedule(quotas_in_blocks, n_slots).join(quotas_in_blocks.select(F.col("source").alias("q"), "n_blocks"), F.col("source").eqNullSafe(F.col("q")))
    plan = plan.where(F.col("rank") < F.col("n_blocks") * MOST).select("slot", F.col("source").alias("p"), (F.col("rank") % F.col("n_blocks")).alias("b"))
    positions = written(placed(sized), "placed")
    takes = pieces(positions, block).join(plan, F.col("source").eqNullSafe(F.col("p")) & (F.col("block") == F.col("b"))).select("slot", "source", "doc_id", "at", "from_word", "words")
    return positions, quotas, takes


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, place, source_size, target, taken) for each row of ``docs``."""
    positions, quotas, takes = mix(docs, block)
    sums = takes.groupBy(F.col("source").alias("s"), F.col("at").alias("a")).agg(F.sum("words").alias("words"))
    met = F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")) & (F.col("size") > 0)
    out = positions.join(sums, met, "left").join(quotas.withColumnRenamed("source", "q"), F.col("source").eqNullSafe(F.col("q")))
    return out.select("doc_id", "source", "size", "place", "source_size", "target", F.coalesce("words", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` as the mix has them: each whole document as often as its taken words hold it, rounded; equal rows alike."""
    twins = written(taken(docs, block).groupBy("place").agg(F.avg(F.col("taken") / F.greatest("size", F.lit(1))).alias("share"), F.count("*").alias("n")), "twins")
    repeats = twins.select(F.col("place").alias("__place"), F.round("share").cast("int").alias("__times")).where("__times > 0")
    counts = twins.select(F.col("place").alias("__place"), F.col("n").alias("__n"))
    total = twins.agg(F.sum("n")).first()[0] or 0
    names = docs.columns
    keyed = docs.withColumn("__place", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    out = split_join(keyed, repeats, "__place", F.monotonically_increasing_id(), total, counts)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*names)
