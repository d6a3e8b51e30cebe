"""Operator 3: sharding by fixed virtual slots.

Each record is hashed (doc_id and text) to one of ``SLOTS`` virtual slots. The slot-to-shard map is a small table with a version:
version 1 deals the slots in turn, whatever they hold; then bytes are summed by slot and the map is edited, as it is whenever
shards grow, shrink or come and go: version 2 moves slots from heavy shards to light ones until shards are near equal in bytes.
A record's size is the UTF-8 bytes of its text (null: none) plus 8.

The map has ``SLOTS`` rows whatever the corpus; only it passes through the driver. A shard is written in parts of about ``PART_BYTES``, one
task each; a slot larger than that is spread over parts of its own. A record's place in its shard is its number within
its part plus the records of the shard's parts before it, as counted in the written files, so no task holds a shard or a slot.

A row that is repeated more often than a slot has rows on average is dealt over as many slots as it fills; such equal rows are
told apart by their place in the scan. Null doc_ids are spread by their texts. Empty tables give empty shards. Extra columns go to
the shard files; those named slot, shard, virtual_slot, size, part or number, or beginning with two underscores, are replaced.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from math import inf

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastertable.llm.shared import written

SLOTS = 8192
#: Bytes of a shard's part files, about; more where there would be over ``MOST_PARTS`` parts in all.
PART_BYTES = 128 << 20
#: Parts of all shards, about: with the slots and shards they bound the table of the parts' places, which is broadcast.
MOST_PARTS = 1 << 16
#: Parts of a shard, at least: they write a shard in parallel.
LEAST_PARTS = 8
MAP = "version int, virtual_slot int, shard int, n_rows long, n_bytes long"


def _keyed(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return docs.withColumns({"size": size, "__hash": F.xxhash64("doc_id", "text"), "__row": F.monotonically_increasing_id()})


def _dealt(keyed: DataFrame, often: DataFrame, slots: int) -> DataFrame:
    """``keyed`` with virtual_slot; ``often`` has the rows that fill several slots, at most ``slots`` of them."""
    copy = F.pmod(F.xxhash64("__row"), F.coalesce("__parts", F.lit(1)))
    slot = F.pmod(F.xxhash64("__hash", copy), F.lit(slots)).cast("int")
    return keyed.join(F.broadcast(often), "__hash", "left").withColumn("virtual_slot", slot).drop("__parts")


def with_slots(docs: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """``docs`` with size, virtual_slot, and __hash and __row, which tell records apart; and the same without the columns of ``docs``.

    The second is worked out from a written table of (hash, row, size), so that counts and loads read no text.
    """
    keyed = _keyed(docs)
    narrow = written(keyed.select("__hash", "__row", "size"), "shard-keys")
    share = narrow.count() // slots + 1
    counts = narrow.groupBy("__hash").agg(F.count("*").alias("__n")).where(F.col("__n") > share)
    often = written(counts.select("__hash", F.ceil(F.col("__n") / share).alias("__parts")), "repeated")
    return _dealt(keyed, often, slots), _dealt(narrow, often, slots)


def slot_loads(slotted: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot."""
    return slotted.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, MAP)


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map, before anything is known of the loads: the slots in turn."""
    return _table(spark, [(1, v, v % shards, 0, 0) for v in range(slots)])


def latest(slot_map: DataFrame) -> DataFrame:
    """The newest version of a map."""
    newest = slot_map.agg(F.max("version").alias("v"))
    return slot_map.join(F.broadcast(newest), F.col("version") == F.col("v")).drop("v")


def rebalanced(slot_map: DataFrame, shards: int, loads: DataFrame | None = None, slack: float = 0.001) -> DataFrame:
    """A next version of the map for ``shards`` shards; returns all versions.

    The slots of removed shards go to the lightest shards, the largest first. Then slots move, one by one, from the heaviest
    shard that can give one to the lightest, until two shards differ by less than ``slack`` of the mean or no move narrows their
    gap; all other slots stay. ``loads`` gives newer rows and bytes.
    """
    rows = latest(slot_map).collect()  # one for each virtual slot
    newer = {r.virtual_slot: (r.n_rows, r.n_bytes) for r in loads.collect()} if loads is not None else None
    size = {r.virtual_slot: (newer.get(r.virtual_slot, (0, 0)) if newer is not None else (r.n_rows, r.n_bytes)) for r in rows}
    owned: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for r in rows:
        if r.shard < shards:
            insort(owned[r.shard], (size[r.virtual_slot][1], r.virtual_slot))
    held = [sum(n for n, _ in x) for x in owned]
    for v in sorted((r.virtual_slot for r in rows if r.shard >= shards), key=lambda v: (-size[v][1], v)):
        s = min(range(shards), key=lambda s: (held[s], s))
        insort(owned[s], (size[v][1], v))
        held[s] += size[v][1]
    least = slack * sum(held) / shards
    while True:
        to = min(range(shards), key=lambda s: (held[s], s))
        moved = False
        for s in sorted(range(shards), key=lambda s: (-held[s], s)):
            gap = held[s] - held[to]
            if gap <= least:
                break
            k = bisect_right(owned[s], (gap // 2, inf)) - 1  # the largest slot of at most half the gap
            if k >= 0 and owned[s][k][0]:
                n, v = owned[s].pop(k)
                insort(owned[to], (n, v))
                held[s], held[to], moved = held[s] - n, held[to] + n, True
                break
        if not moved:
            break
    owner = {v: s for s, x in enumerate(owned) for _, v in x}
    version = rows[0].version + 1 if rows else 1
    return slot_map.unionByName(_table(slot_map.sparkSession, [(version, v, owner[v], *size[v]) for v in sorted(owner)]))


def parts(slot_map: DataFrame) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(virtual_slot, shard, its first part, its parts, the task of its first part) of the newest map, and the number of tasks."""
    by_shard: dict[int, list] = {}
    for r in latest(slot_map).collect():  # one row for each virtual slot
        by_shard.setdefault(r.shard, []).append(r)
    out, task = [], 0
    least = sum(r.n_bytes for rows in by_shard.values() for r in rows) // MOST_PARTS
    for shard, rows in sorted(by_shard.items()):
        most = max(1, least, min(PART_BYTES, sum(r.n_bytes for r in rows) // LEAST_PARTS))
        ahead = last = 0
        for r in sorted(rows, key=lambda r: r.virtual_slot):
            first, n = ahead // most, max(1, -(-r.n_bytes // most))
            out.append((r.virtual_slot, shard, first, n, task + first))
            ahead, last = ahead + r.n_bytes, max(last, first + n)
        task += last
    return out, task


def placed(slotted: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``slotted`` with shard, part and number: the record's order within its part, with gaps before the first only."""
    rows, tasks = parts(slot_map)
    places = F.broadcast(slotted.sparkSession.createDataFrame(rows, "virtual_slot int, shard int, __first int, __parts int, __task int"))  # one row for each virtual slot
    spread = F.pmod(F.xxhash64("__hash", "__row"), F.col("__parts")).cast("int")
    dealt = slotted.join(places, "virtual_slot").withColumn("__in", spread)
    dealt = dealt.withColumns({"part": F.col("__first") + F.col("__in"), "__task": F.col("__task") + F.col("__in")})
    sent = dealt.repartitionById(max(tasks, 1), "__task").sortWithinPartitions("shard", "part", "virtual_slot", "__hash", "__row")
    return sent.withColumn("number", F.monotonically_increasing_id()).drop("__hash", "__row", "__first", "__parts", "__task", "__in")


def with_places(files: DataFrame) -> DataFrame:
    """Shard files with slot: the record's place in its shard, from 0 without gaps.

    The places of the parts are broadcast: they are at most ``MOST_PARTS`` rows and one for each slot and shard, whatever the corpus.
    """
    sizes = files.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return files.join(F.broadcast(bases), ["shard", "part"]).withColumn("slot", F.col("base") + F.col("number")).drop("base", "number")


def write_shards(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Writes ``docs`` as shard folders, dealt by version 2 of their map; returns files and map as read back."""
    slotted, narrow = with_slots(docs.drop("slot", "shard", "part", "virtual_slot", "size", "number"), slots)
    first = first_map(docs.sparkSession, shards, slots)
    slot_map = written(rebalanced(first, shards, slot_loads(narrow), slack=0.0), "slot-map")
    return with_places(written(placed(slotted, slot_map), "shards", ["shard"])), slot_map
