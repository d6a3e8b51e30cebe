"""Operator 13: near-duplicate documents by MinHash, banding, signature verification and exact confirmation.

A document's set is the set of its distinct ``WORDS``-word shingles, ASCII letters in lower case (fewer words: the whole sequence as one; no
words: empty). Documents are linked if the intersection of their sets is at least ``LINK`` of the union; empty sets are linked with nothing.

1. Each set gets ``BANDS`` * ``ROWS`` minima of universal hash functions. Documents with equal sets (128-bit hash) are one node.
2. Nodes that agree on all minima of a band meet. In each band each node is paired with the least node it meets, its centre, so that a group
   of copies stays linear. Pairs whose signatures agree in fewer than ``CUT`` minima are dropped; the rest are confirmed on full sets,
   rebuilt from the texts of those documents alone.
3. Confirmed links are joined to components by alternating large-star and small-star. Nodes that meet in a band and are not yet in one
   component are then compared with each other, not only with the centre: by signature in blocks, then on full sets.

A pair at exactly 0.8 misses all bands with probability 7e-6 (``ROWS`` 5, ``BANDS`` 30), one at 0.9 with 3e-12; nothing else loses a link. A link
between copies is known by their one node. Shingles are 64-bit hashes.

Null and empty texts have no shingles and are their own component. Rows with a null doc_id are kept; a component's id is its least doc_id
that is not null; such a row is ``kept`` only if its component has no other id. Repeated rows are rows like any other. An empty table gives
an empty result; other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.llm.components import components, split_join
from rastertable.llm.shared import as_bytes, slices, written
from rastertable.llm.simhash_dedup import row_key, word_runs

WORDS = 2
#: 100 * intersection >= LINK * union.
LINK = 80
ROWS = 5
BANDS = 30
#: Equal minima, of ``ROWS`` * ``BANDS``, below which a pair is dropped: at similarity 0.8 more than eight standard deviations below the mean.
CUT = 80
#: Pairs of a centre, and nodes of a band, that one block holds.
BLOCK = 256
_A, _B = np.random.default_rng(13).integers(0, 1 << 64, (2, 1, ROWS * BANDS), np.uint64)
_A |= np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    known: dict[bytes, int] = {}
    digest, parts, few = xxhash.xxh64_intdigest, [], []
    for run in word_runs(data.lower(), WORDS - 1):
        few = run
        for w in set(run):
            if w not in known:
                known[w] = digest(w)
        h = np.array([known[w] for w in run], np.uint64)
        if len(h) >= WORDS:
            key = np.zeros(len(h) - WORDS + 1, np.uint64)
            for k in range(WORDS):
                key = _mixed(key + h[k : k + len(key)] + np.uint64(k + 1))
            parts.append(np.unique(key))
    if parts:
        return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
    return np.array([digest(b" ".join(few))] if few else [], np.uint64)


def signature(shingles: np.ndarray, step: int = 2048) -> np.ndarray:
    """The minima of multiply-add-shift hashes of a set that is not empty."""
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), step):
        x = (shingles[k : k + step, None] >> np.uint64(32)) * _A
        x += _B
        np.minimum(low, x.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def set_hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sizes, keys, minima = [], [], []
        for data in as_bytes(batch.column("text")):
            own = shingle_set(data)
            sizes.append(len(own))
            keys.append(set_hash(own) if len(own) else None)
            minima.append(signature(own).tobytes() if len(own) else None)
        arrays = [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row_key", "n_shingles", "set", "minima"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_shingles, set, minima) of each row; set is a hash of the shingle set, null for the empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    return rows.mapInArrow(_signatures, "doc_id long, row_key long, n_shingles long, set binary, minima binary")


def cells(nodes: DataFrame) -> DataFrame:
    """(cell, node, centre) of nodes that meet another in a band; a cell is a hash of the band's minima, with the band in its last five bits."""
    band = lambda b: F.xxhash64(F.lit(b), F.substring("minima", 4 * ROWS * b + 1, 4 * ROWS)).bitwiseAND(-32).bitwiseOR(F.lit(b))
    dealt = nodes.select("node", F.explode(F.array(*[band(b) for b in range(BANDS)])).alias("cell"))
    met = written(dealt.groupBy("cell").agg(F.min("node").alias("centre"), F.count("*").alias("__n")).where("__n > 1"), "cells")
    total = met.agg(F.sum("__n")).first()[0] or 0
    return written(split_join(dealt, met.select("cell", "centre"), "cell", "node", total, met.select("cell", "__n")), "met")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        own = [shingle_set(x) for x in as_bytes(batch.column("text"))]
        right = np.array([set_hash(x) == y for x, y in zip(own, batch.column("set").to_pylist(), strict=True)], bool)  # rows that share a row_key by chance
        arrays = [batch.column("node"), batch.column("minima"), pa.array([x.tobytes() for x in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["node", "minima", "shingles"]).filter(pa.array(right))


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, minima, shingles) of each node, from the text of one of its rows."""
    rows = docs.select(row_key().alias("row_key"), "text").join(nodes.select("row_key", "node", "set", "minima"), "row_key")
    found = rows.dropDuplicates(["row_key", "node"]).select("node", "set", "minima", "text").mapInArrow(_sets, "node long, minima binary, shingles binary")
    return written(found.dropDuplicates(["node"]), "sets")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < LINK * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int(np.count_nonzero(a[at] == b))
    return 100 * common >= LINK * (both - common)


def _beside_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by centre and part, the centre's own row (b null) first; it may be in an earlier batch than its partners."""
    centre, minima, shingles = None, np.zeros(0, "<u4"), np.zeros(0, np.uint64)
    for batch in batches:
        found: list[tuple[int, int]] = []
        for a, b, m, s in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "minima", "shingles")), strict=True):
            if b is None:
                centre, minima, shingles = a, np.frombuffer(m, "<u4"), np.frombuffer(s, np.uint64)
            elif a == centre and np.count_nonzero(minima == np.frombuffer(m, "<u4")) >= CUT and linked(shingles, np.frombuffer(s, np.uint64)):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def centre_links(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the confirmed links between nodes and the centres of their cells. The partners of a centre are dealt to parts of ``BLOCK``."""
    pairs = written(met.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    counts = written(pairs.groupBy("a").agg(F.count("*").alias("__n")).withColumn("parts", F.ceil(F.col("__n") / BLOCK).cast("int")), "centres")
    dealt = split_join(pairs, counts.select("a", "parts"), "a", "b", pairs.count(), counts.select("a", "__n"))
    tails = dealt.withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).join(sets.withColumnRenamed("node", "b"), "b")
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.withColumnRenamed("node", "a"), "a")
    columns = ["a", "part", "b", "minima", "shingles"]
    rows = tails.select(*columns).union(heads.withColumn("b", F.lit(None).cast("long")).select(*columns))
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(_beside_centre, "a long, b long")


def block_links(band: int, nodes: list[int], roots: list[int], first: np.ndarray, minima: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Confirmed links between nodes of different components that join them; ``first`` tells the rows of the first of two blocks.

    A pair is looked at in the first band that it shares; a pair of one component, known or found here, is not looked at.
    """
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    label = np.array([number[r] for r in roots])
    out = []
    two = bool(first.any() and not first.all())
    for x in np.flatnonzero(first) if two else range(len(nodes)):
        others = np.flatnonzero((~first if two else np.arange(len(nodes)) > x) & (label != label[x]))
        same = minima[others] == minima[x]
        shared = same.reshape(len(others), BANDS, ROWS).all(axis=2)
        live = (same.sum(axis=1) >= CUT) & (shared.argmax(axis=1) == band)
        for y in others[live]:
            if label[x] != label[y] and linked(sets[x], sets[y]):
                out.append((nodes[x], nodes[y]))
                label[label == label[y]] = label[x]
    return out


def _within_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell and pair of blocks; such a group goes on in later batches."""
    names = ("cell", "i", "j", "own", "node", "root", "minima", "shingles")
    key, held = None, []

    def solve() -> pa.RecordBatch:
        found = []
        if held:
            own, nodes, roots, minima, sets = zip(*held, strict=True)
            first = np.array(own) == key[1]
            found = block_links(key[0] & 31, list(nodes), list(roots), first, np.array([np.frombuffer(m, "<u4") for m in minima]), [np.frombuffer(s, np.uint64) for s in sets])
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for cell, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if (cell, i, j) != key:
                yield solve()
                key, held = (cell, i, j), []
            held.append(rest)
    yield solve()


def cell_links(met: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): confirmed links that join nodes of one cell which ``known`` (node, root) has in different components, block by block.

    Nodes of the cell's largest component are not compared with each other: they meet the blocks of the others alone.
    """
    rest = met.where("node <> centre").select("cell", "node").join(known, "node", "left").select("cell", "node", F.coalesce("root", "node").alias("root"))
    groups = rest.groupBy("cell", "root").agg(F.count("*").alias("n"))
    apart = groups.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("cell", F.col("m.root").alias("most"))
    rows = written(rest.join(apart, "cell").withColumn("stray", F.expr("root <> most")).drop("most").join(sets, "node"), "open_cells")
    size = F.octet_length("shingles") + F.octet_length("minima")
    blocks = lambda side: F.greatest(F.ceil(F.count_if(side) / BLOCK), F.ceil(F.sum(F.when(side, size).otherwise(0)) / (8 << 20))).cast("int")
    counts = rows.groupBy("cell").agg(blocks(F.col("stray")).alias("strays"), blocks(~F.col("stray")).alias("others"))
    own = F.expr("IF(stray, pmod(xxhash64(node), strays), strays + pmod(xxhash64(node), others))").cast("int")
    dealt = rows.join(counts, "cell").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, IF(stray, strays + others, strays) - 1)")))
    place = ["cell", "i", "j"]
    dealt = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "minima", "shingles")
    return dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(_within_cells, "a long, b long")


def node_roots(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a link."""
    met = cells(nodes)
    wanted = met.select("node").distinct()
    sets = full_sets(docs, nodes.join(wanted, "node", "left_semi"))
    known = written(components(centre_links(met, sets), "a", "b"), "known")
    more = written(cell_links(met, sets, known), "cell_links")
    if more.isEmpty():
        return known
    root = lambda side: known.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    edges = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = written(components(edges, "a", "b"), "joined").selectExpr("node AS root", "root AS last")
    outer = known.join(joined, "root", "full").select(F.coalesce("node", "root").alias("node"), F.coalesce("last", "root").alias("root"))
    return outer.groupBy("node").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    prints = written(signatures(docs), "signatures")
    nodes = prints.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.first("minima").alias("minima"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = nodes.select("node", "set", "least").join(node_roots(docs, nodes), "node", "left").select("set", "least", F.coalesce("root", "node").alias("root"))
    named = written(named, "named")
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = written(split_join(named, low, "root", "set", named.count()).select("set", "component_id"), "component_of_set")
    full = split_join(prints.where("n_shingles > 0").select("doc_id", "n_shingles", "set"), of_set, "set", F.monotonically_increasing_id(), prints.count())
    alone = prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
