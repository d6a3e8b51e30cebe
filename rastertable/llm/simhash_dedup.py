"""Operator 8: near-duplicate documents by SimHash with pivot distance tables.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the document's shingle hashes (repeats included).
Two fingerprints are linked if they differ in at most ``RADIUS`` bits.

The Hamming distances to ``PIVOTS`` reference fingerprints are a fingerprint's coordinates, summed from a precomputed table for each
of its eight bytes. Linked fingerprints differ in no coordinate by more than the radius: of the pairs that meet in a cell, those
whose largest coordinate difference exceeds it are discarded, and the rest are verified bit by bit.

Coordinates alone are no index: they lie close together, so a grid over m of them needs 3 ** m cells a fingerprint to compare 0.8 ** m of all
pairs. Cells are therefore made of bit segments: the 64 bits are cut into s segments, linked fingerprints agree on at least s - 4 of
them, and each choice of s - 4 segments is a cell key, which loses no link. s grows with the number of distinct fingerprints, so
that a cell has a few by chance; the result does not depend on it. A cell gives only a spanning star of each of its local
components, so that large groups of copies stay linear, and a cell of very many fingerprints is split into pairs of blocks.

Equal fingerprints are one node. Null and empty texts have fingerprint zero and link like any other. Rows whose doc_id is null
are kept; a component's id is its least doc_id that is not null. An empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.llm.components import components, split_join
from rastertable.llm.shared import as_bytes, slices, written

RADIUS = 4
WORDS = 4
SEED = 42
PIVOTS = 16
#: Fingerprints of a cell that one block holds.
BLOCK = 1024
#: Fingerprints that share a cell by chance, at most, about.
CHANCE = 4
_SPACE = re.compile(rb"[ \t-\r]")


def word_runs(data: bytes, overlap: int, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in runs of about ``most`` bytes; a run starts with the last ``overlap`` words of the run before."""
    at, tail = 0, []
    while at < len(data):
        m = _SPACE.search(data, at + most) if at + most < len(data) else None
        end = m.end() if m else len(data)
        words = tail + data[at:end].split()
        yield words
        tail, at = words[max(0, len(words) - overlap) :] if overlap else [], end


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """SimHash of a text's word shingles; ASCII letters count as lower case."""
    digest, ones, total, few = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for run in word_runs(data.lower(), words - 1):
        few = run
        if len(run) >= words:
            h = np.array([digest(b" ".join(z), SEED) for z in zip(*(run[k:] for k in range(words)), strict=False)], "<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(h)
    if not total:
        return digest(b" ".join(few), SEED) if few else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = np.array([fingerprint(x) for x in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(found)], names=["doc_id", "row_key", "fp"])


def row_key() -> Column:
    """A row's key: a hash of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def wide_key() -> Column:
    """A row's key in 128 bits, for tables so large that two of 64 bits may be equal by chance."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "-").otherwise("+"), F.coalesce("text", F.lit("")))))


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, row_key, fp): the fingerprint of each whole text, as a signed long. ``key`` takes the place of ``row_key()``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (row_key() if key is None else key).alias("row_key"), "text")
    return rows.mapInArrow(_fingerprints, f"doc_id long, row_key {rows.schema['row_key'].dataType.simpleString()}, fp long")


def pivot_tables(pivots: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """For each byte of a fingerprint and each value of it, the Hamming distances to the pivots' bits of that byte."""
    reference = np.random.default_rng(seed).integers(0, 256, (8, 1, pivots), np.uint8)
    return np.bitwise_count(np.arange(256, dtype=np.uint8)[None, :, None] ^ reference).astype(np.int8)


_TABLES = pivot_tables()


def coordinates(fps: np.ndarray) -> np.ndarray:
    """The distances of fingerprints to the pivots, one row for each."""
    each = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return sum(_TABLES[b][each[:, b]] for b in range(8))


def segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of the bit segments for ``n`` distinct fingerprints."""
    count = RADIUS + 1
    while count < 12 and n > CHANCE << 64 * (count - RADIUS) // count:
        count += 1
    widths = [64 // count + (k < 64 % count) for k in range(count)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _cells(cut: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each fingerprint and choice of segments; a cell is the choice and the chosen bits."""
    choices = list(combinations(range(len(cut)), len(cut) - RADIUS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy()
            fps = signed.view(np.uint64)
            own = [(fps >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in cut]
            for c, picked in enumerate(choices):
                key = np.zeros(len(fps), np.uint64)
                for k in picked:
                    key = key << np.uint64(cut[k][1]) | own[k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), c, np.int32)), pa.array(key.view(np.int64)), pa.array(signed)], names=["choice", "bits", "fp"])

    return run


def local_stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) that join each component of the given distinct fingerprints."""
    n = len(fps)
    coords = coordinates(fps)
    near = np.ones((n, n), bool)
    for p in range(coords.shape[1]):
        near &= np.abs(coords[:, p][:, None] - coords[:, p][None, :]) <= RADIUS
    i, j = np.nonzero(near)
    ok = np.bitwise_count(fps[i] ^ fps[j]) <= RADIUS
    i, j, label = i[ok], j[ok], np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    member = np.flatnonzero(label != np.arange(n))
    return fps[member], fps[label[member]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by cell and block pair; a group may go on in the next batch."""
    kept: tuple[np.ndarray, np.ndarray] = (np.zeros((0, 4), np.int64), np.zeros(0, np.int64))

    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        fps = fps.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        live = np.abs(coordinates(a) - coordinates(b)).max(axis=1, initial=0) <= RADIUS
        live &= np.bitwise_count(a ^ b) <= RADIUS
        u, v = [a[live]], [b[live]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            x, y = local_stars(fps[s : s + n])
            u.append(x)
            v.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["a", "b"])

    for batch in batches:
        keys = np.column_stack([np.asarray(batch.column(c)) for c in ("choice", "bits", "i", "j")]).astype(np.int64)
        keys, fps = np.concatenate([kept[0], keys]), np.concatenate([kept[1], batch.column("fp").to_numpy()])
        if not len(keys):
            continue
        last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
        kept = (keys[last:], fps[last:])
        if last:
            yield solve(keys[:last], fps[:last])
    if len(kept[0]):
        yield solve(*kept)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that join the components of distinct fingerprints (column fp)."""
    cells = written(distinct.select("fp").mapInArrow(_cells(segments(distinct.count())), "choice int, bits long, fp long"), "cells")
    counts = cells.groupBy("choice", "bits").count().where("count > 1").select("choice", "bits", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    shared = cells.join(counts, ["choice", "bits"]).withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks"))).otherwise(0).cast("int"))
    paired = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["choice", "bits", "i", "j"]
    paired = paired.select("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return paired.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, row_key, fingerprint, component_id, root) for each row of ``docs``; root is the least fingerprint of a component."""
    prints = written(fingerprints(docs, key), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    total = nodes.count()
    roots = components(links(nodes), "a", "b")
    linked = written(roots.join(nodes.withColumnRenamed("fp", "node"), "node"), "linked")
    least = written(linked.groupBy("root").agg(F.min("least").alias("low")), "components")
    moved = split_join(linked, least, "root", "node", total).select(F.col("node").alias("fp"), "low", "root")
    named = nodes.join(moved, "fp", "left").select("fp", F.coalesce("low", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    out = split_join(prints, written(named, "named"), "fp", F.monotonically_increasing_id(), prints.count())
    return out.select("doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")
