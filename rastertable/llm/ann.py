"""Operator 9: approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and the residual codebooks are fitted on a bounded sample (``SAMPLE`` vectors in expectation, chosen by a
hash); the number of lists is the square root of the number of vectors, up to what the sample can fit (``LIST_SAMPLE`` vectors a
list). Every vector is indexed: its cell, one byte for each subspace of its residual and the norm of what the code leaves out.
A query looks into its nearest cells, as many as hold ``TARGET`` of the true neighbours of trial queries in the sample: few where the
vectors form clusters, most where they are spread evenly.

A query and a cell meet by a join on the cell. Asymmetric distance tables are summed over the cell's codes; a code's distance is
off by the norm at most, so a vector is discarded only if its least possible distance is above the k-th smallest of the
largest possible ones, or above the k-th distance that the query found in its nearest cell. All others are ranked by the exact
distance in double precision, so within the probed cells nothing is lost, also not among many near copies of one code. Vectors
travel to their cell once; a cell of more than ``ROWS`` vectors is split, and queries stream past the vectors of a block.

Vectors that are null, zero, of another length than most of the table, or with null or non-finite components take no part, nor
do null ids. Queries of one id are one query (the least vector if they differ); table rows are candidates each, also equal
ones. Ties go to the smaller vec_id. A query's own id is no candidate. With fewer candidates than asked for, all are given.
Other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastertable.llm.shared import slices, written

SAMPLE = 16_384
#: Sample vectors for each list, at least.
LIST_SAMPLE = 16
#: Share of the trial queries' neighbours that the probed cells must hold.
TARGET, TRIALS = 0.98, 512
SUBSPACES = 16
CODES = 256
#: Index rows of a cell that one block holds, about, and queries that are compared with them at once.
ROWS, QUERIES = 8192, 64


def finite(table: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v) with double components, without vectors that are null, zero or hold null or non-finite components."""
    v = F.transform(vec, lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(good & F.exists("v", lambda x: x != 0))


def of_usual_length(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows as long as most vectors of ``table``; of equally frequent lengths the longer one counts."""
    lengths = table.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    most = lengths.agg(F.max_by("n", F.struct("rows", "n")).alias("dims"))
    return rows.join(F.broadcast(most), F.size("v") == F.col("dims")).drop("dims")  # one row


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(rounds):
        own = _nearest(x, c, 1)[:, 0]
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest of ``c``, nearest first."""
    out = []
    for at in range(0, len(x), 4096):
        d = (c * c).sum(axis=1)[None, :] - 2 * x[at : at + 4096] @ c.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k] if k > 1 else d.argmin(axis=1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


class Quantiser:
    """Coarse centroids, the codebooks of the residuals' subspaces and the number of cells that a query probes."""

    def __init__(self, x: np.ndarray, lists: int, k: int = 10) -> None:
        self.coarse = _kmeans(x, lists, 10, 1)
        cell = _nearest(x, self.coarse, 1)[:, 0]
        residual = x - self.coarse[cell]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.books = [_kmeans(residual[:, cut], CODES, 8, 2 + m) for m, cut in enumerate(self.cuts)]
        self.probes = self._calibrated(x, cell, k)

    def _calibrated(self, x: np.ndarray, cell: np.ndarray, k: int) -> int:
        """Cells that hold ``TARGET`` of the ``k`` nearest sample vectors of trial queries from the sample."""
        trial = np.random.default_rng(0).permutation(len(x))[:TRIALS]
        near = _nearest(x[trial], x, k + 1)
        place = np.argsort(_nearest(x[trial], self.coarse, len(self.coarse)), axis=1, kind="stable")
        ranks = np.take_along_axis(place, cell[near], axis=1)[near != trial[:, None]]
        return int(np.quantile(ranks, TARGET, method="higher")) + 1 if len(ranks) else len(self.coarse)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes and the norms of the residuals' quantisation errors."""
        cell = _nearest(x, self.coarse, 1)[:, 0]
        r = x - self.coarse[cell]
        codes = np.column_stack([_nearest(r[:, cut], book, 1)[:, 0] for cut, book in zip(self.cuts, self.books, strict=True)]).astype(np.uint8)
        lost = sum(((r[:, cut] - book[codes[:, m]]) ** 2).sum(axis=1) for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)))
        return cell, codes, np.sqrt(lost)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of each query to each code of one cell."""
        r = queries - self.coarse[cell]
        out = np.zeros((len(queries), len(codes)))
        for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = ((r[:, cut][:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            out += table[:, codes[:, m]]
        return out


def fit(rows: DataFrame, k: int = 10, sample: int = SAMPLE) -> Quantiser | None:
    """Fits on a sample of ``rows`` in one task; None without rows. The sample and the result are bounded."""
    n = rows.count()
    lists = max(1, min(isqrt(n), sample // LIST_SAMPLE))
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(place * n < sample).select("vec_id", "v").distinct().withColumn("all", F.lit(0))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        return pd.DataFrame({"model": [pickle.dumps(Quantiser(np.array(part.v.tolist(), np.float64), lists, k))]})

    made = picked.groupBy("all").applyInPandas(run, "model binary").collect()
    return pickle.loads(bytes(made[0].model)) if made else None


class Block:
    """The vectors of one cell, or a part of them."""

    def __init__(self, model: Quantiser, cell: int, parts: list[pa.RecordBatch], k: int) -> None:
        column = lambda name: pa.chunked_array([p.column(name) for p in parts])
        self.model, self.cell, self.k = model, cell, k
        self.ids, self.lost = column("id").to_numpy(), column("lost").to_numpy()
        self.codes = np.frombuffer(b"".join(column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.x = np.frombuffer(b"".join(column("raw").to_pylist()), np.float64).reshape(len(self.ids), -1)

    def near(self, asked: np.ndarray, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score): the ``k`` nearest of the block for each query, none of them beyond the query's bound."""
        d = np.sqrt(self.model.distances(q, self.cell, self.codes))
        slack = 1e-9 * (d + self.lost + np.abs(q).sum(axis=1)[:, None])  # far above the rounding of the sums
        own = asked[:, None] == self.ids[None, :]
        d[own] = np.inf
        if self.k <= d.shape[1]:
            bound = np.minimum(bound, np.partition(d + self.lost + slack, self.k - 1, axis=1)[:, self.k - 1])
        row, col = np.nonzero((d - self.lost - slack <= bound[:, None]) & ~own)
        score = np.concatenate([np.zeros(0), *(np.sqrt(((self.x[col[at : at + 4096]] - q[row[at : at + 4096]]) ** 2).sum(axis=1)) for at in range(0, len(row), 4096))])
        order = np.lexsort((self.ids[col], score, row))
        row, col, score = row[order], col[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        best = nth < self.k
        return asked[row[best]], self.ids[col[best]], score[best]


def search(table: DataFrame, queries: DataFrame, k: int = 10, vec: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``table`` for each id of ``queries``; ``probes`` overrides the fitted number."""
    spark = table.sparkSession
    rows = of_usual_length(finite(table, vec), finite(table, vec))
    model = fit(rows, max(k, 1)) if k > 0 else None
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(model)  # SAMPLE and CODES bound its size

    def vectors(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = vectors(b.column("v"))
                cell, codes, lost = shared.value.encode(x)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype(np.int64)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "cell", "code", "lost", "raw"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each query and probed cell, in slices of queries."""
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                part = b.slice(at, QUERIES)
                x = vectors(part.column("v"))
                cells = _nearest(x, shared.value.coarse, min(probes or shared.value.probes, len(shared.value.coarse)))
                n = cells.shape[1]
                cols = [pa.array(np.repeat(part.column("vec_id").to_numpy(), n)), pa.array(cells.ravel().astype(np.int64)), pa.array(np.tile(np.arange(n), len(x))), pa.array([raw for v in x for raw in [v.tobytes()] * n], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "cell", "nth", "raw"])

    index = written(rows.mapInArrow(encode, "id long, cell long, code binary, lost double, raw binary"), "ann-index")
    asked = of_usual_length(finite(queries, vec), finite(table, vec)).groupBy("vec_id").agg(F.min("v").alias("v"))
    probed = written(asked.mapInArrow(probe, "id long, cell long, nth long, raw binary"), "ann-probes")
    blocks = written(index.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks")), "ann-blocks")  # one row for each list

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by cell and block, vectors before queries."""
        held: list[pa.RecordBatch] = []
        block, of = None, None
        for b in slices(batches, "raw"):
            keys = np.column_stack([b.column(c).to_numpy() for c in ("cell", "block", "query")])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                cell, part, query = keys[lo].tolist()
                if (cell, part) != of:
                    held, block, of = [], None, (cell, part)
                if not query:
                    held.append(b.slice(lo, hi - lo))
                    continue
                if block is None:
                    block = Block(shared.value, cell, held, k)
                for at in range(lo, hi, QUERIES):
                    some = b.slice(at, min(QUERIES, hi - at))
                    q = np.frombuffer(b"".join(some.column("raw").to_pylist()), np.float64).reshape(some.num_rows, -1)
                    found = block.near(some.column("id").to_numpy(), q, some.column("lost").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    def met(some: DataFrame) -> DataFrame:
        """What queries (id, cell, raw, and their bound as ``lost``) find in their cells; cells of a block number meet in one task."""
        few = F.broadcast(blocks)
        vector = index.join(few, "cell").select("cell", F.pmod(F.xxhash64("id", "raw"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("query"), "id", "code", "lost", "raw")
        query = some.join(few, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "id", F.lit(None).cast("binary").alias("code"), "lost", "raw")
        dealt = vector.unionByName(query).repartition("cell", "block").sortWithinPartitions("cell", "block", "query")
        return dealt.mapInArrow(scan, "query_id long, vec_id long, score double")

    endless = F.lit(float("inf"))
    first = written(met(probed.where("nth = 0").withColumn("lost", endless)), "ann-first")
    bounds = first.groupBy(F.col("query_id").alias("q")).agg(F.when(F.count("*") >= k, F.max("score")).alias("bound"))
    rest = probed.where("nth > 0").join(bounds, F.col("id") == F.col("q"), "left").withColumn("lost", F.coalesce("bound", endless))
    scored = first.unionByName(met(rest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
