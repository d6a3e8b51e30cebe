"""Operator 5: language identification by nearest clustered centroid.

A text becomes the counts of its byte 2- and 3-grams (lower case, everything in ASCII but letters is a space, runs of spaces
are one), hashed to ``DIMS`` dimensions, damped by a logarithm, weighted by inverse document frequency and normalised. Each
language has several centroids, found by spherical k-means (seeded as k-means++ does, with a fixed generator) on a bounded sample of its
labelled rows (``SAMPLE`` rows in expectation, chosen by a hash of doc_id and text); clusters of single odd texts are dropped. The prediction is the language of the centroid with the largest cosine. A text that
is farther from its centroid than any sampled training text of that centroid, by a margin, is rejected.

Document frequencies are counted over all training rows. Null texts and texts without a letter are ``und`` with score 0;
so is every text if no labelled row exists. Ties go to the language and centroid that sort first. Repeated rows count in
the frequencies as often as they occur, in the sample once; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertable.llm.shared import slices

DIMS = 4096
CENTROIDS = 4
SAMPLE = 800
#: Clusters with a smaller share of their language's sample are dropped, so that no centroid is a single odd text.
LEAST_SHARE = 0.02
#: A text is rejected if its cosine is under this share of the least cosine among its centroid's training texts.
MARGIN = 0.5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SPACES = re.compile(rb"  +")


def counts(text: str) -> np.ndarray:
    """Hashed 2- and 3-gram counts of a whole text."""
    raw = b" " + _SPACES.sub(b" ", text.lower().encode().translate(_FOLD)).strip() + b" "
    out = np.zeros(DIMS, np.int64)
    step = 1 << 22
    for at in range(0, len(raw), step):  # a very long text in pieces that overlap by two bytes
        b = np.frombuffer(raw[at : at + step + 2], np.uint8).astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        for g, salt in ((two[: max(0, min(step, len(raw) - 1 - at))], 0x9E3779B1), (three[:step], 0x85EBCA77)):
            out += np.bincount((g * np.uint32(salt)) >> np.uint32(20), minlength=DIMS)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)).astype(np.float32) * idf
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS, np.int64)
    n = 0
    for batch in slices(batches, "text"):
        for t in batch.column("text").to_pylist():
            if has_letter(t):
                total += counts(t) > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array([*range(DIMS), -1]), pa.array([*total.tolist(), n])], names=["dim", "n"])


def _clusters(idf: np.ndarray, centroids: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values(["doc_id", "text"]).text
        x = np.array([vector(t, idf) for t in texts], np.float32)
        rng = np.random.default_rng(0)
        seeds = [int(rng.integers(len(x)))]
        while len(seeds) < min(centroids, len(x)):  # the farther from the seeds, the likelier
            far = np.maximum(1 - (x @ x[seeds].T).max(axis=1), 0).astype(np.float64) ** 2
            if not far.sum():
                break
            seeds.append(int(rng.choice(len(x), p=far / far.sum())))
        c = x[seeds]
        for _ in range(12):
            own = (x @ c.T).argmax(axis=1)
            c = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))], np.float32)
            c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
        sizes = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
        c = c[sizes >= min(LEAST_SHARE * len(x), sizes.max())]  # texts of a dropped cluster join their next nearest
        near = x @ c.T
        own = near.argmax(axis=1)
        floor = [float(near[own == k, k].min()) if (own == k).any() else 1.0 for k in range(len(c))]
        return pd.DataFrame({"lang": key[0], "k": range(len(c)), "centroid": [v.tobytes() for v in c], "floor": floor})

    return run


class Model:
    """Centroids, their languages and floors, and the weights of the dimensions; its size is bounded by the label set."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, floors: np.ndarray) -> None:
        self.idf, self.langs, self.centroids, self.floors = idf, langs, centroids, floors

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1) and whether the text is rejected."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        near = self.centroids @ vector(text, self.idf)
        k = int(near.argmax())
        score = min(1.0, max(0.0, float(near[k])))
        return self.langs[k], score, score < MARGIN * self.floors[k]


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from rows (doc_id, text, lang); rows with a null lang or text, or without a letter, teach nothing."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sums = {r.dim: r.n for r in rows.select("text").mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = sums.get(-1, 0)
    if not n:
        return Model(np.zeros(DIMS, np.float32), [], np.zeros((0, DIMS), np.float32), np.zeros(0))
    idf = np.log((1 + n) / (1 + np.array([sums[d] for d in range(DIMS)]))).astype(np.float32) + np.float32(0.1)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(sizes), "lang").where((place * F.col("n") < sample) & F.col("text").rlike(r"\p{L}"))
    found = picked.select("doc_id", "text", "lang").distinct().groupBy("lang").applyInPandas(_clusters(idf, centroids), "lang string, k int, centroid binary, floor double").orderBy("lang", "k").collect()
    return Model(idf, [r.lang for r in found], np.array([np.frombuffer(r.centroid, np.float32) for r in found]).reshape(len(found), DIMS), np.array([r.floor for r in found]))


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with lang_pred, score and rejected, or as ``names`` calls them; clashing columns of ``docs`` are replaced."""
    kept = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x CENTROIDS x DIMS floats
    own = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            found = [m.predict(t) for t in batch.column(text).to_pylist()]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *more], names=[*own, *names])

    out = T.StructType(list(kept.schema.fields))
    for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True):
        out = out.add(name, kind)
    return kept.mapInArrow(run, out)


def is_held_out() -> Column:
    """The fold that is never learnt from: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 3 == 1

