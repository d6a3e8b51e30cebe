"""Operator 11: runs of periodic words, by an online sparse dynamic program over diagonals.

The words of a text are its maximal stretches without ASCII white space. A run is a stretch of consecutive words with smallest period q
(words q apart are identical) and length >= max(``LEAST``, ``TIMES`` * q) that no neighbouring word extends keeping period q.

Diagonal d holds the matches of word i with word i - d. The words are read once, in order: earlier occurrences of a word extend the match
lengths of the active diagonals, and a diagonal whose match ends with sufficient length emits its run at once. The program is sparse: a
diagonal is opened only where an earlier occurrence can begin a run, and none is lost by that.

* A run of period d has at least 3 d matches (``LEAST`` - 1 for d = 1). With d from 2^k up to 2^(k+1), one of the words on multiples of 2^k
  ends a block of 2^(k+1) words (``GRAM`` for d < 4) that occurs d words earlier as well.
* Only the nearest earlier occurrence of that block counts: the block and the lag together are as long as the sum of any two such lags, so
  every further one is a multiple of the block's smallest period and its stretch has that smaller period.

So a text of n words opens at most n / 2^k diagonals for each k, whatever its words are; prose without repeats opens none. The length before
the place where a diagonal was opened is found by walking back when its match ends.

Null and empty texts have no words and no runs. A text is worked off in one task, in memory that grows with its length alone; rows that are
repeated give repeated rows; a null doc_id stays null. Other columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rastertable.llm.shared import as_bytes, slices
from rastertable.llm.simhash_dedup import word_runs

LEAST = 6
TIMES = 4
#: Words of the shortest block: as long as the match of a run of period 1.
GRAM = LEAST - 1
SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_ids(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word of a text, and the distinct words by number."""
    known: dict[bytes, int] = {}
    out = array("i")
    for run in word_runs(data, 0):
        out.extend([known.setdefault(w, len(known)) for w in run])
    return np.frombuffer(out, np.int32) if out else np.zeros(0, np.int32), list(known)


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _nearest(blocks: np.ndarray) -> np.ndarray:
    """How far back the nearest equal block lies; 0 without one."""
    order = np.argsort(blocks, kind="stable")
    same = np.flatnonzero(blocks[order[1:]] == blocks[order[:-1]])
    lag = np.zeros(len(blocks), np.int64)
    lag[order[same + 1]] = order[same + 1] - order[same]
    return lag


def _repeats(ids: np.ndarray) -> bool:
    """Whether some block of ``GRAM`` words may occur twice (by hash, so that it may say so of one that does not)."""
    m = len(ids) - GRAM + 1
    if m < 2:
        return False
    key = np.zeros(m, np.uint64)
    for k in range(GRAM):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m].astype(np.uint64)
    key.sort()
    return bool((key[1:] == key[:-1]).any())


def openings(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(word, lag, block): where diagonals are opened, by word; the block of so many words that ends there occurs ``lag`` words earlier."""
    if not _repeats(ids):
        return []
    n, one = len(ids), ids.astype(np.int64)
    two = _ranks(one[:-1], one[1:])
    four = _ranks(two[:-2], two[2:])
    blocks, width, level, out = _ranks(four[: n - GRAM + 1], one[GRAM - 1 :]), GRAM, 0, []
    while TIMES << level <= n:
        lag = _nearest(blocks)
        if not lag.any():
            break
        for k in (0, 1) if width == GRAM else (level,):
            ends = np.arange(len(lag)) + width - 1
            at = np.flatnonzero((lag >= 1 << k) & (lag < 2 << k) & (lag <= n // TIMES) & (ends % (1 << k) == 0))
            out += zip(ends[at].tolist(), lag[at].tolist(), [width] * len(at), strict=True)
        if width == GRAM:
            blocks, width, level = _ranks(four[:-4], four[4:]) if n >= 8 else four[:0], 8, 2
        else:
            blocks, width, level = _ranks(blocks[:-width], blocks[width:]), 2 * width, level + 1
    return sorted(out)


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    events, n = openings(ids), len(ids)
    if not events:
        return []
    words = ids.tolist()
    active: dict[int, int] = {}  # the first match of each open diagonal, as far as known
    out: list[tuple[int, int, int]] = []

    def close(d: int, end: int) -> None:
        """Emits the run of a diagonal that matches up to ``end`` (left out), if it is long enough."""
        first = active.pop(d)
        while first > d and words[first - 1] == words[first - 1 - d]:
            first -= 1
        if end - first + d >= max(LEAST, TIMES * d):
            out.append((first - d, end - first + d, d))

    at, k = events[0][0], 0
    while k < len(events) or active:
        if not active:
            at = events[k][0]
        for d in [d for d in active if at >= n or words[at] != words[at - d]]:
            close(d, at)
        while k < len(events) and events[k][0] == at:
            active.setdefault(events[k][1], at - events[k][2] + 1)
            k += 1
        at += 1
    return sorted(out)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for each word that stays when every run is collapsed to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def collapsed_bytes(ids: np.ndarray, vocabulary: list[bytes], runs: list[tuple[int, int, int]], step: int = 1 << 16) -> Iterator[bytes]:
    """The words that stay, joined by one space, in pieces."""
    stay = ids[kept_words(len(ids), runs)] if runs else ids
    for k in range(0, len(stay), step):
        yield (b" " if k else b"") + b" ".join([vocabulary[w] for w in stay[k : k + step].tolist()])


def repeated_tail(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of a text as the query asks for them: those of every tenth document (by crc32 of doc_id) repeat from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(ids)
    g = h // 10
    if h % 10 or not n:
        return ids
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def _digest(prepare: Callable[[np.ndarray, int | None], np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                ids, vocabulary = word_ids(data)
                ids = prepare(ids, doc_id) if prepare else ids
                runs = find_runs(ids)
                digest = hashlib.sha256()
                for piece in collapsed_bytes(ids, vocabulary, runs):
                    digest.update(piece)
                best = min(((-length, start, q) for start, length, q in runs), default=None)
                top = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                rows.append((doc_id, len(ids), len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), digest.hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    return run


def run_digests(docs: DataFrame, prepare: Callable[[np.ndarray, int | None], np.ndarray] | None = None) -> DataFrame:
    """One row for each row of ``docs``: number of runs, the longest, and hashes of the list of runs and of the collapsed text.

    ``prepare`` changes the word numbers of a text beforehand.
    """
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(_digest(prepare), SCHEMA)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts, listed = [], []
        for data in as_bytes(batch.column("text")):
            ids, vocabulary = word_ids(data)
            runs = find_runs(ids)
            texts.append(b"".join(collapsed_bytes(ids, vocabulary, runs)))
            listed.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        arrays = [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(listed, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "collapsed", "runs"])


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, collapsed, runs): each text with every run cut to its first period, and the runs."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(_collapse, "doc_id long, collapsed string, runs array<struct<start:long,length:long,period:long>>")
