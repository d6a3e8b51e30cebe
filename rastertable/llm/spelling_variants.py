"""Operator 12: spelling variants of words, found by asymmetric q-chunks.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Of a pair, the longer word (of equal ones, the
smaller) contributes two disjoint chunks, its halves; the other contributes its positional grams of the chunks' lengths. One edit leaves one chunk
whole, and the other word has it at the same place or one place earlier, so only grams within that shift are made. Pairs that share a chunk
are verified. The edit is placed at the first difference, so that a pair that shares both chunks is verified for one of them alone.

Some chunks are very frequent. A key under which the pairs would be more than ``DENSE`` for each of its rows is not joined: its words are cut
once more, the half that may hold the edit into two chunks, and so on down to single letters. No pair is lost or met twice.

Words that are null do not occur; empty tables give empty results; other columns pass by.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.llm.shared import as_bytes, slices, written
from rastertable.llm.simhash_dedup import word_runs

SHORTEST = 5
LEAST = 3
#: A form is at least so many times as frequent as the word.
TIMES = 2
#: Of one in so many different words of each document a letter is left out.
DROPPED = 97
#: Pairs for each row of a key, at most; beyond that its words are cut further.
DENSE = 16
#: Different words that a task holds before it passes their counts on.
HELD = 300_000
#: Letters A-Z, a-z and U+00C0 to U+00FF, in UTF-8 and after lower-casing of A-Z.
_WORD = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")


def document_words(doc_id: int | None, data: bytes, into: Counter[bytes]) -> None:
    """Adds the words of a text to ``into``; a word loses a letter where the crc32 of doc_id (null: none) and word says so."""
    begin = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    begin, crc = zlib.crc32(b":", begin), zlib.crc32
    for run in word_runs(data.lower(), 0):
        words = _WORD.findall(b" ".join(run))
        into.update(words)
        for w in [w for w in set(words) if not crc(w, begin) % DROPPED]:
            times, text = words.count(w), w.decode()
            k = crc(w, begin) % len(text)
            into[w] -= times
            into[(text[:k] + text[k + 1 :]).encode()] += times


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def batch_of() -> Iterator[pa.RecordBatch]:
        words = [w for w, n in held.items() if n]
        for k in range(0, len(words), 1 << 16):
            part = words[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])
        held.clear()

    for batch in batches:
        for part in slices([batch], "text", 1 << 20):
            for doc_id, data in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                document_words(doc_id, data, held)
            if len(held) > HELD:
                yield from batch_of()
    yield from batch_of()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least ``SHORTEST`` code points that occur at least ``LEAST`` times in all texts together."""
    each = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(_count, "word string, n long")
    return each.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


#: The chunk key of a row: the word without the stretch from ``lo`` to ``hi`` of the longer word, which holds the edit.
_KEY = "concat(left(word, lo), '|', substring(word, hi + 1 - (size - char_length(word))))"


def _entries(words: DataFrame) -> DataFrame:
    """Two chunk rows (size = own length) and the gram rows that may meet one (as the other word, of a word of its length or one more)."""
    roles = "explode(array(struct(true AS chunk, char_length(word) AS size), struct(false AS chunk, char_length(word) AS size), struct(false AS chunk, char_length(word) + 1 AS size))) AS r"
    return _halved(words.selectExpr("word", "n", roles).selectExpr("word", "n", "r.chunk", "r.size", "0 AS lo", "r.size AS hi"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row for both halves of the stretch that may hold the edit."""
    halves = "explode(array(struct(lo AS lo, (lo + hi) DIV 2 AS hi), struct((lo + hi) DIV 2 AS lo, hi AS hi))) AS w"
    cut = rows.selectExpr("word", "n", "chunk", "size", halves).where("w.hi > w.lo")
    return cut.selectExpr("word", "n", "chunk", "size", "CAST(w.lo AS INT) AS lo", "CAST(w.hi AS INT) AS hi").withColumn("key", F.expr(_KEY))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of near words once; ``words`` has (word, n), each word once."""
    rows, found = _entries(words), []
    place = ["size", "lo", "key"]
    while True:
        counts = rows.groupBy(*place).agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        counts = written(counts.where("chunks > 0 AND grams > 0 AND chunks * grams > 1").withColumn("dense", F.expr(f"open > 1 AND chunks * grams > {DENSE} * (chunks + grams)")), "chunk_counts")
        thin = rows.join(counts.where("NOT dense").select(*place), place, "left_semi")
        a = thin.where("chunk").select(*place, "hi", "word", "n")
        b = thin.where("NOT chunk").select(*place, F.col("word").alias("other"), F.col("n").alias("other_n"))
        pairs = a.join(b, place).where("left(word, hi) <> left(other, hi) AND (char_length(other) < size OR word < other) AND levenshtein(word, other, 1) = 1")
        found.append(written(pairs.select("word", "n", "other", "other_n"), "near_pairs"))
        dense = counts.where("dense").select(*place)
        if dense.isEmpty():
            break
        rows = written(_halved(rows.join(dense, place, "left_semi")), "chunks")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of ``forms`` (word, form): the end of the path from word to form to form. Paths must end."""
    at = written(forms.selectExpr("word", "form AS root"), "roots")
    while True:
        ahead = at.selectExpr("word AS root", "root AS next")
        moved = written(at.join(ahead, "root", "left").selectExpr("word", "coalesce(next, root) AS root", "next IS NOT NULL AS moved"), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n).

    form is the most frequent near word (ties: the smallest) if it is at least ``TIMES`` as frequent, root the end of the path of forms.
    """
    pairs = near_pairs(words)
    both = pairs.union(pairs.select(F.col("other"), F.col("other_n"), F.col("word"), F.col("n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    named = words.join(best, "word", "left").selectExpr("word", "n", "coalesce(n_near, 0L) AS n_near", f"-best.less >= {TIMES} * n AS has_form", "best")
    named = written(named.selectExpr("word", "n", "n_near", "IF(has_form, best.other, NULL) AS form", "IF(has_form, -best.less, NULL) AS form_n"), "forms")
    ends = roots(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(ends, "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of all words of the texts of ``docs``; null texts have none."""
    return variants(written(word_counts(docs), "words"))
