r"""Operator 10: benchmark decontamination by SimHash of item-sized windows.

Words are lower case, with ASCII punctuation as space. Every window of an item's size is fingerprinted with 64 bits: a bit is 1 if it
is set in over half of the hashes of the window's words, counted per window from running sums. Windows have exactly the item's
number of words up to 31 words; above, the five leading bits of the number are kept, which is within 1/16 of it, and the item is
known by its first and its last window of that size.

The fingerprints are cut into four blocks of 16 bits. A window whose fingerprint is within ``RADIUS`` = 7 bits of an item's has a block
within one bit (7 = 4 x 1 + 3), so each block table holds the item's block and its 16 neighbours: no window within the radius
is missed. A candidate gives a place for the whole item, and there the exact weighted similarity decides: the share of the
item's weight (its five-word shingles, repeats included, the rarer among items the heavier; all words at once for shorter items) that the document's item-sized passage holds, 0.8 or more.

Passages with many edits are out of the fingerprints' reach. Each item is therefore also known by its heaviest shingles that
hold more than 0.2 of its weight together (anchors): a passage of 0.8 has one of them at least. Around each anchor that a
document holds, every item-sized passage with the anchor is weighed, so no passage of 0.8 or more is missed. Neighbouring
places of an item are weighed together from running counts, once for each run of places, so the work is linear in the text.

A text is scanned in steps that overlap by the longest item, whatever its length, so every item-sized passage lies whole in a
step. Null and empty texts match nothing, nor do items without words; items with a null item_id are items like any other.
Repeated rows and repeated items each give their rows. How many items hold a shingle is counted over the whole benchmark beforehand.
Items are held by each task in blocks of at most ``ITEM_WORDS`` words (and one item), in the order of item_id and text; a larger benchmark
is taken block by block, and the matches do not depend on the blocks. Other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.llm.components import split_join
from rastertable.llm.shared import as_bytes, slices, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 7
#: Leading bits of an item's number of words that its window size keeps.
SIZE_BITS = 5
ITEM_WORDS = 500_000
#: Bytes that one step of the window scan holds, about; more if the longest item needs it.
STEP = 1 << 19
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Multiplier of the words' polynomial hashes and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class _Powers:
    """Powers of the multiplier and of its inverse, kept for each worker and grown when needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a folded text: each word's bytes as a polynomial, from running sums, mixed."""
    raw = np.frombuffer(folded, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = raw != 32
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return starts, ends, h ^ h >> np.uint64(33)


def window_size(n: int) -> int:
    """The window size of an item of ``n`` words."""
    low = max(0, n.bit_length() - SIZE_BITS)
    return n >> low << low


def window_prints(hashes: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size > 255:
        return _wide_prints(hashes, size)
    sums = lane_sums(hashes) if sums is None else sums
    out, count = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    #: A lane's high bit is set if its count plus this is 128 or more: for counts over half the size. No lane passes 255.
    more = _ONES * np.uint64(127 - size // 2)
    for k in range(8):
        np.subtract(sums[k, size:], sums[k, :-size], out=count)
        np.add(count, more, out=count)
        np.bitwise_and(count, _TOPS, out=count)
        np.right_shift(out, np.uint64(1), out=out)
        np.bitwise_or(out, count, out=out)
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _wide_prints(hashes: np.ndarray, size: int, piece: int = 1 << 13) -> np.ndarray:
    """Fingerprints of large windows, in pieces, by the bits that come in and go out."""
    n = len(hashes) - size + 1
    count = sum((_bits(hashes[at : min(at + piece, size)]).sum(axis=0, dtype=np.int64) for at in range(0, size, piece)), np.zeros(64, np.int64))
    out = []
    for at in range(0, n, piece):
        end = min(at + piece, n)
        change = _bits(hashes[at + size : end + size]).astype(np.int32)
        change -= _bits(hashes[at : at + len(change)])
        run = np.zeros((end - at + 1, 64), np.int64)
        np.cumsum(change, axis=0, out=run[1 : len(change) + 1])
        out.append(np.packbits((run[: end - at] + count) * 2 > size, axis=1, bitorder="little").view("<u8").ravel())
        count = count + run[end - at]
    return np.concatenate(out)


def lane_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the hashes' bits: row k has the bits 8 lane + k, each lane a byte, modulo 2^64."""
    run = np.zeros((8, len(hashes) + 1), np.uint64)
    for k in range(8):
        np.cumsum((hashes >> np.uint64(k)) & _ONES, out=run[k, 1:])
    return run


def shingles(words: list[bytes]) -> Counter:
    if len(words) < SHINGLE:
        return Counter([b" ".join(words)] if words else [])
    return Counter(b" ".join(z) for z in zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words from the words' hashes; they depend on the order."""
    n = max(0, len(hashes) - size + 1)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_BASE)
        out += hashes[k : k + n]
    return out


class ItemIndex:
    """Block tables of item fingerprints by window size, each item's weighted shingles and its anchors."""

    def __init__(self, items: list[tuple[int | None, bytes]], holders: list[list[int]] | None = None, total: int | None = None) -> None:
        """``holders``: for each item how many of the benchmark's ``total`` items hold each of its shingles, in the order in which
        they first occur; without it the given items are the whole benchmark."""
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.longest = max(map(len, self.words), default=0)
        own = [shingles(w) for w in self.words]
        if holders is None:
            seen = Counter(s for c in own for s in c)
            holders, total = [[seen[s] for s in c] for c in own], len(items)
        self.weights = [{s: n * (1 + log(total / k)) for (s, n), k in zip(c.items(), each, strict=True)} for c, each in zip(own, holders, strict=True)]
        self.counts = own
        self.totals = [sum(w.values()) for w in self.weights]
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        known: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
        anchors: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (w, weights) in enumerate(zip(self.words, self.weights, strict=True)):
            names = list(weights)
            n = min(SHINGLE, len(w))
            hashes = [int(gram_hashes(word_hashes(s)[2], n)[0]) for s in names]
            order = np.argsort(np.array(hashes, np.uint64))
            keys = np.array(hashes, np.uint64)[order]
            counts = np.array([own[k][s] for s in names], np.int64)[order]
            each = np.array([weights[s] for s in names])[order] / np.maximum(counts, 1)
            self.grams.append((keys, counts, each))
            if w:
                size = window_size(len(w))
                prints = window_prints(word_hashes(b" ".join(w))[2], size)
                for at in {0, len(w) - size}:
                    known[size].add((int(prints[at]), k, at))
                held = 0.0
                for x in sorted(range(len(names)), key=lambda x: (-weights[names[x]], names[x])):
                    anchors[n][hashes[x]].append(k)
                    held += weights[names[x]]
                    if held > (1 - SIMILARITY + 1e-9) * self.totals[k]:
                        break
        self.tables = {size: self._tables(sorted(found)) for size, found in sorted(known.items())}
        self.anchors = {size: self._anchors(found) for size, found in sorted(anchors.items())}

    @staticmethod
    def _anchors(found: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Marks of the hashes' first 16 bits, the hashes in order and the items of each."""
        keys = np.array(sorted(found), np.uint64)
        hit = np.zeros(1 << 16, bool)
        hit[keys >> np.uint64(48)] = True
        return hit, keys, [found[x] for x in keys.tolist()]

    @staticmethod
    def _tables(found: list[tuple[int, int, int]]) -> tuple:
        """References; for each block marks of the values within one bit, those values in order and their references."""
        prints = np.array([f[0] for f in found], np.uint64)
        near = np.array([0, *(1 << t for t in range(16))], np.int64)
        hit, flat = np.zeros((4, 1 << 16), bool), []
        for b in range(4):
            values = (((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ near).ravel()
            refs = np.repeat(np.arange(len(prints)), len(near))
            order = np.lexsort((refs, values))
            keys, starts = np.unique(values[order], return_index=True)
            hit[b, keys] = True
            flat.append((keys, np.r_[starts, len(order)], refs[order]))
        return prints, hit, flat, np.array([f[1] for f in found]), np.array([f[2] for f in found])

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, reference number) of all windows within the radius of a reference."""
        refs, hit, flat, _, _ = self.tables[size]
        blocks = prints.astype("<u8", copy=False).view(np.uint16).reshape(-1, 4)
        out, any_hit = [], hit[0].take(blocks[:, 0])
        for b in range(1, 4):
            any_hit |= hit[b].take(blocks[:, b])
        met = np.flatnonzero(any_hit)
        for b in range(4):
            at = met[hit[b].take(blocks[met, b])]
            keys, starts, ns = flat[b]
            x = np.searchsorted(keys, blocks[at, b])
            lo, width = starts[x], starts[x + 1] - starts[x]
            at = np.repeat(at, width)
            ref = ns[np.repeat(lo, width) + np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)]
            near = np.bitwise_count(prints[at] ^ refs[ref]) <= RADIUS
            out.append(at[near] * len(refs) + ref[near])
        both = np.unique(np.concatenate(out))
        return both // len(refs), both % len(refs)

    def places(self, hashes: np.ndarray, owner: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """For each (text, item), ranges of words where an item-sized passage may start; ``first`` has each text's first word."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        sums = lane_sums(hashes)
        for size, (_, _, _, items, offsets) in self.tables.items():
            at, ref = self.candidates(window_prints(hashes, size, sums), size)
            same = owner[at] == owner[at + size - 1] if len(at) else np.zeros(0, bool)
            at, ref = at[same], ref[same]
            start = np.maximum(at - offsets[ref], first[owner[at]])
            for doc, item, lo in zip(owner[at].tolist(), items[ref].tolist(), start.tolist(), strict=True):
                out[doc, item].append((lo, lo))
        for size, (hit, keys, lists) in self.anchors.items():
            grams = gram_hashes(hashes, size)
            at = np.flatnonzero(hit.take(grams.astype("<u8", copy=False).view(np.uint16).reshape(-1, 4)[:, 3]))
            key = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            ok = (keys[key] == grams[at]) & (owner[at] == owner[at + size - 1])
            for w, doc, k in zip(at[ok].tolist(), owner[at[ok]].tolist(), key[ok].tolist(), strict=True):
                for item in lists[k]:
                    out[doc, item].append((max(w - len(self.words[item]) + size, int(first[doc])), w))
        return out

    def best_start(self, item: int, hashes: np.ndarray, lo: int, hi: int) -> int | None:
        """The first best of the starts ``lo`` to ``hi`` of an item-sized passage; None if no passage can do.

        ``hashes`` are a text's words; passages at its end may be shorter. Running sums give the weight of every passage if no
        shingle comes more often than the item has it; otherwise running counts do.
        """
        keys, own, each = self.grams[item]
        n = len(self.words[item])
        size = min(SHINGLE, n)
        width = n - size + 1
        grams = gram_hashes(hashes[lo : hi + n], size)
        if not len(grams):
            return None
        key = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        met = keys[key] == grams
        there = np.bincount(key[met], minlength=len(keys))
        if (np.minimum(there, own) * each).sum() < (SIMILARITY - 1e-9) * self.totals[item]:
            return None
        starts = hi - lo + 1
        if (there <= own).all():
            run = np.zeros(len(grams) + 1)
            np.cumsum(np.where(met, each[key], 0.0), out=run[1:])
            at = np.minimum(np.arange(starts), len(grams))
            held = run[np.minimum(at + width, len(grams))] - run[at]
        else:
            count, value, held = [0] * len(keys), 0.0, np.zeros(starts)
            key, met, most, worth = key.tolist(), met.tolist(), own.tolist(), each.tolist()
            for p in range(starts + width - 1):
                if p < len(met) and met[p]:
                    count[key[p]] += 1
                    value += worth[key[p]] if count[key[p]] <= most[key[p]] else 0.0
                if p >= width and p - width < len(met) and met[p - width]:
                    value -= worth[key[p - width]] if count[key[p - width]] <= most[key[p - width]] else 0.0
                    count[key[p - width]] -= 1
                if p >= width - 1:
                    held[p - width + 1] = value
        return lo + int(np.flatnonzero(held >= held.max() - 1e-9 * self.totals[item])[0])

    def similarity(self, item: int, passage: list[bytes]) -> float:
        there, own, w = shingles(passage), self.counts[item], self.weights[item]
        return sum(v * min(there[s], own[s]) / own[s] for s, v in w.items() if s in there) / self.totals[item]


def _steps(folded: bytes, overlap: int) -> Iterator[tuple[int, bytes, bool]]:
    """(first word, text, last): a folded text in steps; each begins ``overlap`` words before the end of the step before."""
    at = base = 0
    while True:
        end, words = at, 0
        while end < len(folded) and words <= 2 * overlap:
            before, end = end, end + STEP
            end = folded.find(b" ", end) if end < len(folded) else len(folded)
            end = len(folded) if end < 0 else end
            words += len(folded[before:end].split())
        starts = word_hashes(folded[at:end])[0] if end < len(folded) else None
        yield base, folded[at:end], end >= len(folded)
        if end >= len(folded):
            return
        skip = len(starts) - overlap
        base, at = base + skip, at + int(starts[skip]) if overlap else end


def _scan(index: ItemIndex, texts: list[bytes]) -> list[tuple[int, int, int, int, float]]:
    """(text number, item number, first word, words, similarity), the best place of each item in each text."""
    found: dict[tuple[int, int], tuple[int, int, float]] = {}

    def step(parts: list[tuple[int, int, bytes, bool]]) -> None:
        """Parts are (text number, first word, folded text, whether the text ends here), one for each text at most."""
        joined = b" ".join(p[2] for p in parts)
        starts, ends, hashes = word_hashes(joined)
        edges = np.searchsorted(starts, np.cumsum([0, *(len(p[2]) + 1 for p in parts)]))
        owner = np.repeat(np.arange(len(parts)), np.diff(edges))
        for (part, item), ranges in index.places(hashes, owner, edges).items():
            n, base, _, last = parts[part]
            begin, end, size = int(edges[part]), int(edges[part + 1]), len(index.words[item])
            most = end - 1 if last else end - size  # a passage that the step cuts lies whole in the next one
            own, lo, hi = hashes[begin:end], None, None
            for a, b in [*sorted(ranges), (len(hashes) + size, 0)]:
                if lo is not None and a <= hi + 1:
                    hi = max(hi, b)
                    continue
                if lo is not None and (top := min(hi, most)) >= lo:
                    start = index.best_start(item, own, lo - begin, top - begin)
                    if start is not None:
                        w = range(begin + start, min(begin + start + size, end))
                        passage = [joined[starts[x] : ends[x]] for x in w]
                        sim, at = index.similarity(item, passage), base + start
                        old = found.get((n, item))
                        if sim >= SIMILARITY and (old is None or (sim, -at) > (old[2], -old[0])):  # of equal places the first
                            found[n, item] = (at, len(passage), sim)
                lo, hi = a, b

    parts: list[tuple[int, int, bytes, bool]] = []
    held = 0
    for n, data in enumerate(texts):
        for base, folded, last in _steps(data.translate(_FOLD), max(index.longest - 1, 0)):
            parts.append((n, base, folded, last))
            held += len(folded)
            if held >= STEP or not last:
                step(parts)
                parts, held = [], 0
    if parts:
        step(parts)
    return [(n, item, *v) for (n, item), v in found.items()]


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, place, shingle): each item's shingles in the order in which they first occur."""
    for batch in slices(batches, "text"):
        for number, data in zip(batch.column("number").to_pylist(), as_bytes(batch.column("text")), strict=True):
            own = list(shingles(words_of(data)))
            for k in range(0, len(own), 1 << 14):
                part = own[k : k + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(part), pa.int64()), pa.array(range(k, k + len(part)), pa.int32()), pa.array(part, pa.binary())], names=["number", "place", "shingle"])


def weighted_items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, holders) of the items that have words, and their number; holders: how many items hold each shingle of the item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    items = written(rows.withColumn("number", F.monotonically_increasing_id()), "items")
    own = written(items.select("number", "text").mapInArrow(_item_shingles, "number long, place int, shingle binary"), "item_shingles")
    seen = own.groupBy("shingle").agg(F.count("*").alias("n"))
    each = split_join(own, seen, "shingle", "number", own.count())
    holders = each.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("h"))  # as long as the item
    out = written(items.join(holders, "number").select("item_id", "text", F.col("h.n").alias("holders")), "weighted_items")
    return out, out.count()


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes, list[int]]]]:
    """The items in blocks of bounded size, streamed."""
    block, held = [], 0
    for item_id, text, holders in items.select("item_id", F.col("text").cast("binary"), "holders").orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(bytes(text)))
        if block and held + n > ITEM_WORDS:
            yield block
            block, held = [], 0
        block.append((item_id, bytes(text), np.array(holders, np.int64)))
        held += n
    if block:
        yield block


#: The index of the block that a worker process used last.
_INDEX: dict[int, ItemIndex] = {}


def _index(shared) -> ItemIndex:
    if shared.bid not in _INDEX:
        _INDEX.clear()
        items = shared.items.value
        _INDEX[shared.bid] = ItemIndex([x[:2] for x in items], [x[2].tolist() for x in items], shared.total)
    return _INDEX[shared.bid]


class _Shared:
    """A broadcast block of items, a number that tells blocks apart, and the number of all items."""

    def __init__(self, items, bid: int, total: int) -> None:
        self.items, self.bid, self.total = items, bid, total


def matches(docs: DataFrame, benchmark: DataFrame, doc_type: str = "long") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best place of each benchmark item in each document that holds it.

    ``doc_type`` is the type that doc_id is cast to.
    """
    spark, done, last, sent = docs.sparkSession, [], None, None
    texts = docs.select(F.col("doc_id").cast(doc_type).alias("doc_id"), "text")
    schema = f"doc_id {doc_type}, item_id long, first_word long, n_words long, similarity double"
    items, total = weighted_items(benchmark)
    for block in _item_blocks(items):
        if last is not None:  # another block follows, so the one before is worked off and its broadcast freed
            done.append(written(last, "matches"))
            sent.destroy()
        sent = spark.sparkContext.broadcast(block)  # at most ITEM_WORDS words and one item
        shared = _Shared(sent, sent._jbroadcast.id(), total)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in slices(batches, "text"):
                ids = batch.column("doc_id").to_pylist()
                got = _scan(index, as_bytes(batch.column("text")))
                cols = [[ids[n] for n, *_ in got], [index.ids[g[1]] for g in got], [g[2] for g in got], [g[3] for g in got], [g[4] for g in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.column("doc_id").type] + [pa.int64()] * 3 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        last = texts.mapInArrow(run, schema)
    if last is None:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.union, [*done, last])
