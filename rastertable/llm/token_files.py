"""Operator 1: token-ID output with fixed-width bit packing.

Each id takes the minimum number of bits of the vocabulary. Ids are stored in blocks of whole documents; a block row holds
its packed ids, the offset of its first id in its shard and the offsets of its documents, so that any id is found by two
searches and unpacked with numpy alone. Blocks are rows of a Parquet table: Spark's committer makes the write atomic and
any store that Spark reaches can hold it.

Order is ascending doc_id (null first), then the text's hash. Null and empty texts have only the end id. Repeated rows are
kept as often as they occur. An empty table gives an empty token table. Other columns are not read.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastertable.llm.shared import slices, written

#: Ids in a block, at least (a block ends with the document that fills it).
BLOCK_IDS = 1 << 16
#: Bytes that a worker's memory of encoded words may hold, about; when full it starts anew. An entry takes ``ENTRY_BYTES`` and its texts.
#: Workers live on between tasks and jobs, so this stays beside whatever else an executor does later.
MEMORY_BYTES, ENTRY_BYTES = 64 << 20, 180
#: Bytes of text that are encoded at a time, about; as Python objects their different words take a few times as much.
SLICE_BYTES = 1 << 20
#: New words that go to the library as one text: a text has costs of its own, and in long ones a word takes longer (measured).
TOGETHER = 20
BLOCKS = "shard int, block int, first_id long, n_ids int, width int, payload binary, doc_ids array<long>, doc_starts array<int>"


def id_bits(vocab_size: int) -> int:
    """Bits that the largest of ``vocab_size`` ids needs."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as a bit string, the first id's highest bit first; the last byte is filled with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits.ravel()).tobytes()


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a packed block, reading only the bytes that hold them."""
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(payload, f">u{size}", count, first * size).astype(np.uint32)
    lo, hi = first * width, (first + count) * width
    raw = np.frombuffer(payload, np.uint8, -(-hi // 8) - lo // 8, lo // 8)
    bits = np.unpackbits(raw)[lo % 8 : lo % 8 + count * width].reshape(count, width)
    out = np.zeros((count, 32), np.uint8)
    out[:, 32 - width :] = bits
    return np.packbits(out, axis=1).view(">u4").ravel().astype(np.uint32)


class WordEncoder:
    r"""Encodes whole texts with a byte-level BPE model of the tokenizers library, remembering words it has met.

    The library's pre-tokenizer never joins characters across a single space between two characters that are not white
    space, so such texts are cut before their spaces and only words that are not known yet go to the library, ``TOGETHER`` of them
    as one text. A word's first id is the only one whose token begins with a space, so it tells the words apart. Nor does it join a
    letter or digit with an ASCII mark after it, so a word's last marks are looked up apart and the word is remembered without them.
    A text with a space beside other white space or at its end, or with a special token, goes to the library whole. The texts of a batch are
    cut, and their words told apart and put together again, by Arrow; Python sees each different word once a batch. What is
    remembered is bounded in bytes: ``MEMORY_BYTES`` and one batch. Ids are kept as little-endian bytes.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: For words: without special tokens, which no word may become part of.
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = self.whole.pre_tokenizer
        special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        #: RE2: texts that are not cut. Every character that some release of Unicode counts as white space is in the class.
        self.odd = "|".join([f"{_WHITE} | {_WHITE}| $", *map(_quoted, special)])
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        #: Ids of words with the space before them, and of texts' first words and of marks, which have none.
        self.words: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.held = 0
        vocab = self.whole.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[k for token, k in vocab.items() if token[0] == "\u0120"]] = True  # the byte-level alphabet's space

    def library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, words: list[str]) -> None:
        """Remembers new words, each with the space before it."""
        joined = [" " + " ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        found = self.plain.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), self.dtype)
        raw, edges = ids.tobytes(), (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * self.dtype.itemsize).tolist()
        self.remember(self.words, {w: raw[lo:hi] for w, lo, hi in zip(words, edges[:-1], edges[1:], strict=True)})

    def learn_bare(self, words: list[str]) -> None:
        found = self.plain.encode_batch_fast(words, add_special_tokens=False)
        self.remember(self.bare, {w: np.array(x.ids, self.dtype).tobytes() for w, x in zip(words, found, strict=True)})

    def find(self, words: list[str]) -> list[bytes]:
        """The ids of different words that are not remembered, without their marks at least, each with the space before it."""
        stems = [w.rstrip(string.punctuation) for w in words]
        stems = [s if s and s[-1] < _LATIN and s[-1].isalnum() else w for s, w in zip(stems, words, strict=True)]
        marks = [w[len(s) :] for s, w in zip(stems, words, strict=True)]
        self.learn([s for s in dict.fromkeys(stems) if s not in self.words])
        self.learn_bare([m for m in dict.fromkeys(marks) if m not in self.bare])
        return [self.words[s] + self.bare[m] for s, m in zip(stems, marks, strict=True)]

    def remember(self, known: dict[str, bytes], found: dict[str, bytes]) -> None:
        known |= found
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        if self.held > MEMORY_BYTES:
            self.words, self.bare, self.held = {}, {}, 0
        empty = np.zeros(0, self.dtype)
        out = [empty] * len(texts)
        odd = pc.fill_null(pc.match_substring_regex(texts, self.odd), False)
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.frombuffer(self.library(texts[k].as_py()), self.dtype)
        cut = np.flatnonzero(pc.and_not(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False), odd).to_numpy(zero_copy_only=False))
        if not len(cut):
            return out
        lists = pc.split_pattern(texts.take(pa.array(cut)), " ")
        edges = lists.offsets.to_numpy()
        every, starts = lists.values, edges[:-1]
        begin, coded = every.take(pa.array(starts)).dictionary_encode(), every.dictionary_encode()
        at = coded.indices.to_numpy().copy()
        at[starts] = len(coded.dictionary) + begin.indices.to_numpy()
        # A word that only begins texts is not looked up as one with a space before it.
        used = np.zeros(len(coded.dictionary) + len(begin.dictionary), bool)
        used[at] = True
        words, heads = _strings(coded.dictionary), _strings(begin.dictionary)
        got = list(map(self.words.get, words))
        new = [k for k, x in enumerate(got) if x is None and used[k]]
        for k, x in zip(new, self.find([words[k] for k in new]), strict=True):
            got[k] = x
        self.learn_bare([w for w in heads if w not in self.bare])
        ids = pa.array([*got, *(self.bare[w] for w in heads)], pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(at) + 1, 8 * ids.offset)[edges] // self.dtype.itemsize
        flat = np.frombuffer(ids.buffers()[2], self.dtype, ends[-1]) if ends[-1] else empty
        for k, lo, hi in zip(cut.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = flat[lo:hi]
        return out


# Fixed value: white space of any release of Unicode, and marks that some tools count as such.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"

#: Letters and digits below this character are such in every release of Unicode.
_LATIN = "\u0100"


def _strings(words: pa.Array) -> list[str]:
    """Words without spaces, at least one, as Python strings: much faster in one piece."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", words.type))[0].as_py().split(" ")


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _blocks(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width, shard = id_bits(enc.whole.get_vocab_size()), TaskContext.get().partitionId()
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32()))])
        end = np.array([end_id], np.uint32)
        block = first = count = 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        starts: list[int] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, block, first, count, width, pack(np.concatenate(held), width), docs, starts), schema, strict=True)], schema=schema)

        for batch in slices(batches, "text", SLICE_BYTES):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                docs.append(doc_id)
                starts.append(count)
                held += [ids, end]
                count += len(ids) + 1
                if count >= BLOCK_IDS:
                    yield flush()
                    block, first, count, held, docs, starts = block + 1, first + count, 0, [], [], []
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the token table; returns the table as read back (schema ``BLOCKS``).

    Shards are ranges of doc_id; equal rows, whose ids are equal, are told apart by their place in the scan, so they fill several shards.
    A document is never cut, so a block is at most ``BLOCK_IDS`` ids and one document long.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"h": F.xxhash64("text"), "spot": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange("doc_id", "h", "spot").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return written(ordered.mapInArrow(_blocks(tokenizer_path, end_id), BLOCKS), "tokens")


def shard_offsets(blocks: DataFrame) -> DataFrame:
    """(shard, base): ids of all shards before; one row for each shard, so the running sum is over few rows."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for k in range(batch.num_rows):  # a block at a time: its payload and its documents are Python objects only meanwhile
            row = batch.slice(k, 1).to_pylist()[0]
            cols: list[list] = [[] for _ in names]
            edges = [*row["doc_starts"], row["n_ids"]]
            for doc_id, lo, hi in zip(row["doc_ids"], edges, edges[1:], strict=False):
                ids = unpack(row["payload"], row["width"], lo, hi - lo)
                for c, v in zip(cols, (doc_id, row["shard"], row["first_id"] + lo, hi - lo, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def read_documents(blocks: DataFrame) -> DataFrame:
    """One row for each document of a token table: doc_id, start, n_tokens and the checksum of its unpacked ids."""
    rows = blocks.select("shard", "first_id", "n_ids", "width", "payload", "doc_ids", "doc_starts")
    out = rows.mapInArrow(_documents, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long")
    return out.join(F.broadcast(shard_offsets(blocks)), "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(blocks: DataFrame, shard: int, first: int, count: int) -> np.ndarray:
    """Random access: ``count`` ids of one shard from ``first`` on; only the blocks that hold them are read."""
    at = blocks.where((F.col("shard") == shard) & (F.col("first_id") < first + count) & (F.col("first_id") + F.col("n_ids") > first))
    parts = []
    for r in at.select("first_id", "n_ids", "width", "payload").orderBy("first_id").toLocalIterator():
        lo, hi = max(first - r.first_id, 0), min(first + count - r.first_id, r.n_ids)
        parts.append(unpack(bytes(r.payload), r.width, lo, hi - lo))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
