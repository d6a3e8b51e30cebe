"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small hand-made tables."""

from __future__ import annotations

import random
import re
import string
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from rastertable.llm import ann, chat, decontaminate, language_id, license_scan, mixing, sharding, simhash_dedup, token_counts, token_files
from rastertable.llm.components import components, split_join

DOCS = "doc_id long, text string, lang string, source string, slot string, shard string, fp string, score string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def table(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, s, "x", "x", "x", "x") for i, t, lang, s in rows], DOCS)


LONG = prose(99, 30_000)
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "one", "en", "a"), (3, "one", "en", "a"), (4, LONG, None, "b"), (None, "no id", "en", None), (5, "  two   spaces \n\n tab\t ", "en", "b"), (6, "日本語 ÉÈ \x00 nul", None, "ü")]


def rows_of(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


# 1 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing_is_exact_and_random_access_agrees(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    for first, n in ((0, 1000), (0, 0), (7, 1), (123, 456), (999, 1)):
        assert (token_files.unpack(packed, width, first, n) == ids[first : first + n]).all()
    assert [token_files.id_bits(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*EDGE, (7, "don't  stop<|endoftext|> it's", None, "a"), (8, " lead and trail ", None, "a")]
    blocks = token_files.write_tokens(table(spark, rows), path)
    lib = Tokenizer.from_file(path)
    want, at = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    stream = []
    for i, t, *_ in ordered:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += ids
    got = token_files.read_documents(blocks)
    assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    first = blocks.agg(F.min("shard")).first()[0]
    assert token_files.read_ids(blocks, first, 2, 5).tolist() == stream[2:7]
    assert token_files.read_documents(token_files.write_tokens(table(spark, []), path)).count() == 0


def test_ids_equal_the_library_for_all_kinds_of_white_space_and_characters(monkeypatch):
    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(11)
    enc = token_files.WordEncoder(path)
    white = [chr(c) for c in range(0x3001) if chr(c).isspace() or chr(c) in "\u180e\u200b\u2060"] + ["\ufeff"]
    marks = ["'s", "don't", "<|endoftext|>", "<|endof", "1", "42", "²", "é", "日本", "a", "the", "Of", ".", "...", "!?", "_", "\x00", "Ġ", "ġ", "😀", "\u0558", "\U00010940", "ß", "я", "\u0301", " "]
    texts = ["".join(r.choice(white if r.random() < 0.2 else " " if r.random() < 0.5 else marks) for _ in range(r.randint(0, 12))) for _ in range(100_000)]
    want = [x.ids for x in enc.whole.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(token_files, "MEMORY_BYTES", 2_000_000)
    for at in range(0, len(texts), 5000):
        for t, got, ids in zip(texts[at : at + 5000], enc.encode(pa.array(texts[at : at + 5000])), want[at : at + 5000], strict=True):
            assert got.tolist() == ids, t
    assert enc.held < 4_000_000 and not len(enc.encode(pa.array([None, ""], pa.string()))[0])
    every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 4096):
        t = " ".join(f"a{c}1{c}!{c}x" for c in every[at : at + 4096])
        assert enc.encode(pa.array([t]))[0].tobytes() == enc.library(t)


def test_a_worker_remembers_few_words():
    enc, most = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")), 0
    for at in range(0, 500_000, 25_000):
        enc.encode(pa.array([" ".join(f"word{k:020d}" for k in range(at, at + 25_000))]))
        most = max(most, sys.getsizeof(enc.words) + sum(sys.getsizeof(w) + sys.getsizeof(x) for w, x in enc.words.items()))
    assert most < 60 << 20, most


def test_new_words_take_no_call_each():
    enc, calls = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")), 0
    texts = pa.array([" ".join(f"{'abcdefghij'[k % 10]}word{k}tail" for k in range(at, at + 5000)) for at in range(0, 20_000, 5000)])

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    got = enc.encode(texts)
    sys.setprofile(None)
    assert [x.tobytes() for x in got] == [enc.library(t) for t in texts.to_pylist()]
    assert calls < 5 * 20_000, calls


def test_words_are_remembered_without_their_last_marks():
    enc, r = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(12)
    marks = [a + b for a in ["", *string.punctuation] for b in ["", *string.punctuation]]
    text = " ".join(["the", *(f"remembered{m}" for m in marks)])
    assert enc.encode(pa.array([text]))[0].tobytes() == enc.library(text)
    assert len(enc.words) == 1, len(enc.words)
    parts = [*string.punctuation, "a", "The", "7", "é", "ÿ", "²", "¼", "ª", "я", "日", "\u0301", "\u0660", "😀", "\xad", "\x00", "\u0100", "Ġ", "\n", "'s", "'ll", "***", "n't"]
    for _ in range(300):
        text = " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(100))
        found = enc.encode(pa.array([text, None, text[: len(text) // 2], "", text[::-1]]))
        for t, x in zip((text, "", text[: len(text) // 2], "", text[::-1]), found, strict=True):
            assert x.tobytes() == enc.library(t), t


def test_cut_and_whole_texts_and_parts_of_a_column_keep_their_places():
    enc, texts = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")), ["one two", None, "a  b", " one", "", "two <|endoftext|> x", "two one", "one ", "one", " "]
    for kind in (pa.string(), pa.large_string()):
        for lo in range(len(texts)):
            got = enc.encode(pa.array(texts, kind)[lo:])
            assert [x.tobytes() for x in got] == [enc.library(t or "") for t in texts[lo:]]
    assert enc.encode(pa.array([], pa.string())) == []


def test_blocks_are_unpacked_one_by_one():
    ids = np.arange(1 << 16, dtype=np.uint32)
    rows = [{"shard": 0, "first_id": k << 16, "n_ids": 1 << 16, "width": 16, "payload": token_files.pack(ids, 16), "doc_ids": [2 * k, 2 * k + 1], "doc_starts": [0, 1000]} for k in range(200)]
    batch, found = pa.RecordBatch.from_pylist(rows), []
    tracemalloc.start()
    for b in token_files._documents(iter([batch])):
        found += b.to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20, peak
    crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in (ids[:1000], ids[1000:])]
    assert [tuple(x.values()) for x in found] == [(2 * k + h, 0, (k << 16) + 1000 * h, (1000, 64536)[h], crcs[h]) for k in range(200) for h in (0, 1)]


# 2 ---------------------------------------------------------------------------------------------------------------


def brute_license(text):
    words = re.findall(license_scan.WORD, (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    places, found = [], set()
    for k in range(len(words)):
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            if words[k : k + len(p)] == p:
                places.append(k)
                found.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def test_license_scan(spark):
    mit = license_scan.TEMPLATES[0][1]
    rows = [*EDGE, (10, "MIT License, mit-license; the MIT\nlicense", None, "a"), (11, "Mit Licenses and mit x license", None, "a"), (12, f"{LONG[:3000]} {mit.title()} {LONG[:200]}", None, "a"), (13, "This work is licensed under the GNU General Public License, version 3.", None, "a"), (14, "license " * 3000 + "apache license", None, "a"), (15, "mit license", None, "a"), (15, "mit license", None, "a"), (16, f"{mit} mit license {license_scan.TEMPLATES[3][1]}", None, "a"), (17, "apache \u212aernel licen\u017fe m\u0131t license", None, "a")]
    out = license_scan.scan(table(spark, rows))
    got = rows_of(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted([(i, *brute_license(t)) for i, t, *_ in rows], key=str)
    labels = {r.doc_id: (r.labels, r.score) for r in out.collect()}
    assert labels[12] == ("mit-text", 1.0) and labels[13][0] == "gpl,gpl-3.0" and labels[3] == ("", 0.0)
    assert labels[16] == ("bsd-3-clause,mit,mit-text", 1.0)
    assert license_scan.scan(table(spark, [])).count() == 0


def test_license_scan_finds_every_template_as_by_brute_force(spark):
    r, found = random.Random(9), license_scan.templates()
    words = sorted({w for t in found for w in t.words})
    rows = []
    for k in range(150):
        text = [r.choice(words) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            t = r.choice(found)
            lo, hi = r.randint(0, t.key_at), r.randint(t.key_at + len(t.key), len(t.words))
            at = r.randint(0, len(text))
            text[at:at] = [w if r.random() > 0.02 else "other" for w in t.words[lo:hi]]
        rows.append((k, " ".join(text), None, "a"))
    got = {x.doc_id: (x.labels, x.score) for x in license_scan.scan(table(spark, rows)).collect()}
    for k, text, *_ in rows:
        own, labels, score = text.split(), set(), 0.0
        for t in found:
            for start in range(-len(t.words), len(own)):
                there = [0 <= start + i < len(own) and own[start + i] == w for i, w in enumerate(t.words)]
                if all(there[t.key_at : t.key_at + len(t.key)]):
                    labels.add(t.label)
                    score = max(score, sum(there) / len(there))
        assert got[k][0] == ",".join(sorted(labels)) and abs(got[k][1] - score) < 1e-12
    own = license_scan.scan(table(spark, [(1, "x our own terms apply here", None, None)]), [("own", "our own terms apply", "own terms")]).first()
    assert (own.labels, own.score) == ("own", 1.0)


# 3 ---------------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    rows = [*EDGE, *[(100 + i, prose(i % 40, 3 + i % 50), None, "a") for i in range(400)]]
    files, slot_map = sharding.write_shards(table(spark, rows), 5, slots=512)
    got = files.select("doc_id", "text", "shard", "slot", "virtual_slot").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    owner = {r.virtual_slot: r.shard for r in sharding.latest(slot_map).collect()}
    assert all(owner[r.virtual_slot] == r.shard for r in got) and len(owner) == 512
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len((r.text or "").encode()) + 8
    rest = sorted(sizes.values())[:-1]  # one shard holds the long text, which is more than a fifth of all bytes
    assert max(rest) - min(rest) < 100
    grown = sharding.rebalanced(slot_map, 6)
    old, new = ({r.virtual_slot: r.shard for r in grown.where(f"version = {v}").collect()} for v in (2, 3))
    assert set(new.values()) == set(range(6)) and sum(old[v] == new[v] for v in old) > 300
    fewer = sharding.latest(sharding.rebalanced(slot_map, 3))
    assert {r.shard for r in fewer.collect()} == {0, 1, 2}
    none, _ = sharding.write_shards(table(spark, []), 3)
    assert none.count() == 0


def test_sharding_splits_repeated_rows_and_large_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 20_000)
    often = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same row").alias("text"), F.lit("x").alias("number"))
    few = spark.range(3000).select((F.col("id") + 10).alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 400).cast("int")).alias("text"), F.lit("x").alias("number"))
    files, slot_map = sharding.write_shards(often.union(few), 3, slots=64)
    by = files.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("places"), F.max("slot").alias("last")).collect()
    assert sum(r.n for r in by) == 103_000 and all(r.n == r.places == r.last + 1 for r in by)
    assert max(r.bytes for r in by) - min(r.bytes for r in by) < 0.01 * sum(r.bytes for r in by)
    loads = sharding.latest(slot_map).agg(F.max("n_rows")).first()[0]
    largest = files.groupBy("shard", "part").count().agg(F.max("count")).first()[0]
    assert loads < 10_000 and largest < 3000


def spark_hash(*values):
    """Spark's xxhash64 of longs and strings; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), h)
    return h - (h >> 63 << 64)


def test_sharding_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_PARTS", 1)  # a shard is one part, in order of slot and hash
    rows = [*EDGE[:4], *EDGE[5:], *[(100 + i, prose(i, 3 + i % 50), None, "a") for i in range(400)]]
    slots, shards = 64, 5
    size, slot_of = Counter(), {}
    for i, t, *_ in rows:
        slot_of[i, t] = spark_hash(spark_hash(i, t), 0) % slots
        size[slot_of[i, t]] += len((t or "").encode()) + 8
    owner = {v: v % shards for v in range(slots)}
    while True:
        held = [sum(size[v] for v in owner if owner[v] == s) for s in range(shards)]
        to = min(range(shards), key=lambda s: (held[s], s))
        moves = ((s, max(((size[v], v) for v in owner if owner[v] == s and 0 < size[v] <= (held[s] - held[to]) // 2), default=None)) for s in sorted(range(shards), key=lambda s: (-held[s], s)))
        move = next((m for _, m in moves if m), None)
        if move is None:
            break
        owner[move[1]] = to
    want = []
    for s in range(shards):
        own = sorted((slot_of[i, t], spark_hash(i, t), str(i), t) for i, t, *_ in rows if owner[slot_of[i, t]] == s)
        want += [(s, k, v, i, t) for k, (v, _, i, t) in enumerate(own)]
    files, _ = sharding.write_shards(table(spark, rows), shards, slots=slots)
    assert rows_of(files.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))), "shard", "slot", "virtual_slot", "doc_id", "text") == sorted(want, key=str)


def test_parts_of_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 100)
    monkeypatch.setattr(sharding, "MOST_PARTS", 50)
    slot_map = spark.createDataFrame([(1, v, v % 4, 10, 1_000_000 if v == 3 else 3000) for v in range(64)], sharding.MAP)
    places, tasks = sharding.parts(slot_map)
    assert len(places) == 64 and 40 < tasks <= 50 + 64 + 4


# 4 ---------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Water filling by rounds; sizes by source in order."""
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and left * weights[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        capped |= over


def test_mixing(spark):
    rows = [(i, prose(i, 20 + i % 90), None, s) for i, s in enumerate(["a"] * 20 + ["b"] * 300 + ["c"] * 80 + ["é"] * 60 + [None] * 100)]
    rows += [(1000, None, None, "a"), (1001, " \n ", None, "b"), (1, rows[1][1], None, "a")]
    out = mixing.taken(table(spark, rows)).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows)
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = brute_targets({s: sizes[s] for s in order})
    for s in order:
        own = [r for r in out if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 4 * mixing.BLOCK
    assert all(r.taken <= 3 * r["size"] for r in out)
    again = mixing.taken(table(spark, rows[::-1])).collect()
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in out) == sorted((str(r.doc_id), r["size"], r.taken) for r in again)
    copies = mixing.mixed(table(spark, rows))
    assert copies.columns == table(spark, []).columns and copies.where("doc_id >= 1000").count() == 0
    assert mixing.taken(table(spark, [(1, None, None, None)])).first().taken == 0 and mixing.taken(table(spark, [])).count() == 0


def test_takes_as_by_brute_force(spark):
    rows = [(i, prose(i, 3 + i * 7 % 90), None, s) for i, s in enumerate(["a"] * 12 + ["b"] * 60 + ["c"] * 25 + [None] * 8)]
    docs = table(spark, rows)
    got = sorted((r.doc_id, r.taken) for r in mixing.taken(docs, 16).collect())
    at = {r.doc_id: r["at"] for r in mixing.placed(mixing.written(mixing.sizes(docs), "sizes")).collect()}
    size = {i: len(t.split()) for i, t, *_ in rows}
    by = {s: [i for i, _, _, own in rows if own == s] for s in ("a", "b", "c", None)}
    totals = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    n_blocks = {s: -(-n // 16) for s, n in totals.items()}
    quota = {s: want / totals[s] * n_blocks[s] for s, want in brute_targets(totals).items()}
    edges, total = [], sum(quota.values())
    for s in quota:
        edges.append((sum(q for x, q in quota.items() if list(quota).index(x) <= list(quota).index(s)) / total, s))
    ranks, blocks = Counter(), Counter()
    for slot in range(round(total)):
        u = (slot * (5**0.5 - 1) / 2) % 1
        s = next((s for e, s in edges if u < e), edges[-1][1])
        if ranks[s] < 3 * n_blocks[s]:
            blocks[s, ranks[s] % n_blocks[s]] += 1
        ranks[s] += 1
    want = []
    for s, ids in by.items():
        assert sorted((at[i], at[i] + size[i]) for i in ids)[0][0] == 0 and sum(size[i] for i in ids) == max(at[i] + size[i] for i in ids)
        want += [(i, sum(n * max(0, min(at[i] + size[i], 16 * b + 16) - max(at[i], 16 * b)) for (x, b), n in blocks.items() if x == s)) for i in ids]
    assert got == sorted(want)


def test_mixing_spreads_a_row_that_is_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 64)
    often = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("a").alias("source"))
    docs = often.union(spark.range(400).select((F.col("id") + 10).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.lit("b").alias("source")))
    rows = mixing.ordered(mixing.written(mixing.sizes(docs), "sizes"))
    assert rows.groupBy(F.pmod("order", F.lit(64)).alias("b")).count().agg(F.max("count")).first()[0] < 1000 and rows.count() == 20_400
    out = mixing.taken(docs)
    by = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()}
    assert all(abs(r.taken - r.target) <= 4 * mixing.BLOCK and r.over <= 0 for r in by.values())
    copies = mixing.mixed(docs).groupBy("source").count().collect()
    assert {r.source for r in copies} == {"a", "b"}


def test_golden_points_stay_even_for_large_slots(spark):
    u = [r.u for r in spark.range(2**40, 2**40 + 5000).select(mixing.points(F.col("id")).alias("u")).collect()]
    counts = np.bincount((np.array(u) * 50).astype(int), minlength=50)
    assert counts.max() - counts.min() <= 4


# 5 ---------------------------------------------------------------------------------------------------------------


def test_language_id(spark):
    r = random.Random(4)
    kinds = {"xx": ["shu", "kra", "mog", "wit"], "yy": ["éla", "oui", "nté", "ber"], "zz": ["ijk", "zze", "oop", "uur"]}
    rows = []
    for i in range(240):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join("".join(r.choice(kinds[lang]) for _ in range(3)) for _ in range(r.randint(3, 60))), lang if i % 9 else None, "a"))
    docs = table(spark, rows + [(500, None, "xx", "a"), (501, "123 ... \n", "xx", "a"), (502, "", None, "a")])
    model = language_id.fit(docs.where(~language_id.is_held_out()))
    assert model.langs == sorted(model.langs) and set(model.langs) == set(kinds)
    got = {r.doc_id: r for r in language_id.predict(docs, model).select("doc_id", "lang_pred", "score", "rejected").collect()}
    right = sum(got[i].lang_pred == list(kinds)[i % 3] for i in range(240))
    assert right >= 235 and all(0 <= g.score <= 1 for g in got.values())
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (500, 501, 502))
    far = language_id.predict(table(spark, [(1, "qqqqqqqqqqqq qqqqqqqq", None, "a"), (2, rows[0][1] * 400, None, "a")]), model).orderBy("doc_id").collect()
    assert far[0].rejected and far[1].lang_pred == "xx"
    nobody = language_id.fit(docs.where("false"))
    assert language_id.predict(docs, nobody).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_predictions_as_by_brute_force_and_held_out_accuracy(spark):
    from math import log, log1p, sqrt
    from pathlib import Path

    rows = [(i, " ".join(random.Random(i).choice(["shu", "kra", "éla", "oui"][i % 2 * 2 :][:2]) for _ in range(i % 9 + 2)), "xx" if i % 2 else "yy", None) for i in range(60)]
    docs = table(spark, rows)
    model = language_id.fit(docs.where(~language_id.is_held_out()))
    learnt = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]

    def grams(text):
        raw = b" " + " ".join(re.sub("[^a-z\x80-\U0010ffff]", " ", text.lower()).split()).encode() + b" "
        return Counter([(int.from_bytes(raw[k : k + 2], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 20 for k in range(len(raw) - 1)] + [(int.from_bytes(raw[k : k + 3], "big") * 0x85EBCA77 & 0xFFFFFFFF) >> 20 for k in range(len(raw) - 2)])

    df = Counter(d for t in learnt for d in grams(t))
    for r in language_id.predict(docs, model).select("text", "lang_pred", "score").collect():
        v = {d: log1p(n) * (log((1 + len(learnt)) / (1 + df[d])) + 0.1) for d, n in grams(r.text).items()}
        norm = sqrt(sum(x * x for x in v.values()))
        near = [sum(x / norm * float(c[d]) for d, x in v.items()) for c in model.centroids]
        assert r.lang_pred == model.langs[near.index(max(near))] and abs(r.score - max(near)) < 1e-4
    given = Path("/root/testdata/sf0.01/documents.parquet")
    if given.exists():
        docs = spark.read.parquet(str(given)).where("lang is not null")
        model = language_id.fit(docs.where(~language_id.is_held_out()))
        odd = spark.createDataFrame([(1, "Tämä on suomenkielinen teksti jossa puhutaan säästä ja kesästä järven rannalla"), (2, "0x4f3a9c deadbeef 1f2e3d4c5b6a 9a8b7c6d5e4f"), (3, "Это русский текст о погоде"), (4, "zzzz qqqq xxxx kkkk jjjj")], "doc_id long, text string")
        assert language_id.predict(odd, model).where("NOT rejected").count() == 0
        found = language_id.predict(docs, model).where(language_id.is_held_out())
        assert found.agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.01
        assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


# 6 ---------------------------------------------------------------------------------------------------------------


def test_token_counts_against_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = token_counts.sentencepiece_vocabulary(path)
    lib = Tokenizer(models.Unigram(vocabulary, 0, False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace()
    r = random.Random(2)
    rows = [*EDGE, *[(50 + i, "".join(r.choice("ab the͸日▁ \n1.") for _ in range(r.randint(0, 50))), None, "a") for i in range(300)]]
    got = rows_of(token_counts.token_counts(table(spark, rows), path), "doc_id", "n_tokens")
    assert got == sorted([(i, len(lib.encode(t or "").ids)) for i, t, *_ in rows], key=str)
    assert token_counts.token_counts(table(spark, []), path).count() == 0


def test_a_very_long_word_is_counted_in_a_ring():
    import resource

    own = token_counts.UnigramCounter([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.5), ("ab", -2.0), ("bab", -2.5), ("aaaa", -2.0)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert own.tokens("a" * 4_000_000) == 1 + 1_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_ties_follow_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -2.0), ("ba", -2.0), ("bab", -3.0)]
    lib = Tokenizer(models.Unigram(vocabulary, 0, False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace()
    own, r = token_counts.UnigramCounter(vocabulary), random.Random(1)
    for _ in range(2000):
        t = "".join(r.choice("abx ") for _ in range(r.randint(0, 14)))
        assert own.tokens(t) == len(lib.encode(t).ids), t


# 7 ---------------------------------------------------------------------------------------------------------------


def test_chat_links_and_order(spark):
    question, answer = "How do I sort a table by its key?", "Use order by on the key column."
    rows = [(1, 0, "user", question), (1, 1, "assistant", answer), (1, 2, "user", f"Al wrote:\n> {question.upper()}\nMe too, please."), (1, 3, "user", f"> > {question}\n>  Me too,   please.\nSame."), (1, 4, "user", f"> {answer}\nThanks a lot for that."),
            (2, 0, "user", question), (2, 1, None, None), (2, 1, None, None), (None, 5, "user", f"> {question}\nno such message here"), (3, None, "user", "no turn"), (3, 1, "user", "> short\nx")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, key string, position string")
    out = chat.conversations(df).collect()
    one = [(r.turn, r.parent, r.depth, r.content) for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)]
    assert one == [(0, None, 0, question), (2, 0, 1, "Me too, please."), (3, 2, 2, "Same."), (1, None, 0, answer), (4, 1, 1, "Thanks a lot for that.")]
    assert sorted(r.position for r in out if r.conv_id == 2) == [0, 1, 2] and len(out) == len(rows)
    assert [r.parent for r in out if r.conv_id is None] == [None]
    text = {(r.conv_id, r.segment): r for r in chat.formatted(df).collect()}
    assert text[2, 0].chat == f"<|im_start|>user\n{question}<|im_end|>\n" + "<|im_start|>user\n<|im_end|>\n" * 2 and text[1, 0].n_linked == 3
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_long_threads_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 4)
    rows = [(1, 0, "user", "message number zero starts here")]
    for k in range(1, 40):
        rows.append((1, k, "user", f"> {rows[-1][3].splitlines()[-1]}\nreply number {k} goes on from there"))
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [(r.turn, r.parent, r.depth) for r in out] == [(k, k - 1 if k else None, k) for k in range(40)]


def test_chat_links_short_and_rewrapped_quotations(spark):
    long, said = "The key column must be sorted first", "and then all of it\nis joined to the other\ntable by its number"
    rows = [(1, 0, "user", "Which one?"), (1, 1, "assistant", f"yes\n{long}"), (1, 2, "user", "> Which one?\nThe first."), (1, 3, "user", ">YES\n>\nFine."), (1, 4, "user", f"> Which one?\n> {long}\nNo."), (1, 5, "user", "好的"), (1, 6, "user", f"Well.\n\n{said}"), (1, 7, "user", "> 好的\nOK"),
            (1, 8, "user", "> and then all of it is joined\n> to the other table by its number\nWhy?"), (1, 9, "user", "> absent\nx"), (2, 0, "user", "> yes\nx")]
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.parent for r in out if r.conv_id == 1} == {0: None, 1: None, 2: 0, 3: 1, 4: 1, 5: None, 6: None, 7: 5, 8: 6, 9: None}
    assert [r.parent for r in out if r.conv_id == 2] == [None]


def test_chat_sql_states_all_kinds_of_quotations(spark, tmp_path):
    import duckdb

    from rastertable.llm import oracles

    r, said = random.Random(8), ["Which one?", "yes", "The key column must be sorted first.", "好的", "A first thing is said here. And then a second one follows! Done", "今日は良い天気ですねとても嬉しいです。明日は雨が降るでしょうから傘が要ります。", "and then all of it\nis joined to the other\ntable by its number", ""]
    rows = []
    for conv in range(60):
        texts = []
        for turn in range(12):
            parts = [r.choice(said)]
            for _ in range(r.randint(0, 2)):
                old = r.choice(texts) if texts and r.random() < 0.8 else "absent text of no one"
                lines = old.replace("table ", "table\n").split("\n") if r.random() < 0.3 else re.split(r"(?<=[.!?]) ", old)[: r.randint(1, 3)] if r.random() < 0.5 else old.split("\n")
                parts.insert(r.randint(0, len(parts)), "\n".join(r.choice(["> ", ">", "> > "][:2]) + x for x in lines))
            texts.append("\n".join(parts))
            rows.append((conv, turn, r.choice(["user", "assistant", None]), texts[-1]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = con.sql(oracles.chat_sql())
    got = chat.formatted(df).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and sum(x.n_linked for x in got) > 200


def test_chat_links_parts_of_lines_and_turns_of_many_messages(spark):
    rows = [(1, 0, "user", "The first step is to sort the rows. Then the second step joins them by key. Done."), (1, 1, "a", "今日は良い天気ですねとても嬉しいです。明日は雨が降るでしょうから傘が要ります。"), (1, 2, "user", "> Then the second step\n> joins them by key.\nWhy?"), (1, 3, "user", "> 明日は雨が降るでしょうから傘が要ります。\nはい"), (1, 4, "user", "> the second step joins\nno sentence")]
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.parent for r in out} == {0: None, 1: None, 2: 0, 3: 1, 4: None}
    many = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(9).cast("long").alias("turn"), F.col("id").cast("string").alias("role"), F.lit("> The first step is to sort the rows.\nyes").alias("text"))
    got = chat.conversations(many.unionByName(spark.createDataFrame(rows[:1], "conv_id long, turn long, role string, text string")))
    assert got.where("parent = 0").count() == 5000 and got.agg(F.max("position")).first()[0] == 5000


def test_chat_links_cut_quotations(spark, tmp_path):
    import duckdb

    from rastertable.llm import oracles

    r, rows, want = random.Random(5), [], {}
    cjk = "今日は良い天気ですねとても嬉しいですが明日は雨が降るでしょうから傘が要ります"
    for conv in range(80):
        texts = []
        for turn in range(12):
            text = " ".join(r.choice(WORDS) + r.choice(["", ",", "s"]) for _ in range(r.randint(12, 40))) + "."
            if r.random() < 0.1:
                text = cjk + str(conv) + "x" * turn
            lines = [text]
            if turn and r.random() < 0.5:
                k = r.randrange(turn)
                words = texts[k].split()
                at = r.randrange(1, max(2, len(words) - 9))
                cut = words[at : at + r.randint(6, 8)] if r.random() < 0.5 else [*words[1:7], r.choice(["[...]", "...", "…", "(...)"]), *words[-7:-1]]
                quote = cjk[5:20] if len(words) == 1 else " ".join(cut)
                lines = ["> " * r.choice([1, 1, 2]) + quote, *lines]
                if len(words) > 1:
                    want[conv, turn] = k
            elif r.random() < 0.2:
                lines = ["> " + " ".join(r.choice(WORDS) for _ in range(9)), *lines]  # no message has it
            texts.append(text)
            rows.append((conv, turn, "user", "\n".join(lines)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): x.parent for x in chat.conversations(df).collect()}
    right = sum(got[m] == k for m, k in want.items())
    assert right >= 0.98 * len(want) and sum(p is not None for m, p in got.items() if m not in want and f"> {cjk[5:20]}" not in rows[m[0] * 12 + m[1]][3]) == 0, (right, len(want))
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    sql = con.sql(oracles.chat_sql())
    out = chat.formatted(df).select(*sql.columns).collect()
    assert sorted(map(tuple, out)) == sorted(sql.fetchall())


def test_chat_links_a_very_long_message_cut_anywhere(spark):
    long = " ".join(f"word{k * k % 9973}x{k}" for k in range(200_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "another"), (1, 2, "user", "> " + " ".join(long.split()[123_456:123_465]) + "\nyes"), (None, 3, "user", "one two three four five six seven"), (None, 4, "user", "> three four five six seven\nno")]
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.parent for r in out} == {0: None, 1: None, 2: 0, 3: None, 4: 3}


# 8 ---------------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    sh = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    base = prose(7, 400).split()
    near = [(20 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), None, "a") for k in range(0, 60, 3)]
    rows = [*EDGE, (10, " ".join(base), None, "a"), (11, " ".join(base).upper(), None, "a"), *near, (90, prose(8, 50), None, "a")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(table(spark, rows)).collect()]
    fps = [brute_print(t) for _, t, *_ in rows]
    root = brute_components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = [(i, f"{fps[k]:016x}", least.get(root[k])) for k, (i, *_) in enumerate(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash_dedup.near_duplicates(table(spark, [])).count() == 0


def test_texts_in_short_runs_keep_their_fingerprint(monkeypatch):
    whole = simhash_dedup.word_runs
    for text in ("data: " + "x" * 50 + " more words and a few others", "two words" + " " * 60, "one " + " " * 50 + "b c" + " " * 50 + "d e f", prose(3, 40)):
        for most in (1, 4, 12, 30, 200):
            monkeypatch.setattr(simhash_dedup, "word_runs", lambda data, overlap, most=most: whole(data, overlap, most))
            assert simhash_dedup.fingerprint(text.encode()) == brute_print(text), (text, most)


def test_links_lose_nothing_in_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK", 8)
    r = random.Random(6)
    fps = set()
    for centre in (r.getrandbits(64) for _ in range(6)):
        for _ in range(40):
            x = centre
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    root = brute_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups = lambda of: {frozenset(k for k in range(len(fps)) if of(k) == v) for v in {of(k) for k in range(len(fps))}}
    assert groups(lambda k: got.get(signed[k], signed[k])) == groups(lambda k: root[k])


def test_pivots_discard_most_pairs_and_no_link():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2)
    b = r.integers(0, 1 << 63, 20_000, np.uint64)
    near = a.copy()
    for _ in range(simhash_dedup.RADIUS):
        near ^= np.uint64(1) << r.integers(0, 64, len(a)).astype(np.uint64)
    gap = lambda x, y: np.abs(simhash_dedup.coordinates(x) - simhash_dedup.coordinates(y)).max(axis=1)
    assert (gap(a, near) <= simhash_dedup.RADIUS).all() and (gap(a, b) > simhash_dedup.RADIUS).mean() > 0.99
    assert all((simhash_dedup.coordinates(a)[:, 3] - simhash_dedup.coordinates(np.zeros(1, np.uint64))[0, 3]) % 2 == np.bitwise_count(a) % 2)


@pytest.mark.parametrize("n", [10, 20_000, 10**6, 10**8, 10**10])
def test_segments_agree_for_all_linked_fingerprints(n):
    cut = simhash_dedup.segments(n)
    assert cut[0][0] == 0 and sum(w for _, w in cut) == 64 and all(s + w == t for (s, w), (t, _) in zip(cut, cut[1:]))
    bits = sum(sorted(w for _, w in cut)[: len(cut) - simhash_dedup.RADIUS])
    assert len(cut) > simhash_dedup.RADIUS and n / 2**bits <= 8


def test_components_of_a_hub_are_split_and_whole(spark):
    edges = spark.range(1, 4000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(5000, 5010).select("id", F.col("id") + 1))
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert all(got[k] == 0 for k in range(4000)) and all(got[k] == 5000 for k in range(5000, 5011)) and len(got) == 4011
    many = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    few = many.select("k").distinct().withColumn("y", F.col("k") * 2)
    assert split_join(many, few, "k", "x", 3000).where("y = 2 * k").count() == 3000


def test_components_of_a_path_and_of_nothing(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.root for r in components(path, "a", "b").collect()}
    assert all(got[k] == 0 for k in range(61)) and got[201] == 200 and 100 not in got
    assert components(path.limit(0), "a", "b").count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------


def test_ann_recall_scores_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[700:720] = x[0]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    odd = [(2000, None, ""), (2001, [0.0] * 16, ""), (2002, [float("nan")] + [1.0] * 15, ""), (2003, [float("inf")] + [1.0] * 15, ""), (2004, [None] + [1.0] * 15, ""), (2005, [1.0] * 3, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, v string")
    out = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    d64, hits, n = x.astype(np.float64), 0, 0
    for q in range(0, 1500, 100):
        s = np.sqrt(((d64 - d64[q]) ** 2).sum(axis=1))
        s[q] = np.inf
        best = np.lexsort((np.arange(1500), s))[:10]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11)) and all(abs(s[r.vec_id] - r.score) < 1e-12 for r in got)
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        hits, n = hits + len({r.vec_id for r in got} & set(best.tolist())), n + 10
    assert hits / n >= 0.9 and not {r.query_id for r in out} & {2000}
    assert [r.vec_id for r in sorted((r for r in out if r.query_id == 0), key=lambda r: r.rank)] == list(range(700, 710))
    twice = ann.search(df, df.where("vec_id % 100 = 0").union(df.where("vec_id = 100")).union(spark.createDataFrame([(300, [1.0] * 3, "")], df.schema))).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, out))
    other = spark.createDataFrame([(9, [1.0] * 3, "")], df.schema)
    assert ann.search(df, other).count() == 0
    few = ann.search(df.where("vec_id < 4 OR vec_id >= 2000"), df.where("vec_id = 0"))
    assert few.count() == 3 and ann.search(df.limit(0), df).count() == 0 and ann.search(df.where("vec_id >= 2000 AND vec_id < 2005"), df).count() == 0


@pytest.mark.parametrize("n,spread", [(40, 1.0), (3000, 1.0), (6000, 0.2)])
def test_ann_recall_on_all_sizes(spark, tmp_path, n, spread, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 50)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, n)] * (1 if spread < 1 else 0) + spread * rng.normal(size=(n, 24))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}), f"{tmp_path}/e.parquet")
    df = spark.read.parquet(f"{tmp_path}/e.parquet")
    out = ann.search(df, df.where("vec_id % 20 = 0")).collect()
    hits = 0
    for q in range(0, n, 20):
        s = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        s[q] = np.inf
        hits += len({r.vec_id for r in out if r.query_id == q} & set(np.argsort(s, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * len(range(0, n, 20)) and len(out) == 10 * len(range(0, n, 20))


def test_ann_keeps_the_neighbours_inside_a_group_of_near_copies(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, 64))
    x[:1500] = x[0] + 0.01 * rng.normal(size=(1500, 64))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}), f"{tmp_path}/e.parquet")
    df = spark.read.parquet(f"{tmp_path}/e.parquet")
    out = ann.search(df, df.where("vec_id < 1500 AND vec_id % 100 = 0")).collect()
    for q in range(0, 1500, 100):
        s = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        s[q] = np.inf
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in got] == np.argsort(s, kind="stable")[:10].tolist()


# 10 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [3, 14, 59, 127, 128, 255, 256, 300])
def test_window_prints(size):
    h = np.random.default_rng(size).integers(0, 1 << 63, 400, np.uint64) * np.uint64(2) + np.uint64(1)
    got = decontaminate.window_prints(h, size)
    assert len(got) == 401 - size
    for k in (0, 5, len(got) - 1):
        assert int(got[k]) == sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h[k : k + size]) * 2 > size)
    assert len(decontaminate.window_prints(h[:2], size)) == 0


def test_candidates_are_all_within_the_radius():
    rng = np.random.default_rng(8)
    index = decontaminate.ItemIndex([(k, prose(k, 15 + k % 40).encode()) for k in range(60)])
    for size, (refs, *_) in index.tables.items():
        prints = rng.choice(refs, 3000)
        for k in range(3000):
            for b in rng.choice(64, rng.integers(0, 11), replace=False):
                prints[k] ^= np.uint64(1) << np.uint64(b)
        got = set(zip(*(x.tolist() for x in index.candidates(prints, size)), strict=True))
        assert got == {(i, j) for i in range(3000) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ refs) <= decontaminate.RADIUS).tolist()}


def test_decontamination(spark, monkeypatch):
    items = [(k, prose(1000 + k, 14 + k)) for k in range(30)] + [(50, "Tiny one"), (51, None), (52, " ... "), (53, prose(1500, 320)), (None, prose(1501, 18))]
    text = dict(items)
    clean = [(200 + k, prose(k, 300), None, "a") for k in range(20)]
    edited = text[25].split()
    edited[30] = "other"
    rows = [*EDGE, *clean, (10, f"{prose(1, 90)} {text[3].upper()}! {prose(2, 40)}", None, "a"), (11, f"{text[7]}\n{text[8]}", None, "a"), (12, " ".join(edited), None, "a"), (13, prose(5, 70_000) + " " + text[9] + " " + prose(6, 9), None, "a"), (14, "a tiny, one b", None, "a"), (15, prose(9, 20) + " " + text[53], None, "a"), (10, text[4], None, "a"), (16, text[20].rsplit(" ", 20)[0], None, "a"), (17, text[None], None, "a")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    want = [(10, 3), (10, 4), (11, 7), (11, 8), (12, 25), (13, 9), (14, 50), (15, 53), (17, None)]
    out = decontaminate.matches(table(spark, rows), bench)
    assert rows_of(out, "doc_id", "item_id") == sorted(want, key=str)
    place = {(r.doc_id, r.item_id): (r.first_word, r.similarity) for r in out.collect()}
    assert place[10, 3] == (90, 1.0) and place[13, 9] == (70_000, 1.0) and 0.8 <= place[12, 25][1] < 1
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 100)
    assert rows_of(decontaminate.matches(table(spark, rows), bench), "doc_id", "item_id") == sorted(want, key=str)
    assert decontaminate.matches(table(spark, []), bench).count() == 0 and decontaminate.matches(table(spark, rows), bench.limit(0)).count() == 0


def test_edited_passages_are_found_as_by_brute_force():
    r = random.Random(12)
    items = [(k, prose(3000 + k, 15 + k % 45).encode()) for k in range(60)] + [(90, b"tiny one")]
    index, texts, want = decontaminate.ItemIndex(items), [], {}
    for k, (_, text) in enumerate(items[:60]):
        for edit in range(8):
            words = text.split()
            ends = r.sample(range(min(6, len(words))), 1 + edit % 2) + [len(words) - 1 - x for x in r.sample(range(6), 1 + edit // 2 % 2)]
            for at in ends:
                words[at] = b"edited"
            if edit > 5:
                words.insert(len(words) // 2, b"more")
            full = prose(5000 + 8 * k + edit, 30).encode().split() + words + prose(6000 + 8 * k + edit, 30).encode().split()
            best = max(index.similarity(k, full[at : at + len(text.split())]) for at in range(len(full)))
            if best >= decontaminate.SIMILARITY:
                want[len(texts), k] = best
            texts.append(b" ".join(full))
    got = {(n, item): sim for n, item, _, _, sim in decontaminate._scan(index, texts)}
    assert len(want) > 50 and set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_word_hashes_depend_on_the_word_alone():
    texts = [prose(k, 200).encode().translate(decontaminate._FOLD) for k in range(5)] + ["é x ü éé  ".encode(), b" ", b""]
    known = {}
    for t in texts:
        starts, ends, hashes = decontaminate.word_hashes(t)
        assert [t[a:b] for a, b in zip(starts, ends, strict=True)] == t.split()
        for w, h in zip(t.split(), hashes.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_no_item_is_too_long_and_no_offset_is_lost(monkeypatch):
    item = prose(4000, 700)
    index = decontaminate.ItemIndex([(1, item.encode()), (None, prose(4001, 9).encode())])
    monkeypatch.setattr(decontaminate, "STEP", 900)
    filler = prose(4002, 3000).split()
    for at in range(0, 3000, 41):
        (found,) = decontaminate._scan(index, [" ".join([*filler[:at], item, *filler[at:]]).encode()])
        assert found == (0, 0, at, 700, 1.0)
    monkeypatch.undo()
    for n, at in ((40_000, 50_000), (70_000, 0), (70_000, 33_333)):
        item = prose(n, n)
        index = decontaminate.ItemIndex([(1, item.encode())])
        text = f"{prose(1, at)} {item} {prose(2, 20_000)}"
        assert decontaminate._scan(index, ["".encode(), text.encode()]) == [(1, 0, at, n, 1.0)]


def test_repeated_shingles_and_text_ends_as_by_brute_force():
    r, items = random.Random(3), [(0, b"a b a b a b a b a b a b c"), (1, b"x y z x y z x y z q"), (2, b"q w")]
    index = decontaminate.ItemIndex(items)
    for _ in range(300):
        words = [r.choice([b"a", b"b", b"x", b"y", b"z", b"q", b"w"]) for _ in range(r.randint(0, 25))]
        words[r.randint(0, len(words)) : 0] = items[r.randrange(3)][1].split()
        want = {}
        for k, (_, t) in enumerate(items):
            n = len(t.split())
            sims = [index.similarity(k, words[a : a + n]) for a in range(len(words))]
            if max(sims) >= decontaminate.SIMILARITY:
                want[k] = max(sims)
        assert {item: pytest.approx(sim) for _, item, _, _, sim in decontaminate._scan(index, [b" ".join(words)])} == want


def test_fingerprints_alone_find_most_edited_passages():
    r = random.Random(5)
    items = [(k, prose(7000 + k, 16 + k % 44).encode()) for k in range(120)]
    index = decontaminate.ItemIndex(items)
    index.anchors = {}
    met = total = 0
    for k, (_, text) in enumerate(items):
        words = text.split()
        words[r.randrange(len(words))] = b"edited"
        full = prose(8000 + k, 40).encode().split() + words + prose(9000 + k, 40).encode().split()
        if index.similarity(k, full[40 : 40 + len(words)]) >= decontaminate.SIMILARITY:
            total, met = total + 1, met + any(f[1] == k for f in decontaminate._scan(index, [b" ".join(full)]))
    assert total > 80 and met >= 0.95 * total
