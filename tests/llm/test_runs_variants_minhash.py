"""Operators 11 to 13 against brute force, on small hand-made tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from rastertable.llm import minhash_dedup, periodic_runs, spelling_variants

DOCS = "doc_id long, text string, word string, node long, n long, cell string, row_key string, set string"
LONG = " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 20_000, 40_000))
EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, LONG), (None, "no id here"), (5, "  two   spaces \n\n tab\t "), (6, "日本語 ÉÈ \x00 nul"), (None, None), (7, "a b c d")]


def table(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", 1, 1, "x", "x", "x") for i, t in rows], DOCS)


def rows_of(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


# 11 --------------------------------------------------------------------------------------------------------------


def all_runs(w):
    """Every diagonal from end to end; of one stretch the smallest period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("kind", range(4))
def test_runs_against_all_diagonals(kind):
    r = random.Random(kind)
    total = 0
    for _ in range(1500):
        w: list[int] = []
        n = r.randrange(0, 110)
        while len(w) < n:
            p = [r.randrange(3) for _ in range(r.randrange(1, 10))]
            w += [[r.randrange(2)], [r.randrange(3)], (p * 9)[: r.randrange(1, 70)], p + [r.randrange(50)] * r.randrange(3)][kind]
        expected = all_runs(w)
        assert periodic_runs.find_runs(np.array(w, np.int32)) == expected
        total += len(expected)
    assert total > 100


@pytest.mark.parametrize("words, n_runs", [([1] * 200_000, 1), (list(range(700)) * 300, 1), (([1] * 9 + [2]) * 20_000, 20_001), ([x for k in range(8000) for x in [100 + k, *range(25)]], 0)])
def test_runs_of_long_texts_open_few_diagonals(words, n_runs):
    ids = np.array(words, np.int32)
    assert len(periodic_runs.openings(ids)) < 8 * len(words)
    assert len(periodic_runs.find_runs(ids)) == n_runs


def expected_digest(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w) if n < 2000 else []
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return doc_id, n, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped))


def test_run_digests_and_collapsed_texts(spark):
    r = random.Random(3)
    rows = EDGE + [(100 + k, " ".join(r.choice("abc") for _ in range(r.randrange(0, 150)))) for k in range(200)] + [(400 + k, " ".join(f"v{r.randrange(400)}" for _ in range(r.randrange(1, 200)))) for k in range(200)]
    names = [x.split()[0] for x in periodic_runs.SCHEMA.split(", ")]
    got = rows_of(periodic_runs.run_digests(table(spark, rows), periodic_runs.repeated_tail), *names)
    expected = sorted((expected_digest(*x) for x in rows), key=str)
    assert got == expected
    assert sum(x[2] > 0 for x in expected) > 40
    texts = {x.doc_id: (x.collapsed, x.runs) for x in periodic_runs.collapse(table(spark, [(1, "a b a b a b a b c"), (2, None), (3, "spam " * 1000)])).collect()}
    assert texts[1] == ("a b c", [(0, 8, 2)]) and texts[2] == ("", []) and texts[3] == ("spam", [(0, 1000, 1)])
    assert periodic_runs.run_digests(table(spark, []), periodic_runs.repeated_tail).count() == 0


# 12 --------------------------------------------------------------------------------------------------------------


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and is_near(w, x)] for w in counts}
    best = {w: min(c, key=lambda x: (-counts[x], x)) for w, c in near.items() if c}
    form = {w: b for w, b in best.items() if counts[b] >= 2 * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=str)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("dense", [16, 0])
def test_variants_against_all_pairs_whatever_the_chunks(spark, monkeypatch, dense):
    monkeypatch.setattr(spelling_variants, "DENSE", dense)
    r = random.Random(dense)
    counts = {"".join(r.choice("abé") for _ in range(r.randrange(5, 9))): r.randrange(3, 200) for _ in range(400)} | {"x" * k: 3 << k for k in range(5, 14)}
    got = rows_of(spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")), *COLUMNS)
    assert got == expected_variants(counts)
    assert {"x" * 13} == {x[2] for x in got if x[0].startswith("x")}


def test_variants_of_documents(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdeÀéß÷") for _ in range(r.randrange(4, 9))) for _ in range(150)]
    rows = EDGE + [(k, " ".join(r.choice(words) + r.choice(["", ".", "Z", "9", "ő"]) for _ in range(60))) for k in range(100, 300)] + [(None, " ".join(words))]
    counts: Counter = Counter()
    for doc_id, text in rows:
        for x in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    got = rows_of(spelling_variants.spelling_variants(table(spark, rows)), *COLUMNS)
    assert got == expected_variants(counts)
    assert sum(x[1] is not None for x in got) > 50
    assert spelling_variants.spelling_variants(table(spark, [])).count() == 0
    assert spelling_variants.spelling_variants(table(spark, [(1, None), (2, "")])).count() == 0


# 13 --------------------------------------------------------------------------------------------------------------


def expected_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else {(x,) for x in w})
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    low: dict[int, int] = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    return sorted(((i, len(s), low.get(x), i == low.get(x)) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=str)


@pytest.mark.parametrize("block", [256, 7])
def test_minhash_components_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    r = random.Random(block)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = [*EDGE, (8, "ONE"), (None, "a b"), (9, "A B")]
    for _ in range(5):
        base = [r.choice(vocabulary) for _ in range(60)]
        for _ in range(40):  # copies around the limit
            w = list(base)
            for _ in range(r.randrange(0, 7)):
                w[r.randrange(60)] = r.choice(vocabulary)
            rows.append((len(rows) * 7 % 1000 + 10, " ".join(w)))
        w = list(base)
        for _ in range(20):  # a chain whose ends have little in common
            w = list(w)
            w[r.randrange(60)], w[r.randrange(60)] = r.choice(vocabulary), r.choice(vocabulary)
            rows.append((1000 + len(rows), " ".join(w)))
    got = rows_of(minhash_dedup.near_duplicates(table(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == expected_components(rows)


def test_minhash_pairs_of_one_cell_that_miss_the_centre_are_found():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 63, 100, np.uint64)) for _ in range(3)]
    sets += [np.sort(np.r_[s[:95], r.integers(0, 1 << 63, 5, np.uint64)]) for s in sets]
    minima = np.array([minhash_dedup.signature(s) for s in sets])
    for band in range(minhash_dedup.BANDS):
        shared = [(minima[k] == minima[k + 3]).reshape(-1, minhash_dedup.ROWS).all(axis=1).argmax() == band for k in range(3)]
        found = minhash_dedup.block_links(band, list(range(6)), list(range(6)), np.ones(6, bool), minima, sets)
        assert found == [(k, k + 3) for k in range(3) if shared[k]]
        assert minhash_dedup.block_links(band, list(range(6)), [0, 1, 2] * 2, np.ones(6, bool), minima, sets) == []
        two = minhash_dedup.block_links(band, list(range(6)), list(range(6)), np.arange(6) < 3, minima, sets)
        assert two == found


def test_minhash_of_empty_tables(spark):
    assert minhash_dedup.near_duplicates(table(spark, [])).count() == 0
    assert rows_of(minhash_dedup.near_duplicates(table(spark, [(1, None), (2, "")])), "doc_id", "n_shingles", "component_id", "kept") == [(1, 0, 1, True), (2, 0, 2, True)]


# 10: matches do not depend on blocks -----------------------------------------------------------------------------


def test_matches_are_the_same_whatever_the_blocks(spark, monkeypatch):
    from rastertable.llm import decontaminate

    r = random.Random(10)
    vocabulary = [f"v{k}" for k in range(300)]
    shared = [" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(3)]  # boilerplate of many items: its weight depends on the whole benchmark
    items = [(k, f"{r.choice(shared)} {' '.join(r.choice(vocabulary) for _ in range(r.randrange(4, 20)))}") for k in range(40)] + [(40, "short one"), (40, "short one"), (None, "a b c d e f"), (41, ""), (42, None)]
    rows = []
    for k in range(120):
        w = r.choice(items[:40])[1].split()
        for _ in range(r.randrange(0, 3)):  # around the limit
            w[r.randrange(len(w))] = "x"
        rows.append((k, " ".join([*(r.choice(vocabulary) for _ in range(5)), *w, *(r.choice(vocabulary) for _ in range(5))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, [*rows, (200, "a short one b"), (201, None), (201, LONG)])
    names = ("doc_id", "item_id", "first_word", "n_words", "similarity")
    whole = decontaminate.ItemIndex([(i, t.encode()) for i, t in items if t])
    want = sorted(((i, whole.ids[k], at, n, sim) for i, t in [(d.doc_id, d.text or "") for d in docs.collect()] for _, k, at, n, sim in decontaminate._scan(whole, [t.encode()])), key=str)
    assert len({x[0] for x in want}) > 60 and any(x[4] < 0.9 for x in want)
    for words in (30, 100, 500_000):
        monkeypatch.setattr(decontaminate, "ITEM_WORDS", words)
        assert rows_of(decontaminate.matches(docs, bench), *names) == want


# 1: equal rows fill several shards -------------------------------------------------------------------------------


def test_equal_rows_are_spread_over_the_shards(spark, monkeypatch):
    import public_tokenizers

    from rastertable.llm import token_files

    docs = spark.range(100_000).selectExpr("IF(id < 90000, 7L, id) AS doc_id", "IF(id < 90000, 'the same words', concat('other ', id)) AS text").repartition(4)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 5000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one shard
    blocks = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()}
    assert sum(shards.values()) == 100_000 and len(shards) >= 4 and max(shards.values()) < 2 * 100_000 / len(shards)
    found = token_files.read_documents(blocks)
    assert found.where("doc_id = 7").select("ids_crc32", "n_tokens").distinct().count() == 1
    starts = sorted((r.start, r.n_tokens) for r in found.select("start", "n_tokens").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    order = [r.doc_id for r in found.orderBy("start").select("doc_id").collect()]
    assert order == sorted(order)
