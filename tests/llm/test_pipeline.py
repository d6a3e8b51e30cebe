"""The pipeline on a small corpus with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from rastertable.llm import mixing, simhash_dedup
from rastertable.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(kind, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(kind) for _ in range(3)) for _ in range(n))


def test_stages(spark, tmp_path):
    a, b = ["shu", "kra", "mog", "wit"], ["éla", "oui", "nté", "ber"]
    item = words(a, 900, 40)
    rows = [(i, words(a if i % 2 else b, i, 120), "xx" if i % 2 else "yy", f"s{i % 4}") for i in range(160)]
    rows += [(300, rows[5][1], "xx", "s0"), (301, rows[5][1] + " end", "xx", "s1"), (302, None, "xx", "s0"), (303, "12 34", None, "s0"), (304, f"{words(a, 901, 60)} {item} {words(a, 902, 60)}", "xx", "s2"), (7, rows[7][1], "xx", "s3"), (None, words(b, 903, 90), "yy", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == COLUMNS
        ids.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
    known, single, clean, mixed = ids
    assert set(known) == {r[0] for r in rows} - {302, 303} and known.count(7) == 2
    assert set(single) == set(known) - {300, 301} and single.count(7) == 1
    assert set(clean) == set(single) - {304} and len(clean) == len(single) - 1
    assert set(mixed) <= set(clean) and mixed
    out = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert sorted((r.doc_id for r in out.collect()), key=str) == mixed
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)


def test_documents_whose_64_bit_keys_are_equal_are_both_kept(spark, tmp_path, monkeypatch):
    a = ["shu", "kra", "mog", "wit"]
    item = words(a, 900, 40)
    rows = [(i, words(a, i, 80), "xx", "s0", 1) for i in range(40)] + [(40, words(a, 3, 80), "xx", "s0", 1), (41, f"{words(a, 41, 30)} {item}", "xx", "s0", 1)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(simhash_dedup, "row_key", lambda: F.lit(7).cast("long"))
    single = written(corpus_pipeline.keep_one_of_each_group(spark, docs, str(tmp_path)), "single")
    assert sorted(r.doc_id for r in single.collect()) == [*range(40), 41]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, single, str(tmp_path)).collect()) == list(range(40))
    keys = docs.select(simhash_dedup.wide_key().alias("k")).union(spark.createDataFrame([(None, None), (None, ""), (1, "-")], "doc_id long, text string").select(simhash_dedup.wide_key()))
    assert keys.distinct().count() == 42 + 3


def test_words_by_source_are_near_their_targets_after_whole_documents(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(20, 200)), ["big", "mid", "small"][min(2, r.randrange(8) // 3)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {x.source: x.target for x in mixing.taken(docs).select("source", "target").distinct().collect()}
    got = {x.source: x.n for x in mixing.mixed(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert len(targets) == 3
    for source, target in targets.items():
        assert abs(got.get(source, 0) - target) <= 0.1 * target, (source, got.get(source), target)


def test_clashing_columns_pass_and_empty_tables_give_empty_results(spark, tmp_path):
    extra = ["score", "lang_pred", "rejected", "row_key", "copy", "place", "size", "h"]
    a = ["shu", "kra", "mog", "wit"]
    rows = [(i, words(a, i, 60), "xx", "s0", 9, *[f"{c}{i}" for c in extra]) for i in range(30)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    spark.createDataFrame([(1, words(a, 900, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/full/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/full/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, f"{tmp_path}/full"), name)
        assert docs.columns == [*COLUMNS, *extra]
        assert all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in extra)
    assert docs.select("doc_id").distinct().count() == 30
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
