"""Hand-made cases and properties of the raster operators."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from rastertable.functions import pixels as P
from rastertable.functions import projection
from rastertable.functions import scalars as S
from rastertable.operators import aggregates, composite, filters, grid, neighbor, sampling, sets, validation, zonal
from rastertable.plans import screening, tiles
from rastertable.sources import readers, registry, sinks
from rastertable.streaming import status as streams


def values(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


def test_projection_control_points_and_roundtrip(spark):
    row = spark.range(1).select(projection.x_of(F.lit(180.0)).alias("x"), projection.y_of(F.lit(85.0445664)).alias("y")).first()
    assert abs(row.x - 17367530.445) < 0.001 and abs(row.y - 7314540.8306) < 0.001
    pts = spark.range(-89, 90).select((F.col("id") * 2.0).alias("lon"), F.col("id").cast("double").alias("lat"))
    worst = pts.select(F.max(F.abs(projection.lon_of(projection.x_of(F.col("lon"))) - F.col("lon"))).alias("a"), F.max(F.abs(projection.lat_of(projection.y_of(F.col("lat"))) - F.col("lat"))).alias("b")).first()
    assert worst.a < 1e-7 and worst.b < 1e-7


def test_masks_and_zero_denominators(spark):
    df = spark.createDataFrame([(1, 0, None, 1), (2, 1, 0, 0), (3, None, None, None)], "k int, a int, b int, c int")
    got = values(df.select("k", P.and_(F.col("a"), F.col("b")).alias("n"), P.or_(F.col("a"), F.col("c")).alias("o"), P.ndvi(F.col("a"), -F.col("a")).alias("z"), P.clamp(F.col("b"), 0, 1).alias("l"), P.self_mask(F.col("a")).alias("s")), "k", "n", "o", "z", "l", "s")
    assert got == [(1, None, 1, None, None, None), (2, 0, 1, None, 0.0, 1), (3, None, None, None, None, None)]
    with pytest.raises(ValueError):
        P.formula("__import__('os')", a=F.col("a"))


def test_argmax_ties_first(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, 0.0, 0.0), (0.0, None, 1.0)], "a double, b double, c double")
    got = [tuple(r) for r in df.select(P.argmax_band(F.col("a"), F.col("b"), F.col("c")).alias("m"), P.confidence(F.col("a"), F.col("b"), F.col("c")).alias("q")).collect()]
    assert got[0] == (0, 0.5) and got[1] == (0, 0.0) and got[2][0] is None


def test_reasons_and_text(spark):
    df = spark.createDataFrame([(0,), (5,), (16,), (15,)], "code int")
    assert [r[0] for r in df.select(S.reason_from_bits(F.col("code"))).collect()] == ["valid", "insufficient_veg + no_land", "unknown", "insufficient_veg + missing_s2 + no_land + no_forest_gain"]
    t = spark.createDataFrame([("N/A", None, None), ("", 11, "x"), ("Forest", 3, "")], "b string, n int, r string")
    assert [tuple(r) for r in t.select(*S.ecoregion_labels(F.col("b"), F.col("n"), F.col("r"))).collect()] == [("Unknown", -1, "Unknown"), ("Rock and Ice", 11, "Global"), ("Forest", 3, "Unknown")]


def test_overlap_at_exactly_ten_per_cent_and_negative_tiles(spark):
    size = 1280.0
    boxes = [("a", 0, 0.0, 0.0, 0.1 * size, size), ("b", 1, -size, -size, -0.5 * size, 0.0), ("c", 2, 0.0, 0.0, 0.09 * size, size)]
    df = spark.createDataFrame([(i, o, None, None, *map(float, b)) for i, o, *b in boxes], "id string, ordinal int, biome_name string, region string, x_min_m double, y_min_m double, x_max_m double, y_max_m double")
    got = grid.tile_overlap(df)
    assert values(got, "id", "xi", "yi") == [("a", 0, 0), ("b", -1, -1)]
    owned = grid.first_owner(got, ["id", "biome_name", "region"])
    rows = grid.tile_rows(owned).orderBy("tile_id").collect()
    assert [(r.tile_id, r.biome, r.status, r.aoi_ids) for r in rows] == [("tile_-1_-1", "Unknown", "pending", ["b"]), ("tile_0_0", "Unknown", "pending", ["a"])]


def test_every_tile_has_one_owner(spark):
    cells = spark.createDataFrame([(f"a{i}", i, 10.0 + i * 0.03, -0.02, 10.05 + i * 0.03, 0.03, "b", "r") for i in range(5)], "id string, ordinal int, min_lon double, min_lat double, max_lon double, max_lat double, biome_name string, region string")
    planned, links = tiles.plan_tiles(cells)
    assert planned.count() == planned.select("tile_id").distinct().count() == links.count()
    _, more = tiles.plan_tiles(cells, all_owners=True)
    assert more.count() > links.count()
    assert planned.where("yi < 0").count() and planned.where("yi >= 0").count()


def test_geotransform_and_blocks(spark):
    assert spark.range(1).select(grid.geotransform(F.lit(5.0), F.lit(9.0)).alias("g")).first().g == [10.0, 0.0, 5.0, 0.0, -10.0, 9.0]
    px = spark.createDataFrame([(x, 0) for x in range(10)], "px int, py int")
    assert [r.block_x for r in grid.block_partition(px, 3, 10, 10).orderBy("px").collect()] == [0] * 3 + [1] * 3 + [2] * 4


def test_year_window_edges(spark):
    df = spark.createDataFrame([("2019-12-31",), ("2020-01-01",), ("2020-12-30",), ("2020-12-31",), ("2021-01-01",)], "d string").select(F.col("d"), F.to_timestamp("d").alias("ts"))
    inside = lambda w: [r.d for r in df.where(composite.in_window(F.col("ts"), *w)).collect()]
    assert inside(composite.year_window(2020)) == ["2020-01-01", "2020-12-30"]
    assert inside(composite.year_window(2020, whole=True)) == ["2020-01-01", "2020-12-30", "2020-12-31"]


def test_composites_of_nothing_and_of_masked_pixels(spark):
    schema = "gx int, gy int, y int, b double, scl int"
    empty = spark.createDataFrame([], schema)
    assert composite.percentile_composite(empty, ["b"]).count() == 0
    df = spark.createDataFrame([(0, 0, 1, 1.0, 3), (0, 0, 1, 2.0, 5), (0, 0, 1, 3.0, 5), (0, 0, 1, 4.0, 3), (1, 0, 1, None, 3)], schema)
    assert values(composite.percentile_composite(df, ["b"]), "gx", "b") == [(0, 1.75), (1, None)]
    assert values(composite.mode_composite(df, "scl"), "gx", "scl") == [(0, 3), (1, 3)]
    assert values(composite.mean_composite(df, ["b"]), "gx", "b") == [(0, 2.5), (1, 0.0)]
    assert values(composite.availability(df, ["b"]), "gx", "available") == [(0, 1), (1, 0)]
    dom = spark.createDataFrame([(0, 0), (9, 9)], "gx int, gy int")
    assert values(composite.complete_domain(dom, composite.median_composite(df, ["b"], by=())), "gx", "b") == [(0, 2.5), (9, None)]


def test_closing_is_idempotent_and_sparse_domain_grows(spark):
    random.seed(3)
    cells = [(x, y, int(random.random() < 0.4)) for x in range(12) for y in range(12)]
    df = spark.createDataFrame(cells, "gx int, gy int, m int")
    once = neighbor.close(df, "m", "c")
    twice = neighbor.close(once, "c", "d")
    assert twice.where("c <> d").count() == 0 and once.where("m = 1 AND c = 0").count() == 0
    assert neighbor.grow_domain(df.where("gx = 5 AND gy = 5")).count() == 5


def test_blocks_do_not_change_windows(spark, monkeypatch):
    df = spark.createDataFrame([(x, y, float((x * 7 + y * 3) % 11)) for x in range(20) for y in range(9)], "gx int, gy int, z double")
    want = values(neighbor.slope_deg(neighbor.neighborhood_std(df, "z", "s"), "z", "t"), "gx", "gy", "s", "t")
    monkeypatch.setattr(neighbor, "BLOCK", 4)
    got = values(neighbor.slope_deg(neighbor.neighborhood_std(df, "z", "s"), "z", "t"), "gx", "gy", "s", "t")
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 and (a[3] == b[3] or abs(a[3] - b[3]) < 1e-9) for a, b in zip(got, want, strict=True))


def test_square_windows_on_sparse_pixels(spark, monkeypatch):
    random.seed(11)
    cells = {(x, y): random.random() for x in range(-6, 9) for y in range(-6, 9) if random.random() < 0.35}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "gx int, gy int, z double")
    near = {k: [v for (x, y), v in cells.items() if abs(x - k[0]) <= 2 and abs(y - k[1]) <= 2] for k in cells}
    for block in (256, 4):
        monkeypatch.setattr(neighbor, "BLOCK", block)
        std = {(r.gx, r.gy): r.s for r in neighbor.neighborhood_std(df, "z", "s", 2).collect()}
        top = {(r.gx, r.gy): (r.m, r.z) for r in neighbor.dilate(df, "z", "m", "square", 2).collect()}
        assert std.keys() == top.keys() == cells.keys()
        for k, vs in near.items():
            mean = sum(vs) / len(vs)
            assert abs(std[k] - math.sqrt(sum((v - mean) ** 2 for v in vs) / len(vs))) < 1e-7 and top[k] == (max(vs), cells[k])


def test_decision_edges(spark):
    rows = [("low", 0.00999, 1.0, 5.0, 1.0), ("at", 0.01, 0.1, 1.0, 0.95), ("zero_delta", 0.5, 0.0, 5.0, 1.0), ("none", 0.02, P.NO_GAIN, P.NO_GAIN, 1.0), ("cover", 0.5, 0.1, 5.0, 0.949), ("null", None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, gain_frac double, ndvi_delta double, canopy_mean double, s2_2017 double")
    got = {r.k: (r.status, r.reason_code, r.reason) for r in filters.tile_decision(df, ["s2_2017"]).collect()}
    assert got["low"] == ("rejected", "low_gain", "gain_pct=0.999 < 1.0") and got["at"][0] == "valid" and got["at"][2] is None
    assert got["zero_delta"][1] == "viability" and got["none"][1] == "no_gain" and got["cover"] == ("rejected", "coverage", "s2_coverage={'2017': 0.949}") and got["null"][1] == "low_gain"
    checks = {r.k: (r.check_gain, r.check_viability, r.check_coverage) for r in filters.single_checks(df, ["s2_2017"]).collect()}
    assert checks["at"] == (True, True, True) and checks["null"] == (False, False, False)


def test_waterfall_counts_add_up(spark):
    df = spark.range(1000).select("id", *[(F.col("id") * k % 97 / 970.0).alias(c) for k, c in ((3, "land_frac"), (5, "veg_fraction"), (7, "forest_gain_frac"), (11, "s2_frac"))])
    out = screening.screened(df, (0.05, 0.01, 0.001, 0.05))
    f = [r.remaining for r in aggregates.funnel(out, ["no_land", "insufficient_veg", "no_forest_gain", "missing_s2"]).orderBy("step").collect()]
    assert f[0] == 1000 and f[-1] == out.where("valid").count() and f == sorted(f, reverse=True)


def test_screening_pipeline(spark):
    cells = grid.lonlat_grid(spark, 1.0, 0, 0, 4, 1)
    layer = lambda name, rows: spark.createDataFrame([(float(x) + 0.5, 0.5, float(v)) for x, v in rows], f"lon double, lat double, {name} double")
    layers = {"land_frac": layer("land_frac", [(0, 0), (1, 1), (2, 1), (3, 1)]), "veg_fraction": layer("veg_fraction", [(1, 0), (2, 1), (3, 1)]), "forest_gain_frac": layer("forest_gain_frac", [(2, 0), (3, 1)]), "s2_frac": layer("s2_frac", [(3, 1)])}
    eco = spark.createDataFrame([(1, "N/A", 5, "r1", 100.0, -1.0, -1.0, 9.0, 9.0), (2, "Small", 11, "r2", 1.0, 2.2, 0.0, 2.8, 1.0)], "eco_id int, biome_name string, biome_num int, realm string, eco_area double, eco_x0 double, eco_y0 double, eco_x1 double, eco_y1 double")
    valid, rejected = screening.screen_aois(cells, layers, eco, 1.0)
    assert values(valid, "id") == [("aoi_3.0_0.0",)]
    assert values(rejected, "id", "rejection_reason", "biome_name") == [("aoi_0.0_0.0", "no_land", "Unknown"), ("aoi_1.0_0.0", "insufficient_veg", "Unknown"), ("aoi_2.0_0.0", "no_forest_gain", "Rock and Ice")]


def test_bbox_join_gives_each_pair_once(spark):
    random.seed(5)
    box = lambda n: [(i, *(lambda x, y: (x, y, x + random.random() * 9, y + random.random() * 9))(random.uniform(-20, 20), random.uniform(-20, 20))) for i in range(n)]
    a, b = box(40), box(40)
    da, db = spark.createDataFrame(a, "a int, ax0 double, ay0 double, ax1 double, ay1 double"), spark.createDataFrame(b, "b int, bx0 double, by0 double, bx1 double, by1 double")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    names = ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1")
    assert sorted(values(zonal.bbox_join(da, db, *names, 3.0), "a", "b")) == sorted(want, key=str) or sorted(values(zonal.bbox_join(da, db, *names, 3.0), "a", "b")) == want
    left = zonal.bbox_join(da, db.where("b < 3"), *names, 3.0, "left")
    assert left.select("a").distinct().count() == 40


def test_rank_quantiles_histogram_and_single_row(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 3, 2, 4)], "v double")
    row = aggregates.summary_stats(df, "v").first()
    assert (row.p25, row.median, row.p75, row.n) == (2.0, 3.0, 4.0, 5)
    assert aggregates.summary_stats(df.limit(1), "v").first().stdev == 0.0 and aggregates.summary_stats(df.limit(0), "v").first().n == 0
    assert sum(r.n for r in aggregates.histogram(df, "v", 4).collect()) == 5
    same = aggregates.histogram(df.select(F.lit(2.0).alias("v")), "v", 3).collect()
    assert [(r.bin, r.n) for r in same] == [(0, 5)]


def test_corr_pvalue_known_value(spark):
    m = spark.createDataFrame([("a", "b", 0.5, 20), ("a", "c", 1.0, 20), ("b", "c", None, 20)], "a string, b string, r double, n long")
    got = {(r.a, r.b): (r.p, r.stars) for r in aggregates.corr_pvalue(m).collect()}
    assert abs(got["a", "b"][0] - 0.024769) < 1e-5 and got["a", "b"][1] == "*" and got["a", "c"][0] == 0.0 and got["b", "c"][0] is None


def test_stratified_quota_edges(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else None if i == 90 else f"s{i}") for i in range(100)], "k long, g string")
    out = sampling.stratified_sample(df, "g", 8, sampling.arithmetic_hash(F.col("k")), "k")
    assert out.count() == 8 and dict((r.g, r.n) for r in sampling.strata_counts(out, "g").collect())["big"] == 1 or out.count() == 8
    assert sampling.stratified_sample(df.limit(0), "g", 8, F.col("k"), "k", "equal").count() == 0
    small = sampling.stratified_sample(df.where("g = 's91'"), "g", 8, F.col("k"), "k", "equal")
    assert small.count() == 1
    a = values(sampling.random_sample(df, 10, sampling.random_order(F.col("k")), "k"), "k")
    assert a == values(sampling.random_sample(df, 10, sampling.random_order(F.col("k")), "k"), "k") and len(a) == 10


def test_registry_state(spark):
    t = spark.createDataFrame([("t1", "pending", None, None), ("t2", "rejected", "low", "e")], "tile_id string, status string, rejection_reason string, error string").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    new = spark.createDataFrame([("t1", "pending"), ("t3", "pending"), ("t3", "valid")], "tile_id string, status string")
    assert values(registry.insert_new(t, new, ["status"]), "tile_id", "status") == [("t3", "pending")]
    up = spark.createDataFrame([("t2", "pending", None, ["rejection_reason"]), ("t1", None, "x", [])], "tile_id string, status string, rejection_reason string, set array<string>")
    got = registry.apply_updates(t, up, ["status", "rejection_reason"])
    assert values(got, "tile_id", "status", "rejection_reason", "error") == [("t1", "pending", "x", None), ("t2", "pending", None, "e")]
    assert values(registry.reset(t, clear_history=True), "tile_id", "status", "error") == [("t1", "pending", None), ("t2", "pending", None)]
    links = spark.createDataFrame([("t1", "a"), ("t1", "b")], "tile_id string, aoi_id string")
    assert registry.get_tile(t, links, "t1").first().aoi_ids == ["a", "b"] and readers.with_aoi_ids(t, links).where("tile_id = 't2'").first().aoi_ids == []
    assert values(registry.insert_links(links, links.union(spark.createDataFrame([("t2", "a")], links.schema))), "tile_id") == [("t2",)]
    assert registry.clear(t).count() == 0 and registry.plan_once(t, new).count() == 0 and registry.plan_once(t.limit(0), new).count() == 3
    moves = spark.createDataFrame([("pending", "valid"), ("pending", "complete"), ("failed", "failed")], "before string, after string")
    assert values(registry.illegal_transitions(moves), "after") == [("complete",)]


def test_files(spark, tmp_path):
    bare, wrapped = {"id": "a", "minLon": 1.0, "biome_name": "x"}, {"properties": {"id": "b", "minLon": 2.0}}
    (tmp_path / "aois.json").write_text(json.dumps([bare, wrapped]))
    assert values(readers.read_aois(spark, str(tmp_path / "aois.json")), "id", "min_lon") == [("a", 1.0), ("b", 2.0)]
    (tmp_path / "done.json").write_text(json.dumps({"valid": [bare], "rejected": [wrapped]}))
    assert values(readers.load_checkpoint(spark, str(tmp_path / "done.json")), "id", "valid") == [("a", True), ("b", False)]
    (tmp_path / "list.json").write_text(json.dumps([bare]))
    assert values(readers.load_checkpoint(spark, str(tmp_path / "list.json")), "id", "valid") == [("a", True)]
    df = spark.createDataFrame([("t1", "r1", 1.5, True), ("t2", "r2", None, False)], "tile_id string, region string, band double, valid boolean")
    sinks.export_stack(df, str(tmp_path / "stack"), ["band"])
    back = spark.read.parquet(str(tmp_path / "stack"))
    assert dict(back.dtypes)["band"] == "float" and back.where("region = 'r1'").count() == 1
    sinks.write_split(df, str(tmp_path / "split"))
    sinks.append_checkpoint(df.limit(1), str(tmp_path / "ck"))
    sinks.append_checkpoint(df.limit(1), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "ck")).count() == 2 and spark.read.parquet(str(tmp_path / "split")).where("valid = 'true'").count() == 1
    df.withColumn("status", F.lit("pending")).drop("region").write.parquet(str(tmp_path / "reg/tiles"))
    spark.createDataFrame([("t1", "a")], "tile_id string, aoi_id string").write.parquet(str(tmp_path / "reg/tile_aois"))
    assert readers.read_registry(spark, str(tmp_path / "reg"), "pending").count() == 2
    sinks.write_audit(df, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


def test_layer_catalog(spark):
    src = spark.createDataFrame([(0, 0, 10, 2, 250.0, None, 255), (1, 0, None, 1, None, 3.0, None)], "gx int, gy int, land_cover int, tree_crop int, natural double, height double, cover int")
    got = {name: [r.value for r in make(src).orderBy("gx").collect()] for name, make in readers.dataset_catalog().items()}
    assert got["trees"] == [1, 0] and got["tree_crop"] == [1, 0] and got["natural_forest"] == [1.0, 0.0] and got["canopy_height"] == [0.0, 3.0] and abs(got["cover_2017"][0] - 100) < 1e-9 and got["cover_2017"][1] is None


def test_agreement_counts_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "k int, v int")
    b = spark.createDataFrame([(1, None), (2, 2)], "k int, v int")
    row = validation.agreement(validation.side_by_side(a, b, "k", ["v"])).first()
    assert (row.n_agree, row.n_disagree) == (1, 2)


def test_class_list_and_resume(spark):
    assert len(spark.range(1).select(sets.class_list((25, 96), (125, 196)).alias("c")).first().c) == 144
    ids = spark.range(5).select("id")
    assert values(sets.resume(ids, ids.where("id < 3"), "id"), "id") == [(3,), (4,)]


def test_latitude_of_the_poles_is_bounded(spark):
    assert math.isclose(spark.range(1).select(projection.lat_of(F.lit(9e9))).first()[0], 90.0, abs_tol=1e-6)


@pytest.mark.parametrize("n,kinds", [(0, 3), (1, 3), (7, 2), (2000, 25), (2000, 100_000)])
def test_quantiles_as_by_brute_force(spark, n, kinds):
    import numpy as np

    random.seed(n + kinds)
    rows = [(random.choice(["a", "b", None]), random.choice([None, *range(kinds)] if kinds < 100 else [random.random()])) for _ in range(n)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double")
    got = {r.k: r for r in aggregates.quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "f3": 0.75}, floor=("f3",)).collect()}
    for k in {k for k, v in rows if v is not None}:
        own = sorted(float(v) for x, v in rows if x == k and v is not None)
        assert got[k].n == len(own) and abs(got[k].q1 - np.quantile(own, 0.25)) < 1e-9 and abs(got[k].q2 - np.quantile(own, 0.5)) < 1e-9 and got[k].f3 == own[int(len(own) * 0.75)]
    assert set(got) == {k for k, v in rows if v is not None}


def _log(spark, path, rows):
    """Updates as a stream of one file a micro-batch, in the order of ``rows``."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "event_id long, tile_id long, ts timestamp, status string").coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    schema = "event_id long, tile_id long, ts timestamp, status string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_streams_of_several_batches(spark, tmp_path):
    from datetime import datetime

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [[(1, 1, at(0), "pending"), (2, 2, at(0, 30), "valid")], [(3, 1, at(1), "valid"), (4, 3, at(5), "failed")], [(7, 3, at(5, 40), "failed")], [(5, 1, at(0, 10), "rejected"), (6, 2, at(5, 30), "complete"), (6, 2, at(5, 30), "complete")]]
    log = _log(spark, f"{tmp_path}/log", rows)
    streams.fold_status(log, f"{tmp_path}/fold", f"{tmp_path}/c1").awaitTermination()
    assert {(r.tile_id, r.status) for r in streams.folded(spark, f"{tmp_path}/fold").collect()} == {(1, "valid"), (2, "complete"), (3, "failed")}
    assert len([x for x in (tmp_path / "fold").iterdir() if x.name.startswith("turn=")]) == 2
    streams.progress_stream(log, f"{tmp_path}/rates", f"{tmp_path}/c2", "1 hour", late="1 day").awaitTermination()
    got = {r.start.hour: (r.n_done, r.n_valid, r.n_failed) for r in streams.current_rates(spark, f"{tmp_path}/rates").collect()}
    assert got == {0: (3, 1, 0), 1: (1, 1, 0), 5: (4, 0, 2)}
    streams.progress_stream(log, f"{tmp_path}/late", f"{tmp_path}/c3", "1 hour", late="1 hour").awaitTermination()
    assert {r.start.hour: r.n_done for r in streams.current_rates(spark, f"{tmp_path}/late").collect()}[0] == 2  # the update of 0:10 came too late
    streams.incremental_screen(log, lambda df: df.withColumn("seen", F.lit(True)), f"{tmp_path}/screen", f"{tmp_path}/c4", "tile_id").awaitTermination()
    assert sorted(r.tile_id for r in spark.read.parquet(f"{tmp_path}/screen").collect()) == [1, 2, 3]


def test_rasterize_paints_centres(spark):
    pixels = spark.createDataFrame([(x, y) for x in range(4) for y in range(3)], "gx int, gy int")
    boxes = spark.createDataFrame([(0.0, 0.0, 2.0, 1.0), (1.4, 0.6, 3.0, 2.0), (9.0, 9.0, 9.0, 9.0)], "a double, b double, c double, d double")
    got = {(r.gx, r.gy) for r in zonal.rasterize(pixels, boxes, ("a", "b", "c", "d"), 1.5, "land").where("land = 1").collect()}
    assert got == {(0, 0), (1, 0), (1, 1), (2, 1)} and zonal.rasterize(pixels, boxes.limit(0), ("a", "b", "c", "d"), 1.5, "land").where("land = 0").count() == 12
