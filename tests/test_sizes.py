"""Queries against their SQL on tables that the given ones do not reach: values at a bound, many equal and overlapping boxes."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

from rastertable.operators import polygons, zonal
from rastertable.plans import catalog, screening

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the given tables are not here")


@pytest.fixture
def sized(tmp_path):
    """Writes customers and suppliers with the given keys (SQL of a range) and returns their folder and a connection that knows them."""
    def make(customers, suppliers="range(1)"):
        con = duckdb.connect()
        con.sql("SET TimeZone='UTC'")
        made = {
            "customer": f"SELECT CAST(range AS BIGINT) AS c_custkey, concat('c', range) AS c_name, CAST(range * range // 7 % 25 AS INTEGER) AS c_nationkey, CAST(range % 11000 - 1000 AS DOUBLE) AS c_acctbal, 'BUILDING' AS c_mktsegment FROM {customers}",
            "supplier": f"SELECT CAST(range AS BIGINT) AS s_suppkey, concat('s', range) AS s_name, CAST(range % 25 AS INTEGER) AS s_nationkey, CAST(0 AS DOUBLE) AS s_acctbal FROM {suppliers}",
            **{t: f"SELECT * FROM '{SF}/{t}.parquet'" for t in ("nation", "region", "orders", "part")},
        }
        for t, statement in made.items():
            con.sql(f"COPY ({statement}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        return str(tmp_path), con

    return make


def same_as_sql(spark, name, folder, con):
    rel = con.sql(catalog.ORACLE_SQL[name])
    want = sorted(rel.fetchall(), key=str)
    got = sorted((tuple(r) for r in catalog.QUERIES[name](spark, folder).select(*rel.columns).collect()), key=str)
    assert got == want
    return len(got)


def test_land_candidates_whose_boxes_end_at_the_bounds(spark, sized):
    assert same_as_sql(spark, "land_candidates", *sized("range(90000)")) > 15000


def test_filter_bounds_with_boxes_that_end_at_the_bounds(spark, sized):
    assert same_as_sql(spark, "filter_bounds", *sized("range(90000)")) > 5000


def joined_rows(df):
    """Runs ``df`` and returns its rows and how many rows its joins made."""
    rows, todo, total = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if "Join" in name:
                total += node.metrics().get("numOutputRows").get().value()
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
    return rows, total


ECO = "eco_id long, biome_name string, biome_num int, realm string, eco_area double, eco_x0 double, eco_y0 double, eco_x1 double, eco_y1 double"


def test_smallest_ecoregion_of_many_that_overlap_makes_few_pairs(spark):
    r = random.Random(7)
    sizes = [(20.0, 15.0), (33.5, 12.0), (4.0, 40.0), (1.0, 0.5)]
    eco = [(k, f"b{k}", k % 14, "r", w * h, x, y, x + w, y + h) for k in range(1500) for (w, h), x, y in [(r.choice(sizes), r.choice([-5.0, 0.0, r.uniform(-20, 20)]), r.choice([5.0, r.uniform(-20, 20)]))]]
    cells = [(f"c{k}", x, y, x + 0.25, y + 0.25) for k in range(1500) for x, y in [(r.choice([0.0, 4.75, 5.0, r.uniform(-25, 25)]), r.choice([-5.25, 5.0, r.uniform(-25, 25)]))]]
    table = spark.createDataFrame(cells, "id string, min_lon double, min_lat double, max_lon double, max_lat double")
    rows, pairs = joined_rows(screening.smallest_ecoregion(table, spark.createDataFrame(eco, ECO)))
    met = {i: [(e[4], e[0]) for e in eco if x0 <= e[7] and x1 >= e[5] and y0 <= e[8] and y1 >= e[6]] for i, x0, y0, x1, y1 in cells}
    label = lambda k: "Unknown" if k is None else "Rock and Ice" if k % 14 == 11 else f"b{k}"
    assert {x.id: x.biome_name for x in rows} == {i: label(min(m)[1] if m else None) for i, m in met.items()}
    assert pairs < sum(map(len, met.values())) / 4


def test_layers_of_one_table_are_one_aggregate(spark):
    r = random.Random(3)
    names = ["land_frac", "veg_fraction", "s2_frac"]
    points = spark.createDataFrame([(r.uniform(0, 9), r.uniform(0, 9), *(None if r.random() < 0.2 else r.randrange(64) / 64 for _ in names)) for _ in range(300)], f"lon double, lat double, {', '.join(f'{c} double' for c in names)}")
    cells = spark.range(100).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS min_lon", "CAST(id DIV 10 AS DOUBLE) AS min_lat")
    apart = screening.cell_fractions(cells, {c: points.select("lon", "lat", c) for c in names}, 1.0)
    as_one = screening.cell_fractions(cells, dict.fromkeys(names, points), 1.0)
    assert as_one._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 2
    assert sorted(as_one.collect()) == sorted(apart.select(*as_one.columns).collect())


def _boxes_and_places(r):
    shapes = [(x, y, x + r.uniform(0, 9), y + r.uniform(0, 9)) for x, y in ((r.uniform(-20, 20), r.uniform(-20, 20)) for _ in range(25))]
    return [(k, *shapes[k % 25]) for k in range(1500)], [(k, r.uniform(-22, 22), r.uniform(-22, 22)) for k in range(200)]


@pytest.mark.parametrize("cell", [3.0, 50.0])
def test_equal_boxes_are_joined_as_one(spark, cell):
    boxes, places = _boxes_and_places(random.Random(11))
    right = spark.createDataFrame(boxes, "b long, x0 double, y0 double, x1 double, y1 double")
    left = spark.createDataFrame([(k, x, y, x + 2, y + 2) for k, x, y in places], "a long, p0 double, q0 double, p1 double, q1 double")
    rows, joined = joined_rows(zonal.bbox_join(left, right, ("p0", "q0", "p1", "q1"), ("x0", "y0", "x1", "y1"), cell).select("a", "b"))
    want = {(k, b[0]) for k, x, y in places for b in boxes if x <= b[3] and x + 2 >= b[1] and y <= b[4] and y + 2 >= b[2]}
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want and joined < len(want) / 3


def test_points_in_equal_boxes_are_joined_as_one(spark):
    boxes, places = _boxes_and_places(random.Random(12))
    right, points = spark.createDataFrame(boxes, "b long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(places, "a long, x double, y double")
    found = zonal.point_join(points, right, "x", "y", ("x0", "y0", "x1", "y1"), 5.0)
    assert found.columns == ["a", "x", "y", "b", "x0", "y0", "x1", "y1"]
    rows, joined = joined_rows(found)
    want = {(k, x, y, *b) for k, x, y in places for b in boxes if b[1] <= x <= b[3] and b[2] <= y <= b[4]}
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want and joined < len(want) / 3


@pytest.mark.parametrize("split", [7, 1 << 16])
def test_equal_boxes_of_all_sizes_are_joined_as_one_and_both_sides_split(spark, split):
    r = random.Random(13)
    shape = lambda: (lambda x, y, s: (x, y, x + s, y + s))(r.uniform(-20, 20), r.uniform(-20, 20), r.choice([0.01, 0.5, 3.0, 30.0]))
    shapes = [shape() for _ in range(12)]
    a, b = [(k, *shape()) for k in range(150)], [(k, *shapes[k % 12]) for k in range(600)]
    left, right = spark.createDataFrame(a, "a long, p0 double, q0 double, p1 double, q1 double"), spark.createDataFrame(b, "b long, x0 double, y0 double, x1 double, y1 double")
    found = zonal.bbox_join_levels(left, right, ("p0", "q0", "p1", "q1"), ("x0", "y0", "x1", "y1"), 0.01, split)
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]}
    rows, joined = joined_rows(found.select("a", "b"))
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want
    assert split == 7 or joined < len(want)


def test_boxes_meeting_polygons_of_few_shapes(spark, sized):
    folder, con = sized("range(20000)", "range(0, 2040*15, 68)")
    assert same_as_sql(spark, "boxes_meeting_polygons", folder, con) > 50000


def test_smallest_polygon_of_few_shapes(spark, sized):
    folder, con = sized("range(3000)", "range(0, 2040*8, 136)")
    assert same_as_sql(spark, "ecoregion_polygons", folder, con) == 3000


def test_polygons_of_the_same_edges_are_one_shape(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rings = {5: square, 3: square[2:] + square[:2], 8: [(x + 1, y) for x, y in square], 9: [*square, (0.0, 2.0)], 7: square}
    points = spark.createDataFrame([(p, 0, 0, k, x, y) for p, ring in rings.items() for k, (x, y) in enumerate(ring)], "poly long, part int, ring int, seq int, x double, y double")
    edges = polygons.ring_edges(points)
    assert sorted(tuple(x) for x in polygons.shapes(edges).collect()) == [(3, 3), (3, 5), (3, 7), (8, 8), (9, 9)]
    boxes = spark.createDataFrame([(k, 4.5, 1.0, 4.75, 1.25) if k % 2 else (k, 0.5, 1.0, 0.75, 1.25) for k in range(2000)], "id long, a double, b double, c double, d double")
    rows, joined = joined_rows(polygons.boxes_meeting_polygons(boxes, ["id"], ("a", "b", "c", "d"), edges, 1.0))
    assert sorted(tuple(x) for x in rows) == sorted((k, p) for k in range(2000) for p in ((8,) if k % 2 else (3, 5, 7, 9)))
    assert joined < 7000
