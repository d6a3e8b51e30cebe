"""Queries of polygons, clustered layouts, keyed tables and streams that keep bounded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.functions import scalars as S
from rastertable.operators import composite, layout, polygons, sketches, zonal
from rastertable.plans import catalog_pixels, labels, screening
from rastertable.plans.catalog_reports import _status_log, _stream
from rastertable.plans.catalog_tiles import LIMITS, WATER, _eco
from rastertable.plans.views import sql, view
from rastertable.sources import keyed, readers, sinks
from rastertable.sources.workdir import work_dir
from rastertable.streaming import bounded
from rastertable.streaming.status import latest_status, progress_rate

QUERIES, SQL = {}, {}


def query(statement: str, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql(statement, *views)
        return f

    return add


# Polygons --------------------------------------------------------------------------------------------------------


def _edges_sql(rings: str) -> str:
    first = "first_value({0}) OVER w"
    return f"e AS (SELECT poly, part, ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, {first.format('x')}) AS x2, coalesce(lead(y) OVER w, {first.format('y')}) AS y2 FROM {rings} WINDOW w AS (PARTITION BY poly, part, ring ORDER BY seq))"


@query(
    f"""{_edges_sql("plots")},
    c AS (SELECT gx, gy, gx + CAST(0.5 AS DOUBLE) AS px, gy + CAST(0.5 AS DOUBLE) AS py FROM field),
    i AS (SELECT gx, gy, poly FROM c JOIN e ON (y1 <= py) <> (y2 <= py) AND x1 + (py - y1)*(x2 - x1)/(y2 - y1) <= px GROUP BY gx, gy, poly HAVING count(*) % 2 = 1)
    SELECT gx, gy, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.gx = c.gx AND i.gy = c.gy) THEN 1 ELSE 0 END AS land FROM c""",
    "plots", "field",
)
def rasterize_polygons(spark: SparkSession, d: str) -> DataFrame:
    return polygons.rasterize_polygons(view(spark, d, "field"), polygons.ring_edges(view(spark, d, "plots")), "land")


_MEET_SQL = f"""{_edges_sql("eco_rings")},
    b AS (SELECT id, k, min_lon + k AS bx0, CAST(min_lat AS DOUBLE) AS by0, min_lon + 0.25 + k AS bx1, min_lat + 0.25 AS by1 FROM cell CROSS JOIN (VALUES (CAST(0 AS DOUBLE)), (CAST(360 AS DOUBLE))) AS v(k)),
    t AS (SELECT id, poly, k, bx0, by0, bx1, by1, x1, y1, x2, y2, x2 - x1 AS dx, y2 - y1 AS dy FROM b JOIN e ON greatest(x1, x2) >= bx0 AND least(x1, x2) <= bx1 AND greatest(y1, y2) >= by0 AND least(y1, y2) <= by1 AND (k = 0 OR greatest(x1, x2) > 180)),
    u AS (SELECT id, poly, dx*(by0 - y1) - dy*(bx0 - x1) AS a, dx*(by0 - y1) - dy*(bx1 - x1) AS b, dx*(by1 - y1) - dy*(bx0 - x1) AS c, dx*(by1 - y1) - dy*(bx1 - x1) AS d FROM t),
    meet AS (SELECT id, poly FROM u WHERE least(a, b, c, d) <= 0 AND greatest(a, b, c, d) >= 0
             UNION SELECT id, poly FROM (SELECT id, k, poly FROM b JOIN e ON (y1 <= by0) <> (y2 <= by0) AND x1 + (by0 - y1)*(x2 - x1)/(y2 - y1) <= bx0 GROUP BY id, k, poly HAVING count(*) % 2 = 1))"""


def _globe_rings(spark: SparkSession, d: str) -> DataFrame:
    """The rings with longitudes up to 180, as files have them; those beyond go on at -180."""
    return view(spark, d, "eco_rings").withColumn("x", F.expr("IF(x > 180, x - 360, x)"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("min_lon").cast("double"), F.col("min_lat").cast("double")
    return view(spark, d, "cell").select("id", lon.alias("min_lon"), lat.alias("min_lat"), (lon + 0.25).alias("max_lon"), (lat + 0.25).alias("max_lat"))


@query(f"{_MEET_SQL} SELECT id, poly FROM meet", "cell", "eco_rings")
def boxes_meeting_polygons(spark: SparkSession, d: str) -> DataFrame:
    edges = polygons.cut_at_date_line(polygons.ring_edges(_globe_rings(spark, d)))
    return polygons.boxes_meeting_polygons(_boxes(spark, d), ["id"], screening.BOX, edges, 1.0)


@query(
    f"""{_MEET_SQL},
    p AS (SELECT id, biome_name, biome_num, CASE WHEN eco_id % 7 <> 0 THEN concat('realm', eco_id % 5) END AS realm FROM meet JOIN eco ON poly = eco_id QUALIFY row_number() OVER (PARTITION BY id ORDER BY w*h, eco_id) = 1),
    q AS (SELECT cell.id, coalesce(biome_num, -1) AS bn, CASE WHEN biome_name IS NULL OR biome_name IN ('N/A', '') THEN 'Unknown' ELSE biome_name END AS b, coalesce(realm, 'Unknown') AS r FROM cell LEFT JOIN p USING (id))
    SELECT id, CASE WHEN bn = 11 THEN 'Rock and Ice' ELSE b END AS biome_name, CAST(bn AS BIGINT) AS biome_num, CASE WHEN bn = 11 THEN 'Global' ELSE r END AS region FROM q""",
    "cell", "eco_rings", "eco",
)
def ecoregion_polygons(spark: SparkSession, d: str) -> DataFrame:
    out = screening.smallest_polygon(_boxes(spark, d), _globe_rings(spark, d), _eco(spark, d).drop(*screening.ECO_BOX))
    return out.select("id", "biome_name", F.col("biome_num").cast("long").alias("biome_num"), "region")


# Keyed tables and streams with bounded state ---------------------------------------------------------------------


@query("SELECT tile_id, status, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY ts DESC, event_id DESC) = 1", "ev")
def fold_keyed(spark: SparkSession, d: str) -> DataFrame:
    out = work_dir(spark, "fold-keyed")
    log = _status_log(_stream(spark, d, "events"))
    bounded.fold_keyed(log, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return keyed.current(spark, f"{out}/table", latest_status(log).schema).select("tile_id", "status", "event_id")


@query(
    """SELECT tile_id, CASE WHEN tile_id % 40 = 1 THEN 'valid' ELSE status END AS status, CASE WHEN tile_id % 40 = 1 THEN 'again' ELSE rejection_reason END AS rejection_reason, tile_id % 40 = 1 AS touched FROM reg""",
    "reg",
)
def upsert_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A registry written in buckets, then updates of one tile in forty and of tiles that are not there; the second batch comes twice."""
    path = work_dir(spark, "tiles-keyed")
    day = lambda x: F.lit(x).cast("timestamp")
    tiles = view(spark, d, "reg").select("tile_id", "status", "rejection_reason", day("2024-01-01").alias("updated_at"))
    updates = tiles.where("tile_id % 40 = 1").select("tile_id", F.lit("valid").alias("status"), F.lit("again").alias("rejection_reason"))
    updates = updates.unionByName(updates.selectExpr("-tile_id AS tile_id", "status", "rejection_reason"))
    keyed.merge(tiles, path, 0, "tile_id", lambda held, new: held.unionByName(new), tiles.schema)
    for _ in range(2):
        bounded.upsert_tiles(updates, path, 1, ["status", "rejection_reason"], tiles.schema, now=day("2024-02-01"))
    return keyed.current(spark, path, tiles.schema).select("tile_id", "status", "rejection_reason", (F.col("updated_at") == day("2024-02-01")).alias("touched"))


@query(f"SELECT c_custkey, {WATER} AS rejection_reason FROM aoi", "aoi")
def screen_new(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cells: a first batch outside the stream, then a stream of all of them, of which only the new ones are screened."""
    k, out = F.col("c_custkey"), work_dir(spark, "screen-new")
    facts = {"land_frac": (F.col("c_acctbal") + 1000) / 11000, "veg_fraction": (k * 31 % 100) / 1000.0, "forest_gain_frac": (k * 17 % 100) / 10000.0, "s2_frac": (k * 13 % 100) / 500.0}
    screen = lambda df: screening.screened(df, LIMITS).select("c_custkey", "rejection_reason")
    early = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey < 12").withColumns(facts)
    keyed.commit(screen(early), f"{out}/table", -1, "c_custkey")
    stream = _stream(spark, d, "customer").withColumns(facts)
    bounded.screen_new(stream, screen, f"{out}/table", f"{out}/checkpoint", "c_custkey long, rejection_reason string", "c_custkey").awaitTermination()
    return keyed.done_rows(spark, f"{out}/table", "c_custkey long, rejection_reason string")


@query(
    "SELECT l_partkey % 512 AS gx, l_orderkey % 512 AS gy, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(max(CASE WHEN l_tax*100 >= 0.5 AND l_linenumber <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS available FROM lineitem GROUP BY ALL",
    "px",
)
def availability_by_year(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "lineitem").select((F.col("l_partkey") % 512).alias("gx"), (F.col("l_orderkey") % 512).alias("gy"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.when(F.col("l_tax") * 100 >= 0.5, F.col("l_tax")).alias("b2n"), "l_linenumber")
    out = work_dir(spark, "availability-by-year")
    bounded.availability_by_year(rows, ["b2n"], f"{out}/table", f"{out}/checkpoint", usable=F.col("l_linenumber") != 3).awaitTermination()
    return bounded.availability_now(spark, f"{out}/table").select("gx", "gy", "y", F.col("available").cast("long").alias("available"))


# Clustered layout ------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey % 2000 AS gx, l_orderkey % 2000 AS gy, l_quantity AS b8 FROM lineitem WHERE l_partkey % 2000 BETWEEN 300 AND 499 AND l_orderkey % 2000 BETWEEN 1000 AND 1199", "px")
def scan_clustered(spark: SparkSession, d: str) -> DataFrame:
    """Observations written along the curve; a box of a hundredth of the area is read back."""
    path = work_dir(spark, "clustered")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 2000).alias("gx"), (F.col("l_orderkey") % 2000).alias("gy"), F.col("l_quantity").alias("b8"))
    layout.write_clustered(rows, path, group_bytes=256 << 10)
    return layout.read_box(spark, path, (300, 1000, 499, 1199)).drop(layout.KEY)


@query("SELECT s_suppkey AS eco_id FROM supplier WHERE ((s_suppkey*3571) % 340) - 180 <= 20 AND ((s_suppkey*3571) % 340) - 180 + 20 + s_suppkey % 20 >= -10 AND ((s_suppkey*2801) % 120) - 60 <= 30 AND ((s_suppkey*2801) % 120) - 60 + 15 + s_suppkey % 10 >= 0", "eco")
def scan_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of up to 39 by 24 degrees, clustered by their corner in cells of a degree; those that meet a box."""
    path, corner = work_dir(spark, "footprints"), (-180, -90)
    layout.write_clustered(_eco(spark, d), path, "eco_x0", "eco_y0", corner, 1)
    return layout.read_footprints(spark, path, (-10.0, 0.0, 20.0, 30.0), screening.ECO_BOX, (39.0, 24.0), "eco_x0", "eco_y0", corner, 1).select("eco_id")


def _floats(names: Sequence[str]) -> str:
    return ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in names)


STACK_BANDS = [*(f"T{k}_{b}" for k in range(3) for b in labels.STEP_BANDS), "dem", "slope", "gain", "canopy", "forest_type", "nat_forest", *labels.LABEL_BANDS]


@query(f"f AS ({catalog_pixels.SQL['full_stack']}) SELECT gx, gy, CAST(floor(gx/4) AS BIGINT) AS xi, CAST(floor(gy/4) AS BIGINT) AS yi, concat('r', CAST(floor(gx/4) AS BIGINT) % 3) AS region, {_floats(STACK_BANDS)} FROM f", "px")
def export_full_stack(spark: SparkSession, d: str) -> DataFrame:
    """All 57 bands of every valid pixel as floats, tile by tile in partitions of regions, and read back."""
    tiles = zonal.with_tile(catalog_pixels.full_stack(spark, d), catalog_pixels.TILE)
    path = work_dir(spark, "stack")
    sinks.export_stack(tiles.withColumn("region", F.concat(F.lit("r"), (F.col("xi") % 3).cast("string"))), path, STACK_BANDS, ("xi", "yi"))
    return spark.read.parquet(path).select("gx", "gy", "xi", "yi", "region", *[F.col(b).cast("double").alias(b) for b in STACK_BANDS])


# Boxes of all sizes, arrays of records ---------------------------------------------------------------------------

_SIZES = "CASE {k} % 6 WHEN 0 THEN 0.0015 WHEN 1 THEN 0.0105 WHEN 2 THEN 0.1205 WHEN 3 THEN 1.0005 WHEN 4 THEN 12.0005 ELSE 90.0005 END"


@query(
    f"""a AS (SELECT c_custkey, CAST(lon AS DOUBLE) AS ax, CAST(lat AS DOUBLE) AS ay, CAST({_SIZES.format(k="c_custkey")} AS DOUBLE) AS s FROM aoi),
    b AS (SELECT eco_id, CAST(x0 AS DOUBLE) AS bx, CAST(y0 AS DOUBLE) AS bq, CAST({_SIZES.format(k="eco_id")} AS DOUBLE) AS t FROM eco)
    SELECT c_custkey, eco_id FROM a JOIN b ON ax <= bx + t AND ax + s >= bx AND ay <= bq + t AND ay + s >= bq""",
    "aoi", "eco",
)
def boxes_of_all_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a thousandth to ninety degrees on both sides."""
    box = lambda df, key, x, y, p: df.select(key, F.col(x).cast("double").alias(f"{p}0"), F.col(y).cast("double").alias(f"{p}1"), F.expr(f"CAST({_SIZES.format(k=key)} AS DOUBLE)").alias("s")).select(key, f"{p}0", f"{p}1", (F.col(f"{p}0") + F.col("s")).alias(f"{p}2"), (F.col(f"{p}1") + F.col("s")).alias(f"{p}3"))
    a, b = box(view(spark, d, "aoi"), "c_custkey", "lon", "lat", "a"), box(view(spark, d, "eco"), "eco_id", "x0", "y0", "b")
    return zonal.bbox_join_levels(a, b, ("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3"), 0.001).select("c_custkey", "eco_id")


#: Bytes of a piece in the queries; files of the tables are small.
_PIECE = 64 << 10


def _aoi_records(spark: SparkSession, d: str) -> DataFrame:
    """(id, r, valid): AOIs as records, every other one wrapped; names hold quotes, backslashes and brackets."""
    odd = F.concat(F.lit('q"}]\\'), F.col("biome"), F.lit('{[\\"'))
    rows = screening.screened(view(spark, d, "aoi"), LIMITS)
    bare = F.struct("id", odd.alias("biome_name"), "region", F.col("land_frac").cast("double").alias("land_frac"), "rejection_reason")
    return rows.select("id", F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(bare.alias("properties")))).otherwise(F.to_json(bare)).alias("r"), "valid")


_NAMES = "concat('q\"}]', chr(92), biome, '{[', chr(92), '\"')"


@query(f"SELECT id, {_NAMES} AS biome_name, region, CAST(land_frac AS DOUBLE) AS land_frac FROM aoi", "aoi")
def scan_aois(spark: SparkSession, d: str) -> DataFrame:
    """All AOIs as one array in one file, read in pieces."""
    path, rows = work_dir(spark, "aoi-array"), _aoi_records(spark, d)
    first = rows.agg(F.min("id").alias("least"))
    lines = rows.join(F.broadcast(first)).select(F.concat(F.when(F.col("id") == F.col("least"), "[").otherwise(","), "r").alias("value"), (F.col("id") != F.col("least")).alias("later"))
    end = spark.createDataFrame([("]", True)], "value string, later boolean")
    lines.union(end).coalesce(1).sortWithinPartitions("later", F.col("value") == "]").select("value").write.text(path)
    return readers.scan_aois(spark, path, _PIECE).select("id", "biome_name", "region", "land_frac")


@query(f"SELECT id, {_NAMES} AS biome_name, {WATER} AS rejection_reason, {WATER} = 'valid' AS valid FROM aoi", "aoi")
def scan_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """All AOIs in one checkpoint file with both arrays, read in pieces."""
    path = work_dir(spark, "checkpoint-arrays")
    rows = _aoi_records(spark, d).select((~F.col("valid")).cast("int").alias("side"), F.lit(1).alias("part"), F.concat("r", F.lit(",")).alias("value"))
    frame = [(0, 0, '{"valid": ['), (0, 2, '{"id": null}], "rejected" :\n ['), (1, 2, '{"id": null}]}')]
    rows.union(spark.createDataFrame(frame, "side int, part int, value string")).coalesce(1).sortWithinPartitions("side", "part").select("value").write.text(path)
    return readers.scan_checkpoint(spark, path, _PIECE).where("id IS NOT NULL").select("id", "biome_name", "rejection_reason", "valid")


# Sketches --------------------------------------------------------------------------------------------------------


@query(
    """r AS (SELECT sensor, count(b8) AS n, round(avg(b8), 6) AS mean, CAST(min(b8) AS DOUBLE) AS least, CAST(max(b8) AS DOUBLE) AS most FROM px WHERE y BETWEEN 1995 AND 1997 GROUP BY sensor)
    SELECT sensor, n, mean, least, most, true AS median_close, true AS p90_close, true AS distinct_close FROM r""",
    "px",
)
def merged_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of each cell and year, written once; three years of each sensor from the sketches alone, held against the exact answers."""
    px, path = view(spark, d, "px"), work_dir(spark, "sketches")
    sketches.sketched(zonal.with_tile(px, 4), ["xi", "yi", "sensor", "y"], "b8", "scene_id").write.parquet(path)
    window = spark.read.parquet(path).where("y BETWEEN 1995 AND 1997")
    found = sketches.report(sketches.merged(window, ["sensor"]), ["sensor"], {"median": 0.5, "p90": 0.9})
    rows, near = px.where("y BETWEEN 1995 AND 1997").select("sensor", F.col("b8").cast("double").alias("v"), "scene_id").join(found, "sensor"), sketches.RANK_ERROR
    close = lambda c, p: ((F.avg((F.col("v") < F.col(c)).cast("double")) <= p + near) & (F.avg((F.col("v") <= F.col(c)).cast("double")) >= p - near))
    distinct = F.countDistinct("scene_id")
    check = rows.groupBy("sensor").agg(close("median", 0.5).alias("median_close"), close("p90", 0.9).alias("p90_close"), (F.abs(F.max("n_distinct") - distinct) <= F.lit(sketches.DISTINCT_ERROR) * distinct).alias("distinct_close"))
    return found.join(check, "sensor").select("sensor", "n", F.round("mean", 6).alias("mean"), "least", "most", "median_close", "p90_close", "distinct_close")


# Stamps ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, ts + INTERVAL '90 minutes' > TIMESTAMP '2024-01-15' AS later FROM ev", "ev")
def iso_stamps(spark: SparkSession, d: str) -> DataFrame:
    at = F.to_timestamp_ltz(F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z")))  # an instant, whatever the session's zone
    ts = view(spark, d, "ev").select("event_id", at.alias("at"))
    return ts.select("event_id", S.iso_utc(F.col("at")).alias("stamp"), (S.iso_utc(F.col("at") + F.expr("INTERVAL 90 MINUTES")) > "2024-01-15T00:00:00Z").alias("later"))


# Kept and merged -------------------------------------------------------------------------------------------------


@query(catalog_pixels.TREND_SQL + " SELECT gx, gy, round(CASE WHEN count(*) > 1 THEN regr_slope(c, y) END, 6) AS slope, round(stddev_pop(c), 6) AS std, count(*) AS n_years FROM yr GROUP BY gx, gy", "px")
def merged_trend(spark: SparkSession, d: str) -> DataFrame:
    """Moments of two years written; those of each later year merged with them, without the years before."""
    path, px = work_dir(spark, "trend"), view(spark, d, "px")
    year = lambda *y: composite.trend_moments(px.where(F.col("y").isin(*y)).groupBy("gx", "gy", "y").agg(F.avg("cov").alias("c")), "c")
    year(1996, 1997).write.parquet(f"{path}/0")
    for k, y in enumerate((1998, 1999)):
        composite.merge_trends(spark.read.parquet(f"{path}/{k}").unionByName(year(y))).write.parquet(f"{path}/{k + 1}")
    return composite.trend_of(spark.read.parquet(f"{path}/2")).select("gx", "gy", F.round("slope", 6).alias("slope"), F.round("std", 6).alias("std"), "n_years")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n_done, count(*) FILTER (WHERE status = 'valid') AS n_valid, count(*) FILTER (WHERE status = 'failed') AS n_failed, round(count(*)/360.0, 6) AS per_minute FROM ev GROUP BY 1", "ev")
def progress_keyed(spark: SparkSession, d: str) -> DataFrame:
    out = work_dir(spark, "progress-keyed")
    log = _status_log(_stream(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    bounded.progress_keyed(log, f"{out}/table", f"{out}/checkpoint", "6 hours", late="3650 days").awaitTermination()  # files come in any order
    rows = keyed.current(spark, f"{out}/table", progress_rate(log, "6 hours").schema)
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "n_done", "n_valid", "n_failed", F.round("per_minute", 6).alias("per_minute"))


# Composites by blocks --------------------------------------------------------------------------------------------


def timestep_blocks(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "px")
    optical = px.select("gx", "gy", "y", "cloudy_pct", F.col("b2").alias("B2"), F.col("b4").alias("B4"), F.col("b8").alias("B8"), *[F.col("b4").alias(b) for b in ("B3", "B5", "B6", "B7")])
    radar = px.where("sensor = 'A'").select("gx", "gy", "y", F.col("b8").alias("VV"), F.col("b4").alias("VH"))
    land = px.select("gx", "gy", "y", (F.col("cov") / 100.0).alias("trees"), (F.col("scl") / 7.0).alias("crops"), (F.col("b2") / 10.0).alias("built"))
    out = labels.timestep_blocks(optical, radar, land, {1997: "T0_"}, px.select("gx", "gy").distinct(), cloudy=60.0)
    return out.select("gx", "gy", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("gx", "gy")])


QUERIES["timestep_blocks"], SQL["timestep_blocks"] = timestep_blocks, catalog_pixels.SQL["timestep_stack"]
