"""Queries over pixels: composites, masks, zonal statistics, neighbourhoods and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.functions import pixels as P
from rastertable.operators import aggregates, composite, neighbor, zonal
from rastertable.plans import labels, tiles
from rastertable.plans.views import sql, view

QUERIES, SQL = {}, {}
TILE = 4


def query(statement: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = sql(statement, *views)
        return f

    return add


def r6(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)


NDVI_SQL = "CASE WHEN b8 >= 0 AND b4 >= 0 AND b8 + b4 <> 0 THEN (b8 - b4)/(b8 + b4) END"


@query(
    f"""
    rows_ AS (SELECT gx, gy, y, cov, {NDVI_SQL} AS ndvi FROM px WHERE y IN (1996, 1999) AND scl <> 3),
    py AS (SELECT gx, gy, y, median(ndvi) AS ndvi, avg(cov) AS cover, 1 AS av FROM rows_ GROUP BY gx, gy, y),
    pix AS (SELECT gx, gy, max(ndvi) FILTER (WHERE y = 1996) AS na, max(ndvi) FILTER (WHERE y = 1999) AS nb, max(cover) FILTER (WHERE y = 1996) AS ca, max(cover) FILTER (WHERE y = 1999) AS cb,
            coalesce(max(av) FILTER (WHERE y = 1996), 0) AS aa, coalesce(max(av) FILTER (WHERE y = 1999), 0) AS ab FROM py GROUP BY gx, gy),
    g AS (SELECT *, coalesce(ca <= 50 AND cb > 50, false) AS gain FROM pix),
    st AS (SELECT floor(gx/4) AS xi, floor(gy/4) AS yi, avg(CASE WHEN gain THEN 1.0 ELSE 0.0 END) AS gf, avg(CASE WHEN gain THEN nb - na END) AS nd, avg(CASE WHEN gain THEN cb END) AS cm, avg(aa) AS sa, avg(ab) AS sb FROM g GROUP BY 1, 2),
    d AS (SELECT CASE WHEN gf*100 < 10 THEN 'low_gain' WHEN nd IS NULL OR cm IS NULL THEN 'no_gain' WHEN nd <= 0 OR cm < 1 THEN 'viability' WHEN sa < 0.5 OR sb < 0.5 THEN 'coverage' ELSE 'valid' END AS reason_code FROM st)
    SELECT CASE WHEN reason_code = 'valid' THEN 'valid' ELSE 'rejected' END AS status, reason_code, count(*) AS n FROM d GROUP BY ALL""",
    "px",
)
def tile_decision_summary(spark: SparkSession, d: str) -> DataFrame:
    return tiles.tile_decision_summary(view(spark, d, "px"), 1996, 1999, TILE, gain_min=10.0, ndvi_min=0.0, available_min=0.5)


@query("SELECT gx, gy, y, round(quantile_cont(b8, 0.25), 6) AS b8, round(quantile_cont(b4, 0.25), 6) AS b4, round(quantile_cont(b2, 0.25), 6) AS b2 FROM px WHERE cloudy_pct < 30 AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-12-31' GROUP BY gx, gy, y", "px")
def p25_composite(spark: SparkSession, d: str) -> DataFrame:
    scenes = composite.scan_scenes(view(spark, d, "px"), "1996-01-01", "1998-12-31", metadata=composite.meta_below("cloudy_pct", 30))
    return composite.percentile_composite(scenes, ["b8", "b4", "b2"]).select("gx", "gy", "y", r6("b8"), r6("b4"), r6("b2"))


@query(f"SELECT gx, gy, y, round(median(b8), 6) AS b8, round(median({NDVI_SQL}), 6) AS ndvi FROM px WHERE sensor = 'A' GROUP BY gx, gy, y", "px")
def median_composite(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "px").where("sensor = 'A'").withColumn("ndvi", P.ndvi(F.col("b8"), F.col("b4")))
    return composite.median_composite(rows, ["b8", "ndvi"]).select("gx", "gy", "y", r6("b8"), r6("ndvi"))


@query("SELECT gx, gy, y, round(coalesce(avg(CASE WHEN scl <> 3 THEN b2n END), 0), 6) AS b2n FROM px GROUP BY gx, gy, y", "px")
def mean_composite(spark: SparkSession, d: str) -> DataFrame:
    rows = P.scl_mask(view(spark, d, "px"), ["b2n"], "scl")
    return composite.mean_composite(rows, ["b2n"]).select("gx", "gy", "y", r6("b2n"))


@query("c AS (SELECT gx, gy, y, scl, count(*) AS n FROM px GROUP BY ALL) SELECT gx, gy, y, scl FROM c QUALIFY row_number() OVER (PARTITION BY gx, gy, y ORDER BY n DESC, scl) = 1", "px")
def mode_composite(spark: SparkSession, d: str) -> DataFrame:
    return composite.mode_composite(view(spark, d, "px"), "scl")


@query("SELECT gx, gy, y, CAST(max(CASE WHEN scl NOT IN (0,3,8,9,10) AND b8 IS NOT NULL AND b4 IS NOT NULL AND b2n IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS available FROM px GROUP BY gx, gy, y", "px")
def availability(spark: SparkSession, d: str) -> DataFrame:
    return composite.availability(view(spark, d, "px"), ["b8", "b4", "b2n"], scl="scl").withColumn("available", F.col("available").cast("long"))


@query("a AS (SELECT gx, gy, y, max(CASE WHEN b2n IS NOT NULL AND scl <> 3 THEN 1 ELSE 0 END) AS v FROM px WHERE sensor = 'R' GROUP BY gx, gy, y) SELECT gx, gy, CAST(1 AS BIGINT) AS full_valid FROM a WHERE y IN (1996, 1997, 1998) AND v = 1 GROUP BY gx, gy HAVING count(*) = 3", "px")
def full_valid(spark: SparkSession, d: str) -> DataFrame:
    a = composite.availability(view(spark, d, "px").where("sensor = 'R'"), ["b2n"], scl="scl")
    return composite.full_valid(a, [1996, 1997, 1998]).withColumn("full_valid", F.col("full_valid").cast("long"))


@query(f"SELECT gx, gy, round(avg({NDVI_SQL}), 6) AS ndvi, round(avg(CASE WHEN b8 + 6*b4 - 7.5*b2 + 1 <> 0 THEN 2.5*(b8 - b4)/(b8 + 6*b4 - 7.5*b2 + 1) END), 6) AS evi, round(avg(CASE WHEN b4 <> 0 THEN b8/b4 END), 6) AS ratio, round(avg((b8 - b4)/(b8 + 6*b4 + 1)), 6) AS formula FROM px GROUP BY gx, gy", "px")
def indices(spark: SparkSession, d: str) -> DataFrame:
    n, r, b = F.col("b8"), F.col("b4"), F.col("b2")
    return view(spark, d, "px").groupBy("gx", "gy").agg(r6(F.avg(P.ndvi(n, r)), "ndvi"), r6(F.avg(P.evi(n, r, b)), "evi"), r6(F.avg(P.band_ratio(n, r)), "ratio"), r6(F.avg(P.formula("(n - r) / (n + 6 * r + 1)", n=n, r=r)), "formula"))


@query(
    """
    f AS (SELECT scl, CASE WHEN cov > 20 THEN CASE WHEN cov > 50 THEN 1 ELSE 0 END END AS a, CASE WHEN b2n IS NOT NULL THEN CASE WHEN b2n > 4.5 THEN 1 ELSE 0 END END AS b, CAST(cov AS DOUBLE) AS v FROM px)
    SELECT scl, CAST(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a <> 0 AND b <> 0 THEN 1 ELSE 0 END END) AS BIGINT) AS n_and, CAST(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a <> 0 OR b <> 0 THEN 1 ELSE 0 END END) AS BIGINT) AS n_or,
      CAST(sum(CASE WHEN a = 0 THEN 1 WHEN a IS NOT NULL THEN 0 END) AS BIGINT) AS n_not, count(nullif(a, 0)) AS n_self, round(sum(CASE WHEN b <> 0 THEN v END), 6) AS masked, CAST(sum(coalesce(a, 0)) AS BIGINT) AS filled, CAST(sum(CASE WHEN scl IN (1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS in_class
    FROM f GROUP BY scl""",
    "px",
)
def mask_logic(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "px").select("scl", F.when(F.col("cov") > 20, P.above(F.col("cov"), 50)).alias("a"), F.when(F.col("b2n").isNotNull(), P.above(F.col("b2n"), 4.5)).alias("b"), F.col("cov").cast("double").alias("v"))
    a, b = F.col("a"), F.col("b")
    return f.groupBy("scl").agg(F.sum(P.and_(a, b)).alias("n_and"), F.sum(P.or_(a, b)).alias("n_or"), F.sum(P.not_(a)).alias("n_not"), F.count(P.self_mask(a)).alias("n_self"), r6(F.sum(P.update_mask(F.col("v"), b)), "masked"), F.sum(P.unmask(a, 0)).alias("filled"), F.sum(P.class_in(F.col("scl"), 1, 2)).alias("in_class"))


@query("SELECT gx, CAST(sum(CASE WHEN (cov*2 BETWEEN 25 AND 96) OR (cov*2 BETWEEN 125 AND 196) THEN 1 ELSE 0 END) AS BIGINT) AS forest, round(avg(cov/2.55), 6) AS cover_pct FROM px GROUP BY gx", "px")
def remap(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cov")
    return view(spark, d, "px").groupBy("gx").agg(F.sum(P.remap_ranges(c * 2, [(25, 96), (125, 196)])).alias("forest"), r6(F.avg(P.decode_cover(c)), "cover_pct"))


@query("SELECT gx, gy, round(avg(greatest(0.0, least(1.0, (cov - 50)/25.0))), 6) AS clamped, round(avg(pow(b8*b4, 0.5)), 6) AS gm2, round(avg(pow(b8*b4*b2, 1.0/3)), 6) AS gm3 FROM px GROUP BY gx, gy", "px")
def clamp_scores(spark: SparkSession, d: str) -> DataFrame:
    b8, b4, b2 = F.col("b8"), F.col("b4"), F.col("b2")
    return view(spark, d, "px").groupBy("gx", "gy").agg(r6(F.avg(P.clamp((F.col("cov") - 50) / 25.0, 0, 1)), "clamped"), r6(F.avg(P.geo_mean(b8, b4)), "gm2"), r6(F.avg(P.geo_mean(b8, b4, b2)), "gm3"))


@query("SELECT vec_id, CAST(list_position([s0, s1, s2, s3], greatest(s0, s1, s2, s3)) - 1 AS BIGINT) AS dominant, round(greatest(s0, s1, s2, s3)/greatest(s0 + s1 + s2 + s3, 0.05), 6) AS confidence FROM emb", "emb")
def argmax_confidence(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col(f"s{k}") for k in range(4)]
    return view(spark, d, "emb").select("vec_id", P.argmax_band(*cols).cast("long").alias("dominant"), r6(P.confidence(*cols, floor=0.05), "confidence"))


@query("SELECT gx, gy, round(max_by(b8, struct_pack(ts, ok, scl)), 6) AS b8, round(max_by(b2n, struct_pack(ts, ok, scl)) FILTER (WHERE b2n IS NOT NULL), 6) AS b2n FROM px GROUP BY gx, gy", "px")
def mosaic_last_valid(spark: SparkSession, d: str) -> DataFrame:
    return composite.mosaic(view(spark, d, "px"), ["b8", "b2n"], ["ts", "ok", "scl"]).select("gx", "gy", r6("b8"), r6("b2n"))


@query("SELECT gx, gy, scene_id FROM px QUALIFY row_number() OVER (PARTITION BY gx, gy ORDER BY ts DESC, ok DESC, scl DESC) = 1", "px")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.last_write_wins(view(spark, d, "px"), ["gx", "gy"], "scene_id", ["ts", "ok", "scl"])


@query("SELECT CAST(floor(gx/4) AS BIGINT) AS xi, CAST(floor(gy/4) AS BIGINT) AS yi, round(avg(b8), 6) AS b8, round(avg(b4), 6) AS b4, round(avg(b2n), 6) AS b2n FROM px GROUP BY 1, 2", "px")
def tile_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return zonal.tile_aggregate(view(spark, d, "px"), ["b8", "b4", "b2n"], TILE).select("xi", "yi", r6("b8"), r6("b4"), r6("b2n"))


@query("SELECT CAST(floor(gx/4) AS BIGINT) AS xi, CAST(floor(gy/4) AS BIGINT) AS yi, round(median(b8), 6) AS b8_median, round(min(b4), 6) AS b4_min, round(max(b2), 6) AS b2_max, CAST(sum(cov) AS BIGINT) AS cov_sum, round(quantile_cont(z, 0.25), 6) AS z_p25 FROM (SELECT px.*, z FROM px JOIN dem USING (gx, gy)) GROUP BY 1, 2", "px", "dem")
def zonal_median(spark: SparkSession, d: str) -> DataFrame:
    layer = zonal.align(view(spark, d, "px"), view(spark, d, "dem"), how="inner")
    out = zonal.zonal(zonal.with_tile(layer, TILE), ["xi", "yi"], {"b8": "median", "b4": "min", "b2": "max", "cov": "sum", "z": "p25"})
    return out.select("xi", "yi", r6("b8_median"), r6("b4_min"), r6("b2_max"), "cov_sum", r6("z_p25"))


@query("c AS (SELECT floor(gx/4) AS xi, floor(gy/4) AS yi, scl, count(*) AS n FROM px GROUP BY ALL) SELECT CAST(xi AS BIGINT) AS xi, CAST(yi AS BIGINT) AS yi, scl AS scl_mode FROM c QUALIFY row_number() OVER (PARTITION BY xi, yi ORDER BY n DESC, scl) = 1", "px")
def zonal_mode(spark: SparkSession, d: str) -> DataFrame:
    return zonal.zonal(zonal.with_tile(view(spark, d, "px"), TILE), ["xi", "yi"], {"scl": "mode"})


@query("p AS (SELECT gx, gy, max(CASE WHEN scl <= 2 AND y <= 1998 THEN 1 ELSE 0 END) AS v FROM px GROUP BY gx, gy) SELECT CAST(floor(gx/4) AS BIGINT) AS xi, CAST(floor(gy/4) AS BIGINT) AS yi, count(*) AS n_pixels FROM p GROUP BY 1, 2 HAVING min(v) = 1", "px")
def tile_all_valid(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "px").groupBy("gx", "gy").agg(F.max(F.when((F.col("scl") <= 2) & (F.col("y") <= 1998), 1).otherwise(0)).alias("v"))
    return zonal.tile_all_valid(p, "v", TILE)


@query(
    f"""
    z AS (SELECT DISTINCT gy, gy - 16 AS lat FROM px), s AS (SELECT gy, CASE WHEN lat > 0 THEN TIMESTAMP '1997-05-01' ELSE TIMESTAMP '1997-11-01' END AS a, CASE WHEN lat > 0 THEN TIMESTAMP '1997-09-30' ELSE TIMESTAMP '1998-03-31' END AS b FROM z)
    SELECT gx, gy, round(median({NDVI_SQL}), 6) AS ndvi FROM px JOIN s USING (gy) WHERE ts >= a AND ts < b AND cloudy_pct < 50 GROUP BY gx, gy""",
    "px",
)
def seasonal_peak(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "px").where("cloudy_pct < 50").withColumn("ndvi", P.ndvi(F.col("b8"), F.col("b4")))
    zones = px.select("gy").distinct().withColumn("lat", F.col("gy") - 16)
    return composite.median_composite(composite.in_season(px, zones, "gy", 1997), ["ndvi"], by=()).select("gx", "gy", r6("ndvi"))


TREND_SQL = "yr AS (SELECT gx, gy, y, avg(cov) AS c FROM px WHERE y BETWEEN 1996 AND 1999 GROUP BY gx, gy, y)"


@query(TREND_SQL + " SELECT gx, gy, round(CASE WHEN count(*) > 1 THEN regr_slope(c, y) END, 6) AS slope, round(CASE WHEN count(*) > 1 THEN greatest(0.0, least(1.0, regr_slope(c, y))) END, 6) AS trend, count(*) AS n_years FROM yr GROUP BY gx, gy", "px")
def linear_trend(spark: SparkSession, d: str) -> DataFrame:
    yearly = view(spark, d, "px").where("y BETWEEN 1996 AND 1999").groupBy("gx", "gy", "y").agg(F.avg("cov").alias("c"))
    return composite.linear_trend(yearly, "c").select("gx", "gy", r6("slope"), r6("trend"), "n_years")


@query(TREND_SQL + " SELECT gx, gy, round(stddev_pop(c), 6) AS std FROM yr GROUP BY gx, gy", "px")
def temporal_std(spark: SparkSession, d: str) -> DataFrame:
    yearly = view(spark, d, "px").where("y BETWEEN 1996 AND 1999").groupBy("gx", "gy", "y").agg(F.avg("cov").alias("c"))
    return composite.linear_trend(yearly, "c").select("gx", "gy", r6("std"))


PLUS = "abs(a.gx - b.gx) + abs(a.gy - b.gy) <= 1"


@query(f"m AS (SELECT gx, gy, CASE WHEN z > 300 THEN 1 ELSE 0 END AS m FROM dem) SELECT a.gx, a.gy, CAST(max(b.m) AS BIGINT) AS dilated, CAST(min(b.m) AS BIGINT) AS eroded FROM m a JOIN m b ON {PLUS} GROUP BY a.gx, a.gy", "dem")
def dilate_erode(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "dem").select("gx", "gy", P.above(F.col("z"), 300).alias("m"))
    return neighbor.erode(neighbor.dilate(m, "m", "dilated"), "m", "eroded").select("gx", "gy", F.col("dilated").cast("long"), F.col("eroded").cast("long"))


@query(
    f"""
    m AS (SELECT gx, gy, CASE WHEN z > 300 THEN 1 ELSE 0 END AS m FROM dem), g AS (SELECT a.gx, a.gy, max(b.m) AS m FROM m a JOIN m b ON {PLUS} GROUP BY a.gx, a.gy)
    SELECT a.gx, a.gy, CAST(min(b.m) AS BIGINT) AS closed, CAST(max(a.m) AS BIGINT) AS skipped FROM g a JOIN g b ON {PLUS} GROUP BY a.gx, a.gy""",
    "dem",
)
def close_mask(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "dem").select("gx", "gy", P.above(F.col("z"), 300).alias("m"))
    return neighbor.close(neighbor.close(m, "m", "closed"), "m", "skipped", "skip").select("gx", "gy", F.col("closed").cast("long"), F.col("skipped").cast("long"))


@query("SELECT a.gx, a.gy, round(stddev_pop(b.z), 4) AS std FROM dem a JOIN dem b ON abs(a.gx - b.gx) <= 3 AND abs(a.gy - b.gy) <= 3 GROUP BY a.gx, a.gy", "dem")
def neighborhood_std(spark: SparkSession, d: str) -> DataFrame:
    return neighbor.neighborhood_std(view(spark, d, "dem"), "z", "std").select("gx", "gy", F.round("std", 4).alias("std"))


SLOPE_SQL = "degrees(atan(sqrt(pow((e.z - w.z)/20, 2) + pow((n.z - s.z)/20, 2))))"
SLOPE_FROM = "FROM dem c LEFT JOIN dem e ON e.gx = c.gx + 1 AND e.gy = c.gy LEFT JOIN dem w ON w.gx = c.gx - 1 AND w.gy = c.gy LEFT JOIN dem n ON n.gx = c.gx AND n.gy = c.gy + 1 LEFT JOIN dem s ON s.gx = c.gx AND s.gy = c.gy - 1"


@query(f"SELECT c.gx, c.gy, round({SLOPE_SQL}, 6) AS slope {SLOPE_FROM}", "dem")
def slope_deg(spark: SparkSession, d: str) -> DataFrame:
    return neighbor.slope_deg(view(spark, d, "dem"), "z", "slope").select("gx", "gy", r6("slope"))


GAIN_SQL = f"""
    cv AS (SELECT gx, gy, avg(cov) FILTER (WHERE y = 1996 AND sensor = 'N') AS c0, avg(cov) FILTER (WHERE y = 1999 AND sensor = 'N') AS c1 FROM px GROUP BY gx, gy),
    raw_ AS (SELECT gx, gy, CASE WHEN c0 IS NOT NULL AND c1 IS NOT NULL AND c0 <= 50 AND c1 > 50 THEN 1 ELSE 0 END AS m, CASE WHEN (gx + gy) % 5 <> 0 THEN 1 ELSE 0 END AS trees FROM cv),
    gr AS (SELECT a.gx, a.gy, max(b.m) AS m FROM raw_ a JOIN raw_ b ON {PLUS} GROUP BY a.gx, a.gy),
    cl AS (SELECT a.gx, a.gy, min(b.m) AS m FROM gr a JOIN gr b ON {PLUS} GROUP BY a.gx, a.gy),
    gl AS (SELECT gx, gy, CASE WHEN cl.m = 1 AND trees = 1 THEN 1 ELSE 0 END AS gain FROM cl JOIN raw_ USING (gx, gy))"""


def _gain(spark: SparkSession, d: str) -> DataFrame:
    at = lambda y: F.avg(F.when((F.col("y") == y) & (F.col("sensor") == "N"), F.col("cov")))
    cover = view(spark, d, "px").groupBy("gx", "gy").agg(at(1996).alias("cover_2017"), at(1999).alias("cover_2020"))
    return labels.gain_layer(cover.withColumn("trees", ((F.col("gx") + F.col("gy")) % 5 != 0).cast("int")))


@query(GAIN_SQL + " SELECT gx, gy, CAST(gain AS BIGINT) AS gain, CAST(nullif(gain, 0) AS BIGINT) AS validated FROM gl", "px")
def gain_layer(spark: SparkSession, d: str) -> DataFrame:
    return _gain(spark, d).select("gx", "gy", F.col("gain").cast("long"), F.col("validated").cast("long"))


def _steps(spark: SparkSession, d: str, steps: dict[int, str]) -> DataFrame:
    px = view(spark, d, "px")
    optical = px.select("gx", "gy", "y", "cloudy_pct", F.col("b2").alias("B2"), F.col("b4").alias("B4"), F.col("b8").alias("B8"), *[F.col("b4").alias(b) for b in ("B3", "B5", "B6", "B7")]).where("cloudy_pct < 60")
    radar = px.where("sensor = 'A'").select("gx", "gy", "y", F.col("b8").alias("VV"), F.col("b4").alias("VH"))
    land = px.select("gx", "gy", "y", (F.col("cov") / 100.0).alias("trees"), (F.col("scl") / 7.0).alias("crops"), (F.col("b2") / 10.0).alias("built"))
    return labels.timestep_stacks(optical, radar, land, steps, px.select("gx", "gy").distinct(), cloudy=60.0)


def _steps_sql(name: str, year: int) -> str:
    p = f"quantile_cont(%s, 0.25) FILTER (WHERE y = {year} AND cloudy_pct < 60)"
    m = f"median(%s) FILTER (WHERE y = {year}%s)"
    evi = "CASE WHEN b8 + 6*b4 - 7.5*b2 + 1 <> 0 THEN 2.5*(b8 - b4)/(b8 + 6*b4 - 7.5*b2 + 1) END"
    bands = {"B2": p % "b2", **{b: p % "b4" for b in ("B3", "B4", "B5", "B6", "B7")}, "B8": p % "b8", "NDVI": p % f"({NDVI_SQL})", "EVI": p % f"({evi})", "VV": m % ("b8", " AND sensor = 'A'"), "VH": m % ("b4", " AND sensor = 'A'"), "trees": m % ("cov/100.0", ""), "crops": m % ("scl/7.0", ""), "built": m % ("b2/10.0", "")}
    return f"{name} AS (SELECT gx, gy, {', '.join(f'{e} AS {name}_{b}' for b, e in bands.items())} FROM px GROUP BY gx, gy)"


@query(_steps_sql("T0", 1997) + " SELECT gx, gy, " + ", ".join(f"round(T0_{b}, 6) AS T0_{b}" for b in labels.STEP_BANDS if b != "VVVH") + ", round(CASE WHEN T0_VH <> 0 THEN T0_VV/T0_VH END, 6) AS T0_VVVH FROM T0", "px")
def timestep_stack(spark: SparkSession, d: str) -> DataFrame:
    out = _steps(spark, d, {1997: "T0_"})
    return out.select("gx", "gy", *[r6(c) for c in out.columns if c not in ("gx", "gy")])


LABEL_SQL = (
    GAIN_SQL
    + f""",
    st_ AS (SELECT c.gx, c.gy, c.z, {SLOPE_SQL} AS slope {SLOPE_FROM}),
    ly AS (SELECT gx, gy, (gx*7 + gy*3) % 11/10.0 AS nat, CASE WHEN (gx + 2*gy) % 3 = 0 THEN 1.0 ELSE 0.0 END AS tc, CASE WHEN (gx*gy) % 2 = 0 THEN 1.0 ELSE 0.0 END AS ec, CASE (gx + gy) % 3 WHEN 0 THEN 20 WHEN 1 THEN 1 ELSE 10 END AS ft, slope, gain, CASE WHEN gain = 1 THEN z/10 ELSE 0 END AS can FROM st_ JOIN gl USING (gx, gy)),
    sd AS (SELECT a.gx, a.gy, least(stddev_pop(b.can)/10, 1.0) AS ch_std FROM ly a JOIN ly b ON abs(a.gx - b.gx) <= 3 AND abs(a.gy - b.gy) <= 3 GROUP BY a.gx, a.gy),
    lc AS (SELECT gx, gy, y, avg(cov/100.0) AS t, avg(scl/7.0) AS c FROM px WHERE y BETWEEN 1996 AND 1999 GROUP BY gx, gy, y),
    tr AS (SELECT gx, gy, CASE WHEN count(*) > 1 THEN greatest(0.0, least(1.0, regr_slope(t, y))) ELSE 0 END AS dw_slope, coalesce(stddev_pop(t), 0) AS dw_std, coalesce(max(t) FILTER (WHERE y = 1996), 0) AS tp, coalesce(max(c) FILTER (WHERE y = 1996), 0) AS cp, coalesce(max(c) FILTER (WHERE y = 1999), 0) AS cq FROM lc GROUP BY gx, gy),
    al AS (SELECT ly.gx, ly.gy, nat, 1 - nat AS low_nat, CASE WHEN gain = 1 THEN tc ELSE 0 END AS tc, ec, CASE WHEN ft = 20 THEN 1.0 ELSE 0.0 END AS pl, CASE WHEN ft = 1 THEN 1.0 ELSE 0.0 END AS nr, coalesce(slope, 0) AS slope, ch_std, coalesce(dw_slope, 0) AS dw_slope, coalesce(dw_std, 0) AS dw_std, coalesce(tp, 0) AS tp, coalesce(cp, 0) AS cp, coalesce(cq, 0) AS cq FROM ly JOIN sd USING (gx, gy) LEFT JOIN tr USING (gx, gy)),
    sc AS (SELECT gx, gy, pow(tc*ec, 0.5)*least(2.0, 1 + 0.4*cp + 0.4*cq) AS a, pow(nat*tp, 0.5)*least(2.0, 1 + 0.5*nr + least(0.5, 2*dw_std)) AS b, pow(pl*(1 - ch_std), 0.5)*least(2.0, 1 + 0.5*low_nat + 0.3*tp) AS c, pow(pl*ch_std*low_nat, 1.0/3)*least(2.0, 1 + 0.5*dw_slope + 0.3*least(1.0, slope/30)) AS e FROM al)"""
)


def _static(spark: SparkSession, d: str) -> DataFrame:
    gx, gy = F.col("gx"), F.col("gy")
    slope = neighbor.slope_deg(view(spark, d, "dem"), "z", "slope")
    layers = slope.join(_gain(spark, d).select("gx", "gy", "gain"), ["gx", "gy"])
    kind = F.when((gx + gy) % 3 == 0, 20).when((gx + gy) % 3 == 1, 1).otherwise(10)
    return layers.withColumns({"canopy": F.col("z") / 10, "nat_forest": (gx * 7 + gy * 3) % 11 / 10.0, "treecrop": ((gx + 2 * gy) % 3 == 0).cast("double"), "esa_crop": ((gx * gy) % 2 == 0).cast("double"), "forest_type": kind})


def _labels(spark: SparkSession, d: str) -> DataFrame:
    land = view(spark, d, "px").select("gx", "gy", "y", (F.col("cov") / 100.0).alias("trees"), (F.col("scl") / 7.0).alias("crops"))
    return labels.pseudo_labels(_static(spark, d), land, 1996, 1999)


SCORE_SQL = "round(a, 9) AS score_agrocrop, round(b, 9) AS score_nat_regen, round(c, 9) AS score_plantation, round(e, 9) AS score_restoration, CAST(list_position([a, b, c, e], greatest(a, b, c, e)) - 1 AS BIGINT) AS dominant, round(greatest(a, b, c, e)/greatest(a + b + c + e, 1e-6), 6) AS confidence"


def _label_columns() -> list:
    return [*[F.round(c, 9).alias(c) for c in labels.LABEL_BANDS[:4]], F.col("dominant").cast("long").alias("dominant"), r6("confidence")]


@query(LABEL_SQL + f" SELECT gx, gy, {SCORE_SQL} FROM sc", "px", "dem")
def pseudo_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("gx", "gy", *_label_columns())


YEARS = (1996, 1997, 1999)
#: The bands of the time steps, but for VVVH the columns of the views T0 to T2.
STEP_SQL = ", ".join(f"round(CASE WHEN T{k}_VH <> 0 THEN T{k}_VV/T{k}_VH END, 6) AS T{k}_VVVH" if b == "VVVH" else f"round(T{k}_{b}, 6) AS T{k}_{b}" for k in range(3) for b in labels.STEP_BANDS)


@query(
    ", ".join(_steps_sql(f"T{k}", y) for k, y in enumerate(YEARS)) + ", " + LABEL_SQL
    + ", av AS (SELECT gx, gy FROM (SELECT gx, gy, y, max(CASE WHEN b2n IS NOT NULL AND scl <> 3 THEN 1 ELSE 0 END) AS v FROM px WHERE sensor = 'R' GROUP BY gx, gy, y) WHERE y IN (1996, 1997, 1999) AND v = 1 GROUP BY gx, gy HAVING count(*) = 3)"
    + f" SELECT gx, gy, {STEP_SQL}, round(dem.z, 6) AS dem, round(ly.slope, 6) AS slope, CAST(ly.gain AS BIGINT) AS gain, round(CASE WHEN ly.gain = 1 THEN dem.z/10 END, 6) AS canopy, CAST(ly.ft AS BIGINT) AS forest_type, round(ly.nat, 6) AS nat_forest, {SCORE_SQL}"
    + " FROM av JOIN ly USING (gx, gy) JOIN dem USING (gx, gy) JOIN T0 USING (gx, gy) JOIN T1 USING (gx, gy) JOIN T2 USING (gx, gy) JOIN sc USING (gx, gy)",
    "px", "dem",
)
def full_stack(spark: SparkSession, d: str) -> DataFrame:
    """All 57 bands: three time steps of 15, six static layers and six labels."""
    valid = composite.full_valid(composite.availability(view(spark, d, "px").where("sensor = 'R'"), ["b2n"], scl="scl"), YEARS)
    static = _static(spark, d).select("gx", "gy", F.col("z").alias("dem"), "slope", "gain", F.when(F.col("gain") == 1, F.col("canopy")).alias("canopy"), "forest_type", "nat_forest")
    out = labels.full_stack([_steps(spark, d, {y: f"T{k}_" for k, y in enumerate(YEARS)})], static, _labels(spark, d), valid)
    steps = [f"T{k}_{b}" for k in range(3) for b in labels.STEP_BANDS]
    return out.select("gx", "gy", *map(r6, steps), r6("dem"), r6("slope"), F.col("gain").cast("long"), r6("canopy"), F.col("forest_type").cast("long"), r6("nat_forest"), *_label_columns())


@query("s AS (SELECT CAST(floor(gx/4) AS BIGINT) AS xi, CAST(floor(gy/4) AS BIGINT) AS yi, y, scl, count(*) AS n FROM px GROUP BY ALL) SELECT xi, yi, y, scl, n, round(100.0*n/sum(n) OVER (PARTITION BY xi, yi, y), 6) AS pct FROM s", "px")
def class_share(spark: SparkSession, d: str) -> DataFrame:
    return zonal.class_share(zonal.with_tile(view(spark, d, "px"), TILE), "scl", ["xi", "yi", "y"]).select("xi", "yi", "y", "scl", "n", r6("pct"))


@query("SELECT CAST(floor(gx/4) AS BIGINT) AS xi, CAST(floor(gy/4) AS BIGINT) AS yi, y, round(avg(cov), 6) AS cov FROM px GROUP BY 1, 2, 3", "px")
def time_series(spark: SparkSession, d: str) -> DataFrame:
    return zonal.time_series(zonal.with_tile(view(spark, d, "px"), TILE), "cov", ["xi", "yi"]).select("xi", "yi", "y", r6("cov"))


@query("SELECT floor(gx/4)::BIGINT AS xi, floor(gy/4)::BIGINT AS yi, list_aggregate(list(round(z, 6) ORDER BY (3 - gy % 4)*4 + gx % 4), 'string_agg', ',') AS band FROM (SELECT gx, gy, CAST(floor(z) AS BIGINT) AS z FROM dem) GROUP BY 1, 2", "dem")
def pack_tile(spark: SparkSession, d: str) -> DataFrame:
    dem = view(spark, d, "dem").select("gx", "gy", F.floor("z").alias("z"))
    return zonal.pack_tile(dem, ["z"], TILE).select("xi", "yi", F.array_join(F.transform("z", lambda v: v.cast("string")), ",").alias("band"))


@query(GAIN_SQL + ", w AS (SELECT floor(gx/4)::BIGINT AS xi, floor(gy/4)::BIGINT AS yi, gain, z FROM gl JOIN dem USING (gx, gy)) SELECT xi, yi, round(coalesce(median(CASE WHEN gain = 1 THEN z END), 0), 6) AS ndvi_delta, round(coalesce(avg(CASE WHEN gain = 1 THEN z/10 END), 0), 6) AS gain_canopy_mean FROM w GROUP BY xi, yi", "px", "dem")
def viability(spark: SparkSession, d: str) -> DataFrame:
    p = zonal.with_tile(_static(spark, d), TILE).withColumn("ndvi_delta", F.col("z"))
    return labels.viability(p, ["xi", "yi"]).select("xi", "yi", r6("ndvi_delta"), r6("gain_canopy_mean"))
