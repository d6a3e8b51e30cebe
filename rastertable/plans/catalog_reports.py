"""Queries of reports, reconciliation, validation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.functions import scalars as S
from rastertable.operators import aggregates, sets, validation, zonal
from rastertable.plans import reports, screening, tiles
from rastertable.plans.catalog_pixels import NDVI_SQL, r6
from rastertable.plans.catalog_tiles import LIMITS, WATER
from rastertable.plans.views import sql, view
from rastertable.sources.workdir import work_dir
from rastertable.streaming import status as streams

QUERIES, SQL = {}, {}


def query(statement: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = sql(statement, *views)
        return f

    return add


def _screened(spark: SparkSession, d: str) -> DataFrame:
    out = screening.screened(view(spark, d, "aoi"), LIMITS).withColumns({"centroid_lon": F.col("lon"), "centroid_lat": F.col("lat"), "biome_name": F.col("biome")})
    return out.withColumn("set", F.when(F.col("valid"), "valid").otherwise("rejected"))


SET_SQL = f"w AS (SELECT *, {WATER} AS rr FROM aoi), s AS (SELECT *, CASE WHEN rr = 'valid' THEN 'valid' ELSE 'rejected' END AS \"set\", CASE WHEN rr = 'no_land' THEN 0 ELSE veg_fraction END AS veg2, CASE WHEN rr IN ('no_land', 'insufficient_veg') THEN 0 ELSE forest_gain_frac END AS gain2 FROM w)"


@query(
    """
    o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn, count(*) OVER () AS n FROM orders)
    SELECT count(*) AS n, round(min(v), 6) AS min, round(max(v) FILTER (WHERE rn = floor(n*0.25) + 1), 6) AS p25, round(avg(v), 4) AS mean, round(median(v), 6) AS median, round(max(v) FILTER (WHERE rn = floor(n*0.75) + 1), 6) AS p75, round(max(v), 6) AS max, round(stddev_samp(v), 4) AS stdev FROM o""",
    "reg",
)
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.summary_stats(view(spark, d, "reg"), "gain_area")
    return out.select("n", r6("min"), r6("p25"), F.round("mean", 4).alias("mean"), r6("median"), r6("p75"), r6("max"), F.round("stdev", 4).alias("stdev"))


@query(SET_SQL + ' SELECT "set", region, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY "set"), 6) AS pct FROM s GROUP BY "set", region', "aoi")
def shares(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.shares(_screened(spark, d), "set", "region").select("set", "region", "n", r6("pct"))


@query(
    """
    q AS (SELECT biome, quantile_cont(land_frac, 0.25) AS q1, quantile_cont(land_frac, 0.5) AS md, quantile_cont(land_frac, 0.75) AS q3, avg(land_frac) AS mean, count(*) AS n FROM aoi GROUP BY biome)
    SELECT biome, round(q1, 6) AS q1, round(md, 6) AS median, round(q3, 6) AS q3, round(mean, 6) AS mean, n, round(min(land_frac), 6) AS whisker_lo, round(max(land_frac), 6) AS whisker_hi FROM aoi JOIN q USING (biome) WHERE land_frac BETWEEN q1 - 1.5*(q3 - q1) AND q3 + 1.5*(q3 - q1) GROUP BY biome, q1, md, q3, mean, n""",
    "aoi",
)
def boxplot(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.boxplot_stats(view(spark, d, "aoi"), "biome", "land_frac")
    return out.select("biome", r6("q1"), r6("median"), r6("q3"), r6("mean"), "n", r6("whisker_lo"), r6("whisker_hi"))


@query("e AS (SELECT min(land_frac) AS lo, max(land_frac) AS hi, count(*) AS t FROM aoi) SELECT least(CAST(floor((land_frac - lo)/((hi - lo)/30)) AS BIGINT), 29) AS bin, count(*) AS n, round(count(*)/(any_value(t)*(any_value(hi) - any_value(lo))/30), 6) AS density FROM aoi, e GROUP BY 1", "aoi")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(view(spark, d, "aoi"), "land_frac", 30).select("bin", "n", r6("density"))


CORR = ["land_frac", "veg_fraction", "forest_gain_frac", "s2_frac", "area_km2"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM aoi" for i, a in enumerate(CORR) for b in CORR[i:]), "aoi")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.correlation_matrix(view(spark, d, "aoi"), CORR).select("a", "b", r6("r"), "n")


def _pvalue_sql() -> str:
    """p of a correlation from the finite sums of Student's distribution for even and odd degrees of freedom."""
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM aoi" for i, a in enumerate(CORR) for b in CORR[i:])
    even = "1 - abs(r)*list_sum(list_transform(range(0, nu//2), lambda j: exp(lgamma(2*j + 1) - 2*j*ln(2) - 2*lgamma(j + 1) + j*ln(1 - r*r))))"
    odd = "1 - 2/pi()*(asin(abs(r)) + abs(r)*sqrt(1 - r*r)*coalesce(list_sum(list_transform(range(0, (nu - 1)//2), lambda j: exp(2*j*ln(2) + 2*lgamma(j + 1) - lgamma(2*j + 2) + j*ln(1 - r*r)))), 0))"
    return f"m AS ({pairs}), v AS (SELECT *, n - 2 AS nu FROM m), w AS (SELECT *, CASE WHEN r IS NULL OR n < 3 THEN NULL WHEN abs(r) > 1 - 1e-12 THEN 0 WHEN nu % 2 = 0 THEN {even} ELSE {odd} END AS p FROM v) SELECT a, b, round(r, 6) AS r, n, abs(round(p, 6)) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM w"


@query(_pvalue_sql(), "aoi")
def corr_pvalue(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.corr_pvalue(aggregates.correlation_matrix(view(spark, d, "aoi"), CORR))
    return out.select("a", "b", r6("r"), "n", r6("p"), "stars")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("SELECT biome, " + ", ".join(f"count(*) FILTER (WHERE region = '{r}') AS \"{r}\"" for r in REGIONS) + " FROM aoi GROUP BY biome", "aoi")
def pivot_biome_region(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.pivot_counts(view(spark, d, "aoi"), "biome", "region", REGIONS)


@query("g AS (SELECT biome, sum(area_km2*forest_gain_frac) AS gain FROM aoi GROUP BY biome) SELECT biome, round(gain, 6) AS gain, round(100*sum(gain) OVER (ORDER BY gain DESC, biome)/sum(gain) OVER (), 6) AS running_pct FROM g", "aoi")
def running_share(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "aoi").groupBy("biome").agg(F.sum(S.gain_area(F.col("area_km2"), F.col("forest_gain_frac"))).alias("gain"))
    return aggregates.running_share(g, "biome", "gain").select("biome", r6("gain"), r6("running_pct"))


@query("SELECT aoi_id, count(*) AS n, round(avg(lat), 6) AS lat, round(count(*)*cos(radians(avg(lat))), 6) AS scaled FROM reg JOIN aoi ON aoi_id = c_custkey GROUP BY aoi_id", "reg", "aoi")
def aoi_latitude_load(spark: SparkSession, d: str) -> DataFrame:
    joined = view(spark, d, "reg").select("aoi_id", "tile_id").join(view(spark, d, "aoi").select(F.col("c_custkey").alias("aoi_id"), "lat"), "aoi_id")
    return aggregates.latitude_load(joined, "aoi_id", F.col("lat")).select("aoi_id", "n", r6("lat"), r6("scaled"))


@query("SELECT count(*) AS aois, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(median(n), 6) AS median FROM (SELECT count(*) AS n FROM reg GROUP BY aoi_id)", "reg")
def tiles_per_aoi(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.tiles_per_aoi(view(spark, d, "reg")).select("aois", "min", "max", r6("mean"), r6("median"))


@query(
    """
    u AS (SELECT 'all' AS dimension, '' AS value, count(*) AS n FROM reg UNION ALL SELECT 'biome', biome, count(*) FROM reg GROUP BY biome UNION ALL SELECT 'region', region, count(*) FROM reg GROUP BY region)
    SELECT dimension, value, n, round(100.0*n/(SELECT count(*) FROM reg), 6) AS pct FROM u""",
    "reg",
)
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.plan_summary(view(spark, d, "reg")).select("dimension", "value", "n", r6("pct"))


@query(SET_SQL + ", g AS (SELECT region, count(*) FILTER (WHERE rr = 'valid') AS n_valid, count(*) FILTER (WHERE rr <> 'valid') AS n_rejected, coalesce(sum(area_km2*gain2) FILTER (WHERE rr = 'valid'), 0) AS gv, coalesce(sum(area_km2*gain2) FILTER (WHERE rr <> 'valid'), 0) AS gr FROM s GROUP BY region) SELECT region, n_valid, n_rejected, round(gv, 6) AS gain_valid, round(gr, 6) AS gain_rejected, round(100.0*n_rejected/(n_valid + n_rejected), 6) AS rejection_rate, round(coalesce(100*gv/nullif(gv + gr, 0), 0), 6) AS gain_retention FROM g", "aoi")
def contribution(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.contribution(_screened(spark, d), "region")
    return out.select("region", "n_valid", "n_rejected", *[r6(c) for c in ("gain_valid", "gain_rejected", "rejection_rate", "gain_retention")])


def _audit(spark: SparkSession, d: str) -> DataFrame:
    reg = view(spark, d, "reg")
    links = reg.select("tile_id", F.concat(F.lit("aoi_"), F.col("aoi_id").cast("string")).alias("aoi_id"))
    return reports.aoi_audit(view(spark, d, "aoi").withColumnRenamed("biome", "biome_name"), reg.select("tile_id", "status"), links)


AUDIT_SQL = "a AS (SELECT aoi.id AS aoi_id, aoi.biome, aoi.region, count(tile_id) AS total_tiles, count(*) FILTER (WHERE r.status = 'complete') AS complete_tiles, count(*) FILTER (WHERE r.status = 'pending') AS pending_tiles FROM aoi LEFT JOIN reg r ON c_custkey = aoi_id GROUP BY ALL)"


@query(AUDIT_SQL + " SELECT aoi_id, biome, region, total_tiles, complete_tiles, pending_tiles, complete_tiles > 0 AS has_coverage FROM a", "aoi", "reg")
def audit_left(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).select("aoi_id", "biome", "region", "total_tiles", "complete_tiles", S.map_get(F.col("tile_counts"), "pending").alias("pending_tiles"), "has_coverage")


@query(AUDIT_SQL + " SELECT biome, count(*) AS total, count(*) FILTER (WHERE complete_tiles > 0) AS covered, round(100.0*count(*) FILTER (WHERE complete_tiles = 0)/count(*), 6) AS gap_pct FROM a GROUP BY biome", "aoi", "reg")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_summary(_audit(spark, d)).select("biome", "total", "covered", r6("gap_pct"))


@query("SELECT aoi_id, count(*) FILTER (WHERE status = 'complete') AS n_complete, count(*) FILTER (WHERE status = 'rejected') AS n_rejected, count(*) FILTER (WHERE status = 'pending') AS n_pending FROM reg GROUP BY ROLLUP (aoi_id)", "reg")
def run_tally(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.run_tally(view(spark, d, "reg"), states={"complete": "n_complete", "rejected": "n_rejected", "pending": "n_pending"})


@query("t AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'rejected') AS rej FROM reg) SELECT rejection_reason, count(*) AS n, round(100.0*count(*)/any_value(rej), 6) AS pct_rejected, round(100.0*count(*)/any_value(total), 6) AS pct_total FROM reg, t WHERE status = 'rejected' GROUP BY rejection_reason", "reg")
def rejection_counts(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.rejection_counts(view(spark, d, "reg"), rejected=F.col("status") == "rejected")
    return out.select("rejection_reason", "n", r6("pct_rejected"), r6("pct_total"))


@query("SELECT status, region, count(*) AS n FROM reg WHERE gain_area > 1000 GROUP BY ALL", "reg")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.group_count(view(spark, d, "reg"), "status", "region", where=F.col("gain_area") > 1000)


@query(SET_SQL + ' SELECT "set", round(sum(area_km2*gain2), 6) AS total, count(*) FILTER (WHERE area_km2*gain2 > 0) AS nonzero, count(*) AS n, round(avg(area_km2*gain2), 6) AS mean, round(100.0*count(*) FILTER (WHERE area_km2*gain2 > 0)/count(*), 6) AS nonzero_pct, round(min(lon), 6) AS lon_min, round(max(lat), 6) AS lat_max FROM s GROUP BY "set"', "aoi")
def gain_totals(spark: SparkSession, d: str) -> DataFrame:
    report = reports.aoi_report(_screened(spark, d))
    return report["gain"].join(report["extents"], "set").select("set", r6("total"), "nonzero", "n", r6("mean"), r6("nonzero_pct"), r6("lon_min"), r6("lat_max"))


@query("c AS (SELECT DISTINCT biome FROM aoi), k AS (SELECT biome, row_number() OVER (ORDER BY biome) AS code FROM c) SELECT id, code FROM aoi JOIN k USING (biome)", "aoi")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.category_codes(view(spark, d, "aoi"), "biome", "code").select("id", F.col("code").cast("long").alias("code"))


@query("n AS (SELECT biome, rejection_reason, count(*) AS n FROM reg WHERE rejection_reason IS NOT NULL GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY biome ORDER BY n DESC, rejection_reason) <= 3", "reg")
def top_reasons(spark: SparkSession, d: str) -> DataFrame:
    counts = aggregates.group_count(view(spark, d, "reg"), "biome", "rejection_reason", where=F.col("rejection_reason").isNotNull())
    return aggregates.top_n(counts, 3, [F.desc("n"), F.col("rejection_reason")], "biome")


@query(
    """
    f AS (SELECT vec_id, CASE WHEN s0*40 < 0 THEN NULL ELSE s0*100 END AS h, CAST(abs(s1)*1000 AS BIGINT) % 11 AS k, expected FROM emb)
    SELECT CASE WHEN h IS NULL THEN NULL WHEN h < 2 THEN '0-2' WHEN h < 5 THEN '2-5' WHEN h < 10 THEN '5-10' WHEN h < 15 THEN '10-15' WHEN h < 20 THEN '15-20' WHEN h < 25 THEN '20-25' WHEN h < 30 THEN '25-30' ELSE '30+' END AS canopy, count(*) AS n FROM f GROUP BY 1""",
    "emb",
)
def canopy_classes(spark: SparkSession, d: str) -> DataFrame:
    h = F.when(F.col("s0") * 40 >= 0, F.col("s0") * 100)
    return view(spark, d, "emb").groupBy(S.canopy_class(h).alias("canopy")).agg(F.count("*").alias("n"))


@query(
    """
    n AS (SELECT tile_id, concat(CASE WHEN tile_id % 2 = 0 THEN 'Tropical & Subtropical ' ELSE 'Temperate ' END, CASE WHEN tile_id % 3 = 0 THEN 'Grasslands, Savannas & Shrublands' ELSE 'Broadleaf & Mixed Forests' END) AS biome, CASE WHEN tile_id % 5 = 0 THEN 'Error 429: too many' WHEN tile_id % 7 = 0 THEN 'Out of MEMORY' WHEN tile_id % 11 = 0 THEN 'bad file' END AS error, status FROM reg)
    SELECT replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(biome, 'Tropical & Subtropical ', 'T&S '), 'Temperate ', 'Temp. '), ', Savannas & Shrublands', '/Sav'), 'Grasslands', 'Grass'), 'Forests/Taiga', 'Forests'), ' & Mixed Forests', ''), 'Woodlands & Scrub', 'Scrub'), 'Deserts & Xeric Shrublands', 'Deserts/Xeric'), 'Flooded Grasslands & Savannas', 'Flooded Grass'), 'Montane Grasslands & Shrublands', 'Montane Grass'), ' Forests', '') AS biome,
      coalesce(regexp_matches(lower(error), '429|concurrent|quota|memory'), false) AS transient, count(*) AS n FROM n GROUP BY 1, 2""",
    "reg",
)
def names_and_errors(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("tile_id")
    biome = F.concat(F.when(t % 2 == 0, "Tropical & Subtropical ").otherwise("Temperate "), F.when(t % 3 == 0, "Grasslands, Savannas & Shrublands").otherwise("Broadleaf & Mixed Forests"))
    error = F.when(t % 5 == 0, "Error 429: too many").when(t % 7 == 0, "Out of MEMORY").when(t % 11 == 0, "bad file")
    return view(spark, d, "reg").groupBy(S.short_biome(biome).alias("biome"), S.transient_error(error).alias("transient")).agg(F.count("*").alias("n"))


@query(
    """
    v AS (SELECT c_custkey AS id FROM aoi WHERE c_custkey % 5 <> 0), r AS (SELECT c_custkey AS id FROM aoi WHERE c_custkey % 7 = 0), u AS (SELECT id FROM v UNION SELECT id FROM r)
    SELECT (SELECT count(*) FROM aoi) AS n_all, (SELECT count(*) FROM v) AS n_valid, (SELECT count(*) FROM r) AS n_rejected, (SELECT count(*) FROM u) AS n_done, (SELECT count(*) FROM aoi WHERE c_custkey NOT IN (SELECT id FROM u)) AS n_missing, (SELECT count(*) FROM v) + (SELECT count(*) FROM r) - (SELECT count(*) FROM u) AS n_duplicates""",
    "aoi",
)
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    ids = view(spark, d, "aoi").select(F.col("c_custkey").alias("id"))
    return reports.reconcile(ids, ids.where("id % 5 <> 0"), ids.where("id % 7 = 0"))[0]


@query("v AS (SELECT c_custkey AS id FROM aoi WHERE c_custkey % 5 <> 0), r AS (SELECT c_custkey AS id FROM aoi WHERE c_custkey % 7 = 0) SELECT id, 'missing' AS kind FROM (SELECT c_custkey AS id FROM aoi EXCEPT (SELECT id FROM v UNION SELECT id FROM r)) UNION ALL SELECT id, 'twice' FROM v JOIN r USING (id)", "aoi")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    ids = view(spark, d, "aoi").select(F.col("c_custkey").alias("id"))
    _, missing, twice = reports.reconcile(ids, ids.where("id % 5 <> 0"), ids.where("id % 7 = 0"))
    return sets.merge(missing.withColumn("kind", F.lit("missing")), twice.select("id", F.lit("twice").alias("kind")))


@query("SELECT quality, toxic, count(*) AS n, quality = toxic AS match FROM labels GROUP BY ALL", "px")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/labels.parquet")
    pairs = validation.side_by_side(rows.select("doc_id", F.col("quality").alias("v")), rows.select("doc_id", F.col("toxic").alias("v")), "doc_id", ["v"])
    return pairs.groupBy(F.col("a_v").alias("quality"), F.col("b_v").alias("toxic"), "match").agg(F.count("*").alias("n"))


@query("f AS (SELECT expected, list_position([s0, s1, s2, s3], greatest(s0, s1, s2, s3)) - 1 AS k FROM emb) SELECT CAST(expected AS BIGINT) AS expected, count(*) FILTER (WHERE k = 0) AS found_0, count(*) FILTER (WHERE k = 1) AS found_1, count(*) FILTER (WHERE k = 2) AS found_2, count(*) FILTER (WHERE k = 3) AS found_3 FROM f GROUP BY 1", "emb")
def label_check(spark: SparkSession, d: str) -> DataFrame:
    from rastertable.functions.pixels import argmax_band

    e = view(spark, d, "emb").withColumn("found", argmax_band(*[F.col(f"s{k}") for k in range(4)]))
    return validation.confusion(e, "expected", "found", range(4)).withColumn("expected", F.col("expected").cast("long"))


@query("SELECT gx, gy, count(*) AS n FROM px WHERE cov < scl*12 GROUP BY gx, gy", "px")
def bounded_check(spark: SparkSession, d: str) -> DataFrame:
    return validation.violations(view(spark, d, "px"), F.col("scl") * 12, F.col("cov")).groupBy("gx", "gy").agg(F.count("*").alias("n"))


@query("SELECT scene_id AS id, count(*) AS n FROM px GROUP BY scene_id HAVING count(*) > 1", "px")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return sets.duplicate_ids(view(spark, d, "px").select(F.col("scene_id").alias("id")), "id")


STATS_SQL = f"""
    r AS (SELECT gx, gy, y, cov, scl, b2n, {NDVI_SQL} AS ndvi FROM px WHERE y IN (1996, 1999)),
    n AS (SELECT gx, gy, median(ndvi) FILTER (WHERE y = 1999) - median(ndvi) FILTER (WHERE y = 1996) AS nd, avg(cov) AS canopy, coalesce(max(CASE WHEN b2n IS NOT NULL AND scl <> 3 THEN 1 ELSE 0 END) FILTER (WHERE y = 1996), 0) AS a0, coalesce(max(CASE WHEN b2n IS NOT NULL AND scl <> 3 THEN 1 ELSE 0 END) FILTER (WHERE y = 1999), 0) AS a1 FROM r GROUP BY gx, gy),
    p AS (SELECT *, CASE WHEN canopy > 55 THEN 1 ELSE 0 END AS gain FROM n),
    t AS (SELECT floor(gx/4)::BIGINT AS xi, floor(gy/4)::BIGINT AS yi, avg(gain) AS gain_frac, coalesce(avg(CASE WHEN gain = 1 THEN nd END), -9999.0) AS mean_delta, coalesce(median(CASE WHEN gain = 1 THEN nd END), -9999.0) AS median_delta, coalesce(avg(CASE WHEN gain = 1 THEN canopy END), -9999.0) AS canopy_mean, avg(a0) AS s0, avg(a1) AS s1 FROM p GROUP BY 1, 2)"""


def _stats(spark: SparkSession, d: str, method: str) -> DataFrame:
    from rastertable.functions.pixels import ndvi
    from rastertable.operators.composite import availability

    px = view(spark, d, "px").where("y IN (1996, 1999)").withColumn("NDVI", ndvi(F.col("b8"), F.col("b4")))
    canopy = px.groupBy("gx", "gy").agg(F.avg("cov").alias("canopy"))
    gain = canopy.select("gx", "gy", (F.col("canopy") > 55).cast("int").alias("gain"))
    return tiles.tile_stats(gain, tiles.yearly_ndvi(px, 1996, 1999), canopy, availability(px, ["b2n"], scl="scl"), (1996, 1999), 4, method)


@query(STATS_SQL + " SELECT xi, yi, round(gain_frac, 6) AS gain_frac, round(mean_delta, 6) AS mean_delta, round(median_delta, 6) AS median_delta, round(canopy_mean, 6) AS canopy_mean, round(s0, 6) AS s2_1996, round(s1, 6) AS s2_1999, (mean_delta <= 0) = (median_delta <= 0) AS match FROM t", "px")
def tile_stats_methods(spark: SparkSession, d: str) -> DataFrame:
    batch, single = _stats(spark, d, "mean").withColumnRenamed("ndvi_delta", "mean_delta"), _stats(spark, d, "median").select("xi", "yi", F.col("ndvi_delta").alias("median_delta"))
    out = batch.join(single, ["xi", "yi"])
    return out.select("xi", "yi", *[r6(c) for c in ("gain_frac", "mean_delta", "median_delta", "canopy_mean", "s2_1996", "s2_1999")], ((F.col("mean_delta") <= 0) == (F.col("median_delta") <= 0)).alias("match"))


@query(
    STATS_SQL
    + """, dd AS (SELECT xi, yi, CASE WHEN gain_frac*100 < 10 THEN printf('gain_pct=%.3f < 10.0', gain_frac*100) WHEN mean_delta = -9999 OR canopy_mean = -9999 THEN printf('no_gain_pixels gain_pct=%.3f', gain_frac*100) WHEN mean_delta <= 0 OR canopy_mean < 1 THEN printf('viability ndvi_delta=%.4f canopy_mean=%.3f', mean_delta, canopy_mean) WHEN s0 < 0.5 OR s1 < 0.5 THEN 'coverage' END AS reason FROM t)
    SELECT tile_id, CASE WHEN status <> 'pending' THEN status WHEN dd.xi IS NULL THEN 'failed' WHEN reason IS NULL THEN 'valid' ELSE 'rejected' END AS status, CASE WHEN status <> 'pending' THEN rejection_reason WHEN reason LIKE 'viability%' THEN 'viability' ELSE reason END AS reason FROM reg LEFT JOIN dd USING (xi, yi)""",
    "px", "reg",
)
def filter_tiles(spark: SparkSession, d: str) -> DataFrame:
    reg = view(spark, d, "reg").withColumn("error", F.lit(None).cast("string"))
    out = tiles.filter_tiles(reg, _stats(spark, d, "mean"), ["s2_1996", "s2_1999"], gain_min=10.0, available_min=0.5)
    kind = F.when(F.col("rejection_reason").startswith("viability"), "viability").when(F.col("rejection_reason").startswith("s2_coverage"), "coverage").otherwise(F.col("rejection_reason"))
    return out.select("tile_id", "status", kind.alias("reason"))


@query("g AS (SELECT gx, gy, CASE WHEN avg(cov) > 50 THEN 1 ELSE 0 END AS gain FROM px GROUP BY gx, gy), j AS (SELECT px.*, floor(gx/4)::BIGINT AS xi, floor(gy/4)::BIGINT AS yi FROM px JOIN g USING (gx, gy) WHERE gain = 1) SELECT xi, yi, y, round(avg(cov), 6) AS trees, count(DISTINCT scl) AS n_classes FROM j GROUP BY xi, yi, y", "px")
def inspect_tiles(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "px")
    pixels = px.groupBy("gx", "gy").agg(F.avg("cov").alias("canopy"), F.max("scl").alias("forest_type")).withColumns({"gain": (F.col("canopy") > 50).cast("int"), "nat_forest": F.lit(0.5)})
    out = reports.inspect_tiles(zonal.with_tile(pixels, 4), px.select("gx", "gy", "y", F.col("cov").alias("trees"), F.col("scl").alias("label")))
    classes = out["classes"].groupBy("xi", "yi", "y").agg(F.count("*").alias("n_classes"))
    return out["trees"].join(classes, ["xi", "yi", "y"]).select("xi", "yi", "y", r6("trees"), "n_classes")


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a stream; the glob lets it be one file or a folder of files."""
    schema = spark.read.parquet(f"{d}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parque[t]")


def _status_log(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "view", "pending").when(kind == "signup", "valid").when(kind == "click", "submitted").when(kind == "purchase", "complete").otherwise("failed")
    return events.select("event_id", F.col("user_id").alias("tile_id"), "ts", name.alias("status"))


@query("SELECT tile_id, status, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY ts DESC, event_id DESC) = 1", "ev")
def fold_status(spark: SparkSession, d: str) -> DataFrame:
    out = work_dir(spark, "fold-status")
    streams.fold_status(_status_log(_stream(spark, d, "events")), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return streams.folded(spark, f"{out}/table").select("tile_id", "status", "event_id")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n_done, count(*) FILTER (WHERE status = 'valid') AS n_valid, count(*) FILTER (WHERE status = 'failed') AS n_failed, round(count(*)/360.0, 6) AS per_minute FROM ev GROUP BY 1", "ev")
def progress_rate(spark: SparkSession, d: str) -> DataFrame:
    out = work_dir(spark, "progress")
    log = _status_log(_stream(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.progress_stream(log, f"{out}/table", f"{out}/checkpoint", "6 hours", late="3650 days").awaitTermination()  # files come in any order
    return streams.current_rates(spark, f"{out}/table").select(F.col("start").cast("timestamp_ntz").alias("start"), "n_done", "n_valid", "n_failed", r6("per_minute"))


@query("SELECT l_partkey % 32 AS gx, l_orderkey % 32 AS gy, CAST(year(l_shipdate) AS BIGINT) AS y, CAST(max(CASE WHEN l_tax*100 >= 0.5 AND l_linenumber <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS available FROM lineitem GROUP BY ALL", "px")
def availability_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "lineitem").select((F.col("l_partkey") % 32).alias("gx"), (F.col("l_orderkey") % 32).alias("gy"), F.year("l_shipdate").cast("long").alias("y"), F.when(F.col("l_tax") * 100 >= 0.5, F.col("l_tax")).alias("b2n"), "l_linenumber")
    out = work_dir(spark, "availability")
    streams.availability_stream(rows, ["b2n"], f"{out}/table", f"{out}/checkpoint", usable=F.col("l_linenumber") != 3).awaitTermination()
    return spark.read.parquet(f"{out}/table").groupBy("gx", "gy", "y").agg(F.max("available").cast("long").alias("available"))


@query(f"SELECT c_custkey, {WATER} AS rejection_reason FROM aoi", "aoi")
def incremental_screen(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    facts = {"land_frac": (F.col("c_acctbal") + 1000) / 11000, "veg_fraction": (k * 31 % 100) / 1000.0, "forest_gain_frac": (k * 17 % 100) / 10000.0, "s2_frac": (k * 13 % 100) / 500.0}
    out = work_dir(spark, "screen")
    streams.incremental_screen(_stream(spark, d, "customer").withColumns(facts), lambda df: screening.screened(df, LIMITS), f"{out}/table", f"{out}/checkpoint", "c_custkey").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("c_custkey", "rejection_reason")
