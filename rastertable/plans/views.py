"""Input views over the given tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "px": """SELECT l_partkey % 32 AS gx, l_orderkey % 32 AS gy, l_suppkey AS scene_id, l_shipdate AS ts, CAST(year(l_shipdate) AS BIGINT) AS y,
       l_quantity AS b8, l_discount*100+1 AS b4, l_tax*100+1 AS b2, CASE WHEN l_tax*100 >= 0.5 THEN l_tax*100+1 END AS b2n, CAST(l_linenumber AS BIGINT) AS scl,
       (l_orderkey*37 + l_linenumber*11 + l_suppkey*7) % 100 AS cov, l_returnflag AS sensor, l_suppkey % 100 AS cloudy_pct, l_orderkey AS ok
       FROM lineitem""",
    "dem": "SELECT l_partkey % 32 AS gx, l_orderkey % 32 AS gy, avg(l_extendedprice)/100 AS z FROM lineitem GROUP BY l_partkey % 32, l_orderkey % 32",
    "aoi": """SELECT c_custkey, concat('aoi_', CAST(c_custkey AS VARCHAR(20))) AS id, ((c_custkey*7919) % 36000)/100.0 - 180 AS lon, ((c_custkey*104729) % 14500)/100.0 - 60 AS lat,
       (c_acctbal+1000)/11000 AS land_frac, ((c_custkey*31) % 100)/1000.0 AS veg_fraction, ((c_custkey*17) % 100)/10000.0 AS forest_gain_frac, ((c_custkey*13) % 100)/500.0 AS s2_frac,
       CAST(400 + c_custkey % 300 AS DOUBLE) AS area_km2, c_mktsegment AS biome, r_name AS region, c_nationkey
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "eco": """SELECT s_suppkey AS eco_id, ((s_suppkey*3571) % 340) - 180 AS x0, ((s_suppkey*2801) % 120) - 60 AS y0, 20 + s_suppkey % 20 AS w, 15 + s_suppkey % 10 AS h,
       CASE WHEN s_suppkey % 13 = 0 THEN 'N/A' ELSE s_name END AS biome_name, CASE WHEN s_suppkey % 17 <> 0 THEN s_suppkey % 14 END AS biome_num FROM supplier""",
    "eco_ids": "SELECT s_suppkey FROM supplier",
    "cell": """SELECT c_custkey, concat('aoi_', CAST(c_custkey AS VARCHAR(20))) AS id, (CAST(floor(((c_custkey*7919) % 36000)/25) AS BIGINT) - 720)*0.25 AS min_lon, (CAST(floor(((c_custkey*104729) % 14500)/25) AS BIGINT) - 240)*0.25 AS min_lat FROM customer""",
    "pts": """SELECT (CAST(floor(((o_custkey*7919) % 36000)/25) AS BIGINT) - 720)*0.25 + 0.05 + (o_orderkey % 4)*0.04 AS lon, (CAST(floor(((o_custkey*104729) % 14500)/25) AS BIGINT) - 240)*0.25 + 0.05 + (o_orderkey % 3)*0.04 AS lat,
       CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS land, (o_orderkey % 7)/64.0 AS veg, CASE WHEN o_orderkey % 5 < 3 THEN 0 ELSE 1 END/64.0 AS gain, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS s2 FROM orders""",
    "reg": """SELECT o_orderkey AS tile_id, o_orderkey % 100 AS xi, CAST(floor(o_orderkey/100) AS BIGINT) AS yi, o_custkey AS aoi_id,
       CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'complete' ELSE 'rejected' END AS status,
       CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS rejection_reason, o_totalprice AS gain_area, o_orderdate AS updated_at, c_mktsegment AS biome, r_name AS region
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ev": """SELECT event_id, user_id AS tile_id, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'valid' WHEN 'click' THEN 'submitted' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status, value FROM events""",
    "emb": "SELECT vec_id, {0} AS s0, {1} AS s1, {2} AS s2, {3} AS s3, label % 4 AS expected FROM embeddings",
}
#: An L with a slanted hole and a separate triangle, in eighths of a box: (part, ring, seq, x, y).
_SHAPE = "(0, 0, 0, 0, 0), (0, 0, 1, 8, 0), (0, 0, 2, 8, 4), (0, 0, 3, 4, 4), (0, 0, 4, 4, 8), (0, 0, 5, 0, 8), (0, 1, 0, 2, 1), (0, 1, 1, 3, 2), (0, 1, 2, 2, 3), (0, 1, 3, 1, 2), (1, 0, 0, 6, 6), (1, 0, 1, 8, 6), (1, 0, 2, 7, 8)"


def _rings(boxes: str) -> str:
    """Vertices of one shape for each box; every third has the hole, every second the triangle."""
    return f"""SELECT poly, part, ring, seq, x0 + w*qx*CAST(0.125 AS DOUBLE) AS x, y0 + h*qy*CAST(0.125 AS DOUBLE) AS y
       FROM ({boxes}) AS b CROSS JOIN (VALUES {_SHAPE}) AS v(part, ring, seq, qx, qy) WHERE (ring = 0 OR poly % 3 = 0) AND (part = 0 OR poly % 2 = 0)"""


VIEWS |= {
    "eco_rings": _rings("SELECT s_suppkey AS poly, ((s_suppkey*3571) % 340) - 180 AS x0, ((s_suppkey*2801) % 120) - 60 AS y0, 20 + s_suppkey % 20 AS w, 15 + s_suppkey % 10 AS h FROM supplier"),
    "plots": _rings("SELECT s_suppkey AS poly, (s_suppkey*37) % 480 AS x0, (s_suppkey*53) % 490 AS y0, 8 + s_suppkey % 24 AS w, 6 + s_suppkey % 17 AS h FROM supplier"),
    "field": "SELECT DISTINCT l_partkey % 512 AS gx, l_orderkey % 512 AS gy FROM lineitem",
}
#: Sums of each quarter of a 64-dimensional vector, as Spark and as DuckDB state them.
_QUARTERS = [f"aggregate(slice(embedding, {k}, 16), 0D, (a, x) -> a + CAST(x AS DOUBLE))" for k in (1, 17, 33, 49)]
_QUARTERS_DUCK = [f"list_sum(list_transform(embedding[{k}:{k + 15}], lambda x: CAST(x AS DOUBLE)))" for k in (1, 17, 33, 49)]
_TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the tables it names are read from ``sf_dir``."""
    text = VIEWS[name].format(*_QUARTERS) if name == "emb" else VIEWS[name]
    used = [t for t in _TABLES if re.search(rf"\b{t}\b(?!_)", text.split("FROM", 1)[1])]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def sql(body: str, *names: str) -> str:
    """DuckDB SQL with the named views as common table expressions before ``body``, which may go on with more of them."""
    text = ",\n".join(f"{n} AS ({VIEWS[n].format(*_QUARTERS_DUCK) if n == 'emb' else VIEWS[n]})" for n in names)
    body = body.strip()
    return f"WITH {text}{',' if not body.upper().startswith('SELECT') else ''}\n{body}"
