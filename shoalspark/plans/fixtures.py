"""Views of the driver's tables in the engine's own schemas (see FIXTURES.md); the SQL runs in Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_pixels": """SELECT o_orderkey AS cell,
       CAST(floor(o_orderkey / 1e2) AS INT) AS prow, CAST(o_orderkey % 100 AS INT) AS pcol,
       5e5 + (o_orderkey % 100) * 1e1 + 5e0 AS x, 3.4e6 - floor(o_orderkey / 1e2) * 1e1 - 5e0 AS y,
       2e-2 + (o_custkey % 97) * 1e-3 AS b02, 2e-2 + (o_orderkey * 7 % 89) * 1e-3 AS b03,
       1e-2 + (o_orderkey * 13 % 61) * 1e-3 AS b04, 5e-3 + (o_custkey % 53) * 1e-3 AS b08,
       CAST(o_orderkey % 12 AS INT) AS scl,
       CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS land
FROM orders""",
    "fx_points": """SELECT event_id AS point_id, 5e5 + (event_id * 37 % 1000) AS x, 3.4e6 - (event_id * 53 % 1500) AS y,
       -8.8e1 + (event_id * 37 % 1000) * 1e-5 AS longitude, 3.05e1 - (event_id * 53 % 1500) * 1e-5 AS latitude,
       -(5e-1 + (event_id * 11 % 200) * 1e-1) AS depth_m,
       CASE event_type WHEN 'click' THEN 'atl03' WHEN 'view' THEN 'atl24' WHEN 'purchase' THEN 'extra_xyz'
            WHEN 'signup' THEN 'multibeam' ELSE 'bathy_lidar' END AS source,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE 1e0 END AS sample_weight,
       user_id AS track, ts
FROM events""",
    "fx_photons": """SELECT CAST(l_suppkey % 10 AS INT) AS granule, concat('gt', CAST(l_linenumber % 3 + 1 AS VARCHAR(4))) AS beam,
       3.05e1 + l_orderkey * 1e-5 AS latitude, -8.8e1 + l_orderkey * 2e-6 AS longitude,
       CASE WHEN l_quantity <= 25 THEN l_discount ELSE -(2e0 + l_tax * 5e1) - l_discount END AS photon_height,
       CAST(l_partkey % 5 AS INT) AS conf, CAST(l_orderkey AS DOUBLE) AS delta_time
FROM lineitem""",
    "fx_scenes": """SELECT s_suppkey AS scene_id, concat('T', CAST(s_suppkey % 3 AS VARCHAR(4))) AS tile,
       CAST(s_suppkey * 5 % 20 AS INT) AS day_no, CAST(s_suppkey * 17 % 60 AS DOUBLE) AS cloud,
       2e1 + (s_suppkey % 40) AS sun_zenith
FROM supplier""",
    "fx_stack": """SELECT p.prow, p.pcol, d.day_no, p.b02 + d.day_no * 1e-3 * (p.cell % 3) AS b02,
       p.b03 + d.day_no * 1e-3 * (p.cell % 5) AS b03, p.b04, p.b08, (p.scl + d.day_no) % 12 AS scl
FROM fx_pixels p CROSS JOIN (SELECT DISTINCT CAST(s_suppkey % 5 AS INT) AS day_no FROM supplier) d""",
    "fx_sections": """SELECT c_custkey AS xs_id, c_nationkey AS river_id, c_custkey * 2.5e1 AS s_center_m,
       2e1 + (c_custkey * 7 % 180) AS width_m,
       4e1 - c_custkey * 1e-3 + (c_custkey * 31 % 11) * 1e-2 AS wse_m,
       5e-1 + (c_custkey * 29 % 60) * 1e-1 AS depth_pred_m,
       1e0 + (c_custkey * 19 % 400) AS drain_area_km2, 1e-4 + (c_custkey % 30) * 1e-4 AS slope_mpm
FROM customer""",
    "fx_measurements": """SELECT p_partkey AS meas_id, CAST(p_partkey % 20 AS INT) AS site_no, 3e1 + p_size AS width_ft,
       2e0 + p_size * 5e-2 + (p_partkey % 7) * 1e-1 AS stage_ft,
       1e2 + p_retailprice AS discharge_cfs, (3e1 + p_size) * (1e0 + (p_partkey % 9) * 5e-1) AS area_sqft
FROM part""",
    "fx_lines": """SELECT c_custkey % 5 AS line_id, CAST(floor(c_custkey / 5e0) AS BIGINT) AS seq,
       5e5 + c_custkey % 5 * 2e2 + floor(c_custkey / 5e0) * 7 % 11 * 4e0 AS x, 3.4e6 - floor(c_custkey / 5e0) * 2e1 AS y
FROM customer""",
    "fx_edges": """SELECT s_suppkey AS edge_id, s_suppkey - 1 AS from_node, s_suppkey AS to_node, 1e2 + (s_suppkey * 3 % 50) AS length_m
FROM supplier WHERE s_suppkey % 25 > 0""",
    "fx_nodes": """SELECT node, CAST(node * 37 % 101 AS DOUBLE) AS y FROM (SELECT from_node AS node FROM fx_edges UNION SELECT to_node AS node FROM fx_edges) n""",
}


def _names(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\b\w+\b", sql)) if n in VIEWS]


def closure(views: list[str]) -> list[str]:
    """``views`` with those they are made of, in order."""
    out: list[str] = []
    for v in views:
        out += [n for n in [*closure(_names(VIEWS[v])), v] if n not in out]
    return out


def with_clause(views: list[str], materialized: bool = False) -> str:
    kind = "MATERIALIZED " if materialized else ""
    return "WITH " + ", ".join(f"{v} AS {kind}({VIEWS[v]})" for v in closure(views)) if views else ""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view, straight over the Parquet files, so that filters and columns are pushed to the scan."""
    sql = f"{with_clause(_names(VIEWS[name]))} {VIEWS[name]}"
    for t in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql)
