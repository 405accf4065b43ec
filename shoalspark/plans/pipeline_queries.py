"""Queries of the chains: diversity, composite, river depth, scene prediction, tile functions, settings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shoalspark.functions import optics
from shoalspark.operators import pipelines
from shoalspark.plans.registry import query

C = F.col
_GRID = (5e5, 3.4e6, 10.0)

_COVER = """b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_points), c AS (SELECT CAST(least(9, floor((y - y0) / (y1 - y0) * 10)) AS INT) AS gr, CAST(least(9, floor((x - x0) / (x1 - x0) * 10)) AS INT) AS gc, count(*) AS n FROM fx_points, b GROUP BY 1, 2),
    g AS (SELECT r.r AS gr, q.c AS gc, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(0, 10)) AS INT) AS r) r CROSS JOIN (SELECT CAST(unnest(range(0, 10)) AS INT) AS c) q LEFT JOIN c ON c.gr = r.r AND c.gc = q.c)"""


@query("p8_a33_diversity", "fx_points", doubles="spatial depth spectral top_share score", twin=f"""WITH {_COVER}, d AS (SELECT least(floor(abs(depth_m)), 19) AS bin, count(*) AS n FROM fx_points WHERE abs(depth_m) > 0 AND abs(depth_m) <= 20 GROUP BY 1), t AS (SELECT track, CAST(ts AS DATE) AS day, count(*) AS n FROM fx_points GROUP BY 1, 2),
    o AS (SELECT (SELECT avg(CASE WHEN n >= 10 THEN 1.0 ELSE 0.0 END) FROM g) AS spatial, (SELECT count(*) FILTER (n < 10) FROM g) AS empty_cells, (SELECT count(*) FILTER (n >= 10) FROM d) / (SELECT ceil(max(abs(depth_m))) FROM fx_points) AS depth,
    (SELECT least(1.0, 2 * stddev_pop(depth_m) / (avg(abs(depth_m)) + 1e-6)) FROM fx_points) AS spectral, (SELECT count(*) FROM t) AS passes, (SELECT max(n) / sum(n) FROM t) AS top_share)
    SELECT *, 0.3 * spatial + 0.3 * depth + 0.2 * spectral + 0.2 * least(passes / 10, 1.0) AS score, coalesce(nullif(concat_ws('; ', CASE WHEN spatial < 0.5 THEN 'most of the area has no training points' WHEN spatial < 0.8 THEN 'parts of the area have no training points' END, CASE WHEN depth < 0.5 THEN 'few depths are covered' END,
    CASE WHEN passes < 3 THEN 'too few passes' WHEN passes < 5 THEN 'more passes would help' END, CASE WHEN top_share > 0.5 THEN 'one pass dominates' END, CASE WHEN spectral < 0.4 THEN 'little optical variety' END), ''), 'nothing is missing') AS advice FROM o""")
def _(p):
    return pipelines.diversity(p, ["depth_m"])


@query("p8_diversity_gaps", "fx_points", twin=f"""WITH {_COVER}, e AS (SELECT CAST(unnest(range(0, 30)) AS INT) AS bin), n AS (SELECT CAST(floor(abs(depth_m)) AS INT) AS bin, count(*) AS n FROM fx_points GROUP BY 1), s AS (SELECT bin, bin - row_number() OVER (ORDER BY bin) AS run FROM e LEFT JOIN n USING (bin) WHERE coalesce(n, 0) < 10),
    k AS (SELECT min(bin) AS a, CAST(max(bin) + 1 AS INT) AS z FROM s GROUP BY run) SELECT 'depth' AS kind, a AS first, z AS second FROM (SELECT * FROM k ORDER BY z - a DESC, a LIMIT 5) UNION ALL SELECT 'cell', gr, gc FROM (SELECT * FROM g WHERE n < 10 ORDER BY n, gr, gc LIMIT 5)""")
def _(p):
    return pipelines.diversity_gaps(p)


@query("p6_optical_composite", "fx_scenes fx_stack")
def _(s, st):
    return pipelines.optical_composite(s.withColumn("day_no", C("day_no") % 5), st, ["b02", "b03", "b04", "b08"], most_cloud=60.0, dates=4)


@query("m14_predicted_with_uncertainty", "fx_pixels", doubles="depth_pred_m sigma_m confidence", twin="""WITH z AS (SELECT *, b04 * 10 AS kd, 30 * ln(1000 * b02) / ln(1000 * b03) - 22 AS depth_pred_m FROM fx_pixels WHERE land = 0),
    s AS (SELECT *, least(10.0, greatest(0.05, sqrt(0.0625 + pow(0.05 + 0.15 * abs(kd * depth_pred_m), 2) + pow(0.03 * abs(depth_pred_m), 2) + pow(0.2 * greatest(abs(depth_pred_m) - 6, 0), 2) + pow(0.1 + 0.05 * (pcol * 100.0 / 1000), 2) + 0.0064))) AS sigma_m FROM z)
    SELECT cell, depth_pred_m, sigma_m, greatest(0.0, least(1.0, 1 / (1 + sigma_m / (depth_pred_m + 0.5) * 0.3) * CASE WHEN kd * depth_pred_m > 4 THEN 0.15 WHEN kd * depth_pred_m > 3 THEN 0.5 ELSE 1 END * CASE WHEN depth_pred_m / 6.0 > 2 THEN 0.03 WHEN depth_pred_m / 6.0 > 1.5 THEN 0.3 ELSE 1 END)) AS confidence FROM s""")
def _(px):
    t = px.where("land = 0").withColumn("kd", C("b04") * 10)
    return pipelines.predicted_with_uncertainty(t, optics.log_ratio_depth(C("b02"), C("b03"), -22.0, 30.0), "transfer", C("kd"), 6.0, distance_m=C("pcol") * 100.0).select("cell", "depth_pred_m", "sigma_m", "confidence")


@query("m16_physics_scene", "fx_pixels")
def _(px):
    return pipelines.physics_scene(px)


def focal_mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean over the 3 x 3 cells that are there."""
    r, c = pdf["prow"].to_numpy() - pdf["prow"].min() + 1, pdf["pcol"].to_numpy() - pdf["pcol"].min() + 1
    grid = np.full((r.max() + 2, c.max() + 2), np.nan)
    grid[r, c] = pdf["b03"]
    around = np.stack([grid[r + i, c + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return pdf[["prow", "pcol"]].assign(mean_v=np.nanmean(around, axis=0))


@query("e1_chunked_focal_mean", "fx_pixels", doubles="mean_v", twin="SELECT p.prow, p.pcol, avg(q.b03) AS mean_v FROM fx_pixels p JOIN (SELECT prow + i AS prow, pcol + j AS pcol, b03 FROM fx_pixels, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) q ON p.prow = q.prow AND p.pcol = q.pcol GROUP BY p.prow, p.pcol")
def _(px):
    return pipelines.chunked_apply(px.select("prow", "pcol", "b03"), focal_mean, "prow int, pcol int, mean_v double", 16, 1)


@query("e2_batched_apply", "fx_pixels", doubles="ratio", twin="SELECT cell, b02 / b03 AS ratio FROM fx_pixels")
def _(px):
    return pipelines.batched_apply(px.select("cell", "b02", "b03"), lambda b: pd.DataFrame({"cell": b["cell"], "ratio": b["b02"] / b["b03"]}), "cell long, ratio double")


@query("s15_regional_settings", "fx_points", doubles="max_depth cloud", twin="""SELECT point_id, CASE WHEN x BETWEEN 500000 AND 500300 AND y BETWEEN 3399000 AND 3400000 THEN 12.0 WHEN x BETWEEN 500200 AND 500600 AND y BETWEEN 3398500 AND 3400000 THEN 25.0 ELSE 20.0 END AS max_depth,
    CASE WHEN x BETWEEN 500000 AND 500300 AND y BETWEEN 3399000 AND 3400000 THEN 20.0 WHEN x BETWEEN 500200 AND 500600 AND y BETWEEN 3398500 AND 3400000 THEN 40.0 ELSE 20.0 END AS cloud FROM fx_points""")
def _(p):
    regions = [((500000, 500300, 3399000, 3400000), {"max_depth": 12.0}), ((500200, 500600, 3398500, 3400000), {"max_depth": 25.0, "cloud": 40.0})]
    return p.select("point_id", *(c.alias(n) for n, c in pipelines.regional_settings(C("x"), C("y"), regions, {"max_depth": 20.0, "cloud": 20.0}).items()))


@query("s17_cell_points", "fx_pixels", doubles="x y z", twin="SELECT 5e5 + (pcol + 0.5) * 10 AS x, 3.4e6 - (prow + 0.5) * 10 AS y, b03 AS z FROM fx_pixels WHERE prow % 3 = 0 AND pcol % 3 = 0 AND land = 0")
def _(px):
    return pipelines.cell_points(px.withColumn("v", F.when(C("land") == 0, C("b03"))), "v", *_GRID, step=3)


@query("s18_stacked_mean", "fx_pixels", doubles="z", twin="SELECT cell, CASE WHEN scl > 0 AND land + 1 > 0 THEN b03 * 50 / scl / (land + 1) END AS z FROM fx_pixels")
def _(px):
    return px.select("cell", pipelines.stacked_mean(C("b03") * 50, C("scl"), C("land") + 1).alias("z"))
