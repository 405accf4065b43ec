"""Queries of chainage, cross-sections, connected water and the fills that follow channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalspark.operators import channels
from shoalspark.plans.registry import query

C = F.col
_GRID = (5e5, 3.4e6, 10.0)

_SEGMENTS = """SELECT *, sqrt(pow(ex - ax, 2) + pow(ey - ay, 2)) AS len FROM (SELECT line_id, seq, x AS ax, y AS ay, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM fx_lines WINDOW w AS (PARTITION BY line_id ORDER BY seq))"""
_STARTS = f"SELECT * FROM (SELECT *, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ({_SEGMENTS})) WHERE len > 0"


def _chainage(table, key):
    """SQL: offset, line and chainage of each row of a table on the lines, by all segments whose box comes near."""
    t = "greatest(0.0, least(1.0, ((p.x - ax) * (ex - ax) + (p.y - ay) * (ey - ay)) / (len * len)))"
    return f"""SELECT {key}, min(struct_pack(off_m := off_m, line_id := line_id, s_m := s_m)) AS b FROM (SELECT {key}, line_id, start + t * len AS s_m, sqrt(pow(x - ax - t * (ex - ax), 2) + pow(y - ay - t * (ey - ay), 2)) AS off_m
        FROM (SELECT p.{key}, p.x, p.y, s.*, {t} AS t FROM {table} p JOIN starts s ON p.x BETWEEN least(ax, ex) - 200 AND greatest(ax, ex) + 200 AND p.y BETWEEN least(ay, ey) - 200 AND greatest(ay, ey) + 200)) WHERE off_m <= 200 GROUP BY {key}"""


@query(
    "g4_chainage", "fx_points fx_lines", doubles="s_m off_m",
    twin=f"WITH starts AS ({_STARTS}), n AS ({_chainage('fx_points', 'point_id')}) SELECT point_id, b.line_id AS line_id, b.s_m AS s_m, b.off_m AS off_m FROM fx_points LEFT JOIN n USING (point_id)",
)
def _(p, lines):
    return channels.chainage(p.select("point_id", "x", "y"), lines, "point_id", 200.0).select("point_id", "line_id", "s_m", "off_m")


@query(
    "i3_anisotropic", "fx_pixels fx_points fx_lines", doubles="depth",
    twin=f"""WITH starts AS ({_STARTS}), px AS (SELECT * FROM fx_pixels), pt AS (SELECT * FROM fx_points WHERE source = 'multibeam'), q AS ({_chainage("px", "cell")}), r AS ({_chainage("pt", "point_id")}),
        c AS (SELECT a.cell, b.point_id, b.depth_m, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, coalesce(abs(q.b.s_m - r.b.s_m), 0) AS s FROM px a CROSS JOIN pt b LEFT JOIN q USING (cell) LEFT JOIN r ON r.point_id = b.point_id),
        k AS (SELECT *, sqrt(pow(s / 500, 2) + greatest(0.0, d * d - s * s) / 900) + 1e-6 AS e FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d, point_id) AS i FROM c) WHERE i <= 30)
        SELECT cell, sum(depth_m / (e * e)) / sum(1 / (e * e)) AS depth, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(e, 9), point_id) AS j FROM k) WHERE j <= 6 GROUP BY cell""",
)
def _(px, p, lines):
    return channels.anisotropic_distance(px, p.where("source = 'multibeam'"), lines, "depth_m", k=6)


@query(
    "g5_x41_cross_sections", "fx_lines fx_pixels", doubles="x y lowest left_z right_z width_m",
    twin=f"""WITH s AS ({_STARTS}), st AS (SELECT line_id, station_m, ax + (station_m - start) / len * (ex - ax) AS x, ay + (station_m - start) / len * (ey - ay) AS y, -(ey - ay) / len AS nx, (ex - ax) / len AS ny
        FROM (SELECT *, unnest(range(CAST(ceil(start / 53) AS BIGINT), CAST(ceil((start + len) / 53) AS BIGINT))) * 53.0 AS station_m FROM s)),
        z AS (SELECT t.line_id, t.station_m, t.x, t.y, t.d, p.b03 AS z FROM (SELECT *, k * 7.0 AS d FROM st, (SELECT unnest(range(0, 21)) AS k)) t LEFT JOIN fx_pixels p ON p.prow = CAST(floor((3.4e6 - (t.y + (t.d - 70) * ny)) / 10) AS INT) AND p.pcol = CAST(floor((t.x + (t.d - 70) * nx - 5e5) / 10) AS INT))
        SELECT line_id, station_m, any_value(x) AS x, any_value(y) AS y, count(z) AS samples, min(z) AS lowest, arg_max(d, struct_pack(z := z, d := -d)) FILTER (d <= 30 AND z IS NOT NULL) AS left_m, max(z) FILTER (d <= 30) AS left_z,
        arg_max(d, struct_pack(z := z, d := -d)) FILTER (d >= 110 AND z IS NOT NULL) AS right_m, max(z) FILTER (d >= 110) AS right_z, arg_max(d, struct_pack(z := z, d := -d)) FILTER (d >= 110 AND z IS NOT NULL) - arg_max(d, struct_pack(z := z, d := -d)) FILTER (d <= 30 AND z IS NOT NULL) AS width_m
        FROM z GROUP BY line_id, station_m""",
)
def _(lines, px):
    return channels.cross_sections(lines, px, "b03", *_GRID, spacing_m=53.0, half_m=70.0, step_m=7.0, bank_m=30.0)


_REACH = """r AS (SELECT prow, pcol, prow AS r0, pcol AS c0 FROM w UNION SELECT w.prow, w.pcol, r.r0, r.c0 FROM r JOIN w ON abs(w.prow - r.prow) + abs(w.pcol - r.pcol) = 1 AND w.prow BETWEEN r.prow - 1 AND r.prow + 1)"""


@query(
    "n7_water_components", "fx_pixels",
    twin=f"WITH RECURSIVE w AS (SELECT prow, pcol FROM fx_pixels WHERE scl BETWEEN 4 AND 8), {_REACH} SELECT prow, pcol, min(r0 * CAST(2147483648 AS BIGINT) + c0) AS component_id FROM r GROUP BY prow, pcol",
)
def _(px):
    return channels.mask_components(px.withColumn("w", C("scl").between(4, 8)), "w")


@query("i6_component_fill", "fx_pixels fx_points")
def _(px, p):
    prior = px.withColumn("depth_m", F.when(C("scl").between(4, 8) & (C("land") == 0), -C("b03") * 100)).withColumn("bank", F.when(C("cell") % 3 == 0, -C("b02") * 50))
    return channels.component_fill(prior, p, *_GRID, bank="bank", least=5)


@query("i4_channel_surface", "fx_pixels fx_points fx_lines")
def _(px, p, lines):
    soundings = p.where("source = 'bathy_lidar'")
    parts = [channels.channel_surface(px, soundings, "depth_m", *_GRID, 25.0, m, k=6, lines=lines).withColumn("method", F.lit(m)) for m in ("idw", "anisotropic")]
    return parts[0].unionByName(parts[1])
