"""Queries of adaptive sampling, with twins that number whole sources and cells."""

from __future__ import annotations

from shoalspark.operators import sampling
from shoalspark.plans.registry import query

_TIER = "CASE source WHEN 'atl24' THEN 2 WHEN 'extra_xyz' THEN 2 WHEN 'multibeam' THEN 1 WHEN 'bathy_lidar' THEN 1 ELSE 3 END"
_WEIGHT = "CASE source WHEN 'bathy_lidar' THEN 25e0 WHEN 'multibeam' THEN 20e0 WHEN 'extra_xyz' THEN 10e0 WHEN 'atl24' THEN 6e0 ELSE 3e0 END"
_RETAIN = "CASE source WHEN 'bathy_lidar' THEN 0.85e0 WHEN 'multibeam' THEN 0.8e0 WHEN 'extra_xyz' THEN 0.4e0 WHEN 'atl24' THEN 0.3e0 ELSE 0.1e0 END"
_SPACING = "CASE source WHEN 'bathy_lidar' THEN 10e0 WHEN 'multibeam' THEN 15e0 WHEN 'extra_xyz' THEN 30e0 WHEN 'atl24' THEN 40e0 ELSE 60e0 END"

# neighbours by cells of a side within which even a corner's quarter holds 50 points
_COMPLEXITY = """side AS (SELECT sqrt((max(x) - min(x)) * (max(y) - min(y)) * 200 / (pi() * count(*))) AS r FROM fx_points),
    a AS (SELECT point_id, x, y, floor(x / r) AS cx, floor(y / r) AS cy FROM fx_points, side),
    b AS (SELECT point_id AS ref_id, x AS rx, y AS ry, depth_m, floor(x / r) + i.i AS cx, floor(y / r) + j.j AS cy FROM fx_points, side, (SELECT unnest([-1, 0, 1]) AS i) i, (SELECT unnest([-1, 0, 1]) AS j) j),
    k AS (SELECT point_id, depth_m, row_number() OVER (PARTITION BY point_id ORDER BY sqrt(pow(x - rx, 2) + pow(y - ry, 2)), ref_id) AS rn FROM a JOIN b USING (cx, cy)),
    sp AS (SELECT point_id, stddev_pop(depth_m) AS spread FROM k WHERE rn <= 30 GROUP BY point_id),
    cplx AS (SELECT point_id, round(least(1e0, 0.4e0 * spread / (SELECT max(spread) FROM sp) + 0.1e0), 9) AS complexity FROM sp),
    s AS (SELECT point_id, x, y, depth_m, source, coalesce(sample_weight, 1e0) AS sample_weight, complexity, {tier} AS tier, {weight} AS weight FROM fx_points JOIN cplx USING (point_id))""".format(tier=_TIER, weight=_WEIGHT)


def _thinned(name: str, rows: str, wanted: int = 2000) -> str:
    """Tables that end in ``name``: what stays of ``rows``."""
    n = name
    return f"""{n}_g AS (SELECT source, count(*) AS n, min(x) AS x0, min(y) AS y0, greatest(1e0, max(x) - min(x)) * greatest(1e0, max(y) - min(y)) AS area, least(count(*), {wanted}) AS wanted FROM ({rows}) GROUP BY source),
    {n}_h AS (SELECT *, CASE WHEN area / ({_SPACING} * {_SPACING}) < wanted THEN greatest(2e0, sqrt(area / wanted)) ELSE {_SPACING} END AS eff, least(n, ceil({_RETAIN} * n), 5000)::BIGINT AS retain FROM {n}_g),
    {n}_c AS (SELECT *, CASE WHEN complexity >= 0.7 THEN 0 WHEN complexity < 0.3 THEN 2 ELSE 1 END AS cls FROM ({rows}) JOIN {n}_h USING (source)),
    {n}_d AS (SELECT *, greatest(eff, least(CASE cls WHEN 0 THEN 15e0 WHEN 1 THEN 30e0 ELSE 60e0 END, 2 * eff)) AS grid, greatest(eff, greatest(eff, least(60e0, 2 * eff)) / 2) AS base FROM {n}_c),
    {n}_e AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY source, cls, floor((x - x0) / grid), floor((y - y0) / grid)) AS in_cell, floor((x - x0) / base)::BIGINT AS bx, floor((y - y0) / base)::BIGINT AS by_ FROM {n}_d
        WINDOW w AS (PARTITION BY source, cls, floor((x - x0) / grid), floor((y - y0) / grid) ORDER BY weight * (1 + complexity) DESC, point_id)),
    {n}_f AS (SELECT *, r = 1 OR (cls = 0 AND in_cell > 3 AND r <= 3) AS kept, row_number() OVER (PARTITION BY source, bx, by_ ORDER BY round(complexity + 0.05e0 * abs(depth_m), 9) DESC, point_id) AS rank FROM {n}_e),
    {n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY NOT kept, rank, ((bx * 7919 + by_ * 104729 + 42) % 10007 + 10007) % 10007, bx, by_, point_id) AS line FROM {n}_f) WHERE kept OR line <= retain)"""


def _near(gap: int) -> str:
    return f"EXISTS (SELECT 1 FROM t1 WHERE abs(t1.x - s.x) <= {gap} AND abs(t1.y - s.y) <= {gap} AND sqrt(pow(t1.x - s.x, 2) + pow(t1.y - s.y, 2)) <= {gap})"


def _sample(target: int, floor: int) -> str:
    wanted = max(target, floor)
    return f"""{_COMPLEXITY}, {_thinned("t1", "SELECT * FROM s WHERE tier = 1", wanted)},
    alone AS (SELECT * FROM s WHERE tier = 2 AND NOT {_near(50)} UNION ALL SELECT * FROM s WHERE tier = 3 AND NOT {_near(30)}), {_thinned("t2", "SELECT * FROM alone", wanted)},
    both_ AS (SELECT point_id, source, tier, complexity, weight, sample_weight FROM t1 UNION ALL SELECT point_id, source, tier, complexity, weight, sample_weight FROM t2),
    chosen AS (SELECT * FROM both_ ORDER BY tier, weight * sample_weight * (1 + complexity) DESC, point_id LIMIT {target}),
    more AS (SELECT point_id, source, tier, complexity, weight, sample_weight FROM s WHERE point_id NOT IN (SELECT point_id FROM chosen)
        ORDER BY CASE tier WHEN 1 THEN 3 ELSE tier - 1 END, (point_id * 7919 + 42) % 10007, point_id LIMIT (SELECT greatest(0, {floor} - count(*)) FROM chosen))"""


@query("p1_relative_complexity", "fx_points", doubles="complexity", twin=f"WITH {_COMPLEXITY} SELECT point_id, complexity FROM cplx")
def _(p):
    return sampling.relative_complexity(p)


@query("w10_w11_adaptive_thinning", "fx_points", twin=f"WITH {_COMPLEXITY}, {_thinned('t', 'SELECT * FROM s')} SELECT point_id, source FROM t")
def _(p):
    scored = p.join(sampling.relative_complexity(p), "point_id")
    return sampling.adaptive_thinned(scored).select("point_id", "source")


@query(
    "p1_adaptive_sample", "fx_points", doubles="complexity",
    twin=f"WITH {_sample(2000, 200)} SELECT point_id, source, tier, complexity, 'thinned' AS taken FROM chosen UNION ALL SELECT point_id, source, tier, complexity, 'topped_up' FROM more",
)
def _(p):
    return sampling.adaptive_sample(p).select("point_id", "source", "tier", "complexity", "taken")


@query(
    "w16_topped_up_sample", "fx_points",
    twin=f"WITH {_sample(60, 90)} SELECT point_id, tier, 'thinned' AS taken FROM chosen UNION ALL SELECT point_id, tier, 'topped_up' FROM more",
)
def _(p):
    return sampling.adaptive_sample(p, sampling.Sampling(target=60, floor=90)).select("point_id", "tier", "taken")


@query(
    "p1_sampling_statistics", "fx_points", doubles="weight retention influence",
    twin=f"""WITH {_sample(2000, 200)}, o AS (SELECT * FROM chosen UNION ALL SELECT * FROM more)
    SELECT tier, n_before, coalesce(n_after, 0) AS n_after, coalesce(w, 0) AS weight, coalesce(n_after, 0) / n_before AS retention, coalesce(w, 0) / sum(coalesce(w, 0)) OVER () AS influence
    FROM (SELECT tier, count(*) AS n_before FROM s GROUP BY tier) LEFT JOIN (SELECT tier, count(*) AS n_after, sum(sample_weight * weight) AS w FROM o GROUP BY tier) USING (tier)""",
)
def _(p):
    return sampling.sampling_statistics(p, sampling.adaptive_sample(p))
