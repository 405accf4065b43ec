"""River depths from raw sections: priors by hand, slopes of the fitted surface, odd sections."""

import math

import pytest

from shoalspark.operators import rivers

SECTION = "xs_id long, river_id int, s_center_m double, width_m double, drain_area_km2 double, slope_mpm double, discharge_m3s double, mouth_km double"


def _priors(spark, rows, **kw):
    x = spark.createDataFrame([(i, 1, 0.0, *r) for i, r in enumerate(rows)], SECTION)
    return [r.asDict() for r in rivers.depth_priors(x, **kw).orderBy("xs_id").collect()]


def test_friction_counts_by_its_guards(spark):
    rows = [(100.0, 50.0, 2e-3, 80.0, 50.0), (100.0, 50.0, 5e-5, 80.0, 50.0), (100.0, 50.0, 2e-3, 80.0, 5.0), (100.0, 50.0, 2e-3, None, None), (100.0, 50.0, 2e-3, 80.0, None)]
    got = _priors(spark, rows, discharge="field")
    y = (0.035 * 80 / (100 * math.sqrt(2e-3))) ** 0.6 * 2 / 1.3
    w = 0.36 * 0.7
    assert [round(r["friction_weight"], 9) for r in got] == [w, 0, 0, 0, w]
    assert all(math.isclose(got[i]["prior_m"], (1 - w) * 1.8 + w * y) for i in (0, 4)) and all(math.isclose(got[i]["prior_m"], 1.8) for i in (1, 2, 3))
    with pytest.raises(ValueError, match="no such discharge"):
        _priors(spark, rows, discharge="guess")


def test_curves_leave_small_and_unknown_areas(spark):
    got = _priors(spark, [(100.0, 100.0, None, None, None), (100.0, 0.5, None, None, None), (100.0, None, None, None, None)], curve=(0.3, 0.4, 50.0))
    want = 0.7 * 1.8 + 0.3 * 0.3 * 100**0.4 * 2 / 1.3
    assert math.isclose(got[0]["prior_m"], want) and [r["prior_m"] for r in got[1:]] == pytest.approx([1.8, 1.8])
    assert _priors(spark, [(100.0, 100.0, None, None, None)], curve="nowhere")[0]["curve_weight"] == pytest.approx(0.36)


def test_slopes_of_the_surface_where_no_reach_has_one(spark):
    x = spark.createDataFrame([(i, 1, i * 100.0, 50.0 - i * 0.1) for i in range(60)] + [(99, 2, 0.0, 9.0)], "xs_id long, river_id int, s_center_m double, wse_m double")
    slope = {r["xs_id"]: r["slope_mpm"] for r in rivers.with_reach_attributes(x, None).collect()}
    assert len(slope) == 61 and all(math.isclose(slope[i], 1e-3, rel_tol=1e-6) for i in range(10, 50)) and slope[99] is None
    reaches = spark.createDataFrame([(1, 2e-3)], "river_id int, slope_mpm double")
    given = {r["xs_id"]: r["slope_mpm"] for r in rivers.with_reach_attributes(x, reaches).collect()}
    assert given[5] == 2e-3 and given[99] is None


def test_sections_without_banks_or_levels(spark):
    rows = [(1, d, None if d == 5 else 10.0 + abs(d - 10) / 10, None, d == 4, d == 16) for d in range(21)]
    rows += [(2, float(d), 5.0, None, False, d == 3) for d in range(5)]  # no left bank
    rows += [(3, float(d), None, None, d == 0, d == 4) for d in range(5)]  # nothing known of heights
    samples = spark.createDataFrame([(a, float(d), *r) for a, d, *r in rows], "xs_id long, dist_m double, z double, z_second double, is_left boolean, is_right boolean")
    lines = spark.createDataFrame([(i, 1, i * 10.0, None) for i in (1, 2, 3)], "xs_id long, river_id int, s_center_m double, site_no int")
    none = spark.createDataFrame([], "site_no int, width_ft double, stage_ft double, discharge_cfs double, area_sqft double")
    sections, points = rivers.inferred_rivers(samples, lines, none)
    got = {r["xs_id"]: r for r in sections.collect()}
    assert sorted(got) == [1, 3] and got[3]["wse_m"] is None and got[3]["bed_m"] is None and got[1]["depth_source"] == "prior" and got[1]["sigma_m"] == 1.5
    beds = {(r["xs_id"], r["dist_m"]): r for r in points.collect()}
    assert len(beds) == 13 + 5 and beds[1, 4.0]["depth_m"] == 0 and math.isclose(beds[1, 10.0]["depth_m"], got[1]["depth_m"])
    assert all(r["bed_m"] is None for k, r in beds.items() if k[0] == 3) and all(r["bed_m"] <= got[1]["bank_min_m"] - 0.05 for k, r in beds.items() if k[0] == 1)
    empty = rivers.inferred_rivers(samples.limit(0), lines, none)
    assert empty[0].count() == empty[1].count() == 0
