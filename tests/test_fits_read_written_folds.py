"""Cross-validation and searches read folds that are written once: not the joins that made them, round after round, in as many parts as a shuffle has."""

import pytest
from pyspark.sql import functions as F

from shoalspark.operators import selection


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joined(spark):
    left = spark.range(600).select(F.col("id").alias("point_id"), (F.col("id") * 37 % 100 * 10.0).alias("x"), (F.col("id") * 53 % 90 * 10.0).alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    right = spark.range(600).select(F.col("id").alias("point_id"), (F.col("id") * 7 % 89 * 1.0).alias("b"), (F.col("id") * 11 % 200 * 0.1).alias("z"))
    return left.join(right.hint("merge"), "point_id")


@pytest.fixture
def fitted(monkeypatch):
    seen, fit = [], selection.out_of_fold
    monkeypatch.setattr(selection, "out_of_fold", lambda folded, *a, **k: seen.append(plan(folded)) or fit(folded, *a, **k))
    return seen


def test_strategies_are_fitted_on_written_folds(joined, fitted):
    made = selection.block_strategies(joined.drop("fold"), 2)
    assert len(made) == 3 and not any("Join" in plan(d) for d in made.values())
    out = selection.compared_strategies(["b"], "z", {"given": joined}, trees=2, depth=2)
    assert [r["folds"] for r in out.collect()] == [2]
    assert len(fitted) == 1 and "Join" not in fitted[0]


def test_draws_are_fitted_on_written_folds(joined, fitted):
    out = selection.random_search(joined, ["b"], "z", draws=2, ranges={"numTrees": (2, 3), "maxDepth": (2, 3)})
    assert [r["n"] for r in out.collect()] == [600, 600]
    assert len(fitted) == 2 and not any("Join" in p for p in fitted)
