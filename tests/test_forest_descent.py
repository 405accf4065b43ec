"""Masked rows don't go down a forest's trees, and the descent leaves rows at their leaves."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shoalspark.operators import modelling


def test_descent_keeps_rows_at_leaves():
    stump = (np.array([-1], np.int32), np.zeros(1), np.array([-1], np.int32), np.array([-1], np.int32), np.array([5.0]))
    tree = (np.array([1, -1, 0, -1, -1], np.int32), np.array([0.5, 0, 2.0, 0, 0]), np.array([1, -1, 3, -1, -1], np.int32), np.array([2, -1, 4, -1, -1], np.int32), np.array([0, 1.0, 0, 2.0, 3.0]))
    x = np.array([[9.0, 0.5], [2.0, 0.6], [2.1, 0.6]])
    assert modelling.tree_values([stump, tree], x).tolist() == [[5.0] * 3, [1.0, 2.0, 3.0]]
    assert modelling.tree_values([tree], x[:0]).shape == (1, 0)


def test_masked_rows_do_not_go_down_the_trees(spark, monkeypatch):
    seen, made = [], F.pandas_udf
    rows = spark.range(400).select((F.col("id") % 31 * 1.0).alias("b"), (F.col("id") % 7 * 1.0).alias("z"))
    _, model = modelling.fit_depth_model(rows, ["b"], "z", trees=2, depth=2)
    monkeypatch.setattr(modelling.F, "pandas_udf", lambda kind: lambda fn: seen.append(fn) or made(kind)(fn))
    modelling.tree_spread(model, rows, ["b"])
    monkeypatch.setattr(modelling, "tree_values", lambda trees, x: np.full((len(trees), len(x)), float(len(x))))
    got = seen[0](pd.Series([1.0, None, 2.0, float("nan")]))
    assert got["mean"].tolist()[::2] == [2.0, 2.0] and got["mean"].isna().tolist() == [False, True, False, True]
