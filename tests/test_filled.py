"""``ordered.filled`` looks ahead by the falling order, so no row reads the rest of its run again."""

import numpy as np
from pyspark.sql import functions as F

from shoalspark.operators import ordered


def test_next_and_last_known_without_frames_up_to_the_end(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", F.when(F.pmod(F.xxhash64("id"), F.lit(23)) == 0, F.col("id")).alias("v"))
    got = ordered.filled(ordered.placed(df, ["g"], ["id"], run=50), F.when(F.col("v").isNotNull(), F.struct("v")))
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    rows = got.select("g", "id", "v", F.col("_before.v").alias("b"), F.col("_after.v").alias("a")).toPandas()
    assert len(rows) == 3000
    for _, one in rows.sort_values("id").groupby("g"):
        assert np.array_equal(one["b"], one["v"].ffill(), equal_nan=True) and np.array_equal(one["a"], one["v"].bfill(), equal_nan=True)
