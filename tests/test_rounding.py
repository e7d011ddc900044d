"""Rounding by the exact value of a double, against Python's."""

import math
import random

from pyspark.sql import functions as F

from newsloom.functions.scores import rounded


def test_grid_and_random_values(spark):
    r = random.Random(7)
    xs = [i / 2000 for i in range(-10000, 10001)] + [i / 8 for i in range(-80, 80)]
    xs += [r.random() * 10 ** r.randint(-6, 6) for _ in range(3000)] + [2.675, 1.005, 0.5, 1.5, 2.5, 1e300, 5e-324]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 1, 2, 3, 4, 6):
        got = [row[0] for row in df.select(rounded(F.col("x"), n)).collect()]
        assert got == [round(x, n) for x in xs]
    half_up = [row[0] for row in df.select(F.round("x", 3)).collect()]
    assert sum(a != round(x, 3) for a, x in zip(half_up, xs, strict=True)) > 4000  # what this is for


def test_null_nan_and_infinities(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,), (-0.0,)], "x double")
    got = [row[0] for row in df.select(rounded(F.col("x"), 3)).collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [math.inf, -math.inf, 0.0]


def test_stays_in_generated_code(spark):
    plan = spark.range(10).select(rounded(F.col("id") / 7, 3).alias("y"))._jdf.queryExecution().executedPlan().toString()
    assert "*(1)" in plan and "Python" not in plan
