"""Folds and lattice reads over batches against plain loops, odd rows included."""
import math

from pyspark.sql import functions as F

from shelfline.functions import folds, lattice as L


def test_folds_follow_their_definition(spark):
    series = {"a": [0.0, 3.0, 0.0, 0.0, 5.0, 1.0], "b": [2.0, 2.0, 7.0], "zero": [0.0] * 4, "one": [4.0], "empty": [], "none": None}
    t = spark.createDataFrame(list(series.items()), "k string, y array<double>")
    y = F.col("y")
    got = {r.k: r for r in t.select("k", folds.croston(y, 0.1).alias("c"), folds.tsb(y, 0.2).alias("t"), folds.difference_std(y).alias("d"),
                                    folds.season_std(y, 2).alias("s"), folds.difference_mean(y).alias("m")).collect()}

    def croston(v):
        z = p = 0.0
        q = 1.0
        for x in v:
            if x:
                z, p, q = (x, q, 1.0) if p == 0 else (0.1 * x + 0.9 * z, 0.1 * q + 0.9 * p, 1.0)
            else:
                q += 1.0
        return z / p if p else 0.0

    for k in ("a", "b", "zero", "one", "empty"):
        assert math.isclose(got[k].c, croston(series[k])), k
    assert math.isclose(got["b"].d, 2.5) and math.isclose(got["b"].m, 2.5) and math.isclose(got["b"].s, 5.0)
    assert [got["zero"].d, got["one"].d, got["none"].d, got["one"].s] == [1.0] * 4
    assert got["none"].c is None and got["none"].t is None and got["one"].m is None and got["zero"].t == 0.0


def test_reads_of_a_distribution(spark):
    rows = [("a", [0.25, 0.25, 0.5], 2.0, 0.5), ("b", [0.5, 0.5], 1.0, 0.99), ("none", None, None, 0.9)]
    t = spark.createDataFrame(rows, "k string, p array<double>, width double, level double")
    got = {r.k: r.at for r in t.select("k", L.at_level(F.col("p"), F.col("width"), F.col("level")).alias("at")).collect()}
    assert tuple(got["a"]) == (2.0, 0.5, 1.0, 0.5) and tuple(got["b"]) == (1.0, 0.0, 0.0, 0.5) and got["none"] is None
