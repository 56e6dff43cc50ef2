"""Operators that must hold at any size: against plain Python on odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gable.functions import tails
from gable.operators import geo as G
from gable.operators import stats as S
from gable.operators.order import quantile_row, quantiles, top_of


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3], float(v), None if i % 5 == 0 else float(w)) for i, (v, w) in enumerate(zip(rng.normal(size=5000), rng.integers(0, 7, 5000)))] + [(9000, None, 5.0, None)]
    df = spark.createDataFrame(rows, "id long, k string, v double, w double")
    points = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    for r in quantiles(df, {"v": F.col("v"), "w": F.col("w")}, points, ["k"]).collect():
        own = [x[2 if r.name == "v" else 3] for x in rows if x[1] == r.k]
        own = [x for x in own if x is not None]
        assert r.n == len(own) and r.q == pytest.approx(np.quantile(own, points), abs=1e-12)
    one = quantile_row(df, {"v": F.col("v"), "none": F.lit(None)}, [0.5]).first()
    assert one.v[0] == pytest.approx(np.median([x[2] for x in rows])) and one.none is None
    assert quantiles(df.limit(0), {"v": F.col("v")}, points).count() == 0
    assert quantile_row(spark.range(1), {"id": F.col("id")}, [0.1, 0.9]).first().id == [0.0, 0.0]


def test_top_of(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 700).alias("n"))
    got = top_of(df, ["g"], [F.desc("n"), F.asc("v")], 5, "v").collect()
    rows = df.collect()
    for g in range(3):
        want = sorted((-r.n, r.v) for r in rows if r.g == g)[:5]
        assert sorted((r.place, -r.n, r.v) for r in got if r.g == g) == [(i + 1, *w) for i, w in enumerate(want)]


def test_nearest_city_of_odd_points(spark):
    cities = spark.createDataFrame([("a", 55.0, 37.0), ("b", 55.4, 37.0), ("far", -40.0, 170.0)], "name string, latitude double, longitude double")
    points = [(1, 55.1, 37.0), (1, 55.39, 37.01), (2, None, 37.0), (3, float("nan"), 37.0), (4, 10.0, 20.0), (5, -41.0, -179.0), (6, 55.21, 37.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = sorted((r.id, r.city_name) for r in G.nearest_city(df, cities).collect() if r.city_name)
    by_degrees = lambda p: min(((p[1] - r.latitude) ** 2 + (p[2] - r.longitude) ** 2, r.name) for r in cities.collect())[1]
    assert got == sorted((p[0], by_degrees(p)) for p in points if p[1] is not None and p[1] == p[1])
    assert G.nearest_city(df, cities).count() == len(points) == G.nearest_city(df, cities.limit(0)).count()


def test_tails():
    assert tails.chi2_tail(7.814727903, 3) == pytest.approx(0.05, abs=1e-6) and tails.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_tail(1.959963985) == pytest.approx(0.05, abs=1e-8) and tails.f_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-6)


def test_tails_as_columns(spark):
    df = spark.createDataFrame([(2.228138852, 10), (None, 10), (0.0, 5)], "t double, df int")
    got = [r.p for r in S.with_tail(df, "p", tails.t_tail, F.col("t"), F.col("df")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] is None and got[2] == 1.0


def test_best_within_the_critical_difference(spark):
    rows = [("x", "a", 1.0, 5.0), ("x", "b", 1.4, 3.0), ("x", "c", 3.0, 1.0), ("y", "a", 1.0, 2.0), ("y", "b", 2.5, 1.0)]
    df = spark.createDataFrame(rows, "g string, m string, rank double, score double")
    got = {r.g: (r.best, r.tied, r.reason) for r in S.best_within(df, ["g"], "m", "score", 0.5).collect()}
    assert got == {"x": ("b", 2, "score"), "y": ("a", 1, "rank")}
