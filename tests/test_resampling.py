"""Exact quantiles of small groups, resampling by weight matrices, exact signed ranks: against numpy and full enumeration."""

import itertools
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gable.operators import stats as S
from gable.operators.metrics import metrics_by
from gable.operators.order import quantiles
from gable.operators.resample import bootstrap_weights, draws, pooled_metrics, poisson_edges, round_metrics, row_key

POINTS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def test_quantiles_of_groups_of_any_size(spark):
    rng = np.random.default_rng(1)
    sizes = [*range(1, 41), 50, 99, 160, 300, 301]
    rows = [(str(n), float(round(v, 1 if n % 2 else 6))) for n in sizes for v in rng.normal(size=n)] + [(None, 1.0), (None, 4.0), ("none", None)]
    got = {r["k"]: (r["n"], r["q"]) for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), {"v": F.col("v")}, POINTS, ["k"]).collect()}
    assert set(got) == {*map(str, sizes), None} and got[None] == (2, [1.0 + 3 * p for p in POINTS])
    for n in sizes:
        assert got[str(n)][0] == n and np.allclose(got[str(n)][1], np.quantile([v for k, v in rows if k == str(n)], POINTS), atol=1e-12)


@pytest.mark.parametrize("n", [19_990, 20_010, 60_000])
def test_quantiles_around_the_change_of_way(spark, n):
    df = spark.range(n).select((F.xxhash64("id") % 1000).cast("double").alias("few"), (F.xxhash64("id") / 7.0).alias("many"))
    rows = df.toPandas()
    for r in quantiles(df, {"few": F.col("few"), "many": F.col("many")}, POINTS).collect():
        assert np.allclose(r["q"], np.quantile(rows[r["name"]], POINTS), rtol=1e-12)


def one(y, p):
    return [1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), np.sqrt(((y - p) ** 2).mean()), 100 * np.mean(2 * abs(y - p) / (abs(y) + abs(p))), 100 * np.median((abs(y - p) / abs(y))[y != 0])]


@pytest.fixture(scope="module")
def priced(spark):
    rng = np.random.default_rng(5)
    n = 3000
    y = np.where(np.arange(n) % 97 == 5, 0.0, rng.lognormal(3, 1, n))
    p = np.where(np.arange(n) % 3 == 0, 1.5 * y + (y == 0), y * rng.lognormal(0, 0.4, n) + (y == 0))  # a third has one relative error
    rows = [(i, ("a", "b", None)[i % 7 % 3], float(y[i]), float(p[i])) for i in range(n)] + [(n, "a", None, 1.0), (n + 1, "a", 1.0, None), (n + 2, "a", float("nan"), 1.0)]
    return spark.createDataFrame(rows, "id long, k string, y double, p double").repartition(5).cache()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rounds_equal_rows_taken_as_often_as_drawn(priced, keys):
    rounds = 30
    got = {(*[r[k] for k in keys], r["round"]): r for r in round_metrics(priced, rounds, keys, "y", "p").collect()}
    rows = priced.where("y is not null and p is not null and not isnan(y)").withColumn("key", row_key(42, F.col("id"))).toPandas()
    w = bootstrap_weights(rounds)(rows["key"].to_numpy().astype(np.uint32))
    groups = [("a",), ("b",), (None,)] if keys else [()]
    assert len(got) == rounds * len(groups)
    for g in groups:
        mine = np.ones(len(rows), bool) if not g else rows["k"].isna().to_numpy() if g[0] is None else (rows["k"] == g[0]).to_numpy()
        for r in range(rounds):
            y, p = (np.repeat(rows[c].to_numpy()[mine], w[mine, r]) for c in ("y", "p"))
            assert np.allclose(one(y, p), [got[(*g, r)][m] for m in S.METRICS], rtol=1e-9)


def test_draws_are_uniform_and_weights_poisson():
    u = draws(np.arange(50_000, dtype=np.uint32) * np.uint32(7919), np.arange(40)).astype(float) / 2**32
    assert abs(u.mean() - 0.5) < 1e-3 and abs(np.histogram(u, 16, (0, 1))[0] / u.size * 16 - 1).max() < 0.01 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.02
    w = bootstrap_weights(40)(np.arange(50_000, dtype=np.uint32))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005 and len(poisson_edges()) >= 8


def test_intervals_follow_theory(spark):
    df = spark.range(4000).select("id", F.lit(0.0).alias("z"), F.expr("100 + (xxhash64(id) % 1000) / 100").alias("y")).withColumn("p", F.col("y") + F.expr("(xxhash64(id, 1) % 1000) / 500"))
    r = {x["metric"]: x for x in S.bootstrap_ci(df, [], "y", "p", 1000).collect()}
    e = np.array([x[0] for x in df.select(((F.col("p") - F.col("y")) ** 2).alias("e")).collect()])
    assert r["rmse"]["n"] == 1000 and abs(r["rmse"]["std"] / (e.std() / np.sqrt(len(e)) / 2 / np.sqrt(e.mean())) - 1) < 0.1
    assert r["rmse"]["lower"] < np.sqrt(e.mean()) < r["rmse"]["upper"]


def test_halves_are_exact_and_the_rest(priced):
    rounds = 12
    df = priced.withColumn("o", F.col("p") * 1.1)
    got = {(r["round"], r["half"]): [r[m] for m in S.METRICS] for r in pooled_metrics(df, "y", "p", "o", rounds).collect()}
    rows = df.where("y is not null and p is not null and not isnan(y)").select("id", "y", "p", "o", *[row_key(42, F.col("id"), F.lit(str(i))).alias(f"k{i}") for i in (0, 1)]).toPandas()
    y, p, k = np.tile(rows["y"], 2), np.concatenate([rows["p"], rows["o"]]), np.concatenate([rows["k0"], rows["k1"]]).astype(np.uint32)
    u = draws(k, np.arange(rounds)).astype(np.uint64) << np.uint64(32) | k.astype(np.uint64)[:, None]
    for r in range(rounds):
        first = np.argsort(u[:, r])[: len(y) // 2]
        half = np.zeros(len(y), bool)
        half[first] = True
        for h, mine in ((0, half), (1, ~half)):
            assert np.allclose(one(y[mine], p[mine]), got[r, h], rtol=1e-9)


def test_permutation_tells_apart_only_what_differs(priced):
    df = priced.withColumns({"same": F.col("y") * F.when(F.xxhash64("id") % 2 == 0, 1.3).otherwise(0.7), "like": F.col("y") * F.when(F.xxhash64("id", F.lit(1)) % 2 == 0, 1.3).otherwise(0.7), "bad": F.col("y") * 3})
    p = {r["metric"]: r["p"] for r in S.permutation_test(df, "y", "same", "bad", 100).collect()}
    q = {r["metric"]: r["p"] for r in S.permutation_test(df, "y", "same", "like", 100).collect()}
    assert p["smape"] == p["medape"] == 0.0 and q["smape"] > 0.02 and q["rmse"] > 0.02


@pytest.mark.parametrize("values", [[1.0, 2, 3, 4, 5], [1.0, -2, 3, -4, 5], [1.0, 1, -1, 2, 2, -3], [0.0, 1, -1, 1, -1], [float(i) * (-1) ** (i // 3) for i in range(1, 15)]])
def test_signed_ranks_of_few_pairs_are_exact(spark, values):
    got = S.wilcoxon(spark.createDataFrame([(v, 0.0) for v in values], "a double, b double"), "a", "b").collect()[0]
    d = [v for v in values if v]
    ranks = [np.mean([i + 1 for i, x in enumerate(sorted(map(abs, d))) if x == abs(v)]) for v in d]
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    w = min(sum(r for r, v in zip(ranks, d) if v > 0), sum(r for r, v in zip(ranks, d) if v < 0))
    assert got["n"] == len(d) and got["w"] == w and abs(got["p"] - min(1, 2 * np.mean([s <= w for s in sums]))) < 1e-12


def test_signed_ranks_by_table_and_beyond(spark):
    # Largest sums with p of both sides up to 0.05, by number of pairs
    table = {6: 0, 7: 2, 8: 3, 9: 5, 10: 8, 15: 25, 20: 52, 25: 89}
    from gable.functions.tails import signed_rank_tail

    for n, w in table.items():
        assert signed_rank_tail(list(range(1, n + 1)), w) <= 0.05 < signed_rank_tail(list(range(1, n + 1)), w + 1)
    rows = spark.range(200).selectExpr("'x' as g", "id % 5 * 1.0 as a", "id % 7 * 1.0 as b").unionByName(spark.createDataFrame([("y", 3.0, 1.0), ("y", 1.0, 5.0)], "g string, a double, b double"))
    got = {r["g"]: r for r in S.wilcoxon(rows, "a", "b", ["g"]).collect()}
    assert got["y"]["n"] == 2 and got["y"]["p"] == 1.0 and 0 < got["x"]["p"] < 1 and got["x"]["n"] > 100


def test_metrics_by_key(priced):
    got = metrics_by(priced.where("y is not null and p is not null and not isnan(y)"), ["k"], "y", "p").collect()
    assert {r["k"] for r in got} == {"a", "b", None} and all(r["medape"] > 0 for r in got)


def test_medians_do_not_depend_on_the_order_in_which_rows_are_read(spark):
    n, rounds = 300_000, 40

    def stirred(frames):  # another order each time the rows are read
        yield pd.concat(list(frames)).sample(frac=1.0, random_state=int.from_bytes(os.urandom(4), "big"))

    rows = spark.range(0, n, 1, 3).selectExpr("id", "'a' as k", "100.0D as y", "100.0D + (xxhash64(id) % 1000000007) / 1e8 as p")
    df = rows.mapInPandas(stirred, rows.schema)
    want = rows.withColumn("key", row_key(42, F.col("id"))).toPandas()
    w = bootstrap_weights(rounds)(want["key"].to_numpy().astype(np.uint32))
    v = (abs(want["y"] - want["p"]) / want["y"]).to_numpy()
    got = {r["round"]: r["medape"] for r in round_metrics(df, rounds, ["k"], "y", "p").collect()}
    for r in range(rounds):
        assert got[r] == pytest.approx(100 * np.median(np.repeat(v, w[:, r])), rel=1e-12)


def test_drift_counts_only_rounds_in_which_both_months_have_the_metric(spark):
    # one row has no r2 in any round, and of two the r2 is missing where one of them is not drawn
    rows = [(i, m, float(10 + 7 * i % 11), float(9 + 5 * i % 13)) for i, m in enumerate("aa" + "b" + "ccc")]
    df = spark.createDataFrame(rows, "id long, month string, y double, p double")
    got = {(r["month"], r["metric"]): r for r in S.month_drift(df, "month", "y", "p", 200).collect()}
    assert ("b", "r2") not in got and ("b", "rmse") in got and ("c", "r2") in got
    by = {(r["month"], r["round"]): r["r2"] for r in round_metrics(df, 200, ["month"], "y", "p").collect()}
    both = [(by["c", r], by["a", r]) for r in range(200) if by["c", r] is not None and by["a", r] is not None]
    assert 0 < len(both) < sum(by["c", r] is not None for r in range(200))
    assert got["c", "r2"]["mean"] == pytest.approx(np.mean([a for a, _ in both])) and got["c", "r2"]["p"] == pytest.approx(np.mean([a - b >= 0 for a, b in both]))
