"""Comparison of models and samples: distributed reductions to one row a statistic; resampling in one pass."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gable.functions.tails import anderson_deviation, chi2_tail, f_tail, kolmogorov_tail, normal_tail, signed_rank_tail, t_tail
from gable.operators.metrics import metrics_by
from gable.operators.order import running
from gable.operators.resample import METRICS, complete, pooled_metrics, round_metrics


def with_tail(df: DataFrame, name: str, tail: Callable[..., float], *values: Column) -> DataFrame:
    """df, a few rows of reduced statistics, with a column of tail probabilities; null where a value is."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def p(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None or x != x for x in row) else tail(*row) for row in zip(*columns)], dtype="float64")

    return df.withColumn(name, p(*[v.cast("double") for v in values]))


def avg_ranks(df: DataFrame, block: list[str], method: str, value: str, higher_better: bool = False) -> DataFrame:
    """df with `rank` of each method within its block, 1 the best, ties averaged. A block is one fold: as many rows as methods."""
    w = W.partitionBy(*block).orderBy(F.desc(value) if higher_better else F.asc(value))
    tie = W.partitionBy(*block, value)
    return df.withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0)


def friedman(ranked: DataFrame, block: list[str], method: str, q: float = 2.569) -> DataFrame:
    """One row: k, n, chi2 (corrected for ties), its p value and the Nemenyi critical difference."""
    means = ranked.groupBy(method).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    tie = ranked.groupBy(*block, "rank").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    k, n = F.col("k"), F.col("n")
    s = means.agg(F.count(F.lit(1)).cast("double").alias("k"), F.max("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r")).alias("s")).join(F.broadcast(tie))
    c = 1 - F.col("ties") / (n * (F.pow(k, F.lit(3.0)) - k))
    chi = (12 / (n * k * (k + 1)) * F.col("s") - 3 * n * (k + 1)) / F.nullif(c, F.lit(0.0))
    out = s.select(k.cast("long").alias("k"), n.cast("long").alias("n"), chi.alias("chi2"), (F.lit(q) * F.sqrt(k * (k + 1) / (6 * n))).alias("cd"))
    return with_tail(out, "p", chi2_tail, F.col("chi2"), F.col("k") - 1)


def best_two(df: DataFrame, group: list[str], method: str, score: str, higher_better: bool = False) -> DataFrame:
    """(group, best, second, best_score, second_score) by mean score, ties by name."""
    m = df.groupBy(*group, method).agg(F.avg(score).alias("s"))
    r = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("s") if higher_better else F.asc("s"), method))
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return m.withColumn("k", r).where("k <= 2").groupBy(*group).agg(at(1, method).alias("best"), at(2, method).alias("second"), at(1, "s").alias("best_score"), at(2, "s").alias("second_score"))


def best_within(ranked: DataFrame, group: list[str], method: str, score: str, cd: float, higher_better: bool = False) -> DataFrame:
    """(group, best, rank, tied, reason): of the methods whose mean rank lies within the critical difference of the least, the one with the best mean score.

    tied counts those methods; reason is `rank` if there is one, else `score`. Ties go by name.
    """
    m = ranked.groupBy(*group, method).agg(F.avg("rank").alias("r"), F.avg(score).alias("s"))
    least = m.groupBy(*group).agg(F.min("r").alias("_least"))
    near = (m.join(least, group) if group else m.join(F.broadcast(least))).where(F.col("r") <= F.col("_least") + F.lit(cd))
    best = F.min(F.struct((-F.col("s") if higher_better else F.col("s")).alias("s"), F.col(method).alias("m"), "r"))
    out = near.groupBy(*group).agg(best.alias("b"), F.count(F.lit(1)).alias("tied"))
    return out.select(*group, F.col("b.m").alias("best"), F.col("b.r").alias("rank"), "tied", F.when(F.col("tied") == 1, "rank").otherwise("score").alias("reason"))


def paired_t(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """(group, n, mean, t, p) of the differences a - b, p of both sides; null without spread."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*group).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), (F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0))).alias("t"))
    return with_tail(out, "p", t_tail, F.col("t"), F.col("n") - 1)


def wilcoxon(df: DataFrame, a: str, b: str, group: list[str] | None = None, exact: int = 50) -> DataFrame:
    """(group, n, w, z, p): w is the smaller sum of signed ranks, p of both sides, exact up to `exact` differences (ties included), normal beyond.

    Differences of 0 are left out. Equal differences are counted first, so ranks need no sort of all rows in one task.
    """
    group = group or []
    d = df.select(*group, (F.col(a) - F.col(b)).alias("d")).where("d <> 0 and d is not null")
    sizes = d.groupBy(*group, F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("p"))
    r = running(sizes, "m", ["c"], group).withColumn("rank", F.col("cum_c") - (F.col("c") - 1) / 2.0)
    few = F.collect_list(F.when(F.col("cum_c") <= exact, F.array_repeat("rank", F.col("c").cast("int"))))
    s = r.groupBy(*group).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("p")).alias("up"), F.sum(F.col("rank") * (F.col("c") - F.col("p"))).alias("down"), F.sum(F.pow(F.col("c").cast("double"), F.lit(3.0)) - F.col("c")).alias("ties"), F.flatten(few).alias("_ranks"))
    n = F.col("n").cast("double")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    out = s.select(*group, "n", F.least("up", "down").alias("w"), ((F.least("up", "down") - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))).alias("z"), "_ranks")

    @F.pandas_udf("double")
    def p(n: pd.Series, w: pd.Series, z: pd.Series, ranks: pd.Series) -> pd.Series:
        one = lambda n, w, z, r: signed_rank_tail(list(r), w) if n <= exact else normal_tail(z)
        return pd.Series([None if not n else one(n, w, z, r) for n, w, z, r in zip(n, w, z, ranks)], dtype="float64")

    return out.withColumn("p", p("n", "w", "z", "_ranks")).drop("_ranks")


def ks_2samp(df: DataFrame, value: str, sample: Column) -> DataFrame:
    """One row: n, m, the largest distance d between the two samples' distribution functions and its asymptotic p value. sample is true for the first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(sample).alias("a"), F.count_if(~sample).alias("b"))
    total = counts.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    cum = running(counts, "v", ["a", "b"]).join(F.broadcast(total))
    out = cum.groupBy("n", "m").agg(F.max(F.abs(F.col("cum_a") / F.col("n") - F.col("cum_b") / F.col("m"))).alias("d"))
    return with_tail(out, "p", kolmogorov_tail, F.col("d"), F.col("n"), F.col("m"))


def normality(df: DataFrame, value: str) -> DataFrame:
    """One row: n, skewness, kurtosis, D'Agostino's K2 and its p value, from moments of one aggregation."""
    x = F.col(value)
    m = df.agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    n, g1, g2 = F.col("n"), F.col("skew"), F.col("kurt")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(F.sqrt(w2)))
    mean = 3 * (n - 1) / (n + 1) - 3
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    u = (g2 - mean) / F.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    z2 = ((1 - 2 / (9 * a)) - F.cbrt((1 - 2 / a) / (1 + u * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return m.select(n.cast("long").alias("n"), g1.alias("skew"), g2.alias("kurt"), (z1 * z1 + z2 * z2).alias("k2")).withColumn("p", F.exp(-F.col("k2") / 2))


def bootstrap_ci(df: DataFrame, keys: list[str], y: str, p: str, rounds: int = 1000, ident: str = "id", seed: int = 42) -> DataFrame:
    """(keys, metric, mean, lower, upper, std, n): 95 % intervals over rounds."""
    m = round_metrics(df, rounds, keys, y, p, ident, seed).unpivot([*keys, "round"], METRICS, "metric", "value")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return m.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), q[0].alias("lower"), q[1].alias("upper"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def bootstrap_diff(df: DataFrame, y: str, first: str, second: str, rounds: int = 1000, ident: str = "id", seed: int = 42) -> DataFrame:
    """(metric, diff, lower, upper, p): first minus second under the same weights; p is the share of rounds in which the first is not better (lower is better but for r2)."""
    a, b = (round_metrics(df, rounds, [], y, c, ident, seed).unpivot(["round"], METRICS, "metric", "value") for c in (first, second))
    d = a.join(b.withColumnRenamed("value", "other"), ["round", "metric"]).withColumn("d", F.col("value") - F.col("other"))
    worse = F.when(F.col("metric") == "r2", F.col("d") <= 0).otherwise(F.col("d") >= 0)
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return d.groupBy("metric").agg(F.avg("d").alias("diff"), q[0].alias("lower"), q[1].alias("upper"), F.avg(worse.cast("double")).alias("p"))


def permutation_test(df: DataFrame, y: str, first: str, second: str, rounds: int = 1000, ident: str = "id", seed: int = 42) -> DataFrame:
    """(metric, diff, p): the second model's metric less the first's, and the share of rounds in which halves of the pooled predictions differ as much."""
    m = pooled_metrics(df, y, first, second, rounds, ident, seed).unpivot(["round", "half"], METRICS, "metric", "value")
    each = m.groupBy("round", "metric").agg(F.max(F.when(F.col("half") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("half") == 0, F.col("value"))).alias("b"))
    rows = complete(df, y, first, second)
    seen = [metrics_by(rows, [], y, c).select(*[F.col(m).alias(f"{m}_{i}") for m in METRICS]) for i, c in enumerate((first, second))]
    diff = seen[0].join(F.broadcast(seen[1])).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_1") - F.col(f"{m}_0")).alias("diff")) for m in METRICS])).alias("x")).select("x.*")
    large = F.abs(F.col("a") - F.col("b")) >= F.abs(F.col("diff"))
    return each.join(F.broadcast(diff), "metric").groupBy("metric").agg(F.max("diff").alias("diff"), F.avg(large.cast("double")).alias("p"))


def month_drift(df: DataFrame, month: str, y: str, p: str, rounds: int = 1000, ident: str = "id", seed: int = 42) -> DataFrame:
    """(month, metric, mean, diff, p) against the first month: rounds of both months are drawn independently and joined by number."""
    m = round_metrics(df, rounds, [month], y, p, ident, seed).unpivot([month, "round"], METRICS, "metric", "value")
    first = df.agg(F.min(month).alias("_first"))
    base = m.join(F.broadcast(first), F.col(month) == F.col("_first")).select("round", "metric", F.col("value").alias("base"))
    d = m.join(base, ["round", "metric"]).withColumn("d", F.col("value") - F.col("base")).where("d is not null")  # rounds in which both months have the metric
    worse = F.when(F.col("metric") == "r2", F.col("d") >= 0).otherwise(F.col("d") <= 0)
    return d.groupBy(month, "metric").agg(F.avg("value").alias("mean"), F.avg("d").alias("diff"), F.avg(worse.cast("double")).alias("p"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, f, p, place): univariate F of each feature and its p value, the largest F first, from correlations of one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.corr(c, target).alias(c) for c in features])
    r2 = F.col("r") * F.col("r")
    out = one.unpivot(["n"], features, "feature", "r").select("feature", (r2 / (1 - r2) * (F.col("n") - 2)).alias("f"), (F.col("n") - 2).alias("_df"))
    out = with_tail(out, "p", f_tail, F.col("f"), F.lit(1), F.col("_df")).drop("_df")
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("f"), "feature")))  # as many rows as features


def importance_table(df: DataFrame, group: str = "model") -> DataFrame:
    """(model, feature, importance, place, scaled): mean absolute value per feature, its rank and its min-max value in the model. Input: (model, feature, value)."""
    m = df.groupBy(group, "feature").agg(F.avg(F.abs("value")).alias("importance"))
    w = W.partitionBy(group)  # as many rows as features
    low, high = F.min("importance").over(w), F.max("importance").over(w)
    return m.withColumn("place", F.row_number().over(w.orderBy(F.desc("importance"), "feature"))).withColumn("scaled", (F.col("importance") - low) / F.nullif(high - low, F.lit(0.0)))


def importance_ends(table: DataFrame, n: int, group: str = "model") -> DataFrame:
    """(model, end, place, feature, importance): the n most and least important features of each model, from importance_table()."""
    sizes = table.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ends = table.join(F.broadcast(sizes), group).withColumn("end", F.when(F.col("place") <= n, "top").when(F.col("place") > F.col("_n") - n, "bottom"))
    return ends.where("end is not null").select(group, "end", "place", "feature", "importance")


def importance_compared(table: DataFrame, models: list[str], group: str = "model") -> DataFrame:
    """One row per feature: its scaled importance in each model, and the mean over models."""
    wide = table.groupBy("feature").pivot(group, models).agg(F.min("scaled"))
    return wide.withColumn("mean", sum((F.coalesce(F.col(m), F.lit(0.0)) for m in models), F.lit(0.0)) / len(models))


def importance_share(df: DataFrame, prefix: str, group: str = "model") -> DataFrame:
    """(model, count, sum, share, max, mean) of the features with a name prefix."""
    m = df.groupBy(group, "feature").agg(F.avg(F.abs("value")).alias("v"))
    own = F.when(F.col("feature").startswith(prefix), F.col("v"))
    return m.groupBy(group).agg(F.count(own).alias("count"), F.sum(own).alias("sum"), (F.sum(own) / F.nullif(F.sum("v"), F.lit(0.0))).alias("share"), F.max(own).alias("max"), F.avg(own).alias("mean"))


def anderson_k(df: DataFrame, value: str, sample: str, names: list[str]) -> DataFrame:
    """One row: n, the k-sample Anderson-Darling statistic a2 in its mid-rank form, standardised, and the 5 % critical value of that."""
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("l"), *[F.count_if(F.col(sample) == s).alias(f"s{i}") for i, s in enumerate(names)])
    sums = ["l", *[f"s{i}" for i in range(len(names))]]
    total = v.agg(*[F.sum(s).cast("double").alias(f"t_{s}") for s in sums])
    c = running(v, "v", sums).join(F.broadcast(total))
    n, b = F.col("t_l"), F.col("cum_l") - F.col("l") / 2.0
    below = b * (n - b) - n * F.col("l") / 4.0
    part = lambda i: F.col("l") / n * F.pow(n * (F.col(f"cum_s{i}") - F.col(f"s{i}") / 2.0) - F.col(f"t_s{i}") * b, F.lit(2.0)) / F.nullif(below, F.lit(0.0)) / F.nullif(F.col(f"t_s{i}"), F.lit(0.0))
    each = c.groupBy("t_l", *[f"t_s{i}" for i in range(len(names))]).agg(*[F.sum(part(i)).alias(f"p{i}") for i in range(len(names))])
    inner = sum((F.coalesce(f"p{i}", F.lit(0.0)) for i in range(len(names))), F.lit(0.0))
    m = len(names) - 1
    inverse = sum((1.0 / F.nullif(f"t_s{i}", F.lit(0.0)) for i in range(len(names))), F.lit(0.0))
    out = each.select(F.col("t_l").cast("long").alias("n"), ((n - 1) / n * inner).alias("a2"), inverse.alias("_h"))
    out = with_tail(out, "_sd", anderson_deviation, F.col("n"), F.lit(m + 1), F.col("_h"))
    # Interpolation of the 5 % point by the number of samples less one
    critical = 1.645 + 0.678 / m**0.5 - 0.362 / m
    return out.select("n", "a2", ((F.col("a2") - m) / F.col("_sd")).alias("standardised"), F.lit(critical).alias("critical"))


# Coefficients of a rational approximation of the inverse normal distribution.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution, to about 1e-9 relative."""

    def poly(x: Column, coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    q = p - 0.5
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = poly(tail, _C) / poly(tail, (*_D, 1.0))
    return F.when(F.abs(q) <= 0.47575, q * poly(q * q, _A) / poly(q * q, (*_B, 1.0))).when(q < 0, outer).otherwise(-outer)


def qq_table(df: DataFrame, value: str) -> DataFrame:
    """(value, quantile): each distinct value against the normal quantile of its mean position."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.sum("c").alias("n"))
    at = running(counts, "value", ["c"]).join(F.broadcast(n))
    return at.select("value", normal_quantile((F.col("cum_c") - F.col("c") / 2.0) / F.col("n")).alias("quantile"))


def comparison_table(ci: DataFrame, diffs: DataFrame, key: str, reference: str, names: list[str]) -> DataFrame:
    """One row per metric, one column per model: mean ± half the interval, with stars of the difference from the reference. ci as bootstrap_ci() with key, diffs: (key, metric, p)."""
    half = (F.col("upper") - F.col("lower")) / 2
    cells = ci.join(diffs.select(key, "metric", "p"), [key, "metric"], "left")
    mark = F.when(F.col(key) == reference, "").otherwise(F.coalesce(stars(F.least(F.col("p"), 1 - F.col("p"))), F.lit("")))
    text = F.concat(F.format_string("%.4g ± %.2g", "mean", half), mark)
    return cells.withColumn("text", text).groupBy("metric").pivot(key, names).agg(F.min("text"))


def drift_table(describe: DataFrame, drift: DataFrame, month: str) -> DataFrame:
    """(month, price description, each metric's mean, its change against the first month with stars), one row a month."""
    text = F.concat(F.format_string("%+.4g", "diff"), stars(F.col("p")))
    wide = drift.groupBy(month).pivot("metric", METRICS).agg(F.min("mean").alias("mean"), F.min(text).alias("change"))
    return describe.join(wide, month)


def bootstrap_select(df: DataFrame, group: str, y: str, models: dict[str, str], metric: str, rounds: int, ident: str = "id", seed: int = 42) -> DataFrame:
    """(group, best, second, p): the two models best by mean over rounds, and the share of rounds in which the second is at least as good."""
    each = [round_metrics(df, rounds, [group], y, c, ident, seed).select(group, "round", F.lit(n).alias("model"), F.col(metric).alias("v")) for n, c in models.items()]
    all_ = each[0]
    for e in each[1:]:
        all_ = all_.unionByName(e)
    top = best_two(all_, [group], "model", "v", metric == "r2").select(group, "best", "second")
    a = all_.join(top, group)
    pair = a.groupBy(group, "best", "second", "round").agg(F.max(F.when(F.col("model") == F.col("best"), F.col("v"))).alias("x"), F.max(F.when(F.col("model") == F.col("second"), F.col("v"))).alias("z"))
    better = F.col("z") >= F.col("x") if metric == "r2" else F.col("z") <= F.col("x")
    return pair.groupBy(group, "best", "second").agg(F.avg(better.cast("double")).alias("p"))
