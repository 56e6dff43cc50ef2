"""Error metrics of predictions, as aggregate expressions and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.operators.order import quantiles

EPS = 1e-8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r2(y: Column | str, p: Column | str) -> Column:
    """1 - SSE / SST; null if the truth does not vary."""
    y, p = _c(y), _c(p)
    spread = F.sum(y * y) - F.count(y) * F.avg(y) * F.avg(y)
    return 1 - F.sum((y - p) * (y - p)) / F.when(F.max(y) != F.min(y), spread)


def rmse(y: Column | str, p: Column | str) -> Column:
    y, p = _c(y), _c(p)
    return F.sqrt(F.avg((y - p) * (y - p)))


def smape(y: Column | str, p: Column | str, kind: str = "eps") -> Column:
    """Percent. eps: 1e-8 in the denominator; zero: pairs of zeros count 0; plain: they are left out."""
    y, p = _c(y), _c(p)
    total = F.abs(y) + F.abs(p)
    if kind == "eps":
        return 100 * F.avg(2 * F.abs(p - y) / (total + EPS))
    ratio = F.when(total != 0, 2 * F.abs(p - y) / F.nullif(total, F.lit(0.0)))
    return 100 * F.avg(F.coalesce(ratio, F.when(total.isNotNull(), 0.0)) if kind == "zero" else ratio)


def ape(y: Column | str, p: Column | str, kind: str = "plain") -> Column:
    """Share of the truth. eps: 1e-8 added to it; zero: absolute error where it is 0; plain: null there."""
    y, p = _c(y), _c(p)
    if kind == "eps":
        return F.abs(y - p) / (F.abs(y) + EPS)
    ratio = F.abs(y - p) / F.nullif(F.abs(y), F.lit(0.0))
    return F.when(y == 0, F.abs(y - p)).otherwise(ratio) if kind == "zero" else ratio


def medape(y: Column | str, p: Column | str, kind: str = "plain") -> Column:
    """Percent."""
    return 100 * F.median(ape(y, p, kind))


def all_metrics(y: Column | str, p: Column | str) -> list[Column]:
    return [r2(y, p).alias("r2"), rmse(y, p).alias("rmse"), smape(y, p, "zero").alias("smape"), medape(y, p).alias("medape")]


def metrics_by(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """(keys, r2, rmse, smape, medape), as all_metrics() but with medians that no task gathers; null keys are a group."""
    whole = df.groupBy(*keys).agg(r2(y, p).alias("r2"), rmse(y, p).alias("rmse"), smape(y, p, "zero").alias("smape"))
    half = quantiles(df, {"v": ape(y, p)}, [0.5], keys).select(*[F.col(k).alias(f"_k_{k}") for k in keys], (100 * F.col("q")[0]).alias("medape"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return whole.join(half, same, "left").select(*keys, "r2", "rmse", "smape", "medape")


def drop_null_pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows in which both are numbers."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(ok(y) & ok(p))


def row_errors(df: DataFrame, y: str = "price", p: str = "predicted_price") -> DataFrame:
    """Truth and prediction on both scales, absolute error and error relative to the truth."""
    t, q = F.col(y), F.col(p)
    return df.select("id", F.log1p(t).alias("true_price_log"), F.log1p(q).alias("predicted_price_log"), t.alias("true_price"), q.alias("predicted_price"), F.abs(t - q).alias("absolute_error"), (F.abs(t - q) / (t + EPS)).alias("relative_error"))


def to_long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per key and metric."""
    return df.unpivot(keys, names, "metric", "value")


def fold_stats(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, population deviation, bounds and half of the 95 % interval over folds."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (1.96 * F.stddev_pop(v) / F.sqrt(F.count(v))).alias("conf_interval"))


def price_describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.count(v).alias("n"))
    half = quantiles(df, {"v": v}, [0.5], keys).select(*keys, F.col("q")[0].alias("median"))
    return out.join(half, keys, "left").select(*keys, "min", "max", "median", "mean", "var", "n")


def pivot_first(df: DataFrame, keys: list[str], metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One row per configuration, one column per metric, the smallest value if there are several."""
    return df.groupBy(*keys).pivot(metric, metrics).agg(F.min(value))


def ordered_report(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """df with `position` of the category in a given order (unknown ones last)."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(column)).cast("int")
    return df.withColumn("position", F.when(rank > 0, rank).otherwise(len(order) + 1))


def percentiles_by_group(df: DataFrame, key: str, value: Column, points: list[float], least: int) -> DataFrame:
    """(key, n, p<points>) of groups of more than `least` rows; exact, interpolated."""
    out = quantiles(df, {"_p": value}, points, [key]).where(F.col("n") > least).withColumnRenamed("q", "_p")
    return out.select(key, "n", *[F.col("_p")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(points)])
