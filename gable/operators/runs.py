"""Run tables, aligned predictions and price segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.operators.order import quantile_row


def runs_table(runs: DataFrame, params: list[str], metrics: list[str], order: str) -> DataFrame:
    """Finished runs with the wanted parameters and metrics as columns, best first; params and metrics are JSON maps."""
    p = F.from_json("params", "map<string,string>")
    m = F.from_json("metrics", "map<string,double>")
    out = runs.where("status = 'FINISHED'").select("run_id", "start_time", *[p[k].alias(k) for k in params], *[m[k].alias(k) for k in metrics])
    return out.orderBy(F.desc_nulls_last(order), "run_id")


def pick_runs(runs: DataFrame, keys: list[str], objective: str) -> DataFrame:
    """(keys, latest, best): the latest run and the one with the highest objective (the latest of equals)."""
    best = F.struct(F.col(objective).isNotNull().alias("known"), F.col(objective).alias("v"), F.col("start_time").alias("t"))
    return runs.groupBy(*keys).agg(F.max_by("run_id", "start_time").alias("latest"), F.max_by("run_id", best).alias("best"))


def align_predictions(truth: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, truth, first, second) of ids that all three have."""
    a, b = first.withColumnRenamed("p", "first"), second.withColumnRenamed("p", "second")
    return truth.join(a, "id").join(b, "id").select("id", "truth", "first", "second")


def cut_label(value: Column, edges: list[float]) -> Column:
    """Label `low-high` of the left-closed range of a value; null outside all ranges."""
    out = F.lit(None).cast("string")
    for a, b in reversed(list(zip(edges[:-1], edges[1:]))):
        out = F.when((value >= a) & (value < b), f"{a:.0f}-{b:.0f}").otherwise(out)
    return out


def price_segments(df: DataFrame, price: str, share: float = 0.85) -> DataFrame:
    """df with `segment`: low up to the quantile, else high. The quantile is one row, joined by broadcast."""
    edge = quantile_row(df, {"_q": F.col(price)}, [share]).select(F.col("_q")[0].alias("_edge"))
    return df.join(F.broadcast(edge)).withColumn("segment", F.when(F.col(price) <= F.col("_edge"), "low").otherwise("high")).drop("_edge")
