"""Profiles and exploratory aggregates of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.operators.order import quantiles, top_of


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of all cells, as text, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.column", "x.value")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, empty, percent)."""
    return _long(df, columns).groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("empty"), (100 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("percent"))


def unique_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) for every distinct value that is not null."""
    return _long(df, columns).where("value is not null").distinct()


def nunique_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, dtype, n): distinct values of each column; two aggregations, so no column's values meet in one task."""
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes if c in columns for x in (c, t)])
    return unique_profile(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n")).select("column", kinds[F.col("column")].alias("dtype"), "n")


def binary_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, is_binary): numeric columns that hold nothing but 0 and 1."""
    number = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(F.explode(number).alias("x")).groupBy("x.column").agg(F.coalesce(F.bool_and(F.col("x.v").isin(0.0, 1.0)), F.lit(False)).alias("is_binary"))


def domain_violations(df: DataFrame, allowed: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) that occur in df but not in allowed (column, value)."""
    return unique_profile(df, columns).join(allowed, ["column", "value"], "left_anti")


def required_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, empty) of required columns that have nulls."""
    return null_profile(df, columns).where("empty > 0").select("column", "empty")


def validate(df: DataFrame, dtypes: dict[str, str], required: list[str], allowed: DataFrame | None = None, columns: list[str] | None = None) -> None:
    """Raise ValueError with all that a strict profile forbids."""
    have = dict(df.dtypes)
    wrong = [f"{c} is {have.get(c, 'missing')}, not {t}" for c, t in dtypes.items() if have.get(c) != t]
    wrong += [f"{r['column']} has {r['empty']} nulls" for r in required_violations(df, [c for c in required if c in have]).collect()] if required else []
    if allowed is not None and columns:
        wrong += [f"{r['column']} has {r['value']!r}" for r in domain_violations(df, allowed, columns).limit(100).collect()]
    if wrong:
        raise ValueError("; ".join(wrong))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, min, max, q25, q50, q75)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    v = F.col("x.v")
    out = df.select(F.explode(cells).alias("x")).groupBy("x.column").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    out = out.join(quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75]).select(F.col("name").alias("column"), "q"), "column", "left")
    return out.select("column", "mean", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def category_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mode, share, second, third); ties by value."""
    counts = _long(df, columns).where("value is not null").groupBy("column", "value").count()
    total = counts.groupBy("column").agg(F.sum("count").alias("t"))
    top = top_of(counts, ["column"], [F.desc("count"), F.asc("value")], 3, "value", "r").join(F.broadcast(total), "column")
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("value")))
    return top.groupBy("column").agg(at(1).alias("mode"), F.max(F.when(F.col("r") == 1, 100 * F.col("count") / F.col("t"))).alias("share"), at(2).alias("second"), at(3).alias("third"))


def binary_share(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, share): percent of ones."""
    one = df.agg(*[(100 * F.avg(c.cast("int"))).alias(n) for n, c in columns.items()])
    return one.unpivot([], list(columns), "column", "share")


def histogram(df: DataFrame, value: str, width: float, group: str | None = None) -> DataFrame:
    """(bin, low, [group,] n) with bins of equal width from 0."""
    keys = [F.floor(F.col(value) / F.lit(width)).alias("bin"), *([F.col(group)] if group else [])]
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("low", F.col("bin") * F.lit(width))


def mapped(df: DataFrame, column: str, mapping: dict[str, str], default: str | None = None) -> Column:
    """Values by a dictionary; the others stay null or take the default."""
    m = F.create_map(*[F.lit(x) for p in mapping.items() for x in p])
    return F.coalesce(m[F.col(column)], F.lit(default).cast("string"))
