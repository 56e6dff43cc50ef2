"""Binning, stratified splits and resampling by repeatable draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.functions.draws import draw, poisson_one
from gable.operators.order import quantile_row, ranked_draws


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row, `edges`: the distinct inner and outer quantiles, exact and interpolated."""
    return quantile_row(df, {"edges": F.col(value)}, [i / bins for i in range(bins + 1)]).select(F.coalesce(F.array_distinct("edges"), F.array().cast("array<double>")).alias("edges"))


def qcut(df: DataFrame, value: str, bins: int, edges: DataFrame | None = None) -> DataFrame:
    """df with `bin`: right-closed quantile bins from 0, the lowest value included, equal edges merged, nulls -1."""
    edges = quantile_edges(df, value, bins) if edges is None else edges
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    code = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return df.join(F.broadcast(edges)).withColumn("bin", F.when(F.col(value).isNull(), -1).otherwise(code)).drop("edges")


def strat_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, ident: str = "id") -> DataFrame:
    """df with `part`: test for the floor(share * size) rows of each stratum with the lowest draws, else train."""
    r = ranked_draws(df.withColumn("_u", draw(seed, F.col(ident))), [key], "_u", ident)
    return r.withColumn("part", F.when(F.col("rank") <= F.floor(F.col("size") * F.lit(share)), "test").otherwise("train")).drop("_u", "rank", "size")


def strat_sample(df: DataFrame, key: str, size: int, bins: int, seed: int = 42, ident: str = "id") -> DataFrame:
    """At most ceil(size / bins) rows of each stratum, cut to `size` in the order of draws."""
    per = -(-size // bins)
    r = ranked_draws(df.withColumn("_u", draw(seed, F.col(ident))), [key], "_u", ident).where(F.col("rank") <= per)
    return r.orderBy("_u", ident).limit(size).drop("_u", "rank", "size")


def strat_kfold(df: DataFrame, key: str, k: int, seed: int = 42, ident: str = "id") -> DataFrame:
    """df with `fold`, 0 to k - 1, dealt in turn by draw within each stratum."""
    r = ranked_draws(df.withColumn("_u", draw(seed, F.col(ident))), [key], "_u", ident)
    return r.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("_u", "rank", "size")


def shuffle(df: DataFrame, seed: int = 42, ident: str = "id") -> DataFrame:
    """df with `position` from 1 in the order of draws."""
    r = ranked_draws(df.withColumn("_u", draw(seed, F.col(ident))).withColumn("_all", F.lit(0)), ["_all"], "_u", ident, 1024)
    return r.withColumn("position", F.col("rank")).drop("_u", "_all", "rank", "size")


def with_weights(df: DataFrame, rounds: int, seed: int = 42, ident: str = "id", first: int = 0) -> DataFrame:
    """Each row once for each bootstrap round that draws it, with the round and its weight."""
    out = df.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(first + rounds - 1))))
    return out.withColumn("weight", poisson_one(draw(seed, F.col(ident), F.col("round")))).where("weight > 0")


def fixed_bins(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the left-closed range; the last range is open above."""
    out = F.when(value >= edges[-1], labels[len(edges) - 1]) if len(labels) == len(edges) else F.lit(None).cast("string")
    for a, b, name in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((value >= a) & (value < b), name).otherwise(out)
    return out


def quartile_groups(df: DataFrame, value: str, name: str = "group") -> DataFrame:
    """df with a text label of the quartile range, bounds rounded to whole numbers."""
    q = quantile_row(df, {"_q": F.col(value)}, [0.25, 0.5, 0.75])
    v, text = F.col(value), lambda c: F.round(c, 0).cast("long").cast("string")
    a, b, c = (F.col("_q")[i] for i in range(3))
    label = F.when(v <= a, F.concat(F.lit("to "), text(a))).when(v <= b, F.concat_ws("-", text(a), text(b))).when(v <= c, F.concat_ws("-", text(b), text(c))).otherwise(F.concat(F.lit("over "), text(c)))
    return df.join(F.broadcast(q)).withColumn(name, F.when(v.isNotNull(), label)).drop("_q")


def capped_groups(value: Column, cap: int) -> Column:
    """The whole number as text, `<cap>+` from the cap on."""
    return F.when(value >= cap, f"{cap}+").otherwise(value.cast("int").cast("string"))
