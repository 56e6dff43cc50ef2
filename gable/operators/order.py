"""Row numbers and running sums over large groups without gathering a group in one task.

The order is cut into buckets first; rows are numbered within their bucket and the counts of the buckets before are
added. Only the table of bucket totals, whose size is set by a parameter, is summed up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked_draws(df: DataFrame, keys: list[str], draw: str, ident: str, buckets: int = 64) -> DataFrame:
    """df with `rank` (from 1) by draw, then ident, within keys, and `size` of the group. draw is uniform in [0, 1)."""
    out = df.withColumn("_b", F.floor(F.col(draw) * buckets).cast("int"))
    totals = out.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*keys)
    totals = totals.withColumn("_before", F.sum("_n").over(group.orderBy("_b")) - F.col("_n")).withColumn("size", F.sum("_n").over(group)).drop("_n")
    numbered = out.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(draw, ident)))
    same = F.col("_b") == F.col("_tb")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    side = totals.select(F.col("_b").alias("_tb"), *[F.col(k).alias(f"_t_{k}") for k in keys], "_before", "size")
    joined = numbered.join(side, same)
    return joined.select(*df.columns, (F.col("_r") + F.col("_before")).alias("rank"), "size")


#: Sketches of quantiles err by n / ACCURACY ranks at most; exact values are looked for SLACK of all ranks around.
ACCURACY, SLACK = 10_000, 0.0005
#: Up to so many rows a sketch's few ranks of slack may miss, so all values are looked at; twice ACCURACY leaves eight ranks.
FEW = 2 * ACCURACY


def quantiles(df: DataFrame, values: dict[str, Column], points: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, name, n, q): exact quantiles at the points, interpolated, of each named value; nulls are left out, a value of nulls has no row.

    Sketches of bounded size say between which two values a quantile lies; then all rows are counted by whether they lie
    below or, by value, between. So no task holds more than about a thousandth of the distinct values, in sorted order, or
    than FEW values, where a group has no more and its values are all looked at.
    """
    keys = keys or []
    cells = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, v in values.items()])
    rows = df.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.name", F.col("_x.v").alias("_v")).where("_v is not null")
    ends = F.percentile_approx("_v", F.array(*[F.lit(max(0.0, p - SLACK)) for p in points], *[F.lit(min(1.0, p + SLACK)) for p in points]), ACCURACY)
    marks = rows.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), ends.alias("_e"))
    place = F.posexplode(F.arrays_zip(F.slice("_e", 1, len(points)).alias("lo"), F.slice("_e", len(points) + 1, len(points)).alias("hi"), F.array(*map(F.lit, points)).alias("p"))).alias("_i", "_m")
    marks = marks.select(*keys, "name", "n", place).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("name").alias("_name"), "n", "_i", F.when(F.col("n") > FEW, F.col("_m.lo")).otherwise(F.lit(float("-inf"))).alias("lo"), F.when(F.col("n") > FEW, F.col("_m.hi")).otherwise(F.lit(float("nan"))).alias("hi"), ((F.col("n") - 1) * F.col("_m.p")).alias("_r"))
    same = F.col("name") == F.col("_name")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    group = [*keys, "name", "n", "_i", "_r"]
    counts = rows.join(marks, same & (F.col("_v") <= F.col("hi"))).groupBy(*group, F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*group).orderBy(F.asc_nulls_first("_v"))
    at = lambda r: F.min(F.when(F.col("_cum") > r, F.col("_v")))
    found = counts.withColumn("_cum", F.sum("_c").over(before)).where("_v is not null").groupBy(*group).agg(at(F.floor("_r")).alias("_a"), at(F.ceil("_r")).alias("_b"))
    one = F.struct("_i", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_r") - F.floor("_r"))).alias("q"))
    return found.groupBy(*keys, "name", "n").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["q"]).alias("q"))


def quantile_row(df: DataFrame, values: dict[str, Column], points: list[float]) -> DataFrame:
    """One row: the quantiles of each named value as an array, null if it has no rows."""
    q = quantiles(df, values, points)
    return q.agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in values])


def top_of(counts: DataFrame, group: list[str], order: list[Column], most: int, ident: str, place: str = "place") -> DataFrame:
    """counts with `place`, up to `most` of each group in the given order: first within 64 shares of the group by a hash of ident, then over what is left."""
    share = W.partitionBy(*group, F.pmod(F.xxhash64(ident), F.lit(64)))
    left = counts.withColumn(place, F.row_number().over(share.orderBy(*order))).where(F.col(place) <= most)
    return left.withColumn(place, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(place) <= most)


def edges_of(df: DataFrame, value: str, buckets: int = 64) -> list[float]:
    """Values that cut df into about equal parts; approximate, bounded by `buckets`."""
    got = df.agg(F.percentile_approx(value, F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)]), 1000)).first()[0]
    return sorted(set(got or []))


def bucket_of(value: Column, edges: list[float]) -> Column:
    """How many edges lie below the value: equal values share a bucket, and buckets follow the order of values."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)) if edges else F.lit(0)


def running(df: DataFrame, value: str, sums: list[str], keys: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """df (one row per keys and value) with `cum_<s>`: the sum of s over rows with the same keys and a value not greater."""
    keys = keys or []
    cut = df.withColumn("_b", bucket_of(F.col(value), edges_of(df, value, buckets)))
    totals = cut.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    w = W.partitionBy(*keys).orderBy("_b") if keys else W.orderBy("_b")
    before = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), *[(F.sum(f"_t_{s}").over(w) - F.col(f"_t_{s}")).alias(f"_before_{s}") for s in sums])
    inner = W.partitionBy(*keys, "_b").orderBy(value)
    same = F.col("_b") == F.col("_kb")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = cut.select("*", *[F.sum(s).over(inner).alias(f"_in_{s}") for s in sums])
    return inside.join(F.broadcast(before), same).select(*df.columns, *[(F.col(f"_in_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums])
