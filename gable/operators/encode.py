"""Categorical encodings, outlier bounds and scaling: fit gives a small table, apply is a pure projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gable.operators.order import quantiles

NONE = "NaN"


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the most frequent value of each column, the smallest of equals."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.explode(cells).alias("x")).where("x.v is not null").groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    # of the largest counts the smallest value: max_by over (n, -order of v) is not expressible for text, so two steps
    top = counts.groupBy("c").agg(F.max("n").alias("n")).join(counts, ["c", "n"]).groupBy("c").agg(F.min("v").alias("v"))
    return top.groupBy().pivot("c", columns).agg(F.min("v"))


def mode_fill(df: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    m = modes(df, columns) if fitted is None else fitted
    side = m.select(*[F.col(c).alias(f"_mode_{c}") for c in columns])
    return df.join(F.broadcast(side)).withColumns({c: F.coalesce(c, f"_mode_{c}") for c in columns}).drop(*[f"_mode_{c}" for c in columns])


def nan_category(value: Column, none_words: tuple[str, ...] = ("нет",)) -> Column:
    """The category `NaN` for nulls and words that mean none."""
    return F.when(value.isNull() | value.isin(*none_words), NONE).otherwise(value)


def detect_roles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, has_comma, n_distinct, role): list if a value holds a comma, binary if there are at most two values, else category."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    values = df.select(F.explode(cells).alias("x")).select("x.c", "x.v").distinct()
    out = values.groupBy(F.col("c").alias("column")).agg(F.coalesce(F.bool_or(F.contains("v", F.lit(","))), F.lit(False)).alias("has_comma"), F.count("v").alias("n_distinct"))
    return out.withColumn("role", F.when(F.col("has_comma"), "list").when(F.col("n_distinct") <= 2, "binary").otherwise("category"))


def list_domain(df: DataFrame, column: str) -> list[str]:
    """Distinct trimmed parts of a comma list, in order; bounded by the domain, to be stored with the fitted parameters."""
    parts = df.select(F.explode(F.split(column, ",")).alias("p")).select(F.trim("p").alias("p"))
    return [r["p"] for r in parts.where(f"p <> '' and p <> '{NONE}'").distinct().orderBy("p").collect()]


def multi_hot(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """df with one 0/1 column `<column>_<name>` for each part of the domain."""
    parts = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: F.trim(x))
    return df.withColumns({f"{column}_{n}": F.array_contains(parts, v).cast("int") for v, n in names.items()})


def one_hot(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """df with one 0/1 column for each mapped value; other values give zeros."""
    return df.withColumns({f"{column}_{n}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v, n in names.items()})


def one_hot_observed(df: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """One-hot over the observed values (one distinct pass unless they are given)."""
    values = values or [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return one_hot(df, column, {v: v for v in values})


#: Values of a domain that are drawn to cut it into ranges, and ranges at most.
DRAWN, RANGES = 20_000, 1_000


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): alphabetical codes from 0; `NaN` gets 0.

    The domain is numbered range by range, so one as large as the table passes through no single task: edges come from
    a sample of about DRAWN values (they set the time only), and the counts of the ranges before are added.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    n = values.count()
    share = int(min(1.0, DRAWN / max(1, n)) * 1_000_000)
    drawn = sorted(r[0] for r in values.where(F.pmod(F.xxhash64("value"), F.lit(1_000_000)) < share).collect()) if n > DRAWN else []
    edges = drawn[:: -(-len(drawn) // RANGES)] if drawn else []
    cut = F.lit(0)  # the range of a value: how many edges are not above it, found by halving
    if edges:
        held, steps = F.array(*map(F.lit, edges)), F.array(*[F.lit(2**k) for k in reversed(range(len(edges).bit_length()))])
        cut = F.aggregate(steps, cut, lambda c, step: F.when(F.coalesce(F.get(held, c + step - 1) <= F.col("value"), F.lit(False)), c + step).otherwise(c))
    cells = values.select("value", cut.alias("_cell"))
    before = W.orderBy("_cell")  # over RANGES rows
    counts = cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_cell").alias("_of"), (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    code = F.row_number().over(W.partitionBy("_cell").orderBy("value")) - 1
    numbered = cells.select("value", "_cell", code.alias("_code")).join(counts, F.col("_cell") == F.col("_of"))
    return numbered.select("value", F.when(F.col("value").cast("string") == NONE, 0).otherwise((F.col("_code") + F.col("_before")).cast("int")).alias("code"))


def label_encode(df: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    codes = label_codes(df, column) if codes is None else codes
    return df.join(codes.select(F.col("value").alias(column), F.col("code").alias(f"{column}_code")), column, "left")


def decode(df: DataFrame, column: str, names: dict[str, str]) -> Column:
    """The value behind one-hot columns; null if none is set."""
    out = F.lit(None).cast("string")
    for v, n in reversed(list(names.items())):
        out = F.when(F.col(f"{column}_{n}") == 1, v).otherwise(out)
    return out


def phrase_flags(df: DataFrame, text: str, phrases: dict[str, list[str]]) -> DataFrame:
    """df with `text_<feature>`: 1 if one of the feature's phrases occurs in the lower-cased text."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    flag = lambda ps: low.rlike("|".join(r"\Q" + p.lower() + r"\E" for p in ps))
    return df.withColumns({f"text_{f}": flag(ps).cast("int") for f, ps in phrases.items()})


def bounds(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(column, lower, upper): exact quantiles, interpolated."""
    q = quantiles(df, {c: F.col(c) for c in columns}, [low, high])
    return q.select(F.col("name").alias("column"), F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def _wide(fitted: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """A fitted long table as one row `_<name>_<column>`."""
    return fitted.agg(*[F.max(F.when(F.col("column") == c, F.col(n))).alias(f"_{n}_{c}") for c in columns for n in names])


def _with(df: DataFrame, fitted: DataFrame, columns: list[str], names: list[str]) -> tuple[DataFrame, list[str]]:
    side = _wide(fitted, columns, names)
    return df.join(F.broadcast(side)), side.columns


def mark_outliers(df: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """df with `is_<column>_outlier` and `is_outlier`, as 0/1."""
    out, extra = _with(df, bounds(df, columns) if fitted is None else fitted, columns, ["lower", "upper"])
    flag = lambda c: F.coalesce((F.col(c) < F.col(f"_lower_{c}")) | (F.col(c) > F.col(f"_upper_{c}")), F.lit(False)).cast("int")
    out = out.withColumns({f"is_{c}_outlier": flag(c) for c in columns}).drop(*extra)
    return out.withColumn("is_outlier", F.greatest(*[F.col(f"is_{c}_outlier") for c in columns], F.lit(0)))


def remove_outliers(df: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """Rows inside the bounds of all columns."""
    out, extra = _with(df, bounds(df, columns) if fitted is None else fitted, columns, ["lower", "upper"])
    for c in columns:
        out = out.where(F.col(c).between(F.col(f"_lower_{c}"), F.col(f"_upper_{c}")))
    return out.drop(*extra)


def log_features(df: DataFrame, columns: list[str], shift: float = 0.0) -> DataFrame:
    """log1p of those columns that are there; a shift is added before."""
    return df.withColumns({c: F.log1p(F.col(c) + shift) for c in columns if c in df.columns})


def minmax_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(F.explode(cells).alias("x")).groupBy("x.column").agg(F.min("x.v").alias("min"), F.max("x.v").alias("max"))


def minmax_apply(df: DataFrame, columns: list[str], fitted: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Columns scaled to [low, high] on the fitted data, not clipped; a constant column gives low."""
    out, extra = _with(df, fitted, columns, ["min", "max"])
    width = lambda c: F.nullif(F.col(f"_max_{c}") - F.col(f"_min_{c}"), F.lit(0.0))
    scaled = lambda c: F.when(F.col(c).isNotNull(), F.lit(low) + F.coalesce((F.col(c) - F.col(f"_min_{c}")) / width(c), F.lit(0.0)) * F.lit(high - low))
    return out.withColumns({c: scaled(c) for c in columns}).drop(*extra)


def minmax_inverse(df: DataFrame, columns: list[str], fitted: DataFrame, low: float = 0.0, high: float = 1.0, logged: tuple[str, ...] = ()) -> DataFrame:
    """The values before scaling, and before log1p for `logged`."""
    out, extra = _with(df, fitted, columns, ["min", "max"])
    back = lambda c: (F.col(c) - F.lit(low)) / F.lit(high - low) * (F.col(f"_max_{c}") - F.col(f"_min_{c}")) + F.col(f"_min_{c}")
    return out.withColumns({c: F.expm1(back(c)) if c in logged else back(c) for c in columns}).drop(*extra)
