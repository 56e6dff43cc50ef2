"""The whole feature pipeline of listings: fit on one table, apply to any other with the same columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable.operators import encode as E
from gable.operators.clean import align_features, clean_year
from gable.operators.order import quantile_row


@dataclass
class Spec:
    """What is done to which column; domains are part of it, so applying is stable in its columns."""

    year: str
    fill: list[str] = field(default_factory=list)
    one_hot: dict[str, dict[str, str]] = field(default_factory=dict)
    multi_hot: dict[str, dict[str, str]] = field(default_factory=dict)
    outliers: list[str] = field(default_factory=list)
    logged: list[str] = field(default_factory=list)
    geo: list[str] = field(default_factory=list)


@dataclass
class Fitted:
    """Small tables: the median year, modes, outlier bounds, minima and maxima."""

    year: DataFrame
    modes: DataFrame
    bounds: DataFrame
    ranges: DataFrame

    def save(self, path: str) -> None:
        for name in ("year", "modes", "bounds", "ranges"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        return Fitted(*[spark.read.parquet(f"{path}/{name}") for name in ("year", "modes", "bounds", "ranges")])


def fit(df: DataFrame, spec: Spec) -> Fitted:
    y = F.col(spec.year)
    return Fitted(
        quantile_row(df, {"median": F.when(y != 0, y)}, [0.5]).select(F.col("median")[0].alias("median")),
        E.modes(df, spec.fill),
        E.bounds(df, spec.outliers),
        E.minmax_fit(E.log_features(df, spec.logged), [*spec.logged, *spec.geo]),
    )


def transform(df: DataFrame, spec: Spec, fitted: Fitted, ident: str = "id") -> DataFrame:
    """ident, is_outlier, scaled numbers, repaired year, one-hot and multi-hot columns."""
    out = E.mark_outliers(df, spec.outliers, fitted.bounds).drop(*[f"is_{c}_outlier" for c in spec.outliers])
    out = clean_year(out.withColumnRenamed(spec.year, "year"), "year", fitted.year)
    out = E.mode_fill(out, spec.fill, fitted.modes)
    for column, names in spec.one_hot.items():
        out = E.one_hot(out, column, names)
    for column, names in spec.multi_hot.items():
        out = E.multi_hot(out, column, names)
    out = E.minmax_apply(E.log_features(out, spec.logged), spec.logged, fitted.ranges)
    out = E.minmax_apply(out, spec.geo, fitted.ranges, -1.0, 1.0)
    hot = [f"{c}_{n}" for d in (spec.one_hot, spec.multi_hot) for c, names in d.items() for n in names.values()]
    return out.select(ident, "is_outlier", *spec.logged, *spec.geo, "year", "yearIsNull", *hot)


def score(df: DataFrame, spec: Spec, fitted: Fitted, model, features: list[str], target: str, ident: str = "id") -> DataFrame:
    """df with `prediction` on the original scale: features made and aligned, predicted, scaled back, joined 1:1.

    features: the columns that the model was fitted on; those that are missing are filled with 0. target: the logged
    and scaled column that the model predicts. Rows that the model leaves out keep a null.
    """
    made = transform(df, spec, fitted, ident)
    aligned = align_features(made, [ident, *features])
    scaled = model.transform(aligned).select(ident, F.col("prediction").alias(target))
    back = E.minmax_inverse(scaled, [target], fitted.ranges, logged=(target,)).withColumnRenamed(target, "prediction")
    return df.join(back, ident, "left")


def restore(df: DataFrame, spec: Spec, fitted: Fitted) -> DataFrame:
    """Numbers and categories as they were before transform()."""
    out = E.minmax_inverse(df, spec.logged, fitted.ranges, logged=tuple(spec.logged))
    out = E.minmax_inverse(out, spec.geo, fitted.ranges, -1.0, 1.0)
    return out.withColumns({c: E.decode(out, c, names) for c, names in spec.one_hot.items()})
