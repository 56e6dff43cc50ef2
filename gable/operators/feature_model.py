"""The whole feature pipeline of listings as a Spark ML Estimator and Model, with its fitted tables written and read back.

Fitted state is several small or keyed tables: the median year, modes, outlier bounds, ranges for scaling, label codes,
hexagon statistics with those of their neighbours, global medians, the gazetteer and the phrase dictionary. Applying joins
them; nothing of the applied rows changes the state, so train and apply modes give a row the same features.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable.functions import geo as G
from gable.operators import encode as E
from gable.operators import geo as O
from gable.operators.clean import clean_year
from gable.operators.nearest import with_nearest
from gable.operators.order import quantile_row

#: Hexagon statistics among the features, and the global medians that stand in where a cell has none.
CELL_FILLS = {
    "hex_price_median": "g_price",
    "hex_price_per_sqm": "g_sqm",
    "hex_price_per_land": "g_land",
    "neighbor_price_median": "g_price",
    "neighbor_price_per_sqm": "g_sqm",
    "neighbor_price_per_land": "g_land",
}
TIERS = {"distance_ppla": ("PPLC", "PPLA"), "distance_ppla2": ("PPLA2",)}


@dataclass
class FeatureSpec:
    """Which column is what. Hexagon statistics need the columns price, house_area and land_area."""

    ident: str = "id"
    lat: str = "lat"
    lon: str = "lon"
    year: str = "year"
    text: str | None = None
    fill: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    one_hot: dict[str, dict[str, str]] = field(default_factory=dict)
    multi_hot: dict[str, dict[str, str]] = field(default_factory=dict)
    outliers: list[str] = field(default_factory=list)
    logged: list[str] = field(default_factory=list)
    resolution: int = 6

    def names(self, phrases: list[str]) -> list[str]:
        """The feature columns, in order."""
        hot = [f"{c}_{n}" for d in (self.one_hot, self.multi_hot) for c, names in d.items() for n in names.values()]
        return [*self.logged, *TIERS, "distance_ring", "year", self.lat, self.lon, "yearIsNull", "azimuth_sin", "azimuth_cos", *CELL_FILLS, "hex_property_count", *hot, *[f"{c}_code" for c in self.labels], *[f"text_{p}" for p in phrases]]


def placed(df: DataFrame, spec: FeatureSpec, gazetteer: DataFrame) -> DataFrame:
    """df with distances to the nearest city of each tier and to the ring, and the direction from the nearest first-level city. Idents must not repeat."""
    out = df.select(spec.ident, F.col(spec.lat).cast("double").alias("_lat"), F.col(spec.lon).cast("double").alias("_lon"))
    for name, codes in TIERS.items():
        out = with_nearest(out, gazetteer.where(F.col("feature_code").isin(*codes)), "_lat", "_lon", f"_{name}")
    at = lambda name: (F.col(f"_{name}.latitude"), F.col(f"_{name}.longitude"))
    here = (F.col("_lat"), F.col("_lon"))
    angle = F.radians(G.azimuth(*at(next(iter(TIERS))), *here))
    found = out.select(spec.ident, *[G.haversine(*here, *at(n)).alias(n) for n in TIERS], F.sin(angle).alias("azimuth_sin"), F.cos(angle).alias("azimuth_cos"), G.polygon_distance(*here).alias("distance_ring"))
    return df.join(found, spec.ident, "left")


def held(df: DataFrame) -> DataFrame:
    """A fitted table of a few rows (one, or one a column), computed now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


class ListingFeatures(Estimator):
    """fit() gives a ListingFeaturesModel. gazetteer: (name, latitude, longitude, feature_code); phrases: feature -> phrases of a text."""

    def __init__(self, spec: FeatureSpec, gazetteer: DataFrame, phrases: dict[str, list[str]] | None = None):
        super().__init__()
        self.spec, self.gazetteer, self.phrases = spec, gazetteer, phrases or {}

    def _fit(self, dataset: DataFrame) -> ListingFeaturesModel:
        spec, y = self.spec, F.col(self.spec.year)
        spark = dataset.sparkSession
        tables = {"gazetteer": self.gazetteer.select("name", "latitude", "longitude", "feature_code")}
        tables["phrases"] = spark.createDataFrame([(f, p) for f, ps in self.phrases.items() for p in ps], "feature string, phrase string")
        tables["year"] = held(quantile_row(dataset, {"median": F.when(y != 0, y)}, [0.5]).select(F.col("median")[0].alias("median")))
        tables["modes"] = held(E.modes(dataset, spec.fill)) if spec.fill else spark.createDataFrame([], "none string")
        tables["bounds"] = held(E.bounds(dataset, spec.outliers))
        codes = spark.createDataFrame([], "column string, value string, code long")
        for c in spec.labels:
            own = E.label_codes(dataset.select(E.nan_category(F.col(c)).alias(c)), c)
            codes = codes.unionByName(own.select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), F.col("code").cast("long").alias("code")))
        tables["codes"] = codes.persist()
        marked = O.with_cell(E.mark_outliers(dataset, spec.outliers, tables["bounds"]), spec.resolution, spec.lat, spec.lon)
        tables["medians"] = held(O.global_medians(marked))
        stats = O.hex_stats(marked).persist()
        tables["cells"] = stats.join(O.hex_neighbors(marked, stats, tables["medians"]), ["q", "r"]).persist()
        model = ListingFeaturesModel(spec, tables)
        logged = model.before_scaling(dataset)
        tables["ranges"] = held(E.minmax_fit(logged, model.scaled + [spec.lat, spec.lon]))
        return ListingFeaturesModel(spec, tables)


class ListingFeaturesModel(Model, MLWritable, MLReadable):
    """transform() gives ident, is_outlier and the features of each row; see FeatureSpec.names().

    Rows of cells that were not seen take the global medians and a count of 0; label values that were not seen take the
    code 0, as missing ones do. Distances, areas and prices are logged; they, the year and coordinates are scaled by the
    fitted ranges and not clipped; hexagon statistics are logged only.
    """

    def __init__(self, spec: FeatureSpec, tables: dict[str, DataFrame]):
        super().__init__()
        self.spec, self.tables = spec, tables
        # a dictionary that a user wrote
        rows = tables["phrases"].orderBy("feature", "phrase").collect()
        self.phrases = {f: [r["phrase"] for r in rows if r["feature"] == f] for f in dict.fromkeys(r["feature"] for r in rows)}

    @property
    def scaled(self) -> list[str]:
        return [*self.spec.logged, *TIERS, "distance_ring", "year"]

    def before_scaling(self, df: DataFrame) -> DataFrame:
        spec, t = self.spec, self.tables
        out = placed(df, spec, t["gazetteer"])
        out = E.mark_outliers(out, spec.outliers, t["bounds"]).drop(*[f"is_{c}_outlier" for c in spec.outliers])
        out = O.with_cell(out, spec.resolution, spec.lat, spec.lon).join(t["cells"], ["q", "r"], "left").join(F.broadcast(t["medians"]))
        out = out.withColumns({c: F.coalesce(c, g) for c, g in CELL_FILLS.items()} | {"hex_property_count": F.coalesce("hex_property_count", F.lit(0))})
        out = clean_year(out if spec.year == "year" else out.withColumnRenamed(spec.year, "year"), "year", t["year"])
        if spec.fill:
            out = E.mode_fill(out, spec.fill, t["modes"])
        for column, names in spec.one_hot.items():
            out = E.one_hot(out, column, names)
        for column, names in spec.multi_hot.items():
            out = E.multi_hot(out, column, names)
        for i, column in enumerate(spec.labels):
            own = t["codes"].where(F.col("column") == column).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_n{i}"))
            out = out.join(own, E.nan_category(F.col(column)) == F.col(f"_v{i}"), "left").withColumn(f"{column}_code", F.coalesce(f"_n{i}", F.lit(0)))
        if spec.text:
            out = E.phrase_flags(out, spec.text, self.phrases)
        return E.log_features(out, [*spec.logged, *TIERS, "distance_ring", *CELL_FILLS])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spec, ranges = self.spec, self.tables["ranges"]
        out = E.minmax_apply(self.before_scaling(dataset), self.scaled, ranges)
        out = E.minmax_apply(out, [spec.lat, spec.lon], ranges, -1.0, 1.0)
        return out.select(spec.ident, "is_outlier", *spec.names(list(self.phrases) if spec.text else []))

    def write(self) -> MLWriter:
        return _Writer(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    @classmethod
    def load(cls, path: str) -> ListingFeaturesModel:
        return cls.read().load(path)


class _Writer(MLWriter):
    def __init__(self, model: ListingFeaturesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"spec": json.dumps(asdict(self.model.spec)), "tables": sorted(self.model.tables)})
        for name, df in self.model.tables.items():
            df.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def load(self, path: str) -> ListingFeaturesModel:
        spark = SparkSession.active()
        facts = DefaultParamsReader.loadMetadata(path, spark)
        model = ListingFeaturesModel(FeatureSpec(**json.loads(facts["spec"])), {name: spark.read.parquet(f"{path}/{name}") for name in facts["tables"]})
        model._resetUid(facts["uid"])
        return model
