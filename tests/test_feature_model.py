"""The feature pipeline's state: train and apply agree, new cells and values fall back, what is read back gives the same rows."""

import pytest
from pyspark.sql import functions as F

from gable.operators.feature_model import CELL_FILLS, FeatureSpec, ListingFeatures, ListingFeaturesModel
from gable.plans.base import gazetteer, listings
from gable.plans.q_features import PHRASES, SPEC


@pytest.fixture(scope="module")
def rows(spark, sf):
    return listings(spark, sf).cache()


@pytest.fixture(scope="module")
def model(spark, sf, rows):
    return ListingFeatures(SPEC, gazetteer(spark, sf), PHRASES).fit(rows)


def test_a_row_has_the_same_features_in_any_company(model, rows):
    everywhere = {r["id"]: r for r in model.transform(rows).collect()}
    few = model.transform(rows.where("id % 50 = 7")).collect()
    assert few and all(everywhere[r["id"]] == r for r in few) and len(everywhere) == rows.count()
    scaled = [c for c in model.scaled if c != "year"]
    assert all(-1e-9 <= r[c] <= 1 + 1e-9 for r in everywhere.values() for c in scaled)


def test_new_cells_and_values_fall_back(spark, model, rows):
    far = rows.limit(1).withColumns({"lat": F.lit(10.0), "lon": F.lit(10.0), "category": F.lit("unseen"), "renovation": F.lit(None).cast("string")})
    got, medians = model.transform(far).collect()[0], model.tables["medians"].collect()[0]
    assert got["hex_property_count"] == 0 and got["category_code"] == 0 and sum(got[f"renovation_{i}"] for i in range(1, 6)) == 1
    import math

    assert all(math.isclose(got[c], math.log1p(medians[g])) for c, g in CELL_FILLS.items())
    empty = model.transform(rows.where("false"))
    assert empty.count() == 0 and empty.columns == model.transform(far).columns


def test_written_state_gives_equal_rows(spark, model, rows, tmp_path):
    model.save(str(tmp_path / "m"))
    back = ListingFeaturesModel.load(str(tmp_path / "m"))
    assert back.spec == model.spec and back.uid == model.uid and back.phrases == {k: sorted(v) for k, v in sorted(PHRASES.items())}
    a, b = (m.transform(rows.where("id % 20 = 3")).orderBy("id").collect() for m in (model, back))
    assert a == b and len(a) > 10


def test_a_pipeline_of_features_and_learner(spark, sf, rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    spec = FeatureSpec(year="year_raw", outliers=["house_area"], logged=["house_area", "price"], resolution=5)
    stages = [ListingFeatures(spec, gazetteer(spark, sf)), VectorAssembler(inputCols=["house_area", "lat", "lon", "hex_price_median"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="price")]
    assert Pipeline(stages=stages).fit(rows).transform(rows).where("prediction is not null").count() == rows.count()
