"""The support-vector regressor against a solution in numpy, TF-IDF as a stage, both written in pipelines and read back."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gable.operators import models as MD
from gable.operators import vectors as V
from gable.operators.stages import LinearSVR, TermWeights


def optimum(x, y, c, eps):
    """By many small gradient steps, then exactly: the system of the rows outside the tube, until they stay the same."""
    x = np.column_stack([x, np.ones(len(x))])
    w, rate = np.zeros(x.shape[1]), 1 / (1 + 2 * c * np.linalg.norm(x, 2) ** 2)
    v = w
    for k in range(20_000):
        r = y - x @ v
        new = v - rate * (v - 2 * c * x.T @ (np.sign(r) * np.maximum(0, np.abs(r) - eps)))
        w, v = new, new + k / (k + 3) * (new - w)
    for _ in range(5):
        r = y - x @ w
        a = np.abs(r) > eps
        w = np.linalg.solve(np.eye(len(w)) + 2 * c * x[a].T @ x[a], 2 * c * x[a].T @ (y[a] - np.sign(r[a]) * eps))
    return w


@pytest.mark.parametrize("c,eps", [(1.0, 0.0), (0.1, 0.5), (10.0, 1.5), (1.0, 100.0)])
def test_regressor_finds_the_optimum(spark, c, eps):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [1, 3, 0.2, 1]
    y = x @ [1.0, -2.0, 5.0, 0.0] + 4 + rng.standard_t(2, 400)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, d double, y double").repartition(3)
    df = VectorAssembler(inputCols=list("abcd"), outputCol="f").transform(df)
    m = LinearSVR(featuresCol="f", labelCol="y", c=c, epsilon=eps).fit(df)
    assert np.allclose([*m.coefficients, m.intercept], optimum(x, y, c, eps), atol=1e-6)
    got = m.transform(df).select("a", "b", "c", "d", "prediction").collect()
    assert all(abs(np.dot(r[:4], m.coefficients) + m.intercept - r["prediction"]) < 1e-9 for r in got)


def test_regressor_in_a_written_pipeline(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 17 * 1.0).alias("a"), (F.col("id") % 5 * 1.0).alias("b")).withColumn("y", 3 * F.col("a") - F.col("b") + 7)
    model = MD.fit(df, "svr", ["a", "b"], "y", c=100.0)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    rows = back.transform(df).collect()
    assert rows == model.transform(df).collect() and max(abs(r["prediction"] - r["y"]) for r in rows) < 0.01


@pytest.mark.parametrize("sublinear,norm,high", [(False, "l2", 1), (True, "l1", 2), (True, None, 1)])
def test_terms_weigh_as_in_the_long_table(spark, sf, tmp_path, sublinear, norm, high):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 3 = 0")
    model = Pipeline(stages=[TermWeights("text", "w", "doc_id", 200, 1, high, 2, 0.9, sublinear, norm)]).fit(docs)
    model.save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    terms = back.stages[0].terms
    counts = V.term_counts(docs, "doc_id", "text", 1, high)
    want = {(r[0], r[1]): r[2] for r in V.tfidf_apply(counts, V.tfidf_fit(counts, docs.count(), 2, 0.9, 200), "doc_id", sublinear, norm).collect()}
    got = {(r["doc_id"], terms[i]): x for r in back.transform(docs).select("doc_id", vector_to_array("w").alias("w")).collect() for i, x in enumerate(r["w"]) if x}
    assert len(terms) == 200 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_text_as_a_feature(spark):
    df = spark.createDataFrame([(i, float(i % 4), "red house" if i % 2 else "blue flat", float(i % 2 * 10)) for i in range(80)] + [(80, 1.0, None, 0.0)], "id int, a double, words string, y double")
    for learner in ("linear", "svr"):
        p = MD.fit(df, learner, ["a"], "y", text="words", terms=4).transform(df).where("words is not null").collect()
        assert max(abs(r["prediction"] - r["y"]) for r in p) < 2
    assert MD.with_text(["a"], "words", 4).fit(df.limit(0)).transform(df).count() == 81


def test_search_is_the_same_whatever_the_order(spark, tmp_path):
    df = spark.range(240).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 17 * 1.0).alias("a")).withColumn("y", 3 * F.col("a") + F.col("id") % 5)
    space = {"learner": ["linear", "svr", "absent"], "regParam": {"of": ("log", 1e-3, 100.0), "when": {"learner": ["linear"]}}, "c": {"of": ("log", 1e-6, 1.0), "when": {"learner": ["svr"]}}, "maxIter": (5, 50)}
    one, four = (MD.search(df, "fold", 3, "linear", ["a"], "y", space, 20, parallel=p, store=str(tmp_path / str(p))).collect() for p in (1, 4))
    close = lambda a, b: a[:3] == b[:3] and a[4] == b[4] and (a[3] == b[3] or abs(a[3] - b[3]) < 1e-9)
    assert len(one) == 20 and all(close(a, b) for a, b in zip(one, four))
    failed = [r for r in one if r["params"]["learner"] == "absent"]
    assert failed and all(r["error"] and r["objective"] == float("-inf") for r in failed)
    assert 0 < sum(r["folds"] == 3 for r in one) <= 10 and all(("regParam" in r["params"]) == (r["params"]["learner"] == "linear") for r in one)
    stored = spark.read.schema(MD.TRIAL).json(str(tmp_path / "4"))
    assert sorted(r["trial"] for r in stored.collect()) == list(range(20))


def test_the_stage_of_the_query_leaves_no_term_out(spark, tmp_path):
    """More terms than the 100,000 that the stage once held, each in two texts."""
    n = 104_000
    letters = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    words = [letters(k) for k in range(n)]
    rows = [(2 * i + j, " ".join(words[i * 1000 : (i + 1) * 1000])) for i in range(n // 1000) for j in (0, 1)] + [(-1, None), (-2, "42")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    Pipeline(stages=[TermWeights("text", "w", "doc_id", None, minDF=2, sublinear=True)]).fit(docs).save(str(tmp_path / "m"))
    got = PipelineModel.load(str(tmp_path / "m")).transform(docs).select("doc_id", "w").cache()
    assert got.count() == len(rows) and got.select(F.explode("w.term").alias("t")).distinct().count() == n
    sizes = {r["doc_id"]: (r["n"], r["z"]) for r in got.selectExpr("doc_id", "size(w) as n", "aggregate(w, 0D, (a, x) -> a + x.weight * x.weight) as z").collect()}
    assert sizes.pop(-1) == sizes.pop(-2) == (0, 0.0) and all(a == 1000 and abs(z - 1) < 1e-9 for a, z in sizes.values())


def test_a_query_without_a_limit_asks_for_none(monkeypatch, spark, sf):
    from gable.operators import stages

    asked = []
    monkeypatch.setattr(stages, "tfidf_fit", lambda counts, n, *bounds: asked.append(bounds) or V.tfidf_fit(counts, n, *bounds))
    import __spark_entry__ as entry

    entry.queries()["tfidf_stage"](spark, sf)
    assert asked == [(5, 0.5, None)]


def test_a_sweep_leaves_nothing_stored(spark, tmp_path, monkeypatch):
    from gable.operators import store

    paths = []
    monkeypatch.setattr(store, "scratch", lambda s: paths.append(str(tmp_path / str(len(paths)))) or paths[-1])
    df = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 17 * 1.0).alias("a")).withColumn("y", 3 * F.col("a") + F.col("id") % 5)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = MD.sweep(df, "fold", 2, "y", [{"learner": "linear", "features": ["a"]}, {"learner": "linear", "features": ["absent"]}, {"learner": "linear", "features": ["a"], "regParam": 1e4}]).collect()
    assert [r["error"] for r in got] == [None, "IllegalArgumentException", None] and got[0]["r2"] > 0.9
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held and len(paths) >= 3 and not list(tmp_path.iterdir())
    want = MD.cross_validate(df, "fold", 2, "linear", ["a"], "y", regParam=1e4).agg(F.avg("r2")).first()[0]
    assert got[2]["r2"] == pytest.approx(want)
