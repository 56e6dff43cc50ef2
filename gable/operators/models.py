"""Price regressors as Spark ML pipelines: assembly, fitting, evaluation, search, scoring."""

from __future__ import annotations

import math
import threading
from concurrent.futures import ThreadPoolExecutor, as_completed
from functools import reduce
from random import Random

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.operators.metrics import metrics_by, r2
from gable.operators.stages import LinearSVR, TermWeights
from gable.operators.store import stored

LEARNERS = {
    "gbt": lambda **p: GBTRegressor(seed=1, **p),
    "rf": lambda **p: RandomForestRegressor(seed=1, **p),
    "svr": lambda **p: LinearSVR(**p),
    "linear": lambda **p: LinearRegression(**({"regParam": 0.1} | p)),
}


def assemble(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")


def with_text(features: list[str], text: str, size: int, ident: str = "id", **weights) -> Pipeline:
    """Assembly of features and the TF-IDF weights of a text column's `size` most frequent words; weights: see TermWeights."""
    return Pipeline(stages=[TermWeights(text, "_terms", ident, size, **weights), assemble([*features, "_terms"])])


def both_scales(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """(keys, scale, r2, rmse, smape, medape) on the log scale of y and p, and on the original one."""
    one = lambda n, f: F.struct(F.lit(n).alias("scale"), f(F.col(y)).alias("_y"), f(F.col(p)).alias("_p"))
    rows = df.select(*keys, F.explode(F.array(one("log", lambda c: c), one("original", F.expm1))).alias("_s")).select(*keys, "_s.*")
    return metrics_by(rows, [*keys, "scale"], "_y", "_p")


def fit(df: DataFrame, learner: str, features: list[str], target: str, text: str | None = None, terms: int = 64, **params) -> PipelineModel:
    """A pipeline of assembly and learner; with text, the TF-IDF weights of its `terms` most frequent words are features too, so a search can choose their number."""
    model = LEARNERS[learner](featuresCol="features", labelCol=target, predictionCol="prediction", **params)
    return Pipeline(stages=[*(with_text(features, text, terms).getStages() if text else [assemble(features)]), model]).fit(df)


def score(df: DataFrame, model, ident: str = "id") -> DataFrame:
    """df left-joined 1:1 with its predictions; rows that the model leaves out keep a null. Raises ValueError if ids repeat."""
    if not df.groupBy(ident).count().where("count > 1").isEmpty():
        raise ValueError(f"{ident} repeats")
    return df.join(model.transform(df).select(ident, "prediction"), ident, "left")


def predicted(df: DataFrame, fold: str, k: int, learner: str, features: list[str], target: str, **params) -> DataFrame:
    """(fold, target, prediction): one fit for each fold, their predictions together."""
    parts = [fit(df.where(F.col(fold) != i), learner, features, target, **params).transform(df.where(F.col(fold) == i)) for i in range(k)]
    return reduce(DataFrame.unionByName, parts).select(fold, target, "prediction")


def cross_validate(df: DataFrame, fold: str, k: int, learner: str, features: list[str], target: str, scales: bool = False, **params) -> DataFrame:
    """(fold, r2, rmse, smape, medape), with scales (fold, scale, ...): one fit for each fold, their predictions together."""
    together = predicted(df, fold, k, learner, features, target, **params).persist()  # read for sums and for medians
    return both_scales(together, [fold], target, "prediction") if scales else metrics_by(together, [fold], target, "prediction")


def drawn(space: dict, trial: int, seed: int) -> dict:
    """Parameters of a trial, the same whenever it is drawn. A space has, by name, a list of values, (low, high) of whole or real
    numbers, ("log", low, high), or {"of": one of these, "when": {name: values}} for a parameter that only such trials have, its
    conditions named before it."""
    rng, out = Random(f"{seed}|{trial}"), {}
    for name, of in space.items():
        if isinstance(of, dict):
            if any(out.get(n) not in values for n, values in of["when"].items()):
                continue
            of = of["of"]
        if isinstance(of, list):
            out[name] = rng.choice(of)
        elif of[0] == "log":
            out[name] = math.exp(rng.uniform(math.log(of[1]), math.log(of[2])))
        else:
            out[name] = rng.randint(*of) if isinstance(of[0], int) and isinstance(of[1], int) else rng.uniform(*of)
    return out


TRIAL = "trial int, params map<string,string>, folds int, objective double, error string"


def search(df: DataFrame, fold: str, k: int, learner: str, features: list[str], target: str, space: dict, trials: int, seed: int = 1, parallel: int = 4, store: str | None = None) -> DataFrame:
    """(trial, params, folds, objective, error): mean R2 over folds; a failed trial gets minus infinity and its error's name.

    The fold table is stored once. Trials run side by side, `parallel` at a time, in threads with a scheduler pool each. All see the first
    fold; then the worse half stops there (folds is 1), whatever the order in which trials ended, and the others go on to all k. A parameter
    `learner` chooses the learner. With `store`, a folder, each trial is appended to it as JSON when it ends.
    """
    spark = df.sparkSession
    df = df.persist()

    def fold_score(params: dict, i: int) -> float:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{threading.get_ident() % parallel}")
        own = {n: v for n, v in params.items() if n != "learner"}
        rows = fit(df.where(F.col(fold) != i), params.get("learner", learner), features, target, **own).transform(df.where(F.col(fold) == i))
        got = rows.agg(r2(target, "prediction").alias("v")).first()["v"]
        return float("-inf") if got is None else float(got)

    def run(work: tuple[int, dict, list[float], range]) -> tuple:
        trial, params, before, folds = work
        try:
            scores, error = before + [fold_score(params, i) for i in folds], None
        except Exception as e:  # a trial's failure is a result of the search
            scores, error = [float("-inf")], type(e).__name__
        return trial, params, scores, error

    def ended(done: list[tuple]) -> list[tuple]:
        rows = [(t, {a: str(b) for a, b in p.items()}, len(s) if e is None else 0, sum(s) / len(s), e) for t, p, s, e in done]
        if store and rows:
            spark.createDataFrame(rows, TRIAL).coalesce(1).write.mode("append").json(store)
        return rows

    try:
        with ThreadPoolExecutor(parallel) as pool:
            go = inheritable_thread_target(spark)(run) if parallel > 1 else run
            first = list(pool.map(go, [(t, drawn(space, t, seed), [], range(1)) for t in range(trials)]))
            good = sorted((x for x in first if x[3] is None), key=lambda x: (-x[2][0], x[0]))[: -(-trials // 2)] if k > 1 else []
            kept = {x[0] for x in good}
            rows = ended([x for x in first if x[0] not in kept])
            for future in as_completed([pool.submit(go, (t, p, s, range(1, k))) for t, p, s, _ in good]):
                rows += ended([future.result()])
    finally:
        df.unpersist()
    return spark.createDataFrame(sorted(rows), TRIAL)


def sweep(df: DataFrame, fold: str, k: int, target: str, configurations: list[dict]) -> DataFrame:
    """(run, learner, features, error, metrics of cross-validation) of each configuration {learner, features, **params}; failures are kept apart.

    The fold table is written once, and a configuration's predictions until its metrics are known.
    """
    rows = []
    with stored(df) as folds:
        for c in configurations:
            params = {n: v for n, v in c.items() if n not in ("learner", "features")}
            name = "_".join([c["learner"], str(len(c["features"])), *[f"{n}{v}" for n, v in params.items()]])
            try:
                with stored(predicted(folds, fold, k, c["learner"], c["features"], target, **params)) as together:
                    m = metrics_by(together, [fold], target, "prediction").agg(*[F.avg(x) for x in ("r2", "rmse", "smape", "medape")]).first()
                rows.append((name, c["learner"], len(c["features"]), None, *m))
            except Exception as e:  # one configuration's failure must not end the others
                rows.append((name, c["learner"], len(c["features"]), type(e).__name__, None, None, None, None))
    return df.sparkSession.createDataFrame(rows, "run string, learner string, features int, error string, r2 double, rmse double, smape double, medape double")
