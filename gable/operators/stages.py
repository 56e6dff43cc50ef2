"""Spark ML stages that the library lacks: a linear support-vector regressor with squared loss, and TF-IDF weights of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable.functions.text import tokens
from gable.operators.store import written
from gable.operators.vectors import ngrams, term_counts, tfidf_apply, tfidf_fit


class _Writer(MLWriter):
    """Metadata with the model's facts."""

    def __init__(self, model: _Stored):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.active(), extraMetadata={"facts": self.model.facts()})


class _Reader(MLReader):
    def __init__(self, kind: type[_Stored]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _Stored:
        got = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        model = self.kind(**got["facts"])
        model._resetUid(got["uid"])
        return model


class _Stored(Model, MLWritable, MLReadable):
    """A model whose state is small, so that it is kept with its metadata, alone or in a PipelineModel."""

    def facts(self) -> dict:
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def load(cls, path: str) -> _Stored:
        return cls.read().load(path)


class LinearSVR(Estimator):
    """Minimises |w|^2 / 2 + c * sum(max(0, |y - w x| - epsilon)^2), where x ends in a 1 for the intercept.

    Newton's method over the rows outside the tube: each step is one aggregation of X'X and X'y over them, a system of the
    number of features that the driver solves, and one pass that tries eight lengths of the step. The loss is convex and
    piecewise quadratic, so a few steps reach the optimum; after maxIter steps without it a RuntimeError is raised.
    """

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", c: float = 1.0, epsilon: float = 0.0, maxIter: int = 50, tol: float = 1e-9):
        super().__init__()
        self.columns, self.c, self.epsilon, self.max_iter, self.tol = (featuresCol, labelCol, predictionCol), float(c), float(epsilon), maxIter, tol

    def _sums(self, rows: DataFrame, fn, size: int) -> np.ndarray:
        """fn(X, y) -> size numbers, summed over all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    total += fn(np.column_stack([x, np.ones(len(x))]), batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        each = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
        out = np.zeros(size)
        for r in each.groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    def _fit(self, dataset: DataFrame) -> LinearSVRModel:
        features, label, prediction = self.columns
        c, eps = self.c, self.epsilon
        rows = dataset.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).where("y is not null").persist()
        try:
            first = rows.first()
            if first is None:
                return LinearSVRModel([], 0.0, features, prediction)
            d = len(first["x"]) + 1
            w = np.zeros(d)
            for _ in range(self.max_iter):

                def step(x: np.ndarray, y: np.ndarray, w=w) -> np.ndarray:
                    r = y - x @ w
                    out = np.abs(r) > eps
                    a, b = x[out], r[out] - np.sign(r[out]) * eps
                    return np.concatenate([(a.T @ a).ravel(), a.T @ b, [b @ b]])

                got = self._sums(rows, step, d * d + d + 1)
                gradient = w - 2 * c * got[d * d : -1]
                if np.abs(gradient).max() <= self.tol * max(1.0, 2 * c * np.abs(got[d * d : -1]).max()):
                    return LinearSVRModel(w[:-1].tolist(), float(w[-1]), features, prediction)
                move = np.linalg.solve(np.eye(d) + 2 * c * got[: d * d].reshape(d, d), -gradient)
                lengths = 0.5 ** np.arange(8)

                def losses(x: np.ndarray, y: np.ndarray, w=w, move=move, lengths=lengths) -> np.ndarray:
                    r = (y - x @ w)[:, None] - (x @ move)[:, None] * lengths
                    return (np.maximum(0.0, np.abs(r) - eps) ** 2).sum(axis=0)

                tried = self._sums(rows, losses, len(lengths)) * c + [(w + t * move) @ (w + t * move) / 2 for t in lengths]
                best = int(tried.argmin())
                now = c * got[-1] + w @ w / 2
                if tried[best] >= now - 1e-14 * abs(now):  # no step is better: rounding
                    return LinearSVRModel(w[:-1].tolist(), float(w[-1]), features, prediction)
                w = w + lengths[best] * move
        finally:
            rows.unpersist()
        raise RuntimeError(f"no optimum after {self.max_iter} steps")


class LinearSVRModel(_Stored):
    def __init__(self, coefficients: list[float], intercept: float, features: str, prediction: str):
        super().__init__()
        self.coefficients, self.intercept, self.features, self.prediction = coefficients, intercept, features, prediction

    def facts(self) -> dict:
        return {"coefficients": self.coefficients, "intercept": self.intercept, "features": self.features, "prediction": self.prediction}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = F.zip_with(vector_to_array(self.features), F.array(*map(F.lit, self.coefficients)).cast("array<double>"), lambda x, w: x * w)
        return dataset.withColumn(self.prediction, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) + F.lit(self.intercept))


class TermWeights(Estimator):
    """TF-IDF vectors of a text column: tfidf_fit() gives the vocabulary, at most maxFeatures terms, which the model holds.

    Needs an ident column to count documents by. A text without a known term has the zero vector; null texts count as empty.
    With maxFeatures None the vocabulary has all terms within the bounds and stays a table: see TermTableModel.
    """

    def __init__(self, inputCol: str, outputCol: str, identCol: str = "id", maxFeatures: int | None = 4096, low: int = 1, high: int = 1, minDF: int = 1, maxDF: float = 1.0, sublinear: bool = False, norm: str | None = "l2"):
        super().__init__()
        self.args = {"text": inputCol, "out": outputCol, "low": low, "high": high, "sublinear": sublinear, "norm": norm}
        self.ident, self.bounds = identCol, (minDF, maxDF, maxFeatures)

    def _fit(self, dataset: DataFrame) -> TermWeightsModel | TermTableModel:
        counts = term_counts(dataset, self.ident, self.args["text"], self.args["low"], self.args["high"])
        fitted = tfidf_fit(counts, dataset.count(), *self.bounds)
        if self.bounds[2] is None:
            return TermTableModel(written(fitted), ident=self.ident, **self.args)
        rows = fitted.orderBy("term").collect()  # maxFeatures rows
        return TermWeightsModel([r["term"] for r in rows], [r["idf"] for r in rows], **self.args)


class TermWeightsModel(_Stored):
    """Counts of known terms as sparse vectors (dense ones if sublinear), times their inverse document frequencies, normed: no row is shuffled."""

    def __init__(self, terms: list[str], idf: list[float], text: str, out: str, low: int, high: int, sublinear: bool, norm: str | None):
        super().__init__()
        self.terms, self.idf = terms, idf
        self.text, self.out, self.low, self.high, self.sublinear, self.norm = text, out, low, high, sublinear, norm

    def facts(self) -> dict:
        return {n: getattr(self, n) for n in ("terms", "idf", "text", "out", "low", "high", "sublinear", "norm")}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words, counts, weights = (f"_{n}_{self.uid}" for n in ("words", "counts", "weights"))
        out = dataset.withColumn(words, ngrams(tokens(F.col(self.text)), self.low, self.high))
        if not self.terms:
            return out.withColumn(self.out, array_to_vector(F.array().cast("array<double>"))).drop(words)
        out = CountVectorizerModel.from_vocabulary(self.terms, inputCol=words, outputCol=counts).transform(out)
        if self.sublinear:  # no stage takes logarithms, so these counts pass through an array
            logs = F.transform(vector_to_array(counts), lambda x: F.when(x > 0, 1.0 + F.log(x)).otherwise(0.0))
            out = out.withColumn(counts, array_to_vector(logs))
        out = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol=counts, outputCol=weights).transform(out)
        if self.norm:
            out = Normalizer(p=float(self.norm[1:]), inputCol=weights, outputCol=self.out).transform(out)
        else:
            out = out.withColumn(self.out, F.col(weights))
        return out.drop(words, counts, weights)


class TermTableModel(_Stored):
    """A vocabulary of any size as a table (term, idf), kept beside the metadata. The output column has each text's terms with their
    weights, array<struct<term, weight>> by term, as such a vocabulary has no dense numbering; texts without a known term have an empty one.

    Texts are joined with the table by term and come back by ident, which must not repeat.
    """

    def __init__(self, table: DataFrame, ident: str, text: str, out: str, low: int, high: int, sublinear: bool, norm: str | None):
        super().__init__()
        self.table, self.ident = table, ident
        self.text, self.out, self.low, self.high, self.sublinear, self.norm = text, out, low, high, sublinear, norm

    def facts(self) -> dict:
        return {n: getattr(self, n) for n in ("ident", "text", "out", "low", "high", "sublinear", "norm")}

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = tfidf_apply(term_counts(dataset, self.ident, self.text, self.low, self.high), self.table, self.ident, self.sublinear, self.norm)
        key, own = (f"_{n}_{self.uid}" for n in ("key", "own"))
        lists = weights.groupBy(F.col(self.ident).alias(key)).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias(own))
        none = F.array().cast("array<struct<term:string,weight:double>>")
        return dataset.join(lists, F.col(self.ident) == F.col(key), "left").withColumn(self.out, F.coalesce(own, none)).drop(key, own)


class _TableWriter(_Writer):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.model.table.write.parquet(f"{path}/terms")


class _TableReader(_Reader):
    def load(self, path: str) -> TermTableModel:
        got = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        model = self.kind(SparkSession.active().read.schema("term string, idf double").parquet(f"{path}/terms"), **got["facts"])
        model._resetUid(got["uid"])
        return model
