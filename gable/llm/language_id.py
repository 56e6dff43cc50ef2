"""Language identification in two steps: the family first, then one-versus-one linear SVMs between its languages.

Texts become square roots of hashed letter 1- to 3-gram counts, scaled to length one. Every classifier (between two
families, or between two languages of one family) is a linear support vector machine; each trains in its own task on a
bounded sample, and the weights, whose size is bounded by the parameters, are shipped to the tasks that score.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gable.llm.common import map_arrow, ready, written

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
#: Weights of a classifier, training texts of a language at most, passes over the sample.
WIDTH, SAMPLE, PASSES = 8192, 400, 12
UNKNOWN = "und"

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def family_of(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    """The family that lists the language, else the language itself."""
    return next((f for f, ls in families.items() if lang.lower().split("-")[0] in ls), lang)


def letters(text: str | None) -> np.ndarray:
    """Code points in lower case; each stretch of others is one 32; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint32)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(c, 0xFFFF)
    is_letter = _LETTER[low]
    if (c > 0xFFFF).any():
        is_letter = np.where(c > 0xFFFF, np.array([chr(x).isalpha() if x > 0xFFFF else False for x in c.tolist()]), is_letter)
    if not is_letter.any():
        return np.empty(0, np.uint32)
    c = np.where(is_letter, c, 32).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    return np.concatenate([[32], c[keep], [32]]).astype(np.uint32)


def features(text: str | None, width: int = WIDTH) -> np.ndarray | None:
    """float32[width] of length one, or None if the text has no letter."""
    c = letters(text)
    if not len(c):
        return None
    shift = np.uint32(32 - int(width).bit_length() + 1)
    with np.errstate(over="ignore"):
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ (one[2:] >> np.uint32(5))) * np.uint32(0xC2B2AE35) + one[2:] if len(c) > 2 else two[:0]
        idx = np.concatenate([((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift for x in (one[1:-1], two, three)])
    x = np.sqrt(np.bincount(idx, minlength=width).astype(np.float32))
    return x / np.sqrt(x @ x)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, passes: int = PASSES) -> np.ndarray:
    """Weights and bias of a linear SVM with hinge loss, by dual coordinate descent in a fixed order."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    q = np.einsum("ij,ij->i", x, x)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / q[i], 0), cost * share[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def bucket_of(ident: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks held-out documents."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(5))


class LanguageModel:
    """Weights by classifier (kind, and the two names); languages by family."""

    def __init__(self, families: dict[str, list[str]], weights: dict[tuple[str, str, str], np.ndarray]):
        self.families, self.weights = families, weights

    def decide(self, kind: str, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner among names by one-versus-one votes (margins break ties) and how sure it is, for each row of x."""
        if len(names) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        votes, margins, least = np.zeros((len(x), len(names))), np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        for a, b in combinations(range(len(names)), 2):
            w = self.weights[kind, names[a], names[b]]
            m = x @ w[:-1] + w[-1]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            for k, s in ((a, m), (b, -m)):
                margins[:, k] += np.tanh(s)
                least[:, k] = np.minimum(least[:, k], s)
        best = np.argmax(votes + margins / (2 * len(names)), axis=1)
        return best, 1 / (1 + np.exp(-2 * least[np.arange(len(x)), best]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.families:
            return langs, scores
        groups = sorted(self.families)
        for at in range(0, len(texts), 256):
            rows = [(i, f) for i in range(at, min(at + 256, len(texts))) if (f := features(texts[i])) is not None]
            if not rows:
                continue
            x = np.stack([f for _, f in rows])
            fam, sure = self.decide("family", x, groups)
            for g, name in enumerate(groups):
                of = np.flatnonzero(fam == g)
                if len(of):
                    inner = self.families[name]
                    lang, more = self.decide("lang", x[of], inner)
                    for k, l, s in zip(of, lang, more):
                        langs[rows[k][0]], scores[rows[k][0]] = inner[l], float(sure[k] * s)
        return langs, scores


def fit(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
    """Learn from rows with a language whose bucket_of(ident) is not 0, at most SAMPLE texts of each language.

    The sample of a language is the rows with the smallest hashes of id and text, so it is the same for every
    partitioning; rows that repeat both count once. Every language is learned of which a sampled text has a letter; rows with
    a null id, text or language teach nothing. Without labelled rows the model knows no language.
    """
    spark = ready(docs.sparkSession)
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (bucket_of(F.col(ident)) != 0))
    usable = usable.select(F.col(lang).alias("_lang"), F.xxhash64(F.col(ident).cast("string"), F.col(text)).alias("_h"), F.col(text).alias("_t"))
    grid = 1 << 30
    place = F.pmod("_h", F.lit(grid))
    counts = usable.groupBy("_lang").agg((F.lit(grid * 1.5 * (SAMPLE + 50)) / F.count(F.lit(1))).alias("_share"))
    # one row a language: as many as the model holds weights for
    drawn = usable.select("_lang", "_h").join(F.broadcast(counts), "_lang").where(place < F.col("_share")).select("_lang", "_h").distinct()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(place, "_h"))  # some hundred rows of each language
    picked = written(drawn.withColumn("_n", rank).where(F.col("_n") <= SAMPLE).select("_lang", "_h"))
    sample = usable.join(picked, ["_lang", "_h"], "left_semi").dropDuplicates(["_lang", "_h"])

    def extracted(batch: pa.RecordBatch) -> pa.RecordBatch:
        fs = [features(t) for t in batch.column("_t").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_lang"), pa.array([None if f is None else f.tobytes() for f in fs], pa.binary())], names=["_h", "_lang", "_x"])

    vectors = written(map_arrow(sample, extracted, "_h long, _lang string, _x binary").where("_x is not null"))
    grouped: dict[str, list[str]] = {}
    for l in sorted(r["_lang"] for r in vectors.select("_lang").distinct().collect()):
        grouped.setdefault(family_of(l, families), []).append(l)
    jobs = [(a, b, "family") for a, b in combinations(sorted(grouped), 2)] + [(a, b, "lang") for ls in grouped.values() for a, b in combinations(ls, 2)]
    if not jobs:
        return LanguageModel(grouped, {})
    sides = {}
    for k, (a, b, kind) in enumerate(jobs):
        for name, sign in ((a, 1), (b, -1)):
            for l in grouped[name] if kind == "family" else [name]:
                sides.setdefault(l, []).append((k, sign))
    plan = spark.createDataFrame([(l, k, s) for l, v in sides.items() for k, s in v], "_lang string, job int, y int")

    def train(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_h")
        w = fit_svm(np.stack([np.frombuffer(b, np.float32) for b in pdf["_x"]]), pdf["y"].to_numpy(float))
        return pd.DataFrame({"job": [int(pdf["job"].iloc[0])], "w": [w.astype(np.float32).tobytes()]})

    fitted = vectors.join(F.broadcast(plan), "_lang").groupBy("job").applyInPandas(train, "job int, w binary").collect()
    return LanguageModel(grouped, {(jobs[r["job"]][2], *jobs[r["job"]][:2]): np.frombuffer(r["w"], np.float32) for r in fitted})


def identified(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", families: dict[str, tuple[str, ...]] = FAMILIES, model: LanguageModel | None = None) -> DataFrame:
    """One row per row of docs: ident, held_out, lang_pred, score (0 to 1).

    lang_pred is a learned language, or `und` with score 0 for a text that is null or has no letter (or if nothing could
    be learned). Whole texts are read; labels, ids and other columns play no part in a prediction. A null id is not
    held out and teaches nothing; rows that repeat repeat. An empty table gives an empty one.
    """
    model = model or fit(docs, ident, text, lang, families)
    kind = docs.schema[ident].dataType.simpleString()

    def predicted(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = model.predict(batch.column("_t").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[ident, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(bucket_of(F.col(ident)) == 0, F.lit(False)).alias("held_out"), F.col(text).alias("_t"))
    return map_arrow(rows, predicted, f"`{ident}` {kind}, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose text was given a language; those without a letter or text go.

    If no language could be learned, all texts with a letter stay. Ids may be null or repeat; an empty table gives an
    empty one.
    """
    model = fit(docs, ident, text, lang)
    names = docs.columns

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column(names.index(text)).to_pylist()
        known = [l != UNKNOWN for l in model.predict(texts)[0]] if model.families else [len(letters(t)) > 0 for t in texts]
        out = batch.filter(pa.array(known))
        return out if out.num_rows else None

    return map_arrow(docs, kept, docs.schema)
