"""Terms, weights and vectors in long tables: lemmas, TF-IDF, pooling, gates, importance of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gable.functions.text import bound, tokens
from gable.operators.order import quantile_row, top_of
from gable.operators.store import written


def lemmatise(df: DataFrame, lemmas: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, text): each token replaced by its lemma (token, lemma), where there is one. The dictionary is broadcast only under Spark's limit."""
    t = df.select(ident, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), " ")).alias("pos", "token"))
    t = t.join(lemmas, "token", "left").select(ident, F.struct("pos", F.coalesce("lemma", "token").alias("w")).alias("x"))
    return t.groupBy(ident).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), " ").alias(text))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of an array of words, joined by spaces."""
    none = F.array().cast("array<string>")
    of = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)
    return bound(words, lambda w: F.concat(*[w if n == 1 else of(w, n) for n in range(low, high + 1)]))


def term_counts(df: DataFrame, ident: str, text: str, low: int = 1, high: int = 1, only: DataFrame | None = None) -> DataFrame:
    """(ident, term, tf), of the terms in `only` if given, a table that is broadcast. Texts are dealt by ident, which is all the shuffling that counts and norms by ident need."""
    if only is None:
        dealt = df.select(ident, text).repartition(ident)
        terms = dealt.select(ident, F.explode(ngrams(tokens(F.col(text)), low, high)).alias("term"))
    else:  # few rows are left, so they are dealt, not the texts
        terms = df.select(ident, F.explode(ngrams(tokens(F.col(text)), low, high)).alias("term")).join(F.broadcast(only.select("term")), "term", "leftsemi")
    return terms.groupBy(ident, "term").agg(F.count(F.lit(1)).alias("tf"))


def top_term_counts(df: DataFrame, ident: str, text: str, low: int, high: int, documents: int, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """(ident, term, tf) of frequent terms, among them all that tfidf_fit() with these bounds would choose.

    Occurrences are counted first; only the most frequent terms are counted by ident. If the bounds leave fewer than max_features
    of them, more are looked at, until they do or there are no more terms.
    """
    totals = df.select(F.explode(ngrams(tokens(F.col(text)), low, high)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    most = 2 * max_features + 100
    while True:
        first = written(totals.orderBy(F.desc("total"), "term").limit(most))
        counts = written(term_counts(df, ident, text, low, high, first))
        if first.count() < most or tfidf_fit(counts, documents, min_df, max_df).count() >= max_features:
            return counts
        most *= 4


def tfidf_fit(counts: DataFrame, documents: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, idf): smooth inverse document frequency of terms within bounds; the most frequent max_features, ties by term."""
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * documents)))
    if max_features:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return terms.select("term", (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf_apply(counts: DataFrame, fitted: DataFrame, ident: str, sublinear: bool = False, norm: str | None = "l2") -> DataFrame:
    """(ident, term, weight)."""
    tf = 1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")
    w = counts.join(fitted, "term").select(ident, "term", (tf * F.col("idf")).alias("w"))
    if norm is None:
        return w.withColumnRenamed("w", "weight")
    own = W.partitionBy(ident)  # the terms of one document
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(own)) if norm == "l2" else F.sum(F.abs("w")).over(own)
    return w.select(ident, "term", (F.col("w") / size).alias("weight"))


def vector_pool(df: DataFrame, key: str, vector: str, dims: int, how: str = "avg") -> DataFrame:
    """(key, vector): mean, sum or max by dimension, as one aggregate for each dimension; groups without vectors get zeros."""
    fn = {"avg": F.avg, "sum": F.sum, "max": F.max}[how]
    parts = [F.coalesce(fn(F.col(vector)[i].cast("double")), F.lit(0.0)) for i in range(dims)]
    return df.groupBy(key).agg(F.array(*parts).alias(vector))


def masked_pool(df: DataFrame, doc: str, how: str) -> DataFrame:
    """(doc, dim, value) of a long table (doc, pos, mask, score, dim, v): first, mean, max or softmax-weighted over unmasked positions."""
    live = df.where("mask = 1")
    if how == "first":
        return live.groupBy(doc, "dim").agg(F.min_by("v", "pos").alias("value"))
    if how in ("avg", "max"):
        return live.groupBy(doc, "dim").agg((F.avg("v") if how == "avg" else F.max("v")).alias("value"))
    top = live.groupBy(doc).agg(F.max("score").alias("top"))
    e = live.join(top, doc).withColumn("e", F.exp(F.col("score") - F.col("top")))
    return e.groupBy(doc, "dim").agg((F.sum(F.col("e") * F.col("v")) / F.sum("e")).alias("value"))


def gate(df: DataFrame, ident: str, dim: str = "dim", value: str = "v", share: float = 0.7, hard: bool = True, temperature: float = 1.0) -> DataFrame:
    """(ident, dim, value): hard gates keep values from the share's quantile on whole, from half of it on with weight 0.2; soft ones weigh by a sigmoid."""
    q = df.groupBy(ident).agg(F.percentile(F.abs(value), F.lit(share)).alias("edge"))
    a, edge = F.abs(F.col(value)), F.col("edge")
    mask = F.when(a >= edge, 1.0).when(a >= edge / 2, 0.2).otherwise(0.0) if hard else 1 / (1 + F.exp(-(a - edge) / temperature))
    return df.join(q, ident).select(ident, dim, (F.col(value) * mask).alias("value"))


def top_features(df: DataFrame, n: int, low: int = 1, high: int = 1) -> DataFrame:
    """The n terms (term, weight) of the largest absolute weight among n-grams of the given lengths; ties by term."""
    return df.where(F.size(F.split("term", " ")).between(low, high)).orderBy(F.desc(F.abs("weight")), "term").limit(n)


def merged_subwords(df: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, word, weight): tokens that begin with ## continue the word before; weights are averaged. Input: (doc, pos, token, weight)."""
    start = (~F.col("token").startswith("##")).cast("int")
    at = df.withColumn("k", F.sum(start).over(W.partitionBy(doc).orderBy("pos")))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("token", "^##", "").alias("t"))))
    return at.groupBy(doc, "k").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("word"), F.avg("weight").alias("weight")).drop("k")


def token_importance(df: DataFrame, least: int = 20, top: int = 30, doc: str = "doc") -> DataFrame:
    """(word, n, weight): words of four letters or more, no specials and no numbers, that occur more than `least` times, the heaviest `top`."""
    w = merged_subwords(df, doc).where((F.length("word") >= 4) & ~F.col("word").rlike(r"\d") & ~F.col("word").startswith("["))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight")).where(F.col("n") > least).orderBy(F.desc(F.round("weight", 9)), "word").limit(top)


def doc_top_tokens(df: DataFrame, n: int, least: int = 4, doc: str = "doc") -> DataFrame:
    """(doc, place, token, share): the n positions of the largest masked softmax score, ## stripped, then those of `least` letters."""
    live = df.where("mask = 1")
    top = live.groupBy(doc).agg(F.max("score").alias("top"))
    e = live.join(top, doc).withColumn("e", F.exp(F.col("score") - F.col("top")))
    total = e.groupBy(doc).agg(F.sum("e").alias("total"))
    share = e.join(total, doc).withColumn("share", F.col("e") / F.col("total"))
    ranked = share.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy(F.desc("score"), "pos"))).where(F.col("place") <= n)
    return ranked.withColumn("token", F.regexp_replace("token", "^##", "")).where(F.length("token") >= least).select(doc, "place", "token", "share")


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    """One row: mean, std, min, max and quartiles."""
    out = df.agg(F.avg(length).alias("mean"), F.stddev_pop(length).alias("std"), F.min(length).alias("min"), F.max(length).alias("max"))
    out = out.join(F.broadcast(quantile_row(df, {"q": length}, [0.25, 0.5, 0.75])))
    return out.select("mean", "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def segment_terms(df: DataFrame, value: str, text: str, top: int = 100) -> DataFrame:
    """(segment, term, n, place): most frequent terms of the cheapest tenth, the middle (median ± 10 %) and the dearest tenth."""
    edges = quantile_row(df, {"q": F.col(value)}, [0.1, 0.9, 0.5]).withColumn("m", F.col("q")[2])
    v = F.col(value)
    segment = F.when(v <= F.col("q")[0], "low").when(v >= F.col("q")[1], "high").when((v >= 0.9 * F.col("m")) & (v <= 1.1 * F.col("m")), "middle")
    terms = df.join(F.broadcast(edges)).withColumn("segment", segment).where("segment is not null").select("segment", F.explode(tokens(F.col(text))).alias("term"))
    counts = terms.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("n"))
    return top_of(counts, ["segment"], [F.desc("n"), F.asc("term")], top, "term")


def centred_pca(df: DataFrame, vector: str, k: int, dims: int) -> DataFrame:
    """df with `pca`: the first min(k, dims) principal components of the mean-centred vectors (Spark ML)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    return PCA(k=min(k, dims), inputCol="_c", outputCol="_p").fit(centred).transform(centred).withColumn("pca", vector_to_array("_p")).drop("_v", "_c", "_p")


#: Letters of text that one task of word_vectors() learns from, about five million words.
SHARE = 32_000_000


def word_vectors(df: DataFrame, text: str, size: int = 16, window: int = 5, least: int = 5, epochs: int = 1, seed: int = 1, share: int = SHARE):
    """A fitted Word2Vec model (skip-gram) over the tokens of a text column; its transform() averages a document's words.

    Texts of up to `share` letters are learned by one task, more by one for each share, side by side: in every epoch each
    learns all words of its share from the same start, and a word's vectors are averaged over the tasks that met it.
    """
    from pyspark.ml.feature import Word2Vec

    words = df.withColumn("words", tokens(F.col(text)))
    letters = df.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    tasks = max(1, -(-int(letters) // share))
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=epochs, seed=seed, numPartitions=tasks, inputCol="words", outputCol="vector").fit(words), words
