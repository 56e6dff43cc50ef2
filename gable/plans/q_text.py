"""Queries: texts, terms and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gable.functions import text as T
from gable.operators import vectors as V
from gable.plans.base import Book, L, rounded, table

book = Book()

AD = """, ad AS (SELECT id, 'Дом ' || CAST(20 + id % 380 AS VARCHAR) || CASE id % 3 WHEN 0 THEN ' кв.м ' WHEN 1 THEN ' м2 ' ELSE ' кв м ' END || CAST(4 + id % 5 AS VARCHAR) || 'x' || CAST(8 + id % 3 AS VARCHAR)
 || ', участок ' || CAST(id % 30 AS VARCHAR) || ' сот. Цена ' || CAST(id % 90 + 1 AS VARCHAR) || ' млн руб! Тел №' || CAST(id AS VARCHAR) || '. Торг ±' || CAST(id % 7 AS VARCHAR) || '%?? '
 || CASE id % 4 WHEN 0 THEN 'Рядом ж/д, снт Лесное 😀→' WHEN 1 THEN CAST(1 + id % 5 AS VARCHAR) || '-й этаж, ' || CAST(1 + id % 9 AS VARCHAR) || ' ' || CAST(100 + id % 900 AS VARCHAR) || ' 000 в год..'
  WHEN 2 THEN 'место 55,' || CAST(749033 + id % 1000 AS VARCHAR) || ', 38,328731, лес' ELSE 'Есть:' || chr(10) || 'свет_газ|вода' END AS t FROM listings)"""


def ads(d):
    k, s = F.col("id"), lambda c: c.cast("string")
    c = F.concat
    high = c(s(1 + k % 5), F.lit("-й этаж, "), s(1 + k % 9), F.lit(" "), s(100 + k % 900), F.lit(" 000 в год.."))
    place = c(F.lit("место 55,"), s(749033 + k % 1000), F.lit(", 38,328731, лес"))
    tail = F.when(k % 4 == 0, "Рядом ж/д, снт Лесное 😀→").when(k % 4 == 1, high).when(k % 4 == 2, place).otherwise("Есть:\nсвет_газ|вода")
    metres = F.when(k % 3 == 0, " кв.м ").when(k % 3 == 1, " м2 ").otherwise(" кв м ")
    parts = [F.lit("Дом "), s(20 + k % 380), metres, s(4 + k % 5), F.lit("x"), s(8 + k % 3), F.lit(", участок "), s(k % 30), F.lit(" сот. Цена "), s(k % 90 + 1), F.lit(" млн руб! Тел №"), s(k), F.lit(". Торг ±"), s(k % 7), F.lit("%?? "), tail]
    return d.select("id", c(*parts).alias("t"))


def on_ads(name, step, sql=None):
    book.on_listings(name, lambda d: ads(d).select("id", step(F.col("t")).alias("t")), f"{L}{AD} {sql}" if sql else None)


def rep(x, *pairs):
    for a, b in pairs:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


ABOUT = f"regexp_matches(s, '[0-9]') AND (regexp_matches(s, '{'|'.join(T.PRICE_WORDS)}') OR regexp_matches(s, '[0-9]\\s*({'|'.join(T.MONEY_UNITS)})'))"
on_ads("price_sentences", T.without_price_sentences, f"SELECT id, array_to_string(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: NOT ({ABOUT})), ' ') AS t FROM ad")
on_ads("strip_emoji", T.strip_emoji, f"SELECT id, regexp_replace(t, '{T.EMOJI}', '', 'g') AS t FROM ad")
on_ads("line_punct", T.line_punctuation, "SELECT id, trim(regexp_replace(array_to_string(list_transform(string_split_regex(t, '[\\r\\n]+'), lambda s: CASE WHEN regexp_matches(s, '[.!,;?]$') THEN s ELSE s || '.' END), ' '), '\\s+', ' ', 'g')) AS t FROM ad")
on_ads(
    "punct_normalize",
    T.normalize_punctuation,
    f"SELECT id, {rep('trim(' + rep('t', ('[_|]', ' '), ('[!?]+', '.'), ('[.]{2,}', '.'), (',{2,}', ','), ('([a-zA-Z])([0-9])', '\\1 \\2'), ('([0-9])([a-zA-Z])', '\\1 \\2'), ('(\\S)-', '\\1 -'), ('-(\\S)', '- \\1'), ('\\s+', ' ')) + ')', ('[\\\\/]{2,}', '/'))} AS t FROM ad",
)
on_ads(
    "number_normalize",
    T.normalize_numbers,
    f"SELECT id, {rep('t', ('([0-9]) ([0-9]{3}) (000) ', '\\1\\2\\3 '), ('([0-9]+),([0-9]+), ([0-9]+),([0-9]+)', '\\1.\\2, \\3.\\4'), ('[!?]', '.'), ('[.]{2,}', '.'), (',{2,}', ','))} AS t FROM ad",
)
on_ads("symbol_words", T.symbol_words, f"SELECT id, trim({rep('t', ('(\\S)%', '\\1 процент'), ('№', 'номер '), ('±', 'примерно '), ('\\s+', ' '))}) AS t FROM ad")
on_ads("sqm_unit", T.square_metres, "SELECT id, regexp_replace(t, '^(Дом [0-9]+) (кв[.]м|м2|кв м) ', '\\1 м² ') AS t FROM ad")
on_ads("dimensions", T.dimensions, "SELECT id, regexp_replace(t, '([0-9])x([0-9])', '\\1 на \\2') AS t FROM ad")
on_ads("amount_words", T.amount_words, "SELECT id, replace(t, 'Цена ' || CAST(id % 90 + 1 AS VARCHAR) || ' млн', 'Цена ' || CAST((id % 90 + 1) * 1000000 AS VARCHAR)) AS t FROM ad")
on_ads("expand_abbrev", T.expand_abbreviations)
on_ads("expand_units", T.expand_units)
on_ads("ordinals", T.ordinals)
on_ads("final_clean", T.final_clean)
on_ads("text_pipeline", lambda c: T.process(c, stop=True, punctuation=True))

STOP = ["the", "and", "der", "die", "de", "la", "le", "el", "of"]
doc = lambda s, d: table(s, d, "documents")
book.add("stopwords", f"SELECT doc_id, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: NOT list_contains([{', '.join(map(repr, STOP))}], lower(w))), ' ') AS text FROM documents")(
    lambda s, d: doc(s, d).select("doc_id", T.without_stop_words(F.coalesce("text", F.lit("")), STOP).alias("text"))
)
LEMMAS = [("the", "a"), ("and", "&"), ("der", "die"), ("les", "le"), ("des", "de"), ("los", "el")]
book.add(
    "lemma_dict",
    f"WITH m(token, lemma) AS (VALUES {', '.join(map(str, LEMMAS))}), t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS token, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS pos FROM documents) SELECT doc_id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS text FROM t LEFT JOIN m USING (token) GROUP BY doc_id",
)(lambda s, d: V.lemmatise(doc(s, d), s.createDataFrame(LEMMAS, "token string, lemma string"), "doc_id", "text"))
book.add("strip_punct", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")(lambda s, d: doc(s, d).select("doc_id", T.strip_punctuation(F.col("text")).alias("text")))
TOK = f"list_filter(regexp_extract_all(translate(lower(coalesce(text, '')), '{T.ACCENTED}', '{T.PLAIN}'), '\\p{{L}}+'), lambda w: length(w) BETWEEN 2 AND 15)"
book.add("tokenize", f"SELECT doc_id, array_to_string({TOK}, ' ') AS tokens FROM documents")(lambda s, d: doc(s, d).select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens")))

TF = "k AS (SELECT doc_id, {terms} AS ws FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM k) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents)"
IDF = "f AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM c, n GROUP BY term, n HAVING count(*) >= {low} AND count(*) <= {high} * n{more})"
L2 = "w AS (SELECT doc_id, term, {tf} * idf AS w FROM c JOIN f USING (term)), z AS (SELECT doc_id, {norm} AS z FROM w GROUP BY 1) SELECT doc_id, term, round(w / z, 4) AS weight FROM w JOIN z USING (doc_id)"


def tfidf(s, d, low, high, min_df, max_df, features, sublinear, norm):
    n = doc(s, d).count()
    c = V.top_term_counts(doc(s, d), "doc_id", "text", low, high, n, min_df, max_df, features) if features else V.term_counts(doc(s, d), "doc_id", "text", low, high)
    return rounded(V.tfidf_apply(c, V.tfidf_fit(c, n, min_df, max_df, features), "doc_id", sublinear, norm))


book.add("tfidf", "WITH " + ", ".join([TF.format(terms=TOK), IDF.format(low=5, high=0.5, more=""), L2.format(tf="(1.0 + ln(tf))", norm="sqrt(sum(w * w))")]))(lambda s, d: tfidf(s, d, 1, 1, 5, 0.5, None, True, "l2"))
BI = "list_concat(ts, CASE WHEN len(ts) >= 2 THEN list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]) ELSE [] END)"
book.add(
    "tfidf_ngram",
    f"WITH t AS (SELECT doc_id, {TOK} AS ts FROM documents), " + ", ".join([TF.format(terms=BI).replace("FROM documents), c", "FROM t), c"), IDF.format(low=2, high=1.0, more=" ORDER BY sum(tf) DESC, term LIMIT 300"), L2.format(tf="tf", norm="sum(abs(w))")]),
)(lambda s, d: tfidf(s, d, 1, 2, 2, 1.0, 300, False, "l1"))

emb = lambda s, d: table(s, d, "embeddings")
book.add("vector_pool", "SELECT label, dim, round(avg(v), 4) AS mean, round(sum(v), 3) AS sum, round(max(v), 4) AS max FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2")(
    lambda s, d: (lambda one: one("avg", 4).join(one("sum", 3), ["label", "dim"]).join(one("max", 4), ["label", "dim"]).select("label", "dim", F.col("avg").alias("mean"), "sum", "max"))(
        lambda how, k: rounded(V.vector_pool(emb(s, d), "label", "embedding", 64, how).select("label", F.posexplode("embedding").alias("dim", how)).withColumn("dim", (F.col("dim") + 1).cast("long")), k)
    )
)
# the table of tokens: 16 vectors make a document; score and mask come from the id
TOKENS = "x AS (SELECT vec_id // 16 AS doc, vec_id % 16 AS pos, CASE WHEN vec_id % 5 = 4 THEN 0 ELSE 1 END AS mask, CAST((vec_id * 37) % 101 AS DOUBLE) / 25 AS score, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings), l AS (SELECT * FROM x WHERE mask = 1)"


def token_table(s, d):
    k = F.col("vec_id")
    return emb(s, d).select(F.floor(k / 16).alias("doc"), (k % 16).alias("pos"), F.when(k % 5 == 4, 0).otherwise(1).alias("mask"), ((k * 37 % 101).cast("double") / 25).alias("score"), F.posexplode(F.slice("embedding", 1, 8)).alias("dim", "v")).withColumns({"dim": (F.col("dim") + 1).cast("long"), "v": F.col("v").cast("double")})


book.add(
    "masked_pool",
    f"WITH {TOKENS}, m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc)) AS e FROM l) SELECT doc, dim, round(arg_min(v, pos), 4) AS first, round(avg(v), 4) AS mean, round(max(v), 4) AS max, round(sum(e * v) / sum(e), 4) AS soft FROM m WHERE dim <= 8 GROUP BY 1, 2",
)(
    lambda s, d: rounded(
        (lambda t: V.masked_pool(t, "doc", "first").withColumnRenamed("value", "first").join(V.masked_pool(t, "doc", "avg").withColumnRenamed("value", "mean"), ["doc", "dim"]).join(V.masked_pool(t, "doc", "max").withColumnRenamed("value", "max"), ["doc", "dim"]).join(V.masked_pool(t, "doc", "soft").withColumnRenamed("value", "soft"), ["doc", "dim"]))(token_table(s, d))
    )
)
book.add("pca")(lambda s, d: rounded(V.centred_pca(emb(s, d), "embedding", 4, 64).select("vec_id", "pca").select("vec_id", *[F.abs(F.col("pca")[i]).alias(f"p{i}") for i in range(4)]), 3))
book.add(
    "gate_mask",
    "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings), q AS (SELECT vec_id, quantile_cont(abs(v), 0.7) AS e FROM x GROUP BY 1) SELECT vec_id, dim, round(v * CASE WHEN abs(v) >= e THEN 1.0 WHEN abs(v) >= e / 2 THEN 0.2 ELSE 0.0 END, 4) + 0.0 AS value FROM x JOIN q USING (vec_id)",
)(lambda s, d: rounded(V.gate(emb(s, d).select("vec_id", F.posexplode("embedding").alias("dim", "v")).withColumns({"dim": (F.col("dim") + 1).cast("long"), "v": F.col("v").cast("double")}), "vec_id")))
WEIGHT = "CAST((length(term) * 7919 + ascii(term) * 31) % 1009 AS DOUBLE) / 1009 - 0.5"
book.add("top_features", f"WITH t AS (SELECT {TOK} AS ts FROM documents), d AS (SELECT DISTINCT unnest({BI}) AS term FROM t), w AS (SELECT term, {WEIGHT} AS weight FROM d) SELECT term, round(weight, 4) AS weight FROM w WHERE len(string_split(term, ' ')) BETWEEN 2 AND 2 ORDER BY abs(weight) DESC, term LIMIT 50")(
    lambda s, d: rounded(V.top_features(doc(s, d).select(F.explode(V.ngrams(T.tokens(F.col("text")), 1, 2)).alias("term")).distinct().withColumn("weight", F.expr(WEIGHT)), 50, 2, 2))
)
SUB = "CASE WHEN length(w) > 6 THEN [substr(w, 1, 4), '##' || substr(w, 5)] ELSE [w] END"
PIECES = f"""t AS (SELECT doc_id AS doc, {TOK} AS ts FROM documents), s AS (SELECT doc, flatten(list_transform(ts, lambda w: {SUB})) AS ps FROM t),
p AS (SELECT doc, unnest(ps) AS token, generate_subscripts(ps, 1) AS pos FROM s), x AS (SELECT doc, pos, token, CAST((doc * 13 + pos * 7) % 97 AS DOUBLE) / 97 AS weight, CASE WHEN pos % 9 = 0 THEN 0 ELSE 1 END AS mask FROM p)"""


def pieces(s, d):
    cut = F.flatten(F.transform(T.tokens(F.col("text")), lambda w: F.when(F.length(w) > 6, F.array(F.substring(w, 1, 4), F.concat(F.lit("##"), F.substring(w, 5, 100)))).otherwise(F.array(w))))
    p = doc(s, d).select(F.col("doc_id").alias("doc"), F.posexplode(cut).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    weight = ((F.col("doc") * 13 + F.col("pos") * 7) % 97).cast("double") / 97
    return p.select("doc", "pos", "token", weight.alias("weight"), weight.alias("score"), F.when(F.col("pos") % 9 == 0, 0).otherwise(1).alias("mask"))


book.add(
    "token_importance",
    f"WITH {PIECES}, k AS (SELECT *, sum(CASE WHEN token LIKE '##%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos) AS k FROM x), w AS (SELECT doc, k, string_agg(regexp_replace(token, '^##', ''), '' ORDER BY pos) AS word, avg(weight) AS weight FROM k GROUP BY 1, 2) SELECT word, count(*) AS n, round(avg(weight), 4) AS weight FROM w WHERE length(word) >= 4 GROUP BY 1 HAVING count(*) > 20 ORDER BY round(avg(weight), 9) DESC, word LIMIT 30",
)(lambda s, d: rounded(V.token_importance(pieces(s, d))))
book.add("token_lengths", f"WITH t AS (SELECT CAST(len({TOK}) AS DOUBLE) AS n FROM documents) SELECT round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS std, min(n) AS min, max(n) AS max, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75 FROM t")(
    lambda s, d: rounded(V.length_stats(doc(s, d).select(F.size(T.tokens(F.col("text"))).cast("double").alias("n")), F.col("n")))
)
book.add(
    "segment_terms",
    f"WITH q AS (SELECT quantile_cont(n_chars, 0.1) AS a, quantile_cont(n_chars, 0.9) AS b, median(n_chars) AS m FROM documents), g AS (SELECT CASE WHEN n_chars <= a THEN 'low' WHEN n_chars >= b THEN 'high' WHEN n_chars >= 0.9 * m AND n_chars <= 1.1 * m THEN 'middle' END AS segment, {TOK} AS ts FROM documents, q), c AS (SELECT segment, term, count(*) AS n FROM (SELECT segment, unnest(ts) AS term FROM g WHERE segment IS NOT NULL) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, term) AS place FROM c) SELECT * FROM r WHERE place <= 100",
)(lambda s, d: V.segment_terms(doc(s, d), "n_chars", "text"))
book.add(
    "doc_top_tokens",
    f"WITH {PIECES}, l AS (SELECT *, exp(weight - max(weight) OVER (PARTITION BY doc)) AS e FROM x WHERE mask = 1), r AS (SELECT doc, regexp_replace(token, '^##', '') AS token, e / sum(e) OVER (PARTITION BY doc) AS share, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, pos) AS place FROM l) SELECT doc, place, token, round(share, 4) AS share FROM r WHERE place <= 10 AND length(token) >= 4",
)(lambda s, d: rounded(V.doc_top_tokens(pieces(s, d), 10)))


@book.add("word2vec")
def word2vec(s, d):
    from pyspark.ml.functions import vector_to_array

    model, words = V.word_vectors(doc(s, d), "text")
    return model.transform(words).select("doc_id", F.transform(vector_to_array("vector"), lambda x: F.round(x, 4)).alias("vector"), F.size("words").alias("n_words"))
