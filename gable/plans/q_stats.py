"""Queries: comparison statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gable.operators import metrics as M
from gable.operators import resample as R
from gable.operators import stats as S
from gable.plans.base import Book, L, rounded

book = Book()
PRED = {"a": "predicted_price", "b": "0.5 * predicted_price + 0.5 * price", "c": "0.9 * price + 20 * house_area", "d": "1.1 * price"}
FOLD = f"""{L}, e AS ({' UNION ALL '.join(f"SELECT category, id % 5 AS fold, '{m}' AS model, price AS y, {x} AS p FROM listings" for m, x in PRED.items())}),
s AS (SELECT category, fold, model, sqrt(avg((y - p) ** 2)) AS score FROM e GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER (PARTITION BY category, fold ORDER BY score) + (count(*) OVER (PARTITION BY category, fold, score) - 1) / 2.0 AS rank FROM s)"""


def scores(d):
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(x).alias("p")) for m, x in PRED.items()]))
    rows = d.select("category", (F.col("id") % 5).alias("fold"), F.col("price").alias("y"), each.alias("x")).select("category", "fold", "y", "x.*")
    return rows.groupBy("category", "fold", "model").agg(M.rmse("y", "p").alias("score"))




def simpson(f: str, x: str, steps: int = 2000) -> str:
    """SQL: the integral of f over i * h from 0 to x, with h = x / steps."""
    return f"(({x}) / {steps}.0 / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('@', f'(i * ({x}) / {steps}.0)')}))))"


def t_p(t: str, df: str) -> str:
    """SQL: p value of both sides of Student's t."""
    c = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    return f"round(greatest(0.0, 1 - 2 * {c} * {simpson(f'(1 + @ * @ / ({df})) ** (-(({df}) + 1) / 2.0)', f'least(abs({t}), 60)')}), 4)"


both = lambda d: d.withColumn("other", F.expr(PRED["c"]))
monthly = lambda d: d.withColumn("month", F.trunc("listed_at", "month"))
ranked = lambda d: S.avg_ranks(scores(d), ["category", "fold"], "model", "score")
book.on_listings("avg_ranks", lambda d: rounded(ranked(d)), f"{FOLD} SELECT category, fold, model, round(score, 4) AS score, CAST(rank AS DOUBLE) AS rank FROM r")
book.on_listings(
    "friedman",
    lambda d: rounded(S.friedman(ranked(d), ["category", "fold"], "model")),
    f"{FOLD}, m AS (SELECT model, sum(rank) AS r, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY category, fold, rank)), a AS (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(max(n) AS DOUBLE) AS n, CAST(sum(r * r) AS DOUBLE) AS s FROM m) SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(chi2, 4) AS chi2, round(2.569 * sqrt(k * (k + 1) / (6 * n)), 4) AS cd, round(1 - {simpson('2 * @ * @ * exp(-@ * @ / 2) / (2 ** 1.5 * gamma(1.5))', 'sqrt(chi2)')}, 4) + 0.0 AS p FROM (SELECT *, (12 / (n * k * (k + 1)) * s - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))) AS chi2 FROM a, t)",
)
BEST = "SELECT {g} max(CASE WHEN k = 1 THEN model END) AS best, max(CASE WHEN k = 2 THEN model END) AS second, round(max(CASE WHEN k = 1 THEN s END), 4) AS best_score, round(max(CASE WHEN k = 2 THEN s END), 4) AS second_score FROM (SELECT {g} model, avg(score) AS s, row_number() OVER ({p} ORDER BY avg(score), model) AS k FROM s GROUP BY {g} model) {b}"
book.on_listings("best_model", lambda d: rounded(S.best_two(scores(d), [], "model", "score")), f"{FOLD} {BEST.format(g='', p='', b='')}")
book.on_listings("best_dataset", lambda d: rounded(S.best_two(scores(d), ["model"], "category", "score")), f"{FOLD} {BEST.format(g='@,', p='PARTITION BY @', b='GROUP BY @').replace('model', 'category').replace('@', 'model')}")
book.on_listings("best_embedding", lambda d: rounded(S.best_two(scores(d), ["category"], "model", "score")), f"{FOLD} {BEST.format(g='category,', p='PARTITION BY category', b='GROUP BY category')}")
CD = 0.9
WITHIN = "m AS (SELECT {g} model, avg(rank) AS r, avg(score) AS s FROM r GROUP BY {g} model), n AS (SELECT * FROM (SELECT *, min(r) OVER ({p}) AS least FROM m) WHERE r <= least + 0.9) SELECT {g} arg_min(model, (s, model)) AS best, round(arg_min(r, (s, model)), 4) AS rank, count(*) AS tied, CASE WHEN count(*) = 1 THEN 'rank' ELSE 'score' END AS reason FROM n {b}"
book.on_listings("best_within_cd", lambda d: rounded(S.best_within(ranked(d), [], "model", "score", CD)), f"{FOLD}, {WITHIN.format(g='', p='', b='')}")
book.on_listings("best_within_cd_by_dataset", lambda d: rounded(S.best_within(ranked(d), ["category"], "model", "score", CD)), f"{FOLD}, {WITHIN.format(g='category,', p='PARTITION BY category', b='GROUP BY category')}")
ERR = f"{L}, d AS (SELECT id, category, abs(price - predicted_price) AS a, abs(price - (0.9 * price + 20 * house_area)) AS b FROM listings)"
losses = lambda d: d.select("id", "category", F.abs(F.expr("price - predicted_price")).alias("a"), F.abs(F.expr("price - (0.9 * price + 20 * house_area)")).alias("b"))
book.on_listings("loss_t", lambda d: rounded(S.paired_t(losses(d), "a", "b", ["category"])), f"{ERR} SELECT category, n, round(m, 4) AS mean, round(t, 4) AS t, {t_p('t', 'n - 1')} AS p FROM (SELECT category, count(*) AS n, avg(a - b) AS m, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM d GROUP BY 1)")
book.on_listings(
    "paired_t",
    lambda d: rounded(S.paired_t(scores(d).groupBy("category", "fold").agg(F.max(F.when(F.col("model") == "a", F.col("score"))).alias("a"), F.max(F.when(F.col("model") == "c", F.col("score"))).alias("c")), "a", "c", ["category"])),
    f"{FOLD}, w AS (SELECT category, fold, max(CASE WHEN model = 'a' THEN score END) - max(CASE WHEN model = 'c' THEN score END) AS d FROM s GROUP BY 1, 2) SELECT category, n, round(m, 4) AS mean, round(t, 4) AS t, {t_p('t', 'n - 1')} AS p FROM (SELECT category, count(*) AS n, avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM w GROUP BY 1)",
)
book.on_listings(
    "wilcoxon",
    lambda d: rounded(S.wilcoxon(losses(d), "a", "b"), 3),
    f"{ERR}, x AS (SELECT a - b AS d FROM d WHERE a - b <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, 1 AS o FROM x), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY abs(d))), s AS (SELECT count(*) AS n, CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE) AS w FROM r) SELECT n, w, round(z, 3) AS z, round(greatest(0.0, 1 - 2 * {simpson('exp(-@ * @ / 2) / sqrt(2 * pi())', 'least(abs(z), 40)')}), 3) AS p FROM (SELECT n, w, (w - n * (n + 1.0) / 4) / sqrt((n * (n + 1.0) * (2.0 * n + 1) - ties / 2) / 24) AS z FROM s, t)",
)
fold_pairs = lambda d: scores(d).groupBy("category", "fold").agg(F.max(F.when(F.col("model") == "a", F.col("score"))).alias("a"), F.max(F.when(F.col("model") == "c", F.col("score"))).alias("c"))
book.on_listings(
    "wilcoxon_folds",
    lambda d: rounded(S.wilcoxon(fold_pairs(d), "a", "c", ["category"]), 4),
    # five folds: all 32 combinations of signs
    f"{FOLD}, fw AS (SELECT category, fold, max(CASE WHEN model = 'a' THEN score END) - max(CASE WHEN model = 'c' THEN score END) AS d FROM s GROUP BY 1, 2), fr AS (SELECT category, d, CAST(row_number() OVER (PARTITION BY category ORDER BY abs(d)) AS INTEGER) AS r FROM fw), fo AS (SELECT category, count(*) AS n, CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE) AS w FROM fr GROUP BY 1), b AS (SELECT i, list_sum(list_transform(range(1, 6), lambda j: j * ((i >> CAST(j - 1 AS INTEGER)) & 1))) AS t FROM (SELECT CAST(unnest(range(32)) AS INTEGER) AS i)) SELECT category, n, w, round((w - 7.5) / sqrt(13.75), 4) AS z, round(least(1.0, 2 * (SELECT count(*) FROM b WHERE t <= fo.w) / 32.0), 4) AS p FROM fo",
)
KS = f"{L}, c AS (SELECT predicted_price AS v, count(*) FILTER (id % 3 = 0) AS a, count(*) FILTER (id % 3 <> 0) AS b FROM listings GROUP BY 1), k AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS n, sum(b) OVER () AS m FROM c WINDOW w AS (ORDER BY v)) , e AS (SELECT n, m, max(abs(ca / n - cb / m)) AS d, max(abs(ca / n - cb / m)) * sqrt(n * m / (n + m)) AS x FROM k GROUP BY 1, 2) SELECT CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(d, 4) AS d, round(CASE WHEN x > 0.2 THEN least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * i * i * x * x))))) ELSE 1.0 END, 4) AS p FROM e"
book.on_listings("ks_2samp", lambda d: rounded(S.ks_2samp(d, "predicted_price", F.col("id") % 3 == 0)), KS)
book.on_listings(
    "normality",
    lambda d: rounded(S.normality(d, "predicted_price"), 3),
    f"""{L}, m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(predicted_price) AS u FROM listings), c AS (SELECT n, avg((predicted_price - u) ** 2) AS m2, avg((predicted_price - u) ** 3) AS m3, avg((predicted_price - u) ** 4) AS m4 FROM listings, m GROUP BY n), g AS (SELECT n, m3 / m2 ** 1.5 AS g1, m4 / (m2 * m2) - 3 AS g2 FROM c),
x AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, (g2 - (3 * (n - 1) / (n + 1) - 3)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS u, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM g),
z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS z1, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS a FROM x)
SELECT CAST(n AS BIGINT) AS n, round(g1, 3) AS skew, round(g2, 3) AS kurt, round(z1 * z1 + (((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + u * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))) ** 2, 3) AS k2, round(exp(-(z1 * z1 + (((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + u * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))) ** 2) / 2), 3) AS p FROM z""",
)
# ---- resampling: the same draws in SQL, one row for each row and round
ROUNDS = 1000


def drawn(source: str) -> str:
    """SQL: source, a table with k and round, and u, the draw of both."""
    c = [f"CAST({x} AS UBIGINT)" for x in (2654435769, 2246822507, 3266489909, 4294967296)]
    return f"(SELECT * EXCLUDE (h0, h1, h2), xor(h2, h2 >> 16) AS u FROM (SELECT *, (xor(h1, h1 >> 13) * {c[2]}) % {c[3]} AS h2 FROM (SELECT *, (xor(h0, h0 >> 16) * {c[1]}) % {c[3]} AS h1 FROM (SELECT *, (k + CAST(round + 1 AS UBIGINT) * {c[0]}) % {c[3]} AS h0 FROM {source}))))"


def row_key(ident: str) -> str:
    return f"CAST('0x' || md5('42|' || {ident})[1:8] AS UBIGINT)"


PW = f"CASE {' '.join(f'WHEN u < {e} THEN {i}' for i, e in enumerate(R.poisson_edges()))} ELSE {len(R.poisson_edges())} END"
RW = f"SELECT unnest(range({ROUNDS})) AS round"
SUMS = "CASE WHEN max(y) <> min(y) THEN 1 - sum(weight * (y - p) ** 2) / (sum(weight * y * y) - sum(weight * y) ** 2 / sum(weight)) END AS r2, sqrt(sum(weight * (y - p) ** 2) / sum(weight)) AS rmse, 100 * sum(weight * 2 * abs(y - p) / (abs(y) + abs(p))) / sum(weight) AS smape"
WEIGHTS = f"bw AS MATERIALIZED (SELECT id, round, {PW} AS weight FROM {drawn(f'(SELECT id, {row_key(chr(105) + chr(100))} AS k, round FROM listings, ({RW}))')} WHERE {PW} > 0)"


def boot(name: str, p: str, key: str = "'all'") -> str:
    """SQL: common table `name` (key, round, metric, value) of the bootstrap rounds of predictions p, after WEIGHTS."""
    return f"""{name}x AS (SELECT {key} AS key, round, price AS y, {p} AS p, weight FROM listings JOIN bw USING (id)),
{name}g AS (SELECT key, round, {SUMS} FROM {name}x GROUP BY ALL),
{name}h AS (SELECT key, round, 100 * median(v) AS medape FROM (SELECT key, round, abs(y - p) / abs(y) AS v, unnest(range(weight)) FROM {name}x) GROUP BY ALL),
{name} AS (SELECT key, round, unnest(['r2', 'rmse', 'smape', 'medape']) AS metric, unnest([r2, rmse, smape, medape]) AS value FROM {name}g JOIN {name}h USING (key, round))"""


book.on_listings(
    "bootstrap_ci",
    lambda d: rounded(S.bootstrap_ci(d, ["category"], "price", "predicted_price", ROUNDS), 5),
    f"{L}, {WEIGHTS}, {boot('a', 'predicted_price', 'category')} SELECT key AS category, metric, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.025), 5) AS lower, round(quantile_cont(value, 0.975), 5) AS upper, round(stddev_pop(value), 5) AS std, count(*) AS n FROM a GROUP BY 1, 2",
)
WORSE = "avg(CASE WHEN metric = 'r2' THEN CASE WHEN d {r} 0 THEN 1.0 ELSE 0.0 END WHEN d {o} 0 THEN 1.0 ELSE 0.0 END)"
book.on_listings(
    "bootstrap_diff",
    lambda d: rounded(S.bootstrap_diff(both(d), "price", "predicted_price", "other", ROUNDS)),
    f"{L}, {WEIGHTS}, {boot('a', 'predicted_price')}, {boot('b', PRED['c'])}, d AS (SELECT metric, a.value - b.value AS d FROM a JOIN b USING (round, metric)) SELECT metric, round(avg(d), 4) AS diff, round(quantile_cont(d, 0.025), 4) AS lower, round(quantile_cont(d, 0.975), 4) AS upper, round({WORSE.format(r='<=', o='>=')}, 4) AS p FROM d GROUP BY 1",
)
MONTH = "CAST(date_trunc('month', listed_at) AS DATE)"
book.on_listings(
    "month_drift",
    lambda d: rounded(S.month_drift(monthly(d), "month", "price", "predicted_price", ROUNDS)),
    f"{L}, {WEIGHTS}, {boot('a', 'predicted_price', MONTH)}, d AS (SELECT a.key, metric, a.value, a.value - b.value AS d FROM a JOIN a b USING (round, metric) WHERE b.key = (SELECT min(key) FROM a) AND a.value IS NOT NULL AND b.value IS NOT NULL) SELECT key AS month, metric, round(avg(value), 4) AS mean, round(avg(d), 4) AS diff, round({WORSE.format(r='>=', o='<=')}, 4) AS p FROM d GROUP BY 1, 2",
)
HALVES = f"""q AS (SELECT id, price AS y, predicted_price AS p, {row_key("id || '|0'")} AS k FROM listings UNION ALL SELECT id, price, {PRED['c']}, {row_key("id || '|1'")} FROM listings),
x AS (SELECT round, y, p, 1 AS weight, row_number() OVER (PARTITION BY round ORDER BY u, k) > (SELECT count(*) FROM listings) AS half FROM {drawn(f'(SELECT * FROM q, ({RW}))')}),
m AS (SELECT round, half, {SUMS}, 100 * median(abs(y - p) / abs(y)) AS medape FROM x GROUP BY 1, 2),
l AS (SELECT round, half, unnest(['r2', 'rmse', 'smape', 'medape']) AS metric, unnest([r2, rmse, smape, medape]) AS value FROM m),
e AS (SELECT metric, a.value - b.value AS d FROM l a JOIN l b USING (round, metric) WHERE a.half AND NOT b.half),
s AS (SELECT {{p}} AS p, price AS y, 1 AS weight FROM listings), o AS (SELECT 0 AS i, {SUMS}, 100 * median(abs(y - p) / abs(y)) AS medape FROM (SELECT predicted_price AS p, price AS y, 1 AS weight FROM listings) UNION ALL SELECT 1, {SUMS}, 100 * median(abs(y - p) / abs(y)) FROM (SELECT {PRED['c']} AS p, price AS y, 1 AS weight FROM listings)),
t AS (SELECT i, unnest(['r2', 'rmse', 'smape', 'medape']) AS metric, unnest([r2, rmse, smape, medape]) AS value FROM o), z AS (SELECT metric, sum(CASE WHEN i = 1 THEN value ELSE -value END) AS diff FROM t GROUP BY 1)"""
HALVES = HALVES.replace("s AS (SELECT {p} AS p, price AS y, 1 AS weight FROM listings), ", "")
book.on_listings(
    "permutation_test",
    lambda d: rounded(S.permutation_test(both(d), "price", "predicted_price", "other", ROUNDS)),
    f"{L}, {HALVES} SELECT metric, round(any_value(diff), 4) AS diff, round(avg(CASE WHEN abs(d) >= abs(diff) THEN 1.0 ELSE 0.0 END), 4) AS p FROM e JOIN z USING (metric) GROUP BY 1",
)
book.on_listings("stars", lambda d: d.select("id", S.stars((F.col("id") % 1000).cast("double") / 10000).alias("stars")), f"{L}, p AS (SELECT id, CAST(id % 1000 AS DOUBLE) / 10000 AS p FROM listings) SELECT id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM p")
FT = ["house_area", "land_area", "lat", "lon", "predicted_price"]
book.on_listings("f_regression", lambda d: rounded(S.f_regression(d, FT, "price"), 2), f"{L}, f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - 2 AS df, corr({c}, price) ** 2 / (1 - corr({c}, price) ** 2) * (count(*) - 2) AS f FROM listings" for c in FT) + f") SELECT feature, round(f, 2) AS f, round({t_p('sqrt(f)', 'df')}, 2) AS p, row_number() OVER (ORDER BY f DESC, feature) AS place FROM f")
LONG = f"{L}, x AS (" + " UNION ALL ".join(f"SELECT category AS model, '{c}' AS feature, CAST({c} AS DOUBLE) * {w} AS value FROM listings" for c, w in (("house_area", 2), ("land_area", -30), ("lat", 1), ("lon", 1))) + "), m AS (SELECT model, feature, avg(abs(value)) AS v FROM x GROUP BY 1, 2)"


def long(d):
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) * w).alias("value")) for c, w in (("house_area", 2), ("land_area", -30), ("lat", 1), ("lon", 1))])
    return d.select(F.col("category").alias("model"), F.explode(parts).alias("x")).select("model", "x.*")


book.on_listings("importance_table", lambda d: rounded(S.importance_table(long(d))), f"{LONG} SELECT model, feature, round(v, 4) AS importance, row_number() OVER (PARTITION BY model ORDER BY v DESC, feature) AS place, round((v - min(v) OVER (PARTITION BY model)) / (max(v) OVER (PARTITION BY model) - min(v) OVER (PARTITION BY model)), 4) AS scaled FROM m")
IMP = "i AS (SELECT model, feature, v AS importance, row_number() OVER (PARTITION BY model ORDER BY v DESC, feature) AS place, (v - min(v) OVER (PARTITION BY model)) / (max(v) OVER (PARTITION BY model) - min(v) OVER (PARTITION BY model)) AS scaled FROM m)"
CATEGORIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
book.on_listings("importance_ends", lambda d: rounded(S.importance_ends(S.importance_table(long(d)), 1)), f"{LONG}, {IMP} SELECT model, CASE WHEN place <= 1 THEN 'top' ELSE 'bottom' END AS \"end\", place, feature, round(importance, 4) AS importance FROM i WHERE place <= 1 OR place > 3")
book.on_listings(
    "importance_compared",
    lambda d: rounded(S.importance_compared(S.importance_table(long(d)), CATEGORIES)),
    f"{LONG}, {IMP} SELECT feature, {', '.join(f'round(min(scaled) FILTER (model = {chr(39)}{c}{chr(39)}), 4) AS {c!r}'.replace(chr(39) + c + chr(39) + ' ', '@@').replace('@@', chr(39) + c + chr(39) + ' ').replace(f'AS {c!r}', f'AS {chr(34)}{c}{chr(34)}') for c in CATEGORIES)}, round(sum(scaled) / 5, 4) AS mean FROM i GROUP BY 1",
)
book.on_listings("importance_share", lambda d: rounded(S.importance_share(long(d), "l")), f"{LONG} SELECT model, count(*) FILTER (feature LIKE 'l%') AS count, round(sum(v) FILTER (feature LIKE 'l%'), 4) AS sum, round(sum(v) FILTER (feature LIKE 'l%') / sum(v), 4) AS share, round(max(v) FILTER (feature LIKE 'l%'), 4) AS max, round(avg(v) FILTER (feature LIKE 'l%'), 4) AS mean FROM m GROUP BY 1")
SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
AK = f"{L}, v AS (SELECT price AS v, CAST(count(*) AS DOUBLE) AS l, " + ", ".join(f"CAST(count(*) FILTER (category = '{c}') AS DOUBLE) AS s{i}" for i, c in enumerate(SEG)) + " FROM listings GROUP BY 1), c AS (SELECT l, sum(l) OVER () AS n, sum(l) OVER w - l / 2 AS b, " + ", ".join(f"s{i}, sum(s{i}) OVER () AS t{i}, sum(s{i}) OVER w - s{i} / 2 AS m{i}" for i in range(5)) + " FROM v WINDOW w AS (ORDER BY v)), w AS (SELECT max(n) AS n, (max(n) - 1) / max(n) * (" + " + ".join(f"sum(l / n * (n * m{i} - t{i} * b) ** 2 / nullif(b * (n - b) - n * l / 4, 0) / t{i})" for i in range(5)) + ") AS a2, " + " + ".join(f"1 / max(t{i})" for i in range(5)) + " AS hh FROM c), r AS (SELECT i, sum(1.0 / i) OVER (ORDER BY i) AS hi FROM (SELECT unnest(range(1, CAST((SELECT n FROM w) AS BIGINT))) AS i)), g AS (SELECT max(hi) AS h, sum(CASE WHEN i <= w.n - 2 THEN ((SELECT max(hi) FROM r) - hi) / (w.n - i) ELSE 0 END) AS g FROM r, w), z AS (SELECT n, a2, sqrt((((4 * g - 6) * 4 + (10 - 6 * g) * hh) * n ** 3 + ((2 * g - 4) * 25 + 40 * h + (2 * g - 14 * h - 4) * hh - 8 * h + 4 * g - 6) * n ** 2 + ((6 * h + 2 * g - 2) * 25 + (4 * h - 4 * g + 6) * 5 + (2 * h - 6) * hh + 4 * h) * n + (2 * h + 6) * 25 - 20 * h) / ((n - 1) * (n - 2) * (n - 3))) AS sd FROM w, g) SELECT CAST(n AS BIGINT) AS n, round(a2, 3) AS a2, round((a2 - 4) / sd, 3) AS standardised, round(1.645 + 0.678 / 2 - 0.362 / 4, 3) AS critical FROM z"
book.on_listings("anderson_k", lambda d: rounded(S.anderson_k(d, "price", "category", SEG), 3), AK)
book.on_listings("qq_table", lambda d: rounded(S.qq_table(d, "price")))
MODELS = {"a": "predicted_price", "c": "other"}
book.on_listings(
    "bootstrap_select",
    lambda d: rounded(S.bootstrap_select(both(d), "category", "price", MODELS, "rmse", ROUNDS)),
    f"{L}, {WEIGHTS}, {boot('a', 'predicted_price', 'category')}, {boot('c', PRED['c'], 'category')}, m AS (SELECT a.key AS category, avg(a.value) AS x, avg(c.value) AS z, avg(CASE WHEN c.value <= a.value THEN 1.0 ELSE 0.0 END) AS ca, avg(CASE WHEN a.value <= c.value THEN 1.0 ELSE 0.0 END) AS ac FROM a JOIN c USING (key, round, metric) WHERE metric = 'rmse' GROUP BY 1) SELECT category, CASE WHEN x <= z THEN 'a' ELSE 'c' END AS best, CASE WHEN x <= z THEN 'c' ELSE 'a' END AS second, round(CASE WHEN x <= z THEN ca ELSE ac END, 4) AS p FROM m",
)


def compared(d):
    rows = both(d)
    ci = S.bootstrap_ci(rows, [], "price", "predicted_price", ROUNDS).withColumn("model", F.lit("a")).unionByName(S.bootstrap_ci(rows, [], "price", "other", ROUNDS).withColumn("model", F.lit("c")))
    return S.comparison_table(ci, S.bootstrap_diff(rows, "price", "other", "predicted_price", ROUNDS).withColumn("model", F.lit("c")), "model", "a", ["a", "c"])


book.on_listings("comparison_table", compared)
book.on_listings("drift_table", lambda d: rounded(S.drift_table(M.price_describe(monthly(d), ["month"], "predicted_price"), S.month_drift(monthly(d), "month", "price", "predicted_price", ROUNDS), "month"), 2))
