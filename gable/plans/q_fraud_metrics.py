"""Queries: suspicious prices, run tables, error metrics, exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gable.operators import explore as X
from gable.operators import fraud as FR
from gable.operators import metrics as M
from gable.operators import runs as R
from gable.plans.base import Book, L, listings, rounded

book = Book()
LOW, HIGH = 50e6 / 400, 100e6 / 400

FLAGS = f"""{L}, f AS (SELECT *, CASE WHEN price = 0 THEN CASE WHEN predicted_price <> 0 THEN CAST('inf' AS DOUBLE) END
  ELSE abs(100 * (predicted_price - price) / price) END AS relative_error FROM listings),
g AS (SELECT *, coalesce((price <= {LOW} AND relative_error >= 45) OR (price > {LOW} AND price <= {HIGH} AND relative_error >= 75), false) AS flag_2,
  coalesce(price <= {HIGH} AND relative_error > 100, false) AS flag_1 FROM f)"""
COLS = "id, price, round(predicted_price, 4) AS predicted_price, round(relative_error, 4) AS relative_error, flag_2, flag_1"


def flagged(df):
    return rounded(FR.fraud_flags(df, LOW, HIGH).select("id", "price", "predicted_price", "relative_error", "flag_2", "flag_1"))


book.on_listings("fraud_flags", flagged, f"{FLAGS} SELECT {COLS} FROM g")
book.on_listings("fraud_very", lambda d: flagged(d).where("flag_1"), f"{FLAGS} SELECT {COLS} FROM g WHERE flag_1")
book.on_listings("fraud_suspicious", lambda d: flagged(d).where("flag_2"), f"{FLAGS} SELECT {COLS} FROM g WHERE flag_2")
book.on_listings("fraud_required", lambda d: FR.check_columns(d).select("id", "price", "predicted_price").transform(rounded), f"{L} SELECT id, price, round(predicted_price, 4) AS predicted_price FROM listings")
book.on_listings("listing_link", lambda d: d.select("id", FR.listing_link(F.col("id")).alias("link")), f"""{L} SELECT id, '<a href="https://listings.example/' || id || '" target="_blank">open listing</a>' AS link FROM listings""")

# run tables: one run for each month and category, parameters and metrics as JSON maps
RUNS_SQL = f"""{L}, m AS (SELECT category, CAST(date_trunc('month', listed_at) AS DATE) AS month, count(*) AS n, round(avg(price), 5) AS price,
  round(1 - sum((price - predicted_price) ** 2) / nullif(sum(price * price) - count(*) * avg(price) * avg(price), 0), 6) AS r2
  FROM listings GROUP BY 1, 2)"""


def run_rows(spark, sf_dir):
    month = F.trunc("listed_at", "month").alias("month")
    agg = listings(spark, sf_dir).groupBy("category", month).agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("price") * 1e5, 0) / 1e5).alias("price"), F.round(M.r2(F.col("price"), F.col("predicted_price")), 6).alias("r2"))
    return agg.select(
        F.concat_ws("/", "category", F.col("month").cast("string")).alias("run_id"),
        F.col("month").alias("start_time"),
        F.lit("FINISHED").alias("status"),
        F.to_json(F.struct(F.col("category").alias("model"), F.col("n").cast("string").alias("sample_size"))).alias("params"),
        F.to_json(F.struct(F.col("r2").alias("test_r2"), F.col("price").alias("avg_price"))).alias("metrics"),
    )


book.add("runs_table", f"{RUNS_SQL} SELECT category || '/' || month AS run_id, month AS start_time, category AS model, CAST(n AS VARCHAR) AS sample_size, r2 AS test_r2, price AS avg_price FROM m")(lambda s, d: R.runs_table(run_rows(s, d), ["model", "sample_size"], ["test_r2", "avg_price"], "test_r2"))
book.add(
    "pick_run",
    f"""{RUNS_SQL}, k AS (SELECT category AS model, category || '/' || month AS run_id, month, r2,
  row_number() OVER (PARTITION BY category ORDER BY month DESC) AS late, row_number() OVER (PARTITION BY category ORDER BY r2 DESC NULLS LAST, month DESC) AS best FROM m)
SELECT model, max(CASE WHEN late = 1 THEN run_id END) AS latest, max(CASE WHEN best = 1 THEN run_id END) AS best FROM k GROUP BY model""",
)(lambda s, d: R.pick_runs(R.runs_table(run_rows(s, d), ["model"], ["test_r2"], "test_r2"), ["model"], "test_r2"))

Y, P = "price", "predicted_price"
book.on_listings("metric_r2", lambda d: rounded(d.groupBy("category").agg(M.r2(Y, P).alias("r2"))), f"{L} SELECT category, round(1 - sum((price - predicted_price) ** 2) / nullif(sum(price * price) - count(*) * avg(price) * avg(price), 0), 4) AS r2 FROM listings GROUP BY 1")
book.on_listings("metric_rmse", lambda d: rounded(d.groupBy("category").agg(M.rmse(Y, P).alias("rmse"), (M.rmse(Y, P) / 1e6).alias("rmse_millions"))), f"{L} SELECT category, round(sqrt(avg((price - predicted_price) ** 2)), 4) AS rmse, round(sqrt(avg((price - predicted_price) ** 2)) / 1e6, 4) AS rmse_millions FROM listings GROUP BY 1")

# every 13th price counts as zero, every 26th prediction too
ZEROED = f"{L}, z AS (SELECT category, CASE WHEN id % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE price END AS y, CASE WHEN id % 26 = 0 THEN CAST(0 AS DOUBLE) ELSE predicted_price END AS p FROM listings)"


def zeroed(d):
    return d.select("category", F.when(F.col("id") % 13 == 0, F.lit(0.0)).otherwise(F.col(Y)).alias("y"), F.when(F.col("id") % 26 == 0, F.lit(0.0)).otherwise(F.col(P)).alias("p"))


y, p = "y", "p"
book.on_listings(
    "metric_smape",
    lambda d: rounded(zeroed(d).groupBy("category").agg(*[M.smape(y, p, k).alias(f"smape_{k}") for k in ("eps", "zero", "plain")])),
    f"""{ZEROED} SELECT category, round(100 * avg(2 * abs(p - y) / (abs(y) + abs(p) + 1e-8)), 4) AS smape_eps,
 round(100 * avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 2 * abs(p - y) / (abs(y) + abs(p)) END), 4) AS smape_zero,
 round(100 * avg(CASE WHEN abs(y) + abs(p) <> 0 THEN 2 * abs(p - y) / (abs(y) + abs(p)) END), 4) AS smape_plain FROM z GROUP BY 1""",
)
book.on_listings(
    "metric_medape",
    lambda d: rounded(zeroed(d).groupBy("category").agg(*[M.medape(y, p, k).alias(f"medape_{k}") for k in ("eps", "zero", "plain")])),
    f"""{ZEROED} SELECT category, round(100 * median(abs(y - p) / (abs(y) + 1e-8)), 4) AS medape_eps,
 round(100 * median(CASE WHEN y = 0 THEN abs(y - p) ELSE abs(y - p) / abs(y) END), 4) AS medape_zero,
 round(100 * median(CASE WHEN y <> 0 THEN abs(y - p) / abs(y) END), 4) AS medape_plain FROM z GROUP BY 1""",
)
book.on_listings(
    "drop_null_pairs",
    lambda d: rounded(M.drop_null_pairs(d.select("id", F.when(F.col("id") % 7 != 0, F.col(Y)).alias("y"), F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col(P)).alias("p")), "y", "p")),
    f"{L} SELECT id, round(price, 4) AS y, round(predicted_price, 4) AS p FROM listings WHERE id % 7 <> 0 AND id % 11 <> 0",
)
book.on_listings(
    "row_errors",
    lambda d: rounded(M.row_errors(d)),
    f"""{L} SELECT id, round(ln(1 + price), 4) AS true_price_log, round(ln(1 + predicted_price), 4) AS predicted_price_log, round(price, 4) AS true_price,
 round(predicted_price, 4) AS predicted_price, round(abs(price - predicted_price), 4) AS absolute_error, round(abs(price - predicted_price) / (price + 1e-8), 4) AS relative_error FROM listings""",
)

# folds by id, on the original and the logarithmic scale
FOLDS = f"""{L}, e AS (SELECT category, id % 5 AS fold, 'orig' AS scale, price AS y, predicted_price AS p FROM listings
 UNION ALL SELECT category, id % 5, 'log', ln(1 + price), ln(1 + predicted_price) FROM listings),
f AS (SELECT category, scale, fold, 1 - sum((y - p) ** 2) / nullif(sum(y * y) - count(*) * avg(y) * avg(y), 0) AS r2, sqrt(avg((y - p) ** 2)) AS rmse,
 100 * avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 2 * abs(p - y) / (abs(y) + abs(p)) END) AS smape, 100 * median(CASE WHEN y <> 0 THEN abs(y - p) / abs(y) END) AS medape FROM e GROUP BY 1, 2, 3),
m AS (SELECT category, scale, fold, 'r2' AS metric, r2 AS value FROM f UNION ALL SELECT category, scale, fold, 'rmse', rmse FROM f
 UNION ALL SELECT category, scale, fold, 'smape', smape FROM f UNION ALL SELECT category, scale, fold, 'medape', medape FROM f)"""
METRICS = ["r2", "rmse", "smape", "medape"]


def fold_metrics(d):
    both = F.array(F.struct(F.lit("orig").alias("scale"), F.col(Y).alias("y"), F.col(P).alias("p")), F.struct(F.lit("log").alias("scale"), F.log1p(Y).alias("y"), F.log1p(P).alias("p")))
    rows = d.select("category", (F.col("id") % 5).alias("fold"), F.explode(both).alias("x")).select("category", "fold", "x.*")
    return M.to_long(M.metrics_by(rows, ["category", "scale", "fold"], y, p), ["category", "scale", "fold"], METRICS)


book.on_listings("metrics_long", lambda d: rounded(fold_metrics(d)), f"{FOLDS} SELECT category, scale, fold, metric, round(value, 4) AS value FROM m")
book.on_listings(
    "fold_stats",
    lambda d: rounded(M.fold_stats(fold_metrics(d), ["category", "scale", "metric"])),
    f"{FOLDS} SELECT category, scale, metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(1.96 * stddev_pop(value) / sqrt(count(value)), 4) AS conf_interval FROM m GROUP BY 1, 2, 3",
)
book.on_listings(
    "pivot_metrics",
    lambda d: rounded(M.pivot_first(M.fold_stats(fold_metrics(d), ["category", "scale", "metric"]), ["category", "scale"], "metric", "mean", METRICS)),
    f"{FOLDS}, a AS (SELECT category, scale, metric, avg(value) AS v FROM m GROUP BY 1, 2, 3) SELECT category, scale, {', '.join(f'''round(max(CASE WHEN metric = '{k}' THEN v END), 4) AS {k}''' for k in METRICS)} FROM a GROUP BY 1, 2",
)
ORDER = ["MACHINERY", "BUILDING", "AUTOMOBILE"]
book.on_listings(
    "ordered_report",
    lambda d: M.ordered_report(M.fold_stats(fold_metrics(d).where("metric = 'rmse' and scale = 'orig'"), ["category"]), "category", ORDER).select("category", "position", F.format_string("%.3f ± %.3f", F.col("mean") / 1e6, F.col("conf_interval") / 1e6).alias("score")),
    f"{FOLDS} SELECT category, CASE category WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'AUTOMOBILE' THEN 3 ELSE 4 END AS position, printf('%.3f ± %.3f', avg(value) / 1e6, 1.96 * stddev_pop(value) / sqrt(count(value)) / 1e6) AS score FROM m WHERE metric = 'rmse' AND scale = 'orig' GROUP BY 1, 2",
)
book.on_listings(
    "align_predictions",
    lambda d: rounded(R.align_predictions(d.select("id", F.col(Y).alias("truth")), d.where("id % 4 <> 0").select("id", F.col(P).alias("p")), d.where("id % 5 <> 0").select("id", (F.col(P) * 0.5 + F.col(Y) * 0.5).alias("p")))),
    f"{L} SELECT id, round(price, 4) AS truth, round(predicted_price, 4) AS first, round(predicted_price * 0.5 + price * 0.5, 4) AS second FROM listings WHERE id % 4 <> 0 AND id % 5 <> 0",
)
RANGES = [0, 50e3, 100e3, 200e3, 300e3, 500e3]
book.on_listings(
    "ape_by_range",
    lambda d: rounded(M.percentiles_by_group(d.withColumn("bin", R.cut_label(F.col(Y), RANGES)), "bin", 100 * M.ape(Y, P), [0.75, 0.8, 0.9, 0.95, 0.99], 10)),
    f"""{L}, b AS (SELECT CASE WHEN price < 0 THEN NULL WHEN price < 50000 THEN '0-50000' WHEN price < 100000 THEN '50000-100000' WHEN price < 200000 THEN '100000-200000'
  WHEN price < 300000 THEN '200000-300000' WHEN price < 500000 THEN '300000-500000' END AS bin, 100 * abs(price - predicted_price) / abs(price) AS a FROM listings)
SELECT bin, count(a) AS n, {', '.join(f'round(quantile_cont(a, {q}), 4) AS p{round(q * 100)}' for q in (0.75, 0.8, 0.9, 0.95, 0.99))} FROM b GROUP BY bin HAVING count(a) > 10""",
)
book.on_listings(
    "price_segments",
    lambda d: rounded(R.price_segments(d, "price").select("id", "price", "segment")),
    f"{L}, q AS (SELECT quantile_cont(price, 0.85) AS q FROM listings) SELECT id, round(price, 4) AS price, CASE WHEN price <= q THEN 'low' ELSE 'high' END AS segment FROM listings, q",
)
book.on_listings(
    "metrics_by_segment",
    lambda d: rounded((lambda s: M.metrics_by(s, ["segment"], Y, P).join(s.groupBy("segment").agg(F.count(F.lit(1)).alias("n")), "segment"))(R.price_segments(d, "price"))),
    f"""{L}, q AS (SELECT quantile_cont(price, 0.85) AS q FROM listings) SELECT CASE WHEN price <= q THEN 'low' ELSE 'high' END AS segment,
 round(1 - sum((price - predicted_price) ** 2) / nullif(sum(price * price) - count(*) * avg(price) * avg(price), 0), 4) AS r2, round(sqrt(avg((price - predicted_price) ** 2)), 4) AS rmse,
 round(100 * avg(2 * abs(predicted_price - price) / (abs(price) + abs(predicted_price))), 4) AS smape, round(100 * median(abs(price - predicted_price) / price), 4) AS medape, count(*) AS n FROM listings, q GROUP BY 1""",
)
book.on_listings(
    "price_describe",
    lambda d: rounded(M.price_describe(d.withColumn("month", F.trunc("listed_at", "month")), ["month", "category"], "predicted_price").withColumn("var", F.col("var") / 1e9), 5),
    f"{L} SELECT CAST(date_trunc('month', listed_at) AS DATE) AS month, category, round(min(predicted_price), 5) AS min, round(max(predicted_price), 5) AS max, round(median(predicted_price), 5) AS median, round(avg(predicted_price), 5) AS mean, round(var_pop(predicted_price) / 1e9, 5) AS var, count(*) AS n FROM listings GROUP BY 1, 2",
)

# exploratory
book.on_listings(
    "describe",
    lambda d: rounded(X.describe(d, ["price", "house_area", "land_area"]), 2),
    " UNION ALL ".join((L if i == 0 else "") + f" SELECT '{c}' AS \"column\", round(avg({c}), 2) AS mean, round(min({c}), 2) AS min, round(max({c}), 2) AS max, round(quantile_cont({c}, 0.25), 2) AS q25, round(quantile_cont({c}, 0.5), 2) AS q50, round(quantile_cont({c}, 0.75), 2) AS q75 FROM listings" for i, c in enumerate(["price", "house_area", "land_area"])),
)
CATS = ["category", "renovation", "infrastructure"]
LONG = ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM listings" for c in CATS) + ")"
book.on_listings(
    "category_summary",
    lambda d: rounded(X.category_summary(d, CATS)),
    f"""{L}{LONG}, n AS (SELECT "column", value, count(*) AS n, sum(count(*)) OVER (PARTITION BY "column") AS t, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS r FROM c WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT "column", max(CASE WHEN r = 1 THEN value END) AS mode, round(max(CASE WHEN r = 1 THEN 100.0 * n / t END), 4) AS share, max(CASE WHEN r = 2 THEN value END) AS second, max(CASE WHEN r = 3 THEN value END) AS third FROM n GROUP BY 1""",
)
book.on_listings(
    "binary_share",
    lambda d: rounded(X.binary_share(d, {w: F.coalesce(F.col("infrastructure").contains(w), F.lit(False)) for w in ("school", "shop", "pharmacy")})),
    " UNION ALL ".join((L if i == 0 else "") + f" SELECT '{w}' AS \"column\", round(100 * avg(CASE WHEN infrastructure LIKE '%{w}%' THEN 1.0 ELSE 0.0 END), 4) AS share FROM listings" for i, w in enumerate(("school", "shop", "pharmacy"))),
)
book.on_listings("histogram", lambda d: rounded(X.histogram(d, "price", 5000.0)), f"{L} SELECT CAST(floor(price / 5000) AS BIGINT) AS bin, floor(price / 5000) * 5000 AS low, count(*) AS n FROM listings GROUP BY 1, 2")
book.on_listings("histogram_stacked", lambda d: rounded(X.histogram(d, "price", 25000.0, "category")), f"{L} SELECT CAST(floor(price / 25000) AS BIGINT) AS bin, category, floor(price / 25000) * 25000 AS low, count(*) AS n FROM listings GROUP BY 1, 2, 3")
NAMES = {"BUILDING": "house", "MACHINERY": "cottage", "FURNITURE": "dacha"}
book.on_listings(
    "join_map",
    lambda d: d.select("id", (F.col("renovation") == "1-URGENT").alias("urgent")).join(d.select("id", X.mapped(d, "category", NAMES, "other").alias("kind")), "id"),
    f"{L} SELECT id, renovation = '1-URGENT' AS urgent, CASE category WHEN 'BUILDING' THEN 'house' WHEN 'MACHINERY' THEN 'cottage' WHEN 'FURNITURE' THEN 'dacha' ELSE 'other' END AS kind FROM listings",
)

# profiles
PROF = ["id", "year_raw", "category", "renovation", "infrastructure"]
CELLS = ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM listings" for c in PROF) + ")"
book.on_listings("profile_nulls", lambda d: rounded(X.null_profile(d, PROF)), f'{L}{CELLS} SELECT "column", count(*) - count(value) AS empty, round(100.0 * (count(*) - count(value)) / count(*), 4) AS percent FROM c GROUP BY 1')
book.on_listings("profile_uniques", lambda d: X.unique_profile(d, PROF[1:]), f"""{L}{CELLS} SELECT DISTINCT "column", value FROM c WHERE value IS NOT NULL AND "column" <> 'id'""")
book.on_listings("profile_nunique", lambda d: X.nunique_profile(d, PROF), f"""{L}{CELLS} SELECT "column", CASE WHEN "column" IN ('id', 'year_raw') THEN 'bigint' ELSE 'string' END AS dtype, count(DISTINCT value) AS n FROM c WHERE value IS NOT NULL GROUP BY 1, 2""")
book.on_listings(
    "profile_binary",
    lambda d: X.binary_columns(d.withColumn("even", (F.col("id") + 1) % 2).withColumn("none", F.lit(None).cast("int")), ["price", "even", "none"]),
    "SELECT 'price' AS \"column\", bool_and(o_totalprice IN (0, 1)) AS is_binary FROM orders UNION ALL SELECT 'even', bool_and((o_orderkey + 1) % 2 IN (0, 1)) FROM orders UNION ALL SELECT 'none', false",
)
book.on_listings(
    "validate_domain",
    lambda d: X.domain_violations(d, d.sparkSession.createDataFrame([("category", "BUILDING"), ("category", "MACHINERY"), ("renovation", "1-URGENT"), ("renovation", "2-HIGH")], "column string, value string"), ["category", "renovation"]),
    f"""{L} SELECT DISTINCT 'category' AS "column", category AS value FROM listings WHERE category NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT DISTINCT 'renovation', renovation FROM listings WHERE renovation NOT IN ('1-URGENT', '2-HIGH')""",
)
book.on_listings("validate_required", lambda d: X.required_violations(d, ["id", "price", "year_raw", "renovation"]), f"""{L}, c AS (SELECT 'year_raw' AS "column", count(*) - count(year_raw) AS empty FROM listings UNION ALL SELECT 'renovation', count(*) - count(renovation) FROM listings UNION ALL SELECT 'price', count(*) - count(price) FROM listings) SELECT * FROM c WHERE empty > 0""")
