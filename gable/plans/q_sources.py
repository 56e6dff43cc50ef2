"""Queries: sources, sinks, ingestion and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from gable.operators import encode as E
from gable.operators import metrics as M
from gable.operators import models as MD
from gable.operators import pipeline as PL
from gable.operators import sampling as S
from gable.plans.base import GAZETTEER_BODY, Book, L, gazetteer, listings, rounded, table
from gable.plans.q_clean import MODE, PRIO, YEAR
from gable.operators.stages import TermWeights
from gable.operators.store import scratch
from gable.plans.q_text import book as TEXTS
from gable.sources import readers as R
from gable.streaming.ingest import ingest

book = Book()


@book.add("src_csv", f"{L} SELECT id, price, category, region FROM listings")
def src_csv(s, d):
    path = scratch(s)
    rows = listings(s, d).select("id", "price", "category", "region")
    R.write(rows, path, "csv")
    return R.read_csv(s, path, rows.schema)


@book.add("sink_roundtrip", f"{L} SELECT category, count(*) AS n, round(avg(price), 4) AS price FROM listings GROUP BY 1")
def sink_roundtrip(s, d):
    path = scratch(s)
    R.write(rounded(listings(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("price"))), path, "json")
    return s.read.schema("category string, n long, price double").json(path)


@book.add("src_phrase_dict", "SELECT r_name AS feature, n_name AS phrase FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_phrase_dict(s, d):
    path = scratch(s)
    pairs = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list("n_name").alias("ps"))
    pairs.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "ps"))).alias("m")).select(F.to_json("m").alias("value")).write.text(path)
    return R.read_phrases(s, path)


@book.add("src_cv_json", f"{L} SELECT 'rmse' AS metric, id % 5 AS fold, round(sqrt(avg((price - predicted_price) ** 2)), 4) AS value FROM listings GROUP BY 2")
def src_cv_json(s, d):
    path = scratch(s)
    folds = listings(s, d).groupBy((F.col("id") % 5).alias("fold")).agg(M.rmse("price", "predicted_price").alias("v"))
    vs = folds.agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "v"))), lambda x: x["v"]).alias("values"), F.avg("v").alias("mean"))
    vs.select(F.to_json(F.create_map(F.lit("original"), F.create_map(F.lit("rmse"), F.struct("mean", "values")))).alias("value")).coalesce(1).write.text(path)
    return rounded(R.read_fold_metrics(s, path).select("metric", F.col("fold").cast("long").alias("fold"), "value"))


@book.add("src_gazetteer", f"WITH g AS ({GAZETTEER_BODY}) SELECT name, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, feature_code, admin1_code FROM g WHERE feature_code IN ('PPLC', 'PPLA', 'PPLA2')")
def src_gazetteer(s, d):
    path = scratch(s)
    g = gazetteer(s, d)
    g.select(*[F.col(c).cast("string") if c in g.columns else F.lit("x").alias(c) for c in R.GAZETTEER_COLUMNS]).write.option("sep", "\t").csv(path)
    return rounded(R.read_gazetteer(s, path))


@book.add("src_run_files", f"{L} SELECT category AS model, 'full' AS dataset, 'none' AS embedding, round(avg(price), 4) AS price FROM listings GROUP BY 1")
def src_run_files(s, d):
    path = scratch(s)
    means = rounded(listings(s, d).groupBy("category").agg(F.avg("price").alias("price")))
    for r in means.collect():  # one small file for each configuration, as runs leave them
        part = f"{path}/tmp-{r['category']}"
        means.where(F.col("category") == r["category"]).select("price").coalesce(1).write.option("header", "true").csv(part)
        jvm, conf = s._jvm.org.apache.hadoop.fs, s._jsc.hadoopConfiguration()
        fs = jvm.Path(path).getFileSystem(conf)
        name = next(x.getPath() for x in fs.listStatus(jvm.Path(part)) if x.getPath().getName().startswith("part-"))
        fs.rename(name, jvm.Path(f"{path}/{r['category']}__full__none__0__0.csv"))
        fs.delete(jvm.Path(part), True)
    return R.read_runs(s, path).select("model", "dataset", "embedding", F.col("price").cast("double").alias("price"))


book.add(
    "extract_pages",
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
 CAST(len(regexp_extract_all(html, '<li>(.*?)</li>')) AS INTEGER) AS n_items, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_paragraphs FROM pages""",
)(lambda s, d: table(s, d, "pages").select("page_id", *[c.alias(n) for n, c in R.page_fields(F.col("html")).items() if n != "heading"]))
book.add("url_id", "SELECT page_id, list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) AS id FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", R.url_id(F.col("url")).alias("id")))


@book.add("ingest_dedup", "SELECT DISTINCT event_id AS id FROM events WHERE event_id % 3 <> 0 AND event_id % 2 <> 0 AND event_id % 5 <> 0")
def ingest_dedup(s, d):
    """Ids that come in, some twice, against two stored tables that hold some of them."""
    e = table(s, d, "events").select(F.col("event_id").alias("id"))
    come = e.where("id % 3 <> 0")
    return R.new_rows(come.unionByName(come.where("id % 7 = 0")), e.where("id % 2 = 0"), e.where("id % 5 = 0"))


def ad_pages(s, d):
    """Listings as pages of a portal: some closed, some without coordinates."""
    k, text = F.col("id"), lambda c: c.cast("string")
    item = lambda name, value: F.concat(F.lit(f'<li class="i">{name}: '), value, F.lit("</li>"))
    place = F.when(k % 13 != 0, F.concat(F.lit('<div data-map-lat="'), text(F.round("lat", 3)), F.lit('" data-map-lon="'), text(F.round("lon", 3)), F.lit('"></div>'))).otherwise("")
    parts = [
        F.lit("<html><ul>"), item("Площадь дома", F.concat(text((20 + k * 37 % 380)), F.lit(" м²"))), item("Площадь участка", F.concat(text(k % 30), F.lit(" сот."))), item("Материал", F.coalesce("category", F.lit(""))), F.lit("<li>без значения</li></ul>"),
        F.lit('<span itemprop="price" content="'), F.format_string("%d %03d", F.floor(k / 1000), k % 1000), F.lit('"></span><span itemprop="address" class="a"> '), F.col("region"), F.lit(" </span>"), place, F.when(k % 17 == 0, "<b>closed-marker</b>").otherwise(""),
    ]
    return listings(s, d).select("id", F.concat(*parts).alias("html"))


book.add(
    "extract_listings",
    f"""{L} SELECT id, CASE WHEN id % 17 = 0 THEN 'closed' WHEN id % 13 = 0 THEN 'failed' ELSE 'parsed' END AS status, CAST(20 + (id * 37) % 380 AS VARCHAR) AS house_area, CAST(id % 30 AS VARCHAR) AS land_area, category AS material, 3 AS n_fields,
 CAST(id AS DOUBLE) AS price, region AS address, CASE WHEN id % 13 <> 0 THEN round(lat, 3) END AS latitude, CASE WHEN id % 13 <> 0 THEN round(lon, 3) END AS longitude FROM listings""",
)(
    lambda s, d: R.extract_listings(ad_pages(s, d), "id").select(
        "id", "status", F.col("fields")["Площадь дома"].alias("house_area"), F.col("fields")["Площадь участка"].alias("land_area"), F.col("fields")["Материал"].alias("material"), F.size("fields").alias("n_fields"), "price", "address", "latitude", "longitude"
    )
)


@book.add("ingest_dedup_stream", "SELECT user_id AS id, count(*) > 0 AS seen FROM events GROUP BY 1")
def ingest_dedup_stream(s, d):
    source = table(s, d, "events")
    where = scratch(s)
    events = s.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    query = ingest(events, f"{where}/table", f"{where}/state")
    query.awaitTermination()
    return s.read.parquet(f"{where}/table").select("id", F.lit(True).alias("seen"))


book.add("crawl_frontier", "SELECT r_name AS kind, c_mktsegment AS road, CAST(unnest(range(1, CAST(ceil(count(*) / 50.0) AS BIGINT) + 1)) AS INTEGER) AS page FROM region, customer GROUP BY 1, 2")(
    lambda s, d: R.crawl_frontier(table(s, d, "region").select(F.col("r_name").alias("kind")), table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("road")).agg(F.count(F.lit(1)).alias("n")))
)

# ---- models: log price from areas and place
FEATURES = ["house_area", "land_area", "lat", "lon", "predicted_price"]
framed = lambda s, d: E.log_features(listings(s, d), ["price", "predicted_price"]).select("id", "price", *FEATURES)
split = lambda s, d: S.strat_split(S.qcut(framed(s, d), "price", 10), "bin")


def holdout(s, d, learner, **params):
    rows = split(s, d)
    model = MD.fit(rows.where("part = 'train'"), learner, FEATURES, "price", **params)
    return rounded(M.metrics_by(model.transform(rows.where("part = 'test'")), [], "price", "prediction"))




@book.add("assemble", f"{L} SELECT id, " + ", ".join(f"round({'ln(1 + predicted_price)' if c == 'predicted_price' else c}, 4) AS f{i}" for i, c in enumerate(FEATURES)) + " FROM listings WHERE id % 3 <> 0")
def assemble(s, d):
    """The assembled vector's values; rows with a missing feature (every third year is unknown) are left out."""
    from pyspark.ml.functions import vector_to_array

    rows = framed(s, d).withColumn("lat", F.when(F.col("id") % 3 != 0, F.col("lat")))
    v = MD.assemble(FEATURES).transform(rows).select("id", vector_to_array("features").alias("v"))
    return rounded(v.select("id", *[F.col("v")[i].alias(f"f{i}") for i in range(len(FEATURES))]))


@book.add("assemble_text")
def assemble_text(s, d):
    """Numbers beside TF-IDF weights of a text column, as one pipeline; the vector's length and the sum of its weights."""
    from pyspark.ml.functions import vector_to_array

    rows = worded(s, d)
    v = MD.with_text(FEATURES, "words", 64).fit(rows).transform(rows).select("id", vector_to_array("features").alias("v"))
    return v.select("id", F.size("v").alias("n_features"), F.aggregate(F.slice("v", len(FEATURES) + 1, 64), F.lit(0.0), lambda a, x: a + x).alias("terms"))


book.add("fit_gbt")(lambda s, d: holdout(s, d, "gbt", maxIter=5, maxDepth=3))
book.add("fit_rf")(lambda s, d: holdout(s, d, "rf", numTrees=5, maxDepth=5))
book.add("fit_linear")(lambda s, d: holdout(s, d, "linear"))
book.add("fit_svr")(lambda s, d: holdout(s, d, "svr", c=0.01, epsilon=0.1))


@book.add("holdout_eval")
def holdout_eval(s, d):
    """Metrics of the held-out part on the log and the original scale."""
    rows = split(s, d)
    model = MD.fit(rows.where("part = 'train'"), "linear", FEATURES, "price", regParam=0.01)
    return rounded(MD.both_scales(model.transform(rows.where("part = 'test'")), [], "price", "prediction"))


book.add("cv_eval")(lambda s, d: rounded(MD.cross_validate(S.strat_kfold(S.qcut(framed(s, d), "price", 10), "bin", 3), "fold", 3, "linear", FEATURES, "price", scales=True)))
worded = lambda s, d: framed(s, d).join(listings(s, d).select("id", F.concat_ws(" ", "category", "region").alias("words")), "id")
SPACE = {"learner": ["linear", "rf", "svr"], "text": ["words"], "terms": [4, 8], "regParam": {"of": ("log", 1e-3, 1.0), "when": {"learner": ["linear"]}}, "numTrees": {"of": (3, 6), "when": {"learner": ["rf"]}}, "c": {"of": ("log", 1e-3, 1.0), "when": {"learner": ["svr"]}}}
book.add("param_search")(lambda s, d: MD.search(S.strat_kfold(S.qcut(worded(s, d), "price", 10), "bin", 3), "fold", 3, "linear", FEATURES, "price", SPACE, 6))


@book.add("tfidf_stage", TEXTS.oracles["tfidf"])
def tfidf_stage(s, d):
    """The weights of the TF-IDF stage over all terms, written with a pipeline and read back, as a long table."""
    from pyspark.ml import Pipeline, PipelineModel

    rows, path = table(s, d, "documents"), scratch(s)
    Pipeline(stages=[TermWeights("text", "weights", "doc_id", None, minDF=5, maxDF=0.5, sublinear=True)]).fit(rows).save(path)
    return rounded(PipelineModel.load(path).transform(rows).select("doc_id", F.inline("weights")))


@book.add("model_roundtrip")
def model_roundtrip(s, d):
    from pyspark.ml import PipelineModel

    path, rows = scratch(s), framed(s, d)
    MD.fit(rows, "linear", FEATURES, "price").write().overwrite().save(path)
    return rounded(PipelineModel.load(path).transform(rows).select("id", "prediction"))


class Formula:
    """A model whose predictions SQL can repeat: rows with a missing year are left out."""

    def transform(self, df):
        return df.where("year_raw IS NOT NULL").withColumn("prediction", F.expr("0.5 * price + 100 * house_area"))


book.on_listings("score_join", lambda d: rounded(MD.score(d, Formula()).select("id", "prediction")), f"{L} SELECT id, CASE WHEN year_raw IS NOT NULL THEN round(0.5 * price + 100 * house_area, 4) END AS prediction FROM listings")


class Share:
    """A model on scaled features whose predictions SQL can repeat."""

    def transform(self, df):
        return df.withColumn("prediction", F.expr("0.5 * house_area + 0.25"))


SCORED = PL.Spec(year="year_raw", fill=["renovation"], outliers=["price"], logged=["price", "house_area"], geo=["lat", "lon"])
book.on_listings(
    "score_chain",
    lambda d: rounded(PL.score(d.where("id % 2 = 0"), SCORED, PL.fit(d, SCORED), Share(), ["house_area", "lat", "absent"], "price").select("id", "prediction"), 2),
    f"{L}, f AS (SELECT min(ln(1 + price)) AS a, max(ln(1 + price)) AS b, min(ln(1 + house_area)) AS c, max(ln(1 + house_area)) AS e FROM listings) SELECT id, round(exp(a + (0.5 * (ln(1 + house_area) - c) / (e - c) + 0.25) * (b - a)) - 1, 2) AS prediction FROM listings, f WHERE id % 2 = 0",
)


def restored(d):
    fitted = PL.fit(d, RESTORED)
    return PL.restore(PL.transform(d, RESTORED, fitted), RESTORED, fitted)


RESTORED = PL.Spec(year="year_raw", fill=["renovation"], one_hot={"renovation": {v: v[0] for v in PRIO}}, outliers=["price"], logged=["price", "house_area"], geo=["lat", "lon"])
book.on_listings(
    "features_restore",
    lambda d: rounded(restored(d).select("id", "price", "house_area", "lat", "lon", "renovation"), 2),
    f"{L}{MODE} SELECT id, round(price, 2) AS price, round(house_area, 2) AS house_area, round(lat, 2) AS lat, round(lon, 2) AS lon, coalesce(renovation, m) AS renovation FROM listings, mo",
)


@book.add("features_saved", f"{L}{YEAR}, q AS (SELECT quantile_cont(price, 0.01) AS pl, quantile_cont(price, 0.99) AS pu FROM listings), f AS (SELECT min(ln(1 + price)) AS n1, max(ln(1 + price)) AS x1, min(ln(1 + house_area)) AS n2, max(ln(1 + house_area)) AS x2, min(lat) AS n4, max(lat) AS x4, min(lon) AS n5, max(lon) AS x5 FROM listings) SELECT id, CAST(price < pl OR price > pu AS INTEGER) AS is_outlier, round((ln(1 + price) - n1) / (x1 - n1), 4) AS price, round((ln(1 + house_area) - n2) / (x2 - n2), 4) AS house_area, round(-1 + 2 * (lat - n4) / (x4 - n4), 4) AS lat, round(-1 + 2 * (lon - n5) / (x5 - n5), 4) AS lon, year, was_null AS \"yearIsNull\" FROM listings JOIN yr USING (id), q, f WHERE id % 5 = 0")
def features_saved(s, d):
    """Fitted tables written with the model and read back give the rows that they gave before."""
    rows, path = listings(s, d), scratch(s)
    PL.fit(rows, SCORED).save(path)
    return rounded(PL.transform(rows.where("id % 5 = 0"), SCORED, PL.Fitted.load(s, path)))


book.add("config_sweep")(lambda s, d: rounded(MD.sweep(S.strat_kfold(S.qcut(framed(s, d), "price", 10), "bin", 2), "fold", 2, "price", [{"learner": "linear", "features": FEATURES}, {"learner": "linear", "features": FEATURES[:2], "regParam": 0.5}, {"learner": "linear", "features": ["absent"]}])))
