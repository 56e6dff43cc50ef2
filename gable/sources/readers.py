"""Reading listings, dictionaries, gazetteers, run files and pages; writing results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, fallbacks: tuple[dict[str, str], ...] = ({"encoding": "windows-1251", "sep": ";"},)) -> DataFrame:
    """Listings as CSV with a header; other options are tried if the header does not hold the schema's columns."""
    base = {"header": "true", "multiLine": "true", "escape": '"', "mode": "PERMISSIVE"}
    wanted = set(schema.fieldNames())
    for options in ({}, *fallbacks):
        reader = spark.read.options(**base, **options)
        if wanted <= set(reader.csv(path).columns):
            return reader.schema(T.StructType([*schema])).option("enforceSchema", "false").csv(path) if reader.csv(path).columns == schema.fieldNames() else reader.csv(path).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
    raise ValueError(f"{path}: the header lacks {sorted(wanted)}")


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition: list[str] | None = None) -> None:
    """One of parquet, csv, json, orc."""
    w = df.write.mode(mode)
    if partition:
        w = w.partitionBy(*partition)
    (w.option("header", "true") if kind == "csv" else w).format(kind).save(path)


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(feature, phrase) of a JSON dictionary feature -> [phrases]."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("feature", "phrases")).select("feature", F.explode("phrases").alias("phrase"))


CV_SCHEMA = "map<string,map<string,struct<mean:double,std:double,conf_interval:double,min:double,max:double,values:array<double>>>>"


def read_fold_metrics(spark: SparkSession, path: str, scale: str = "original") -> DataFrame:
    """(file, metric, fold, value, mean) of the nested metrics of result files, one scale."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", CV_SCHEMA)[scale].alias("m"))
    rows = text.select("file", F.explode("m").alias("metric", "s"))
    return rows.select("file", "metric", F.posexplode("s.values").alias("fold", "value"), F.col("s.mean").alias("mean"))


GAZETTEER_COLUMNS = ["geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class", "feature_code", "country", "cc2", "admin1_code", "admin2_code", "admin3_code", "admin4_code", "population", "elevation", "dem", "timezone", "modified"]


def read_gazetteer(spark: SparkSession, path: str, codes: tuple[str, ...] = ("PPLC", "PPLA", "PPLA2")) -> DataFrame:
    """(name, latitude, longitude, feature_code, admin1_code) of cities in a tab-separated gazetteer of 19 columns without header."""
    schema = ", ".join(f"{c} {'double' if c in ('latitude', 'longitude') else 'string'}" for c in GAZETTEER_COLUMNS)
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)
    return cities(rows, codes)


def cities(rows: DataFrame, codes: tuple[str, ...] = ("PPLC", "PPLA", "PPLA2")) -> DataFrame:
    return rows.where(F.col("feature_code").isin(*codes)).select("name", "latitude", "longitude", "feature_code", "admin1_code")


def read_runs(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Result files named model__dataset__embedding__pca__gate.<kind>, with the configuration as columns."""
    rows = spark.read.option("header", "true").format(kind).load(path).withColumn("_file", F.col("_metadata.file_name"))
    parts = F.split(F.regexp_replace("_file", r"\.[a-z]+$", ""), "__")
    return rows.withColumns({n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(("model", "dataset", "embedding", "pca", "gate"))}).drop("_file")


def page_fields(html: Column) -> dict[str, Column]:
    """Title, first heading, language, links and paragraphs of a page, by regular expressions."""
    tags = lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))
    return {
        "title": F.regexp_extract(html, r"<title>([^<]*)</title>", 1),
        "heading": tags(F.regexp_extract(html, r"<h1>(.*?)</h1>", 1)),
        "lang": F.regexp_extract(html, r'<html lang="([a-z]*)"', 1),
        "n_items": F.size(F.regexp_extract_all(html, F.lit(r"<li>(.*?)</li>"), F.lit(1))),
        "n_paragraphs": F.size(F.regexp_extract_all(html, F.lit(r"<p>"), F.lit(0))),
    }


def extract_listings(pages: DataFrame, ident: str = "page_id", html: str = "html", closed: str = "closed-marker") -> DataFrame:
    """Pages of listings: status (parsed, closed, failed), fields by `name: value` items, price, address, coordinates."""
    h = F.col(html)
    items = F.transform(F.regexp_extract_all(h, F.lit(r"<li[^>]*>([^<:]+:[^<]*)</li>"), F.lit(1)), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"\s*(м²|сот\.|км)$", "").alias("v")))
    lat, lon = F.regexp_extract(h, r'data-map-lat="([-0-9.]+)"', 1).try_cast("double"), F.regexp_extract(h, r'data-map-lon="([-0-9.]+)"', 1).try_cast("double")
    unique = F.map_from_entries(F.aggregate(items, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x)))))
    status = F.when(h.contains(closed), "closed").when(lat.isNull() | lon.isNull(), "failed").otherwise("parsed")
    return pages.select(ident, status.alias("status"), unique.alias("fields"), F.regexp_replace(F.regexp_extract(h, r'itemprop="price" content="([^"]*)"', 1), r"\s", "").try_cast("double").alias("price"), F.nullif(F.trim(F.regexp_extract(h, r'itemprop="address"[^>]*>([^<]*)<', 1)), F.lit("")).alias("address"), lat.alias("latitude"), lon.alias("longitude"))


def url_id(url: Column, marker: str = "/") -> Column:
    """What stands between the last marker of a URL's path and its query or fragment."""
    return F.substring_index(F.regexp_replace(url, r"[?#].*$", ""), marker, -1)


def new_rows(incoming: DataFrame, *stored: DataFrame, ident: str = "id") -> DataFrame:
    """Incoming rows, one per id, whose id is in none of the stored tables."""
    known = reduce(DataFrame.unionByName, [s.select(ident) for s in stored])
    return incoming.dropDuplicates([ident]).join(known, ident, "left_anti")


def crawl_frontier(types: DataFrame, roads: DataFrame, per_page: int = 50) -> DataFrame:
    """(kind, road, page): pages 1 to ceil(n / per_page) of each pair; both tables are small dimensions with `n` the number of ads."""
    pairs = types.join(roads, F.lit(True))
    return pairs.where("n > 0").select("kind", "road", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / per_page).cast("int"))).alias("page"))
