"""Inputs that several queries share: the listings table, split in two 'models', and helpers for binding queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTINGS_BODY = """
 SELECT o_orderkey AS id, o_totalprice AS price,
  CAST(20 + (o_orderkey * 37) % 380 AS DOUBLE) AS house_area,
  CAST((o_orderkey * 53) % 300 AS DOUBLE) / CAST(10 AS DOUBLE) AS land_area,
  CAST(54.2 AS DOUBLE) + CAST((o_orderkey * 7919) % 2900 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
  CAST(35.2 AS DOUBLE) + CAST((o_orderkey * 104729) % 5000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 96 WHEN o_orderkey % 43 = 0 THEN 12
       WHEN o_orderkey % 47 = 0 THEN 207 WHEN o_orderkey % 53 = 0 THEN 2030 ELSE 1950 + o_orderkey % 75 END AS year_raw,
  c_mktsegment AS category,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderpriority END AS renovation,
  nullif(concat_ws(', ', CASE WHEN o_orderkey % 2 = 0 THEN 'school' END,
                         CASE WHEN o_orderkey % 3 = 0 THEN 'shop' END,
                         CASE WHEN o_orderkey % 5 = 0 THEN 'pharmacy' END), '') AS infrastructure,
  o_orderdate AS listed_at, n_name AS region,
  o_totalprice * (CAST(60 + (o_orderkey * 31) % 170 AS DOUBLE) / CAST(100 AS DOUBLE)) AS predicted_price
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
#: SQL that begins every oracle over listings.
L = f"WITH listings AS ({LISTINGS_BODY})"
#: For a further common table: L1 + ", name AS (...)".
GAZETTEER_BODY = """
 SELECT n_name AS name, CAST(54.2 AS DOUBLE) + CAST((n_nationkey * 7919) % 2900 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
  CAST(35.2 AS DOUBLE) + CAST((n_nationkey * 104729 + 311) % 5000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude,
  CASE WHEN n_nationkey % 7 = 0 THEN 'PPLC' WHEN n_nationkey % 3 = 0 THEN 'PPLA' WHEN n_nationkey % 2 = 0 THEN 'PPLA2' ELSE 'PPL' END AS feature_code,
  CAST(n_regionkey AS VARCHAR(9)) AS admin1_code
 FROM nation
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings made from orders, customers and nations."""
    k = F.col("o_orderkey")
    real = lambda c: c.cast("double")
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    year = F.when(k % 3 == 0, None).when(k % 41 == 0, 96).when(k % 43 == 0, 12).when(k % 47 == 0, 207).when(k % 53 == 0, 2030).otherwise(1950 + k % 75)
    places = F.concat_ws(", ", F.when(k % 2 == 0, "school"), F.when(k % 3 == 0, "shop"), F.when(k % 5 == 0, "pharmacy"))
    return joined.select(
        k.alias("id"),
        F.col("o_totalprice").alias("price"),
        real(20 + k * 37 % 380).alias("house_area"),
        (real(k * 53 % 300) / F.lit(10.0)).alias("land_area"),
        (F.lit(54.2) + real(k * 7919 % 2900) / F.lit(1000.0)).alias("lat"),
        (F.lit(35.2) + real(k * 104729 % 5000) / F.lit(1000.0)).alias("lon"),
        year.alias("year_raw"),
        F.col("c_mktsegment").alias("category"),
        F.when(k % 50 != 0, F.col("o_orderpriority")).alias("renovation"),
        F.nullif(places, F.lit("")).alias("infrastructure"),
        F.col("o_orderdate").alias("listed_at"),
        F.col("n_name").alias("region"),
        (F.col("o_totalprice") * (real(60 + k * 31 % 170) / F.lit(100.0))).alias("predicted_price"),
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities made from nations."""
    k = F.col("n_nationkey")
    code = F.when(k % 7 == 0, "PPLC").when(k % 3 == 0, "PPLA").when(k % 2 == 0, "PPLA2").otherwise("PPL")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        (F.lit(54.2) + (k * 7919 % 2900).cast("double") / F.lit(1000.0)).alias("latitude"),
        (F.lit(35.2) + ((k * 104729 + 311) % 5000).cast("double") / F.lit(1000.0)).alias("longitude"),
        code.alias("feature_code"),
        F.col("n_regionkey").cast("string").alias("admin1_code"),
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """df with its doubles rounded half away from zero after scaling, so that the order of summation does not show; -0.0 becomes 0.0."""
    scale = F.lit(float(10**digits))
    return df.select(*[(F.round(F.col(f"`{c}`") * scale, 0) / scale + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


class Book:
    """Queries and their SQL, by name."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def bind(fn):
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return bind

    def on_listings(self, name: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        """A query that is one operator over the listings."""
        self.add(name, sql)(lambda spark, sf_dir: fn(listings(spark, sf_dir)))
