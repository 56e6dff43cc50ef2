"""Edge cases of the analytics operators on hand-made frames, and all registered queries against their SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gable.functions import tails
from gable.functions import text as T
from gable.functions.geo import in_polygon, polygon_distance
from gable.operators import clean as C
from gable.operators import encode as E
from gable.operators import fraud as FR
from gable.operators import geo as G
from gable.operators import sampling as S
from gable.operators.nearest import PlaceTree, with_nearest
from gable.operators.order import ranked_draws, running
from gable.plans import registry
from gable.sources.readers import extract_listings, new_rows, url_id
from tests.compare import differences, duck

SLOW = {"fit_gbt", "fit_rf", "fit_linear", "cv_eval", "param_search", "word2vec", "holdout_eval", "text_pipeline"}


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 120
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_query(spark, sf, name):
    assert differences(spark, duck(sf), registry.QUERIES[name], registry.ORACLES[name], sf) == ""


def test_fraud_edges(spark):
    rows = [(1, 0.0, 5.0), (2, 0.0, 0.0), (3, None, 5.0), (4, 10.0, None), (5, 10.0, 10.0), (6, 10.0, 30.0), (7, 60e6, 105.1e6), (8, 200e6, 900e6)]
    got = {r.id: (r.relative_error, r.flag_2, r.flag_1) for r in FR.fraud_flags(spark.createDataFrame(rows, "id long, price double, predicted_price double")).collect()}
    assert got[1] == (math.inf, True, True) and got[2] == got[3] == got[4] == (None, False, False) and got[5] == (0.0, False, False)
    assert got[6] == (200.0, True, True) and got[7][1:] == (True, False) and got[8][1:] == (False, False)
    with pytest.raises(ValueError):
        FR.check_columns(spark.createDataFrame([(1,)], "id long"))


def test_years(spark):
    rows = [(i, y) for i, y in enumerate([None, 0, 7, 26, 99, 207, 2030, 1980, 1990])]
    got = {r.id: (r.year, r.yearIsNull) for r in C.clean_year(spark.createDataFrame(rows, "id int, year int")).collect()}
    assert [got[i][0] for i in range(2, 9)] == [2007, 1926, 1999, 2007, 2025, 1980, 1990] and got[0][1] == 1 and got[1][1] == 0


def test_types_are_checked(spark):
    df = spark.createDataFrame([("1.5", "x", "3")], "latitude string, longitude string, price string")
    with pytest.raises(ValueError):
        C.convert_types(df, ["price"], [], {})
    with pytest.raises(ValueError):
        C.convert_types(df, ["absent"], [], {})


def test_constant_column_and_inverse(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, None), (3, 5.0, 8.0)], "id int, a double, b double")
    fit = E.minmax_fit(df, ["a", "b"])
    out = E.minmax_apply(df, ["a", "b"], fit)
    assert [(r.a, r.b) for r in out.orderBy("id").collect()] == [(0.0, 0.0), (0.0, None), (0.0, 1.0)]
    assert [r.b for r in E.minmax_inverse(out, ["b"], fit).orderBy("id").collect()] == [2.0, None, 8.0]


def test_modes_and_labels(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "NaN")], "id int, k string")
    assert E.mode_fill(df.where("id < 4"), ["k"]).where("id = 3").first().k == "a"
    assert {r.value: r.code for r in E.label_codes(df, "k").collect()} == {"NaN": 0, "a": 1, "b": 2}


def test_labels_of_a_large_domain(spark, monkeypatch):
    monkeypatch.setattr(E, "DRAWN", 60)
    monkeypatch.setattr(E, "RANGES", 13)
    values = sorted({f"{chr(65 + i * 37 % 600)}{i}" for i in range(2000)} | {"", "NaN", "я", "😀", "￿"})
    df = spark.createDataFrame([(v,) for v in [*values, *values[:9], None]], "k string")
    assert {r.value: r.code for r in E.label_codes(df, "k").collect()} == {v: 0 if v == "NaN" else i for i, v in enumerate(values)}
    numbers = spark.range(500).withColumnRenamed("id", "k")
    assert {r.value: r.code for r in E.label_codes(numbers, "k").collect()} == {i: i for i in range(500)}


def test_bins(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([1, 1, 1, 1, 2, 3, 4, None])], "id int, v double")
    got = {r.id: r.bin for r in S.qcut(df, "v", 4).collect()}
    assert got[7] == -1 and got[0] == got[3] == 0 and got[6] == max(got.values())


def test_folds_and_ranks(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    folds = S.strat_kfold(df, "k", 5)
    assert folds.count() == 1000 and {r["count"] for r in folds.groupBy("k", "fold").count().collect()} <= {66, 67}
    got = ranked_draws(df.withColumn("u", (F.col("id") * 7919 % 1000) / 1000.0), ["k"], "u", "id", 8)
    each = got.groupBy("k").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.countDistinct("rank").alias("n"), F.max("size").alias("s")).collect()
    assert len(each) == 3 and all(r.a == 1 and r.b == r.n == r.s for r in each)
    run = running(spark.range(500).select((F.col("id") * 37 % 500).alias("v"), F.lit(1).alias("c")), "v", ["c"], buckets=8)
    assert all(r.cum_c == r.v + 1 for r in run.collect())


def test_polygon(spark):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    df = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 11.0), (3, -1.0, 5.0)], "id int, lat double, lon double")
    got = df.select("id", in_polygon(F.col("lat"), F.col("lon"), square).alias("i"), polygon_distance(F.col("lat"), F.col("lon"), square).alias("d")).orderBy("id").collect()
    assert [r.i for r in got] == [True, False, False] and got[0].d == 0 and abs(got[2].d - 111.19) < 0.1


def test_many_cities_in_shares(spark):
    points = spark.range(200).select("id", (F.col("id") * 37 % 100 / 10.0).alias("lat"), (F.col("id") * 53 % 100 / 10.0).alias("lon"))
    cities = spark.range(30).select(F.format_string("c%02d", "id").alias("name"), (F.col("id") * 61 % 97 / 10.0).alias("latitude"), (F.col("id") * 29 % 89 / 10.0).alias("longitude"))
    there = cities.collect()
    near = {p.id: min(((p.lat - c.latitude) ** 2 + (p.lon - c.longitude) ** 2, c.name) for c in there) for p in points.collect()}
    for most in (1000, 7):
        got = {r.id: r.near.name for r in with_nearest(points, cities, "lat", "lon", "near", most).collect()}
        by = {c.name: c for c in there}
        assert len(got) == 200
        for p in points.collect():
            c = by[got[p.id]]
            assert (p.lat - c.latitude) ** 2 + (p.lon - c.longitude) ** 2 == pytest.approx(near[p.id][0])


def test_dense_places_equal_brute_force():
    rng = np.random.default_rng(9)
    x, y = np.concatenate([rng.normal(0, 1e-3, 150_000), rng.uniform(-90, 90, 50_000)]), np.concatenate([rng.normal(0, 1e-3, 150_000), rng.uniform(-180, 180, 50_000)])
    x[:500], y[:500] = 0.0, 0.0  # places that coincide
    tree, px, py = PlaceTree(x, y), np.append(rng.normal(0, 0.002, 150), rng.uniform(-90, 90, 151)), np.append(rng.normal(0, 0.002, 150), rng.uniform(-180, 180, 151))
    px[300], py[300] = 0.0, 0.0
    found, d2 = tree.nearest(px, py)
    for i in range(len(px)):
        d = (px[i] - x) ** 2 + (py[i] - y) ** 2
        assert found[i] == d.argmin() and d2[i] == d.min()
    assert max(len(n[0]) for n in tree.nodes if len(n) == 1) <= 500 and PlaceTree(x[:0], y[:0]).nearest(px, py)[0].max() == -1


def test_texts(spark):
    def step(fn, text):
        return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]

    assert step(T.normalize_numbers, "1 000 000 и 54.000.000 за 1,5 млн") == "1000000 и 54000000 за 1.5 млн"
    assert step(T.normalize_numbers, "55°33'3\"N, 37°17'46\"E").startswith("55.55")
    assert step(T.dimensions, "6x8x3 и 4х5") == "6 на 8 на 3 и 4 на 5"
    assert step(T.amount_words, "1.5 млн и 20 тысяч") == "1500000 и 20000"
    assert step(T.ordinals, "на 2-м и 3-й, 10-го") == "на вторым и третий, десятого"
    assert step(T.expand_abbreviations, "ж/д, снт в лесу").startswith("железнодорожный, снт")
    assert step(T.strip_emoji, "дом 😀→") == "дом "
    assert step(T.tokens, "Ёлка йод élan a") == ["елка", "иод", "elan"]


def test_tails():
    assert abs(tails.chi2_tail(3.841, 1) - 0.05) < 1e-3 and abs(tails.t_tail(2.228, 10) - 0.05) < 1e-3
    assert abs(tails.f_tail(4.96, 1, 10) - 0.05) < 1e-3 and abs(tails.normal_tail(1.96) - 0.05) < 1e-3
    assert tails.signed_rank_tail([1, 2, 3, 4, 5], 0) == 2 / 32 and tails.kolmogorov_tail(0.0, 9, 9) == 1.0


def test_pages_and_ids(spark):
    page = '<ul><li>Площадь дома: 120 м²</li><li>Этажей: 2</li></ul><span itemprop="price" content="5 000"></span><div itemprop="address"> Тверь </div><div data-map-lat="55.1" data-map-lon="37.2">'
    rows = [(1, page), (2, "<p>closed-marker</p>"), (3, "<li>Этажей: 2</li>"), (4, None)]
    got = {r.page_id: r for r in extract_listings(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got[1].status == "parsed" and got[1].fields == {"Площадь дома": "120", "Этажей": "2"} and got[1].price == 5000 and got[1].address == "Тверь"
    assert got[2].status == "closed" and got[3].status == got[4].status == "failed"
    assert spark.createDataFrame([("http://x/a/b_77?context=1",)], "u string").select(url_id(F.col("u"), "_")).first()[0] == "77"
    df = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert new_rows(df, df.where("id = 2")).count() == 1
