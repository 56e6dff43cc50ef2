"""Queries: typing, repair, filters, encodings, scaling, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gable.operators import clean as C
from gable.operators import encode as E
from gable.operators import pipeline as PL
from gable.operators import sampling as S
from gable.plans.base import Book, L, rounded, table

book = Book()

# ---- projection, typing, filters
book.on_listings(
    "rename_map",
    lambda d: rounded(C.rename(d.select("id", F.col("house_area").alias("Площадь дома"), F.col("land_area").alias("Площадь участка"), "lat", "lon", "price"))),
    f"{L} SELECT id, house_area AS \"houseArea\", round(land_area, 4) AS \"landArea\", round(lat, 4) AS latitude, round(lon, 4) AS longitude, price FROM listings",
)
book.on_listings("default_col", lambda d: C.with_default(d.select("id", "category"), "region", "unknown"), f"{L} SELECT id, category, 'unknown' AS region FROM listings")
RAW = """, raw AS (SELECT id, CAST(lat AS VARCHAR) AS latitude, CAST(lon AS VARCHAR) AS longitude, CASE WHEN id % 17 = 0 THEN 'n/a' WHEN id % 19 = 0 THEN NULL ELSE CAST(CAST(floor(price) AS BIGINT) AS VARCHAR) END AS price,
 CASE WHEN id % 23 = 0 THEN 'много' ELSE CAST(CAST(house_area AS INTEGER) AS VARCHAR) END AS house_area,
 CASE id % 12 WHEN 10 THEN '10 и больше' WHEN 11 THEN 'Свободная планировка' ELSE CAST(id % 12 AS VARCHAR) END AS rooms, CASE id % 4 WHEN 3 THEN '4 и больше' ELSE CAST(id % 4 AS VARCHAR) END AS floors FROM listings)"""


def raw(d):
    k, text = F.col("id"), lambda c, t: F.col(c).cast(t).cast("string")
    return d.select(
        "id",
        text("lat", "double").alias("latitude"),
        text("lon", "double").alias("longitude"),
        F.when(k % 17 == 0, "n/a").when(k % 19 == 0, None).otherwise(F.floor("price").cast("string")).alias("price"),
        F.when(k % 23 == 0, "много").otherwise(text("house_area", "int")).alias("house_area"),
        F.when(k % 12 == 10, "10 и больше").when(k % 12 == 11, "Свободная планировка").otherwise((k % 12).cast("string")).alias("rooms"),
        F.when(k % 4 == 3, "4 и больше").otherwise((k % 4).cast("string")).alias("floors"),
    )


book.on_listings(
    "coerce_types",
    lambda d: rounded(C.convert_types(raw(d), ["price"], ["house_area"], {"rooms": C.ROOM_WORDS, "floors": C.FLOOR_WORDS})),
    f"""{L}{RAW} SELECT id, round(CAST(latitude AS DOUBLE), 4) AS latitude, round(CAST(longitude AS DOUBLE), 4) AS longitude, CAST(coalesce(try_cast(price AS DOUBLE), 0) AS BIGINT) AS price,
 coalesce(try_cast(house_area AS DOUBLE), 0) AS house_area, CAST(CASE rooms WHEN '10 и больше' THEN '10' WHEN 'Свободная планировка' THEN '0' ELSE rooms END AS INTEGER) AS rooms,
 CAST(CASE floors WHEN '4 и больше' THEN '4' ELSE floors END AS INTEGER) AS floors FROM raw""",
)
book.on_listings(
    "coerce_locale_num",
    lambda d: rounded(d.select("id", F.when(F.col("id") % 9 == 0, "нет").otherwise(F.concat(F.lit("1 "), (F.col("id") % 900 + 100).cast("string"), F.lit(","), (F.col("id") % 10).cast("string"))).alias("v")).select("id", C.local_number(F.col("v")).alias("number"))),
    f"{L} SELECT id, CASE WHEN id % 9 <> 0 THEN CAST('1' || CAST(id % 900 + 100 AS VARCHAR) || '.' || CAST(id % 10 AS VARCHAR) AS DOUBLE) END AS number FROM listings",
)
TEXTS = """, t AS (SELECT id, CASE id % 6 WHEN 0 THEN 'Продам ДОЛЮ в доме' WHEN 1 THEN NULL WHEN 2 THEN 'уютный дом' WHEN 3 THEN 'продам 1/2 дома' WHEN 4 THEN 'тёплый дом, 025 дома рядом' ELSE 'дача' END AS description_raw,
 CASE id % 5 WHEN 0 THEN 'Реализация на торгах' WHEN 1 THEN NULL ELSE 'возможна ипотека' END AS sale_method, CASE id % 7 WHEN 0 THEN 'фермерское хозяйство' WHEN 1 THEN NULL ELSE 'снт' END AS land_category FROM listings)"""


def texts(d):
    k = F.col("id")
    return d.select(
        "id",
        F.when(k % 6 == 0, "Продам ДОЛЮ в доме").when(k % 6 == 1, None).when(k % 6 == 2, "уютный дом").when(k % 6 == 3, "продам 1/2 дома").when(k % 6 == 4, "тёплый дом, 025 дома рядом").otherwise("дача").alias("description_raw"),
        F.when(k % 5 == 0, "Реализация на торгах").when(k % 5 == 1, None).otherwise("возможна ипотека").alias("sale_method"),
        F.when(k % 7 == 0, "фермерское хозяйство").when(k % 7 == 1, None).otherwise("снт").alias("land_category"),
    )


LIKE = " OR ".join(f"lower(description_raw) LIKE '%{p}%'" for p in C.DESCRIPTION_PHRASES)
book.on_listings(
    "drop_phrases",
    lambda d: C.drop_phrases(texts(d), {"description_raw": C.DESCRIPTION_PHRASES, "sale_method": C.SALE_METHODS}, {"land_category": C.LAND_CATEGORY}),
    f"{L}{TEXTS} SELECT * FROM t WHERE NOT coalesce({LIKE}, false) AND NOT coalesce(lower(sale_method) LIKE '%реализация на торгах%' OR lower(sale_method) LIKE '%продажа доли%', false) AND land_category IS DISTINCT FROM 'фермерское хозяйство'",
)
book.on_listings("drop_cols", lambda d: rounded(d.drop("infrastructure", "listed_at", "region", "lat", "lon", "predicted_price")), f"{L} SELECT id, price, house_area, round(land_area, 4) AS land_area, year_raw, category, renovation FROM listings")
book.on_listings("align_features", lambda d: rounded(C.align_features(d.drop("lat"), ["house_area", "rooms", "land_area", "id"])), f"{L} SELECT house_area, 0 AS rooms, round(land_area, 4) AS land_area, id FROM listings")
book.add("feature_set", "SELECT doc_id, lang, n_chars, coalesce(CASE WHEN doc_id % 5 <> 0 THEN text END, '') AS text FROM documents")(
    lambda s, d: C.feature_set(table(s, d, "documents").withColumn("text", F.expr("CASE WHEN doc_id % 5 <> 0 THEN text END")), "mixed", "text", ["doc_id", "lang", "n_chars"])
)
book.on_listings("head_n", lambda d: C.head_n(d.select("id", "price"), 300), f"{L} SELECT id, price FROM listings ORDER BY id LIMIT 300")
book.add("set_difference", "SELECT DISTINCT c_nationkey AS nationkey FROM customer EXCEPT SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000")(
    lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("nationkey")).subtract(table(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))
)
book.add("set_intersect", "SELECT DISTINCT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT DISTINCT s_nationkey FROM supplier")(
    lambda s, d: table(s, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nationkey")).intersect(table(s, d, "supplier").select("s_nationkey"))
)
PARAM = "CASE o_orderkey % 7 WHEN 0 THEN 'None' WHEN 1 THEN 'True' WHEN 2 THEN 'false' WHEN 3 THEN CAST(o_orderkey AS {s}) WHEN 4 THEN CONCAT(CAST(o_orderkey AS {s}), '.5') WHEN 5 THEN '1e-4' ELSE o_orderpriority END"
book.add(
    "typed_params",
    f"""WITH p AS (SELECT o_orderkey AS key, {PARAM.format(s='VARCHAR')} AS value FROM orders),
k AS (SELECT *, CASE WHEN lower(value) IN ('none', '') THEN 'none' WHEN lower(value) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN 'int'
 WHEN regexp_full_match(value, '[+-]?[0-9]*\\.?[0-9]*([eE][+-]?[0-9]+)?') THEN 'double' ELSE 'string' END AS kind FROM p)
SELECT key, kind, CASE WHEN kind = 'bool' THEN lower(value) = 'true' END AS as_bool, CASE WHEN kind = 'int' THEN CAST(value AS BIGINT) END AS as_int,
 CASE WHEN kind IN ('int', 'double') THEN CAST(value AS DOUBLE) END AS as_double, CASE WHEN kind = 'string' THEN value END AS as_string FROM k""",
)(lambda s, d: C.typed_params(table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.expr(PARAM.format(s="STRING")).alias("value"))))
book.on_listings(
    "best_config_lookup",
    lambda d: rounded(C.matching(d.groupBy("category", "renovation").agg(F.avg("price").alias("score")), d.groupBy("category").agg(F.max_by("renovation", "price").alias("renovation")), ["category", "renovation"])),
    f"{L}, s AS (SELECT category, renovation, avg(price) AS score FROM listings GROUP BY 1, 2), b AS (SELECT category, max_by(renovation, price) AS renovation FROM listings GROUP BY 1) SELECT category, renovation, round(score, 4) AS score FROM s JOIN b USING (category, renovation)",
)

# ---- cleaning and encoding
YEAR_CASE = "CASE WHEN v BETWEEN 26 AND 99 THEN v + 1900 WHEN v BETWEEN 0 AND 25 THEN v + 2000 WHEN v BETWEEN 100 AND 999 THEN 2000 + v % 100 ELSE v END"
YEAR = f", ym AS (SELECT median(year_raw) AS m FROM listings WHERE year_raw <> 0), yv AS (SELECT id, CAST(year_raw IS NULL AS INTEGER) AS was_null, CAST(trunc(least(CASE WHEN year_raw IS NULL OR year_raw = 0 THEN m ELSE year_raw END, 2025)) AS INTEGER) AS v FROM listings, ym), yr AS (SELECT id, was_null, {YEAR_CASE} AS year FROM yv)"
book.on_listings("clean_year", lambda d: C.clean_year(d.select("id", F.col("year_raw").alias("year"))), f'{L}{YEAR} SELECT id, year, was_null AS "yearIsNull" FROM yr')
MODE = ", mo AS (SELECT renovation AS m FROM listings WHERE renovation IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, renovation LIMIT 1)"
book.on_listings("mode_fill", lambda d: E.mode_fill(d.select("id", "renovation", "category"), ["renovation", "category"]), f"{L}{MODE} SELECT id, coalesce(renovation, m) AS renovation, category FROM listings, mo")
book.on_listings("nan_category", lambda d: d.select("id", E.nan_category(F.col("renovation"), ("нет", "5-LOW")).alias("renovation")), f"{L} SELECT id, CASE WHEN renovation IS NULL OR renovation = '5-LOW' THEN 'NaN' ELSE renovation END AS renovation FROM listings")
book.on_listings(
    "detect_roles",
    lambda d: E.detect_roles(d.withColumn("even", F.when(F.col("id") % 2 == 0, "yes")), ["category", "infrastructure", "even"]),
    f"""{L} SELECT 'category' AS "column", bool_or(category LIKE '%,%') AS has_comma, count(DISTINCT category) AS n_distinct, 'category' AS role FROM listings
 UNION ALL SELECT 'infrastructure', bool_or(infrastructure LIKE '%,%'), count(DISTINCT infrastructure), 'list' FROM listings UNION ALL SELECT 'even', false, 1, 'binary'""",
)
PLACES = {"school": "school", "shop": "shop", "pharmacy": "pharmacy"}
HOT = ", ".join(f"CAST(coalesce(list_contains(list_transform(string_split(infrastructure, ','), lambda x: trim(x)), '{p}'), false) AS INTEGER) AS infrastructure_{p}" for p in PLACES)
book.on_listings("multi_hot", lambda d: E.multi_hot(d.select("id", "infrastructure"), "infrastructure", {p: p for p in E.list_domain(d, "infrastructure")}).drop("infrastructure"), f"{L} SELECT id, {HOT} FROM listings")
KIND = {"BUILDING": "house", "MACHINERY": "cottage", "FURNITURE": "dacha"}
ONE = ", ".join(f"CAST(category = '{v}' AS INTEGER) AS category_{n}" for v, n in KIND.items())
book.on_listings("one_hot_map", lambda d: E.one_hot(d.select("id", "category"), "category", KIND).drop("category"), f"{L} SELECT id, {ONE} FROM listings")
PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
book.on_listings(
    "one_hot_values",
    lambda d: E.one_hot_observed(d.select("id", "renovation"), "renovation").drop("renovation"),
    f"{L} SELECT id, " + ", ".join(f"CAST(coalesce(renovation = '{v}', false) AS INTEGER) AS \"renovation_{v}\"" for v in PRIO) + " FROM listings",
)
LABEL = ", lv AS (SELECT DISTINCT coalesce(renovation, 'NaN') AS r FROM listings), lc AS (SELECT r, CAST(CASE WHEN r = 'NaN' THEN 0 ELSE row_number() OVER (ORDER BY r) - 1 END AS INTEGER) AS code FROM lv)"
book.on_listings("label_encode", lambda d: E.label_encode(d.select("id", E.nan_category(F.col("renovation")).alias("renovation")), "renovation"), f"{L}{LABEL} SELECT id, r AS renovation, code AS renovation_code FROM listings JOIN lc ON r = coalesce(renovation, 'NaN')")
book.on_listings("decode_categories", lambda d: E.one_hot(d.select("id", "category"), "category", KIND).select("id", E.decode(d, "category", KIND).alias("category")), f"{L} SELECT id, CASE WHEN category IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN category END AS category FROM listings")
PHRASES = {"article": ["the ", "der ", "le "], "junk": ["%%%", "***", "&&&"], "rights": ["rights reserved"]}
book.add(
    "phrase_flags",
    "SELECT doc_id, " + ", ".join("CAST(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in ps) + f" AS INTEGER) AS text_{f}" for f, ps in PHRASES.items()) + " FROM documents",
)(lambda s, d: E.phrase_flags(table(s, d, "documents").select("doc_id", "text"), "text", PHRASES).drop("text"))
NUM = ["price", "house_area", "land_area"]
BOUND = ", b AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS l_{c}, quantile_cont({c}, 0.99) AS u_{c}" for c in NUM) + " FROM listings{w})"
FLAG = ", ".join(f"CAST({c} < l_{c} OR {c} > u_{c} AS INTEGER) AS is_{c}_outlier" for c in NUM)
ANY = "CAST(" + " OR ".join(f"{c} < l_{c} OR {c} > u_{c}" for c in NUM) + " AS INTEGER) AS is_outlier"
book.on_listings("outlier_flags", lambda d: E.mark_outliers(d.select("id", *NUM), NUM).drop(*NUM), f"{L}{BOUND.format(w='')} SELECT id, {FLAG}, {ANY} FROM listings, b")
book.on_listings("outlier_apply", lambda d: E.mark_outliers(d.where("id % 3 = 0").select("id", *NUM), NUM, E.bounds(d.where("id % 3 <> 0"), NUM)).drop(*NUM), f"{L}{BOUND.format(w=' WHERE id % 3 <> 0')} SELECT id, {FLAG}, {ANY} FROM listings, b WHERE id % 3 = 0")
book.on_listings("outlier_remove", lambda d: rounded(E.remove_outliers(d.select("id", *NUM), NUM)), f"{L}{BOUND.format(w='')} SELECT id, price, house_area, round(land_area, 4) AS land_area FROM listings, b WHERE " + " AND ".join(f"{c} BETWEEN l_{c} AND u_{c}" for c in NUM))
book.on_listings("log_features", lambda d: rounded(E.log_features(E.log_features(d.select("id", "price", "land_area"), ["price", "absent"]), ["land_area"], 1.0)), f"{L} SELECT id, round(ln(1 + price), 4) AS price, round(ln(1 + land_area + 1), 4) AS land_area FROM listings")
FIT = ", f AS (SELECT " + ", ".join(f"min({c}) AS n_{c}, max({c}) AS x_{c}" for c in [*NUM, "lat", "lon"]) + " FROM listings)"
book.on_listings("minmax_fit", lambda d: rounded(E.minmax_fit(d, [*NUM, "lat"])), " UNION ALL ".join((L if i == 0 else "") + f" SELECT '{c}' AS \"column\", round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM listings" for i, c in enumerate([*NUM, "lat"])))


def scaled(d):
    geo = ["lat", "lon"]
    both = E.minmax_fit(d, [*NUM, *geo])
    return E.minmax_apply(E.minmax_apply(d.select("id", *NUM, *geo), NUM, both), geo, both, -1.0, 1.0)


book.on_listings("minmax_apply", lambda d: rounded(scaled(d)), f"{L}{FIT} SELECT id, " + ", ".join(f"round(({c} - n_{c}) / (x_{c} - n_{c}), 4) AS {c}" for c in NUM) + ", " + ", ".join(f"round(-1 + 2 * ({c} - n_{c}) / (x_{c} - n_{c}), 4) AS {c}" for c in ("lat", "lon")) + " FROM listings, f")
book.on_listings("minmax_inverse", lambda d: rounded(E.minmax_inverse(scaled(d), NUM, E.minmax_fit(d, NUM)).drop("lat", "lon"), 3), f"{L} SELECT id, round(price, 3) AS price, house_area, round(land_area, 3) AS land_area FROM listings")


def price_back(d):
    logged = E.log_features(d.select("id", "price"), ["price"])
    fit = E.minmax_fit(logged, ["price"])
    return E.minmax_inverse(E.minmax_apply(logged, ["price"], fit), ["price"], fit, logged=("price",))


book.on_listings("price_inverse", lambda d: rounded(price_back(d), 2), f"{L} SELECT id, round(price, 2) AS price FROM listings")

# ---- full feature pipelines: fitted on all rows, applied to every third
TRAIN = f"""{L}{YEAR}{MODE}, q AS (SELECT quantile_cont(price, 0.01) AS pl, quantile_cont(price, 0.99) AS pu, quantile_cont(house_area, 0.01) AS hl, quantile_cont(house_area, 0.99) AS hu FROM listings),
f AS (SELECT min(ln(1 + price)) AS n1, max(ln(1 + price)) AS x1, min(ln(1 + house_area)) AS n2, max(ln(1 + house_area)) AS x2, min(ln(1 + land_area)) AS n3, max(ln(1 + land_area)) AS x3, min(lat) AS n4, max(lat) AS x4, min(lon) AS n5, max(lon) AS x5 FROM listings)
SELECT id, CAST(price < pl OR price > pu OR house_area < hl OR house_area > hu AS INTEGER) AS is_outlier, round((ln(1 + price) - n1) / (x1 - n1), 4) AS price, round((ln(1 + house_area) - n2) / (x2 - n2), 4) AS house_area,
 round((ln(1 + land_area) - n3) / (x3 - n3), 4) AS land_area, round(-1 + 2 * (lat - n4) / (x4 - n4), 4) AS lat, round(-1 + 2 * (lon - n5) / (x5 - n5), 4) AS lon, year, was_null AS "yearIsNull",
 {', '.join(f"CAST(coalesce(renovation, m) = '{v}' AS INTEGER) AS renovation_{v[0]}" for v in PRIO)}, {HOT}
 FROM listings JOIN yr USING (id), mo, q, f"""
SPEC = PL.Spec(year="year_raw", fill=["renovation"], one_hot={"renovation": {v: v[0] for v in PRIO}}, multi_hot={"infrastructure": PLACES}, outliers=["price", "house_area"], logged=["price", "house_area", "land_area"], geo=["lat", "lon"])
book.on_listings("features_train", lambda d: rounded(PL.transform(d, SPEC, PL.fit(d, SPEC))), TRAIN)
book.on_listings("features_apply", lambda d: rounded(PL.transform(d.where("id % 3 = 1"), SPEC, PL.fit(d, SPEC))), TRAIN + " WHERE id % 3 = 1")

# ---- binning and sampling
U = "(CAST(('0x' || substr(md5('{seed}|' || CAST(id AS VARCHAR){more}), 1, 8)) AS BIGINT) / 4294967296.0)"
QC = ", qe AS (SELECT list_distinct(quantile_cont(price, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM listings), qs AS (SELECT list_sort(e)[2:len(e) - 1] AS e FROM qe), qb AS (SELECT id, price, CAST(len(list_filter(e, lambda x: x < price)) AS INTEGER) AS bin FROM listings, qs)"
book.on_listings("qcut", lambda d: S.qcut(d.select("id", "price"), "price", 10), f"{L}{QC} SELECT id, price, bin FROM qb")
ST = f"{L}{QC}, r AS (SELECT id, bin, {U.format(seed=42, more='')} AS u, row_number() OVER (PARTITION BY bin ORDER BY {U.format(seed=42, more='')}, id) AS k, count(*) OVER (PARTITION BY bin) AS n FROM qb)"
binned = lambda d: S.qcut(d.select("id", "price"), "price", 10).select("id", "bin")
book.on_listings("strat_split", lambda d: S.strat_split(binned(d), "bin"), f"{ST} SELECT id, bin, CASE WHEN k <= floor(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM r")
book.on_listings("strat_sample", lambda d: S.strat_sample(binned(d), "bin", 95, 10), f"{ST} SELECT id, bin FROM r WHERE k <= 10 ORDER BY u, id LIMIT 95")
book.on_listings("strat_kfold", lambda d: S.strat_kfold(binned(d), "bin", 5), f"{ST} SELECT id, bin, CAST((k - 1) % 5 AS INTEGER) AS fold FROM r")
book.on_listings("shuffle", lambda d: S.shuffle(d.select("id")), f"{L} SELECT id, row_number() OVER (ORDER BY {U.format(seed=42, more='')}, id) AS position FROM listings")


def poisson_sql(u: str) -> str:
    total, term, out = 0.0, 0.36787944117144233, []
    for k in range(8):
        total += term
        term /= k + 1
        out.append(f"WHEN {u} < CAST({total!r} AS DOUBLE) THEN {k}")
    return f"CASE {' '.join(out)} ELSE 8 END"


book.on_listings(
    "bootstrap_weights",
    lambda d: S.with_weights(d.select("id", "price"), 10).groupBy("round").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("weight") * F.col("price")) / F.sum("weight"), 2).alias("mean")),
    f"{L}, i AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS round), w AS (SELECT round, price, {poisson_sql(U.format(seed=42, more=''' || '|' || CAST(round AS VARCHAR)'''))} AS weight FROM listings, i) SELECT round, CAST(sum(weight) AS BIGINT) AS n, count(*) AS rows, round(sum(weight * price) / sum(weight), 2) AS mean FROM w WHERE weight > 0 GROUP BY 1",
)
book.on_listings("cut_bins", lambda d: d.select("id", S.fixed_bins(F.col("price"), [0, 100e3, 250e3], ["cheap", "middle", "dear"]).alias("range")), f"{L} SELECT id, CASE WHEN price < 0 THEN NULL WHEN price < 100000 THEN 'cheap' WHEN price < 250000 THEN 'middle' ELSE 'dear' END AS range FROM listings")
book.on_listings(
    "distance_groups",
    lambda d: S.quartile_groups(d.select("id", "house_area"), "house_area").drop("house_area"),
    f"""{L}, q AS (SELECT quantile_cont(house_area, 0.25) AS a, quantile_cont(house_area, 0.5) AS b, quantile_cont(house_area, 0.75) AS c FROM listings),
t AS (SELECT *, CAST(CAST(round(a) AS BIGINT) AS VARCHAR) AS x, CAST(CAST(round(b) AS BIGINT) AS VARCHAR) AS y, CAST(CAST(round(c) AS BIGINT) AS VARCHAR) AS z FROM q)
SELECT id, CASE WHEN house_area <= a THEN 'to ' || x WHEN house_area <= b THEN x || '-' || y WHEN house_area <= c THEN y || '-' || z ELSE 'over ' || z END AS "group" FROM listings, t""",
)
book.on_listings("room_groups", lambda d: d.select("id", S.capped_groups(F.col("id") % 12, 7).alias("rooms")), f"{L} SELECT id, CASE WHEN id % 12 >= 7 THEN '7+' ELSE CAST(id % 12 AS VARCHAR) END AS rooms FROM listings")
