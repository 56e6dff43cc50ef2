"""Queries: geography."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gable.functions import geo as G
from gable.operators import geo as O
from gable.plans.base import GAZETTEER_BODY, Book, L, gazetteer, listings, rounded

book = Book()
CENTRE = (55.7558, 37.6173)


def hav(a, b, c, d):
    s = f"least(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2), 1)"
    return f"(2 * 6371.0 * atan2(sqrt({s}), sqrt(1 - {s})))"


def azi(a, b, c, d):
    y = f"sin(radians({d}) - radians({b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"


book.on_listings("haversine", lambda d: rounded(d.select("id", G.haversine(F.col("lat"), F.col("lon"), F.lit(CENTRE[0]), F.lit(CENTRE[1])).alias("km"))), f"{L} SELECT id, round({hav('lat', 'lon', *CENTRE)}, 4) AS km FROM listings")
book.on_listings(
    "azimuth",
    lambda d: rounded(d.select("id", G.azimuth(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon")).alias("a")).select("id", F.sin(F.radians("a")).alias("azimuth_sin"), F.cos(F.radians("a")).alias("azimuth_cos"))),
    f"{L}, a AS (SELECT id, {azi(*CENTRE, 'lat', 'lon')} AS a FROM listings) SELECT id, round(sin(radians(a)), 4) + 0.0 AS azimuth_sin, round(cos(radians(a)), 4) + 0.0 AS azimuth_cos FROM a",
)
GZ = f"{L}, g AS ({GAZETTEER_BODY})"
NEAR = """n AS (SELECT id, lat, lon, region, name, latitude, longitude, row_number() OVER (PARTITION BY id ORDER BY (lat - latitude) * (lat - latitude) + (lon - longitude) * (lon - longitude), name) AS k FROM listings, g WHERE feature_code IN ({codes}))"""


def two_tiers(s, d):
    points, cities = listings(s, d), gazetteer(s, d)
    first = O.nearest_city(points, cities.where("feature_code in ('PPLC', 'PPLA')"), prefix="first")
    return rounded(first.join(O.nearest_city(points, cities.where("feature_code = 'PPLA2'"), prefix="second"), "id"))


book.add(
    "nearest_city",
    f"{GZ}, {NEAR.format(codes=chr(39) + 'PPLC' + chr(39) + ', ' + chr(39) + 'PPLA' + chr(39))}, {NEAR.replace('n AS', 'm AS').format(codes=chr(39) + 'PPLA2' + chr(39))} SELECT n.id, n.name AS first_name, round({hav('n.lat', 'n.lon', 'n.latitude', 'n.longitude')}, 4) AS first_km, m.name AS second_name, round({hav('m.lat', 'm.lon', 'm.latitude', 'm.longitude')}, 4) AS second_km FROM n JOIN m ON n.id = m.id WHERE n.k = 1 AND m.k = 1",
)(two_tiers)
CAPITALS = {"russia": (55.7558, 37.6173), "united": (54.9, 38.3)}
book.add(
    "azimuth_ref",
    f"{GZ}, {NEAR.format(codes=chr(39) + 'PPLC' + chr(39) + ', ' + chr(39) + 'PPLA' + chr(39))}, p AS (SELECT id, lat, lon, CASE WHEN lower(region) LIKE '%united%' THEN 54.9 WHEN lower(region) LIKE '%russia%' THEN 55.7558 ELSE latitude END AS a, CASE WHEN lower(region) LIKE '%united%' THEN 38.3 WHEN lower(region) LIKE '%russia%' THEN 37.6173 ELSE longitude END AS b FROM n WHERE k = 1), z AS (SELECT id, {azi('a', 'b', 'lat', 'lon')} AS a FROM p) SELECT id, round(sin(radians(a)), 4) + 0.0 AS azimuth_sin, round(cos(radians(a)), 4) + 0.0 AS azimuth_cos FROM z",
)(lambda s, d: rounded(O.azimuth_features(listings(s, d), gazetteer(s, d), CAPITALS)))
CITY_VALUES = ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, a, b) in enumerate(O.CITIES))
book.on_listings(
    "nearest_city_hav",
    lambda d: rounded(d.select("id", O.nearest_of_list(F.col("lat"), F.col("lon")).alias("c")).select("id", "c.name", "c.km")),
    f"{L}, c(place, name, a, b) AS (VALUES {CITY_VALUES}), k AS (SELECT id, name, {hav('lat', 'lon', 'a', 'b')} AS km, place FROM listings, c) SELECT id, arg_min(name, (km, place)) AS name, round(min(km), 4) AS km FROM k GROUP BY id",
)
EDGES = ", ".join(f"({x1!r}, {y1!r}, {x2!r}, {y2!r})" for x1, y1, x2, y2 in G._edges(G.RING))
RINGED = f"{L}, e(x1, y1, x2, y2) AS (VALUES {EDGES}), x AS (SELECT id, lat, lon, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM listings, e), i AS (SELECT id, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) / nullif(y2 - y1, 0) * (x2 - x1) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM x GROUP BY id)"
book.on_listings("point_in_polygon", lambda d: d.select("id", G.in_polygon(F.col("lat"), F.col("lon")).alias("inside")), f"{RINGED} SELECT id, inside FROM i")
book.on_listings(
    "dist_polygon",
    lambda d: rounded(d.select("id", G.polygon_distance(F.col("lat"), F.col("lon")).alias("km"))),
    f"{RINGED}, t AS (SELECT *, greatest(0.0, least(1.0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM x), n AS (SELECT id, lat, lon, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (lon - px) * (lon - px) + (lat - py) * (lat - py), px, py) AS k FROM n) SELECT id, CASE WHEN inside THEN 0.0 ELSE round({hav('lat', 'lon', 'py', 'px')}, 4) END AS km FROM b JOIN i USING (id) WHERE k = 1",
)


def cell_sql(k: int, source: str = "listings", extra: str = "") -> str:
    """Common tables that give `h<k>`: all columns of source with q and r."""
    size = G.edge_km(k)
    return f"""a{k} AS (SELECT *, (lon * {G.KM_LON!r} * {math.sqrt(3) / 3!r} - lat * {G.KM_LAT!r} / 3.0) / {size!r} AS q_, lat * {G.KM_LAT!r} * {2 / 3!r} / {size!r} AS r_ FROM {source}{extra}),
b{k} AS (SELECT *, -q_ - r_ AS s_, floor(q_ + 0.5) AS rq, floor(r_ + 0.5) AS rr, floor(-q_ - r_ + 0.5) AS rs FROM a{k}),
c{k} AS (SELECT *, abs(rq - q_) AS dq, abs(rr - r_) AS dr, abs(rs - s_) AS ds FROM b{k}),
h{k} AS (SELECT *, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM c{k})"""


RES = 5
cells = lambda d: O.with_cell(d.withColumn("is_outlier", (F.col("id") % 10 == 0).cast("int")), RES)
HX = f"{L}, o AS (SELECT *, CAST(id % 10 = 0 AS INTEGER) AS is_outlier FROM listings), {cell_sql(RES, 'o')}, ok AS (SELECT * FROM h{RES} WHERE is_outlier = 0)"
STATS = f"""{HX}, st AS (SELECT q, r, median(price) AS hex_price_median, median(house_area) AS hex_median_house_area, median(land_area) AS hex_median_land_area, count(*) AS hex_property_count,
 sum(price) / nullif(sum(house_area), 0) AS hex_price_per_sqm, sum(price) / nullif(sum(land_area), 0) AS hex_price_per_land FROM ok GROUP BY 1, 2),
gm AS (SELECT median(price) AS g_price, median(price / nullif(house_area, 0)) AS g_sqm, median(price / nullif(land_area, 0)) AS g_land FROM ok)"""
NAMES = ["hex_price_median", "hex_median_house_area", "hex_median_land_area", "hex_price_per_sqm", "hex_price_per_land"]
book.on_listings("hex_cell", lambda d: O.with_cell(d.select("id", "lat", "lon"), RES).select("id", "q", "r", G.hex_id(F.struct("q", "r"), RES).alias("hex_id")), f"{L}, {cell_sql(RES)} SELECT id, q, r, '{RES}_' || q || '_' || r AS hex_id FROM h{RES}")
book.on_listings("hex_stats", lambda d: rounded(O.hex_stats(cells(d)), 1), f"{STATS} SELECT q, r, hex_property_count, {', '.join(f'round({n}, 1) AS {n}' for n in NAMES)} FROM st")
book.on_listings(
    "hex_global_fill",
    lambda d: rounded(O.hex_global_fill(O.hex_stats(cells(d)).withColumn("hex_price_per_land", F.when(F.col("q") % 2 == 0, F.col("hex_price_per_land"))), O.global_medians(cells(d))).select("q", "r", *O.FILLS), 1),
    f"{STATS} SELECT q, r, round(hex_price_median, 1) AS hex_price_median, round(hex_price_per_sqm, 1) AS hex_price_per_sqm, round(CASE WHEN q % 2 = 0 THEN coalesce(hex_price_per_land, g_land) ELSE g_land END, 1) AS hex_price_per_land FROM st, gm",
)
book.on_listings(
    "hex_attach",
    lambda d: rounded((lambda c: O.hex_attach(c, O.hex_stats(c.where("r % 3 <> 0")), O.global_medians(c)))(cells(d)).select("id", "hex_property_count", *O.FILLS), 1),
    f"{STATS}, s3 AS (SELECT * FROM st WHERE r % 3 <> 0) SELECT h.id, hex_property_count, {', '.join(f'round(CASE WHEN is_outlier = 1 AND {c} IS NULL THEN {g} ELSE {c} END, 1) AS {c}' for c, g in O.FILLS.items())} FROM h{RES} h LEFT JOIN s3 ON s3.q = h.q AND s3.r = h.r, gm",
)
STEPS = ", ".join(map(str, G.NEIGHBOURS))
book.on_listings(
    "hex_neighbors",
    lambda d: rounded((lambda c: O.hex_neighbors(c, O.hex_stats(c), O.global_medians(c)))(cells(d)), 3),
    f"""{STATS}, su AS (SELECT q, r, sum(price) AS p, sum(house_area) AS h, sum(land_area) AS l FROM ok GROUP BY 1, 2), d(a, b) AS (VALUES {STEPS}),
nb AS (SELECT st.q, st.r, median(n.hex_price_median) AS m, sum(p) / nullif(sum(h), 0) AS s, sum(p) / nullif(sum(l), 0) AS l FROM st, d JOIN st n ON n.q = st.q + a AND n.r = st.r + b JOIN su ON su.q = n.q AND su.r = n.r GROUP BY 1, 2)
SELECT st.q, st.r, round(coalesce(m, g_price), 3) AS neighbor_price_median, round(coalesce(nb.s, g_sqm), 3) AS neighbor_price_per_sqm, round(coalesce(nb.l, g_land), 3) AS neighbor_price_per_land FROM st LEFT JOIN nb ON nb.q = st.q AND nb.r = st.r, gm""",
)
book.on_listings("hex_geojson", lambda d: O.hex_geojson(O.hex_stats(cells(d)), RES))
book.on_listings(
    "hex_auto_res",
    lambda d: O.auto_resolution(d, 5, 5, 3),
    f"{L}, {cell_sql(3)}, {cell_sql(4)}, {cell_sql(5)}, n AS (" + " UNION ALL ".join(f"SELECT {k} AS k, min(n) AS n FROM (SELECT count(*) AS n FROM h{k} GROUP BY q, r)" for k in (3, 4, 5)) + ") SELECT CAST(coalesce(max(CASE WHEN n >= 5 THEN k END), 3) AS INTEGER) AS resolution FROM n",
)
book.on_listings(
    "geo_density",
    lambda d: rounded(O.density(d)),
    f"{L}, x AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM listings), g AS (SELECT CAST(least(floor((lon - x0) / (x1 - x0) * 50), 49) AS BIGINT) AS gx, CAST(least(floor((lat - y0) / (y1 - y0) * 50), 49) AS BIGINT) AS gy, price FROM listings, x) SELECT gx, gy, count(*) AS n, round(median(price), 4) AS median FROM g GROUP BY 1, 2",
)
ROADS = list(O.HIGHWAYS)
book.on_listings(
    "find_highway",
    lambda d: d.select("id", O.find_highway(F.when(F.col("id") % 3 != 0, F.concat(F.lit("Московская область, "), F.element_at(F.array(*[F.lit(r.capitalize()) for r in ROADS]), (F.col("id") % len(ROADS) + 1).cast("int")), F.lit(" шоссе, 12 км")))).alias("highway")),
    f"{L}, r AS (SELECT [{', '.join(repr(v) for v in O.HIGHWAYS.values())}] AS v) SELECT id, CASE WHEN id % 3 <> 0 THEN v[id % {len(ROADS)} + 1] END AS highway FROM listings, r",
)
