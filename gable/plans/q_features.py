"""Queries: the whole feature pipeline with its fitted state, on the rows it was fitted on, on others, and read back."""

from __future__ import annotations

from gable.operators.feature_model import CELL_FILLS, TIERS, FeatureSpec, ListingFeatures, ListingFeaturesModel
from gable.plans.base import GAZETTEER_BODY, Book, gazetteer, listings, rounded
from gable.plans.q_clean import HOT, PLACES, PRIO, YEAR_CASE
from gable.plans.q_geo import RINGED, STEPS, azi, cell_sql, hav
from gable.plans.q_sources import scratch

book = Book()
RES = 6
# phrases are looked for in the region's name
PHRASES = {"united": ["united", "kingdom"], "an": ["an"]}
SPEC = FeatureSpec(
    year="year_raw", text="region", fill=["renovation"], labels=["category"], one_hot={"renovation": {v: v[0] for v in PRIO}}, multi_hot={"infrastructure": PLACES},
    outliers=["house_area", "land_area"], logged=["house_area", "land_area", "price"], resolution=RES,
)
fitted = lambda s, d: ListingFeatures(SPEC, gazetteer(s, d), PHRASES).fit(listings(s, d).where("id % 3 <> 1"))


def near(name: str, codes: tuple[str, ...], more: str = "") -> str:
    """SQL: common table (id, km, latitude, longitude) of the nearest city of a tier."""
    return f"{name} AS (SELECT id, {hav('lat', 'lon', 'latitude', 'longitude')} AS km, latitude, longitude FROM (SELECT id, lat, lon, latitude, longitude, row_number() OVER (PARTITION BY id ORDER BY (lat - latitude) * (lat - latitude) + (lon - longitude) * (lon - longitude), name) AS k FROM listings, g WHERE feature_code IN ({', '.join(map(repr, codes))})) WHERE k = 1)"


LOGGED = ["house_area", "land_area", "price", *TIERS, "distance_ring"]
SCALED = [*LOGGED, "year"]
SQL = f"""{RINGED}, g AS ({GAZETTEER_BODY}),
rt AS (SELECT *, greatest(0.0, least(1.0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM x),
rn AS (SELECT id, lat, lon, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM rt), rb AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (lon - px) * (lon - px) + (lat - py) * (lat - py), px, py) AS k FROM rn),
ring AS (SELECT id, CASE WHEN inside THEN 0.0 ELSE {hav('lat', 'lon', 'py', 'px')} END AS km FROM rb JOIN i USING (id) WHERE k = 1),
{near('t1', TIERS['distance_ppla'])}, {near('t2', TIERS['distance_ppla2'])},
fit AS (SELECT * FROM listings WHERE id % 3 <> 1),
bo AS (SELECT quantile_cont(house_area, 0.01) AS hl, quantile_cont(house_area, 0.99) AS hu, quantile_cont(land_area, 0.01) AS ll, quantile_cont(land_area, 0.99) AS lu FROM fit),
ol AS (SELECT listings.*, CAST(house_area < hl OR house_area > hu OR land_area < ll OR land_area > lu AS INTEGER) AS is_outlier FROM listings, bo), {cell_sql(RES, 'ol')},
ok AS (SELECT * FROM h{RES} WHERE is_outlier = 0 AND id % 3 <> 1),
st AS (SELECT q, r, median(price) AS m, count(*) AS c, sum(price) AS p, sum(house_area) AS h, sum(land_area) AS l FROM ok GROUP BY 1, 2),
gm AS (SELECT median(price) AS g_price, median(price / nullif(house_area, 0)) AS g_sqm, median(price / nullif(land_area, 0)) AS g_land FROM ok), step(a, b) AS (VALUES {STEPS}),
nb AS (SELECT st.q, st.r, median(n.m) AS nm, sum(n.p) / nullif(sum(n.h), 0) AS ns, sum(n.p) / nullif(sum(n.l), 0) AS nl FROM st, step JOIN st n ON n.q = st.q + a AND n.r = st.r + b GROUP BY 1, 2),
ym AS (SELECT median(year_raw) AS ym FROM fit WHERE year_raw <> 0),
yv AS (SELECT id, CAST(year_raw IS NULL AS INTEGER) AS was_null, CAST(trunc(least(CASE WHEN year_raw IS NULL OR year_raw = 0 THEN ym ELSE year_raw END, 2025)) AS INTEGER) AS v FROM listings, ym), yr AS (SELECT id, was_null, {YEAR_CASE} AS year FROM yv),
mo AS (SELECT renovation AS mode FROM fit WHERE renovation IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, renovation LIMIT 1),
lc AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM fit GROUP BY 1),
az AS (SELECT id, {azi('t1.latitude', 't1.longitude', 'lat', 'lon')} AS a FROM listings JOIN t1 USING (id)),
un AS (SELECT o.id, o.is_outlier, ln(1 + house_area) AS house_area, ln(1 + land_area) AS land_area, ln(1 + price) AS price, ln(1 + t1.km) AS distance_ppla, ln(1 + t2.km) AS distance_ppla2, ln(1 + ring.km) AS distance_ring, year, lat, lon, was_null,
  sin(radians(az.a)) AS azimuth_sin, cos(radians(az.a)) AS azimuth_cos, ln(1 + coalesce(st.m, g_price)) AS hex_price_median, ln(1 + coalesce(st.p / nullif(st.h, 0), g_sqm)) AS hex_price_per_sqm, ln(1 + coalesce(st.p / nullif(st.l, 0), g_land)) AS hex_price_per_land,
  ln(1 + coalesce(nm, g_price)) AS neighbor_price_median, ln(1 + coalesce(ns, g_sqm)) AS neighbor_price_per_sqm, ln(1 + coalesce(nl, g_land)) AS neighbor_price_per_land, coalesce(st.c, 0) AS hex_property_count,
  coalesce(renovation, mode) AS renovation, infrastructure, region, coalesce(code, 0) AS category_code
  FROM h{RES} o JOIN t1 USING (id) JOIN t2 USING (id) JOIN ring USING (id) JOIN yr USING (id) JOIN az USING (id) LEFT JOIN st ON st.q = o.q AND st.r = o.r LEFT JOIN nb ON nb.q = o.q AND nb.r = o.r LEFT JOIN lc ON lc.category = o.category, gm, mo),
ra AS (SELECT {', '.join(f'min({c}) AS n_{c}, max({c}) AS x_{c}' for c in [*SCALED, 'lat', 'lon'])} FROM un WHERE id % 3 <> 1)
SELECT id, is_outlier, {', '.join(f'round((un.{c} - n_{c}) / (x_{c} - n_{c}), 4) + 0.0 AS {c}' for c in SCALED)}, {', '.join(f'round(-1 + 2 * (un.{c} - n_{c}) / (x_{c} - n_{c}), 4) + 0.0 AS {c}' for c in ('lat', 'lon'))}, was_null AS "yearIsNull",
 round(azimuth_sin, 4) + 0.0 AS azimuth_sin, round(azimuth_cos, 4) + 0.0 AS azimuth_cos, {', '.join(f'round({c}, 4) AS {c}' for c in CELL_FILLS)}, hex_property_count,
 {', '.join(f"CAST(renovation = '{v}' AS INTEGER) AS renovation_{v[0]}" for v in PRIO)}, {HOT}, category_code, {', '.join(f"CAST({' OR '.join(f'contains(lower(region), {p!r})' for p in ps)} AS INTEGER) AS text_{f}" for f, ps in sorted(PHRASES.items()))}
FROM un, ra"""


@book.add("model_features_train", SQL + " WHERE id % 3 <> 1")
def model_features_train(s, d):
    """Fitted on two thirds of the listings and applied to them."""
    return rounded(fitted(s, d).transform(listings(s, d).where("id % 3 <> 1")))


@book.add("model_features_apply", SQL + " WHERE id % 3 = 1")
def model_features_apply(s, d):
    """Written, read back and applied to the third that it has not seen."""
    path = scratch(s)
    fitted(s, d).save(path)
    return rounded(ListingFeaturesModel.load(path).transform(listings(s, d).where("id % 3 = 1")))
