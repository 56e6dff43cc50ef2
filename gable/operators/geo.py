"""Cities, ring road, highways and hexagon statistics of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.functions import geo as G
from gable.operators.nearest import with_nearest
from gable.operators.order import quantile_row

# Highways by their name in an address.
HIGHWAYS = {
    "алтуфьевское": "altufyevskoye", "боровское": "borovskoye", "быковское": "bykovskoye", "варшавское": "varshavskoye", "волоколамское": "volokolamskoye",
    "горьковское": "gorkovskoye", "дмитровское": "dmitrovskoye", "егорьевское": "yegoryevskoye", "ильинское": "ilinskoye", "калужское": "kaluzhskoye",
    "каширское": "kashirskoye", "киевское": "kiyevskoye", "куркинское": "kurkinskoye", "ленинградское": "leningradskoye", "минское": "minskoye",
    "можайское": "mozhayskoye", "новокаширское": "novokashirskoye", "новорижское": "novorizhskoye", "новорязанское": "novoryazanskoye",
    "новосходненское": "novoskhodnenskoye", "носовихинское": "nosovikhinskoye", "осташковское": "ostashkovskoye", "пятницкое": "pyatnitskoye",
    "рогачёвское": "rogachyovskoye", "рублёво-успенское": "rublyovo-uspenskoye", "рублёвское": "rublyovskoye", "рязанское": "ryazanskoye",
    "симферопольское": "simferopolskoye", "сколковское": "skolkovskoye", "фряновское": "fryanovskoye", "щёлковское": "shchyolkovskoye", "ярославское": "yaroslavskoye",
}

# Cities around the capital (name, latitude, longitude), in order.
CITIES = [
    ("Balashikha", 55.8094, 37.9581), ("Khimki", 55.8970, 37.4297), ("Podolsk", 55.4242, 37.5547), ("Korolyov", 55.9162, 37.8265), ("Mytishchi", 55.9116, 37.7307),
    ("Lyubertsy", 55.6784, 37.8933), ("Kolomna", 55.0793, 38.7783), ("Elektrostal", 55.7896, 38.4467), ("Odintsovo", 55.6772, 37.2775), ("Zheleznodorozhny", 55.7504, 38.0166),
    ("Serpukhov", 54.9158, 37.4111), ("Shchyolkovo", 55.9249, 37.9722), ("Dolgoprudny", 55.9387, 37.5019), ("Domodedovo", 55.4368, 37.7661), ("Ramenskoye", 55.5669, 38.2303),
    ("Reutov", 55.7586, 37.8616), ("Noginsk", 55.8525, 38.4388), ("Pushkino", 56.0105, 37.8474), ("Zhukovsky", 55.6013, 38.1115), ("Krasnogorsk", 55.8204, 37.3302),
    ("Voskresensk", 55.3173, 38.6526), ("Sergiev Posad", 56.3100, 38.1326), ("Orekhovo-Zuyevo", 55.8067, 38.9618), ("Klin", 56.3333, 36.7333), ("Chekhov", 55.1527, 37.4783),
    ("Naro-Fominsk", 55.3875, 36.7333), ("Lobnya", 56.0127, 37.4744), ("Dubna", 56.7333, 37.1667), ("Yegoryevsk", 55.3843, 39.0309), ("Stupino", 54.9008, 38.0708),
    ("Pavlovsky Posad", 55.7819, 38.6506), ("Istra", 55.9225, 36.8647), ("Fryazino", 55.9606, 38.0456), ("Lytkarino", 55.5833, 37.9000), ("Dzerzhinsky", 55.6286, 37.8547),
    ("Kashira", 54.8333, 38.1500), ("Protvino", 54.8667, 37.2167), ("Troitsk", 55.4833, 37.3000), ("Lukhovitsy", 54.9667, 39.0167), ("Zaraysk", 54.7667, 38.8833),
    ("Mozhaysk", 55.5000, 36.0333), ("Volokolamsk", 56.0333, 35.9500), ("Shatura", 55.5667, 39.5333), ("Zvenigorod", 55.7333, 36.8500), ("Roshal", 55.6667, 39.8833),
    ("Kubinka", 55.5667, 36.7000), ("Chernogolovka", 56.0167, 38.3833), ("Krasnoarmeysk", 56.1000, 38.1333), ("Elektrogorsk", 55.8833, 38.7833), ("Vysokovsk", 56.3167, 36.5500),
    ("Likino-Dulyovo", 55.7167, 38.9500),
]


def nearest_of_list(lat: Column, lon: Column, cities: list[tuple[str, float, float]] = CITIES) -> Column:
    """struct<km, place, name> of the nearest of a fixed list by great circle, the first of equals. No join."""
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.lit(a).alias("lat"), F.lit(b).alias("lon")) for i, (n, a, b) in enumerate(cities)])
    return F.array_min(F.transform(rows, lambda c: F.struct(G.haversine(lat, lon, c["lat"], c["lon"]).alias("km"), c["place"].alias("place"), c["name"].alias("name"))))


def nearest_city(points: DataFrame, cities: DataFrame, ident: str = "id", lat: str = "lat", lon: str = "lon", prefix: str = "city") -> DataFrame:
    """(ident, <prefix>_name, <prefix>_km): the city nearest in degrees, its distance by great circle.

    cities: (name, latitude, longitude). Points without a coordinate, and all if there is no city, keep their row with nulls;
    repeated idents stay apart. See with_nearest().
    """
    best = with_nearest(points.select(ident, F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")), cities, "_lat", "_lon", "_near")
    km = G.haversine(F.col("_lat"), F.col("_lon"), F.col("_near.latitude"), F.col("_near.longitude"))
    return best.select(ident, F.col("_near.name").alias(f"{prefix}_name"), km.alias(f"{prefix}_km"))


def azimuth_features(df: DataFrame, cities: DataFrame, capitals: dict[str, tuple[float, float]], lat: str = "lat", lon: str = "lon", region: str = "region", ident: str = "id") -> DataFrame:
    """(ident, azimuth_sin, azimuth_cos) from the point of the region's capital, or else from the nearest first-level city."""
    first = cities.where(F.col("feature_code").isin("PPLC", "PPLA"))
    out = with_nearest(df.select(ident, F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"), F.col(region).alias("_region")), first, "_lat", "_lon", "_near")
    a, b = F.col("_near.latitude"), F.col("_near.longitude")
    for word, (x, y) in capitals.items():
        hit = F.lower("_region").contains(word)
        a, b = F.when(hit, F.lit(x)).otherwise(a), F.when(hit, F.lit(y)).otherwise(b)
    z = F.radians(G.azimuth(a, b, F.col("_lat"), F.col("_lon")))
    return out.select(ident, F.sin(z).alias("azimuth_sin"), F.cos(z).alias("azimuth_cos"))


def find_highway(address: Column, names: dict[str, str] = HIGHWAYS) -> Column:
    """The first highway named in an address, null if there is none."""
    m = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    return m[F.nullif(F.regexp_extract(F.lower(address), "(" + "|".join(names) + ")", 1), F.lit(""))]


def hex_stats(df: DataFrame, outlier: str = "is_outlier") -> DataFrame:
    """Per cell (q, r), over rows that are no outliers: medians, count and prices per area (null without area)."""
    ok = df.where(F.col(outlier) == 0)
    per = lambda c: F.sum("price") / F.nullif(F.sum(c), F.lit(0.0))
    return ok.groupBy("q", "r").agg(
        F.median("price").alias("hex_price_median"),
        F.median("house_area").alias("hex_median_house_area"),
        F.median("land_area").alias("hex_median_land_area"),
        F.count(F.lit(1)).alias("hex_property_count"),
        per("house_area").alias("hex_price_per_sqm"),
        per("land_area").alias("hex_price_per_land"),
    )


def global_medians(df: DataFrame, outlier: str = "is_outlier") -> DataFrame:
    """One row: median price, price per house area and per land area over rows that are no outliers."""
    ok = df.where(F.col(outlier) == 0)
    per = lambda c: F.col("price") / F.nullif(F.col(c), F.lit(0.0))
    q = quantile_row(ok, {"g_price": F.col("price"), "g_sqm": per("house_area"), "g_land": per("land_area")}, [0.5])
    return q.select(*[F.col(c)[0].alias(c) for c in q.columns])


FILLS = {"hex_price_median": "g_price", "hex_price_per_sqm": "g_sqm", "hex_price_per_land": "g_land"}


def hex_global_fill(stats: DataFrame, medians: DataFrame) -> DataFrame:
    """Null statistics of cells take the global medians."""
    return stats.join(F.broadcast(medians)).withColumns({c: F.coalesce(c, g) for c, g in FILLS.items()}).drop(*FILLS.values())


def hex_attach(df: DataFrame, stats: DataFrame, medians: DataFrame, outlier: str = "is_outlier") -> DataFrame:
    """df with its cell's statistics; outlier rows of cells without statistics take the global medians."""
    out = df.join(stats, ["q", "r"], "left").join(F.broadcast(medians))
    fill = lambda c, g: F.when((F.col(outlier) == 1) & F.col(c).isNull(), F.col(g)).otherwise(F.col(c))
    return out.withColumns({c: fill(c, g) for c, g in FILLS.items()}).drop(*FILLS.values())


def hex_neighbors(df: DataFrame, stats: DataFrame, medians: DataFrame, outlier: str = "is_outlier") -> DataFrame:
    """Per cell: median of its neighbours' median prices, and price over area summed over neighbours; without neighbours the global medians."""
    sums = df.where(F.col(outlier) == 0).groupBy("q", "r").agg(F.sum("price").alias("p"), F.sum("house_area").alias("h"), F.sum("land_area").alias("l"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in G.NEIGHBOURS])
    around = stats.select("q", "r").withColumn("s", F.explode(steps)).select("q", "r", (F.col("q") + F.col("s.a")).alias("nq"), (F.col("r") + F.col("s.b")).alias("nr"))
    side = stats.join(sums, ["q", "r"]).select(F.col("q").alias("nq"), F.col("r").alias("nr"), F.col("hex_price_median").alias("m"), "p", "h", "l")
    got = around.join(side, ["nq", "nr"]).groupBy("q", "r").agg(F.median("m").alias("neighbor_price_median"), (F.sum("p") / F.nullif(F.sum("h"), F.lit(0.0))).alias("neighbor_price_per_sqm"), (F.sum("p") / F.nullif(F.sum("l"), F.lit(0.0))).alias("neighbor_price_per_land"))
    out = stats.select("q", "r").join(got, ["q", "r"], "left").join(F.broadcast(medians))
    fills = {"neighbor_price_median": "g_price", "neighbor_price_per_sqm": "g_sqm", "neighbor_price_per_land": "g_land"}
    return out.withColumns({c: F.coalesce(c, g) for c, g in fills.items()}).drop(*fills.values())


def with_cell(df: DataFrame, resolution: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with the axial coordinates q, r of its hexagon."""
    return df.withColumn("_c", G.hex_cell(F.col(lat), F.col(lon), resolution)).withColumns({"q": F.col("_c.q"), "r": F.col("_c.r")}).drop("_c")


def auto_resolution(df: DataFrame, least: int, finest: int, coarsest: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row, `resolution`: the finest whose smallest cell holds `least` rows, else the coarsest. One pass over all resolutions."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), G.hex_cell(F.col(lat), F.col(lon), k).alias("c")) for k in range(coarsest, finest + 1)])
    counts = df.select(F.explode(cells).alias("x")).groupBy("x.k", "x.c").agg(F.count(F.lit(1)).alias("n"))
    good = counts.groupBy("k").agg(F.min("n").alias("n")).agg(F.max(F.when(F.col("n") >= least, F.col("k"))).alias("k"))
    return good.select(F.coalesce("k", F.lit(coarsest)).alias("resolution"))


def hex_geojson(stats: DataFrame, resolution: int) -> DataFrame:
    """(q, r, feature): one GeoJSON feature per cell, its statistics as properties."""
    properties = [c for c in stats.columns if c not in ("q", "r")]
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(G.hex_corners(F.col("q"), F.col("r"), resolution)).alias("coordinates"))
    return stats.select("q", "r", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def density(df: DataFrame, grid: int = 50, lat: str = "lat", lon: str = "lon", value: str = "price") -> DataFrame:
    """(gx, gy, n, median) on a grid over the extent of the points."""
    box = df.agg(F.min(lon).alias("x0"), F.max(lon).alias("x1"), F.min(lat).alias("y0"), F.max(lat).alias("y1"))
    cell = lambda c, a, b: F.least(F.floor((F.col(c) - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0)) * grid), F.lit(grid - 1))
    out = df.join(F.broadcast(box)).withColumn("gx", cell(lon, "x0", "x1")).withColumn("gy", cell(lat, "y0", "y1"))
    return out.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"))
