"""Typing, repairing and filtering of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.operators.order import quantile_row

# Source names of columns and their canonical names.
COLUMN_MAPPING = {
    "id": "id",
    "Количество комнат": "rooms",
    "Площадь дома": "houseArea",
    "Площадь участка": "landArea",
    "Этажей в доме": "floors",
    "Категория земель": "landCategory",
    "Год постройки": "year",
    "Материал стен": "wallMaterial",
    "Санузел": "bathroom",
    "Ремонт": "renovation",
    "Электричество": "electricity",
    "Отопление": "heating",
    "Водоснабжение": "waterSupply",
    "Газ": "gas",
    "Канализация": "sewerage",
    "Интернет и ТВ": "media",
    "Парковка": "parking",
    "Транспортная доступность": "transportAccessibility",
    "Способ продажи": "saleMethod",
    "Расстояние от МКАД": "distanceFromMkad",
    "address": "address",
    "price": "price",
    "description": "description",
    "description_raw": "description_raw",
    "seller": "seller",
    "category": "category",
    "lat": "latitude",
    "lon": "longitude",
    "Инфраструктура": "infrastructure",
    "Расстояние до центра города": "distanceToCityCenter",
    "Терраса или веранда": "terrace",
    "Для отдыха": "recreation",
    "Коммуникации": "utilities",
    "region": "region",
}

# Phrases in a description, ways of sale and a land category whose listings are left out.
DESCRIPTION_PHRASES = [
    "построим", "потсрою", "вашему проекту", "вашему тз", "аукцион", "торги", "продам долю", "1/3 дома", "1/2 дома", "1/4 дома", "0.5 дома",
    "половину дома", "треть дома", "четверть дома", "1/3 дачи", "1/2 дачи", "1/4 дачи", "0.5 дачи", "половину дачи", "треть дачи", "четверть дачи",
]
SALE_METHODS = ["продажа доли", "реализация на торгах"]
LAND_CATEGORY = "фермерское хозяйство"

# Words in whole-number columns.
ROOM_WORDS = {"Свободная планировка": "0", "10 и больше": "10"}
FLOOR_WORDS = {"4 и больше": "4"}


def rename(df: DataFrame, mapping: dict[str, str] = COLUMN_MAPPING) -> DataFrame:
    """df with the mapped names; others stay."""
    return df.withColumnsRenamed(mapping)


def with_default(df: DataFrame, column: str, value: object) -> DataFrame:
    """df with the column, added with a default if it is missing."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def number_or_zero(value: Column, kind: str = "double") -> Column:
    """A number; what is null or no number becomes 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0)).cast(kind)


def whole_number(value: Column, words: dict[str, str]) -> Column:
    """A whole number; some values are words for one."""
    m = F.create_map(*[F.lit(x) for p in words.items() for x in p])
    return F.coalesce(m[value], value).try_cast("int")


def local_number(value: Column) -> Column:
    """A number written with a decimal comma and spaces."""
    return F.replace(F.replace(value, F.lit(","), F.lit(".")), F.lit(" "), F.lit("")).try_cast("double")


def convert_types(df: DataFrame, wholes: list[str], reals: list[str], words: dict[str, dict[str, str]], coordinates: tuple[str, ...] = ("latitude", "longitude")) -> DataFrame:
    """df with typed columns. Raises ValueError if a coordinate is missing or no number in any row."""
    missing = [c for c in (*coordinates, *wholes, *reals) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    typed = {c: F.col(c).try_cast("double") for c in coordinates}
    if coordinates:
        bad = df.agg(*[F.count_if(v.isNull()).alias(c) for c, v in typed.items()]).first().asDict()
        if any(bad.values()):
            raise ValueError(f"invalid coordinates: {bad}")
    typed |= {c: number_or_zero(F.col(c), "long") for c in wholes} | {c: number_or_zero(F.col(c)) for c in reals} | {c: whole_number(F.col(c), m) for c, m in words.items() if c in df.columns}
    return df.withColumns(typed)


def drop_phrases(df: DataFrame, rules: dict[str, list[str]], unwanted: dict[str, str] | None = None) -> DataFrame:
    """Rows in which no column holds one of its phrases (case aside) or an unwanted value; nulls stay. One predicate."""
    keep = F.lit(True)
    for column, phrases in rules.items():
        alternatives = "|".join(r"\Q" + p + r"\E" for p in phrases)
        keep &= ~F.coalesce(F.col(column).rlike(f"(?iu)({alternatives})"), F.lit(False))
    for column, value in (unwanted or {}).items():
        keep &= ~F.col(column).eqNullSafe(F.lit(value))
    return df.where(keep)


def matching(df: DataFrame, picks: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of df that equal a row of picks in the columns, compared as text (a null equals a null); each once, however often it is picked."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(f"_p_{c}")
    same = F.lit(True)
    for c in columns:
        same &= F.coalesce(F.col(c).cast("string"), F.lit("None")) == F.col(f"_p_{c}")
    return df.join(picks.select(*map(text, columns)).distinct(), same, "left_semi")


def align_features(df: DataFrame, features: list[str]) -> DataFrame:
    """The fitted features in their order: missing ones 0, nulls as they are, others dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in features])


def feature_set(df: DataFrame, kind: str, text: str, others: list[str]) -> DataFrame:
    """text-only, categorical-only or mixed columns; a null text is empty."""
    words = F.coalesce(F.col(text), F.lit("")).alias(text)
    return df.select(*{"text-only": [words], "categorical-only": others, "mixed": [*others, words]}[kind])


def head_n(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(order).limit(n)


def typed_params(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, kind, as_bool, as_int, as_double, as_string) of parameters given as text."""
    v = F.trim(value)
    low = F.lower(v)
    whole, real = v.rlike(r"^[+-]?[0-9]+$"), v.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$")
    kind = F.when(v.isNull() | low.isin("none", ""), "none").when(low.isin("true", "false"), "bool").when(whole, "int").when(real, "double").otherwise("string")
    return df.withColumn("kind", kind).select(
        key,
        "kind",
        F.when(F.col("kind") == "bool", low == "true").alias("as_bool"),
        F.when(F.col("kind") == "int", v.try_cast("long")).alias("as_int"),
        F.when(F.col("kind").isin("int", "double"), v.try_cast("double")).alias("as_double"),
        F.when(F.col("kind") == "string", v).alias("as_string"),
    )


def clean_year(df: DataFrame, year: str = "year", median: DataFrame | None = None, cap: int = 2025, faithful: bool = False) -> DataFrame:
    """df with the year repaired and `yearIsNull`.

    Null and 0 become the median of known years, years over `cap` the cap, 26-99 19xx, 0-25 20xx, 100-999 2000 + the last
    two digits. faithful: the median runs over nulls as zeros, and nulls are not flagged.
    """
    y = F.col(year)
    known = F.coalesce(y, F.lit(0)) if faithful else F.when(y != 0, y)
    m = quantile_row(df, {"_m": known}, [0.5]).select(F.col("_m")[0].alias("_m")) if median is None else median.select(F.col(median.columns[0]).alias("_m"))
    v = F.least(F.when(y.isNull() | (y == 0), F.col("_m")).otherwise(y), F.lit(cap)).cast("int")
    fixed = F.when(v.between(26, 99), v + 1900).when(v.between(0, 25), v + 2000).when(v.between(100, 999), 2000 + v % 100).otherwise(v)
    flag = F.lit(0) if faithful else y.isNull().cast("int")
    return df.join(F.broadcast(m)).withColumn("yearIsNull", flag).withColumn(year, fixed).drop("_m")
