"""Listings whose price departs suspiciously from the prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("price", "id", "predicted_price")


def check_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """df itself; raises ValueError naming the columns that are missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def relative_error(price: Column, predicted: Column) -> Column:
    """Percent of the price; infinite where only the price is zero; null where both are, or one is missing."""
    zero = F.when(predicted != 0, F.lit(float("inf")))
    return F.when(price == 0, zero).otherwise(F.abs(100 * (predicted - price) / F.nullif(price, F.lit(0.0))))


def fraud_flags(df: DataFrame, low: float = 50e6, high: float = 100e6) -> DataFrame:
    """df with relative_error, flag_2 (suspicious: 45 % up to `low`, 75 % up to `high`) and flag_1 (very: over 100 % up to `high`)."""
    price, error = F.col("price"), F.col("relative_error")
    flag_2 = ((price <= low) & (error >= 45)) | ((price > low) & (price <= high) & (error >= 75))
    out = check_columns(df).withColumn("relative_error", relative_error(price, F.col("predicted_price")))
    return out.withColumn("flag_2", F.coalesce(flag_2, F.lit(False))).withColumn("flag_1", F.coalesce((price <= high) & (error > 100), F.lit(False)))


def listing_link(ident: Column, base: str = "https://listings.example/") -> Column:
    """An HTML link to the listing."""
    return F.format_string(f'<a href="{base}%s" target="_blank">open listing</a>', ident.cast("string"))
