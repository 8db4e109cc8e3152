"""Profiles of tidy tables: counts, levels, nulls, descriptive statistics, zone maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.coords import finite
from gridloom.functions.weather import clip_percent, relative_humidity_raw
from gridloom.operators.extract import normalise_level
from gridloom.operators.ordinal import exact_quantiles


def variable_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("variable").agg(F.count("*").alias("row_count")).orderBy("variable")


def level_counts(df: DataFrame) -> DataFrame:
    """Distinct levels per variable; a null level does not count."""
    return (
        normalise_level(df).select("variable", "isobaricInhPa").distinct()
        .groupBy("variable").agg(F.count("isobaricInhPa").alias("level_count"))
        .orderBy("variable")
    )


def level_counts_approx(df: DataFrame) -> DataFrame:
    """The same by a sketch, for a quick look at a very large table."""
    return normalise_level(df).groupBy("variable").agg(
        F.approx_count_distinct("isobaricInhPa").alias("level_count")
    )


def level_lists(df: DataFrame, head: int = 20) -> DataFrame:
    """Per variable: number of levels, the lowest ``head`` of them, and whether that cuts some.

    The list is the report's own limit. The rank filter runs before the lists are built, so a
    list never exceeds ``head`` entries.
    """
    levels = (
        normalise_level(df).where(F.col("isobaricInhPa").isNotNull())
        .select("variable", "isobaricInhPa").distinct()
    )
    totals = levels.groupBy("variable").agg(F.count("*").alias("level_count"))
    by_level = Window.partitionBy("variable").orderBy("isobaricInhPa")
    first = (
        levels.withColumn("_rank", F.row_number().over(by_level)).where(F.col("_rank") <= head)
        .groupBy("variable").agg(F.array_sort(F.collect_list("isobaricInhPa")).alias("levels"))
    )
    return totals.join(first, "variable").withColumn("truncated", F.col("level_count") > head)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null or NaN rows per column, one pass, as (column_name, null_count)."""
    names = columns or df.columns
    kinds = dict(df.dtypes)
    def absent(name):
        col = F.col(name)
        return (col.isNull() | F.isnan(col)) if kinds[name] in ("float", "double") else col.isNull()
    counts = df.agg(*[F.count_if(absent(n)).alias(n) for n in names])
    return counts.unpivot([], names, "column_name", "null_count")


def describe_exact(df: DataFrame, column: str = "value") -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of one column."""
    real = df.select(F.col(column).cast("double").alias(column)).where(
        F.col(column).isNotNull() & ~F.isnan(column)
    )
    basics = real.agg(
        F.count("*").alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    )
    quartiles = exact_quantiles(real, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basics.withColumn("_one", F.lit(1)).join(quartiles.withColumn("_one", F.lit(1)), "_one").select(
        "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def zone_map(df: DataFrame) -> DataFrame:
    """Rows and extremes of the filter columns per file split of a scanned table."""
    tidy = normalise_level(df)
    split = [
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    ]
    bounds = []
    for name in ["variable", "isobaricInhPa", "latitude", "longitude"]:
        bounds += [F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max")]
    return (
        tidy.select(*split, "variable", "isobaricInhPa", "latitude", "longitude")
        .groupBy("file_path", "block_start").agg(F.count("*").alias("n_rows"), *bounds)
    )


def humidity_summary(df: DataFrame, *keys: str, clip: bool = True) -> DataFrame:
    """Clipped count, extremes and mean of derived relative humidity per group."""
    raw = relative_humidity_raw(F.col("q"), F.col("t_k"), F.col("pressure_hpa"))
    shown = clip_percent(raw) if clip else raw
    rows = df.select(*keys, raw.alias("_raw"), shown.alias("_rh"))
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("_raw") != F.col("_rh")).alias("clipped_value_count"),
        F.count_if(~F.coalesce(finite(F.col("_rh")), F.lit(False))).alias("invalid_count"),
        F.min("_rh").alias("rh_percent_min"),
        F.max("_rh").alias("rh_percent_max"),
        F.avg("_rh").alias("rh_percent_mean"),
    )


def root_mean_square_error(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    gap = F.col(observed).cast("double") - F.col(predicted)
    return df.agg(F.count("*").alias("rows"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def variable_level_counts(df: DataFrame) -> DataFrame:
    """Rows per variable and level; the scan reads these two columns only."""
    return normalise_level(df).groupBy("variable", "isobaricInhPa").agg(F.count("*").alias("n"))
