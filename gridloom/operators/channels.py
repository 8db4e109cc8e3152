"""Matching tidy rows with a channel contract, and what a step offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.coords import is_surface, near, no_nan, number
from gridloom.operators.extract import normalise_level
from gridloom.schema import MODEL_CHANNELS, channel_array_sql, channel_table


def contract_array(channels=None) -> Column:
    """The contract as one array literal of (channel_index, variable, level)."""
    return F.expr(channel_array_sql(channels))


def tag_channels(df: DataFrame, channels=None, how: str = "inner") -> DataFrame:
    """Add ``channel_index``: equal lower-case name, then the level rule as a residual.

    The contract is a fixed table of tens of rows, so it is always broadcast and the tidy
    rows are not shuffled.
    """
    tidy = normalise_level(df)
    contract = channel_table(df.sparkSession, channels).select(
        "channel_index", F.col("variable").alias("_name"), F.col("level").alias("_ref")
    )
    pressure = number(F.col("isobaricInhPa"))
    at_level = F.when(F.col("_ref").isNull(), is_surface(pressure)).otherwise(near(pressure, F.col("_ref")))
    return tidy.join(
        F.broadcast(contract), (F.lower("variable") == F.col("_name")) & at_level, how
    ).drop("_name", "_ref")


def available_levels(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct (lower-case variable, level) with row counts, surface first."""
    tidy = normalise_level(df)
    return (
        tidy.groupBy(
            *keys,
            F.lower("variable").alias("variable"),
            no_nan(number(F.col("isobaricInhPa"))).alias("isobaricInhPa"),
        )
        .agg(F.count("*").alias("row_count"))
        .orderBy(*keys, "variable", F.asc_nulls_first("isobaricInhPa"))
    )


def spelling_variants(df: DataFrame) -> DataFrame:
    """Raw spellings behind each lower-case variable name."""
    return (
        df.select("variable").distinct()
        .groupBy(F.lower("variable").alias("variable_lower"))
        .agg(F.array_sort(F.collect_list("variable")).alias("variants"))
    )


def channel_points(df: DataFrame, *keys: str, channels=None) -> DataFrame:
    """Per channel: rows and distinct raw points; null coordinates compare equal.

    Counting per point first collapses repeated points on the map side. A distinct count over
    the pair would lose points with a null.
    """
    tagged = tag_channels(df, channels)
    points = tagged.groupBy(*keys, "channel_index", "latitude", "longitude").agg(
        F.count("*").alias("n")
    )
    return points.groupBy(*keys, "channel_index").agg(
        F.sum("n").alias("row_count"), F.count("*").alias("distinct_points")
    )


def duplicate_points(df: DataFrame, *keys: str, channels=None) -> DataFrame:
    """Channels with repeated points and how many rows repeat."""
    extra = F.col("row_count") - F.col("distinct_points")
    return (
        channel_points(df, *keys, channels=channels)
        .where(extra > 0)
        .select(*keys, "channel_index", extra.alias("duplicate_points"))
    )


def missing_channels(df: DataFrame, *keys: str, channels=None) -> DataFrame:
    """Contract channels that a step does not have."""
    found = tag_channels(df, channels, how="left").groupBy(*keys).agg(
        F.collect_set("channel_index").alias("_found")  # at most one entry per contract row
    )
    gaps = F.filter(contract_array(channels), lambda c: ~F.array_contains("_found", c["channel_index"]))
    return found.select(*keys, F.explode(gaps).alias("_gap")).select(
        *keys, "_gap.channel_index", "_gap.variable", "_gap.level"
    )


def level_subset(df: DataFrame, levels: list[float], *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows at the wanted levels, and the (variable, level) pairs that are missing."""
    wanted = F.array(*[F.lit(float(x)) for x in levels])
    upper = normalise_level(df)
    rows = upper.where(F.col("isobaricInhPa").isin([float(x) for x in levels]))
    seen = upper.groupBy(*keys, "variable").agg(
        F.collect_set(F.when(F.array_contains(wanted, F.col("isobaricInhPa")), F.col("isobaricInhPa"))).alias("_seen")
    )
    gaps = seen.select(
        *keys, "variable", F.explode(F.array_except(wanted, "_seen")).alias("missing_level")
    )
    return rows, gaps


def absent_channels(contract: DataFrame, have: DataFrame) -> DataFrame:
    """Channel indexes of a contract that a table does not have."""
    return contract.select("channel_index").join(have.select("channel_index").distinct(), "channel_index", "left_anti")
