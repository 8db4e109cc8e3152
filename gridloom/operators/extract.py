"""Row selection on tidy tables and the column contracts that guard it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.coords import is_surface, near, number
from gridloom.schema import LEVEL_SPELLINGS, SNAPSHOT_COLUMNS


class ContractError(ValueError):
    """A table lacks columns or rows that an operator needs."""


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ContractError("missing required columns: " + ", ".join(missing))
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stop on an empty result; ``isEmpty`` reads at most one row."""
    if df.isEmpty():
        raise ContractError(f"{what} is empty")
    return df


def normalise_level(df: DataFrame) -> DataFrame:
    """Force the output name ``isobaricInhPa`` whichever spelling the catalog kept."""
    found = [c for c in df.columns if c in LEVEL_SPELLINGS]
    if not found:
        raise ContractError("missing pressure-level column: " + "|".join(LEVEL_SPELLINGS))
    if LEVEL_SPELLINGS[0] in found:
        return df
    return df.withColumnRenamed(found[0], LEVEL_SPELLINGS[0])


def snapshot(df: DataFrame, variable: str = "t", level: float = 1000.0) -> DataFrame:
    """One field at one level as (latitude, longitude, value) without null or NaN rows.

    Both comparisons are exact, so they reach the Parquet scan as pushed filters.
    """
    require_columns(df, ["latitude", "longitude", "value", "variable"])
    tidy = normalise_level(df)
    return (
        tidy.where((F.col("variable") == variable) & (F.col("isobaricInhPa") == float(level)))
        .select(*SNAPSHOT_COLUMNS)
        .dropna()
    )


def select_channel(df: DataFrame, variable: str, level: float | None) -> DataFrame:
    """Rows of one channel: any letter case, level within tolerance, surface for ``None``."""
    tidy = require_columns(
        normalise_level(df), ["variable", "latitude", "longitude", "value", "isobaricInhPa"]
    )
    pressure = tidy["isobaricInhPa"]
    if dict(tidy.dtypes)["isobaricInhPa"] == "string":
        pressure = number(pressure)
    at_level = is_surface(pressure) if level is None else near(pressure, float(level))
    return tidy.where(at_level & (F.lower("variable") == variable.lower()))


def bi_input(df: DataFrame, variable: str, **partition: str) -> DataFrame:
    """Decimal view of one partition of one variable for a BI tool."""
    rows = df.where(F.col("variable") == variable)
    for name, value in partition.items():
        rows = rows.where(F.col(name) == value)
    return rows.select(
        F.col("latitude").cast("decimal(9,4)").alias("lat"),
        F.col("longitude").cast("decimal(9,4)").alias("lon"),
        F.col("value").cast("decimal(10,4)").alias("t2m"),
    )


def latest_run(df: DataFrame) -> DataFrame:
    """Rows of the most recent (date, run) pair."""
    newest = df.agg(F.max(F.struct("date", "run")).alias("_newest")).select(
        F.col("_newest.date").alias("date"), F.col("_newest.run").alias("run")
    )
    return df.join(F.broadcast(newest), ["date", "run"], "left_semi")


def counted(df: DataFrame, keep) -> DataFrame:
    """Row counts before and after a filter, in one pass."""
    return df.agg(
        F.count("*").alias("rows_before"), F.count_if(keep).alias("rows_after")
    )


def lower_variables(df: DataFrame) -> DataFrame:
    """Variable names in lower case, as catalogs disagree on them."""
    return df.withColumn("variable", F.lower("variable"))


def head_points(df: DataFrame, limit: int) -> DataFrame:
    """First points by variable, level (surface first), latitude from the north and longitude."""
    order = ["variable", F.asc_nulls_first("isobaricInhPa"), F.desc("latitude"), "longitude"]
    return normalise_level(df).orderBy(*order).limit(limit)
