"""Wide fields to tidy rows, and merging of message groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.weather import geopotential, readable_name, soil_name
from gridloom.operators.extract import normalise_level
from gridloom.functions.coords import no_nan
from gridloom.schema import TIDY_BODY
from gridloom.session import materialise

COORDS = ["isobaricInhPa", "latitude", "longitude"]


def dataset_name(level):
    """``surface`` without a pressure level, else ``upper``."""
    return F.when(level.isNull() | F.isnan(level), "surface").otherwise("upper")


def melt_fields(wide: DataFrame, *keys: str, layer: str | None = None) -> DataFrame:
    """One row per (point, field). The field names are all columns that are no coordinate.

    On pressure levels ``gh`` becomes ``z``. A soil layer column gives one variable per layer.
    A null value stays a row, as in a dense field.
    """
    ids = [*keys, *COORDS] + ([layer] if layer else [])
    fields = [c for c in wide.columns if c not in ids]
    level = F.col("isobaricInhPa")
    long = wide.select(
        *ids, *[F.col(c).cast("float").alias(c) for c in fields]
    ).unpivot(ids, fields, "code", "raw")
    height = (F.col("code") == "gh") & level.isNotNull() & ~F.isnan(level)
    code = F.col("code")
    if layer:
        code = F.when(F.col(layer).isNotNull(), soil_name(code, F.col(layer))).otherwise(code)
    return long.select(
        *keys,
        F.when(~F.isnan(level), level).alias("isobaricInhPa"),
        "latitude",
        "longitude",
        F.when(height, F.lit("z")).otherwise(readable_name(code)).alias("variable"),
        F.when(height, geopotential(F.col("raw"))).otherwise(F.col("raw")).alias("value"),
    )


def stamp_run(tidy: DataFrame, date: str, run: str) -> DataFrame:
    return tidy.withColumns({"date": F.lit(date), "run": F.lit(run)})


def split_datasets(tidy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surface rows and pressure-level rows."""
    tagged = normalise_level(tidy).withColumn("_dataset", dataset_name(F.col("isobaricInhPa")))
    pick = lambda name: tagged.where(F.col("_dataset") == name).drop("_dataset")
    return pick("surface"), pick("upper")


def union_fields(spark: SparkSession, frames: list[DataFrame], schema: str = TIDY_BODY) -> DataFrame:
    """Union by name; a column that a frame lacks is null there. No frame at all still gives the schema."""
    empty = spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else empty


def merge_groups(frames: list[DataFrame], *keys: str, per_point: bool = False) -> DataFrame:
    """Merge tidy message groups where an earlier frame wins.

    By default the whole variable comes from the first frame that has it. The winners are one
    row per variable, written first so that the join knows their size. ``per_point`` instead fills
    point by point from later frames: a null or NaN of an earlier frame does not hide a later number, and the point's further columns
    come from the frame of its value.
    """
    stacked = union_fields(
        frames[0].sparkSession,
        [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)],
    )
    if not per_point:
        first = materialise(stacked.groupBy(*keys, "variable").agg(F.min("_rank").alias("_rank")), "winners")
        return stacked.join(first, [*keys, "variable", "_rank"], "left_semi").drop("_rank")
    place = [*keys, "variable", *COORDS]
    rest = [c for c in stacked.columns if c not in place and c != "_rank"]
    empty = no_nan(F.col("value").cast("double")).isNull()
    best = stacked.groupBy(*place).agg(F.min_by(F.struct(*rest), F.struct(empty, "_rank")).alias("_best"))
    return best.select(*place, "_best.*")


def wide_from_tidy(tidy: DataFrame, variables: list[str], *keys: str) -> DataFrame:
    """Align named variables on the same point with one aggregation instead of self-joins."""
    return tidy.where(F.col("variable").isin(variables)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    )


def align_pairs(tidy: DataFrame, left: str, right: str, *keys: str) -> DataFrame:
    """Points of two variables and whether both are there."""
    wide = wide_from_tidy(tidy, [left, right], *keys)
    return wide.withColumn("aligned", F.col(left).isNotNull() & F.col(right).isNotNull())


def north_first(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys, F.desc("latitude"), "longitude")


