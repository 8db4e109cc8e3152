"""Readers of tidy Parquet, catalog tables and point files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.extract import ContractError, require_columns, require_rows
from gridloom.schema import TIDY


def step_key(path=None):
    """The forecast step a file belongs to.

    A foreign file is a step of its own, except below ``dataset=`` folders, where the surface and upper
    files together make one. Part files that Spark wrote are pieces of their folder's step, so a sink for several steps needs a step folder.
    """
    path = F.col("_metadata.file_path") if path is None else path
    return (
        F.when(path.contains("/dataset="), F.regexp_extract(path, "^(.*?)/dataset=", 1))
        .when(path.rlike(r"/part-\d+[^/]*$"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(path)
    )


def read_tidy(spark: SparkSession, base: str, schema: str = TIDY) -> DataFrame:
    """Tidy table with string partition columns, the step key and the file-name facets.

    The explicit schema keeps ``04`` a string and spares a footer read per file.
    """
    rows = spark.read.schema(schema).parquet(base)
    return rows.select(
        "*", step_key().alias("step_key"), F.col("_metadata.file_name").alias("step_file")
    )


def scan_partition(spark: SparkSession, base: str, **partition: str) -> DataFrame:
    """Rows of one or more partitions; listing is pruned by the partition predicate."""
    rows = read_tidy(spark, base)
    for name, value in partition.items():
        rows = rows.where(F.col(name) == value)
    return require_rows(rows, f"partition {partition}")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points from ``.csv`` (with header) or ``.parquet``, chosen by the suffix."""
    suffix = path.rstrip("/").lower().rsplit(".", 1)[-1]
    if suffix == "csv":
        header = spark.read.option("header", True).csv(path)
        numeric = {"latitude", "longitude", "value"}
        points = header.select(
            *[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in header.columns]
        )
    elif suffix == "parquet":
        points = spark.read.parquet(path)
    else:
        raise ContractError("points must come from a .csv or .parquet path")
    return require_columns(points, ["latitude", "longitude"])


def read_training_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows of a folder: all of ``train.csv``, a file or a written folder, if there is one.

    Otherwise all part files if Spark wrote the folder, else the first CSV by name, as a folder of foreign files holds one table per file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option(
        "recursiveFileLookup", "true").load(folder).select("path")
    kind = (
        F.when(F.col("path").rlike(r"/train\.csv(/[^/]*)?$"), 0).when(F.col("path").rlike(r"/part-\d+[^/]*$"), 1).otherwise(2)
    )
    best = files.agg(F.min(F.struct(kind.alias("kind"), "path")).alias("best")).first()["best"]
    if best is None:
        raise ContractError(f"no CSV file in {folder}")
    where = best["path"] if best["kind"] == 2 or best["path"].endswith("/train.csv") else best["path"].rsplit("/", 1)[0]
    return require_columns(
        spark.read.option("header", True).schema("latitude DOUBLE, longitude DOUBLE, value DOUBLE").csv(where),
        ["latitude", "longitude", "value"],
    )


SNAPSHOT_SQL = """
SELECT latitude, longitude, value
FROM IDENTIFIER(:table)
WHERE variable = :variable AND isobaricInhPa = :level
  AND year = :year AND month = :month AND day = :day AND hour IN (:hour, :hour_z)
"""


def catalog_snapshot(
    spark: SparkSession, table: str, year: str, month: str, day: str, hour: str,
    variable: str = "t", level: float = 1000.0,
) -> DataFrame:
    """The snapshot query on a catalog table, with every value bound as a parameter.

    Hour folders are spelled with or without ``z``; an empty result stops.
    """
    if not re.fullmatch(r"(00|06|12|18)z?", hour.strip().lower()):
        raise ContractError(f"hour must be 00, 06, 12 or 18 with or without z: {hour}")
    args = {
        "table": table, "variable": variable, "level": float(level), "year": year, "month": month,
        "day": day, "hour": hour.strip().lower()[:2], "hour_z": hour.strip().lower()[:2] + "z",
    }
    return require_rows(spark.sql(SNAPSHOT_SQL, args=args).dropna(), f"snapshot of {table}")
