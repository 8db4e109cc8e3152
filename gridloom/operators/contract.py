"""Data contracts checked against a table's schema and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.profile import null_counts
from gridloom.sources.files import hashed_files

# Contract types and the Spark types that satisfy them.
CONTRACT_TYPES = {
    "INTEGER": ("tinyint", "smallint", "int", "bigint"),
    "STRING": ("string",),
    "DECIMAL": ("float", "double", "decimal"),
}


def table_violations(df: DataFrame, fields: list[dict]) -> DataFrame:
    """(column_name, rule, row_count): absent columns, wrong types, nulls where none may be.

    The rows are read once, and only for the columns that must not be null.
    """
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    found, strict = [], []
    for field in fields:
        name = field["name"]
        if name not in kinds:
            found.append((name, "missing_column", None))
            continue
        if kinds[name].split("(")[0] not in CONTRACT_TYPES[field["type"]]:
            found.append((name, "wrong_type", None))
        if field.get("nullable", True) is False:
            strict.append(name)
    schema = "column_name STRING, rule STRING, row_count BIGINT"
    violations = spark.createDataFrame(found, schema)
    if strict:
        nulls = null_counts(df.select(*strict)).where("null_count > 0").select(
            "column_name", F.lit("null_value").alias("rule"), F.col("null_count").alias("row_count")
        )
        violations = violations.unionByName(nulls)
    return violations


def column_report(df: DataFrame, required: list[str]) -> DataFrame:
    """Required columns: present or not, and how many rows hold a value."""
    present = [c for c in required if c in df.columns]
    absent = [c for c in required if c not in df.columns]
    filled = df.agg(*[F.count(c).alias(c) for c in present]).unpivot(
        [], present, "column_name", "value_count"
    ).withColumn("present", F.lit(True))
    if not absent:
        return filled
    rest = df.sparkSession.createDataFrame(
        [(c, 0, False) for c in absent], "column_name STRING, value_count BIGINT, present BOOLEAN"
    )
    return filled.unionByName(rest)


def model_table_faults(model: DataFrame) -> DataFrame:
    """One row: size of a lookup model table, rows that break it, and the verdict."""
    bad = F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon")
    return model.agg(
        F.count("*").alias("grid_rows"),
        F.count_if(bad).alias("bad_coordinates"),
        F.count_if(F.col("value").isNull()).alias("missing_values"),
    ).withColumn(
        "ok",
        (F.col("grid_rows") > 0) & (F.col("bad_coordinates") == 0) & (F.col("missing_values") == 0),
    )


def asset_inventory(spark, path: str, glob: str = "*") -> DataFrame:
    """Size and SHA-256 of every file below ``path``, one file per row, of any size."""
    return hashed_files(spark, path, glob)


def inventory_verdict(assets: DataFrame, checks: DataFrame) -> DataFrame:
    """Totals of an inventory and ``ok`` if every named check holds."""
    totals = assets.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"))
    flags = checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ok"))
    one = F.lit(1)
    return totals.withColumn("_one", one).join(flags.withColumn("_one", one), "_one").drop("_one")
