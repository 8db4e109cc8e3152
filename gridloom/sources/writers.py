"""Sinks: tidy tables, snapshots, predictions, row-tensors, reports and external tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.coords import partition_date, run_suffixed
from gridloom.functions.text import score_text
from gridloom.operators.melt import dataset_name
from gridloom.operators.extract import require_rows
from gridloom.schema import (
    PREDICTION_OPTIONAL, PREDICTION_PARTITIONS, PREDICTION_REQUIRED, prediction_schema,
)

TIME_PARTITIONS = ["year", "month", "day", "hour"]


def with_time_partitions(tidy: DataFrame) -> DataFrame:
    """Add year, month, day and hour from ``date`` and ``run``."""
    return tidy.withColumns(
        {**partition_date(F.col("date")), "hour": run_suffixed(F.col("run"))}
    )


def write_tidy(tidy: DataFrame, path: str, *extra: str, split_dataset: bool = False, mode: str = "error") -> str:
    """Hive-partitioned snappy Parquet, clustered so that row-group extremes are selective.

    The range exchange spreads a partition that holds most rows over many tasks, since it also
    cuts on variable, level and position.
    """
    rows = with_time_partitions(tidy) if "year" not in tidy.columns else tidy
    parts = [*TIME_PARTITIONS, *extra]
    if split_dataset:
        rows = rows.withColumn("dataset", dataset_name(F.col("isobaricInhPa")))
        parts.append("dataset")
    order = [*parts, "variable", "isobaricInhPa", "latitude", "longitude"]
    (
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode(mode).option("compression", "snappy").partitionBy(*parts).parquet(path)
    )
    return path


def write_snapshot(df: DataFrame, path: str) -> str:
    df.write.mode("error").option("header", True).csv(path)
    return path


def write_predictions(df: DataFrame, path: str) -> str:
    """Replace only the partitions present in ``df``; rows are gathered by folder, and a large folder is split again."""
    names = PREDICTION_REQUIRED + PREDICTION_OPTIONAL + PREDICTION_PARTITIONS
    (
        df.select(*names).hint("rebalance", *PREDICTION_PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PREDICTION_PARTITIONS).parquet(path)
    )
    return path


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(prediction_schema()).parquet(path)


def write_row_tensors(rows: DataFrame, path: str, *keys: str) -> str:
    """One folder per step; a rerun replaces the steps it holds."""
    (
        rows.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys).parquet(path)
    )
    return path


def write_reports(df: DataFrame, path: str, *keys: str) -> str:
    """JSON files, a line per report, filed under its keys rather than a clock; a rerun replaces its own."""
    body = F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in keys]))
    df.select(*keys, body.alias("report")).hint("rebalance", *keys).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*keys).text(path)
    return path


def write_scores(df: DataFrame, path: str, order: str = "row_number") -> str:
    """Headerless ``label,score`` lines in input order, six decimals."""
    (
        df.select(order, "label", score_text(F.col("score")).alias("score"))
        .repartitionByRange(order).sortWithinPartitions(order)
        .select("label", "score").write.mode("error").csv(path)
    )
    return path


def write_training(df: DataFrame, path: str, dataset: str) -> DataFrame:
    """``train.csv`` and ``metadata.json`` below ``path``; the one-row metadata is counted from what was written.

    An empty table stops before anything is written.
    """
    columns = ["latitude", "longitude", "value"]
    rows = require_rows(df.select(*columns).dropna(), "training table")
    where = f"{path}/train.csv"
    rows.write.mode("error").option("header", True).csv(where)
    written = df.sparkSession.read.option("header", True).schema(
        "latitude DOUBLE, longitude DOUBLE, value DOUBLE"
    ).csv(where)
    record = written.agg(F.count("*").alias("row_count")).select(
        F.lit(dataset).alias("dataset_name"), "row_count",
        F.array(*[F.lit(c) for c in columns]).alias("columns"), F.lit(where).alias("source_csv"),
    )
    record.coalesce(1).write.mode("error").json(f"{path}/metadata.json")
    return record


def write_zone_map(zones: DataFrame, path: str) -> str:
    zones.write.mode("error").option("header", True).csv(path)
    return path


def create_prediction_table(spark: SparkSession, table: str, path: str, *, discover: bool = True) -> None:
    """External table over the prediction folders; ``discover`` registers all that are there, by a listing of the whole table."""
    parts = set(PREDICTION_PARTITIONS)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in prediction_schema() if f.name not in parts]
    fields += [f"{name} string" for name in PREDICTION_PARTITIONS]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(fields)}) USING PARQUET "
        f"PARTITIONED BY ({', '.join(PREDICTION_PARTITIONS)}) LOCATION '{path}'"
    )
    if discover:
        spark.sql(f"MSCK REPAIR TABLE {table}")


#: Partitions of one statement.
PARTITIONS_PER_STATEMENT = 100


def register_partitions(spark: SparkSession, table: str, written: DataFrame) -> int:
    """Add the partitions that ``written`` has rows for to a table, and return their number; no other folder is listed.

    A write names each of its folders to the driver anyway, and no more of them come here.
    """
    folders = sorted(tuple(r) for r in written.select(*PREDICTION_PARTITIONS).distinct().collect())
    quoted = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    clauses = [f"PARTITION ({', '.join(f'{c} = {quoted(v)}' for c, v in zip(PREDICTION_PARTITIONS, folder))})" for folder in folders]
    for at in range(0, len(clauses), PARTITIONS_PER_STATEMENT):
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(clauses[at:at + PARTITIONS_PER_STATEMENT])}")
    return len(folders)


def inspect_predictions(df: DataFrame, limit: int = 50, **partition: str) -> DataFrame:
    """First ``limit`` predictions of one partition in a stable order."""
    rows = df
    for name, value in partition.items():
        rows = rows.where(F.col(name) == value)
    return (
        rows.select(
            "latitude", "longitude", "target_variable", "predicted_value",
            "prediction_timestamp_utc", *PREDICTION_PARTITIONS, "prediction_id",
        )
        .orderBy("latitude", "longitude", "prediction_id").limit(limit).drop("prediction_id")
    )
