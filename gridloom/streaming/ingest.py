"""Incremental twins of the batch jobs, on file streams with ``availableNow``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.plans.classify import score_points
from gridloom.schema import MODEL_GRID, TIDY_BODY, GridSpec
from gridloom.session import materialise, scratch_scope
from gridloom.sources import commits
from gridloom.sources.writers import TIME_PARTITIONS, with_time_partitions

#: Files of one micro-batch.
FILES_PER_BATCH = 1000
#: Values of a key that are written into a scan's filter; beyond, a join filters.
LITERAL_KEYS = 1000


def arrivals(spark: SparkSession, landing: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a landing folder; the stream log remembers what was read."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(landing)


def ingest_tidy(
    spark: SparkSession, landing: str, target: str, log: str, extra: str = "", partition_extra: tuple[str, ...] = (),
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append newly landed step files to the partitioned tidy table, each file exactly once."""
    schema = TIDY_BODY + (f", {extra}" if extra else "")
    rows = with_time_partitions(arrivals(spark, landing, schema, files_per_batch))
    return (
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", log)
        .partitionBy(*TIME_PARTITIONS, *partition_extra).trigger(availableNow=True).start()
    )


def validate_arrivals(
    spark: SparkSession, landing: str, log: str, handle: Callable[[DataFrame, int], None],
    extra: str = "", files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Hand every micro-batch to a batch operator.

    A batch may be delivered again after a failure, so ``handle`` must overwrite what it publishes,
    step by step.
    """
    schema = TIDY_BODY + (f", {extra}" if extra else "")
    return (
        arrivals(spark, landing, schema, files_per_batch).writeStream.foreachBatch(handle)
        .option("checkpointLocation", log).trigger(availableNow=True).start()
    )


def touched_rows(table: DataFrame, touched: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``table`` whose keys are among ``touched``.

    Folders are pruned by literals only where few values are counted; else the semi-join does it, at run time.
    """
    counts = touched.agg(*[F.count_distinct(k).alias(k) for k in keys]).first()
    for k in keys:
        if counts[k] <= LITERAL_KEYS:
            table = table.where(F.col(k).isin([r[0] for r in touched.select(k).where(F.col(k).isNotNull()).distinct().collect()]))
    return table.join(touched, list(keys), "left_semi")


def tensor_publisher(
    tidy_table: str, base: str, *keys: str, spec: GridSpec = MODEL_GRID,
    extra: str = "", channels=None, policy: str = "fail",
) -> Callable[[DataFrame, int], None]:
    """Handler that judges the steps of a batch on their whole rows in the tidy table.

    A step may arrive in several files. Only its newest state in the table counts. Reports, tensors and manifest rows of a batch become visible together, by the commit of the batch's
    number below ``base``: a handler that is cut off leaves the earlier state, and a batch that is sent again after its commit changes nothing.
    """
    from gridloom.plans.tensor_job import run_tensor_job
    from gridloom.schema import TIDY

    schema = TIDY + (f", {extra}" if extra else "")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if commits.is_committed(spark, base, batch_id):
            return
        with scratch_scope(spark):
            touched = materialise(batch.select(*keys).distinct(), "touched")
            rows = spark.read.schema(schema).parquet(tidy_table)
            whole = touched_rows(rows.withColumn("step_file", F.col("_metadata.file_name")), touched, *keys)
            job = run_tensor_job(whole, *keys, spec=spec, allow_incomplete=True, channels=channels, policy=policy)
            commits.publish_job(job, base, batch_id, *keys, sources=commits.source_files(whole, *keys))

    return handle


def score_arrivals(spark: SparkSession, landing: str, target: str, log: str, config: dict | None = None) -> StreamingQuery:
    """Classifier scores of newly landed points; stateless, so append mode needs no watermark."""
    points = arrivals(spark, landing, "event_id BIGINT, lat DOUBLE, lon DOUBLE, t2m DOUBLE")
    return (
        score_points(points, config).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", log).trigger(availableNow=True).start()
    )
