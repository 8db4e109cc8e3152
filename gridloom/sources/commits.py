"""Publishing several tables together: attempt folders, and one manifest file per commit that makes them visible.

Layout below ``base``::

    tensors/attempt=<id>/<key>=.../   row-tensors of the steps of one attempt
    reports/attempt=<id>/             their reports
    manifest/commit=<number>/         one file: a row per step with the attempt that holds it

Nothing is visible before the commit's file is renamed into place, and all of it is visible after. Readers take, for every step, the attempt of its newest commit. Attempts that
never reached a commit are invisible, however far they came, and ``sweep`` removes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import delete_path, list_folders, path_exists

#: Columns of a manifest row besides the keys of the step.
RECORD = (
    "attempt string, source_files array<string>, report_file string, tensor_file string, latitude_policy string, allow_incomplete boolean, tensor_written boolean, "
    "tensor_write_reason string, tensor_shape array<int>, tensor_dtype string, status string"
)
FIRST_COMMIT = 0


def manifest_schema(keys: dict[str, str]) -> str:
    return ", ".join([*[f"{k} {kind}" for k, kind in keys.items()], RECORD, "commit long"])


def is_committed(spark: SparkSession, base: str, commit: int) -> bool:
    return path_exists(spark, f"{base}/manifest/commit={commit}/_SUCCESS")


def next_commit(spark: SparkSession, base: str) -> int:
    """Number behind the newest commit, from the folder names alone."""
    numbers = [int(name.split("=")[1]) for name in list_folders(spark, f"{base}/manifest") if name.startswith("commit=")]
    return max(numbers, default=FIRST_COMMIT - 1) + 1


def new_attempt(commit: int) -> str:
    """A name that no other attempt has, not even an earlier one at the same commit that was cut off."""
    return f"{commit:012d}-{uuid.uuid4().hex}"


def write_attempt(reports: DataFrame, tensors: DataFrame, base: str, attempt: str, *keys: str) -> None:
    """Both tables of an attempt, in any order: neither counts before the commit."""
    reports.write.mode("error").parquet(f"{base}/reports/attempt={attempt}")
    tensors.hint("rebalance", *keys).write.mode("error").partitionBy(*keys).parquet(f"{base}/tensors/attempt={attempt}")


def commit_records(steps: DataFrame, sources: DataFrame | None, attempt: str, *keys: str) -> DataFrame:
    """Manifest rows of a job's steps (see ``run_tensor_job``); ``sources`` has the keys and ``source_files``."""
    record = steps.join(sources, list(keys), "left") if sources is not None else steps.withColumn("source_files", F.lit(None).cast("array<string>"))
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    written = F.col("tensor_written")
    return record.select(
        *keys, F.lit(attempt).alias("attempt"), "source_files", F.lit(f"reports/attempt={attempt}").alias("report_file"),
        F.when(written, F.concat(F.lit(f"tensors/attempt={attempt}/"), folder)).alias("tensor_file"),
        "latitude_policy", "allow_incomplete", "tensor_written", "tensor_write_reason", F.col("tensor_shape").cast("array<int>").alias("tensor_shape"), "tensor_dtype",
        F.when(written, "ok").otherwise("incomplete").alias("status"),
    )


def write_commit(records: DataFrame, base: str, commit: int) -> None:
    """The commit point: one file, one rename. A number can be taken once only."""
    records.coalesce(1).write.mode("error").parquet(f"{base}/manifest/commit={commit}")


def read_manifest(spark: SparkSession, base: str, **keys: str) -> DataFrame:
    """All manifest rows; ``keys`` are the key columns with their types."""
    return spark.read.schema(manifest_schema(keys)).parquet(f"{base}/manifest")


def current(manifest: DataFrame, *keys: str) -> DataFrame:
    """The newest row of every step."""
    newest = manifest.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in manifest.columns if c not in keys]), "commit").alias("r"))
    return newest.select(*keys, "r.*")


def read_published(spark: SparkSession, base: str, schema: str, **keys: str) -> DataFrame:
    """Row-tensors of all steps whose newest commit wrote them; ``schema`` is that of the row-tensors without keys.

    ``attempt`` is the outermost folder, so Spark prunes attempts by what the manifest names.
    """
    chosen = current(read_manifest(spark, base, **keys), *keys).where("tensor_written").select("attempt", *keys)
    kinds = ", ".join([schema, "attempt string", *[f"{k} {kind}" for k, kind in keys.items()]])
    return spark.read.schema(kinds).parquet(f"{base}/tensors").join(chosen, ["attempt", *keys], "left_semi").drop("attempt")


def read_reports(spark: SparkSession, base: str, schema: str, **keys: str) -> DataFrame:
    """The report of every step's newest commit; ``schema`` is that of the reports, keys included."""
    chosen = current(read_manifest(spark, base, **keys), *keys).select("attempt", *keys)
    return spark.read.schema(f"{schema}, attempt string").parquet(f"{base}/reports").join(chosen, ["attempt", *keys], "left_semi").drop("attempt")


def sweep(spark: SparkSession, base: str, **keys: str) -> list[str]:
    """Remove attempts that no step's newest commit names, and return their names. Attempts of a later commit than the newest may be at work and stay.

    Run it from the writer, between commits, and when no reader holds an older state.
    """
    after = next_commit(spark, base)
    used = {r["attempt"] for r in current(read_manifest(spark, base, **keys), *keys).select("attempt").distinct().toLocalIterator()} if after > FIRST_COMMIT else set()
    found = {name.split("=", 1)[1] for table in ("tensors", "reports") for name in list_folders(spark, f"{base}/{table}") if name.startswith("attempt=")}
    gone = sorted(a for a in found - used if int(a.split("-")[0]) < after)
    for attempt in gone:
        for table in ("tensors", "reports"):
            delete_path(spark, f"{base}/{table}/attempt={attempt}")
    return gone


def publish_job(job, base: str, commit: int, *keys: str, sources: DataFrame | None = None) -> bool:
    """Write a tensor job's reports and tensors as one commit. A commit that is there already is left as it is; the answer is whether it was written now."""
    spark = job.steps.sparkSession
    if is_committed(spark, base, commit):
        return False
    attempt = new_attempt(commit)
    write_attempt(job.reports, job.tensors, base, attempt, *keys)
    write_commit(commit_records(job.steps, sources, attempt, *keys), base, commit)
    return True


def source_files(tidy: DataFrame, *keys: str, name: str = "step_file") -> DataFrame:
    """The files that each step was read from, in order; the scan needs the keys only."""
    files = tidy.select(*keys, name).distinct()
    return files.groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias("source_files"))
