"""The partition job: validate every step, build the tensors of the good ones, publish a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.extract import ContractError
from gridloom.operators.assemble import assembled_rows, availability, line_facets, no_points, off_grid_points, step_lines
from gridloom.operators.tensor import published_rows, tensor_status
from gridloom.operators.validate import check_policy, facet_report, report_columns
from gridloom.schema import MODEL_GRID, GridSpec
from gridloom.session import materialise


@dataclass
class TensorJob:
    reports: DataFrame
    steps: DataFrame
    tensors: DataFrame


def run_tensor_job(
    tidy: DataFrame, *keys: str, policy: str = "fail", spec: GridSpec = MODEL_GRID,
    allow_incomplete: bool = False, channels=None,
) -> TensorJob:
    """All steps of all requested partitions in one job, with a single shuffle of their rows.

    The lines of the steps are assembled once. Reports (with the available variables and levels) are rolled up from them, and the lines of good steps are the row-tensors.
    Reports and row-tensors are written to the shared folder first. A strict job stops before
    anything is handed out if one step is not good, so nothing half-publishes.
    """
    policy = check_policy(policy)
    if absent := report_columns(tidy):
        raise ContractError(f"the tidy table lacks {', '.join(absent)}; no step can be judged")
    lines = step_lines(tidy, *keys, spec=spec, channels=channels)
    beside = off_grid_points(tidy, *keys, spec=spec, channels=channels) if lines.where("off_grid > 0").limit(1).count() else None
    facets = line_facets(lines, beside if beside is not None else no_points(lines, *keys), *keys)
    reports = facet_report(facets, *keys, policy=policy, spec=spec, channels=channels)
    reports = materialise(reports.join(availability(lines, *keys), list(keys), "left"), "reports")
    rows = materialise(assembled_rows(lines, reports, *keys, spec=spec), "rows")
    status = materialise(tensor_status(rows, *keys, spec=spec, channels=channels), "status")
    steps = reports.select(*keys, "ok").join(status, list(keys), "left").select(
        *keys,
        F.lit(policy).alias("latitude_policy"),
        F.lit(allow_incomplete).alias("allow_incomplete"),
        (F.col("ok") & F.coalesce("tensor_ok", F.lit(False))).alias("tensor_written"),
        F.when(~F.col("ok"), "validation_failed")
        .when(F.coalesce("tensor_ok", F.lit(False)), "written").otherwise("tensor_incomplete")
        .alias("tensor_write_reason"),
        F.when(F.col("tensor_ok"), F.col("shape")).alias("tensor_shape"),
        F.when(F.col("tensor_ok"), "float32").alias("tensor_dtype"),
    )
    if not allow_incomplete:
        bad = steps.where(~F.col("tensor_written")).agg(
            F.count("*").alias("n"), F.min(F.concat_ws("/", *keys)).alias("first")
        ).first()
        if bad["n"]:
            raise ContractError(f"{bad['n']} steps are incomplete, first {bad['first']}; nothing was published")
    return TensorJob(reports, steps, published_rows(rows, status, *keys))


def partition_manifest(steps: DataFrame, *partition: str) -> DataFrame:
    """One manifest row per partition with the records of its steps."""
    record = [c for c in steps.columns if c not in partition]
    return steps.groupBy(*partition).agg(
        F.count("*").alias("step_count"),
        F.count_if("tensor_written").alias("tensors_written"),
        F.when(F.bool_and("tensor_written"), "ok").otherwise("incomplete").alias("status"),
        F.array_sort(F.collect_list(F.struct(*record))).alias("processed_files"),
    )
