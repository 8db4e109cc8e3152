"""Manifest-driven tensor jobs: one report per request, and the verdict over a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.tensor import shape_verdict, statistics_columns, statistics_fault
from gridloom.plans.forward import Loader, forward_outcomes
from gridloom.schema import GUARD_ELEMENTS
from gridloom.session import materialise

STATS = ["elements", "finite", "nan_count", "min", "max", "mean", "std"]


def guard_blocks(elements, guard):
    """A guarded request may not exceed the element limit."""
    return guard & (elements > GUARD_ELEMENTS)


def tensor_profiles(rows: DataFrame, key: str = "tensor_uri") -> DataFrame:
    """Shape and statistics of each row-tensor, from one scan: a small table, written once."""
    flat = rows.select(key, "channel_index", "lat_index", F.posexplode("values").alias("_pos", "value"))
    size = lambda c: (F.max(c) + 1).cast("int")
    profiles = flat.groupBy(key).agg(
        F.array(F.lit(1), size("channel_index"), size("lat_index"), size("_pos")).alias("shape"),
        *statistics_columns("value"),
    )
    return materialise(profiles, "profiles")


def request_plan(requests: DataFrame, profiles: DataFrame, grid=(20, 720, 1440)) -> DataFrame:
    """Requests with the profile of their tensor and the reason a forward run is refused, if any.

    ``profiles`` has one row per tensor. A tensor that many requests name is described once.
    """
    described = profiles.select(
        F.col("tensor_uri").alias("input_s3_uri"), "shape", "elements", F.lit(True).alias("_found"),
        F.struct(*STATS).alias("input_tensor"),
    )
    planned = requests.join(described, "input_s3_uri", "left")
    refused = F.when(
        F.col("mode") == "forward",
        F.when(guard_blocks(F.col("elements"), F.col("max_runtime_guard")), "runtime_guard_blocked_large_tensor")
        .otherwise(shape_verdict(F.col("shape"), grid)),
    )
    return planned.withColumn("forward_reason", refused).withColumn(
        "found", F.coalesce("_found", F.lit(False))
    ).drop("_found")


def named_tensors(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the tensors in ``wanted.tensor_uri``."""
    return rows.join(wanted.select("tensor_uri").distinct(), "tensor_uri", "left_semi")


def statistics_block(stats: DataFrame, channels: int = 20) -> DataFrame:
    """One row, ``stats``: what the tables of means and deviations hold, as every report repeats it."""
    inside = stats.where(F.col("channel_index").between(0, channels - 1))
    sides = []
    for name, column in (("global_means", "mean"), ("global_stds", "std")):
        facts = inside.agg(F.struct(F.array(F.lit(1), F.count("*").cast("int"), F.lit(1), F.lit(1)).alias("shape"), *statistics_columns(column)).alias(name))
        sides.append(facts.withColumn("_one", F.lit(1)))
    return sides[0].join(sides[1], "_one").select(F.struct("global_means", "global_stds").alias("stats"))


def request_reports(
    requests: DataFrame, rows: DataFrame, stats: DataFrame, *, timestamp_utc: str,
    model: Loader | None = None, model_name: str = "model", grid=(20, 720, 1440),
) -> DataFrame:
    """One report per request line; no request can fail the job, and none can fail another.

    Only tensors that a request names are profiled, once each. The model sees the tensors of accepted forward requests alone: found, without a parse error, inside the
    guard and of the right shape. It runs once a tensor, and what it raises is in the reports of those requests that name the tensor. Faulty statistics are in the reports of all accepted ones.
    ``forward`` tells how a forward request went (null for others): guard limit and elements where the guard blocked it, expected and found
    shape where they differ, shapes and error otherwise. ``stats`` describes the statistics tables.
    """
    named = requests.where(F.col("error").isNull()).select(F.col("input_s3_uri").alias("tensor_uri"))
    plan = request_plan(requests, tensor_profiles(named_tensors(rows, named)), grid)
    accepted = (F.col("mode") == "forward") & F.col("error").isNull() & F.col("found") & F.col("forward_reason").isNull()
    fault = statistics_fault(stats, grid[0]) if model is not None else None
    if model is not None and fault is None:
        ready = materialise(plan.where(accepted).select(F.col("input_s3_uri").alias("tensor_uri")).distinct(), "accepted")
        outcomes = materialise(forward_outcomes(rows, ready, stats, model, grid[0], model_name), "outcomes").select(
            F.col("tensor_uri").alias("input_s3_uri"), "output_shape", F.col("error_type").alias("_raised"), F.col("error_message").alias("_message"),
            F.when(F.col("error_type").isNull(), F.struct(*STATS)).alias("output_stats"),
        )
        plan = plan.join(outcomes, "input_s3_uri", "left")
    else:
        nothing = {"output_shape": "array<int>", "_raised": "string", "_message": "string"}
        plan = plan.withColumns({c: F.lit(None).cast(kind) for c, kind in nothing.items()}).withColumn(
            "output_stats", F.lit(None).cast(plan.schema["input_tensor"].dataType)
        )
    plan = plan.withColumn("fault", F.when(accepted, F.lit(fault).cast("string")))
    tried = (F.col("mode") == "forward") & F.col("found") & F.col("error").isNull() & F.col("fault").isNull()
    not_run = F.lit("model_not_available") if model is None else F.when(F.col("_raised").isNotNull(), "forward_execution_failed")
    reason = F.when(tried, F.coalesce("forward_reason", not_run))
    failed = ~F.col("found") | F.col("error").isNotNull() | F.col("fault").isNotNull()
    ok = ~failed & F.when(F.col("mode") == "forward", reason.isNull()).otherwise(True)
    result = (
        F.when(failed, "prediction_failed")
        .when(F.col("mode") == "metadata_only", "metadata_collected")
        .when(ok, "forward_succeeded").otherwise("forward_failed")
    )
    message = F.coalesce(
        "error", "fault",
        F.when(F.col("input_s3_uri") == "", "No tensor provided")
        .when(~F.col("found"), F.concat(F.lit("tensor not found: "), "input_s3_uri")),
    )
    blocked, misshapen = (F.coalesce(reason == r, F.lit(False)) for r in ("runtime_guard_blocked_large_tensor", "input_shape_mismatch"))
    forward = F.when(tried, F.struct(
        reason.isNull().alias("ok"), reason.alias("reason"),
        F.when(blocked, GUARD_ELEMENTS).alias("guard_elements_limit"), F.when(blocked, F.col("elements")).alias("tensor_elements"),
        F.when(misshapen, F.array(*[F.lit(x) for x in grid])).alias("expected"), F.when(misshapen, F.slice("shape", -3, 3)).alias("got"),
        F.when(~blocked, F.col("shape")).alias("input_shape"), F.col("output_shape"), F.col("output_stats"),
        F.col("_raised").alias("error_type"), F.col("_message").alias("error_message"),
    ))
    reports = plan.select(
        "request_id", "mode", ok.alias("ok"), result.alias("result"),
        reason.alias("reason"), "input_s3_uri", "output_s3_uri", "shape",
        F.when(failed, "ValueError").alias("error_type"), message.alias("error_message"),
        "input_tensor", F.when(ok & (F.col("mode") == "forward"), F.col("output_stats")).alias("output_stats"),
        forward.alias("forward"), F.lit(timestamp_utc).alias("timestamp_utc"),
    )
    block = statistics_block(stats, grid[0])  # one row
    return reports.withColumn("_one", F.lit(1)).join(F.broadcast(block.withColumn("_one", F.lit(1))), "_one").drop("_one")


# Reasons that count as an expected failure.
EXPECTED_FAILURES = ("backend_unavailable", "backend_model_instantiation_failed")


def record_verdict(reports: DataFrame, nested: bool = False) -> DataFrame:
    """SUCCESS, CONTROLLED_ERROR, ERROR or FAIL per report line.

    ``nested`` also looks at the reason inside the forward section.
    """
    reason = F.col("reason")
    if nested:
        reason = F.coalesce(F.nullif("reason", F.lit("")), "forward_reason", F.lit(""))
    expected = reason.contains(EXPECTED_FAILURES[0]) | reason.contains(EXPECTED_FAILURES[1])
    return reports.withColumn(
        "verdict",
        F.when(~F.col("valid"), "FAIL").when(F.col("ok"), "SUCCESS")
        .when(expected, "CONTROLLED_ERROR").when(F.col("error_type") != "", "ERROR")
        .otherwise("FAIL"),
    )


def batch_verdict(verdicts: DataFrame) -> DataFrame:
    """Counts and the final word; a batch without records has failed."""
    each = [
        F.count_if(F.col("verdict") == v).alias(v.lower())
        for v in ("SUCCESS", "CONTROLLED_ERROR", "ERROR", "FAIL")
    ]
    passed = F.coalesce(F.bool_and(F.col("verdict").isin("SUCCESS", "CONTROLLED_ERROR")), F.lit(False))
    return verdicts.agg(F.count("*").alias("records"), *each, passed.alias("_passed")).withColumn(
        "final_verdict", F.when(F.col("_passed"), "PASSED_CANARY").otherwise("FAILED")
    ).drop("_passed")
