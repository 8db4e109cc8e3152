"""Text sources: numbered lines, strict CSV, JSONL manifests and reports, request objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.coords import in_range
from gridloom.functions.text import py_number
from gridloom.operators.extract import ContractError
from gridloom.schema import REQUEST_MODES
from gridloom.session import materialise


def read_numbered_lines(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines with their 1-based number over all files of ``path``: by folder, part number and name; ``keep`` may name ``_file`` and ``_start``, their file and split.

    The text is scanned once and written with the number that each task gave its lines, so the offsets of the file splits, one small row each,
    belong to the same cut of the files. A split without an offset stops the job.
    """
    lines = materialise(
        spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_seq"),
        ),
        "lines",
    )
    splits = lines.groupBy("_file", "_start").agg(
        F.count("*").alias("_size"), F.min("_seq").alias("_base")
    )
    part = F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    folder = F.regexp_extract("_file", r"^(.*)/[^/]*$", 1)
    before = Window.orderBy("_folder", "_part", "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        splits.withColumns({"_part": part, "_folder": folder}).select(
            "_file", "_start", "_base", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
        ),
        "splits",
    )
    number = F.col("_seq") - F.col("_base") + F.col("_before") + 1
    return lines.join(offsets, ["_file", "_start"], "left").select(
        F.coalesce(number, F.raise_error(F.lit("a file split has no offset")).cast("long")).alias("row_number"),
        F.col("value").alias("line"), *keep,
    )


FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,"]*)(?=,|$)'


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line, quotes removed; an empty line has none."""
    parts = F.regexp_extract_all(line, F.lit(FIELD), F.lit(1))
    bare = F.transform(
        parts,
        lambda p: F.when(
            p.startswith('"'), F.replace(F.regexp_replace(p, '^"|"$', ""), F.lit('""'), F.lit('"'))
        ).otherwise(p),
    )
    return F.when(F.length(line) == 0, F.array().cast("array<string>")).otherwise(bare)


def text_number(text: Column) -> Column:
    """A number as Python reads it: blanks around it are fine, a type suffix is not."""
    trimmed = F.trim(text)
    suffixed = trimmed.rlike(r"(?i)^[+-]?[0-9.]+(e[+-]?[0-9]+)?[df]$")
    return F.when(~suffixed, trimmed.try_cast("double"))


def parse_points(lines: DataFrame, nan_passes: bool = True) -> DataFrame:
    """``lat,lon,t2m`` lines as numbers plus ``error``, the first fault of the row or null.

    A NaN coordinate passes the range check by default, as a Python comparison lets it.
    """
    rows = lines.withColumn("_f", csv_fields(F.col("line")))
    names = ["lat", "lon", "t2m"]
    rows = rows.withColumns({n: text_number(F.get("_f", F.lit(i))) for i, n in enumerate(names)})
    zero = F.lit(0.0)
    prefix = F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(": "))
    fault = F.when(
        F.size("_f") != 3,
        F.concat(F.lit("expected exactly 3 columns (lat, lon, t2m), got "), F.size("_f").cast("string")),
    )
    for i, n in enumerate(names):
        fault = fault.when(
            F.col(n).isNull(), F.concat(F.lit(f"invalid {n} value '"), F.get("_f", F.lit(i)), F.lit("'"))
        )
    fault = fault.when(
        ~in_range(F.col("lat"), zero, nan_passes), F.concat(F.lit("lat out of range [-90, 90]: "), py_number(F.col("lat")))
    ).when(
        ~in_range(zero, F.col("lon"), nan_passes), F.concat(F.lit("lon out of range [-180, 180]: "), py_number(F.col("lon")))
    )
    return rows.withColumn("error", F.concat(prefix, fault)).select("row_number", *names, "error")


def strict_points(parsed: DataFrame) -> DataFrame:
    """All rows, or the first error of the batch as an exception.

    The verdict is one aggregated row and comes before any write, so nothing half-publishes.
    """
    verdict = parsed.agg(
        F.count("*").alias("rows"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("row_number"))).alias("first_error"),
    ).first()
    if verdict["rows"] == 0:
        raise ContractError("Input CSV has no rows")
    if verdict["first_error"] is not None:
        raise ContractError(verdict["first_error"])
    return parsed.drop("error")


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and faulty rows with their error."""
    return parsed.where(F.col("error").isNull()).drop("error"), parsed.where(F.col("error").isNotNull())


def _is_object(line: Column) -> Column:
    """Valid JSON whose top level is an object."""
    return F.try_variant_get(F.try_parse_json(line), "$", "map<string,variant>").isNotNull()


def parse_manifest(lines: DataFrame, column: str = "line") -> DataFrame:
    """Request lines with defaults applied and ``error`` for what a request may not be.

    Modes compare trimmed and in lower case. A missing mode is ``metadata_only``, a missing guard
    is on, URIs are trimmed text.
    """
    schema = (
        "request_id STRING, mode STRING, input_s3_uri STRING, output_s3_uri STRING, "
        "max_runtime_guard STRING"
    )
    rows = lines.withColumn("_r", F.from_json(column, schema))
    mode = F.lower(F.trim(F.coalesce("_r.mode", F.lit("metadata_only"))))
    guard = F.lower(F.coalesce("_r.max_runtime_guard", F.lit("true")))
    rest = [c for c in lines.columns if c != column]
    return rows.withColumn("_object", _is_object(F.col(column))).select(
        *rest,
        F.col("_r.request_id").alias("request_id"),
        mode.alias("mode"),
        F.trim(F.coalesce("_r.input_s3_uri", F.lit(""))).alias("input_s3_uri"),
        F.trim(F.coalesce("_r.output_s3_uri", F.lit(""))).alias("output_s3_uri"),
        (~guard.isin("false", "0", "0.0", "", "[]", "{}")).alias("max_runtime_guard"),
        F.when(~F.coalesce("_object", F.lit(False)), "JSON payload must be an object.")
        .when(~mode.isin(*REQUEST_MODES), "mode must be metadata_only or forward")
        .alias("error"),
    )


def parse_reports(lines: DataFrame, column: str = "line") -> DataFrame:
    """Batch output lines: blank lines go, broken JSON stays with ``valid`` false."""
    schema = (
        "ok BOOLEAN, reason STRING, error_type STRING, error_message STRING, "
        "forward STRUCT<reason: STRING>"
    )
    rows = lines.where(F.length(F.trim(column)) > 0)
    rest = [c for c in lines.columns if c != column]
    return rows.withColumn("_r", F.from_json(column, schema)).select(
        *rest,
        F.coalesce(_is_object(F.col(column)), F.lit(False)).alias("valid"),
        F.coalesce("_r.ok", F.lit(False)).alias("ok"),
        F.coalesce("_r.reason", F.lit("")).alias("reason"),
        F.coalesce("_r.error_type", F.lit("")).alias("error_type"),
        F.col("_r.error_message").alias("error_message"),
        F.col("_r.forward.reason").alias("forward_reason"),
    )


def parse_point_request(body: Column) -> dict[str, Column]:
    """``lat``, ``lon`` and an error code of a JSON request body."""
    parsed = F.from_json(body, "lat STRING, lon STRING")
    valid = F.try_parse_json(body).isNotNull()
    lat, lon = text_number(parsed["lat"]), text_number(parsed["lon"])
    keys = F.json_object_keys(body)
    has_keys = F.array_contains(keys, "lat") & F.array_contains(keys, "lon")
    error = (
        F.when(~F.coalesce(valid, F.lit(False)), "malformed_json")
        .when(~F.coalesce(_is_object(body), F.lit(False)), "not_an_object")
        .when(~F.coalesce(has_keys, F.lit(False)), "missing_keys")
        .when(lat.isNull() | lon.isNull(), "not_numeric")
    )
    return {"lat": F.when(error.isNull(), lat), "lon": F.when(error.isNull(), lon), "error": error}
