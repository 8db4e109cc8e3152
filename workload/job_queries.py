"""Sources, sinks, manifest jobs and streams, each read back and checked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import contract, documents, profile
from gridloom.operators.extract import snapshot
from gridloom.operators.validate import validation_report
from gridloom.plans import requests as R
from gridloom.plans.classify import classify_file, score_points
from gridloom.schema import TIDY, TIDY_BODY
from gridloom.session import scratch_path
from gridloom.sources import commits, files
from gridloom.sources import lines as L
from gridloom.sources import records
from gridloom.sources import tidy as S
from gridloom.sources import writers as K
from gridloom.streaming import ingest, waiting
from workload import query
from workload.row_queries import CSV_ERROR
from workload.step_queries import SPARSE, STAT_SQL, rounded, tensor_table

RUN_ROWS = "isobaricInhPa, latitude, longitude, variable, CAST(value AS DOUBLE) AS value, date, run"


def double_value(df):
    return df.withColumn("value", F.col("value").cast("double"))


@query("s1_partition_scan", f"SELECT {RUN_ROWS} FROM @forecast_runs WHERE date = '20260409' AND run = '06z'")
def _(v):
    path = K.write_tidy(v.forecast_runs, scratch_path(v.spark, "tidy"), "step")
    rows = S.scan_partition(v.spark, path, year="2026", month="04", day="09", hour="06z")
    return double_value(rows).select("isobaricInhPa", "latitude", "longitude", "variable", "value", "date", "run")


@query("s2_points_by_suffix", """
SELECT event_id, lat AS latitude, lon AS longitude, s.suffix FROM @probes, (VALUES ('csv'), ('parquet')) AS s(suffix)""")
def _(v):
    points = v.probes.select("event_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    base = scratch_path(v.spark, "points")
    points.write.option("header", True).csv(base + ".csv")
    points.write.parquet(base + ".parquet")
    read = lambda s: S.read_points(v.spark, f"{base}.{s}").select(
        F.col("event_id").cast("long").alias("event_id"), "latitude", "longitude", F.lit(s).alias("suffix"))
    return read("csv").unionByName(read("parquet"))


def written_lines(v, rows, order, column):
    """A text table whose lines follow ``order``."""
    path = scratch_path(v.spark, "lines")
    rows.repartitionByRange(order).sortWithinPartitions(order).select(F.col(column).alias("value")).write.text(path)
    return path


@query("s3_strict_csv", f"SELECT event_id + 1 AS row_number, replace({CSV_ERROR}, 'Row ' || CAST(event_id AS STRING) || ':', 'Row ' || CAST(event_id + 1 AS STRING) || ':') AS error FROM @csv_lines")
def _(v):
    path = written_lines(v, v.csv_lines, "event_id", "line")
    return L.parse_points(L.read_numbered_lines(v.spark, path)).select("row_number", "error")


@query("t5_row_order", "SELECT event_id + 1 AS row_number, line FROM @csv_lines")
def _(v):
    return L.read_numbered_lines(v.spark, written_lines(v, v.csv_lines, "event_id", "line"))


@query("s4_training_csv", "SELECT latitude, longitude, round(CAST(CAST(value AS STRING) AS DOUBLE), 3) AS value FROM @forecast WHERE variable = 't' AND isobaricInhPa = 850")
def _(v):
    path = scratch_path(v.spark, "train")
    K.write_training(snapshot(v.forecast, "t", 850.0).repartition(4), path, "grid_t850")
    return S.read_training_csv(v.spark, path).withColumn("value", F.round("value", 3))


@query("s7_catalog_plain_hours", """
SELECT latitude, longitude, CAST(value AS DOUBLE) AS value FROM @forecast WHERE variable = 't' AND isobaricInhPa = 850 AND hour = '18z'""")
def _(v):
    v.forecast.withColumn("hour", F.lit("18")).createOrReplaceTempView("gl_catalog_plain_hours")
    return double_value(S.catalog_snapshot(v.spark, "gl_catalog_plain_hours", "2026", "04", "09", "18z", level=850.0))


@query("s7_catalog_snapshot", """
SELECT latitude, longitude, CAST(value AS DOUBLE) AS value FROM @forecast WHERE variable = 't' AND isobaricInhPa = 850 AND hour = '18z'""")
def _(v):
    v.forecast.createOrReplaceTempView("gl_catalog_forecast")
    return double_value(S.catalog_snapshot(v.spark, "gl_catalog_forecast", "2026", "04", "09", "18", level=850.0))


@query("s8_step_files", f"SELECT date, run, step, variable, count(*) AS n FROM @forecast_runs GROUP BY ALL")
def _(v):
    target, log = scratch_path(v.spark, "stream"), scratch_path(v.spark, "log")
    ingest.ingest_tidy(v.spark, land(v, v.forecast_runs, "step"), target, log, "step INT", ("step",)).awaitTermination()
    rows = v.spark.read.schema(TIDY_BODY + ", year STRING, month STRING, day STRING, hour STRING, step INT").parquet(target)
    return rows.groupBy("date", "run", "step", "variable").agg(F.count("*").alias("n"))


@query("k1_snapshot_csv", "SELECT latitude, longitude, round(CAST(CAST(value AS STRING) AS DOUBLE), 3) AS value FROM @forecast WHERE variable = 't' AND isobaricInhPa = 850")
def _(v):
    path = K.write_snapshot(snapshot(v.forecast, "t", 850.0), scratch_path(v.spark, "snapshot"))
    rows = v.spark.read.option("header", True).schema("latitude DOUBLE, longitude DOUBLE, value DOUBLE").csv(path)
    return rows.withColumn("value", F.round("value", 3))


@query("k3_tidy_sink", f"SELECT {RUN_ROWS}, substr(date, 1, 4) AS year, substr(date, 5, 2) AS month, substr(date, 7, 2) AS day, run AS hour FROM @forecast_runs")
def _(v):
    path = K.write_tidy(v.forecast_runs.drop("step"), scratch_path(v.spark, "tidy"))
    return double_value(S.read_tidy(v.spark, path)).drop("step_key", "step_file")


@query("k5_report_sink", """
SELECT step, count(*) AS row_count FROM @forecast_steps GROUP BY 1""")
def _(v):
    path = K.write_reports(validation_report(v.forecast_steps, "step", spec=SPARSE), scratch_path(v.spark, "reports"), "step")
    back = v.spark.read.json(path)
    return back.select(F.col("step").cast("int").alias("step"), F.col("row_count").cast("long").alias("row_count"))


@query("k7_score_sink", """
SELECT event_id + 1 AS row_number, CASE WHEN abs(t2m - 285) / 8 >= 2 THEN '1' ELSE '0' END || ',' || printf('%.6f', abs(t2m - 285) / 8) AS line
FROM (SELECT event_id, CAST(265 + event_id % 40 AS DOUBLE) + 0.25 AS t2m FROM @events)""")
def _(v):
    points = v.events.select(F.col("event_id").alias("row_number"), ((265 + F.col("event_id") % 40).cast("double") + 0.25).alias("t2m"))
    path = K.write_scores(score_points(points), scratch_path(v.spark, "scores"))
    return L.read_numbered_lines(v.spark, path)


@query("k7_classifier_file", """
SELECT event_id + 1 AS row_number, CASE WHEN abs(t2m - 285) / 8 >= 2 THEN 1 ELSE 0 END AS label, round(abs(t2m - 285) / 8, 6) AS score FROM (
  SELECT event_id, CASE event_id % 11 WHEN 4 THEN CAST(event_id % 400 AS DOUBLE) ELSE CAST(265 + event_id % 40 AS DOUBLE) + 0.25 END AS t2m
  FROM @csv_lines WHERE event_id % 11 > 3)""")
def _(v):
    scored, _bad = classify_file(v.spark, written_lines(v, v.csv_lines, "event_id", "line"), strict=False)
    return scored.select("row_number", "label", F.round("score", 6).alias("score"))


@query("k9_tensor_sink", "SELECT tensor_uri, count(*) AS elements FROM @tensor_points GROUP BY 1")
def _(v):
    path = K.write_row_tensors(tensor_table(v), scratch_path(v.spark, "tensors"), "tensor_uri")
    return v.spark.read.parquet(path).groupBy("tensor_uri").agg(F.sum(F.size("values")).alias("elements"))


@query("k10_zone_map", "SELECT count(*) AS n_rows, min(variable) AS variable_min, max(variable) AS variable_max, min(latitude) AS lat_min FROM @forecast")
def _(v):
    path = K.write_tidy(v.forecast, scratch_path(v.spark, "tidy"))
    zones = K.write_zone_map(profile.zone_map(v.spark.read.parquet(path)), scratch_path(v.spark, "zones"))
    back = v.spark.read.option("header", True).csv(zones)
    return back.agg(
        F.sum(F.col("n_rows").cast("long")).alias("n_rows"), F.min("variable_min").alias("variable_min"),
        F.max("variable_max").alias("variable_max"), F.min(F.col("latitude_min").cast("double")).alias("lat_min"))


@query("s3_csv_records", """
SELECT 2 * event_id - (SELECT min(event_id) FROM @events) * 2 + 1 AS row_number, '"' || CAST(event_id AS STRING) || chr(10) || 'a ""b"", c",x"y,2' AS line FROM @events
UNION ALL SELECT 2 * event_id - (SELECT min(event_id) FROM @events) * 2 + 2, CAST(event_id AS STRING) || ',,"z"' FROM @events""")
def _(v):
    path = scratch_path(v.spark, "csv")
    text = F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('\na ""b"", c",x"y,2\n'), F.col("event_id").cast("string"), F.lit(',,"z"'))
    v.events.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select(text.alias("value")).write.text(path)
    return records.read_csv_records(v.spark, path).where("error is null").select("row_number", "line")


BOUNDS = ["variable", "isobaricInhPa", "latitude", "longitude"]


@query("a14_zone_map", f"SELECT count(*) AS n_rows, {', '.join(f'{f}({c}) AS {c}_{f}' for c in BOUNDS for f in ('min', 'max'))} FROM @forecast")
def _(v):
    path = K.write_tidy(v.forecast, scratch_path(v.spark, "tidy"))
    zones = files.footer_zones(v.spark, path)
    return zones.agg(F.sum("n_rows").alias("n_rows"), *[
        f(f"{c}_{n}").alias(f"{c}_{n}") for c in BOUNDS for n, f in (("min", F.min), ("max", F.max))])


@query("a14_scanned_zones", f"SELECT count(*) AS n_rows, {', '.join(f'{f}({c}) AS {c}_{f}' for c in BOUNDS for f in ('min', 'max'))} FROM @forecast")
def _(v):
    path = K.write_tidy(v.forecast, scratch_path(v.spark, "tidy"))
    zones = profile.zone_map(v.spark.read.parquet(path))
    return zones.agg(F.sum("n_rows").alias("n_rows"), *[
        f(f"{c}_{n}").alias(f"{c}_{n}") for c in BOUNDS for n, f in (("min", F.min), ("max", F.max))])


@query("a14_file_skipping", """
SELECT variable, isobaricInhPa, latitude, longitude, CAST(value AS DOUBLE) AS value FROM @forecast WHERE variable = 'z' AND isobaricInhPa = 500 AND latitude BETWEEN 50 AND 80.5""")
def _(v):
    path = K.write_tidy(v.forecast, scratch_path(v.spark, "tidy"))
    zones = files.footer_zones(v.spark, path)
    rows = files.scan_matching(v.spark, path, TIDY, zones, variable="z", isobaricInhPa=500.0, latitude=(50.0, 80.5))
    return double_value(rows).select("variable", "isobaricInhPa", "latitude", "longitude", "value")


@query("a22_asset_inventory", "SELECT count(DISTINCT tensor_uri) AS folders, true AS ok FROM @tensor_points")
def _(v):
    path = K.write_row_tensors(tensor_table(v), scratch_path(v.spark, "tensors"), "tensor_uri")
    assets = contract.asset_inventory(v.spark, path, "*.parquet")
    checks = assets.select((F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("size_bytes") > 0)).alias("passed"))
    folders = assets.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count_distinct("folder").alias("folders"))
    verdict = contract.inventory_verdict(assets, checks).select("ok", "files")
    return folders.join(verdict, F.col("files") >= F.col("folders")).select("folders", "ok")


@query("p24_contract_documents", """
SELECT document, place, key, rule FROM @contract_documents JOIN (VALUES (1, '', '', 'invalid_json'), (2, '', 'version', 'missing_key'), (3, 'inputContentType', 'inputContentType', 'unknown_value'),
  (4, 'input', 'input', 'wrong_kind'), (5, 'input[0]', 'type', 'missing_key'), (6, 'input[0]', 'type', 'unknown_value'), (7, 'input[0]', 'unit', 'extra_key'),
  (8, 'input[0]', 'name', 'too_long'), (9, 'input', 'name', 'duplicate_name'), (10, 'instanceCount', 'instanceCount', 'too_small'), (11, 'input[0]', '', 'not_an_object'),
  (12, 'defaultInstanceType', 'defaultInstanceType', 'not_listed'), (13, 'instanceTypes[0]', '', 'unknown_value')) AS r(k, place, key, rule) ON document % 14 = r.k""")
def _(v):
    return documents.contract_violations(v.contract_documents).drop("found")


REQUESTS = """rq AS (SELECT event_id, 's3://bucket/step' || CAST(event_id % 7 AS STRING) || '/t.npy' AS tensor_uri,
   CASE event_id % 4 WHEN 1 THEN 'forward' WHEN 3 THEN 'bogus' ELSE 'metadata_only' END AS mode, event_id % 4 = 3 AS bad FROM @manifest_lines)"""


@query("j9_manifest_tensors", f"""WITH {REQUESTS}, t AS (SELECT tensor_uri, count(*) AS elements FROM @tensor_points GROUP BY 1)
SELECT event_id, tensor_uri AS input_s3_uri, t.elements IS NOT NULL AS found, t.elements FROM rq LEFT JOIN t USING (tensor_uri)""")
def _(v):
    plan = R.request_plan(L.parse_manifest(v.manifest_lines), R.tensor_profiles(tensor_table(v)))
    return plan.select("event_id", "input_s3_uri", "found", "elements")


@query("m6_manifest_metadata", f"""WITH {REQUESTS}, t AS (SELECT tensor_uri, {STAT_SQL} FROM @tensor_points GROUP BY 1)
SELECT 'r' || CAST(event_id AS STRING) AS request_id, mode, tensor_uri AS input_s3_uri,
  t.elements IS NOT NULL AND mode = 'metadata_only' AS ok,
  CASE WHEN bad OR t.elements IS NULL THEN 'prediction_failed' WHEN mode = 'metadata_only' THEN 'metadata_collected' ELSE 'forward_failed' END AS result,
  t.nan_count, t.min, t.max, t.mean, t.std FROM rq LEFT JOIN t USING (tensor_uri)""")
def _(v):
    reports = R.request_reports(
        L.parse_manifest(v.manifest_lines), tensor_table(v), v.channel_stats, timestamp_utc="2026-04-09T18:00:00+00:00")
    return rounded(reports.select(
        "request_id", "mode", "input_s3_uri", "ok", "result", "input_tensor.nan_count", "input_tensor.min", "input_tensor.max",
        "input_tensor.mean", "input_tensor.std"), "min", "max", "mean", "std")


@query("m6_manifest_forward", f"""WITH {REQUESTS}, sh AS (SELECT tensor_uri, max(lat_index) + 1 AS lats FROM @tensor_points GROUP BY 1),
 o AS (SELECT tensor_uri, CAST(CAST(CAST(CAST((CAST(value AS DOUBLE) - mean) / std AS FLOAT) AS DOUBLE) + 0.5 AS FLOAT) AS DOUBLE) * std + mean AS v
       FROM @tensor_points JOIN @channel_stats USING (channel_index) WHERE NOT isnan(value)),
 st AS (SELECT tensor_uri, round(avg(CAST(CAST(v AS FLOAT) AS DOUBLE)), 4) AS mean FROM o GROUP BY 1)
SELECT 'r' || CAST(event_id AS STRING) AS request_id, coalesce(lats = 9, false) AS ok,
  CASE WHEN lats IS NULL THEN 'prediction_failed' WHEN lats = 9 THEN 'forward_succeeded' ELSE 'forward_failed' END AS result,
  CASE WHEN lats <> 9 THEN 'input_shape_mismatch' END AS reason, CASE WHEN lats = 9 THEN st.mean END AS mean
FROM rq LEFT JOIN sh USING (tensor_uri) LEFT JOIN st USING (tensor_uri) WHERE mode = 'forward'""")
def _(v):
    requests = L.parse_manifest(v.manifest_lines).where("mode = 'forward'")
    reports = R.request_reports(
        requests, tensor_table(v), v.channel_stats, timestamp_utc="2026-04-09T18:00:00+00:00", model=half_more, grid=(20, 9, 15))
    return reports.select("request_id", "ok", "result", "reason", F.round("output_stats.mean", 4).alias("mean"))


def half_more():
    return lambda tensor: tensor + np.float32(0.5)


def moody():
    """A model that refuses tensors with a missing first value, as a network with a faulty layer would."""
    def run(tensor):
        if np.isnan(tensor[:, :2]).any():
            raise ArithmeticError("missing values in the first rows")
        return half_more()(tensor)

    return run


@query("m6_forward_blocks", f"""WITH {REQUESTS}, sh AS (SELECT tensor_uri, max(lat_index) + 1 AS lats, count(*) AS elements,
   bool_or(isnan(value) AND lat_index < 2) AS bad FROM @tensor_points GROUP BY 1),
 s AS (SELECT avg(mean) AS m, avg(std) AS d FROM @channel_stats)
SELECT 'r' || CAST(event_id AS STRING) AS request_id, CASE WHEN lats IS NULL THEN 'prediction_failed' WHEN lats = 9 AND NOT sh.bad THEN 'forward_succeeded' ELSE 'forward_failed' END AS result,
  CASE WHEN lats <> 9 THEN 'input_shape_mismatch' WHEN sh.bad THEN 'forward_execution_failed' END AS reason,
  CASE WHEN lats <> 9 THEN '20,9,15' END AS expected, CASE WHEN lats <> 9 THEN '20,' || CAST(lats AS STRING) || ',15' END AS got,
  CASE WHEN lats = 9 AND NOT sh.bad THEN '1,20,9,15' END AS output_shape, CASE WHEN lats = 9 AND sh.bad THEN 'ArithmeticError: missing values in the first rows' END AS error,
  round(s.m, 6) AS mean_of_means, round(s.d, 6) AS mean_of_stds
FROM rq CROSS JOIN s LEFT JOIN sh USING (tensor_uri) WHERE mode = 'forward'""")
def _(v):
    requests = L.parse_manifest(v.manifest_lines).where("mode = 'forward'")
    reports = R.request_reports(
        requests, tensor_table(v), v.channel_stats, timestamp_utc="t", model=moody, model_name="moody", grid=(20, 9, 15))
    listed = lambda c: F.array_join(F.col(f"forward.{c}").cast("array<string>"), ",").alias(c)
    return reports.select(
        "request_id", "result", "reason", listed("expected"), listed("got"), listed("output_shape"),
        F.concat("forward.error_type", F.lit(": "), "forward.error_message").alias("error"),
        F.round("stats.global_means.mean", 6).alias("mean_of_means"), F.round("stats.global_stds.mean", 6).alias("mean_of_stds"))


@query("a19_record_verdicts", """
SELECT l.event_id, CASE e.event_type WHEN 'view' THEN 'SUCCESS' WHEN 'click' THEN 'CONTROLLED_ERROR' WHEN 'error' THEN 'ERROR' ELSE 'FAIL' END AS verdict
FROM @report_lines l JOIN @events e USING (event_id) WHERE trim(l.line) <> ''""")
def _(v):
    return R.record_verdict(L.parse_reports(v.report_lines)).select("event_id", "verdict")


@query("a19_verdict", """
SELECT count(*) AS records, count(*) FILTER (event_type = 'view') AS success, count(*) FILTER (event_type = 'click') AS controlled_error,
       count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS fail, 'FAILED' AS final_verdict
FROM @events WHERE event_type IN ('view', 'click', 'error', 'signup')""")
def _(v):
    return R.batch_verdict(R.record_verdict(L.parse_reports(v.report_lines), nested=True))


def land(v, rows, *parts):
    """Landing folder with one set of files per part value."""
    path = scratch_path(v.spark, "landing")
    rows.withColumns({f"_p{i}": F.col(c) for i, c in enumerate(parts)}).write.partitionBy(
        *[f"_p{i}" for i in range(len(parts))]).parquet(path)
    return path


@query("w1_ingest", "SELECT date, run, step, variable, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 3) AS total FROM @forecast_runs GROUP BY 1, 2, 3, 4")
def _(v):
    landing = land(v, v.forecast_runs, "run")
    target, log = scratch_path(v.spark, "stream"), scratch_path(v.spark, "log")
    for _run in range(2):  # the second run finds nothing new
        ingest.ingest_tidy(v.spark, landing, target, log, "step INT", ("step",), files_per_batch=4).awaitTermination()
    rows = v.spark.read.schema(TIDY_BODY + ", year STRING, month STRING, day STRING, hour STRING, step INT").parquet(target)
    return rows.groupBy("date", "run", "step", "variable").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


@query("w2_stream_tensors", """
SELECT DISTINCT step, CASE WHEN step = 9 THEN 'written' ELSE 'validation_failed' END AS tensor_write_reason,
  CASE WHEN step = 9 THEN (SELECT count(*) FROM @forecast) END AS elements FROM @forecast_steps""")
def _(v):
    base = streamed_steps(v)
    sizes = commits.read_published(v.spark, base, TENSOR_ROWS, step="INT").groupBy("step").agg(F.sum(F.size("values")).alias("elements"))
    manifest = commits.current(commits.read_manifest(v.spark, base, step="INT"), "step")
    return manifest.select("step", "tensor_write_reason").join(sizes, "step", "left")


TENSOR_ROWS = "channel_index INT, lat_index INT, values ARRAY<FLOAT>"


def streamed_steps(v):
    """The steps landed as files, ingested and published in two runs of two streams."""
    landing = land(v, v.forecast_steps, "step")
    target, log, log2, base = (scratch_path(v.spark, x) for x in ("stream", "log", "log", "published"))
    handler = ingest.tensor_publisher(target, base, "step", spec=SPARSE, extra="step INT")
    for _run in range(2):  # the second run finds nothing new
        ingest.ingest_tidy(v.spark, landing, target, log, "step INT", ("step",)).awaitTermination()
        ingest.validate_arrivals(v.spark, landing, log2, handler, "step INT").awaitTermination()
    return base


@query("k12_manifest_sink", """
SELECT step, CASE WHEN step = 9 THEN 'ok' ELSE 'incomplete' END AS status, step = 9 AS tensor_written, CASE WHEN step = 9 THEN 'written' ELSE 'validation_failed' END AS reason,
  CASE WHEN step = 9 THEN 'tensors/step=9' END AS tensor_file, true AS has_sources, count(*) AS n_rows FROM @forecast_steps GROUP BY step""")
def _(v):
    base = streamed_steps(v)
    records = commits.current(commits.read_manifest(v.spark, base, step="INT"), "step")
    reports = commits.read_reports(v.spark, base, "step INT, row_count LONG", step="INT")
    return records.join(reports.select("step", F.col("row_count").alias("n_rows")), "step").select(
        "step", "status", "tensor_written", F.col("tensor_write_reason").alias("reason"), F.regexp_replace("tensor_file", "attempt=[^/]*/", "").alias("tensor_file"),
        (F.size("source_files") > 0).alias("has_sources"), "n_rows")


# a step's files come some seconds apart; a fifth of the upper files come too late, a seventh never, some surface files twice
ARRIVALS = """ev AS (SELECT event_id AS step, (event_id * 37) % 5000 AS t0, event_id % 3 AS kind FROM @events),
 arr AS (SELECT step, 'surface' AS part, t0 + CASE WHEN kind = 0 THEN 40 ELSE 0 END AS t FROM ev
   UNION ALL SELECT step, 'surface', t0 + 100 FROM ev WHERE step % 4 = 1
   UNION ALL SELECT step, 'upper', t0 + CASE WHEN step % 5 = 2 THEN 900 WHEN kind = 0 THEN 0 ELSE 30 + step % 500 END FROM ev WHERE step % 7 <> 3)"""


@query("s8_late_steps", f"""WITH {ARRIVALS}, f AS (SELECT step, min(t) AS first, min(t) FILTER (part = 'surface') AS s, min(t) FILTER (part = 'upper') AS u, max(t) AS last FROM arr GROUP BY 1),
 d AS (SELECT *, coalesce(greatest(s, u) <= first + 600, false) AND s IS NOT NULL AND u IS NOT NULL AS whole, max(last) OVER () AS now FROM f),
 x AS (SELECT step, first, CASE WHEN whole THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN whole THEN greatest(s, u) ELSE first + 600 END AS decided,
   CASE WHEN NOT whole THEN CASE WHEN u IS NULL OR u > first + 600 THEN 'upper' ELSE 'surface' END ELSE '' END AS missing FROM d WHERE whole OR now > first + 600)
SELECT step, status, missing, CAST(first AS BIGINT) AS first_second, CAST(decided AS BIGINT) AS decided_second FROM x
UNION ALL SELECT a.step, 'late', x.missing, CAST(x.first AS BIGINT), CAST(a.t AS BIGINT) FROM arr a JOIN x USING (step) WHERE a.t > x.decided""")
def _(v):
    landed, target, log = (scratch_path(v.spark, x) for x in ("notices", "decisions", "log"))
    sql = ARRIVALS.replace("@events", "gl_events").replace("FILTER (part", "FILTER (WHERE part")
    v.events.createOrReplaceTempView("gl_events")
    notices = v.spark.sql(f"WITH {sql} SELECT step, part, timestamp_seconds(CAST(t AS BIGINT) + 1000000000) AS arrived FROM arr")
    # files in the order of time, some seconds of each in the next one
    notices.repartitionByRange(6, "arrived").write.parquet(landed)
    stream = v.spark.readStream.schema("step LONG, part STRING, arrived TIMESTAMP").parquet(landed)
    waiting.decide_arrivals(waiting.await_parts(stream, "step"), target, log).awaitTermination()
    second = lambda c: (F.unix_seconds(c) - 1_000_000_000).alias(f"{c.split('_')[0]}_second")
    return v.spark.read.parquet(target).select(
        "step", "status", "missing", second("first_arrival"), second("decided_at"))


@query("w3_stream_scores", "SELECT event_id, CASE WHEN abs(t2m - 285) / 8 >= 2 THEN 1 ELSE 0 END AS label, round(abs(t2m - 285) / 8, 6) AS score FROM @probes")
def _(v):
    landing = scratch_path(v.spark, "landing")
    v.probes.write.parquet(landing)
    target, log = scratch_path(v.spark, "stream"), scratch_path(v.spark, "log")
    ingest.score_arrivals(v.spark, landing, target, log).awaitTermination()
    return v.spark.read.parquet(target).select("event_id", "label", F.round("score", 6).alias("score"))
