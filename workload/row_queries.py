"""Row-level operators: selection, parsing, keys, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import coords as C
from gridloom.functions import text as X
from gridloom.functions import weather as W
from gridloom.operators import channels as CH
from gridloom.operators import contract, extract, melt, profile
from gridloom.plans.classify import score_points
from gridloom.plans.predict import MockPredictor, response_body
from gridloom.schema import GRAVITY, SURFACE_GROUP
from gridloom.sources import lines as L
from workload import query

SURFACE = "(level IS NULL OR abs(level) <= 1e-6)"


@query("p1_snapshot_extract", """
SELECT latitude, longitude, CAST(value AS DOUBLE) AS value FROM @forecast
WHERE variable = 't' AND isobaricInhPa = 850.0 AND latitude IS NOT NULL AND longitude IS NOT NULL AND value IS NOT NULL""")
def _(v):
    return extract.snapshot(v.forecast, "t", 850.0).withColumn("value", F.col("value").cast("double"))


@query("p2_level_column", "SELECT isobaricInhPa, variable, count(*) AS n FROM @forecast GROUP BY ALL")
def _(v):
    lower = v.forecast.withColumnRenamed("isobaricInhPa", "isobaricinhpa")
    return extract.normalise_level(lower).groupBy("isobaricInhPa", "variable").agg(F.count("*").alias("n"))


@query("p3_lon_0_360", """
SELECT event_id, round(lon - 360 * floor(lon / 360), 6) AS lon360 FROM @probes""")
def _(v):
    return v.probes.select("event_id", F.round(C.lon_0_360(F.col("lon")), 6).alias("lon360"))


@query("p4_channel_select", """
SELECT 'u' AS channel, latitude, longitude, CAST(value AS DOUBLE) AS value FROM @forecast_dirty
WHERE lower(variable) = 'u' AND abs(isobaricInhPa - 500) <= 1e-6 + 1e-5 * 500
UNION ALL
SELECT 't2m', latitude, longitude, CAST(value AS DOUBLE) FROM @forecast_dirty
WHERE lower(variable) = 't2m' AND (isobaricInhPa IS NULL OR abs(isobaricInhPa) <= 1e-6)""")
def _(v):
    part = lambda name, level: extract.select_channel(v.forecast_dirty, name, level).select(
        F.lit(name).alias("channel"), "latitude", "longitude", F.col("value").cast("double").alias("value"))
    return part("u", 500.0).unionByName(part("t2m", None))


@query("p5_variable_lower", "SELECT lower(variable) AS variable, count(*) AS n FROM @forecast_dirty GROUP BY 1")
def _(v):
    return extract.lower_variables(v.forecast_dirty).groupBy("variable").agg(F.count("*").alias("n"))


@query("p6_numeric_coercion", """
SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id AS STRING) END AS DOUBLE) AS number
FROM @events""")
def _(v):
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return v.events.select("event_id", C.number(raw).alias("number"))


@query("p7_required_columns", """
SELECT 'latitude' AS column_name, count(latitude) AS value_count, true AS present FROM @forecast_dirty UNION ALL
SELECT 'level_name', 0, false UNION ALL
SELECT 'value', count(value), true FROM @forecast_dirty""")
def _(v):
    return contract.column_report(v.forecast_dirty, ["latitude", "level_name", "value"])


@query("p8_empty_guard", """
SELECT variable, count(*) AS n FROM @forecast WHERE variable = 't' GROUP BY 1""")
def _(v):
    rows = extract.require_rows(v.forecast.where("variable = 't'"), "variable t")
    return rows.groupBy("variable").agg(F.count("*").alias("n"))


@query("p9_run_hours", """
WITH h AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END || CAST(event_id % 27 AS STRING)
           || CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '' END AS hour FROM @events)
SELECT event_id,
       CASE WHEN lower(trim(hour)) LIKE '%z' THEN lower(trim(hour)) ELSE lower(trim(hour)) || 'z' END AS suffixed,
       CASE WHEN regexp_full_match(lower(trim(hour)), '(00|06|12|18)z?') THEN substr(lower(trim(hour)), 1, 2) || 'z' END AS synoptic,
       CASE WHEN event_id % 27 <= 23 THEN lpad(CAST(event_id % 27 AS STRING), 2, '0') END AS hour_of_day
FROM h""")
def _(v):
    hour = F.concat(
        F.when(F.col("event_id") % 3 == 0, " ").otherwise(""), (F.col("event_id") % 27).cast("string"),
        F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    return v.events.select(
        "event_id", C.run_suffixed(hour).alias("suffixed"), C.synoptic_hour(hour).alias("synoptic"),
        C.hour_of_day(hour).alias("hour_of_day"))


@query("p10_date_parts", """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '2026130' ELSE strftime(o_orderdate, '%Y%m%d') END AS date,
                  o_orderdate FROM @orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y') END AS year,
       CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%m') END AS month,
       CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%d') END AS day FROM d""")
def _(v):
    date = F.when(F.col("o_orderkey") % 50 == 0, "2026130").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return v.orders.select("o_orderkey", *[c.alias(n) for n, c in C.partition_date(date).items()])


@query("p11_readable_names", """
SELECT CASE variable WHEN 'tp' THEN 'total_precipitation' WHEN 'skt' THEN 'skin_temperature' ELSE variable END AS name,
       count(*) AS n
FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'skt' ELSE 'u10' END AS variable FROM @orders) GROUP BY 1""")
def _(v):
    code = F.element_at(F.array(F.lit("tp"), F.lit("skt"), F.lit("u10")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return v.orders.select(W.readable_name(code).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("p12_geopotential", """
SELECT latitude, longitude, CAST(CAST(gh * CAST(9.80665 AS FLOAT) AS FLOAT) AS DOUBLE) AS z
FROM @wide_fields WHERE isobaricInhPa IS NOT NULL""")
def _(v):
    return v.wide_fields.where("isobaricInhPa IS NOT NULL").select(
        "latitude", "longitude", W.geopotential(F.col("gh")).cast("double").alias("z"))


@query("p13_dataset_split", """
SELECT CASE WHEN isobaricInhPa IS NULL THEN 'surface' ELSE 'upper' END AS dataset, variable, count(*) AS n
FROM @forecast GROUP BY 1, 2""")
def _(v):
    surface, upper = melt.split_datasets(v.forecast)
    tag = lambda d, n: d.groupBy("variable").agg(F.count("*").alias("n")).withColumn("dataset", F.lit(n))
    return tag(surface, "surface").unionByName(tag(upper, "upper"))


MELT_SQL = """
SELECT isobaricInhPa, latitude, longitude, CASE WHEN isobaricInhPa IS NOT NULL THEN 'z' ELSE 'gh' END AS variable,
       CAST(CASE WHEN isobaricInhPa IS NOT NULL THEN CAST(gh * CAST(9.80665 AS FLOAT) AS FLOAT) ELSE gh END AS DOUBLE) AS value FROM @wide_fields
UNION ALL SELECT isobaricInhPa, latitude, longitude, 't', CAST(t AS DOUBLE) FROM @wide_fields
UNION ALL SELECT isobaricInhPa, latitude, longitude, 'total_precipitation', CAST(tp AS DOUBLE) FROM @wide_fields"""


@query("p14_melt_wide", MELT_SQL)
def _(v):
    return melt.melt_fields(v.wide_fields).withColumn("value", F.col("value").cast("double"))


@query("p15_soil_names", """
SELECT latitude, longitude, 'stl_soil' || CAST(1 + o % 4 AS STRING) AS variable, CAST(t AS DOUBLE) AS value
FROM (SELECT latitude, longitude, t, CAST(longitude AS BIGINT) AS o FROM @wide_fields WHERE isobaricInhPa IS NULL)""")
def _(v):
    soil = v.wide_fields.where("isobaricInhPa IS NULL").select(
        "isobaricInhPa", "latitude", "longitude", F.col("t").alias("stl"),
        (1 + F.col("longitude").cast("long") % 4).cast("double").alias("soilLayer"))
    return melt.melt_fields(soil, layer="soilLayer").select(
        "latitude", "longitude", "variable", F.col("value").cast("double").alias("value"))


@query("p16_run_stamp", "SELECT '20260409' AS date, '18z' AS run, count(*) AS n FROM @wide_fields")
def _(v):
    return melt.stamp_run(v.wide_fields, "20260409", "18z").groupBy("date", "run").agg(F.count("*").alias("n"))


@query("p17_step_facets", """
SELECT event_id, strftime(ts, '%Y%m%d') AS date, strftime(ts, '%H') || 'z' AS run, CAST(event_id % 48 AS INT) AS step_hours,
       'oper' AS stream, 'fc' AS type FROM @events WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL FROM @events WHERE event_id % 5 = 0""")
def _(v):
    name = F.when(F.col("event_id") % 5 == 0, "part-0.parquet").otherwise(F.concat(
        F.date_format("ts", "yyyyMMddHH"), F.lit("0000-"), (F.col("event_id") % 48).cast("string"), F.lit("h-oper-fc.parquet")))
    return v.events.select("event_id", *[c.alias(n) for n, c in C.step_facets(name).items()])


@query("p19_bi_view", """
SELECT CAST(CAST(latitude AS DECIMAL(9,4)) AS DOUBLE) AS lat, CAST(CAST(longitude AS DECIMAL(9,4)) AS DOUBLE) AS lon,
       round(CAST(CAST(value AS DECIMAL(10,4)) AS DOUBLE), 2) AS t2m
FROM @forecast WHERE variable = 't2m' AND year = '2026' AND month = '04' AND day = '09' AND hour = '18z'""")
def _(v):
    view = extract.bi_input(v.forecast, "t2m", year="2026", month="04", day="09", hour="18z")
    return view.select(
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        F.round(F.col("t2m").cast("double"), 2).alias("t2m"))


@query("p20_range_check", """
SELECT event_id, lat * 1.1 >= -90 AND lat * 1.1 <= 90 AND lon * 1.1 >= -180 AND lon * 1.1 <= 180 AS in_range FROM @probes""")
def _(v):
    return v.probes.select("event_id", C.in_range(F.col("lat") * 1.1, F.col("lon") * 1.1).alias("in_range"))


@query("p24_data_contract", """
SELECT 'value' AS column_name, 'null_value' AS rule, count(*) AS row_count FROM @forecast_dirty WHERE value IS NULL HAVING count(*) > 0
UNION ALL SELECT 'run', 'wrong_type', NULL UNION ALL SELECT 'units', 'missing_column', NULL""")
def _(v):
    fields = [
        {"name": "latitude", "type": "DECIMAL", "nullable": False}, {"name": "value", "type": "DECIMAL", "nullable": False},
        {"name": "run", "type": "INTEGER"}, {"name": "units", "type": "STRING"}, {"name": "step", "type": "INTEGER"}]
    return contract.table_violations(v.forecast_dirty, fields)


@query("f1_prediction_id", """
SELECT event_id, sha256(concat_ws(chr(124), 'knn_baseline', 'v1', '2026', '04', '09', '18', '18z',
       CAST(lat AS STRING), CAST(lon AS STRING), 't')) AS prediction_id
FROM (SELECT event_id, CAST((event_id * 7919) % 361 AS DOUBLE) / 4 - 45 AS lat,
             CAST((event_id * 104729) % 721 AS DOUBLE) / 4 - 90 AS lon FROM @events)""")
def _(v):
    lat = (F.col("event_id") * 7919 % 361).cast("double") / 4 - 45
    lon = (F.col("event_id") * 104729 % 721).cast("double") / 4 - 90
    fixed = [F.lit(x) for x in ("knn_baseline", "v1", "2026", "04", "09", "18", "18z")]
    key = X.prediction_key(*fixed, X.py_number(lat), X.py_number(lon), F.lit("t"))
    return v.events.select("event_id", key.alias("prediction_id"))


@query("f1_number_text", """
SELECT event_id, CAST(x AS STRING) AS shown FROM (
  SELECT event_id, (CAST(event_id % 1000 AS DOUBLE) - 500) / 1024 *
         CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1048576 WHEN 2 THEN 17179869184 * 4194304 ELSE 1.0 / 16384 END AS x FROM @events)""")
def _(v):
    e = F.col("event_id")
    factor = F.when(e % 4 == 0, 1.0).when(e % 4 == 1, 1048576.0).when(e % 4 == 2, 17179869184.0 * 4194304.0).otherwise(1.0 / 16384)
    x = ((e % 1000).cast("double") - 500) / 1024 * factor
    return v.events.select("event_id", X.py_number(x).alias("shown"))


RH = """100 * ((q / greatest(1 - q, 1e-12)) / greatest(0.622 * (6.112 * exp(17.67 * (t_k - 273.15) / (t_k - 29.65)))
  / greatest(pressure_hpa - 6.112 * exp(17.67 * (t_k - 273.15) / (t_k - 29.65)), 1e-6), 1e-12))"""


@query("f2_relative_humidity", f"""
SELECT id, round(CAST(CAST(least(greatest({RH}, 0), 100) AS FLOAT) AS DOUBLE), 3) AS rh FROM @humidity""")
def _(v):
    rh = W.relative_humidity(F.col("q"), F.col("t_k"), F.col("pressure_hpa"))
    return v.humidity.select("id", F.round(rh.cast("double"), 3).alias("rh"))


@query("f3_geopotential_constant", "SELECT count(*) AS n, round(sum(gh * CAST(9.80665 AS DOUBLE)), 2) AS total FROM @wide_fields")
def _(v):
    return v.wide_fields.agg(F.count("*").alias("n"), F.round(F.sum(F.col("gh").cast("double") * GRAVITY), 2).alias("total"))


@query("f4_abrupt", """
SELECT event_id, CASE WHEN abs(t2m - 285) / 8 >= 2 THEN 1 ELSE 0 END AS label, round(abs(t2m - 285) / 8, 6) AS score FROM @probes""")
def _(v):
    return score_points(v.probes).select("event_id", "label", F.round("score", 6).alias("score"))


@query("f5_mock", """
SELECT event_id, round(273.15 + ((abs(lat) + abs(lon)) % 25), 6) AS predicted_value, lat AS lat_grid, lon AS lon_grid FROM @probes""")
def _(v):
    rows = v.probes.select("event_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return MockPredictor().apply(rows).select(
        "event_id", F.round("predicted_value", 6).alias("predicted_value"), "lat_grid", "lon_grid")


@query("f6_observed_error", """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN t2m END AS observed_value,
       round(CASE WHEN event_id % 3 <> 0 THEN 280.5 - t2m END, 6) AS error FROM @probes""")
def _(v):
    observed = F.when(F.col("event_id") % 3 != 0, F.col("t2m"))
    error = W.observed_error(F.lit(280.5), observed)
    return v.probes.select("event_id", observed.alias("observed_value"), F.round(error, 6).alias("error"))


@query("f8_feature_snapshot", """
SELECT event_id, '{"latitude": ' || CAST(CAST(event_id % 181 AS DOUBLE) / 2 - 45 AS STRING) || ', "longitude": '
       || CAST(CAST(event_id % 721 AS DOUBLE) / 4 - 90 AS STRING) || ', "run": "18z"}' AS snapshot FROM @events""")
def _(v):
    e = F.col("event_id")
    lat, lon = (e % 181).cast("double") / 2 - 45, (e % 721).cast("double") / 4 - 90
    return v.events.select("event_id", X.feature_snapshot(lat, lon, F.lit("18z")).alias("snapshot"))


@query("f9_response", """
SELECT event_id, '{"t2m":' || CAST(CAST(event_id % 100 AS DOUBLE) + 200.5 AS STRING) || ',"lat_grid":' || CAST(CAST(event_id % 90 AS DOUBLE) AS STRING)
       || ',"lon_grid":' || CAST(CAST(event_id % 180 AS DOUBLE) AS STRING) || ',"units":"K","source":"ECMWF SCDA"}' AS body FROM @events""")
def _(v):
    e = F.col("event_id")
    return v.events.select("event_id", response_body(
        (e % 100).cast("double") + 200.5, (e % 90).cast("double"), (e % 180).cast("double")).alias("body"))


@query("f10_time_stamps", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM @events")
def _(v):
    return v.events.select("event_id", X.time_stamp(F.col("ts")).alias("stamp"))


CSV_ERROR = """CASE event_id % 11
  WHEN 0 THEN 'Row ' || CAST(event_id AS STRING) || ': expected exactly 3 columns (lat, lon, t2m), got 2'
  WHEN 1 THEN 'Row ' || CAST(event_id AS STRING) || ': lat out of range [-90, 90]: 120.0'
  WHEN 2 THEN 'Row ' || CAST(event_id AS STRING) || ': lon out of range [-180, 180]: 190.0'
  WHEN 3 THEN 'Row ' || CAST(event_id AS STRING) || ': invalid t2m value ''not-a-number''' END"""


@query("f11_row_errors", f"SELECT event_id AS row_number, {CSV_ERROR} AS error FROM @csv_lines WHERE event_id % 11 <= 3")
def _(v):
    rows = v.csv_lines.select(F.col("event_id").alias("row_number"), "line")
    _good, bad = L.quarantine(L.parse_points(rows))
    return bad.select("row_number", "error")


@query("f12_truthy", """
SELECT o_orderpriority AS word, lower(trim(substr(o_orderpriority, 1, 1))) IN ('1', 'true', 'yes', 'y') AS flag, count(*) AS n
FROM @orders GROUP BY 1, 2""")
def _(v):
    return v.orders.select(
        F.col("o_orderpriority").alias("word"), C.truthy(F.substring("o_orderpriority", 1, 1)).alias("flag")
    ).groupBy("word", "flag").agg(F.count("*").alias("n"))


@query("f13_uri_split", """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'bucket' || CAST(event_id % 5 AS STRING) END AS bucket,
       CASE WHEN event_id % 3 <> 0 THEN 'a/' || CAST(event_id AS STRING) || '.npy' END AS key FROM @events""")
def _(v):
    e = F.col("event_id")
    uri = F.when(e % 3 == 0, "file:///x").otherwise(F.concat(
        F.lit("s3://bucket"), (e % 5).cast("string"), F.lit("/a/"), e.cast("string"), F.lit(".npy")))
    return v.events.select("event_id", *[c.alias(n) for n, c in C.split_uri(uri).items()])


@query("f14_elementwise", """
SELECT event_id, round(abs(lat), 5) AS magnitude, round(sqrt(lat * lat + lon * lon), 6) AS radius, true AS is_finite,
       abs(lat - 45) <= 1e-6 + 1e-5 * 45 AS is_45 FROM @probes""")
def _(v):
    lat, lon = F.col("lat"), F.col("lon")
    return v.probes.select(
        "event_id", F.round(F.abs(lat), 5).alias("magnitude"), F.round(F.sqrt(lat * lat + lon * lon), 6).alias("radius"),
        C.finite(lat).alias("is_finite"), C.near(lat, 45.0).alias("is_45"))


@query("f15_text", """
SELECT event_id, lower(trim('  ' || event_type || 'Z ')) AS cleaned, lpad(CAST(event_id % 24 AS STRING), 2, '0') AS padded,
       event_type LIKE '%k' AS ends_k, 'year=2026/hour=' || lpad(CAST(event_id % 24 AS STRING), 2, '0') || 'z' AS prefix FROM @events""")
def _(v):
    hour = C.hour_of_day((F.col("event_id") % 24).cast("string"))
    return v.events.select(
        "event_id", F.lower(F.trim(F.concat(F.lit("  "), "event_type", F.lit("Z ")))).alias("cleaned"), hour.alias("padded"),
        F.col("event_type").endswith("k").alias("ends_k"), F.concat(F.lit("year=2026/hour="), C.run_suffixed(hour)).alias("prefix"))


@query("k4_partition_path", """
SELECT o_orderkey, 'tidy/year=' || strftime(o_orderdate, '%Y') || '/month=' || strftime(o_orderdate, '%m') || '/day='
       || strftime(o_orderdate, '%d') || '/hour=' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || 'z' AS path FROM @orders""")
def _(v):
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    return v.orders.select("o_orderkey", C.partition_path("/tidy/", F.date_format("o_orderdate", "yyyyMMdd"), hour).alias("path"))


MANIFEST_SQL = """
SELECT event_id, 'r' || CAST(event_id AS STRING) AS request_id,
       CASE event_id % 4 WHEN 1 THEN 'forward' WHEN 3 THEN 'bogus' ELSE 'metadata_only' END AS mode,
       's3://bucket/step' || CAST(event_id % 7 AS STRING) || '/t.npy' AS input_s3_uri, '' AS output_s3_uri,
       event_id % 4 <> 2 AS max_runtime_guard,
       CASE WHEN event_id % 4 = 3 THEN 'mode must be metadata_only or forward' END AS error FROM @manifest_lines"""


@query("s5_manifest_scan", MANIFEST_SQL)
def _(v):
    return L.parse_manifest(v.manifest_lines)


@query("s6_report_scan", """
SELECT event_id, json_valid(line) AS valid, CASE WHEN json_valid(line) THEN coalesce(json_extract_string(line, '$.ok') = 'true', false) ELSE false END AS ok,
       CASE WHEN json_valid(line) THEN coalesce(json_extract_string(line, '$.reason'), '') ELSE '' END AS reason,
       CASE WHEN json_valid(line) THEN coalesce(json_extract_string(line, '$.error_type'), '') ELSE '' END AS error_type
FROM @report_lines WHERE trim(line) <> ''""")
def _(v):
    return L.parse_reports(v.report_lines).select("event_id", "valid", "ok", "reason", "error_type")


@query("s9_pruned_scan", "SELECT variable, isobaricInhPa, count(*) AS n FROM @forecast GROUP BY 1, 2")
def _(v):
    return profile.variable_level_counts(v.forecast)


@query("s11_request_parse", """
SELECT event_id,
       CASE event_id % 6 WHEN 4 THEN CAST(event_id % 90 AS DOUBLE) + 0.5 WHEN 5 THEN CAST(event_id % 90 AS DOUBLE) END AS lat,
       CASE event_id % 6 WHEN 4 THEN CAST(event_id % 180 AS DOUBLE) WHEN 5 THEN -(CAST(event_id % 180 AS DOUBLE) + 0.25) END AS lon,
       CASE event_id % 6 WHEN 0 THEN 'missing_keys' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'not_numeric' WHEN 3 THEN 'malformed_json' END AS error
FROM @point_requests""")
def _(v):
    return v.point_requests.select("event_id", *[c.alias(n) for n, c in L.parse_point_request(F.col("body")).items()])


@query("u1_union_fields", f"SELECT variable, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 3) AS total FROM @forecast WHERE variable IN ({', '.join(repr(x) for x in SURFACE_GROUP)}) GROUP BY 1")
def _(v):
    base = v.forecast.drop("year", "month", "day", "hour")
    frames = [base.where(F.col("variable") == name) for name in SURFACE_GROUP]
    return melt.union_fields(v.spark, frames).groupBy("variable").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


@query("u2_column_difference", """
SELECT c.channel_index FROM @channels c WHERE c.channel_index NOT IN (SELECT o_orderkey % 20 FROM @orders WHERE o_orderkey % 20 <> 18)""")
def _(v):
    have = v.orders.select((F.col("o_orderkey") % 20).cast("int").alias("channel_index")).where("channel_index <> 18")
    return CH.absent_channels(v.channels, have)


@query("u3_empty_union", "SELECT count(*) AS n FROM @forecast WHERE variable = 'none'")
def _(v):
    none = v.forecast.where("variable = 'none'").drop("year", "month", "day", "hour")
    return melt.union_fields(v.spark, []).unionByName(none).agg(F.count("*").alias("n"))
