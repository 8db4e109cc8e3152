"""Operators over whole steps: channel joins, validation, profiles and row-tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.coords import lon_0_360
from gridloom.operators import channels as CH
from gridloom.operators import contract, extract, melt, profile
from gridloom.operators import tensor as T
from gridloom.operators import validate
from gridloom.operators.validate import validation_report
from gridloom.plans.tensor_job import partition_manifest, run_tensor_job
from gridloom.schema import GridSpec
from gridloom.session import materialise
from workload import query

# the longitudes of the derived views: 12, 36 .. 348
SPARSE = GridSpec(lat_count=None, lon_count=15, lon_step=24.0, lon_start=12.0)

TAGGED = """tagged AS (SELECT f.*, c.channel_index FROM @forecast_dirty f JOIN @channels c ON lower(f.variable) = c.variable AND
  ((c.level IS NULL AND (f.isobaricInhPa IS NULL OR abs(f.isobaricInhPa) <= 1e-6))
   OR abs(f.isobaricInhPa - c.level) <= 1e-6 + 1e-5 * abs(c.level)))"""
TAGGED_STEPS = TAGGED.replace("@forecast_dirty", "@forecast_steps")


@query("j3_channel_tags", f"""WITH {TAGGED}
SELECT step, channel_index, count(*) AS n, count(value) AS with_value FROM tagged GROUP BY 1, 2""")
def _(v):
    return CH.tag_channels(v.forecast_dirty).groupBy("step", "channel_index").agg(
        F.count("*").alias("n"), F.count("value").alias("with_value"))


@query("j4_missing_channels", f"""WITH {TAGGED}
SELECT s.step, c.channel_index, c.variable, c.level FROM (SELECT DISTINCT step FROM @forecast_dirty) s, @channels c
WHERE NOT EXISTS (SELECT 1 FROM tagged t WHERE t.step = s.step AND t.channel_index = c.channel_index)""")
def _(v):
    return CH.missing_channels(v.forecast_dirty, "step")


@query("j5_grid_holes", f"""WITH {TAGGED}, obs AS (SELECT DISTINCT step, channel_index, latitude,
    CAST((longitude - 360 * floor(longitude / 360) - 12) / 24 AS INT) AS lon_index FROM tagged WHERE value IS NOT NULL AND NOT isnan(value)),
  lines AS (SELECT DISTINCT step, latitude FROM @forecast_dirty)
SELECT l.step, CAST(c.channel_index AS INT) AS channel_index, l.latitude, CAST(i.lon_index AS INT) AS lon_index
FROM lines l, @channels c, (SELECT unnest(range(15)) AS lon_index) i
WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.step = l.step AND o.channel_index = c.channel_index
                  AND o.latitude = l.latitude AND o.lon_index = i.lon_index)""")
def _(v):
    return T.grid_holes(v.forecast_dirty, "step", spec=SPARSE)


@query("j5_holes_of_fixed_axis", f"""WITH {TAGGED}, obs AS (SELECT DISTINCT step, channel_index, latitude,
    CAST((longitude - 360 * floor(longitude / 360) - 12) / 24 AS INT) AS lon_index FROM tagged WHERE value IS NOT NULL AND NOT isnan(value))
SELECT s.step, CAST(c.channel_index AS INT) AS channel_index, 90 - a.i * 0.25::DOUBLE AS latitude, CAST(i.lon_index AS INT) AS lon_index
FROM (SELECT DISTINCT step FROM @forecast_dirty) s, @channels c, (SELECT unnest(range(100)) AS i) a, (SELECT unnest(range(15)) AS lon_index) i
WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.step = s.step AND o.channel_index = c.channel_index
                  AND o.latitude = 90 - a.i * 0.25 AND o.lon_index = i.lon_index)""")
def _(v):
    return T.grid_holes(v.forecast_dirty, "step", spec=GridSpec(lat_count=100, lon_count=15, lon_step=24.0, lon_start=12.0))


@query("j5_off_grid_points", f"""WITH {TAGGED}
SELECT step, channel_index, latitude, longitude FROM tagged
WHERE ((longitude - 360 * floor(longitude / 360)) - 12) / 48 <> floor(((longitude - 360 * floor(longitude / 360)) - 12) / 48)""")
def _(v):
    coarse = GridSpec(lat_count=None, lon_count=8, lon_step=48.0, lon_start=12.0)
    return T.grid_extras(v.forecast_dirty, "step", spec=coarse)


@query("j6_level_subset", """
SELECT variable, isobaricInhPa, count(*) AS n FROM @forecast WHERE isobaricInhPa IN (1000, 500, 850) GROUP BY 1, 2""")
def _(v):
    rows, _gaps = CH.level_subset(v.forecast, [1000.0, 500.0, 850.0])
    return rows.groupBy("variable", "isobaricInhPa").agg(F.count("*").alias("n"))


@query("j6_missing_levels", """
SELECT v.variable, l.level AS missing_level FROM (SELECT DISTINCT variable FROM @forecast) v,
  (VALUES (1000.0::DOUBLE), (500.0::DOUBLE), (50.0::DOUBLE)) AS l(level)
WHERE NOT EXISTS (SELECT 1 FROM @forecast f WHERE f.variable = v.variable AND f.isobaricInhPa = l.level)""")
def _(v):
    return CH.level_subset(v.forecast, [1000.0, 500.0, 50.0])[1]


@query("j7_group_merge", """
SELECT variable, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 3) AS total FROM (
  SELECT variable, value FROM @forecast WHERE variable IN ('t', 'u')
  UNION ALL SELECT variable, value + 1 FROM @forecast WHERE variable NOT IN ('t', 'u')) GROUP BY 1""")
def _(v):
    base = v.forecast.drop("year", "month", "day", "hour")
    later = base.withColumn("value", (F.col("value") + F.lit(1).cast("float")).cast("float"))
    merged = melt.merge_groups([base.where("variable IN ('t', 'u')"), later])
    return merged.groupBy("variable").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


@query("j7_point_merge", """
SELECT o.variable, o.isobaricInhPa, o.latitude, o.longitude,
       CAST(CASE WHEN o.latitude > 0 THEN o.value ELSE o.value + 1 END AS DOUBLE) AS value FROM @forecast o""")
def _(v):
    base = v.forecast.drop("year", "month", "day", "hour")
    later = base.withColumn("value", (F.col("value") + F.lit(1).cast("float")).cast("float"))
    merged = melt.merge_groups([base.where("latitude > 0"), later], per_point=True)
    return merged.select("variable", *melt.COORDS, F.col("value").cast("double").alias("value"))


@query("j7_point_fill", """
SELECT o.variable, o.isobaricInhPa, o.latitude, o.longitude, CAST(CASE WHEN o.latitude > 0 THEN o.value ELSE o.value + 1 END AS DOUBLE) AS value,
       CASE WHEN o.latitude > 0 THEN NULL ELSE 'later' END AS origin, o.run FROM @forecast o""")
def _(v):
    base = v.forecast.drop("year", "month", "day", "hour")
    later = base.withColumn("value", (F.col("value") + F.lit(1).cast("float")).cast("float")).withColumn("origin", F.lit("later"))
    holed = base.withColumn("value", F.when(F.col("latitude") > 0, F.col("value")))
    merged = melt.merge_groups([holed, later], per_point=True)
    return merged.select("variable", *melt.COORDS, F.col("value").cast("double").alias("value"), "origin", "run")


@query("j8_alignment", """
SELECT latitude, longitude, max(CASE WHEN variable = 't' THEN CAST(value AS DOUBLE) END) AS t, max(CASE WHEN variable = 'u' THEN CAST(value AS DOUBLE) END) AS u,
       max(CASE WHEN variable = 't' THEN value END) IS NOT NULL AND max(CASE WHEN variable = 'u' THEN value END) IS NOT NULL AS aligned
FROM @forecast WHERE isobaricInhPa = 850 AND variable IN ('t', 'u') GROUP BY 1, 2""")
def _(v):
    rows = v.forecast.where("isobaricInhPa = 850").withColumn("value", F.col("value").cast("double"))
    return melt.align_pairs(rows, "t", "u", "latitude", "longitude")


@query("j12_spelling_variants", """
SELECT lower(variable) AS variable_lower, string_agg(DISTINCT variable, ',' ORDER BY variable) AS variants FROM @forecast_dirty GROUP BY 1""")
def _(v):
    return CH.spelling_variants(v.forecast_dirty).withColumn("variants", F.array_join("variants", ","))


@query("a1_variable_counts", "SELECT variable, count(*) AS row_count FROM @forecast_dirty GROUP BY 1")
def _(v):
    return profile.variable_counts(v.forecast_dirty)


@query("a2_level_counts", "SELECT variable, count(DISTINCT isobaricInhPa) AS level_count FROM @forecast_dirty GROUP BY 1")
def _(v):
    return profile.level_counts(v.forecast_dirty)


@query("a2_level_counts_sketch", "SELECT variable, true AS within_bound FROM @forecast_dirty GROUP BY 1")
def _(v):
    exact = profile.level_counts(v.forecast_dirty).withColumnRenamed("level_count", "exact")
    sketch = profile.level_counts_approx(v.forecast_dirty).join(exact, "variable")
    return sketch.select("variable", (F.abs(F.col("level_count") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_bound"))


@query("a3_level_lists", """
WITH lv AS (SELECT DISTINCT o_orderpriority AS variable, CAST(o_orderkey % 25 AS DOUBLE) AS level FROM @orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY level) AS rn FROM lv)
SELECT variable, count(*) AS level_count, string_agg(CAST(CAST(level AS INT) AS STRING), ',' ORDER BY level) FILTER (rn <= 20) AS levels,
       count(*) > 20 AS truncated FROM r GROUP BY 1""")
def _(v):
    rows = v.orders.select(F.col("o_orderpriority").alias("variable"), (F.col("o_orderkey") % 25).cast("double").alias("isobaricInhPa"))
    lists = profile.level_lists(rows)
    return lists.withColumn("levels", F.array_join(F.transform("levels", lambda x: x.cast("int").cast("string")), ","))


@query("a4_availability", """
SELECT lower(variable) AS variable, isobaricInhPa, count(*) AS row_count FROM @forecast_dirty GROUP BY 1, 2""")
def _(v):
    return CH.available_levels(v.forecast_dirty)


@query("a5_duplicate_points", f"""WITH {TAGGED},
 p AS (SELECT step, channel_index, latitude, longitude, count(*) AS n FROM tagged GROUP BY ALL)
SELECT step, channel_index, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_points FROM p GROUP BY 1, 2 HAVING sum(n) - count(*) > 0""")
def _(v):
    return CH.duplicate_points(v.forecast_dirty, "step")


@query("a6_grid_cardinality", """
SELECT step, count(DISTINCT latitude) AS observed_lat_count, count(DISTINCT longitude) AS observed_lon_count,
       count(DISTINCT longitude - 360 * floor(longitude / 360)) AS wrapped_lon_count FROM @forecast_steps GROUP BY 1""")
def _(v):
    return validation_report(v.forecast_steps, "step").select(
        "step", "observed_lat_count", "observed_lon_count", "wrapped_lon_count")


LAT_SQL = """
WITH l AS (SELECT step, count(DISTINCT latitude) AS n, min(latitude) AS lo, max(latitude) AS hi,
                  max(CASE WHEN latitude < 90 THEN latitude END) AS hi2 FROM @forecast_steps GROUP BY 1)
SELECT step, n AS original_lat_count, CASE WHEN n = 50 AND hi = 90 THEN n - 1 ELSE n END AS final_lat_count,
       lo AS original_lat_min, hi AS original_lat_max, lo AS final_lat_min, CASE WHEN n = 50 THEN hi2 ELSE hi END AS final_lat_max,
       'drop_north_pole' AS latitude_policy,
       CASE n WHEN 49 THEN 'none' WHEN 50 THEN 'drop_north_pole' ELSE 'unsupported_latitude_count' END AS latitude_policy_applied,
       CASE WHEN n = 50 THEN 90.0 END AS dropped_latitude FROM l"""


@query("a7_latitude_detail", LAT_SQL)
def _(v):
    spec = GridSpec(lat_count=49, lon_count=15, lon_step=24.0, lon_start=12.0)
    return validation_report(v.forecast_steps, "step", policy="drop_north_pole", spec=spec).select("step", "latitude.*")


@query("p18_latitude_policy", """
WITH l AS (SELECT step, count(DISTINCT latitude) AS n FROM @forecast_steps GROUP BY 1), w AS (SELECT n - 1 AS want FROM l WHERE step = 9)
SELECT f.step, count(*) AS rows_kept, min(f.latitude) AS lat_min, max(f.latitude) AS lat_max FROM @forecast_steps f JOIN l USING (step), w
WHERE n IN (want, want + 1) AND (n = want OR f.latitude <> 90) GROUP BY 1""")
def _(v):
    from gridloom.operators.validate import keep_policy_rows
    # a grid with one latitude less than step 9 has, whatever the scale
    seen = v.forecast.agg(F.count_distinct("latitude")).first()[0]
    spec = GridSpec(lat_count=seen - 1, lon_count=15, lon_step=24.0, lon_start=12.0)
    report = validation_report(v.forecast_steps, "step", policy="drop_north_pole", spec=spec)
    ready = report.where("latitude.final_lat_count = expected_lat_count").select("step", F.col("latitude").alias("detail"))
    kept = v.forecast_steps.join(materialise(ready, "policy"), "step").where(keep_policy_rows(F.col("latitude"), F.col("detail")))
    return kept.groupBy("step").agg(
        F.count("*").alias("rows_kept"), F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"))


@query("a8_available_levels", """
SELECT step, lower(variable) AS variable, isobaricInhPa, dense_rank() OVER (PARTITION BY step ORDER BY lower(variable)) AS variable_place FROM
  (SELECT DISTINCT step, lower(variable) AS variable, isobaricInhPa FROM @forecast_steps) AS pairs""")
def _(v):
    reports = run_tensor_job(v.forecast_steps, "step", spec=SPARSE, allow_incomplete=True).reports
    levels = reports.select("step", "available_variables", F.explode("available_variable_levels").alias("a"))
    return levels.select("step", "a.variable", "a.isobaricInhPa", F.array_position("available_variables", F.col("a.variable")).cast("int").alias("variable_place"))


VERDICT_SQL = f"""WITH {TAGGED_STEPS},
 pts AS (SELECT step, channel_index, latitude, longitude, count(*) AS n FROM tagged GROUP BY ALL),
 ch AS (SELECT step, channel_index, sum(n) - count(*) AS dup FROM pts GROUP BY 1, 2),
 st AS (SELECT step, count(*) AS row_count FROM @forecast_steps GROUP BY 1),
 miss AS (SELECT st.step, c.channel_index FROM st, @channels c WHERE NOT EXISTS
          (SELECT 1 FROM ch WHERE ch.step = st.step AND ch.channel_index = c.channel_index))
SELECT st.step, st.row_count,
       coalesce((SELECT string_agg(CAST(channel_index AS STRING), ',' ORDER BY channel_index) FROM miss m WHERE m.step = st.step), '') AS missing,
       coalesce((SELECT string_agg(CAST(channel_index AS STRING) || ':' || CAST(CAST(dup AS BIGINT) AS STRING), ',' ORDER BY channel_index)
                 FROM ch WHERE ch.step = st.step AND dup > 0), '') AS duplicates,
       NOT EXISTS (SELECT 1 FROM miss m WHERE m.step = st.step) AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.step = st.step AND dup > 0) AS ok
FROM st"""


@query("a8_validation_verdict", VERDICT_SQL)
def _(v):
    report = validation_report(v.forecast_steps, "step", spec=SPARSE)
    missing = F.array_join(F.transform("missing_channels", lambda c: c["channel_index"].cast("string")), ",")
    twice = F.array_join(F.transform("duplicate_points_by_channel", lambda c: F.concat(
        c["channel_index"].cast("string"), F.lit(":"), c["duplicate_points"].cast("string"))), ",")
    return report.select("step", "row_count", missing.alias("missing"), twice.alias("duplicates"), "ok")


STAT_SQL = """count(*) AS elements, bool_and(NOT isnan(value) AND NOT isinf(value)) AS finite,
  count(*) FILTER (isnan(value)) AS nan_count, round(min(CASE WHEN NOT isnan(value) THEN CAST(value AS DOUBLE) END), 6) AS min,
  round(max(CASE WHEN NOT isnan(value) THEN CAST(value AS DOUBLE) END), 6) AS max,
  round(avg(CASE WHEN NOT isnan(value) THEN CAST(value AS DOUBLE) END), 6) AS mean,
  round(stddev_pop(CASE WHEN NOT isnan(value) THEN CAST(value AS DOUBLE) END), 6) AS std"""


def tensor_table(v):
    """Row-tensors of the six derived tensors, written once."""
    rows = T.tensor_rows(v.tensor_points, "tensor_uri", spec=SPARSE)
    return materialise(rows.drop("complete"), "tensors")


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("a9_tensor_stats", f"SELECT tensor_uri, {STAT_SQL} FROM @tensor_points GROUP BY 1")
def _(v):
    return rounded(T.tensor_statistics(tensor_table(v), "tensor_uri"), "min", "max", "mean", "std")


@query("a10_humidity_summary", f"""
WITH r AS (SELECT pressure_hpa, {{RH}} AS raw FROM @humidity)
SELECT pressure_hpa, count(*) FILTER (raw <> least(greatest(raw, 0), 100)) AS clipped_value_count, CAST(0 AS BIGINT) AS invalid_count,
       round(min(least(greatest(raw, 0), 100)), 4) AS rh_percent_min, round(max(least(greatest(raw, 0), 100)), 4) AS rh_percent_max,
       round(avg(least(greatest(raw, 0), 100)), 4) AS rh_percent_mean FROM r GROUP BY 1""".replace("{RH}", __import__("workload.row_queries", fromlist=["RH"]).RH))
def _(v):
    names = ["rh_percent_min", "rh_percent_max", "rh_percent_mean"]
    return profile.humidity_summary(v.humidity, "pressure_hpa").withColumns({n: F.round(n, 4) for n in names})


@query("a11_describe", """
SELECT count(value) AS count, round(avg(CAST(value AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(value AS DOUBLE)), 6) AS std,
       round(min(CAST(value AS DOUBLE)), 6) AS min, round(quantile_cont(CAST(value AS DOUBLE), 0.25), 6) AS p25,
       round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(value AS DOUBLE), 0.75), 6) AS p75,
       round(max(CAST(value AS DOUBLE)), 6) AS max FROM @forecast_dirty""")
def _(v):
    return rounded(profile.describe_exact(v.forecast_dirty), "mean", "std", "min", "p25", "p50", "p75", "max")


@query("a12_null_counts", """
SELECT 'value' AS column_name, count(*) FILTER (value IS NULL) AS null_count FROM @forecast_dirty UNION ALL
SELECT 'isobaricInhPa', count(*) FILTER (isobaricInhPa IS NULL) FROM @forecast_dirty UNION ALL
SELECT 'variable', count(*) FILTER (variable IS NULL) FROM @forecast_dirty""")
def _(v):
    return profile.null_counts(v.forecast_dirty, ["value", "isobaricInhPa", "variable"])


@query("a15_filter_counts", """
SELECT count(*) AS rows_before, count(*) FILTER (variable = 't' AND isobaricInhPa = 850) AS rows_after FROM @forecast_dirty""")
def _(v):
    return extract.counted(v.forecast_dirty, (F.col("variable") == "t") & (F.col("isobaricInhPa") == 850))


A16_SQL = """
WITH ax AS (SELECT latitude, row_number() OVER (ORDER BY latitude DESC) - 1 AS lat_index FROM (SELECT DISTINCT latitude FROM @forecast))
SELECT CAST(c.channel_index AS INT) AS channel_index, CAST(ax.lat_index AS INT) AS lat_index,
       CAST((f.longitude - 360 * floor(f.longitude / 360) - 12) / 24 AS INT) AS lon_index, CAST(f.value AS DOUBLE) AS value
FROM @forecast f JOIN @channels c ON f.variable = c.variable AND f.isobaricInhPa IS NOT DISTINCT FROM c.level JOIN ax USING (latitude)"""


def unroll(rows):
    return rows.select("channel_index", "lat_index", F.posexplode("values").alias("lon_index", "value")).withColumn(
        "value", F.col("value").cast("double"))


@query("a16_field_to_grid", A16_SQL)
def _(v):
    steps = v.forecast_steps.where("step = 9")
    report = materialise(validation_report(steps, "step", spec=SPARSE), "report")
    rows = T.tensor_rows(T.field_cells(steps, report, "step", spec=SPARSE), "step", spec=SPARSE)
    return unroll(rows.where("complete"))


@query("a17_tensor_rows", A16_SQL)
def _(v):
    job = run_tensor_job(v.forecast_steps, "step", spec=SPARSE, allow_incomplete=True)
    return unroll(job.tensors)


@query("a17_tensor_regular_axis", """
SELECT CAST(ch AS INT) AS channel_index, CAST(k AS INT) AS lat_index,
       CAST((longitude - 360 * floor(longitude / 360) - 12) / 24 AS INT) AS lon_index, CAST(value AS DOUBLE) AS value FROM @forecast_regular""")
def _(v):
    rows = v.forecast_regular.drop("ch", "k")
    lats = rows.select("latitude").distinct().count()
    spec = GridSpec(lat_count=lats, lon_count=15, lon_step=24.0, lon_start=12.0)
    return unroll(run_tensor_job(rows, "step", spec=spec).tensors)


@query("a18_grouped_tensors", """
WITH lay AS (SELECT * FROM (VALUES ('surface',0,0,'msl',CAST(NULL AS DOUBLE)),('surface',1,0,'u10',NULL),('surface',2,0,'v10',NULL),('surface',3,0,'t2m',NULL),
   ('upper',0,0,'z',1000),('upper',0,2,'z',850),('upper',0,5,'z',500),('upper',0,12,'z',50),('upper',2,2,'t',850),('upper',2,5,'t',500),
   ('upper',3,0,'u',1000),('upper',3,2,'u',850),('upper',3,5,'u',500),('upper',4,0,'v',1000),('upper',4,2,'v',850),('upper',4,5,'v',500)) AS l(g, var_index, level_index, variable, level))
SELECT g AS "group", CAST(var_index AS INT) AS var_index, CAST(level_index AS INT) AS level_index, latitude, count(*) AS lons, round(sum(CAST(value AS DOUBLE)), 3) AS total
FROM @forecast f JOIN lay ON f.variable = lay.variable AND f.isobaricInhPa IS NOT DISTINCT FROM lay.level GROUP BY 1, 2, 3, 4""")
def _(v):
    rows = T.grouped_tensor_rows(v.forecast, spec=SPARSE)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("group", "var_index", "level_index", "latitude", F.size("values").cast("long").alias("lons"), F.round(total, 3).alias("total"))


MANIFEST = """
SELECT '20260409' AS date, '18z' AS run, count(*) AS step_count, count(*) FILTER (step = 9) AS tensors_written,
       CASE WHEN bool_and(step = 9) THEN 'ok' ELSE 'incomplete' END AS status,
       string_agg(CAST(step AS STRING) || ':' || CASE WHEN step = 9 THEN 'written' ELSE 'validation_failed' END, ',' ORDER BY step) AS files
FROM (SELECT DISTINCT step FROM @forecast_steps)"""


@query("a20_job_manifest", MANIFEST)
def _(v):
    job = run_tensor_job(v.forecast_steps, "date", "run", "step", spec=SPARSE, allow_incomplete=True)
    files = F.array_join(F.transform("processed_files", lambda s: F.concat(
        s["step"].cast("string"), F.lit(":"), s["tensor_write_reason"])), ",")
    return partition_manifest(job.steps, "date", "run").select(
        "date", "run", "step_count", "tensors_written", "status", files.alias("files"))


@query("a21_stats_policy", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 15 + event_id % 10 WHEN 1 THEN 15 + event_id % 10 END AS channels,
       coalesce(event_id % 3 < 2 AND 15 + event_id % 10 >= 20, false) AS supported FROM @events""")
def _(v):
    e = F.col("event_id")
    c = (15 + e % 10).cast("long")
    one = F.lit(1).cast("long")
    shape = F.when(e % 3 == 0, F.array(c)).when(e % 3 == 1, F.array(one, c, one, one)).otherwise(F.array(c, one))
    channels = T.stats_channels(shape)
    return v.events.select("event_id", channels.alias("channels"), F.coalesce(channels >= 20, F.lit(False)).alias("supported"))


@query("a24_distinct_points", "SELECT count(*) AS n FROM (SELECT DISTINCT step, variable, isobaricInhPa, latitude, longitude FROM @forecast_dirty)")
def _(v):
    return validate.distinct_points(v.forecast_dirty, "step").agg(F.count("*").alias("n"))


@query("j10_stat_join", """
SELECT s.channel_index, CAST(s.mean AS DOUBLE) AS mean, CAST(s.std AS DOUBLE) AS std, count(*) AS n FROM @tensor_points t JOIN @channel_stats s USING (channel_index)
WHERE s.channel_index < 20 GROUP BY 1, 2, 3""")
def _(v):
    joined = T.with_channel_stats(v.tensor_points, v.channel_stats, column="value")
    return joined.groupBy("channel_index", F.col("_mean").alias("mean"), F.col("_std").alias("std")).agg(F.count("*").alias("n"))


@query("f7_normalise", """
SELECT tensor_uri, t.channel_index, lat_index, lon_index,
       round(CAST(CAST((CAST(value AS DOUBLE) - mean) / std AS FLOAT) AS DOUBLE), 5) AS scaled,
       round(CAST(CAST(CAST(CAST((CAST(value AS DOUBLE) - mean) / std AS FLOAT) AS DOUBLE) * std + mean AS FLOAT) AS DOUBLE), 3) AS restored
FROM @tensor_points t JOIN @channel_stats s USING (channel_index) WHERE NOT isnan(value)""")
def _(v):
    rows = T.normalise_rows(tensor_table(v), v.channel_stats)
    both = T.denormalise_rows(rows.withColumn("scaled", F.col("values")), v.channel_stats)
    flat = both.select("tensor_uri", "channel_index", "lat_index", F.posexplode(F.arrays_zip("scaled", "values")).alias("lon_index", "pair"))
    return flat.where("NOT isnan(pair.scaled)").select(
        "tensor_uri", "channel_index", "lat_index", "lon_index",
        F.round(F.col("pair.scaled").cast("double"), 5).alias("scaled"), F.round(F.col("pair.values").cast("double"), 3).alias("restored"))


@query("s10_tensor_source", "SELECT tensor_uri, channel_index, lat_index, count(*) AS lons FROM @tensor_points GROUP BY 1, 2, 3")
def _(v):
    return tensor_table(v).select("tensor_uri", "channel_index", "lat_index", F.size("values").cast("long").alias("lons"))


@query("p22_shape_guard", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unexpected_input_rank' WHEN 1 THEN 'input_shape_mismatch' END AS reason FROM @events""")
def _(v):
    kinds = F.array(*[F.array(*[F.lit(x) for x in s]) for s in ([720, 1440], [1, 20, 721, 1440], [20, 720, 1440], [1, 20, 720, 1440])])
    shape = F.get(kinds, (F.col("event_id") % 4).cast("int"))
    return v.events.select("event_id", T.shape_verdict(shape).alias("reason"))


@query("p21_runtime_guard", """
SELECT event_id, event_id % 2 = 0 AND event_id * 10000 > 50000000 AS blocked FROM @events""")
def _(v):
    from gridloom.plans.requests import guard_blocks
    return v.events.select("event_id", guard_blocks(F.col("event_id") * 10000, F.col("event_id") % 2 == 0).alias("blocked"))


@query("p25_model_contract", """
SELECT count(*) AS grid_rows, count(*) FILTER (lat IS NULL) AS bad_coordinates, count(*) FILTER (value IS NULL) AS missing_values, true AS ok FROM @model_grid""")
def _(v):
    return contract.model_table_faults(v.model_grid)


@query("t1_north_first", "SELECT latitude, longitude, CAST(value AS DOUBLE) AS value FROM @forecast WHERE variable = 'sp'")
def _(v):
    return melt.north_first(v.forecast.where("variable = 'sp'")).select("latitude", "longitude", F.col("value").cast("double").alias("value"))


@query("t2_nulls_first", "SELECT DISTINCT lower(variable) AS variable, isobaricInhPa FROM @forecast_dirty")
def _(v):
    return CH.available_levels(v.forecast_dirty).drop("row_count")


@query("t3_head", """
SELECT latitude, longitude, variable, isobaricInhPa, CAST(value AS DOUBLE) AS value FROM @forecast
ORDER BY variable, isobaricInhPa NULLS FIRST, latitude DESC, longitude LIMIT 80""")
def _(v):
    return extract.head_points(v.forecast, 80).select(
        "latitude", "longitude", "variable", "isobaricInhPa", F.col("value").cast("double").alias("value"))


@query("t6_latest_run", """
SELECT date, run, variable, count(*) AS n FROM @forecast_runs WHERE date || run = (SELECT max(date || run) FROM @forecast_runs) GROUP BY 1, 2, 3""")
def _(v):
    return extract.latest_run(v.forecast_runs).groupBy("date", "run", "variable").agg(F.count("*").alias("n"))


@query("p3_wrapped_longitudes", """
SELECT longitude - 360 * floor(longitude / 360) AS lon360, count(*) AS n FROM @forecast GROUP BY 1""")
def _(v):
    return v.forecast.groupBy(lon_0_360(F.col("longitude")).alias("lon360")).agg(F.count("*").alias("n"))
