"""Lines of a step - a channel on a latitude - assembled once; verdict, availability and row-tensors all come from them.

The tidy rows are shuffled a single time, by step, channel and latitude. A line holds its distinct on-grid points, and counts of its rows and points, so the report is rolled up from lines and the
tensor is a change of form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.coords import lon_0_360, no_nan, number
from gridloom.operators.channels import tag_channels
from gridloom.operators.extract import normalise_level
from gridloom.operators.tensor import LAT_STEP, lon_position
from gridloom.operators.validate import keep_policy_rows
from gridloom.schema import MODEL_GRID, GridSpec
from gridloom.session import materialise


def step_lines(df: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID, channels=None) -> DataFrame:
    """``line_rows``, written once."""
    return materialise(line_rows(df, *keys, spec=spec, channels=channels), "lines")


def line_rows(df: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID, channels=None) -> DataFrame:
    """``keys, channel_index, latitude, n_rows, off_grid, points, fields``: one row per step, channel and latitude.

    ``points`` has the distinct (longitude, place on the grid, value) of a contract channel, ``off_grid`` counts rows beside the grid, which are not gathered. Rows outside the contract (null channel) keep the grid's
    longitudes without values. ``fields`` are the variable and level pairs of the line. Repeated points combine on the map side.
    """
    tagged = tag_channels(normalise_level(df), channels, how="left")
    kinds = dict(tagged.dtypes)
    raw = lambda c: no_nan(F.col(c)) if kinds[c] in ("float", "double") else F.col(c)
    place = lon_position(number(F.col("longitude")), spec)
    value = F.when(F.col("channel_index").isNotNull(), F.col("value"))
    rows = tagged.select(
        *keys, "channel_index", raw("latitude").alias("latitude"), raw("longitude").alias("longitude"), place.alias("lon_index"), value.alias("value"),
        F.lower("variable").alias("variable"), no_nan(F.col("isobaricInhPa")).alias("level"),
    )
    point = F.when(F.col("lon_index").isNotNull(), F.struct("lon_index", "longitude", "value"))
    return rows.groupBy(*keys, "channel_index", "latitude").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("lon_index").isNull()).alias("off_grid"),
        F.collect_set(point).alias("points"), F.collect_set(F.struct("variable", "level")).alias("fields"),
    )


def off_grid_points(df: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID, channels=None) -> DataFrame:
    """``keys, channel_index, latitude, longitude, n``: points beside the grid with their rows; as many as the step has faults."""
    tagged = tag_channels(normalise_level(df), channels, how="left")
    kinds = dict(tagged.dtypes)
    raw = lambda c: no_nan(F.col(c)) if kinds[c] in ("float", "double") else F.col(c)
    beside = tagged.where(lon_position(number(F.col("longitude")), spec).isNull())
    return beside.groupBy(*keys, "channel_index", raw("latitude").alias("latitude"), raw("longitude").alias("longitude")).agg(F.count("*").alias("n"))


def no_points(lines: DataFrame, *keys: str) -> DataFrame:
    """An empty table of points beside the grid."""
    kind = lines.schema["points"].dataType.elementType["longitude"].dataType
    return lines.limit(0).select(*keys, "channel_index", "latitude", F.lit(None).cast(kind).alias("longitude"), F.lit(0).cast("long").alias("n"))


def line_facets(lines: DataFrame, beside: DataFrame, *keys: str) -> DataFrame:
    """What ``point_facets`` counts, from lines and the points beside the grid. Every step here is small: lines, or coordinates combined on the map side."""
    distinct = F.size(F.array_distinct(F.transform("points", lambda p: p["longitude"])))
    counted = lines.select(*keys, "channel_index", "latitude", "n_rows", distinct.cast("long").alias("points"))
    extra = beside.groupBy(*keys, "channel_index", "latitude").agg(F.count("*").alias("points")).withColumn("n_rows", F.lit(0).cast("long"))
    counted = counted.unionByName(extra.select(counted.columns))
    lat = no_nan(number(F.col("latitude")))
    none = {"channel_index": "int", "lat": "double", "lon": "double", "lon360": "double", "rows": "long", "points": "long"}

    def facet(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, *[F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in none.items()], F.lit(name).alias("facet"))

    sums = [F.sum("n_rows").alias("rows"), F.sum("points").alias("points")]
    by_channel = facet(counted.groupBy(*keys, "channel_index").agg(*sums), "channel_index")
    by_lat = facet(counted.groupBy(*keys, lat.alias("lat")).agg(*sums), "lat")
    lon = lines.select(*keys, F.explode(F.array_distinct(F.transform("points", lambda p: p["longitude"]))).alias("longitude")).unionByName(beside.select(*keys, "longitude"))
    lon = lon.select(*keys, no_nan(number(F.col("longitude"))).alias("lon")).distinct()
    by_lon = facet(lon, "lon")
    by_lon360 = facet(lon.select(*keys, lon_0_360(F.col("lon")).alias("lon360")).distinct(), "lon360")
    return by_channel.unionByName(by_lat).unionByName(by_lon).unionByName(by_lon360)


def available_levels(lines: DataFrame, *keys: str) -> DataFrame:
    """``keys, variable, isobaricInhPa``: each variable and level that a step has, by lower-cased name."""
    pairs = lines.select(*keys, F.explode("fields").alias("f")).select(*keys, "f.variable", F.col("f.level").alias("isobaricInhPa"))
    return pairs.distinct()


def availability(lines: DataFrame, *keys: str) -> DataFrame:
    """``keys, available_variables, available_variable_levels``: the same as two ordered lists, levels null first."""
    pair = F.struct("variable", "isobaricInhPa")
    return available_levels(lines, *keys).groupBy(*keys).agg(
        F.array_sort(F.collect_set("variable")).alias("available_variables"), F.sort_array(F.collect_list(pair)).alias("available_variable_levels")
    )


def assembled_rows(lines: DataFrame, report: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID) -> DataFrame:
    """Row-tensors, ``keys, channel_index, lat_index, values, complete``, of the steps whose report is ok; no shuffle of lines."""
    passed = report.where("ok").select(*keys, F.col("latitude").alias("_detail"))
    lat = no_nan(number(F.col("latitude")))
    kept = lines.withColumn("latitude", lat).join(passed, list(keys)).where(keep_policy_rows(F.col("latitude"), F.col("_detail")))
    if spec.lat_count is not None:
        offset = (F.col("_detail.final_lat_max") - F.col("latitude")) / F.lit(LAT_STEP)
        index = F.round(offset).cast("int")
        kept = kept.withColumn("lat_index", F.when((offset == index) & index.between(0, spec.lat_count - 1), index))
    else:
        axis = kept.where(F.col("latitude").isNotNull()).groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_set("latitude"))).alias("_axis"))
        place = F.array_position("_axis", F.col("latitude")).cast("int") - 1
        kept = kept.join(axis, list(keys)).where(F.col("latitude").isNotNull()).withColumn("lat_index", place)
    entries = F.array_sort(F.transform("points", lambda p: F.struct(p["lon_index"], p["value"])))
    full = F.sequence(F.lit(0), F.lit(spec.lon_count - 1))
    rows = kept.where(F.col("channel_index").isNotNull()).withColumn("_entries", entries)
    usable = ~F.exists("_entries", lambda e: e["value"].isNull() | F.isnan(e["value"]))
    return rows.select(
        *keys, "channel_index", "lat_index", F.transform("_entries", lambda e: e["value"]).alias("values"),
        F.coalesce(
            (F.col("off_grid") == 0) & F.col("lat_index").isNotNull() & (F.transform("_entries", lambda e: e["lon_index"]) == full) & usable, F.lit(False)
        ).alias("complete"),
    )

