"""Row-tensors: one row per (step, channel, latitude) with an ordered array of longitudes.

A whole step is 14,400 such rows; nothing ever holds a step in one cell or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.coords import finite, is_surface, lon_0_360, no_nan, number
from gridloom.functions.weather import restore, standardise
from gridloom.operators.channels import tag_channels
from gridloom.operators.extract import ContractError, normalise_level
from gridloom.schema import MODEL_CHANNELS, MODEL_GRID, GridSpec, layout_table
from gridloom.operators.validate import keep_policy_rows

LAT_STEP = 0.25


def latitude_axis(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct latitudes of each step with their position from the north."""
    lats = df.select(*keys, no_nan(number(F.col("latitude"))).alias("latitude")).where(
        F.col("latitude").isNotNull()
    ).distinct()
    north_first = Window.partitionBy(*keys).orderBy(F.desc("latitude"))
    return lats.withColumn("lat_index", F.row_number().over(north_first) - 1)


def lon_position(longitude, spec: GridSpec):
    """Index on the target longitudes, null off the grid (exact match, as a reindex does)."""
    lon = lon_0_360(longitude)
    index = F.round((lon - spec.lon_start) / spec.lon_step).cast("int")
    on_grid = (lon == spec.lon_start + index * F.lit(spec.lon_step)) & index.between(0, spec.lon_count - 1)
    return F.when(on_grid, index)


def field_cells(
    df: DataFrame, report: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID, channels=None
) -> DataFrame:
    """Contract rows of the steps whose report is ok, with grid positions.

    The report has one row per step, so the gate is a small join and the tidy rows stay in
    place. On a regular axis the latitude position is arithmetic. Any other axis is ranked.
    """
    tagged = tag_channels(df, channels)
    passed = report.where("ok").select(*keys, F.col("latitude").alias("_detail"))
    rows = tagged.join(passed, list(keys)).where(keep_policy_rows(F.col("latitude"), F.col("_detail")))
    rows = rows.withColumn("lon_index", lon_position(F.col("longitude"), spec))
    if spec.lat_count is not None:
        offset = (F.col("_detail.final_lat_max") - F.col("latitude")) / F.lit(LAT_STEP)
        index = F.round(offset).cast("int")
        rows = rows.withColumn(
            "lat_index", F.when((offset == index) & index.between(0, spec.lat_count - 1), index)
        )
    else:
        kept = normalise_level(df).join(passed, list(keys)).where(
            keep_policy_rows(F.col("latitude"), F.col("_detail"))
        )
        rows = rows.join(latitude_axis(kept, *keys), [*keys, "latitude"])
    return rows.select(*keys, "channel_index", "lat_index", "lon_index", "latitude", "value")


def tensor_rows(cells: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID) -> DataFrame:
    """Assemble ordered arrays with one shuffle on (step, channel, latitude).

    ``cells`` come from steps without repeated points, so an array holds at most one entry per
    longitude and wrap. ``complete`` tells whether it is exactly the expected row.
    """
    entries = F.array_sort(F.collect_list(F.struct("lon_index", "value")))
    rows = cells.groupBy(*keys, "channel_index", "lat_index").agg(
        entries.alias("_entries"), F.count_if(F.col("lon_index").isNull()).alias("_off_grid")
    )
    full = F.sequence(F.lit(0), F.lit(spec.lon_count - 1))
    usable = ~F.exists("_entries", lambda e: e["value"].isNull() | F.isnan(e["value"]))
    return rows.select(
        *keys,
        "channel_index",
        "lat_index",
        F.transform("_entries", lambda e: e["value"]).alias("values"),
        F.coalesce(
            (F.col("_off_grid") == 0)
            & F.col("lat_index").isNotNull()
            & (F.transform("_entries", lambda e: e["lon_index"]) == full)
            & usable,
            F.lit(False),
        ).alias("complete"),
    )


def tensor_status(rows: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID, channels=None) -> DataFrame:
    """Per step: is every row of every channel there? Reads no array."""
    n_channels = len(channels or MODEL_CHANNELS)
    per_channel = rows.groupBy(*keys, "channel_index").agg(
        F.count("*").alias("lat_rows"), F.count_if(F.col("complete")).alias("good_rows")
    )
    per_step = per_channel.groupBy(*keys).agg(
        F.count("*").alias("channels"),
        F.min("good_rows").alias("lat_rows_min"),
        F.max("lat_rows").alias("lat_rows_max"),
    )
    wanted = F.col("lat_rows_max") if spec.lat_count is None else F.lit(spec.lat_count)
    return per_step.select(
        *keys,
        (
            (F.col("channels") == n_channels)
            & (F.col("lat_rows_min") == wanted)
            & (F.col("lat_rows_max") == wanted)
        ).alias("tensor_ok"),
        F.array(F.lit(1), F.col("channels").cast("int"), F.col("lat_rows_max").cast("int"), F.lit(spec.lon_count)).alias("shape"),
    )


def published_rows(rows: DataFrame, status: DataFrame, *keys: str) -> DataFrame:
    """Row-tensors of complete steps only."""
    return rows.join(status.where("tensor_ok").select(*keys), list(keys), "left_semi").drop("complete")


def grid_holes(
    df: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID, channels=None, top: float = 90.0
) -> DataFrame:
    """Expected grid points that a step lacks, as (keys, channel, latitude, lon_index).

    A point without a number is one that lacks. With a fixed ``lat_count`` every latitude from ``top`` down is expected, also
    one that no channel has; without it, those that the step has in any channel.

    The longitudes seen on a line are at most ``lon_count`` small integers, combined on the map
    side. Only lines with a gap are expanded, never the full expected grid.
    """
    tagged = tag_channels(df, channels).withColumn("lon_index", lon_position(F.col("longitude"), spec))
    seen = tagged.where(no_nan(F.col("value").cast("double")).isNotNull()).groupBy(*keys, "channel_index", "latitude").agg(
        F.collect_set("lon_index").alias("_seen")
    )
    if spec.lat_count is None:
        lines = df.select(*keys, "latitude").where(F.col("latitude").isNotNull()).distinct()
    else:
        kind = df.schema["latitude"].dataType
        axis = F.transform(F.sequence(F.lit(0), F.lit(spec.lat_count - 1)), lambda i: (F.lit(top) - i * F.lit(LAT_STEP)).cast(kind))
        lines = df.groupBy(*keys).agg(F.count("*").alias("_rows")).select(*keys, F.explode(axis).alias("latitude"))
    indexes = F.sequence(F.lit(0), F.lit(len(channels or MODEL_CHANNELS) - 1))
    expected = lines.withColumn("channel_index", F.explode(indexes))
    full = F.sequence(F.lit(0), F.lit(spec.lon_count - 1))
    return (
        expected.join(seen, [*keys, "channel_index", "latitude"], "left")
        .select(
            *keys, "channel_index", "latitude",
            F.explode(F.array_except(full, F.coalesce("_seen", F.array().cast("array<int>")))).alias("lon_index"),
        )
    )


def grid_extras(df: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID, channels=None) -> DataFrame:
    """Contract points that lie off the target longitudes."""
    tagged = tag_channels(df, channels).withColumn("lon_index", lon_position(F.col("longitude"), spec))
    return tagged.where(F.col("lon_index").isNull()).select(
        *keys, "channel_index", "latitude", "longitude"
    )


def grouped_tensor_rows(df: DataFrame, *keys: str, spec: GridSpec = MODEL_GRID) -> DataFrame:
    """Row-tensors of the surface/upper layout, on each step's own latitudes.

    Null, NaN and zero levels are the surface. ``values`` has a place for every target longitude, null where no number was found, and ``complete``
    tells whether there is none.
    """
    layout = layout_table(df.sparkSession).select(
        "group", "var_index", "level_index",
        F.col("variable").alias("_name"), F.col("level").alias("_ref"),
    )
    tidy = normalise_level(df)
    rows = tidy.join(
        F.broadcast(layout),
        (F.lower("variable") == F.col("_name"))
        & F.when(F.col("_ref").isNull(), is_surface(F.col("isobaricInhPa"))).otherwise(F.col("isobaricInhPa") == F.col("_ref")),
    )
    place = [*keys, "group", "var_index", "level_index", "latitude", "lon_index"]
    points = rows.withColumn("lon_index", lon_position(F.col("longitude"), spec)).where(
        F.col("lon_index").isNotNull()
    ).groupBy(*place).agg(F.max(no_nan(F.col("value"))).alias("value"))  # a repeated point must not grow an array
    full = F.sequence(F.lit(0), F.lit(spec.lon_count - 1))
    found = points.groupBy(*[c for c in place if c != "lon_index"]).agg(
        F.collect_list(F.struct("lon_index", "value")).alias("_found")
    )
    gaps = F.transform(
        F.array_except(full, F.transform("_found", lambda e: e["lon_index"])),
        lambda i: F.struct(i.alias("lon_index"), F.lit(None).cast(df.schema["value"].dataType).alias("value")),
    )
    filled = found.withColumn("values", F.transform(F.array_sort(F.concat("_found", gaps)), lambda e: e["value"]))
    return filled.drop("_found").withColumn("complete", ~F.exists("values", lambda v: v.isNull()))


def statistics_columns(column: str) -> list:
    """NaN-ignoring statistics with population deviation; infinities stay in."""
    raw = F.col(column).cast("double")
    real = no_nan(raw)
    return [
        F.count("*").alias("elements"),
        F.bool_and(F.coalesce(finite(raw), F.lit(False))).alias("finite"),
        F.count_if(F.isnan(raw)).alias("nan_count"),
        F.min(real).alias("min"),
        F.max(real).alias("max"),
        F.avg(real).alias("mean"),
        F.stddev_pop(real).alias("std"),
    ]


def value_statistics(values: DataFrame, *keys: str, column: str = "value") -> DataFrame:
    return values.groupBy(*keys).agg(*statistics_columns(column))


def tensor_statistics(rows: DataFrame, *keys: str) -> DataFrame:
    """Statistics of row-tensors; partial aggregation happens before the shuffle."""
    return value_statistics(rows.select(*keys, F.explode("values").alias("value")), *keys)


def statistics_fault(stats: DataFrame, channels: int = 20) -> str | None:
    """What is wrong with a statistics table: it must hold mean and deviation of channels 0 to ``channels - 1``, once each."""
    wanted = F.col("channel_index").between(0, channels - 1)
    usable = wanted & F.col("mean").isNotNull() & F.col("std").isNotNull()
    seen = stats.agg(
        F.count_if(wanted).alias("rows"), F.count_distinct(F.when(usable, F.col("channel_index"))).alias("channels")
    ).first()
    if seen["rows"] == seen["channels"] == channels:
        return None
    return f"statistics need one row for each of {channels} channels, got {seen['rows']} rows for {seen['channels']} channels"


def with_channel_stats(rows: DataFrame, stats: DataFrame, channels: int = 20, column: str = "values") -> DataFrame:
    """Every row with its channel's statistics as ``_mean`` and ``_std``; a faulty table and a channel beyond it are refused."""
    fault = statistics_fault(stats, channels)
    if fault:
        raise ContractError(fault)
    picked = stats.where(F.col("channel_index").between(0, channels - 1)).select(
        "channel_index", F.col("mean").cast("double").alias("_mean"), F.col("std").cast("double").alias("_std")
    )
    unknown = F.raise_error(F.concat(F.lit("no statistics for channel "), F.col("channel_index").cast("string")))
    joined = rows.join(F.broadcast(picked), "channel_index", "left")  # exactly `channels` rows
    kind = rows.schema[column].dataType
    return joined.withColumn(column, F.when(F.col("_mean").isNull(), unknown.cast(kind)).otherwise(F.col(column)))


def normalise_rows(rows: DataFrame, stats: DataFrame, channels: int = 20) -> DataFrame:
    """(x - mean) / std per channel, worked in double and kept in single precision."""
    scaled = F.transform(
        "values", lambda v: standardise(v.cast("double"), F.col("_mean"), F.col("_std")).cast("float")
    )
    return with_channel_stats(rows, stats, channels).withColumn("values", scaled).drop("_mean", "_std")


def denormalise_rows(rows: DataFrame, stats: DataFrame, channels: int = 20) -> DataFrame:
    scaled = F.transform(
        "values", lambda v: restore(v.cast("double"), F.col("_mean"), F.col("_std")).cast("float")
    )
    return with_channel_stats(rows, stats, channels).withColumn("values", scaled).drop("_mean", "_std")


def stats_channels(shape):
    """Channel count of a statistics array shape: rank 1 or rank 4, else null."""
    return F.when(F.size(shape) == 1, shape[0]).when(F.size(shape) == 4, F.get(shape, F.lit(1)))


def shape_verdict(shape, want=(20, 720, 1440)):
    """Why a tensor shape is refused; null if it is accepted."""
    rank = F.size(shape)
    full = F.when(rank == 3, F.concat(F.array(F.lit(1)), shape)).when(rank == 4, shape)
    tail = F.slice(full, 2, 3)
    return F.when(full.isNull(), "unexpected_input_rank").when(
        tail != F.array(*[F.lit(x) for x in want]), "input_shape_mismatch"
    )
