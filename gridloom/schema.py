"""Table schemas, the channel contracts and the constants of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PARTITION_FIELDS = "year STRING, month STRING, day STRING, hour STRING"

TIDY_BODY = (
    "isobaricInhPa DOUBLE, latitude DOUBLE, longitude DOUBLE, variable STRING, value FLOAT, "
    "date STRING, run STRING"
)
TIDY = f"{TIDY_BODY}, {PARTITION_FIELDS}"

SNAPSHOT_COLUMNS = ["latitude", "longitude", "value"]
TIDY_REQUIRED = ["latitude", "longitude", "variable", "value", "date", "run"]
LEVEL_SPELLINGS = ["isobaricInhPa", "isobaricinhpa"]

# The published prediction table, in its published column order.
PREDICTION_REQUIRED = [
    "prediction_id", "model_name", "model_version", "prediction_timestamp_utc",
    "source_database", "source_table", "source_year", "source_month", "source_day",
    "source_hour", "run", "latitude", "longitude", "target_variable",
    "predicted_value", "predicted_units", "method",
]
PREDICTION_OPTIONAL = ["observed_value", "error", "feature_snapshot_json"]
PREDICTION_PARTITIONS = [
    "year", "month", "day", "hour", "model_name_partition", "model_version_partition",
]
PREDICTION_DOUBLES = {"latitude", "longitude", "predicted_value", "observed_value", "error"}


def prediction_schema() -> T.StructType:
    names = PREDICTION_REQUIRED + PREDICTION_OPTIONAL + PREDICTION_PARTITIONS
    return T.StructType(
        [T.StructField(n, T.DoubleType() if n in PREDICTION_DOUBLES else T.StringType()) for n in names]
    )


MANIFEST = (
    "request_id STRING, mode STRING, input_s3_uri STRING, output_s3_uri STRING, "
    "max_runtime_guard BOOLEAN"
)

# The 20 model channels in contract order; level None is the surface.
MODEL_CHANNELS: list[tuple[str, float | None]] = [
    ("u10", None), ("v10", None), ("t2m", None), ("sp", None), ("msl", None),
    ("t", 850.0), ("u", 1000.0), ("v", 1000.0), ("z", 1000.0),
    ("u", 850.0), ("v", 850.0), ("z", 850.0),
    ("u", 500.0), ("v", 500.0), ("z", 500.0), ("t", 500.0),
    ("z", 50.0), ("r", 500.0), ("r", 850.0), ("tcwv", None),
]

# The second tensor layout (surface group and 13-level upper group).
SURFACE_GROUP = ["msl", "u10", "v10", "t2m"]
UPPER_GROUP = ["z", "q", "t", "u", "v"]
UPPER_LEVELS = [1000, 925, 850, 700, 600, 500, 400, 300, 250, 200, 150, 100, 50]

# Readable names for GRIB short codes; other codes keep their name.
READABLE_NAMES = {
    "p49": "wind_gust_max_10m", "tp": "total_precipitation", "skt": "skin_temperature",
    "u100": "wind_u_100m", "v100": "wind_v_100m", "asn": "snow_albedo", "rsn": "snow_density",
    "sd": "snow_depth", "sf": "snowfall", "ssrd": "solar_radiation_downwards",
    "strd": "thermal_radiation_downwards", "ssr": "net_solar_radiation",
    "str": "net_thermal_radiation", "ro": "runoff", "tprate": "total_precipitation_rate",
    "sithick": "sea_ice_thickness", "zos": "sea_surface_height",
}

GRAVITY = 9.80665
GUARD_ELEMENTS = 50_000_000
LATITUDE_POLICIES = ("fail", "drop_south_pole", "drop_north_pole")
REQUEST_MODES = ("metadata_only", "forward")
CLASSIFIER_DEFAULTS = {"mean_t2m": 285.0, "std_t2m": 8.0, "threshold": 2.0}


@dataclass(frozen=True)
class GridSpec:
    """The target grid: descending latitudes, ascending longitudes from ``lon_start``.

    ``lat_count=None`` takes every observed latitude of a step as expected.
    """

    lat_count: int | None = 720
    lon_count: int = 1440
    lon_step: float = 0.25
    lon_start: float = 0.0


MODEL_GRID = GridSpec()


def _sql(value) -> str:
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    return f"'{value}'" if isinstance(value, str) else f"{value}D" if isinstance(value, float) else str(value)


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A literal table, known to the optimizer with its exact size."""
    body = ", ".join("(" + ", ".join(_sql(x) for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def channel_table(spark: SparkSession, channels=None) -> DataFrame:
    """(channel_index, variable, level): a fixed table of tens of rows."""
    rows = [(i, name, level) for i, (name, level) in enumerate(channels or MODEL_CHANNELS)]
    return _values(spark, rows, "channel_index, variable, level")


def channel_array_sql(channels=None) -> str:
    """The same contract as one array literal of structs."""
    entries = [
        f"named_struct('channel_index', {i}, 'variable', '{name}', 'level', {_sql(level)})"
        for i, (name, level) in enumerate(channels or MODEL_CHANNELS)
    ]
    return f"array({', '.join(entries)})"


def layout_table(spark: SparkSession) -> DataFrame:
    """Surface/upper tensor layout as (group, var_index, level_index, variable, level)."""
    rows = [("surface", v, 0, name, None) for v, name in enumerate(SURFACE_GROUP)]
    rows += [
        ("upper", v, i, name, float(level))
        for v, name in enumerate(UPPER_GROUP)
        for i, level in enumerate(UPPER_LEVELS)
    ]
    return _values(spark, rows, "group, var_index, level_index, variable, level")
