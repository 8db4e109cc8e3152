"""Coordinate, level and partition-key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABS_TOL = 1e-6
REL_TOL = 1e-5


def number(col: Column) -> Column:
    """Lenient numeric reading: text that is no number becomes null."""
    return col.try_cast("double")


def lon_0_360(lon: Column) -> Column:
    """Longitude in [0, 360); ``pmod`` keeps the sign of the divisor, ``%`` would not."""
    return F.pmod(lon.cast("double"), F.lit(360.0))


def near(value: Column, ref: float | Column) -> Column:
    """``|value - ref| <= 1e-6 + 1e-5*|ref|``; null and NaN are never near.

    A literal reference becomes a plain range, which Parquet can use to skip row groups.
    """
    if isinstance(ref, Column):
        tol = F.lit(ABS_TOL) + F.lit(REL_TOL) * F.abs(ref)
        return (value >= ref - tol) & (value <= ref + tol)
    tol = ABS_TOL + REL_TOL * abs(ref)
    return (value >= F.lit(ref - tol)) & (value <= F.lit(ref + tol))


def is_surface(level: Column) -> Column:
    """No pressure level: null, NaN or zero."""
    return level.isNull() | F.isnan(level) | ((level >= F.lit(-ABS_TOL)) & (level <= F.lit(ABS_TOL)))


def no_nan(col: Column) -> Column:
    """NaN becomes null, so that aggregates skip it."""
    return F.when(~F.isnan(col), col)


def finite(col: Column) -> Column:
    return ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def in_range(lat: Column, lon: Column, nan_passes: bool = False) -> Column:
    """Latitude in [-90, 90] and longitude in [-180, 180].

    Spark orders NaN above every number. ``nan_passes`` lets NaN through instead.
    """
    ok = (lat >= -90.0) & (lat <= 90.0) & (lon >= -180.0) & (lon <= 180.0)
    if nan_passes:
        ok = ((F.isnan(lat)) | ((lat >= -90.0) & (lat <= 90.0))) & (
            (F.isnan(lon)) | ((lon >= -180.0) & (lon <= 180.0))
        )
    return ok


def run_suffixed(run: Column) -> Column:
    """Dialect (a): lower, trim, one trailing ``z``."""
    text = F.lower(F.trim(run))
    return F.when(text.endswith("z"), text).otherwise(F.concat(text, F.lit("z")))


def synoptic_hour(hour: Column) -> Column:
    """Dialect (b): 00, 06, 12 or 18 with or without ``z``; anything else is null."""
    text = F.lower(F.trim(hour))
    return F.when(text.rlike("^(00|06|12|18)z?$"), F.concat(F.substring(text, 1, 2), F.lit("z")))


def hour_of_day(hour: Column) -> Column:
    """Dialect (c): 0..23 with an optional ``z`` as two digits; anything else is null."""
    n = F.regexp_replace(F.lower(F.trim(hour)), "z$", "").try_cast("int")
    return F.when(n.between(0, 23), F.lpad(n.cast("string"), 2, "0"))


def partition_date(date: Column) -> dict[str, Column]:
    """Zero-padded year, month and day of a ``yyyyMMdd`` text; null if it is no date."""
    day = F.try_to_timestamp(date, F.lit("yyyyMMdd"))
    return {
        "year": F.date_format(day, "yyyy"),
        "month": F.date_format(day, "MM"),
        "day": F.date_format(day, "dd"),
    }


def partition_path(prefix: str, date: Column, run: Column) -> Column:
    part = partition_date(date)
    return F.concat(
        F.lit(prefix.strip("/") + "/year="), part["year"], F.lit("/month="), part["month"],
        F.lit("/day="), part["day"], F.lit("/hour="), run_suffixed(run),
    )


STEP_FILE = r"^(\d{4})(\d{2})(\d{2})(\d{2})\d{4}-(\d+)h-([a-z]+)-([a-z]+)"


def step_facets(file_name: Column) -> dict[str, Column]:
    """Run date, run hour, lead time, stream and type of a step file name."""
    def part(k: int) -> Column:
        return F.nullif(F.regexp_extract(file_name, STEP_FILE, k), F.lit(""))

    return {
        "date": F.concat(part(1), part(2), part(3)),
        "run": F.concat(part(4), F.lit("z")),
        "step_hours": part(5).cast("int"),
        "stream": part(6),
        "type": part(7),
    }


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(False))


def split_uri(uri: Column) -> dict[str, Column]:
    """Bucket and key of an ``s3://bucket/key`` text; null when it has not that form."""
    pattern = r"^s3://([^/]+)/(.+)$"
    return {
        "bucket": F.nullif(F.regexp_extract(uri, pattern, 1), F.lit("")),
        "key": F.nullif(F.regexp_extract(uri, pattern, 2), F.lit("")),
    }
