"""Step validation: schema, channels, duplicates and latitudes in one pass over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.coords import lon_0_360, no_nan, number
from gridloom.operators.channels import contract_array, tag_channels
from gridloom.operators.extract import normalise_level
from gridloom.schema import (
    LATITUDE_POLICIES, LEVEL_SPELLINGS, MODEL_GRID, TIDY_REQUIRED, GridSpec,
)


def check_policy(policy: str | None) -> str:
    text = str(policy or "fail").strip().lower()
    if text not in LATITUDE_POLICIES:
        raise ValueError(f"latitude policy must be one of {sorted(LATITUDE_POLICIES)}, got {policy!r}")
    return text


def report_columns(df: DataFrame) -> list[str]:
    """Columns a report needs and the table lacks."""
    missing = [c for c in TIDY_REQUIRED if c not in df.columns]
    if not set(LEVEL_SPELLINGS) & set(df.columns):
        missing.append("|".join(LEVEL_SPELLINGS))
    return missing


def point_facets(df: DataFrame, *keys: str, channels=None) -> DataFrame:
    """Row counts per step by channel, by latitude and by longitude, from a single scan.

    Rows are first counted per channel point, which is the only large shuffle and combines repeated
    points on the map side. Fields outside the contract share one group per point. The grouping sets
    then run over distinct points and collapse to tens of channels and some thousand coordinates.
    """
    tagged = tag_channels(df, channels, how="left")
    kinds = dict(tagged.dtypes)
    raw = lambda c: no_nan(F.col(c)) if kinds[c] in ("float", "double") else F.col(c)
    points = tagged.groupBy(
        *keys, "channel_index", raw("latitude").alias("raw_lat"), raw("longitude").alias("raw_lon")
    ).agg(F.count("*").alias("n"))
    placed = points.select(
        *keys, "channel_index", "n",
        no_nan(number(F.col("raw_lat"))).alias("lat"), no_nan(number(F.col("raw_lon"))).alias("lon"),
    ).withColumn("lon360", lon_0_360(F.col("lon")))
    facets = ["channel_index", "lat", "lon", "lon360"]
    gid = F.grouping_id()
    one_of_four = {"channel_index": 0b0111, "lat": 0b1011, "lon": 0b1101, "lon360": 0b1110}
    name = F.coalesce(*[F.when(gid == bits, F.lit(c)) for c, bits in one_of_four.items()])
    return placed.groupingSets([[*keys, c] for c in facets], *keys, *facets).agg(
        F.sum("n").alias("rows"), F.count("*").alias("points"), name.alias("facet")
    )


def latitude_detail(
    count: Column, low: Column, high: Column, inner_low: Column, inner_high: Column, policy: str, expected: int
) -> Column:
    """What a latitude policy makes of the distinct latitudes of a step.

    ``inner_low`` is the lowest latitude above -90, ``inner_high`` the highest below 90.
    """
    policy = check_policy(policy)
    one_too_many = count == expected + 1
    dropping = one_too_many & F.lit(policy != "fail")
    south = policy == "drop_south_pole"
    applied = (
        F.when(count == expected, "none")
        .when(one_too_many, "latitude_policy_required" if policy == "fail" else policy)
        .otherwise("unsupported_latitude_count")
    )
    has_pole = (low == -90.0) if south else (high == 90.0)
    single = lambda c: c.cast("float").cast("double")
    return F.struct(
        count.alias("original_lat_count"),
        F.when(dropping & has_pole, count - 1).otherwise(count).alias("final_lat_count"),
        single(low).alias("original_lat_min"),
        single(high).alias("original_lat_max"),
        single(F.when(dropping & F.lit(south), inner_low).otherwise(low)).alias("final_lat_min"),
        single(F.when(dropping & F.lit(not south), inner_high).otherwise(high)).alias("final_lat_max"),
        F.lit(policy).alias("latitude_policy"),
        applied.alias("latitude_policy_applied"),
        F.when(dropping, -90.0 if south else 90.0).alias("dropped_latitude"),
    )


def keep_policy_rows(latitude: Column, detail: Column) -> Column:
    """Rows that survive the policy of their step."""
    return detail["dropped_latitude"].isNull() | (latitude != detail["dropped_latitude"])


def validation_report(
    df: DataFrame, *keys: str, policy: str = "fail", spec: GridSpec = MODEL_GRID, channels=None
) -> DataFrame:
    """One report row per step.

    Three aggregations follow one scan: points (large, combined on the map side), facets of a
    step (some thousand rows) and the step itself. Every list in a report is bounded by the contract.
    """
    policy = check_policy(policy)
    absent = report_columns(df)
    if absent:
        counts = df.groupBy(*keys) if keys else df.groupBy()
        return counts.agg(F.count("*").alias("row_count")).select(
            *keys, F.lit(False).alias("ok"), "row_count",
            F.array(*[F.lit(c) for c in absent]).alias("missing_columns"),
        )

    return facet_report(point_facets(normalise_level(df), *keys, channels=channels), *keys, policy=policy, spec=spec, channels=channels)


def facet_report(facets: DataFrame, *keys: str, policy: str = "fail", spec: GridSpec = MODEL_GRID, channels=None) -> DataFrame:
    """The report of every step from the counts of its channels and coordinates (see ``point_facets``)."""
    is_ = lambda facet: F.col("facet") == facet
    lat = F.when(is_("lat"), F.col("lat"))
    step = facets.groupBy(*keys).agg(
        F.sum(F.when(is_("lat"), F.col("rows"))).alias("row_count"),
        F.count(lat).alias("observed_lat_count"),
        F.count(F.when(is_("lon"), F.col("lon"))).alias("observed_lon_count"),
        F.count(F.when(is_("lon360"), F.col("lon360"))).alias("wrapped_lon_count"),
        F.min(lat).alias("_low"),
        F.max(lat).alias("_high"),
        F.min(F.when(lat > -90.0, lat)).alias("_inner_low"),
        F.max(F.when(lat < 90.0, lat)).alias("_inner_high"),
        F.collect_list(
            F.when(
                is_("channel_index") & F.col("channel_index").isNotNull(),
                F.struct("channel_index", (F.col("rows") - F.col("points")).alias("extra")),
            )
        ).alias("_seen"),
    )
    contract = contract_array(channels)
    missing = F.filter(
        contract, lambda c: ~F.exists("_seen", lambda s: s["channel_index"] == c["channel_index"])
    )
    repeated = F.transform(
        F.filter(
            contract,
            lambda c: F.exists("_seen", lambda s: (s["channel_index"] == c["channel_index"]) & (s["extra"] > 0)),
        ),
        lambda c: F.struct(
            c["channel_index"].alias("channel_index"), c["variable"].alias("variable"), c["level"].alias("level"),
            F.filter("_seen", lambda s: s["channel_index"] == c["channel_index"])[0]["extra"].alias("duplicate_points"),
        ),
    )
    expected = F.col("observed_lat_count") if spec.lat_count is None else F.lit(spec.lat_count)
    detail = latitude_detail(
        F.col("observed_lat_count"), F.col("_low"), F.col("_high"), F.col("_inner_low"),
        F.col("_inner_high"), policy, expected,
    )
    return (
        step.withColumns(
            {
                "missing_columns": F.array().cast("array<string>"),
                "missing_channels": missing,
                "duplicate_points_by_channel": repeated,
                "expected_lat_count": expected.cast("int"),
                "expected_lon_count": F.lit(spec.lon_count),
                "latitude": detail,
            }
        )
        .withColumn(
            "ok",
            reduce(
                lambda a, b: a & b,
                [
                    F.size("missing_channels") == 0,
                    F.size("duplicate_points_by_channel") == 0,
                    F.col("latitude.latitude_policy_applied").isin("none", "drop_south_pole", "drop_north_pole"),
                    F.col("latitude.final_lat_count") == F.col("expected_lat_count"),
                ],
            ),
        )
        .select(
            *keys, "ok", "row_count", "missing_columns", "missing_channels",
            "duplicate_points_by_channel", "expected_lat_count", "expected_lon_count",
            "observed_lat_count", "observed_lon_count", "wrapped_lon_count", "latitude",
        )
    )


def distinct_points(df: DataFrame, *keys: str) -> DataFrame:
    """One row per step, variable, level and position."""
    return normalise_level(df).dropDuplicates([*keys, "variable", "isobaricInhPa", "latitude", "longitude"])
