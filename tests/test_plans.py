"""Physical plans that must hold at any size."""

import pytest

from gridloom.operators.assemble import assembled_rows, line_rows
from gridloom.operators.channels import tag_channels
from gridloom.operators.extract import select_channel, snapshot
from gridloom.operators.nearest import build_index, nearest_point
from gridloom.operators.validate import validation_report
from gridloom.plans.tensor_job import run_tensor_job
from gridloom.schema import MODEL_CHANNELS, GridSpec
from gridloom.session import materialise, scratch_path
from gridloom.sources.tidy import read_tidy
from gridloom.sources.writers import write_tidy
from workload.views import Views


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tidy(spark, views):
    return read_tidy(spark, write_tidy(views.forecast, scratch_path(spark, "tidy")))


def test_channel_tags_are_a_broadcast_hash_join(tidy):
    text = plan(tag_channels(tidy))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Exchange hash" not in text


def test_snapshot_filters_reach_the_scan(tidy):
    text = plan(snapshot(tidy.where("year = '2026' AND hour = '18z'"), "t", 850.0))
    assert "EqualTo(variable,t)" in text and "EqualTo(isobaricInhPa,850.0)" in text
    assert "PartitionFilters: [isnotnull(year" in text
    assert "date" not in text.split("ReadSchema")[1]


def test_level_range_reaches_the_scan(tidy):
    text = plan(select_channel(tidy, "t", 850.0))
    assert "GreaterThanOrEqual(isobaricInhPa" in text and "LessThanOrEqual(isobaricInhPa" in text


def test_validation_reads_the_rows_once(tidy):
    text = plan(validation_report(tidy, "step_key"))
    assert text.count("FileScan parquet") == 1 and "NestedLoop" not in text and "Cartesian" not in text


def test_lookup_never_pairs_everything(views):
    text = plan(nearest_point(views.probes, build_index(views.model_grid)))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_a_step_is_shuffled_once(spark, tidy):
    lines = line_rows(tidy, "step_key")
    text = plan(lines)
    assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan parquet") == 1
    written = materialise(lines, "lines")
    report = materialise(validation_report(tidy, "step_key"), "reports")
    assert "Exchange hashpartitioning" not in plan(assembled_rows(written, report, "step_key"))


def test_a_step_of_full_size(spark):
    """One forecast step of 20 channels, 721 latitudes and 1440 longitudes: 20.8 million rows."""
    from pyspark.sql import functions as F

    names = F.array(*[F.lit(n) for n, _ in MODEL_CHANNELS])
    levels = F.array(*[F.lit(lv).cast("double") for _, lv in MODEL_CHANNELS])
    cell = F.col("id")
    channel, lat, lon = (cell / (721 * 1440)).cast("int"), (cell / 1440).cast("long") % 721, cell % 1440
    rows = spark.range(20 * 721 * 1440, numPartitions=16).select(
        F.lit("s").alias("step"), F.get(levels, channel).alias("isobaricInhPa"), (90.0 - lat / 4).alias("latitude"), (lon / 4).alias("longitude"),
        F.get(names, channel).alias("variable"), (cell % 1000).cast("float").alias("value"), F.lit("20260409").alias("date"), F.lit("18z").alias("run"),
    )
    job = run_tensor_job(rows, "step", policy="drop_south_pole", spec=GridSpec())
    step = job.steps.first()
    assert (step["tensor_written"], step["tensor_shape"]) == (True, [1, 20, 720, 1440])
    assert job.tensors.count() == 20 * 720
    report = job.reports.first()
    assert report["row_count"] == 20 * 721 * 1440 and len(report["available_variables"]) == 11 and len(report["available_variable_levels"]) == 20
    one = job.tensors.where("channel_index = 7 and lat_index = 100").first()["values"]
    assert one == [float(((7 * 721 + 100) * 1440 + k) % 1000) for k in range(1440)]
