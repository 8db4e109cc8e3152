"""Validation, latitude policies and tensor jobs on small constructed steps."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators.channels import missing_channels
from gridloom.operators.extract import ContractError, normalise_level, require_columns, snapshot
from gridloom.operators.ordinal import exact_quantiles, with_ordinal
from gridloom.operators.tensor import value_statistics
from gridloom.operators.validate import check_policy, validation_report
from gridloom.plans.tensor_job import run_tensor_job
from gridloom.schema import MODEL_CHANNELS, GridSpec

SPEC = GridSpec(lat_count=4, lon_count=4, lon_step=90.0, lon_start=0.0)


def step(spark, lats, name=1, lons=(-180.0, -90.0, 0.0, 90.0), channels=MODEL_CHANNELS):
    rows = [
        (name, level, lat, lon, var, float(c * 1000 + i * 10 + j), "20260409", "18z")
        for c, (var, level) in enumerate(channels) for i, lat in enumerate(lats) for j, lon in enumerate(lons)
    ]
    return spark.createDataFrame(
        rows, "step INT, isobaricInhPa DOUBLE, latitude DOUBLE, longitude DOUBLE, variable STRING, value FLOAT, date STRING, run STRING")


def lats(n, top=90.0):
    return [top - 0.25 * i for i in range(n)]


def test_complete_step_becomes_ordered_rows(spark):
    job = run_tensor_job(step(spark, lats(4)), "step", spec=SPEC)
    rows = {(r.channel_index, r.lat_index): r["values"] for r in job.tensors.collect()}
    assert len(rows) == 20 * 4
    # longitudes -180, -90 wrap to 180, 270: the order is 0, 90, 180, 270
    assert rows[(3, 2)] == [3022.0, 3023.0, 3020.0, 3021.0]
    assert job.steps.first()["tensor_shape"] == [1, 20, 4, 4]


@pytest.mark.parametrize("policy, ok, first", [("fail", False, None), ("drop_north_pole", True, 1.0), ("drop_south_pole", False, None)])
def test_pole_policies(spark, policy, ok, first):
    data = step(spark, lats(5))  # one too many; the south pole is not among them
    report = validation_report(data, "step", policy=policy, spec=SPEC).first()
    assert report["ok"] is ok
    job = run_tensor_job(data, "step", policy=policy, spec=SPEC, allow_incomplete=True)
    rows = job.tensors.where("channel_index = 0 AND lat_index = 0").collect()
    assert (rows[0]["values"][2] == 10.0) if ok else not rows  # the first kept line is the second one


def test_south_pole_is_dropped(spark):
    data = step(spark, [-89.0, -89.25, -89.5, -89.75, -90.0])
    job = run_tensor_job(data, "step", policy="drop_south_pole", spec=SPEC)
    assert job.tensors.count() == 80
    detail = job.reports.first()["latitude"]
    assert (detail["final_lat_count"], detail["dropped_latitude"], detail["final_lat_min"]) == (4, -90.0, -89.75)


def test_strict_job_publishes_nothing(spark):
    good, bad = step(spark, lats(4)), step(spark, lats(4), 2, channels=MODEL_CHANNELS[:-1])
    with pytest.raises(ContractError, match="1 steps are incomplete"):
        run_tensor_job(good.unionByName(bad), "step", spec=SPEC)
    job = run_tensor_job(good.unionByName(bad), "step", spec=SPEC, allow_incomplete=True)
    assert {r["step"]: r["tensor_write_reason"] for r in job.steps.collect()} == {1: "written", 2: "validation_failed"}
    assert missing_channels(bad, "step").first()["variable"] == "tcwv"


def test_holes_nulls_and_wrap_duplicates_keep_a_step_back(spark):
    base = step(spark, lats(4))
    hole = base.where("NOT (variable = 'sp' AND latitude = 89.75 AND longitude = 0)")
    null = base.withColumn("value", F.when((F.col("variable") != "sp") | (F.col("longitude") != 0), F.col("value")))
    wrap = step(spark, lats(4), lons=(-180.0, -90.0, 0.0, 90.0, 180.0))
    for data in (hole, null, wrap):
        job = run_tensor_job(data, "step", spec=SPEC, allow_incomplete=True)
        assert job.steps.first()["tensor_write_reason"] == "tensor_incomplete"
        assert job.tensors.isEmpty()


def test_duplicates_and_spellings(spark):
    data = step(spark, lats(4)).withColumn("variable", F.upper("variable"))
    report = validation_report(data.unionByName(data.where("variable = 'SP'")), "step", spec=SPEC).first()
    assert [(d["variable"], d["duplicate_points"]) for d in report["duplicate_points_by_channel"]] == [("sp", 16)]
    assert not report["ok"] and not report["missing_channels"]


def test_missing_columns_end_a_report_early(spark):
    report = validation_report(step(spark, lats(4)).drop("isobaricInhPa", "run"), "step").first()
    assert report["missing_columns"] == ["run", "isobaricInhPa|isobaricinhpa"] and report["row_count"] == 320


def test_contracts(spark):
    data = step(spark, lats(2))
    with pytest.raises(ContractError, match="a, b"):
        require_columns(data, ["b", "a", "step"])
    with pytest.raises(ContractError):
        normalise_level(data.drop("isobaricInhPa"))
    with pytest.raises(ValueError):
        check_policy("drop_both")
    low = data.withColumnRenamed("isobaricInhPa", "isobaricinhpa")
    assert snapshot(low, "u", 1000.0).count() == 8


def test_statistics_ignore_nan_and_keep_infinity(spark):
    values = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "value DOUBLE")
    row = value_statistics(values).first()
    assert (row["min"], row["max"], row["mean"], row["nan_count"], row["finite"]) == (1.0, 3.0, 2.0, 1, False)
    assert row["std"] == pytest.approx(0.816497, abs=1e-6)
    wild = value_statistics(values.unionByName(spark.createDataFrame([(float("inf"),)], "value DOUBLE"))).first()
    assert wild["max"] == float("inf")


def test_ordinals_and_quantiles_with_a_hot_value(spark):
    data = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 7.0D, CAST(id AS DOUBLE)) AS value")
    numbered = with_ordinal(data, F.desc("id")).collect()
    assert {r["id"]: r["ordinal"] for r in numbered} == {i: 999 - i for i in range(1000)}
    got = exact_quantiles(data, "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    want = data.toPandas()["value"].quantile([0.25, 0.5, 0.75]).tolist()
    assert list(got) == pytest.approx(want)
