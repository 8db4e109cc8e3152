"""Cases that once lost, cut or misjudged data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.extract import ContractError
from gridloom.operators.nearest import build_index, lookup, nearest_point
from gridloom.operators.tensor import grouped_tensor_rows, normalise_rows, statistics_fault
from gridloom.plans import requests as R
from gridloom.plans.predict import load_predictor
from gridloom.plans.train import train_knn
from gridloom.schema import GridSpec
from gridloom.session import scratch_path
from gridloom.sources import lines as L
from gridloom.sources import tidy as S
from gridloom.sources import writers as K

SPARSE = GridSpec(lat_count=None, lon_count=3, lon_step=120.0, lon_start=0.0)


def test_numbered_lines_survive_other_splits(spark):
    path = scratch_path(spark, "text")
    spark.range(20_000).repartitionByRange(4, "id").sortWithinPartitions("id").select(
        F.format_string("line %07d", "id").alias("value")).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        numbered = L.read_numbered_lines(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = numbered.orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == list(range(1, 20_001))
    assert [r["line"] for r in rows] == [f"line {k:07d}" for k in range(20_000)]


def test_part_files_are_ordered_by_number(spark, tmp_path):
    for k in (99_999, 100_000):
        (tmp_path / f"part-{k}-x.txt").write_text(f"{k}\n")
    lines = L.read_numbered_lines(spark, str(tmp_path)).orderBy("row_number").collect()
    assert [r["line"] for r in lines] == ["99999", "100000"]


def test_training_table_reads_back_whole(spark):
    path = scratch_path(spark, "train")
    rows = spark.range(1000).select(F.col("id").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(2.0).alias("value"))
    K.write_training(rows.repartition(4), path, "all")
    assert S.read_training_csv(spark, path).count() == 1000
    assert spark.read.json(f"{path}/metadata.json").first()["row_count"] == 1000
    with pytest.raises(ContractError):
        K.write_training(rows.limit(0), scratch_path(spark, "train"), "none")
    plain = scratch_path(spark, "plain")
    rows.repartition(3).write.option("header", True).csv(plain)
    assert S.read_training_csv(spark, plain).count() == 1000


def grid(spark, lats, lons):
    rows = [(i, float(a), float(b), float(i)) for i, (a, b) in enumerate((a, b) for a in lats for b in lons)]
    return spark.createDataFrame(rows, "grid_id BIGINT, lat DOUBLE, lon DOUBLE, value DOUBLE"), rows


def test_any_position_and_many_neighbours(spark):
    model, rows = grid(spark, np.arange(0, 20), np.arange(0, 20))
    probes = [(0, 1000.0, 3.0), (1, -5e6, 2e6), (2, 10.2, 10.1), (3, 511.9, -512.0)]
    frame = spark.createDataFrame(probes, "pid INT, lat DOUBLE, lon DOUBLE")
    hits = {r["pid"]: [h["grid_id"] for h in r["hits"]] for r in lookup(frame, build_index(model, 80)).collect()}
    for pid, lat, lon in probes:
        best = sorted(rows, key=lambda r: ((r[1] - lat) ** 2 + (r[2] - lon) ** 2, r[0]))[:80]
        assert hits[pid] == [r[0] for r in best]


def test_wrapped_index_stays_wrapped_off_the_map(spark):
    model = spark.createDataFrame([(0, 0.0, -170.0, 1.0), (1, 0.0, 175.0, 2.0)], "grid_id BIGINT, lat DOUBLE, lon DOUBLE, value DOUBLE")
    probes = spark.createDataFrame([(0, 0.0, 190.0), (1, 95.0, 529.0), (2, 0.0, 900.0)], "pid INT, lat DOUBLE, lon DOUBLE")
    found = nearest_point(probes, build_index(model, wrap=True))
    assert {r["pid"]: r["grid_id"] for r in found.collect()} == {0: 0, 1: 1, 2: 1}


def test_served_model_keeps_its_neighbours(spark):
    model, _rows = grid(spark, range(10), range(10))
    trained, metrics = train_knn(model, 3)
    path = scratch_path(spark, "model")
    trained.write.parquet(path)
    assert load_predictor(spark, path).regression.k == 3 == metrics.first()["n_neighbors"]
    other = scratch_path(spark, "model")
    trained.drop("n_neighbors").write.parquet(other)
    with pytest.raises(ContractError):
        load_predictor(spark, other)


STATS = "channel_index INT, mean DOUBLE, std DOUBLE"


def test_statistics_must_hold_each_channel_once(spark):
    good = [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    tensor = spark.createDataFrame([("a", c, 0, [1.0]) for c in range(3)], "tensor_uri STRING, channel_index INT, lat_index INT, values ARRAY<FLOAT>")
    assert statistics_fault(spark.createDataFrame(good, STATS), 2) is None
    for bad in (good[:1], [*good, good[0]], [good[0], (1, None, 4.0)]):
        assert statistics_fault(spark.createDataFrame(bad, STATS), 2)
    with pytest.raises(ContractError):
        normalise_rows(tensor, spark.createDataFrame(good[:1], STATS), 2)
    with pytest.raises(Exception, match="no statistics for channel 2"):
        normalise_rows(tensor, spark.createDataFrame(good, STATS), 2).collect()


def reports(spark, monkeypatch, model, stats=((0, 0.0, 1.0), (1, 0.0, 1.0)), name="picky"):
    monkeypatch.setattr(R, "GUARD_ELEMENTS", 10)
    shapes = {"good": (2, 1, 3), "large": (2, 2, 3), "wrong": (1, 1, 3), "unnamed": (2, 1, 3)}
    rows = [(n, c, a, [1.0] * w) for n, (cs, rows, w) in shapes.items() for c in range(cs) for a in range(rows)]
    tensors = spark.createDataFrame(rows, "tensor_uri STRING, channel_index INT, lat_index INT, values ARRAY<FLOAT>")
    asked = [(n, "forward", n, "", True, None) for n in ("good", "large", "wrong", "missing")] + [("meta", "metadata_only", "large", "", True, None)]
    requests = spark.createDataFrame(
        asked, "request_id STRING, mode STRING, input_s3_uri STRING, output_s3_uri STRING, max_runtime_guard BOOLEAN, error STRING")
    out = R.request_reports(requests, tensors, spark.createDataFrame(list(stats), STATS), timestamp_utc="t", model=model, model_name=name, grid=(2, 1, 3))
    return {r["request_id"]: (r["ok"], r["result"], r["reason"]) for r in out.collect()}


def picky_loader():
    """Made here, so that it travels by value to workers that cannot import this file."""
    def load():
        def run(tensor):
            assert tensor.shape == (2, 1, 3), "the model saw a refused tensor"
            return tensor * 2

        return run

    return load


def test_only_accepted_tensors_reach_the_model(spark, monkeypatch):
    assert reports(spark, monkeypatch, picky_loader()) == {
        "good": (True, "forward_succeeded", None),
        "large": (False, "forward_failed", "runtime_guard_blocked_large_tensor"),
        "wrong": (False, "forward_failed", "input_shape_mismatch"),
        "missing": (False, "prediction_failed", None),
        "meta": (True, "metadata_collected", None),
    }


def test_a_failing_model_is_reported(spark, monkeypatch):
    def broken():
        raise OSError("no such checkpoint")

    got = reports(spark, monkeypatch, broken, name="broken")
    assert got["good"] == (False, "forward_failed", "forward_execution_failed")
    assert got["wrong"][2] == "input_shape_mismatch" and got["meta"][0]


def test_one_refused_tensor_fails_its_own_request_only(spark):
    def no_threes():
        def run(tensor):
            if (tensor == 3).any():
                raise ZeroDivisionError("a three")
            return tensor[:, :, ::-1] + 1

        return run

    rows = [(f"t{k}", c, a, [float(k), float(a), float(c)]) for k in (1, 2, 3, 4) for c in range(2) for a in (1, 0)]
    tensors = spark.createDataFrame(rows, "tensor_uri STRING, channel_index INT, lat_index INT, values ARRAY<FLOAT>").repartition(4)
    asked = [(f"{t}{n}", "forward", t, "", True, None) for t in ("t1", "t2", "t3", "t4") for n in "ab"]
    requests = spark.createDataFrame(
        asked, "request_id STRING, mode STRING, input_s3_uri STRING, output_s3_uri STRING, max_runtime_guard BOOLEAN, error STRING")
    stats = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.0, 1.0)], STATS)
    # channel 1 of t3 holds 3 / 1, channel 0 of it (3 - 1) / 2
    got = {r["request_id"]: r for r in R.request_reports(requests, tensors, stats, timestamp_utc="t", model=no_threes, model_name="no_threes", grid=(2, 2, 3)).collect()}
    assert {k: r["ok"] for k, r in got.items()} == {f"{t}{n}": t != "t3" for t in ("t1", "t2", "t3", "t4") for n in "ab"}
    bad, good = got["t3a"]["forward"], got["t1b"]["forward"]
    assert (bad["reason"], bad["error_type"], bad["error_message"], bad["output_shape"]) == ("forward_execution_failed", "ZeroDivisionError", "a three", None)
    assert (good["ok"], good["reason"], good["output_shape"], good["input_shape"]) == (True, None, [1, 2, 2, 3], [1, 2, 2, 3])
    shifted = [v + (2 if c == 0 else 1) for t, c, _, vs in rows if t == "t1" for v in vs]
    assert len(shifted) == 12 and got["t1a"]["output_stats"]["mean"] == pytest.approx(sum(shifted) / 12)
    assert got["t1a"]["stats"]["global_stds"]["max"] == 2.0 and got["t1a"]["stats"]["global_means"]["shape"] == [1, 2, 1, 1]


def test_faulty_statistics_are_reported(spark, monkeypatch):
    got = reports(spark, monkeypatch, picky_loader(), stats=((0, 0.0, 1.0),))
    assert got["good"] == (False, "prediction_failed", None) and got["meta"][0]


def test_grouped_tensors_keep_surface_levels_and_places(spark):
    rows = [(None, 0.0), (float("nan"), 120.0), (0.0, 240.0)]
    df = spark.createDataFrame([(lv, 1.0, lon, "msl", 5.0 + i) for i, (lv, lon) in enumerate(rows)] + [(None, 2.0, 120.0, "msl", 9.0), (None, 2.0, 0.0, "msl", float("nan"))],
                               "isobaricInhPa DOUBLE, latitude DOUBLE, longitude DOUBLE, variable STRING, value DOUBLE")
    got = {r["latitude"]: (r["values"], r["complete"]) for r in grouped_tensor_rows(df, spec=SPARSE).collect()}
    assert got == {1.0: ([5.0, 6.0, 7.0], True), 2.0: ([None, 9.0, None], False)}


def test_catalog_hours_and_empty_snapshots(spark):
    rows = "isobaricInhPa DOUBLE, latitude DOUBLE, longitude DOUBLE, variable STRING, value FLOAT, year STRING, month STRING, day STRING, hour STRING"
    for hour in ("18", "18z"):
        spark.createDataFrame([(1000.0, 1.0, 2.0, "t", 3.0, "2026", "04", "09", hour)], rows).createOrReplaceTempView("gl_hours")
        assert S.catalog_snapshot(spark, "gl_hours", "2026", "04", "09", "18z").count() == 1
    with pytest.raises(ContractError):
        S.catalog_snapshot(spark, "gl_hours", "2026", "04", "10", "18")


def test_own_sink_keeps_a_step_together(spark):
    rows = spark.range(64).select(
        F.lit(None).cast("double").alias("isobaricInhPa"), F.col("id").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"),
        F.lit("t2m").alias("variable"), F.lit(1.0).cast("float").alias("value"), F.lit("20260409").alias("date"), F.lit("18z").alias("run"),
        (F.col("id") % 2).cast("int").alias("step"))
    path = K.write_tidy(rows.repartition(8), scratch_path(spark, "tidy"), "step")
    keys = S.read_tidy(spark, path).select("step_key").distinct().collect()
    assert len(keys) == 2
