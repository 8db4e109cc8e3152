"""Footers, file skipping, digests of large files, partitions and contract documents."""

import hashlib
import io
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.operators import contract, documents
from gridloom.operators.profile import zone_map
from gridloom.schema import TIDY
from gridloom.session import scratch_path
from gridloom.sources import files
from gridloom.sources import writers as K
from workload.views import Views


@pytest.fixture(scope="module")
def tidy(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, small as the table is
    try:
        return K.write_tidy(Views(spark, "/root/testdata/sf0.001").forecast, scratch_path(spark, "tidy"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_footer_bounds_are_those_of_a_scan(spark, tidy):
    bounds = [f"{c}_{side}" for c in files.ZONE_COLUMNS for side in ("min", "max")]
    by_file = [F.min(b).alias(b) if b.endswith("min") else F.max(b).alias(b) for b in bounds]
    read = files.footer_zones(spark, tidy).groupBy("file_path").agg(F.sum("n_rows").alias("n_rows"), *by_file).collect()
    scanned = zone_map(spark.read.schema(TIDY).parquet(tidy)).groupBy("file_path").agg(F.sum("n_rows").alias("n_rows"), *by_file).collect()
    plain = lambda rows: {r["file_path"].split(":")[-1].lstrip("/"): tuple(r)[1:] for r in rows}
    assert plain(read) == plain(scanned) and len(read) > 1


def test_a_footer_costs_little_of_its_file(tmp_path, monkeypatch):
    where = str(tmp_path / "large.parquet")
    n = 400_000
    pq.write_table(pa.table({"variable": ["t"] * n, "latitude": [k * 0.37 for k in range(n)], "noise": os.urandom(8 * n).hex()[:n] and [os.urandom(16) for _ in range(n)]}), where, row_group_size=50_000)

    class Counted(io.FileIO):
        taken = 0

        def read(self, size=-1):
            got = super().read(size)
            Counted.taken += len(got)
            return got

        def readinto(self, buffer):
            got = super().readinto(buffer)
            Counted.taken += got
            return got

    monkeypatch.setattr(files, "open_file", lambda path: Counted(path))
    batch = pa.record_batch([pa.array([where])], names=["path"])
    rows = [r for b in files._footers(files.ZONE_COLUMNS)(iter([batch])) for r in b.to_pylist()]
    assert [r["n_rows"] for r in rows] == [50_000] * 8 and rows[3]["latitude_min"] == 150_000 * 0.37
    assert rows[0]["isobaricInhPa_min"] is None  # not in the file
    assert 0 < Counted.taken < os.path.getsize(where) / 50


def test_only_matching_files_are_planned(spark, tidy):
    zones = files.footer_zones(spark, tidy)
    every = spark.read.schema(TIDY).parquet(tidy)
    some = files.scan_matching(spark, tidy, TIDY, zones, variable="z", isobaricInhPa=500.0)
    want = every.where("variable = 'z' and isobaricInhPa = 500.0")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect())) and some.count() > 0
    assert 0 < len(some.inputFiles()) < len(every.inputFiles())
    assert {r["year"] for r in some.select("year").distinct().collect()} == {"2026"}
    nothing = files.scan_matching(spark, tidy, TIDY, zones, variable="z", latitude=(200.0, 300.0))
    assert nothing.count() == 0 and nothing.columns == every.columns
    unknown = zones.withColumn("variable_min", F.lit(None).cast("string"))
    assert files.matching_files(unknown, variable="none").count() == len(every.inputFiles())


def test_files_of_any_size_are_hashed(spark, tmp_path):
    large, small = tmp_path / "a" / "large.bin", tmp_path / "small.bin"
    large.parent.mkdir()
    with open(large, "wb") as f:
        f.truncate(3 << 30)  # sparse: takes no room
    small.write_bytes(b"abc")
    got = {r["path"].rsplit("/", 1)[1]: (r["size_bytes"], r["sha256"]) for r in contract.asset_inventory(spark, str(tmp_path)).collect()}
    zeros, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(3 << 10):
        zeros.update(block)
    assert got == {"large.bin": (3 << 30, zeros.hexdigest()), "small.bin": (3, hashlib.sha256(b"abc").hexdigest())}


def test_touched_partitions_equal_a_full_repair(spark):
    from gridloom.schema import PREDICTION_PARTITIONS, prediction_schema

    path = scratch_path(spark, "predictions")
    rows = [{"prediction_id": str(k), "year": "2026", "month": "04", "day": "09", "hour": f"{k % 3:02d}", "model_name_partition": "it's", "model_version_partition": "v=1"} for k in range(9)]
    every = spark.createDataFrame(rows, prediction_schema())
    K.write_predictions(every, path)
    one, all_ = (f"gl_parts_{path.rsplit('-', 1)[-1]}_{k}" for k in "ab")
    K.create_prediction_table(spark, one, path, discover=False)
    assert spark.table(one).count() == 0
    assert K.register_partitions(spark, one, every.where("hour <> '02'")) == 2
    assert K.register_partitions(spark, one, every.where("hour <> '02'")) == 2  # again
    assert spark.table(one).count() == 6
    K.register_partitions(spark, one, every)
    K.create_prediction_table(spark, all_, path)
    parts = lambda t: sorted(tuple(r) for r in spark.table(t).select(*PREDICTION_PARTITIONS, "prediction_id").collect())
    assert parts(one) == parts(all_) and len(parts(one)) == 9


def test_contract_documents_with_several_faults(spark):
    good = {"inputContentType": "CSV", "outputContentType": "CSV", "version": "v1", "input": [{"name": "lat", "type": "DECIMAL", "nullable": False}], "output": []}
    cases = {
        "good": (good, set()),
        "empty": ({}, {("", k, "missing_key") for k in ("inputContentType", "outputContentType", "input", "output", "version")}),
        "kinds": ({**good, "version": 3, "instanceCount": "two", "output": None}, {("version", "version", "wrong_kind"), ("instanceCount", "instanceCount", "wrong_kind"), ("output", "output", "wrong_kind")}),
        "fields": ({**good, "input": [{"name": "n" * 101, "kind": 1}, 5, [], {"type": 7, "name": "lat"}], "output": [{"name": "lat", "type": "INTEGER"}] * 2}, {
            ("input[0]", "name", "too_long"), ("input[0]", "kind", "extra_key"), ("input[0]", "type", "missing_key"), ("input[1]", "", "not_an_object"),
            ("input[2]", "", "not_an_object"), ("input[3]", "type", "unknown_value"), ("output", "name", "duplicate_name")}),
        "instances": ({**good, "instanceTypes": ["ml.m5.large", "big"], "defaultInstanceType": "ml.m4.xlarge", "instanceCount": 0, "description": "d" * 1001}, {
            ("instanceTypes[1]", "", "unknown_value"), ("defaultInstanceType", "defaultInstanceType", "not_listed"), ("instanceCount", "instanceCount", "too_small"),
            ("description", "description", "too_long")}),
        "no list": ({**good, "defaultInstanceType": "anything"}, set()),
    }
    rows = [(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("text", "{bad"), ("list", "[1]"), ("null", None)]
    got = documents.contract_violations(spark.createDataFrame(rows, "document string, body string").repartition(3)).collect()
    want = {(k, *w) for k, (_, ws) in cases.items() for w in ws} | {(k, "", "", "invalid_json") for k in ("text", "list", "null")}
    assert {(r["document"], r["place"], r["key"], r["rule"]) for r in got} == want and len(got) == len(want)
    assert {r["found"] for r in got if r["rule"] == "duplicate_name"} == {"lat"}
