"""Commits of reports, tensors and manifest: what a reader sees when a writer stops anywhere between."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gridloom.session import list_folders, scratch_path, scratch_scope
from gridloom.sources import commits
from gridloom.streaming import ingest

ROWS = "channel_index INT, lat_index INT, values ARRAY<FLOAT>"
STEPS = (
    "step INT, latitude_policy STRING, allow_incomplete BOOLEAN, tensor_written BOOLEAN, tensor_write_reason STRING, tensor_shape ARRAY<INT>, tensor_dtype STRING"
)


def job(spark, states):
    """A finished tensor job; ``states`` has, by step, the value of its tensor or None for a bad one."""
    steps = [(k, "fail", True, v is not None, "validation_failed" if v is None else "written", None if v is None else [1, 1, 1, 2], None if v is None else "float32") for k, v in states.items()]
    tensors = [(k, 0, 0, [float(v), float(v)]) for k, v in states.items() if v is not None]
    return SimpleNamespace(
        steps=spark.createDataFrame(steps, STEPS), tensors=spark.createDataFrame(tensors, f"step INT, {ROWS}"),
        reports=spark.createDataFrame([(k, v is not None, 7) for k, v in states.items()], "step INT, ok BOOLEAN, row_count LONG"),
    )


def seen(spark, base):
    tensors = {r["step"]: r["values"][0] for r in commits.read_published(spark, base, ROWS, step="INT").collect()}
    reports = {r["step"]: r["ok"] for r in commits.read_reports(spark, base, "step INT, ok BOOLEAN", step="INT").collect()}
    return tensors, reports


def test_a_reader_sees_old_or_new_together(spark, monkeypatch):
    base = scratch_path(spark, "published")
    assert commits.publish_job(job(spark, {1: 10, 2: 20, 3: None}), base, 0, "step")
    old = ({1: 10.0, 2: 20.0}, {1: True, 2: True, 3: False})
    assert seen(spark, base) == old
    after = job(spark, {1: 11, 2: None, 3: 30})

    def stop(*_args, **_kwargs):
        raise KeyboardInterrupt("killed")

    with monkeypatch.context() as broken:  # between the tables
        reports = after.reports
        broken.setattr(type(after.tensors), "hint", stop)
        with pytest.raises(KeyboardInterrupt):
            commits.publish_job(after, base, 1, "step")
        assert reports is after.reports
    assert seen(spark, base) == old
    with monkeypatch.context() as broken:  # behind both, before the commit
        broken.setattr(commits, "write_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            commits.publish_job(after, base, 1, "step")
    assert seen(spark, base) == old and not commits.is_committed(spark, base, 1)

    assert commits.next_commit(spark, base) == 1
    assert commits.publish_job(after, base, 1, "step")
    new = ({1: 11.0, 3: 30.0}, {1: True, 2: False, 3: True})
    assert seen(spark, base) == new
    assert not commits.publish_job(job(spark, {1: 99}), base, 1, "step")  # sent again
    assert seen(spark, base) == new

    left = {name for table in ("tensors", "reports") for name in list_folders(spark, f"{base}/{table}")}
    assert len(left) == 4
    gone = commits.sweep(spark, base, step="INT")
    assert len(gone) == 3 and seen(spark, base) == new and commits.sweep(spark, base, step="INT") == []


def test_a_number_is_taken_once(spark):
    base = scratch_path(spark, "published")
    assert commits.next_commit(spark, base) == 0
    commits.publish_job(job(spark, {1: 10}), base, 5, "step")
    assert commits.next_commit(spark, base) == 6
    with pytest.raises(Exception, match="already exists"):
        commits.write_commit(commits.commit_records(job(spark, {1: 1}).steps, None, "x", "step"), base, 5)


def test_literals_only_for_few_keys(spark, monkeypatch):
    path = scratch_path(spark, "tidy")
    spark.range(100).select((F.col("id") % 20).cast("int").alias("step"), "id").write.partitionBy("step").parquet(path)
    table = spark.read.schema("id LONG, step INT").parquet(path)
    touched = spark.createDataFrame([(3,), (4,), (None,)], "step INT")
    for most in (1000, 1):
        monkeypatch.setattr(ingest, "LITERAL_KEYS", most)
        found = ingest.touched_rows(table, touched, "step")
        assert sorted(r["id"] for r in found.collect()) == sorted(k for k in range(100) if k % 20 in (3, 4))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("step" in plan.split("PartitionFilters: [")[1].split("]")[0] and " IN (3,4)" in plan) == (most == 1000)


def test_scratch_tables_go_with_their_scope(spark):
    with scratch_scope(spark):
        path = scratch_path(spark, "scoped")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
