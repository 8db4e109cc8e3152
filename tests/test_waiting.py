"""Arrivals with a wait limit, in any order of files and over several runs of the stream."""

import os
from datetime import datetime, timezone

import pytest

from gridloom.session import scratch_path
from gridloom.streaming import waiting

KIND = "step STRING, part STRING, arrived TIMESTAMP"
AT = lambda s: datetime.fromtimestamp(1_000_000 + s, tz=timezone.utc)


def run(spark, files, per_batch):
    """Decisions over a landing folder that gets one file after the other; ``per_batch`` files before each run of the stream."""
    landed, target, log = (scratch_path(spark, x) for x in ("notices", "decisions", "log"))
    for k in range(0, len(files), per_batch):
        for n, rows in enumerate(files[k:k + per_batch]):
            spark.createDataFrame([(s, p, AT(t)) for s, p, t in rows], KIND).coalesce(1).write.mode("append").parquet(landed)
            assert n < per_batch
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(landed)
        waiting.decide_arrivals(waiting.await_parts(stream, "step", out_of_order=50), target, log).awaitTermination()
    rows = spark.read.parquet(target).collect()
    return sorted((r["step"], r["status"], r["missing"], int((r["decided_at"].astimezone(timezone.utc) - AT(0)).total_seconds()), r["files"]) for r in rows)


FILES = [
    [("a", "surface", 0)], [("b", "upper", 10)], [("a", "upper", 30), ("c", "surface", 20)], [("b", "surface", 609)], [("d", "whole", 620)], [("c", "upper", 700)],
    [("e", "surface", 800)], [("e", "surface", 820)], [("f", "upper", 3000)], [("a", "upper", 3001)],
]
WANT = [
    ("a", "complete", "", 30, 2), ("a", "late", "", 3001, 3), ("b", "complete", "", 609, 2), ("c", "incomplete", "upper", 620, 1), ("c", "late", "upper", 700, 2),
    ("d", "complete", "", 620, 1), ("e", "incomplete", "upper", 1400, 2),
]


@pytest.mark.parametrize("per_batch", [len(FILES), 3])
def test_steps_are_released_or_reported_at_the_limit(spark, per_batch):
    assert run(spark, FILES, per_batch) == WANT


def test_order_within_the_allowance_does_not_matter(spark):
    swapped = [FILES[1], FILES[0], [FILES[2][1]], [FILES[2][0]], *FILES[3:]]
    assert run(spark, swapped, 5) == WANT


def test_files_of_a_landing_folder(spark):
    landing, target, log = (scratch_path(spark, x) for x in ("landing", "decisions", "log"))
    for step, part in (("s1", "surface"), ("s1", "upper"), ("s2", "surface"), ("s3", None)):
        folder = f"{landing}/{step}/dataset={part}" if part else f"{landing}/{step}"
        spark.range(3).coalesce(1).write.parquet(folder)
    for base, _, names in os.walk(landing):
        for name in names:
            os.utime(f"{base}/{name}", (2_000_000, 2_000_000) if "/s2" in base else (2_001_000, 2_001_000))
    files = waiting.step_files(spark, landing)
    waiting.decide_arrivals(waiting.await_parts(files, "step"), target, log).awaitTermination()
    got = {(r["step"].rsplit("/", 1)[1], r["status"], r["missing"]) for r in spark.read.parquet(target).collect()}
    assert got == {("s1", "complete", ""), ("s2", "incomplete", "upper"), ("s3", "complete", "")}


BIG = 2**53 + 1


@pytest.mark.parametrize("buckets", [{}, {"buckets": 1}])
def test_many_steps_share_states(spark, buckets):
    """Each batch calls Python once for each bucket, not for each step; keys may be null or large and stay apart."""
    steps = [(None, "x"), (None, None), (BIG, None), (BIG - 1, None), *[(n, f'"{n}"\n') for n in range(3000 if buckets else 40_000)]]
    landed, target, log = (scratch_path(spark, x) for x in ("notices", "decisions", "log"))
    kind = "step LONG, name STRING, part STRING, arrived TIMESTAMP"
    base = spark.createDataFrame(steps, "step LONG, name STRING")
    parts = {0: ("surface", "coalesce(step, 0) >= 0"), 30: ("upper", "coalesce(step, 0) % 2 = 0"), 900: ("upper", "step % 3 = 0"), 5000: ("surface", "step = 8")}
    for second, (part, which) in parts.items():
        base.where(which).selectExpr("*", f"'{part}' AS part", f"timestamp_seconds(1000000 + {second}) AS arrived").coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(kind).parquet(landed)
    query = waiting.decide_arrivals(waiting.await_parts(stream, "step", "name", **buckets), target, log)
    query.awaitTermination()
    want = []
    for step, name in steps:
        whole = (step or 0) % 2 == 0
        want.append((step, name, "complete" if whole else "incomplete", 30 if whole else 600))
        want += [(step, name, "late", second) for second, which in ((900, step is not None and step % 3 == 0), (5000, step == 8)) if which]
    got = [(r["step"], r["name"], r["status"], int((r["decided_at"].astimezone(timezone.utc) - AT(0)).total_seconds())) for r in spark.read.parquet(target).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(kept) <= buckets.get("buckets", len(steps) - 1)
