"""Steps that arrive in parts: a stateful stream releases a step when all parts are there, or reports it at a wait limit."""

from __future__ import annotations

import pickle
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.sources.tidy import step_key

#: Parts of a step; a file outside ``dataset=`` folders is a step of its own.
PARTS = ("surface", "upper")
#: Fixed value: seconds that a job waits for an object before it gives up.
WAIT_SECONDS = 600
#: Seconds for which a decided step is remembered, so that a file behind the decision is told from a new step.
REMEMBER_SECONDS = 7 * 24 * 3600

#: Steps share states by hash, since a call of Python for each step costs far more than the step: with fewer steps nearly each has one of its own, with millions some hundred share one.
BUCKETS = 1 << 15

_STATE = "steps binary"
#: A key travels as JSON text, exact for each type: nulls stay, and numbers beyond 2**53 keep their digits.
_KEY_TEXT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def step_files(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream with one row per landed file: ``step, part, arrived``. Only names and times are read."""
    reader = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY").option(
        "recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = F.col("path")
    part = F.when(path.contains("/dataset="), F.regexp_extract(path, "/dataset=([^/]*)/", 1)).otherwise("whole")
    return reader.load(landing).select(step_key(path).alias("step"), part.alias("part"), F.col("modificationTime").alias("arrived"))


def await_parts(
    arrivals: DataFrame, *keys: str, parts: tuple[str, ...] = PARTS, wait: int = WAIT_SECONDS, remember: int = REMEMBER_SECONDS, out_of_order: int = 0, buckets: int = BUCKETS
) -> DataFrame:
    """``keys, status, missing, first_arrival, decided_at, files``, from a stream of ``keys, part, arrived``.

    ``complete``: all parts (or one ``whole`` file) came within ``wait`` seconds of the first; decided when the last of them came. ``incomplete``: the limit passed before; decided at the limit, as soon as the
    stream's time is beyond it. ``late``: a file of a step that was decided before. Time is that of the arrivals: the latest one seen, less ``out_of_order`` seconds, so the result does not
    depend on when the stream runs. Repeated files of a part count once for completeness. Arrivals that come more than ``out_of_order`` seconds behind the latest one
    of an earlier batch (or before 1970) are taken for lost by the stream, so a landing folder that several clocks write needs a larger allowance.

    A step's state is four numbers and its next time of action; decided steps are forgotten ``remember`` seconds after their first file. The steps of a bucket are one state of the stream, which is
    rewritten when one of them changes; ``buckets`` stays the same over the life of a checkpoint.
    """
    wanted, limit, keep = set(parts), wait * 1000, remember * 1000

    def decide(_bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps = pickle.loads(state.get[0]) if state.exists else {}  # key: first, here, decided, files, timer
        now, rows = state.getCurrentWatermarkMs(), []
        came = defaultdict(list)
        if not state.hasTimedOut:
            for batch in batches:
                for key, at, part in zip(batch["_key"], batch["arrived"].astype("datetime64[ms]").astype("int64").tolist(), batch["part"]):
                    came[key].append((at, part))

        def say(key: str, status: str, here: str, first: int, at: int, files: int) -> None:
            lacks = "" if status == "complete" or "whole" in here.split(",") else ",".join(sorted(wanted.difference(here.split(","))))
            rows.append((key, status, lacks, first, at, files))

        for key in [k for k, step in steps.items() if step[4] < now and k not in came]:
            first, here, decided, files, _timer = steps.pop(key)
            if decided is None:
                decided = first + limit
                say(key, "incomplete", here, first, decided, files)
                steps[key] = (first, here, decided, files, max(first + keep, now + 1))
        for key, arrived in came.items():
            first, here, decided, files, _timer = steps.get(key, (None, "", None, 0, 0))
            for at, part in sorted(arrived):
                if first is None:
                    first = at
                if decided is None and at > first + limit:
                    decided = first + limit
                    say(key, "incomplete", here, first, decided, files)
                files += 1
                if decided is not None:
                    say(key, "late", here, first, at, files)
                    continue
                here = sys.intern(",".join(sorted({*here.split(","), part} - {""})))
                if part == "whole" or wanted <= set(here.split(",")):
                    decided = at
                    say(key, "complete", here, first, at, files)
            if decided is None and first + limit < now:
                decided = first + limit  # time is beyond the limit already
                say(key, "incomplete", here, first, decided, files)
            steps[key] = (first, here, decided, files, max(first + (limit if decided is None else keep), now + 1))
        if steps:
            state.update((pickle.dumps(steps, pickle.HIGHEST_PROTOCOL),))
            state.setTimeoutTimestamp(max(min(step[4] for step in steps.values()), now + 1))
        else:
            state.remove()
        if rows:
            said = dict(zip(("_key", "status", "missing", "first_arrival", "decided_at", "files"), map(list, zip(*rows))))
            times = {c: np.array(said[c], dtype="datetime64[ms]").astype("datetime64[ns]") for c in ("first_arrival", "decided_at")}
            yield pd.DataFrame(said | times)

    timed = arrivals.withWatermark("arrived", f"{out_of_order} seconds")
    kinds = arrivals.select(*keys).schema
    # as in a grouping, minus zero is zero
    plain = [(F.col(k) + F.lit(0).cast(kinds[k].dataType)).alias(k) if kinds[k].dataType.typeName() in ("float", "double") else F.col(k) for k in keys]
    dealt = timed.select(F.pmod(F.xxhash64(*plain), F.lit(buckets)).cast("int").alias("_bucket"), F.to_json(F.struct(*plain), _KEY_TEXT).alias("_key"), "part", "arrived")
    decided = dealt.groupBy("_bucket").applyInPandasWithState(
        decide, "_key string, status string, missing string, first_arrival timestamp, decided_at timestamp, files long", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return decided.withColumn("_key", F.from_json("_key", kinds, _KEY_TEXT | {"mode": "FAILFAST"})).select("_key.*", "status", "missing", "first_arrival", "decided_at", "files")


def decide_arrivals(decisions: DataFrame, target: str, log: str) -> StreamingQuery:
    """Append the decisions to a Parquet table, each once."""
    return (
        decisions.writeStream.format("parquet").option("path", target).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    )
