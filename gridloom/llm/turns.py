"""Turns of conversations: their places, and digests of what a key holds in order. No step needs a conversation in one cell."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import key128
from gridloom.operators.ordinal import with_ordinal
from gridloom.session import materialise


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """``conv, conv_id, place, turn, role, text, same``: rows with their 1-based place in the conversation.

    Conversations are ordered by turn (null first), ties by ``same``, a 128-bit hash of role and text, so that equal rows stand together. ``conv`` is a hash of the id
    that tells a null from every other id. Range partitions are numbered and shifted, so the rows of one long conversation are spread over tasks.
    """
    keyed = rows.select(
        key128(F.col("conv_id")).alias("conv"), "conv_id", "turn", "role", "text", key128(F.col("role"), F.col("text")).alias("same"),
        F.monotonically_increasing_id().alias("_nth"),
    )
    at = with_ordinal(keyed, "conv", F.col("turn").asc_nulls_first(), "same", "_nth", name="_at")
    starts = at.groupBy("conv").agg(F.min("_at").alias("_start"))
    placed = at.join(starts, "conv").withColumn("place", F.col("_at") - F.col("_start") + 1)
    return materialise(placed.select("conv", "conv_id", "place", "turn", "role", "text", "same"), label)


def running_length(turns: DataFrame, label: str) -> DataFrame:
    """``turns`` (``conv, place, chars`` and more) with ``upto``, the characters of the conversation up to this turn.

    Sums run inside range partitions and are shifted by one row per partition, then by one row per conversation.
    """
    sliced = materialise(turns.repartitionByRange("conv", "place").withColumn("_slice", F.spark_partition_id()), f"{label}-sorted")
    inside = Window.partitionBy("_slice").orderBy("conv", "place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("_slice").agg(F.sum("chars").alias("_sum"))  # one row a task
    shifts = totals.select("_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    summed = materialise(
        sliced.withColumn("_run", F.sum("chars").over(inside)).join(F.broadcast(shifts), "_slice")
        .withColumn("_run", F.col("_run") + F.col("_shift")).drop("_slice", "_shift"),
        f"{label}-sums",
    )
    starts = summed.groupBy("conv").agg(F.min(F.col("_run") - F.col("chars")).alias("_start"))
    return materialise(
        summed.join(starts, "conv").withColumn("upto", F.col("_run") - F.col("_start")).drop("_run", "_start"), label
    )


def _digest(separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                piece = piece.encode("utf-8", "surrogatepass")
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(piece)
                else:
                    state.update(separator + piece)
            yield _pairs(done)
        if state:
            yield _pairs([(key, state.hexdigest())])

    return run


def _pairs(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "sha256"])


def ordered_digest(pieces: DataFrame, *order: str, separator: str = "\n") -> DataFrame:
    """``key, sha256``: the SHA-256 of the pieces of each (binary) key, in order, with a separator between them.

    A SHA-256 runs from the first byte to the last, so a key's pieces pass through one task, sorted with spill and hashed as a stream; nothing of them is kept.
    """
    sorted_ = pieces.select("key", *order, "piece").repartition("key").sortWithinPartitions("key", *order)
    return sorted_.select("key", "piece").mapInArrow(_digest(separator.encode()), "key binary, sha256 string")
