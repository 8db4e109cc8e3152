"""Row numbers, running counts and exact quantiles without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialise

_SEQ_MASK = (1 << 33) - 1


def _slice_offsets(slices: DataFrame) -> DataFrame:
    """Exclusive running total over the slices: one row per task of the sort, so it stays small."""
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select(
        "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Add 0-based positions in ``order``.

    Range partitions are numbered locally and shifted by the sizes of the partitions before
    them, so no task ever sees more than its own range. The order should be total.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialise(
        ranged.select(
            "*",
            F.spark_partition_id().alias("_slice"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_SEQ_MASK)).alias("_seq"),
        ),
        "ordinal",
    )
    sizes = numbered.groupBy("_slice").agg(F.count("*").alias("_size"))
    return (
        numbered.join(F.broadcast(_slice_offsets(sizes)), "_slice")
        .withColumn(name, F.col("_seq") + F.col("_offset"))
        .drop("_slice", "_seq", "_offset")
    )


def running_counts(df: DataFrame, column: str) -> DataFrame:
    """Per distinct value: its row count ``n`` and ``upto``, the rows with a value at most it.

    Equal values are counted before the sort, so a value that fills a third of the table is one row.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ranged = materialise(
        counts.repartitionByRange(column).withColumn("_slice", F.spark_partition_id()), "quantile"
    )
    sizes = ranged.groupBy("_slice").agg(F.sum("n").alias("_size"))
    local = Window.partitionBy("_slice").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_local", F.sum("n").over(local))
        .join(F.broadcast(_slice_offsets(sizes)), "_slice")
        .select(column, "n", (F.col("_local") + F.col("_offset")).alias("upto"))
    )


def exact_quantiles(df: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    """One row with linearly interpolated quantiles, exact at any size."""
    ranks = running_counts(df, column)
    total = ranks.agg(F.max("upto")).first()[0] or 0

    def value_at(position: int) -> Column:
        hit = (F.col("upto") - F.col("n") <= position) & (F.col("upto") > position)
        return F.max(F.when(hit, F.col(column).cast("double")))

    exprs = []
    for name, q in points.items():
        spot = q * max(total - 1, 0)
        low = int(spot)
        share = spot - low
        value = value_at(low)
        if share > 0:
            value = value + (value_at(low + 1) - value) * F.lit(share)
        exprs.append(value.alias(name))
    return ranks.agg(*exprs)
