"""CSV records that cross lines and file splits, as rows with the numbers that a CSV reader gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.session import materialise
from gridloom.sources.lines import read_numbered_lines

#: Fixed value: characters of a field beyond which a CSV reader gives up.
FIELD_LIMIT = 131_072
#: A field that is closed on its line, with the comma before it: in quotes (two of them stand for one), plain, or empty.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_CLOSED = rf',(?:{_QUOTED}|[^",][^,]*+|(?=,|\z))'
_TO_CLOSING = r'^[^"]*+(?:""[^"]*+)*+"[^,]*+'


def ends_inside(line: Column) -> Column:
    """Whether a line that starts between fields ends inside quotes: a quote only opens at the start of a field."""
    return F.regexp_replace(F.concat(F.lit(","), line), _CLOSED, ",?").contains(',"')


def still_inside(line: Column) -> Column:
    """The same for a line that starts inside quotes."""
    return F.when(~line.rlike(_TO_CLOSING), F.lit(True)).otherwise(ends_inside(F.concat(F.lit("?"), F.regexp_replace(line, _TO_CLOSING, ""))))


def read_csv_records(spark: SparkSession, path: str, limit: int = FIELD_LIMIT) -> DataFrame:
    """``row_number, line, error``: the records of all files of ``path``, a line break inside quotes kept in its record.

    A line maps the two states, between fields and inside quotes, to two states. These maps are composed along the lines: a line that maps both to one state settles it, one that swaps them flips it. Runs are composed
    inside blocks of lines, then over the blocks (a row each), so no task reads another's lines.

    A record of more than ``limit`` characters, as an unclosed quote makes it, is not gathered: its line is null and ``error`` says so. A quote that is open at the end of a file closes there.
    """
    numbered = read_numbered_lines(spark, path, keep=("_file", "_start"))
    states = numbered.select("*", ends_inside(F.col("line")).alias("_a"), still_inside(F.col("line")).alias("_b"))
    flips = (F.col("_a") & ~F.col("_b")).cast("int")
    settles = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("int"))
    block = Window.partitionBy("_file", "_start").orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    # the settled state, as it would have been before all flips of the block so far
    local = states.withColumn("_flips", F.sum(flips).over(block)).withColumn("_key", (settles + F.col("_flips")) % 2)
    local = materialise(local.withColumn("_key", F.last("_key", ignorenulls=True).over(block)), "quotes")
    ends = local.groupBy("_file", "_start").agg(F.max("_flips").alias("_all"), F.max_by("_key", "row_number").alias("_last"), F.min("row_number").alias("_n"))
    by_file = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_total", F.sum("_all").over(by_file)).withColumn("_settled", (F.col("_last") + F.col("_total") - F.col("_all")) % 2)
    ends = ends.withColumn("_settled", F.last("_settled", ignorenulls=True).over(by_file))
    out = ends.withColumn("_out", (F.coalesce("_settled", F.lit(0)) + F.col("_total")) % 2)
    came = F.lag("_out", 1, 0).over(Window.partitionBy("_file").orderBy("_start"))
    before = materialise(out.select("_file", "_start", came.alias("_in")), "quote-blocks")
    joined = local.join(before, ["_file", "_start"])
    after = (F.coalesce("_key", "_in") + F.col("_flips")) % 2
    inside = F.lag(after, 1).over(Window.partitionBy("_file", "_start").orderBy("row_number"))
    opened = joined.withColumn("_open", F.coalesce(inside, F.col("_in")))
    # records are numbered by the lines that start one
    starts = F.sum(1 - F.col("_open")).over(block)
    counted = materialise(opened.withColumn("_nth", starts), "records")
    sizes = counted.groupBy("_file", "_start").agg(F.max("_nth").alias("_records"), F.min("row_number").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_records").over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a block
    placed = counted.join(F.broadcast(offsets.select("_file", "_start", "_before")), ["_file", "_start"])
    lines = materialise(placed.select((F.col("_nth") + F.col("_before")).alias("record"), F.col("row_number").alias("_n"), "line"), "record-lines")
    long = lines.groupBy("record").agg((F.sum(F.length("line")) + F.count("*") - 1).alias("_chars")).where(F.col("_chars") > limit).select("record")
    whole = lines.join(long, "record", "left_anti").groupBy("record").agg(F.sort_array(F.collect_list(F.struct("_n", "line"))).alias("_l"))
    good = whole.select(F.col("record").alias("row_number"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("line"), F.lit(None).cast("string").alias("error"))
    bad = long.select(F.col("record").alias("row_number"), F.lit(None).cast("string").alias("line"), F.lit(f"field larger than field limit ({limit})").alias("error"))
    return good.unionByName(bad)
