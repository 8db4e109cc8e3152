"""Exact duplicates by 128-bit content hash, checked byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import only, text_or_empty
from gridloom.session import materialise


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Rows are grouped by the MD5 of their text and, inside a hash, by the bytes themselves, so two texts that
    collide end in two groups. Copies meet in each task first, before the shuffle, so a text that fills a third of the table
    travels once per task. Only groups of two or more rows are written, without their texts; every row then looks up its
    group by hash and SHA-256 with a join whose row side may be split. Only functions of Spark are used.

    ``keep`` says whether the ``smallest`` or the ``largest`` id of equal texts stays. Null text counts as empty.
    A null id never stays while its group has another one; a group of nulls only keeps them. Rows that repeat an id with its text are
    one document: all of them carry the same values. An empty table gives an empty result; further columns are not read.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    texts = only(docs, doc_id=id_col, text=text_col).select("doc_id", normalise(text_or_empty("text")).alias("text"))
    hashed = texts.withColumn("hash", F.unhex(F.md5("text")))
    groups = materialise(
        hashed.groupBy("hash", "text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1").select("hash", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"),
        "exact",
    )
    rows = hashed.select("doc_id", "hash", F.sha2("text", 256).alias("sha"))
    return rows.join(groups, ["hash", "sha"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
