"""Expressions and small helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters separate words.
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; an empty array for none."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda inside ``body`` uses it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key128(*parts: Column) -> Column:
    """16-byte MD5 of the parts; nulls and part borders are told apart."""
    framed = [
        F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.length(p.cast("string")), F.lit(":"), p.cast("string")))
        for p in parts
    ]
    return F.unhex(F.md5(F.concat(*framed)))


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under the operator's own names, so that extra columns cannot clash."""
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut positions ``[low, high)`` so that each slice holds about ``most`` bytes, one row at least."""
    low, total = 0, 0
    for i, size in enumerate(sizes):
        if i > low and total + size > most:
            yield low, i
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def with_row_key(docs: DataFrame, *columns: str, name: str = "_row_key") -> DataFrame:
    """Add a 128-bit key over ``columns``; rows that agree in all of them share it."""
    return docs.withColumn(name, key128(*[F.col(f"`{c}`") for c in columns]))
