"""Abrupt-change classifier over point files: parse, check, score, write in input order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.weather import abrupt_label, abrupt_score, classifier_config
from gridloom.sources.lines import parse_points, quarantine, read_numbered_lines, strict_points


def score_points(points: DataFrame, config: dict | None = None) -> DataFrame:
    """Stateless, so it serves batches and streams alike."""
    return points.withColumns(
        {"label": abrupt_label(F.col("t2m"), config), "score": abrupt_score(F.col("t2m"), config)}
    )


def classify_file(
    spark: SparkSession, path: str, config: dict | None = None, strict: bool = True,
    nan_passes: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Scored rows, and the quarantined rows unless ``strict`` makes the first fault final."""
    parsed = parse_points(read_numbered_lines(spark, path), nan_passes)
    if strict:
        return score_points(strict_points(parsed), config), None
    good, bad = quarantine(parsed)
    return score_points(good, config), bad


def hooked_handler(
    requests: DataFrame, column: str, output_schema: str,
    model: Callable[[], object], parse: Callable, predict: Callable, render: Callable,
) -> DataFrame:
    """Handler made of four hooks, run per Arrow batch: the model loads once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = model()
        for batch in batches:
            yield render(batch, predict(parse(batch[column]), loaded))

    return requests.mapInPandas(run, output_schema)
