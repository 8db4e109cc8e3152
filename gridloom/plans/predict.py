"""Predictors as DataFrame -> DataFrame steps, and the canonical prediction table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import feature_snapshot, prediction_key, py_number
from gridloom.functions.weather import mock_temperature, observed_error
from gridloom.operators.extract import ContractError
from gridloom.operators.nearest import NearestIndex, build_index, lookup, DISTANCE_WEIGHTED
from gridloom.operators.contract import model_table_faults
from gridloom.session import materialise
from gridloom.schema import PREDICTION_OPTIONAL, PREDICTION_PARTITIONS, PREDICTION_REQUIRED


class Predictor(Protocol):
    """Adds predicted_value, lat_grid and lon_grid to rows with latitude and longitude."""

    model_name: str
    model_version: str
    method: str
    predicted_units: str
    target_variable: str

    def apply(self, points: DataFrame) -> DataFrame: ...


@dataclass
class MockPredictor:
    """Deterministic stand-in used when no model table exists."""

    model_name: str = "mock_predictor"
    model_version: str = "v0"
    method: str = "mock_passthrough"
    predicted_units: str = "K"
    target_variable: str = "t"

    def apply(self, points: DataFrame) -> DataFrame:
        lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
        return points.withColumns(
            {"predicted_value": mock_temperature(lat, lon), "lat_grid": lat, "lon_grid": lon}
        )


@dataclass
class GridPredictor:
    """Nearest model point, or k-nearest regression when ``regression`` is set.

    The regression may use an index of the training rows only, while the reported grid position
    always comes from all points.
    """

    index: NearestIndex
    regression: NearestIndex | None = None
    model_name: str = "knn_baseline"
    model_version: str = "v1"
    method: str = "nearest_grid_lookup"
    predicted_units: str = "K"
    target_variable: str = "t"

    def apply(self, points: DataFrame) -> DataFrame:
        names = [f"`{c}`" for c in points.columns]
        found = lookup(points, self.index, "latitude", "longitude").selectExpr(
            *names, "hits[0].value AS predicted_value", "hits[0].lat_grid AS lat_grid",
            "hits[0].lon_grid AS lon_grid",
        )
        if self.regression is None:
            return found
        found = materialise(found, "found")  # the second lookup asks for the range of its probes before it joins
        return lookup(found, self.regression, "latitude", "longitude").selectExpr(
            *names, f"{DISTANCE_WEIGHTED} AS predicted_value", "lat_grid", "lon_grid"
        )


@dataclass
class BatchModelPredictor:
    """Any Python model on Arrow batches: ``load`` runs once per task, then maps each batch.

    The loaded callable takes latitude and longitude series and returns the predicted series.
    """

    load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]
    model_name: str
    model_version: str
    method: str = "python_model"
    predicted_units: str = "K"
    target_variable: str = "t"

    def apply(self, points: DataFrame) -> DataFrame:
        fields = [T.StructField(n, T.DoubleType()) for n in ("predicted_value", "lat_grid", "lon_grid")]
        load = self.load

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                yield batch.assign(
                    predicted_value=model(batch["latitude"], batch["longitude"]),
                    lat_grid=batch["latitude"], lon_grid=batch["longitude"],
                )

        return points.mapInPandas(run, T.StructType(points.schema.fields + fields))


def load_predictor(
    spark: SparkSession, model_path: str | None, model_name: str = "knn_baseline",
    model_version: str = "v1", k: int | None = None,
) -> Predictor:
    """Grid predictor of a stored model table, or the mock one if there is none.

    With the mock the given name and version no longer apply, so partitions carry its own. A trained table is served with the
    number of neighbours stored in it, unless ``k`` says otherwise.
    """
    if model_path is None:
        return MockPredictor()
    try:
        model = spark.read.parquet(model_path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return MockPredictor()
        raise
    verdict = model_table_faults(model).first()
    if not verdict["ok"]:
        raise ContractError(f"model table is not usable: {verdict.asDict()}")
    nearest = build_index(model)
    if "for_training" not in model.columns:
        return GridPredictor(nearest, None, model_name, model_version)
    if k is None:
        if "n_neighbors" not in model.columns:
            raise ContractError("a trained model table without n_neighbors needs k")
        k = model.agg(F.max("n_neighbors")).first()[0]
    regression = build_index(model.where("for_training"), k)
    return GridPredictor(nearest, regression, model_name, model_version)


def prediction_frame(
    predicted: DataFrame, predictor: Predictor, *, timestamp_utc: str, source_database: str,
    source_table: str, year: str, month: str, day: str, hour: str,
) -> DataFrame:
    """Canonical prediction rows; a projection only, so it streams behind any predictor.

    ``run`` and ``value`` are optional inputs. The error is null where no value was observed.
    """
    have = set(predicted.columns)
    run = F.coalesce(F.col("run"), F.lit("")) if "run" in have else F.lit("")
    observed = F.col("value").cast("double") if "value" in have else F.lit(None).cast("double")
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    pred = F.col("predicted_value").cast("double")
    const = {
        "model_name": predictor.model_name, "model_version": predictor.model_version,
        "prediction_timestamp_utc": timestamp_utc, "source_database": source_database,
        "source_table": source_table, "source_year": year, "source_month": month,
        "source_day": day, "source_hour": hour, "target_variable": predictor.target_variable,
        "predicted_units": predictor.predicted_units, "method": predictor.method,
        "year": year, "month": month, "day": day, "hour": hour,
        "model_name_partition": predictor.model_name,
        "model_version_partition": predictor.model_version,
    }
    fixed = {n: F.lit(v) for n, v in const.items()}
    columns = {
        **fixed,
        "prediction_id": prediction_key(
            fixed["model_name"], fixed["model_version"], fixed["source_year"], fixed["source_month"],
            fixed["source_day"], fixed["source_hour"], run, py_number(lat), py_number(lon),
            fixed["target_variable"],
        ),
        "run": run, "latitude": lat, "longitude": lon, "predicted_value": pred,
        "observed_value": observed, "error": observed_error(pred, observed),
        "feature_snapshot_json": feature_snapshot(lat, lon, run),
    }
    names = PREDICTION_REQUIRED + PREDICTION_OPTIONAL + PREDICTION_PARTITIONS
    return predicted.select(*[columns[n].alias(n) for n in names])


def predict_batch(points: DataFrame, predictor: Predictor, **source: str) -> DataFrame:
    return prediction_frame(predictor.apply(points), predictor, **source)


def with_observed(predicted: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Predictions beside ``observed.value``; a row without a partner on the other side stops the job."""
    left = predicted.withColumn("_left", F.lit(True))
    right = observed.select(*keys, "value", F.lit(True).alias("_right"))
    both = left.join(right, list(keys), "full_outer")
    alone = F.concat(F.lit("no partner for "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_left") & F.col("_right"), F.col("value")).otherwise(F.raise_error(alone).cast("double"))
    return both.withColumn("value", checked).drop("_left", "_right")


def response_body(value, lat_grid, lon_grid):
    """JSON answer to a point request."""
    return F.to_json(
        F.struct(
            value.alias("t2m"), lat_grid.alias("lat_grid"), lon_grid.alias("lon_grid"),
            F.lit("K").alias("units"), F.lit("ECMWF SCDA").alias("source"),
        )
    )
