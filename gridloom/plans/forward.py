"""A forward model run once per tensor: grouped Arrow map, with the outcome of every tensor as a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model maps a normalised tensor (channels, latitudes, longitudes) to one of the same number of channels; a loader makes it in the worker.
TensorModel = Callable[[np.ndarray], np.ndarray]
Loader = Callable[[], TensorModel]

OUTCOME = (
    "tensor_uri string, output_shape array<int>, error_type string, error_message string, elements bigint, finite boolean, nan_count bigint, "
    "min double, max double, mean double, std double"
)
_LOADED: dict[str, TensorModel] = {}


def _model(name: str, load: Loader) -> TensorModel:
    """The model of this worker process; tasks that follow in the same worker share it."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def tensor_array(rows: pa.Table) -> np.ndarray:
    """The rows of one tensor as (channels, latitudes, longitudes), nulls as NaN."""
    ordered = rows.select(["channel_index", "lat_index", "values"]).sort_by([("channel_index", "ascending"), ("lat_index", "ascending")])
    values = ordered.column("values").combine_chunks()
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float32)
    channels = len(set(ordered.column("channel_index").to_pylist()))
    return flat.reshape(channels, len(ordered) // channels, -1)


def array_statistics(values: np.ndarray) -> dict:
    """As ``tensor_statistics``: NaN left out, population deviation, infinities kept."""
    real = values[~np.isnan(values)].astype(np.float64)
    some = len(real) > 0
    with np.errstate(invalid="ignore"):
        return {
            "elements": values.size, "finite": bool(np.isfinite(values).all()), "nan_count": int(values.size - len(real)),
            "min": float(real.min()) if some else None, "max": float(real.max()) if some else None,
            "mean": float(real.mean()) if some else None, "std": float(real.std()) if some else None,
        }


def forward_outcomes(rows: DataFrame, wanted: DataFrame, stats: DataFrame, load: Loader, channels: int = 20, name: str = "model") -> DataFrame:
    """One row per tensor of ``wanted.tensor_uri``: output shape and statistics, or type and message of what the model raised.

    A tensor meets in one task, as the model takes it whole; its size was bounded by the guard and the shape check before. The values are normalised with ``stats`` (one row per channel,
    checked by the caller), given to the model that ``load`` makes once a worker under ``name``, and restored. Only errors of the model and its
    loader are caught: a lost executor or a full disk still fails the job.
    """
    picked = stats.where(F.col("channel_index").between(0, channels - 1)).orderBy("channel_index").select(
        F.col("mean").cast("double"), F.col("std").cast("double")
    ).collect()  # exactly one row a channel
    mean, std = (np.array([r[c] for r in picked])[:, None, None] for c in ("mean", "std"))
    fields = OUTCOME.split(", ")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = dict.fromkeys(f.split(" ")[0] for f in fields)
        out["tensor_uri"] = key[0].as_py()
        given = tensor_array(table).astype(np.float64)
        try:
            answer = _model(name, load)(((given - mean) / std).astype(np.float32))
            restored = (np.asarray(answer, np.float32).astype(np.float64) * std + mean).astype(np.float32)
        except MemoryError:
            raise
        except Exception as fault:  # whatever a model raises belongs to its tensor's report
            out |= {"error_type": type(fault).__name__, "error_message": str(fault)}
        else:
            out |= {"output_shape": [1, *restored.shape], **array_statistics(restored)}
        return pa.Table.from_pylist([out], schema=_SCHEMA)

    chosen = rows.join(wanted.select("tensor_uri").distinct(), "tensor_uri", "left_semi")
    return chosen.select("tensor_uri", "channel_index", "lat_index", "values").groupBy("tensor_uri").applyInArrow(run, OUTCOME)


_SCHEMA = pa.schema([
    ("tensor_uri", pa.string()), ("output_shape", pa.list_(pa.int32())), ("error_type", pa.string()), ("error_message", pa.string()), ("elements", pa.int64()),
    ("finite", pa.bool_()), ("nan_count", pa.int64()), ("min", pa.float64()), ("max", pa.float64()), ("mean", pa.float64()), ("std", pa.float64()),
])
