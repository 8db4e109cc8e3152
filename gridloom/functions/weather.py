"""Derived fields and point scores, all as code-generated column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.coords import finite
from gridloom.schema import CLASSIFIER_DEFAULTS, GRAVITY, READABLE_NAMES


def geopotential(height: Column) -> Column:
    """Geopotential from geopotential height, kept in single precision."""
    return height.cast("float") * F.lit(GRAVITY).cast("float")


def readable_name(code: Column) -> Column:
    names = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in READABLE_NAMES.items()) + ")")
    return F.coalesce(F.try_element_at(names, code), code)


def soil_name(code: Column, layer: Column) -> Column:
    return F.concat(code, F.lit("_soil"), layer.cast("int").cast("string"))


def relative_humidity_raw(q: Column, t_k: Column, p_hpa: Column) -> Column:
    """Percent relative humidity from specific humidity, before clipping.

    Non-finite inputs and pressures that are not positive give null.
    """
    sat = F.lit(6.112) * F.exp(F.lit(17.67) * (t_k - 273.15) / (t_k - 29.65))
    mixing = q / F.greatest(F.lit(1.0) - q, F.lit(1e-12))
    sat_mixing = F.lit(0.622) * sat / F.greatest(p_hpa - sat, F.lit(1e-6))
    percent = F.lit(100.0) * (mixing / F.greatest(sat_mixing, F.lit(1e-12)))
    usable = finite(q) & finite(t_k) & finite(p_hpa) & (p_hpa > 0.0) & (t_k != 29.65)
    return F.when(usable, percent)


def clip_percent(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)))


def relative_humidity(q: Column, t_k: Column, p_hpa: Column) -> Column:
    return clip_percent(relative_humidity_raw(q, t_k, p_hpa)).cast("float")


def classifier_config(overrides: dict | None = None) -> dict[str, float]:
    config = {**CLASSIFIER_DEFAULTS, **(overrides or {})}
    try:
        config = {k: float(config[k]) for k in CLASSIFIER_DEFAULTS}
    except (TypeError, ValueError) as exc:
        raise ValueError("classifier settings must be numbers") from exc
    if not config["std_t2m"] > 0:
        raise ValueError("std_t2m must be > 0")
    return config


def abrupt_score(t2m: Column, config: dict | None = None) -> Column:
    cfg = classifier_config(config)
    return F.abs(t2m.cast("double") - F.lit(cfg["mean_t2m"])) / F.lit(cfg["std_t2m"])


def abrupt_label(t2m: Column, config: dict | None = None) -> Column:
    """1 for an abrupt change. A NaN score is no change; Spark alone would call it one."""
    score = abrupt_score(t2m, config)
    return F.when(~F.isnan(score) & (score >= F.lit(classifier_config(config)["threshold"])), 1).otherwise(0)


def mock_temperature(lat: Column, lon: Column) -> Column:
    return F.lit(273.15) + ((F.abs(lat) + F.abs(lon)) % F.lit(25.0))


def standardise(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def restore(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def observed_error(predicted: Column, observed: Column) -> Column:
    """Prediction minus observation; null where nothing was observed."""
    return predicted.cast("double") - observed.cast("double")
