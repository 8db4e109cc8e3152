"""Lookups against brute force on layouts that break naive cell schemes."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators.nearest import build_index, knn_regression, lookup, nearest_point


def brute(grid, probes, k):
    lat, lon = (grid[c].to_numpy().astype("f4").astype("f8") for c in ("lat", "lon"))
    d2 = (probes.lat.to_numpy()[:, None] - lat) ** 2 + (probes.lon.to_numpy()[:, None] - lon) ** 2
    return np.argsort(d2, axis=1, kind="stable")[:, :k], np.sort(d2, axis=1)[:, :k]


def layouts():
    rng = np.random.default_rng(3)
    spread = pd.DataFrame({"lat": rng.uniform(-90, 90, 300), "lon": rng.uniform(-180, 180, 300)})
    knot = pd.DataFrame({"lat": 10 + rng.normal(0, 0.001, 200), "lon": 20 + rng.normal(0, 0.001, 200)})
    same = pd.DataFrame({"lat": np.full(200, 1.0), "lon": np.full(200, 2.0)})
    probes = pd.DataFrame({"lat": rng.uniform(-90, 90, 400).round(1), "lon": rng.uniform(-180, 180, 400).round(1)})
    probes.loc[:130, "lat"], probes.loc[:130, "lon"] = 10.0, 20.0       # a third at one place
    probes.loc[131:140, "lat"], probes.loc[131:140, "lon"] = 1.0, 2.0    # exact matches
    probes.loc[141:150, "lat"], probes.loc[141:150, "lon"] = 95.0, -200.0  # off the map
    return pd.concat([spread, knot, same], ignore_index=True), probes


@pytest.mark.parametrize("k", [1, 4])
def test_skewed_layout_equals_brute_force(spark, k):
    grid, probes = layouts()
    grid = grid.assign(grid_id=np.arange(len(grid)), value=np.arange(len(grid), dtype=float))
    probes = probes.assign(pid=np.arange(len(probes)))
    index = build_index(spark.createDataFrame(grid), k)
    got = lookup(spark.createDataFrame(probes), index).select(
        "pid", F.transform("hits", lambda h: h["grid_id"]).alias("ids")).toPandas().sort_values("pid")
    want, _ = brute(grid, probes, k)
    assert len(got) == len(probes)
    assert np.array_equal(np.array(got.ids.tolist()), want)


def test_equidistant_ring_is_exact_and_unusable_probes_stay(spark):
    angle = np.linspace(0, 2 * np.pi, 150, endpoint=False)
    grid = pd.DataFrame({"grid_id": np.arange(150), "lat": 30 * np.sin(angle), "lon": 30 * np.cos(angle), "value": 1.0})
    probes = pd.DataFrame({"pid": range(4), "lat": [0.0, 1.0, np.nan, 5.0], "lon": [0.0, 0.0, 1.0, -5.0]})
    found = nearest_point(spark.createDataFrame(probes), build_index(spark.createDataFrame(grid))).toPandas().sort_values("pid")
    want, _ = brute(grid, probes.iloc[[0, 1, 3]], 1)
    assert found.grid_id.iloc[[0, 1, 3]].tolist() == want[:, 0].tolist()
    assert np.isnan(found.predicted_value.iloc[2])


def test_two_point_model_and_weights(spark):
    grid = spark.createDataFrame([(0, -33.5, -70.6, 285.0), (1, -34.0, -71.0, 286.0)], "grid_id BIGINT, lat DOUBLE, lon DOUBLE, value DOUBLE")
    probe = spark.createDataFrame([(0, -33.51, -70.59)], "pid INT, lat DOUBLE, lon DOUBLE")
    row = nearest_point(probe, build_index(grid)).first()
    assert row["predicted_value"] == 285.0 and row["lat_grid"] == -33.5
    exact = spark.createDataFrame([(0, -34.0, -71.0)], "pid INT, lat DOUBLE, lon DOUBLE")
    assert knn_regression(exact, build_index(grid, 4)).first()["predicted_value"] == 286.0


def test_stacked_positions_do_not_refine_for_ever(spark, monkeypatch):
    """A column of 300 positions with four points each: 80 neighbours are 20 places, and no cell needs more than a few levels."""
    monkeypatch.setattr("gridloom.operators.nearest.LAST_LEVEL", 13)
    places = pd.DataFrame({"lat": np.repeat(np.arange(300) / 8 - 18, 4), "lon": 0.0})
    rng = np.random.default_rng(5)
    grid = places.sample(frac=1, random_state=5).reset_index(drop=True).assign(grid_id=np.arange(1200), value=1.0)
    probes = pd.DataFrame({"pid": np.arange(200), "lat": rng.uniform(-20, 20, 200).round(2), "lon": rng.uniform(-9, 9, 200).round(2)})
    probes.loc[:20, "lon"] = 0.0
    index = build_index(spark.createDataFrame(grid), 80, domain=(-20.0, 20.0, -10.0, 10.0))
    assert index.net is None and index.crowded is None and index.leaves.count() < 5000
    got = lookup(spark.createDataFrame(probes), index).select("pid", F.transform("hits", lambda h: h["grid_id"]).alias("ids")).toPandas().sort_values("pid")
    want, _ = brute(grid, probes, 80)
    assert np.array_equal(np.array(got.ids.tolist()), want)


def test_hits_are_ranked_once_when_exploded(spark):
    grid, probes = layouts()
    grid = grid.assign(grid_id=np.arange(len(grid)), value=1.0)
    for model in (grid, grid[:300]):  # leaves, a net
        index = build_index(spark.createDataFrame(model), 4)
        rows = lookup(spark.createDataFrame(probes[:141]), index).select("lat", F.posexplode("hits"))
        assert len(re.findall(r"(?:sort_array|array_sort)\(", rows._jdf.queryExecution().optimizedPlan().toString())) == 1
