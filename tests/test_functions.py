"""Golden values of the scalar functions."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import coords as C
from gridloom.functions import text as X
from gridloom.functions import weather as W
from gridloom.plans.predict import MockPredictor, predict_batch, response_body
from gridloom.sources import lines as L
from gridloom.operators.extract import ContractError


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize("lon, want", [(-70.6, 289.4), (360.0, 0.0), (-180.0, 180.0), (725.0, 5.0)])
def test_lon_0_360(spark, lon, want):
    assert one(spark, C.lon_0_360(F.lit(lon)))[0] == pytest.approx(want)


def test_near_has_relative_tolerance(spark):
    assert list(one(spark, *[C.near(F.lit(x), 1000.0) for x in (999.995, 1000.009, 999.98)])) == [True, True, False]
    assert one(spark, C.near(F.lit(float("nan")), 1000.0))[0] is False


def test_surface_levels(spark):
    levels = [F.lit(None).cast("double"), F.lit(float("nan")), F.lit(0.0), F.lit(1e-7), F.lit(10.0)]
    assert list(one(spark, *[C.is_surface(x) for x in levels])) == [True, True, True, True, False]


NUMBERS = [0.0005, 1e-5, 1e7, 123456789.5, 1e16, 1.5e300, -33.5, 0.1 + 0.2, -0.0, 1e-4, 12345678901234567.0,
           2.0e-3, 5e-324, 1 / 3, 100.0, 9007199254740993.0, -2.800676018271027e16, float("nan"), float("inf")]


@pytest.mark.parametrize("x", NUMBERS)
def test_number_text_equals_python(spark, x):
    assert one(spark, X.py_number(F.lit(x)))[0] == str(x)


def test_prediction_key_equals_hashlib(spark):
    parts = ["m", "v1", "2026", "04", "09", "18", "18z", str(-33.5), str(0.0005), "t"]
    cols = [F.lit(p) for p in parts[:7]] + [X.py_number(F.lit(-33.5)), X.py_number(F.lit(0.0005)), F.lit("t")]
    want = hashlib.sha256("|".join(parts).encode()).hexdigest()
    assert one(spark, X.prediction_key(*cols))[0] == want


def test_feature_snapshot_is_json_dumps(spark):
    got = one(spark, X.feature_snapshot(F.lit(-33.5), F.lit(1e-5), F.lit('a"b')))[0]
    assert got == json.dumps({"latitude": -33.5, "longitude": 1e-5, "run": 'a"b'})


def test_classifier_golden_rows(spark):
    rows = spark.createDataFrame([(285.4,), (305.0,), (280.0,), (float("nan"),)], "t2m DOUBLE")
    got = rows.select(W.abrupt_label(F.col("t2m")).alias("l"), X.score_text(W.abrupt_score(F.col("t2m"))).alias("s")).collect()
    assert [tuple(r) for r in got[:3]] == [(0, "0.050000"), (1, "2.500000"), (0, "0.625000")]
    assert got[3]["l"] == 0  # a NaN score is no change


def test_classifier_settings_are_checked():
    with pytest.raises(ValueError):
        W.classifier_config({"std_t2m": 0})
    with pytest.raises(ValueError):
        W.classifier_config({"threshold": "high"})


def test_relative_humidity(spark):
    def expected(q, t, p):
        sat = 6.112 * math.exp(17.67 * (t - 273.15) / (t - 29.65))
        ws = 0.622 * sat / max(p - sat, 1e-6)
        return min(max(100 * (q / max(1 - q, 1e-12)) / max(ws, 1e-12), 0), 100)

    for q, t, p in [(0.004, 280.0, 850.0), (0.5, 250.0, 500.0), (-0.1, 280.0, 850.0)]:
        got = one(spark, W.relative_humidity(F.lit(q), F.lit(t), F.lit(p)))[0]
        assert got == pytest.approx(expected(q, t, p), rel=1e-5)
    assert one(spark, W.relative_humidity(F.lit(float("nan")), F.lit(280.0), F.lit(850.0)))[0] is None
    assert one(spark, W.relative_humidity(F.lit(0.1), F.lit(280.0), F.lit(0.0)))[0] is None


def test_csv_faults(spark):
    bodies = ["120,0,1", "0,190,1", "0,0,not-a-number", "1,2", "", '"1","2","3"', "1,2,3d", "nan,5,6"]
    rows = spark.createDataFrame([(i + 1, b) for i, b in enumerate(bodies)], "row_number BIGINT, line STRING")
    got = [r["error"] for r in L.parse_points(rows).orderBy("row_number").collect()]
    assert got == [
        "Row 1: lat out of range [-90, 90]: 120.0", "Row 2: lon out of range [-180, 180]: 190.0",
        "Row 3: invalid t2m value 'not-a-number'", "Row 4: expected exactly 3 columns (lat, lon, t2m), got 2",
        "Row 5: expected exactly 3 columns (lat, lon, t2m), got 0", None, "Row 7: invalid t2m value '3d'", None,
    ]
    strict = L.parse_points(rows, nan_passes=False).where("row_number = 8").first()
    assert strict["error"] == "Row 8: lat out of range [-90, 90]: nan"
    with pytest.raises(ContractError, match="Row 1"):
        L.strict_points(L.parse_points(rows))


def test_manifest_defaults(spark):
    bodies = ['{"input_s3_uri":" s3://b/k "}', '{"mode":"FORWARD","max_runtime_guard":false}', "[1]", "{", '{"mode":"x"}']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i INT, line STRING")
    got = L.parse_manifest(rows).orderBy("i").collect()
    assert (got[0]["mode"], got[0]["max_runtime_guard"], got[0]["input_s3_uri"], got[0]["error"]) == ("metadata_only", True, "s3://b/k", None)
    assert (got[1]["mode"], got[1]["max_runtime_guard"]) == ("forward", False)
    assert [r["error"] is not None for r in got] == [False, False, True, True, True]


def test_response_and_prediction_rows(spark):
    body = one(spark, response_body(F.lit(285.0), F.lit(-33.5), F.lit(-70.6)))[0]
    assert json.loads(body) == {"t2m": 285.0, "lat_grid": -33.5, "lon_grid": -70.6, "units": "K", "source": "ECMWF SCDA"}
    points = spark.createDataFrame([(-33.5, -70.6, "18z", 285.0), (-34.0, -71.0, "18z", None)], "latitude DOUBLE, longitude DOUBLE, run STRING, value DOUBLE")
    rows = predict_batch(points, MockPredictor(), timestamp_utc="t", source_database="d", source_table="s", year="2026", month="04", day="09", hour="18").collect()
    assert rows[0]["error"] == pytest.approx(273.15 + (33.5 + 70.6) % 25 - 285.0)
    assert rows[1]["error"] is None and rows[1]["observed_value"] is None
    assert rows[0]["model_name_partition"] == "mock_predictor"
