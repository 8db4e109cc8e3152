"""Text forms that must equal what a Python producer writes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_number(value: Column) -> Column:
    """Double as Python prints it: the fewest digits that read back the same number.

    ``5.0E-4`` becomes ``0.0005``, ``1.0E7`` becomes ``10000000.0``. Plain short texts pass unchanged.
    """
    x = value.cast("double")
    raw = x.cast("string")
    one, sixteen = F.format_string("%.0e", x), F.format_string("%.15e", x)
    exact = (
        F.when(one.try_cast("double") == x, F.replace(one, F.lit("e"), F.lit(".0e")))
        .when(sixteen.try_cast("double") == x, sixteen).otherwise(F.format_string("%.16e", x))
    )
    return (
        F.when(raw == "NaN", F.lit("nan"))
        .when(raw == "Infinity", F.lit("inf"))
        .when(raw == "-Infinity", F.lit("-inf"))
        .when(~raw.contains("E") & (F.length(raw) <= 17), raw)
        .otherwise(_once(exact, lambda e: _once(_digits(e), _from_digits)))
    )


def _once(value: Column, use) -> Column:
    """Bind a value to a name, so that it is worked out once however often ``use`` needs it."""
    return F.transform(F.array(value), use)[0]


def _digits(scientific: Column) -> Column:
    part = lambda k: F.regexp_extract(scientific, r"^(-?)(\d)\.(\d*?)0*e([+-]\d+)$", k)
    return F.struct(
        part(1).alias("sign"), part(2).alias("head"), part(3).alias("tail"),
        F.concat(part(2), part(3)).alias("all"), part(4).try_cast("int").alias("exp"),
    )


def _from_digits(d: Column) -> Column:
    small = F.concat(d["sign"], F.lit("0."), F.repeat(F.lit("0"), -d["exp"] - 1), d["all"])
    fraction = F.substring(d["all"], d["exp"] + 2, F.lit(20))
    large = F.concat(
        d["sign"], F.substring(F.rpad(d["all"], 17, "0"), F.lit(1), d["exp"] + 1), F.lit("."),
        F.when(F.length(fraction) > 0, fraction).otherwise(F.lit("0")),
    )
    scientific = F.concat(
        d["sign"], d["head"], F.when(F.length(d["tail"]) > 0, F.concat(F.lit("."), d["tail"])).otherwise(F.lit("")),
        F.when(d["exp"] < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(d["exp"]) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(d["exp"]).cast("string"),
    )
    return (
        F.when((d["exp"] >= -4) & (d["exp"] < 0), small)
        .when((d["exp"] >= 0) & (d["exp"] < 16), large).otherwise(scientific)
    )


def json_text(col: Column) -> Column:
    """A quoted and escaped JSON string."""
    return F.regexp_extract(F.to_json(F.struct(col.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def json_number(number: Column) -> Column:
    """A number as Python's JSON writes it: NaN and the infinities have names of their own."""
    return (
        F.when(F.isnan(number), F.lit("NaN"))
        .when(number == float("inf"), F.lit("Infinity")).when(number == float("-inf"), F.lit("-Infinity"))
        .otherwise(py_number(number))
    )


def feature_snapshot(lat: Column, lon: Column, run: Column) -> Column:
    """``{"latitude": .., "longitude": .., "run": ".."}`` with a blank after ``:`` and ``,``."""
    return F.concat(
        F.lit('{"latitude": '), json_number(lat), F.lit(', "longitude": '), json_number(lon),
        F.lit(', "run": '), json_text(F.coalesce(run, F.lit(""))), F.lit("}"),
    )


def prediction_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``|``; a missing part counts as empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def score_text(score: Column) -> Column:
    return F.format_string("%.6f", score)


def time_stamp(at: Column) -> Column:
    """``20260409T180000Z`` of a UTC time."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
