"""CSV records over line breaks and splits, against Python's own reader."""

import csv
import io
import random

from gridloom.sources import lines as L
from gridloom.sources import records


def read(spark, path, split, **options):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return records.read_csv_records(spark, str(path), **options).orderBy("row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_are_those_of_a_csv_reader(spark, tmp_path):
    draw = random.Random(7)
    pieces = ["a", "b", '"', '""', ",", "\n", " ", "1.5", "\n", ",", '"x"', '"q\nr"']
    want = []
    for k in range(3):
        text = "".join(draw.choices(pieces, k=1500)).strip("\n") + "\n"
        (tmp_path / f"part-{k:05d}.csv").write_text(text)
        want += list(csv.reader(io.StringIO(text)))
    for split in (200, 1_000_000):
        got = read(spark, tmp_path, split)
        assert [r["row_number"] for r in got] == list(range(1, len(want) + 1))
        assert [next(csv.reader(io.StringIO(r["line"])), []) for r in got] == want


def test_points_with_line_breaks_keep_their_row_numbers(spark, tmp_path):
    text = '1,2,3\n"4\n",5,6\n"7","8\n8",9\n10,11,"12"\n'
    (tmp_path / "points.csv").write_text(text)
    errors = [r["error"] for r in L.parse_points(records.read_csv_records(spark, str(tmp_path)).drop("error")).orderBy("row_number").collect()]
    assert errors == [None, None, "Row 3: invalid lon value '8\n8'", None]


def test_an_unclosed_quote_is_no_unbounded_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,3\n4,\"5,6\n" + "7,8,9\n" * 400)
    (tmp_path / "b.csv").write_text("10,11,12\n")
    got = read(spark, tmp_path, 500, limit=1000)
    assert [(r["row_number"], r["line"], r["error"]) for r in got] == [
        (1, "1,2,3", None), (2, None, "field larger than field limit (1000)"), (3, "10,11,12", None)]
