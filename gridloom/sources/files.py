"""Files of a folder as rows, opened in tasks: Parquet footers, digests of files of any size, and scans of just the files that can match."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that are in memory at a time while it is hashed.
BLOCK = 8 << 20
#: The filter columns of the tidy table, with their types.
ZONE_COLUMNS = {"variable": "string", "isobaricInhPa": "double", "latitude": "double", "longitude": "double"}
_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}


def file_list(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, size_bytes`` of every file below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size_bytes"))


def open_file(path: str):
    """A file of any file system that Arrow knows, opened for reading. Names are taken as they are, also with percent signs."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":") if re.match("[a-z][a-z0-9+.-]*:", path) else ("file", "", path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    authority, _, name = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}/")
    return system.open_input_file(f"{base.rstrip('/')}/{name}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with open_file(path) as file:
                while block := file.read(BLOCK):
                    digest.update(block)
            done.append(digest.hexdigest())
        yield pa.record_batch([batch.column("path"), batch.column("size_bytes"), pa.array(done, pa.string())], names=["path", "size_bytes", "sha256"])


def hashed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, size_bytes, sha256`` of every file, one after the other in its task, a block at a time."""
    files = file_list(spark, path, glob)
    return files.repartition("path").mapInArrow(_digests, "path string, size_bytes long, sha256 string")


def _zone_schema(columns: dict[str, str]) -> str:
    bounds = [f"{c}_{side} {kind}" for c, kind in columns.items() for side in ("min", "max")]
    return ", ".join(["file_path string", "row_group int", "n_rows long", *bounds])


def _footers(columns: dict[str, str]):
    fields = [f.split(" ") for f in _zone_schema(columns).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with open_file(path) as file:
                    footer = parquet.ParquetFile(file).metadata
                for group in range(footer.num_row_groups):
                    held = footer.row_group(group)
                    stats = {held.column(i).path_in_schema: held.column(i).statistics for i in range(held.num_columns)}
                    bounds = []
                    for name in columns:
                        known = stats.get(name)
                        bounds += [known.min, known.max] if known is not None and known.has_min_max else [None, None]
                    rows.append((path, group, held.num_rows, *bounds))
            columns_ = list(zip(*rows)) or [[]] * len(fields)
            yield pa.record_batch([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns_, fields)], names=[n for n, _ in fields])

    return run


def footer_zones(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Rows and bounds of every row group of the Parquet files below ``path``, from the footers alone.

    One task's file costs its footer, whatever its size. A column without statistics, or one that is not in the file, has null bounds. Bounds of nothing but nulls are null as well.
    """
    columns = columns or ZONE_COLUMNS
    return file_list(spark, path, "*.parquet").repartition("path").mapInArrow(_footers(columns), _zone_schema(columns))


def matching_files(zones: DataFrame, **wanted) -> DataFrame:
    """``file_path`` of files that can hold a row with all ``wanted`` columns at a value, or between a pair of values. Unknown bounds can hold anything."""
    row = F.lit(True)
    for name, value in wanted.items():
        low, high = value if isinstance(value, tuple) else (value, value)
        row = row & F.coalesce((F.col(f"{name}_min") <= high) & (F.col(f"{name}_max") >= low), F.lit(True))
    return zones.where(row).select("file_path").distinct()


def scan_matching(spark: SparkSession, path: str, schema: str, zones: DataFrame, **wanted) -> DataFrame:
    """The rows of a tidy table that match ``wanted``, from a scan that plans only the files which can hold some.

    The names of these files pass the driver, as those of every scan do. Folder columns keep their meaning below ``path``.
    """
    files = [r["file_path"] for r in matching_files(zones, **wanted).orderBy("file_path").toLocalIterator()]
    reader = spark.read.schema(schema)
    rows = reader.option("basePath", path).parquet(*files) if files else spark.createDataFrame([], schema)
    for name, value in wanted.items():
        rows = rows.where(F.col(name).between(*value) if isinstance(value, tuple) else F.col(name) == value)
    return rows
