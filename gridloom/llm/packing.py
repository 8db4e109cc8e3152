"""Concatenate and cut: documents become one token stream that fixed windows divide."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import by_bytes, only
from gridloom.llm.tokens import memo, segments_without_space
from gridloom.session import materialise

#: Text bytes that are cut into segments and encoded together.
BATCH_BYTES = 4 << 20


def id_width(tokenizer: str, end_id: int) -> str:
    """Smallest type that holds all ids of a vocabulary."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id)
    return "<u2" if most < 1 << 16 else "<u4"


def slices(whole: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _encode(path: str, end_id: int, width: str):
    """Ids of each document, and where it starts within the tokens of its own partition."""
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = memo(path, width, lambda ids, counts: slices(ids.astype(width).tobytes(), counts * size), b"".join, False)
        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], width).tobytes()
        for batch in batches:
            names = batch.column("doc_id")
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for low, high in by_bytes([4 * len(t) for t in texts], BATCH_BYTES):
                cut = [segments_without_space(encoded.plain(t)) for t in texts[low:high]]
                ids, starts = [], []
                for parts in encoded.of(cut):
                    ids.append(b"".join(parts) + end)
                    starts.append(at)
                    at += len(ids[-1]) // size
                yield pa.record_batch(
                    [
                        pa.array([part] * len(ids), pa.int32()), names.slice(low, high - low),
                        pa.array(starts, pa.int64()), pa.array([len(x) // size for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "doc_id", "start", "doc_tokens", "ids"],
                )

    return run


def _cut(length: int, width: str):
    """Cut each document where a window of ``length`` tokens ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = batch.column("doc_id"), batch.column("doc_tokens").to_pylist()
            starts, ids = batch.column("start").to_pylist(), batch.column("ids")
            for low, high in by_bytes([4 * n for n in sizes], BATCH_BYTES):
                rows, out = [], []
                for i in range(low, high):
                    wide = np.frombuffer(ids[i].as_buffer(), width).astype("<u4")
                    first, stop = starts[i], starts[i] + sizes[i]
                    while first < stop:
                        after = min(stop, (first // length + 1) * length)
                        piece = wide[first - starts[i]:after - starts[i]].tobytes()
                        rows.append(i)
                        out.append((first - starts[i], after - first, zlib.crc32(piece), sizes[i], first // length, first % length, piece))
                        first = after
                columns = list(zip(*out))
                yield pa.record_batch(
                    [names.take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return run


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2
) -> DataFrame:
    """Pieces that fill windows of ``length`` tokens: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    Pass one encodes every document once, appends ``end_id`` and writes the ids with their start inside the partition. The totals
    of the partitions, one row per task, are summed up to give each partition its place in the one global stream. Pass two cuts every
    document at the window borders; a window's first and last piece are its boundary records. ``ids`` holds the piece as
    little-endian unsigned 32-bit numbers. Only the very last window can be short, so the padding of the whole corpus is less than one window.
    No text is shuffled and nothing but the partition totals meets in one place.

    Null and empty texts are one ``end_id``. Null or repeated ids and repeated rows are packed like any other row. A document longer than a window
    becomes many pieces; a run of text without any white space, however long, is one call of the tokenizer. Ids take two bytes between the passes, or four for vocabularies beyond 65,536. An empty table gives no pieces; further columns are not read.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    width = id_width(tokenizer, end_id)
    encoded = materialise(
        rows.mapInArrow(_encode(tokenizer, end_id, width), f"part int, doc_id {kind}, start long, doc_tokens long, ids binary"),
        "packing",
    )
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = encoded.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "doc_tokens", "ids"
    )
    return placed.mapInArrow(
        _cut(length, width),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
