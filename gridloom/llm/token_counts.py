"""Token counts of whole texts, as lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import by_bytes, only
from gridloom.llm.tokens import memo, segments_with_space

#: Text bytes that are cut into segments and encoded together.
BATCH_BYTES = 4 << 20


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = memo(path, "length", lambda ids, counts: counts.tolist(), sum, True)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            counts = []
            for low, high in by_bytes([4 * len(t) for t in texts], BATCH_BYTES):
                cut = [segments_with_space(t) for t in texts[low:high]]
                counts += map(sum, lengths.of(cut))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row per row of ``docs``.

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file that every executor can open. No token is
    added; special strings inside a text count as the library counts them by default. A narrow map: no shuffle.

    Null text counts as empty: 0 bytes, 0 tokens. A null id stays null; repeated rows are counted each.
    A text of any length is cut at safe boundaries, so memory follows the segments and not the text's tokens; a run without any boundary, however long, is one call of the tokenizer. An empty table
    gives an empty result; further columns are not read.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    sized = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = sized.mapInArrow(_count(tokenizer), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
