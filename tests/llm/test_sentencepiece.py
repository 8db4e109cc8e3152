"""SentencePiece encoding against the library, and back."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from gridloom.llm import sentencepiece_lattice as sl
from gridloom.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
PATH = tokenizer_file("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, "  two  spaces "), (3, "  two  spaces "), (None, "é 你好 🙂 ①\n\nx\ty\r"), (5, "q" * 5000), (6, "▁ marks ▁▁x"), (7, " "),
    (8, "abcabcbcab" * 300), (9, "123.45 don't e.g. \x00 \x7f"), (10, "implementation_responsibility" * 5), (11, "\n"),
]


@pytest.fixture(scope="module")
def model():
    return sl.Model(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, [1], "u") for i, t in rows], "doc_id long, text string, ids array<int>, unit string").repartition(3)


def test_odd_texts(spark, model, library):
    want = sorted([(i, library.encode(t or "")) for i, t in ODD], key=repr)
    encoded = sl.encode(frame(spark, ODD), model)
    assert sorted(map(tuple, encoded.collect()), key=repr) == want
    back = sorted([(i, (t or "").replace("▁", " ")) for i, t in ODD], key=repr)
    assert sorted(map(tuple, sl.decode(encoded, model).collect()), key=repr) == back
    assert sl.encode(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("frequent", [0, 3, 500_000])
def test_summary_of_odd_texts(spark, model, frequent):
    docs = frame(spark, ODD)
    got = sl.encode_summary(docs, model, frequent=frequent)
    units = sl.dictionary(docs, model).select("unit", "ids")
    rows = sl._numbered(docs, model, "doc_id", "text").select("row", "doc_id", F.posexplode_outer("units").alias("pos", "unit"))
    want = rows.join(units, "unit", "left").groupBy("row", "doc_id").agg(
        F.count("unit"), F.sum(F.coalesce(F.size("ids"), F.lit(0))), F.coalesce(F.bit_xor(F.when(F.col("ids").isNotNull(), F.xxhash64("pos", "ids"))), F.lit(0))
    ).drop("row")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_query_encodes_and_decodes(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op10_sentencepiece"](spark, SF).collect()}
    want = {i: (len(ids := library.encode(t or "")), ids, hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t in rows}
    assert got == want


def test_carried_columns(spark, model):
    docs = frame(spark, ODD).withColumn("source", F.coalesce("text", F.lit("")))
    back = sl.decode(sl.encode(docs, model, carry=("source",)), model, carry=("ids", "source")).collect()
    assert len(back) == len(ODD) and all(r["text"] == r["source"].replace("▁", " ") for r in back)


def test_whole_table(spark, model, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    encoded = sl.encode(docs, model)
    assert {r[0]: r[1] for r in encoded.collect()} == {i: library.encode(t) for i, t in rows}
    assert {r[0]: r[1] for r in sl.decode(encoded, model).collect()} == {i: t for i, t in rows}
    counts = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_sentencepiece"](spark, SF).collect()}
    assert counts == {i: len(library.encode(t)) for i, t in rows}


def test_nothing_is_shuffled_or_written(spark, model, monkeypatch):
    monkeypatch.setattr(sl, "materialise", lambda *_, **__: pytest.fail("units are written"))
    plan = sl.encode(frame(spark, ODD).coalesce(1), model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
    assert "Exchange hashpartitioning" not in QUERIES["op10_sentencepiece"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_units_are_cut_as_by_the_expression(spark, model):
    rows = frame(spark, ODD).where("text is not null").select(sl.marked(F.col("text")).alias("m"), sl.units_of(F.col("text"), model).alias("u")).collect()
    for part in (rows, rows[3:7], [rows[1]]):
        texts = pa.array([r["m"] for r in part], pa.string())
        units, sizes = sl._cut(texts, sl._classes(model.mixed))
        assert units.to_pylist() == [u for r in part for u in r["u"]] and sizes.tolist() == [len(r["u"]) for r in part]


def test_memory_that_forgets_and_small_slices(model, library):
    """Tasks forget units, slices and batches end anywhere, a unit spans batches: the ids stay those of the library."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the", "ation", "q", " ", "  ", "12", "é", "🙂", "\n", "▁", "x" * 70]) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["implementation" * 40, ""]
    pieces: dict[int, list] = {}
    for p, i, _ in model.pieces:
        pieces.setdefault(sl.piece_key(p), []).append((p, i))

    def joined(batches):
        for b in batches:
            for r in b.to_pylist():
                for first, cuts in enumerate(r["keys"]):
                    for more, key in enumerate(cuts):
                        head = first == 0
                        hits = [None] if head else [i for p, i in pieces.get(key, []) if r["block"][first - 1:first + 1 + more] == p]
                        for i in hits:
                            edge = None if head else ((r["at"] + first - 1) << 8 | more + 2) << 24 | i
                            yield {"number": r["number"], "unit": r["unit"] if head else None, "edge": edge, "places": r["places"] if head else None, "kept_0": r["kept_0"] if head else None}

    marked = [("▁" + t.replace(" ", "▁")) if t else "" for t in texts]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(marked, pa.string())], names=["kept_0", "text"])
    kinds = pa.schema([("number", pa.int64()), ("unit", pa.string()), ("edge", pa.int64()), ("places", pa.binary()), ("kept_0", pa.int64())])
    with pytest.MonkeyPatch.context() as patch:
        for name, value in (("TASK_UNITS", 20), ("SLICE_BYTES", 300), ("SLICE_UNITS", 9), ("NEW_CHARS", 64), ("FOLD_UNITS", 3)):
            patch.setattr(sl, name, value)
        rows = list(joined(sl._split(model.longest, model.mixed, ["kept_0"])(iter([batch.slice(0, 25), batch.slice(25)]))))
        cut = (pa.RecordBatch.from_pylist(rows[at:at + 7], kinds) for at in range(0, len(rows), 7))
        got = {r["kept_0"]: (r["ids"], r["text"]) for b in sl._look_up(model, ["kept_0"], True)(cut) for r in b.to_pylist()}
    assert got == {k: (library.encode(t), t.replace("▁", " ")) for k, t in enumerate(texts)}


def test_decoded_with_the_ids(spark, model):
    encoded = sl.encode(frame(spark, ODD), model, decoded="back")
    want = sl.decode(sl.encode(frame(spark, ODD), model, carry=()), model, carry=("ids",))
    assert sorted(map(repr, map(tuple, encoded.collect()))) == sorted(map(repr, map(tuple, want.select("doc_id", "ids", "text").collect())))


@pytest.mark.parametrize("changed", [{}, {"KEY_BASE": 1}, {"TASK_PARTS": 5, "NEW_CHARS": 64, "TASK_UNITS": 20, "SLICE_BYTES": 300}])
def test_substrings_meet_the_pieces_once_a_task(model, library, monkeypatch, changed):
    """However often a substring occurs, the join sees it once; keys that many substrings share, forgotten substrings and batches that end anywhere do no harm."""
    for name, value in changed.items():
        monkeypatch.setattr(sl, name, value)
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["station", "nation", "q", "12", "é🙂", "x" * 70, "implementation" * 9]) + str(k) for _ in range(30)) for k in range(40)] + ["", "q"]
    kept = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([[t] for t in texts])], names=["kept_0", "kept_1"])
    batch = kept.append_column("text", pa.array([("▁" + t.replace(" ", "▁")) if t else "" for t in texts]))
    ids = {p: i for p, i, _ in model.pieces}
    split = sl._split(model.longest, model.mixed, kept.schema.names, model.keys())
    rows = [r for b in sl._packed(split, kept.schema.names, model.keys())(iter([batch.slice(0, 25), batch.slice(25)])) for r in b.to_pylist()]
    parts = [r["part"] for r in rows if r["number"] >= 0]
    if "TASK_PARTS" not in changed:
        assert len(set(parts)) == len(parts) and set(parts) >= {p for p in ids if 1 < len(p) and any(p in t for t in ("▁station", "nation", "implementation"))}
    found = pa.schema([("number", pa.int64()), ("id", pa.int64()), ("held", pa.binary())])
    joined = [{"number": r["number"], "id": ids.get(r["part"]), "held": r["held"]} for r in rows]
    cut = (pa.RecordBatch.from_pylist(joined[at:at + 7], found) for at in range(0, len(joined), 7))
    got = {r["kept_0"]: (r["kept_1"], r["ids"], r["text"]) for b in sl._unpacked(sl._look_up(model, kept.schema.names, True))(cut) for r in b.to_pylist()}
    assert got == {k: ([t], library.encode(t), t) for k, t in enumerate(texts)}


def test_no_row_for_each_edge(spark, model, library):
    """Handing a row of every edge to Python took most of the JVM's CPU time."""
    assert "Generate" not in sl.encode(frame(spark, ODD), model)._jdf.queryExecution().optimizedPlan().toString()
    plain = [(1, "~"), (2, "\x7f"), (3, "①")]  # no substring that may be a piece but the mark's
    assert sorted(map(tuple, sl.encode(frame(spark, plain).coalesce(1), model).collect())) == [(i, library.encode(t)) for i, t in plain]


def test_sieve_never_loses_a_piece(model):
    for some in (model.keys(), model.keys()[:1], model.keys()[:0]):
        assert sl._Sieve(some).may_hold(some.view("u8")).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype("u8")
    assert sl._Sieve(model.keys()).may_hold(others).mean() < 0.01
