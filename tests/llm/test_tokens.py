"""Token counts and packing against the library on whole texts."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing, tokens
from gridloom.llm.queries import QUERIES, tokenizer_file
from gridloom.llm.token_counts import token_counts

SF = "/root/testdata/sf0.01"
BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, "  a\n\n b\t\tc  "), (3, "  a\n\n b\t\tc  "), (None, "x<|endoftext|>y <|endoftext|>"), (5, "q" * 30_000),
    (6, "a  b　\x0b c\x85 d \x1c e"), (7, "\r\n \r\n"), (8, "don't  WON'T É ́x Å ΣΣ"), (9, "word " * 3000), (10, "x<|startoftext|> z"),
]


def split_lists(ids, counts):
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_tokens int, part int")


def plain_pieces(pieces, rows, length, end=2):
    """Checks the packing contract for pieces against texts encoded as a whole."""
    tok = Tokenizer.from_file(WORD)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end]
        own = sorted(by_doc.pop(doc), key=lambda p: p["start"])
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert sum(p["length"] for p in own) == len(ids)
        for p in own:
            cut = ids[p["start"]:p["start"] + p["length"]]
            assert p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
    assert not by_doc
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, own in by_sequence.items():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at == length or k == len(by_sequence) - 1 and at < length


def test_counts_of_the_whole_table(spark):
    tok = Tokenizer.from_file(BYTE)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 512) for i, t in rows}
    assert {tuple(r) for r in QUERIES["op1_token_counts"](spark, SF).collect()} == want


def test_counts_of_odd_texts(spark):
    tok = Tokenizer.from_file(BYTE)
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD]
    got = token_counts(frame(spark, ODD), BYTE).select("doc_id", "n_bytes", "n_tokens").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts(frame(spark, []), BYTE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\r\x0b ab'tsS1é!<|>́≠².…“9_", max_size=40))
def test_segments_give_the_tokens_of_the_text(text):
    whole, word = Tokenizer.from_file(BYTE) if not CACHE else CACHE[0], CACHE[1] if CACHE else Tokenizer.from_file(WORD)
    CACHE[:] = [whole, word]
    ids = lambda t, s: t.encode(s, add_special_tokens=False).ids
    assert sum((ids(whole, s) for s in tokens.segments_with_space(text)), []) == ids(whole, text)
    assert sum((ids(word, s) for s in tokens.segments_without_space(text)), []) == ids(word, text)
    for path, tok, cut in ((BYTE, whole, tokens.segments_with_space), (WORD, word, tokens.segments_without_space)):
        if path not in MEMOS:
            MEMOS[path] = tokens.SegmentMemo(path, split_lists, lambda parts: sum(parts, []), path == BYTE)
        assert sum(MEMOS[path].of([cut(MEMOS[path].plain(text))])[0], []) == ids(tok, text)


CACHE: list = []
MEMOS: dict = {}


def test_words_together_have_the_ids_of_words_alone():
    odd = ["İstanbul", "ΣΑΣ", "straße", "ﬁn", "naïve", "ᾳ", "𝒜b", "日本語", "é", "Ǆ", "K", "ſ"]
    for path, spaced in ((BYTE, True), (WORD, False)):
        tok = Tokenizer.from_file(path)
        words = [f" {w}" if spaced else w for w in [*odd, *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]]]
        found = tokens.SegmentMemo(path, split_lists, lambda parts: sum(parts, []), spaced).of([words])[0]
        assert list(found) == [tok.encode(w, add_special_tokens=False).ids for w in words]


def test_long_runs_without_a_boundary(spark):
    texts = [(1, "ab" * 1_000_000), (2, "a1" * 600_000), (3, "é!" * 50_000)]
    tok, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame(spark, texts), BYTE).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts}
    pieces = packing.pack(frame(spark, texts), WORD).collect()
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == {i: len(word.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts}


def test_large_vocabularies_take_four_bytes(spark, monkeypatch):
    plain = [(k, t) for k, (_, t) in enumerate(ODD)]
    want = sorted(map(tuple, packing.pack(frame(spark, plain).coalesce(1), WORD, length=9).collect()))
    assert packing.id_width(WORD, 2) == "<u2" and packing.id_width(WORD, 70_000) == "<u4"
    monkeypatch.setattr(packing, "id_width", lambda *_: "<u4")
    assert sorted(map(tuple, packing.pack(frame(spark, plain).coalesce(1), WORD, length=9).collect())) == want


def test_memo_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_SEGMENTS", 3)
    monkeypatch.setattr(tokens, "MEMO_PARTS", 3)
    memo = tokens.SegmentMemo(BYTE, lambda ids, counts: counts.tolist(), sum, True)
    assert [list(map(int, x)) for x in memo.of([["a", "b"], ["c", "d", "a"]])] == [[1, 1], [1, 1, 1]]
    assert [list(x) for x in memo.of([["c", "e"]])] == [[1, 1]] and set(memo.places) == {"c", "e"} and set(memo.parts) == {"c", "e"}


def test_packing_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    plain_pieces(QUERIES["op5_packing"](spark, SF).collect(), rows, 4096)


@pytest.mark.parametrize("length", [7, 4096])
def test_packing_of_odd_texts(spark, length):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)]
    pieces = packing.pack(frame(spark, rows).repartition(3), WORD, length=length).collect()
    plain_pieces(pieces, rows, length)
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    assert packing.pack(frame(spark, []), WORD).count() == 0
    twice = packing.pack(frame(spark, [(1, "a"), (1, "a"), (None, None)]), WORD).collect()
    assert sorted((p["doc_id"] or 0, p["length"]) for p in twice) == [(0, 1), (1, 2), (1, 2)]


def test_words_are_learnt_once_and_never_cut(monkeypatch):
    import gc

    memo = tokens.SegmentMemo(WORD, lambda ids, counts: [tuple(x) for x in np.split(ids, np.cumsum(counts)[:-1])], lambda parts: sum(parts, ()), False)
    cut, encoded, running = [], [], []
    monkeypatch.setattr(memo, "_cut", lambda s, plain=memo._cut: cut.append(s) or running.append(gc.isenabled()) or plain(s))
    monkeypatch.setattr(memo, "_encode", lambda parts, plain=memo._encode: encoded.extend(parts) or plain(parts))
    texts = [["alpha", "beta", "alpha", "gamma,"], ["beta", "don't", "gamma"], ["<unk>", "alpha", "é,x"]]
    tok = Tokenizer.from_file(WORD)
    for _ in range(2):
        got = [[int(i) for part in text for i in part] for text in memo.of(texts)]
        assert got == [tok.encode(" ".join(text), add_special_tokens=False).ids for text in texts]
    assert sorted(cut) == sorted(["gamma,", "don't", "<unk>", "é,x"]) and len(encoded) == len(set(encoded))
    assert set(running) == {False} and gc.isenabled()
