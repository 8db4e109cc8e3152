"""Chat formatting: exact round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import chat_format as cf
from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PIECES = [*cf.CONTROLS, "\\", "<", "[", "/", " ", "]", "s>", "INST]", "a", "\n", "é", "[\\INST]", "<\\\\/s>", "[ROLE"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    rendered, spans, rounds = cf.format_turns(turns)
    assert cf.parse(rendered) == turns and rounds <= 1
    assert [cf.unescape(rendered[a:b]) for _, a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert all(turns[k][0] == "assistant" for k, _, _ in spans)
    for _, a, b in spans:
        assert not cf._BARE.search(rendered, a, b)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escape_is_reversible(text):
    assert cf.unescape(cf.escape(text)) == text
    assert not cf._BARE.search(cf.escape(text))


def want(rows):
    by = {}
    for n, (c, turn, role, text) in enumerate(rows):
        by.setdefault((c, n if c is None else None), []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for (c, _), turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = QUERIES["op6_chat_format"](spark, SF).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == want(rows)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "x"), (None, 3, "assistant", ""), (None, 3, "assistant", ""), (None, 4, "user", "<s>"), (2, 1, "tool]", "y" * 50_000), (2, 1, "assistant", "<s>")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    formatted = cf.format_conversations(df)
    assert sorted([tuple(r)[:5] for r in cf.read_back(formatted).collect()], key=repr) == want(rows)
    assert cf.format_conversations(df.limit(0)).count() == 0
