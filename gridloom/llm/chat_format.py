"""Chat formatting with a grammar round trip.

Grammar of a rendered conversation (every turn ends where its closing mark first stands)::

    conversation = { turn }
    turn         = "<s>[INST] " text " [/INST]"          user
                 | " " text "</s>"                        assistant
                 | "[ROLE " role "] " text " [/ROLE]"     any other role, a null role has no name
    escaped      = a control string with backslashes after its first character

A text is first rendered as it is. If the parser does not give the turns back, the control strings of the turns that differ
get one more backslash each, until source and reading are identical. The parser refuses bare control strings inside a text and takes one backslash
from every escaped one, so a text that holds either is always escaped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import only

USER, ASSISTANT = "user", "assistant"
#: What marks turns, and what texts must not hold unescaped.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE ", "[ROLE]", "[/ROLE]"]
_BARE = re.compile("|".join(map(re.escape, CONTROLS)))
_CONFLICT = re.compile("|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))



def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def marks(role: str | None) -> tuple[str, str]:
    """What stands before and after the text of a turn."""
    if role == USER:
        return "<s>[INST] ", " [/INST]"
    if role == ASSISTANT:
        return " ", "</s>"
    return ("[ROLE] " if role is None else f"[ROLE {escape_role(role)}] "), " [/ROLE]"


def escape_role(role: str) -> str:
    """Role names end at a bracket, so brackets and the escape itself are spelled out."""
    return role.replace("\\", "\\\\").replace("]", "\\c")


def unescape_role(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"c": "]"}.get(m[1], m[1]), name, flags=re.S)


def render(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text of a conversation and ``(turn, start, end)`` of each assistant text in it (code points)."""
    out, spans, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        before, after = marks(role)
        out += [before, text, after]
        if role == ASSISTANT:
            spans.append((k, at + len(before), at + len(before) + len(text)))
        at += len(before) + len(text) + len(after)
    return "".join(out), spans


def parse(rendered: str) -> list[tuple[str | None, str]]:
    """Turns of a rendered conversation, texts unescaped; raises ValueError where the grammar does not hold."""
    turns, at = [], 0
    while at < len(rendered):
        if rendered.startswith("<s>[INST] ", at):
            role, start, close = USER, at + 10, " [/INST]"
        elif rendered.startswith("[ROLE] ", at):
            role, start, close = None, at + 7, " [/ROLE]"
        elif rendered.startswith("[ROLE ", at):
            end = rendered.find("] ", at)
            if end < 0:
                raise ValueError(f"role without an end at {at}")
            role, start, close = unescape_role(rendered[at + 6:end]), end + 2, " [/ROLE]"
        elif rendered.startswith(" ", at):
            role, start, close = ASSISTANT, at + 1, "</s>"
        else:
            raise ValueError(f"no turn starts at {at}")
        end = rendered.find(close, start)
        if end < 0:
            raise ValueError(f"turn without an end at {at}")
        if _BARE.search(rendered, start, end):
            raise ValueError(f"a bare control string in the turn at {at}")
        turns.append((role, unescape(rendered[start:end])))
        at = end + len(close)
    return turns


def format_turns(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int, int]], int]:
    """Rendered text, loss spans and how often it had to be escaped, such that ``parse`` gives ``turns`` back."""
    texts, rounds = [t for _, t in turns], 0
    while True:
        rendered, spans = render([(role, t) for (role, _), t in zip(turns, texts)])
        try:
            read = parse(rendered)
        except ValueError:
            read = []
        if read == turns:
            return rendered, spans, rounds
        # a turn's own reading tells whether it conflicts; the next reading is of the whole conversation again
        again = [escape(t) if alone(role, s) != [(role, s)] else t for (role, s), t in zip(turns, texts)]
        if again == texts or rounds:
            raise ValueError("a conversation cannot be read back")
        texts, rounds = again, rounds + 1


def alone(role: str | None, text: str) -> list:
    """What the parser reads from one turn whose text is not escaped."""
    try:
        return parse(render([(role, text)])[0])
    except ValueError:
        return []


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("turn", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rendered, spans, rounds = [], [], []
        for turns in batch.column("turns").to_pylist():
            text, loss, n = format_turns([(t["role"], t["text"]) for t in turns])
            rendered.append(text)
            spans.append([{"turn": k, "start": a, "end": b} for k, a, b in loss])
            rounds.append(n)
        yield pa.record_batch(
            [batch.column("conv_id"), pa.array(rendered, pa.string()), pa.array(spans, span), pa.array(rounds, pa.int32())],
            names=["conv_id", "formatted", "loss", "escaped"],
        )


def format_conversations(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, formatted, loss, escaped``: one rendered text per conversation.

    ``loss`` lists turn, start and end (code points of ``formatted``) of the assistant texts, between the marks and still escaped. ``escaped`` is the
    number of escape rounds, 0 or 1. Every conversation was read back and compared before it is returned.

    One shuffle by conversation; a conversation is one output text, so its turns meet in one task by nature. Turns are ordered by number (null first),
    then role and text, so ties have one order and repeated rows stay. Null text counts as empty, a null role has no name. A null id is no conversation that rows could
    share: each such row is a conversation of one turn. An empty table gives an empty result; further columns are not read.
    """
    rows = only(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumn("_alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    turns = rows.groupBy("conv_id", "_alone").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    ).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(
        _format, f"conv_id {kind}, formatted string, loss array<struct<turn: int, start: bigint, end: bigint>>, escaped int"
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        out = []
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = parse(text)
            said, learnt, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, words in turns:
                said.update(f"{'' if role is None else role}\n{words}\n".encode("utf-8", "surrogatepass"))
            for s in loss:
                words = unescape(text[s["start"]:s["end"]])
                learnt.update(words.encode("utf-8", "surrogatepass"))
                chars += len(words)
            out.append((len(turns), said.hexdigest(), chars, learnt.hexdigest(), len(text)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*out)) or [[]] * 5
        yield pa.record_batch(
            [batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, parsed from the rendered texts and their spans alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        _read,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
