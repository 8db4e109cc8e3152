"""Conversation structure repair by a grammar-compressed dynamic programme.

A row becomes a symbol of its role and fault. Rows act on four states of the wanted order ``(s?(ua)+)?``: nothing yet, after the system turn, after a user turn, after an
assistant turn. A symbol is a 4 x 4 matrix of cheapest edits from state to state; a sequence is a min-plus product. Re-Pair replaces frequent neighbours by rule symbols, so that the product
of a rule is worked out once, from the bottom up, and shared by all conversations.

Insertions belong to the row behind them, so every audit of a sequence ends with a row's edit and holds as many of these as the sequence has rows. Two different audits of the same
sequence therefore differ before either ends, and ties can be settled by ranks: an entry keeps its cost, the state in the middle (the rope) and the rank of its audit among those
from the same state. No audit text is written before the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import key128, only
from gridloom.llm.turns import numbered, ordered_digest
from gridloom.session import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
STATES = 4
NEVER = 1 << 60
#: What may be inserted in a state, and where it leads; a longer way round to the same state never pays.
INSERTS = [[("", 0), ("u", 2), ("ua", 3)], [("", 1), ("u", 2), ("ua", 3)], [("", 2), ("a", 3)], [("", 3), ("u", 2)]]
#: The state behind a kept role.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: What has to follow at the end.
CLOSING = ["", "ua", "a", ""]
ROLES = {"u": "user", "a": "assistant"}
#: Rows whose symbols are one piece; rules never cross a piece. Re-Pair stops after so many rounds of at most so many rules.
PIECE, ROUNDS, RULES = 4096, 8, 64
WHITE = " \t\n\x0b\x0c\r"
#: Symbols: role initials (``o`` any other), capitals for truncated rows, ``x`` for rows that must go.
SYMBOLS = "suaoSUAOx"
_RULE_CHAR = 0xE000


@dataclass
class Matrix:
    """Cost, rank of the audit among those from the same state, and the rope: (inserted, edit, new role) of a row, or the middle state of a pair."""

    cost: list[int]
    rank: list[int]
    rope: list
    left: Matrix | None = None
    right: Matrix | None = None


def row_matrix(symbol: str) -> Matrix:
    role, late = symbol.lower(), TRUNCATED * symbol.isupper()
    cost, rank, rope = [NEVER] * 16, [0] * 16, [None] * 16
    for start in range(STATES):
        best: dict[int, tuple] = {}
        for inserted, at in INSERTS[start]:
            edits = [("D", "", at, DELETE)]
            if symbol != "x":
                if role in NEXT[at]:
                    edits.append(("K", "", NEXT[at][role], KEEP + late))
                new = "a" if at == 2 else "u"
                edits.append(("R", new, NEXT[at][new], REROLE + late))
            for edit, new, end, price in edits:
                way = (price + INSERT * len(inserted), "I" * len(inserted) + edit, (inserted, edit, new))
                best[end] = min(best.get(end, way), way)
        for place, end in enumerate(sorted(best, key=lambda e: best[e][1])):
            cost[4 * start + end], rank[4 * start + end], rope[4 * start + end] = best[end][0], place, best[end][2]
    return Matrix(cost, rank, rope)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest ways through both, ties by the least audit: different middle states differ inside the left audit already."""
    cost, rank, rope = [NEVER] * 16, [0] * 16, [None] * 16
    for i in range(STATES):
        order = []
        for j in range(STATES):
            ways = [(a.cost[4 * i + m] + b.cost[4 * m + j], a.rank[4 * i + m], m) for m in range(STATES)]
            price, first, m = min(w for w in ways) if (ways := [w for w in ways if w[0] < NEVER]) else (NEVER, 0, None)
            if m is not None:
                cost[4 * i + j], rope[4 * i + j] = price, m
                order.append((first, b.rank[4 * m + j], j))
        for place, (_, _, j) in enumerate(sorted(order)):
            rank[4 * i + j] = place
    return Matrix(cost, rank, rope, a, b)


def unroll(matrix: Matrix, start: int, end: int) -> list[tuple[str, str, str]]:
    """(inserted, edit, new role) of every row along the rope, without recursion."""
    out, todo = [], [(matrix, start, end)]
    while todo:
        m, i, j = todo.pop()
        way = m.rope[4 * i + j]
        if m.left is None:
            out.append(way)
        else:
            todo.append((m.right, way, j))
            todo.append((m.left, i, way))
    return out


@dataclass
class Grammar:
    """Rules in the order in which they were made: a pair of symbols and the character that stands for it."""

    rules: list[tuple[str, str]] = field(default_factory=list)
    _matrices: dict[str, Matrix] = field(default_factory=dict)
    _pieces: dict[str, Matrix] = field(default_factory=dict)

    def compress(self, symbols: str) -> str:
        for pair, char in self.rules:
            if pair[0] in symbols:
                symbols = symbols.replace(pair, char)
        return symbols

    def matrices(self) -> dict[str, Matrix]:
        """One matrix per symbol, rules from the bottom up."""
        if not self._matrices:
            self._matrices = {s: row_matrix(s) for s in SYMBOLS}
            for pair, char in self.rules:
                self._matrices[char] = product(self._matrices[pair[0]], self._matrices[pair[1]])
        return self._matrices

    def piece(self, symbols: str) -> Matrix:
        """The matrix of a piece; those seen last are kept by the worker."""
        if symbols not in self._pieces:
            if len(self._pieces) >= 20_000:
                self._pieces.clear()
            known = self.matrices()
            first, *rest = self.compress(symbols)
            done = known[first]
            for s in rest:
                done = product(done, known[s])
            self._pieces[symbols] = done
        return self._pieces[symbols]


def pair_counts(symbols: str) -> Counter:
    """Neighbouring pairs; those of one symbol with itself do not overlap."""
    counts: Counter = Counter()
    last = None
    for k in range(len(symbols) - 1):
        pair = symbols[k:k + 2]
        if pair[0] == pair[1] and last == k - 1 and symbols[k - 1:k + 1] == pair:
            continue  # the middle one belongs to the pair before
        counts[pair] += 1
        last = k
    return counts


def choose(pairs: list[tuple[str, int]]) -> list[str]:
    """Most frequent pairs of which no two can overlap."""
    lefts, rights, chosen = set(), set(), []
    for pair, _ in pairs:
        a, b = pair
        if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        chosen.append(pair)
    return chosen


def build_grammar(pieces: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> Grammar:
    """Re-Pair over all distinct pieces. A round counts the pairs of the whole table and brings the ``rules`` most frequent ones to the driver."""
    distinct = materialise(pieces.groupBy("symbols").agg(F.count("*").alias("n")), "pieces")
    grammar = Grammar()
    for _ in range(rounds):
        rewrite = Grammar(list(grammar.rules)).compress

        def count(batches: Iterator[pa.RecordBatch], rewrite=rewrite) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                    for pair, k in pair_counts(rewrite(symbols)).items():
                        total[pair] += k * n
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pair", "n"])

        found = distinct.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        top = found.orderBy(F.desc("n"), "pair").limit(rules).collect()
        chosen = choose([(r["pair"], r["n"]) for r in top])
        if not chosen:
            break
        grammar.rules += [(pair, chr(_RULE_CHAR + len(grammar.rules) + k)) for k, pair in enumerate(chosen)]
    return grammar


def judged(turns: DataFrame) -> DataFrame:
    """Numbered turns with their first fault, initial and symbol."""
    repeated = turns.groupBy("conv", "same").agg(F.min("place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (
        F.when(bare == "", "blank").when(F.col("place") > F.col("_first"), "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return turns.join(repeated, ["conv", "same"], "left").select(
        "conv", "conv_id", "place", "turn", "role", "text", fault.alias("fault"), initial.alias("initial"),
        F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(known)).otherwise(known).alias("symbol"),
    )


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """``conv, piece, symbols, illegal, first, last``: at most ``size`` rows each."""
    gathered = rows.groupBy("conv", F.floor((F.col("place") - 1) / size).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("place", "symbol", "initial"))).alias("r")
    )
    pairs = F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda k: F.concat(F.col("r")[k]["initial"], F.col("r")[k + 1]["initial"]))
    wrong = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    return gathered.select(
        "conv", "piece", F.array_join(F.transform("r", lambda x: x["symbol"]), "").alias("symbols"),
        F.when(F.size("r") > 1, wrong).otherwise(0).cast("long").alias("illegal"),
        F.col("r")[0]["initial"].alias("first"), F.element_at("r", -1)["initial"].alias("last"),
    )


_PATH = "conv binary, cost long, illegal long, steps array<struct<piece: bigint, start: int, end: int, closing: string>>"


def _transfer(grammar: Grammar):
    """Cost and rank matrix of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [grammar.piece(s) for s in batch.column("symbols").to_pylist()]
            columns = [batch.column(c) for c in ("conv", "piece", "illegal", "first", "last")]
            yield pa.record_batch(
                [*columns, pa.array([m.cost for m in done], pa.list_(pa.int64())), pa.array([m.rank for m in done], pa.list_(pa.int32()))],
                names=["conv", "piece", "illegal", "first", "last", "cost", "rank"],
            )

    return run


def cheapest_path(pieces: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """Cost without what closes the end, and (start, end) state of each piece; ``pieces`` have cost and rank matrices."""
    cost, rank, back = [0, NEVER, NEVER, NEVER], [0] * 4, []
    for p in pieces:
        new, came, order = [NEVER] * 4, [None] * 4, []
        for j in range(STATES):
            ways = [(cost[m] + p["cost"][4 * m + j], rank[m], m) for m in range(STATES)]
            if ways := [w for w in ways if w[0] < NEVER]:
                new[j], _, m = min(ways)
                came[j] = m
                order.append((rank[m], p["rank"][4 * m + j], j))
        back.append(came)
        cost, rank = new, [0] * 4
        for place, (_, _, j) in enumerate(sorted(order)):
            rank[j] = place
    total, _, state = min((cost[j] + INSERT * len(CLOSING[j]), rank[j], j) for j in range(STATES))
    path = []
    for came in reversed(back):
        path.append((came[state], state))
        state = came[state]
    return total, path[::-1]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest way through all pieces of a conversation."""
    step = pa.struct([("piece", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("closing", pa.string())])
    for batch in batches:
        costs, wrong, steps = [], [], []
        for pieces in batch.column("pieces").to_pylist():
            total, path = cheapest_path(pieces)
            borders = zip(pieces, pieces[1:])
            costs.append(total)
            wrong.append(sum(p["illegal"] for p in pieces) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in borders))
            ends = [""] * (len(path) - 1) + [CLOSING[path[-1][1]]]
            steps.append([{"piece": p["piece"], "start": i, "end": j, "closing": c} for p, (i, j), c in zip(pieces, path, ends)])
        yield pa.record_batch(
            [batch.column("conv"), pa.array(costs, pa.int64()), pa.array(wrong, pa.int64()), pa.array(steps, pa.list_(step))],
            names=["conv", "cost", "illegal", "steps"],
        )


def _edits(grammar: Grammar):
    """The edits of a piece: what is inserted before each row, the row's edit and its new role."""
    edit = pa.struct([("inserted", pa.string()), ("edit", pa.string()), ("to", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, edits = [], []
            for symbols, i, j, closing in zip(*[batch.column(c).to_pylist() for c in ("symbols", "start", "end", "closing")]):
                rows = unroll(grammar.piece(symbols), i, j)
                audits.append("".join("I" * len(ins) + e for ins, e, _ in rows) + "I" * len(closing))
                edits.append([{"inserted": ins, "edit": e, "to": to} for ins, e, to in rows])
            yield pa.record_batch(
                [batch.column("conv"), batch.column("piece"), batch.column("closing"), pa.array(audits, pa.string()), pa.array(edits, pa.list_(edit))],
                names=["conv", "piece", "closing", "audit", "edits"],
            )

    return run


@dataclass
class Repair:
    """``reports``: one row per conversation; ``rows``: the repaired turns (``conv, conv_id, place, sub, role, text, edit``)."""

    reports: DataFrame
    rows: DataFrame


def repair_structure(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    piece: int = PIECE, rounds: int = ROUNDS, rules: int = RULES,
) -> Repair:
    """Cheapest edits that give every conversation the role initials ``(s?(ua)+)?``.

    A row's first fault counts: blank (only white space), duplicate (role and text stood earlier), truncated (the last character that is no white space is none of ``.!?``). Keeping is free, a new role
    (user or assistant) costs 3, deletion 4 and is a must for blank and duplicate rows, insertion of an empty user or assistant turn 3; truncated rows that stay cost 3 more. Among the cheapest
    audits the least by ASCII is taken. ``reports`` has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``; counts describe the rows before repair.

    At most ``piece`` rows of a conversation meet in one cell as symbols, and a piece is 32 numbers afterwards. The grammar has at most ``rounds * rules`` rules, each counted over all pieces. Repaired
    turns stay rows; only a conversation's digest, which is sequential by nature, and its audit come together.

    Null role and text are one space, a null turn comes first and counts for no gap, rows with a null id are one conversation. Ties in turn are ordered by a hash of role and text;
    repeated rows are duplicates. Empty texts are blank; a text may be of any length. Roles are judged by their first character, an empty role has none. An empty table gives
    empty results; further columns are not read.
    """
    given = only(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    spaced = given.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
    rows = materialise(judged(numbered(spaced, "turns")), "judged")
    pieces = materialise(_pieces(rows, piece), "symbols")
    grammar = build_grammar(pieces, rounds, rules)
    kinds = "conv binary, piece long, illegal long, first string, last string, cost array<bigint>, rank array<int>"
    transfers = pieces.mapInArrow(_transfer(grammar), kinds)
    folded = transfers.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("piece", "cost", "rank", "illegal", "first", "last"))).alias("pieces")
    )
    paths = materialise(folded.mapInArrow(_fold, _PATH), "paths")
    steps = paths.select("conv", F.explode("steps").alias("s")).select("conv", "s.*")
    edits = materialise(
        pieces.select("conv", "piece", "symbols").join(steps, ["conv", "piece"]).mapInArrow(
            _edits(grammar), "conv binary, piece long, closing string, audit string, edits array<struct<inserted: string, edit: string, to: string>>"
        ),
        "edits",
    )
    repaired = _repaired(rows, edits, piece)
    digests = ordered_digest(
        repaired.select(F.col("conv").alias("key"), "place", "sub", F.concat("role", F.lit(":"), "text").alias("piece")), "place", "sub"
    ).withColumnRenamed("key", "conv")
    audits = edits.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", "audit"))).alias("a")).select(
        "conv", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit")
    )
    of = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), of("blank"), of("duplicate"), of("truncated"))
    reports = counts.join(paths.select("conv", "cost", "illegal"), "conv").join(audits, "conv").join(digests, "conv", "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return Repair(reports, repaired)


def _repaired(rows: DataFrame, edits: DataFrame, piece: int) -> DataFrame:
    """Edits joined to their rows; inserted turns stand before theirs, closing ones behind the last."""
    at = edits.select("conv", "piece", F.posexplode("edits").alias("k", "e")).select(
        "conv", (F.col("piece") * piece + F.col("k") + 1).alias("place"), "e.*"
    )
    turn = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))
    full = lambda initial: F.when(initial == "u", ROLES["u"]).otherwise(ROLES["a"])
    inserted = lambda initials: F.transform(
        F.filter(F.split(initials, ""), lambda c: c != ""), lambda c: turn(full(c), F.lit(""), "insert")
    )
    own = (
        F.when(F.col("edit") == "K", F.array(turn(F.col("role"), F.col("text"), "keep")))
        .when(F.col("edit") == "R", F.array(turn(full(F.col("to")), F.col("text"), "rerole")))
        .otherwise(F.array().cast("array<struct<role: string, text: string, edit: string>>"))
    )
    inside = rows.select("conv", "conv_id", "place", "role", "text").join(at, ["conv", "place"]).select(
        "conv", "conv_id", "place", F.posexplode(F.concat(inserted(F.col("inserted")), own)).alias("sub", "t")
    )
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), (F.max("place") + 1).alias("place"))
    behind = edits.where("closing <> ''").select("conv", "closing").join(ids, "conv").select(
        "conv", "conv_id", "place", F.posexplode(inserted(F.col("closing"))).alias("sub", "t")
    )
    return inside.unionByName(behind).select("conv", "conv_id", "place", "sub", "t.role", "t.text", "t.edit")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by ``crc32('conv_id:turn') % 20``: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn"))) % 20
    rows = conversations.select("conv_id", "turn", words("role").alias("role"), words("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Reports of damaged conversations, with a row for every original id; one without any row left has zeros, an empty audit and the hash of an empty text."""
    given = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    reports = repair_structure(damage(given)).reports.withColumn("_c", key128(F.col("conv_id"))).drop("conv_id")
    every = given.groupBy("conv_id").agg(F.count("*").alias("_n")).withColumn("_c", key128(F.col("conv_id"))).drop("_n")
    joined = every.join(reports, "_c", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
