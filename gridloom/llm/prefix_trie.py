"""The prefix trie of conversations, from the longest common prefixes of sorted neighbours.

Conversations are sorted by their turns. Edges between neighbours are united in descending depth of their common prefix; every union of components makes a branching node, or
grows the one of that depth. The sorted order is cut into chunks of fixed length, and each chunk has a ghost leaf on both sides that is joined at the depth that the chunk shares with the neighbour there.
Nodes without a ghost are finished inside their chunk. Nodes with one are contracted to a row of sums; a single pass over these rows, in the order of the chunks, merges them across the boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import key128
from gridloom.llm.turns import numbered, ordered_digest, running_length
from gridloom.operators.ordinal import with_ordinal
from gridloom.session import materialise

#: Sorted sequences of one chunk, and children of one block in the ranking.
CHUNK, FAN = 8192, 16


@dataclass
class Node:
    """A branching node or leaf: its depth, the characters down to there, and sums over what hangs below it."""

    depth: int
    upto: int
    n: int = 0
    conv: int | None = None
    kids: int = 0
    leaves: int = 0
    below: int = 0
    ends: int | None = None
    ghost: str = ""
    children: list = field(default_factory=list)

    def take(self, n: int, conv: int | None, kids: int, leaves: int, below: int, ends: int | None) -> None:
        self.n += n
        if conv is not None:
            self.conv = conv if self.conv is None else min(self.conv, conv)
        self.kids += kids
        self.leaves += leaves
        self.below += below
        if ends is not None:
            self.ends = ends

    def adopt(self, child: Node) -> None:
        """A finished child hangs below with the whole chain between the two nodes."""
        self.take(child.n, child.conv, 1, child.leaves if child.kids else 1, child.below + (child.n - 1) * (child.upto - self.upto), None)


def forest(rows: list[dict], next_lcp: int, next_upto: int) -> list[Node]:
    """Nodes of a chunk by union-find over its edges in descending depth, children before parents; those that hold a ghost are open and lack what lies outside.

    ``rows``: ``rank, conv, n, len, upto, lcp, lcp_upto`` in the order of rank; ``lcp`` is shared with the row before.
    """
    m = len(rows)
    left, right = Node(-1, 0, ghost="L"), Node(-1, 0, ghost="R")
    leaves = [Node(r["len"], r["upto"], r["n"], r["conv"], ends=r["rank"]) for r in rows]
    top = [left, *leaves, right]
    edges = [(r["lcp"], r["lcp_upto"]) for r in rows] + [(next_lcp, next_upto)]
    parent = list(range(m + 2))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    made: list[Node] = []
    for e in sorted(range(m + 1), key=lambda e: (-edges[e][0], e)):
        depth, upto = edges[e]
        a, b = find(e), find(e + 1)
        x, y = top[a], top[b]
        if x.depth != depth and y.depth == depth:
            x, y = y, x
        if x.depth != depth:
            node = Node(depth, upto, children=[x, y])
        elif y.depth == depth:
            node = x
            node.children += y.children
            node.take(y.n, y.conv, 0, 0, 0, y.ends)
        else:
            node = x
            node.children.append(y)
        parent[b] = a
        top[a] = node
    # children first, without recursion
    order, todo = [], [top[find(0)]]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        if node.depth < 0:
            continue
        for child in node.children:
            if child.ghost:
                node.ghost += "".join(g for g in child.ghost if g not in node.ghost)
            else:
                node.adopt(child)
        made.append(node)
    return made


_OPEN = "part long, place int, ghost string, depth long, upto long, n long, conv long, kids long, leaves long, below long, ends long, least long, next_lcp long"
_NODE = "conv long, depth long, above long, parent long, upto long, n long, kids long, leaves long, below long, ends long"
_FACT = "part long, place int, conv long"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.record_batch([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _chunk(table: pa.Table) -> tuple[list[dict], int, int]:
    rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
    return rows, rows[-1]["next_lcp"] or 0, rows[-1]["next_upto"] or 0


def _contract(key: tuple, table: pa.Table) -> pa.Table:
    """Open nodes of a chunk with the sums of what is finished below them, ``least`` is the shortest prefix that neighbours in the chunk share."""
    rows, next_lcp, next_upto = _chunk(table)
    least = min((r["lcp"] for r in rows[1:]), default=None)
    nodes = [n for n in forest(rows, next_lcp, next_upto) if n.ghost]
    return pa.Table.from_batches([_table([
        (key[0].as_py(), k, n.ghost, n.depth, n.upto, n.n, n.conv, n.kids, n.leaves, n.below, n.ends, least, next_lcp) for k, n in enumerate(nodes)
    ], _OPEN)])


@dataclass
class _Merged:
    node: Node
    parts: list[tuple[int, int]] = field(default_factory=list)
    done: list[Node] = field(default_factory=list)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the open nodes of all chunks, in order: nodes of one depth at a boundary are one node. Yields nodes (``place`` null) and facts."""
    stack = [_Merged(Node(0, 0))]
    nodes, facts = [], []

    def close(merged: _Merged, above: _Merged | None) -> None:
        for child in merged.done:
            nodes.append((None, None, child.conv, child.depth, merged.node.depth, merged.node.conv, child.upto, child.n, child.kids, child.leaves, child.below, child.ends))
        facts.extend((part, place, merged.node.conv, *[None] * 9) for part, place in merged.parts)
        if above is not None:
            above.node.adopt(merged.node)
            above.done.append(merged.node)

    def pop_beyond(depth: int) -> None:
        while stack[-1].node.depth > depth:
            last = stack.pop()
            close(last, stack[-1])

    def put(row: dict) -> None:
        at = len(stack)
        while stack[at - 1].node.depth > row["depth"]:
            at -= 1
        if stack[at - 1].node.depth < row["depth"]:
            stack.insert(at, _Merged(Node(row["depth"], row["upto"])))
            at += 1
        merged = stack[at - 1]
        merged.node.take(row["n"], row["conv"], row["kids"], row["leaves"], row["below"], row["ends"])
        merged.parts.append((row["part"], row["place"]))

    def chunk(rows: list[dict]) -> None:
        for row in (r for r in rows if "L" in r["ghost"]):
            put(row)
        if rows[0]["least"] is not None:
            pop_beyond(rows[0]["least"])
        reach = rows[0]["next_lcp"]
        pop_beyond(reach)
        for row in sorted((r for r in rows if "L" not in r["ghost"]), key=lambda r: r["depth"]):
            put(row)

    schema = f"{_FACT}, depth long, above long, parent long, upto long, n long, kids long, leaves long, below long, ends long"
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["part"] != row["part"]:
                chunk(held)
                held = []
            held.append(row)
        yield _table(nodes, schema)
        yield _table(facts, schema)
        nodes.clear(), facts.clear()
    if held:
        chunk(held)
        pop_beyond(0)
        close(stack[0], None)
        root = stack[0].node
        nodes.append((None, None, root.conv, 0, -1, None, 0, root.n, root.kids, root.leaves, root.below, root.ends))
    yield _table(nodes, schema)
    yield _table(facts, schema)


def _finish(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
    """The finished nodes of a chunk; a parent that is open has its conversation from ``known``."""
    rows, next_lcp, next_upto = _chunk(table)
    facts = dict(zip(known.column("place").to_pylist(), known.column("conv").to_pylist()))
    nodes = forest(rows, next_lcp, next_upto)
    out, place = [], 0
    for node in nodes:
        conv = node.conv
        if node.ghost:
            conv, place = facts[place], place + 1
        out += [
            (c.conv, c.depth, node.depth, conv, c.upto, c.n, c.kids, c.leaves, c.below, c.ends)
            for c in node.children if not c.ghost
        ]
    return pa.Table.from_batches([_table(out, _NODE)])


def sequence_ranks(turns: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``conv, rank`` of every sequence in lexicographic order of its turns' hashes (equal ones share a rank), and the block tables of each level.

    Prefix doubling by sixteens: a block lists the ranks of up to 16 blocks of the level below; distinct blocks are sorted and numbered. So a sequence of any
    length is never in one cell.
    """
    level = turns.select("conv", (F.col("place") - 1).alias("at"), F.col("same").alias("id"))
    last = turns.agg(F.max("place")).first()[0] or 0
    tables, reach = [], 1
    while reach < last or not tables:
        reach *= FAN
        blocks = level.groupBy("conv", F.floor(F.col("at") / FAN).alias("at")).agg(
            F.sort_array(F.collect_list(F.struct("at", "id"))).alias("b")
        ).select("conv", "at", F.transform("b", lambda x: x["id"]).alias("ids"))
        blocks = materialise(blocks, "blocks")
        distinct = blocks.groupBy("ids").agg(F.count("*").alias("_n")).drop("_n")
        table = materialise(with_ordinal(distinct, "ids", name="id"), "block-ranks")
        tables.append(table)
        level = materialise(blocks.join(table, "ids").select("conv", "at", "id"), "level")
    return level.select("conv", F.col("id").alias("rank")), tables


def neighbour_prefixes(tables: list[DataFrame]) -> DataFrame:
    """``rank, lcp``: turns that each sorted sequence shares with the one before it, from the largest blocks down."""
    top = tables[-1]
    pairs = top.select(F.col("id").alias("rank"), F.col("id").alias("right"), (F.col("id") - 1).alias("left"), F.lit(0).cast("long").alias("lcp")).where("rank > 0")
    for k in range(len(tables) - 1, -1, -1):
        side = lambda name: tables[k].select(F.col("id").alias(name), F.col("ids").alias(f"{name}_ids"))
        met = pairs.join(side("left"), "left").join(side("right"), "right")
        short = F.least(F.size("left_ids"), F.size("right_ids"))
        same = F.aggregate(
            F.sequence(F.lit(1), short), F.lit(0),
            lambda n, i: F.when((n == i - 1) & (F.col("left_ids")[i - 1] == F.col("right_ids")[i - 1]), i).otherwise(n),
        )
        met = met.withColumn("_m", same)
        pairs = materialise(met.select(
            "rank", (F.col("lcp") + F.col("_m") * FAN**k).alias("lcp"),
            *([F.get("left_ids", F.col("_m")).alias("left"), F.get("right_ids", F.col("_m")).alias("right")] if k else []),
        ), "prefixes")
        if k:
            # one side ends here: its prefix is known
            ended = pairs.where("left is null or right is null").select("rank", "lcp")
            tail = ended if k == len(tables) - 1 else tail.unionAll(ended)
            pairs = pairs.where("left is not null and right is not null")
    return pairs.select("rank", "lcp").unionAll(tail) if len(tables) > 1 else pairs.select("rank", "lcp")


def prefix_trie(turns: DataFrame, conversations: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """One row per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, place`` (1-based, without gaps), ``same`` (128-bit hash of role and text) and ``chars`` (code points of the text); ``conversations`` has every ``conv_id`` (whole
    numbers), also those without turns. A node is named by the smallest conversation that starts with it. ``saved_tokens`` sums ``(n_convs - 1) * chars`` of the last turn over the subtree, ``ends_sha256`` is the
    SHA-256 of the ids, ascending with commas between, of the conversations that end in the node.

    Chunks of ``chunk`` distinct sequences meet in one task, whatever the size of the input; equal conversations are counted before. Open nodes of all chunks pass through one task as a stream that keeps the
    path at the current boundary; a path of k open nodes needs a conversation of at least k turns. Turns and nodes stay rows. A SHA-256 is sequential, so the ids of a node's copies pass one task
    in order, without being kept.

    Null ids belong to no conversation and are left out. An empty table has no nodes; conversations without turns end in the root. Turns are compared by their hash.
    """
    conv = F.col("conv_id").cast("long").alias("conv")
    turns = materialise(running_length(turns.where("conv_id is not null").select(conv, F.col("place").cast("long").alias("place"), "same", F.col("chars").cast("long").alias("chars")), "turns"), "trie-turns")
    ranks, tables = sequence_ranks(turns)
    every = conversations.where("conv_id is not null").groupBy(conv).agg(F.count("*").alias("_n")).drop("_n")
    # the sequence without turns has rank 0, all others come behind it
    members = materialise(every.join(ranks, "conv", "left").select("conv", F.coalesce(F.col("rank") + 1, F.lit(0)).alias("rank")), "members")
    sizes = turns.groupBy("conv").agg(F.max("place").alias("len"), F.max("upto").alias("upto"))
    leaves = members.groupBy("rank").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).join(sizes, "conv", "left").select(
        "rank", "conv", "n", F.coalesce("len", F.lit(0)).cast("long").alias("len"), F.coalesce("upto", F.lit(0)).cast("long").alias("upto")
    )
    shared = neighbour_prefixes(tables).select((F.col("rank") + 1).alias("rank"), "lcp")
    sums = turns.select("conv", F.col("place").alias("lcp"), F.col("upto").alias("lcp_upto"))
    placed = leaves.join(shared, "rank", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)).cast("long")).join(sums, ["conv", "lcp"], "left")
    placed = materialise(
        placed.select(F.floor(F.col("rank") / chunk).alias("part"), "rank", "conv", "n", "len", "upto", "lcp", F.coalesce("lcp_upto", F.lit(0)).cast("long").alias("lcp_upto")), "sequences"
    )
    # what the first row of each chunk shares with the chunk before; a row per chunk
    borders = placed.groupBy("part").agg(F.min_by(F.struct("lcp", "lcp_upto"), "rank").alias("b")).select(
        (F.col("part") - 1).alias("part"), F.col("b.lcp").alias("next_lcp"), F.col("b.lcp_upto").alias("next_upto")
    )
    placed = placed.join(borders, "part", "left")
    opened = placed.groupBy("part").applyInArrow(_contract, _OPEN)
    merged = materialise(
        opened.repartition(1).sortWithinPartitions("part", "place").mapInArrow(
            _merge, f"{_FACT}, depth long, above long, parent long, upto long, n long, kids long, leaves long, below long, ends long"
        ), "merged",
    )
    facts = merged.where("place is not null").select("part", "place", "conv")
    finished = placed.groupBy("part").cogroup(facts.groupBy("part")).applyInArrow(_finish, _NODE)
    spanning = merged.where("place is null").select("conv", "depth", "above", "parent", "upto", "n", "kids", "leaves", "below", "ends")
    nodes = materialise(finished.unionByName(spanning), "branches")
    ends = ordered_digest(
        members.select(F.unhex(F.lpad(F.hex("rank"), 16, "0")).alias("key"), "conv", F.col("conv").cast("string").alias("piece")), "conv", separator=","
    ).select(F.conv(F.hex("key"), 16, 10).cast("long").alias("ends"), "sha256")
    nodes = nodes.join(ends, "ends", "left")
    return _along(nodes, turns)


def _along(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Every node of the trie: the chain above each branching node, turn by turn."""
    chain = nodes.where("depth > 0").withColumn("place", F.explode(F.sequence(F.col("above") + 1, F.col("depth"))))
    texts = turns.select("conv", "place", (F.col("upto") - F.col("chars")).alias("before"))
    nothing = F.sha2(F.lit(""), 256)
    is_end, single = F.col("place") == F.col("depth"), F.col("place") == F.col("above") + 1
    inner = chain.join(texts, ["conv", "place"]).select(
        F.col("conv").alias("conv_id"), F.col("place").alias("depth"), F.when(single, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(is_end, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.when(F.col("kids") > 0, F.col("leaves")).otherwise(1).cast("long").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("upto") - F.col("before"))).alias("saved_tokens"),
        F.when(is_end, F.coalesce("sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
    root = nodes.where("depth = 0").select(
        F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.when(F.col("kids") > 0, F.col("leaves")).otherwise(1).cast("long").alias("n_leaves"),
        F.col("below").alias("saved_tokens"), F.coalesce("sha256", nothing).alias("ends_sha256"),
    )
    return inner.unionByName(root)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, same, chars``: each conversation with its first ``h = crc32(id) % 6`` turns taken from conversation ``id - id % 100``.

    Turns are ordered by number (null first), ties by a hash of role and text; null role and text are empty. Null ids are left out.
    """
    given = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    own = numbered(given, "own-turns").select("conv_id", "place", "same", F.length("text").cast("long").alias("chars"))
    most = 5
    donors = materialise(own.where(f"conv_id % 100 = 0 and place <= {most}").withColumnRenamed("conv_id", "donor"), "donors")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("_n")).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("donor"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h")
    )
    lengths = donors.groupBy("donor").agg(F.count("*").alias("given"))
    convs = materialise(convs.join(lengths, "donor", "left").withColumn("k", F.least("h", F.coalesce("given", F.lit(0)))), "heads")
    heads = convs.select("conv_id", "donor", "h").join(donors, "donor").where("place <= h").select("conv_id", "place", "same", "chars")
    tails = own.join(convs.select("conv_id", "h", "k"), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "same", "chars"
    )
    return materialise(heads.unionByName(tails), "rebuilt")
