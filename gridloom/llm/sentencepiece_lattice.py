"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece can cross: a run of spaces with the letters or the other characters behind it, and line ends. A task encodes each of its distinct
units once: the distinct substrings up to the longest piece are joined to the piece table; those found are the edges of the unit's lattice, and
a fold over them gives its ids. Substrings that no piece can equal are sieved out before the join. The texts of the task follow as numbers of their units
and look them up, so neither texts nor units are shuffled.

The fold follows the model. A BPE model merges neighbours in the order of scores, so its ids are not those of the path with the best sum; the fold
here merges along the edges of the lattice, best score first and leftmost first, as the library does.
"""

from __future__ import annotations

import functools
import heapq
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.text import by_bytes, only, text_or_empty
from gridloom.session import materialise

SPACE_MARK = "▁"
#: Units that are broadcast with their ids, the most frequent ones, and their longest form; all others are joined by a shuffle.
FREQUENT, LONGEST_FREQUENT = 500_000, 64
#: Lattice starts that are exploded from one block of a long unit.
BLOCK = 48
#: Base of the 64-bit keys of substrings, and the factor that spreads keys over a sieve.
KEY_BASE, KEY_SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Units and their characters that a task keeps; bytes of texts that it cuts, and units or ids that it looks up, together.
TASK_UNITS, TASK_CHARS, SLICE_BYTES, SLICE_UNITS = 400_000, 8_000_000, 2 << 20, 1 << 17
#: Distinct substrings that a task keeps; their numbers take the place of ids, so fewer than ``1 << 24`` with those of one more batch.
TASK_PARTS = 1 << 20
#: Characters of blocks whose keys are made together, units that are folded together, and the longest unit that is folded so.
NEW_CHARS, FOLD_UNITS, LONGEST_TOGETHER = 1 << 15, 8192, 64
#: Rank of what is no edge.
_NEVER = 1 << 30
_UNITS = f"\n|{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+"
#: The same where no piece has letters (and their marks) beside other characters.
_LETTER_UNITS = rf"\n|{SPACE_MARK}*[\p{{L}}\p{{M}}]+|{SPACE_MARK}*[^\p{{L}}\p{{M}}{SPACE_MARK}\n]+|{SPACE_MARK}+"


class Model:
    """Pieces, scores and special ids of a model file, read on the driver."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in plain]
        self.unknown = sp.unk_id()
        self.longest = max((len(p) for p, _, _ in self.pieces), default=1)
        bare = [p.lstrip(SPACE_MARK) for p, _, _ in self.pieces]
        crossing = [p for p in bare if SPACE_MARK in p or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross the units of this encoder: {crossing[:3]}")
        mixed = any(len({unicodedata.category(c)[0] in "LM" for c in p}) > 1 for p in bare)
        self.mixed, self.units = mixed, _UNITS if mixed else _LETTER_UNITS

    def table(self, spark: SparkSession) -> DataFrame:
        """``key, piece, id``; bounded by the model's vocabulary."""
        return spark.createDataFrame([(piece_key(p), p, i) for p, i, _ in self.pieces], "key long, piece string, id int")

    def keys(self) -> np.ndarray:
        """Keys of all pieces, for ``_Sieve``."""
        return np.array([piece_key(p) for p, _, _ in self.pieces], np.int64)

    def spelled(self) -> dict[int, bytes]:
        """Bytes of each id for decoding."""
        return {i: p.encode() for p, i, _ in self.pieces} | {i: bytes([b]) for b, i in self.bytes.items()}


def marked(text: Column) -> Column:
    """A text with marks for spaces; it gets the space that the library puts before it unless it is empty."""
    return F.when(text == "", text).otherwise(F.concat(F.lit(SPACE_MARK), F.replace(text, F.lit(" "), F.lit(SPACE_MARK))))


def units_of(text: Column, model: Model) -> Column:
    """Units of a text in order. None for an empty text."""
    return F.regexp_extract_all(marked(text), F.lit(model.units), F.lit(0))


@functools.lru_cache(2)
def _classes(mixed: bool) -> np.ndarray:
    """Of each character: 0 or 1 inside a unit (letters and their marks have 1 where units part them from others), 2 for a space mark, 3 for a line end."""
    found = np.zeros(0x110000, np.uint8)
    if not mixed:
        kinds = "".join(map(unicodedata.category, map(chr, range(0x110000)))).encode()
        found[np.isin(np.frombuffer(kinds, np.uint8)[::2], list(b"LM"))] = 1
    found[ord(SPACE_MARK)], found[ord("\n")] = 2, 3
    return found


def _cut(texts: pa.Array, classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units of marked texts, as ``units_of`` cuts them, all in one array that shares the texts' bytes, and their number in each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    if whole is None or offsets[0] == offsets[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    whole, offsets = whole.slice(int(offsets[0]), int(offsets[-1] - offsets[0])), offsets - offsets[0]
    starts = np.flatnonzero((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80).astype(np.int32)
    kind = classes[np.frombuffer(str(whole, "utf-8").encode("utf-32-le"), "<u4")]
    first = kind == 3
    first[0] = True
    first[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != 2)
    first[np.searchsorted(starts, offsets[:-1][offsets[:-1] < offsets[-1]])] = True
    cuts = np.append(starts[first], offsets[-1])
    units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), whole)
    return units, np.diff(np.searchsorted(cuts, offsets))


def _strings(names: pa.Array) -> list[str]:
    return names.to_numpy(zero_copy_only=False).tolist()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def piece_key(piece: str) -> int:
    """The number that stands for a piece in the join; substrings get theirs from ``_keys``."""
    key = 0
    for code in _codes(piece).tolist():
        key = (key * KEY_BASE + code) % (1 << 64)
    return key - (1 << 64) if key >> 63 else key


class _Sieve:
    """Tells keys that are no piece's from those that may be: each piece marks a place in two tables of at least 16 places a piece. Never wrong about a piece; the join decides about the rest."""

    def __init__(self, keys: np.ndarray):
        bits = max(len(keys), 1).bit_length() + 4
        self.shift, self.last = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.tables = np.zeros((2, 1 << bits), bool)
        for table, places in zip(self.tables, self._places(keys.view(np.uint64))):
            table[places] = True

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = keys * np.uint64(KEY_SPREAD)
        return (spread >> self.shift).view(np.int64), ((spread >> np.uint64(20)) & self.last).view(np.int64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        one, two = self._places(keys)
        found = self.tables[0][one]
        some = np.flatnonzero(found)
        found[some] = self.tables[1][two[some]]
        return found


def _keys(blocks: list[str], starts: np.ndarray, heads: np.ndarray, longest: int, sieve: _Sieve | None = None) -> pa.Array:
    """For each block a list of lists: ``[0]`` where a unit begins, else none, then the keys of the substrings of two characters or more from each of its first ``starts`` characters, shortest first.

    With a sieve, the substrings from a character end with the longest one that may be a piece.
    """
    codes, sizes = _codes("".join(blocks)), np.fromiter(map(len, blocks), np.int64, len(blocks))
    ends = np.cumsum(sizes)
    inside = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    room = np.where(inside < np.repeat(starts, sizes), np.minimum(np.repeat(ends, sizes) - np.arange(len(codes)), longest), 0)
    each = [codes]  # keys of the substrings of 1, 2, ... characters from each character
    for length in range(2, min(longest, len(codes)) + 1):
        each.append(each[-1][:-1] * np.uint64(KEY_BASE) + codes[length - 1:])
    if sieve is not None:
        most, room = room, np.zeros_like(room)
        for length, key in enumerate(each[1:], 2):
            room[:len(key)][sieve.may_hold(key) & (most[:len(key)] >= length)] = length
    held = np.maximum(room - 1, 0)
    before = np.cumsum(held) - held  # values in front of each character
    found = np.zeros(int(held.sum()), np.uint64)
    for length, key in enumerate(each[1:], 2):
        some = np.flatnonzero(room >= length)
        found[before[some] + (length - 2)] = key[some]
    found = found.view(np.int64)
    first = (ends - sizes)[heads]
    values = np.insert(found, before[first], 0)
    inner = np.insert(held[inside < np.repeat(starts, sizes)], np.cumsum(starts) - starts, heads.astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(starts + 1)]).astype(np.int32)), lists)


#: What ``lattice`` reads; further columns are handed on with a row's first edge.
_ROWS = "number long, unit string, at int, block string, keys array<array<long>>"


def _unit_rows(number: int, units: list[str], longest: int, sieve: _Sieve | None = None) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """The columns of ``_ROWS`` for units numbered from ``number`` on, one row a block, some rows at a time, with the place of each row's unit."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    blocks = -(-sizes // BLOCK)
    owners = np.repeat(np.arange(len(units)), blocks)
    at = (np.arange(len(owners)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    texts = units
    if len(owners) > len(units):
        texts = [units[k][a:a + BLOCK + longest - 1] for k, a in zip(owners.tolist(), at.tolist())]
    for low, high in by_bytes(list(map(len, texts)), NEW_CHARS):
        mine, places, some = owners[low:high], at[low:high], texts[low:high]
        heads = places == 0
        yield mine, [
            pa.array(number + mine), pa.array([units[k] if h else None for k, h in zip(mine.tolist(), heads.tolist())], pa.string()),
            pa.array(places.astype(np.int32)), pa.array(some, pa.string()), _keys(some, np.minimum(sizes[mine] - places, BLOCK), heads, longest, sieve),
        ]


def lattice(rows: DataFrame, model: Model, *carry: str) -> DataFrame:
    """``number, unit, edge``: the edges of the lattice of each unit, one row each, packed as ``place << 24 | id`` with ``place = start << 8 | length``.

    Substrings of two characters or more are joined to the pieces by a 64-bit key and kept where the texts are equal, so a key that two texts share does no harm. A unit's first row has no edge;
    it alone carries the unit and the columns ``carry``. A row without a unit gives that one row. The rows of a unit follow each other, as neither the explosion nor a broadcast join reorders
    rows; ``number`` lets the reader make sure. Long units come in blocks, so the work is in proportion to their length.
    """
    starts = rows.select("number", "unit", "at", "block", *carry, F.posexplode("keys").alias("first", "cuts"))
    cuts = starts.select("number", "unit", "at", "block", *carry, "first", F.posexplode("cuts").alias("more", "key"))
    return cuts.join(F.broadcast(model.table(rows.sparkSession)), "key", "left").where(
        "first = 0 or (id is not null and substring(block, first, more + 2) = piece)"
    ).select(
        "number", F.when(F.col("first") == 0, F.col("unit")).alias("unit"),
        F.when(F.col("first") > 0, F.expr("(((cast(at + first - 1 as bigint) << 8) | (more + 2)) << 24) | id")).alias("edge"),
        *[F.when(F.col("first") == 0, F.col(c)).alias(c) for c in carry],
    )


def merge(n: int, edges: dict[int, int], scores: dict[int, float]) -> list[tuple[int, int]]:
    """(start, end) of the symbols after all merges: the pair whose union is the best edge goes first, the leftmost of equals."""
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue: list[tuple[float, int, int, int]] = []

    def push(left: int) -> None:
        right = after[left]
        if right < n:
            end = after[right]
            hit = edges.get(left << 8 | end - left) if end - left < 256 else None
            if hit is not None:
                heapq.heappush(queue, (-scores[hit], left, right, end))

    for k in range(n - 1):
        push(k)
    while queue:
        _, left, right, end = heapq.heappop(queue)
        if not (alive[left] and alive[right] and after[left] == right and after[right] == end):
            continue
        alive[right], after[left] = False, end
        if end < n:
            before[end] = left
        push(left)
        if before[left] >= 0:
            push(before[left])
    return [(k, after[k]) for k in range(n) if alive[k]]


class _Fold:
    """Ids of units from the rows of their lattices. Units are gathered and folded together: in each round every unit makes its best merge."""

    def __init__(self, model: Model):
        self.spelled, self.unknown, self.longest = model.bytes, model.unknown, model.longest
        self.scores = {i: s for _, i, s in model.pieces}
        ids = np.array(list(self.scores), np.int64)
        self.ranks = np.full(int(ids.max(initial=0)) + 2, _NEVER, np.int64)  # by id + 1; 0 is no edge
        self.ranks[ids + 1] = np.unique(-np.array(list(self.scores.values())), return_inverse=True)[1]
        self.single = np.full(0x110000, -1, np.int32)
        for piece, i, _ in model.pieces:
            if len(piece) == 1:
                self.single[ord(piece)] = i
        self.names, self.numbers = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.edges: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, numbers: np.ndarray, names: pa.Array, edge: np.ndarray) -> None:
        """Rows of units, in order; ``edge`` is -1 in a unit's first row."""
        heads, more = edge < 0, np.flatnonzero(edge >= 0)
        owners = np.cumsum(heads) + (len(self.names) - 1)
        self.names = pa.concat_arrays([self.names, names.drop_null()])
        self.numbers = np.concatenate([self.numbers, numbers[heads]])
        if owners[0] < 0 or len(self.names) != len(self.numbers) or (self.numbers[owners] != numbers).any():
            raise ValueError("edges of a unit are apart")
        self.edges.append(edge[more])
        self.owners.append(owners[more])

    def take(self, ended: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """``(units, numbers, ids, counts)`` of the gathered units; the last one stays unless no row of it can follow."""
        n = len(self.names) if ended else max(len(self.names) - 1, 0)
        names, numbers = self.names.slice(0, n), self.numbers[:n]
        edges, owners = np.concatenate([np.zeros(0, np.int64), *self.edges]), np.concatenate([np.zeros(0, np.int64), *self.owners])
        cut = int(np.searchsorted(owners, n))
        self.names, self.numbers, self.edges, self.owners = self.names.slice(n), self.numbers[n:], [edges[cut:]], [owners[cut:] - n]
        return names, numbers, *self._ids(names, edges[:cut], owners[:cut])

    def _ids(self, names: pa.Array, edges: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.utf8_length(names).to_numpy().astype(np.int64)
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        bases = np.cumsum(sizes) - sizes
        stops = np.zeros(total, np.int64)  # end of the symbol that starts at a character, 0 for none
        piece = np.zeros(total, np.int64)  # its id + 1 if it is longer than a character
        short = sizes <= LONGEST_TOGETHER
        self._merge_short(stops, piece, sizes, bases, short, edges, owners)
        for k in np.flatnonzero(~short).tolist():
            low, high = np.searchsorted(owners, [k, k + 1])
            found = dict(zip((edges[low:high] >> 24).tolist(), (edges[low:high] & 0xFFFFFF).tolist()))
            for start, end in merge(int(sizes[k]), found, self.scores):
                stops[bases[k] + start] = bases[k] + end
                if end - start > 1:
                    piece[bases[k] + start] = found[start << 8 | end - start] + 1
        starts = np.flatnonzero(stops)
        codes = _codes("".join(_strings(names)))[starts].astype(np.int64)
        ids = np.where(piece[starts] > 0, piece[starts] - 1, self.single[codes])
        counts, lost = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
        spelled = [[self.spelled[x] for x in chr(c).encode("utf-8", "surrogatepass")] if self.spelled else [self.unknown] for c in codes[lost].tolist()]
        counts[lost] = list(map(len, spelled))
        places = np.cumsum(counts) - counts
        out = np.repeat(ids, counts).astype(np.int32)
        for place, some in zip(places[lost].tolist(), spelled):
            out[place:place + len(some)] = some
        return out, np.bincount(np.repeat(np.arange(len(names)), sizes)[starts], counts, len(names)).astype(np.int64)

    def _merge_short(self, stops, piece, sizes, bases, short, edges, owners) -> None:
        """Fill in the symbols of short units. The best edge goes first, the leftmost of equals, as in ``merge``."""
        width = self.longest + 1
        table = np.zeros(len(stops) * width, np.int32)
        mine = short[owners]
        place = edges[mine] >> 24
        table[(bases[owners[mine]] + (place >> 8)) * width + (place & 0xFF)] = (edges[mine] & 0xFFFFFF) + 1
        unit = np.repeat(np.arange(len(sizes)), sizes)
        start = np.flatnonzero(short[unit])
        unit, end = unit[start], start + 1
        while len(start):
            span = np.append(end[1:], 0) - start
            fits = np.append(unit[1:] == unit[:-1], False) & (span <= self.longest)
            rank = self.ranks[table[np.where(fits, start * width + span, 0)]]
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(start)), first)
            merged = (best >> 32) < _NEVER
            left = best[merged] & 0xFFFFFFFF
            end[left] = end[left + 1]
            piece[start[left]] = table[start[left] * width + end[left] - start[left]]
            going = np.repeat(merged, np.diff(np.append(first, len(start))))
            stops[start[~going]] = end[~going]
            going[left + 1] = False
            start, end, unit = start[going], end[going], unit[going]


def _edges_of(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    return batch.column("number").to_numpy(), batch.column("unit"), batch.column("edge").fill_null(-1).to_numpy()


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """``unit, n, ids`` for distinct ``unit, n``; written once."""
    longest, pieces = model.longest, model.keys()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sieve = 0, _Sieve(pieces)
        for batch in batches:
            names = batch.column("unit").to_pylist()
            for owners, columns in _unit_rows(at, names, longest, sieve):
                yield pa.record_batch([*columns, batch.column("n").take(pa.array(owners))], names=["number", "unit", "at", "block", "keys", "n"])
            at += len(names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, held = _Fold(model), pa.array([], pa.int64())

        def done(ended: bool) -> pa.RecordBatch:
            nonlocal held
            names, _, ids, counts = folded.take(ended)
            out = pa.record_batch([names, held.slice(0, len(names)), _lists(ids, counts)], names=["unit", "n", "ids"])
            held = held.slice(len(names))
            return out

        for batch in batches:
            folded.add(*_edges_of(batch))
            held = pa.concat_arrays([held, batch.column("n").drop_null()])
            yield done(False)
        yield done(True)

    rows = units.select("unit", F.col("n").cast("long").alias("n")).mapInArrow(spread, f"{_ROWS}, n long")
    return materialise(lattice(rows, model, "n").mapInArrow(fold, "unit string, n long, ids array<int>"), "unit-ids")


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def _numbered(docs: DataFrame, model: Model, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    rows = only(docs, doc_id=id_col, text=text_col, **{c: c for c in carry})
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *carry, units_of(text_or_empty("text"), model).alias("units")
    )


def dictionary(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``unit, n, ids`` of every distinct unit of ``docs`` with its number of occurrences."""
    found = only(docs, text=text_col).select(F.explode(units_of(text_or_empty("text"), model)).alias("unit"))
    return encode_units(found.groupBy("unit").agg(F.count("*").alias("n")), model)


def _split(longest: int, mixed: bool, kept: list[str], pieces: np.ndarray | None = None):
    """Rows for ``lattice``: the units that a task has not met yet, numbered, then the texts that hold them, as the numbers of their units. ``pieces`` are the keys for a sieve."""
    names = ["number", "unit", "at", "block", "keys", "places", *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        chars, classes, sieve = 0, _classes(mixed), None if pieces is None else _Sieve(pieces)
        for batch in batches:
            texts, others = batch.column("text"), [batch.column(c) for c in kept]
            for low, high in by_bytes(pc.binary_length(texts).to_pylist(), SLICE_BYTES):
                n = high - low
                units, sizes = _cut(texts.slice(low, n), classes)
                found = units.dictionary_encode()
                distinct = _strings(found.dictionary)
                if distinct and (len(known) > TASK_UNITS or chars > TASK_CHARS):
                    known, chars = {}, 0
                before = len(known)
                numbers = np.fromiter((known.setdefault(u, len(known)) for u in distinct), np.uint32, len(distinct))
                new = [distinct[k] for k in np.flatnonzero(numbers >= before).tolist()]
                chars += sum(map(len, new))
                for owners, columns in _unit_rows(before, new, longest, sieve):
                    yield pa.record_batch([*columns, *[pa.nulls(len(owners), t) for t in (pa.binary(), *[c.type for c in others])]], names=names)
                flat = numbers[found.indices.to_numpy()].tobytes()
                ends = (4 * np.cumsum(sizes)).tolist()
                yield pa.record_batch(
                    [pa.array([-1] * n, pa.int64()), pa.nulls(n, pa.string()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string()),
                     pa.array([[[0]]] * n, pa.list_(pa.list_(pa.int64()))), pa.array([flat[a:b] for a, b in zip([0, *ends], ends)], pa.binary()),
                     *[c.slice(low, n) for c in others]],
                    names=names,
                )

    return run


def _parts(rows: pa.RecordBatch, sieve: _Sieve) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of rows of ``_unit_rows`` the substrings that may be pieces, in order: their row, their place ``start << 8 | length`` in the unit, and their text."""
    lists, blocks = rows.column("keys").flatten(), rows.column("block")
    cuts, per_list, per_row = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), rows.column("keys").value_lengths().to_numpy()
    some = np.flatnonzero(sieve.may_hold(cuts.view(np.uint64)))
    of_list = np.repeat(np.arange(len(lists)), per_list)[some]
    first = (np.arange(len(lists)) - np.repeat(np.cumsum(per_row) - per_row, per_row))[of_list]
    some, of_list, start = some[first > 0], of_list[first > 0], first[first > 0] - 1
    row = np.repeat(np.arange(len(per_row)), per_row)[of_list]
    length = some - (np.cumsum(per_list) - per_list)[of_list] + 2
    whole = np.frombuffer("".join(_strings(blocks)).encode(), np.uint8)
    borders = np.append(np.flatnonzero((whole & 0xC0) != 0x80), len(whole))  # of characters
    sizes = pc.utf8_length(blocks).to_numpy().astype(np.int64)
    begin = (np.cumsum(sizes) - sizes)[row] + start
    low, held = borders[begin], borders[begin + length] - borders[begin]
    ends = np.cumsum(held)
    data = whole[np.repeat(low - (ends - held), held) + np.arange(held.sum())]
    texts = pa.StringArray.from_buffers(len(row), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data))
    return row, (rows.column("at").to_numpy()[row].astype(np.int64) + start) << 8 | length, texts


def _packed(split, kept: list[str], pieces: np.ndarray):
    """``number, part, held``: the distinct substrings that may be pieces, numbered, and behind them, numbered -1, what refers to them. ``held`` is an Arrow stream of
    units with their edges, which have numbers of substrings for ids, or of texts with their ``places`` and ``kept``."""
    names = ["number", "part", "held"]

    def stream(batch: pa.RecordBatch) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return pa.record_batch([pa.array([-1], pa.int64()), pa.nulls(1, pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        sieve = _Sieve(pieces)
        for batch in split(batches):
            if not batch.column("places").null_count:
                yield stream(batch.select(["places", *kept]))
                continue
            row, place, texts = _parts(batch, sieve)
            found = texts.dictionary_encode()
            distinct = _strings(found.dictionary)
            if len(known) > TASK_PARTS:
                known = {}
            before = len(known)
            numbers = np.fromiter((known.setdefault(p, len(known)) for p in distinct), np.int64, len(distinct))
            new = [distinct[k] for k in np.flatnonzero(numbers >= before).tolist()]
            if new:
                yield pa.record_batch([pa.array(np.arange(before, len(known))), pa.array(new, pa.string()), pa.nulls(len(new), pa.binary())], names=names)
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            edges = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(place << 24 | numbers[found.indices.to_numpy()]))
            yield stream(pa.record_batch([batch.column("number"), batch.column("unit"), edges], names=["number", "unit", "edges"]))

    return run


def _unpacked(look_up):
    """``look_up`` of ``number, id, held``: what ``_packed`` made, with the ids of the substrings that are pieces. The join keeps the order of rows; the numbers make sure."""

    def edges(units: pa.RecordBatch, ids: np.ndarray) -> pa.RecordBatch:
        names, flat = units.column("unit"), units.column("edges").flatten().to_numpy()
        found = ids[flat & 0xFFFFFF]
        hits, heads = found >= 0, np.asarray(names.is_valid())
        rows = np.repeat(np.arange(len(names)), units.column("edges").value_lengths().to_numpy())[hits]
        sizes = np.bincount(rows, minlength=len(names)) + heads
        first = (np.cumsum(sizes) - sizes)[heads]
        rows, edge = np.repeat(np.arange(len(names)), sizes), np.zeros(int(sizes.sum()), np.int64)
        edge[first] = -1
        edge[edge == 0] = (flat & ~0xFFFFFF | found)[hits]
        unit = names.take(pa.array(rows, mask=edge >= 0))
        return pa.record_batch([units.column("number").take(pa.array(rows)), unit, pa.array(edge), pa.nulls(len(rows), pa.binary())], names=["number", "unit", "edge", "places"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.zeros(0, np.int64)
        for batch in batches:
            numbers, found, low = batch.column("number").to_numpy(), batch.column("id").fill_null(-1).to_numpy(), 0
            for at in [*np.flatnonzero(numbers < 0).tolist(), batch.num_rows]:
                if at > low:
                    if numbers[low] == 0:  # the task has begun a new list
                        ids = ids[:0]
                    if (numbers[low:at] != np.arange(len(ids), len(ids) + at - low)).any():
                        raise ValueError("substrings of a task are out of order")
                    ids = np.concatenate([ids, found[low:at]])
                if at < batch.num_rows:
                    held = pa.ipc.open_stream(batch.column("held")[at].as_buffer()).read_next_batch()
                    yield held if "places" in held.schema.names else edges(held, ids)
                low = at + 1

    return lambda batches: look_up(rows(batches))


class _Spelled(dict):
    def __missing__(self, i: int) -> bytes:
        return b""


def _texts(ids: pa.Array, spell: Callable[[int], bytes]) -> pa.Array:
    """The text of each list of ids."""
    parts = list(map(spell, ids.flatten().to_pandas().tolist()))
    ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist()
    whole = [b"".join(parts[a:b]).decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]
    return pa.array([text.replace(SPACE_MARK, " ").removeprefix(" ") for text in whole], pa.string())


def _look_up(model: Model, kept: list[str], decoded: bool):
    """Ids of each text from the lattices of its units, which came before it; ``decoded`` adds the text that they spell."""
    known = model.spelled()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, spell = _Fold(model), _Spelled(known).__getitem__
        ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        starts = counts

        def learn(ended: bool) -> None:
            nonlocal ids, counts, starts
            names, numbers, more, sizes = folded.take(ended)
            if len(names) and numbers[0] == 0:  # the task has begun a new list
                ids, counts = ids[:0], counts[:0]
            if (numbers != np.arange(len(counts), len(counts) + len(names))).any():
                raise ValueError("units of a task are out of order")
            ids, counts = np.concatenate([ids, more]), np.concatenate([counts, sizes])
            starts = np.cumsum(counts) - counts

        def texts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            places = rows.column("places").to_pylist()
            for low, high in by_bytes([len(p) // 4 for p in places], SLICE_UNITS):
                numbers = np.frombuffer(b"".join(places[low:high]), np.uint32)
                sizes = counts[numbers]
                ends = np.cumsum(sizes)
                flat = ids[np.repeat(starts[numbers] - (ends - sizes), sizes) + np.arange(sizes.sum())]
                of_text = np.append(0, ends)[np.cumsum([0, *[len(p) // 4 for p in places[low:high]]])]
                found = _lists(flat, np.diff(of_text))
                yield pa.record_batch(
                    [*[rows.column(c).slice(low, high - low) for c in kept], found, *([_texts(found, spell)] if decoded else [])],
                    names=[*kept, "ids", *(["text"] if decoded else [])],
                )

        for batch in batches:
            whole = np.asarray(batch.column("places").is_valid())
            borders = [0, *(np.flatnonzero(whole[1:] != whole[:-1]) + 1).tolist(), batch.num_rows]
            for low, high in zip(borders, borders[1:]):
                rows = batch.slice(low, high - low)
                if high > low and whole[low]:
                    learn(True)
                    yield from texts(rows)
                elif high > low:
                    folded.add(*_edges_of(rows))
                    if len(folded.names) > FOLD_UNITS:
                        learn(False)

    return run


def encode(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), decoded: str | None = None
) -> DataFrame:
    """``doc_id, ids``: the ids of each row's text, as the library gives them without begin or end.

    Null text counts as empty and has no ids; a character that is no piece becomes its bytes. Null ids and repeated rows are
    encoded each. Texts of any length work: long units are cut into blocks. ``carry`` names further columns that the result keeps,
    ``decoded`` a column for what ``decode`` makes of the ids, worked out in the same pass. An empty table gives an empty result; other columns are not read.

    Nothing is shuffled or written. A task numbers the units that it has not met and the substrings in them, joins each substring to the pieces once, and sends the units
    behind their substrings, and each text behind its units, as numbers; beyond ``TASK_UNITS`` units, ``TASK_CHARS`` characters or ``TASK_PARTS`` substrings it forgets them and begins again.
    """
    rows = only(docs, doc_id=id_col, text=text_col, **{c: c for c in carry})
    kept = [f"kept_{k}" for k in range(1 + len(carry))]
    named = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(("doc_id", *carry), kept)], marked(text_or_empty("text")).alias("text"))
    kinds = ", ".join(f"{k} {named.schema[k].dataType.simpleString()}" for k in kept)
    keys = model.keys()
    parts = named.mapInArrow(_packed(_split(model.longest, model.mixed, kept, keys), kept, keys), "number long, part string, held binary")
    kinds += ", ids array<int>" + (", text string" if decoded else "")
    pieces = F.broadcast(model.table(docs.sparkSession).select(F.col("piece").alias("part"), "id"))
    edges = parts.join(pieces, "part", "left").select("number", F.col("id").cast("long").alias("id"), "held")
    found = edges.mapInArrow(_unpacked(_look_up(model, kept, decoded is not None)), kinds)
    return found.select(*[F.col(k).alias(c) for c, k in zip(("doc_id", *carry), kept)], "ids", *([F.col("text").alias(decoded)] if decoded else []))


def encode_summary(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """``doc_id, n_units, n_tokens, digest``: what ``encode`` gives, summed up instead of listed.

    ``digest`` is the exclusive or of ``xxhash64(place of the unit, its ids)`` over the text's units, so it changes with any id and any order of units.

    The ids of the most frequent units are broadcast (at most ``frequent`` units of bounded length); what they cover is summed to one row per document before any
    shuffle. The other occurrences are looked up in the dictionary with a join whose sides may be split. One pass over the texts decides both,
    and is written, so that documents keep their numbers. Nulls, repeats and empty tables are as for ``encode``.
    """
    known = dictionary(docs, model, text_col=text_col)
    sizes = known.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()  # at most 63 rows
    least, room = 64, frequent
    for power, count in sorted(map(tuple, sizes), reverse=True):
        room -= count
        if room < 0:
            break
        least = power
    often = known.where((F.col("n") >= F.lit(2.0) ** least) & (F.char_length("unit") <= LONGEST_FREQUENT)).select("unit", "ids")
    units = _numbered(docs, model, id_col, text_col).select("row", "doc_id", F.posexplode_outer("units").alias("pos", "unit"))
    met = units.join(F.broadcast(often), "unit", "left")
    rare = F.col("unit").isNotNull() & F.col("ids").isNull()

    def sums(tokens: Column, digest: Column) -> list[Column]:
        return [F.sum(tokens).alias("n_tokens"), F.bit_xor(digest).alias("digest")]

    passed = materialise(
        met.groupBy("row", "doc_id", F.when(rare, F.col("unit")).alias("unit"), F.when(rare, F.col("pos")).alias("pos")).agg(
            F.count("unit").alias("n_units"),
            *sums(F.coalesce(F.size("ids"), F.lit(0)), F.when(F.col("ids").isNotNull(), F.xxhash64("pos", "ids"))),
        ),
        "encoded",
    )
    late = passed.where("unit is not null").select("row", "doc_id", "unit", "pos", "n_units").join(known.select("unit", "ids"), "unit").select(
        "row", "doc_id", "n_units", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("pos", "ids").alias("digest")
    )
    early = passed.where("unit is null").select("row", "doc_id", "n_units", "n_tokens", "digest")
    return early.unionByName(late).groupBy("row", "doc_id").agg(
        F.sum("n_units").alias("n_units"), F.sum("n_tokens").alias("n_tokens"), F.coalesce(F.bit_xor("digest"), F.lit(0)).alias("digest")
    ).drop("row")


def decode(
    encoded: DataFrame, model: Model, *, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, text``: pieces joined, bytes read as UTF-8, marks turned into spaces, the first one taken off.

    Null or empty ids give an empty text; control and unknown ids have none. Bytes that are no UTF-8 become the replacement character.
    ``carry`` names further columns that the result keeps.
    """
    rows, known = only(encoded, doc_id=id_col, ids=ids_col, **{c: c for c in carry if c != "ids"}), model.spelled()
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = _Spelled(known).__getitem__
        for batch in batches:
            every = batch.column("ids")
            for low, high in by_bytes(every.value_lengths().fill_null(0).to_pylist(), SLICE_UNITS):
                some = every.slice(low, high - low)
                yield pa.record_batch([*[batch.column(c).slice(low, high - low) for c in ("doc_id", *carry)], _texts(some, spell)], names=["doc_id", *carry, "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")
