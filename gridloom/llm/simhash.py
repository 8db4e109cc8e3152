"""SimHash near-duplicates with fuzzy keys from the Golay code.

A 64-bit fingerprint is cut into three segments of at most 23 bits. In the perfect (23, 12) code every word is within
three bits of one codeword, so two words at most two bits apart share a codeword within four bits of both: the halfway word
has one. The codewords within four bits of a segment, about five, are its keys.

Two fingerprints at most four bits apart have segment errors s1 <= s2 <= s3 with a sum of at most four, hence either

* s1 = 0 and s2 <= 2: one segment is equal, and a second shares a key; or
* s1 = s2 = 1: the nearest codeword of either word in a segment is a key of the other word in it.

The join keys below hold a segment or a codeword of two segments each, so no link can be missed; every pair that meets is then verified.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import component_stars
from gridloom.llm.text import only
from gridloom.session import materialise

#: (first bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The three-segment argument holds up to here.
MOST_BITS = 4
#: Fingerprints of one key that meet in one piece of memory; larger keys are dealt out in pairs of blocks.
BLOCK = 4096
#: Runs up to here are compared by shifting, longer ones by growing trees.
SHORT_RUN = 32
#: Shingles hashed at once.
HASH_BATCH = 100_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int) -> int:
    """SimHash over word shingles, repeats included: a bit is set if over half of the XXH64 hashes set it."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    votes = np.zeros(64, np.int64)
    for low in range(0, n, HASH_BATCH):
        part = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[low:min(n, low + HASH_BATCH)], last[low:low + HASH_BATCH])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long; null text counts as empty, which is zero."""
    rows = only(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint("" if t is None else t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit word's halves, and the error patterns of weight up to four for each syndrome, lightest first (-1 fills up)."""
    generator = 0b101011100011  # Fixed value: generator polynomial of the (23, 12) code

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= generator << (bit - 11)
        return word

    single = [remainder(1 << b) for b in range(23)]

    def table(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.int64)
        for b in range(bits):
            out[1 << b:2 << b] = out[:1 << b] ^ single[first + b]
        return out

    by_syndrome: list[list[int]] = [[] for _ in range(1 << 11)]
    layer = [(0, 0, -1)]
    for _ in range(5):
        for pattern, syndrome, _top in layer:
            by_syndrome[syndrome].append(pattern)
        layer = [(p | 1 << b, s ^ single[b], b) for p, s, top in layer for b in range(top + 1, 23)]
    width = max(map(len, by_syndrome))
    patterns = np.array([row + [-1] * (width - len(row)) for row in by_syndrome], np.int64)
    return table(0, 12), table(12, 11), patterns


def segment_keys(values: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits of each word, the nearest in the first column; -1 fills up."""
    low, high, patterns = golay()
    errors = patterns[low[values & 0xFFF] ^ high[values >> 12]]
    return np.where(errors < 0, -1, (values[:, None] ^ errors) >> 11)


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the fingerprint) for all join keys of the module's argument."""
    words = [(fps.view(np.uint64) >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [segment_keys(w) for w in words]
    keys, owners, tag = [], [], 0

    def add(first: np.ndarray, second: np.ndarray) -> None:
        key = np.where((first < 0) | (second < 0), -1, (tag << 40) | (first << 12) | second)
        owner, _ = np.nonzero(key >= 0)
        keys.append(key[key >= 0])
        owners.append(owner)

    for i in range(3):
        for j in range(3):
            if i != j:
                add(words[i][:, None], near[j])
                tag += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        add(near[i], near[j][:, :1])
        add(near[i][:, :1], near[j][:, 1:])
        tag += 1
    return np.concatenate(keys), np.concatenate(owners)


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        keys, owners = join_keys(fps)
        yield pa.record_batch([pa.array(keys), pa.array(fps[owners])], names=["key", "fp"])


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of signed 64-bit values (the count of a negative number would be that of its absolute)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _trees(fps: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one run, without listing all its pairs."""
    out, rest = [], np.sort(fps)
    while len(rest) > 1:
        root, queue, rest = int(rest[0]), [rest[0]], rest[1:]
        while queue and len(rest):
            near = bits_apart(rest, queue.pop()) <= most_bits
            found = rest[near]
            if len(found):
                out += [(int(x), root) for x in found]
                queue.extend(found)
                rest = rest[~near]
    return out


def link_runs(most_bits: int, block: int):
    """Verify the fingerprints of each key against each other; input must be sorted by key.

    Gives ``hi, lo`` links that connect what is linked, and ``hi`` null with the key in ``lo`` for keys of more than ``block`` fingerprints.
    """

    def links(keys: np.ndarray, fps: np.ndarray) -> tuple[list, list]:
        hi, lo = [], []
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
            for a, b in _trees(fps[s:s + n], most_bits):
                hi.append(a)
                lo.append(b)
        short = np.repeat((sizes <= SHORT_RUN) & (sizes > 1), sizes)
        keys, fps = keys[short], fps[short]
        for shift in range(1, SHORT_RUN):
            at = np.flatnonzero(keys[shift:] == keys[:-shift])
            if not len(at):
                break
            a, b = fps[at], fps[at + shift]
            near = bits_apart(a, b) <= most_bits
            hi += a[near].tolist()
            lo += b[near].tolist()
        return hi, lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, skipped = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def out(hi: list, lo: list, over: list) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array(hi + [None] * len(over), pa.int64()), pa.array(lo + over, pa.int64())], names=["hi", "lo"]
            )

        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            if skipped is not None:
                fresh = keys != skipped
                keys, fps = keys[fresh], fps[fresh]
            keys, fps = np.r_[held_k, keys], np.r_[held_f, fps]
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))
            held_k, held_f = keys[whole:], fps[whole:]
            hi, lo = links(keys[:whole], fps[:whole]) if whole else ([], [])
            over = []
            if len(held_k) > block:
                skipped = int(held_k[0])
                over, held_k, held_f = [skipped], held_k[:0], held_f[:0]
            yield out(hi, lo, over)
        if len(held_k):
            yield out(*links(held_k, held_f), [])

    return run


def fingerprint_links(distinct: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """``hi, lo`` links among the distinct fingerprints of column ``fp`` that connect all at most ``most_bits`` apart.

    A run of equal keys is sorted together by the shuffle and read as a stream. Keys of more than ``block`` fingerprints are
    named, cut into blocks by a hash, and every pair of blocks is compared as a run of its own, so memory and tasks stay bounded and no pair is lost.
    """
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"fuzzy keys cover 0 to {MOST_BITS} bits")
    keyed = distinct.mapInArrow(_explode_keys, "key long, fp long")

    def linked(rows: DataFrame, *by: str, most: int) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by).select("key", "fp").mapInArrow(
            link_runs(most_bits, most), "hi long, lo long"
        ).distinct()

    found = materialise(linked(keyed, "key", most=block), "simhash-links")
    over = found.where("hi is null").select(F.col("lo").alias("key"))
    links = found.where("hi is not null")
    if over.isEmpty():
        return links
    crowded = materialise(keyed.join(over, "key"), "simhash-crowded")
    sizes = materialise(
        crowded.groupBy("key").agg(F.ceil(2 * F.count("*") / F.lit(block)).cast("int").alias("blocks")), "simhash-blocks"
    )
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    dealt = (
        crowded.join(sizes, "key").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    )
    pairs = materialise(linked(dealt, "key", most=1 << 62), "simhash-links")
    return links.unionAll(pairs)


def simhash_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most_bits: int = MOST_BITS
) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs`` with the smallest id that links lead to.

    Fingerprints are written once. Equal ones become one node with the smallest id of its rows, counted on the map side; nodes are linked through
    fuzzy keys and joined to components on the executors. Rows look up their component by fingerprint with a join whose row side may be split.

    Null text counts as empty; texts without a word have fingerprint zero and are linked like any other. A text of fewer words than a
    shingle is one shingle. Null ids never name a component while another id can; a component of null ids only has a null name.
    Repeated rows get the same values. An empty table gives an empty result; further columns are not read.
    """
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    stars = component_stars(fingerprint_links(nodes.select("fp"), most_bits))
    members = stars.select(F.col("hi").alias("fp"), F.col("lo").alias("root")).unionAll(
        stars.select(F.col("lo").alias("fp"), F.col("lo").alias("root")).distinct()
    )
    members = materialise(members.join(nodes, "fp", "right"), "simhash-members")
    names = materialise(
        members.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names"
    )
    named = materialise(
        members.where("root is not null").join(names, "root").select("fp", "component_id")
        .unionAll(members.where("root is null and n > 1").select("fp", F.col("least").alias("component_id")))
        .withColumn("named", F.lit(True)),
        "simhash-components",
    )
    return prints.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def fingerprint_text(fp: str = "fp"):
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first_of_group(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id names their group: one document of each stays, all columns unchanged.

    Rows that repeat the staying id are one document; one of them stays per distinct text. Rows with a null id are kept only if their
    whole group has none.
    """
    groups = simhash_groups(docs, id_col=id_col, **options)
    stays = materialise(
        groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("_rows")), "simhash-stays"
    ).withColumnRenamed("doc_id", "_stays")
    kept = docs.join(stays.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col("_stays")), "inner").drop("_stays")
    if stays.where("_rows > 1").isEmpty():
        return kept.drop("_rows")
    once, more = kept.where("_rows = 1").drop("_rows"), kept.where("_rows > 1").drop("_rows")
    return once.unionByName(more.dropDuplicates([id_col, options.get("text_col", "text")]))
