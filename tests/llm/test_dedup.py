"""Exact and SimHash duplicates against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import components, simhash
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (None, "z"), (7, "x" * 100_000), (8, "x" * 100_000), (9, "A b")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, hash int, keep_id string")


def found(df):
    return {(r[0], i): tuple(r)[1:] for i, r in enumerate(sorted(df.collect(), key=repr))}


def test_exact_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op7_exact_dedup"]).fetchall())
    assert sorted(map(tuple, QUERIES["op7_exact_dedup"](spark, SF).collect())) == want


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_edges(spark, keep):
    got = exact_dedup(frame(spark, ODD), keep=keep).collect()
    assert len(got) == len(ODD)
    small = keep == "smallest"
    want = []
    for i, t in ODD:
        ids = [j for j, u in ODD if (u or "") == (t or "")]
        known = [j for j in ids if j is not None]
        stay = (min(known) if small else max(known)) if known else None
        want.append((i, stay, len(ids), i == stay, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup(frame(spark, [])).count() == 0


def plain_print(text, k=4):
    words = text.encode().translate(simhash._LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, most=4):
    nodes = [(i, plain_print(t or "")) for i, t in rows]
    parent = list(range(len(nodes)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if (nodes[a][1] ^ nodes[b][1]).bit_count() <= most:
                parent[top(a)] = top(b)
    least = {}
    for x, (i, _) in enumerate(nodes):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return [(i, f"{fp:016x}", least.get(top(x))) for x, (i, fp) in enumerate(nodes)]


def groups(spark, rows):
    out = simhash.simhash_groups(frame(spark, rows))
    return sorted(map(tuple, out.select("doc_id", simhash.fingerprint_text(), "component_id").collect()), key=repr)


def test_simhash_edges(spark):
    rows = ODD + [(10, "One two"), (11, "one\ttwo"), (12, "a\x0bb c d e"), (13, "é ü ß Ä ñ"), (14, "\x1c \x85 b")]
    assert groups(spark, rows) == sorted(plain_components(rows), key=repr)
    assert groups(spark, []) == []


def test_simhash_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op9_simhash_near_dedup"](spark, SF).collect()))
    assert got == sorted(plain_components(rows))
    assert any(c < i for i, _, c in got)


def test_decoding_is_perfect():
    low, high, patterns = simhash.golay()
    weights = np.bitwise_count(np.where(patterns < 0, 0, patterns))
    assert weights[:, 0].max() == 3 and (patterns >= 0).sum() == sum([1, 23, 253, 1771, 8855])


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_no_near_pair_misses_a_key(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    keys, owners = simhash.join_keys(np.array([fp, other], np.uint64).view(np.int64))
    assert set(keys[owners == 0]) & set(keys[owners == 1])


def test_crowded_keys_in_blocks(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for base in list(prints)[:5]:
        for _ in range(120):
            near = base
            for b in rng.sample(range(64), rng.randint(1, 6)):
                near ^= 1 << b
            prints.add(near)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)

    def parts(links):
        stars = dict(components.component_stars(links).select("hi", "lo").collect())
        out = {}
        for x in signed:
            out.setdefault(stars.get(x, x), set()).add(x)
        return sorted(map(sorted, out.values()))

    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    brute = parts(spark.createDataFrame(pairs, "hi long, lo long"))
    assert parts(simhash.fingerprint_links(distinct)) == brute
    assert parts(simhash.fingerprint_links(distinct, block=16)) == brute


def test_paths_become_stars(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 500), (601, 600), (600, 601)]
    got = sorted(map(tuple, components.component_stars(spark.createDataFrame(path, "hi long, lo long")).collect()))
    assert got == [(i, 0) for i in range(1, 201)] + [(601, 600)]


def test_keep_first_of_group(spark):
    rows = [(1, "a b c d e"), (2, "A b c d e"), (3, "other words are in here"), (3, "other words are in here"), (None, "nothing like the rest at all")]
    kept = simhash.keep_first_of_group(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "hash", "keep_id"]
    assert sorted([r[0] for r in kept.collect()], key=repr) == [1, 3, None]
