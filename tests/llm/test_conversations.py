"""The prefix trie and structure repair against plain Python on small and odd conversations; whole tables against SQL are in test_sql."""

import hashlib
import random
import zlib

import pytest

from gridloom.llm import prefix_trie as pt
from gridloom.llm import structure_repair as sr
from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, depth int, conv string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(convs):
    """Nodes of ``{id: [(turn, characters)]}`` by listing every prefix."""
    nodes, kids = {}, {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        saved[p] = (len(nodes[p]) - 1) * (p[-1][1] if p else 0) + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
    return {
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
         sha(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))))
        for p, m in nodes.items()
    }


def trie_of(spark, convs, chunk):
    rows = [(c, i + 1, bytes([t] * 16), n) for c, s in convs.items() for i, (t, n) in enumerate(s)]
    turns = spark.createDataFrame(rows, "conv_id long, place long, same binary, chars long").repartition(3)
    return pt.prefix_trie(turns, spark.createDataFrame([(c,) for c in convs], "conv_id long"), chunk=chunk).collect()


@pytest.mark.parametrize("chunk, longest", [(1, 4), (4, 40), (8192, 300)])
def test_trie_equals_listed_prefixes(spark, chunk, longest):
    draw, convs = random.Random(chunk), {}
    for c in range(60):
        base = draw.choice(list(convs.values())) if convs and draw.random() < 0.7 else []
        tail = [(t, t + 1) for t in draw.choices(range(3), k=draw.choice([0, 1, 2, 3, longest]))]
        convs[3 * c - 30] = base[:draw.randint(0, len(base))] + tail
    got = trie_of(spark, convs, chunk)
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_trie(convs)


def test_trie_across_boundaries_without_spark():
    """Chunks of every size give the nodes of one chunk: the forests are contracted, merged and finished as the tasks do it."""
    import pyarrow as pa

    draw = random.Random(3)
    for _ in range(40):
        seqs = sorted({tuple(draw.choices(range(2), k=draw.randint(0, 7))) for _ in range(draw.randint(1, 25))})
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(seqs, seqs[1:])]
        rows = [
            {"rank": k, "conv": 7 * k % 31, "n": 1 + k % 3, "len": len(s), "upto": 2 * len(s), "lcp": lcp, "lcp_upto": 2 * lcp}
            for k, (s, lcp) in enumerate(zip(seqs, shared))
        ]
        results = []
        for chunk in (1, 2, 3, 100):
            parts = [rows[k:k + chunk] for k in range(0, len(rows), chunk)]
            tables, opened = [], []
            for k, part in enumerate(parts):
                after = parts[k + 1][0] if k + 1 < len(parts) else {"lcp": None, "lcp_upto": None}
                tables.append(pa.Table.from_pylist([{**r, "next_lcp": after["lcp"], "next_upto": after["lcp_upto"]} for r in part]))
                opened.append(pt._contract((pa.scalar(k),), tables[-1]))
            merged = [r for b in pt._merge(iter(b for t in opened for b in t.to_batches())) for r in b.to_pylist()]
            nodes = [tuple(r[c] for c in ("conv", "depth", "above", "parent", "upto", "n", "kids", "leaves", "below", "ends")) for r in merged if r["place"] is None]
            for k, table in enumerate(tables):
                facts = [{"place": r["place"], "conv": r["conv"]} for r in merged if r["place"] is not None and r["part"] == k]
                nodes += [tuple(r.values()) for r in pt._finish((pa.scalar(k),), table, pa.Table.from_pylist(facts)).to_pylist()]
            results.append(sorted(nodes, key=repr))
        assert all(r == results[-1] for r in results)


def rows_with_oddities():
    turn = lambda c, t, r, x: (c, t, r, x, 1, "k")
    rows = [turn(0, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(8)]
    rows += [turn(c, k, "user" if k % 2 == 0 else "assistant", f"turn {k}." if k < 4 else f"own {c % 3} {k}") for c in range(1, 30) for k in range(3 + c % 4)]
    rows += [turn(50, None, None, None), turn(50, None, None, None), turn(50, 1, "", ""), turn(51, 1, "user", "tie"), turn(51, 1, "user", "tie"), turn(51, 1, "user", "other")]
    rows += [turn(None, 0, "user", "no id"), turn(None, 0, "user", "no id"), turn(None, 1, "assistant", None), turn(300, 0, "user", "x" * 200_000), turn(-7, 0, "user", "ÄÖ")]
    return rows


def in_order(rows):
    """Rows of each conversation by turn, ties by the hash of role and text."""
    framed = lambda x: "-" if x is None else f"{len(x)}:{x}"
    same = lambda r: hashlib.md5((framed(r[2]) + framed(r[3])).encode()).digest()
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, same(r))):
        out.setdefault(r[0], []).append(r)
    return out


def test_rebuilt_trie_of_odd_rows(spark):
    rows = rows_with_oddities()
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = pt.prefix_trie(pt.rebuilt(df), df.select("conv_id")).collect()
    given = in_order([(c, t, r or "", x or "") for c, t, r, x, *_ in rows if c is not None])
    convs = {}
    for c, own in given.items():
        seq = [((r, x), len(x)) for _, _, r, x in own]
        donor = [((r, x), len(x)) for _, _, r, x in given.get(c - int(__import__("math").fmod(c, 100)), [])]
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = donor[:h] + seq[h:]
    assert set(map(tuple, got)) == plain_trie(convs) and len(got) == len(set(map(tuple, got)))
    empty = df.limit(0)
    assert pt.prefix_trie(pt.rebuilt(empty), empty.select("conv_id")).count() == 0


def plain_repair(rows):
    """Counts, cost, audit and repaired text of one conversation's rows, keeping every cheapest audit."""
    judged, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(sr.WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        judged.append((role, text, fault))
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: {"": (0, ())}}
    for role, text, fault in judged:
        late, new = 3 * (fault == "truncated"), {}
        for state, ways in best.items():
            for audit, (cost, lines) in ways.items():
                at = state
                for k in range(4):
                    to = ("assistant" if at == 2 else "user", step[at])
                    options = [("D", 4, at, ())]
                    if fault not in ("blank", "duplicate"):
                        options.append(("R", 3 + late, to[1], (f"{to[0]}:{text}",)))
                        if (at, role[:1]) in {(0, "s"), (0, "u"), (1, "u"), (2, "a"), (3, "u")}:
                            options.append(("K", late, {"s": 1, "u": 2, "a": 3}[role[:1]], (f"{role}:{text}",)))
                    for edit, price, end, line in options:
                        way = new.setdefault(end, {})
                        key, total = audit + edit, cost + price
                        if key not in way or total < way[key][0]:
                            way[key] = (total, lines + line)
                    audit, cost, lines, at = audit + "I", cost + 3, (*lines, f"{to[0]}:"), to[1]
        least = {s: min(c for c, _ in w.values()) for s, w in new.items()}
        best = {s: {a: v for a, v in w.items() if v[0] == least[s]} for s, w in new.items()}
    closing = {0: (), 1: ("user:", "assistant:"), 2: ("assistant:",), 3: ()}
    cost, audit, lines = min((c + 3 * len(closing[s]), a + "I" * len(closing[s]), ls + closing[s]) for s, w in best.items() for a, (c, ls) in w.items())
    turns = {t for _, t, _, _ in rows if t is not None}
    count = lambda f: sum(x[2] == f for x in judged)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(lines))


def spaced(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]


@pytest.mark.parametrize("piece, rounds", [(3, 8), (4096, 8), (2, 0)])
def test_repair_equals_all_cheapest_audits(spark, piece, rounds):
    draw, rows = random.Random(piece), []
    for c in range(80):
        for k in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "system", "tool", "user", "assistant", ""])
            rows.append((c, draw.choice([k, k, k + 2, None]), role, draw.choice(["a.", "b!", "open", " \n", "c? ", f"t{k}.", f"u{k}"]), 1, "k"))
    rows += rows_with_oddities()
    df = spark.createDataFrame(rows, KIND).repartition(3)
    result = sr.repair_structure(df, piece=piece, rounds=rounds)
    want = {(c, *plain_repair(own)) for c, own in in_order(spaced(rows)).items()}
    assert set(map(tuple, result.reports.collect())) == want
    shapes = {}
    for r in result.rows.orderBy("conv", "place", "sub").collect():
        shapes[r["conv_id"]] = shapes.get(r["conv_id"], "") + r["role"][:1]
    assert all(__import__("re").fullmatch("(s?(ua)+)?", s) for s in shapes.values())
    assert sr.repair_structure(df.limit(0)).reports.count() == 0 and sr.damaged_and_repaired(df.limit(0)).count() == 0


def test_damage_and_repair_of_odd_rows(spark):
    rows = rows_with_oddities()
    got = {r[0]: tuple(r) for r in sr.damaged_and_repaired(spark.createDataFrame(rows, KIND)).collect()}
    damaged = []
    for c, t, role, text in spaced(rows):
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        damaged += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    left = in_order(damaged)
    assert got == {c: (c, *(plain_repair(left[c]) if c in left else (0, 0, 0, 0, 0, 0, "", sha("")))) for c in {r[0] for r in rows}}


def test_pairs_of_one_symbol_do_not_overlap():
    assert sr.pair_counts("uuuuu")["uu"] == 2 and sr.pair_counts("uaua") == {"ua": 2, "au": 1}
    assert sr.choose([("ua", 9), ("au", 8), ("us", 7), ("xx", 3)]) == ["ua", "us", "xx"]


def test_rules_shorten_long_conversations(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for c in range(3) for k in range(400)]
    turns = sr.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "turns")
    grammar = sr.build_grammar(sr._pieces(sr.judged(turns), 4096))
    assert len(grammar.rules) >= 3 and len(grammar.compress("ua" * 200)) < 40


def test_every_conversation_has_a_row(spark):
    convs = {r[0] for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().collect()}
    assert {r["conv_id"] for r in QUERIES["op13_structure_repair"](spark, SF).collect()} == convs
