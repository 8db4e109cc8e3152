"""Line dedup against a brute force over all runs."""

import hashlib
import random
import re

import pytest

from gridloom.llm.line_dedup import line_dedup
from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, least):
    """Text, lines with a word and removed lines of each row; every maximal repeat is tried."""
    docs, seen = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(key(r)).digest())):
        if (i, t) not in seen:
            seen[i, t] = None
            docs.append((i, t))
    spoken = [[(p, x) for p, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for _, t in docs]
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    gone = [set() for _ in docs]
    where = {}
    for d, lines in enumerate(spoken):
        for p, (_, x) in enumerate(lines):
            for e, q in where.get(x, ()):
                n = 0
                while p + n < len(lines) and q + n < len(spoken[e]) and lines[p + n][1] == spoken[e][q + n][1]:
                    n += 1
                if sum(size(x) for _, x in lines[p:p + n]) >= least:
                    gone[d] |= set(range(p, p + n))
            where.setdefault(x, []).append((d, p))
    out = {}
    for (i, t), lines, drop in zip(docs, spoken, gone):
        places = {lines[k][0] for k in drop}
        text = t if not drop else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in places)
        out[i, t] = (text, len(lines), len(drop))
    return sorted([(i, *out[i, t]) for i, t in rows], key=repr)


def key(row):
    return "".join("-" if v is None else f"{len(str(v))}:{v}" for v in row).encode()


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_removed").collect()], key=repr)


@pytest.mark.parametrize("least", [1, 5, 50])
def test_random_documents(spark, least):
    rng = random.Random(least)
    lines = [" ".join(["w"] * rng.choice([1, 2, 3, 7])) + f" {k}" for k in range(12)] + ["", "  \t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(i + 100, rows[i][1]) for i in range(5)] + [(200, "x\n" * 30 + "y"), (201, "x\n" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(line_dedup(df, least_words=least)) == brute(rows, least)


def test_edges(spark):
    long = "\n".join(f"line {k} " + "word " * 20 for k in range(300))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (None, None), (7, "\n\n"), (8, f"head\n{long}\ntail"), (9, "a " * 60 + "\n\n" + "a " * 60)]
    df = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], "doc_id long, text string, n_lines int, hash string, idx string")
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "hash", "idx", "n_lines", "n_removed"]
    assert result(out) == brute(rows, 50)
    assert line_dedup(df.limit(0)).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, r, len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t, n, r in brute(rows, 50)]
    got = QUERIES["op4_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_removed", "n_chars", "text_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r for _, _, r, _, _ in want)
