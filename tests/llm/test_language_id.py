"""Language models against a plain Python Kneser-Ney estimate, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import language_id as li
from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_model(words, order, letters):
    """Grams to probability by the textbook: a function of a history and a symbol."""
    top, starts = Counter(), Counter()
    for w in words:
        marked = f"<{w}>"
        for end in range(2, len(marked) + 1):
            (top if end >= order else starts)[marked[max(0, end - order):end]] += 1
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
        levels[k].update({g: n for g, n in starts.items() if len(g) == k})
    cuts = {}
    for k, level in levels.items():
        once, twice = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
        cuts[k] = once / (once + 2 * twice) if once and twice else 0.5
    behind = defaultdict(Counter)
    for level in levels.values():
        for g, n in level.items():
            behind[g[:-1]][g[-1]] = n

    def p(history, symbol):
        k, after = len(history) + 1, behind.get(history)
        lower = p(history[1:], symbol) if history else 1 / (letters + 1)
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get(symbol, 0) - cuts[k], 0) / total + cuts[k] * len(after) / total * lower

    return levels, p


def test_models_equal_the_textbook(spark):
    draw, order = random.Random(3), 4
    words = {lang: ["".join(draw.choices(base, [5, 4, 3, 2, 1, 1], k=draw.randint(1, 7))) for _ in range(400)] for lang, base in (("a", "etaoin"), ("b", "aeißöz"))}
    rows = [(lang, " ".join(ws[k:k + 50])) for lang, ws in words.items() for k in range(0, 400, 50)]
    counts = li.gram_counts(spark.createDataFrame(rows, "lang string, text string").repartition(3), order)
    model = li.kneser_ney(counts, order)
    loaded = li.load_models(model, ["a", "b"])
    letters = len({g for ws in words.values() for w in ws for g in w + ">"})
    tests = words["a"][:20] + words["b"][:20] + ["q", "etaqq", "ßßßßßßßßßß", "zzz" * 30]
    got = li.Scorer(loaded, order).words(tests)
    for column, lang in enumerate(("a", "b")):
        _, p = plain_model(words[lang], order, letters)
        for row, w in enumerate(tests):
            marked = f"<{w}>"
            want = sum(math.log(p(marked[max(0, k - order + 1):k], marked[k])) for k in range(1, len(marked)))
            assert got[row, column] == pytest.approx(want, rel=1e-5), (lang, w)
        # what follows a history sums to one with the share of the letter that no text held
        history = "<" + words[lang][0][:2]
        assert sum(p(history[-3:], x) for x in {c for ws in words.values() for w in ws for c in w + ">"} | {"?"}) == pytest.approx(1)
    small = li.kneser_ney(counts, order, capacity=40)
    assert small.groupBy("lang").count().collect() and max(r["count"] for r in small.groupBy("lang").count().collect()) <= 40 * order + 2


def test_held_out_accuracy_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op11_language_id"](spark, SF).collect()}
    known = [tuple(r) for r in docs.select("doc_id", "lang", "text").collect()]
    assert len(rows) == len(known)
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in known)
    judged = [(rows[i]["lang_pred"] == lang) for i, lang, text in known if rows[i]["held_out"] and lang and any(c.isalpha() for c in text or "")]
    assert len(judged) > 200 and np.mean(judged) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_predictions_do_not_read_the_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    held = li.held_out(docs["doc_id"])
    from pyspark.sql import functions as F

    swapped = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = ({tuple(r) for r in li.identify(x).collect()} for x in (docs, swapped))
    assert a == b


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(li, "LEAST_LIMIT", 5)
    draw = random.Random(1)
    one = lambda n: " ".join("".join(draw.choices("etaoinshr", k=draw.randint(2, 7))) for _ in range(n))
    two = lambda n: " ".join("".join(draw.choices("жзийклмно", k=draw.randint(2, 7))) for _ in range(n))
    rows = [(k, one(40), "l1") for k in range(100)] + [(100 + k, two(40), "l2") for k in range(100)]
    rows += [(500, None, "l1"), (501, "", None), (502, "12 §$ ² ½ ...", None), (503, one(30), None), (504, two(30), None), (None, two(5), "l2"), (None, two(5), "l2")]
    rows += [(505, "e" * 3_000_000, None), (506, one(3) + " " + "日本語" * 30, None), (507, one(20), "only"), (508, "日本語のテキスト。" * 20, None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, best string, score double").repartition(3)
    got = li.identify(df, block=2)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    table = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [table[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and {table[i]["score"] for i in (500, 501, 502)} == {0.0}
    assert not any(table[i]["accepted"] for i in (500, 501, 502))
    assert table[503]["lang_pred"] == "l1" and table[504]["lang_pred"] == "l2" and table[None]["lang_pred"] == "l2" and table[505]["lang_pred"] in ("l1", "only")
    assert table[503]["accepted"] and not table[508]["accepted"]
    for k in (1, 8):
        assert {tuple(r) for r in li.identify(df, block=k).collect()} == {tuple(r) for r in table.values()} | {tuple(r) for r in got.collect()}
    assert li.identify(df.limit(0)).count() == 0
    nothing = li.identify(df.withColumn("lang", df["lang"].substr(1, 0)).where("false").unionByName(df.withColumn("lang", df["best"].substr(9, 0)).limit(0)))
    assert nothing.count() == 0
    unlabelled = df.drop("lang").selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in li.identify(unlabelled).collect()} == {"und"}


def test_shares_never_fall():
    shares = li.rising([1, 5, 3, 10], [2, 5, 4, 10])
    assert shares == sorted(shares) and len(shares) == 4 and all(0 < s < 1 for s in shares)


def test_letters():
    assert li.words_of_letters("Ab1c d²e Ⅷ_x-ÄÖ") == ["ab", "c", "d", "e", "x", "äö"]
