"""Quality rules and the site classifier against plain Python, and held-out accuracy."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from gridloom.llm import quality_rules as qr
from gridloom.llm import site_quality as sq
from gridloom.llm.queries import QUERIES

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes(text):
    out = [0] * 6
    for c in text:
        if re.match(r"[\x20\x09-\x0D]", c):
            continue
        kind = unicodedata.category(c)
        k = 0 if kind == "Ll" else 1 if kind == "Lu" else 2 if kind == "Nd" else 3 if kind[0] in "LM" else 4 if c in ".,;:!?'\"()-" else 5
        out[k] += 1
    return out


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def distance(p, q):
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2))


def brute_rules(rows):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        counts[lang or ""].update(WORD.findall(text or ""))
    refs = {}
    for lang, own in counts.items():
        letters = {w: n for w, n in own.items() if all(unicodedata.category(c)[0] == "L" for c in w)}
        common = sorted(letters, key=lambda w: (-letters[w], w.encode()))[:qr.COMMON]
        chars = [0] * 6
        for w, n in own.items():
            chars = [a + n * b for a, b in zip(chars, classes(w))]
        refs[lang] = (sum(own.values()), common, [own[w] for w in common], chars)
    out = []
    for i, text, lang in rows:
        n, chars, *rest = base(text)
        words, common, held, all_chars = refs[lang or ""]
        own = Counter(WORD.findall(text or ""))
        char_d = word_d = None
        if chars >= qr.LEAST_CHARS and (left := sum(all_chars) - chars) >= qr.LEAST_REST_CHARS:
            mine = classes(text)
            char_d = distance([c / chars for c in mine], [(a - c) / left for a, c in zip(all_chars, mine)])
        if n >= qr.LEAST_WORDS and common and words - n >= qr.LEAST_REST_WORDS:
            bins, shares = [own[w] / n for w in common], [(h - own[w]) / (words - n) for h, w in zip(held, common)]
            word_d = distance([*bins, max(0.0, 1 - sum(bins))], [*shares, max(0.0, 1 - sum(shares))])
        failed = n < 50 or 100 * rest[2] > 50 * n
        far = (char_d or 0) > qr.MOST_CHARS or (word_d is not None and word_d > qr.MOST_WORDS + qr.SLACK / n)
        out.append((i, n, chars, *rest, failed, char_d, word_d, not failed and not far))
    return out


def same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert [x for x in g if not isinstance(x, float)] == [x for x in w if not isinstance(x, float)], (g, w)
        assert [x for x in g if isinstance(x, float)] == pytest.approx([x for x in w if isinstance(x, float)], abs=1e-9)


def test_rules_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    want = brute_rules(rows)
    same(qr.quality_rules(docs).collect(), want)
    got = {tuple(r) for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    assert got == {(*w[:7], w[-1]) for w in want}


def test_rules_on_edges(spark):
    many = " ".join(f"w{k}" for k in range(300))
    rows = [
        (1, None, None), (2, "", "en"), (3, "a b c a b c", None), (3, "a b c a b c", None), (None, f"{many} {many}", "en"), (6, f"{many}\n{many}\n\n \t", "xx"),
        (7, "the of " * 4000 + many, "en"), (8, "ÄÖÜ ß 123 #$ <|> " * 30, "de"), (9, "x" * 50_000, "en"), (10, "a\x0bb\x0cc\rd \x1c\x85", "en"),
    ]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, lang string, words int, doc string").repartition(3)
    same(qr.quality_rules(df).collect(), brute_rules(rows))
    kept = qr.keep_fitting(df)
    assert kept.columns == df.columns
    assert sorted([r[0] for r in kept.collect()], key=repr) == sorted([w[0] for w in brute_rules(rows) if w[-1]], key=repr)
    assert qr.quality_rules(df.limit(0)).count() == 0


def test_rare_languages_have_their_own_reference(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    draw = random.Random(4)
    uncased = ["".join(chr(0x10D0 + draw.randrange(30)) for _ in range(2 + k % 6)) for k in range(200)]
    rows += [(10_000 + k, " ".join(draw.choices(uncased, [1 / (i + 1) for i in range(200)], k=150 + 20 * k)) + ".", "ka") for k in range(12)]
    words = Counter()
    for _, text, lang in rows:
        words[lang or ""] += len(WORD.findall(text or ""))
    rare = {lang for lang, n in words.items() if n < 20_000}
    assert {"de", "fr", "es", "ka"} <= rare
    got = qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    same(got, brute_rules(rows))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").select("doc_id").collect()
    clean = {r[0] for r in labels} & {i for i, _, lang in rows if lang in rare} | set(range(10_000, 10_012))
    judged = [r for r in got if r["doc_id"] in clean and not r["base_failed"] and r["n_words"] >= qr.LEAST_WORDS]
    assert len(judged) > 30 and all(r["kept"] for r in judged)


@pytest.mark.parametrize("languages", [1, 2, 300])
def test_any_number_of_languages(spark, languages):
    draw = random.Random(8)
    rows = []
    for k in range(languages):
        own = [f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for a in "abcdefghijklmnopqrstuvwxyzäöüßçé"]
        texts = [" ".join(draw.choices(own, [1 / (i + 1) for i in range(32)], k=120 + k % 7)) for _ in range(11)]
        rows += [(100 * k + i, t, f"l{k}") for i, t in enumerate([*texts, "#1 $2 %3 " * (20 if k % 2 else 1) + texts[0]])]
    rows += [(90_000, None, "none"), (90_001, "", None), (None, "of the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = brute_rules(rows)
    same(qr.quality_rules(df).collect(), want)
    assert {w[-1] for w in want if w[1] >= qr.LEAST_WORDS} == {True} | ({False} if languages > 1 else set())
    kept = sorted(r[0] for r in qr.keep_fitting(df).collect())
    assert kept == sorted(w[0] for w in want if w[-1])


def test_a_document_is_not_compared_with_itself(spark):
    draw = random.Random(2)
    junk = lambda: " ".join("".join(draw.choices("0123456789#$%&|{}", k=6)) for _ in range(300))
    prose = [" ".join(draw.choices(["the", "of", "and", "house", "river", "green", "walks", "on"], k=200)) for _ in range(12)]
    alone = junk()
    rows = [(k, t, "en") for k, t in enumerate(prose)] + [(20, alone, "en"), (21, alone, "xx"), (22, alone, None), (23, junk(), "yy"), (24, prose[0], "yy")]
    got = {r["doc_id"]: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[20]["char_distance"] > 0.9 and not got[20]["kept"]
    # alone in its language, or with too little beside it: not called near, not judged
    assert [got[i]["char_distance"] for i in (21, 22, 23, 24)] == [None] * 4 and [got[i]["word_distance"] for i in (21, 22, 23, 24)] == [None] * 4
    same(got.values(), brute_rules(rows))


def brute_sites(rows, labels):
    """rows of (id, text, host, path); labels of (id, good)."""
    known = defaultdict(list)
    for i, g in labels:
        if i is not None and g is not None:
            known[i].append(g)
    known = {i: sum(g) / len(g) for i, g in known.items()}
    feats = []
    for i, text, host, path in rows:
        words, c = WORD.findall(text or ""), classes(text or "")
        chars, n = max(1, sum(c)), max(1, len(words))
        shares = [
            c[1] / chars, c[5] / chars, c[4] / chars, c[2] / chars, len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, min(1.0, chars / n / 64), min(1.0, n / 4096),
        ]
        bins = [min(sq.BINS - 1, math.floor(-math.log2(s) * sq.STEPS)) if s > 0 else sq.BINS - 1 for s in shares]
        feats.append((i, host or "", path or "", len(words), bins))
    table = []
    for m in range(len(sq.MEASURES)):
        sides = []
        for side in (1, 0):
            raw = [0.0] * sq.BINS
            for i, _, _, _, bins in feats:
                if i in known:
                    raw[bins[m]] += known[i] if side else 1 - known[i]
            wide = [raw[b] + 0.25 * (raw[max(0, b - 1)] + raw[min(sq.BINS - 1, b + 1)]) + 0.5 for b in range(sq.BINS)]
            sides.append([w / sum(wide) for w in wide])
        table.append([math.log(a / b) for a, b in zip(*sides)])
    good = sum(known[f[0]] for f in feats if f[0] in known)
    bad = sum(1 - known[f[0]] for f in feats if f[0] in known)
    odds = math.log(good / bad)
    clip = lambda x: max(-sq.MOST_EVIDENCE, min(sq.MOST_EVIDENCE, x))
    evidence = [f[3] / (f[3] + sq.HALF_WORDS) * clip(sum(t[b] for t, b in zip(table, f[4]))) for f in feats]
    soft = [known.get(f[0], 1 / (1 + math.exp(-(e + odds)))) for f, e in zip(feats, evidence)]
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for f, s in zip(feats, soft):
        for site in (paths[f[1], f[2]], hosts[f[1]]):
            site[0] += 1
            site[1] += s
    mean = sum(soft) / len(soft)

    def pull(sites):
        total = sum(n for n, _, _ in sites)
        spread = sum(n * (g / n - m) ** 2 for n, g, m in sites) / total
        noise = sum(m * (1 - m) for _, _, m in sites) / total
        within = sum(n * m * (1 - m) for n, _, m in sites) / total
        return max(sq.LEAST_PULL, min(sq.MOST_PULL, within / max(spread - noise, 1e-12) - 1))

    a = pull([(n, g, mean) for n, g in hosts.values()])
    host_mean = {h: (g + a * mean) / (n + a) for h, (n, g) in hosts.items()}
    b = pull([(n, g, host_mean[h]) for (h, _), (n, g) in paths.items()])
    out = []
    for f, e, s in zip(feats, evidence, soft):
        hn, hg = hosts[f[1]]
        pn, pg = paths[f[1], f[2]]
        hs = (hg - s + a * mean) / (hn - 1 + a)
        ps = min(1 - 1e-9, max(1e-9, (pg - s + b * hs) / (pn - 1 + b)))
        p = 1 / (1 + math.exp(-(e + math.log(ps / (1 - ps)))))
        out.append((f[0], f[1], f[2], e, hs, ps, p, p >= sq.LEAST_PROBABILITY))
    return out


def test_sites_of_the_whole_table(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]
    known = [tuple(r) for r in labels.select("doc_id", "quality").collect()]
    same(QUERIES["op3_site_quality"](spark, SF).collect(), brute_sites(rows, known))


def test_sites_on_edges(spark):
    clean = "The river and the hill are in the north of the land. It was a good day for all, and they said so."
    rows = [(k, clean + f" Day {k}.", "h1", "a") for k in range(30)] + [(100 + k, "BUY!! NOW!! " * 20, "h2", None) for k in range(20)]
    rows += [(200, None, None, None), (201, "", "h3", "a"), (201, "", "h3", "a"), (None, clean, "h1", "b"), (203, "z" * 40_000, "h1", "a")]
    labels = [(k, 1) for k in range(20)] + [(100 + k, 0) for k in range(10)] + [(5, 0), (None, 1), (7, None)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, lang string, good int, n double").repartition(3)
    marks = spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, soft int")
    same(sq.site_quality(df, marks).drop("row_key").collect(), brute_sites(rows, labels))
    kept = sq.keep_good(df, marks)
    assert kept.columns == df.columns
    want = [r[0] for r in brute_sites(rows, labels) if r[-1]]
    assert sorted([r[0] for r in kept.collect()], key=repr) == sorted(want, key=repr)
    assert sq.keep_good(df, marks.limit(0)).count() == len(rows)
    assert sq.site_quality(df.limit(0), marks).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), {r[0]: r[1] for r in labels.where("doc_id % 2 = 1").select("doc_id", "quality").collect()}
    kept = {r["doc_id"]: r["kept"] for r in sq.site_quality(docs, fit).collect()}
    good = [kept[i] for i, q in held.items() if q]
    bad = [kept[i] for i, q in held.items() if not q]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad), (sum(good), len(good), sum(bad), len(bad))
