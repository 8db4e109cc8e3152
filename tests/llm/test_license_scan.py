"""Licence scans against every pair of passage and template."""

import random
import re
from collections import Counter

from gridloom.llm import license_scan as ls
from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall("[a-z0-9]+", text.lower())


def brute(rows, templates, least=0.8, windows=True):
    """No bounds and no shortcuts: lines, blocks, the whole text and (where a template's words are dense) every window against all templates, then the rule of foreign wording."""
    out = []
    grams = {name: Counter(zip(w, w[1:])) for name, t in templates.items() if len(w := words(t)) > 1}
    pairs = {g for held in grams.values() for g in held}
    for i, text in rows:
        every, spans, blocks, inside = [], [], [], False
        for line in (text or "").split("\n"):
            w = words(line)
            if w:
                a, b = len(every), len(every) + len(w)
                every += w
                spans.append((a, b))
                blocks = [*blocks[:-1], [blocks[-1][0], b, blocks[-1][2] + 1]] if inside else [*blocks, [a, b, 1]]
            inside = bool(w)
        spans += [(a, b) for a, b, n in blocks if n > 1] + ([(0, len(every))] if len(blocks) > 1 else [])

        def dice(a, b, name):
            own = Counter(zip(every[a:b], every[a + 1:b]))
            return 2.0 * sum((own & grams[name]).values()) / (b - a - 1 + sum(grams[name].values()))

        kept, strong, used = [], [], {name: set() for name in grams}

        def take(cands, once):
            for low, a, end, name in sorted(cands):
                b, own = -end, set(zip(every[a:-end], every[a + 1:-end]))
                if once and used[name] & set(range(a, b)):
                    continue
                if any(o != name and x <= a and b <= y and (d > -low or d == -low and y - x > b - a) and own & grams[name].keys() <= grams[o].keys() for o, x, y, d in strong):
                    continue
                used[name] |= set(range(a, b))
                kept.append((name, a, b, -low))
                strong.append((name, a, b, max([-low, *[-d for d, x, y, n in cands if not once and n == name and a <= x and -y <= b]])))

        at = [k for k, g in enumerate(zip(every, every[1:])) if g in pairs]
        cands = []
        for name, held in grams.items() if windows else ():
            own = [k for k in at if (every[k], every[k + 1]) in held]
            size = sum(held.values())
            for p, a in enumerate(own):
                ends = [k + 2 for k in own[p:] if k - a + 1 <= size * (2 - least) / least + 1e-9]
                best = max(((d, -e) for e in ends if (d := dice(a, e, name)) >= least), default=None)
                if best:
                    cands.append((-best[0], a, best[1], name))
        take([(-d, a, -b, name) for a, b in spans if b - a > 1 for name in grams if (d := dice(a, b, name)) >= least], False)
        take(cands, True)
        found = {}
        for name, _, _, d in kept:
            found.setdefault(name, []).append(d)
        out += [(i, name, len(v), max(v)) for name, v in found.items()]
    return sorted(out, key=repr)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op2_license_scan"](spark, SF).collect()), key=repr)
    assert got == brute(rows, ls.TEMPLATES)  # with every window
    assert len({r[1] for r in got}) >= 5


def test_edges(spark):
    mit = ls.TEMPLATES["mit/text"]
    cut = mit.replace(" including without limitation the rights", "")
    rows = [
        (1, None), (2, ""), (3, mit), (3, mit), (None, "All  RIGHTS\treserved"), (5, "x " * 5_000 + "\n" + mit), (6, f"head\n\n{cut}\n\ntail"),
        (7, "Released under\nthe MIT License."), (8, "reserved"), (9, "all rights reserved all rights reserved"), (10, "Licensed under CC BY-SA 4.0!"),
    ]
    df = spark.createDataFrame([(i, t, 0.5, "z") for i, t in rows], "doc_id long, text string, dice double, template string").repartition(2)
    got = sorted(map(tuple, ls.license_scan(df).collect()), key=repr)
    assert got == brute(rows, ls.TEMPLATES)
    assert {(6, "mit/text"), (7, "mit/notice"), (None, "all-rights-reserved/notice")} <= {r[:2] for r in got}
    assert ls.license_scan(df.limit(0)).count() == 0
    assert ls.license_scan(df, templates={}).count() == 0


def test_bounds_lose_nothing():
    known = ls.Templates({"a": "one two three four five six", "b": "six five four"}, 0.5)
    every = ["one", "two", "three", "four", "five", "six", "x"]
    for n in range(1, 14):
        for shift in range(7):
            w = [every[(shift + k) % 7] for k in range(n)]
            own = Counter(zip(w, w[1:]))
            want = {t: d for t, held in known.grams.items() if n > 1 and (d := 2.0 * sum((own & held).values()) / (n - 1 + known.sizes[t])) >= 0.5}
            assert dict(known.hits(w)) == want


def test_licences_inside_long_documents(spark):
    t = ls.TEMPLATES
    parts = {
        "mit/text": re.split(r"(?<=conditions:)|(?<=the Software\.)(?= THE)", t["mit/text"]),
        "gpl-3.0/header": re.split(r"(?<=later version\.)|(?<=PURPOSE\.)", t["gpl-3.0/header"]),
        "apache-2.0/header": re.split(r"(?<=with the License\.)|(?<=LICENSE-2\.0)", t["apache-2.0/header"]),
    }
    prose = " ".join(f"word{k % 97} is of the other{k % 31}" for k in range(100))
    rows, want = [], set()
    for k, (name, paragraphs) in enumerate(parts.items()):
        assert len(paragraphs) == 3
        for m, between in enumerate(["\n\n", "\n#\n# ", "\n *\n * "]):
            rows.append((10 * k + m, f"Head of the file{between}{between.join(paragraphs)}\n\n{prose}"))
            want.add((10 * k + m, name))
    rows += [(50, f"{prose}. Licensed under CC BY 4.0. {prose}"), (51, f"{prose}; all rights reserved, {prose}\n{prose}. All rights\n\nreserved."), (52, prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r[0], r[1]): (r[2], r[3]) for r in ls.license_scan(df).collect()}
    assert want | {(50, "cc-by-4.0/notice"), (51, "all-rights-reserved/notice")} <= set(got)
    assert got[50, "cc-by-4.0/notice"] == (1, 1.0) and got[51, "all-rights-reserved/notice"] == (2, 1.0)
    assert not any(i == 52 for i, _ in got)


def test_windows_lose_nothing():
    known = ls.Templates({"a": "one two three four five six", "b": "six five four", "c": "one two one two one"}, 0.7)
    draw = random.Random(5)
    for _ in range(300):
        w = draw.choices(["one", "two", "three", "four", "five", "six", "x"], k=draw.randrange(0, 25))
        want = {}
        for a in range(len(w)):
            for b in range(a + 2, len(w) + 1):
                own = Counter(zip(w[a:b], w[a + 1:b]))
                for t, held in known.grams.items():
                    dice = 2.0 * sum((own & held).values()) / (b - a - 1 + known.sizes[t])
                    if dice >= 0.7:
                        want[t] = max(dice, want.get(t, 0))
        got = {}
        for dice, _, _, t in known.windows(w):
            got[t] = max(-dice, got.get(t, 0))
        assert got == want


def test_found_equals_brute_force_on_random_texts():
    texts = {"a": "one two three four five six", "b": "six five four", "c": "one two one two one", "d": "one two three four five seven", "e": "one two three four five six"}
    known, draw = ls.Templates(texts, 0.7), random.Random(9)
    for n in range(400):
        text = "".join(draw.choice(["one", "two", "three", "four", "five", "six", "seven", "x"]) + draw.choice([" ", " ", " ", "\n", "\n\n"]) for _ in range(draw.randrange(0, 30)))
        got = {}
        for name, dice in known.found(text):
            got.setdefault(name, []).append(dice)
        assert sorted((n, t, len(v), max(v)) for t, v in got.items()) == brute([(n, text)], texts, 0.7), text


def test_a_notice_gives_the_same_rows_alone_and_inside_a_sentence(spark):
    t = ls.TEMPLATES
    rows = []
    for k, name in enumerate(sorted(t)):
        rows += [(3 * k, t[name]), (3 * k + 1, f"Some words before it. {t[name]} And words behind."), (3 * k + 2, f"before\n\n{t[name]}\n\nbehind it")]
    got = {}
    for r in ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], {})[r["template"]] = r["dice"]
    for k, name in enumerate(sorted(t)):
        assert got[3 * k][name] == got[3 * k + 2][name] == 1.0 and name in got[3 * k + 1], name
        if len(words(t[name])) <= 20:  # long texts fill their line, so that the line itself is a passage, with the words around
            assert set(got[3 * k]) == set(got[3 * k + 1]) == set(got[3 * k + 2]), name
    at = 3 * sorted(t).index("gpl-3.0/notice")
    assert got[at] == got[at + 1] == got[at + 2] == {"gpl-3.0/notice": 1.0}
    assert {"bsd-2-clause/text", "bsd-3-clause/text", "unlicense/text"} <= set(t)


def test_many_notices_in_one_text():
    import time

    known = ls.Templates(ls.TEMPLATES, 0.8)
    notice = ls.TEMPLATES["gpl-3.0/notice"]

    def seconds(n):
        start = time.perf_counter()
        assert sum(name == "gpl-3.0/notice" for name, _ in known.found(f"{notice} and then " * n)) == n
        return time.perf_counter() - start

    one = seconds(1_000)
    assert seconds(8_000) < 16 * max(one, 0.05)
