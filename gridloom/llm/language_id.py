"""Language identification by interpolated Kneser-Ney character models, one per language.

A word is a run of letters, lower-cased, between a start and an end mark; a model gives each letter and the end mark a probability behind up to ``order - 1`` symbols of the same word. The
highest order is estimated from counts, lower orders from the number of different symbols in front (grams at a word's start, which nothing can precede, from counts). Every order is discounted and
interpolated with the one below. The finished model is two numbers per gram - its log-probability, and the weight of the lower order behind it - in arrays sorted by a 64-bit hash of the gram.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import by_bytes, only
from gridloom.session import materialise

START, END = "<", ">"
UNKNOWN = "und"
#: Highest order of the models, and grams kept of each order and language.
ORDER, CAPACITY = 5, 500_000
#: Languages whose models are in memory together.
BLOCK = 8
#: Of a language with at least ``LEAST_DOCS`` documents to learn from, one in ``SLICE`` is set apart for calibration.
LEAST_DOCS, SLICE = 64, 8
#: Share of a language's own documents that may lie beyond its limit, and documents that a limit needs.
BEYOND, LEAST_LIMIT = 0.002, 100
#: Text bytes of one step; a worker forgets tokens beyond so many, or so many characters, and grams beyond so many, and passes counts on from so many distinct tokens.
BATCH_BYTES, MEMO_TOKENS, MEMO_CHARS, MEMO_GRAMS, FLUSH = 8 << 20, 600_000, 16_000_000, 1_000_000, 600_000
_RUN = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of_letters(text: str) -> list[str]:
    """Runs of letters, lower-cased; digits of any kind, marks and signs end a run."""
    runs = _RUN.findall(text.lower())
    if "".join(runs).isalpha():
        return runs
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from."""
    return _digits(doc_id) % 4 == 2


def _digits(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def _count(order: int):
    """Counts of the highest grams of each language, and of the shorter ones at the start of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                tokens.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, tokens.values())) > FLUSH:
                yield from (_grams(lang, found, order) for lang, found in tokens.items())
                tokens = {}
        yield from (_grams(lang, found, order) for lang, found in tokens.items())

    return run


def _grams(lang: str, found: Counter, order: int) -> pa.RecordBatch:
    words: Counter = Counter()
    for token, n in found.items():
        for word in words_of_letters(token):
            words[word] += n
    text = Windows(list(words), order)
    weights = np.repeat(np.fromiter(words.values(), np.int64, len(words)), text.lengths)
    sums = np.bincount(text.where, weights * (text.place > 0), len(text.first)).astype(np.int64)
    keep = np.flatnonzero(sums)
    grams = [text.gram(int(i)) for i in keep]
    return pa.record_batch(
        [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(sums[keep], pa.int64())], names=["lang", "gram", "n"]
    )


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over all ``rows`` (``lang, text``)."""
    counted = rows.mapInArrow(_count(order), "lang string, gram string, n long")
    return materialise(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def kneser_ney(counts: DataFrame, order: int = ORDER, capacity: int = CAPACITY) -> DataFrame:
    """``lang, gram, logp, back``: interpolated log-probabilities, and the log-weight of the lower order behind a gram.

    At most ``capacity`` grams of each order and language stay, those that occur most often; all counts are taken before. Grams that occur equally often stay or go together.
    """
    tail = lambda c: F.substring(c, 2, order)
    starts = F.col("gram").startswith(START)
    levels = {order: counts.where(F.length("gram") == order)}
    for k in range(order - 1, 0, -1):
        followed = levels[k + 1].groupBy("lang", tail("gram").alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = materialise(followed.unionByName(counts.where(starts & (F.length("gram") == k))), "grams-below")
    letters = levels[1].agg(F.count_distinct("gram")).first()[0]
    below = None
    finished = []
    for k in range(1, order + 1):
        once = levels[k].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        # at 0 an order would leave nothing to the one below, at 1 nothing to itself
        cut = _by_lang({r["lang"]: r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5 for r in once.collect()})  # a number a language
        head = F.substring("gram", 1, k - 1)
        behind = levels[k].groupBy("lang", head.alias("head")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        behind = behind.withColumn("cut", cut).select("lang", "head", "total", "cut", (F.col("cut") * F.col("kinds") / F.col("total")).alias("weight"))
        behind = materialise(behind, "contexts")
        known = levels[k].withColumn("head", head).join(behind, ["lang", "head"])
        if k == 1:
            known = known.withColumn("lower", F.lit(1.0 / (letters + 1)))
        else:
            known = known.withColumn("last", tail("gram")).join(below.select("lang", F.col("gram").alias("last"), F.col("p").alias("lower")), ["lang", "last"])
        level = known.select("lang", "gram", "n", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("lower")).alias("p"))
        level = materialise(level, "level")
        weights = behind.select("lang", F.col("head").alias("gram"), F.log("weight").alias("back"))
        if k == 1:
            # the empty gram keeps what a letter that no text held gets
            nothing = weights.select("lang", "gram", (F.col("back") - math.log(letters + 1)).alias("logp"), "back")
            finished.append(nothing)
        else:
            finished.append(_join_back(_most_frequent(below, capacity), weights))
        below = level
    finished.append(_most_frequent(below, capacity).select("lang", "gram", F.log("p").alias("logp"), F.lit(0.0).alias("back")))
    model = finished[0]
    for part in finished[1:]:
        model = model.unionByName(part)
    return materialise(model, "model")


def _join_back(level: DataFrame, weights: DataFrame) -> DataFrame:
    """Grams with the weight behind them; the start mark alone is a context only."""
    joined = level.join(weights, ["lang", "gram"], "full")
    return joined.where(F.col("p").isNotNull() | (F.col("gram") == START)).select(
        "lang", "gram", F.coalesce(F.log("p"), F.lit(0.0)).alias("logp"), F.coalesce("back", F.lit(0.0)).alias("back")
    )


def _most_frequent(level: DataFrame, capacity: int) -> DataFrame:
    """Grams whose count keeps the number of grams of their language within ``capacity``: counts are put in a histogram of 64 classes a doubling first."""
    level = level.withColumn("class", F.floor(F.log2("n") * 64))
    histogram = level.groupBy("lang", "class").agg(F.count("*").alias("grams"))
    downwards = Window.partitionBy("lang").orderBy(F.desc("class"))
    fits = histogram.withColumn("kept", F.sum("grams").over(downwards)).where(F.col("kept") <= capacity)
    least = _by_lang({r["lang"]: r["least"] for r in fits.groupBy("lang").agg(F.min("class").alias("least")).collect()})  # a number a language
    return level.where(F.col("class") >= least).drop("class")


def _by_lang(numbers: dict[str, float]) -> Column:
    """A number that belongs to the row's language."""
    if not numbers:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[x for lang, n in sorted(numbers.items()) for x in (F.lit(lang), F.lit(n))]), F.col("lang"))


@dataclass
class Model:
    """A language's grams as sorted hashes with log-probability and weight; ``unseen`` is for letters that no text held."""

    lang: str
    keys: np.ndarray
    logp: np.ndarray
    back: np.ndarray
    unseen: float


def _mixed(total: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def hash_columns(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of grams whose last symbols are the first column, those before them the second, and so on."""
    total, power = np.zeros(len(columns[0]), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for column in columns:
            total += (column + np.uint64(1)) * power
            power *= _BASE
    return _mixed(total)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Windows:
    """All places of some words with the gram of up to ``order`` symbols that ends there; equal grams are found once.

    ``where`` leads from a place to its gram, ``first`` from a gram to a place of it.
    """

    def __init__(self, words: list[str], order: int):
        self.text = "".join([f"{START}{w}{END}" for w in words])
        self.order, self.codes = order, _codes(self.text)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.codes)) - np.repeat(self.begins, self.lengths)  # 0 is the start mark
        total, power = np.zeros(len(self.codes), np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for back in range(min(order, len(self.codes))):
                near = np.where(self.place[back:] >= back, self.codes[:len(self.codes) - back] + np.uint64(1), np.uint64(0))
                total[back:] += near * power
                power *= _BASE
        self.keys, self.first, self.where = np.unique(_mixed(total), return_index=True, return_inverse=True)

    def gram(self, i: int) -> str:
        end = int(self.first[i])
        return self.text[end - min(int(self.place[end]), self.order - 1):end + 1]

    def symbols(self, back: int) -> np.ndarray:
        """The symbol so many places before the end of each gram; whatever stands there if the gram is shorter."""
        return self.codes[np.maximum(self.first - back, 0)]


def load_models(model: DataFrame, langs: list[str]) -> list[Model]:
    """Sorted hash arrays of a block of languages, at most ``order * capacity`` grams each."""
    table = model.where(F.col("lang").isin(langs)).toArrow()
    loaded = []
    for lang in langs:
        part = table.filter(pc.equal(table.column("lang"), lang))
        grams = part.column("gram").to_pylist()
        keys = np.zeros(len(grams), np.uint64)
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            codes = _codes("".join(grams[i] for i in at))
            keys[at] = hash_columns([codes[size - 1 - back::size] for back in range(size)])
        logp, back = part.column("logp").to_numpy().astype(np.float32), part.column("back").to_numpy().astype(np.float32)
        unseen = float(logp[sizes == 0][0])
        order = np.argsort(keys[sizes > 0])
        loaded.append(Model(lang, keys[sizes > 0][order], logp[sizes > 0][order], back[sizes > 0][order], unseen))
    return loaded


def _lookup(model: Model, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted array, and whether the gram is there."""
    at = np.searchsorted(model.keys, keys)
    at[at == len(model.keys)] = 0
    return at, model.keys[at] == keys if len(model.keys) else np.zeros(len(keys), bool)


class Scorer:
    """Log-probabilities of a block of languages. A gram that was met before is not looked up again; at most ``MEMO_GRAMS`` are remembered."""

    def __init__(self, models: list[Model], order: int = ORDER):
        self.models, self.order = models, order
        self.forget()

    def forget(self) -> None:
        self.keys, self.logp = np.zeros(0, np.uint64), np.zeros((0, len(self.models)))

    def grams(self, text: Windows) -> np.ndarray:
        """Log-probability of the last symbol of each gram (row) in each language (column)."""
        at = np.searchsorted(self.keys, text.keys)
        at[at == len(self.keys)] = 0
        new = np.flatnonzero(self.keys[at] != text.keys) if len(self.keys) else np.arange(len(text.keys))
        if len(new):
            if len(self.keys) + len(new) > MEMO_GRAMS:
                self.forget()
                new = np.arange(len(text.keys))
            keys = np.concatenate([self.keys, text.keys[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.logp = keys[order], np.concatenate([self.logp, self._look_up(text, new)])[order]
            at = np.searchsorted(self.keys, text.keys)
        return self.logp[at]

    def _look_up(self, text: Windows, chosen: np.ndarray) -> np.ndarray:
        size = np.minimum(text.place[text.first[chosen]] + 1, self.order)
        columns = [text.symbols(back)[chosen] for back in range(self.order)]
        out = np.zeros((len(chosen), len(self.models)))
        for column, model in enumerate(self.models):
            logp = np.full(len(size), model.unseen)
            for k in range(1, self.order + 1):
                long_enough = np.flatnonzero(size >= k)
                if k > 1:
                    at, hit = _lookup(model, hash_columns([c[long_enough] for c in columns[1:k]]))
                    logp[long_enough[hit]] += model.back[at[hit]]
                at, hit = _lookup(model, hash_columns([c[long_enough] for c in columns[:k]]))
                logp[long_enough[hit]] = model.logp[at[hit]]
            logp[size == 1] = 0.0  # the start mark is given
            out[:, column] = logp
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word (row) in each language (column), its end included."""
        if not words:
            return np.zeros((0, len(self.models)))
        text = Windows(words, self.order)
        return np.add.reduceat(self.grams(text)[text.where], text.begins, axis=0)

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """Log-probabilities of the words of each token, and behind them their symbols."""
        words = [words_of_letters(t) for t in tokens]
        flat = list(chain.from_iterable(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros((len(tokens), len(self.models) + 1))
        if flat:
            some = np.flatnonzero(sizes)
            each = np.column_stack([self.words(flat), np.fromiter(map(len, flat), np.int64, len(flat)) + 1])
            out[some] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some])
        return out


def _score(shared, order: int):
    """Adds a block of languages to what is known of each text: best and second cross-entropy in bits a symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        names, scorer = [m.lang for m in models], Scorer(models, order)
        memo: dict[str, int] = {}
        known, chars = np.zeros((0, len(models) + 1)), 0
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for low, high in by_bytes([4 * len(t) for t in texts], BATCH_BYTES):
                cut = [t.split() for t in texts[low:high]]
                if len(memo) > MEMO_TOKENS or chars > MEMO_CHARS:
                    memo, known, chars = {}, known[:0], 0
                new = list(set().union(*cut).difference(memo))
                if new:
                    memo.update(zip(new, range(len(memo), len(memo) + len(new))))
                    known = np.concatenate([known, scorer.tokens(new)])
                    chars += sum(map(len, new))
                sizes = np.fromiter(map(len, cut), np.int64, len(cut))
                index = np.fromiter(map(memo.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
                totals = np.zeros((len(cut), len(models) + 1))
                if len(index):
                    some = np.flatnonzero(sizes)
                    totals[some] = np.add.reduceat(known[index], (np.cumsum(sizes) - sizes)[some])
                symbols = totals[:, -1].astype(np.int64)
                yield _best(batch.slice(low, high - low), names, -totals[:, :-1] / math.log(2) / np.maximum(symbols, 1)[:, None], symbols)

    return run


def _best(batch: pa.RecordBatch, names: list[str], entropy: np.ndarray, symbols: np.ndarray) -> pa.RecordBatch:
    before = list(zip(*[batch.column(c).to_pylist() for c in ("best", "first", "second")]))
    best, first, second = [], [], []
    for (lang, low, next_), row in zip(before, entropy):
        ways = sorted([(e, n) for e, n in zip(row.tolist(), names)] + [(e, n) for e, n in ((low, lang), (next_, "")) if e is not None])[:2]
        best.append(ways[0][1])
        first.append(ways[0][0])
        second.append(ways[1][0] if len(ways) > 1 else None)
    new = {
        "best": pa.array(best, pa.string()), "first": pa.array(first, pa.float64()), "second": pa.array(second, pa.float64()), "symbols": pa.array(symbols, pa.int64())
    }
    names_ = batch.schema.names
    return pa.record_batch([new.get(n, batch.column(n)) for n in names_], names=names_)


def entropies(docs: DataFrame, model: DataFrame, langs: list[str], order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """``docs`` without the text, with ``best, first, second, symbols``; the text is read once for every ``block`` languages."""
    spark = docs.sparkSession
    scored = docs.select(
        "*", F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("second"), F.lit(0).cast("long").alias("symbols")
    )
    for at in range(0, len(langs), block):
        shared = spark.sparkContext.broadcast(load_models(model, langs[at:at + block]))
        scored = scored.mapInArrow(_score(shared, order), scored.schema)
        if at + block < len(langs):
            scored = materialise(scored, "scored-texts")
    return materialise(scored.drop("text"), "scored")


@dataclass
class Calibration:
    """Share of right answers by the doubling of the gap in bits, and the highest cross-entropy (in twentieths of a bit) by language and doubling of the length."""

    right: list[float]
    limits: dict[tuple[str, int], float]


GAPS, LENGTHS, STEP = 24, 32, 20


def gap_class() -> Column:
    gap = F.coalesce((F.col("second") - F.col("first")) * F.col("symbols"), F.lit(0.0))
    return F.least(F.floor(F.log2(gap + 1)), F.lit(GAPS - 1)).cast("int")


def length_class() -> Column:
    return F.least(F.floor(F.log2(F.greatest("symbols", F.lit(1)))), F.lit(LENGTHS - 1)).cast("int")


def rising(hits: list[float], totals: list[float]) -> list[float]:
    """Shares that never fall (pool adjacent violators), with half an even chance added to each class."""
    pools: list[list[float]] = []
    for hit, total in zip(hits, totals):
        pools.append([hit + 0.5, total + 1.0, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            h, t, n = pools.pop()
            pools[-1] = [pools[-1][0] + h, pools[-1][1] + t, pools[-1][2] + n]
    return [h / t for h, t, n in pools for _ in range(int(n))]


def calibrate(scored: DataFrame, beyond: float = BEYOND) -> Calibration:
    """From documents of known language that no model learnt from. What reaches the driver is one row per class, whatever their number."""
    known = scored.where("apart and symbols > 0 and best is not null")
    table = known.groupBy(gap_class().alias("gap")).agg(F.count_if(F.col("lang") == F.col("best")).alias("hits"), F.count("*").alias("n")).collect()
    hits, totals = [0.0] * GAPS, [0.0] * GAPS
    for r in table:
        hits[r["gap"]], totals[r["gap"]] = r["hits"], r["n"]
    level = F.ceil(F.least("first", F.lit(64.0)) * STEP)
    spread = known.where("lang = best").groupBy("best", length_class().alias("size"), level.alias("level")).agg(F.count("*").alias("n")).collect()
    by_class: dict[tuple[str, int], Counter] = {}
    for r in spread:
        by_class.setdefault((r["best"], r["size"]), Counter())[r["level"]] += r["n"]
    limits = {}
    for key, levels in by_class.items():
        total = sum(levels.values())
        if total >= LEAST_LIMIT:
            seen = 0
            for at in sorted(levels):
                seen += levels[at]
                if seen >= (1 - beyond) * total:
                    limits[key] = (at + 1) / STEP
                    break
    return Calibration(rising(hits, totals), limits)


def identify(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, capacity: int = CAPACITY,
    block: int = BLOCK, least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted, cross_entropy``: one row per row of ``docs``.

    Models learn from all rows with a language that are not held out (``crc32`` of the id as text, modulo 4, is 2), except one in eight of each language of ``least_docs`` rows or more: these
    calibrate. ``lang_pred`` is the language of least cross-entropy a letter, ``score`` the share of right answers among calibration rows whose lead over the second language was as large.
    ``accepted`` is false if that is below one half, or the cross-entropy is beyond what calibration rows of that language and length showed (all but two in a thousand; the loosest limit of that length
    where a language has too few of them).

    Words are counted before grams, grams before the shuffle, so a language or a text that fills much of the input is pre-aggregated. Each language keeps at most ``capacity`` grams an
    order; a task holds ``block`` languages. Texts are read whole and never shuffled.

    A null text, a text without a letter and an input without any language give ``und``, score 0, not accepted. A null id counts as an empty one; repeated rows are judged each, and learnt from each.
    Words of any length are scored whole. Ties go to the language that sorts first. An empty table gives an empty result; further columns are not read.
    """
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    learnable = rows.where("lang is not null and not held_out")
    sizes = {r["lang"]: r["n"] for r in learnable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    large = [lang for lang, n in sizes.items() if n >= least_docs]
    slice_ = F.floor(_digits(F.col("doc_id")) / 4) % SLICE == SLICE - 1
    apart = ~F.col("held_out") & F.coalesce(F.col("lang").isin(large), F.lit(False)) & slice_
    rows = rows.withColumn("apart", apart)
    counts = gram_counts(rows.where("lang is not null and text is not null and not held_out and not apart").select("lang", "text"), order)
    model = kneser_ney(counts, order, capacity)
    langs = sorted(r["lang"] for r in model.select("lang").distinct().collect())
    scored = entropies(rows, model, langs, order, block)
    found = calibrate(scored)
    shares = F.array(*[F.lit(float(x)) for x in found.right])
    limit = F.lit(None).cast("double")
    if found.limits:
        pairs = [x for (lang, size), most in sorted(found.limits.items()) for x in (F.lit(f"{size}:{lang}"), F.lit(float(most)))]
        limit = F.try_element_at(F.create_map(*pairs), F.concat_ws(":", length_class().cast("string"), F.col("best")))
        loosest = {size: max(m for (_, s), m in found.limits.items() if s == size) for _, size in found.limits}
        others = F.create_map(*[x for size, most in sorted(loosest.items()) for x in (F.lit(size), F.lit(float(most)))])
        limit = F.coalesce(limit, F.try_element_at(others, length_class()))
    judged = (F.col("symbols") > 0) & F.col("best").isNotNull()
    score = F.when(judged, F.get(shares, gap_class())).otherwise(0.0)
    return scored.select(
        "doc_id", "held_out", F.when(judged, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"),
        (judged & (score >= 0.5) & F.coalesce(F.col("first") <= limit, F.lit(True))).alias("accepted"),
        F.when(judged, F.col("first")).alias("cross_entropy"),
    )
