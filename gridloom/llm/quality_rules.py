"""Quality rules: counted limits, then the Jensen-Shannon distance to a language's own histograms.

Two histograms of a document are compared to references that are counted over all other documents of its language: the classes of its characters and its share of
each of the language's commonest words. Only functions of Spark are used.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import SPACE, let, only, text_or_empty, with_row_key, words_of
from gridloom.session import materialise

#: Commonest words of a language that are compared one by one; all others are one bin.
COMMON = 24
#: A document is compared with what its language holds without it, if that has so many words, or characters.
LEAST_REST_WORDS, LEAST_REST_CHARS = 1000, 5000
#: A histogram is judged only with so many characters, or words, in it.
LEAST_CHARS, LEAST_WORDS = 200, 100
#: Largest distances of a kept document; that of words may be larger by ``SLACK`` over the number of words, as short histograms are rough.
MOST_CHARS, MOST_WORDS, SLACK = 0.27, 0.25, 3.0

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Character classes, taken out of the text one after the other; what is left is the last class.
_CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "letter": r"[\p{L}\p{M}]+", "point": r"[.,;:!?'\"()\-]+"}
#: Repeated windows of a text that are looked up one by one; beyond, its windows are sorted with their places.
_FEW = 64


def with_char_classes(df: DataFrame, text: str) -> DataFrame:
    """Add ``chars``: code points of the text outside white space, by class."""
    out = df.withColumn("_rest", F.regexp_replace(text, SPACE, ""))
    sizes = []
    for i, pattern in enumerate(_CLASSES.values()):
        out = out.withColumns({"_next": F.regexp_replace("_rest", pattern, ""), f"_had{i}": F.length("_rest").cast("long")})
        sizes.append(f"_had{i}")
        out = out.withColumn("_rest", F.col("_next"))
        if i == 3:
            # letters, digits and white space are gone, so the symbols are what is easy to count
            out = out.withColumn("_symbols", (F.length("_rest") - F.length(F.regexp_replace("_rest", r"[#*$%&|<>]+", ""))).cast("long"))
    sizes = [F.col(s) for s in sizes] + [F.length("_rest").cast("long"), F.lit(0).cast("long")]
    return out.withColumn("chars", F.array(*[a - b for a, b in zip(sizes, sizes[1:])])).drop("_next")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds at least twice. Windows are compared by XXH64."""
    last = F.size(words) - 2
    hashes = F.transform(
        F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def counted(hashes: Column) -> Column:
        return let(F.sort_array(hashes), lambda ordered: let(
            F.array_distinct(F.filter(ordered, lambda h, i: (i > 0) & (h == F.get(ordered, i - 1)))),
            lambda twice: F.when(F.size(twice) == 0, F.lit(0)).otherwise(_covered(places(hashes, twice))),
        ))

    def places(hashes: Column, twice: Column) -> Column:
        few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        many = let(pairs, lambda p: F.sort_array(F.filter(
            F.transform(p, lambda x, k: F.when(
                F.coalesce(x["h"] == F.get(p, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, k + 1)["h"], F.lit(False)), x["i"])),
            lambda i: i.isNotNull(),
        )))
        return F.when(F.size(twice) <= _FEW, few).otherwise(many)

    return F.when(last < 1, F.lit(0)).otherwise(let(hashes, counted)).cast("long")


def _covered(starts: Column) -> Column:
    """Positions in windows of three from sorted starts."""
    return let(starts, lambda s: F.aggregate(
        F.transform(s, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
    ))


def measured(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc, words``: a struct with the row's counts, and its words in order."""
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col, **{c: c for c in carry})
    rows = rows.select("doc_id", *carry, F.coalesce("lang", F.lit("")).alias("lang"), text_or_empty("text").alias("text"))
    rows = with_char_classes(rows.withColumn("words", words_of(F.col("text"))), "text")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        F.struct(
            "doc_id", *carry, "lang",
            F.size("words").cast("long").alias("n_words"), F.col("_had0").alias("word_chars"), F.col("_symbols").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("words")).alias("n_repeat_words"), "chars",
        ).alias("doc"),
        "words",
    )


def language_references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, words, common, counts, chars``: number of words, commonest words with their counts and characters by class of each language.

    Counted over every word of every document. Words count once per task before they are shuffled, and the commonest
    words are cut in each task before they meet, so a language that has most of the input is no single task's work.
    """
    rows = only(docs, text=text_col, lang=lang_col).select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.explode(words_of(text_or_empty("text"))).alias("word")
    )
    counts = materialise(rows.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    sums = with_char_classes(counts, "word").groupBy("lang").agg(
        F.sum("n").alias("words"), F.array(*[F.sum(F.col("n") * F.col("chars")[k]) for k in range(len(_CLASSES) + 1)]).alias("chars")
    )
    sums = materialise(sums, "languages")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.where(F.col("word").rlike(r"^\p{L}+$")).withColumn("rank", rank).where(F.col("rank") <= COMMON)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    return materialise(
        sums.join(top, "lang", "left").select(
            "lang", "words", F.coalesce(F.col("top.word"), F.array().cast("array<string>")).alias("common"),
            F.coalesce(F.col("top.n"), F.array().cast("array<bigint>")).alias("counts"), "chars",
        ),
        "references",
    )


def _with_bins(rows: DataFrame, references: DataFrame) -> DataFrame:
    """``doc``, its reference and ``bins``, how often it holds each common word of its language.

    The references are a written table of some hundred bytes a language: small ones are broadcast by their size, others joined by language. Documents are neither exploded nor grouped.
    """
    known = references.select("lang", "words", "common", "counts", F.col("chars").alias("ref_chars")).withColumnRenamed("words", "ref_words")
    joined = rows.join(known, rows["doc.lang"] == known["lang"], "left")
    hits = F.filter("words", lambda w: F.array_contains("common", w))
    return joined.select(
        "doc", "ref_words", "counts", "ref_chars",
        let(hits, lambda held: F.transform("common", lambda c: F.size(F.filter(held, lambda w: w == c)).cast("long"))).alias("bins"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base two, of two arrays of shares: 0 for equal, 1 for disjoint ones."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), operator.add)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS, slack: float = SLACK, carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, the counts of ``BASE``, ``base_failed``, ``char_distance``, ``word_distance``, ``kept``: one row per row of ``docs``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows. ``kept`` is false for those and for documents
    whose histogram of character classes or of common words is farther from its language's than the limits. A histogram with too few
    characters or words is not judged (its distance is null).

    A document's own words and characters are taken out of its reference first, so that it is never compared with itself. Where fewer than ``LEAST_REST_WORDS`` words (``LEAST_REST_CHARS``
    characters) of its language are left, as for the only document of a language, the distance is null as well, and the base decides alone.

    Texts are not shuffled as long as the references, one row a language, are small enough for Spark's own broadcast limit. ``carry`` names further columns that the result keeps. Null text has no words and
    fails the base; a null and an empty language are one language. Null ids, repeated rows and ties are judged row by row. An empty table gives an empty result; further columns are not read.
    """
    references = language_references(docs, text_col=text_col, lang_col=lang_col)
    judged = _with_bins(measured(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, carry=carry), references)
    n_words, n_chars = F.col("doc.n_words").cast("double"), F.col("doc.word_chars").cast("double")
    bins = F.transform("bins", lambda n: n / n_words)
    rest_words = F.col("ref_words") - F.col("doc.n_words")
    rest_chars = F.aggregate("ref_chars", F.lit(0).cast("long"), operator.add) - F.col("doc.word_chars")
    without = lambda counts, own, rest: F.zip_with(counts, own, lambda c, o: (c - o) / rest.cast("double"))
    shares, ref_chars = without("counts", "bins", F.col("rest_words")), without("ref_chars", "doc.chars", F.col("rest_chars"))

    def with_rest(shares: Column) -> Column:
        rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(shares, F.lit(0.0), operator.add))
        return F.concat(shares, F.array(rest))

    judged = judged.withColumns({"rest_words": rest_words, "rest_chars": rest_chars}).select(
        *[F.col(f"doc.{c}").alias(c) for c in ["doc_id", *carry, *BASE]],
        ((F.col("doc.n_words") < 50) | (100 * F.col("doc.n_repeat_words") > 50 * F.col("doc.n_words"))).alias("base_failed"),
        F.when(
            (F.col("doc.word_chars") >= LEAST_CHARS) & (F.col("rest_chars") >= LEAST_REST_CHARS),
            js_distance(F.transform("doc.chars", lambda c: c / n_chars), ref_chars),
        ).alias("char_distance"),
        F.when(
            (F.col("doc.n_words") >= LEAST_WORDS) & (F.size("bins") > 0) & (F.col("rest_words") >= LEAST_REST_WORDS),
            js_distance(with_rest(bins), with_rest(shares)),
        ).alias("word_distance"),
    )
    far = functools.reduce(operator.or_, [
        F.coalesce(F.col("char_distance") > most_chars, F.lit(False)), F.coalesce(F.col("word_distance") > most_words + slack / F.col("n_words"), F.lit(False)),
    ])
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_fitting(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    keyed = with_row_key(docs, id_col, lang_col, text_col)
    judged = quality_rules(keyed, id_col=id_col, text_col=text_col, lang_col=lang_col, carry=("_row_key",), **options)
    rejected = materialise(judged.where("not kept").select("_row_key").distinct(), "rejected")
    return keyed.join(rejected.hint("merge"), "_row_key", "left_anti").drop("_row_key")
