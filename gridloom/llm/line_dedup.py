"""Line dedup: repeated runs of lines lose their later copies.

The lines of all documents are one sequence of line ids with a break after each document. Suffixes of it are ranked by distributed prefix
doubling: level k ranks them by their first 2^k lines, from pairs of ranks of the level below, so equal ranks are equal runs. Suffixes that share
their first m lines are an interval of the suffix array with a common prefix of at least m; any such interval is named by two overlapping
level-k ranks with 2^k <= m < 2^(k+1).

A run counts from ``least_words`` words on. It is enough to look at windows that reach that many words with as few lines as possible, counted from either end:
the windows from the left inside a maximal repeated run cover all of it but its last lines, and the last one from the right covers those. Such a
window is fixed by its content alone, so each of its interval's suffixes has it too, and the first of them keeps it. A window has at most
``least_words`` lines, as blank lines are left out, so the number of levels does not depend on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import key128, let, only, text_or_empty, words_of
from gridloom.operators.ordinal import with_ordinal
from gridloom.session import materialise

#: Words from which on a repeated run is a passage.
LEAST_WORDS = 50


def _spoken(text: Column) -> Column:
    """Lines with a word, and their places among all lines."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    return F.filter(lines, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))


def line_sequence(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``row, row_key, doc_id, idx, hash, words``: every line with a word, hashed, written once. Rows equal in id and text are one document."""
    rows = only(docs, doc_id=id_col, text=text_col)
    # numbered in a step of its own: beside a generator the number would be one of its rows
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), key128(F.col("doc_id"), F.col("text")).alias("row_key"), "doc_id", "text"
    ).select("row", "row_key", "doc_id", F.posexplode(_spoken(text_or_empty("text"))).alias("idx", "x"))
    lines = materialise(
        rows.select(
            "row", "row_key", "doc_id", "idx", F.unhex(F.md5("x.line")).alias("hash"), F.size(words_of(F.col("x.line"))).alias("words")
        ),
        "lines",
    )
    twice = materialise(
        lines.groupBy("row_key").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last"), "twice"
    )
    if twice.isEmpty():
        return lines
    return lines.join(twice, "row_key", "left").where("first is null or row = first").drop("first", "last")


def suffix_ranks(repeated: DataFrame, levels: int) -> DataFrame:
    """Add ``r1`` .. to rows with ``row, idx, r0``: the rank of each suffix by its first 2^k lines, null where no other suffix shares them."""
    ranked = repeated
    for k in range(levels):
        near, step = f"r{k}", 1 << k
        ahead = Window.partitionBy("row").orderBy("idx").rangeBetween(step, step)
        pairs = ranked.withColumn("next", F.when(F.col(near).isNotNull(), F.max(near).over(ahead)))
        shared = pairs.where("next is not null").groupBy(F.col(near).alias("a"), F.col("next").alias("b")).agg(F.count("*").alias("n"))
        names = with_ordinal(shared.where("n > 1").select("a", "b"), "a", "b", name=f"r{k + 1}")
        names = materialise(names, "ranks")
        ranked = materialise(
            pairs.join(names, (F.col(near) == F.col("a")) & (F.col("next") == F.col("b")), "left").drop("a", "b", "next"), "suffixes"
        )
    return ranked


def _windows(ranked: DataFrame, levels: int, least_words: int, from_left: bool) -> DataFrame:
    """``row, doc_id, row_key, start, lines, a, b``: for each line the shortest run from it (or up to it) that holds enough words."""
    run = Window.partitionBy("row", "run").orderBy("idx")
    frame = run.rowsBetween(0, least_words - 1) if from_left else run.rowsBetween(1 - least_words, 0)
    ranks = [f"r{k}" for k in range(levels + 1)]
    near = ranked.select(
        "row", "doc_id", "row_key", "idx", F.collect_list(F.struct("words", *ranks)).over(frame).alias("near")
    )
    sums = F.aggregate(
        F.col("near") if from_left else F.reverse("near"), F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")),
        lambda at, x: F.when(at["words"] >= least_words, at).otherwise(
            F.struct((at["words"] + x["words"]).alias("words"), (at["lines"] + 1).alias("lines"))
        ),
    )
    reached = near.withColumn("sums", sums).where(F.col("sums.words") >= least_words).withColumn("lines", F.col("sums.lines"))
    first = F.lit(0) if from_left else F.size("near") - F.col("lines")

    def rank(at: Column, k: int) -> Column:
        return F.get(F.col("near"), at)[f"r{k}"]

    a = b = F.lit(None).cast("long")
    for k in range(levels + 1):
        fits = (F.col("lines") >= 1 << k) & (F.col("lines") < 2 << k)
        a = F.when(fits, rank(first, k)).otherwise(a)
        b = F.when(fits, rank(first + F.col("lines") - (1 << k), k)).otherwise(b)
    start = F.col("idx") if from_left else F.col("idx") - F.col("lines") + 1
    return reached.select("row", "doc_id", "row_key", start.alias("start"), "lines", a.alias("a"), b.alias("b")).where(
        "a is not null and b is not null"
    )


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``row_key, drop``: per document the places, among its lines with a word, of those that lie in a later copy of a run."""
    lines = line_sequence(docs, id_col=id_col, text_col=text_col)
    hashes = lines.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    ids = materialise(with_ordinal(hashes, "hash", name="r0"), "line-ids")
    repeated = materialise(lines.join(ids, "hash").drop("hash"), "repeated")
    levels = max(least_words, 1).bit_length() - 1
    ranked = suffix_ranks(repeated, levels)
    in_row = Window.partitionBy("row").orderBy("idx")
    ranked = ranked.withColumn("run", F.col("idx") - F.row_number().over(in_row))
    windows = _windows(ranked, levels, least_words, True).unionByName(_windows(ranked, levels, least_words, False))
    windows = materialise(windows.distinct(), "windows")
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_key", "start")
    first = materialise(
        windows.groupBy("lines", "a", "b").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n"), "firsts"
    )
    later = windows.join(first, ["lines", "a", "b"]).where(
        ~((F.col("first.row_key") == F.col("row_key")) & (F.col("first.start") == F.col("start")))
    )
    gone = later.select("row_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)).alias("idx"))
    return materialise(gone.groupBy("row_key").agg(F.sort_array(F.collect_set("idx")).alias("drop")), "gone")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with all its columns, the text column without later copies, and ``n_lines, n_removed`` (lines with a word before, and taken out).

    A line goes if it lies in a run of lines that stands earlier as well, in the order of id and place, and that has ``least_words`` words or more. Runs may overlap and lie
    in one document. Blank lines belong to no run and stay; lines are compared by a 128-bit hash. So whatever is removed can still be read in an earlier document, or
    earlier in this one.

    Only lines that occur twice are ranked, and rank tables are joined with sides that may be split, so a line or a run that fills much of the input is spread out.
    Windows look at one document's neighbouring lines. Only functions of Spark are used.

    A null text stays null and has no lines. Rows equal in id and text are one document and get the same text; null ids come last in the order.
    An empty table gives an empty result. Columns of the names ``n_lines`` and ``n_removed`` are replaced, all others are kept.
    """
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, least_words=least_words)
    text = F.col(f"`{text_col}`")
    keyed = docs.drop("n_lines", "n_removed").withColumn("_row_key", key128(F.col(f"`{id_col}`"), text))
    # the list of removals grows with the input, so it is not broadcast at any size
    drops = gone.select(F.col("row_key").alias("_row_key"), F.col("drop").alias("_drop")).hint("merge")
    joined = keyed.join(drops, "_row_key", "left")
    places = F.transform(_spoken(F.coalesce(text, F.lit(""))), lambda x: x["pos"])
    left = let(F.col("_places"), lambda at: F.transform("_drop", lambda i: F.get(at, i)))
    rest = let(F.split(text, "\n"), lambda lines: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), left), lambda p: F.get(lines, p)), "\n"
    ))
    return (
        joined.withColumn("_places", places)
        .withColumn("n_lines", F.size("_places")).withColumn("n_removed", F.coalesce(F.size("_drop"), F.lit(0)))
        .withColumn(text_col, F.when(F.col("_drop").isNotNull(), rest).otherwise(text))
        .drop("_row_key", "_drop", "_places")
    )
