"""Quality classifier: evidence from the text, combined with what its host and path are like.

The text gives a log likelihood ratio (naive Bayes over binned measures). A site's share of good documents is a
beta-binomial posterior in three levels: the whole input, the host, the path below it. How strongly a level is drawn to the one above is
estimated from how much the sites of that level differ, so a sparse site says little and a large one speaks for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.quality_rules import with_char_classes
from gridloom.llm.text import key128, only, text_or_empty, words_of
from gridloom.session import materialise

#: Measures of a text, each a share from 0 to 1, or per word; see ``_measures``.
MEASURES = ["upper", "symbols", "points", "digits", "variety", "stutter", "length", "size"]
#: Bins of a measure: shares are binned on a logarithmic scale with this many steps per factor of two.
BINS, STEPS = 24, 2
#: Evidence beyond this (log odds) counts as this, as the measures are not independent.
MOST_EVIDENCE = 12.0
#: A text's evidence is weighed by n / (n + this) for its n words, as shares of few words say little.
HALF_WORDS = 20
#: Documents with a lower probability of being good are rejected.
LEAST_PROBABILITY = 0.25
#: Bounds of the strength with which a site is drawn to the level above, in documents.
LEAST_PULL, MOST_PULL = 2.0, 10_000.0


def _measures() -> dict[str, Column]:
    chars, words = F.greatest(F.col("_had0"), F.lit(1)).cast("double"), F.greatest(F.size("words"), F.lit(1)).cast("double")
    return {
        "upper": F.col("chars")[1] / chars,
        "symbols": F.col("chars")[5] / chars,
        "points": F.col("chars")[4] / chars,
        "digits": F.col("chars")[2] / chars,
        "variety": F.size(F.array_distinct("words")) / words,
        "stutter": F.size(F.filter("words", lambda w, i: w == F.get(F.col("words"), i - 1))) / words,
        "length": F.least(chars / words / 64, F.lit(1.0)),
        "size": F.least(words / 4096, F.lit(1.0)),
    }


def _bin(share: Column) -> Column:
    """0 for the largest shares, one more for every half power of two below, the last bin for what is smaller still and for zero."""
    return F.when(share > 0, F.least(F.lit(BINS - 1), F.floor(-F.log2(share) * STEPS))).otherwise(F.lit(BINS - 1)).cast("int")


def measured(docs: DataFrame, *, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """``row_key, doc_id, host, path, n_words, bins``: the narrow table that training and scoring share, written once."""
    rows = only(docs, doc_id=id_col, text=text_col, host=host_col, path=path_col).select(
        key128(F.col("doc_id"), F.col("host"), F.col("path"), F.col("text")).alias("row_key"), "doc_id",
        F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        text_or_empty("text").alias("text"),
    )
    rows = with_char_classes(rows.withColumn("words", words_of(F.col("text"))), "text")
    shares = _measures()
    return materialise(
        rows.select("row_key", "doc_id", "host", "path", F.size("words").alias("n_words"), F.array(*[_bin(shares[m]) for m in MEASURES]).alias("bins")), "measures"
    )


def fit_evidence(rows: DataFrame) -> list[list[float]]:
    """Log likelihood ratio of each bin of each measure, from the ``good`` shares of all labelled ``rows``.

    What reaches the driver is two numbers for each of the fixed bins.
    """
    labelled = rows.where("good is not null")
    counted = labelled.select("good", F.posexplode("bins").alias("measure", "bin")).groupBy("measure", "bin").agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")
    )
    good = [[0.0] * BINS for _ in MEASURES]
    bad = [[0.0] * BINS for _ in MEASURES]
    for m, b, g, n in counted.collect():
        good[m][b], bad[m][b] = float(g), float(n)

    def smooth(counts: list[float]) -> list[float]:
        # neighbours lend a quarter of their weight, and every bin has half a document
        wide = [c + 0.25 * (counts[max(0, i - 1)] + counts[min(BINS - 1, i + 1)]) + 0.5 for i, c in enumerate(counts)]
        return [w / sum(wide) for w in wide]

    return [[math.log(g / b) for g, b in zip(smooth(gs), smooth(bs))] for gs, bs in zip(good, bad)]


def _evidence(table: list[list[float]]) -> Column:
    terms = [F.element_at(F.array(*[F.lit(x) for x in row]), F.col("bins")[k] + 1) for k, row in enumerate(table)]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    weight = F.col("n_words") / (F.col("n_words") + HALF_WORDS)
    return weight * F.greatest(F.lit(-MOST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), total))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _pull(mean: Column) -> Column:
    """Prior strength by moments: the variance between sites beyond what counting explains, as a beta prior's size.

    An aggregate over sites; ``n``, ``good`` are a site's documents and good ones, ``mean`` the level above.
    """
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)) / F.sum("n")
    noise = F.sum(mean * (1 - mean)) / F.sum("n")
    within = F.sum(F.col("n") * mean * (1 - mean)) / F.sum("n")
    strength = within / F.greatest(spread - noise, F.lit(1e-12)) - 1
    return F.greatest(F.lit(LEAST_PULL), F.least(F.lit(MOST_PULL), strength))


def site_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality", least_probability: float = LEAST_PROBABILITY,
) -> DataFrame:
    """``row_key, doc_id, host, path, evidence, host_share, path_share, probability, kept``: one row per row of ``docs``.

    ``labels`` says of some ids whether they are good (1) or not (0); several labels of an id are averaged. All labelled rows fit the evidence. A row's soft label is
    its label, or else the probability that its text has under the global share. Soft labels are summed per path and per host (combined in each task before the shuffle, so a host with
    a third of all rows is one partial row per task); a row's own soft label is left out of the sites it is judged by. ``host_share`` and ``path_share`` are the
    posterior means, ``probability`` joins the path's odds with the text's evidence.

    Null text counts as empty; a null host or path is one site. Null ids have no label; repeated rows are judged alike. Without labels of both kinds there is no
    evidence and everything is kept. An empty table gives an empty result; further columns are not read.
    """
    rows = measured(docs, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col)
    known = materialise(
        only(labels, doc_id=label_id, good=label_col).where("doc_id is not null and good is not null")
        .groupBy("doc_id").agg(F.avg(F.col("good").cast("double")).alias("good")), "labels",
    )
    labelled = materialise(rows.join(known, "doc_id", "left"), "labelled")
    prior, rest = labelled.agg(F.sum("good"), F.sum(1 - F.col("good"))).first()
    if not prior or not rest:
        none = F.lit(None).cast("double")
        return rows.select(
            "row_key", "doc_id", "host", "path", F.lit(0.0).alias("evidence"), none.alias("host_share"), none.alias("path_share"),
            F.lit(1.0).alias("probability"), F.lit(True).alias("kept"),
        )
    share = prior / (prior + rest)
    odds = math.log(share / (1 - share))
    judged = labelled.withColumn("evidence", _evidence(fit_evidence(labelled)))
    soft = judged.withColumn("soft", F.coalesce("good", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(odds))))))
    paths = materialise(soft.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("soft").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = total["good"] / total["n"]
    host_pull = hosts.agg(_pull(F.lit(mean))).first()[0]
    sites = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host").withColumn(
        "host_mean", (F.col("host_good") + host_pull * mean) / (F.col("host_n") + host_pull)
    )
    sites = materialise(sites.withColumn("path_good", F.col("good")), "sites")
    path_pull = sites.agg(_pull(F.col("host_mean"))).first()[0]
    placed = soft.drop("good").join(sites.drop("good"), ["host", "path"])
    host_share = (F.col("host_good") - F.col("soft") + host_pull * mean) / (F.col("host_n") - 1 + host_pull)
    placed = placed.withColumn("host_share", host_share)
    placed = placed.withColumn(
        "path_share",
        F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), (F.col("path_good") - F.col("soft") + path_pull * F.col("host_share")) / (F.col("n") - 1 + path_pull))),
    )
    return placed.select(
        "row_key", "doc_id", "host", "path", "evidence", "host_share", "path_share",
        (1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_share")))))).alias("probability"),
    ).withColumn("kept", F.col("probability") >= least_probability)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns unchanged."""
    judged = site_quality(docs, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col, **options)
    rejected = materialise(judged.where("not kept").select(F.col("row_key").alias("_row_key")).distinct(), "rejected")
    keyed = docs.withColumn("_row_key", key128(F.col(f"`{id_col}`"), F.col(f"`{host_col}`"), F.col(f"`{path_col}`"), F.col(f"`{text_col}`")))
    return keyed.join(rejected.hint("merge"), "_row_key", "left_anti").drop("_row_key")
