"""The corpus pipeline: documents in, packed token sequences out.

Every stage works on all that the one before kept. The last one returns pieces of packed sequences; all others return documents.

All stages take any further columns along and give the same verdict to rows equal in id and text. A null text counts as empty; an empty table gives an empty one; texts may be of any
length. What that means for each stage is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import line_dedup as lines
from gridloom.llm import packing, quality_rules, simhash, site_quality
from gridloom.llm.queries import table, tokenizer_file
from gridloom.session import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, fitted on the labels of this input. Null and empty texts have no evidence of their own and follow their host and path; without labels nothing is rejected."""
    return site_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counted limits and resemble their language. Null, empty and very short texts fail the limits; a null language is the empty one."""
    return quality_rules.keep_fitting(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages of 50 words or more; those with nothing left go, ``n_chars`` follows the text. Null texts stay null; the first copy is that of the smallest id, nulls last."""
    deduped = lines.line_dedup(docs, least_words=50)
    left = deduped.where("n_removed = 0 or n_removed < n_lines").withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 4-word shingles, at most 4 of 64 bits apart. Texts without a word are copies of each other; the smallest id stays."""
    return simhash.keep_first_of_group(docs, shingle=4, most_bits=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids. A null or empty text is its end mark alone."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), length=4096, end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("packing", pack),
]

#: Statistics, fingerprints and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
