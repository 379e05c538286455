"""A corpus pipeline of five stages, from ``documents`` to packed batches.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return the columns of ``documents``.

Defined results: a document with a null or empty text, or of fewer than 50 words, is rejected by the
quality rules; a null id or source is kept like any other (a null id is near to nothing, lines of a
null source stay); very long texts pass through whole; repeated rows share their decision; an empty
table gives empty stages; columns that ``documents`` doesn't have are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import line_crf, line_dedup, minhash, packing, quality_rules
from gridloom.llm.common import forget, materialize, read, words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose lines are good rather than bad, by a model learnt from part of ``labels``."""
    scored = line_crf.line_quality(docs, read(spark, sf_dir, "labels"))
    return scored.where("score >= 0.5").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that break no quality rule of policy v2."""
    return quality_rules.quality_rules(docs, "v2").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand in five or more of a source's documents and in over 2 % of them; n_chars follows the text.

    A source is many sites, so a site's boilerplate is a small share of it: in sf0.1 the common line
    stands in about a tenth of each source. Prose hardly repeats whole lines in five documents.
    """
    done = line_dedup.line_dedup(docs, "source", ratio=0.02, min_pages=5, min_count=5)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles link at a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each document, whole, in a batch of its length bucket."""
    counted = docs.withColumn("n_tokens", F.size(words(F.col("text"))).cast("long"))
    return packing.pack(materialize(counted), "n_tokens", "doc_id")


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("packing", packing_stage),
]
#: SQL cannot express the trained classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if last is not None:
            forget(last)  # a stage's table goes once the next one stands
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
