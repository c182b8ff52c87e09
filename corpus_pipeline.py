"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, source mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Each
result is written as Parquet and read again as the next stage's input. Rows with a null doc_id are kept by the stages
that name documents by it; extra columns of any name pass through; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontam, mixing, quality, setjoin, tokens
from helixframe.llm.registry import prepare
from helixframe.session import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    prepare(spark)
    return quality.quality_filter(docs)


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't in ``bad``."""
    return docs.join(bad.select(F.col("doc_id")), "doc_id", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingle similarity of 0.8 or more links: the smallest doc_id.

    Of rows that repeat both doc_id and text one stays.
    """
    prepare(spark)
    classes = setjoin.jaccard_classes(docs, size=5, percent=80)
    kept = _without(docs, classes.where(F.col("component_id") != F.col("doc_id")).distinct())
    repeated = classes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.limit(1).count() == 0:
        return kept
    twice = kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return _without(kept, repeated).unionByName(twice)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    prepare(spark)
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice."""
    prepare(spark)
    return mixing.mix_documents(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold by document."""
    prepare(spark)
    return tokens.tokenize(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", to_token_ids),
]

#: Tokenization and connected components have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = materialize(docs, "stage-" + name.split()[0].lower())
    return docs
