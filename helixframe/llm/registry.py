"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontam, fim, funnels, licenses, lines, mixing, passages, pii, quality, setjoin, sql, suffixes, tokens, toxicity
from helixframe.session import table


def prepare(spark: SparkSession) -> None:
    """Batches that keep a Python worker's memory at some tens of MB whatever the texts' lengths; shuffle files that
    go when the write that needed them ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.quality_measures(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return tokens.tokenize(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffixes.digest(suffixes.drop_repeated_bytes(table(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return licenses.summarize(licenses.find_licenses(table(spark, sf_dir, "documents")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return setjoin.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lines.digest(lines.drop_repeated_lines(table(spark, sf_dir, "documents")))


def op11_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return passages.digest(passages.drop_repeated_passages(table(spark, sf_dir, "documents")))


def op12_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")  # short rows
    return funnels.count_funnels(table(spark, sf_dir, "clicks"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES = (
    op1_pii,
    op2_decontamination,
    op3_quality_rules,
    op4_token_ids,
    op5_suffix_dedup,
    op6_license_scan,
    op7_source_mixing,
    op8_toxicity,
    op9_jaccard_join,
    op10_line_dedup,
    op11_passage_dedup,
    op12_funnels,
    op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": sql.OP2,
        "op3_quality_rules": sql.OP3,
        "op5_suffix_dedup": sql.OP5,
        "op9_jaccard_join": sql.OP9,
        "op10_line_dedup": sql.OP10,
        "op11_passage_dedup": sql.OP11,
        "op12_funnels": sql.OP12,
        "op13_fill_in_middle": sql.OP13,
    }
