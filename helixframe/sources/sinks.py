"""Writers: variant text, FASTQ pairs, reports and sorted tables. Each writes in parallel and commits as Spark does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.genotype import reverse_complement

VCF_HEAD = "##fileformat=VCFv4.2"


def vcf_lines(calls: DataFrame, sample: str = "SAMPLE") -> DataFrame:
    """Lines of a VCF with one diploid sample: columns ``contig, pos, ref, alt, gt, gq, dp``."""
    missing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    value = F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", missing("alt"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:GQ:DP"), F.concat_ws(":", missing("gt"), missing("gq"), missing("dp")))
    return calls.select("contig", "pos", value.alias("value"))


def write_vcf(calls: DataFrame, path: str, contig_rank: DataFrame | None = None, sample: str = "SAMPLE") -> None:
    """Header and records in order of contig rank and position, as text parts that concatenate."""
    spark = calls.sparkSession
    body = vcf_lines(calls, sample)
    if contig_rank is not None:
        body = body.join(F.broadcast(contig_rank), "contig")
    else:
        body = body.withColumn("rank", F.col("contig"))
    ordered = body.orderBy("rank", "pos").select("value")
    head = spark.createDataFrame([(VCF_HEAD,), ("\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample)),)], "value string").coalesce(1)
    head.write.mode("overwrite").text(f"{path}/header")
    ordered.write.mode("overwrite").text(f"{path}/records")


def fastq_pairs(reads: DataFrame) -> DataFrame:
    """(name, first, second): both mates of a name as FASTQ records in their original orientation."""
    rev = F.col("flags").bitwiseAND(F.lit(0x10)) != 0
    seq = F.when(rev, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.coalesce(F.when(rev, F.reverse("quals")).otherwise(F.col("quals")), F.repeat(F.lit("I"), F.length("seq")))
    keep = (F.col("flags").bitwiseAND(F.lit(0x900)) == 0) & F.col("seq").isNotNull() & (F.coalesce("name", F.lit("")) != "")
    r = reads.where(keep).select("name", F.col("flags").bitwiseAND(F.lit(0x80)).alias("second"), F.concat(F.lit("@"), F.col("name"), F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("rec"))
    return r.groupBy("name").agg(F.max(F.when(F.col("second") == 0, F.col("rec"))).alias("first"), F.max(F.when(F.col("second") != 0, F.col("rec"))).alias("second")).where("first is not null and second is not null")


def write_fastq(reads: DataFrame, path: str) -> None:
    """Mates of one name stand at the same place of both outputs: one sort, two projections of it."""
    pairs = fastq_pairs(reads).orderBy("name")
    pairs.select("first").write.mode("overwrite").text(f"{path}/R1")
    pairs.select("second").write.mode("overwrite").text(f"{path}/R2")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def key_values(row: DataFrame) -> DataFrame:
    """A one-row frame as rows of (metric, value)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def html_rows(df: DataFrame) -> DataFrame:
    """Rows as escaped HTML table rows."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return df.select(F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in df.columns), F.lit("</tr>")).alias("value"))


def write_sorted(reads: DataFrame, path: str, contig: str = "contig", pos: str = "pos") -> None:
    """Reads in coordinate order, unplaced ones last, with position statistics in every row group."""
    placed = F.when(F.col(contig).isNull(), 1).otherwise(0)
    reads.withColumn("_u", placed).orderBy("_u", contig, pos).drop("_u").write.mode("overwrite").parquet(path)


def records_json(df: DataFrame) -> DataFrame:
    """Rows as canonical JSON with its hash, for publication."""
    j = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(j.alias("record"), F.sha2(j, 256).alias("sha256"))


def completeness_rank(kind: Column) -> Column:
    """How complete an artifact is; a more complete one is never overwritten by a lesser."""
    return F.when(kind == "full", 2).when(kind == "lite", 1).otherwise(0)
