"""Source, sink, repeat and streaming queries on the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import structural as sv
from helixframe.plans.catalog import Tables, query, rounded
from helixframe.session import scratch_path
from helixframe.sources import files, sinks, tables, variants
from helixframe.streaming import events as st


#: Names and heads of files with what they are, dealt over the pages.
_FILES = (
    ("reads.BAM", "", "alignment"),
    ("y.g.vcf.gz", "##contig=<ID=chrY,length=9>", "variants"),
    ("a.g.vcf.gz", "##contig=<ID=chr1,length=9>", "gvcf_call_set"),
    ("a.vcf", "\t".join(("1", "5", ".", "A", "G", ".", ".", ".", "GT:DP", "0/0:9")), "gvcf_call_set"),
    ("b.vcf", "\t".join(("1", "5", ".", "A", "G", ".", ".", ".", "GT:DP", "0/1:9")), "variants"),
    ("kit.csv", "DYS393,13\nDYS390,24\nDYS19,14", "str_profile"),
    ("kit.txt", "DYS393 thirteen", "unknown"),
    ("my_str.txt", "one,two", "str_profile"),
    ("dump.txt", "# 23andMe raw\nrs4477212\t1\t82154\tAA", "chip_data"),
    ("dump.txt", "rsid,note\n", "unknown"),
    ("big.csv", '"SNP_Name","Position","On_Haplotree","Ancestral","Derived"', "ftdna_csv_variants"),
    ("big.csv", "Position,Ancestral,Derived\n5,A,G", "ftdna_csv_variants"),
    ("cg.tsv", ">locus\tploidy\tallele\tchromosome\tbegin\tend\tvarType\treference\talleleSeq", "master_var"),
    ("bisdna.txt", "about\nSNPID\tgenotype\tresult", "ysnp_panel"),
    ("mt.fa", ">chrM", "mtdna_fasta"),
    ("notes.html", "", "unknown"),
)


@query("SELECT page_id, CASE page_id % 16 " + " ".join(f"WHEN {k} THEN '{f[2]}'" for k, f in enumerate(_FILES)) + " END AS kind FROM pages")
def file_type_detect(t: Tables) -> DataFrame:
    dealt = t.spark.createDataFrame([(k, n, h) for k, (n, h, _) in enumerate(_FILES)], "k long, name string, head string")
    j = t.pages.join(F.broadcast(dealt), F.col("page_id") % len(_FILES) == F.col("k"))
    return j.select("page_id", files.file_type(F.col("name"), F.col("head")).alias("kind"))


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in files.HEALTH_TERMS) + " AS health FROM documents")
def health_mentions(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", files.health_topic(F.col("text")).alias("health"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'FTDNA Big Y' WHEN doc_id % 6 = 1 THEN 'YSEQ' WHEN doc_id % 6 = 2 THEN 'Nebula Genomics' WHEN doc_id % 6 = 3 THEN 'FTDNA mtFull Sequence' ELSE 'Imported VCF' END AS vendor,
 CASE WHEN doc_id % 6 IN (0, 1, 3) THEN 'TargetedNgs' WHEN doc_id % 6 = 2 THEN 'WgsShortRead' ELSE 'Imported' END AS source_type FROM documents"""
)
def vendor_classify(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 6
    meta = F.when(k == 0, "##source=aengine").when(k == 1, "##YSEQ export").when(k == 2, "##nebula").otherwise("##fileformat=VCFv4.2")
    v = files.vendor(meta, F.when(k == 3, F.array(F.lit("chrM"))).otherwise(F.array(F.lit("chrY"), F.lit("chr1"))), F.lit("calls.vcf"), F.lit(None).cast("string"))
    return t.documents.select("doc_id", v.alias("vendor")).withColumn("source_type", files.source_type(F.col("vendor")))


def _vcf_lines(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    gt = F.when(p % 3 == 0, "0/1").when(p % 3 == 1, "1/1").otherwise("0/0")
    return t.part.select(F.concat_ws("\t", F.concat(F.lit("chr"), (p % 5 + 1).cast("string")), (p * 10).cast("string"), F.lit("."), F.lit("A"), F.lit("G"), F.lit("50"), F.lit("PASS"), F.when(p % 3 == 2, F.concat(F.lit("END="), (p * 10 + 5).cast("string"))).otherwise("."), F.lit("GT:AD:DP:GQ"), F.concat_ws(":", gt, F.concat_ws(",", (p % 7).cast("string"), (p % 11).cast("string")), (p % 7 + p % 11).cast("string"), F.lit("40"))).alias("value"))


@query("SELECT CAST(p_partkey % 5 + 1 AS VARCHAR) AS contig, p_partkey * 10 AS pos, CASE WHEN p_partkey % 3 = 2 THEN p_partkey * 10 + 5 ELSE p_partkey * 10 END AS \"end\", CAST(p_partkey % 7 + p_partkey % 11 AS INTEGER) AS dp, CASE WHEN p_partkey % 7 + p_partkey % 11 > 0 THEN floor((p_partkey % 11) / (p_partkey % 7 + p_partkey % 11) * 10000 + 0.5) / 10000 END AS af FROM part")
def vcf_site_evidence(t: Tables) -> DataFrame:
    return variants.site_evidence(variants.vcf_records(_vcf_lines(t))).select("contig", "pos", "end", "dp", rounded(F.col("af")).alias("af"))


@query(
    """WITH tg AS (SELECT CAST(p_partkey % 5 + 1 AS VARCHAR) AS contig, p_partkey * 10 + p_size % 8 AS pos, 'C' AS ref FROM part), b AS (SELECT CAST(p_partkey % 5 + 1 AS VARCHAR) AS contig, p_partkey * 10 AS lo, p_partkey * 10 + 5 AS hi FROM part WHERE p_partkey % 3 = 2), v AS (SELECT CAST(p_partkey % 5 + 1 AS VARCHAR) AS contig, p_partkey * 10 AS pos FROM part WHERE p_partkey % 3 = 1)
SELECT DISTINCT contig, pos, 'G' AS base FROM tg SEMI JOIN v USING (contig, pos) UNION SELECT DISTINCT contig, pos, 'C' FROM tg WHERE EXISTS (SELECT 1 FROM b WHERE b.contig = tg.contig AND tg.pos BETWEEN lo AND hi)"""
)
def gvcf_target_bases(t: Tables) -> DataFrame:
    tg = t.part.select((F.col("p_partkey") % 5 + 1).cast("string").alias("contig"), (F.col("p_partkey") * 10 + F.col("p_size") % 8).alias("pos"), F.lit("C").alias("ref")).distinct()
    return variants.haploid_bases(variants.vcf_records(_vcf_lines(t)), tg, 64)


@query("SELECT CAST(p_partkey % 5 + 1 AS VARCHAR) AS contig, p_partkey * 10 AS pos, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'G' END AS a1, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'G' END AS a2, p_partkey % 3 = 2 AS hom_ref FROM part")
def gvcf_diploid_calls(t: Tables) -> DataFrame:
    return variants.diploid_calls(variants.vcf_records(_vcf_lines(t))).drop("end")


@query("SELECT CAST(p_partkey % 5 + 1 AS VARCHAR) AS contig, p_partkey * 10 AS pos, 'A' AS ref, 'G' AS alt FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 7 + p_partkey % 11 >= 4 AND (p_partkey % 11) / (p_partkey % 7 + p_partkey % 11) >= 0.6")
def gvcf_derived_snvs(t: Tables) -> DataFrame:
    return variants.derived_snvs(variants.vcf_records(_vcf_lines(t)), min_af=0.6).select("contig", "pos", "ref", "alt")


@query("SELECT 't' || CAST(p_partkey % 5 AS VARCHAR) AS contig, CASE WHEN p_partkey % 2 = 0 THEN 1000000 + p_partkey ELSE 3000000 - p_partkey END AS pos, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'T' END AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'G' ELSE 'C' END AS alt FROM part")
def chain_lift(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    pts = t.part.select(F.concat((p % 5).cast("string"), F.when(p % 2 == 0, "p").otherwise("m")).alias("contig"), p.alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    # Blocks reach as far as the positions do: one row of the greatest.
    names = [(f"{k}{s}", f"t{k}", "+" if s == "p" else "-") for k in range(5) for s in "pm"]
    last = t.part.agg(F.coalesce(F.max(p), F.lit(0)).alias("end"))
    blocks = t.spark.createDataFrame(names, "contig string, t_contig string, strand string").crossJoin(F.broadcast(last))
    t_start = F.when(F.col("strand") == "+", 1_000_000).otherwise(3_000_000 - F.col("end"))
    return variants.lift(pts, blocks.select("contig", F.lit(0).cast("long").alias("start"), "end", "t_contig", t_start.alias("t_start"), "strand"))


@query("SELECT 'rs' || p_partkey AS rsid, CAST(p_partkey % 22 + 1 AS VARCHAR) AS contig, p_partkey * 100 AS pos, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'G' END AS a1, 'T' AS a2 FROM part WHERE p_partkey % 4 <> 3")
def chip_autosomal(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    gt = F.when(p % 4 == 0, "AT").when(p % 4 == 1, "CT").when(p % 4 == 2, "GT").otherwise("--")
    lines = t.part.select(F.concat_ws("\t", F.concat(F.lit("rs"), p.cast("string")), (p % 22 + 1).cast("string"), (p * 100).cast("string"), gt).alias("value"))
    return tables.chip_autosomal(tables.chip_rows(lines))


@query("SELECT 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) AS contig, p_partkey * 10 AS pos, 'chr' || CAST(p_partkey % 5 + 1 AS VARCHAR) || chr(9) || (p_partkey * 10) || chr(9) || '.' || chr(9) || 'A' || chr(9) || 'G' || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT:GQ:DP' || chr(9) || '0/1:' || p_size || ':.' AS value FROM part")
def vcf_write_lines(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    calls = t.part.select(F.concat(F.lit("chr"), (p % 5 + 1).cast("string")).alias("contig"), (p * 10).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.lit("0/1").alias("gt"), F.col("p_size").alias("gq"), F.lit(None).cast("int").alias("dp"))
    return sinks.vcf_lines(calls)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def csv_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    sinks.write_tsv(t.customer.where("c_acctbal > 0").select("c_custkey", "c_mktsegment"), path)
    return t.spark.read.schema("c_custkey long, c_mktsegment string").option("header", True).option("sep", "\t").csv(path)


@query(
    """WITH o AS (SELECT l_suppkey % 50 AS locus, CAST(10 + l_quantity AS INTEGER) % 6 + 8 AS o FROM lineitem), n AS (SELECT locus, o, count(*) AS n FROM o GROUP BY 1, 2),
s AS (SELECT a.locus, a.o AS allele, sum(n.n * CASE WHEN n.o = a.o THEN ln(0.9) ELSE ln(greatest((1 - 0.9) * 0.5 * (1 - 0.5) * pow(0.5, abs(n.o - a.o) - 1), 1e-12)) END) AS ll, sum(n.n) AS depth FROM n a JOIN n ON a.locus = n.locus GROUP BY 1, 2 HAVING sum(n.n) >= 5)
SELECT locus, allele, CAST(depth AS BIGINT) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY floor(ll * 1e6 + 0.5) DESC, allele DESC) AS r FROM s) WHERE r = 1"""
)
def str_haploid_call(t: Tables) -> DataFrame:
    o = t.lineitem.select((F.col("l_suppkey") % 50).alias("locus"), ((10 + F.col("l_quantity")).cast("int") % 6 + 8).alias("o"))
    return sv.str_haploid(o, ["locus"], "o")


@query(
    """WITH o AS (SELECT l_suppkey % 50 AS locus, CAST(10 + l_quantity AS INTEGER) % 6 + 8 AS o FROM lineitem), n AS (SELECT locus, o, count(*) AS n FROM o GROUP BY 1, 2), p AS (SELECT a.locus, a.o AS a, b.o AS b FROM n a JOIN n b ON a.locus = b.locus AND a.o <= b.o),
l AS (SELECT p.*, n.n, exp(CASE WHEN o = a THEN ln(0.9) ELSE ln(greatest((1 - 0.9) * 0.5 * (1 - 0.5) * pow(0.5, abs(o - a) - 1), 1e-12)) END) AS pa, exp(CASE WHEN o = b THEN ln(0.9) ELSE ln(greatest((1 - 0.9) * 0.5 * (1 - 0.5) * pow(0.5, abs(o - b) - 1), 1e-12)) END) AS pb FROM p JOIN n USING (locus)),
s AS (SELECT locus, a, b, sum(n * ln(greatest(0.5 * pa + 0.5 * pb, 1e-12))) AS ll, sum(n) AS depth FROM l GROUP BY 1, 2, 3 HAVING sum(n) >= 5)
SELECT locus, a, b, CAST(depth AS BIGINT) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY floor(ll * 1e6 + 0.5) DESC, a, b) AS r FROM s) WHERE r = 1"""
)
def str_diploid_call(t: Tables) -> DataFrame:
    o = t.lineitem.select((F.col("l_suppkey") % 50).alias("locus"), ((10 + F.col("l_quantity")).cast("int") % 6 + 8).alias("o"))
    return sv.str_diploid(o, ["locus"], "o")


@query()
def overlap_greedy(t: Tables) -> DataFrame:
    x = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("contig"), F.col("o_orderpriority").alias("kind"), F.floor(F.col("o_totalprice") / 10).alias("start")).withColumn("end", F.col("start") + 20)
    return sv.merge_evidence(x.where("id % 2 = 0"), x.where("id % 2 = 1"), 128)


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY 1, 2")
def stream_window(t: Tables) -> DataFrame:
    s = st.tumbling(st.event_stream(t.spark, f"{t.sf_dir}/events.parquet"), "1 day", "365 days")
    out = st.drain(t.spark, s, "complete", "stream-window")
    return out.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", rounded(F.col("total"), 2).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_session(t: Tables) -> DataFrame:
    s = st.sessions(st.event_stream(t.spark, f"{t.sf_dir}/events.parquet"), "6 hours", "365 days")
    out = st.drain(t.spark, s, "complete", "stream-session")
    return out.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")


@query("SELECT count(DISTINCT (user_id, event_type)) AS kept FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    s = st.first_seen(st.event_stream(t.spark, f"{t.sf_dir}/events.parquet"), ["user_id", "event_type"], "3650 days")
    return st.drain(t.spark, s, "append", "stream-dedup").agg(F.count("*").alias("kept"))


@query("SELECT event_id, value > 20 AS ok, CASE WHEN value > 20 THEN NULL ELSE 120 END AS retry_after FROM events WHERE event_type = 'purchase'")
def stream_outbox(t: Tables) -> DataFrame:
    """One round of an outbox: what isn't delivered waits as long as its backoff says."""
    s = st.event_stream(t.spark, f"{t.sf_dir}/events.parquet").where("event_type = 'purchase'").select("event_id", "value")
    rows = st.drain(t.spark, s, "append", "outbox").select("*", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("due"))
    sent = st.outbox_round(rows, F.when(F.col("value") > 20, "ok").otherwise("transient"), 0, "event_id")
    return sent.select("event_id", (F.col("status") == "SENT").alias("ok"), F.when(F.col("status") == "PENDING", F.col("due").cast("int")).alias("retry_after"))
