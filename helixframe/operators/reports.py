"""Reports over projects, subjects and runs, and the rules by which the store is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.scan import numbered


def first_fresh(artifacts: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(subject, one struct a kind): payload and alignment of the first alignment with a current artifact of the kind.

    ``artifacts``: subject, alignment, kind, version, completeness, payload; ``wanted``: current version by kind.
    """
    row = F.struct("alignment", "payload", "completeness")
    pick = [F.min_by(row, F.when((F.col("kind") == k) & (F.col("version") == v), F.col("alignment"))).alias(k) for k, v in wanted.items()]
    return artifacts.groupBy("subject").agg(*pick)


def project_report(members: DataFrame, alignments: DataFrame, artifacts: DataFrame, terminals: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """One row a member: alignments, the primary one (with coverage, else the first), fresh results and terminals."""
    n = alignments.groupBy("subject").agg(F.count("*").alias("alignments"), F.min("alignment").alias("_first"))
    out = members.join(n, "subject", "left").join(first_fresh(artifacts, wanted), "subject", "left").join(terminals, "subject", "left")
    first = next(iter(wanted))
    return out.withColumn("primary_alignment", F.coalesce(F.col(f"{first}.alignment"), F.col("_first"))).withColumn("partial", F.coalesce(F.col(f"{first}.completeness") == "partial", F.lit(False))).withColumn("alignments", F.coalesce("alignments", F.lit(0))).drop("_first")


def subject_terminals(reconciled: DataFrame, labels: DataFrame, overrides: DataFrame, external: DataFrame, prefer_external: bool) -> DataFrame:
    """(subject, dna, terminal): a manual override, else the placed label, else the reconciled calls.

    With ``prefer_external`` a subject that has an external call keeps its reconciled one instead of the label.
    """
    key = ["subject", "dna"]
    placed = labels.select(*key, F.col("label").alias("_l"))
    if prefer_external:
        placed = placed.join(external.select(*key).distinct(), key, "left_anti")
    j = reconciled.select(*key, F.col("haplogroup").alias("_r")).join(placed, key, "full_outer").join(overrides.select(*key, F.col("haplogroup").alias("_o")), key, "full_outer")
    return j.select(*key, F.coalesce("_o", "_l", "_r").alias("terminal"))


def ranked_matches(queries: DataFrame, profiles: DataFrame, snps: DataFrame, markers: DataFrame, most: int = 200) -> DataFrame:
    """(query, subject, shared, distance, compared, divergence, signal, place): related subjects of each query.

    ``profiles``: subject, name, lineage; ``snps``: subject, snp; ``markers``: subject, marker, value. Only subjects
    that share a SNP or a marker meet; the first ``most`` are the report. Years follow from private SNPs and markers.
    """
    from helixframe.operators.match import block_pairs, query_pairs, snp_tmrca, str_tmrca
    from helixframe.operators.tree import common_prefix

    q = queries.select(F.col("subject").alias("query")).distinct()
    size = snps.groupBy("subject").agg(F.count_distinct("snp").alias("n"))
    # What a query shares with each subject is a product of matrices of two blocks: no row for a SNP or marker of a pair.
    asked = q.withColumn("_q", F.lit(True))
    mark = lambda d: d.join(asked, d.subject == F.col("query"), "left").select("subject", *(c for c in d.columns if c != "subject"), "_q")
    one = mark(snps.select("subject", "snp").distinct())
    shared = block_pairs(one.withColumn("_v", F.lit(1)), "subject", "snp", "_v", query_pairs, "query SUBJECT, subject SUBJECT, compared long, differing long", "_q")
    shared = shared.select("query", "subject", F.col("compared").alias("shared"))
    own = mark(markers.select("subject", F.upper("marker").alias("m"), "value"))
    str_ = block_pairs(own, "subject", "m", "value", query_pairs, "query SUBJECT, subject SUBJECT, compared long, differing long", "_q").withColumnRenamed("differing", "distance")
    # Two subjects with SNPs are comparable even if none is shared.
    with_snp = size.select("subject", F.col("n").alias("theirs"))
    both = shared.join(str_, ["query", "subject"], "full_outer").join(with_snp, "subject", "left").join(size.select(F.col("subject").alias("query"), F.col("n").alias("mine")), "query", "left")
    snp = F.col("mine").isNotNull() & F.col("theirs").isNotNull()
    n = F.coalesce("shared", F.lit(0))
    p = profiles.select("subject", "name", "lineage")
    j = both.join(p, "subject").join(p.select(F.col("subject").alias("query"), F.col("lineage").alias("ql")), "query")
    at = common_prefix(F.col("lineage"), F.col("ql"))
    j = j.withColumn("signal", F.when(snp & F.col("compared").isNotNull(), "SnpStr").when(snp, "Snp").otherwise("Str"))
    j = j.withColumn("divergence", F.when(snp & (at > 0), F.get("lineage", at - 1))).withColumn("shared", F.when(snp, n).otherwise(0))
    years = F.when(snp, snp_tmrca(F.col("mine") - n, F.col("theirs") - n))
    j = j.withColumn("snp_years", years).withColumn("str_years", F.when(F.col("compared") > 0, str_tmrca(F.col("distance"), F.col("compared"))))
    tier = F.when(F.col("signal") == "Str", 1).otherwise(0)
    w = Window.partitionBy("query").orderBy(tier, F.desc("shared"), F.coalesce("distance", F.lit(1 << 40)), "name", "subject")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query", "subject", "shared", "distance", "compared", "divergence", "snp_years", "str_years", "signal", "place")


def marker_chart(values: DataFrame, groups: DataFrame, order: DataFrame) -> DataFrame:
    """(haplogroup, place, depth, marker, low, high, mode, members): statistics of each group, groups in tree order.

    ``values``: subject, marker, value; ``groups``: subject, haplogroup (null if unplaced, which come first);
    ``order``: haplogroup, rank in pre-order, and how many of its ancestors are groups too.
    """
    v = values.join(groups, "subject")
    n = v.groupBy("haplogroup", "marker", "value").agg(F.count("*").alias("n"))
    s = n.groupBy("haplogroup", "marker").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("n", (-F.col("value")).alias("k"))).alias("mode"), F.sum("n").alias("members"))
    names = groups.select("haplogroup").distinct().join(order, "haplogroup", "left")
    unplaced = F.when(F.col("haplogroup").isNull(), 0).when(F.col("rank").isNotNull(), 1).otherwise(2)
    placed = numbered(names.withColumn("_unplaced", unplaced), [], ["_unplaced", "rank", "haplogroup"])
    placed = placed.select(F.col("haplogroup").alias("h"), "place", F.coalesce("depth", F.lit(0)).alias("depth"))
    return s.join(placed, F.col("haplogroup").eqNullSafe(F.col("h"))).drop("h")


def deviations(values: DataFrame, chart: DataFrame, groups: DataFrame) -> DataFrame:
    """(subject, marker, deviation): Below or Above the mode of the subject's group."""
    j = values.join(groups, "subject").join(chart.select(F.col("haplogroup").alias("h"), F.col("marker").alias("m"), "mode"), F.col("haplogroup").eqNullSafe(F.col("h")) & (F.col("marker") == F.col("m")))
    return j.select("subject", "marker", F.when(F.col("value") < F.col("mode"), "Below").when(F.col("value") > F.col("mode"), "Above").alias("deviation"))


def maintenance_survey(chores: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(chore, due, total): for each chore all rows, those done or not due, and their key."""
    out = None
    for name, (rows, done, key) in chores.items():
        n = rows.select(key).join(done.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
        one = n.agg(F.lit(name).alias("chore"), F.count_if(F.col("_done").isNull()).alias("due"), F.count("*").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out.select("chore", "due", "total")


def stale_placements(calls: DataFrame, consensus: DataFrame, nodes: DataFrame, fingerprint: str) -> DataFrame:
    """Subjects with a call against another tree, or whose consensus names a branch that the tree doesn't hold."""
    old = calls.where(F.col("tree").isNotNull() & (F.col("tree") != fingerprint)).select("subject")
    return old.union(off_tree_subjects(consensus, nodes)).distinct()


def off_tree_subjects(consensus: DataFrame, nodes: DataFrame) -> DataFrame:
    return consensus.join(nodes.select(F.upper("name").alias("_n")).distinct(), F.upper("label") == F.col("_n"), "left_anti").select("subject").distinct()


def publishable_ancestors(ancestors: DataFrame, variant_sets: DataFrame, runs: DataFrame, alignments: DataFrame, members: DataFrame) -> DataFrame:
    """Ancestors of subjects with data of their own and without an opt-out: a roster row that doesn't share publicly."""
    own = variant_sets.select("subject").union(runs.join(alignments, "run", "left_semi").select("subject")).distinct()
    out = members.where(F.coalesce("shares", F.lit(False)) == F.lit(False)).select("subject")
    return ancestors.join(own, "subject", "left_semi").join(out, "subject", "left_anti")


def ledger(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests, newest first by ``place``, each with its result if there is one."""
    r = results.select("request", F.col("total_cm").alias("result_cm"))
    j = requests.join(r, "request", "left").withColumn("attested", F.col("attested_at").isNotNull()).drop("attested_at")
    return j


def default_alignment(alignments: DataFrame, key: list[str]) -> DataFrame:
    """The alignment that stands for a subject: by breadth of its test, depth, a file, being derived; then the smallest id."""
    best = F.max_by("alignment", F.struct("breadth", "depth", "has_file", "derived", (-F.col("alignment")).alias("k")))
    return alignments.groupBy(*key).agg(best.alias("alignment"))


def breadth_rank(target: Column) -> Column:
    """Whole genomes before exomes and mixed chips before tests of Y or mitochondria."""
    return F.when(target.isNull() | target.isin("WholeGenome"), 3).when(target.isin("Autosomal", "Mixed", "XChromosome"), 2).otherwise(1)


def donor_ancestry(results: DataFrame, key: list[str], consensus: int = 0, method: str = "ADMIXTURE") -> DataFrame:
    """The consensus estimate of a method, else the one with the most SNPs."""
    r = results.where(F.col("method") == method)
    best = F.max_by(F.struct("source", "snps", "top"), F.struct((F.col("source") == consensus).alias("c"), "snps", "source"))
    return r.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def build_vote(alignments: DataFrame, key: list[str], build: str = "build") -> DataFrame:
    """The commonest known build of a project; ties go to the name that sorts last."""
    n = alignments.where(F.col(build).isNotNull()).groupBy(*key, build).agg(F.count("*").alias("n"))
    return n.groupBy(*key).agg(F.max_by(build, F.struct("n", build)).alias("build"), F.sum("n").alias("votes"))


def donor_private(calls: DataFrame, key: list[str]) -> DataFrame:
    """Private variants of a subject over its alignments: the deepest call of a position, the first alignment on ties."""
    deepest = F.max_by(F.struct("alignment", "depth", "alt"), F.struct("depth", (-F.col("alignment")).alias("k")))
    return calls.groupBy(*key, "pos").agg(deepest.alias("d")).select(*key, "pos", "d.*")


def observed_profile(obs: DataFrame, key: list[str]) -> DataFrame:
    """(key, group, name, pos, ancestral, derived, sources): observations by name or position, each source kept.

    The first named observation speaks for the group, in the order of ``seq``.
    """
    from helixframe.functions.rules import group_key

    g = obs.withColumn("group", group_key(F.col("name"), F.col("pos")))
    first = F.min_by(F.struct("name", "pos", "ancestral", "derived"), F.struct((F.trim("name") == "").alias("unnamed"), "seq"))
    sources = F.transform(F.sort_array(F.collect_list(F.struct("seq", "source", "base"))), lambda s: F.concat_ws(":", s["source"], s["base"]))
    return g.groupBy(*key, "group").agg(first.alias("f"), sources.alias("sources")).select(*key, "group", "f.*", "sources")


def fact_sheet(subjects: DataFrame, facts: dict[str, DataFrame], key: str = "subject") -> DataFrame:
    """One row a subject with a struct for each fact, null where there is none: one join a fact, never a loop."""
    out = subjects.select(key).distinct()
    for name, rows in facts.items():
        out = out.join(rows.select(key, F.struct(*(c for c in rows.columns if c != key)).alias(name)), key, "left")
    return out


def mt_regions(variants: DataFrame, key: list[str]) -> DataFrame:
    """Mitochondrial differences by region: hypervariable 1 (16024 to 16383), 2 (57 to 372) and the rest, with the first five."""
    hv1, hv2 = F.col("pos").between(16024, 16383), F.col("pos").between(57, 372)
    examples = F.slice(F.sort_array(F.collect_list(F.struct("pos", "note"))), 1, 5)
    return variants.groupBy(*key).agg(F.count("*").alias("total"), F.count_if(hv1).alias("hvr1"), F.count_if(hv2).alias("hvr2"), F.count_if(~hv1 & ~hv2).alias("coding"), F.array_join(F.transform(examples, lambda x: x["note"]), ",").alias("examples"))


# ---- keeping the store


def completeness_rank(completeness: Column) -> Column:
    return F.when(completeness == "full", 2).when(completeness == "partial", 1).otherwise(0)


def keep_fuller(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Artifacts after new ones come in: a fuller one is never replaced by a less complete one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(completeness_rank(F.col("completeness"))), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def merge_runs(runs: DataFrame, alignments: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, alignments) after the secondary runs of ``merges`` (subject, primary, secondary) went into the primary.

    Merges into itself, of unknown runs or across subjects are left out.
    """
    own = runs.select("subject", "run")
    m = merges.where("primary <> secondary").join(own.withColumnRenamed("run", "primary"), ["subject", "primary"], "left_semi").join(own.withColumnRenamed("run", "secondary"), ["subject", "secondary"], "left_semi")
    m = m.groupBy(F.col("secondary").alias("run")).agg(F.min("primary").alias("_to"))
    moved = alignments.join(m, "run", "left").withColumn("run", F.coalesce("_to", "run")).select(alignments.columns)
    return runs.join(m, "run", "left_anti").select(runs.columns), moved


def backfill(rows: DataFrame, found: DataFrame, key: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their null columns filled from the first finding of the key, how many of each column were filled)."""
    first = found.groupBy(*key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(f"_{c}") for c in columns))
    j = rows.join(first, key, "left")
    counts = j.agg(F.count("*").alias("examined"), *(F.count_if(F.col(c).isNull() & F.col(f"_{c}").isNotNull()).alias(f"{c}_filled") for c in columns))
    return j.select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns)), counts


def recent(history: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` entries of each account, newest first by ``place``; the number is the feature."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return history.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def current_overrides(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """Overrides in force after a log of settings and clearings (value null)."""
    last = log.groupBy(*key).agg(F.max_by(F.struct("value"), order).alias("v"))
    return last.select(*key, F.col("v.value").alias("value")).where(F.col("value").isNotNull())


def allocate_sequence(messages: DataFrame, next_seq: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New messages numbered on from each conversation's counter."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return messages.withColumn("_n", n).join(next_seq, key).withColumn("seq", F.col("next_seq") + F.col("_n")).drop("_n", "next_seq")


def last_read(conversations: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Conversations read up to the partner's last message; without one they stay as they are."""
    top = messages.where(F.col("sender") == "partner").groupBy(key).agg(F.max("seq").alias("_top"))
    return conversations.join(top, key, "left").withColumn("last_read", F.coalesce("_top", "last_read")).drop("_top")


def catalogue_backfill(subjects: DataFrame, found: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identifiers to add, one row of counts): those found, less stored ones and those that two subjects claim.

    ``found`` and ``stored``: subject, namespace, value.
    """
    key = ["namespace", "value"]
    f = found.join(subjects.select("subject"), "subject", "left_semi").distinct()
    claims = f.union(stored.select("subject", *key)).distinct().groupBy(*key).agg(F.count_distinct("subject").alias("n"))
    new = f.join(stored, ["subject", *key], "left_anti")
    add = new.join(claims.where("n = 1"), key, "left_semi")
    counts = f.agg(F.count("*").alias("found")).join(new.agg(F.count("*").alias("missing"))).join(add.agg(F.count("*").alias("added")))
    return add, counts.withColumn("conflicts", F.col("missing") - F.col("added"))


def import_plan(rows: DataFrame, subjects: DataFrame, scores: DataFrame, least: float = 0.6) -> DataFrame:
    """(kit, action, subject): exact external id first, else the best score of at least ``least``, else a new subject."""
    exact = rows.join(subjects.select(F.col("external").alias("kit"), F.col("subject").alias("_e")), "kit", "left")
    best = scores.where(F.col("score") >= least).groupBy("kit").agg(F.max_by("subject", F.struct("score", (-F.col("subject")).alias("k"))).alias("_b"))
    j = exact.join(best, "kit", "left")
    action = F.when(F.col("_e").isNotNull(), "Exact").when(F.col("_b").isNotNull(), "Fuzzy").otherwise("Create")
    return j.select("kit", action.alias("action"), F.coalesce("_e", "_b").alias("subject"))


def due_analyses(samples: DataFrame, artifacts: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(sample, kind) still to be done: samples of a project without a current artifact."""
    kinds = samples.sparkSession.createDataFrame(list(wanted.items()), "kind string, version string")
    fresh = artifacts.join(F.broadcast(kinds), ["kind", "version"], "left_semi").select("sample", "kind")
    return samples.select("sample").distinct().join(F.broadcast(kinds.select("kind"))).join(fresh, ["sample", "kind"], "left_anti")


def missing_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Recorded files that the listing doesn't show."""
    return files.join(listing.select("path").distinct(), "path", "left_anti")


def laminar_family(sets: DataFrame, family: str, name: str, item: str) -> DataFrame:
    """(family, crossing pairs, laminar): whether the sets of a family are all disjoint or nested."""
    s = sets.select(family, name, item).distinct()
    size = s.groupBy(family, name).agg(F.count("*").alias("n"))
    a, b = s.withColumnRenamed(name, "a"), s.withColumnRenamed(name, "b")
    shared = a.join(b, [family, item]).where("a < b").groupBy(family, "a", "b").agg(F.count("*").alias("s"))
    j = shared.join(size.select(family, F.col(name).alias("a"), F.col("n").alias("na")), [family, "a"]).join(size.select(family, F.col(name).alias("b"), F.col("n").alias("nb")), [family, "b"])
    crossing = j.where((F.col("s") < F.col("na")) & (F.col("s") < F.col("nb"))).groupBy(family).agg(F.count("*").alias("crossing"))
    return sets.select(family).distinct().join(crossing, family, "left").select(family, F.coalesce("crossing", F.lit(0)).alias("crossing"), F.col("crossing").isNull().alias("laminar"))


class Entities:
    """Rows of one entity in a Parquet table: create, update, delete and list; each change writes a new version.

    Versions are folders under ``path``; readers take the newest complete one, so a lost writer changes nothing.
    """

    def __init__(self, spark, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(map(int, done))

    def rows(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> DataFrame:
        found = self._versions()
        rows.write.parquet(f"{self.path}/{found[-1] + 1 if found else 1}")
        return self.rows()

    def create(self, new: DataFrame) -> DataFrame:
        """Rows whose key isn't there yet."""
        now = self.rows()
        return self._write(now.unionByName(new.join(now, self.key, "left_anti").select(now.columns)))

    def upsert(self, new: DataFrame) -> DataFrame:
        now = self.rows()
        return self._write(now.join(new, self.key, "left_anti").select(now.columns).unionByName(new.select(now.columns)))

    def delete(self, gone: DataFrame) -> DataFrame:
        now = self.rows()
        return self._write(now.join(gone.select(self.key), self.key, "left_anti").select(now.columns))

    def list_by(self, column: str, value) -> DataFrame:
        """Rows of one parent, in the order of their ids."""
        return self.rows().where(F.col(column) == value).orderBy(self.key)
