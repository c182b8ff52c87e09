"""Readers of genealogy exports: named-variant reports, group files, SNP dictionaries, subject and truth VCFs, stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.genotype import contig_bare
from helixframe.functions.rules import present, valid_snp

#: Columns of a marker overview that aren't markers, and entities of these exports: fixed values.
IDENTITY = ("Kit Number", "Name", "Paternal Ancestor Name", "Country", "Haplogroup", "Test", "Subgroup")
ENTITIES = (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&darr;", ""), ("&#39;", "'"), ("&quot;", '"'))


def big_y_report(columns: list[str]) -> str | None:
    """named or private by the header of a variant report, else None."""
    low = [c.strip().strip('"').lower() for c in columns]
    if {"snp_name", "position", "ancestral", "derived"} <= set(low):
        return "named"
    return "private" if low == ["position", "ancestral", "derived"] else None


def big_y_variants(rows: DataFrame) -> DataFrame:
    """Derived SNPs of a named or private report; rows that aren't single bases at a position go."""
    if (kind := big_y_report(rows.columns)) is None:
        raise ValueError("not a variant report")
    name = present(F.trim("SNP_Name")) if kind == "named" else F.lit(None).cast("string")
    out = rows.select(F.lit("chrY").alias("contig"), F.trim("Position").try_cast("long").alias("pos"), F.upper(F.trim("Ancestral")).alias("ref"), F.upper(F.trim("Derived")).alias("alt"), name.alias("name"), F.lit("1").alias("genotype"))
    return out.where(F.col("pos").isNotNull() & valid_snp(F.col("ref"), F.col("alt")))


def unescaped(text: Column) -> Column:
    out = text
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def _filled(text: Column) -> Column:
    t = unescaped(text)
    return F.when((t != "") & (t != "-"), t)


def _real_kits(rows: DataFrame) -> DataFrame:
    kit = F.trim("Kit Number")
    return rows.where((kit != "") & (kit != "MIN") & ~kit.startswith("00000")).withColumn("Kit Number", unescaped(F.col("Kit Number")))


def group_file_kind(columns: list[str]) -> str | None:
    if any(c.startswith("DYS") for c in columns):
        return "YdnaOverview"
    for name, kind in (("Publicly Share DNA Results", "Member"), ("Maternal Ancestor Name", "MaternalAncestry"), ("Paternal Ancestor Name", "PaternalAncestry")):
        if name in columns:
            return kind
    return None


def members(rows: DataFrame) -> DataFrame:
    yes = F.upper(F.trim("Publicly Share DNA Results"))
    return _real_kits(rows).select(F.col("Kit Number").alias("kit"), _filled(F.col("Name")).alias("name"), _filled(F.col("Access Granted")).alias("access"), F.when(yes == "YES", True).when(yes == "NO", False).alias("shares"))


def ancestors(rows: DataFrame) -> DataFrame:
    """Ancestor, years, place and clade of each kit; sentinels of these exports are nulls."""
    name = next(c for c in rows.columns if c.endswith("Ancestor Name"))
    raw = _filled(F.col(name))
    year = lambda mark, stop: F.nullif(F.regexp_extract(raw, rf"(?i)(?<![a-z]){mark}\.{stop}*?([0-9]{{4}})", 1), F.lit("")).cast("int")
    before = F.regexp_extract(raw, r"(?is)^(.*?)(?:(?<![a-z])[bd]\.|$)", 1)
    coord = lambda c: F.nullif(F.trim(c).try_cast("double"), F.lit(0.0))
    clade, country, place = _filled(F.col("Sub Group")), _filled(F.col("Country")), _filled(F.col("Map Location"))
    return _real_kits(rows).select(
        F.col("Kit Number").alias("kit"),
        F.when(clade.contains(">"), clade).alias("sub_group"),
        F.when(country != "Unknown Origin", country).alias("country"),
        F.nullif(F.regexp_replace(F.trim(before), r"[,\s]+$", ""), F.lit("")).alias("ancestor"),
        year("b", r"(?:(?!(?<![a-z])d\.).)").alias("born"),
        year("d", ".").alias("died"),
        F.when(place != "No Location Saved", place).alias("place"),
        coord("Latitude").alias("latitude"),
        coord("Longitude").alias("longitude"),
    )


def overview_markers(rows: DataFrame) -> DataFrame:
    """(kit, marker, value) of the filled marker cells: the wide table turned long, in one pass."""
    names = [c for c in rows.columns if c not in IDENTITY and c]
    cells = F.array(*(F.struct(F.lit(unescape(c)).alias("marker"), F.trim(F.col(f"`{c}`")).alias("value")) for c in names))
    long = _real_kits(rows).select(F.col("Kit Number").alias("kit"), F.explode(cells).alias("c")).select("kit", "c.*")
    return long.where(~F.col("value").isin("", "0", "-"))


def unescape(name: str) -> str:
    for entity, char in ENTITIES:
        name = name.replace(entity, char)
    return name.strip()


def snp_dictionary(lines: DataFrame, seq: str = "seq") -> DataFrame:
    """(name, build, contig, pos, strand, ancestral, derived): the first line of a name and build holds."""
    c = F.transform(F.split("value", "\t"), lambda x: F.trim(x))
    r = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(c.alias("c"), seq).where((F.size("c") >= 7) & (F.lower(F.get("c", F.lit(0))) != "name"))
    get = lambda k: F.get("c", F.lit(k))
    r = r.withColumn("pos", get(3).try_cast("long")).where("pos is not null")
    row = F.struct(get(0).alias("name"), get(2).alias("contig"), "pos", F.when(get(4) == "", "+").otherwise(F.substring(get(4), 1, 1)).alias("strand"), F.upper(get(5)).alias("ancestral"), F.upper(get(6)).alias("derived"))
    g = r.groupBy(F.lower(get(0)).alias("key"), get(1).alias("build")).agg(F.min_by(row, seq).alias("r"))
    spelled = r.groupBy(F.lower(get(0)).alias("key")).agg(F.min_by(get(0), seq).alias("canonical"))
    return g.join(spelled, "key").select("key", F.col("canonical").alias("name"), "build", "r.contig", "r.pos", "r.strand", "r.ancestral", "r.derived")


def snp_aliases(lines: DataFrame, dictionary: DataFrame, seq: str = "seq") -> DataFrame:
    """(alias, key) of aliases that aren't names themselves and lead to a name; the first line of an alias holds."""
    c = F.transform(F.split("value", "\t"), lambda x: F.lower(F.trim(x)))
    r = lines.where(~F.col("value").startswith("#")).select(F.get(c, F.lit(0)).alias("alias"), F.get(c, F.lit(1)).alias("key"), seq).where((F.col("alias") != "") & (F.col("key") != "") & (F.col("alias") != "alias"))
    names = dictionary.select("key").distinct()
    known = r.join(names, "key", "left_semi").join(names.withColumnRenamed("key", "alias"), "alias", "left_anti")
    return known.groupBy("alias").agg(F.min_by("key", seq).alias("key"))


def resolve_snps(names: DataFrame, dictionary: DataFrame, aliases: DataFrame, build: str, name: str = "name") -> DataFrame:
    """``names`` with the canonical name and its place on a build, null where the dictionary has none."""
    n = names.withColumn("_a", F.lower(F.trim(name))).join(aliases.withColumnRenamed("alias", "_a").withColumnRenamed("key", "_k"), "_a", "left").withColumn("key", F.coalesce("_k", "_a"))
    d = dictionary.where(F.col("build") == build).select("key", F.col("name").alias("canonical"), "contig", "pos", "strand", "ancestral", "derived")
    return n.join(d, "key", "left").drop("_a", "_k", "key")


def names_at_positions(dictionary: DataFrame, build: str) -> DataFrame:
    """(pos, name): one name a position, the least."""
    return dictionary.where(F.col("build") == build).groupBy("pos").agg(F.min("name").alias("name"))


def subject_snps(lines: DataFrame) -> DataFrame:
    """SNPs that a VCF's subject carries, with the evidence given: the first alternate of the genotype, or the first
    listed where there is no genotype; reference and uncalled rows go."""
    f = F.split("value", "\t")
    get = lambda k: F.get(f, F.lit(k))
    r = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 5) & (get(4) != ".") & get(1).try_cast("long").isNotNull())

    def field(key: str) -> Column:
        at = F.array_position(F.split(get(8), ":"), F.lit(key)).cast("int")
        return F.when((F.size(f) >= 10) & (at > 0), present(F.get(F.split(get(9), ":"), at - 1)))

    gt = field("GT")
    carried = F.get(F.filter(F.transform(F.split(gt, r"[/|]"), lambda a: a.try_cast("int")), lambda a: a > 0), F.lit(0))
    index = F.when(gt.isNull(), 1).otherwise(carried)
    ad = F.transform(F.split(field("AD"), ","), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    failed = F.when(~F.upper(get(6)).isin("", ".", "PASS"), get(6))
    out = r.select(
        contig_bare(get(0)).alias("contig"), get(1).cast("long").alias("pos"), F.upper(get(3)).alias("ref"), F.upper(F.get(F.split(get(4), ","), index - 1)).alias("alt"), present(get(2)).alias("rsid"), gt.alias("genotype"),
        get(5).try_cast("double").alias("qual"), failed.alias("filter"), field("DP").try_cast("int").alias("dp"), field("GQ").try_cast("int").alias("gq"), F.get(ad, F.lit(0)).alias("ad_ref"), F.get(ad, index).alias("ad_alt"),
    )
    return out.where(valid_snp(F.col("ref"), F.col("alt")))


def truth_keys(lines: DataFrame) -> DataFrame:
    """(contig, pos, ref, alt) of a truth VCF's single-base variants, one row an alternate."""
    f = F.split("value", "\t")
    r = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 5))
    e = r.select(contig_bare(F.get(f, F.lit(0))).alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.upper(F.get(f, F.lit(3))).alias("ref"), F.explode(F.split(F.upper(F.get(f, F.lit(4))), ",")).alias("alt"))
    return e.where(F.col("pos").isNotNull() & valid_snp(F.col("ref"), F.col("alt"))).distinct()


def nested_tree(spark: SparkSession, path: str) -> DataFrame:
    """(node, parent, name, variant, build, pos, ancestral, derived) of a tree whose nodes hold their children.

    Depth has no bound, so the document is walked with a stack of its own; a node without variants is one row.
    """
    import json

    def run(frames):
        import pandas as pd

        columns = ["node", "parent", "name", "variant", "build", "pos", "ancestral", "derived"]
        for f in frames:
            for text in f["value"]:
                rows, stack = [], [(r, None) for r in json.loads(text)["roots"]]
                while stack:
                    n, parent = stack.pop()
                    before = len(rows)
                    for v in n.get("variants") or []:
                        own = v.get("link_ancestral"), v.get("link_derived")
                        for build, c in (v.get("coordinates") or {}).items():
                            a, d = own if all(own) else (c.get("ancestral"), c.get("derived"))
                            rows.append((n["id"], parent, n["name"], v.get("canonical_name"), build, c.get("position"), a, d))
                    if len(rows) == before:
                        rows.append((n["id"], parent, n["name"], None, None, None, None, None))
                    stack.extend((c, n["id"]) for c in n.get("children") or [])
                out = pd.DataFrame(rows, columns=columns)
                yield out.astype({"node": "Int64", "parent": "Int64", "pos": "Int64"})

    return spark.read.text(path, wholetext=True).mapInPandas(run, "node long, parent long, name string, variant string, build string, pos long, ancestral string, derived string")


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, stretch: int = 100_000) -> DataFrame:
    """A table of an SQLite file on a shared folder, read in stretches of row ids side by side."""
    import sqlite3

    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    if not all(x.replace("_", "").isalnum() for x in (table, *columns)):
        raise ValueError("names of letters, digits and underscores only")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        top = db.execute(f"SELECT coalesce(max(rowid), 0) FROM {table}").fetchone()[0]
    cuts = [(a, a + stretch) for a in range(0, top + 1, stretch)]

    def run(frames):
        import sqlite3

        import pandas as pd

        for f in frames:
            for r in f.itertuples():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute(f"SELECT {', '.join(columns)} FROM {table} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (int(r.a), int(r.b))).fetchall()
                yield pd.DataFrame(rows, columns=columns).convert_dtypes()

    return spark.createDataFrame(cuts, "a long, b long").repartition(len(cuts)).mapInPandas(run, schema)
