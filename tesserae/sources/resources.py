"""Reference tables in files: ortholog tables, interaction archives with their versions, and gene identifiers.

Files are read where they lie (any store Spark reads), with only the columns that a result needs; nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genes as g

#: Organisms of the HCOP tables (fixed values); each has a column `<organism>_symbol` beside `human_symbol`.
ORGANISMS = (
    "human", "anole_lizard", "c.elegans", "cat", "cattle", "chicken", "chimpanzee", "dog", "fruitfly", "horse", "macaque", "mouse", "opossum", "pig", "platypus", "rat", "s.cerevisiae", "s.pombe",
    "xenopus", "zebrafish",
)
#: Columns of an interaction archive that its readers use (fixed values).
INTERACTION_COLUMNS = (
    "source_genesymbol", "target_genesymbol", "is_stimulation", "is_inhibition", "consensus_stimulation", "consensus_inhibition", "dorothea_level", "evidences", "ncbi_tax_id_target",
)
ARCHIVE = r"omnipath_webservice_interactions__(\d{8}|\d{4}-\d{2}-\d{2})[-_]+(\d{8}|\d{4}-\d{2}-\d{2})\.tsv(?:\.gz)?"


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    table = spark.read.option("header", True).option("sep", "\t").csv(path)
    if missing := [c for c in columns if c not in table.columns]:
        raise ValueError(f"{path}: columns missing: {missing}")
    return table.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in columns])


def read_hcop(spark: SparkSession, path: str, organism: str, min_evidence: int = 3) -> DataFrame:
    """(source: human symbol, target, support, evidence) of an HCOP table with enough supports; `-` and nulls go."""
    if organism not in ORGANISMS or organism == "human":
        raise ValueError(f"organism: one of {ORGANISMS[1:]}")
    if min_evidence < 1:
        raise ValueError("min_evidence: 1 or more")
    rows = _tsv(spark, path, ["human_symbol", f"{organism}_symbol", "support"]).toDF("source", "target", "support")
    return g.supported(rows.filter("source <> '-' and target <> '-'"), min_evidence)


def read_orthologs(spark: SparkSession, paths: dict[str, str], output_organism: str, input_organism: str = "human", min_evidence: int = 3) -> DataFrame:
    """(source, target, evidence, frequency, rank) between two organisms; paths: the table of each organism that is not
    human. Human to others reads one table, others to human turns it round, and two others meet at human genes, where
    the evidence of a path is the lesser and its frequency the number of human genes between."""
    if input_organism == output_organism:
        raise ValueError("two different organisms expected")
    if input_organism == "human":
        return g.ranked_orthologs(read_hcop(spark, paths[output_organism], output_organism, min_evidence))
    if output_organism == "human":
        rows = read_hcop(spark, paths[input_organism], input_organism, min_evidence)
        return g.ranked_orthologs(rows.select(F.col("target").alias("source"), F.col("source").alias("target"), "evidence"))
    left, right = (read_hcop(spark, paths[o], o, min_evidence) for o in (input_organism, output_organism))
    return g.ranked_orthologs(g.bridge(left, right).select("source", "target", "evidence"))


def ortholog_lists(ranked: DataFrame) -> DataFrame:
    """(source, targets): each gene's orthologs, the best first."""
    return ranked.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("targets"))


def archive_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, start, end, path) of the dated interaction archives in a folder, by their names alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "omnipath_webservice_interactions__*").load(folder).select("path")
    date = lambda k: F.to_date(F.replace(F.regexp_extract("path", ARCHIVE, k), F.lit("-")), "yyyyMMdd")
    found = files.filter(F.col("path").rlike(ARCHIVE)).select(date(1).alias("start"), date(2).alias("end"), "path")
    return found.select(F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string")).alias("version"), "start", "end", "path")


def resolve_archive(spark: SparkSession, folder: str, version: str = "latest") -> str:
    """Path of the archive whose dates hold the one given; `latest`: the one so named, else the newest."""
    if version == "latest":
        named = spark.read.format("binaryFile").option("pathGlobFilter", "omnipath_webservice_interactions__latest.tsv*").load(folder).select("path").limit(1).collect()
        rows = named or archive_versions(spark, folder).orderBy(F.desc("end"), F.desc("start")).limit(1).collect()
    else:
        rows = g.version_at(archive_versions(spark, folder), version).orderBy(F.desc("start")).limit(1).collect()
    if not rows:
        raise ValueError(f"no archive for version {version!r}")
    return rows[0]["path"]


def read_interactions(spark: SparkSession, path: str, resource: str, organism: int | None = None) -> DataFrame:
    """(row_no, source, target, the sign and evidence columns) of an archive's rows that a resource's flag marks, in file
    order; organism: taxon of the targets."""
    table = spark.read.option("header", True).option("sep", "\t").csv(path)
    if resource not in table.columns:
        raise ValueError(f"resource column not found in the archive: {resource}")
    kept = [c for c in INTERACTION_COLUMNS if c in table.columns]
    rows = table.withColumn("row_no", F.monotonically_increasing_id()).filter(g.truthy(F.col(resource))).select("row_no", *kept)
    if organism is not None and "ncbi_tax_id_target" in kept:
        rows = rows.filter(F.col("ncbi_tax_id_target") == str(organism))
    return rows.withColumnsRenamed({"source_genesymbol": "source", "target_genesymbol": "target", "dorothea_level": "level"})


def collectri(spark: SparkSession, path: str, split: bool = False, organism: int | None = None) -> DataFrame:
    """(source, target, sign) of the CollecTRI rows of an archive; split: complexes to their subunits."""
    signs = g.consensus_signs(read_interactions(spark, path, "collectri", organism))
    return g.split_complexes(signs) if split else signs


def dorothea(spark: SparkSession, path: str, levels: tuple[str, ...] = ("A", "B", "C"), compatibility: bool = False, organism: int | None = None) -> DataFrame:
    """(source, target, sign, confidence) of the DoRothEA rows of an archive."""
    return g.confidence_signs(read_interactions(spark, path, "dorothea", organism), levels, compatibility)


def load_interactions_version(spark: SparkSession, folder: str, resource: str, version: str = "latest", **options) -> DataFrame:
    """A resource from the archive of a version in a folder of archives."""
    if resource not in ("collectri", "dorothea"):
        raise ValueError("resource: collectri or dorothea")
    return {"collectri": collectri, "dorothea": dorothea}[resource](spark, resolve_archive(spark, folder, version), **options)


def translated(edges: DataFrame, ranked: DataFrame, one_to_many: int = 5) -> DataFrame:
    """Human edges for another organism: both ends go to all their orthologs, genes with more than one_to_many drop out,
    and equal signed edges are one."""
    once = g.translate(edges, "source", ranked, "drop", one_to_many).drop("source").withColumnRenamed("translated", "source")
    both = g.translate(once, "target", ranked, "drop", one_to_many).drop("target").withColumnRenamed("translated", "target")
    return both.select("source", "target", *[c for c in edges.columns if c not in ("source", "target")]).distinct()


#: Identifier types that every gene table has (fixed values); databases add theirs.
INPUT_TYPES, OUTPUT_TYPES = ("name", "gene_id", "ensembl_id"), ("symbol", "ncbi_symbol", "gene_id", "ensembl_id")


def databases(info: DataFrame) -> list[str]:
    """Databases that some gene is named in: a handful."""
    return sorted(r["k"] for r in info.select(F.explode(F.map_keys("databases")).alias("k")).distinct().collect())


def input_identifier_types(info: DataFrame) -> tuple[str, ...]:
    return (*INPUT_TYPES, *databases(info))


def output_identifier_types(info: DataFrame) -> tuple[str, ...]:
    return (*OUTPUT_TYPES, *databases(info))


def by_identifier(info: DataFrame, kind: str) -> DataFrame:
    """(key, gene_id) for any input type: names by their priorities, ids as they are, databases by their ids."""
    if kind == "name":
        return g.alias_table(info)
    if kind in ("gene_id", "ensembl_id"):
        keyed = info.select(F.upper(kind).alias("key"), "gene_id")
    else:
        keyed = info.select(F.upper(F.try_element_at("databases", F.lit(kind))).alias("key"), "gene_id")
    return keyed.filter("key is not null").groupBy("key").agg(F.min("gene_id").alias("gene_id"))


def with_identifiers(info: DataFrame, kind: str) -> DataFrame:
    """(gene_id, `kind`) for any output type."""
    if kind in OUTPUT_TYPES:
        return info.select("gene_id", *({kind} - {"gene_id"})) if kind != "gene_id" else info.select("gene_id")
    return info.select("gene_id", F.try_element_at("databases", F.lit(kind)).alias(kind))
