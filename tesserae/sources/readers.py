"""Readers of networks, cubes, edges and matrices into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import from_table


def read_bnet(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(network, component, rule) of `.bnet` files: one rule a line after the first comma, `#` starts a comment, `!` is
    read as `~`. A directory gives one network a file. A header line is a component like any other."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", "*.bnet") if recursive or not path.endswith(".bnet") else reader
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("network"), F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).filter("line <> ''")
    at = F.instr("line", ",")
    rule = F.replace(F.trim(F.substring(F.col("line"), at + 1, F.length("line"))), F.lit("!"), F.lit("~"))
    checked = F.when(at > 0, F.trim(F.substring(F.col("line"), F.lit(1), at - 1))).otherwise(F.raise_error(F.concat(F.lit("no comma in line: "), F.col("line"))))
    return lines.select("network", checked.alias("component"), rule.alias("rule"))


def validate_network(rules: DataFrame) -> DataFrame:
    """(network, symbol) of symbols that no rule of their network defines; a closed network has none."""
    used = rules.select("network", F.explode(F.regexp_extract_all("rule", F.lit(r"([A-Za-z_][\w.:\-]*)"), F.lit(1))).alias("symbol")).distinct()
    used = used.filter(~F.lower("symbol").isin("true", "false"))
    return used.join(rules.select("network", F.col("component").alias("symbol")), ["network", "symbol"], "left_anti")


def read_influence_graph(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Signed edges of a CSV with source, target and sign; other columns stay, rows without a sign go."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    if missing := {"source", "target", "sign"} - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    return from_table(df)


def _cube_value(c):
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("1", "1.0", "true"), True).when(s.isin("0", "0.0", "false"), False)


def read_hypercubes(spark: SparkSession, path: str, orientation: str = "columns", sep: str = ",") -> DataFrame:
    """(name, component, value) of a CSV or JSON of hypercubes; empty and `*` are free, so null.

    columns: a cube a column, components in the first; rows: a cube a row. JSON: {cube: {component: value}}."""
    if path.endswith(".json"):
        text = spark.read.option("wholetext", True).text(path)
        cubes = text.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("name", "_m"))
        return cubes.select("name", F.explode("_m").alias("component", "_v")).select("name", "component", _cube_value(F.col("_v")).alias("value"))
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    first, *rest = df.columns
    long = df.unpivot([first], rest, "_other", "_v")
    name, component = ("_other", first) if orientation == "columns" else (first, "_other")
    return long.select(F.col(name).alias("name"), F.col(component).alias("component"), _cube_value(F.col("_v")).alias("value"))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _start, _k) of the lines of a file, of a folder of parts or of a glob. Spark deals the largest parts
    out first, so `_k` alone is not their order; (_file, _start, _k) is."""
    at = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    return spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("_k"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, row_no): lines numbered from 0 in the order of `_placed`."""
    lines = _placed(spark, path)
    blocks = lines.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_k").alias("_first")).collect()  # a row a block
    base, rows = 0, []
    for b in sorted(blocks, key=lambda b: (b["_file"], b["_start"])):
        rows.append((b["_file"], b["_start"], base - b["_first"]))
        base += b["_n"]
    shift = spark.createDataFrame(rows, "_file string, _start long, _shift long")
    return lines.join(F.broadcast(shift), ["_file", "_start"]).select("value", (F.col("_k") + F.col("_shift")).alias("row_no"))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value), 0-based, of a Matrix Market coordinate file, gzip included, or of its parts in the order of
    their names. Comments and the size line go: the size line is the first that is no comment."""
    lines = _placed(spark, path).filter(~F.col("value").startswith("%")).filter(F.trim("value") != "")
    at = lines.select(F.split(F.trim("value"), r"\s+").alias("f"), F.struct("_file", "_start", "_k").alias("_at"))
    first = at.agg(F.min("_at").alias("_first"))
    rows = at.crossJoin(F.broadcast(first)).filter("_at > _first")
    return rows.select((F.col("f")[0].cast("long") - 1).alias("row"), (F.col("f")[1].cast("long") - 1).alias("col"), F.when(F.size("f") > 2, F.get("f", F.lit(2)).cast("double")).otherwise(1.0).alias("value"))


def read_10x(spark: SparkSession, path: str) -> DataFrame:
    """(cell, gene, value) of a folder with matrix.mtx, barcodes.tsv and genes.tsv or features.tsv (each may be gzipped)."""

    def names(glob: str, out: str) -> DataFrame:
        return _numbered(spark, f"{path}/{glob}").select(F.col("row_no").alias("_i"), F.split("value", "\t")[0].alias(out))

    x = read_mtx(spark, f"{path}/matrix.mtx*")
    genes, cells = names("{genes,features}.tsv*", "gene"), names("barcodes.tsv*", "cell")
    return x.join(genes, x.row == genes._i).drop("_i").join(cells, x.col == cells._i).select("cell", "gene", "value")


def read_gene_info(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, gene_id, symbol, ncbi_symbol, synonyms, databases map, ensembl_id, chromosome, gene_type) of a TSV in file
    order."""
    lines = _numbered(spark, path).select(F.split("value", "\t").alias("f"), "row_no").filter(~F.col("f")[0].startswith("#") & (F.col("f")[0] != "gene_id"))
    f = F.col("f")
    refs = F.filter(F.split(f[4], r"\|"), lambda x: x.contains(":"))
    pair = F.transform(refs, lambda x: F.struct(F.substring_index(x, ":", 1).alias("db"), F.regexp_replace(x, "^[^:]*:", "").alias("id")))
    out = lines.select("row_no", f[0].alias("gene_id"), f[1].alias("symbol"), f[2].alias("ncbi_symbol"), F.filter(F.split(f[3], r"\|"), lambda x: x != "-").alias("synonyms"), pair.alias("_r"), f[5].alias("chromosome"), f[6].alias("gene_type"))
    # of a database named twice the last counts
    last = lambda db: F.element_at(F.filter("_r", lambda x: x["db"] == db), -1)["id"]
    other = F.filter("_r", lambda x: x["db"] != "Ensembl")
    keep = F.transform(F.array_distinct(F.transform(other, lambda x: x["db"])), lambda d: F.struct(d.alias("db"), F.element_at(F.transform(F.filter("_r", lambda x: x["db"] == d), lambda x: x["id"]), -1).alias("id")))
    ensembl = F.when(F.exists("_r", lambda x: x["db"] == "Ensembl"), last("Ensembl"))
    return out.withColumns({"databases": F.map_from_entries(keep), "ensembl_id": ensembl}).drop("_r")
