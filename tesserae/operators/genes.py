"""Reference tables of genes: identifiers with conflict priorities, orthologs with evidence, signed regulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Priority of gene types in name conflicts (fixed values).
GENE_TYPE_PRIORITY = {
    "protein-coding": 100, "ncRNA": 80, "rRNA": 70, "scRNA": 70, "snRNA": 70, "snoRNA": 70, "tRNA": 70, "other": 30, "unknown": 20, "biological-region": 10, "pseudo": 0,
}


def priority(gene_type: Column) -> Column:
    out = F.lit(-1)
    for name, p in GENE_TYPE_PRIORITY.items():
        out = F.when(gene_type == name, p).otherwise(out)
    return out


def alias_table(info: DataFrame) -> DataFrame:
    """(key, gene_id): which gene an upper-case name means, from (row_no, gene_id, symbol, ncbi_symbol, synonyms array,
    gene_type) in file order.

    Read in order, a symbol always takes its name; a synonym takes a name that is free or held at a lower priority,
    unless a symbol of priority above 0 has held it. So the last symbol wins if one was ever protected; else the best
    synonym after it that outranks it, the first of equals; names without symbols go to the best first synonym."""
    symbol = F.when(F.col("symbol") == "-", F.col("ncbi_symbol")).otherwise(F.col("symbol"))
    base = info.select("row_no", "gene_id", symbol.alias("symbol"), "ncbi_symbol", "synonyms", priority(F.col("gene_type")).alias("p"))
    own = base.select(F.upper("symbol").alias("key"), "gene_id", "p", "row_no", F.lit(0).alias("k"), F.lit(True).alias("main"))
    other = base.select("symbol", "gene_id", "p", "row_no", F.posexplode(F.concat(F.coalesce("synonyms", F.array().cast("array<string>")), F.array("ncbi_symbol"))).alias("k", "name"))
    other = other.filter("name <> '-'").filter(F.upper("name") != F.upper("symbol"))
    events = own.union(other.select(F.upper("name"), "gene_id", "p", "row_no", F.col("k") + 1, F.lit(False)))
    place = F.struct("row_no", "k")
    main = events.filter("main").groupBy("key").agg(F.max(F.struct(place.alias("at"), "gene_id", "p")).alias("last"), F.bool_or(F.col("p") > 0).alias("protected"))
    rivals = events.filter(~F.col("main")).join(main, "key", "left").filter(F.col("last").isNull() | (~F.col("protected") & (place > F.col("last.at")) & (F.col("p") > F.col("last.p"))))
    best = rivals.groupBy("key").agg(F.min_by("gene_id", F.struct((-F.col("p")).alias("p"), place.alias("at"))).alias("rival"))
    return main.join(best, "key", "full").select("key", F.coalesce("rival", "last.gene_id").alias("gene_id"))


def convert(names: DataFrame, column: str, aliases: DataFrame, genes: DataFrame, output: str = "symbol", keep_if_missing: bool = True) -> DataFrame:
    """`names` with `converted`: the gene's `output` column, for unknown names the name itself or null."""
    known = aliases.join(genes.select("gene_id", F.col(output).alias("_out")), "gene_id").select(F.col("key").alias("_key"), "_out")
    joined = names.join(known, F.upper(column) == F.col("_key"), "left")
    value = F.coalesce("_out", column) if keep_if_missing else F.col("_out")
    return joined.withColumn("converted", value).drop("_key", "_out")


def convert_edges(edges: DataFrame, aliases: DataFrame, genes: DataFrame) -> DataFrame:
    """Signed edges with both ends converted; edges that become equal are one."""
    once = convert(edges, "source", aliases, genes).drop("source").withColumnRenamed("converted", "source")
    both = convert(once, "target", aliases, genes).drop("target").withColumnRenamed("converted", "target")
    return both.select("source", "target", "sign").distinct()


def contains(names: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """`names` with `known`."""
    keys = aliases.select(F.col("key").alias("_key"), F.lit(True).alias("_known"))
    return names.join(keys, F.upper(column) == F.col("_key"), "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_key", "_known")


def evidence(support: Column) -> Column:
    """Number of comma-separated supports."""
    return F.size(F.split(support, ","))


def supported(table: DataFrame, min_evidence: int = 3) -> DataFrame:
    """(source, target, support, evidence) of rows without nulls and with enough supports."""
    return table.dropna(subset=["source", "target", "support"]).withColumn("evidence", evidence(F.col("support"))).filter(F.col("evidence") >= min_evidence)


def ranked_orthologs(table: DataFrame) -> DataFrame:
    """(source, target, evidence, frequency, rank): targets by greatest evidence, then number of rows, then name."""
    each = table.groupBy("source", "target").agg(F.max("evidence").alias("evidence"), F.count("*").alias("frequency"))
    order = Window.partitionBy("source").orderBy(F.desc("evidence"), F.desc("frequency"), "target")
    return each.withColumn("rank", F.row_number().over(order))


def bridge(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source, target, via, evidence, best_evidence, paths) of two human-keyed tables (source: human, target): each
    side once a pair at its greatest evidence, evidence the lesser of both, best and paths over a pair's humans."""
    side = lambda d, name, out: d.filter("source <> '-' and target <> '-'").groupBy(F.col("source").alias("via"), F.col("target").alias(name)).agg(F.max("evidence").alias(out))
    paths = side(left, "source", "_a").join(side(right, "target", "_b"), "via").withColumn("evidence", F.least("_a", "_b"))
    pair = Window.partitionBy("source", "target")
    return paths.select("source", "target", "via", "evidence", F.max("evidence").over(pair).alias("best_evidence"), F.count("*").over(pair).alias("paths"))


def translate(names: DataFrame, column: str, ranked: DataFrame, on_unmapped: str = "drop", one_to_many: int | None = None) -> DataFrame:
    """`names` with `translated`. Without one_to_many the best target; with it all targets, a row each, names with more
    than one_to_many dropped. Unmapped names: drop, keep, nan (null) or raise."""
    if one_to_many is None:
        known = ranked.filter("rank = 1").select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    else:
        size = ranked.groupBy("source").agg(F.count("*").alias("_n"))
        known = ranked.join(size.withColumnRenamed("source", "_s"), ranked.source == F.col("_s")).select("_s", F.col("target").alias("_t"), "_n")
    joined = names.join(known, F.col(column) == F.col("_s"), "left")
    if one_to_many is not None:
        joined = joined.filter(F.col("_n").isNull() | (F.col("_n") <= one_to_many)).drop("_n")
    return _unmapped(joined, column, on_unmapped).drop("_s", "_t")


def _unmapped(joined: DataFrame, column: str, policy: str) -> DataFrame:
    if policy == "drop":
        return joined.filter(F.col("_t").isNotNull()).withColumn("translated", F.col("_t"))
    if policy == "keep":
        return joined.withColumn("translated", F.coalesce("_t", column))
    if policy == "nan":
        return joined.withColumn("translated", F.col("_t"))
    if policy == "raise":
        fail = F.raise_error(F.concat(F.lit("no ortholog of "), F.col(column)))
        return joined.withColumn("translated", F.when(F.col("_t").isNull(), fail).otherwise(F.col("_t")))
    raise ValueError("on_unmapped: drop, keep, nan or raise")


def translate_complexes(names: DataFrame, column: str, ranked: DataFrame) -> DataFrame:
    """`names` with `translated`: `A_B` becomes its subunits' best targets joined again; dropped if one has none."""
    best = ranked.filter("rank = 1").select(F.col("source").alias("_unit"), F.col("target").alias("_t"))
    distinct = names.select(F.col(column).alias("_name")).distinct().select("_name", F.posexplode(F.split("_name", "_")).alias("_k", "_unit"))
    whole = distinct.join(best, "_unit", "left").groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("_k", "_t"))).alias("_ts"), F.count("_t").alias("_n"))
    known = whole.filter(F.col("_n") == F.size("_ts")).select("_name", F.array_join(F.transform("_ts", lambda x: x["_t"]), "_").alias("translated"))
    return names.join(known, F.col(column) == F.col("_name")).drop("_name")


def split_complexes(edges: DataFrame) -> DataFrame:
    """Edges between all subunits of `A_B` names."""
    return edges.withColumn("source", F.explode(F.split("source", "_"))).withColumn("target", F.explode(F.split("target", "_"))).distinct()


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def consensus_signs(rows: DataFrame) -> DataFrame:
    """(source, target, sign) of rows that stimulate or inhibit but not both, each signed edge once; self-loops stay.
    Consensus columns are used where the table has them."""
    pre = "consensus_" if "consensus_stimulation" in rows.columns else "is_"
    up, down = truthy(F.col(f"{pre}stimulation")), truthy(F.col(f"{pre}inhibition"))
    return rows.filter(up != down).select("source", "target", F.when(up, 1).otherwise(-1).alias("sign")).distinct()


def confidence_signs(rows: DataFrame, levels: tuple[str, ...] | None = None, compatibility: bool = False) -> DataFrame:
    """(source, target, sign, confidence) with the level before `;`: -1 where inhibiting, unless stimulating both by
    itself and by consensus. No self-loops; one row a signed edge, the first by row_no, or in compatibility mode one a
    pair, the first by confidence and sign."""
    level = F.substring_index("level", ";", 1)
    up, down, agree = truthy(F.col("is_stimulation")), truthy(F.col("is_inhibition")), truthy(F.col("consensus_stimulation"))
    out = rows.withColumn("confidence", level).withColumn("sign", F.when(down & ~(up & agree), -1).otherwise(1)).filter("source <> target")
    if levels is not None:
        out = out.filter(F.col("confidence").isin(*levels))
    if compatibility:
        return out.groupBy("source", "target").agg(F.min(F.struct("confidence", "sign", "row_no")).alias("f")).select("source", "target", "f.sign", "f.confidence")
    return out.groupBy("source", "target", "sign").agg(F.min_by("confidence", "row_no").alias("confidence")).select("source", "target", "sign", "confidence")


EVIDENCE = "map<string, array<struct<dataset:string, resource:string, references:array<string>, via:string>>>"


def evidence_summary(rows: DataFrame, column: str, dataset: str) -> DataFrame:
    """`rows` with is_directed, is_positive, is_negative, consensus_positive, consensus_negative, resources and
    references of one dataset's evidences (JSON: group -> evidences); rows without any go. An evidence's effort is its
    references and one."""
    parsed = rows.withColumn("_e", F.from_json(column, EVIDENCE))
    of = lambda group: F.filter(F.coalesce(F.try_element_at("_e", F.lit(group)), F.array().cast("array<struct<dataset:string,resource:string,references:array<string>,via:string>>")), lambda x: x["dataset"] == dataset)
    whole = F.filter(F.flatten(F.map_values("_e")), lambda x: x["dataset"] == dataset)
    effort = lambda g: F.aggregate(of(g), F.lit(0), lambda a, x: a + F.coalesce(F.size(x["references"]), F.lit(0)) + 1)
    up, down = effort("positive"), effort("negative")
    out = parsed.withColumn("_all", whole).filter(F.size("_all") > 0)
    return out.withColumns({
        "is_directed": F.size(of("directed")) > 0, "is_positive": up > 0, "is_negative": down > 0, "consensus_positive": up >= down, "consensus_negative": up <= down,
        "resources": F.array_sort(F.array_distinct(F.transform("_all", lambda x: x["resource"]))),
        "references": F.array_sort(F.array_distinct(F.flatten(F.transform("_all", lambda x: F.coalesce(x["references"], F.array().cast("array<string>")))))),
    }).drop("_e", "_all")


def booleanize(levels: DataFrame, most: int) -> DataFrame:
    """(name, component, value): `C_b1` ... `C_bm` of a level from 0 to m, true from their threshold on; m = 1 keeps C."""
    k = F.explode(F.sequence(F.lit(1), F.lit(most)))
    each = levels.select("*", k.alias("_k"))
    component = F.col("component") if most == 1 else F.concat(F.col("component"), F.lit("_b"), F.col("_k").cast("string"))
    return each.select("name", component.alias("component"), (F.col("level") >= F.col("_k")).alias("value"))


def best_mapping(ranked: DataFrame) -> DataFrame:
    """(old, new): each symbol's best ortholog, for relabelling graphs and cubes."""
    return ranked.filter("rank = 1").select(F.col("source").alias("old"), F.col("target").alias("new"))


def translate_edges(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """Signed edges between best orthologs; edges with an unmapped end go, equal ones are one."""
    m = best_mapping(ranked)
    out = edges.join(m.toDF("source", "_s"), "source").join(m.toDF("target", "_t"), "target")
    return out.select(F.col("_s").alias("source"), F.col("_t").alias("target"), "sign").distinct()


def version_at(versions: DataFrame, date: str) -> DataFrame:
    """The version rows (version, start, end) whose interval holds the date; an open end holds all later dates."""
    d = F.to_date(F.lit(date))
    return versions.filter((F.col("start") <= d) & (F.col("end").isNull() | (d <= F.col("end"))))


def network_mapping(components: list[str], mapping: DataFrame) -> dict[str, str]:
    """New names of a network's components by (old, new): a row a component at most. Two that meet are an error."""
    rows = mapping.filter(F.col("old").isin(*components)).collect() if components else []
    out = {r["old"]: r["new"] for r in rows}
    if len({out.get(c, c) for c in components}) < len(components):
        raise ValueError("two components would have one name")
    return out


def alias_mapping(aliases: DataFrame, genes: DataFrame, names: DataFrame, output: str = "symbol") -> DataFrame:
    """(old, new) of the names (column `old`) that mean a gene, for relabelling graphs, cubes and networks."""
    found = convert(names.select("old").distinct(), "old", aliases, genes, output, False)
    return found.filter(F.col("converted").isNotNull()).select("old", F.col("converted").alias("new"))
