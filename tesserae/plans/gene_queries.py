"""Queries of the reference-table joins on parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genes as g
from .tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _info(spark, sf):
    """Parts as gene rows: many share a symbol, brands and types are synonyms, sizes give the gene type."""
    size = F.col("p_size")
    kind = F.when(size > 40, "protein-coding").when(size > 30, "ncRNA").when(size > 15, "pseudo").otherwise("unknown")
    symbol = F.when(size % 10 == 0, "-").otherwise(F.col("p_name"))
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("row_no"), F.col("p_partkey").cast("string").alias("gene_id"), symbol.alias("symbol"), F.concat(F.col("p_name"), F.lit("."), size.cast("string")).alias("ncbi_symbol"),
        F.array("p_brand", F.split("p_name", " ")[0]).alias("synonyms"), kind.alias("gene_type"),
    )


#: The same names resolved one event at a time, as the file is read: a fold over each name's ordered events.
_ALIAS = """i AS (SELECT p_partkey AS row_no, CAST(p_partkey AS VARCHAR) AS gene_id, CASE WHEN p_size % 10 = 0 THEN p_name || '.' || p_size ELSE p_name END AS symbol, p_name || '.' || p_size AS ncbi, p_brand AS s1, split_part(p_name, ' ', 1) AS s2,
 CASE WHEN p_size > 40 THEN 100 WHEN p_size > 30 THEN 80 WHEN p_size > 15 THEN 0 ELSE 20 END AS p FROM part),
ev AS (SELECT upper(symbol) AS key, gene_id, p, row_no * 10 AS pos, true AS main FROM i UNION ALL SELECT upper(s1), gene_id, p, row_no * 10 + 1, false FROM i WHERE upper(s1) <> upper(symbol) UNION ALL SELECT upper(s2), gene_id, p, row_no * 10 + 2, false FROM i WHERE upper(s2) <> upper(symbol) UNION ALL SELECT upper(ncbi), gene_id, p, row_no * 10 + 3, false FROM i WHERE upper(ncbi) <> upper(symbol)),
fd AS (SELECT key, list_reduce(list_prepend({'g': '', 'p': -2, 'm': false, 'x': false}, list({'g': gene_id, 'p': p, 'm': main, 'x': main AND p > 0} ORDER BY pos)),
 lambda a, e: CASE WHEN e.m THEN {'g': e.g, 'p': e.p, 'm': true, 'x': a.x OR e.x} WHEN a.x THEN a WHEN e.p > a.p THEN {'g': e.g, 'p': e.p, 'm': a.m, 'x': a.x} ELSE a END).g AS gene_id FROM ev GROUP BY key)"""


@query(f"WITH {_ALIAS} SELECT key, gene_id FROM fd")
def gene_alias_resolution(spark, sf):
    return g.alias_table(_info(spark, sf))


def _converted(spark, sf, keep):
    info = _info(spark, sf)
    names = read(spark, sf, "part").select("p_partkey", F.lower("p_brand").alias("name")).union(read(spark, sf, "supplier").select("s_suppkey", "s_name"))
    return g.convert(names, "name", g.alias_table(info), info, "ncbi_symbol", keep)


@query(f"WITH {_ALIAS}, n AS (SELECT p_partkey, lower(p_brand) AS name FROM part UNION ALL SELECT s_suppkey, s_name FROM supplier) SELECT n.p_partkey, n.name, coalesce(i.ncbi, n.name) AS converted FROM n LEFT JOIN fd ON fd.key = upper(n.name) LEFT JOIN i ON i.gene_id = fd.gene_id")
def convert_identifiers(spark, sf):
    return _converted(spark, sf, True)


@query(f"WITH {_ALIAS}, n AS (SELECT p_partkey, lower(p_brand) AS name FROM part UNION ALL SELECT s_suppkey, s_name FROM supplier) SELECT n.p_partkey, n.name, i.ncbi AS converted FROM n LEFT JOIN fd ON fd.key = upper(n.name) LEFT JOIN i ON i.gene_id = fd.gene_id")
def convert_identifiers_strict(spark, sf):
    return _converted(spark, sf, False)


@query("SELECT p_partkey, regexp_matches(lower(p_name), '^(red|blue)') AS flag FROM part")
def flag_gene_sets(spark, sf):
    from ..operators.matrix import flag_genes

    part = read(spark, sf, "part")
    var = part.select("p_partkey", F.col("p_partkey").cast("string").alias("gene"))
    ids = part.select(F.col("p_partkey").cast("string").alias("alias"), F.lower("p_name").alias("symbol"))
    return flag_genes(var, ids, "^(red|blue)", "symbol", "flag").select("p_partkey", "flag")


_HCOP = "h0 AS (SELECT p_brand AS source, 'T' || s_nationkey AS target, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',') AS support, count(DISTINCT l_linenumber) AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand, s_suppkey, s_nationkey), h AS (SELECT * FROM h0 WHERE evidence >= 3)"


def _hcop(spark, sf):
    line, part, supplier = (read(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    rows = joined.groupBy(F.col("p_brand").alias("source"), "s_suppkey", F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("target")).agg(F.array_join(F.collect_set(F.col("l_linenumber").cast("string")), ",").alias("support"))
    return g.supported(rows.drop("s_suppkey"))


_RANKED = f"{_HCOP}, r AS (SELECT source, target, max(evidence) AS evidence, count(*) AS frequency, row_number() OVER (PARTITION BY source ORDER BY max(evidence) DESC, count(*) DESC, target) AS rank FROM h GROUP BY 1, 2)"


@query(f"WITH {_RANKED} SELECT * FROM r")
def ortholog_rank(spark, sf):
    return g.ranked_orthologs(_hcop(spark, sf))


_HCOP2 = "k0 AS (SELECT p_brand AS source, 'S' || CAST(floor(p_size / 11) AS INTEGER) AS target, count(DISTINCT l_linenumber) AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, floor(p_size / 11), p_type), k AS (SELECT * FROM k0 WHERE evidence >= 3)"


def _hcop2(spark, sf):
    """Brands and five classes of sizes, one row a type, supported by line numbers."""
    line, part = read(spark, sf, "lineitem"), read(spark, sf, "part")
    size = F.concat(F.lit("S"), F.floor(F.col("p_size") / 11).cast("string"))
    rows = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("source"), size.alias("target"), "p_type").agg(F.array_join(F.collect_set(F.col("l_linenumber").cast("string")), ",").alias("support"))
    return g.supported(rows.drop("p_type"))


@query(f"WITH {_HCOP}, {_HCOP2}, a AS (SELECT source AS via, target AS source, max(evidence) AS e FROM h GROUP BY 1, 2), b AS (SELECT source AS via, target, max(evidence) AS e FROM k GROUP BY 1, 2) SELECT source, target, via, least(a.e, b.e) AS evidence, max(least(a.e, b.e)) OVER (PARTITION BY source, target) AS best_evidence, count(*) OVER (PARTITION BY source, target) AS paths FROM a JOIN b USING (via)")
def ortholog_bridge(spark, sf):
    return g.bridge(_hcop(spark, sf), _hcop2(spark, sf))


@query(f"WITH {_HCOP2}, r AS (SELECT DISTINCT source, target FROM k), n AS (SELECT source, count(*) AS n FROM r GROUP BY 1) SELECT p_partkey, p_brand AS name, r.target AS translated FROM part JOIN n ON n.source = p_brand AND n.n <= 5 JOIN r ON r.source = p_brand")
def translate_one_to_many(spark, sf):
    names = read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("name"))
    return g.translate(names, "name", g.ranked_orthologs(_hcop2(spark, sf)), one_to_many=5)


@query(f"WITH {_RANKED}, x AS (SELECT p_partkey, p_brand AS a, CASE WHEN p_size < 5 THEN 'none' ELSE 'Brand#' || (1 + p_size % 25) END AS b FROM part) SELECT p_partkey, a || '_' || b AS name, u.target || '_' || v.target AS translated FROM x JOIN r u ON u.source = a AND u.rank = 1 JOIN r v ON v.source = b AND v.rank = 1")
def translate_complexes(spark, sf):
    other = F.when(F.col("p_size") < 5, "none").otherwise(F.concat(F.lit("Brand#"), (1 + F.col("p_size") % 25).cast("string")))
    names = read(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("_"), other).alias("name"))
    return g.translate_complexes(names, "name", g.ranked_orthologs(_hcop(spark, sf)))


def _regulations(spark, sf):
    line, part, supplier = (read(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    flag = lambda c: F.when(c, "True").otherwise("no")
    return joined.select(
        F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("source"), F.col("p_brand").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        flag(F.col("l_returnflag") == "A").alias("is_stimulation"), flag((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "O")).alias("is_inhibition"), flag(F.col("l_discount") > 0.05).alias("consensus_stimulation"),
        flag(F.col("l_tax") > 0.04).alias("consensus_inhibition"), F.concat(F.when(F.col("l_quantity") > 40, "A").when(F.col("l_quantity") > 20, "B").otherwise("C"), F.lit(";x")).alias("level"),
    )


_REG = "g AS (SELECT 'Brand#' || (s_nationkey + 1) AS source, p_brand AS target, l_orderkey * 10 + l_linenumber AS row_no, l_returnflag = 'A' AS up, l_returnflag = 'R' OR l_linestatus = 'O' AS down, l_discount > 0.05 AS cup, l_tax > 0.04 AS cdown, CASE WHEN l_quantity > 40 THEN 'A' WHEN l_quantity > 20 THEN 'B' ELSE 'C' END AS level FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"WITH {_REG} SELECT DISTINCT source, target, CASE WHEN cup THEN 1 ELSE -1 END AS sign FROM g WHERE cup <> cdown")
def regulon_signs(spark, sf):
    return g.consensus_signs(_regulations(spark, sf))


_SIGNED = f"{_REG}, s AS (SELECT *, CASE WHEN down AND NOT (up AND cup) THEN -1 ELSE 1 END AS sign FROM g WHERE source <> target AND level IN ('A', 'B'))"


@query(f"WITH {_SIGNED} SELECT source, target, sign, arg_min(level, row_no) AS confidence FROM s GROUP BY 1, 2, 3")
def regulon_dedup(spark, sf):
    return g.confidence_signs(_regulations(spark, sf), ("A", "B"))


@query(f"WITH {_SIGNED}, k AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY level, sign, row_no) AS k FROM s) SELECT source, target, sign, level AS confidence FROM k WHERE k = 1")
def regulon_dedup_compatible(spark, sf):
    return g.confidence_signs(_regulations(spark, sf), ("A", "B"), True)


@query("""WITH e AS (SELECT user_id, CASE WHEN value > 60 THEN 'positive' WHEN value > 20 THEN 'negative' ELSE 'directed' END AS grp, event_type AS resource, CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'main' END AS dataset, CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS refs FROM events)
SELECT user_id, bool_or(grp = 'directed') AS is_directed, bool_or(grp = 'positive') AS is_positive, bool_or(grp = 'negative') AS is_negative,
 coalesce(sum(refs + 1) FILTER (WHERE grp = 'positive'), 0) >= coalesce(sum(refs + 1) FILTER (WHERE grp = 'negative'), 0) AS consensus_positive, coalesce(sum(refs + 1) FILTER (WHERE grp = 'positive'), 0) <= coalesce(sum(refs + 1) FILTER (WHERE grp = 'negative'), 0) AS consensus_negative,
 count(DISTINCT resource) AS n_resources, max(refs) AS n_references FROM e WHERE dataset = 'main' GROUP BY 1""")
def regulon_evidence_json(spark, sf):
    e = read(spark, sf, "events")
    group = F.when(F.col("value") > 60, "positive").when(F.col("value") > 20, "negative").otherwise("directed")
    refs = F.get_json_object("props", "$.k").cast("int") % 4
    one = F.struct(F.when(F.col("event_id") % 3 == 0, "other").otherwise("main").alias("dataset"), F.col("event_type").alias("resource"), F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), 1, refs), lambda i: i.cast("string")).alias("references"))
    grouped = e.groupBy("user_id", group.alias("grp")).agg(F.collect_list(one).alias("list")).groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("grp", "list")))).alias("evidences"))
    out = g.evidence_summary(grouped, "evidences", "main")
    return out.select("user_id", "is_directed", "is_positive", "is_negative", "consensus_positive", "consensus_negative", F.size("resources").cast("long").alias("n_resources"), F.size("references").alias("n_references"))


@query("SELECT p_partkey AS name, p_brand || '_b' || k AS component, least(p_size // 10, 4) >= k AS value FROM part, range(1, 5) t(k)")
def threshold_booleanize(spark, sf):
    levels = read(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("component"), F.least(F.floor(F.col("p_size") / 10), F.lit(4)).alias("level"))
    return g.booleanize(levels, 4)
