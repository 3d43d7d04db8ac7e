"""Queries of what is written and read back, and of names converted in graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions.lineage import scratch
from ..operators import genes as g
from ..operators.dynamics import ExecutableModel, Network
from ..sources import models, readers, writers
from .boolean_queries import _CUBES, _NEXT, RULES, _bit, _cubes, net
from .gene_queries import _ALIAS, _info
from .more_queries import _STOPPED
from .tables import EVENT_X, event_matrix, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TYPES = ("click", "error", "purchase", "signup", "view")
_NUMBERED = f"WITH {EVENT_X}, n AS (SELECT cell AS row, CASE gene {' '.join(f'WHEN {chr(39)}{t}{chr(39)} THEN {k}' for k, t in enumerate(_TYPES))} END AS col, value FROM x)"


def _numbered(spark, sf):
    """Users by event types, numbered; as the file has its numbers as text, values are rounded first."""
    col = F.lit(None).cast("int")
    for k, t in enumerate(_TYPES):
        col = F.when(F.col("gene") == t, k).otherwise(col)
    return event_matrix(spark, sf).select(F.col("cell").alias("row"), col.cast("long").alias("col"), F.round("value", 4).alias("value"))


@query(_NUMBERED + " SELECT row, CAST(col AS BIGINT) AS col, round(value, 4) AS value FROM n")
def matrix_market_round_trip(spark, sf):
    path, x = scratch(spark, "mtx"), _numbered(spark, sf)
    size = x.agg(F.max("row").alias("r")).first()["r"]
    writers.write_mtx(x, path, int(size) + 1, len(_TYPES))
    return readers.read_mtx(spark, path)


@query(_NUMBERED + " SELECT row, CAST(col AS BIGINT) AS col, round(value, 4) AS value FROM n")
def coordinate_round_trip(spark, sf):
    path = scratch(spark, "coordinates")
    writers.write_coordinates(_numbered(spark, sf), path)
    return spark.read.parquet(path)


@query(f"WITH {EVENT_X} SELECT CAST(cell AS VARCHAR) AS cell, " + ", ".join(f"round(coalesce(sum(value) FILTER (WHERE gene = '{t}'), 0), 4) AS {t}" for t in _TYPES) + " FROM x GROUP BY 1")
def csv_round_trip(spark, sf):
    path = scratch(spark, "csv")
    writers.write_csv(event_matrix(spark, sf), path, list(_TYPES))
    return spark.read.option("header", True).csv(path).select("cell", *[F.round(F.col(t).cast("double"), 4).alias(t) for t in _TYPES])


def _named_edges(spark, sf):
    """Brands to the first words of part names, negative for small parts: both are names of genes."""
    part = read(spark, sf, "part")
    return part.select(F.lower("p_brand").alias("source"), F.split("p_name", " ")[0].alias("target"), F.when(F.col("p_size") < 10, -1).otherwise(1).alias("sign"))


_EDGES = "e AS (SELECT lower(p_brand) AS source, split_part(p_name, ' ', 1) AS target, CASE WHEN p_size < 10 THEN -1 ELSE 1 END AS sign FROM part)"


@query(f"WITH {_ALIAS}, {_EDGES}, k AS (SELECT fd.key, CASE WHEN p_size % 10 = 0 THEN '-' ELSE p_name END AS symbol FROM fd JOIN part ON CAST(p_partkey AS VARCHAR) = fd.gene_id) SELECT DISTINCT coalesce(a.symbol, source) AS source, coalesce(b.symbol, target) AS target, sign FROM e LEFT JOIN k a ON a.key = upper(source) LEFT JOIN k b ON b.key = upper(target)")
def convert_graph(spark, sf):
    info = _info(spark, sf)
    return g.convert_edges(_named_edges(spark, sf), g.alias_table(info), info)


@query(f"WITH {_ALIAS}, n AS (SELECT p_partkey, p_type AS name FROM part UNION ALL SELECT p_partkey, p_brand FROM part) SELECT p_partkey, name, fd.key IS NOT NULL AS known FROM n LEFT JOIN fd ON fd.key = upper(name)")
def contains_identifiers(spark, sf):
    part = read(spark, sf, "part")
    names = part.select("p_partkey", F.col("p_type").alias("name")).union(part.select("p_partkey", "p_brand"))
    return g.contains(names, "name", g.alias_table(_info(spark, sf))).select("p_partkey", "name", "known")


@query("WITH e AS (SELECT p_brand || '_' || p_type AS source, 'S' || p_size || '_' || p_brand AS target, CASE WHEN p_size < 10 THEN -1 ELSE 1 END AS sign FROM part) SELECT DISTINCT s AS source, t AS target, sign FROM e, unnest(string_split(source, '_')) AS x(s), unnest(string_split(target, '_')) AS y(t)")
def split_complexes(spark, sf):
    part = read(spark, sf, "part")
    sign = F.when(F.col("p_size") < 10, -1).otherwise(1)
    edges = part.select(F.concat_ws("_", "p_brand", "p_type").alias("source"), F.concat(F.lit("S"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_brand")).alias("target"), sign.alias("sign"))
    return g.split_complexes(edges)


@query("WITH e AS (SELECT DISTINCT lower(p_brand) AS source, split_part(p_name, ' ', 1) AS target, CASE WHEN p_size < 10 THEN -1 ELSE 1 END AS sign FROM part) SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target, sign FROM e")
def undirected_graph(spark, sf):
    from ..operators import graphs

    return graphs.to_undirected(graphs.to_directed(_named_edges(spark, sf)))


def _counts(network) -> list[tuple[str, int]]:
    """States on which each rule holds."""
    return [(c, int(r.table(t, network.components).sum())) for c, t in network.rules.items()]


def _counts_sql(rules: dict[str, str], names: dict[str, str] | None = None) -> str:
    order = tuple(rules)
    each = (f"SELECT '{(names or {}).get(c, c)}' AS component, count(*) FILTER (WHERE {r.to_sql(r.parse(t), lambda v: _bit(v, 's', order))}) AS ones FROM st" for c, t in rules.items())
    return f"WITH st AS (SELECT range AS s FROM range(0, {1 << len(rules)})) " + " UNION ALL ".join(each)


def _rows(spark, network):
    return spark.createDataFrame(_counts(network), "component string, ones long")


_WORDY = {"A": "(A & ~A) | B & B", "B": "~(~A) & (A | C)", "C": "(C | ~C) & D", "D": "A ^ 0"}
_RENAMED = {"A": "first", "D": "last"}


@query(_counts_sql(RULES))
def bnet_round_trip(spark, sf):
    path = scratch(spark, "network") + ".bnet"
    writers.write_bnet(net().frame(spark), path)
    back = {x["component"]: x["rule"] for x in readers.read_bnet(spark, path).collect()}
    return _rows(spark, Network({c: back[c] for c in RULES}))


@query(_counts_sql(RULES))
def ginml_round_trip(spark, sf):
    path = scratch(spark, "model")
    spark.createDataFrame([(writers.graph_xml(net()).decode(),)], "value string").coalesce(1).write.text(path)
    back = models.read_ginml(spark, f"{path}/part-*")
    return _rows(spark, Network({c: back.rules[c] for c in RULES}))


@query("SELECT * FROM (VALUES ('open', 'Z'), ('open', 'Y')) AS t(network, symbol)")
def network_symbols(spark, sf):
    rows = [("open", "A", "B & ~Z"), ("open", "B", "Y | A | True"), ("closed", "A", "B"), ("closed", "B", "1")]
    return readers.validate_network(spark.createDataFrame(rows, "network string, component string, rule string"))


@query(_counts_sql(_WORDY))
def network_simplify(spark, sf):
    return _rows(spark, Network(_WORDY).simplify())


@query(_counts_sql(RULES, _RENAMED))
def network_relabel(spark, sf):
    mapping = spark.createDataFrame(list(_RENAMED.items()), "old string, new string")
    return _rows(spark, net().relabel(g.network_mapping(net().components, mapping)))


@query(f"WITH {_EDGES} SELECT DISTINCT source, target, sign FROM e")
def edge_file_round_trip(spark, sf):
    path = scratch(spark, "edges")
    _named_edges(spark, sf).distinct().write.option("header", True).csv(path)
    return readers.read_influence_graph(spark, path)


@query(f"WITH {_EDGES} SELECT DISTINCT source, target, sign FROM e UNION ALL SELECT n_name, r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey")
def edge_additions(spark, sf):
    from ..operators import graphs

    n, other = read(spark, sf, "nation"), read(spark, sf, "region")
    new = n.join(other, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit(1).alias("sign"))
    return graphs.add_edges(_named_edges(spark, sf).distinct(), new)


@query(f"WITH {_CUBES}, n AS (SELECT DISTINCT cell FROM c) SELECT CAST(n.cell AS VARCHAR) AS name, t.component, c.value FROM n CROSS JOIN (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in _TYPES)}) AS t(component) LEFT JOIN c ON c.cell = n.cell AND c.component = t.component")
def hypercube_file_round_trip(spark, sf):
    path = scratch(spark, "cubes")
    text = F.when(F.col("value"), "1").when(~F.col("value"), "0").otherwise("*")
    wide = _cubes(spark, sf).select("cell", "component", text.alias("v")).groupBy("cell").pivot("component", list(_TYPES)).agg(F.max("v"))
    wide.withColumnRenamed("cell", "name").write.option("header", True).csv(path)
    return readers.read_hypercubes(spark, path, "rows")


@query("SELECT CAST(p_partkey AS VARCHAR) AS gene_id, CASE WHEN p_size % 10 = 0 THEN '-' ELSE p_name END AS symbol, p_brand AS synonyms, CASE WHEN p_size > 25 THEN 'E' || p_partkey END AS ensembl_id, CAST(p_size AS VARCHAR) AS mgi, p_type AS gene_type FROM part")
def gene_info_round_trip(spark, sf):
    path, part = scratch(spark, "genes"), read(spark, sf, "part")
    size = F.col("p_size").cast("string")
    refs = F.concat(F.lit("MGI:"), size, F.when(F.col("p_size") > 25, F.concat(F.lit("|Ensembl:E"), F.col("p_partkey").cast("string"))).otherwise(""))
    symbol = F.when(F.col("p_size") % 10 == 0, "-").otherwise(F.col("p_name"))
    part.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), symbol, F.col("p_name"), F.col("p_brand"), refs, F.lit("1"), F.col("p_type"))).write.text(path)
    info = readers.read_gene_info(spark, path)
    return info.select("gene_id", "symbol", F.array_join("synonyms", "|").alias("synonyms"), "ensembl_id", F.try_element_at("databases", F.lit("MGI")).alias("mgi"), "gene_type")


@query(f"WITH RECURSIVE {_STOPPED}, {_NEXT['asynchronous']}, rc(s) AS (SELECT s FROM st WHERE (s & 15) = 5 UNION SELECT nx.t FROM rc JOIN nx ON nx.s = rc.s) SELECT s AS state FROM rc")
def executable_model_reachable(spark, sf):
    model = ExecutableModel(net(), {"start": {"A": True, "B": False, "C": True, "D": False}}, {"H": False})
    return model.reachable(spark, "start", "asynchronous")
