"""Writers: CSV, Matrix Market, coordinate Parquet, `.bnet` and DOT text."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dynamics import ExecutableModel, Network
from ..operators.graphs import dot_rows
from ..operators.matrix import to_wide


def write_csv(x: DataFrame, path: str, genes: list[str]) -> None:
    """A row a cell, a column a listed gene."""
    to_wide(x, genes).write.option("header", True).csv(path)


def write_mtx(x: DataFrame, path: str, n_rows: int, n_cols: int) -> None:
    """Matrix Market text of 0-based (row, col, value), in order of rows; parts in order make the file, the first
    begins with the header."""
    count = x.count()
    spark = x.sparkSession
    head = spark.createDataFrame([(-2, -1, "%%MatrixMarket matrix coordinate real general"), (-1, -1, f"{n_rows} {n_cols} {count}")], "row long, col long, value string")
    body = x.select("row", "col", F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("value").cast("string")).alias("value"))
    head.union(body).repartitionByRange("row", "col").sortWithinPartitions("row", "col").select("value").write.text(path)


def write_coordinates(x: DataFrame, path: str) -> None:
    """Coordinate Parquet sorted by row, the scalable form of a sparse archive."""
    x.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.parquet(path)


def write_bnet(rules: DataFrame, path: str) -> None:
    """`component, rule` lines."""
    rules.select(F.concat_ws(", ", "component", "rule")).write.text(path)


def bnet_text(network: Network) -> str:
    from ..functions.rules import to_text

    return "".join(f"{c}, {to_text(t)}\n" for c, t in network.rules.items())


def write_dot(edges: DataFrame, path: str) -> None:
    """Edge lines of a drawing."""
    dot_rows(edges).write.text(path)


#: Programs that read rules in the `.bnet` form, and whether they write negation as `!`.
PROGRAMS = {"biolqm": True, "minibn": True, "mpbn": True, "pyboolnet": True}


def exchange_text(network: Network, program: str) -> str:
    """The network as another program reads it."""
    if program not in PROGRAMS:
        raise ValueError(f"program: one of {sorted(PROGRAMS)}")
    text = bnet_text(network)
    return text.replace("~", "!") if PROGRAMS[program] else text


def graph_xml(network: Network) -> bytes:
    """GINML: a node with its rule for each component, an edge for each component that a rule depends on."""
    from ..functions import rules as r

    root = ElementTree.Element("gxl")
    graph = ElementTree.SubElement(root, "graph", {"id": "model", "class": "regulatory", "nodeorder": " ".join(network.components)})
    for c, tree in network.rules.items():
        node = ElementTree.SubElement(graph, "node", {"id": c, "maxvalue": "1"})
        if tree == ("var", c):
            node.set("input", "true")
            continue
        if tree[0] == "const":
            node.set("basevalue", str(int(tree[1])))
        value = ElementTree.SubElement(node, "value", {"val": "1"})
        ElementTree.SubElement(value, "exp", {"str": r.to_text(_plain(tree)).replace("~", "!")})
    for c, tree in network.rules.items():
        for s, found in r.signs(tree).items():
            kind = {(1,): "positive", (-1,): "negative"}.get(tuple(sorted(found)), "dual")
            ElementTree.SubElement(graph, "edge", {"id": f"{s}:{c}", "from": s, "to": c, "minvalue": "1", "sign": kind})
    return ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)


def _plain(tree: tuple) -> tuple:
    """The rule without exclusive or, which GINML expressions lack."""
    if tree[0] in ("var", "const"):
        return tree
    parts = [_plain(t) for t in tree[1:]]
    if tree[0] == "xor":
        a, b = parts
        return ("or", ("and", a, ("not", b)), ("and", ("not", a), b))
    return (tree[0], *parts)


def zginml_bytes(model: ExecutableModel) -> bytes:
    """A ZGINML archive: the network as it runs (perturbations are in its rules), and the named initial conditions."""
    states = ElementTree.Element("initialStates")
    for name, given in model.initial.items():
        ElementTree.SubElement(states, "initialState", {"name": name, "value": " ".join(f"{c};{int(v)}" for c, v in given.items())})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("GINsim-data/regulatoryGraph.ginml", graph_xml(model.network))
        z.writestr("GINsim-data/initialState", ElementTree.tostring(states, encoding="utf-8", xml_declaration=True))
    return out.getvalue()


def save_model(model: ExecutableModel, path: str) -> None:
    """Writes the archive to a file of the driver's machine: models are small documents that people pass on."""
    if not path.endswith(".zginml"):
        raise ValueError("a .zginml file expected")
    with open(path, "wb") as f:
        f.write(zginml_bytes(model))
