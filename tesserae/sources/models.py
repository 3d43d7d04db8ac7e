"""Readers of XML models (SBML-qual and GINML) into Boolean networks.

Model files are small documents that become rules on the driver; they are fetched through Spark's readers, so any
store that Spark reads will do. Levels above 1 are booleanised: component C of greatest level m becomes C_b1 ... C_bm.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import SparkSession

from ..operators.dynamics import ExecutableModel, Network


def _bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one file expected")
    return bytes(rows[0]["content"])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(node, name: str, default=None):
    return next((v for k, v in node.attrib.items() if _local(k) == name), default)


def _find(node, name: str) -> list:
    return [x for x in node.iter() if _local(x.tag) == name]


def names_of(ids: list[str]) -> dict[str, str]:
    """Identifiers fit for rules; two that become alike are an error."""
    out = {}
    for i in ids:
        n = re.sub(r"[^A-Za-z0-9_]", "_", i)
        out[i] = f"_{n}" if not n or n[0].isdigit() else n
    if len(set(out.values())) < len(out):
        raise ValueError("two components would have one name")
    return out


class Levels:
    """Names and greatest levels of components, and the rule text for a level reaching a threshold."""

    def __init__(self, most: dict[str, int]):
        self.most, self.names = most, names_of(list(most))

    def at(self, component: str, threshold: int) -> str:
        if component not in self.most:
            raise ValueError(f"unknown component {component}")
        if threshold <= 0:
            return "1"
        if threshold > self.most[component]:
            return "0"
        name = self.names[component]
        return name if self.most[component] == 1 else f"{name}_b{threshold}"

    def exactly(self, component: str, level: int) -> str:
        """All thresholds up to the level hold and the next does not; states that skip a threshold have no level."""
        parts = [self.at(component, k) for k in range(1, level + 1)]
        if level < self.most[component]:
            parts.append(f"~{self.at(component, level + 1)}")
        return " & ".join(parts)

    def between(self, component: str, low: int, high: int) -> str:
        low, high = max(low, 0), min(high, self.most[component])
        if low == 0 and high == self.most[component]:
            return "1"
        return " | ".join(f"({self.exactly(component, v)})" for v in range(low, high + 1)) or "0"

    def network(self, desired: dict[str, dict[int, str]], inputs: set[str]) -> Network:
        """Rules per threshold. An input keeps its value. With several levels, C_bk holds if the levels below hold and the
        rule asks for it, or if the level above and all below it still hold, so that levels are left one at a time."""
        rules = {}
        for c, m in self.most.items():
            for k in range(1, m + 1):
                own = self.at(c, k)
                if c in inputs:
                    rules[own] = " & ".join(self.at(c, j) for j in range(1, k + 1))
                elif m == 1:
                    rules[own] = desired[c][k]
                else:
                    below = "".join(f"{self.at(c, j)} & " for j in range(1, k))
                    still = " & ".join(self.at(c, j) for j in range(1, k + 2)) if k < m else "0"
                    rules[own] = f"({below}({desired[c][k]})) | ({still})"
        return Network(rules)


def _math(node, levels: Levels) -> str:
    """Rule text of a MathML condition on levels; a comparison is spelled out over the levels that meet it."""
    tag = _local(node.tag)
    if tag == "math":
        return _math(list(node)[0], levels)
    if tag in ("true", "false"):
        return "1" if tag == "true" else "0"
    if tag != "apply":
        raise ValueError(f"MathML element {tag} is not supported")
    op, *args = list(node)
    op = _local(op.tag)
    if op in ("and", "or"):
        parts = [f"({_math(a, levels)})" for a in args]
        return (" & " if op == "and" else " | ").join(parts) or ("1" if op == "and" else "0")
    if op == "not":
        return f"~({_math(args[0], levels)})"
    if op == "xor":
        return " ^ ".join(f"({_math(a, levels)})" for a in args)
    tests = {"eq": int.__eq__, "neq": int.__ne__, "lt": int.__lt__, "leq": int.__le__, "gt": int.__gt__, "geq": int.__ge__}
    if op not in tests or len(args) != 2:
        raise ValueError(f"MathML operator {op} is not supported")
    sides = [(_local(a.tag), (a.text or "").strip()) for a in args]
    values = [range(levels.most[t] + 1) if tag == "ci" else [int(float(t))] for tag, t in sides]
    terms = []
    for pair in itertools.product(*values):
        if tests[op](*pair):
            terms.append(" & ".join(f"({levels.exactly(t, v)})" for (tag, t), v in zip(sides, pair, strict=True) if tag == "ci") or "1")
    return " | ".join(f"({t})" for t in terms) or "0"


def parse_sbml(data: bytes) -> Network:
    """SBML Level 3 with qualitative models: one transition a species, assignment effects only."""
    root = ElementTree.fromstring(data)
    if _attr(root, "level") != "3":
        raise ValueError("SBML level 3 expected")
    species = {_attr(s, "id"): s for s in _find(root, "qualitativeSpecies")}
    if not species:
        raise ValueError("no qualitative species")
    levels = Levels({i: int(_attr(s, "maxLevel", "1")) for i, s in species.items()})
    desired: dict[str, dict[int, str]] = {}
    for t in _find(root, "transition"):
        terms = [(int(_attr(f, "resultLevel")), _math(next(x for x in f.iter() if _local(x.tag) == "math"), levels)) for f in _find(t, "functionTerm")]
        default = int(_attr(next(iter(_find(t, "defaultTerm"))), "resultLevel", "0"))
        for out in _find(t, "output"):
            if _attr(out, "transitionEffect", "assignmentLevel") != "assignmentLevel":
                raise ValueError("only assignmentLevel effects are supported")
            c = _attr(out, "qualitativeSpecies")
            if c in desired:
                raise ValueError(f"two transitions set {c}")
            desired[c] = {}
            for k in range(1, levels.most[c] + 1):
                parts = [f"({m})" for level, m in terms if level >= k]
                if default >= k:
                    parts.append("~(" + (" | ".join(f"({m})" for _, m in terms) or "0") + ")")
                desired[c][k] = " | ".join(parts) or "0"
    inputs = {i for i, s in species.items() if _attr(s, "constant") == "true" or i not in desired}
    return levels.network(desired, inputs)


def parse_ginml(data: bytes) -> Network:
    """GINML regulatory graphs: explicit expressions, logical parameters as contexts over all incoming interactions, and
    a base value where nothing is active."""
    root = ElementTree.fromstring(data)
    nodes = {_attr(n, "id"): n for n in _find(root, "node")}
    levels = Levels({i: int(_attr(n, "maxvalue", "1")) for i, n in nodes.items()})
    incoming: dict[str, list] = {i: [] for i in nodes}
    for e in _find(root, "edge"):
        source, target = _attr(e, "from"), _attr(e, "to")
        low = int(_attr(e, "minvalue", "1"))
        high = int(_attr(e, "maxvalue", str(levels.most[source])))
        incoming[target].append((_attr(e, "id"), f"({levels.between(source, low, levels.most[source] if high < 0 else high)})"))
    desired: dict[str, dict[int, str]] = {}
    inputs = set()
    for i, n in nodes.items():
        if _attr(n, "input") == "true":
            inputs.add(i)
            continue
        values = [(int(_attr(v, "val")), [_expression(_attr(x, "str", ""), levels) for x in _find(v, "exp")]) for v in _find(n, "value")]
        contexts = []
        for p in _find(n, "parameter"):
            active = set((_attr(p, "idActiveInteractions") or "").split())
            contexts.append((int(_attr(p, "val", "1")), " & ".join(rule if e in active else f"~{rule}" for e, rule in incoming[i]) or "1"))
        base = int(_attr(n, "basevalue", "0"))
        if incoming[i] and not any(x for _, x in values) and base and not any(c == " & ".join(f"~{r}" for _, r in incoming[i]) for _, c in contexts):
            contexts.append((base, " & ".join(f"~{rule}" for _, rule in incoming[i])))
        desired[i] = {}
        for k in range(1, levels.most[i] + 1):
            rule = " | ".join(f"({x})" for v, xs in values if v >= k for x in xs) or "0"
            for v, c in contexts:
                rule = f"({rule}) | ({c})" if v >= k else f"({rule}) & ~({c})"
            desired[i][k] = rule
        if not incoming[i] and not values and not contexts:
            desired[i] = {k: "1" if base >= k else "0" for k in desired[i]}
    return levels.network(desired, inputs)


def _expression(text: str, levels: Levels) -> str:
    """`!` for not; `C:2` for a level of at least 2."""
    at = lambda m: levels.at(m[1], int(m[2] or 1))
    return re.sub(r"([A-Za-z_][\w.\-]*)(?::(\d+))?", at, text.replace("!", "~"))


def read_sbml(spark: SparkSession, path: str) -> Network:
    return parse_sbml(_bytes(spark, path))


def read_ginml(spark: SparkSession, path: str) -> Network:
    return parse_ginml(_bytes(spark, path))


def read_zginml(spark: SparkSession, path: str) -> Network:
    """The GINML document inside a ZGINML archive."""
    with zipfile.ZipFile(io.BytesIO(_bytes(spark, path))) as z:
        found = [n for n in z.namelist() if n.endswith(".ginml")]
        if len(found) != 1:
            raise ValueError("one .ginml in the archive expected")
        return parse_ginml(z.read(found[0]))


def read_model(spark: SparkSession, path: str) -> ExecutableModel:
    """A ZGINML archive with its named initial conditions (Boolean components only; levels above 1 are read as true)."""
    data = _bytes(spark, path)
    network = read_zginml(spark, path)
    initial: dict[str, dict[str, bool]] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if not name.endswith("initialState"):
                continue
            for k, s in enumerate(_find(ElementTree.fromstring(z.read(name)), "initialState")):
                pairs = [p.split(";") for p in (_attr(s, "value", "") or "").split()]
                initial[_attr(s, "name", f"state{k}")] = {c: int(v) > 0 for c, v in pairs if c in network.order}
    return ExecutableModel(network, initial)
