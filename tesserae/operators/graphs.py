"""Signed influence graphs as edge tables (source, target, sign in {-1, 1}), at most one row a (source, target, sign)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.lineage import settled

#: Graphs of at most so many edges are walked on the driver, where rounds cost no jobs; larger ones on the cluster.
DRIVER_EDGES = 50_000


def normalized_sign(c: Column) -> Column:
    """1 for 1, +, positive; -1 for -1, -, negative; null for anything else, booleans included."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("1", "+1", "1.0", "+", "positive"), 1).when(s.isin("-1", "-1.0", "-", "negative"), -1)


def from_table(df: DataFrame, source: str = "source", target: str = "target", sign: str = "sign") -> DataFrame:
    """Edges of a table; rows without a sign go, and a repeated signed edge is an error."""
    edges = df.select(F.col(source).alias("source"), F.col(target).alias("target"), normalized_sign(F.col(sign)).alias("sign"), *[c for c in df.columns if c not in (source, target, sign)])
    edges = edges.filter(F.col("sign").isNotNull())
    twice = edges.groupBy("source", "target", "sign").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("a signed edge occurs twice")
    return edges


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with nodes renamed by (old, new); edges that become equal are one."""
    m = lambda c: mapping.select(F.col("old").alias(c), F.col("new").alias(f"_{c}"))
    out = edges.select("source", "target", "sign").join(m("source"), "source", "left").join(m("target"), "target", "left")
    return out.select(F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target"), "sign").distinct()


def edge_sign(edges: DataFrame) -> DataFrame:
    """(source, target, sign): the common sign of the parallel edges, 0 where they differ."""
    return edges.groupBy("source", "target").agg(F.when(F.min("sign") == F.max("sign"), F.min("sign")).otherwise(0).alias("sign"))


def autoregulations(edges: DataFrame, sign: int | None = None) -> DataFrame:
    own = edges.filter(F.col("source") == F.col("target"))
    return own if sign is None else own.filter(F.col("sign") == sign)


def regulators(edges: DataFrame) -> DataFrame:
    """Nodes that are sources and no targets."""
    return edges.select(F.col("source").alias("node")).distinct().join(edges.select(F.col("target").alias("node")), "node", "left_anti")


def targets(edges: DataFrame) -> DataFrame:
    """Nodes that are targets and no sources."""
    return edges.select(F.col("target").alias("node")).distinct().join(edges.select(F.col("source").alias("node")), "node", "left_anti")


def strong_labels(pairs: list[tuple], nodes: list) -> dict:
    """node -> smallest node of its strongly connected component (iterative depth-first search with low links)."""
    out: dict = {}
    after: dict = {}
    for s, t in pairs:
        after.setdefault(s, []).append(t)
    index, low, stack, on = {}, {}, [], set()
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(after.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    first = min(part)
                    out.update((w, first) for w in part)
    return out


def _strong_rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same on the cluster: each node takes the smallest node that reaches it; what reaches that root inside one
    colour is the root's component; the rest goes round again."""
    left, found = settled(nodes), None
    pairs = settled(edges.select("source", "target").filter("source <> target").distinct())
    while not left.isEmpty():
        colour = settled(left.select("node", F.col("node").alias("c")))
        while True:
            seen = pairs.join(colour, pairs.source == colour.node).groupBy("target").agg(F.min("c").alias("s"))
            nxt = settled(colour.join(seen, colour.node == seen.target, "left").select("node", F.least("c", F.coalesce("s", "c")).alias("c")))
            moved = nxt.join(colour.withColumnRenamed("c", "_old"), "node").filter("c <> _old").isEmpty()
            colour = nxt
            if moved:
                break
        tag = lambda c, n: colour.select(F.col("node").alias(c), F.col("c").alias(n))
        inner = settled(pairs.join(tag("source", "a"), "source").join(tag("target", "b"), "target").filter("a = b").select("source", "target"))
        part = front = settled(colour.filter("node = c"))
        while not front.isEmpty():
            back = inner.join(front, inner.target == front.node).select(F.col("source").alias("node"), "c").distinct()
            front = settled(back.join(part.select("node"), "node", "left_anti"))
            part = settled(part.union(front))
        found = part if found is None else settled(found.union(part))
        left = settled(left.join(part.select("node"), "node", "left_anti"))
        gone = part.select("node")
        pairs = settled(pairs.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti"))
    return nodes.withColumn("scc", F.col("node")).limit(0) if found is None else found.select("node", F.col("c").alias("scc"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc): the smallest node of its strongly connected component, for all nodes."""
    rows = edges.select("source", "target").distinct().limit(DRIVER_EDGES + 1).collect()
    if len(rows) > DRIVER_EDGES:
        return _strong_rounds(edges, nodes_of(edges))
    pairs = sorted((r.source, r.target) for r in rows)
    labels = strong_labels(pairs, sorted({x for p in pairs for x in p}))
    kind = dict(edges.dtypes)["source"]
    return edges.sparkSession.createDataFrame(sorted(labels.items()), f"node {kind}, scc {kind}")


def feedback_components(edges: DataFrame, include_selfloops: bool = True) -> DataFrame:
    """(node, scc) of components of two nodes or more, and of single nodes with an edge to themselves."""
    found = strong_components(edges)
    many = found.groupBy("scc").count().filter("count > 1").select("scc")
    if include_selfloops:
        many = many.union(autoregulations(edges).select(F.col("source").alias("scc")).join(found.filter("node = scc").select("scc"), "scc", "left_semi")).distinct()
    return found.join(many, "scc", "left_semi").select("node", "scc")


def feedback_induced(edges: DataFrame, include_selfloops: bool = True) -> DataFrame:
    """Edges between feedback nodes."""
    inside = feedback_components(edges, include_selfloops).select("node")
    return edges.join(inside.toDF("source"), "source", "left_semi").join(inside.toDF("target"), "target", "left_semi").select(*edges.columns)


def _signatures(edges: DataFrame, include_successors: bool, extra: list[str]) -> DataFrame:
    """(node, pre, post): sorted sets of signed neighbours."""
    mark = ["sign", *extra]
    pre = edges.groupBy(F.col("target").alias("node")).agg(F.array_sort(F.collect_set(F.struct(F.col("source").alias("n"), *mark))).alias("pre"))
    out = nodes_of(edges).join(pre, "node", "left")
    if not include_successors:
        return out.withColumn("post", F.lit(None))
    post = edges.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set(F.struct(F.col("target").alias("n"), *mark))).alias("post"))
    return out.join(post, "node", "left")


def structural_families(edges: DataFrame, include_successors: bool = True, preserve_feedback: bool = True, min_size: int = 2, extra: list[str] = ()) -> DataFrame:
    """(family, members array): nodes with the same signed predecessors and, if asked, successors. Feedback nodes stay
    alone when preserved. extra: further edge columns that must agree (such as a frequency bin)."""
    signed = _signatures(edges, include_successors, list(extra))
    if preserve_feedback:
        signed = signed.join(feedback_components(edges).select("node"), "node", "left_anti")
    families = signed.groupBy("pre", "post").agg(F.array_sort(F.collect_list("node")).alias("members")).filter(F.size("members") >= min_size)
    return families.select(F.array_join("members", "|").alias("family"), "members")


def family_collapsed(edges: DataFrame, families: DataFrame) -> DataFrame:
    """Edges between families and other nodes; those inside a family go, equal signed edges are one."""
    return relabel(edges, families.select(F.explode("members").alias("old"), F.col("family").alias("new"))).filter("source <> target")


def walks_from(edges: DataFrame, start: str, max_depth: int = 3) -> DataFrame:
    """(path array, sign) of all walks of one to max_depth edges from `start`; parallel edges walk apart."""
    step = edges.select(F.col("source").alias("_at"), "target", F.col("sign").alias("_s"))
    level = edges.filter(F.col("source") == start).select(F.array("source", "target").alias("path"), "sign")
    out = level
    for _ in range(max_depth - 1):
        level = level.join(step, F.element_at("path", -1) == F.col("_at")).select(F.concat("path", F.array("target")).alias("path"), (F.col("sign") * F.col("_s")).alias("sign"))
        out = out.union(level)
    return out


def walk_scores(edges: DataFrame, max_depth: int = 3, weights: list[float] | None = None) -> DataFrame:
    """(source, target, score, total, paths, normalized) over signed walks of one to max_depth edges.

    Only counts of positive and negative walks travel: each depth is a join with the edges' counts and a partial
    aggregate, never a row a walk. Walks back to their source do not score but go on."""
    weights = weights or [1 / n**2 for n in range(1, max_depth + 1)]
    if len(weights) < max_depth:
        raise ValueError("fewer weights than depths")
    step = edges.groupBy("source", "target").agg(F.count_if(F.col("sign") == 1).alias("pe"), F.count_if(F.col("sign") == -1).alias("ne"))
    level = step.select("source", F.col("target").alias("at"), F.col("pe").alias("p"), F.col("ne").alias("n"))
    parts = []
    for depth in range(max_depth):
        if depth:
            grown = level.join(step.select(F.col("source").alias("at"), F.col("target").alias("to"), "pe", "ne"), "at")
            level = grown.groupBy("source", F.col("to").alias("at")).agg(F.sum(F.expr("p * pe + n * ne")).alias("p"), F.sum(F.expr("p * ne + n * pe")).alias("n"))
        parts.append(level.filter("source <> at").select("source", F.col("at").alias("target"), "p", "n", F.lit(float(weights[depth])).alias("w")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    out = whole.groupBy("source", "target").agg(F.sum(F.expr("(p - n) * w")).alias("score"), F.sum(F.expr("(p + n) * w")).alias("total"), F.sum(F.expr("p + n")).alias("paths"))
    return out.withColumn("normalized", F.coalesce(ratio(F.col("score"), F.col("total")), F.lit(0.0)))


def infer_interactions(scores: DataFrame, threshold: float = 0.75, minimum_paths: int = 1, bidirectional: bool = False) -> DataFrame:
    """(source, target, sign): pairs whose normalised score is not 0 and reaches the threshold; without
    `bidirectional`, only where it is strictly above the opposite direction's."""
    own = scores.filter((F.col("paths") >= minimum_paths) & (F.col("normalized") != 0) & (F.abs("normalized") >= threshold))
    if not bidirectional:
        back = scores.select(F.col("target").alias("source"), F.col("source").alias("target"), F.abs("normalized").alias("_back"))
        own = own.join(back, ["source", "target"], "left").filter(F.abs("normalized") > F.coalesce("_back", F.lit(0.0)))
    return own.select("source", "target", F.sign("normalized").cast("int").alias("sign"))


def circuits(edges: DataFrame, max_length: int, sign: int | None = None) -> DataFrame:
    """(path array, sign) of simple circuits of at most max_length nodes, each from its smallest node, once for each
    choice of parallel edges. Only paths inside feedback components are grown."""
    inner = feedback_induced(edges).select("source", "target", "sign")
    step = inner.select(F.col("source").alias("_at"), F.col("target").alias("_to"), F.col("sign").alias("_s"))
    level = inner.filter("source <= target").select(F.array("source").alias("path"), F.col("target").alias("at"), "sign")
    out = None
    for length in range(1, max_length + 1):
        closed = level.filter(F.col("at") == F.col("path")[0]).select("path", "sign")
        out = closed if out is None else out.union(closed)
        if length == max_length:
            break
        open_ = level.filter((F.col("at") > F.col("path")[0]) & ~F.array_contains("path", F.col("at")))
        grown = open_.join(step, F.col("at") == F.col("_at")).filter(F.col("_to") >= F.col("path")[0])
        level = grown.select(F.concat("path", F.array("at")).alias("path"), F.col("_to").alias("at"), (F.col("sign") * F.col("_s")).alias("sign"))
    return out if sign is None else out.filter(F.col("sign") == sign)


def path_sign(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, sign, text): product of the edges' common signs (0 absorbs) and its reading, for paths whose edges exist."""
    signs = edge_sign(edges)
    steps = paths.select("path", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("source"), F.slice("path", 2, F.size("path") - 1).alias("target"))).alias("pos", "e"))
    found = steps.select("path", "pos", "e.source", "e.target").join(signs, ["source", "target"])
    whole = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "sign", "target"))).alias("steps")).filter(F.size("steps") == F.size("path") - 1)
    product = F.aggregate("steps", F.lit(1), lambda a, s: a * s["sign"])
    arrow = lambda s: F.concat(F.when(s["sign"] == 1, " -> ").when(s["sign"] == -1, " -| ").otherwise(" -- "), s["target"])
    return whole.select("path", product.alias("sign"), F.concat(F.col("path")[0], F.array_join(F.transform("steps", arrow), "")).alias("text"))


def marker_paths(edges: DataFrame, markers: list[str], max_depth: int = 6) -> DataFrame:
    """(marker, scc, path): all shortest paths from each feedback component to each marker, by breadth-first levels.
    A marker inside a component has the path of itself."""
    members = feedback_components(edges).select("node", "scc")
    step = edge_sign(edges).select(F.col("source").alias("_at"), F.col("target").alias("_to"))
    level = settled(members.select("scc", F.col("node").alias("at"), F.array("node").alias("path")))
    seen = level.select("scc", "at").distinct()
    out = level.filter(F.col("at").isin(markers))
    for _ in range(max_depth):
        grown = level.join(step, F.col("at") == F.col("_at")).select("scc", F.col("_to").alias("at"), F.concat("path", F.array("_to")).alias("path"))
        level = settled(grown.join(seen, ["scc", "at"], "left_anti"))
        if level.isEmpty():
            break
        seen = settled(seen.union(level.select("scc", "at").distinct()))
        out = out.union(level.filter(F.col("at").isin(markers)))
    return out.select(F.col("at").alias("marker"), "scc", "path")


def graph_distance(a: DataFrame, b: DataFrame, universe: str = "union", given: DataFrame | None = None) -> DataFrame:
    """(differing, size, distance, similarity): one row. universe: union of the edges, `complete` (2 n^2), `loopless`
    (2 n (n - 1)) over the nodes of both, or `given` edges."""
    keys = ["source", "target", "sign"]
    both = a.select(*keys).distinct().withColumn("a", F.lit(1)).join(b.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full")
    counts = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("differing"), F.count("*").alias("_union"), F.count_if(F.col("source") == F.col("target")).alias("_loops"))
    n = nodes_of(a.select("source", "target").union(b.select("source", "target"))).agg(F.count("*").alias("_n"))
    row = counts.crossJoin(n)
    if universe == "union":
        row = row.withColumn("size", F.col("_union"))
    elif universe == "complete":
        row = row.withColumn("size", 2 * F.col("_n") * F.col("_n"))
    elif universe == "loopless":
        refuse = F.assert_true(F.col("_loops") == 0, F.lit("a graph without loops has none"))
        row = row.withColumn("size", 2 * F.col("_n") * (F.col("_n") - 1)).filter(refuse.isNull())
    elif universe == "given":
        row = row.crossJoin(given.select(*keys).distinct().agg(F.count("*").alias("size")))
    else:
        raise ValueError("universe: union, complete, loopless or given")
    distance = F.coalesce(ratio(F.col("differing"), F.col("size")), F.lit(0.0))
    return row.select("differing", "size", distance.alias("distance"), (1 - distance).alias("similarity"))


def aggregate_graphs(edges: DataFrame, graph: str) -> DataFrame:
    """(source, target, sign, count, total, frequency) over the graphs that `graph` names."""
    counts = edges.select("source", "target", "sign", graph).distinct().groupBy("source", "target", "sign").agg(F.count("*").alias("count"))
    total = edges.select(graph).distinct().agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("frequency", F.col("count") / F.col("total"))


def frequency_bin(frequency: Column, bins: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> Column:
    """Number of the first interval, closed on both sides, that holds the frequency."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(bins) - 1)):
        out = F.when((frequency >= bins[k]) & (frequency <= bins[k + 1]), k).otherwise(out)
    return out


def aggregated_collapse(aggregated: DataFrame, families: DataFrame) -> DataFrame:
    """Edges between families with mean, least and greatest frequency."""
    m = families.select(F.explode("members").alias("old"), F.col("family").alias("new"))
    side = lambda c: m.select(F.col("old").alias(c), F.col("new").alias(f"_{c}"))
    out = aggregated.join(side("source"), "source", "left").join(side("target"), "target", "left")
    out = out.select(F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target"), "sign", "frequency").filter("source <> target")
    return out.groupBy("source", "target", "sign").agg(F.avg("frequency").alias("mean"), F.min("frequency").alias("low"), F.max("frequency").alias("high"))


def dot_rows(edges: DataFrame) -> DataFrame:
    """(line) of a DOT drawing: one edge a line, negative ones with a flat head."""
    head = F.when(F.col("sign") == -1, "tee").otherwise("normal")
    return edges.select(F.format_string('"%s" -> "%s" [arrowhead=%s];', "source", "target", head).alias("line"))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of `new`; a signed edge that is there already is an error."""
    return from_table(edges.unionByName(new, allowMissingColumns=True))


def validated_counts(aggregated: DataFrame) -> DataFrame:
    """The aggregated graph, failing where a count is not between 1 and the total."""
    bad = ~F.col("count").between(F.lit(1), F.col("total"))
    return aggregated.withColumn("count", F.when(bad | F.col("count").isNull(), F.raise_error(F.lit("a count is outside 1 .. total"))).otherwise(F.col("count")))


def frequency_style(frequency: Column) -> Column:
    """Line style of an edge by its frequency."""
    return F.when(frequency < 0.25, "dotted").when(frequency < 0.5, "dashed").when(frequency < 0.75, "solid").otherwise("bold")


def update_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of `new`, which take the place of equal signed edges."""
    keys = ["source", "target", "sign"]
    return edges.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def weighted_edges(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Signed edges of (source, target, weight): a weight above 0 is positive, below negative, and stays as a column."""
    sign = F.when(F.col(weight) > 0, 1).when(F.col(weight) < 0, -1)
    return rows.withColumn("sign", sign).filter(F.col("sign").isNotNull()).select("source", "target", "sign", *[c for c in rows.columns if c not in ("source", "target", "sign")])


def to_directed(edges: DataFrame) -> DataFrame:
    """(source, target, sign) as a table of its own, each signed edge once."""
    return edges.select("source", "target", "sign").distinct()


def to_undirected(edges: DataFrame) -> DataFrame:
    """(source, target, sign) with the lesser node first: both directions of a signed edge are one."""
    return edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "sign").distinct()


def update_aggregated(aggregated: DataFrame, new: DataFrame) -> DataFrame:
    """Aggregated graphs (source, target, sign, count, total) of two sets of graphs together."""
    totals = [d.agg(F.coalesce(F.max("total"), F.lit(0)).alias(f"_t{k}")) for k, d in enumerate((aggregated, new))]  # one row each
    both = aggregated.select("source", "target", "sign", "count").union(new.select("source", "target", "sign", "count"))
    summed = both.groupBy("source", "target", "sign").agg(F.sum("count").alias("count")).crossJoin(F.broadcast(totals[0])).crossJoin(F.broadcast(totals[1]))
    total = F.col("_t0") + F.col("_t1")
    return summed.select("source", "target", "sign", "count", total.alias("total"), (F.col("count") / total).alias("frequency"))
