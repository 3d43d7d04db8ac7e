"""Dynamics of Boolean networks over states (BIGINT; bit i is component i in the network's order).

State sets are tables with a column `state`, exact up to MAX_COMPONENTS components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions.lineage import settled
from .boolean import _outranked
from .graphs import strong_components

#: Tables of all states; larger networks go through `symbolic`, which has no such bound.
MAX_COMPONENTS = 24
#: Rounds kept apart before they are written together.
MOST_FRONTS = 32
UPDATES = ("synchronous", "asynchronous", "general")


class Network:
    """Components with their rules, in order. Every symbol of a rule must be a component."""

    def __init__(self, rules: dict[str, str], check: bool = True):
        self.rules = {name: r.parse(text) if isinstance(text, str) else text for name, text in rules.items()}
        self.components = list(self.rules)
        self.order = {c: i for i, c in enumerate(self.components)}
        unknown = {s for t in self.rules.values() for s in r.symbols(t)} - set(self.components)
        if check and unknown:
            raise ValueError(f"no rule for {sorted(unknown)}")

    @property
    def n(self) -> int:
        return len(self.components)

    def image(self, state: Column) -> Column:
        """f(state)."""
        bits = [F.when(r.on_state(tree, self.order, state), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, tree in enumerate(self.rules.values())]
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out

    def images(self) -> np.ndarray:
        """f of all states at once."""
        return sum(r.table(t, self.components).astype(np.int64) << i for i, t in enumerate(self.rules.values()))

    def frame(self, spark: SparkSession, network_id: int = 0) -> DataFrame:
        return spark.createDataFrame([(network_id, c, r.to_text(t)) for c, t in self.rules.items()], "network_id int, component string, rule string")

    def relabel(self, mapping: dict[str, str]) -> Network:
        names = [mapping.get(c, c) for c in self.components]
        if len(set(names)) < len(names):
            raise ValueError("two components would have one name")
        return Network({n: r.relabel(t, mapping) for n, t in zip(names, self.rules.values(), strict=True)})

    def simplify(self) -> Network:
        return Network({c: r.simplify(t) for c, t in self.rules.items()})

    def influences(self, spark: SparkSession) -> DataFrame:
        """(source, target, sign) of what each rule depends on."""
        rows = [(s, c, sign) for c, t in self.rules.items() for s, found in r.signs(t).items() for sign in sorted(found)]
        return spark.createDataFrame(rows, "source string, target string, sign int")


def all_states(spark: SparkSession, network: Network) -> DataFrame:
    if network.n > MAX_COMPONENTS:
        raise ValueError(f"{network.n} components; state sets take at most {MAX_COMPONENTS}")
    return spark.range(1 << network.n).withColumnRenamed("id", "state")


def fixed_points(spark: SparkSession, network: Network) -> DataFrame:
    return all_states(spark, network).filter(network.image(F.col("state")) == F.col("state"))


def successors(states: DataFrame, network: Network, update: str = "general") -> DataFrame:
    """(state, next): f(x) when synchronous; one changing bit when asynchronous; any changing bits when general."""
    image = states.select("state", network.image(F.col("state")).alias("_f"))
    if update == "synchronous":
        return image.select("state", F.col("_f").alias("next"))
    moves = image.select("state", F.col("state").bitwiseXOR(F.col("_f")).alias("_u"))
    bits = f"filter(sequence(0, {network.n - 1}), i -> (shiftright(_u, i) & 1) = 1)"
    if update == "asynchronous":
        flips = F.expr(f"transform({bits}, i -> shiftleft(1L, i))")
    elif update == "general":
        flips = F.expr(f"filter(aggregate({bits}, array(0L), (acc, i) -> concat(acc, transform(acc, m -> m | shiftleft(1L, i)))), m -> m > 0)")
    else:
        raise ValueError(f"update: one of {UPDATES}")
    return moves.select("state", F.explode(flips).alias("_m")).select("state", F.col("state").bitwiseXOR(F.col("_m")).alias("next"))


def post(states: DataFrame, network: Network, update: str = "asynchronous") -> DataFrame:
    """States reached in exactly one step."""
    return successors(states, network, update).select(F.col("next").alias("state")).distinct()


def predecessors(states: DataFrame, network: Network, update: str = "asynchronous") -> DataFrame:
    """States with a successor in the set. Asynchronously a state has one candidate for each component, which is tried;
    other updates go through the steps of all states."""
    if update != "asynchronous":
        edges = successors(all_states(states.sparkSession, network), network, update)
        return edges.join(states.select(F.col("state").alias("next")), "next", "left_semi").select("state").distinct()
    flips = F.expr(f"transform(sequence(0, {network.n - 1}), i -> shiftleft(1L, i))")
    tried = states.select(F.explode(flips).alias("_m"), F.col("state").alias("_to")).select(F.col("_to").bitwiseXOR(F.col("_m")).alias("state"), "_m", "_to")
    moved = network.image(F.col("state")).bitwiseXOR(F.col("state")).bitwiseAND(F.col("_m")) != 0
    return tried.filter(moved).select("state").distinct()


def pre(states: DataFrame, network: Network, update: str = "asynchronous") -> DataFrame:
    """States with a successor in the set."""
    return predecessors(states, network, update)


def _closure(start: DataFrame, step, within: DataFrame | None) -> DataFrame:
    """The start set and what `step` leads to, round by round: only what is new is expanded, and each round is written
    once; what has been seen is the rounds side by side."""
    keep = (lambda d: d) if within is None else (lambda d: d.join(within.select("state"), "state", "left_semi"))
    fronts = [settled(keep(start.select("state").distinct()))]
    while not fronts[-1].isEmpty():
        seen = reduce(DataFrame.union, fronts)
        fronts.append(settled(keep(step(fronts[-1])).join(seen, "state", "left_anti")))
        if len(fronts) > MOST_FRONTS:
            fronts = [settled(reduce(DataFrame.union, fronts[:-1])), fronts[-1]]
    return reduce(DataFrame.union, fronts)


def reachable(start: DataFrame, network: Network, update: str = "general", within: DataFrame | None = None) -> DataFrame:
    """States reached from the start set, which is included."""
    return _closure(start, lambda front: post(front, network, update), within)


def coreachable(goal: DataFrame, network: Network, update: str = "general", within: DataFrame | None = None) -> DataFrame:
    """States from which the goal set is reached, the set included."""
    if update == "asynchronous":
        return _closure(goal, lambda front: predecessors(front, network, update), within)
    edges = settled(successors(all_states(goal.sparkSession, network), network, update))
    return _closure(goal, lambda front: edges.join(front.select(F.col("state").alias("next")), "next", "left_semi").select("state").distinct(), within)


def terminal_components(states: DataFrame, network: Network, update: str = "general") -> DataFrame:
    """(attractor, state): strongly connected parts of the region's own graph that no edge of it leaves; edges out of
    the region do not count. An attractor is named by its smallest state."""
    region = settled(states.select("state").distinct())
    edges = successors(region, network, update).filter("state <> next")
    edges = settled(edges.join(region.select(F.col("state").alias("next")), "next", "left_semi").select(F.col("state").alias("source"), F.col("next").alias("target")).distinct())
    label = settled(region.join(strong_components(edges).withColumnRenamed("node", "state"), "state", "left").select("state", F.coalesce("scc", "state").alias("attractor")))
    a, b = label.toDF("source", "a"), label.toDF("target", "b")
    leaving = edges.join(a, "source").join(b, "target").filter("a <> b").select(F.col("a").alias("attractor")).distinct()
    return label.join(leaving, "attractor", "left_anti").select("attractor", "state")


def attractors(start: DataFrame, network: Network, update: str = "general") -> DataFrame:
    return terminal_components(reachable(start, network, update), network, update)


def transition(source: DataFrame, target: DataFrame, network: Network, update: str = "general") -> DataFrame:
    """(exists_, robust, universal): some pair, for each source some target, every pair, by one step."""
    steps = successors(source, network, update).distinct().join(target.select(F.col("state").alias("next")), "next", "left_semi")
    per = source.select("state").distinct().join(steps.groupBy("state").agg(F.count("*").alias("hits")), "state", "left").fillna(0, ["hits"])
    return _quantified(per, target)


def _quantified(per: DataFrame, target: DataFrame) -> DataFrame:
    size = target.select("state").distinct().agg(F.count("*").alias("_n"))
    return per.crossJoin(F.broadcast(size)).agg(F.coalesce(F.bool_or(F.col("hits") > 0), F.lit(False)).alias("exists_"), F.bool_and(F.col("hits") > 0).alias("robust"), F.bool_and(F.col("hits") == F.col("_n")).alias("universal"))


def reachability(source: DataFrame, target: DataFrame, network: Network, update: str = "general") -> DataFrame:
    """The same by any number of steps: pairs (source, state) grow together."""
    goal = target.select("state").distinct()
    seen = front = settled(source.select(F.col("state").alias("from"), "state").distinct())
    while not front.isEmpty():
        steps = successors(front.select("state").distinct(), network, update)
        grown = front.join(steps, "state").select("from", F.col("next").alias("state")).distinct()
        front = settled(grown.join(seen, ["from", "state"], "left_anti"))
        seen = settled(seen.union(front))
    hits = seen.join(goal, "state", "left_semi").groupBy("from").agg(F.count("*").alias("hits"))
    per = source.select(F.col("state").alias("from")).distinct().join(hits, "from", "left").fillna(0, ["hits"])
    return _quantified(per, goal)


def trap_closure(cubes: DataFrame, network: Network) -> DataFrame:
    """(fixed_mask, value_mask, closed_fixed, closed_value): the least closed cube around each cube: a component is
    freed as soon as its rule can leave its value somewhere inside, which the rule's decision diagram tells without
    looking at the cube's states."""
    names = network.components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        diagrams = [r.Diagram(t) for t in network.rules.values()]
        for b in batches:
            fixed_in, value_in = (b[c].to_numpy(zero_copy_only=False) for c in ("fixed_mask", "value_mask"))
            out_f, out_v = [], []
            for fixed, value in zip(fixed_in.tolist(), value_in.tolist(), strict=True):
                while True:
                    cube = {c: bool(value >> i & 1) for i, c in enumerate(names) if fixed >> i & 1}
                    leave = sum(1 << i for i, c in enumerate(names) if c in cube and diagrams[i].can_take_value(cube, not cube[c]))
                    if not leave:
                        break
                    fixed &= ~leave
                    value &= fixed
                out_f.append(fixed)
                out_v.append(value)
            yield pa.RecordBatch.from_arrays([b["fixed_mask"], b["value_mask"], pa.array(out_f, pa.int64()), pa.array(out_v, pa.int64())], ["fixed_mask", "value_mask", "closed_fixed", "closed_value"])

    return cubes.select("fixed_mask", "value_mask").mapInArrow(run, "fixed_mask long, value_mask long, closed_fixed long, closed_value long")


def minimal_trap_spaces(spark: SparkSession, network: Network) -> DataFrame:
    """(fixed_mask, value_mask) of closed cubes that hold no smaller one: closures of single states, of which the least
    stay. They are the attractors of most-permissive dynamics."""
    points = all_states(spark, network).select(F.lit((1 << network.n) - 1).cast("long").alias("fixed_mask"), F.col("state").alias("value_mask"))
    closed = settled(trap_closure(points, network).select(F.col("closed_fixed").alias("fixed_mask"), F.col("closed_value").alias("value_mask")).distinct())
    return closed.join(_outranked(closed, "minimal"), ["fixed_mask", "value_mask"], "left_anti")


def most_permissive_reachable(spark: SparkSession, network: Network, start: int) -> DataFrame:
    """(state): what most-permissive dynamics reach from `start`. Components are allowed their opposite value in every
    combination; an allowed cube is closed step by step, and a component whose rule can no longer take its first value
    inside the cube has changed for good."""
    images, n = network.images(), network.n
    found: set[int] = set()
    for allowed in range(1 << n):
        free = 0
        while True:
            states = np.array([start], np.int64)
            for i in range(n):
                if free >> i & 1:
                    states = np.concatenate([states, states ^ (1 << i)])
            can = int(np.bitwise_or.reduce(images[states] ^ start)) & allowed
            if can == free:
                break
            free |= can
        if free != allowed:
            continue
        keep = 0  # free components that can still take their first value
        for i in range(n):
            if free >> i & 1 and ((images[states] >> i & 1) == (start >> i & 1)).any():
                keep |= 1 << i
        final = start ^ (free & ~keep)
        options = [i for i in range(n) if keep >> i & 1]
        for k in range(len(options) + 1):
            for pick in itertools.combinations(options, k):
                found.add(final ^ sum(1 << i for i in pick))
    return spark.createDataFrame([(s,) for s in sorted(found)], "state long")


def hamming(spark: SparkSession, a: Network, b: Network) -> DataFrame:
    """(component, disagree, size, share): assignments on which the two rules differ, over the union of the variables
    that either depends on."""
    rows = []
    for c in a.components:
        order = sorted(set(r.essential(a.rules[c])) | set(r.essential(b.rules[c])))
        fill = lambda net, c=c, order=order: r.table(_restricted(net.rules[c], order), order)
        rows.append((c, int((fill(a) != fill(b)).sum()), 1 << len(order)))
    return spark.createDataFrame(rows, "component string, disagree long, size long").withColumn("share", F.col("disagree") / F.col("size"))


def _restricted(tree: tuple, order: list[str]) -> tuple:
    """The rule with variables that it does not depend on set to 0."""
    if tree[0] == "var":
        return tree if tree[1] in order else ("const", False)
    return tree if tree[0] == "const" else (tree[0], *(_restricted(t, order) for t in tree[1:]))


def distance(spark: SparkSession, a: Network, b: Network, metric: str = "hamming") -> DataFrame:
    """(distance, similarity): mean share of disagreeing assignments, or with `equivalence` of rules that differ."""
    value = F.col("share") if metric == "hamming" else (F.col("disagree") > 0).cast("double")
    return hamming(spark, a, b).agg(F.avg(value).alias("distance")).withColumn("similarity", 1 - F.col("distance"))


def ensemble_influences(spark: SparkSession, networks: list[Network]) -> DataFrame:
    """(source, target, sign, count, total) over networks."""
    rows = [(k, *x) for k, net in enumerate(networks) for c, t in net.rules.items() for s, found in r.signs(t).items() for x in ((s, c, sign) for sign in sorted(found))]
    frame = spark.createDataFrame(rows, "network int, source string, target string, sign int")
    return frame.groupBy("source", "target", "sign").agg(F.count_distinct("network").alias("count")).withColumn("total", F.lit(len(networks)))


def truth_table(spark: SparkSession, rule: str, order: list[str]) -> DataFrame:
    """(state, value) on all assignments."""
    at = {name: i for i, name in enumerate(order)}
    return spark.range(1 << len(order)).select(F.col("id").alias("state"), r.on_state(r.parse(rule), at, F.col("id")).alias("value"))


def ensemble_frame(spark: SparkSession, networks: list[Network]) -> DataFrame:
    """(network_id, component, rule) of networks over one set of components."""
    if len({frozenset(n.components) for n in networks}) > 1:
        raise ValueError("networks of one ensemble have the same components")
    rows = [(k, c, r.to_text(t)) for k, n in enumerate(networks) for c, t in n.rules.items()]
    return spark.createDataFrame(rows, "network_id int, component string, rule string")


def ensemble_distances(spark: SparkSession, networks: list[Network]) -> DataFrame:
    """(a, b, distance) of all network pairs a < b: each distinct pair of a component's rules is compared once."""
    memo: dict[tuple, float] = {}

    def differ(x: tuple, y: tuple) -> float:
        if (x, y) not in memo:
            order = sorted(set(r.essential(x)) | set(r.essential(y)))
            memo[x, y] = float((r.table(_restricted(x, order), order) != r.table(_restricted(y, order), order)).mean())
        return memo[x, y]

    rows = [(i, j, sum(differ(a.rules[c], b.rules[c]) for c in a.components) / a.n) for (i, a), (j, b) in itertools.combinations(enumerate(networks), 2)]
    return spark.createDataFrame(rows, "a int, b int, distance double")


def ensemble_implicants(spark: SparkSession, networks: list[Network], value: bool = True, prime: bool = False) -> DataFrame:
    """(network_id, component, implicant map) of every rule; equal rules are expanded once."""
    expand = r.prime_implicants if prime else r.dnf_implicants
    memo = {t: expand(t, value) for t in dict.fromkeys(t for n in networks for t in n.rules.values())}
    rows = [(k, c, cube) for k, n in enumerate(networks) for c, t in n.rules.items() for cube in memo[t]]
    return spark.createDataFrame(rows, "network_id int, component string, implicant map<string, boolean>")


class ExecutableModel:
    """A network with named initial conditions (component -> value, absent: free) and perturbations (component -> value
    that replaces its rule)."""

    def __init__(self, network: Network, initial: dict[str, dict[str, bool]] | None = None, perturbations: dict[str, bool] | None = None, parameters: dict | None = None, metadata: dict | None = None):
        self.initial, self.perturbations = dict(initial or {}), dict(perturbations or {})
        self.parameters, self.metadata = dict(parameters or {}), dict(metadata or {})
        if unknown := ({c for v in self.initial.values() for c in v} | set(self.perturbations)) - set(network.components):
            raise ValueError(f"no components {sorted(unknown)}")
        self.network = Network({c: ("const", self.perturbations[c]) if c in self.perturbations else t for c, t in network.rules.items()})

    def states(self, spark: SparkSession, name: str) -> DataFrame:
        """All states of a named condition."""
        given, order = self.initial[name], self.network.order
        fixed, value = sum(1 << order[c] for c in given), sum(1 << order[c] for c, v in given.items() if v)
        return all_states(spark, self.network).filter(F.col("state").bitwiseAND(F.lit(fixed)) == value)

    def condition(self, spark: SparkSession, given: str | dict[str, bool]) -> DataFrame:
        """States of a named condition, or of one given as component -> value."""
        if isinstance(given, str):
            return self.states(spark, given)
        order = self.network.order
        fixed, value = sum(1 << order[c] for c, v in given.items() if v is not None), sum(1 << order[c] for c, v in given.items() if v)
        return all_states(spark, self.network).filter(F.col("state").bitwiseAND(F.lit(fixed)) == value)

    def reachable(self, spark: SparkSession, name: str, update: str = "general") -> DataFrame:
        return reachable(self.states(spark, name), self.network, update)

    def attractors(self, spark: SparkSession, name: str, update: str = "general") -> DataFrame:
        return attractors(self.states(spark, name), self.network, update)

    def transition(self, spark: SparkSession, source: str | dict[str, bool], target: str | dict[str, bool], update: str = "general", quantifier: str = "robust") -> bool:
        """Whether one step leads from the source condition to the target: `exists`, `robust` or `universal`."""
        return self._asked(transition, spark, source, target, update, quantifier)

    def reachability(self, spark: SparkSession, source: str | dict[str, bool], target: str | dict[str, bool], update: str = "general", quantifier: str = "robust") -> bool:
        """The same by any number of steps."""
        return self._asked(reachability, spark, source, target, update, quantifier)

    def _asked(self, test, spark, source, target, update, quantifier) -> bool:
        column = {"exists": "exists_", "robust": "robust", "universal": "universal"}[quantifier]
        return bool(test(self.condition(spark, source), self.condition(spark, target), self.network, update).first()[column])


class Ensemble:
    """Networks over one set of components, as a list that keeps that so."""

    def __init__(self, networks: list[Network] = (), components: list[str] | None = None):
        networks = list(networks)
        if components is None and not networks:
            raise ValueError("an empty ensemble needs its components")
        self.components = list(components or networks[0].components)
        self.networks = [self._fits(n) for n in networks]

    def _fits(self, network: Network | dict[str, str]) -> Network:
        network = network if isinstance(network, Network) else Network({c: str(t) for c, t in network.items()})
        if set(network.components) != set(self.components):
            raise ValueError("networks of one ensemble have the same components")
        return network

    def __len__(self) -> int:
        return len(self.networks)

    def __iter__(self):
        return iter(self.networks)

    def __getitem__(self, at):
        return self.networks[at]

    def __setitem__(self, at, value) -> None:
        self.networks[at] = [self._fits(n) for n in value] if isinstance(at, slice) else self._fits(value)

    def __delitem__(self, at) -> None:
        del self.networks[at]

    def insert(self, at: int, value: Network | dict[str, str]) -> None:
        self.networks.insert(at, self._fits(value))

    def append(self, value: Network | dict[str, str]) -> None:
        self.insert(len(self), value)

    def frame(self, spark: SparkSession) -> DataFrame:
        return ensemble_frame(spark, self.networks)


def ensemble_nodes(spark: SparkSession, networks: list[Network]) -> DataFrame:
    """(component, function_count, stability): distinct implicant structures of a component's rules over the networks,
    and the share of networks that have the commonest."""
    shape = F.to_json(F.array_sort(F.collect_list(F.to_json("implicant")))).alias("shape")
    per = ensemble_implicants(spark, networks).groupBy("network_id", "component").agg(shape)
    # a rule without implicants (never true) has a structure too
    named = ensemble_frame(spark, networks).select("network_id", "component").join(per, ["network_id", "component"], "left").fillna("[]", ["shape"])
    counts = named.groupBy("component", "shape").agg(F.count("*").alias("n"))
    return counts.groupBy("component").agg(F.count("*").alias("function_count"), (F.max("n") / len(networks)).alias("stability"))
