"""Kleene values, partial Booleans, hypercubes and configuration sets as Columns and tables.

A Kleene value is a nullable boolean, null being the free value `*`; SQL's three-valued AND, OR and NOT are the strong
Kleene ones. A hypercube is rows (cube, component, value); a component it lacks is free. A configuration set is rows
(fixed_mask, value_mask) of disjoint cubes over numbered components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ratio


def rank(v: Column) -> Column:
    """0, 1, 2 for false, free, true."""
    return F.when(v, 2).when(~v, 0).otherwise(1)


def kleene_diff(a: Column, b: Column) -> Column:
    """0 if equal, 1 if a is below b, else -1."""
    return F.sign(rank(b) - rank(a)).cast("int")


def mask(v: Column) -> Column:
    """Partial Boolean as the set of its values: 1 for {0}, 2 for {1}, 3 for both."""
    return F.when(v, 2).when(~v, 1).otherwise(3)


def includes(a: Column, b: Column) -> Column:
    """Whether the values of a are among those of b."""
    return mask(a).bitwiseAND(mask(b)) == mask(a)


def changes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after, change) of components whose value differs: flip, stabilization or destabilization."""
    both = a.select(*keys, F.col("value").alias("before")).join(b.select(*keys, F.col("value").alias("after")), keys, "full")
    kind = (
        F.when(F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before") != F.col("after")), "flip")
        .when(F.col("before").isNull() & F.col("after").isNotNull(), "stabilization")
        .when(F.col("before").isNotNull() & F.col("after").isNull(), "destabilization")
    )
    return both.withColumn("change", kind).filter(F.col("change").isNotNull())


def cube_masks(cubes: DataFrame, components: list[str]) -> DataFrame:
    """(cube, fixed_mask, value_mask); at most 62 components."""
    if len(components) > 62:
        raise ValueError("at most 62 components")
    bit = F.lit(0).cast("long")
    for i, c in enumerate(components):
        bit = F.when(F.col("component") == c, F.lit(1 << i)).otherwise(bit)
    return cubes.groupBy("cube").agg(
        F.coalesce(F.bit_or(F.when(F.col("value").isNotNull(), bit)), F.lit(0)).alias("fixed_mask"), F.coalesce(F.bit_or(F.when(F.col("value"), bit)), F.lit(0)).alias("value_mask")
    )


def _outranked(kinds: DataFrame, pick: str) -> DataFrame:
    """Of distinct (fixed_mask, value_mask), those strictly inside (`maximal`) or around (`minimal`) another of them.

    Cubes that fix fewer components are found by equality: of the masks that occur, each pair of a mask and one inside
    it says which bits of the finer cube's values a coarser one must have. Masks are few beside the cubes."""
    masks = kinds.select("fixed_mask").distinct()
    pairs = masks.join(masks.select(F.col("fixed_mask").alias("_less")), (F.col("_less") != F.col("fixed_mask")) & (F.col("_less").bitwiseAND(F.col("fixed_mask")) == F.col("_less")))
    finer = kinds.join(pairs, "fixed_mask").withColumn("_part", F.col("value_mask").bitwiseAND(F.col("_less")))
    if pick == "maximal":
        coarser = kinds.select(F.col("fixed_mask").alias("_less"), F.col("value_mask").alias("_part"))
        return finer.join(coarser, ["_less", "_part"], "left_semi").select("fixed_mask", "value_mask").distinct()
    return finer.select(F.col("_less").alias("fixed_mask"), F.col("_part").alias("value_mask")).distinct()


def _extreme(masks: DataFrame, pick: str) -> DataFrame:
    """Cubes that are not strictly inside (or around) another."""
    kinds = masks.select("fixed_mask", "value_mask").distinct()
    return masks.join(_outranked(kinds, pick), ["fixed_mask", "value_mask"], "left_anti").select("cube")


def maximal(masks: DataFrame) -> DataFrame:
    """Cubes inside no other."""
    return _extreme(masks, "maximal")


def minimal(masks: DataFrame) -> DataFrame:
    """Cubes around no other."""
    return _extreme(masks, "minimal")


def inside(masks: DataFrame, fixed: int, value: int) -> DataFrame:
    """Cubes inside the given one."""
    return masks.filter((F.col("fixed_mask").bitwiseAND(F.lit(fixed)) == fixed) & (F.col("value_mask").bitwiseAND(F.lit(fixed)) == value))


def around(masks: DataFrame, fixed: int, value: int) -> DataFrame:
    """Cubes around the given one: they fix nothing that it leaves free, and agree with it."""
    return masks.filter((F.col("fixed_mask").bitwiseAND(F.lit(fixed)) == F.col("fixed_mask")) & (F.lit(value).bitwiseAND(F.col("fixed_mask")) == F.col("value_mask")))


def collected(masks: DataFrame) -> DataFrame:
    """(fixed_mask, value_mask) of a collection: each cube once."""
    return masks.select("fixed_mask", "value_mask").distinct()


def with_cubes(masks: DataFrame, new: DataFrame) -> DataFrame:
    """The collection with the cubes of `new`."""
    return collected(masks.select("fixed_mask", "value_mask").union(new.select("fixed_mask", "value_mask")))


def without_cubes(masks: DataFrame, gone: DataFrame) -> DataFrame:
    """The collection without the cubes of `gone`; absent ones do not matter."""
    return collected(masks).join(gone.select("fixed_mask", "value_mask"), ["fixed_mask", "value_mask"], "left_anti")


def has_cube(masks: DataFrame, fixed: int, value: int) -> DataFrame:
    """(contained): whether the cube itself is in the collection."""
    return masks.agg(F.coalesce(F.bool_or((F.col("fixed_mask") == fixed) & (F.col("value_mask") == value)), F.lit(False)).alias("contained"))


def same_collections(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equal, size): whether two collections have the same cubes, and the size of the first."""
    both = collected(a).withColumn("_a", F.lit(1)).join(collected(b).withColumn("_b", F.lit(1)), ["fixed_mask", "value_mask"], "full")
    return both.agg((F.count_if(F.col("_a").isNull() | F.col("_b").isNull()) == 0).alias("equal"), F.count("_a").alias("size"))


def fixed_components(cubes: DataFrame) -> DataFrame:
    """(component) of those that some cube fixes."""
    return cubes.filter(F.col("value").isNotNull()).select("component").distinct()


def compress(masks: DataFrame, n: int) -> DataFrame:
    """(fixed_mask, value_mask) of disjoint cubes that make up the same states, fewer where two that differ in one fixed
    bit could become one: bit by bit, each cube is merged with its twin if that is there. Not always the fewest."""
    out = collected(masks)
    for i in range(n):
        bit = F.lit(1 << i)
        fixes = F.col("fixed_mask").bitwiseAND(bit) != 0
        rest = F.col("value_mask").bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << i)))
        pairs = out.filter(fixes).groupBy("fixed_mask", rest.alias("_rest")).agg(F.count("*").alias("_n"), F.max("value_mask").alias("_value"))
        merged = pairs.select(F.when(F.col("_n") == 2, F.col("fixed_mask").bitwiseXOR(bit)).otherwise(F.col("fixed_mask")).alias("fixed_mask"), F.when(F.col("_n") == 2, F.col("_rest")).otherwise(F.col("_value")).alias("value_mask"))
        out = out.filter(~fixes).union(merged)
    return out


def symbol(v: Column) -> Column:
    """0, 1 or * of a partial Boolean."""
    return F.when(v, "1").when(~v, "0").otherwise("*")


def is_fixed(v: Column) -> Column:
    return v.isNotNull()


def is_free(v: Column) -> Column:
    return v.isNull()


def possibilities(v: Column) -> Column:
    """The values that a partial Boolean allows, in order."""
    return F.when(v, F.array(F.lit(1))).when(~v, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))


def to_kleene(v: Column) -> Column:
    """A partial Boolean read as a Kleene value: the same symbol, `*` now meaning unknown."""
    return v


def fully_specified(masks: DataFrame, n: int) -> DataFrame:
    return masks.filter(F.bit_count("fixed_mask") == n)


def configuration_count(masks: DataFrame, n: int) -> DataFrame:
    """(n_configurations) of disjoint cubes over n components."""
    return masks.agg(F.coalesce(F.sum(F.expr(f"shiftleft(1L, {n} - bit_count(fixed_mask))")), F.lit(0)).alias("n_configurations"))


def enumerate_configurations(masks: DataFrame, n: int) -> DataFrame:
    """(cube, state) of every configuration: the free bits take all values."""
    state = F.expr(
        f"aggregate(sequence(0, {n - 1}), array(value_mask), (acc, i) -> CASE WHEN (shiftright(fixed_mask, i) & 1) = 0 THEN concat(acc, transform(acc, s -> s | shiftleft(1L, i))) ELSE acc END)"
    )
    return masks.select("cube", F.explode(state).alias("state"))


def subtract(masks: DataFrame, other: DataFrame, n: int) -> DataFrame:
    """States of one set that are not in the other."""
    return enumerate_configurations(masks, n).select("state").distinct().join(enumerate_configurations(other, n).select("state").distinct(), "state", "left_anti")


#: Cubes whose sizes are summed together when draws are placed.
DEALT = 1024


def sample(masks: DataFrame, n: int, size: int, seed: int = 0) -> DataFrame:
    """(draw, state): uniform draws with replacement: a draw's number falls into a cube by cumulated sizes, and its
    offset fills the cube's free bits.

    Sizes are summed inside groups of cubes and then over the groups. Draws and cubes meet by stretches of the line of
    all states, of which a cube touches as many as its share asks for."""
    sized = masks.withColumn("_n", F.expr(f"shiftleft(1L, {n} - bit_count(fixed_mask))"))
    whole = sized.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))  # one row
    sized = sized.crossJoin(F.broadcast(whole)).withColumn("_group", F.pmod(F.xxhash64("fixed_mask", "value_mask", "cube"), F.ceil(F.col("_k") / DEALT)))
    up = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.groupBy("_group").agg(F.sum("_n").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(up([F.lit(0)], ["_group"])), F.lit(0)))
    own = F.coalesce(F.sum("_n").over(up(["_group"], ["fixed_mask", "value_mask", "cube"])), F.lit(0))
    placed = sized.withColumn("_own", own).join(bases.select("_group", "_base"), "_group").withColumn("_lo", F.col("_base") + F.col("_own"))
    width = F.greatest(F.floor(F.col("_t") / F.col("_k")), F.lit(1))
    placed = placed.withColumn("_at", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_lo") + F.col("_n") - 1) / width))))
    draws = masks.sparkSession.range(size).withColumnRenamed("id", "draw").crossJoin(F.broadcast(whole)).withColumn("_x", F.pmod(F.xxhash64("draw", F.lit(seed)), F.col("_t")))
    draws = draws.select("draw", "_x", F.floor(F.col("_x") / width).alias("_at"))
    hit = draws.join(placed, "_at").filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_lo") + F.col("_n")))
    fill = F.expr(
        f"aggregate(sequence(0, {n - 1}), struct(value_mask AS s, _x - _lo AS r), (a, i) -> CASE WHEN (shiftright(fixed_mask, i) & 1) = 0 THEN struct(a.s | shiftleft(a.r & 1L, i) AS s, shiftright(a.r, 1) AS r) ELSE a END, a -> a.s)"
    )
    return hit.select("draw", fill.alias("state"))


def predecessor_vote(source1: Column, source2: Column, target1: Column, target2: Column, sign: Column) -> Column:
    """forward, backward or inconclusive: which cell comes first, from one signed influence and both cells' values.

    Telling only if the source is fixed and alike in both cells and the target differs: an active source drives the
    target along its sign, an inactive one against it."""
    informative = source1.isNotNull() & source1.eqNullSafe(source2) & ~target1.eqNullSafe(target2)
    along = sign == kleene_diff(target1, target2)
    forward = F.when(source1, along).otherwise(~along)
    return F.when(~F.coalesce(informative, F.lit(False)), "inconclusive").when(forward, "forward").otherwise("backward")


def predecessor_votes(pairs: DataFrame, cells: DataFrame, interactions: DataFrame) -> DataFrame:
    """(cell1, cell2, forward, backward, inconclusive) for the cell pairs given; cells are (cell, component, value), and
    a component that a cell lacks is inconclusive."""
    v = lambda cell, comp, out: cells.select(F.col("cell").alias(cell), F.col("component").alias(comp), F.col("value").alias(out), F.lit(True).alias(f"_{out}"))
    each = pairs.crossJoin(interactions.select("source", "target", "sign"))
    for cell in ("cell1", "cell2"):
        for comp in ("source", "target"):
            each = each.join(v(cell, comp, f"{comp}_{cell}"), [cell, comp], "left")
    known = F.col("_source_cell1") & F.col("_source_cell2") & F.col("_target_cell1") & F.col("_target_cell2")
    vote = predecessor_vote(*(F.col(f"{c}_{k}") for c in ("source", "target") for k in ("cell1", "cell2")), F.col("sign"))
    vote = F.when(F.coalesce(known, F.lit(False)), vote).otherwise("inconclusive")
    return each.withColumn("vote", vote).groupBy("cell1", "cell2").agg(*[F.count_if(F.col("vote") == k).alias(k) for k in ("forward", "backward", "inconclusive")])


def predecessor_score(votes: DataFrame) -> DataFrame:
    """votes with score (f - b) / (f + b), 0 without conclusive votes, and the cell that comes first (null: neither)."""
    score = F.coalesce(ratio(F.col("forward") - F.col("backward"), F.col("forward") + F.col("backward")), F.lit(0.0))
    return votes.withColumn("score", score).withColumn("predecessor", F.when(score > 0, F.col("cell1")).when(score < 0, F.col("cell2")))


def drop_components(cubes: DataFrame, components: list[str]) -> DataFrame:
    """Cubes without the components, which are then free."""
    return cubes.filter(~F.col("component").isin(*components))


def relabel_components(cubes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Components renamed by (old, new); two of a cube that would become one are an error."""
    out = cubes.join(mapping.select(F.col("old").alias("component"), "new"), "component", "left").withColumn("component", F.coalesce("new", "component")).drop("new")
    size = F.count("*").over(Window.partitionBy("cube", "component"))
    return out.withColumn("_n", size).withColumn("component", F.when(F.col("_n") == 1, F.col("component")).otherwise(F.raise_error(F.lit("relabelling merges components")))).drop("_n")


def update_cubes(cubes: DataFrame, changes_: DataFrame) -> DataFrame:
    """Cubes with values set by (cube, component, value); new components are added."""
    kept = cubes.join(changes_.select("cube", "component"), ["cube", "component"], "left_anti")
    return kept.unionByName(changes_.select(*cubes.columns))


def compare_cubes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cube, same, below, above): whether cubes of one name are equal, a inside b, b inside a. Missing is free."""
    both = a.select("cube", "component", F.col("value").alias("_a")).join(b.select("cube", "component", F.col("value").alias("_b")), ["cube", "component"], "full")
    return both.groupBy("cube").agg(
        F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("same"), F.bool_and(includes(F.col("_a"), F.col("_b"))).alias("below"), F.bool_and(includes(F.col("_b"), F.col("_a"))).alias("above")
    )


def state_algebra(a: DataFrame, b: DataFrame, operation: str, n: int) -> DataFrame:
    """States of a set operation: union, intersection, difference, symmetric or (of a alone) complement."""
    a, b = a.select("state").distinct(), b.select("state").distinct()
    if operation == "union":
        return a.union(b).distinct()
    if operation == "intersection":
        return a.intersect(b)
    if operation == "difference":
        return a.subtract(b)
    if operation == "symmetric":
        return a.subtract(b).union(b.subtract(a))
    if operation == "complement":
        return a.sparkSession.range(1 << n).withColumnRenamed("id", "state").join(a, "state", "left_anti")
    raise ValueError("operation: union, intersection, difference, symmetric or complement")


def state_relations(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equal, subset, superset, meets, n_a, n_b) of two state sets, in one pass."""
    both = a.select("state").distinct().withColumn("_a", F.lit(1)).join(b.select("state").distinct().withColumn("_b", F.lit(1)), "state", "full")
    only_a, only_b, shared = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull()), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.agg(((only_a == 0) & (only_b == 0)).alias("equal"), (only_a == 0).alias("subset"), (only_b == 0).alias("superset"), (shared > 0).alias("meets"), F.count("_a").alias("n_a"), F.count("_b").alias("n_b"))
