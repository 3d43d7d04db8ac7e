"""SimHash near-duplicates: fingerprints, then a binary trie joined with itself under a Hamming budget.

With six blocks of bits, two fingerprints that differ in at most four bits agree in two whole blocks. So each of the
15 choices of two blocks gives a trie whose path starts with those bits, and only subtrees below equal starts can
meet: a subtree is the unit that is dealt to tasks. Inside, node pairs are walked together from the top; a pair's
differing bits add up and the pair is dropped once they pass the budget. What a task finds it reports as a spanning
forest, so a group of near copies costs its size in links, not its square.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .components import components

BITS, BUDGET, SHINGLE, SEED = 64, 4, 4, 42
#: Block bounds: any BUDGET differing bits leave two of the six untouched.
BOUNDS = (0, 11, 22, 33, 44, 54, 64)
CHOICES = tuple(itertools.combinations(range(6), 2))
#: Node pairs with at most this many leaf pairs are finished by comparing the leaves.
LEAVES = 32
#: Node pairs walked at once, and fingerprints held at once (whole subtrees, so one subtree may exceed it).
FRONTIER, HELD = 1 << 20, 1 << 19


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of whole texts' word shingles, repeats included; no words: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # 1 MB of bits at a time, however long the text
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long: the fingerprint's 64 bits) per row; null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x or b"", shingle) for x in b["text"].cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _field(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo..hi-1 counted from the top."""
    return (x >> np.uint64(BITS - hi)) & np.uint64((1 << (hi - lo)) - 1)


def rearranged(x: np.ndarray, choice: int) -> np.ndarray:
    """`x` with the chosen blocks first, the others after them in order."""
    first = CHOICES[choice]
    out = np.zeros_like(x)
    for k in (*first, *(k for k in range(6) if k not in first)):
        lo, hi = BOUNDS[k], BOUNDS[k + 1]
        out = out << np.uint64(hi - lo) | _field(x, lo, hi)
    return out


def _depth(choice: int) -> int:
    return sum(BOUNDS[k + 1] - BOUNDS[k] for k in CHOICES[choice])


class Forest:
    """Components of leaves 0..n-1 under links that come in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label[:] = up

    def single(self) -> np.ndarray:
        """Running count of places where the label changes: a range is one component if it has none inside."""
        return np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])


def _pairs(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All leaf pairs of range pairs."""
    na, nb = ah - al, bh - bl
    total = na * nb
    which = np.repeat(np.arange(len(total)), total)
    k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    return al[which] + k // nb[which], bl[which] + k % nb[which]


def trie_join(leaves: np.ndarray, groups: np.ndarray, depth: int, budget: int, forest: Forest) -> None:
    """Links into `forest` all pairs of sorted `leaves` of one group that differ in at most `budget` bits.

    groups: group bounds (g + 1 positions); the leaves of one share their first `depth` bits, where the walk starts.
    A node is a range of leaves. A node pair that lies in one component already is not walked again."""
    lo, hi = groups[:-1], groups[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(d, al[:half], ah[:half], bl[:half], bh[:half], err[:half]), (d, al[half:], ah[half:], bl[half:], bh[half:], err[half:])]
            continue
        if not len(al):
            continue
        single = forest.single()
        joined = (single[ah - 1] == single[al]) & (single[bh - 1] == single[bl]) & (forest.label[al] == forest.label[bl])
        few = ~joined & ((ah - al) * (bh - bl) <= LEAVES)
        sure = ~joined & ~few & (err + BITS - d <= budget)  # no bits left that could part them
        if few.any():
            x, y = _pairs(al[few], ah[few], bl[few], bh[few])
            near = (x < y) & (np.bitwise_count(leaves[x] ^ leaves[y]) <= budget)
            forest.link(x[near], y[near])
        if sure.any():
            for a, b, c, e in zip(al[sure].tolist(), ah[sure].tolist(), bl[sure].tolist(), bh[sure].tolist(), strict=True):
                x = np.concatenate([np.arange(a, b), np.arange(c, e)])
                forest.link(x, np.full(len(x), a))
        go = ~(joined | few | sure)
        if not go.any():
            continue
        al, ah, bl, bh, err = al[go], ah[go], bl[go], bh[go], err[go]
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((leaves >> np.uint64(BITS - 1 - d)) & np.uint64(1), dtype=np.int64)])
        am, bm = ah - (ones[d][ah] - ones[d][al]), bh - (ones[d][bh] - ones[d][bl])
        other = (al != bl) | (ah != bh)  # a node paired with itself has one mixed pair of children, not two
        equal = ((al, am, bl, bm, err), (am, ah, bm, bh, err))
        mixed = ((al, am, bm, bh, err + 1), tuple(x[other] for x in (am, ah, bl, bm, err + 1)))
        nxt = [np.concatenate(part) for part in zip(*equal, *mixed, strict=True)]
        keep = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget)
        stack.append((d + 1, *(x[keep] for x in nxt)))


def links(fps: np.ndarray, choice: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct `fps` that agree in the chosen blocks: (fingerprint, its root)."""
    moved = rearranged(fps, choice)
    order = np.argsort(moved)
    moved, fps = moved[order], fps[order]
    depth = _depth(choice)
    start = moved >> np.uint64(BITS - depth)
    groups = np.concatenate([[0], np.flatnonzero(start[1:] != start[:-1]) + 1, [len(start)]])
    forest = Forest(len(fps))
    # near ones first: a group of close copies is then one component before the wide budget looks at it
    for b in dict.fromkeys((min(1, budget), budget)):
        trie_join(moved, groups, depth, b, forest)
    tied = np.flatnonzero(forest.label != np.arange(len(fps)))
    return fps[tied], fps[forest.label[tied]]


def linked(fps: DataFrame) -> DataFrame:
    """(u, v) links between distinct fingerprints `fp`, enough to connect all that differ in at most BUDGET bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for c in range(len(CHOICES)):
                start = rearranged(x, c) >> np.uint64(BITS - _depth(c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(start.view(np.int64)), b["fp"]], ["choice", "start", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (choice, start); subtrees are joined whole, many at a time."""

        def found(choice: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for c in np.unique(choice):
                u, v = links(fp[choice == c].view(np.uint64), int(c))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held: list[pa.RecordBatch] = []
        rows, look = 0, HELD
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < look:
                continue
            t = pa.Table.from_batches(held)
            choice, start, fp = (t[c].to_numpy() for c in ("choice", "start", "fp"))
            # the last subtree may go on in the next batch
            ends = np.flatnonzero((choice[1:] != choice[:-1]) | (start[1:] != start[:-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from found(choice[:cut], fp[:cut])
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
            look = max(HELD, 2 * rows)  # a subtree that fills what is held is looked at again when it has doubled
        if rows:
            t = pa.Table.from_batches(held)
            yield from found(t["choice"].to_numpy(), t["fp"].to_numpy())

    dealt = fps.select("fp").mapInArrow(spread, "choice int, start long, fp long").repartition("choice", "start")
    return dealt.sortWithinPartitions("choice", "start").mapInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs` (doc_id, text; other columns ignored).

    component_id: smallest doc_id reachable by links. Equal fingerprints (so also null, empty and blank texts) are one
    node. Rows with null doc_id link like others, but their id names no component unless all ids in it are null.
    Repeated rows stay; an empty table gives none."""
    prints = stored(fingerprints(docs))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(linked(nodes))
    named = found.join(nodes, found.node == nodes.fp)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    member = found.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    # stored, so that the last join reads both sides straight from shuffles and can split a fingerprint of many copies
    of = stored(nodes.join(member, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprint and component of every document; edge cases as in `near_duplicates`."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
