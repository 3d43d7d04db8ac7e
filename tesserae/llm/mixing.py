"""Mixing sources to target weights by fixed-length blocks of words.

Each source's documents are laid end to end and cut into blocks of BLOCK words. The mix is a set of slots: every
output shard draws its number of slots of each source from a multinomial over what the sources still owe, and a
source's slots run through its blocks in a pseudorandom order, pass after pass. Slots and document pieces meet by
(source, block). A pass visits each block once, so no block is taken more than ceil(target / size) times.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import bounded_batches, places, stored

BLOCK, SHARDS, SEED, MOST = 32, 64, 20, 3.0
#: Repeating weights by the sources' order (fixed by the contract).
WEIGHTS = (5.0, 2.0, 1.0)
ROUNDS = 12
#: Slots that one task row stands for and that one task makes, and documents in one prefix-sum group.
CHUNK, TASK, GROUP = 1 << 14, 1 << 18, 1000


def sized(docs: DataFrame) -> DataFrame:
    """`docs` with long `size` (words of the text; null: 0) and long `_crc` of the text; columns of these names go."""
    docs = docs.drop("size", "_crc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].cast(pa.binary()).to_pylist()
            size = pa.array([len(t.split()) if t else 0 for t in texts], pa.int64())
            crc = pa.array([zlib.crc32(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, size, crc], [*b.schema.names, "size", "_crc"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("size", LongType()), StructField("_crc", LongType())]))


def targets(sizes: list[float], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most x its size; what is cut off goes to the others by weight."""
    caps = [most * s for s in sizes]
    out, free, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, float(sum(sizes))
    while free:
        per = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * per > caps[i]}
        if not over:
            for i in free:
                out[i] = weights[i] * per
            break
        for i in over:
            out[i] = caps[i]
            left -= caps[i]
        free -= over
    return out


def draw(slots: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) slot counts: multinomial draws over what each source still owes; columns sum to `slots`."""
    rng = np.random.default_rng(seed)
    owed = np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for m in range(shards):
        need = int(owed.sum()) // (shards - m)
        while need:
            got = np.minimum(rng.multinomial(need, owed / owed.sum()), owed)
            out[m] += got
            owed -= got
            need -= int(got.sum())
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64; fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """The image of indices `i` under a pseudorandom permutation of range(n): a swap-or-not shuffle."""
    i = i.astype(np.uint64)
    size = np.uint64(n)
    with np.errstate(over="ignore"):
        for r in range(ROUNDS):
            k = _mix64(np.array([(key * 1_000_003 + r * 97 + 1) % (1 << 64)], np.uint64))
            partner = (k % size + size - i) % size
            coin = _mix64(np.maximum(i, partner) + k * np.uint64(3)) >> np.uint64(63)
            i = np.where(coin == 1, partner, i)
    return i.astype(np.int64)


def _listed(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A table planned on the driver."""
    return spark.createDataFrame(pa.table(columns))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> list[dict]:
    """A row for each source: its number, size, target, blocks and slots. Sources by code point, null last. Sources are a
    dimension of the corpus: the driver holds a row for each, and SHARDS slot counts."""
    found = docs.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found = sorted(((r["source"], int(r["n"] or 0)) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    want = targets([n for _, n in found], [weights[k % len(weights)] for k in range(len(found))], most)
    out = []
    for k, ((source, n), target) in enumerate(zip(found, want, strict=True)):
        blocks = -(-n // block)
        slots = min(round(target * blocks / n), int(most * blocks)) if n else 0
        out.append({"src": k, "source": source, "source_size": n, "target": target, "blocks": blocks, "slots": slots})
    return out


def placed(docs: DataFrame, sources: list[dict]) -> DataFrame:
    """`docs` (stored, with _uid; narrow, as they are shuffled) with _src and _at, the words of its source laid before it (order: a hash, then doc_id).

    Documents are summed in groups of about GROUP, groups in spans of GROUP groups, so no window grows with a source."""
    spark = docs.sparkSession
    column = lambda name, kind: pa.array([s[name] for s in sources], kind)
    dim = _listed(spark, {"_src": column("src", pa.int32()), "_name": column("source", pa.string()), "source_size": column("source_size", pa.int64()), "target": column("target", pa.float64())})
    docs = docs.drop("_src", "source_size", "target").join(dim, docs.source.eqNullSafe(dim._name)).drop("_name")
    groups = max(1, -(-docs.count() // GROUP))
    tied = docs.withColumn("_group", F.pmod(F.xxhash64("doc_id", "_crc"), F.lit(groups))).withColumn("_tie", F.struct("doc_id", "_crc", "size"))
    sums = tied.groupBy("_src", "_group").agg(F.sum("size").alias("_sum")).withColumn("_span", F.floor(F.col("_group") / GROUP))
    spans = sums.groupBy("_src", "_span").agg(F.sum("_sum").alias("_total"))
    up = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("_src", "_span", up("_total", ["_src"], "_span").alias("_first"))
    sums = sums.withColumn("_second", up("_sum", ["_src", "_span"], "_group")).join(spans, ["_src", "_span"])
    out = places(tied, ["_src", "_group"], "_tie", F.col("size")).withColumnRenamed("_at", "_own")
    out = out.join(sums.select("_src", "_group", (F.col("_first") + F.col("_second")).alias("_base")), ["_src", "_group"])
    return out.withColumn("_at", F.col("_base") + F.col("_own")).drop("_base", "_own", "_group", "_tie")


def slots(spark: SparkSession, sources: list[dict], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, slot, _src, _block) of every slot of the mix."""
    counts = draw([s["slots"] for s in sources], shards, seed)
    firsts = np.cumsum(counts, axis=0) - counts
    m, k = np.nonzero(counts)
    blocks = np.array([s["blocks"] for s in sources], np.int64)
    rows = {"shard": m.astype(np.int32), "src": k.astype(np.int32), "first": firsts[m, k], "n": counts[m, k], "blocks": blocks[k]}
    listed = _listed(spark, {c: pa.array(x) for c, x in rows.items()})
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    # dealt by the number of slots, which the few bytes of their description do not tell
    tasks = max(1, min(-(-int(counts.sum()) // TASK), 1 << 16))
    chunks = listed.withColumn("part", part).repartition(tasks, "shard", "src", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                j = r["first"] + np.arange(r["part"] * CHUNK, min(r["n"], (r["part"] + 1) * CHUNK), dtype=np.int64)
                turn, block = j // r["blocks"], np.empty(len(j), np.int64)
                for t in np.unique(turn).tolist():
                    at = turn == t
                    block[at] = permuted(j[at] % r["blocks"], r["blocks"], (seed * 1_000_003 + r["src"]) * 1_009 + t)
                whole = lambda v: pa.array(np.full(len(j), v, np.int32))
                yield pa.RecordBatch.from_arrays([whole(r["shard"]), pa.array(j), whole(r["src"]), pa.array(block)], ["shard", "slot", "_src", "_block"])

    return chunks.mapInArrow(run, "shard int, slot long, _src int, _block long")


def mixed(docs: DataFrame, sources: list[dict], block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: (shard, slot, _uid, first_word, n_words), the pieces of documents that each slot takes."""
    ends = docs.filter("size > 0").withColumn("_end", F.col("_at") + F.col("size"))
    each = ends.select("_src", "_uid", "_at", "_end", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_end") - 1) / block))).alias("_block"))
    lo = F.greatest(F.col("_block") * block, F.col("_at"))
    hi = F.least((F.col("_block") + 1) * block, F.col("_end"))
    pieces = each.select("_src", "_block", "_uid", (lo - F.col("_at")).alias("first_word"), (hi - lo).alias("n_words"))
    # both sides grow with the corpus, whatever a planner makes of the literal behind the slots: no broadcast here
    return slots(docs.sparkSession, sources, shards, seed).hint("merge").join(pieces.hint("merge"), ["_src", "_block"]).select("shard", "slot", "_uid", "first_word", "n_words")


def prepared(docs: DataFrame, keep_text: bool = True) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(documents with sizes, without their texts unless kept, and _uid; their places without texts; the sources' plan).
    The texts are read once."""
    base = sized(docs.drop("_uid")).withColumn("_uid", F.monotonically_increasing_id())
    base = stored(base if keep_text else base.drop("text"))
    sources = plan(base)
    return base, placed(base.select("_uid", "doc_id", "source", "size", "_crc"), sources), sources


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what the mix takes of every document.

    Null or blank text: size 0, taken 0. Null source: a source of its own, last. A source without words has target 0.
    Null doc_id and repeated rows: rows of their own. Extra columns are ignored; an empty table gives no rows."""
    _, docs, sources = prepared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), keep_text=False)
    docs = stored(docs)
    taken = mixed(docs, sources).groupBy("_uid").agg(F.sum("n_words").alias("taken"))
    out = docs.join(taken, "_uid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """Words [a, b) of the text for each span, in order, with the white space between them; spans join by a line feed."""
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    if spans == [(0, len(words))]:
        return text
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in spans)


def mixed_texts(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) as the mix has them: a document taken k times is k rows, each with
    the words that are taken so often; documents without taken words go. Columns are those of `docs`; n_chars follows."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    base, places_, sources = prepared(docs.select(*names))
    times = mixed(places_.select("_uid", "_src", "_at", "size"), sources).groupBy("_uid", "first_word", "n_words").agg(F.count("*").alias("times"))
    spans = times.groupBy("_uid").agg(F.collect_list(F.struct("first_word", "n_words", "times")).alias("_spans"))
    joined = base.select("_uid", *names).join(spans, "_uid").drop("_uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                own = sorted((s["first_word"], s["n_words"], s["times"]) for s in r.pop("_spans"))
                for k in range(1, max(t for *_, t in own) + 1):
                    runs: list[tuple[int, int]] = []
                    for first, n, t in own:
                        if t >= k:
                            if runs and runs[-1][1] == first:
                                runs[-1] = (runs[-1][0], first + n)
                            else:
                                runs.append((first, first + n))
                    text = cut(r["text"], runs)
                    out.append(r | {"text": text, "n_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([b.schema.field(n) for n in names]))

    return joined.mapInArrow(run, docs.select(*names).schema)
