"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard owns `vnodes` points of a ring of 2^30 positions; a key belongs to the first point clockwise of its own
hash. A shard takes keys up to its capacity; keys that find it full go on clockwise. The placement is decided on
counts, not rows: arcs are counted in parts of about PART_ROWS rows, so a table of arcs x parts reaches the driver.
Rows then find their shard from their rank in their part by a join with the parts' few segments.
"""

from __future__ import annotations

import bisect
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import places, stored

RING = 1 << 30
#: Rows that are ranked together, about: an arc is cut into parts of so many, at least LEAST_PARTS.
PART_ROWS, LEAST_PARTS = 1 << 20, 16
#: Segments that are broadcast; more are joined.
MOST_BROADCAST = 100_000


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % RING
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


@dataclass(frozen=True)
class Segment:
    """Rows of an arc's part with start <= rank < start + n go to `shard`, slots from `slot` on."""

    arc: int
    part: int
    start: int
    n: int
    shard: int
    slot: int


def place(counts: dict[tuple[int, int], int], nodes: list[tuple[int, int]], shards: int, capacity: list[int]) -> list[Segment]:
    """Bounded loads on counts. In round k every arc offers what it still holds to the k-th *distinct* shard clockwise."""
    room, used, out = list(capacity), [0] * shards, []
    waiting = {key: (0, n) for key, n in sorted(counts.items()) if n}
    order = {arc: list(dict.fromkeys(nodes[(arc + k) % len(nodes)][1] for k in range(len(nodes)))) for arc in {a for a, _ in waiting}}
    for k in range(shards):
        for key in sorted(waiting):
            start, n = waiting[key]
            shard = order[key[0]][k]
            if took := min(n, room[shard]):
                out.append(Segment(*key, start, took, shard, used[shard]))
                room[shard] -= took
                used[shard] += took
                waiting[key] = (start + took, n - took)
        waiting = {key: x for key, x in waiting.items() if x[1]}
    if waiting:
        raise ValueError("the shards' capacity is below the number of rows")
    return out


def capacities(n: int, shards: int, load_factor: float) -> list[int]:
    """load_factor 1: exactly n places, counts at most one apart; above: ceil(load_factor x mean) each."""
    if load_factor > 1:
        return [-int(-load_factor * n // shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def _arc(position: Column, nodes: list[tuple[int, int]]) -> Column:
    """Index of the first node at or after `position`, round the ring: a binary search over a coarse literal table.

    The ring is cut into equal cells; a cell's literal holds the arc at its start and the few nodes inside it."""
    cells = 1 << (max(len(nodes) - 1, 1)).bit_length()
    width = RING // cells
    points = [p for p, _ in nodes]
    first = [bisect.bisect_left(points, c * width) for c in range(cells)]
    inside = [points[first[c] : bisect.bisect_left(points, (c + 1) * width)] for c in range(cells)]
    listed = json.dumps([{"first": f, "inside": xs} for f, xs in zip(first, inside, strict=True)])
    table = F.from_json(F.lit(listed), "array<struct<first:int,inside:array<int>>>")
    cell = F.get(table, F.floor(position / width).cast("int"))
    return ((cell["first"] + F.size(F.filter(cell["inside"], lambda x: x < position))) % len(nodes)).cast("int")


def shard_rows(docs: DataFrame, key: Column, tie: Column, shards: int = 24, vnodes: int = 16, load_factor: float = 1.0) -> DataFrame:
    """`docs` with int `shard` and long `slot` (gapless from 0 within the shard).

    Rows of one key keep one ring position; null keys share one. Reruns agree, however the rows are stored: rows that
    are equal in `tie` are taken for equal. Any key, and any tie, may hold any share of the rows: they are ranked in
    parts, and overflow to further shards. Columns named as the results are replaced. Empty table: no rows."""
    nodes = ring(shards, vnodes)
    position = F.pmod(F.xxhash64(key), F.lit(RING)).cast("int")
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = stored(docs.select(*columns, _arc(position, nodes).alias("_arc"), tie.alias("_tie"), F.monotonically_increasing_id().alias("_uid")))
    n = rows.count()
    parts = max(LEAST_PARTS, -(-n // (PART_ROWS * len(nodes))))
    part = F.pmod(F.xxhash64("_tie", F.lit("part")), F.lit(parts)).cast("int")
    placed = rows.withColumn("_part", part)
    counts = {(r["_arc"], r["_part"]): r["n"] for r in placed.groupBy("_arc", "_part").agg(F.count("*").alias("n")).collect()}
    segments = place(counts, nodes, shards, capacities(n, shards, load_factor))
    schema = "array<struct<_arc:int,_part:int,_start:bigint,_n:bigint,shard:int,_slot:bigint>>"
    listed = json.dumps([dict(_arc=x.arc, _part=x.part, _start=x.start, _n=x.n, shard=x.shard, _slot=x.slot) for x in segments])
    where = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(listed), schema)))
    ranked = places(placed, ["_arc", "_part"], "_tie")
    inside = (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_n"))
    # a part has a segment for each shard it overflows to, and there are arcs x parts of them: small beside the rows
    return (
        ranked.join(F.broadcast(where) if len(segments) <= MOST_BROADCAST else where, ["_arc", "_part"])
        .filter(inside)
        .select(*columns, "shard", (F.col("_slot") + F.col("_at") - F.col("_start")).alias("slot"))
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document in one of 24 shards, law `rows` (counts at most one apart by exact capacities).

    Null text: size 8, crc32 of the empty text. Null or repeated doc_id: placed like any other row. Extra columns are
    ignored; an empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    # digests only: the texts are read once and never shuffled
    out = shard_rows(docs, F.col("doc_id"), F.struct("doc_id", "size", "text_crc32"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
