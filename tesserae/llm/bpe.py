"""Byte-level BPE by corpus-level merge replay, and its decoding.

A task takes a bounded block of documents as its corpus: the block's distinct pieces (matches of the splitting
pattern) become one array of bytes, an inverted index maps each mergeable pair's rank to the positions where it
stands, and merges are applied in rank order over the whole block, touching only the neighbours of what was merged.
Documents are then spelled from the pieces' ids, so a text costs a table lookup a word. No shuffle takes place.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches

#: Bytes of text that a task holds as one corpus; it bounds memory and does not change any id.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose ids are put together at once.
SLICE_BYTES = 1 << 19
#: Chunks kept spelled between blocks of one task, and chunks matched in one run.
KEEP_CHUNKS, RUN = 450_000, 256


class Merges:
    """Pair ranks of a byte-level vocabulary, for looking up whole arrays of pairs at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        found = [(ranks[t[:i]] << 17 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        table = np.array(sorted(found), np.int64)
        self.keys, self.values = table[:, 0].copy(), table[:, 1].astype(np.int32)
        data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes, self.starts = data, np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has no such token; ids below 0 are boundaries."""
        key = left.astype(np.int64) << 17 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], -1)

    def spell(self, piece: bytes) -> list[int]:
        """One piece, merge by merge: the rule by which the corpus replay is tested, and its way out (see `replay`)."""
        ids = [int(self.byte_ids[b]) for b in piece]
        while len(ids) > 1:
            pairs = [self.ranks.get(self.tokens[a] + self.tokens[b], 1 << 30) for a, b in zip(ids, ids[1:], strict=False)]
            best = min(pairs)
            if best == 1 << 30:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best]
        return ids

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each): all merges in rank order over all pieces at once."""
        if not pieces:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        tok = self.byte_ids[data]
        tok[starts + lengths] = -1  # a boundary after each piece
        size = len(tok)
        nxt, prv = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        nxt[-1] = size - 1
        prv[0] = size - 1  # the last boundary stands before the first piece too
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(ranks: np.ndarray, positions: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, p in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        first = self.rank(tok, tok[nxt])
        if (has := np.flatnonzero(first >= 0)).size:
            add(first[has], has)
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            at = at[tok[at] >= 0]
            at = at[self.rank(tok[at], tok[nxt[at]]) == r]
            if not at.size:
                continue
            # of overlapping occurrences the first, the third, ... of each run merge
            chained = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
            if chained.any():
                run = np.arange(at.size) - np.maximum.accumulate(np.where(chained, 0, np.arange(at.size)))
                at = at[run % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            tok[at], tok[gone] = r, -2
            nxt[at], prv[after] = after, at
            left = prv[at]
            positions = np.concatenate([left, at])
            ranks = self.rank(tok[positions], tok[nxt[positions]])
            has = ranks >= 0
            if has.any():
                positions, ranks = positions[has], ranks[has]
                if (ranks < r).any():  # a merge made an earlier one possible: its order within the piece matters
                    odd.append(positions[ranks < r])
                add(ranks, positions)
        alive = np.flatnonzero(tok >= 0)
        sizes = np.bincount(np.searchsorted(starts, alive, "right") - 1, minlength=len(pieces))
        if not odd:
            return tok[alive], sizes
        each = np.split(tok[alive], np.cumsum(sizes)[:-1])
        for i in set((np.searchsorted(starts, np.concatenate(odd), "right") - 1).tolist()):
            each[i] = np.array(self.spell(pieces[i]), np.int32)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Texts to ids. A text is cut where white space follows something else (mostly at a blank): no match of the
    pattern crosses such a place, so a chunk's ids depend on the chunk alone and are looked up once it is known."""

    block_bytes = BLOCK_BYTES

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.merges, self.pattern = merges(path), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.flat, self.sizes, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def spell(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of ids of each): all their distinct pieces in one replay."""
        split = matched(chunks, self.pattern)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        number = Numbers()
        at = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
        ids, sizes = self.merges.replay([p.encode("utf-8", "surrogatepass") for p in number])
        return ragged(ids, (np.cumsum(sizes) - sizes)[at], sizes[at]), grouped_sums(sizes[at], counts)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(chunk numbers of all texts one after another, number of chunks of each); new chunks get the next numbers."""
        keys = [_keys(t) for t in texts]
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        return np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(keys)), np.int32, int(counts.sum())), counts

    def learn(self) -> None:
        """Spells the chunks that have a number but no ids yet, all at once."""
        new = list(itertools.islice(self.known, len(self.sizes), None))
        if new:
            ids, sizes = self.spell([k[1:] if k[:1] == " " else " " + k for k in new])
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes

    def ids(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) from what `numbers` gave."""
        sizes = self.sizes[numbers]
        return ragged(self.flat, self.starts[numbers], sizes), grouped_sums(sizes, counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.numbers(texts)
        self.learn()
        return self.ids(*found)

    def encoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """(rows, their ids, numbers of ids) for batches with a column `text`; null text: empty. Texts are cut a slice at
        a time, a block's chunks are learnt together, and of a block only its chunk numbers stay until then."""
        for block in blocks(batches, self.block_bytes):
            if len(self.known) > KEEP_CHUNKS:
                self.forget()
            parts = list(blocks(iter(block.to_batches()), SLICE_BYTES))
            found = [self.numbers([x or "" for x in rows["text"].to_pylist()]) for rows in parts]
            self.learn()
            for rows, x in zip(parts, found, strict=True):
                yield rows, *self.ids(*x)


class Numbers(dict):
    """Keys numbered in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def begins_plainly(chunk: str) -> bool:
    """One blank, at the start, and no white space at the end: in a run of such chunks no match crosses into the next,
    and each blank starts a chunk."""
    return chunk[0] == " " and chunk.rfind(" ") == 0 and not chunk[-1].isspace()


def matched(chunks: list[str], pattern: regex.Pattern) -> list[list[str]]:
    """Matches of the pattern in each chunk; plain ones are matched in runs."""
    out: list[list[str] | None] = [None] * len(chunks)
    plain = [i for i, c in enumerate(chunks) if begins_plainly(c)]
    for k in range(0, len(plain), RUN):
        part = plain[k : k + RUN]
        found = pattern.findall("".join([chunks[i] for i in part]))
        cuts = [j for j, p in enumerate(found) if p[0] == " "]
        if len(cuts) == len(part):
            for i, (x, y) in zip(part, itertools.pairwise([*cuts, len(found)]), strict=True):
                out[i] = found[x:y]
    return [pattern.findall(c) if ps is None else ps for c, ps in zip(chunks, out, strict=True)]


def grouped_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values`, `counts` long."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _keys(text: str) -> list[str]:
    """A text's chunks, those that start with one blank without it, others after a blank of their own."""
    if not text:
        return []
    if _ODD.search(text):
        return [c[1:] if c[0] == " " and c[1:2] != " " else " " + c for c in _CHUNK.findall(text)]
    parts = text.split(" ")
    if parts[0]:
        parts[0] = " " + parts[0]
    else:
        del parts[0]
    return parts


#: A blank after other white space, and the chunks of a text that has it: white space, then what follows.
_ODD, _CHUNK = re.compile(r"\s "), regex.compile(r"\s*\S+|\s+")


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for all i, one after another."""
    total = int(lengths.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return flat[np.repeat(shift, lengths) + np.arange(total)]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Batches joined, or cut between rows, to tables of about `limit` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        step = max(1, int(whole.num_rows * limit / max(whole.nbytes, 1)))
        for i in range(0, whole.num_rows, step):
            b = whole.slice(i, step)
            held.append(b)
            size += b.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) per row of `docs`; null text: empty, so no ids. Rows stay in place and stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for t, ids, counts in encoder.encoded(batches):
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids); null ids: empty. Bytes and not text, as ids may cut a character."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = merges(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "bytes": [m.decode(x) if x is not None else b"" for x in b["ids"]]})

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, and digests both in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for t, ids, counts in encoder.encoded(batches):
            ends = np.cumsum(counts).tolist()
            packed = ids.astype("<u4", copy=False)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            parts = [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), pa.array(counts), pa.array([sha(p) for p in parts], pa.string()), pa.array([sha(encoder.merges.decode(p)) for p in parts], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: round trip of every document. Null or empty text: no ids, digests of nothing. Null doc_id and repeated
    rows: kept as they are. Extra columns are ignored; an empty table gives no rows."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
