"""Token ids in Parquet files: delta-encoded list columns and positions, bounded row groups and pages.

Rows are dealt by ranges of (doc_id, length), so the files in order of their part number hold the documents in
order. Each row carries its start within its part; a part's own start comes from the parts' totals, which a reader
takes from the narrow columns alone. Row groups and pages are small enough, and the page indexes of the sorted
doc_id tight enough, that a range of documents or the metadata can be read without the rest.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RUN, SLICE_BYTES, Encoder, Numbers, _keys, begins_plainly, blocks, grouped_sums, ragged
from .common import bounded_batches, shared_dir

#: Parquet settings of the format. Version 2 pages without dictionaries give DELTA_BINARY_PACKED integers: ids of a
#: large vocabulary are as small that way as by dictionary, and cheaper to write.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.columnindex.truncate.length": "64",
    "compression": "snappy",
}
SCHEMA = "doc_id long, part int, start long, n_tokens long, ids array<int>"


@functools.lru_cache(maxsize=2)
def _library(path: str):
    """(tokenizer as the file has it, the same with added tokens as plain text, the added tokens' strings, flags of the ids
    that start with a blank, id of a line feed), once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    blank = np.zeros(plain.get_vocab_size(), bool)
    blank[[i for i in range(len(blank)) if plain.id_to_token(i).startswith("\u0120")]] = True  # the byte-level form of a blank
    return whole, plain, added, blank, plain.token_to_id("\u010a")


class LibraryEncoder(Encoder):
    """Ids by the tokenizers library, once for each distinct chunk. A text with an added token's string (such as
    `<|endoftext|>`, which the library gives its own id) is handed to the library whole."""

    block_bytes = 20 << 20

    def __init__(self, path: str):
        self.whole, self.tokenizer, self.added, self.blank, self.feed = _library(path)

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(chunk numbers of all texts one after another, number of chunks of each); the chunks' ids are kept for `ids`.

        Arrow cuts at blanks and finds the distinct parts; each is a chunk after a blank. Plain words, with or without a
        mark at their end, are spelled from Arrow columns; parts with a line feed, the first part of a text (nothing
        stands before it) and texts with a blank that is no place to cut (a part that is empty or ends in white space
        shows it) are cut one by one."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64) - int(lists.offsets[0].as_py())
        distinct = lists.flatten().dictionary_encode()
        del lists
        parts, at, counts = distinct.dictionary, distinct.indices.to_numpy(), np.diff(offsets)
        last = pc.utf8_slice_codeunits(parts, -1).dictionary_encode()
        ends, ending = last.dictionary.to_pylist(), last.indices.to_numpy()
        odd = np.fromiter((not c or c.isspace() for c in ends), bool, len(ends))[ending]
        broken = pc.match_substring(parts, "\n").to_numpy(zero_copy_only=False) & ~odd
        easy = np.flatnonzero(~odd & ~broken)
        body = pc.utf8_slice_codeunits(parts, 0, -1)
        marked = np.fromiter((c in _MARKS for c in ends), bool, len(ends))[ending] & pc.utf8_is_alpha(body).to_numpy(zero_copy_only=False)
        words = pc.if_else(pa.array(marked), body, parts).take(pa.array(easy)).dictionary_encode()
        flat, sizes = self.words(words.dictionary)
        where = words.indices.to_numpy()
        sizes, own = sizes[where], (np.cumsum(sizes) - sizes)[where]
        marked = marked[easy]
        marks = np.array([self._alone(c)[0] if c in _MARKS else 0 for c in ends], np.int32)
        flat = np.insert(ragged(flat, own, sizes), np.cumsum(sizes)[marked], marks[ending[easy[marked]]])
        # numbers: the easy parts, those with a line feed, then single chunks
        number = np.zeros(len(parts), np.int32)
        number[easy] = np.arange(len(easy))
        number[broken] = len(easy) + np.arange(int(broken.sum()))
        others = [" " + p for p in parts.filter(pa.array(broken)).to_pylist()]
        single = Numbers()
        found = number[at]
        base = len(easy) + len(others)
        first = offsets[:-1][counts > 0]
        found[first] = base + np.fromiter((single[p] for p in parts.take(pa.array(at[first])).to_pylist()), np.int32, len(first))
        whole = np.flatnonzero(grouped_sums(odd[at].astype(np.int64), counts))
        if len(whole):
            each = np.split(found, offsets[1:-1])
            for i in whole.tolist():
                each[i] = base + np.array([single[k[1:] if k[:1] == " " else " " + k] for k in _keys(texts[i].as_py())], np.int32)
            found, counts = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        rest, rest_sizes = self.spell([*others, *(c for c in single)])
        self.flat, self.sizes = np.concatenate([flat, rest]), np.concatenate([sizes + marked, rest_sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        return found, counts

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words without white space, each after a blank, number of ids of each): words go to the library side by
        side, as the ids that start with a blank tell them apart."""
        n = len(words)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        cuts = np.append(np.arange(0, n, RUN), n).astype(np.int32)
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ").to_pylist()
        ids, sizes = [], []
        for k in range(0, len(runs), 64):
            for run, lo, hi, got in zip(runs[k : k + 64], cuts[k:], cuts[k + 1 :], self.tokenizer.encode_batch_fast([" " + r for r in runs[k : k + 64]], add_special_tokens=False), strict=False):
                own = np.array(got.ids, np.int32)
                lengths = np.diff(np.append(np.flatnonzero(self.blank[own]), len(own)))
                if len(lengths) != hi - lo or lengths.sum() != len(own):
                    each = [self._alone(" " + w) for w in run.split(" ")]
                    own, lengths = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
                ids.append(own)
                sizes.append(lengths)
        return np.concatenate(ids), np.concatenate(sizes)

    def _alone(self, chunk: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids, np.int32)

    def encoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        for block in blocks(batches, self.block_bytes):
            texts = block["text"].combine_chunks().fill_null("")
            marked = self.marked(texts)
            numbers, counts = self.coded(pc.if_else(pa.array(marked), "", texts) if marked.any() else texts)
            del texts
            pa.default_memory_pool().release_unused()  # the cut texts are gone by now
            row = at = 0
            for rows in blocks(iter(block.to_batches()), SLICE_BYTES):
                own = counts[row : row + rows.num_rows]
                n = int(own.sum())
                ids, sizes = self.ids(numbers[at : at + n], own)
                if (whole := np.flatnonzero(marked[row : row + rows.num_rows])).size:
                    each = np.split(ids, np.cumsum(sizes)[:-1])
                    for i in whole.tolist():
                        each[i] = np.array(self.whole.encode_batch_fast([rows["text"][i].as_py()], add_special_tokens=False)[0].ids, np.int32)
                    ids, sizes = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
                yield rows, ids, sizes
                row, at = row + rows.num_rows, at + n

    def marked(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold an added token's string."""
        out = np.zeros(len(texts), bool)
        for token in self.added:
            out |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return out

    def spell(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of ids of each) by distinct pieces: a mark after letters and a line feed inside a chunk are matches of their own, so words
        are encoded once whatever stands around them."""
        pieces: list[str] = []
        counts = np.empty(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            had = len(pieces)
            if "\n" in c and _BROKEN.fullmatch(c):
                left, _, right = c.partition("\n")
                _unmarked(left, pieces)
                pieces.append("\n")
                _unmarked(right, pieces)
            else:
                _unmarked(c, pieces)
            counts[i] = len(pieces) - had
        number = Numbers()
        where = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        ids, sizes = self._pieces(list(number))
        return ragged(ids, (np.cumsum(sizes) - sizes)[where], sizes[where]), grouped_sums(sizes[where], counts)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces go to the library in runs: those that start with a blank side by side, as the ids that start with a
        blank tell them apart; those without white space a line each, as a line feed between them is one id."""
        order, ids, sizes, alone = [], [], [], []
        plain, bare = [], []
        for i, p in enumerate(pieces):
            (plain if begins_plainly(p) else bare if _BARE.fullmatch(p) else alone).append(i)
        for which, joint in ((plain, ""), (bare, "\n")):
            for k in range(0, len(which), RUN):
                part = which[k : k + RUN]
                whole = np.array(self.tokenizer.encode_batch_fast([joint.join([pieces[i] for i in part])], add_special_tokens=False)[0].ids, np.int32)
                if joint:
                    cuts = np.flatnonzero(whole == self.feed)
                    lengths = np.diff(np.concatenate([[-1], cuts, [len(whole)]])) - 1
                    whole = np.delete(whole, cuts)
                else:
                    lengths = np.diff(np.append(np.flatnonzero(self.blank[whole]), len(whole)))
                if len(lengths) == len(part) and lengths.sum() == len(whole):
                    order += part
                    ids.append(whole)
                    sizes.append(lengths)
                else:
                    alone += part
        for i in alone:
            ids.append(self._alone(pieces[i]))
            sizes.append(np.array([len(ids[-1])], np.int64))
        if not pieces:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        back = np.argsort(np.array(order + alone, np.int64))
        flat, counts = np.concatenate(ids), np.concatenate(sizes)
        return ragged(flat, (np.cumsum(counts) - counts)[back], counts[back]), counts[back]


def _unmarked(chunk: str, out: list[str]) -> None:
    if not chunk:
        return
    if chunk[-1] in _MARKS and chunk[1:-1].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
        out.append(chunk[:-1])
        out.append(chunk[-1])
    else:
        out.append(chunk)


#: A chunk with one line feed between two parts without white space, and text without any.
_BROKEN, _BARE = regex.compile(r" ?\S+\n\S+"), regex.compile(r"\S+")
#: Marks that the splitting pattern parts from letters before them.
_MARKS = frozenset(".,;:!?|")


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, **layout: str) -> None:
    """Writes ids of `docs` (doc_id, text; other columns ignored) with `end_id` after each document.

    Null text: the end id alone. Null doc_ids come first; rows of one doc_id are ordered by length and text, and equal
    rows, which cannot be told apart, stay repeated. No file is without a schema, so an empty table reads back.
    layout: Parquet settings in place of those of LAYOUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, part = LibraryEncoder(tokenizer), 0, TaskContext.get().partitionId()
        for t, ids, counts in encoder.encoded(batches):
            ids = np.insert(ids, np.cumsum(counts), end_id)
            offsets = np.concatenate([[0], np.cumsum(counts + 1)])
            columns = [t["doc_id"].combine_chunks(), pa.array(np.full(len(counts), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(counts + 1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start", "n_tokens", "ids"])
            at += int(offsets[-1])

    bounded_batches(docs.sparkSession)
    # rows of one doc_id part by length too, so that no id binds a file to all its rows; only ties compare texts
    order = ["doc_id", F.octet_length("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ranged.mapInArrow(run, SCHEMA).write.options(**LAYOUT | layout).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): `start` counts the ids of all documents before. Columns not used are not read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # one total a file; the sum over the files before it is its own start
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals])]).astype(int).tolist()
    listed = json.dumps([{"part": p, "first": s} for (p, _), s in zip(totals, starts, strict=False)])
    parts = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<part:int,first:bigint>>")))
    return rows.join(parts, "part").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids")


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents first <= doc_id <= last. As files, row groups and pages are ordered by
    doc_id, their statistics leave all others unread."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.filter(F.col("doc_id").between(first, last)).select("doc_id", "n_tokens", "ids")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, n_tokens): the narrow columns alone; the ids' pages stay unread."""
    return spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "n_tokens")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Adds ids_crc32 (long, unsigned, of the ids as little-endian 32-bit integers) in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = ids.offsets.to_numpy().tolist()
            crc = pa.array([zlib.crc32(flat[x:y]) for x, y in zip(ends, ends[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["n_tokens"], crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: writes all documents' ids to files in the shared folder and returns what reading them back gives."""
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return with_crc32(read_tokens(spark, path))
