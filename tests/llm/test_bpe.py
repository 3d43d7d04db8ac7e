import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tesserae.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    fixed = ["", " ", "  ", "a", " a  b\n c", "aaaaaaaaa", "abababab" * 30, "x  y", "don't we'll  go\n\n\n", "<|endoftext|> é ü 漢字 🙂🙂", "\x1c a \x85b", "a\n b", "a \nb ", "12345 678", "!!??..,,", "﻿x   y"]
    alphabet = "abcdeé漢 \n\t '!1🙂"
    return fixed + ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(400)] + ["ab" * 20000, " " * 3000]


def test_replay_equals_library(library):
    ts = texts()
    ids, counts = bpe.Encoder(PATH).encode(ts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for t, p in zip(ts, parts):
        assert p.tolist() == library.encode_ordinary(t), repr(t[:60])
        assert bpe.merges(PATH).decode(p) == t.encode()


def test_replay_equals_piecewise_spelling():
    m = bpe.merges(PATH)
    rng = random.Random(3)
    pieces = ["".join(rng.choices("abcdeinrt", k=rng.randint(1, 25))).encode() for _ in range(500)]
    ids, sizes = m.replay(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [m.spell(p) for p in pieces]
    assert [len(x) for x in m.replay([])] == [0, 0]


def test_operator_edge_rows(spark):
    rows = [(1, "ab ab", "x"), (1, "ab ab", "x"), (None, None, None), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.encoded(docs, PATH).collect(), key=str)
    assert len(got) == 4 and sum(len(r.ids) for r in got) > 0
    back = bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()
    assert sorted(bytes(r.bytes) for r in back) == [b"", b"", b"ab ab", b"ab ab"]
    assert bpe.round_trip(docs, PATH).count() == 4
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_arrow_and_pattern_cuts_agree(library):
    """Texts where blanks stand beside other white space, at either end, or nowhere."""
    rng = random.Random(11)
    ts = ["", " ", "  ", " a", "a ", "a  b", "a  b", " ", "a\n b c", "a b\n", " a b\n ", "x", "　 y z"] * 3
    ts += ["".join(rng.choices(["ab", " ", "c", "\n", " ", "!", "  "], k=rng.randint(0, 30))) for _ in range(500)]
    e = bpe.Encoder(PATH)
    for part in (ts, ts[::-1], []):
        ids, counts = e.encode(part)
        at = np.cumsum(counts) - counts
        assert [ids[a : a + n].tolist() for a, n in zip(at, counts)] == [library.encode_ordinary(t) for t in part]
