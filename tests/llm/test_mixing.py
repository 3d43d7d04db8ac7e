import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import mixing


def test_targets_share_and_stop():
    got = mixing.targets([100, 100, 100, 10], [5, 2, 1, 5])
    assert sum(got) == pytest.approx(310) and got[3] == 30
    assert got[0] == pytest.approx(280 * 5 / 8) and got[2] == pytest.approx(280 / 8)
    assert mixing.targets([0, 10], [5, 2]) == [0, 10]
    assert mixing.targets([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000, 4097])
def test_permutation_is_a_bijection(n):
    got = mixing.permuted(np.arange(n), n, 12345)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 100 or got.tolist() != mixing.permuted(np.arange(n), n, 999).tolist()


def test_draws_meet_what_is_owed():
    got = mixing.draw([1000, 10, 0, 333], 16)
    assert got.sum(axis=0).tolist() == [1000, 10, 0, 333] and (got >= 0).all()
    assert max(got.sum(axis=1)) - min(got.sum(axis=1)) <= 1


def corpus():
    rows = [(i, "w " * (i * 37 % 400), "s%d" % (i % 5) if i % 9 else None) for i in range(300)]
    return rows + [(7, None, "s1"), (7, "", "s1"), (None, "a b c", "s2"), (8, "x y " * 60, "s0"), (8, "x y " * 60, "s0")]


def test_mix_meets_targets(spark):
    docs = spark.createDataFrame([(*r, 1) for r in corpus()], "doc_id long, text string, source string, size int")

    def run():
        _, placed, sources = mixing.prepared(docs, keep_text=False)
        taken = mixing.mixed(placed, sources).groupBy("_uid").sum("n_words").withColumnRenamed("sum(n_words)", "taken")
        return placed.join(taken, "_uid", "left").fillna(0, ["taken"]).select("doc_id", "source", "size", "source_size", "target", "taken").toPandas()

    got = run()
    assert len(got) == len(corpus())
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby(got.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), said=("source_size", "first"))
    assert (by["size"] == by.said).all()
    assert ((by.taken - by.target).abs() <= 0.02 * by.target + mixing.BLOCK).all()
    assert by.target.sum() == pytest.approx(by["size"].sum())
    key = lambda d: sorted(map(str, d.itertuples(index=False)))
    assert key(got) == key(run())


def plain_permuted(i, n, key):
    """The swap-or-not shuffle written out with Python's integers."""
    mask = (1 << 64) - 1

    def scramble(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    for r in range(mixing.ROUNDS):
        k = scramble((key * 1_000_003 + r * 97 + 1) & mask)
        partner = (k % n - i) % n
        if scramble((max(i, partner) + k * 3) & mask) >> 63:
            i = partner
    return i


@pytest.mark.parametrize("partitions", [1, 7])
def test_taken_equals_brute_force(spark, partitions):
    """Documents laid end to end by hand, and every slot's block looked up word by word."""
    rows = [*corpus(), *[(None, "again and again", "s2")] * 50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions, "text")
    _, base, sources = mixing.prepared(docs, keep_text=False)
    taken = mixing.mixed(base, sources, shards=8).groupBy("_uid").sum("n_words").withColumnRenamed("sum(n_words)", "taken")
    got = collections.Counter((r.doc_id, r.source, r.size, r.taken or 0) for r in base.join(taken, "_uid", "left").collect())
    groups = max(1, -(-len(rows) // mixing.GROUP))
    hashed = docs.select("doc_id", "source", "text", F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(groups)).alias("g")).collect()
    want = collections.Counter()
    for s in sources:
        own = [(r.g, r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").split()), r.doc_id) for r in hashed if r.source == s["source"]]
        words = [n for n, x in enumerate(sorted(own, key=lambda x: x[:5])) for _ in range(x[4])]
        times = np.zeros(len(own), int)
        for j in range(s["slots"]):
            t, i = divmod(j, s["blocks"])
            block = plain_permuted(i, s["blocks"], (mixing.SEED * 1_000_003 + s["src"]) * 1_009 + t)
            for n in words[block * mixing.BLOCK : (block + 1) * mixing.BLOCK]:
                times[n] += 1
        ordered = sorted(own, key=lambda x: x[:5])
        want.update((x[5], s["source"], x[4], int(n)) for x, n in zip(ordered, times, strict=True))
    # of equal documents it is open which is which
    total = lambda c: collections.Counter({k: 0 for k in ()}) + sum((collections.Counter({(d, s, n): t * m}) for (d, s, n, t), m in c.items()), collections.Counter())
    assert total(got) == total(want) and sum(got.values()) == len(rows)


def test_long_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000, "a"), (2, "x", "b"), (3, None, None)], "doc_id long, text string, source string")
    _, base, sources = mixing.prepared(docs, keep_text=False)
    got = {r._uid: r.n for r in mixing.mixed(base, sources).groupBy("_uid").agg(F.sum("n_words").alias("n")).collect()}
    assert sum(got.values()) == pytest.approx(200_001, rel=0.01)
    assert mixing.prepared(docs.limit(0), keep_text=False)[1].count() == 0


def test_mixed_texts_have_the_taken_words(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 90)), "en", "ab"[i % 7 == 0], 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_texts(docs).collect()
    total = sum(i % 90 for i in range(120))
    words = [w for r in got for w in r.text.split()]
    assert abs(len(words) - total) <= 0.05 * total
    assert all(r.n_chars == len(r.text) and all(w.startswith(f"w{r.doc_id}x") for w in r.text.split()) for r in got)
    assert max(np.unique(words, return_counts=True)[1]) <= 3
    assert mixing.mixed_texts(docs.limit(0)).count() == 0


def test_cut_keeps_white_space():
    assert mixing.cut("a  b\tc d", [(0, 2), (3, 4)]) == "a  b\nd"
    assert mixing.cut(" a b ", [(0, 2)]) == " a b "
