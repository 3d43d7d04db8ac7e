import random
import re

import numpy as np
import xxhash

from tesserae.llm import components, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items):
    """doc -> smallest doc reachable, over (doc, fp)."""
    parent = {d: d for d, _ in items}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if bin(x ^ y).count("1") <= 4:
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {d: top(d) for d, _ in items}


def near(rng, n):
    """Random fingerprints with chains and clusters around some of them."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for base in list(out)[: n // 4]:
        x = base
        for _ in range(rng.randint(1, 6)):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            out.add(x)
    return sorted(out)


def test_trie_join_equals_all_pairs():
    rng = random.Random(1)
    fps = near(rng, 300) + [v for v in {0xABC0000000000000 | rng.getrandbits(9) for _ in range(300)}]
    fps = sorted(set(fps))
    arr = np.array(fps, np.uint64)
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for c in range(len(simhash.CHOICES)):
        for u, v in zip(*simhash.links(arr, c)):
            p, q = sorted((top(int(u)), top(int(v))))
            parent[q] = p
    want = brute_components([(f, f) for f in fps])
    assert {f: top(f) for f in fps} == want
    assert len(set(want.values())) < len(fps)


def test_fingerprint_equals_definition():
    texts = ["", "  \n", "One", "one TWO three", "a b c d", "A b\tc\x0bd  e É É f g a b c d", "x " * 50, "é" * 40]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_components_equals_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        parent[q] = p
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_operator_on_edge_rows(spark):
    rng = random.Random(9)
    base = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], k=400))
    near_copy = base + " tail"
    rows = [(5, base), (3, base), (9, near_copy), (9, near_copy), (1, None), (2, ""), (4, " \n"), (7, "short text"), (None, "something else entirely here now")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    items = [(d, brute_fingerprint(t)) for d, t in rows]
    want = brute_components(list({d: (d, f) for d, f in items if d is not None}.values()))
    assert sorted(got, key=str) == sorted([(d, f, want.get(d)) for d, f in items], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_texts_and_one_subtree_beyond_what_is_held(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 64)
    long = "word other third " * 60_000
    docs = spark.createDataFrame([(1, long), (2, long + "end"), (3, "x" * 400_000)], "doc_id long, text string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {1: (brute_fingerprint(long), 1), 2: (brute_fingerprint(long + "end"), 1), 3: (brute_fingerprint("x" * 400_000), 3)}
    base = random.Random(3).getrandbits(64) >> 12 << 12
    fps = sorted({base | random.Random(i).getrandbits(12) for i in range(900)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert {x for r in links for x in (r.u, r.v)} == set(signed)
