"""Quality rules, chat formatting, URL rules and sharding against brute force."""

import collections
import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat, quality, sharding, urls
from tesserae.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup = len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    base = n < 10 or 100 * len(covered) > 20 * n
    bad = base or 4 * symbols > n or chars < 2 * n or chars > 20 * n or 20 * dup > 7 * len(lines) or 2 * text.count("!") > n
    return n, chars, symbols, dup, len(covered), base, not bad


def test_quality_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 3000, "word " * 9, "é漢\u00a0x " * 20, "l one\n" * 8 + "\n\n other line", "# * $ % & | < > " * 5]
    texts += [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 60))) for _ in range(150)]
    texts += ["\n".join(" ".join(rng.choices(["alpha", "beta#", "gamma!", "delta"], k=rng.randint(0, 9))) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    spark.createDataFrame([(i % 200, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").write.parquet(str(tmp_path / "documents.parquet"))
    got = quality.op9_quality(spark, str(tmp_path)).collect()
    want = sorted((i % 200, *brute_quality(t)) for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want


def spam(spark):
    return spark.createDataFrame([(i, ("spam# " if i % 3 else "fine word here ") * 20 + str(i)) for i in range(40)], "doc_id long, text string")


def test_cascade_order_does_not_change_what_is_kept(spark):
    docs = spam(spark)
    kept = {r.doc_id for r in quality.quality_filter(docs).collect()}
    for rules in (quality.RULES[::-1], quality.RULES[2:] + quality.RULES[:2]):
        assert {r.doc_id for r in docs.filter(quality.rejected_by(list(rules), F.col("text")).isNull()).collect()} == kept
    assert quality.quality_filter(docs.limit(0)).count() == 0


def test_order_is_reproducible_and_by_rejection_per_cost(spark):
    docs = spam(spark)
    ranks = quality.ranked(docs)
    assert ranks == quality.ranked(docs)
    assert sorted(r.rule.name for r in ranks) == sorted(r.name for r in quality.RULES)
    assert ranks[0].rejects / ranks[0].cost >= max(r.rejects / r.cost for r in ranks[1:])
    assert [r.rule for r in quality.ranked(docs.limit(0))] == list(quality.RULES)


def test_a_cheap_rejection_prevents_costly_features(spark, monkeypatch):
    costly = quality.Feature(lambda w: F.raise_error(F.lit("made")).cast("long"), "words", 250.0)
    monkeypatch.setitem(quality.FEATURES, "n_repeat_words", costly)
    docs = spark.createDataFrame([("too few",), ("a b",), (None,)], "text string")
    assert docs.filter(quality.rejected_by(list(quality.RULES), F.col("text")).isNull()).count() == 0
    with pytest.raises(Exception, match="made"):
        docs.filter(quality.rejected_by(list(quality.RULES[::-1]), F.col("text")).isNull()).count()


def test_windows_of_equal_hashes_are_compared_by_words(spark):
    rng = random.Random(4)
    texts = ["a b c d e f g h i j", "a b c d e a b c d e"] + [" ".join(rng.choices("abc", k=30)) for _ in range(20)]
    words = F.split("text", " ")
    for salt in (1, 3):  # hashes that collide always, or for a third of the windows
        kinds = F.lit(salt)
        hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.pmod(i, kinds))  # noqa: B023
        got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality.covered(words, hashes).alias("n")).collect()
        assert all(r.n == brute_quality(r.text)[4] for r in got)


def chats():
    nasty = ["", "plain", "a<|im_sep|>b", "\\e\\\\", "<|im_end|>\n<|im_start|>user\nhi", "</s>[INST] ok [/INST]", "line\nline\n", "é🙂", "<|im_", "\\", None, "[IN[/INST]ST]"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "odd\nrole<|im_end|>"]), rng.choice(nasty)) for c in range(60) for t in range(rng.randint(1, 8))]
    return rows + [(7, 0, "user", "tie"), (7, 0, "user", "tie"), (8, None, "assistant", "x"), (None, 1, "assistant", "no id")]


def test_chat_round_trip(spark):
    rows = chats()
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    back = {r.conv_id: r for r in chat.read_chat(chat.format_chat(df)).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, chat_key(role), role or "", text or ""))
    assert set(back) == set(groups)
    for c, turns in groups.items():
        want = [t[3:] for t in sorted(turns)]
        assert [(t.role, t.text) for t in back[c].turns] == want
        assert back[c].loss_text == "".join(x for r, x in want if r == "assistant")
    assert chat.format_chat(df.limit(0)).count() == 0


def test_ties_are_ordered_by_text_as_given(spark):
    df = spark.createDataFrame([(1, 0, "user", t) for t in ("A", "<s>", "<|im_sep|>", "\\", "a")], "conv_id long, turn long, role string, text string")
    assert [t.text for t in chat.read_chat(chat.format_chat(df)).first().turns] == sorted(["A", "<s>", "<|im_sep|>", "\\", "a"])


def test_long_conversations_and_a_real_conversation_of_the_controls_id(spark, tmp_path):
    rows = [(5, i, ["user", "assistant"][i % 3 > 0], f"text {i}" * (i % 4)) for i in range(6000)] + [(-1, 0, "assistant", "mine")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op10_chat_format(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.n_turns) for r in got) == [(-1, 1), (-1, 2), (5, 6000)]
    said = "".join(x for _, _, r, x in rows[:-1] if r == "assistant")
    one = next(r for r in got if r.conv_id == 5)
    assert one.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and one.loss_chars == len(said)


def test_starts_are_sums_before(spark):
    for n in (0, 1, 2, 3, 10, 17):
        r = spark.range(1).select(chat.starts_of(F.array(*[F.lit(k + 1) for k in range(n)]).cast("array<bigint>")).alias("x")).first()
        assert r.x == [sum(range(1, k + 1)) for k in range(n)]


def chat_key(role):
    return role or ""


def test_adjacent_turns_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    r = chat.format_chat(df).first()
    assert r.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.loss_spans] == ["c"]


def brute_url(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]) if m else ("", "")
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if re.search(r"(^|[^a-z0-9])(" + "|".join(w for own in urls.WORDS.values() for w in own) + ")([^a-z0-9]|$)", re.sub("[A-Z]", lambda x: x[0].lower(), url or "")) else "allow"


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.COM", "com", "xcom", "a.net", "example.net", "é.org", "b c.com", "", "example.com.evil.org", "my-com"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/EN/", "/en/71/x", "/de/", "/de/8", "/de/81", "/es/x", "/x/en/", "/xxx/", "/casinos", "/a-casino-b"]
    found = [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}{rng.choice(['', '?q=/en/', '#top', '?u=http://com/en/'])}" for h in hosts for p in paths]
    found += [None, "", "no scheme", "://", "http:/x/en/", "x://y://com/en/", "http://example.com/en/7\n"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(found)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(found)}
    assert urls.url_filter(df.limit(0)).count() == 0
    joined = urls.url_filter(df, urls.rules_table(spark, urls.RULES))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in joined.collect()} == got
    assert urls.url_filter(df.limit(0), urls.rules_table(spark, urls.RULES)).count() == 0


def test_very_long_urls_and_repeated_rows(spark):
    long = "http://www.example.com/en/7" + "/seg" * 50_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://x.org/" + "a" * 200_000 + "?casino")], "page_id long, url string")
    got = urls.url_filter(df).collect()
    assert [(r.page_id, r.rule, r.verdict) for r in sorted(got)] == [(1, "example.com/en/7", "allow")] * 2 + [(2, None, "block")]


def test_many_rules_cost_about_what_few_do(spark):
    """Rules that no URL matches: neither planning nor a URL's look-ups grow with their number."""
    pages = stored(spark.range(20_000).selectExpr("id as page_id", "concat('http://www.site', id % 977, '.com/part/', id, '?q=words') as url"))

    def took(n):
        rules = (*urls.RULES, *(urls.worded("block", f"zz{i}qq") for i in range(n)))
        began = time.perf_counter()
        assert urls.url_filter(pages, rules).filter("verdict = 'block' and rule is null").count() == 0
        return time.perf_counter() - began

    took(10)
    assert took(20_000) < 3 * took(10) + 5


def test_index_uses_the_rarest_token():
    index = urls.index_of(urls.RULES, {"com": 50, "en": 5, "example": 9, "net": 1, "de": 1})
    assert {r.name for r in index["en"]} == {"com/en/", "example.com/en/7"}
    with pytest.raises(ValueError):
        urls.index_of((urls.UrlRule("x", "block", "x", (), False),), {})


def test_bounded_loads_place_every_row_clockwise():
    nodes = sharding.ring(5, 8)
    rng = random.Random(0)
    counts = {(a, p): rng.randint(0, 30) for a in range(40) for p in range(2)}
    counts[3, 0] = 2000
    total = sum(counts.values())
    caps = sharding.capacities(total, 5, 1.0)
    segments = sharding.place(counts, nodes, 5, caps)
    load = collections.Counter()
    for key, n in counts.items():
        own = sorted((s for s in segments if (s.arc, s.part) == key), key=lambda s: s.start)
        assert sum(s.n for s in own) == n and [s.start for s in own] == [sum(x.n for x in own[:i]) for i in range(len(own))]
        clockwise = list(dict.fromkeys(nodes[(key[0] + k) % 40][1] for k in range(40)))
        assert [s.shard for s in own] == [x for x in clockwise if x in {s.shard for s in own}]
    for s in segments:
        load[s.shard] += s.n
    assert [load[s] for s in range(5)] == caps and max(caps) - min(caps) <= 1


def test_sharding_operator(spark, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(997)] + [(5, "y")] * 400 + [(None, None), (None, "é"), (6, "long " * 100_000)]
    spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, shard int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op4_sharding(spark, str(tmp_path)).collect()
    key = lambda i, t: (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(key(*r) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 24 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.op4_sharding(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard_rows(spark.range(0), F.col("id"), F.col("id")).count() == 0


def test_placement_equals_one_made_row_by_row(spark):
    """Keys in order of (arc, part, tie) walk the ring one by one; also where one key and one row are most of the table."""
    rows = [(i % 300, i) for i in range(600)] + [(7, 7)] * 700 + [(None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    shards, vnodes = 6, 8
    nodes = sharding.ring(shards, vnodes)
    parts = F.pmod(F.xxhash64(F.struct("k", "v"), F.lit("part")), F.lit(sharding.LEAST_PARTS)).cast("int")
    seen = df.select("k", "v", F.pmod(F.xxhash64("k"), F.lit(sharding.RING)).alias("at"), parts.alias("part")).collect()
    arc = lambda at: next((i for i, (p, _) in enumerate(nodes) if p >= at), 0)
    caps = sharding.capacities(len(rows), shards, 1.0)
    waiting = sorted((arc(r["at"]), r["part"], r["k"] is not None, r["k"] or 0, r["v"]) for r in seen)
    want, load = collections.Counter(), [0] * shards
    for k in range(shards):
        left = []
        for x in waiting:
            s = list(dict.fromkeys(nodes[(x[0] + j) % len(nodes)][1] for j in range(len(nodes))))[k]
            if load[s] < caps[s]:
                load[s] += 1
                want[(x[3] if x[2] else None, x[4], s)] += 1
            else:
                left.append(x)
        waiting = left
    for n in (1, 5):
        got = sharding.shard_rows(df.repartition(n), F.col("k"), F.struct("k", "v"), shards, vnodes).collect()
        assert collections.Counter((r["k"], r["v"], r["shard"]) for r in got) == want


def test_loose_capacity_moves_few_keys_when_a_shard_is_added(spark):
    keys = stored(spark.range(4000))
    one = {r.id: r.shard for r in sharding.shard_rows(keys, F.col("id"), F.col("id"), 8, 64, 1.25).collect()}
    two = {r.id: r.shard for r in sharding.shard_rows(keys, F.col("id"), F.col("id"), 9, 64, 1.25).collect()}
    assert sum(one[i] != two[i] for i in one) < 0.4 * len(one)
    assert max(collections.Counter(one.values()).values()) <= 1.25 * 4000 / 8 + 1
    assert hashlib.md5(str(sorted(one.items())).encode()).hexdigest()
