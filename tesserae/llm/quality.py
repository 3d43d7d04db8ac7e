"""Quality rules as a short-circuit cascade, in Spark expressions only.

Every rule is a test of a few features of the text. A hashed sample gives how much work each feature is (an operation
count, so that the order is the same each time) and which rules reject together; rules run in order of rejection per
cost among the documents that the rules before leave. The cascade makes a feature once, when the first rule that needs
it is reached, and stops at the first rule that rejects. The order changes how much work is done, never the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows of the sample, about; it decides only the order of the rules.
SAMPLE = 1000


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of the text as an array; null text: none."""
    return F.array_remove(F.split(_text(text), SPACE), "")


def lines_of(text: Column) -> Column:
    """Lines (split at \\n) that hold a word."""
    return F.filter(F.split(_text(text), "\n"), lambda x: x.rlike(WORD))


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), f"[^{SYMBOLS}]+", "")).cast("long")


def n_lines(lines: Column) -> Column:
    return F.size(lines).cast("long")


def n_bangs(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), "[^!]+", "")).cast("long")


def n_dup_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line of the same text."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _twins(s: Column, field: str) -> Column:
    """Elements of a sorted array whose `field` equals that of a neighbour."""
    return F.filter(s, lambda x, i: F.coalesce((x[field] == F.get(s, i - 1)[field]) | (x[field] == F.get(s, i + 1)[field]), F.lit(False)))


def covered(words: Column, hashes: Column) -> Column:
    """Words inside the windows that occur at least twice; hashes: a hash of each window, by its first word.

    Windows whose hashes are equal are compared word by word: sorting puts equal ones side by side. Each repeated
    window then adds min(WINDOW, distance to the repeated window before it)."""
    indexed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    spelled = lambda s: F.sort_array(F.transform(_twins(s, "h"), lambda x: F.struct(F.slice(words, x["i"] + 1, WINDOW).alias("words"), x["i"].alias("i"))))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last"))
    summed = lambda t: F.aggregate(F.sort_array(F.transform(_twins(t, "words"), lambda x: x["i"])), start, step, lambda a: a["sum"])
    return let(indexed, lambda s: let(spelled(s), summed))


def n_repeat_words(words: Column) -> Column:
    """Words inside 5-word windows found twice or more in the text, first occurrences included. Only texts in which some
    window's hash repeats are sorted; the others stop at a hash-set count."""
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    windows = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    repeats = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(words, h))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, repeats))


@dataclass(frozen=True)
class Feature:
    """made from "text", "words" or "lines"; work: operations for each of its source's elements (code points, words,
    lines), in nanoseconds as measured once. They order the rules and nothing else."""

    make: Callable[[Column], Column]
    source: str
    work: float


SOURCES = {"text": (lambda t: t, 0.0), "words": (words_of, 8.0), "lines": (lines_of, 3.0)}
FEATURES = {
    "n_words": Feature(n_words, "words", 0.1), "word_chars": Feature(word_chars, "words", 15.0), "n_symbols": Feature(n_symbols, "text", 6.0),
    "n_dup_lines": Feature(n_dup_lines, "lines", 60.0), "n_repeat_words": Feature(n_repeat_words, "words", 250.0),
    "n_lines": Feature(n_lines, "lines", 0.1), "n_bangs": Feature(n_bangs, "text", 6.0),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document where `test`, a function of the features it names, is true (null: not)."""

    name: str
    needs: tuple[str, ...]
    test: Callable[..., Column]

    def rejects(self, known: dict[str, Column]) -> Column:
        return F.coalesce(self.test(*[known[x] for x in self.needs]), F.lit(False))


#: The first two are the contract's base; the others are the method's own, set so that ordinary prose passes.
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n),
)
OWN = (
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 4 * s > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 20 * n)),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 20 * d > 7 * n),
    Rule("shouting", ("n_words", "n_bangs"), lambda n, b: 2 * b > n),
)
RULES = BASE + OWN


@dataclass(frozen=True)
class Ranked:
    """cost: operations that the rule adds to those of the rules before it; rejects: its share of what they leave."""

    rule: Rule
    cost: float
    rejects: float


def bound(text: Column, needs: tuple[str, ...], known: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """`body(known)` with the features `needs` (and their sources) made once and added to `known`."""
    missing = [x for x in needs if x not in known]
    if not missing:
        return body(known)
    source = FEATURES[missing[0]].source
    if source not in known and source != "text":
        return let(SOURCES[source][0](text), lambda s: bound(text, needs, known | {source: s}, body))
    own = [x for x in missing if FEATURES[x].source == source]
    made = F.struct(*[FEATURES[x].make(known.get(source, text)).alias(x) for x in own])
    return let(made, lambda s: bound(text, needs, known | {x: s[x] for x in own}, body))


def rejected_by(rules: list[Rule], text: Column, known: dict[str, Column] | None = None) -> Column:
    """Name of the first rule in this order that rejects, else null; features of later rules are then not made."""
    if not rules:
        return F.lit(None).cast("string")
    first, *rest = rules
    return bound(text, first.needs, known or {}, lambda k: F.when(first.rejects(k), F.lit(first.name)).otherwise(rejected_by(rest, text, k)))


def ranked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Ranked]:
    """Rules by rejection per cost, each among what the rules before it leave, on about `sample` rows chosen by a hash of
    their place. An empty sample leaves the order given. The driver sees a row for each combination of rejections."""
    every = max(1, docs.count() // sample)
    some = docs.select("text", F.monotonically_increasing_id().alias("_at")).filter(F.pmod(F.xxhash64("_at"), F.lit(every)) == 0)
    needs = tuple(dict.fromkeys(x for r in rules for x in r.needs))
    measured = lambda k: F.struct(
        *[r.rejects(k).alias(f"r{i}") for i, r in enumerate(rules)], F.length(_text(F.col("text"))).alias("text"), k["n_words"].alias("words"), k["n_lines"].alias("lines")
    )
    seen = some.select(bound(F.col("text"), tuple(dict.fromkeys((*needs, "n_words", "n_lines"))), {}, measured).alias("m")).select("m.*")
    flags = [f"r{i}" for i in range(len(rules))]
    groups = seen.groupBy(*flags).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SOURCES]).collect()
    total = max(1, sum(g["n"] for g in groups))
    size = {c: sum(g[c] for g in groups) / total for c in SOURCES}
    work = {x: f.work * size[f.source] for x, f in FEATURES.items()}
    base = {c: w * size["text"] for c, (_, w) in SOURCES.items()}  # sources are cut from the text
    left, have, out = list(range(len(rules))), set(), []
    while left:
        alive = sum(g["n"] for g in groups) or 1

        def judged(i: int) -> Ranked:
            new = [x for x in rules[i].needs if x not in have]  # noqa: B023
            cost = 1.0 + sum(work[x] for x in new) + sum(base[c] for c in {FEATURES[x].source for x in new} - have)  # noqa: B023
            return Ranked(rules[i], cost, sum(g["n"] for g in groups if g[flags[i]]) / alive)  # noqa: B023

        at = max(left, key=lambda i: (judged(i).rejects / judged(i).cost, -i))  # noqa: B023
        out.append(judged(at))
        have |= {*rules[at].needs, *(FEATURES[x].source for x in rules[at].needs)}
        groups = [g for g in groups if not g[flags[at]]]
        left.remove(at)
    return out


def quality_features(docs: DataFrame, names: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """`docs` (its columns but `text` may be any) with a struct `_f` of the features; null text has no words."""
    return docs.withColumn("_f", bound(F.col("text"), names, {}, lambda k: F.struct(*[k[x].alias(x) for x in names])))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of `docs` (all its columns) that no rule rejects, by the ordered cascade. Null and blank text: no words."""
    return docs.filter(rejected_by([r.rule for r in ranked(docs, rules)], F.col("text")).isNull())


def op9_quality(spark, sf_dir) -> DataFrame:
    """op9: features, base verdict and final verdict of every document.

    Null, empty or blank text: all features 0, base_failed true, kept false. Ties and repeated rows: one output row
    per input row. Empty table: no rows. Other columns are ignored. The features asked for are made for every document;
    the cascade makes the others only where it reaches a rule that needs them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    order = [r.rule for r in ranked(docs)]
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    known = {x: F.col(f"_f.{x}") for x in asked}
    base = BASE[0].rejects(known) | BASE[1].rejects(known)
    kept = rejected_by(order, F.col("text"), known).isNull()
    return quality_features(docs, asked).select("doc_id", *[known[x].alias(x) for x in asked], base.alias("base_failed"), kept.alias("kept"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS u
  FROM documents),
g AS (
  SELECT u, i, array_to_string(ws[i:i + 4], ' ') AS h FROM w, unnest(range(1, len(ws) - 3)) AS r(i) WHERE len(ws) >= 5),
d AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, h) AS c FROM g) WHERE c > 1),
r AS (SELECT u, count(DISTINCT i + k) AS n FROM d, unnest(range(0, 5)) AS k(k) GROUP BY u),
f AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
         length(t) - length(replace(t, '!', '')) AS n_bangs
  FROM w LEFT JOIN r USING (u))
SELECT * EXCLUDE (n_lines, n_bangs), (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 4 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 20 * n_dup_lines > 7 * n_lines OR 2 * n_bangs > n_words) AS kept
FROM f
"""
