"""URL filter rules found through an index on each rule's rarest literal token, in Spark expressions only.

A rule is a regular expression with the literal tokens that any URL it matches must hold. The index keeps each rule
under the token that fewest URLs hold; a URL's own tokens fetch its candidate rules, and only those run as regular
expressions. A rule list of up to LITERAL_BYTES goes with the plan as one hash table, which a URL's tokens look up
without any shuffle; longer lists, and lists in a table, are joined by token instead. Both give the same result.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, stored

LITERAL_BYTES = 4 << 20
_TOKEN = r"[^a-z0-9]+"
_RULE = "name string, verdict string, pattern string, listed boolean"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; null or no `://`: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column, url: Column) -> Column:
    """What patterns see: host, `#`, path, `#` (neither can hold one), the whole URL in lower case."""
    return F.concat(host, F.lit("#"), path, F.lit("#"), ascii_lower(F.coalesce(url, F.lit(""))))


@dataclass(frozen=True)
class UrlRule:
    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    #: Named rules (the lists) beat patterns; among fitting rules the longest name wins, then the smaller name.
    listed: bool


def listed(verdict: str, site: str) -> UrlRule:
    """Rule `host/path...`: fits the host and its subdomains where the path starts with the rule's."""
    host, _, rest = site.partition("/")
    whole = rest.split("/")[:-1]  # the last segment may go on in the URL, so it is no literal token
    tokens = [t for part in (*host.split("."), *whole) for t in re.split(_TOKEN, part.lower()) if t]
    return UrlRule(site, verdict, rf"(?s)^(?:[^#]*\.)?{re.escape(host)}#{re.escape('/' + rest)}", tuple(tokens), True)


def worded(verdict: str, word: str) -> UrlRule:
    """Rule on a word that stands alone in the URL."""
    return UrlRule(word, verdict, rf"(?s)(?:^|[^a-z0-9]){re.escape(word)}(?:[^a-z0-9]|$)", (word,), False)


#: The contract's lists (fixed values).
LISTED = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: The method's own words, by kind: a URL that holds one as a token of its own is not training data. Words with an
#: ordinary sense (bet, slots, drug) are left out, so that clean pages pass.
WORDS = {
    "gambling": ("baccarat", "blackjack", "bookmaker", "casino", "casinos", "jackpots", "poker", "roulette", "slotmachine", "sportsbook"),
    "adult": ("bdsm", "camgirl", "camgirls", "escorts", "hentai", "milf", "nsfw", "onlyfans", "porn", "porno", "pornstar", "pornstars", "xxx", "xvideos"),
    "pills": ("cialis", "levitra", "phentermine", "tramadol", "viagra", "xanax"),
    "piracy": ("crackz", "keygen", "keygens", "serialz", "warez"),
    "fraud": ("getrichquick", "payday", "phishing", "ponzi"),
}
RULES = (*(listed(*x) for x in LISTED), *(worded("block", w) for own in WORDS.values() for w in own))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _TOKEN), ""))


def hash_table(entries: dict[str, object], value: str) -> tuple[Column, int]:
    """(literal array of buckets of (token, value), number of buckets): a token's bucket is its crc32, so that a look-up
    costs the same however many entries there are."""
    buckets: list[list[dict]] = [[] for _ in range(max(1, 2 * len(entries)))]
    for token, own in sorted(entries.items()):
        buckets[zlib.crc32(token.encode()) % len(buckets)].append({"token": token, "value": own})
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<token:string,value:{value}>>>"), len(buckets)


def looked_up(table: tuple[Column, int], token: Column) -> Column:
    """Array of the values under `token`: one or none."""
    buckets, n = table
    bucket = F.get(buckets, F.pmod(F.crc32(token.cast("binary")), F.lit(n)).cast("int"))
    return F.transform(F.filter(bucket, lambda e: e["token"] == token), lambda e: e["value"])


def token_counts(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """URLs that hold each of the rules' tokens; at most one row a token reaches the driver."""
    table = hash_table(dict.fromkeys(tokens, True), "boolean")
    each = pages.select(F.explode(F.filter(tokens_of(F.col("url")), lambda t: F.size(looked_up(table, t)) > 0)).alias("token"))
    return {r["token"]: r["n"] for r in each.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_of(rules: tuple[UrlRule, ...], counts: dict[str, int]) -> dict[str, list[UrlRule]]:
    """Each rule under its rarest literal token (ties: the smaller token)."""
    out: dict[str, list[UrlRule]] = {}
    for rule in rules:
        if not rule.literals:
            raise ValueError(f"rule {rule.name} has no literal token")
        out.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return out


def _order(r: Column) -> Column:
    """What the best of the fitting rules has least of."""
    return F.struct((~r["listed"]).alias("own"), (-F.length(r["name"])).alias("short"), r["name"].alias("name"), r["verdict"].alias("verdict"))


def _parsed(pages: DataFrame) -> DataFrame:
    parsed = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    return parsed.withColumn("_seen", canonical(F.col("host"), F.col("path"), F.col("url")))


def best_by_literal(pages: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """(page_id, host, path, best): the winning rule by look-ups in a hash table that the plan carries."""
    index = index_of(rules, token_counts(pages, {t for r in rules for t in r.literals}))
    as_dict = lambda r: {"name": r.name, "verdict": r.verdict, "pattern": r.pattern, "listed": r.listed}
    fields = ",".join(x.replace(" ", ":") for x in _RULE.split(", "))
    table = hash_table({t: [as_dict(r) for r in own] for t, own in index.items()}, f"array<struct<{fields}>>")

    def judged(text: Column) -> Column:
        candidates = F.flatten(F.transform(tokens_of(text), lambda t: F.flatten(looked_up(table, t))))
        return F.array_min(F.transform(F.filter(candidates, lambda r: F.regexp_like(text, r["pattern"])), _order))

    return _parsed(pages).select("page_id", "host", "path", let(F.col("_seen"), judged).alias("best"))


def rules_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    """(name, verdict, pattern, listed, literals) of a rule list."""
    columns = {"name": pa.string(), "verdict": pa.string(), "pattern": pa.string(), "listed": pa.bool_(), "literals": pa.list_(pa.string())}
    return spark.createDataFrame(pa.table({c: pa.array([list(v) if isinstance(v := getattr(r, c), tuple) else v for r in rules], t) for c, t in columns.items()}))


def best_by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, best): the winning rule by joins on tokens, for rule tables of any size.

    A rule's number of URLs stays small as its token is its rarest; a token that many URLs hold is split by the join."""
    rows = stored(_parsed(pages).withColumn("_row", F.monotonically_increasing_id()))
    tokens = rows.select("_row", F.explode(tokens_of(F.col("_seen"))).alias("token"))
    own = rules.select(*(c.split(" ")[0] for c in _RULE.split(", ")), F.explode("literals").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token")
    keys = [c.split(" ")[0] for c in _RULE.split(", ")]
    index = stored(own.join(counts, "token", "left").groupBy(*keys).agg(rarest))
    hits = tokens.join(index, "token").join(rows.select("_row", "_seen"), "_row").filter(F.regexp_like("_seen", F.col("pattern")))
    best = hits.groupBy("_row").agg(F.min(_order(F.struct(*keys))).alias("best"))
    return rows.join(best, "_row", "left").select("page_id", "host", "path", "best")


def url_filter(pages: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """`pages` (page_id, url; other columns ignored) with host, path, the winning listed rule and the verdict.

    rules: a list, or a table as `rules_table` makes it. Null, empty or scheme-less url: host and path empty, rule null,
    verdict from the word rules, else `default`. One output row per input row, repeated rows included; an empty table
    gives none."""
    if isinstance(rules, DataFrame):
        found = best_by_join(pages, rules)
    elif sum(len(r.name) + len(r.pattern) + 80 for r in rules) > LITERAL_BYTES:
        found = best_by_join(pages, rules_table(pages.sparkSession, rules))
    else:
        found = best_by_literal(pages, rules)
    return found.select("page_id", "host", "path", F.when(~F.col("best.own"), F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: verdict for every page's url; edge cases as in `url_filter`."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


OP7_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS u,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(host, path, verdict) AS (VALUES {', '.join(f"('{s.split('/')[0]}', '/{s.partition('/')[2]}', '{v}')" for v, s in LISTED)}),
m AS (
  SELECT p.u, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.u ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule,
       coalesce(m.verdict, CASE WHEN regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({'|'.join(w for own in WORDS.values() for w in own)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON m.u = p.u AND m.k = 1
"""
