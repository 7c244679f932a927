"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the rules worth running.

A token is a whole run of A-Z, a-z and 0-9 in host + path. Each rule names the tokens that any URL it matches must
have; it is filed under the one that the fewest URLs of the table have. The index is a hash table held as one literal
array of buckets: looking up a token costs one array access, whatever the number of rules, and only the rules found
run their regular expression. All is row-local: no join, no shuffle of pages, and no Python. A rule without a sure
token is run for every URL; rules beyond MOST_LITERAL are looked up by a join on the token, with the same result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scoped, written

#: Rules that a literal in the plan may hold; more are a written table that the URLs' tokens are joined with.
MOST_LITERAL = 20_000
_TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression over host + path. tokens: whole tokens in all that it matches. rank: the highest wins."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    base: bool = False
    rank: int = 0


def host_rule(name: str, verdict: str) -> Rule:
    """A base rule host/path: it fits that host and all its subdomains where the path starts with the rule's."""
    host, _, path = name.partition("/")
    path = "/" + path
    safe = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
    # A path's last token may go on in the URL, unless something ends it; so may nothing in the host.
    sure = re.findall(_TOKEN, host) + [x for x in re.findall(rf"{_TOKEN}(?=[^A-Za-z0-9])", path)]
    return Rule(name, rf"^([^/]*\.)?{safe(host)}{safe(path)}", tuple(sure), verdict, True, len(name))


def word_rule(word: str, verdict: str) -> Rule:
    """A pattern rule: the host has a label made of these hyphened words."""
    safe = word.replace("-", r"\-")
    return Rule(word, rf"^([^/]*\.)?{safe}\.[^/]*", tuple(re.findall(_TOKEN, word)), verdict, False, len(word))


#: The rules of the contract.
BASE_RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]
#: The method's own: hosts that announce spam.
PATTERN_RULES = [word_rule(x, "block") for x in ("spam-farm", "cheap-pills", "link-farm", "free-casino", "buy-followers", "adult-cams")]
DEFAULT = "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    start = F.locate("://", url)
    rest = F.coalesce(F.when(start > 0, url.substr(start + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, upper, lower), path


def _found(at: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(at, F.lit(f"({_TOKEN})"), F.lit(1)))


def _filed(r: Rule, counts: dict[str, int]) -> dict:
    """The rule under its rarest token."""
    token = min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else None
    return {"token": token, "rank": r.rank, "name": r.name, "base": r.base, "verdict": r.verdict, "pattern": r.pattern}


def _held(spark: SparkSession, values: list, kind: str) -> DataFrame:
    """(x) for each of the values."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")).alias("x"))


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[str, int]:
    """Buckets by crc32 of the rarest token, as JSON, and their number."""
    import zlib

    size = 1 << max(1, (2 * len(rules)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for r in rules:
        own = _filed(r, counts)
        buckets[zlib.crc32(own["token"].encode()) % size].append(own)
    return json.dumps(buckets), size


def _best(found: Column, base: bool) -> Column:
    """Of the fitting rules the one that wins: the highest rank, of equal ones the first by name, pattern and verdict."""
    by = lambda x: F.struct(-x["rank"], x["name"], x["pattern"], x["verdict"])
    own = F.filter(found, lambda r: r["base"] == F.lit(base))
    return F.get(F.array_sort(own, lambda x, y: F.when(by(x) < by(y), -1).when(by(x) > by(y), 1).otherwise(0)), F.lit(0))


_RULE = "struct<token:string,rank:int,name:string,base:boolean,verdict:string,pattern:string>"


def _looked_up(rows: DataFrame, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    """rows with fitting, by an index that is a literal."""
    index, size = _index(rules, counts)
    table = F.from_json(F.lit(index), f"array<array<{_RULE}>>")
    buckets = F.transform(_found(F.col("at")), lambda t: F.filter(F.get(table, F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int")), lambda r: r["token"] == t))
    return rows.withColumn("fitting", F.filter(F.flatten(buckets), lambda r: F.rlike("at", r["pattern"])))


def _joined(rows: DataFrame, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    """rows with fitting, by an index that is a table."""
    index = written(_held(rows.sparkSession, [_filed(r, counts) for r in rules], _RULE).select("x.*"), "rules")
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "urls")
    pairs = rows.select("uid", "at", F.explode(_found(F.col("at"))).alias("token")).join(index, "token").where(F.rlike("at", F.col("pattern")))
    fits = pairs.groupBy("uid").agg(F.collect_list(F.struct("token", "rank", "name", "base", "verdict", "pattern")).alias("fitting"))
    return rows.join(fits, "uid", "left").drop("uid").withColumn("fitting", F.coalesce("fitting", F.array().cast(f"array<{_RULE}>")))


@scoped
def url_filter(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(page_id, host, path, rule, pattern_rule, verdict) for each row.

    rule is the base rule that fits and is longest (of equal lengths the first by name), pattern_rule the pattern rule
    that fits, chosen likewise. verdict: the base rule's, else the pattern rule's, else DEFAULT. A null or empty url,
    or one without ://, has an empty host and path and no rule; a very long one is used whole; rows that repeat, or
    share a page_id, are judged one by one; an empty table gives no rows; other columns are not read.
    """
    rules = BASE_RULES + PATTERN_RULES if rules is None else rules
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("at", F.concat("host", "path"))
    filed, always = [r for r in rules if r.tokens], [r for r in rules if not r.tokens]
    tokens = sorted({t for r in filed for t in r.tokens})
    seen = rows.select(F.explode(_found(F.col("at"))).alias("token"))
    if few := len(tokens) <= MOST_LITERAL:
        seen = seen.where(F.col("token").isin(tokens))
    seen = seen.groupBy("token").agg(F.count("*").alias("n"))
    if not few:
        seen = seen.join(_held(rows.sparkSession, tokens, "string"), F.col("token") == F.col("x"), "left_semi")
    counts = {r["token"]: r["n"] for r in seen.collect()}  # one row per rule token at most
    judged = (_looked_up if len(filed) <= MOST_LITERAL else _joined)(rows, filed, counts)
    found = F.col("fitting")
    if always:
        every = F.from_json(F.lit(json.dumps([_filed(r, counts) for r in always])), f"array<{_RULE}>")
        found = F.concat(found, F.filter(every, lambda r: F.rlike("at", r["pattern"])))
    judged = judged.select("page_id", "host", "path", found.alias("fitting"))
    judged = judged.select("page_id", "host", "path", _best(F.col("fitting"), True).alias("b"), _best(F.col("fitting"), False).alias("p"))
    verdict = F.coalesce("b.verdict", "p.verdict", F.lit(DEFAULT)).alias("verdict")
    return judged.select("page_id", "host", "path", F.col("b.name").alias("rule"), F.col("p.name").alias("pattern_rule"), verdict)


ORACLE_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    nullif(regexp_extract(host, '(^|\\.)(buy-followers|free-casino|cheap-pills|adult-cams|spam-farm|link-farm)\\.', 2), '') AS pattern_rule
  FROM split)
SELECT page_id, host, path, rule, pattern_rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
