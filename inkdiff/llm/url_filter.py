"""URL filter rules found through their rarest literal token, in DataFrame operations only.

A rule is a pattern in a small language: `||` in front stands for the start of the host or of one of its labels, `^` for
a place beside which no letter, digit, `_`, `-`, `.` or `%` stands (or the url's end), `*` for any characters. The
literal tokens of a rule are its runs of a-z0-9 that must be whole tokens of any url that fits. Each rule is indexed by
the one of them that is rarest in the urls at hand; each url's tokens fetch its candidate rules, and only those run
their regular expressions. A rule without such a token is indexed by the empty token, which every url has.

The rules are given as a list, which becomes a table (`rule_table`), or as such a table, which the driver only counts. Up
to MAX_BROADCAST_RULES rows the index is broadcast; beyond that it is joined by shuffle. Urls are judged once for each
distinct url, and those that fit a rule are written; then the rows are joined with them. Both sides of that join are
plain, so Spark may split the rows of one url. Tokens are paired with rules, never urls with urls.

A null url, or one without `://`, has an empty host and path and fits no rule. Of the fitting prefix rules (host and
path) the longest wins, of equally long ones the least name, of one name's `allow` before `block`; without one, a fitting exception pattern allows, else a fitting block pattern blocks, else the
url is allowed. Each row is answered, repeated ones alike; an empty table gives an empty result. All of the table's
columns stand in the struct `input`, so none of their names can clash.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize, table

MAX_BROADCAST_RULES = 100_000
TOKEN = "[a-z0-9]+"

#: (host, path, verdict): fits the host and its subdomains if the url's path starts with the rule's.
PREFIX_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: What else a crawl for training text leaves out.
PATTERN_RULES = (
    ("^spam-farm^", "block"),
    ("^cheap-pills^", "block"),
    ("^casino-win^", "block"),
    ("^free-bets^", "block"),
    ("^ads-track^", "block"),
    ("^adult-x^", "block"),
    ("^casino^", "block"),
    ("^porn*^", "block"),
    ("^doubleclick^", "block"),
    ("||adserver^", "block"),
    ("^wp-login.php^", "block"),
    ("^viagra^", "block"),
    ("^casino*^responsible-gaming^", "allow"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # prefix or pattern
    regex: str
    verdict: str
    tokens: tuple[str, ...]
    length: int


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits host + path of a url, in which the host has no slash."""
    edge = "" if re.search(r"[^a-zA-Z0-9]\Z", path) or not path else " "
    whole = tuple(dict.fromkeys(t for t in re.findall(TOKEN, host + re.sub(r"[a-zA-Z0-9]+\Z", "", path) if edge else host + path)))
    whole = tuple(t for t in whole if t == t.lower())
    return Rule(host + path, "prefix", r"^([^/]*\.)?" + _quoted(host + path), verdict, whole, len(host + path))


def pattern_rule(pattern: str, verdict: str) -> Rule:
    parts, tokens, at = [], [], 0
    for piece in re.findall(r"\|\||\^|\*|[^|^*]+|\|", pattern):
        literal = not re.fullmatch(r"\|\||\^|\*", piece)
        if literal:
            before, after = pattern[:at], pattern[at + len(piece) :]
            for m in re.finditer(TOKEN, piece.lower()):
                left = m.start() > 0 or before.endswith(("^", "||"))
                right = m.end() < len(piece) or after.startswith("^")
                if left and right:
                    tokens.append(m[0])
        parts.append({"||": r"^([^/]*\.)?", "^": r"([^a-z0-9_.%-]|\.|^|$)" if not at else r"([^a-z0-9_%-]|$)", "*": ".*"}.get(piece) or _quoted(piece.lower()))
        at += len(piece)
    return Rule(pattern, "pattern", "".join(parts), verdict, tuple(dict.fromkeys(tokens)), len(pattern))


def _quoted(text: str) -> str:
    """text as a regular expression that Java and RE2 read alike."""
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


RULES = (*(prefix_rule(*r) for r in PREFIX_RULES), *(pattern_rule(*r) for r in PATTERN_RULES))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    """What follows the host, query and fragment included."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*(.*)", 1)


RULE_ROWS = "array<struct<_token: string, _rule: string, _kind: string, _regex: string, _verdict: string, _length: int>>"


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each rule and token: _token, _rule, _kind, _regex, _verdict, _length. The list is one literal of the plan."""
    rows = [{"_token": t, "_rule": r.name, "_kind": r.kind, "_regex": r.regex, "_verdict": r.verdict, "_length": r.length} for r in rules for t in r.tokens or ("",)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), RULE_ROWS)))


def rule_index(tokens: DataFrame, listed: DataFrame, small) -> DataFrame:
    """Each rule of the table under its token that is rarest in tokens(_token)."""
    seen = tokens.join(small(listed.select("_token").distinct()), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_n"))
    by_rarity = Window.partitionBy("_rule", "_kind", "_regex", "_verdict").orderBy(F.coalesce("_n", F.lit(0)), "_token")
    ranked = listed.join(seen, "_token", "left").withColumn("_rank", F.row_number().over(by_rarity))
    return ranked.where("_rank = 1").drop("_rank", "_n")


def filter_urls(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] | DataFrame = RULES) -> DataFrame:
    """df's columns in a struct `input`, with host, path, rule (of the winning prefix rule, else null) and verdict."""
    listed = rules if isinstance(rules, DataFrame) else rule_table(df.sparkSession, rules)
    number = rules.count() if isinstance(rules, DataFrame) else sum(max(1, len(r.tokens)) for r in rules)
    small = F.broadcast if number <= MAX_BROADCAST_RULES else lambda x: x
    rows = df.select(F.struct("*").alias("input"), F.coalesce(df[url], F.lit("")).alias("_url"))
    urls = rows.select("_url").distinct()
    parsed = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"), rest_of(F.col("_url")).alias("_rest"))
    parsed = parsed.where("_host <> '' or _rest <> ''")
    found = F.array_distinct(F.concat(F.regexp_extract_all(F.lower(F.concat("_host", "_rest")), F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))))
    tokens = parsed.select("_url", "_host", "_path", "_rest", F.explode(found).alias("_token"))
    candidates = tokens.join(small(rule_index(tokens.select("_token"), listed, small)), "_token")
    target = F.when(F.col("_kind") == "prefix", F.concat("_host", "_path")).otherwise(F.lower(F.concat("_host", "_rest")))
    fits = candidates.where(F.regexp(target, F.col("_regex")))
    prefix, pattern = F.col("_kind") == "prefix", F.col("_kind") == "pattern"
    judged = fits.groupBy("_url").agg(
        F.min(F.when(prefix, F.struct(-F.col("_length"), "_rule", "_verdict"))).alias("_best"),
        F.bool_or(pattern & (F.col("_verdict") == "allow")).alias("_excepted"),
        F.bool_or(pattern & (F.col("_verdict") == "block")).alias("_blocked"),
    )
    judged = materialize(judged.withColumnRenamed("_url", "_of"), "judged")
    method = F.when(F.coalesce("_blocked", F.lit(False)) & ~F.coalesce("_excepted", F.lit(False)), "block").otherwise("allow")
    return rows.join(judged, rows["_url"] == judged["_of"], "left").select(
        "input",
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        F.col("_best._rule").alias("rule"),
        F.coalesce(F.col("_best._verdict"), method).alias("verdict"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("input.page_id", "host", "path", "rule", "verdict")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """Every rule's expression on every url."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    fits = lambda r: f"regexp_matches({'host || path' if r.kind == 'prefix' else 'lower(host || rest)'}, {quote(r.regex)})"
    best = sorted((r for r in rules if r.kind == "prefix"), key=lambda r: (-r.length, r.name, r.verdict))
    pick = lambda field, other: "CASE " + " ".join(f"WHEN {fits(r)} THEN {quote(field(r))}" for r in best) + f" ELSE {other} END"
    some = lambda verdict: " OR ".join(fits(r) for r in rules if r.kind == "pattern" and r.verdict == verdict) or "false"
    method = f"CASE WHEN (host <> '' OR rest <> '') AND ({some('block')}) AND NOT ({some('allow')}) THEN 'block' ELSE 'allow' END"
    return f"""
WITH cut AS (SELECT page_id, strpos(coalesce(url, ''), '://') AS cut_at, coalesce(url, '') AS url FROM pages),
after AS (SELECT page_id, CASE WHEN cut_at > 0 THEN substr(url, cut_at + 3) ELSE '' END AS tail FROM cut),
parts AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 substr(tail, length(regexp_extract(tail, '^[^/?#]*')) + 1) AS rest FROM after),
urls AS (SELECT page_id, host, rest, regexp_extract(rest, '^[^?#]*') AS path FROM parts)
SELECT page_id, host, path, {pick(lambda r: r.name, "NULL")} AS rule, {pick(lambda r: r.verdict, method)} AS verdict FROM urls
"""


SQL = sql()
