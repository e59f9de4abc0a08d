"""URL rules fetched through their rarest literal token, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host and path, action): a host with all its subdomains and the start of the path.
HOST_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Patterns for urls that no host rule fits; `*` stands for any characters within a host label.
PATTERNS = [
    ("ads-track.*/", "block"),
    ("adult-x.*/", "block"),
    ("casino-win.*/", "block"),
    ("cheap-pills.*/", "block"),
    ("free-bets.*/", "block"),
    ("spam-farm.*/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[^A-Za-z0-9]+"
#: A rule list of more rows than this is joined by a shuffle.
BROADCAST = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """As the rules read a url: the host after the first `://` in ASCII lower case, and the
    path; both empty for null or without `://`."""
    full = F.coalesce(url, F.lit(""))
    at = F.instr(full, "://")
    rest = F.when(at > 0, F.substring(full, at + 3, F.length(full))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def expression(rule: str) -> str:
    """The regular expression of a rule over host + path."""
    return r"^(?:[^/]*\.)?" + r"[^/]*".join(re.escape(part) for part in rule.split("*"))


def literal_tokens(rule: str) -> list[str]:
    """Tokens that every url fitting the rule holds: literal stretches bounded on both sides."""
    parts = re.split(r"([A-Za-z0-9]+)", rule)
    return sorted({t for i, t in enumerate(parts) if i % 2 and not parts[i - 1].endswith("*") and parts[i + 1] and not parts[i + 1].startswith("*")})


def filter_line(line: str) -> tuple[str, str, str, list[str]] | None:
    """(rule, action, expression, tokens) of a line of a filter list; None for comments and blanks.

    `||` anchors at the start of a host or a parent domain, `|` at either end, `*` is anything,
    `^` a separator (no letter, digit, `_`, `-`, `.` or `%`) or the end, and `@@` ahead makes an
    exception. A line without an anchor fits anywhere in host and path."""
    rule = line.strip()
    if not rule or rule.startswith("!"):
        return None
    action = "allow" if rule.startswith("@@") else "block"
    body = rule.removeprefix("@@")
    ahead = r"^(?:[^/]*\.)?" if body.startswith("||") else "^" if body.startswith("|") else ""
    inner = body.lstrip("|")
    ends = inner.endswith("|")
    inner = inner.rstrip("|")
    parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%\-]|$)"}
    expression = ahead + "".join(parts.get(c, re.escape(c)) for c in inner) + ("$" if ends else "")
    # At an anchored end a token is whole; at a free end, or beside a star, it may go on.
    marked = ("^" if ahead else "*") + inner + ("^" if ends else "*")
    return rule, action, expression, literal_tokens(marked)


def filter_urls(
    pages: DataFrame, key: str = "page_id", url: str = "url", host_rules: list[tuple[str, str]] | None = None,
    patterns: list[tuple[str, str]] | None = None, filters: list[str] | None = None,
) -> DataFrame:
    """(key, host, path, rule, verdict, pattern) of every row of `pages`.

    Rules are lists held by the caller: host rules, patterns over host labels, and lines of a
    filter list (`filter_line`). Each rule is filed under that literal token of its own which is
    rarest among all urls, one without a literal token under the empty token, which every url
    has. A url's distinct tokens fetch candidate rules by a join and only those run their regular
    expression, so the work a url costs does not grow with the list. The longest fitting host
    rule decides, or else a fitting exception, or else the first fitting pattern or filter, or
    else `allow`. Each distinct host and path is judged once.

    Null and unparsable urls have an empty host and path, fit no rule and are allowed; repeated
    rows give equal rows; other columns are not carried."""
    host_rules = HOST_RULES if host_rules is None else host_rules
    patterns = PATTERNS if patterns is None else patterns
    spark = pages.sparkSession
    known = [(r, a, "host", expression(r), literal_tokens(r)) for r, a in host_rules] + [(r, a, "pattern", expression(r), literal_tokens(r)) for r, a in patterns]
    known += [(r, a, "pattern", e, t) for r, a, e, t in filter(None, map(filter_line, filters or []))]
    rows = [(n, rule, action, kind, regex, t) for n, (rule, action, kind, regex, tokens) in enumerate(known) for t in tokens or [""]]
    rules = spark.createDataFrame(rows, "n int, rule string, action string, kind string, expression string, token string")

    def beside(table: DataFrame) -> DataFrame:
        """The table of rules, broadcast while it has at most BROADCAST rows."""
        return F.broadcast(table) if len(rows) <= BROADCAST else table

    host, path = host_and_path(F.col(url))
    given = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    subjects = given.where("host <> ''").select("host", "path").distinct()
    own = F.array_distinct(F.concat(F.split(F.concat("host", "path"), TOKEN), F.array(F.lit(""))))
    tokens = subjects.select("host", "path", F.explode(own).alias("token")).join(beside(rules.select("token").distinct()), "token")
    counts = tokens.groupBy("token").agg(F.count("*").alias("urls"))  # at most a row for each token of a rule
    index = (
        rules.join(counts, "token", "left")
        .groupBy("n", "rule", "action", "kind", "expression")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))["token"].alias("token"))
    )
    fits = tokens.join(beside(index), "token").where(F.expr("rlike(concat(host, path), expression)"))
    best = fits.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == "host", F.struct(F.length("rule"), -F.col("n"), "rule", "action"))).alias("by_host"),
        F.min(F.when(F.col("kind") == "pattern", F.struct(F.col("action") != "allow", "n", "rule", "action"))).alias("by_pattern"),
    )
    return given.join(best, ["host", "path"], "left").select(
        F.col("key").alias(key), "host", "path", F.col("by_host.rule").alias("rule"),
        F.coalesce("by_host.action", "by_pattern.action", F.lit("allow")).alias("verdict"),
        F.when(F.col("by_host").isNull(), F.col("by_pattern.rule")).alias("pattern"),
    )


ORACLE_SQL = r"""
with r as (
  select page_id, case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)?', 1), '') as path from r),
f as (
  select page_id, host, path,
    case when regexp_matches(host || path, '^([^/]*\.)?www\.example\.com/en/') then 'www.example.com/en/'
         when regexp_matches(host || path, '^([^/]*\.)?example\.com/en/') then 'example.com/en/'
         when regexp_matches(host || path, '^([^/]*\.)?net/es/') then 'net/es/'
         when regexp_matches(host || path, '^([^/]*\.)?net/fr/') then 'net/fr/'
         when regexp_matches(host || path, '^([^/]*\.)?com/') then 'com/' end as rule,
    regexp_extract(host || path, '^([^/]*\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.[^/]*/', 2) as spam
  from h)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
       when spam <> '' then 'block' else 'allow' end as verdict,
  case when rule is null and spam <> '' then spam || '.*/' end as pattern
from f
"""
