"""Operator 13: URL filters by hashed host-suffix and path-prefix expressions, in DataFrame operations.

A rule is a host and a path with the verdict block or allow. It fits its host and all hosts below it,
if the URL's path starts with the rule's. A URL has one expression for each suffix of its host, cut at
dots, and each prefix of its path; a rule fits exactly if its host and path, joined, are among them.
Expressions are made only of the shapes that rules have (labels of the host, characters of the path),
so their number follows the rules and not the length of a URL; with more than `SHAPES` shapes all of a
URL's own are made.

As in lists that browsers keep, the first join is on 32 bits of the expression's SHA-256, which is a
small table even for many rules; what passes is confirmed on the whole digest, and of the rules that
fit a URL the longest counts (characters of host and path; then the longer host). A rule given twice
with both verdicts blocks. URLs without a rule get the default verdict.

Only distinct pairs of host and path are expanded, combined before the shuffle, and joined back to the
rows. Tables of rules are broadcast up to a measured bound; beyond it, and for the join back, a hot
expression or URL is on the side that adaptive execution splits, as rules and pairs are unique.

Cases: a null URL, or one without `://`, has an empty host and path and no rule; a URL whose path is
empty fits only rules with an empty path; very long URLs are judged whole; rows of one page_id, or
without one, are judged each for its own URL; rules with a null field fit nothing; without rules, all
rows get the default; an empty table gives an empty result; other columns are not read by `judge` and
pass through `allowed`, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_row

#: Greatest number of different shapes that are listed in the plan.
SHAPES = 4096
#: Rules up to this number are broadcast: at most 8 bytes of each for the first join, 100 to confirm.
BROADCAST_RULES = 200_000

#: The rules of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """(host, path, verdict) of a short list of rules."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in rule) + ")" for rule in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(host, path, verdict)")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def labels_of(host: Column) -> Column:
    """Parts of a host between dots."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_shapes(rules: DataFrame) -> list[tuple[int, int]] | None:
    """The different (labels, characters of the path) of rules; None if they are more than SHAPES."""
    rows = rules.select(labels_of(F.col("host")).alias("labels"), F.length("path").alias("chars")).distinct().limit(SHAPES + 1).collect()
    return sorted((r.labels, r.chars) for r in rows) if len(rows) <= SHAPES else None


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]] | None) -> Column:
    """Suffix of the host with prefix of the path, for each shape that the URL has."""

    def joined(labels: Column, chars: Column) -> Column:
        return F.concat(F.call_function("substring_index", host, F.lit("."), -labels), F.left(path, chars))

    if shapes is None:
        every = F.transform(F.sequence(F.lit(1), labels_of(host)), lambda k: F.transform(F.sequence(F.lit(0), F.length(path)), lambda n: joined(k, n)))
        return F.flatten(every)
    if not shapes:
        return F.array().cast("array<string>")
    listed = F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("chars")) for k, n in shapes])
    own = F.filter(listed, lambda s: (s["labels"] <= labels_of(host)) & (s["chars"] <= F.length(path)))
    return F.transform(own, lambda s: joined(s["labels"], s["chars"]))


def short(digest: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def known_rules(rules: DataFrame) -> DataFrame:
    """(digest, rule, host_chars, blocks), one row for each host and path."""
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna()
    rows = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    return rows.select(F.sha2(F.concat("host", "path"), 256).alias("digest"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "blocks")


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, blocks): the rule that counts for each pair of (host, path) that has one."""
    known = known_rules(rules)
    usable = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna()
    shapes = rule_shapes(usable)
    few = known.count() <= BROADCAST_RULES
    sized = F.broadcast if few else (lambda t: t.hint("merge"))
    asked = urls.select("host", "path").distinct().select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("expression"))
    asked = asked.select("host", "path", F.sha2("expression", 256).alias("digest"))
    near = asked.withColumn("short", short(F.col("digest"))).join(sized(known.select(short(F.col("digest")).alias("short")).distinct()), "short", "left_semi")
    sure = near.drop("short").join(sized(known), "digest")
    longest = F.struct(F.length("rule"), "host_chars")
    return sure.groupBy("host", "path").agg(F.max_by(F.struct("rule", "blocks"), longest).alias("x")).select("host", "path", "x.rule", "x.blocks")


def judged(pages: DataFrame, rules: DataFrame, carry: list[Column], default: str) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select(*carry, host.alias("host"), path.alias("path"))
    found = fitting(rows, rules).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "rule", "blocks")
    rows = rows.join(found, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    return rows.drop("__host", "__path").withColumn("verdict", F.when(F.col("rule").isNull(), default).when(F.col("blocks"), "block").otherwise("allow")).drop("blocks")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict."""
    return judged(pages, rules, [F.col("page_id")], default).select("page_id", "host", "path", "rule", "verdict")


def allowed(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The pages that are not blocked, with their columns."""
    return judged(pages, rules, [whole_row(pages)], default).filter("verdict = 'allow'").select("row.*")


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH r AS (SELECT * FROM (VALUES {rules}) AS t(rule_host, rule_path, rule_verdict)),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT n, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
    SELECT n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), f AS (
    SELECT n, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
    FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (n)
"""


SQL = _sql()
