"""URL filters: rules on host and path, then trust and distrust along links between hosts.

Everything is DataFrame operations and SQL functions.

A url is judged by the longest rule that fits it. Where none fits, its host's scores decide.
Two walks run over the edges "a page of host A links to host B": personalised PageRank from
trusted hosts along the links (what trusted hosts link to is trusted), and from blocked hosts
against them (what links to blocked hosts is not). A host's seed is the share of its pages
that rules allow, or block. Scores are divided by the seeds' share of the walk, so that a host
without links scores its own seed.

Distrust is split among all that link to a blocked host, so one of many farms gets little of it.
A host's ``exposure`` is not: it is the chance that a reader who starts there and follows links,
each time with chance ``damping``, comes to a blocked page. A host that links to nothing but
blocked ones has exposure ``damping``, however many others do. A host is blocked where its
distrust or its exposure is at least ``threshold`` and above its trust.

Edge cases: a null url, or one without ``://``, has empty host and path and is allowed unless
a rule fits; rows that repeat are judged alike, each; links of a host to itself, and links
that name no host, make no edges; a null page has no links; an empty table gives an empty
result; further columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinvote.session import materialize

LINK = r"""(?i)\bhref\s*=\s*["']?\s*[a-z][a-z0-9+.\-]*://([^/?#"'\s<>]+)"""


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null where none does.

    ``rules``: (verdict, host/path). The list is a parameter that the query text holds.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, hit).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target, weight): the share of the source host's links that go to the target."""
    links = pages.select(
        host_of(F.col(url)).alias("source"),
        F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("_link"),
    ).select("source", _lower(F.col("_link")).alias("target"))
    counted = (
        links.filter((F.col("source") != "") & (F.col("source") != F.col("target")))
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("links"))
    )
    return counted


def spread_scores(
    seeds: DataFrame,
    edges: DataFrame,
    start: str,
    end: str,
    damping: float,
    rounds: int,
    cut: int = 5,
    meeting: bool = False,
) -> DataFrame:
    """Personalised PageRank: (host, score) after ``rounds`` steps from column ``start`` to ``end``.

    With ``meeting`` a link counts as a share of the links of the host in column ``end``, and
    only in so far as that host is no seed: the score is then the chance to meet a seed on a
    walk from the host, from ``end`` to ``start``. A round is one join on the edges and one sum that combines before its shuffle. The
    lineage is cut every ``cut`` rounds by a written table.
    """
    whole = end if meeting else start
    totals = edges.groupBy(whole).agg(F.sum("links").alias("_all"))
    shares = edges.join(totals, whole).select(
        F.col(start).alias("_from"), F.col(end).alias("host"), (F.col("links") / F.col("_all")).alias("_share")
    )
    if meeting:
        goes_on = F.col("_share") * (1 - F.coalesce("seed", F.lit(0.0)))
        shares = shares.join(seeds, "host", "left").select("_from", "host", goes_on.alias("_share"))
    shares = materialize(shares, "host-shares")
    base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    scores = base
    for i in range(rounds):
        moved = scores.withColumnRenamed("host", "_from").join(shares, "_from").select(
            "host", (F.col("score") * F.col("_share") * damping).alias("score")
        )
        scores = moved.unionByName(base).groupBy("host").agg(F.sum("score").alias("score")).filter("score > 0")
        if cut and i % cut == cut - 1 and i + 1 < rounds:
            scores = materialize(scores, "host-scores")
    return scores


def host_scores(
    pages: DataFrame, url: str, html: str, rules: Sequence[tuple[str, str]], damping: float = 0.85, rounds: int = 10
) -> DataFrame:
    """(host, trust, distrust, exposure) of every host that is a seed or is reached from one."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.select(host.alias("host"), rule_of(host, path, rules)["verdict"].alias("_verdict"))
    shares = judged.filter("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("_verdict") == "allow", 1.0).otherwise(0.0)).alias("trusted"),
        F.avg(F.when(F.col("_verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"),
    )
    shares = materialize(shares, "host-seeds")
    edges = materialize(host_edges(pages, url, html), "host-edges")
    seeds = lambda kind: shares.filter(F.col(kind) > 0).select("host", F.col(kind).alias("seed"))
    trust = spread_scores(seeds("trusted"), edges, "source", "target", damping, rounds)
    distrust = spread_scores(seeds("blocked"), edges, "target", "source", damping, rounds)
    exposure = spread_scores(seeds("blocked"), edges, "target", "source", damping, rounds, meeting=True)
    scale = F.lit(1 / (1 - damping))
    walks = {"trust": trust, "distrust": distrust, "exposure": exposure}
    scored = [
        walk.select("host", *[(F.col("score") * scale if n == name else F.lit(0.0)).alias(n) for n in walks])
        for name, walk in walks.items()
    ]
    return reduce(DataFrame.unionByName, scored).groupBy("host").agg(
        *[F.round(F.sum(name), 9).alias(name) for name in walks]
    )


def judge_urls(
    pages: DataFrame,
    key: str,
    url: str,
    html: str,
    rules: Sequence[tuple[str, str]],
    damping: float = 0.85,
    rounds: int = 10,
    threshold: float = 0.5,
) -> DataFrame:
    """Per row: key, host, path, rule (null where none fits), verdict, and the host's scores.

    Only blocked hosts meet the pages' hosts in a join, so a host with a third of all pages
    that is not blocked is never gathered; a blocked one is split by adaptive execution.
    """
    scores = host_scores(pages, url, html, rules, damping, rounds)
    doubt = F.greatest("distrust", "exposure")
    bad = scores.filter((doubt >= threshold) & (doubt > F.col("trust"))).select(F.col("host").alias("_bad"))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn(
        "_rule", rule_of(F.col("host"), F.col("path"), rules)
    )
    by_scores = F.when(F.col("_bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    ruled, other = rows.filter(F.col("_rule").isNotNull()), rows.filter(F.col("_rule").isNull())
    judged = other.join(bad, F.col("host") == F.col("_bad"), "left").select(
        key, "host", "path", F.lit(None).cast("string").alias("rule"), by_scores.alias("verdict")
    )
    return ruled.select(
        key, "host", "path", F.col("_rule")["rule"].alias("rule"), F.col("_rule")["verdict"].alias("verdict")
    ).unionByName(judged)
