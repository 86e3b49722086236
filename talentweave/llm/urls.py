"""URL rules, and trust propagated over the links between hosts.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; of several
the longest wins. URLs that no rule fits get the verdict of their host. Hosts are seeds by the share of their pages that rules
allow (trust) or block (distrust). Trust follows links: personalised PageRank from the trusted hosts. Distrust
runs against them, from blocked hosts to those that link to them, shared by the links that arrive. Both are summed
as a series: every round sends the last increment, damped, along the edges. A kind ends when all that its increment can
still add, anywhere and in all later rounds, is at most ``REST``: an absolute score, whatever the number of seeds.

    trust = seed + damping * sum over links in of trust(from) * links / links out of it

A host is blocked if its distrust reaches ``threshold`` and exceeds its trust. Links within a host don't count; hosts
without links out (in) pass nothing on. Edges weigh the number of pages that hold the link. The number of rules is bounded
by configuration; pages, hosts and edges stay distributed, and edges are counted before they are joined.

NULL urls and urls without ``://`` have empty host and path; an empty host is never linked, and allowed. Repeated
pages count repeatedly. NULL html has no links. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.plans.storage import materialize

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
THRESHOLD = 0.5
REST = 1e-6  # of a score: less than this is left when a series ends
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as a struct ``length, host_length, rule, verdict``; NULL if none does. BLOCK wins ties."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(
                F.lit(len(h) + len(p)).alias("length"), F.lit(len(h)).alias("host_length"), F.lit(h + p).alias("rule"),
                F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    nothing = F.lit(None).cast("struct<length:int,host_length:int,rule:string,verdict:string>")
    return F.greatest(nothing, nothing, *fits)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, pages``: how many pages of a host link to another one."""
    found = F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))
    linked = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
    return linked.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` from seeds of these names and edges ``src, dst, pages``.

    Each round writes one table: of every host reached so far its sum and what came last. A kind of score goes on until less than
    ``REST`` of all its scores together can still arrive, so the number of rounds depends on the logarithm of the seeds alone.
    """
    edges = materialize(edges, "host-edges")
    out = edges.groupBy(F.col("src").alias("of")).agg(F.sum("pages").alias("all"))
    come = edges.groupBy(F.col("dst").alias("of")).agg(F.sum("pages").alias("all"))
    share = (F.col("pages") / F.col("all") * damping).alias("share")
    ways = materialize(
        edges.join(out, F.col("src") == F.col("of")).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("trust").alias("kind"), share)
        .unionByName(edges.join(come, F.col("dst") == F.col("of")).select(
            F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("distrust").alias("kind"), share)),
        "host-ways")
    scores = seeds.select("host", F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("last"), F.col(k).cast("double").alias("score")) for k in ("trust", "distrust")
    ]))).where("last > 0")
    while True:
        scores = materialize(scores, "host-scores")
        # What came last adds in this and all later rounds at most its sum times damping / (1 - damping).
        left = {r["kind"]: r["rest"] * damping / (1 - damping) for r in scores.groupBy("kind").agg(F.sum("last").alias("rest")).collect()}
        going = [k for k, rest in left.items() if rest > REST]
        if not going:
            break
        moving = scores.where(F.col("kind").isin(going) & (F.col("last") > 0)).withColumnRenamed("kind", "way").drop("score")
        sent = ways.join(moving, (F.col("a") == F.col("host")) & (F.col("way") == F.col("kind"))).select(
            F.col("b").alias("host"), "kind", (F.col("share") * F.col("last")).alias("last"))
        scores = scores.withColumn("last", F.lit(0.0)).unionByName(sent.withColumn("score", F.col("last"))).groupBy("host", "kind").agg(
            F.sum("last").alias("last"), F.sum("score").alias("score"))
    of = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")}
    return scores.groupBy("host").agg(*of.values())


def judged(
    pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page."""
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce(F.col("_rule.verdict"), F.lit("")) == ALLOW).cast("int")).alias("trust"),
        F.avg((F.coalesce(F.col("_rule.verdict"), F.lit("")) == BLOCK).cast("int")).alias("distrust"))
    scores = propagated(seeds, host_edges(pages, url_col, html_col)).withColumnRenamed("host", "_host")
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return ruled.join(scores, F.col("host") == F.col("_host"), "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(bad, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
