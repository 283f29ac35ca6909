"""URL filter: rules by host and path, and link-graph propagation between hosts for what no rule decides.

Trust flows from hosts that the rules mostly allow along the links of pages to other hosts; distrust flows from hosts that
the rules mostly block against the direction of links. Both are personalised PageRanks over the same edge table, in
DataFrame operations; each step is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.plans.registry import query
from gridloom.session import materialize

#: (verdict, host, path): fixed rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, STEPS, TOLERANCE = 0.85, 20, 1e-6
#: Steps that always reach the tolerance: a step changes both kinds together by 4 at most, and by DAMPING times the last.
ENOUGH = ceil(log(TOLERANCE / 4) / log(DAMPING)) + 1
#: A host is blocked if more than this share of its trust and distrust together is distrust.
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    none = F.lit(None).cast("string")
    return tuple(reduce(lambda rest, i: F.when(fits[i], F.lit(values[i])).otherwise(rest), reversed(range(len(ordered))), none)
                 for values in ([h + p for _, h, p in ordered], [v for v, _, _ in ordered]))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links of pages (host, html) to other hosts, counted. Relative links stay on their host."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    return links.withColumn("dst", dst).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, steps_at_most: int = STEPS) -> DataFrame:
    """(kind, host, rank) from edges (src, dst, n) and seeds (kind, host, mass), kind trust or distrust.

    The ranks of a kind add up to 1 if it has seeds; what a host without outgoing edges holds returns to the seeds.
    Steps end when all ranks together change by less than TOLERANCE, which ENOUGH steps always reach.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    steps = materialize(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    mass = seeds.groupBy("kind").agg(F.sum("mass").alias("m"))
    seeds = materialize(seeds.join(mass, "kind").select("kind", "host", (F.col("mass") / F.col("m")).alias("seed")))
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    for _ in range(steps_at_most):
        moved = (ranks.join(steps, (ranks.kind == steps.kind) & (ranks.host == steps.src))
                 .select(steps.kind, F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("part")))
        gone = moved.groupBy("kind").agg(F.sum("part").alias("gone"))
        back = seeds.join(gone, "kind", "left").select("kind", "host", (F.col("seed") * (1 - F.coalesce("gone", F.lit(0.0)))).alias("part"))
        after = materialize(moved.unionByName(back).groupBy("kind", "host").agg(F.sum("part").alias("rank")))
        change = (after.select("kind", "host", F.col("rank").alias("d")).unionByName(ranks.select("kind", "host", (-F.col("rank")).alias("d")))
                  .groupBy("kind", "host").agg(F.abs(F.sum("d")).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0])
        ranks = after
        if change < TOLERANCE:
            break
    return ranks


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    A null url, or one without ://, has an empty host and path, which no rule fits and no link reaches: it is allowed,
    as is any host that neither trust nor distrust reaches. Null pages have no links. Repeated rows and ids are judged
    each; other columns are not read; no rows give no rows.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("rule", rule).withColumn("ruled", verdict)
    hosts = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.sum((F.col("ruled") == "allow").cast("long")).alias("allowed"), F.sum((F.col("ruled") == "block").cast("long")).alias("blocked"))
    hosts = materialize(hosts.fillna(0, ["allowed", "blocked"]))
    seeds = hosts.where("2 * allowed > n").select(F.lit("trust").alias("kind"), "host", F.lit(1.0).alias("mass")).unionByName(
        hosts.where("2 * blocked > n").select(F.lit("distrust").alias("kind"), "host", F.lit(1.0).alias("mass")))
    ranks = propagate(materialize(host_edges(parsed)), seeds, ENOUGH)
    pivot = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"),
                                      F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    bad = pivot.where(F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust"))).select(F.col("host").alias("bad_host"))
    joined = ruled.select("id", "host", "path", "rule", "ruled").join(materialize(bad), F.col("host") == F.col("bad_host"), "left")
    return joined.select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))


@query("op4_host_rank")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
