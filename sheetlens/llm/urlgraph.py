"""URL filters: longest-match rules, and link-graph propagation for what no rule judges.

Hosts are nodes; a page's links to other hosts are edges, weighted by the pages that hold
them. Trust starts at hosts in proportion to the share of their pages that rules allow and
follows links (personalised PageRank); distrust starts at hosts in proportion to the share
of pages that rules block and follows links backwards. A host is blocked where distrust
makes up the threshold share of both, each taken as a share of all mass of its kind: what is
lost at hosts without links differs by kind and must not decide between them.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import saved

# Fixed values: (verdict, host, path) of the registered query.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


def _authority(rest: Column) -> Column:
    """The host at the start of ``rest``, A-Z lower-cased."""
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end; path: then up to ``?``, ``#`` or end. Else both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return _authority(rest), F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are few: one expression each."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts; weight: the pages of src that link to dst.

    ``pages(host, html)``. Only absolute links and those that start with ``//`` leave a host.
    """
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_HREF), 1)
    targets = F.array_distinct(F.transform(links, lambda u: F.when(u.startswith("//"), _authority(F.substring(u, 3, F.length(u)))).otherwise(host_and_path(u)[0])))
    return (
        pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
        .filter("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 2000, every: int = 5) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind of mass from its seeds.

    ``edges(kind, src, dst, weight)``, ``seeds(kind, host, mass)``. Both kinds run in one
    loop. What a host without links would pass on is lost, which scales the scores of a kind
    alike. Every few rounds the scores are cut from their lineage by a checkpoint; the loop
    ends once they change no host's score by more than a millionth of that score, so that
    small scores far from any seed are settled too, and raises if ``rounds`` do not suffice.
    """
    total = edges.groupBy("kind", "src").agg(F.sum("weight").alias("_t"))
    steps = saved(edges.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("_t")).alias("p")))
    start = saved(
        seeds.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).filter("mass > 0")
        .join(seeds.groupBy("kind").agg(F.sum("mass").alias("_all")), "kind")
        .select("kind", "host", (F.col("mass") / F.col("_all")).alias("mass")))
    scores = start.select("kind", "host", F.col("mass").alias("score"))
    if steps.isEmpty():
        return scores
    home = start.select("kind", "host", ((1 - damping) * F.col("mass")).alias("score"))
    kept = scores
    for k in range(1, rounds + 1):
        moved = (
            scores.join(steps.withColumnRenamed("src", "host"), ["kind", "host"])
            .select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score")))
        scores = moved.unionByName(home).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % every == 0 or k == rounds:
            scores = saved(scores)
            change = (
                scores.select("kind", "host", F.col("score").alias("new"), F.lit(0.0).alias("old"))
                .unionByName(kept.select("kind", "host", F.lit(0.0).alias("new"), F.col("score").alias("old")))
                .groupBy("kind", "host").agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
                .agg(F.max(F.try_divide(F.abs(F.col("new") - F.col("old")), F.greatest("new", "old"))).alias("d")).first().d)
            if (change or 0.0) < 1e-6:
                break
            kept = scores
    else:
        raise RuntimeError(f"scores did not settle in {rounds} rounds")
    return scores


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, distrust) for each row of ``pages(page_id, url, html)``.

    verdict is the longest rule's, else ``block`` where the host's distrust share reaches
    ``threshold``, else ``allow``; hosts that no mass reaches, and urls without a host, have
    distrust 0. Null and repeated rows are judged like any others; an empty table gives no
    row. Other columns of ``pages`` aren't read, whatever their names.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    parsed = parsed.withColumn("_m", match_rule(F.col("host"), F.col("path"), rules))
    shares = parsed.filter("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce(F.col("_m.verdict"), F.lit("")) == "allow").cast("double")).alias("trust"),
        F.avg((F.coalesce(F.col("_m.verdict"), F.lit("")) == "block").cast("double")).alias("distrust"))
    seeds = shares.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "mass"))
    edges = saved(host_edges(parsed))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    reached = saved(propagate(both, seeds))
    shared = reached.join(F.broadcast(reached.groupBy("kind").agg(F.sum("score").alias("_all"))), "kind").withColumn("score", F.col("score") / F.col("_all"))  # two kinds, two rows
    scores = shared.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("_bad"), F.sum("score").alias("_both"))
    hosts = scores.select("host", F.when(F.col("_both") > 0, F.col("_bad") / F.col("_both")).otherwise(0.0).alias("_d"))
    share = F.coalesce(F.col("_d"), F.lit(0.0))
    return parsed.drop("html").join(hosts, "host", "left").select(
        "page_id", "host", "path", F.col("_m.rule").alias("rule"),
        F.coalesce(F.col("_m.verdict"), F.when(share >= threshold, "block").otherwise("allow")).alias("verdict"), share.alias("distrust"))
