"""URL filter: explicit allow and block rules, and for hosts without a rule a
link-graph judgement. Trust flows by personalised PageRank from allowed hosts
along links; distrust flows from blocked hosts against the links (a page that
links to a blocked host is suspect). A host is a seed with the share of its
pages that rules allow or block. Pages without a rule are blocked when their
host's distrust exceeds ``threshold`` times its trust. DataFrame functions only.

Host and path come from the url's text: host after the first ``://`` up to
``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from there up to ``?``,
``#`` or the end. A null url or one without ``://`` has both empty.

Scale. Pages are scanned twice: once for links, which are at once aggregated
to (host, host) edges with map-side combine, and once for the result. The
iterations work on host edges only, until no host's score changes; that takes
at least as many rounds as the longest shortest path from a seed. Rules and scores meet pages through the
host; the hosts with a large part of all pages (at most 1000 by construction)
are joined by broadcast, the others by shuffle.

Edge cases: null html has no links; a relative link points to the page's own
host and, as every link inside a host, moves no score; repeated pages are
separate rows; a host that no seed reaches over links scores 0 and is allowed
(its own restart mass, as a seed, does not count); an empty
table gives no rows. Equal-length rules: block wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, hot_join

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Relative difference of scores that is rounding; flows are iterated until no host changes by a hundredth of it.
ROUNDING = 1e-9
#: Below the normal range of doubles relative changes have no meaning.
LEAST = 1e-300

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*((?:/[^?#]*)?)", 1)


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n) between different hosts, from absolute and protocol-relative links."""
    href = F.expr(r"""regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["\']?((?:https?:)?//[^"\'\\s>]*)', 1)""")
    links = pages.select(host_of(col(url_col)).alias("src"), col(html_col).alias("html"))
    links = links.select("src", F.explode(href).alias("link"))
    links = links.select("src", host_of(F.regexp_replace("link", "^//", "http://")).alias("dst"))
    return (links.where("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def spread(edges: DataFrame, seeds: DataFrame, a: str, b: str, rounds: int | None, damping: float) -> DataFrame:
    """Personalised PageRank from ``seeds`` (host, weight) over edges a -> b:
    (host, score, came) after a fixed number of rounds, or, with None, when no
    host's score changes any more. ``came`` is the score without the host's own
    restart mass. Mass at hosts without links leaves the graph."""
    out = edges.groupBy(F.col(a).alias("host")).agg(F.sum("n").alias("all_n"))
    share = cut_lineage(edges.join(out, edges[a] == out["host"])
                        .select(F.col(a).alias("a"), F.col(b).alias("b"),
                                (F.col("n") / F.col("all_n")).alias("share")), "op3-share")
    base = cut_lineage(seeds, "op3-seeds")
    now = base.select("host", F.col("weight").alias("score"), F.lit(0.0).alias("came"))
    done = 0
    while rounds is None or done < rounds:
        none = F.lit(0.0)
        moved = (share.join(now, share["a"] == now["host"])
                 .groupBy("b").agg((F.sum(F.col("share") * F.col("score")) * damping).alias("came"))
                 .select(F.col("b").alias("host"), none.alias("own"), "came", none.alias("old")))
        now = (base.select("host", (F.col("weight") * (1 - damping)).alias("own"), none.alias("came"), none.alias("old"))
               .unionByName(moved)
               .unionByName(now.select("host", none.alias("own"), none.alias("came"), F.col("score").alias("old")))
               .groupBy("host").agg(*(F.sum(c).alias(c) for c in ("own", "came", "old"))))
        now = cut_lineage(now.select("host", (F.col("own") + F.col("came")).alias("score"), "came", "old"), "op3-score")
        done += 1
        change = F.abs(F.col("score") - F.col("old"))
        if rounds is None and now.where((change > F.col("score") * (ROUNDING / 100)) & (change > LEAST)).isEmpty():
            break
    return now.select("host", "score", "came")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host -> fits: the rules of the host and its parent domains, as structs
    that sort by length of the rule's text, then block before allow."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    named = hosts.select("host", F.explode(suffixes).alias("r_host"))
    return (named.join(rules, "r_host")
            .groupBy("host").agg(F.collect_list(F.struct(
                F.char_length(F.concat("r_host", "r_path")).alias("len"), "r_verdict",
                F.concat("r_host", "r_path").alias("rule"), "r_path")).alias("fits")))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               rounds: int | None = None, damping: float = 0.85, threshold: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "r_verdict string, r_host string, r_path string")
    src = pages.select(col(id_col).alias("page_id"), host_of(col(url_col)).alias("host"),
                       path_of(col(url_col)).alias("path"))
    hosts = src.groupBy("host").agg(F.count("*").alias("size"))
    fits = cut_lineage(hosts.join(host_rules(hosts, rules), "host", "left"), "op3-hosts")
    total = fits.agg(F.sum("size")).first()[0] or 0
    best = F.array_max(F.filter("fits", lambda r: F.col("path").startswith(r["r_path"])))
    ruled = hot_join(src, fits, "host", "size", total).select("page_id", "host", "path", best.alias("best"))
    ruled = cut_lineage(ruled.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                                     F.col("best.r_verdict").alias("by_rule")), "op3-ruled")
    # a host is a seed with the share of its pages that rules allow or block
    share = ruled.groupBy("host").agg(*(F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0)).alias(v)
                                        for v in ("allow", "block")))
    share = cut_lineage(share, "op3-seeds")
    edges = cut_lineage(host_links(pages, url_col, html_col), "op3-edges")
    flows = []
    for verdict, a, b, name in (("allow", "src", "dst", "trust"), ("block", "dst", "src", "distrust")):
        seeds = share.where(F.col(verdict) > 0).select("host", F.col(verdict).alias("weight"))
        # a seed's own restart mass repeats its rules: only mass that came over links judges other pages
        flows.append(spread(edges, seeds, a, b, rounds, damping).select("host", F.col("came").alias(name)))
    judged = fits.select("host", "size").join(flows[0], "host", "left").join(flows[1], "host", "left")
    judged = cut_lineage(judged.select("host", "size", *(F.coalesce(c, F.lit(0.0)).alias(c)
                                                         for c in ("trust", "distrust"))), "op3-judged")
    by_graph = F.when(F.col("distrust") > F.lit(threshold * (1 + ROUNDING)) * F.col("trust"), "block").otherwise("allow")
    return (hot_join(ruled, judged, "host", "size", total)
            .select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"),
                    "trust", "distrust"))
