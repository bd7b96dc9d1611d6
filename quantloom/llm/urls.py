"""URL filters: allow and block rules, and link-graph propagation for hosts that no rule decides.

A rule has a host, which covers its subdomains, and a path that the url's path starts with; the
longest fitting rule decides. For the rest, trust flows along links between hosts from hosts with
allowed pages: a personalised PageRank, which a host divides among those it links to. Distrust flows
against the links from hosts with blocked pages: a host has the mean distrust of those it links to, so
it is the chance that a walk along its links ends at a blocked seed, from 0 to 1 however many hosts
link to the same blocked one. A host's seed is the share of its pages that a rule allows or blocks; a
host without outgoing links keeps its own share. A page without a rule is blocked if its host's
distrust is over the threshold and over its trust, and allowed otherwise.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is
judged as host ''; null html has no links; links without a host point to their own page's host and
don't count as edges; links in double, single or no quotes count, and ``&amp;`` in them is ``&``;
repeated rows are pages of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import dropped, saved

#: Rounds end when no rank is further than TOLERANCE from its limit.
DAMPING, TOLERANCE = 0.85, 1e-6
THRESHOLD = 0.5
#: Rules are part of the plan, so their number is bounded.
MOST_RULES = 500
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The fitting rule as a string, and its verdict; null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, counted before the shuffle."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link")).withColumn("link", F.replace("link", F.lit("&amp;"), F.lit("&")))
    to, _ = host_and_path(F.concat(F.lit("x:"), F.regexp_replace("link", r"^[^/]*:?(?=//)", "")))
    return links.select(F.col("host").alias("src"), to.alias("dst")).where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def most_rounds(n: int, damping: float, tolerance: float) -> int:
    """Rounds after which the ranks of n hosts are sure to be settled: each shrinks the sum of all changes by the damping."""
    return 2 + math.ceil(math.log(tolerance * (1 - damping) / max(n, 1)) / math.log(damping))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from hosts (host, trust_seed, distrust_seed) and edges (src, dst, n).

    Both solve r = (1 - damping) seed + damping * inflow. Of trust a host sends its own over its edges
    in proportion to n; of distrust it takes that of the hosts behind its edges in proportion to n; a
    host without edges keeps its own. Sums over edges are made in each task before the shuffle.
    """
    edges = saved(edges, "host-edges")
    total = saved(edges.groupBy("src").agg(F.sum("n").alias("total")), "host-totals")
    shares = edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))
    none = F.lit(0.0)
    moves = shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("share").alias("trust_share"), none.alias("distrust_share"))
    moves = saved(moves.unionByName(shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), none.alias("trust_share"), F.col("share").alias("distrust_share"))), "host-moves")
    known = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct().join(hosts.select("host"), "host", "left_anti")
    state = hosts.unionByName(known.select("host", none.alias("trust_seed"), none.alias("distrust_seed")))
    state = state.join(total.select(F.col("src").alias("host"), F.lit(True).alias("sends")), "host", "left")
    state = state.select("host", "trust_seed", "distrust_seed", F.col("sends").isNull().alias("keeps"), F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    state = saved(state.withColumns({"trust_moved": none, "distrust_moved": none}), "host-state")
    dropped(edges)
    dropped(total)
    for _ in range(most_rounds(state.count(), damping, tolerance)):
        inflow = moves.join(state.select("host", "trust", "distrust"), "host").groupBy(F.col("to").alias("host")).agg(*(F.sum(F.col(f"{k}_share") * F.col(k)).alias(f"{k}_in") for k in ("trust", "distrust")))
        new = state.join(inflow, "host", "left")
        parts = {}
        for k in ("trust", "distrust"):
            inner = F.coalesce(f"{k}_in", none) + F.when(F.col("keeps"), F.col(k)).otherwise(0.0)
            parts[f"new_{k}"] = (1 - damping) * F.col(f"{k}_seed") + damping * inner
        new = new.withColumns(parts)
        moved = [F.abs(F.col(f"new_{k}") - F.col(k)).alias(f"{k}_moved") for k in ("trust", "distrust")]
        new = saved(new.select("host", "trust_seed", "distrust_seed", "keeps", F.col("new_trust").alias("trust"), F.col("new_distrust").alias("distrust"), *moved), "host-state")
        dropped(state)
        state = new
        # A round shrinks the sum of the changes of trust, and the largest change of distrust, by the damping at least.
        change = state.agg(F.greatest(F.sum("trust_moved"), F.max("distrust_moved"))).first()[0] or 0.0
        if change * damping / (1 - damping) < tolerance:
            break
    else:
        raise RuntimeError("ranks did not settle")
    dropped(moves)
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled})
    share = lambda v: F.count_if(F.coalesce(F.col("ruled") == v, F.lit(False))) / F.count("*")
    hosts = rows.groupBy("host").agg(share("allow").alias("trust_seed"), share("block").alias("distrust_seed"))
    ranks = propagate(hosts, host_edges(rows))
    own = F.when((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return rows.drop("html").join(ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
