"""URL filters: host rules, and trust that spreads over the link graph of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bare, forget, packed, staged, unpacked

#: (verdict, host, path): a rule holds for the host and its subdomains; the longest that fits wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING = 0.85
#: Rounds end when one moves less mass than this, of 1 for trust and 1 for distrust; 0.85 ** 60 is below it.
TOLERANCE, MOST_ROUNDS = 1e-4, 60
#: A host is blocked where its distrust is over this multiple of its trust.
DISTRUST_OVER_TRUST = 1.5


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, else null."""
    found = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def base_of(html: Column) -> Column:
    """The target of the first <base href>, else null."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<base\s[^>]*?href\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.when(found != "", found)


def link_hosts(html: Column, host: Column) -> Column:
    """Array of the hosts that a page's href values lead to, with repeats.

    ``scheme://host`` names its own; ``//host`` too; any other target is relative and leads to
    the host of <base href> where there is one that names a host, else to the page's.
    """
    targets = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<(?:a|area|link)\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))

    def named(target: Column) -> Column:
        return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url_host(target)).when(target.startswith("//"), url_host(F.concat(F.lit("x:"), target)))

    home = F.coalesce(named(base_of(html)), host)
    # mailto:, javascript: and the like lead nowhere.
    web = F.filter(targets, lambda t: ~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)"))
    return F.transform(web, lambda t: F.coalesce(named(t), home))


def host_edges(pages: DataFrame, host: Column, html: Column, tie_weight: float = 0.0) -> DataFrame:
    """(src, dst, weight): links between different hosts, by the logarithm of their number.

    A ``tie_weight`` above 0 also ties a host and its parent domain in both directions, for
    collections whose pages link to their own hosts only.
    """
    rows = pages.select(host.alias("src"), F.explode(link_hosts(html, host)).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    links = rows.groupBy("src", "dst").agg(F.log1p(F.count(F.lit(1))).alias("weight"))
    if tie_weight <= 0:
        return links
    hosts = pages.select(host.alias("host")).filter("host <> ''").distinct()
    # Domains above a host: example.org for a.b.example.org by way of b.example.org; a lone top level ties nothing.
    labels = F.split("host", "\\.")
    ups = hosts.select(F.explode(F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("src"), F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("dst"))))).alias("e")).select("e.src", "e.dst").distinct()
    ties = ups.unionByName(ups.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(float(tie_weight)))
    return links.unionByName(ties).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust): PageRank restarted at the seeds, by (host, trust, distrust) weights.

    Trust flows along the edges, distrust against them: who links to the blocked is
    distrusted. Mass of hosts without a way on returns to the seeds. Rounds go on until the
    mass that a round still moves is below the tolerance, or ``most_rounds`` at most, by when
    damping has left less of it than that. Edges are summed per pair of hosts beforehand, so a hub costs its
    neighbours, not its links.
    """
    one = F.lit(1.0)
    both = edges.select("src", "dst", "weight", F.lit("trust").alias("kind")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("kind")))
    both = staged(both, "urlgraph-edges")
    outs = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    flow = staged(both.join(outs, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), "urlgraph-flow")
    starts = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust").cast("double"), F.lit("distrust"), F.col("distrust").cast("double"))).alias("kind", "w")).filter("w > 0")
    totals = starts.groupBy("kind").agg(F.sum("w").alias("total"))
    starts = staged(starts.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("w") / F.col("total")).alias("start")), "urlgraph-starts")  # totals: two rows
    rank = starts.withColumnRenamed("start", "rank")
    for _ in range(most_rounds):
        moved = rank.withColumnRenamed("host", "src").join(flow, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("mass"))
        moved = staged(moved, "urlgraph-moved")
        gone = F.broadcast(moved.groupBy("kind").agg(F.sum("mass").alias("kept")).withColumnRenamed("kind", "k"))  # two rows
        back = starts.join(gone, F.col("kind") == F.col("k"), "left").select("kind", "host", (F.col("start") * (one - F.coalesce("kept", F.lit(0.0)))).alias("mass"), F.lit(0.0).alias("old"))
        parts = moved.select("kind", "host", "mass", F.lit(0.0).alias("old")).unionByName(back).unionByName(rank.select("kind", "host", F.lit(0.0).alias("mass"), F.col("rank").alias("old")))
        after = staged(parts.groupBy("kind", "host").agg(F.sum("mass").alias("rank"), F.sum("old").alias("old")), "urlgraph-rank")
        change = after.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        forget(moved, rank)
        rank = after
        if change < tolerance:
            break
    forget(both, flow)
    return rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS, damping: float = DAMPING, over: float = DISTRUST_OVER_TRUST, tie_weight: float = 0.0) -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    Seeds are the hosts of pages that a rule allows or blocks, weighted by their numbers.
    Pages that no rule fits get their host's verdict: block where distrust is over ``over``
    times trust. Hosts that no seed reaches, and urls without a host, are allowed. Null urls
    and pages are empty; repeated pages get equal verdicts and their links count again.
    """
    host, path = url_host(bare(url_col)), url_path(bare(url_col))
    seeds = pages.select(host.alias("host"), rule_for(host, path, rules)["verdict"].alias("v")).filter("host <> '' and v is not null").groupBy("host").agg(F.sum(F.when(F.col("v") == "allow", 1).otherwise(0)).alias("trust"), F.sum(F.when(F.col("v") == "block", 1).otherwise(0)).alias("distrust"))
    ranks = propagate(host_edges(pages, host, bare(html_col), tie_weight), seeds, tolerance, most_rounds, damping)
    ranks = ranks.select(F.col("host").alias("r_host"), "trust", "distrust")
    n_hosts = ranks.count()
    rows = pages.select(packed(pages), host.alias("host"), path.alias("path")).withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    joined = rows.join(F.broadcast(ranks) if n_hosts <= 200_000 else ranks, F.col("host") == F.col("r_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when(distrust > over * trust, "block").otherwise("allow")
    return unpacked(joined, pages.columns, {"host": F.col("host"), "path": F.col("path"), "rule": F.col("r.rule"), "verdict": F.coalesce(F.col("r.verdict"), by_graph), "trust": trust, "distrust": distrust})
