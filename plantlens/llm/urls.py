"""URL filters: rules by host and path, and link-graph propagation between hosts; DataFrame functions only.

Trust spreads from hosts with allowed pages along links (personalised PageRank, restarts at the trusted seeds); distrust
spreads from hosts with blocked pages against the links, from a page's host to those that link to it. A page without a
rule gets its host's verdict: block where distrust outweighs trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Fixed values: (verdict, host, path) of the rules.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DAMPING, SETTLED = 0.85, 1e-6
#: Rounds that the SQL writes out, and rounds after which propagation that hasn't settled is an error; a round leaves at
#: most DAMPING of the change, so 90 are enough.
ROUNDS, MOST_ROUNDS = 20, 120
#: A host is blocked when its distrust is over this many times its trust.
RATIO = 1.0
LINK = r"""(?i)(?:href|src)\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE = "^([A-Za-z][A-Za-z0-9+.-]*:)?//"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ://, null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts its path.

    `rules` is a short list, written into the plan; of equally long ones the first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): links between different hosts; relative links, also with an address inside, stay on their host."""
    targets = F.filter(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)), lambda u: u.rlike(ABSOLUTE))
    links = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(targets)).alias("u"))
    absolute = F.when(F.col("u").startswith("//"), F.concat(F.lit("x:"), F.col("u"))).otherwise(F.col("u"))
    return links.select("src", host_of(absolute).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = MOST_ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(kind, host, score) of personalised PageRank; edges: kind, src, dst, n; seeds: kind, host, weight (weights of a kind sum to 1).

    Both kinds go through the same rounds: a join of scores with edges on the source and a partial aggregate by target.
    Scores of hosts without edges out return to the seeds. Hosts that no seed reaches have no row. Rounds go on until they
    change the scores by less than `settled` in all; an error if `rounds` don't get there.
    """
    if edges.isEmpty():
        return seeds.select("kind", "host", F.col("weight").alias("score"))
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    seeds = written(seeds, "seeds")
    scores = seeds.select("kind", "host", F.col("weight").alias("score"))
    last = None
    for _ in range(rounds):
        sent = scores.join(shares, (scores["kind"] == shares["kind"]) & (scores["host"] == shares["src"])).select(shares["kind"], F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("got"))
        moved = sent.groupBy("kind", "host").agg(F.sum("got").alias("got"))
        kept = moved.groupBy("kind").agg(F.sum("got").alias("moved"))  # one row a kind
        restart = seeds.join(F.broadcast(kept), "kind", "left").select("kind", "host", (F.col("weight") * (1 - F.coalesce("moved", F.lit(0.0)))).alias("got"))
        old = scores.select("kind", "host", F.lit(0.0).alias("got"), F.col("score").alias("old"))
        both = moved.unionByName(restart).withColumn("old", F.lit(0.0)).unionByName(old)
        new = written(both.groupBy("kind", "host").agg(F.sum("got").alias("score"), F.sum("old").alias("old")), "scores")
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        if last is not None:
            discard(last)
        last, scores = new, new.select("kind", "host", "score")
        if change is None or change < settled:
            return scores
    raise RuntimeError(f"host scores still change by {change} after {rounds} rounds")


def judged(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id", rules: list[tuple[str, str, str]] | None = None, ratio: float = RATIO) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ://, has an empty host and path and no rule. A host without trust and distrust, the empty
    one among them, is allowed. Repeated rows are judged alike and count as seeds and links each; null html has no links;
    an empty table gives no rows; other columns are not kept.
    """
    rules = RULES if rules is None else rules
    host, path = host_of(F.col(url)), path_of(F.col(url))
    x = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = x.withColumns({"rule": rule, "by_rule": verdict})
    seeds = ruled.where("by_rule is not null and host <> ''").groupBy(F.col("by_rule").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    totals = seeds.groupBy("kind").agg(F.sum("n").alias("all"))  # two rows at most
    seeds = seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("weight"))
    one_way = written(host_edges(ruled, "host", "html"), "links")
    edges = one_way.select(F.lit("allow").alias("kind"), "src", "dst", "n").unionByName(one_way.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    scores = propagated(edges, seeds)
    hosts = scores.groupBy(F.col("host").alias("_host")).agg(F.sum(F.when(F.col("kind") == "allow", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("score"))).alias("distrust"))
    # Written, so that Spark knows its size: it is broadcast if small, else joined with the pages of a hot host split.
    out = ruled.drop("html").join(written(hosts, "hosts"), F.col("host") == F.col("_host"), "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    by_host = F.when(distrust > ratio * trust, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def report(pages: DataFrame, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    return judged(pages, **options).select("page_id", "host", "path", "rule", "verdict")
