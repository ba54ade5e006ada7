r"""URL filters: host and path rules, and link-graph propagation for pages that no rule fits.

Personalised PageRank spreads trust from hosts with allowed pages along links; distrust spreads from hosts with
blocked pages against the links (who links to a bad host is suspect). Links are href targets of the pages and,
as an edge both ways, a host and its nearest parent domain that has pages of its own. A host is blocked when its
distrust, by its share of the mean, exceeds its trust and the threshold.

Edges are counted per pair of hosts before anything is joined, so a host with a third of all pages is one row per
neighbour. Ranks are kept per host; rank without a way out returns to the seeds. Rounds go on until the ranks settle:
each leaves at most DAMPING of the change before it, so their number is bounded, and more of them are an error.

Cases: a null url or one without "://" has an empty host and path, fits no rule, takes no part in the graph and
is allowed; null html has no links; repeated pages count as links again; without seeds every score is 0.
Of rules of equal length that fit, the greatest (verdict, host, path) holds, so block before allow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, ROUNDS, LEAST_DISTRUST = 0.85, 12, 0.5  # ROUNDS: of the SQL
#: Ranks are settled when a round changes them by less, summed over hosts, as a share of the mean; or by what doubles can tell.
TOLERANCE, LEAST_CHANGE = 1e-6, 1e-14
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Host, path, rule and ruled (the rule's verdict) beside the columns of ``pages``."""
    p = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, x in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(x)
        rule, ruled = F.when(fits, h + x).otherwise(rule), F.when(fits, v).otherwise(ruled)
    return p.withColumns({"rule": rule, "ruled": ruled})


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, counted, and parent domains."""
    at = pages.select("host", "html").where("host <> ''")
    links = at.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    links = links.select("src", host_of(F.concat(F.lit("x://"), F.regexp_replace("to", r"^(?:[a-zA-Z]*:)?//", ""))).alias("dst"))
    links = links.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = at.select("host").distinct()
    ups = hosts.select("host", F.posexplode(F.expr("transform(sequence(2, greatest(size(split(host, '[.]')), 2)), i -> concat_ws('.', slice(split(host, '[.]'), i, 255)))")).alias("far", "up"))
    up = ups.join(hosts.select(F.col("host").alias("up")), "up").groupBy("host").agg(F.min_by("up", "far").alias("up"))
    both = up.select(F.col("host").alias("src"), F.col("up").alias("dst"), F.lit(1.0).alias("weight"))
    return links.union(both).union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_rank(hosts: DataFrame, edges: DataFrame, seed: str, rounds: int | None = None) -> DataFrame:
    """host, rank: the personalised PageRank with restarts in proportion to column ``seed`` of ``hosts``.

    After so many ``rounds``, or as many as it takes to settle.
    """
    total = hosts.agg(F.sum(seed)).first()[0] or 0
    r = hosts.select("host", (F.col(seed) / F.lit(float(total)) if total else F.lit(0.0)).cast("double").alias("home"))
    r = r.withColumn("rank", F.col("home"))
    if not total:
        return r.select("host", "rank")
    known = hosts.select("host")
    e = edges.join(known.withColumnRenamed("host", "src"), "src", "left_semi").join(known.withColumnRenamed("host", "dst"), "dst", "left_semi")
    e = cut(e.join(e.groupBy("src").agg(F.sum("weight").alias("all")), "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    settled = max(TOLERANCE / hosts.count(), LEAST_CHANGE)
    most = math.ceil(math.log(settled / 2) / math.log(DAMPING)) + 2 if rounds is None else rounds
    r = r.withColumn("was", F.lit(0.0))
    for _ in range(most):
        got = r.join(e, r["host"] == e["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        r = cut(r.join(got, r["host"] == got["dst"], "left").select("host", "home", "was", "rank", F.coalesce("got", F.lit(0.0)).alias("got")))
        stayed, change = r.agg(F.sum("got"), F.sum(F.abs(F.col("rank") - F.col("was")))).first()
        # rank that went along edges stays; the rest returns to the seeds
        r = r.select("host", "home", F.col("rank").alias("was"), (DAMPING * F.col("got") + (1 - DAMPING * stayed) * F.col("home")).alias("rank"))
        if rounds is None and change <= settled:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks did not settle in {most} rounds")
    return r.select("host", "rank")


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    p = with_rules(pages, rules)
    hosts = cut(p.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")))
    edges = cut(host_edges(p))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    n = hosts.count()
    trust = personalised_rank(hosts, edges, "good").select(F.col("host").alias("h"), (F.col("rank") * n).alias("trust"))
    distrust = personalised_rank(hosts, back, "bad").select(F.col("host").alias("h"), (F.col("rank") * n).alias("distrust"))
    scores = cut(trust.join(distrust, "h"))
    # one row per host; Spark broadcasts it only below its own size bound, and splits a hot host otherwise
    out = p.select("page_id", "host", "path", "rule", "ruled").join(scores, F.col("host") == F.col("h"), "left")
    own = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") > LEAST_DISTRUST), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"))
