"""URL filters with link-graph propagation.

Rules judge a url by its host and path; the longest rule that fits wins. Urls that no rule
judges go by their host, scored on the graph of links between hosts: personalised PageRank carries trust from
hosts with allowed pages along links, and distrust goes from hosts with blocked pages against the links, to those that
link to them. A seed's weight is the share of its pages that rules allow or block. A host is blocked if rules
block half of its own pages, and more than they allow; or if its distrust is at least `threshold` of both together, and
what links brought it of that at least `floor` of what a wholly blocked host starts with, so a trace of distrust doesn't block.

Scale: rules are rows. The distinct urls are joined to them by equality, on the suffixes of the
host with as many labels as some rule has, and on the beginnings of the path that have the length of one of that host's rules, so any
number of rules and any length of urls will do. Links are read from the html by built-in functions and folded to one
weighted edge for each pair of hosts before any iteration, so a host with a third of all pages is
a few rows. Each round is one equality join and one partial aggregate for both directions at once
on the mass that still moves; its result is cut off in the shared folder. The mass shrinks by
`damping` a round, and rounds go on until less than `tolerance` of it moves. A hub's edges are
split at run time by the join's skew handling; scores are joined to pages by host.

Edge cases: a null url, or one without ://, has an empty host and path; a host that neither
trust nor distrust reaches is allowed; links without a host, and links within a host, don't
count; of equally long rules the last in the order of their text is taken; repeated rows are repeated
pages; further columns pass through, but for those with the name of a result or helper, which
are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, forget

DAMPING = 0.85
THRESHOLD = 0.5
FLOOR = 0.01
TOLERANCE = 1e-4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path and _rule, a struct(rule, verdict), for each distinct host and path that a rule (host, path, verdict) fits."""
    spark = urls.sparkSession
    rows = spark.createDataFrame(sorted(set(rules)), "_h string, _p string, verdict string")
    lengths = rows.groupBy("_h").agg(F.collect_set(F.length("_p")).alias("_n"))
    urls = urls.select("host", "path").distinct()
    dots = F.length("host") - F.length(F.replace("host", F.lit(".")))
    wanted = sorted({h.count(".") for h, _, _ in rules})
    suffixes = F.array_compact(F.array(*[F.when(dots >= n, F.substring_index("host", ".", -n - 1)) for n in wanted]))
    hosts = urls.select("host").distinct().select("host", F.explode(suffixes).alias("_h")).join(lengths, "_h")
    asked = urls.join(hosts, "host").select("host", "path", "_h", F.explode("_n").alias("_n")).where(F.length("path") >= F.col("_n"))
    found = asked.withColumn("_p", F.substr("path", F.lit(1), F.col("_n"))).join(rows, ["_h", "_p"])
    text = F.concat("_h", "_p")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length(text), text.alias("rule"), "verdict")).alias("_best"))
    return best.select("host", "path", F.struct("_best.rule", "_best.verdict").alias("_rule"))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: links from the pages of one host to another, counted."""
    links = pages.select(host(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_HREF), F.lit(1))).alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    ends = links.select("src", host(whole).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return ends.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust.

    seeds: host, trusted (boolean) and weight. The seeds of a kind share a mass of 1 by their weights; mass that
    reaches a host without further links is not handed on. A score is the sum over all rounds of
    (1 - damping) of the mass that passed the host, but for the last `tolerance` of the mass.
    """
    ahead = edges.select(F.lit(True).alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "weight")
    back = edges.select(F.lit(False).alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "weight")
    both = ahead.unionByName(back)
    total = both.groupBy("kind", "at").agg(F.sum("weight").alias("total"))
    steps = cut(both.join(total, ["kind", "at"]).select("kind", "at", "to", (F.col("weight") / F.col("total") * damping).alias("part")), "host-steps")
    sizes = seeds.groupBy("trusted").agg(F.sum("weight").alias("n"))
    now = cut(seeds.join(F.broadcast(sizes), "trusted").select(F.col("trusted").alias("kind"), F.col("host").alias("at"), (F.col("weight") / F.col("n")).alias("mass")), "host-mass")  # sizes is two rows
    passed = [now]
    moving = 2.0 if steps.limit(1).count() else 0.0
    while moving >= tolerance:
        told = Observation()
        moved = now.join(steps, ["kind", "at"]).groupBy("kind", F.col("to").alias("at")).agg(F.sum(F.col("mass") * F.col("part")).alias("mass"))
        now = cut(moved.observe(told, F.sum("mass").alias("sum")), "host-mass")
        passed.append(now)
        moving = told.get["sum"] or 0.0
    total = reduce(DataFrame.unionByName, passed).groupBy("kind", "at").agg(F.sum("mass").alias("mass"))
    out = cut(total, "host-passed")
    forget(steps, *passed)
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass") * (1 - damping))), F.lit(0.0))
    return out.groupBy(F.col("at").alias("host")).agg(score(True).alias("trust"), score(False).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", html: str = "html", threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """pages without html, with host, path, rule, verdict, trust and distrust (both of hosts without a rule, to nine digits)."""
    pages = pages.drop("host", "path", "rule", "verdict", "trust", "distrust", "_rule", "_good", "_bad")
    plain = pages.drop(html).withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    fits = cut(with_rule(plain, rules), "url-rules")
    ruled = cut(plain.join(fits, ["host", "path"], "left"), "judged-urls")
    share = lambda verdict: F.count_if(F.col("_rule.verdict") == verdict) / F.count("*")
    shares = ruled.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")).where("good > 0 or bad > 0")
    kinds = F.array(F.struct(F.lit(True).alias("trusted"), F.col("good").alias("weight")), F.struct(F.lit(False).alias("trusted"), F.col("bad").alias("weight")))
    seeds = cut(shares.select("host", F.inline(kinds)).where("weight > 0"), "host-seeds")
    scores = propagate(host_edges(pages, url, html), seeds)
    whole = (1 - DAMPING) / (seeds.where("not trusted").agg(F.sum("weight")).first()[0] or 1.0)  # what a wholly blocked host starts with
    own = seeds.groupBy("host").agg(*[F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0)).alias(n) for n, c in (("_good", F.col("trusted")), ("_bad", ~F.col("trusted")))])
    asked = ruled.where("_rule is null").join(scores.join(own, "host", "left"), "host", "left")
    trust, distrust = (F.round(c, 9) for c in ("trust", "distrust"))
    own_bad = F.coalesce("_bad", F.lit(0.0))
    led = distrust - whole * own_bad  # what links brought
    bad = (own_bad >= 0.5) & (own_bad > F.coalesce("_good", F.lit(0.0))) | (led >= whole * floor) & (distrust >= threshold * (trust + distrust))
    unruled = asked.withColumns({"verdict": F.when(bad, "block").otherwise("allow"), "rule": F.lit(None).cast("string"), "trust": trust, "distrust": distrust}).drop("_good", "_bad")
    known = ruled.where("_rule is not null").withColumn("rule", F.col("_rule.rule")).withColumn("verdict", F.col("_rule.verdict"))
    return known.unionByName(unruled, allowMissingColumns=True).drop("_rule")
