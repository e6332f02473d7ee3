"""URL filter by link-graph propagation: personalised PageRank of trust, and of distrust on the reversed graph.

Rules (host, path, verdict) judge the urls that they fit. Hosts with allowed urls seed trust, hosts with
blocked ones seed distrust, each in proportion to such urls. Trust flows along the links between hosts,
distrust against them, so hosts that link to blocked ones come to share their distrust. A url that no rule
fits gets its host's verdict: block if the host's distrust exceeds RATIO times its trust, else allow; a
host that neither reaches is allowed.

Defined cases: a null url, or one without `://`, has an empty host and path and is allowed; null and empty
html has no links; links of a host to itself and relative links are no edges; repeated pages count as often
as they occur; if longest rules tie, the first given wins; an empty table gives an empty result; other
columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING, RATIO = 0.85, 1.0
#: Rounds end when no new host is reached and all that is still to flow is at most this share of the least host's score.
TOLERANCE = 1e-3
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>\\]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, as a string, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-i for i, x in enumerate(rules) if x == r])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, summed before the exchange."""
    host, _ = host_and_path(url)
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> '' AND src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """edges(src, dst, links), seeds(host, mass) to (host, score), scores summing to 1.

    What reaches a host without edges is not passed on; scaling at the end equals sending it back to the seeds.
    Every host that a seed reaches has a row, and every unscaled score is within TOLERANCE of its full value: the flow still to
    come, which is at most the last round's times damping / (1 - damping), could all go to the host of least score."""
    out = store.cut(edges.groupBy("src").agg(F.sum("links").alias("all")))  # so that a host with very many links does not stay in the sums' task
    edges = store.cut(edges.join(out, "src").select("src", "dst", (damping * F.col("links") / F.col("all")).alias("share")))
    total = seeds.agg(F.coalesce(F.sum("mass"), F.lit(0)).cast("double")).first()[0]
    start = store.cut(seeds.where("mass > 0").select("host", ((1 - damping) * F.col("mass") / total).alias("score")))
    parts, reached = start.withColumn("flow", F.col("score")), start.count()
    while reached and not edges.isEmpty():  # the score is the sum of the flows along paths of each length
        flow = parts.join(edges, parts["host"] == edges["src"]).where("flow IS NOT NULL").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("flow") * F.col("share")).alias("flow"))
        flow = flow.select("host", F.col("flow").alias("score"), "flow")
        parts = store.cut(parts.select("host", "score", F.lit(None).cast("double").alias("flow")).unionByName(flow).groupBy("host").agg(F.sum("score").alias("score"), F.sum("flow").alias("flow")))
        hosts, left, least = parts.agg(F.count("*"), F.coalesce(F.sum("flow"), F.lit(0.0)) * damping / (1 - damping), F.min("score")).first()
        if hosts == reached and left <= TOLERANCE * least:
            break
        reached = hosts
    whole = parts.agg(F.sum("score")).first()[0] or 1.0
    return parts.select("host", (F.col("score") / whole).alias("score"))


def judged(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(url)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules)
    urls = urls.withColumns({"rule": rule, "verdict": verdict})
    hosts = store.cut(urls.where("host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("trusted"), F.count_if(F.col("verdict") == "block").alias("blocked")))
    edges = store.cut(host_edges(pages, url, html))
    trust = propagated(edges, hosts.select("host", F.col("trusted").alias("mass")))
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = propagated(against, hosts.select("host", F.col("blocked").alias("mass")))
    scores = distrust.withColumnRenamed("score", "distrust").join(trust.withColumnRenamed("score", "trust"), "host", "left")
    bad = store.cut(scores.where(F.col("trust").isNull() | (F.col("distrust") > RATIO * F.col("trust"))).select(F.col("host").alias("_host")))
    out = urls.join(bad, urls["host"] == bad["_host"], "left")
    method = F.when(F.col("_host").isNull(), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))
