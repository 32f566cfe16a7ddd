"""URL filters: rules for hosts and paths, and for the rest trust and distrust that links carry between hosts.

Trust is a personalised PageRank from trusted hosts along links; distrust one from blocked hosts against
them. A host is blocked where distrust is the greater part of both. Only the host graph takes part in the rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.plans.session import dropped, written

#: (verdict, host and path); a rule fits its host and all subdomains if the path begins with its own. Fixed values.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, ROUNDS, LIMIT = 0.85, 10, 0.5
#: Rounds go on until the masses of a way change by no more than this in sum over CUT rounds; ROUNDS is the least number of them.
TOLERANCE = 1e-9
#: Rounds between two written tables, and edges of a host in a part.
CUT, HUB = 5, 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(rules: Sequence[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits host and path, null if none does."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        at = rule.index("/") if "/" in rule else len(rule)
        name, start = rule[:at], rule[at:]
        fits.append(((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start))
        fits.append(F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
    return F.coalesce(*(F.when(f, s) for f, s in zip(fits[::2], fits[1::2], strict=True)))


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(way, host, mass): edges (way, a, b) carry mass from a to b; seeds (way, host, mass) sum to one for each way.

    Each round is a join and a sum over edges. Mass of hosts without edges leaves. What is left to move after
    CUT rounds is less than what they moved, as damping ** CUT is below a half: about 130 rounds do for any graph.
    A host's edges are dealt to parts of about HUB, and its mass to each of them, so a hub is no single task.
    """
    out = edges.groupBy("way", "a").agg(F.count("*").alias("d")).withColumn("parts", F.ceil(F.col("d") / HUB).cast("int"))
    out = written(out)
    edges = written(edges.join(out, ["way", "a"]).select("way", "a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), "b", "d"))
    seeds = written(seeds)
    start = seeds.withColumn("mass", F.col("mass") * (1 - damping))
    spread = out.select("way", F.col("a").alias("host"), "parts")
    now, before = start, None
    for i in count(1):
        dealt = now.join(spread, ["way", "host"]).select("way", F.col("host").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "mass")
        moved = edges.join(dealt, ["way", "a", "part"]).groupBy("way", F.col("b").alias("host")).agg((damping * F.sum(F.col("mass") / F.col("d"))).alias("mass"))
        now = start.unionByName(moved).groupBy("way", "host").agg(F.sum("mass").alias("mass"))
        if i % CUT == 0:
            now = written(now)
            moved = now.unionByName((before if before is not None else start).withColumn("mass", -F.col("mass"))).groupBy("way", "host").agg(F.sum("mass").alias("mass"))
            done = i >= rounds and not moved.groupBy("way").agg(F.sum(F.abs("mass")).alias("change")).where(F.col("change") > tolerance).count()
            if before is not None:
                dropped(before)
            if done:
                dropped(edges, out, seeds)
                return now
            before = now


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages (page_id, url, html).

    verdict is that of the longest fitting rule; without one it is `block` if the host's distrust is more than
    limit of its trust and distrust together, else `allow`. Hosts are trusted by the share of their pages that
    rules allow, and seeds of distrust by the share that rules block. Links are href values in html that
    name a host; those within a host, as relative ones all are, count for nothing. A null or empty html has none, one of
    any length is read whole. Pages without a host have no mass. Equal rows are judged alike; other columns of pages are
    left out, whatever their names.
    """
    known = pages.select("page_id", "url", "html").withColumn("host", host()).withColumn("path", path()).withColumn("found", _ruled(rules))
    links = known.where("host <> ''").select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("to"))
    links = links.select(F.col("host").alias("a"), F.translate("to", _UPPER, _LOWER).alias("b")).where("a <> b").distinct()
    links = written(links)
    edges = links.select(F.lit("trust").alias("way"), "a", "b").unionByName(links.select(F.lit("distrust").alias("way"), F.col("b").alias("a"), F.col("a").alias("b")))
    share = lambda verdict: F.avg(F.coalesce(F.col("found.verdict") == verdict, F.lit(False)).cast("double"))
    hosts = known.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("way"), F.col("trust").alias("mass")), F.struct(F.lit("distrust").alias("way"), F.col("distrust").alias("mass")))).alias("s")).select("s.way", "host", "s.mass").where("mass > 0")
    sums = seeds.groupBy("way").agg(F.sum("mass").alias("all"))
    mass = propagated(edges, seeds.join(F.broadcast(sums), "way").select("way", "host", (F.col("mass") / F.col("all")).alias("mass")))  # two rows
    mass = mass.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("way") == w, F.col("mass"))), F.lit(0.0)).alias(w) for w in ("trust", "distrust")))
    judged = known.select("page_id", "host", "path", "found").join(mass.withColumnRenamed("host", "own"), F.col("host") == F.col("own"), "left")
    by_links = F.when(F.col("distrust") > limit * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_links).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
