"""URL filter: rules first, then link-graph propagation between hosts.

A url follows the longest rule that fits its host (or a parent domain) and path. Where no rule
fits, its host is judged by two personalised PageRanks over host edges: trust flows from hosts
with allowed urls along links, distrust flows from hosts with blocked urls against links. A link is
any mention of another host of the table in a page's html (absolute urls, footers). Both
run in one table of steps, in whole numbers (shares of ``UNIT``), so every run gives the same
digits whatever the order of addition. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UNIT = 1 << 50
HOST_NAME = r"(?<![A-Za-z0-9-])(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, null if none fits.

    ``rules`` are ``(verdict, host, path)``. Length is that of host and path together; of equally long
    ones the longer host, then the first in the list wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i][1] + rules[i][2]), len(rules[i][1]), -i))
    for verdict, h, p in (rules[i] for i in order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 12, damping: float = 0.85) -> DataFrame:
    """``(kind, host, score)``: personalised PageRank of ``trust`` along and ``distrust`` against edges.

    ``edges`` are ``(src, dst, n)``, ``seeds`` ``(kind, host, n)``; ``n`` are weights. A kind's seeds share ``UNIT``
    by weight. Mass at hosts without a way on goes nowhere. Hosts never reached have no row.
    """
    num, den = int(damping * 1000), 1000
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = cut(seeds.groupBy("kind", "host").agg(F.sum("n").alias("n")).join(total, "kind")
                .select("kind", "host", F.expr(f"cast(cast(n as decimal(20,0)) * {UNIT} div all as bigint)").alias("seed")))
    ways = (edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "n")
            .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "n")))
    degree = ways.groupBy("kind", "at").agg(F.sum("n").alias("out"))
    ways = cut(ways.join(degree, ["kind", "at"]))
    scores = seeds.select("kind", "host", F.col("seed").alias("score"))
    if ways.isEmpty():
        return scores.withColumn("score", F.expr(f"score * {den - num} div {den}"))
    base = seeds.select("kind", "host", F.expr(f"seed * {den - num} div {den}").alias("score"))
    for _ in range(rounds):
        flow = (ways.join(scores, (ways["kind"] == scores["kind"]) & (ways["at"] == scores["host"]))
                .select(ways["kind"], F.col("to").alias("host"),
                        F.expr(f"cast(cast(score as decimal(20,0)) * n * {num} div (out * {den}) as bigint)").alias("score")))
        scores = cut(flow.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score")).where("score > 0"))
    return scores


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url",
          html_col: str | None = "html", rounds: int = 12, min_lift: float = 0.1) -> DataFrame:
    """One row per page: ``id, url, host, path, rule, verdict, trust, distrust``.

    Without a rule a page is blocked when its host's distrust exceeds its trust and reaches ``min_lift`` times
    the even share of all hosts, else allowed. Null urls, and urls without ``://``, have an empty host and path; they fit no
    rule and, having no links to their name, are allowed. A page without html has no links. Repeated
    pages count as often as they occur. An empty table gives an empty result; other columns are ignored.
    """
    html = F.col(html_col) if html_col else F.lit(None).cast("string")
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    p = p.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    p = p.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    # one row per pair of hosts of the table: partial sums run before each shuffle
    hosts = cut(p.where("host <> ''").groupBy("host").count().select("host"))
    links = (p.where("host <> ''")
             .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HOST_NAME), 0)).alias("dst"))
             .select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> dst")
             .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
             .join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi"))
    least = min_lift * UNIT / max(hosts.count(), 1)
    judged = p.drop("html")
    seeds = (judged.where("r IS NOT NULL AND host <> ''")
             .select(F.when(F.col("r.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
             .groupBy("kind", "host").agg(F.count(F.lit(1)).alias("n")))
    scores = (propagate(cut(links), seeds, rounds).groupBy("host")
              .agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"),
                   F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust")))
    # the many pages of one host meet its score in several parts
    parts = 8
    scores = scores.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = judged.withColumn("part", F.pmod(F.xxhash64("id", "url"), F.lit(parts)).cast("int")).join(scores, ["host", "part"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0).cast("bigint")), F.coalesce("distrust", F.lit(0).cast("bigint"))
    method = F.when((distrust >= least) & (distrust > trust), "block").otherwise("allow")
    return out.select("id", "url", "host", "path", F.col("r.rule").alias("rule"),
                      F.coalesce(F.col("r.verdict"), method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
