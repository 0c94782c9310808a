"""URL rules, and verdicts on other URLs by trust and distrust over the host graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefdeck.llm.common import stored
from prefdeck.llm.graph import settled_pagerank

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict on a host, its subdomains and all paths that start as ``path`` does."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first '://' and the next '/', '?', '#' or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (host and path together) that fits, as ``struct<rule, verdict>``, or NULL."""
    choice = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        choice = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(choice)
    return choice


def host_links(pages: DataFrame) -> DataFrame:
    """``u, v, weight``: links from the pages of host u to host v, from ``pages (host, html)``.

    A link with a host leads there; one without stays on its host.
    """
    href = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]*)"), F.lit(1)))
    target = F.col("href")
    away = F.when(target.startswith("//"), host_of(F.concat(F.lit("http:"), target))).when(
        target.rlike("(?i)^https?://"), host_of(target)
    )
    inner = target.rlike("(?i)^(?!//)(?![a-z][a-z0-9+.-]*:)")
    return (
        pages.where(F.col("host") != "")
        .select("host", href.alias("href"))
        .select(F.col("host").alias("u"), F.coalesce(away, F.when(inner, F.col("host"))).alias("v"))
        .where("v <> ''")
        .groupBy("u", "v")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    damping: float = 0.85,
    tolerance: float = 1.0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``id, host, path, rule, verdict, trust, distrust`` per row of ``pages``.

    Where no rule fits, the host decides: trust is PageRank from hosts with pages that an allow rule
    fits, along links; distrust is PageRank from hosts with blocked pages, against links (who links
    to bad hosts is doubtful). Each seed weighs as many pages as its rules fit. A host is blocked if
    its distrust exceeds ``tolerance`` times its trust; hosts that neither reaches are allowed.
    Distrust alone is thus enough to block a host without trust. Ranks are settled, see
    ``settled_pagerank``.

    A NULL url, or one without '://', has an empty host and path and is allowed unless a rule fits.
    NULL html has no links. Repeated rows (NULL ids too) each give a row; other columns are ignored;
    no rows give none. Links are summed to host pairs map-side before the shuffle; a host of a third
    of all pages is then one row per target.
    """
    url = F.col(url_col).cast("string")
    parsed = pages.select(
        F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html")
    )
    links = stored(host_links(parsed))
    ruled = parsed.select("id", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("r"))
    seeds = stored(
        ruled.where((F.col("host") != "") & F.col("r").isNotNull()).groupBy("host", F.col("r.verdict").alias("verdict")).agg(F.count("*").cast("double").alias("seed"))
    )

    def seeded(verdict: str) -> DataFrame:
        return seeds.where(F.col("verdict") == verdict).select(F.col("host").alias("node"), "seed")

    def ranks(edges: DataFrame, verdict: str, name: str) -> DataFrame:
        return settled_pagerank(edges, seeded(verdict), damping, name)

    trust = ranks(links, "allow", "trust")
    back = links.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")
    distrust = ranks(back, "block", "distrust")
    hosts = stored(trust.join(distrust, "node", "full"))
    zero = F.lit(0.0)
    own = F.when(F.coalesce("distrust", zero) > tolerance * F.coalesce("trust", zero), "block").otherwise("allow")
    return ruled.join(hosts, ruled["host"] == hosts["node"], "left").select(
        F.col("id").alias(id_col), "host", "path", "r.rule", F.coalesce("r.verdict", own).alias("verdict"), "trust", "distrust"
    )
