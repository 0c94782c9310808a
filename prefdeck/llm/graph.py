"""Connected components and PageRank over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefdeck.llm.common import stored

SETTLED = 1e-6  # summed change of rank in a round, of a sum of 1, that ends PageRank


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    ).first()
    return row["n"], row["sum"]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (u, v)``: the smallest node it can reach.

    Alternates two steps until nothing changes: every node links its larger neighbours to its
    smallest neighbour, then its smaller ones. Both are an aggregate with map-side minimum and a
    join whose sides are fresh shuffles, so AQE splits a hub. Each round is written to the shared
    folder; only a count and a checksum reach the driver. The number of rounds grows with the
    logarithm of the largest component. No edges give no rows.
    """
    links = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v_min")).withColumn("low", F.least("u", "v_min"))
        large = (
            both.where("v > u").join(low.select("u", "low"), "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("low").alias("v")))
            .distinct()
        )
        links = stored(small)
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def settled_pagerank(edges: DataFrame, seeds: DataFrame, damping: float, name: str, settled: float = SETTLED) -> DataFrame:
    """Personalised PageRank ``node, <name>`` from weighted ``seeds (node, seed)`` over weighted ``edges (u,
    v, weight)``. Rank of nodes without out-links returns to the seeds. Nodes that seeds don't reach
    have no row; without seeds there are none.

    Ranks are the sum of what the seeds pass on over 0, 1, 2... links, scaled to 1. A round adds one
    link, so links without cycles are done after the longest path. Otherwise rounds follow until the
    ranks change by less than ``settled`` in sum (of 1) and no node gains its first rank: each node
    that seeds reach has one, however far.
    """
    total = seeds.agg(F.sum("seed").alias("t")).scalar()
    out = edges.groupBy("u").agg(F.sum("weight").alias("out"))
    shares = stored(edges.join(out, "u").select("u", "v", (F.col("weight") / F.col("out")).alias("share")))
    share = F.col("seed") / total
    ranks = stored(seeds.where("seed > 0").select("node", share.alias("rank"), share.alias("last")))
    while True:
        row = ranks.agg(F.sum("rank").alias("all"), F.sum("last").alias("last"), F.count_if(F.col("last") == F.col("rank")).alias("new")).first()
        if not row["last"]:
            break
        if row["all"] > row["last"] and not row["new"]:
            before = (F.col("rank") - F.col("last")) / (row["all"] - row["last"])
            if ranks.agg(F.sum(F.abs(F.col("rank") / row["all"] - before))).first()[0] < settled:
                break
        moved = (
            ranks.where("last > 0").join(shares, F.col("node") == shares["u"])
            .select(F.col("v").alias("node"), (F.col("last") * F.col("share") * damping).alias("last"))
        )
        every = ranks.select("node", "rank", F.lit(0.0).alias("last")).unionByName(
            moved.select("node", F.col("last").alias("rank"), "last")
        )
        ranks = stored(every.groupBy("node").agg(F.sum("rank").alias("rank"), F.sum("last").alias("last")))
    return ranks.select("node", (F.col("rank") / F.lit(row["all"] or 1.0)).alias(name))
