"""Splitting hot groups must never change a result."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from prefdeck.operators import metrics, pairs, skew

SCORES = "origin string, category string, input_id bigint, output_id int, rank int, reward double"


def brute_counts(rows):
    prompts = {}
    for origin, category, input_id, _, rank, reward in rows:
        prompts.setdefault((origin, category, input_id), []).append((rank, reward))
    result = {}
    for key, items in prompts.items():
        n = c = d = 0
        usable = [i for i in items if i[0] is not None and i[1] is not None]
        for (ra, a), (rb, b) in itertools.combinations(usable, 2):
            if ra == rb:
                continue
            better, worse = (a, b) if ra < rb else (b, a)
            n, c, d = n + 1, c + (better > worse), d + (better < worse)
        result[key] = (len(items), n, c, d)
    return result


def skewed_rows(seed, n=240, ranks=7, values=9):
    """A third of the rows share one prompt, and many rewards are equal."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        prompt = 0 if i % 3 == 0 else rng.randrange(1, 30)
        rank = None if rng.random() < 0.05 else rng.randint(-2, ranks)
        reward = None if rng.random() < 0.05 else float(rng.randrange(values))
        rows.append((f"o{prompt % 2}", f"c{prompt % 3}", prompt, i, rank, reward))
    return rows


def counts(df):
    return {
        (r.origin, r.category, r.input_id): (
            r.n_responses, int(r.n_pairs), int(r.n_concordant), int(r.n_discordant)
        )
        for r in df.collect()
    }


@pytest.mark.parametrize("floor_rows", [100_000, 40, 0])
@pytest.mark.parametrize("ranks, values", [(1, 9), (7, 9), (500, 1000), (3, 1)])
def test_rank_counts_agree_with_pairs_hot_or_not(spark, floor_rows, ranks, values):
    rows = skewed_rows(ranks + values, ranks=ranks, values=values)
    df = spark.createDataFrame(rows, SCORES)
    assert counts(metrics.rank_counts(df, floor_rows=floor_rows)) == brute_counts(rows)


def test_rank_counts_use_ranges_of_a_large_hot_prompt(spark):
    rng = random.Random(5)
    rows = [("o", "c", 1, i, rng.randrange(40), rng.gauss(0, 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, SCORES)
    assert counts(metrics.rank_counts(df, floor_rows=10)) == brute_counts(rows)
    assert counts(metrics.rank_counts(df, floor_rows=10, range_rows=20)) == brute_counts(rows)


def test_rank_counts_with_hot_prompts_of_all_sizes_and_equal_rewards(spark):
    rng = random.Random(6)
    sizes = {1: 700, 2: 120, 3: 11, 4: 2}
    rows = [
        ("o", None if q % 2 else "c", q, i, rng.randrange(9), float(min(rng.randrange(60), 20)))
        for q, n in sizes.items()
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, SCORES)
    assert counts(metrics.rank_counts(df, floor_rows=5, range_rows=4)) == brute_counts(rows)


def ranges_of(df, **options):
    counted = F.col("v").isNotNull()
    return skew.in_ranges(df, ["k"], "v", "at", counted, **options)


def test_a_group_is_cut_into_as_many_ranges_as_its_rows_need(spark):
    """A million rows of one group make 61 ranges by the production figures, a tenth of it 6."""
    df = spark.range(1_100_000).select(
        (F.col("id") < 100_000).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v")
    )
    sizes = ranges_of(df).groupBy("k", "at").count().groupBy("k").agg(
        F.count("*").alias("n"), F.max("count").alias("most"), F.sum("count").alias("rows")
    )
    found = {r.k: r for r in sizes.collect()}
    assert 50 <= found[False].n <= 64 and 5 <= found[True].n <= 8
    assert found[False].rows == 1_000_000 and found[True].rows == 100_000
    assert max(r.most for r in found.values()) < 2 * skew.RANGE_ROWS


def test_ranges_keep_the_order_of_values_and_equal_ones_together(spark):
    df = spark.range(20_000).select(
        F.lit(1).alias("k"), F.when(F.col("id") % 10 > 6, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("v")
    ).unionByName(spark.sql("SELECT 1 k, CAST(NULL AS DOUBLE) v UNION ALL SELECT 1, double('NaN')"))
    for options, n_ranges in (({"range_rows": 50}, 200), ({"range_rows": 50, "max_ranges": 8}, 5), ({}, 2)):
        rows = ranges_of(df, **options).where("v IS NOT NULL").groupBy("at").agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")
        ).orderBy("at").collect()
        assert len(rows) >= n_ranges and sum(r.n for r in rows) == 20_001
        for a, b in zip(rows, rows[1:], strict=False):
            assert a.high < b.low or math.isnan(b.low)


def test_nan_reward_is_comparable_but_on_neither_side(spark):
    rows = [("o", "c", 1, 0, 1, math.nan), ("o", "c", 1, 1, 2, 1.0), ("o", "c", 1, 2, 3, 0.0)]
    df = spark.createDataFrame(rows, SCORES)
    for floor_rows in (100, 0):
        assert counts(metrics.rank_counts(df, floor_rows=floor_rows)) == {("o", "c", 1): (3, 3, 1, 0)}


@pytest.mark.parametrize("block_rows", [100_000, 17, 5])
def test_ordered_pairs_in_blocks_of_any_size(spark, block_rows):
    rng = random.Random(3)
    sizes = {1: 60, 2: 7, 3: 1, 4: 18}
    rows = [
        ("o", "c", prompt, i, rng.randint(1, 3), rng.random())
        for prompt, n in sizes.items()
        for i in range(n)
    ]
    expected = sorted(
        (a[2], *((a[3], b[3]) if a[4] < b[4] else (b[3], a[3])))
        for a, b in itertools.combinations(rows, 2)
        if a[2] == b[2] and a[4] != b[4]
    )
    found = pairs.rank_pairs(spark.createDataFrame(rows, SCORES), block_rows=block_rows)
    got = sorted((r.input_id, r.chosen_id, r.rejected_id) for r in found.collect())
    assert got == expected


def test_tasks_of_a_pair_join_follow_the_pairs(spark):
    rows = spark.createDataFrame([("o", "c", i % 4, i, i, 0.0) for i in range(400)], SCORES)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_pairs = 4 * 100 * 99 // 2
    assert pairs.pair_tasks(rows, pairs.PAIR_KEY) == least
    assert pairs.pair_tasks(rows, pairs.PAIR_KEY, pairs_per_task=100) == n_pairs // 100
    assert pairs.pair_tasks(rows.limit(0), pairs.PAIR_KEY) == least
    found = pairs.rank_pairs(rows, block_rows=10, n_tasks=150)
    assert found.rdd.getNumPartitions() == 150 and found.count() == n_pairs


def test_hot_groups_need_more_than_their_fair_share(spark):
    df = spark.range(10_000).withColumn("k", F.when(F.col("id") < 3000, -1).otherwise(F.col("id")))
    assert [r.n_rows for r in skew.hot_groups(df, ["k"], floor_rows=0, max_groups=4096).collect()] == [3000]
    assert skew.hot_groups(df, ["k"], floor_rows=3000).count() == 0
    even = spark.range(5000)
    assert skew.hot_groups(even, ["id"], floor_rows=0, max_groups=4096).count() == 0


def test_a_group_of_a_million_rows_is_hot_in_a_table_of_many_small_ones(spark):
    """One row stands for a thousand: 260 million groups of 1,000 rows and one of 1,000,000."""
    groups = spark.range(260_000).withColumn("k", F.when(F.col("id") < 1000, -1).otherwise(F.col("id")))
    assert [r.n_rows for r in skew.hot_groups(groups, ["k"], floor_rows=100).collect()] == [1000]


@pytest.mark.parametrize("how", ["sum", "max", "min"])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_total_over_chunks(spark, how, keys):
    rng = random.Random(how)
    rows = [(i % 3, i // 10, i, rng.randint(-50, 50)) for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, chunk int, at int, v int")
    got = skew.running_total(df, F.col("v"), "before", ["at"], ["chunk"], keys, how)
    combine = {"sum": sum, "max": max, "min": min}[how]
    for r in got.collect():
        earlier = [v for k, _, at, v in rows if at < r.at and (not keys or k == r.k)]
        empty = 0 if how == "sum" else None
        assert r.before == (combine(earlier) if earlier else empty)


def test_dense_index_with_a_group_spanning_chunks(spark):
    df = spark.range(1000).withColumn("chunk", F.floor(F.col("id") / 64)).withColumn("k", F.lit(1))
    rows = skew.dense_index(df, "pos", ["id"], ["chunk"], ["k"]).collect()
    assert all(r.pos == r.id for r in rows) and len(rows) == 1000


def test_tasks_are_dealt_by_bytes_whatever_the_number_of_shuffle_partitions(spark):
    noise = F.concat(*[F.md5(F.concat_ws(":", "id", F.lit(i))) for i in range(32)])
    rows = spark.range(100_000).withColumn("noise", noise)  # 100 MB
    grouped = rows.groupBy("noise").agg(F.count("*").alias("n"))
    tasks = grouped.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 100_000
    assert len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(t["count"] for t in tasks) < 100_000 / 8
