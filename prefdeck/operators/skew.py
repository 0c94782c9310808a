"""Hot groups and running totals that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Below this many rows a group is never worth splitting.
HOT_FLOOR_ROWS = 100_000
# A hot group also holds more than 1/MAX_HOT_GROUPS of all rows, so there are always fewer than
# MAX_HOT_GROUPS of them and their keys (8 bytes each) are safe to broadcast at any data size. Up to
# 2.6 * 10**10 rows the floor alone decides; a group of a million rows is hot up to 2.6 * 10**11.
MAX_HOT_GROUPS = 2**18
# A hot group is cut into ranges of about this many rows, or into MAX_RANGES larger ones if it has more
# than 67 million (a power of two; the sketch knows ranks to a ten-thousandth).
RANGE_ROWS = 16_384
MAX_RANGES = 4096


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with all ``keys`` set, for a table that is about to meet itself in a join.

    A NULL key matches nothing there. Saying so before the plan forks keeps its branches identical
    (Spark would otherwise infer the filter for some of them), and identical shuffles run once.
    """
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return df.where(condition)


def _group_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    counted: Column | None = None,
    floor_rows: int = HOT_FLOOR_ROWS,
    max_groups: int = MAX_HOT_GROUPS,
) -> DataFrame:
    """Groups with more than ``max(floor_rows, all rows / max_groups)`` rows.

    One row ``(hot_key, n_rows)`` per group, fewer than ``max_groups`` in all. ``hot_key`` is a
    64-bit hash of the keys, so counting is a map-side folded aggregate over one number; should two
    groups share a hash they are merely both treated as hot. ``counted`` (rows where it is true)
    can name the columns the caller reads anyway: the shuffles below are then the same in both
    passes and Spark runs them once.
    """
    n_rows = F.count("*") if counted is None else F.count_if(counted)
    sizes = df.groupBy(_group_hash(keys).alias("hot_key")).agg(n_rows.alias("n_rows"))
    fair_share = sizes.agg(F.sum("n_rows") / F.lit(max_groups)).scalar()
    return sizes.where((F.col("n_rows") > floor_rows) & (F.col("n_rows") > fair_share))


def without_groups(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` outside the groups of :func:`hot_groups`."""
    small = F.broadcast(hot.select("hot_key"))
    return df.join(small, _group_hash(keys) == F.col("hot_key"), "left_anti")


def with_groups(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` inside the groups of :func:`hot_groups`."""
    small = F.broadcast(hot.select("hot_key"))
    return df.join(small, _group_hash(keys) == F.col("hot_key"), "left_semi")


def in_ranges(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    counted: Column,
    facts: Sequence[Column] = (),
    range_rows: int = RANGE_ROWS,
    max_ranges: int = MAX_RANGES,
) -> DataFrame:
    """Rows of *hot* groups with the number ``name`` of their range of ``value``, and the aggregates ``facts``.

    A group gets as many ranges as its counted rows need: about one for every ``range_rows``, cut at
    quantiles of its own sketch, which is folded before the shuffle. Equal values share a range and larger
    ones never have a smaller range, wherever the quantiles fall. Cuts and facts come back by a join without
    a hint: AQE broadcasts them if their measured size allows and otherwise splits the hot keys. Groups are
    told apart by the hash of :func:`hot_groups`; two with one hash share cuts and facts.
    """
    hashed = df.withColumn("_key", _group_hash(keys))
    # One parsed expression: building thousands of literals one by one costs seconds.
    grid = F.expr("array(" + ", ".join(f"{i / max_ranges}D" for i in range(1, max_ranges)) + ")")
    every = F.greatest(F.lit(1), F.floor(F.lit(max_ranges * range_rows) / F.greatest(F.col("_n"), F.lit(1))))
    cuts = (
        hashed.groupBy("_key")
        .agg(F.count_if(counted).alias("_n"), F.percentile_approx(value, grid).alias("_cuts"), *facts)
        .withColumn("_cuts", F.filter("_cuts", lambda _, i: (i + 1) % every == 0))
        .drop("_n")
    )
    # How many cuts lie below the value, by halving; 0 for NULL.
    steps = F.array(*[F.lit(max_ranges >> i) for i in range(1, max_ranges.bit_length())])
    number = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(F.col("_cuts"), at + step - 1) < F.col(value), at + step).otherwise(at),
    )
    return hashed.join(cuts, "_key").withColumn(name, number).drop("_key", "_cuts")


def running_total(
    df: DataFrame,
    value: Column,
    name: str,
    order: Sequence[Column | str],
    chunk: Sequence[str],
    keys: Sequence[str] = (),
    how: str = "sum",
) -> DataFrame:
    """Running ``how`` (sum, max or min) of ``value`` over all *earlier* rows of the group.

    ``chunk`` names columns that cut each group into bounded pieces which follow ``order`` (every
    row of a smaller chunk comes before every row of a larger one). The window only ever sees one
    chunk; the pieces are put together from one total per chunk. Without ``keys`` the totals of all
    chunks pass one window, so choose chunks whose number is bounded (file splits, hash prefixes).
    Keys and chunk columns must not be NULL.
    """
    combine = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    keys, chunk = list(keys), list(chunk)
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)

    local = keyed(df, keys + chunk).withColumn("_value", value).withColumn(
        "_local", combine("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    carried = (
        local.groupBy(*keys, *chunk)
        .agg(combine("_value").alias("_total"))
        .withColumn("_carry", combine("_total").over(earlier))
        .drop("_total")
    )
    joined = local.join(carried, [*keys, *chunk])
    if how == "sum":
        result = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        pick = F.greatest if how == "max" else F.least
        result = pick("_local", "_carry")  # both skip NULL
    return joined.withColumn(name, result).drop("_value", "_local", "_carry")


def dense_index(
    df: DataFrame,
    name: str,
    order: Sequence[Column | str],
    chunk: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Gap-free position (from 0) of each row in its group; see :func:`running_total`."""
    return running_total(df, F.lit(1).cast("bigint"), name, order, chunk, keys)
