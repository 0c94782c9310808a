"""Batches of samples that keep the two ends of a pair together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefdeck.functions.arrays import LABEL_TYPE
from prefdeck.operators.metrics import neg_log_sigmoid
from prefdeck.operators.pairs import PAIR_KEY, distinct_pairs
from prefdeck.operators.skew import dense_index, keyed, running_total
from prefdeck.session import materialize

# Epoch order is by md5, so its first four hex digits cut the prompts into 65,536 even chunks.
_PREFIX = 4
# Output ids per numbering chunk of one prompt.
_CHUNK_BITS = 16


def shuffle_key(seed: int, epoch: int) -> Column:
    return F.md5(F.concat_ws(":", "origin", "input_id", F.lit(seed + epoch)))


def epoch_order(prompts: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Prompts with their place in the shuffled order of this epoch."""
    hashed = prompts.withColumn("_shuffle", shuffle_key(seed, epoch)).withColumn(
        "_prefix", F.substring("_shuffle", 1, _PREFIX)
    )
    placed = dense_index(hashed, "epoch_pos", order=["_shuffle", *PAIR_KEY], chunk=["_prefix"])
    return placed.drop("_shuffle", "_prefix")


def unkeyed_samples(samples: DataFrame) -> DataFrame:
    """Samples without origin, input or output id: they have no place in an epoch."""
    return samples.where("origin IS NULL OR input_id IS NULL OR output_id IS NULL")


def require_keyed(samples: DataFrame) -> DataFrame:
    """The same samples; running them fails on the first that :func:`unkeyed_samples` would report."""
    missing = F.col("origin").isNull() | F.col("input_id").isNull() | F.col("output_id").isNull()
    failure = F.raise_error(F.lit("a sample lacks its origin, input_id or output_id"))
    kind = samples.schema["output_id"].dataType
    return samples.withColumn("output_id", F.when(missing, failure.cast(kind)).otherwise(F.col("output_id")))


def epoch_positions(samples: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Samples with their dense place in the epoch: prompts shuffled, outputs of a prompt in a row.

    The unit is a prompt, or a run of 2**16 output ids of a larger one. Samples are numbered inside
    their unit, and a unit starts where the sizes of the units before it add up to. So neither a
    huge prompt nor the whole table is ever in one window.
    """
    unit = [*PAIR_KEY, "_chunk"]
    numbered = (
        keyed(samples.select(*PAIR_KEY, "output_id"), [*PAIR_KEY, "output_id"])
        .withColumn("_chunk", F.coalesce(F.shiftright("output_id", _CHUNK_BITS), F.lit(0)))
        .withColumn("_inside", F.row_number().over(Window.partitionBy(*unit).orderBy("output_id")))
    )
    sizes = numbered.groupBy(*unit).agg(F.max("_inside").alias("_size"))
    hashed = sizes.withColumn("_shuffle", shuffle_key(seed, epoch)).withColumn(
        "_prefix", F.substring("_shuffle", 1, _PREFIX)
    )
    starts = running_total(
        hashed, F.col("_size"), "_start", order=["_shuffle", *unit], chunk=["_prefix"]
    ).select(*unit, "_start")
    return numbered.join(starts, unit).select(
        *PAIR_KEY, "output_id", (F.col("_start") + F.col("_inside") - 1).alias("epoch_pos")
    )


def pack_batches(samples: DataFrame, batch_size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Consecutive batches along the epoch order, from running sizes alone.

    Every sample once, every batch full but the last, and only pairs of prompts that lie across a
    batch border are parted. Samples without a key are left out, see :func:`unkeyed_samples` and
    :func:`require_keyed`.
    """
    return epoch_positions(samples, seed, epoch).select(
        *PAIR_KEY,
        "output_id",
        F.floor(F.col("epoch_pos") / F.lit(batch_size)).alias("batch_id"),
        (F.col("epoch_pos") % F.lit(batch_size)).cast("int").alias("slot"),
    )


def _walk(linked: list[int], members: int) -> Iterator[list[int]]:
    """Connected groups among ``members`` (a bit set), each breadth first from its lowest member.

    ``linked`` has the neighbours of each sample as a bit set. Taking out of the unseen ones all
    neighbours at once deletes the used ends of every pair in passing, so no pair is looked at twice.
    """
    unseen = members
    while unseen:
        first = (unseen & -unseen).bit_length() - 1
        order = [first]
        unseen ^= 1 << first
        for sample in order:
            found = linked[sample] & unseen
            unseen ^= found
            while found:
                lowest = found & -found
                order.append(lowest.bit_length() - 1)
                found ^= lowest
        yield order


def _groups(n: int, batch_size: int, ends: np.ndarray, others: np.ndarray) -> list[list[int]]:
    """Samples 0 to n - 1 in groups of at most ``batch_size``, connected by the pairs (ends, others).

    A larger component is cut along its breadth-first order, and each run falls into what is still
    connected in it.
    """
    near = np.zeros((n, n), bool)
    near[ends, others] = near[others, ends] = True
    packed = np.packbits(near, axis=1, bitorder="little")
    linked = [int.from_bytes(row.tobytes(), "little") for row in packed]
    out: list[list[int]] = []
    for order in _walk(linked, (1 << n) - 1):
        if len(order) <= batch_size:
            out.append(order)
            continue
        for start in range(0, len(order), batch_size):
            run = 0
            for sample in order[start : start + batch_size]:
                run |= 1 << sample
            out.extend(_walk(linked, run))
    return out


def fill_batches(
    n: int, batch_size: int, ends: np.ndarray, others: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Batch and slot of each of the samples 0 to n - 1, which the pairs (ends, others) connect.

    Connected groups go whole, in order, into the batch whose free slots they fill best; samples
    without a partner fill up what remains; a group that fits nowhere is parted over the largest
    rests. No more batches are opened than needed, so all are full but the last. The work is linear
    in the samples and pairs.
    """
    n_batches = -(-n // batch_size)
    batches: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(batch_size + 1)]
    sizes = 0  # bit f: some batch has f free slots

    def put(batch: int, samples: list[int]) -> None:
        nonlocal sizes
        batches[batch] += samples
        free = batch_size - len(batches[batch])
        if free:
            by_free[free].append(batch)
            sizes |= 1 << free

    def take(free: int) -> int:
        nonlocal sizes
        batch = by_free[free].pop()
        if not by_free[free]:
            sizes ^= 1 << free
        return batch

    parted = []
    groups = _groups(n, batch_size, ends, others)
    for group in sorted(groups, key=lambda g: len(g) == 1):
        enough = sizes >> len(group) << len(group)
        if enough:
            put(take((enough & -enough).bit_length() - 1), group)
        elif len(batches) < n_batches:
            batches.append([])
            put(len(batches) - 1, group)
        else:
            parted.append(group)
    for group in parted:
        while group:
            free = sizes.bit_length() - 1
            put(take(free), group[:free])
            group = group[free:]
    if sizes:  # the emptiest batch becomes the last one and fills up the others
        last = take(sizes.bit_length() - 1)
        while sizes:
            put(take(sizes.bit_length() - 1), [batches[last].pop()])
        batches[last], batches[-1] = batches[-1], batches[last]
    batch, slot = np.empty(n, np.int64), np.empty(n, np.int32)
    for number, samples in enumerate(batches):
        batch[samples] = number
        slot[samples] = np.arange(len(samples))
    return batch, slot


PACKED_SCHEMA = "input_id bigint, origin string, output_id int, batch_id bigint, slot int"
# Neighbours of a shard's samples are a bit matrix: 32 MB at this size.
MOST_SHARD_ROWS = 16_384


def pack_batches_greedy(
    samples: DataFrame,
    labels: DataFrame,
    batch_size: int,
    seed: int = 0,
    epoch: int = 0,
    shard_rows: int = 4096,
) -> DataFrame:
    """Pair-aware packing inside shards of ``shard_rows`` samples along the epoch order.

    A shard is a run of positions, a multiple of the batch size, so every shard but the last holds
    exactly that many samples (a huge prompt simply covers several) and only the very last batch
    can be short. Labels across a shard border cannot be kept together. A task gets positions and
    pairs of positions only, see :func:`fill_batches`.
    """
    size = max(batch_size, shard_rows // batch_size * batch_size)
    if size > MOST_SHARD_ROWS:
        raise ValueError(f"a shard has at most {MOST_SHARD_ROWS} rows, not {size}")
    placed = epoch_positions(samples, seed, epoch).withColumn(
        "shard", F.floor(F.col("epoch_pos") / F.lit(size))
    )
    place = (F.col("epoch_pos") % F.lit(size)).cast("int")
    where = keyed(placed, [*PAIR_KEY, "output_id", "shard"]).select(
        *PAIR_KEY, "output_id", "shard", place.alias("place")
    )
    inside = (
        distinct_pairs(labels)
        .where(F.col("chosen_id") != F.col("rejected_id"))
        .join(
            where.withColumnsRenamed({"output_id": "chosen_id", "place": "end"}),
            [*PAIR_KEY, "chosen_id"],
        )
        .join(
            where.withColumnsRenamed({"output_id": "rejected_id", "place": "other"}),
            [*PAIR_KEY, "rejected_id", "shard"],
        )
        .select(F.col("shard").alias("pair_shard"), "end", "other")
    )

    def pack(rows, pairs):
        places = rows.column("place").to_numpy()
        ends, others = (pairs.column(c).to_numpy() for c in ("end", "other"))
        batch, slot = fill_batches(len(places), batch_size, ends, others)
        first = rows.column("shard")[0].as_py() * (size // batch_size) if len(places) else 0
        columns = [rows.column(c) for c in (*PAIR_KEY, "output_id")]
        found = [pa.array(first + batch[places], pa.int64()), pa.array(slot[places], pa.int32())]
        return pa.table([*columns, *found], names=[*PAIR_KEY, "output_id", "batch_id", "slot"])

    return (
        placed.select(*PAIR_KEY, "output_id", "shard", place.alias("place"))
        .groupBy("shard")
        .cogroup(inside.groupBy("pair_shard"))
        .applyInArrow(pack, schema=PACKED_SCHEMA)
    )


def packing_audit(batches: DataFrame, labels: DataFrame, samples: DataFrame, batch_size: int) -> DataFrame:
    """One row about a packing: ``n_samples, n_missing, n_repeated, n_batches, n_oversize, n_short,
    n_uneven_slots, n_kept_pairs``. The packing is read five times and so stored first, see
    :func:`~prefdeck.session.materialize`."""
    batches = materialize(batches)
    key = [*PAIR_KEY, "output_id"]
    known = require_keyed(samples).select(*key)
    sizes = batches.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")
    )
    per_sample = batches.groupBy(*key).agg(F.count("*").alias("n"))
    short = F.count_if(F.col("n") < batch_size)
    uneven = F.count_if((F.col("slots") != F.col("n")) | (F.col("last") + 1 != F.col("n")))
    return sizes.agg(
        F.sum("n").alias("n_samples"),
        F.count("*").alias("n_batches"),
        F.count_if(F.col("n") > batch_size).alias("n_oversize"),
        short.alias("n_short"),
        uneven.alias("n_uneven_slots"),
    ).withColumns(
        {
            "n_missing": known.join(per_sample, key, "left_anti").agg(F.count("*")).scalar(),
            "n_repeated": per_sample.agg(F.count_if(F.col("n") > 1)).scalar(),
            "n_kept_pairs": in_batch_pairs(batches, labels).agg(F.count("*")).scalar(),
        }
    )


def in_batch_pairs(batches: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct labels whose two ends lie in the same batch."""
    place = keyed(
        batches.select(*PAIR_KEY, "output_id", "batch_id"), [*PAIR_KEY, "output_id", "batch_id"]
    )
    return (
        distinct_pairs(labels)
        .join(place.withColumnRenamed("output_id", "chosen_id"), [*PAIR_KEY, "chosen_id"])
        .join(
            place.withColumnRenamed("output_id", "rejected_id"),
            [*PAIR_KEY, "rejected_id", "batch_id"],
        )
        .select("batch_id", *PAIR_KEY, "chosen_id", "rejected_id")
    )


def pair_coverage(batches: DataFrame, labels: DataFrame) -> DataFrame:
    """Kept pairs, all distinct pairs, and their share."""
    kept = in_batch_pairs(batches, labels).agg(F.count("*").alias("n_kept"))
    n_all = distinct_pairs(labels).agg(F.count("*")).scalar()
    return kept.withColumn("n_all", n_all).withColumn(
        "coverage", F.when(F.col("n_all") > 0, F.col("n_kept") / F.col("n_all"))
    )


def batch_rows(batches: DataFrame, labels: DataFrame) -> DataFrame:
    """Batch rows with the in-batch labels of their prompt as an array (empty if none).

    Only pairs inside the batch take part in the loss, so the array is bounded by the batch size
    rather than by the number of labels of the prompt.
    """
    key = ["batch_id", *PAIR_KEY]
    arrays = (
        in_batch_pairs(batches, labels)
        .groupBy(*key)
        .agg(
            F.sort_array(F.collect_list(F.struct("chosen_id", "rejected_id")))
            .cast(LABEL_TYPE)
            .alias("labels")
        )
    )
    return batches.join(arrays, key, "left").withColumn(
        "labels", F.coalesce("labels", F.array().cast(LABEL_TYPE))
    )


def group_samples(batches: DataFrame, labels: DataFrame) -> DataFrame:
    """Per (batch, prompt): its ``outputs`` as ascending ids and its in-batch ``labels`` (empty if none).

    Both lists are bounded by the batch size, whatever the size of the prompt; a prompt that fills
    several batches has a row in each.
    """
    rows = batch_rows(batches, labels)
    # The labels are the same in every row of a group.
    return rows.groupBy("batch_id", *PAIR_KEY).agg(
        F.sort_array(F.collect_list("output_id")).alias("outputs"), F.first("labels").alias("labels")
    )


def batch_loss(
    batches: DataFrame, labels: DataFrame, scores: DataFrame, reg_coef: float = -1.0
) -> DataFrame:
    """Per batch: mean Bradley-Terry loss of its pairs plus the reward penalty over its rows.

    A batch without a pair has a NULL loss.
    """
    rows = batches.join(scores.select(*PAIR_KEY, "output_id", "reward"), [*PAIR_KEY, "output_id"])
    ends = keyed(rows, [*PAIR_KEY, "output_id", "batch_id"]).select(
        "batch_id", *PAIR_KEY, "output_id", "reward"
    )
    pairs = (
        distinct_pairs(labels)
        .join(
            ends.withColumnsRenamed({"output_id": "chosen_id", "reward": "chosen_reward"}),
            [*PAIR_KEY, "chosen_id"],
        )
        .join(
            ends.withColumnsRenamed({"output_id": "rejected_id", "reward": "rejected_reward"}),
            [*PAIR_KEY, "rejected_id", "batch_id"],
        )
    )
    difference = F.col("chosen_reward") - F.col("rejected_reward")
    pair_part = pairs.groupBy("batch_id").agg(
        F.avg(neg_log_sigmoid(difference)).alias("bt_loss"), F.count("*").alias("n_pairs")
    )
    square = F.avg(F.col("reward") * F.col("reward"))
    row_part = ends.groupBy("batch_id").agg(
        (square * F.lit(float(reg_coef)) if reg_coef > 0 else F.lit(0.0)).alias("l2_penalty"),
        F.count("*").alias("n_rows"),
    )
    return row_part.join(pair_part, "batch_id", "left").select(
        "batch_id",
        "n_rows",
        F.coalesce("n_pairs", F.lit(0).cast("bigint")).alias("n_pairs"),
        "bt_loss",
        "l2_penalty",
        (F.col("bt_loss") + F.col("l2_penalty")).alias("loss"),
    )
