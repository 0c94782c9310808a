"""Packing: sizes, cover, determinism, pair coverage; length path; export."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefdeck.functions.arrays import expand_label_rows, pad_batch
from prefdeck.functions.text import tokens
from prefdeck.operators import batching, lengths
from prefdeck.operators.pairs import PAIR_KEY
from prefdeck.sources.sinks import export_training_batches, read_training_batches

SAMPLES = "origin string, input_id bigint, output_id int, n_tokens int, reward double"
LABELS = "origin string, input_id bigint, chosen_id int, rejected_id int"


def frames(spark, prompts):
    """``{input_id: (n outputs, labels)}`` as sample and label tables."""
    samples = [("o", i, k, 5 * k, float(k)) for i, (n, _) in prompts.items() for k in range(n)]
    labels = [("o", i, c, r) for i, (_, pairs) in prompts.items() for c, r in pairs]
    return spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(labels, LABELS)


def check(batches, n_samples, size):
    """Every sample once; no batch over the size; every batch full but the last; slots dense."""
    rows = batches.collect()
    assert len(rows) == len({(r.origin, r.input_id, r.output_id) for r in rows}) == n_samples
    sizes = Counter(r.batch_id for r in rows)
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(sizes[b] == size for b in sorted(sizes)[:-1]) and sizes[max(sizes)] <= size
    for batch in sizes:
        assert sorted(r.slot for r in rows if r.batch_id == batch) == list(range(sizes[batch]))
    return sorted((r.origin, r.input_id, r.output_id, r.batch_id, r.slot) for r in rows)


STAR = {1: (9, [(0, k) for k in range(1, 7)] + [(7, 8)]), 2: (4, [(0, 1), (2, 3)])}


def test_greedy_packing_ends_where_a_label_graph_is_disconnected(spark):
    samples, labels = frames(spark, STAR)
    for seed in range(3):
        check(batching.pack_batches_greedy(samples, labels, 4, seed=seed), 13, 4)


def kept_pairs(n, size, pairs):
    ends = np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
    batch, slot = batching.fill_batches(n, size, *ends)
    sizes = Counter(batch.tolist())
    assert sorted(sizes) == list(range(-(-n // size))) and all(sizes[b] == size for b in sorted(sizes)[:-1])
    assert len(set(zip(batch.tolist(), slot.tolist()))) == n and slot.max(initial=0) < size
    return int((batch[ends[0]] == batch[ends[1]]).sum())


def test_components_stay_whole():
    assert kept_pairs(6, 3, [(0, 5), (5, 3), (1, 2), (2, 4)]) == 4
    assert kept_pairs(7, 4, [(0, 6), (1, 5), (2, 4)]) == 3  # three twos and a single in 4 + 3
    assert kept_pairs(9, 4, [(0, k) for k in range(1, 9)]) == 3
    assert kept_pairs(10, 5, [(k, k + 1) for k in range(9)]) == 8  # a chain is cut once
    assert kept_pairs(5, 8, [(0, 0), (1, 2)]) == 2
    assert kept_pairs(3, 1, [(0, 1)]) == kept_pairs(0, 4, []) == 0


def test_a_full_graph_is_packed_in_linear_time():
    n, size = 4096, 64
    a, b = np.triu_indices(n, 1)
    started = time.perf_counter()
    batch, _ = batching.fill_batches(n, size, a, b)
    assert time.perf_counter() - started < 1.0
    assert (batch[a] == batch[b]).sum() == n // size * size * (size - 1) // 2  # the most there can be


@pytest.mark.parametrize("seed", range(40))
def test_random_graphs_are_packed_with_few_parted_pairs(seed):
    rng = random.Random(seed)
    n, size = rng.randint(1, 120), rng.randint(1, 20)
    pairs = list({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, n))})
    kept = kept_pairs(n, size, pairs)
    in_order = sum(a // size == b // size for a, b in pairs)
    assert kept >= in_order


def random_prompts(seed, n=40):
    rng = random.Random(seed)
    prompts = {}
    for i in range(n):
        size = rng.randint(1, 7)
        pairs = {(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randint(0, 6))}
        prompts[i] = (size, sorted(pairs))
    return prompts


@pytest.mark.parametrize("size, shard_rows", [(1, 8), (2, 8), (5, 20), (8, 4096), (64, 16)])
def test_both_packings_cover_every_sample_once(spark, size, shard_rows):
    prompts = random_prompts(size)
    samples, labels = frames(spark, prompts)
    n = sum(k for k, _ in prompts.values())
    greedy = batching.pack_batches_greedy(samples, labels, size, seed=3, shard_rows=shard_rows)
    assert check(greedy, n, size) == check(greedy, n, size)
    plain = batching.pack_batches(samples, size, seed=3)
    assert check(plain, n, size) == check(plain, n, size)


def test_greedy_keeps_more_pairs_than_plain_and_plain_more_than_chance(spark):
    prompts = random_prompts(11, n=120)
    samples, labels = frames(spark, prompts)
    labels = labels.where("chosen_id <> rejected_id")

    def kept(batches):
        return batching.pair_coverage(batches, labels).first()

    plain = kept(batching.pack_batches(samples, 6))
    greedy = kept(batching.pack_batches_greedy(samples, labels, 6))
    ids = samples.select(*PAIR_KEY, "output_id")
    chance = kept(
        ids.withColumn("batch_id", F.pmod(F.xxhash64("input_id", "output_id"), F.lit(80)))
    )
    assert greedy.n_all == plain.n_all == labels.distinct().count()
    assert greedy.coverage >= plain.coverage > chance.coverage


def test_a_prompt_larger_than_a_chunk_is_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(batching, "_CHUNK_BITS", 3)
    samples, _ = frames(spark, {1: (100, []), 2: (3, []), 3: (20, [])})
    rows = batching.epoch_positions(samples).collect()
    assert sorted(r.epoch_pos for r in rows) == list(range(123))
    big = sorted((r.output_id, r.epoch_pos) for r in rows if r.input_id == 1)
    assert [p - big[0][1] for _, p in big] == list(range(100))


def test_epochs_differ_and_an_epoch_repeats(spark):
    prompts = spark.range(50).select(F.lit("o").alias("origin"), F.col("id").alias("input_id"))

    def order(epoch):
        rows = batching.epoch_order(prompts, seed=1, epoch=epoch).orderBy("epoch_pos").collect()
        assert [r.epoch_pos for r in rows] == list(range(50))
        return [r.input_id for r in rows]

    assert order(0) == order(0) != order(1)


def test_length_path(spark):
    """Output 3 is too long; label (2, 3) goes, so does the self-label; output 2 is left alone."""
    samples, labels = frames(spark, {1: (4, [(0, 1), (2, 3), (1, 1)]), 2: (2, [])})
    kept, usable = lengths.apply_length_path(samples, labels, 10, PAIR_KEY)
    assert sorted((r.input_id, r.output_id) for r in kept.collect()) == [(1, 0), (1, 1)]
    assert [(r.chosen_id, r.rejected_id) for r in usable.collect()] == [(0, 1)]
    same, _ = lengths.apply_length_path(samples, labels, None, PAIR_KEY)
    assert same.count() == 6


def words_as_lengths():
    return lambda texts: [[len(word) for word in value.split()] for value in texts]


@pytest.mark.parametrize("tokenizer", [words_as_lengths, "column"])
def test_length_path_with_a_tokenizer(spark, tokenizer):
    """Output 1 has three tokens, output 2 none, output 3 no text."""
    if tokenizer == "column":
        tokenizer = F.transform(tokens("text"), F.length)
    rows = [("o", 1, 0, "a bb"), ("o", 1, 1, "a bb ccc"), ("o", 1, 2, ""), ("o", 1, 3, None)]
    samples = spark.createDataFrame(rows, "origin string, input_id bigint, output_id int, text string")
    _, labels = frames(spark, {1: (4, [(0, 1), (0, 2), (2, 3)])})

    def ids(df):
        return {r.output_id: (r.input_ids, r.n_tokens) for r in df.collect()}

    cut, same = lengths.apply_length_path(samples, labels, 2, PAIR_KEY, True, tokenizer)
    assert ids(cut) == {0: ([1, 2], 2), 1: ([2, 3], 2), 2: ([], 0), 3: (None, None)}
    assert cut.columns == ["origin", "input_id", "output_id", "input_ids", "n_tokens"] and same.count() == 3
    again, _ = lengths.apply_length_path(cut, labels, 1, PAIR_KEY, truncation=True)
    assert ids(again) == {0: ([2], 1), 1: ([3], 1), 2: ([], 0), 3: (None, None)}
    kept, usable = lengths.apply_length_path(samples, labels, 2, PAIR_KEY, False, tokenizer)
    assert ids(kept) == {0: ([1, 2], 2), 2: ([], 0)}
    assert [(r.chosen_id, r.rejected_id) for r in usable.collect()] == [(0, 2)]
    whole, _ = lengths.apply_length_path(samples, labels, None, PAIR_KEY, False, tokenizer)
    assert ids(whole)[1] == ([1, 2, 3], 3)
    assert ids(lengths.apply_length_path(samples.limit(0), labels, 2, PAIR_KEY, False, tokenizer)[0]) == {}
    with pytest.raises(ValueError):
        lengths.tokenize(samples, tokenizer, max_length=0)


def test_batch_loss_of_a_batch_without_pairs_is_undefined(spark):
    samples, labels = frames(spark, {1: (2, [(0, 1)]), 2: (2, [])})
    batches = samples.select(*PAIR_KEY, "output_id", F.col("input_id").alias("batch_id"))
    rows = {r.batch_id: r for r in batching.batch_loss(batches, labels, samples, 0.5).collect()}
    assert rows[1].n_pairs == 1 and rows[1].loss == pytest.approx(1.3132616875 + 0.25)
    assert rows[2].bt_loss is None and rows[2].loss is None and rows[2].l2_penalty == 0.25


def test_grouped_samples_of_a_prompt_over_batches(spark):
    samples, labels = frames(spark, {1: (5, [(0, 1), (3, 2), (4, 0)]), 2: (2, [])})
    batches = batching.pack_batches(samples, 3)
    place = {(r.input_id, r.output_id): r.batch_id for r in batches.collect()}
    outputs, pairs = {}, {}
    for (prompt, output), batch in sorted(place.items()):
        outputs.setdefault((batch, prompt), []).append(output)
    for chosen, rejected in [(0, 1), (3, 2), (4, 0)]:
        if place[1, chosen] == place[1, rejected]:
            pairs.setdefault((place[1, chosen], 1), []).append((chosen, rejected))
    rows = batching.group_samples(batches, labels).collect()
    assert len(rows) == len(outputs)
    for r in rows:
        key = (r.batch_id, r.input_id)
        assert list(r.outputs) == outputs[key] and sorted(map(tuple, r.labels)) == sorted(pairs.get(key, []))


def test_export_round_trip(spark, tmp_path):
    samples, labels = frames(spark, STAR)
    batches = batching.batch_rows(batching.pack_batches(samples, 4), labels)
    rows = batches.withColumn("input_ids", F.sequence(F.lit(0), F.col("output_id")))
    padded = pad_batch(rows, ["batch_id"], ["input_ids"], label_column="labels")
    path = str(tmp_path / "batches")
    export_training_batches(padded, path, epoch=2)
    back = spark.read.parquet(path).where("epoch = 2")
    assert back.count() == 13
    widths = back.groupBy("batch_id").agg(
        F.countDistinct(F.size("input_ids")).alias("a"), F.countDistinct(F.size("labels")).alias("b")
    )
    assert widths.where("a <> 1 OR b <> 1").count() == 0
    export_training_batches(padded.limit(4), path, epoch=3)
    export_training_batches(padded.limit(2), path, epoch=3, mode="overwrite")
    counts = {r["epoch"]: r["count"] for r in spark.read.parquet(path).groupBy("epoch").count().collect()}
    assert counts == {2: 13, 3: 2}
    files = back.select("batch_id", F.input_file_name().alias("file")).distinct()
    assert files.count() == back.select("batch_id").distinct().count()
    expanded = {(r.input_id, r.chosen_id, r.rejected_id) for r in expand_label_rows(back).collect()}
    inside = batching.in_batch_pairs(batches, labels).collect()
    assert expanded == {(r.input_id, r.chosen_id, r.rejected_id) for r in inside}


def test_exported_batches_are_in_order_and_an_epoch_resumes(spark, tmp_path):
    samples, labels = frames(spark, random_prompts(4, n=300))
    batches = batching.pack_batches_greedy(samples, labels, 8).repartition(9)
    path = str(tmp_path / "run")
    export_training_batches(batches, path, epoch=1, n_files=5)
    read = spark.read.parquet(f"{path}/epoch=1")
    rows = read.select("batch_id", "slot", "_metadata.file_name", F.monotonically_increasing_id().alias("at")).collect()
    in_files = [(r.batch_id, r.slot) for r in sorted(rows, key=lambda r: (r.file_name, r.at))]
    assert in_files == sorted(in_files)
    last = max(b for b, _ in in_files)
    manifest = spark.read.parquet(f"{path}/_manifest/epoch=1").orderBy("file").collect()
    assert sum(m.n_rows for m in manifest) == len(rows) and len(manifest) > 1
    assert all(a.last_batch < b.first_batch for a, b in zip(manifest, manifest[1:]))
    for k in (0, 1, last // 2, last, last + 1):
        found = read_training_batches(spark, path, 1, k)
        assert sorted((r.batch_id, r.slot) for r in found.collect()) == [x for x in in_files if x[0] >= k]
        opened = found.select("_metadata.file_name").distinct().count()
        assert opened == sum(m.last_batch >= k for m in manifest)
    assert spark.read.parquet(path).count() == len(rows)


def test_an_audit_runs_the_packing_once(spark, tmp_path):
    samples, labels = frames(spark, {1: (5, [(0, 1), (2, 3)]), 2: (3, [(0, 2)])})
    folder = str(tmp_path)

    def noted(tables):
        import uuid

        for table in tables:
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield table

    packed = batching.pack_batches(samples, 4).coalesce(1)
    audit = batching.packing_audit(packed.mapInPandas(noted, packed.schema), labels, samples, 4).collect()
    assert [(r["n_samples"], r["n_missing"], r["n_repeated"], r["n_batches"]) for r in audit] == [(8, 0, 0, 2)]
    assert len(list(tmp_path.iterdir())) == 1
