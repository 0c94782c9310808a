"""Records, ranks and keys that take no part, and data sets without categories."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from prefdeck.operators import batching, fuse, metrics, pairs, records
from prefdeck.plans.evaluate import prepare
from prefdeck.sources import jsonl, sinks

SCORES = "origin string, category string, input_id long, output_id int, rank int, reward double"


def read(spark, tmp_path, rows):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return jsonl.read_preferences(spark, str(path), "set")


def ranked(question, answers, ranks):
    listed = [{"id": i, "content": text} for i, text in answers.items()]
    return {"input": question, "responses": listed, "annotations": [], "rank": ranks, "category": ["k"]}


def bag(rows):
    return {(r.origin, r.category, r.metric): r.value for r in rows.collect()}


def test_a_broken_line_leaves_no_gap(spark, tmp_path):
    lines = [ranked("q0", {"a": "x"}, {"a": "1"}), '{"input": "broken', ranked("q1", {"a": "x"}, {"a": "1"})]
    df = read(spark, tmp_path, lines)
    fused, flat = prepare(df)
    assert {r.input: r.input_id for r in flat.collect()} == {"q0": 0, "q1": 1}
    assert all(r.is_common for r in fuse.prune_common_keys(fused.inputs, ["input", "category"]).collect())
    assert records.records_without_prompt(df).count() == 1
    with pytest.raises(Exception, match="no prompt"):
        records.require_valid(df).collect()


def test_merged_rank_maps_lose_no_pair(spark, tmp_path):
    df = read(spark, tmp_path, [ranked("q", {"a": "x", "b": "y"}, {"a": "1"}), ranked("q", {}, {"b": "2"})])
    _, flat = prepare(df)
    rows = flat.withColumn("question", F.col("input"))
    got = pairs.judge_pairs(rows, ["origin", "input_id"]).collect()
    assert [(r.id_a, r.id_b, r.answer_a, r.answer_b, r.preference) for r in got] == [("a", "b", "x", "y", "A")]


def test_bad_ranks_and_short_tuples_are_reported(spark, tmp_path):
    row = {**ranked("q", {"a": "x", "b": "y"}, {"a": "first", "b": "2", "nobody": "3"}), "annotations": [["a", "b"]]}
    df = read(spark, tmp_path, [row])
    normalized = records.normalize_records(df)
    assert [r.response_id for r in records.invalid_ranks(normalized).collect()] == ["a"]
    fused = fuse.fuse_by_prompt(normalized)
    assert [r.response_id for r in fuse.unknown_rank_ids(fused.ranks, fused.responses).collect()] == ["nobody"]
    assert records.invalid_annotations(normalized).count() == 1
    with pytest.raises(Exception, match="three parts"):
        records.require_valid(df).collect()
    with pytest.raises(Exception, match="not an integer"):
        records.require_valid(read(spark, tmp_path, [{**row, "annotations": []}])).collect()


@pytest.mark.parametrize("block_rows", [2, 1000])
def test_pairs_over_blocks(spark, block_rows):
    rows = [("o", "k", q, i, i % 3, float(i)) for q in (0, 1) for i in range(11 if q else 2)]
    got = pairs.rank_pairs(spark.createDataFrame(rows, SCORES), block_rows).collect()
    want = {(q, a, b) for _, _, q, a, ra, _ in rows for _, _, p, b, rb, _ in rows if p == q and ra < rb}
    assert len(got) == len(want) and {(r.input_id, r.chosen_id, r.rejected_id) for r in got} == want


def test_a_large_prompt_is_paired_in_many_tasks(spark):
    rows = spark.createDataFrame([("o", "k", 1, i, 2 if i else 1, 0.0) for i in range(4000)], SCORES)
    got = pairs.rank_pairs(rows, block_rows=100).withColumn("task", F.spark_partition_id())
    assert got.count() == 3999 and got.select("task").distinct().count() > 4


def test_an_origin_that_lacks_categories_is_measured_as_a_whole(spark, tmp_path):
    rows = [("o", c, q, i, i, -float(i * s)) for q, c, s in [(0, "k", 1), (1, None, -1)] for i in (1, 2)]
    rows += [("p", c, q, i, i, -float(i * s)) for q, c, s in [(0, "k", 1), (1, "l", -1)] for i in (1, 2)]
    found = metrics.metric_bundle(spark.createDataFrame(rows, SCORES))
    values = bag(found)
    assert found.count() == len(values) == 4 + 4 * 3
    assert values["o", None, "accuracy-rank"] == values["p", None, "accuracy-rank"] == 0.5
    assert values["p", "k", "accuracy-rank"] == 1.0 and ("o", "k", "accuracy-rank") not in values
    assert metrics.overall_score(found).first().overall == 0.5
    path = str(tmp_path / "document")
    sinks.write_metrics_document(found, path)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    document = json.loads(text)
    assert document["o"]["accuracy-rank"] == 0.5 and document["p"]["accuracy-rank-k"] == 1.0


def test_a_category_without_pairs_makes_the_mean_undefined(spark):
    rows = [("o", c, q, i, i, -float(i)) for q, c in [(0, "k"), (1, "l")] for i in (0, 1)]
    labels = spark.createDataFrame([("o", 0, 0, 1)], "origin string, input_id long, chosen_id int, rejected_id int")
    scores = spark.createDataFrame(rows, SCORES)
    values = bag(metrics.metric_bundle(scores, labels))
    assert values["o", "k", "accuracy-labels"] == 1.0
    assert values["o", "l", "accuracy-labels"] is None and values["o", None, "accuracy-labels"] is None
    assert bag(metrics.metric_bundle(scores, labels, skip_undefined=True))["o", None, "accuracy-labels"] == 1.0


def test_calibration_error_is_zero_without_differences(spark):
    rows = spark.createDataFrame([("o", 1.0, 1.0)], "origin string, chosen_reward double, rejected_reward double")
    curve = metrics.calibration_curve(rows)
    assert metrics.expected_calibration_error(curve).count() == 0
    curve = metrics.calibration_curve(rows, outside=True)
    assert [r.ece for r in metrics.expected_calibration_error(curve).collect()] == [0.0]


def test_samples_without_key_are_reported(spark):
    rows = spark.createDataFrame(
        [("o", 1, 0), ("o", None, 0), ("o", 1, None)], "origin string, input_id long, output_id int"
    )
    assert batching.unkeyed_samples(rows).count() == 2 and batching.pack_batches(rows, 4).count() == 1
    with pytest.raises(Exception, match="lacks its origin"):
        batching.require_keyed(rows).collect()
