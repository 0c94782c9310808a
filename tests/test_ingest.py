"""Reading JSON lines, fusing, ids, labels."""

from __future__ import annotations

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from prefdeck.operators import fuse, records, samples
from prefdeck.plans.evaluate import prepare, sample_labels
from prefdeck.sources import jsonl


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    return str(path)


FLAT = {"input": "Q1", "answer1": "x", "answer2": "y", "preference": 1, "category": ["k1", "z"]}
TEXTS = {
    "prompt": "Q1",
    "category": ["k2"],
    "annotations": [{"answer1": "y", "answer2": "z", "preference": "2"}],
}
FULL = {
    "input": "Q2",
    "responses": [{"id": "a", "content": "甲"}, {"id": "b", "content": "乙"}, {"id": "c", "content": "丙"}],
    "annotations": [["a", "b", "1"], ["b", "c", "2"]],
    "rank": {"b": 1, "a": "2"},
    "category": ["k1"],
    "sys_prompt": "be brief",
}


@pytest.fixture
def mixed(spark, tmp_path):
    return jsonl.read_preferences(spark, write(tmp_path / "mixed.jsonl", [FLAT, TEXTS, FULL]), "set")


def test_three_shapes_in_one_file(mixed):
    fused, flat = prepare(mixed)
    rows = {(r.input, r.output_id): r for r in flat.collect()}
    assert {k: r.output for k, r in rows.items()} == {
        ("Q1", 0): "x", ("Q1", 1): "y", ("Q1", 2): "z",
        ("Q2", 0): "甲", ("Q2", 1): "乙", ("Q2", 2): "丙",
    }
    assert {r.input: r.input_id for r in rows.values()} == {"Q1": 0, "Q2": 1}
    # the last record of a prompt decides its category; ids follow the first prompt of a category
    assert {r.input: (r.category, r.category_id) for r in rows.values()} == {"Q1": ("k2", 0), "Q2": ("k1", 1)}
    assert [rows["Q2", i]["rank"] for i in range(3)] == [2, 1, None]
    assert {r.sys_prompt for k, r in rows.items() if k[0] == "Q2"} == {"be brief"}
    labels = {(r.input_id, r.chosen_id, r.rejected_id) for r in sample_labels(fused).collect()}
    assert labels == {(0, 0, 1), (0, 2, 1), (1, 0, 1)}


def test_missing_rank_is_zero_in_compat_mode(mixed):
    _, flat = prepare(mixed, compat_ranks=True)
    assert {r.output_id: r["rank"] for r in flat.collect() if r.input == "Q2"} == {0: 2, 1: 1, 2: 0}


def test_two_files_share_a_prompt_and_keep_list_order(spark, tmp_path):
    one = write(tmp_path / "one.jsonl", [{"input": "Q", "answer1": "p", "answer2": "q", "preference": "1"}])
    two = write(tmp_path / "two.jsonl", [{"input": "Q", "answer1": "q", "answer2": "r", "preference": "2"}])

    def outputs(paths):
        _, flat = prepare(jsonl.read_preferences(spark, paths))
        return [r.output for r in flat.orderBy("output_id").collect()]

    assert outputs([one, two]) == ["p", "q", "r"]
    assert outputs([two, one]) == ["q", "r", "p"]


def test_fusing_is_idempotent(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [FLAT, TEXTS, FULL])
    again = write(tmp_path / "b.jsonl", [FLAT, TEXTS])
    once = prepare(jsonl.read_preferences(spark, path, "s"))[1].drop("input_id")
    twice = prepare(jsonl.read_preferences(spark, [path, again], "s"))[1].drop("input_id")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_identical_answers_become_one_response_and_a_self_label(spark, tmp_path):
    row = {"input": "Q", "answer1": "same", "answer2": "same", "preference": "1"}
    fused, flat = prepare(jsonl.read_preferences(spark, write(tmp_path / "s.jsonl", [row])))
    assert [r.response_id for r in flat.collect()] == [md5("same")]
    assert [(r.chosen_id, r.rejected_id) for r in sample_labels(fused).collect()] == [(0, 0)]


def test_prompt_keyed_flat_record_does_not_qualify(spark, tmp_path):
    row = {"prompt": "Q", "answer1": "x", "answer2": "y", "preference": "1"}
    fused, flat = prepare(jsonl.read_preferences(spark, write(tmp_path / "p.jsonl", [row])))
    assert flat.count() == 0 and fused.annotations.count() == 0 and fused.inputs.first().input == "Q"


def test_flat_pair_replaces_annotations(spark, tmp_path):
    row = {**FLAT, "annotations": [{"answer1": "u", "answer2": "v", "preference": "1"}]}
    normalized = records.normalize_records(jsonl.read_preferences(spark, write(tmp_path / "f.jsonl", [row])))
    assert [(r.first, r.second) for r in records.annotation_rows(normalized).collect()] == [("x", "y")]


def test_bad_preference_is_reported_and_fails_in_strict_mode(spark, tmp_path):
    rows = [FLAT, {**FLAT, "preference": "3"}, {**FLAT, "preference": None, "annotations": [{"answer1": "x"}]}]
    df = jsonl.read_preferences(spark, write(tmp_path / "bad.jsonl", rows))
    normalized = records.normalize_records(df)
    assert sorted(str(r.preference) for r in records.invalid_annotations(normalized).collect()) == ["3", "None"]
    assert records.canonical_annotations(normalized).count() == 1
    with pytest.raises(Exception, match="preference must be 1 or 2"):
        records.require_valid(df).collect()


def test_annotations_that_are_no_list_and_broken_lines(spark, tmp_path):
    rows = [FLAT, {"input": "Q", "annotations": {"answer1": "x"}}, '{"input": "broken', FULL]
    path = write(tmp_path / "broken.jsonl", rows)
    reasons = sorted(r.reason for r in jsonl.invalid_lines(spark, path).collect())
    assert reasons == ["annotations is not a list", "not a record of the expected shape"]
    assert jsonl.read_preferences(spark, path).count() == 4
    with pytest.raises(Exception, match="(?i)malformed"):
        records.normalize_records(jsonl.read_preferences(spark, path, strict=True)).collect()


def test_unknown_label_ids(spark, tmp_path):
    row = {**FULL, "annotations": [["a", "nobody", "1"], ["nobody", "a", "2"]]}
    fused, flat = prepare(jsonl.read_preferences(spark, write(tmp_path / "u.jsonl", [row])))
    unknown = samples.unknown_label_ids(fused.annotations, fused.responses)
    assert [r.response_id for r in unknown.collect()] == ["nobody"]
    assert sample_labels(fused).count() == 0


def test_rank_once(spark, tmp_path):
    df = jsonl.read_preferences(spark, write(tmp_path / "r.jsonl", [FULL, FULL, FLAT]))
    rows = fuse.rank_once(records.normalize_records(df)).collect()
    assert [(r.input_key, r.n_rank_maps) for r in rows] == [(md5("Q2"), 2)]


def test_common_keys(mixed):
    inputs = fuse.fuse_inputs(records.normalize_records(mixed))
    fields = {r.field: r.is_common for r in fuse.prune_common_keys(inputs, ["category", "sys_prompt"]).collect()}
    assert fields == {"category": True, "sys_prompt": False}
    kept = fuse.keep_common_keys(inputs, ["category", "sys_prompt"]).columns
    assert "category" in kept and "sys_prompt" not in kept


def test_last_content_wins_at_the_first_place(spark, tmp_path):
    rows = [
        {"input": "Q", "responses": [{"id": "1", "content": "old"}, {"id": "2", "content": "b"}], "annotations": []},
        {"input": "Q", "responses": [{"id": "1", "content": "new"}], "annotations": []},
    ]
    _, flat = prepare(jsonl.read_preferences(spark, write(tmp_path / "d.jsonl", rows)))
    assert [(r.output_id, r.output) for r in flat.orderBy("output_id").collect()] == [(0, "new"), (1, "b")]


def test_output_ids_of_a_prompt_over_several_splits(spark):
    """First-seen order holds across chunk borders, for a prompt with most of the rows."""
    rows = spark.range(500).select(
        F.lit("o").alias("origin"),
        F.when(F.col("id") % 7 == 0, "small").otherwise("big").alias("input_key"),
        F.col("id").cast("string").alias("response_id"),
        F.struct(
            F.struct(F.lit(0).alias("path"), F.floor(F.col("id") / 50).alias("block"), F.col("id").alias("row")).alias("ord"),
            F.lit(0).alias("sub"),
        ).alias("first_ord"),
    )
    got = samples.assign_output_ids(rows).collect()
    for key in ("small", "big"):
        ids = [r.output_id for r in sorted((r for r in got if r.input_key == key), key=lambda r: int(r.response_id))]
        assert ids == list(range(len(ids)))


def test_extension_is_checked(spark):
    with pytest.raises(ValueError, match="jsonl"):
        jsonl.read_preferences(spark, ["a.jsonl", "b.json"])


def test_named_sets_and_origins(spark, tmp_path):
    one, two = write(tmp_path / "one.jsonl", [FLAT]), write(tmp_path / "two.jsonl", [TEXTS, FULL])

    def origins(df):
        return {r.origin: r["count"] for r in df.groupBy("origin").count().collect()}

    assert origins(jsonl.read_named_sets(spark, {"t": one, "u": [one, two]})) == {"t": 1, "u": 3}
    assert origins(jsonl.read_named_sets(spark, [one, two])) == {f"{one},{two}": 3}
    assert origins(jsonl.tag_origin(spark, [one, two])) == {one: 1, two: 2}
    train, test = jsonl.read_train_and_eval(spark, one, one)
    assert train is test
    assert jsonl.read_train_and_eval(spark, one, None)[1] is None
    assert origins(jsonl.read_train_and_eval(spark, one, {"v": two})[1]) == {"v": 2}


def test_hot_prompt_and_hot_answer_are_split_by_skew_joins(spark):
    """One prompt holds two thirds of the answers and one answer all its votes. With the limits of
    AQE scaled down to the test, its joins are split and the result is that of unsplit joins."""
    rows = spark.range(6000).select(
        F.lit("o").alias("origin"),
        F.struct(
            F.lit(0).alias("path"), F.floor(F.col("id") / 500).cast("bigint").alias("block"), F.col("id").alias("row")
        ).alias("ord"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("q"), F.col("id"))).alias("input"),
        F.lit(None).cast("string").alias("prompt"),
        F.lit(None).cast("string").alias("sys_prompt"),
        F.array(F.lit("c")).alias("category"),
        F.lit("base").alias("answer1"),
        F.concat(F.lit("other "), F.col("id")).alias("answer2"),
        (1 + F.col("id") % 2).cast("string").alias("preference"),
        F.lit(None).cast("array<struct<id:string,content:string>>").alias("responses"),
        F.lit(None).cast("array<string>").alias("annotations"),
        F.lit(None).cast("map<string,string>").alias("rank"),
    )
    fused = fuse.fuse_by_prompt(records.normalize_records(rows))

    def run():
        result = []
        for df in (samples.explode_responses(fused), sample_labels(fused)):
            result.append((sorted(map(str, df.collect())), df._jdf.queryExecution().executedPlan().toString()))
        return result

    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    plain = run()
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        split = run()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    assert [rows for rows, _ in plain] == [rows for rows, _ in split]
    assert len(plain[0][0]) == 6000 + 2001 and len(plain[1][0]) == 6000
    for _, plan in split:
        assert "skew=true" in plan.split("Initial Plan")[0]


def test_files_of_a_glob_are_numbered_apart_and_in_name_order(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part{i}.jsonl").write_text(json.dumps({"input": f"q{i}", "answer1": "a", "answer2": "b", "preference": "1"}) + "\n")
    fused, _ = prepare(jsonl.read_preferences(spark, str(tmp_path / "*.jsonl"), origin="o"))
    chunks = samples._with_split(fused.inputs.select("first_ord"), "first_ord").select("_split").distinct()
    assert chunks.count() == 5
    ids = samples.assign_input_ids(fused.inputs).select("input", "input_id").collect()
    assert {r["input"]: r["input_id"] for r in ids} == {f"q{i}": i for i in range(5)}


def test_thousands_of_listed_paths_are_one_scan(spark, tmp_path):
    """Order follows the list, a path listed twice counts twice, names need no quoting."""
    names = [f"part {k % 7}-{k}.jsonl" for k in range(2000)]
    for k, name in enumerate(names):
        (tmp_path / name).write_text(json.dumps({"input": f"q{k}"}) + "\n\n")
    draw = random.Random(1)
    listed = [str(tmp_path / n) for n in names]
    draw.shuffle(listed)
    listed.append(listed[0])
    started = time.time()
    df = jsonl.read_preferences(spark, listed, "o")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert time.time() - started < 30
    assert plan.count("FileScan text") == 1 and "Union" not in plan
    got = [r.input for r in df.select("input", "ord.path").orderBy("path").collect()]
    assert got == ["q" + name.rpartition("-")[2].removesuffix(".jsonl") for name in listed]


def test_sets_folders_and_globs_share_one_scan(spark, tmp_path):
    for folder in ("a.jsonl", "b.jsonl"):
        (tmp_path / folder).mkdir()
        for k in range(2):
            (tmp_path / folder / f"{k}.jsonl").write_text(json.dumps({"input": f"{folder[0]}{k}"}) + "\n")
    one, both = str(tmp_path / "a.jsonl" / "1.jsonl"), str(tmp_path / "*" / "*.jsonl")
    df = jsonl.read_named_sets(spark, {"first": [one, str(tmp_path / "b.jsonl")], "all": both, "uri": f"file://{one}"})
    got = sorted((r.origin, r.path, r.input) for r in df.select("origin", "ord.path", "input").collect())
    assert got == [
        ("all", 0, "a0"), ("all", 0, "a1"), ("all", 0, "b0"), ("all", 0, "b1"),
        ("first", 0, "a1"), ("first", 1, "b0"), ("first", 1, "b1"), ("uri", 0, "a1"),
    ]


def test_broken_lines_are_found_whatever_is_read(spark):
    lines = ['{"input": "a", "rank": {"1": 2}}', '{"input": "b"', "", '{"input": "c", "annotations": {"x": 1}}', "[1]", '{"input": 5}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    read = jsonl.records_from_lines(df, "line")
    assert [r.n for r in read.where("_corrupt_record IS NOT NULL").select("n").orderBy("n").collect()][0] == 1
    assert {r.n: r.reason for r in jsonl.invalid_records(df, "line").collect()} == {
        1: "not a record of the expected shape", 3: "annotations is not a list", 4: "not a record of the expected shape"
    }
    assert read.where("n = 0").first().rank == {"1": "2"} and read.where("n = 5").first().input == "5"
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        jsonl.records_from_lines(df.where("n = 1"), "line", strict=True).collect()


def test_fields_that_some_prompt_of_an_origin_lacks(spark):
    rows = [("a", "p", "x", None), ("a", "q", None, None), ("b", "p", "x", "s"), ("b", "q", "y", "t")]
    inputs = spark.createDataFrame(rows, "origin string, input_key string, category string, sys_prompt string")
    found = fuse.null_uncommon_keys(inputs, ["category", "sys_prompt"]).orderBy("origin", "input_key").collect()
    assert [tuple(r)[2:] for r in found] == [(None, None), (None, None), ("x", "s"), ("y", "t")]
    assert fuse.null_uncommon_keys(inputs.limit(0), ["category"]).count() == 0
