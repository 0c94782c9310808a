"""Evaluation end to end, registry, sinks, head, and the shape of the physical plans."""

from __future__ import annotations

import contextlib
import io
import json
import math
import os
import random
import re
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import fixtures as fx
from catalog import queries
from prefdeck.operators import fuse, metrics, scoring
from prefdeck.operators import samples as samples_of
from prefdeck.plans import head
from prefdeck.plans.evaluate import evaluate, prepare, sample_labels
from prefdeck.plans.registry import JUDGE, SCORE, Predictor, Registry, default_registry
from prefdeck.session import materialize
from prefdeck.sources import jsonl, sinks, store


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    rows = [
        {
            "input": f"question {i}",
            "responses": [{"id": str(k), "content": f"{i}-" + "x" * k} for k in range(4)],
            "annotations": [],
            "rank": {"3": 1, "2": 2, "1": 2, "0": 3},
            "category": [["math", "code"][i % 2]],
        }
        for i in range(6)
    ]
    path = tmp_path_factory.mktemp("bench") / "human.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    return prepare(jsonl.tag_origin(spark, str(path)))[1]


def bag(df):
    return {(r.category, r.metric): r.value for r in df.collect()}


def calls():
    """A scorer that checks it only ever gets whole rows; longer is better."""

    def rewards(rows: pd.DataFrame) -> pd.Series:
        assert len(rows) <= 3
        return rows["output"].str.len().astype(float)

    return rewards


def longer_judge():
    def text(rows: pd.DataFrame) -> pd.Series:
        assert rows["judge_prompt"].str.contains("question").all()
        a_wins = rows["answer_a"].str.len() > rows["answer_b"].str.len()
        return a_wins.map({True: "A it is: [[A]]", False: "[[B]]"})

    return text


def test_evaluate_scorer_judge_and_default(samples):
    known = Registry(default=Predictor(SCORE, F.lit(0.0)))
    known.register("column", Predictor(SCORE, F.length("output")))
    known.register("python", Predictor(SCORE, calls, batch_size=3))
    known.register("judge", Predictor(JUDGE, longer_judge))
    for name in ("column", "python", "judge"):
        found = bag(evaluate(samples, name, known))
        for category in (None, "math", "code"):
            assert found[category, "accuracy-rank"] == found[category, "exact_match-rank"] == 1.0
    flat = bag(evaluate(samples, "unknown name", known))
    assert flat[None, "accuracy-rank"] == 0.0 and flat[None, "exact_match-rank"] == 1.0
    assert bag(evaluate(samples, "anything", default_registry()))[None, "accuracy-rank"] == 1.0
    assert metrics.overall_score(evaluate(samples, "column", known)).first().overall == 1.0


def test_registry_refuses_unknown_kinds(samples):
    known = Registry()
    with pytest.raises(ValueError):
        known.register("x", Predictor("other", F.lit(1)))
    with pytest.raises(KeyError):
        known.get("x")
    odd = Registry(default=Predictor("other", F.lit(1)))
    with pytest.raises(NotImplementedError):
        evaluate(samples, "x", odd)


def test_judging_gives_a_column_for_a_single_row(spark):
    df = spark.createDataFrame([("q", "aa", "b", "question")], "question string, answer_a string, answer_b string, judge_prompt string")
    assert [r.judge_text for r in scoring.judge_responses(df, longer_judge, 1).collect()] == ["A it is: [[A]]"]


def test_repartition_for_calls(spark):
    slots = spark.sparkContext.defaultParallelism
    for n in (1, 10, 100_000):
        assert scoring.repartition_for_calls(spark.range(n)).rdd.getNumPartitions() == 4 * slots
    assert scoring.repartition_for_calls(spark.range(9), partitions=2).rdd.getNumPartitions() == 2
    assert scoring.repartition_for_calls(spark.range(1), waves=1).count() == 1


def test_a_factory_is_built_once_per_worker_process(spark, tmp_path):
    """A hundred tasks on a few workers; a second call with the same state name builds nothing."""
    notes, out = str(tmp_path / "built"), str(tmp_path / "pids")

    def factory():
        with open(notes, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda rows: [float(os.getpid())] * len(rows)

    for _ in range(2):
        df = spark.range(1000).repartition(100)
        got = {int(r.reward) for r in scoring.score_responses(df, factory, state="once").distinct().collect()}
        with open(out, "a") as f:
            f.writelines(f"{pid}\n" for pid in got)
    built = open(notes).read().split()
    assert len(built) == len(set(built)) and set(built) >= set(open(out).read().split())


def test_states_of_a_worker_are_few():
    seen = []
    for name in ("a", "b", "a", "c", "a", "b"):
        scoring.worker_state(f"test {name}", lambda: seen.append(name))
    assert seen == ["a", "b", "c", "b"]


def frames_of(n, size):
    return (pd.DataFrame({"x": range(i, min(i + size, n))}) for i in range(0, n, size))


def test_calls_overlap_in_order_and_within_bounds():
    lock, now, most = threading.Lock(), [0], [0]

    def slow(rows):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05 if rows["x"].iloc[0] % 3 else 0.1)
        with lock:
            now[0] -= 1
        return rows["x"] * 2

    started = time.time()
    done = list(scoring.run_calls(slow, frames_of(80, 7), 2, scoring.Calls(in_flight=8)))
    assert time.time() - started < 44 * 0.05 and most[0] == 8
    assert [x for part, _ in done for x in part["x"]] == list(range(80))
    assert [x for _, found in done for x in found] == [2 * x for x in range(80)]


@pytest.mark.parametrize("in_flight", [1, 4])
def test_a_failing_row_is_tried_again_alone(in_flight):
    asked = []

    def judge(rows):
        asked.append(rows["x"].tolist())
        if 5 in rows["x"].tolist() or (9 in rows["x"].tolist() and asked.count([9]) < 2):
            raise OSError("no answer")
        return rows["x"]

    how = scoring.Calls(in_flight=in_flight, retries=2, pause=0.001, on_error=scoring.NULL)
    done = list(scoring.run_calls(judge, frames_of(12, 4), None, how))
    assert [x for _, found in done for x in found] == [0, 1, 2, 3, 4, None, 6, 7, 8, 9, 10, 11]
    assert asked.count([5]) == 3 and asked.count([9]) == 2 and asked.count([4, 5, 6, 7]) == 1 and asked.count([6]) == 1
    with pytest.raises(OSError):
        list(scoring.run_calls(judge, frames_of(12, 4), None, scoring.Calls(in_flight=in_flight, retries=0)))
    with pytest.raises(ValueError):
        list(scoring.run_calls(lambda rows: [1], frames_of(3, 3), None, scoring.Calls()))
    with pytest.raises(ValueError):
        scoring.Calls(in_flight=0)


def test_scores_to_samples(spark, samples):
    scores = samples.where("output_id > 0").select("origin", "input_id", "output_id", F.lit(1.5).alias("reward"))
    joined = scoring.scores_to_samples(samples, scores)
    assert joined.count() == samples.count()
    assert scoring.missing_scores(joined).select("output_id").distinct().collect() == [(0,)]


def test_metric_documents(spark, samples, tmp_path):
    found = evaluate(samples, "x", default_registry())
    text = sinks.metrics_json(found).first().document
    document = json.loads(text)
    assert document["accuracy-rank"] == document["accuracy-rank-math"] == 1.0 and "\n" in text
    path = str(tmp_path / "metrics")
    sinks.write_metrics_json(found, path)
    back = spark.read.json(path)
    assert back.select("metrics.*").columns and back.select("origin").distinct().count() == 1
    with_text = spark.createDataFrame([("o", "数学", "accuracy-rank", 0.5)], "origin string, category string, metric string, value double")
    assert "accuracy-rank-数学" in sinks.metrics_json(with_text).first().document


def test_materialize_uses_the_named_folder(spark, tmp_path):
    assert materialize(spark.range(3)).count() == 3
    kept = materialize(spark.range(3), fallback_dir=str(tmp_path))
    assert kept.count() == 3 and "Range" not in kept._jdf.queryExecution().toString()


def test_head_finds_the_direction(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a, b = ([rng.gauss(0, 1) for _ in range(3)] for _ in range(2))
        noise = rng.gauss(0, 0.5)
        better = 2 * a[0] - a[1] + noise > 2 * b[0] - b[1]
        rows.append((a, b) if better else (b, a))
    df = spark.createDataFrame(rows, "chosen_features array<double>, rejected_features array<double>")
    fit = head.fit_linear_reward_head(df)
    w = fit.weights
    assert fit.n_pairs == 300 and fit.gradient < 1e-8 and fit.bt_loss < math.log(2)
    assert w[0] / -w[1] == pytest.approx(2.0, rel=0.25) and abs(w[2]) < 0.3 * w[0]
    scored = df.select(
        F.lit("o").alias("origin"),
        head.linear_reward("chosen_features", w).alias("chosen_reward"),
        head.linear_reward("rejected_features", w).alias("rejected_reward"),
    )
    fitted = metrics.bradley_terry_loss(scored).first().bt_loss
    nudged = scored.withColumn("chosen_reward", F.col("chosen_reward") * 1.2).withColumn(
        "rejected_reward", F.col("rejected_reward") * 1.2
    )
    assert fitted < 0.6931 and fitted <= metrics.bradley_terry_loss(nudged).first().bt_loss + 1e-6


@pytest.mark.parametrize("greater, best", [(True, (3.0, 1)), (False, (1.0, 0))])
def test_best_checkpoint_takes_the_earliest_of_equals(spark, monkeypatch, greater, best):
    monkeypatch.setattr(head, "_STEPS", 2)
    values = [1.0, 3.0, 3.0, 2.0, 1.0]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, step int, value double")
    row = head.best_checkpoint(df, greater).first()
    assert (row.best_value, row.best_step) == best
    walk = [r.is_new_best for r in head.checkpoint_walk(df, greater).orderBy("step").collect()]
    assert walk == ([True, True, False, False, False] if greater else [True, False, False, False, False])


# --- plans --------------------------------------------------------------------------------------


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


PYTHON = {"pack_batches_greedy", "pack_batches_greedy_audit", "score_responses_python", "length_path_truncated"}
# These run jobs while the plan is built: the fit, stored tables, and scores and token ids written to
# the checkpoint folder.
EAGER = {
    "fit_linear_reward_head", "linear_head_audit", "evaluate_python_scorer", "evaluate_python_judge",
    "stored_samples", "stored_labels", "length_path_dropped", "length_path_dropped_labels",
}


# Every node that runs Python on executors has one of these words in its name.
IN_PYTHON = re.compile(r"\b\w*(Python|Pandas|Arrow)\w*")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - EAGER))
def test_plans_stay_in_the_jvm_and_form_no_product(spark, sf_dir, name):
    plan = plan_of(queries.QUERIES[name](spark, sf_dir))
    assert bool(IN_PYTHON.search(plan)) == (name in PYTHON)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_is_used(spark, sf_dir):
    plan = plan_of(entry.queries()["rank_accuracy"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_discount:double>" in plan


def test_metrics_do_not_join_a_prompt_with_itself(spark, sf_dir):
    """The only joins are with the orders table and with the bounded table of hot prompts."""
    df = entry.queries()["rank_counts"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert not [j for j in joins if "input_id" in j and "hot_key" not in j and "_fact_" not in j]


def test_stored_samples_need_no_exchange_and_no_record(spark, sf_dir, tmp_path):
    """Not even to meet other rows by sample key, whichever session declared the table."""
    fused = fuse.fuse_by_prompt(fx.normalized_documents(spark, sf_dir))
    written = store.write_fused(fused, f"{tmp_path}/it's", buckets=8)
    expected = sorted(map(str, samples_of.explode_responses(fused).collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        store.write_fused(fused, f"{tmp_path}/it's", buckets=8)
    for kept in (written, None):
        if kept is None:  # as a new session, which knows the folder alone
            spark.sql("DROP TABLE " + store._table_name(f"{tmp_path}/it's"))
            kept = store.read_fused(spark, f"{tmp_path}/it's/")
        plan = plan_of(kept.samples)
        assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
        assert sorted(map(str, kept.samples.collect())) == expected
        sizes = kept.samples.select(*store.SAMPLE_KEY, F.length("output").alias("n"))
        joined = kept.samples.join(sizes.hint("merge"), store.SAMPLE_KEY)
        assert "Exchange" not in plan_of(joined) and joined.count() == len(expected)
        assert sorted(map(str, kept.labels.collect())) == sorted(map(str, sample_labels(fused).collect()))


def test_texts_are_shuffled_once_for_records_and_once_for_responses(spark, tmp_path):
    """Documents meet their successors in one shuffle, and responses of one data set (the same origin in all
    records) join on the key they are grouped by without another."""
    texts = [(i, f"text {i}", "en", "web", 6) for i in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    normalized = fx.normalized_documents(spark, str(tmp_path))
    assert plan_of(normalized).count("Arguments: hashpartitioning") == 1
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        responses = fuse.dedup_responses(fuse.response_rows(normalized))
        keys = spark.createDataFrame([("documents", "k", "r")], "origin string, input_key string, response_id string")
        joined = responses.select(*samples_of.RESPONSE_KEY, "output").join(keys, samples_of.RESPONSE_KEY)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        grouped, below = plan.split("SortAggregate", 1)
        assert "Exchange" not in grouped and "SortMergeJoin" in grouped and "Exchange" in below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rows_and_their_followers_are_those_of_a_self_join(spark):
    rows = [(i, f"t{i}" if i % 7 else None) for i in [-129, -128, -65, -64, -1, 0, 1, 1, 2, 2, 2, 5, 62, 63, 63, 64, 64, 65, 127, 128, 300]]
    df = spark.createDataFrame([*rows, (None, "x"), (None, "y")], "doc_id long, text string").withColumn("n", F.length("text"))
    after = df.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"), F.col("n").alias("next_n"))
    expected = df.join(after, "doc_id", "left").select("doc_id", "text", "n", "next_text", "next_n")
    found = fx._with_following(df, {"text": "next_text", "n": "next_n"}).select(*expected.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("labels", [[7] * 3 + [1] * 20, [7] * 20 + [1] * 3, [7] * 5])
def test_head_is_fitted_on_every_vector(spark, tmp_path, monkeypatch, labels):
    rows = [(i, [float(i % 5), float(label)], label) for i, label in enumerate(labels)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []

    class Fitted(Exception):
        pass

    def fit(pairs, **_):
        seen.extend(pairs.select("chosen_vec", "rejected_vec").collect())
        raise Fitted

    monkeypatch.setattr(queries.head, "fit_linear_reward_head", fit)
    with pytest.raises(Fitted):
        queries.QUERIES["fit_linear_reward_head"](spark, str(tmp_path))
    both = len(set(labels)) == 2
    assert len(seen) == (20 if both else 0)
    assert {v for pair in seen for v in pair} == (set(range(23)) if both else set())


def test_head_penalises_rewards(spark):
    """Against plain gradient descent on the same objective; separable pairs stay finite."""
    draw = np.random.default_rng(3)
    c, r = draw.normal(0.3, 1, (200, 4)), draw.normal(0, 1, (200, 4))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(c, r)], "chosen_features array<double>, rejected_features array<double>")
    fit = head.fit_linear_reward_head(df.repartition(5), reg_coef=0.1, ridge=0.0)
    w = np.zeros(4)
    for _ in range(5000):
        miss = 1 / (1 + np.exp((c - r) @ w))
        w -= 0.3 * (-(miss @ (c - r)) / 200 + 0.2 * (c.T @ (c @ w) + r.T @ (r @ w)) / 400)
    assert fit.weights == pytest.approx(w.tolist(), abs=1e-6) and fit.n_pairs == 200
    assert fit.objective == pytest.approx(fit.bt_loss + 0.1 * np.mean(np.append(c @ w, r @ w) ** 2), abs=1e-6)
    apart = spark.createDataFrame([([1.0], [0.0]), ([2.0], [0.0]), (None, [1.0])], df.schema)
    found = head.fit_linear_reward_head(apart)
    assert found.n_pairs == 2 and 1 < found.weights[0] < 100
    assert head.fit_linear_reward_head(apart.limit(0)).weights == []
