"""One registered query per operator, each over whole tables."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import fixtures as fx
from prefdeck.functions import arrays, text, verdict
from prefdeck.functions.prompts import JUDGE_STYLES, render_judge_prompts
from prefdeck.operators import batching, fuse, lengths, metrics, pairs, records, samples, scoring
from prefdeck.plans import evaluate as evaluation
from prefdeck.plans import head
from prefdeck.schema import CORRUPT
from prefdeck.plans.registry import JUDGE, SCORE, Predictor, Registry
from prefdeck.session import materialize, shared_folder
from prefdeck.sources import jsonl, sinks, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED, EPOCH, BATCH = 7, 1, 16
MAX_TOKENS = 60
HEAD_WEIGHTS = [(i - 31.5) / 64.0 for i in range(64)]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines scored by discount, which ties often."""
    return fx.ranked_lines(spark, sf_dir).withColumn("reward", F.col("reward_tied"))


# --- metrics ------------------------------------------------------------------------------------


@query
def reward_stats(spark, sf_dir):
    by = ["origin", "category"]
    return _round(metrics.reward_stats(fx.ranked_lines(spark, sf_dir), by), "reward_mean", "reward_std")


@query
def dedup_scores(spark, sf_dir):
    return fx.line_samples(spark, sf_dir).select(
        "origin", "category", "input_id", "output_id", "rank", F.round("reward", 6).alias("reward")
    )


@query
def rank_pairs(spark, sf_dir):
    return _round(
        pairs.rank_pairs(fx.line_samples(spark, sf_dir)), "chosen_reward", "rejected_reward"
    )


@query
def rank_counts(spark, sf_dir):
    counts = metrics.rank_counts(_tied(spark, sf_dir))
    whole = {c: F.col(c).cast("bigint") for c in ["n_pairs", "n_concordant", "n_discordant"]}
    return counts.withColumns(whole)


def _rank_metric(spark, sf_dir, metric, name):
    counts = metrics.rank_counts(_tied(spark, sf_dir))
    rows = metrics.rank_metrics(counts, ["origin", "category"])
    return rows.select("origin", "category", F.round(F.col(f"`{metric}`"), 6).alias(name))


@query
def rank_accuracy(spark, sf_dir):
    return _rank_metric(spark, sf_dir, "accuracy-rank", "accuracy_rank")


@query
def rank_exact_match(spark, sf_dir):
    return _rank_metric(spark, sf_dir, "exact_match-rank", "exact_match_rank")


@query
def metrics_by_category(spark, sf_dir):
    return _round(metrics.metrics_by_category(_tied(spark, sf_dir)), "value")


@query
def macro_metrics(spark, sf_dir):
    rows = metrics.macro_metrics(metrics.metrics_by_category(_tied(spark, sf_dir)))
    return _round(rows.select("origin", "metric", "value"), "value")


@query
def metric_bundle(spark, sf_dir):
    bag = metrics.metric_bundle(fx.line_samples(spark, sf_dir), labels=fx.line_votes(spark, sf_dir))
    return _round(bag, "value")


@query
def train_eval_metrics(spark, sf_dir):
    bag = metrics.train_eval_metrics(fx.line_samples(spark, sf_dir), fx.line_votes(spark, sf_dir))
    return _round(bag.select("origin", "metric", "value"), "value")


@query
def metric_documents(spark, sf_dir):
    bag = metrics.metric_bundle(_tied(spark, sf_dir))
    documents = sinks.metric_documents(bag).select("origin", F.explode("metrics").alias("name", "value"))
    return _round(documents, "value")


@query
def overall_score(spark, sf_dir):
    return _round(metrics.overall_score(metrics.metric_bundle(_tied(spark, sf_dir))), "overall")


# --- label pairs --------------------------------------------------------------------------------


@query
def distinct_pairs(spark, sf_dir):
    return pairs.distinct_pairs(fx.line_votes(spark, sf_dir))


def _pairs(spark, sf_dir):
    return pairs.build_pairs(fx.line_votes(spark, sf_dir), fx.line_samples(spark, sf_dir))


@query
def build_pairs(spark, sf_dir):
    return _round(_pairs(spark, sf_dir), "chosen_reward", "rejected_reward")


@query
def require_pairs(spark, sf_dir):
    return pairs.require_pairs(_pairs(spark, sf_dir))


@query
def pair_metrics(spark, sf_dir):
    rows = metrics.pair_metrics(_pairs(spark, sf_dir), ["origin", "category"])
    return rows.select(
        "origin",
        "category",
        *[
            F.round(F.col(f"`{c}`"), 6).alias(c.replace("-", "_"))
            for c in rows.columns
            if c not in ("origin", "category")
        ],
    )


@query
def calibration_curve(spark, sf_dir):
    return _round(metrics.calibration_curve(_pairs(spark, sf_dir)), "accuracy", "mean_diff")


@query
def expected_calibration_error(spark, sf_dir):
    by = ["origin", "category"]
    rows = _pairs(spark, sf_dir)
    curve = metrics.calibration_curve(rows, by, outside=True)
    return _round(metrics.expected_calibration_error(curve, by), "ece")


@query
def bradley_terry_loss(spark, sf_dir):
    return _round(metrics.bradley_terry_loss(_pairs(spark, sf_dir)), "bt_loss")


@query
def reward_l2_penalty(spark, sf_dir):
    return _round(metrics.reward_l2_penalty(fx.line_samples(spark, sf_dir), 0.1), "l2_penalty")


# --- records, fusing, ids -----------------------------------------------------------------------


@query
def normalize_prompt_key(spark, sf_dir):
    return fx.normalized_documents(spark, sf_dir).select(
        F.col("ord.row").alias("doc_id"), "input_text", "input_key"
    )


@query
def normalize_flat_pairs(spark, sf_dir):
    return fx.normalized_documents(spark, sf_dir).select(
        F.col("ord.row").alias("doc_id"), "is_flat", F.size("items").alias("n_items")
    )


@query
def first_category(spark, sf_dir):
    return fx.normalized_documents(spark, sf_dir).select(
        F.col("ord.row").alias("doc_id"), records.first_category().alias("category")
    )


@query
def content_id(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", text.content_id("text").alias("response_id")
    )


def _annotations(rows: DataFrame) -> DataFrame:
    return rows.select(
        "input_key", F.col("ord.row").alias("doc_id"), "sub", "id_1", "id_2", "preference"
    )


@query
def canonical_annotations(spark, sf_dir):
    return _annotations(records.canonical_annotations(fx.normalized_documents(spark, sf_dir)))


@query
def tuple_annotations(spark, sf_dir):
    return _annotations(records.tuple_annotations(fx.normalized_documents(spark, sf_dir)))


@query
def invalid_annotations(spark, sf_dir):
    rows = records.invalid_annotations(fx.normalized_documents(spark, sf_dir))
    return rows.select("input_key", F.col("ord.row").alias("doc_id"), "preference")


@query
def fuse_by_prompt(spark, sf_dir):
    fused = fuse.fuse_by_prompt(fx.normalized_documents(spark, sf_dir))
    return fuse.fused_summary(fused).select(
        "input_key",
        "input",
        F.col("first_ord.row").alias("first_doc"),
        "category",
        "n_records",
        "n_responses",
        "n_annotations",
    )


@query
def dedup_responses(spark, sf_dir):
    rows = fuse.dedup_responses(fuse.response_rows(fx.normalized_documents(spark, sf_dir)))
    return rows.select(
        "input_key",
        "response_id",
        F.col("first_ord.ord.row").alias("first_doc"),
        F.col("first_ord.sub").alias("first_sub"),
        "output",
        "n_mentions",
    )


@query
def passthrough_scalars(spark, sf_dir):
    rows = fuse.passthrough_scalars(fx.normalized_documents(spark, sf_dir), ["sys_prompt"])
    return rows.select("input_key", "sys_prompt")


@query
def rank_once(spark, sf_dir):
    return fuse.rank_once(fx.normalized_documents(spark, sf_dir)).select("input_key", "n_rank_maps")


@query
def prune_common_keys(spark, sf_dir):
    fused = fuse.fuse_inputs(fx.normalized_documents(spark, sf_dir))
    return fuse.prune_common_keys(fused, ["input", "category", "sys_prompt"])


@query
def assign_input_ids(spark, sf_dir):
    fused = fuse.fuse_inputs(fx.normalized_documents(spark, sf_dir))
    return samples.assign_input_ids(fused).select("input_key", "input_id")


def _numbered(spark, sf_dir):
    rows = fuse.response_rows(fx.normalized_documents(spark, sf_dir))
    return samples.assign_output_ids(fuse.dedup_responses(rows))


@query
def assign_output_ids(spark, sf_dir):
    return _numbered(spark, sf_dir).select("input_key", "response_id", "output_id")


@query
def category_dictionary(spark, sf_dir):
    return samples.category_dictionary(fuse.fuse_inputs(fx.normalized_documents(spark, sf_dir)))


@query
def explode_responses(spark, sf_dir):
    fused = fuse.fuse_by_prompt(fx.normalized_documents(spark, sf_dir))
    return samples.explode_responses(fused).select(
        "input_id", "output_id", "input", "output", "category", "category_id", "rank", "sys_prompt"
    )


@query
def sequential_order(spark, sf_dir):
    keys = fx.line_samples(spark, sf_dir).select("origin", "input_id", "output_id")
    return samples.sequential_positions(keys)


@query
def null_uncommon_keys(spark, sf_dir):
    _, flat = evaluation.prepare(fx.document_records(spark, sf_dir), common_only=True)
    return flat.select("input_id", "output_id", "input", "category", "category_id", "sys_prompt")


def _stored(spark, sf_dir):
    fused = fuse.fuse_by_prompt(fx.normalized_documents(spark, sf_dir))
    return store.write_fused(fused, f"{shared_folder(spark)}/fused-{uuid.uuid4().hex}", buckets=8)


@query
def stored_samples(spark, sf_dir):
    return _stored(spark, sf_dir).samples.select(
        "input_id", "output_id", "input", "output", "category", "category_id", "rank", "sys_prompt"
    )


@query
def stored_labels(spark, sf_dir):
    kept = _stored(spark, sf_dir)
    keys = kept.samples.select("input_id", "input_key").distinct()
    return kept.labels.join(keys, "input_id").select("input_key", "chosen_id", "rejected_id")


@query
def index_labels(spark, sf_dir):
    annotations = records.all_annotations(fx.normalized_documents(spark, sf_dir))
    responses = fuse.dedup_responses(fuse.response_rows(fx.normalized_documents(spark, sf_dir)))
    return samples.index_labels(annotations, samples.number_outputs(responses)).select(
        "input_key", "chosen_id", "rejected_id"
    )


@query
def unknown_label_ids(spark, sf_dir):
    """Annotations against the ids of the full records only, so that many ids are unknown."""
    normalized = fx.normalized_documents(spark, sf_dir)
    annotations = records.all_annotations(normalized)
    listed = fuse.rank_rows(normalized)
    rows = samples.unknown_label_ids(annotations, listed)
    return rows.groupBy("input_key", "response_id").agg(F.count("*").alias("n_uses"))


@query
def attach_ranks(spark, sf_dir):
    normalized = fx.normalized_documents(spark, sf_dir)
    ranked = samples.attach_ranks(
        fuse.dedup_responses(fuse.response_rows(normalized)), fuse.rank_rows(normalized)
    )
    return ranked.select(
        "input_key", "response_id", "rank", F.coalesce("rank", F.lit(0)).alias("rank_compat")
    )


# --- text and length path -----------------------------------------------------------------------


def _chat(df: DataFrame) -> DataFrame:
    return df.withColumn("chat", text.to_chat("question", "answer", "sys_prompt"))


@query
def to_chat(spark, sf_dir):
    flat = F.transform("chat", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return _chat(fx.chat_turns(spark, sf_dir)).select(
        "conv_id", "turn", F.size("chat").alias("n_turns"), F.array_join(flat, "|").alias("chat")
    )


@query
def render_chat(spark, sf_dir):
    return _chat(fx.chat_turns(spark, sf_dir)).select(
        "conv_id",
        "turn",
        text.render_chat("chat", "chatml").alias("chatml"),
        text.render_chat("chat", "plain", add_generation_prompt=True).alias("plain"),
        text.render_chat(text.to_chat("question", "answer"), "human_assistant").alias("human"),
    )


@query
def strip_bos(spark, sf_dir):
    rows = _chat(fx.chat_turns(spark, sf_dir))
    marked = F.concat(F.lit("<s>"), text.render_chat("chat", "plain"))
    return rows.select("conv_id", "turn", text.strip_bos(marked, "<s>").alias("text"))


@query
def count_tokens(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", text.count_tokens("text").alias("n_tokens")
    )


@query
def truncate_left(spark, sf_dir):
    kept = text.truncate_left(text.tokens("text"), MAX_TOKENS)
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(kept, " ").alias("tail"), F.size(kept).alias("n_kept")
    )


def _measured(spark, sf_dir):
    return fx.chat_samples(spark, sf_dir).withColumn("n_tokens", text.count_tokens("text"))


@query
def length_filter(spark, sf_dir):
    return lengths.length_filter(_measured(spark, sf_dir), MAX_TOKENS).select(
        "input_id", "output_id", "n_tokens"
    )


@query
def label_endpoint_filter(spark, sf_dir):
    kept = lengths.length_filter(_measured(spark, sf_dir), MAX_TOKENS)
    labels = fx.chat_labels(spark, sf_dir)
    return lengths.label_endpoint_filter(labels, kept, pairs.PAIR_KEY).drop("origin")


@query
def orphan_output_filter(spark, sf_dir):
    kept, _ = lengths.apply_length_path(
        _measured(spark, sf_dir), fx.chat_labels(spark, sf_dir), MAX_TOKENS, pairs.PAIR_KEY
    )
    return kept.select("input_id", "output_id", "n_tokens")


def _word_sizes():
    """A tokenizer in Python: the id of a word is its length less two."""
    return lambda texts: [[len(word) - 2 for word in re.split("[\t-\r ]+", text) if word] for text in texts]


def _length_path(spark, sf_dir, tokenizer, truncation):
    return lengths.apply_length_path(
        fx.chat_samples(spark, sf_dir),
        fx.chat_labels(spark, sf_dir),
        MAX_TOKENS,
        pairs.PAIR_KEY,
        truncation,
        tokenizer,
    )


def _word_sizes_column():
    return F.transform(text.tokens("text"), lambda word: F.length(word) - 2)


def _with_ids(kept):
    return kept.select("input_id", "output_id", "n_tokens", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"))


@query
def length_path_truncated(spark, sf_dir):
    kept, _ = _length_path(spark, sf_dir, _word_sizes, True)
    return _with_ids(kept)


@query
def length_path_truncated_column(spark, sf_dir):
    kept, _ = _length_path(spark, sf_dir, _word_sizes_column(), True)
    return _with_ids(kept)


@query
def length_path_dropped(spark, sf_dir):
    kept, _ = _length_path(spark, sf_dir, _word_sizes, False)
    return _with_ids(kept)


@query
def length_path_dropped_labels(spark, sf_dir):
    _, usable = _length_path(spark, sf_dir, _word_sizes, False)
    return usable.drop("origin")


# --- lines of JSON ------------------------------------------------------------------------------


def _line_records(spark, sf_dir):
    """Records of the lines that are whole, each with its document's id as its place."""
    read = jsonl.records_from_lines(fx.preference_lines(spark, sf_dir)).where(F.col(CORRUPT).isNull())
    place = F.struct(F.lit(0).alias("path"), F.lit(0).cast("long").alias("block"), F.col("doc_id").alias("row"))
    return read.withColumns({"origin": F.lit("lines"), "ord": place})


@query
def records_from_lines(spark, sf_dir):
    read = jsonl.records_from_lines(fx.preference_lines(spark, sf_dir))
    whole = F.col(CORRUPT).isNull()
    return read.select(
        "doc_id",
        whole.alias("whole"),
        F.when(whole, F.col("input")).alias("input"),
        F.when(whole, F.size("responses")).alias("n_responses"),
        F.when(whole, F.size("rank")).alias("n_ranks"),
        F.when(whole, F.element_at("annotations", 1)).alias("annotation"),
    )


@query
def invalid_lines(spark, sf_dir):
    return jsonl.invalid_records(fx.preference_lines(spark, sf_dir)).select("doc_id", "reason")


@query
def records_without_prompt(spark, sf_dir):
    return records.records_without_prompt(_line_records(spark, sf_dir)).select("doc_id")


@query
def invalid_ranks(spark, sf_dir):
    found = records.invalid_ranks(records.normalize_records(_line_records(spark, sf_dir)))
    return found.select("input_key", "response_id", "rank_text")


@query
def unknown_rank_ids(spark, sf_dir):
    normalized = records.normalize_records(_line_records(spark, sf_dir))
    fused = fuse.fuse_by_prompt(normalized)
    return fuse.unknown_rank_ids(fused.ranks, fused.responses).select("input_key", "response_id")


@query
def scores_to_samples(spark, sf_dir):
    every = fx.line_samples(spark, sf_dir)
    scores = every.where("output_id % 2 = 0").select("origin", "input_id", "output_id", "reward")
    joined = scoring.scores_to_samples(every.drop("reward"), scores)
    return _round(joined.select("origin", "input_id", "output_id", "reward"), "reward")


@query
def question_answer(spark, sf_dir):
    question, answer = text.question_answer("question", "answer")
    return fx.chat_turns(spark, sf_dir).select("conv_id", "turn", question, answer)


# --- judge path ---------------------------------------------------------------------------------


def _judge_rows(spark, sf_dir):
    rows = fx.ranked_documents(spark, sf_dir).withColumn("question", F.col("input"))
    return pairs.judge_pairs(rows, ["origin", "input"])


def _pair_coin():
    return F.concat_ws(":", "origin", "question", "id_a", "id_b")


@query
def judge_pairs(spark, sf_dir):
    return _judge_rows(spark, sf_dir).select(
        "origin", "category", "question", "id_a", "id_b", "answer_a", "answer_b", "preference"
    )


@query
def swap_positions(spark, sf_dir):
    swapped = pairs.swap_positions(_judge_rows(spark, sf_dir), _pair_coin())
    return swapped.select(
        "question",
        "id_a",
        "id_b",
        F.md5("answer_a").alias("answer_a_md5"),
        F.md5("answer_b").alias("answer_b_md5"),
        "preference",
    )


@query
def render_judge_prompts_all(spark, sf_dir):
    """Every style over every chat turn: the two 'answers' are the reply and the question."""
    prompts = [
        F.struct(
            F.lit(style).alias("style"),
            render_judge_prompts("question", "answer", "question", style).alias("prompt"),
        )
        for style in JUDGE_STYLES
    ]
    return fx.chat_turns(spark, sf_dir).select("conv_id", "turn", F.inline(F.array(*prompts)))


def _verdicts(style, column="judge_text", **options):
    def run(spark, sf_dir):
        return fx.judge_texts(spark, sf_dir).select(
            "event_id", verdict.parse_verdict(column, style, **options).alias("judgment")
        )

    return run


QUERIES["parse_verdict_bracket"] = _verdicts("bracket")
QUERIES["parse_verdict_exact_choice"] = _verdicts("exact_choice")
QUERIES["parse_verdict_letter"] = _verdicts("letter")
QUERIES["parse_verdict_json_choice"] = _verdicts("json_choice", "json_text", choice_key="k")


@query
def score_judgments(spark, sf_dir):
    judged = fx.judge_texts(spark, sf_dir).withColumn("judgment", verdict.parse_verdict("judge_text"))
    return judged.select("event_id", verdict.score_judgment("judgment", "preference").alias("score"))


@query
def judge_metrics(spark, sf_dir):
    judged = fx.judge_texts(spark, sf_dir).withColumn("judgment", verdict.parse_verdict("judge_text"))
    return _round(metrics.judge_metrics(judged), "value")


# --- batches ------------------------------------------------------------------------------------


@query
def epoch_order(spark, sf_dir):
    prompts = fx.table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("origin"), F.col("o_orderkey").alias("input_id")
    )
    return batching.epoch_order(prompts, SEED, EPOCH).select("input_id", "epoch_pos")


def _packed(spark, sf_dir):
    return batching.pack_batches(fx.line_samples(spark, sf_dir), BATCH, SEED, EPOCH)


@query
def pack_batches(spark, sf_dir):
    return _packed(spark, sf_dir)


@query
def pack_batches_greedy(spark, sf_dir):
    return batching.pack_batches_greedy(
        fx.line_samples(spark, sf_dir), fx.line_votes(spark, sf_dir), BATCH, SEED, EPOCH
    )


@query
def pack_batches_greedy_audit(spark, sf_dir):
    """Each sample once, batches full but the last, and no fewer pairs together than along the order."""
    samples_ = materialize(fx.line_samples(spark, sf_dir).select(*pairs.PAIR_KEY, "output_id"))
    votes = materialize(pairs.distinct_pairs(fx.line_votes(spark, sf_dir)))
    greedy = batching.pack_batches_greedy(samples_, votes, BATCH, SEED, EPOCH)
    packed = batching.pack_batches(samples_, BATCH, SEED, EPOCH)
    plain = batching.in_batch_pairs(packed, votes).agg(F.count("*")).scalar()
    audit = batching.packing_audit(greedy, votes, samples_, BATCH)
    return audit.withColumn("keeps_as_many", F.col("n_kept_pairs") >= plain).drop("n_kept_pairs")


@query
def pad_batch(spark, sf_dir):
    ids = fx.chat_token_ids(spark, sf_dir)
    batches = batching.pack_batches(ids, BATCH, SEED, EPOCH)
    rows = ids.join(batches, [*pairs.PAIR_KEY, "output_id"]).withColumn(
        "attention_mask", F.transform("input_ids", lambda x: F.lit(1))
    )
    padded = arrays.pad_batch(rows, ["batch_id"], ["input_ids", "attention_mask"])
    return padded.select(
        "batch_id",
        "slot",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), ",").alias("attention_mask"),
    )


@query
def sanitize_token_ids(spark, sf_dir):
    clean = arrays.sanitize_token_ids("input_ids", vocab_size=9, pad_id=0)
    return fx.chat_token_ids(spark, sf_dir).select(
        "input_id",
        "output_id",
        F.array_join(clean.cast("array<string>"), ",").alias("input_ids"),
        arrays.count_bad_token_ids("input_ids", 9).alias("n_replaced"),
    )


@query
def last_attended_index(spark, sf_dir):
    mask = F.transform("input_ids", lambda x: F.when(x % 3 != 0, 1).otherwise(0))
    return fx.chat_token_ids(spark, sf_dir).select(
        "input_id", "output_id", arrays.last_attended_index(mask).alias("last_index")
    )


@query
def in_batch_pairs(spark, sf_dir):
    return batching.in_batch_pairs(_packed(spark, sf_dir), fx.line_votes(spark, sf_dir))


@query
def pair_coverage(spark, sf_dir):
    return _round(
        batching.pair_coverage(_packed(spark, sf_dir), fx.line_votes(spark, sf_dir)), "coverage"
    )


@query
def expand_label_rows(spark, sf_dir):
    rows = batching.batch_rows(_packed(spark, sf_dir), fx.line_votes(spark, sf_dir))
    return arrays.expand_label_rows(rows)


@query
def group_samples(spark, sf_dir):
    """Per (batch, prompt): its outputs and labels as lists, bounded by the batch size."""
    groups = batching.group_samples(_packed(spark, sf_dir), fx.line_votes(spark, sf_dir))
    outputs = F.array_join(F.col("outputs").cast("array<string>"), ",")
    return groups.select("batch_id", *pairs.PAIR_KEY, outputs.alias("outputs"), F.size("labels").alias("n_labels"))


@query
def batch_loss(spark, sf_dir):
    rows = batching.batch_loss(
        _packed(spark, sf_dir), fx.line_votes(spark, sf_dir), fx.line_samples(spark, sf_dir), 0.1
    )
    return _round(rows, "bt_loss", "l2_penalty", "loss")


# --- scoring, evaluation ------------------------------------------------------------------------


def _python_length():
    def rewards(rows: pd.DataFrame) -> pd.Series:
        return rows["output"].str.len() / 1000.0

    return rewards


def _python_longer():
    def answers(rows: pd.DataFrame) -> pd.Series:
        longer = rows["answer_a"].str.len() >= rows["answer_b"].str.len()
        return longer.map({True: "so: [[A]]", False: "so: [[B]]"})

    return answers


def _scored(spark, sf_dir, scorer):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("output"))
    return scoring.score_responses(rows, scorer).select("doc_id", F.round("reward", 6).alias("reward"))


@query
def score_responses(spark, sf_dir):
    return _scored(spark, sf_dir, F.length("output") / 1000.0)


@query
def score_responses_python(spark, sf_dir):
    return _scored(spark, sf_dir, _python_length)


def _document_samples(spark, sf_dir):
    return fx.ranked_documents(spark, sf_dir).withColumn("input_id", F.md5("input"))


def _registry() -> Registry:
    known = Registry()
    known.register("length", Predictor(SCORE, F.length("output") / 1000.0))
    known.register("python_length", Predictor(SCORE, _python_length))
    longer = F.length("answer_a") >= F.length("answer_b")
    known.register(
        "longer", Predictor(JUDGE, F.when(longer, "so: [[A]]").otherwise("so: [[B]]"))
    )
    several = scoring.Calls(in_flight=4)
    known.register("python_longer", Predictor(JUDGE, _python_longer, calls=several))
    return known


def _evaluated(name):
    def run(spark, sf_dir):
        return _round(evaluation.evaluate(_document_samples(spark, sf_dir), name, _registry()), "value")

    return run


QUERIES["evaluate_scorer"] = _evaluated("length")
QUERIES["evaluate_python_scorer"] = _evaluated("python_length")
QUERIES["evaluate_judge"] = _evaluated("longer")
QUERIES["evaluate_python_judge"] = _evaluated("python_longer")


# --- head, checkpoints --------------------------------------------------------------------------


@query
def linear_reward(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(head.linear_reward("embedding", HEAD_WEIGHTS), 6).alias("reward")
    )


def _fitted_head(spark, sf_dir):
    return head.fit_linear_reward_head(fx.feature_pairs(spark, sf_dir), reg_coef=0.01)


@query
def fit_linear_reward_head(spark, sf_dir):
    fit = _fitted_head(spark, sf_dir)
    reward = {f"{side}_reward": fit.column(f"{side}_features") for side in ("chosen", "rejected")}
    scored = fx.feature_pairs(spark, sf_dir).withColumns(reward).withColumn("origin", F.lit("head"))
    return _round(metrics.bradley_terry_loss(scored), "bt_loss")


@query
def linear_head_audit(spark, sf_dir):
    """The fit ends where the gradient vanishes, below the loss of equal rewards, on every pair once;
    the loss found again from the rewards is the loss of the fit."""
    fit = _fitted_head(spark, sf_dir)
    pairs_ = fx.feature_pairs(spark, sf_dir)
    margin = fit.column("chosen_features") - fit.column("rejected_features")
    loss = F.avg(metrics.neg_log_sigmoid(margin))
    return pairs_.agg(
        F.count("*").alias("n_pairs"),
        (F.count("*") == fit.n_pairs).alias("every_pair_once"),
        F.lit(fit.gradient < 1e-6).alias("settled"),
        (loss < math.log(2)).alias("below_chance"),
        (F.abs(loss - fit.bt_loss) < 1e-9).alias("same_loss"),
    )


@query
def feature_pairs(spark, sf_dir):
    return fx.feature_pairs(spark, sf_dir).select("k", "chosen_vec", "rejected_vec")


@query
def best_checkpoint(spark, sf_dir):
    return head.best_checkpoint(fx.evaluation_history(spark, sf_dir))


@query
def checkpoint_walk(spark, sf_dir):
    return head.checkpoint_walk(fx.evaluation_history(spark, sf_dir))
