"""Preference data derived from the test tables.

Every view covers its whole tables and grows with them in step; no prompt collects more rows just
because there is more data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefdeck.functions.text import content_id, tokens
from prefdeck.operators.pairs import coin, dedup_scores
from prefdeck.operators.records import normalize_records
from prefdeck.operators.skew import dense_index
from prefdeck.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- F1: order lines as ranked and scored responses to their order ------------------------------


def ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a response. ``output_id`` is not unique; ``reward_tied`` has many ties."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("status_"), "o_orderstatus").alias("origin"),
        F.col("o_orderpriority").alias("category"),
        F.col("l_orderkey").alias("input_id"),
        (F.col("l_linenumber") - 1).alias("output_id"),
        (F.floor((F.col("l_quantity") - 1) / 10).cast("int") + 1).alias("rank"),
        (F.col("l_extendedprice") / 10000.0).alias("reward"),
        F.col("l_discount").alias("reward_tied"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("line_order"),
    )


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per (order, line number): the last one."""
    return dedup_scores(
        ranked_lines(spark, sf_dir), F.col("line_order"), carry=["rank", "reward_tied"]
    )


def line_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes between lines with neighbouring numbers: the lower rank is chosen.

    Line numbers repeat, so the same vote comes up several times and contradicting ones exist.
    """
    rows = ranked_lines(spark, sf_dir).select("origin", "input_id", "output_id", "rank")
    after = rows.select(
        "origin",
        "input_id",
        (F.col("output_id") - 1).alias("output_id"),
        F.col("rank").alias("next_rank"),
    )
    better = F.col("rank") < F.col("next_rank")
    both = rows.join(after, ["origin", "input_id", "output_id"]).where(
        F.col("rank") != F.col("next_rank")
    )
    return both.select(
        "origin",
        "input_id",
        F.when(better, F.col("output_id")).otherwise(F.col("output_id") + 1).alias("chosen_id"),
        F.when(better, F.col("output_id") + 1).otherwise(F.col("output_id")).alias("rejected_id"),
    )


# --- F2: documents as preference records --------------------------------------------------------


def _document_prompt():
    batch = F.floor(F.col("doc_id") / 1000).cast("string")
    return F.concat_ws("/", "lang", "source", batch)


# Document ids per chunk of _with_following.
_CHUNK = 64


def _with_following(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Every row beside each row whose ``doc_id`` is one more, with the columns ``names`` of that one under
    new names, or NULLs if there is none: a left join of the table with itself, but texts are shuffled
    once. Rows meet in chunks of ids; those that begin a chunk visit the one before as well."""
    own = F.floor(F.col("doc_id") / _CHUNK)
    begins = F.pmod("doc_id", F.lit(_CHUNK)) == 0
    # Boxed before the shuffle, so that NULLs stay in the lists and no value is moved boxed and plain. A list
    # per column, so that Spark moves only those that are used.
    boxed = rows.withColumns({f"_box_{old}": F.struct(old) for old in names}).drop(*names)
    chunked = boxed.withColumn("_chunk", F.explode(F.when(begins, F.array(own, own - 1)).otherwise(F.array(own))))
    following = Window.partitionBy("_chunk").orderBy("doc_id").rangeBetween(1, 1)
    lists = {f"_list_{new}": F.collect_list(f"_box_{old}").over(following) for old, new in names.items()}
    n = F.when(F.col("doc_id").isNotNull(), F.count("*").over(following))
    found = chunked.withColumns({**lists, "_n": n}).where(own.eqNullSafe(F.col("_chunk")))
    each = found.withColumn("_at", F.explode_outer(F.when(F.col("_n") > 0, F.sequence(F.lit(1).cast("long"), "_n"))))
    place = F.col("_at").cast("int") - 1
    kept = [c for c in rows.columns if c not in names]
    return each.select(
        *kept,
        *[F.col(f"_box_{old}")[old].alias(old) for old in names],
        *[F.get(F.col(f"_list_{new}"), place)[old].alias(new) for old, new in names.items()],
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its successor as one record, in four shapes by ``doc_id % 4``:
    flat pair, text-form annotation, full record with ids and ranks, flat pair under ``prompt``."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    rank = 1 + (1 - F.coalesce("quality", F.lit(0))) + F.coalesce("toxic", F.lit(0))
    # Ids come before the joins: what needs only them moves no text.
    ranked = (
        documents.withColumn("text_id", content_id("text"))
        .join(labels, "doc_id", "left")
        .withColumn("rank_no", rank.cast("string"))
    )
    following = _with_following(ranked, {"text": "next_text", "text_id": "next_id", "rank_no": "next_rank"})
    pairs = following.select(
        "doc_id",
        "lang",
        "source",
        _document_prompt().alias("prompt_text"),
        (F.col("doc_id") % 4).alias("shape"),
        F.col("text").alias("a"),
        F.coalesce("next_text", "text").alias("b"),
        F.col("text_id").alias("id_a"),
        F.coalesce("next_id", "text_id").alias("id_b"),
        F.col("rank_no").alias("rank_a"),
        F.coalesce("next_rank", "rank_no").alias("rank_b"),
        F.when(F.col("doc_id") % 50 == 0, "3")
        .when(coin(F.col("doc_id").cast("string")), "1")
        .otherwise("2")
        .alias("vote"),
    )
    shape = F.col("shape")
    flat, texts, full = shape == 0, shape == 1, shape == 2
    id_a, id_b = F.col("id_a"), F.col("id_b")
    text_form = F.to_json(
        F.struct(F.col("a").alias("answer1"), F.col("b").alias("answer2"), F.col("vote").alias("preference"))
    )
    id_form = F.to_json(F.array(id_a, id_b, F.col("vote")))
    responses = F.array(
        F.struct(id_a.alias("id"), F.col("a").alias("content")),
        F.struct(id_b.alias("id"), F.col("b").alias("content")),
    )
    ranks = F.when(id_a == id_b, F.create_map(id_a, F.col("rank_a"))).otherwise(
        F.map_from_arrays(F.array(id_a, id_b), F.array("rank_a", "rank_b"))
    )
    unkeyed = flat | (shape == 3)
    return pairs.select(
        F.lit("documents").alias("origin"),
        F.struct(
            F.lit(0).alias("path"),
            F.shiftright("doc_id", 16).alias("block"),
            F.col("doc_id").alias("row"),
        ).alias("ord"),
        F.when(flat | full, F.col("prompt_text")).alias("input"),
        F.when(~(flat | full), F.col("prompt_text")).alias("prompt"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("source "), "source")).alias("sys_prompt"),
        F.when(shape != 3, F.array("lang")).alias("category"),
        F.when(unkeyed, F.col("a")).alias("answer1"),
        F.when(unkeyed, F.col("b")).alias("answer2"),
        F.when(unkeyed, F.col("vote")).alias("preference"),
        F.when(full, responses).alias("responses"),
        F.when(texts, F.array(text_form)).when(full, F.array(id_form)).alias("annotations"),
        F.when(full, ranks).alias("rank"),
    )


def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_records(document_records(spark, sf_dir))


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as ranked responses, in the long form the judge and scorer paths read."""
    rank = (1 + (1 - F.col("quality")) + F.col("toxic")).cast("int")
    rows = (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select(
            F.concat(F.lit("docs_"), "lang").alias("origin"),
            F.col("lang").alias("category"),
            _document_prompt().alias("input"),
            F.floor(F.col("doc_id") / 1000).alias("batch"),
            F.col("doc_id"),
            F.col("doc_id").cast("string").alias("response_id"),
            rank.alias("rank"),
            F.col("text").alias("output"),
        )
    )
    slim = rows.select("origin", "input", "batch", "doc_id")
    placed = dense_index(
        slim, "rank_pos", order=["doc_id"], chunk=["batch"], keys=["origin", "input"]
    ).select("doc_id", F.col("rank_pos").cast("int").alias("rank_pos"))
    return rows.drop("batch").join(placed, "doc_id").withColumnRenamed("doc_id", "output_id")


# --- F2b: documents as lines of JSON -------------------------------------------------------------


def preference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a line of JSON ``value``. Some lines are cut off, have annotations that are no
    list, ranks that are no integer or name no response, or no prompt."""
    doc = F.col("doc_id")

    def quoted(value) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    text_id = doc.cast("string")
    prompt = F.concat(F.when(doc % 17 == 0, F.lit('"other"')).otherwise(F.lit('"input"')), F.lit(": "), quoted(F.concat_ws("/", "lang", "source")))
    response = F.concat(F.lit('"responses": [{"id": '), quoted(text_id), F.lit(', "content": '), quoted(F.md5("text")), F.lit("}]"))
    number = F.when(doc % 5 == 0, F.lit('"x"')).otherwise((doc % 3 + 1).cast("string"))
    ghost = F.when(doc % 13 == 0, F.lit(', "ghost": 1')).otherwise(F.lit(""))
    rank = F.concat(F.lit('"rank": {'), quoted(text_id), F.lit(": "), number, ghost, F.lit("}"))
    notes = F.when(doc % 11 == 0, F.lit('"annotations": {"answer1": "x"}')).otherwise(F.lit('"annotations": [["a", "b", "1"]]'))
    line = F.concat(F.lit("{"), F.concat_ws(", ", prompt, response, rank, notes), F.lit("}"))
    cut = F.when(doc % 7 == 0, F.substring(line, 1, 10)).otherwise(line)
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("value"))


# --- F3: conversations --------------------------------------------------------------------------


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn after it and the system prompt of the conversation."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replied = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    system = turns.where(F.col("role") == "system").select("conv_id", F.col("text").alias("sys_prompt"))
    return asked.join(replied, ["conv_id", "turn"]).join(system, "conv_id", "left")


def chat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.lit("chat").alias("origin"),
        F.col("conv_id").alias("input_id"),
        F.col("turn").cast("int").alias("output_id"),
        "text",
    )


def chat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vote between each turn and the next one of its conversation, decided by coin, and a vote of
    each turn against itself (identical answers)."""
    rows = chat_samples(spark, sf_dir).select("origin", "input_id", "output_id")
    after = rows.withColumn("output_id", F.col("output_id") - 1)
    flip = coin(F.concat_ws(":", "input_id", "output_id"))
    this, following = F.col("output_id"), F.col("output_id") + 1
    votes = rows.join(after, ["origin", "input_id", "output_id"]).select(
        "origin",
        "input_id",
        F.when(flip, this).otherwise(following).alias("chosen_id"),
        F.when(flip, following).otherwise(this).alias("rejected_id"),
    )
    same = rows.select(
        "origin", "input_id", this.alias("chosen_id"), this.alias("rejected_id")
    )
    return votes.unionByName(same)


def chat_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays: the id of a token is its length less two."""
    return chat_samples(spark, sf_dir).select(
        "origin",
        "input_id",
        "output_id",
        F.transform(tokens("text"), lambda t: F.length(t) - 2).alias("input_ids"),
    )


# --- F4, F5, F7: judge texts, feature pairs, evaluation history ---------------------------------


def judge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw judge output per event in every answer format, right and wrong."""
    kind = F.col("event_id") % 6
    plain = ["x [[A]]", "[[B]]", "[[B]] [[A]]", "none", "Output (a)", " b "]
    text = F.lit("Output (a)")
    for number, value in enumerate(plain):
        text = F.when(kind == number, value).otherwise(text)
    digit = (F.col("user_id") % 4).cast("string")
    json_kind = F.col("event_id") % 12
    wide_digit = F.translate(digit, "0123", "０１２３")
    forms = [
        F.col("props"),
        F.concat(F.lit('{"k": "'), digit, F.lit('"}')),
        F.concat(F.lit('  {"k": '), digit, F.lit("}\n")),
        F.concat(F.lit('{"k": '), digit, F.lit("} tail")),
        F.concat(F.lit("{'k': "), digit, F.lit("}")),
        F.concat(F.lit('{"k": '), digit, F.lit(".7}")),
        F.lit('{"k": true}'),
        F.concat(F.lit('[{"k": '), digit, F.lit("}]")),
        F.concat(F.lit('{"k": "'), digit, F.lit('.0"}')),
        F.concat(F.lit('{"k": 3, "k": '), digit, F.lit("}")),
        F.concat(F.lit('{"k": '), digit, F.lit('}{"k": '), digit, F.lit("}")),
        F.concat(F.lit('{"k": "'), wide_digit, F.lit('"}')),
    ]
    json_text = F.lit(None).cast("string")
    for number, form in enumerate(forms):
        json_text = F.when(json_kind == number, form).otherwise(json_text)
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("origin"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("question"),
        "event_id",
        text.alias("judge_text"),
        json_text.alias("json_text"),
        F.when(coin(F.col("event_id").cast("string")), "A").otherwise("B").alias("preference"),
    )


def _numbered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with label 5 or more are chosen; ``k`` numbers each side by ``vec_id``."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        (F.col("label") >= 5).alias("is_chosen"),
        F.shiftright("vec_id", 16).alias("chunk"),
    )
    numbered = dense_index(
        vectors.drop("embedding"), "k", order=["vec_id"], chunk=["chunk"], keys=["is_chosen"]
    ).select("vec_id", "k")
    return vectors.join(numbered, "vec_id")


def _sides(rows: DataFrame, *on) -> tuple[DataFrame, DataFrame]:
    chosen = rows.where("is_chosen").select(
        *on, F.col("vec_id").alias("chosen_vec"), F.col("embedding").alias("chosen_features")
    )
    rejected = rows.where("not is_chosen").select(
        *on, F.col("vec_id").alias("rejected_vec"), F.col("embedding").alias("rejected_features")
    )
    return chosen, rejected


def feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in a pair: the k-th of the larger side (label 5 or more, or less) against the
    (k modulo size)-th of the smaller one. With one side empty there are no pairs."""
    rows = _numbered_vectors(spark, sf_dir)
    sizes = table(spark, sf_dir, "embeddings").agg(
        F.least(F.count_if(F.col("label") >= 5), F.count_if(F.col("label") < 5)).alias("smaller")
    )
    smaller = sizes.select(F.when(F.col("smaller") > 0, F.col("smaller"))).scalar()
    chosen, rejected = _sides(rows.withColumn("place", F.col("k") % smaller), "place", "k")
    paired = chosen.join(rejected.withColumnRenamed("k", "other"), "place")
    return paired.withColumn("k", F.greatest("k", "other")).drop("place", "other")


def evaluation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per type and day, as the evaluations of a run."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("step"))
        .agg(F.round(F.avg("value"), 6).alias("value"))
    )
