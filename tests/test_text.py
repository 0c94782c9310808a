"""Text, verdict and array expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prefdeck.functions import arrays, prompts, text, verdict
from prefdeck.operators import pairs


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def column(df, expression):
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_strip_removes_all_unicode_whitespace(spark):
    values = ["  a b\n", "　a ", "\x1ca\x1f", "\t\n", "a", "​a"]
    assert column(texts(spark, values), text.strip("t")) == [v.strip() for v in values]


@pytest.mark.parametrize(
    "judgment, expected",
    [
        ('{"k": 1}', "A"), ('{"k": "2"}', "B"), ('{"k": 1.7}', "A"), ('{"k": true}', "A"),
        (' 　{"k": 2}\n', "B"), ('{"k": " 1 "}', "A"), ('{"k": 1e0}', "A"), ('{"k": 2.0}', "B"),
        ('{"k": "1.0"}', "error"), ('{"k": 1} tail', "error"), ("{'k': 1}", "error"),
        ('[{"k": 1}]', "error"), ('{"k": 3}', "error"), ('{"k": null}', "error"),
        ('{"k": 1}{"k": 2}', "error"), ('{"k": 1},{"k": 2}', "error"), ('{"j": 1}', "error"),
        ('{"k": {"k": 1}}', "error"), ('{"k": false}', "error"), ('{"k": "+1"}', "A"),
        ('{"k": -1}', "error"), ('{"k": 1e400}', "error"), ("", "error"), (None, "error"), ("1", "error"),
        ('{"k": 2, "k": 1}', "A"), ('{"k": 1, "k": 3}', "error"), ('{"r": {"x": 1, "x": 2}, "k": 2}', "B"),
        ('{"k": "１"}', "A"), ('{"k": "٢"}', "B"), ('{"k": "𝟐"}', "B"), ('{"k": １}', "error"), ('{"k": "²"}', "error"),
        ('{"k": 1}}, {"k": 2}', "error"), ('{"k": 1}],[{}', "error"),
        ('{"x": NaN, "k": 1}', "A"), ('{"x": [-Infinity, Infinity], "k": 2}', "B"), ('{"k": NaN}', "error"),
        ('{"k": 1, "k": Infinity}', "error"), ('{"k": -NaN}', "error"), ('{"k": 1NaN}', "error"), ('{"NaN": 0, "k": 1}', "A"),
        ('{"x": "a \\" NaN \\\\", "y": NaN, "k": 2}', "B"), ('{"x": nan, "k": 1}', "error"), ('{NaN: 0, "k": 1}', "error"),
        ('{"k": "1", "x": "Infinity"}', "A"), ('{"k": "NaN"}', "error"), ('{"x": NaNs, "k": 1}', "error"),
        ('{"k": 99999999999999999999}', "error"), ('{"k": "99999999999999999999"}', "error"),
    ],
)
def test_json_verdict(spark, judgment, expected):
    df = texts(spark, [judgment])
    assert column(df, verdict.parse_verdict("t", "json_choice", choice_key="k")) == [expected]


def test_json_verdict_default_key(spark):
    df = texts(spark, ['{"原因": "好", "更好的回答": 2}'])
    assert column(df, verdict.parse_verdict("t", "json_choice")) == ["B"]


def test_other_verdict_styles(spark):
    df = texts(spark, ["[[B]] then [[A]]", "so [[B]]", "none", "Output (b)", " Output (b)", "pick A 　", None])
    assert column(df, verdict.parse_verdict("t", "bracket")) == ["A", "B", *["error"] * 5]
    assert column(df, verdict.parse_verdict("t", "exact_choice")) == [*["error"] * 3, "B", *["error"] * 3]
    assert column(df, verdict.parse_verdict("t", "letter"))[5:] == ["A", "error"]
    with pytest.raises(ValueError):
        verdict.parse_verdict("t", "no such style")


def test_chat_with_and_without_system_prompt(spark):
    df = spark.createDataFrame([(0, "q", "a", "s"), (1, "q", "a", None), (2, "q", None, None)], "i int, q string, a string, s string")
    chat = text.to_chat("q", "a", "s")
    roles = F.transform(chat, lambda m: m["role"])
    assert column(df, roles) == [["system", "user", "assistant"], ["user", "assistant"], ["user"]]
    assert column(df, text.render_chat(chat, "human_assistant"))[1] == "Human:q\n\nAssistant:a"
    assert column(df, text.render_chat(chat, "plain", add_generation_prompt=True, do_strip=False))[2] == "user: q\nassistant: "


def test_conversation_input_is_extended(spark):
    df = spark.sql("SELECT 0 AS i, array(named_struct('role', 'user', 'content', 'q')) AS c, 'a' AS a")
    chat = text.to_chat("c", "a", is_conversation=True)
    assert column(df, text.render_chat(chat, "plain")) == ["user: q\nassistant: a"]


def test_tokens_and_left_truncation(spark):
    df = texts(spark, ["", "  ", " a b  c ", "one"])
    assert column(df, text.count_tokens("t")) == [0, 0, 3, 1]
    assert column(df, text.count_tokens("t", lambda c: F.split(c, ""))) [3] == 3
    assert column(df, text.truncate_left(text.tokens("t"), 2)) == [[], [], ["b", "c"], ["one"]]


@pytest.mark.parametrize("style", sorted(prompts.JUDGE_STYLES))
def test_each_judge_prompt_holds_its_own_texts(spark, style):
    df = spark.createDataFrame([(0, "q0", "a0", "b0"), (1, "q1", "a1", "b1")], "i int, q string, a string, b string")
    rendered = column(df, prompts.render_judge_prompts("q", "a", "b", style))
    for n, one in enumerate(rendered):
        places = [one.index(f"{name}{n}") for name in "qab"]
        assert places == sorted(places) and f"q{1 - n}" not in one
        assert one.endswith("<|im_start|>assistant\n")


def test_swapping_twice_is_the_identity_and_about_half_swap(spark):
    df = spark.range(1000).selectExpr(
        "id", "concat('a', id) AS answer_a", "concat('b', id) AS answer_b", "if(id % 3 = 0, 'A', 'B') AS preference"
    )
    key = F.col("id").cast("string")
    once = pairs.swap_positions(df, key)
    n = once.where("answer_a LIKE 'b%'").count()
    assert 400 < n < 600
    assert sorted(pairs.swap_positions(once, key).collect()) == sorted(df.collect())
    gold = once.where("(preference = 'A') = (id % 3 = 0) AND answer_a LIKE 'b%'").count()
    assert gold == 0


def test_arrays(spark):
    df = spark.sql("SELECT 0 AS i, array(5, -1, 99, 0) AS ids, array(0, 2, 1, 0) AS mask, array(0, 0) AS none")
    assert column(df, arrays.sanitize_token_ids("ids", 50, 7)) == [[5, 7, 7, 0]]
    assert column(df, arrays.count_bad_token_ids("ids", 50)) == [2]
    assert column(df, arrays.last_attended_index("mask")) == [2]
    assert column(df, arrays.last_attended_index("none")) == [None]


def test_padding_is_on_the_left_and_per_batch(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, array(7), array(5), array(named_struct('chosen_id', 0, 'rejected_id', 1))),
           (1, array(1, 2, 3), array(6, 6), array()), (2, array(4), array(3), array())
           AS t(batch_id, input_ids, extra, labels)"""
    ).withColumn("labels", F.col("labels").cast(arrays.LABEL_TYPE))
    rows = arrays.pad_batch(df, ["batch_id"], ["input_ids"], ["extra"], "labels").collect()
    got = sorted((r.batch_id, r.input_ids, r.extra, [tuple(p) for p in r.labels]) for r in rows)
    assert got == [
        (1, [0, 0, 7], [-100, 5], [(0, 1)]),
        (1, [1, 2, 3], [6, 6], [(-100, -100)]),
        (2, [4], [3], [(-100, -100)]),
    ]
