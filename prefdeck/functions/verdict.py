"""Reading a verdict from raw judge text: 'A', 'B' or 'error', as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefdeck.functions.text import strip

# The marks each answer format asks for.
BRACKET_MARKS = ("[[A]]", "[[B]]")
EXACT_CHOICES = ("Output (a)", "Output (b)")
JSON_REASON_KEY = "原因"
JSON_CHOICE_KEY = "更好的回答"


# All decimal digits beyond ASCII, in the order of their code points, and the ASCII digits they stand for.
OTHER_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode)) if unicodedata.category(c) == "Nd")
SAME_DIGITS = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def _verdict(is_a: Column, is_b: Column) -> Column:
    """A wins over B when both hold; NULL text is an error."""
    return F.when(is_a, F.lit("A")).when(is_b, F.lit("B")).otherwise(F.lit("error"))


def _bracket(text: Column) -> Column:
    return _verdict(*[F.contains(text, F.lit(mark)) for mark in BRACKET_MARKS])


def _exact_choice(text: Column) -> Column:
    return _verdict(*[text == choice for choice in EXACT_CHOICES])


def _letter(text: Column) -> Column:
    lowered = F.lower(strip(text))
    return _verdict(lowered.endswith("a"), lowered.endswith("b"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chosen_number(found: Column) -> Column:
    """The integer a JSON value of ``(kind, as_text)`` stands for: numbers are cut towards zero,
    booleans are 0 or 1, strings must be integer literals in decimal digits of any script; NULL otherwise."""
    kind, as_text = found["kind"], found["as_text"]
    ascii_text = F.translate(strip(as_text), OTHER_DIGITS, SAME_DIGITS)
    literal = F.regexp_extract(ascii_text, r"^(?:[+-]?[0-9]+(?:_[0-9]+)*)$", 0)
    number = as_text.try_cast("double")
    return (
        F.when(kind == "BOOLEAN", F.when(as_text == "true", 1).otherwise(0))
        .when(kind == "STRING", F.replace(literal, F.lit("_"), F.lit("")).try_cast("bigint"))
        .when(
            (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
            F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)),
        )
    )


def _finite(text: Column) -> Column:
    """JSON text with 0 for NaN, Infinity and -Infinity outside of strings, so that a strict parser reads it;
    none of the four is a choice. Escaped backslashes and quotes are spelled as code points first, after
    which every other piece between quotes is outside."""
    spelled = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    word = r"(?<![\w.+-])(?:NaN|-?Infinity)(?![\w.+-])"
    pieces = F.transform(
        F.split(spelled, '"', -1),
        lambda piece, i: F.when(i % 2 == 0, F.regexp_replace(piece, word, "0")).otherwise(piece),
    )
    return F.when(text.rlike("NaN|Infinity"), F.array_join(pieces, '"')).otherwise(text)


def _json_choice(text: Column, key: str) -> Column:
    path = f"$.v['{key}']"

    def read(trimmed: Column) -> Column:
        # The parser takes text after the first value, so the text is parsed as a field and as the
        # only element of a list; it passes both only if it is exactly one value.
        element = F.try_parse_json(F.concat(F.lit("["), trimmed, F.lit("]")))
        field = F.try_parse_json(F.concat(F.lit('{"v":'), trimmed, F.lit("}")))
        one_value = _once(
            element,
            lambda v: F.try_variant_get(v, "$[0]", "variant").isNotNull()
            & F.try_variant_get(v, "$[1]", "variant").isNull(),
        )
        found = _once(
            F.try_variant_get(field, path, "variant"),
            lambda v: F.struct(
                F.schema_of_variant(v).alias("kind"),
                F.try_variant_get(v, "$", "string").alias("as_text"),
            ),
        )
        choice = _once(found, _chosen_number)
        verdict = _once(choice, lambda n: _verdict(n == 1, n == 2))
        is_object = trimmed.startswith("{") & trimmed.endswith("}")
        return F.when(is_object, F.when(one_value, verdict))

    return F.coalesce(_once(_once(strip(text), _finite), read), F.lit("error"))


VERDICT_STYLES = ("bracket", "bracket_explain", "json_choice", "exact_choice", "letter")


def parse_verdict(
    text: Column | str, style: str = "bracket", choice_key: str = JSON_CHOICE_KEY
) -> Column:
    """The verdict in ``text`` under the answer format ``style``.

    ``json_choice`` wants one JSON object and nothing else. Of equal keys the last one counts, in a
    session that :func:`prefdeck.configure` has set up; without its settings they are an error.
    """
    column = F.col(text) if isinstance(text, str) else text
    if style in ("bracket", "bracket_explain"):
        return _bracket(column)
    if style == "json_choice":
        return _json_choice(column, choice_key)
    if style == "exact_choice":
        return _exact_choice(column)
    if style == "letter":
        return _letter(column)
    raise ValueError(f"unknown verdict style {style!r}; known: {VERDICT_STYLES}")


def score_judgment(judgment: Column | str, preference: Column | str) -> Column:
    """1 if the judgment names the preferred side, else 0 (so 'error' is wrong)."""
    judgment = F.col(judgment) if isinstance(judgment, str) else judgment
    preference = F.col(preference) if isinstance(preference, str) else preference
    return F.when(judgment == preference, 1).otherwise(0)
