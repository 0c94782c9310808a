"""Text as column expressions: ids, chat rendering, token counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace at both ends in the Unicode sense, plus the four ASCII separators.
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

TURN_TYPE = "array<struct<role:string,content:string>>"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def content_id(text: Column | str) -> Column:
    """md5 of the UTF-8 text, in hex."""
    return F.md5(_col(text))


def strip(text: Column | str) -> Column:
    """Remove all Unicode whitespace at both ends (``btrim`` removes spaces only)."""
    return F.regexp_replace(_col(text), _STRIP, "")


def strip_bos(text: Column | str, bos: str) -> Column:
    """Remove the begin-of-text token wherever it occurs."""
    return F.replace(_col(text), F.lit(bos), F.lit("")) if bos else _col(text)


def turn(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), _col(content).alias("content"))


def to_chat(
    source: Column | str,
    output: Column | str | None = None,
    sys_prompt: Column | str | None = None,
    is_conversation: bool = False,
) -> Column:
    """System prompt (if any), then the input text or conversation, then the output (if any)."""
    turns = _col(source) if is_conversation else F.array(turn("user", source))
    chat = turns.cast(TURN_TYPE)
    none = F.array().cast(TURN_TYPE)
    if output is not None:
        answer = F.array(turn("assistant", output)).cast(TURN_TYPE)
        chat = F.concat(chat, F.when(_col(output).isNotNull(), answer).otherwise(none))
    if sys_prompt is not None:
        system = F.array(turn("system", sys_prompt)).cast(TURN_TYPE)
        chat = F.concat(F.when(_col(sys_prompt).isNotNull(), system).otherwise(none), chat)
    return chat


@dataclass(frozen=True)
class ChatTemplate:
    """How one turn is written: ``before[role] + content + after``."""

    before: dict[str, str]
    after: str = ""
    generation_prompt: str = ""
    other: str = field(default="")  # prefix of a role that is not listed


CHAT_TEMPLATES: dict[str, ChatTemplate] = {
    "chatml": ChatTemplate(
        before={
            "system": "<|im_start|>system\n",
            "user": "<|im_start|>user\n",
            "assistant": "<|im_start|>assistant\n",
        },
        after="<|im_end|>\n",
        generation_prompt="<|im_start|>assistant\n",
    ),
    "plain": ChatTemplate(
        before={"system": "system: ", "user": "user: ", "assistant": "assistant: "},
        after="\n",
        generation_prompt="assistant: ",
    ),
    # The two role marks of this style.
    "human_assistant": ChatTemplate(before={"user": "Human:", "assistant": "\n\nAssistant:"}),
}


def render_chat(
    chat: Column | str,
    template: str | ChatTemplate = "chatml",
    add_generation_prompt: bool = False,
    do_strip: bool = True,
) -> Column:
    """A conversation as one text."""
    style = CHAT_TEMPLATES[template] if isinstance(template, str) else template

    def write(message: Column) -> Column:
        prefix = F.lit(style.other)
        for role, before in style.before.items():
            prefix = F.when(message["role"] == role, before).otherwise(prefix)
        return F.concat(prefix, message["content"], F.lit(style.after))

    text = F.array_join(F.transform(_col(chat), write), "")
    if add_generation_prompt and style.generation_prompt:
        text = F.concat(text, F.lit(style.generation_prompt))
    return strip(text) if do_strip else text


def question_answer(source: Column | str, output: Column | str) -> tuple[Column, Column]:
    """The style that keeps question and answer as two text columns."""
    return _col(source).alias("question"), _col(output).alias("answer")


def tokens(text: Column | str, pattern: str = r"\s+") -> Column:
    """Default tokenizer: split on whitespace. The token array of an empty text is empty."""
    return F.filter(F.split(_col(text), pattern), lambda token: token != "")


def count_tokens(
    text: Column | str, tokenizer: Callable[[Column], Column] | None = None
) -> Column:
    """Token count. ``tokenizer`` maps a text column to a token array (built-in functions or a
    ``pandas_udf``); the default splits on whitespace."""
    return F.size((tokenizer or tokens)(_col(text)))


def truncate_left(token_array: Column | str, max_length: int) -> Column:
    """The last ``max_length`` tokens."""
    array = _col(token_array)
    start = F.greatest(F.size(array) - F.lit(max_length - 1), F.lit(1))
    return F.slice(array, start, F.lit(max_length))
