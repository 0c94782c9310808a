"""Judge prompts: one conversation per pair, and its rendered text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefdeck.functions.text import TURN_TYPE, ChatTemplate, render_chat
from prefdeck.functions.verdict import (
    BRACKET_MARKS,
    EXACT_CHOICES,
    JSON_CHOICE_KEY,
    JSON_REASON_KEY,
)

# A turn is (role, parts); a part is literal text or one of the three column slots.
QUESTION, FIRST, SECOND = "{question}", "{first}", "{second}"

_A, _B = BRACKET_MARKS
_OUT_A, _OUT_B = EXACT_CHOICES
_BOTH_ANSWERS = [
    "\n\n<question>\n", QUESTION, "\n</question>\n\n<answer_of_A>\n", FIRST,
    "\n</answer_of_A>\n\n<answer_of_B>\n", SECOND, "\n</answer_of_B>",
]

JUDGE_STYLES: dict[str, list[tuple[str, list[str]]]] = {
    "bracket": [
        (
            "user",
            [
                "Two assistants, A and B, replied to the same question. Decide fairly which reply "
                "serves the person who asked better. Neither the order nor the length of the "
                f"replies may count. End with {_A} if A is better or {_B} if B is better.",
                *_BOTH_ANSWERS,
            ],
        )
    ],
    "bracket_explain": [
        (
            "system",
            [
                "You compare two replies to a question without favour. Weigh correctness, use, "
                "depth and clarity; ignore order, length and names. Explain your view in a few "
                f"sentences first, then close with {_A} for A or {_B} for B.",
            ],
        ),
        ("user", ["Compare the replies below.", *_BOTH_ANSWERS]),
    ],
    "json_choice": [
        ("system", [""]),
        (
            "user",
            [
                "请比较同一个问题的两个回答，判断哪一个更准确、更完整、更通顺。只输出一个JSON对象，"
                f'键"{JSON_REASON_KEY}"写明理由，键"{JSON_CHOICE_KEY}"写整数1或2。\n\n问题：',
                QUESTION, "\n\n第一个回答：", FIRST, "\n\n第二个回答：", SECOND,
            ],
        ),
    ],
    "exact_choice": [
        (
            "user",
            [
                "Which of two outputs follows the instruction better? Look at whether it does what "
                "was asked, no more and no less, then at its quality; the order means nothing. "
                f"Reply with exactly {_OUT_A} or exactly {_OUT_B} and not one word more.\n\n"
                "Instruction:\n",
                QUESTION, f"\n\n{_OUT_A}:\n", FIRST, f"\n\n{_OUT_B}:\n", SECOND,
            ],
        )
    ],
    "letter": [
        (
            "user",
            [
                "Below, assistants A and B answer one user. Name the better assistant with a "
                "single letter, A or B, and write nothing else.\n\nUser: ",
                QUESTION, "\nAssistant A: ", FIRST, "\nAssistant B: ", SECOND,
            ],
        )
    ],
}


def judge_conversation(
    question: Column | str, answer_a: Column | str, answer_b: Column | str, style: str
) -> Column:
    """The turns put to the judge. Every row gets its own texts."""
    if style not in JUDGE_STYLES:
        raise ValueError(f"unknown judge style {style!r}; known: {sorted(JUDGE_STYLES)}")
    slots = {QUESTION: question, FIRST: answer_a, SECOND: answer_b}

    def part(text: str) -> Column:
        column = slots.get(text, F.lit(text))
        return F.col(column) if isinstance(column, str) else column

    turns = [
        F.struct(
            F.lit(role).alias("role"), F.concat(*[part(text) for text in parts]).alias("content")
        )
        for role, parts in JUDGE_STYLES[style]
    ]
    return F.array(*turns).cast(TURN_TYPE)


def render_judge_prompts(
    question: Column | str,
    answer_a: Column | str,
    answer_b: Column | str,
    style: str = "bracket",
    template: str | ChatTemplate = "chatml",
) -> Column:
    """The whole prompt as one text that ends with the cue for the judge's turn."""
    return render_chat(
        judge_conversation(question, answer_a, answer_b, style),
        template,
        add_generation_prompt=True,
        do_strip=False,
    )
