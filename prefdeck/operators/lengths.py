"""The length path: cut over-long samples on the left, or drop them and then labels and samples left
without a partner."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefdeck.functions.text import truncate_left
from prefdeck.operators.scoring import map_batches
from prefdeck.operators.skew import keyed
from prefdeck.session import materialize

# A tokenizer is a Column with the token ids, or a factory that builds its state (a vocabulary) once per
# worker process and returns a function from a list of texts to one sequence of ids per text.
TokenizerFactory = Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]
IDS = T.ArrayType(T.IntegerType())
TEXTS_PER_CALL = 256


def _last_ids(factory: TokenizerFactory, text: str, most: int | None) -> Callable:
    """A factory for ``map_batches``: the last ``most`` ids of each text, NULL for a NULL text."""

    def build() -> Callable[[pd.DataFrame], list]:
        encode = factory()

        def ids(rows: pd.DataFrame) -> list:
            found = iter(encode([value for value in rows[text] if value is not None]))
            whole = [None if value is None else list(next(found)) for value in rows[text]]
            return whole if most is None else [one and one[-most:] for one in whole]

        return ids

    return build


def tokenize(
    samples: DataFrame,
    tokenizer: Column | TokenizerFactory,
    text: str = "text",
    max_length: int | None = None,
    truncation: bool = False,
    keep: Sequence[str] | None = None,
    state: str | None = None,
) -> DataFrame:
    """The columns ``keep`` (all but ``text`` by default) with ``input_ids`` and ``n_tokens``.

    With ``truncation`` the last ``max_length`` ids stay. Without, a text of more ids than that has its
    last ``max_length + 1``, enough to be told apart by :func:`length_filter`; so no more than these
    leave the tokenizer, however long the text. A NULL text has NULL in both columns.
    """
    if max_length is not None and max_length < 1:
        raise ValueError(f"max_length is {max_length}")
    kept = [c for c in samples.columns if c not in (text, "input_ids", "n_tokens")] if keep is None else list(keep)
    most = None if max_length is None else max_length if truncation else max_length + 1
    if isinstance(tokenizer, Column):
        ids = tokenizer.cast(IDS)
        found = samples.select(*kept, (ids if most is None else truncate_left(ids, most)).alias("input_ids"))
    else:
        asked = samples.select(*dict.fromkeys([*kept, text]))
        found = map_batches(
            asked, "input_ids", IDS, _last_ids(tokenizer, text, most), TEXTS_PER_CALL, kept, state, None, None
        )
    return found.withColumn("n_tokens", F.size("input_ids"))


def length_filter(samples: DataFrame, max_length: int, n_tokens: str = "n_tokens") -> DataFrame:
    return samples.where(F.col(n_tokens) <= max_length)


def _endpoint(samples: DataFrame, name: str, key: list[str]) -> DataFrame:
    return keyed(samples, [*key, "output_id"]).select(*key, F.col("output_id").alias(name))


def label_endpoint_filter(labels: DataFrame, samples: DataFrame, key: list[str]) -> DataFrame:
    """Labels whose two endpoints both survive and differ. Identical answers go here."""
    return (
        labels.where(F.col("chosen_id") != F.col("rejected_id"))
        .join(_endpoint(samples, "chosen_id", key), [*key, "chosen_id"], "left_semi")
        .join(_endpoint(samples, "rejected_id", key), [*key, "rejected_id"], "left_semi")
    )


def orphan_output_filter(samples: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Samples that still occur in some label; a prompt left without labels vanishes.

    The endpoints are made distinct before the join, so an output named by millions of labels is
    one row there.
    """
    ends = labels.select(
        *key, F.explode(F.array("chosen_id", "rejected_id")).alias("output_id")
    ).distinct()
    return samples.join(ends, [*key, "output_id"], "left_semi")


def apply_length_path(
    samples: DataFrame,
    labels: DataFrame,
    max_length: int | None,
    key: list[str],
    truncation: bool = False,
    tokenizer: Column | TokenizerFactory | None = None,
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Samples and labels that fit ``max_length``; without one nothing is dropped.

    ``tokenizer`` adds ``input_ids`` and ``n_tokens`` (see :func:`tokenize`) in place of ``text``; a
    factory runs once, its ids written to the checkpoint folder before the filters read them in several
    branches. Without a tokenizer the samples bring ``n_tokens``, and for truncation ``input_ids``. With
    ``truncation`` ids are cut on the left, and no sample or label goes. Otherwise the three filters
    follow in order.
    """
    if tokenizer is not None:
        samples = tokenize(samples, tokenizer, text, max_length, truncation)
    elif truncation and max_length is not None:
        cut = truncate_left("input_ids", max_length)
        samples = samples.withColumn("input_ids", cut).withColumn("n_tokens", F.size("input_ids"))
    if max_length is None or truncation:
        return samples, labels
    kept = length_filter(samples, max_length)
    if callable(tokenizer) and not isinstance(tokenizer, Column):
        kept = materialize(kept)
    usable = label_endpoint_filter(labels, kept, key)
    return orphan_output_filter(kept, usable, key), usable
