"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefdeck.llm.common import batch, bounded_batches, concat_schema, map_arrow, stored, text_column

# Letters that look like a Latin letter, and digits and signs that stand for one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i",
    "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r",
    "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ϲ": "c",
    "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

# A word is listed if its log-likelihood ratio reaches this (chance: about one in 10^6), and if so
# many of its uses are toxic.
SURPRISE, PRECISION = 24.0, 0.8
LENGTH_WEIGHT = 0.25  # how much a text's length dampens its matches

_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_GLYPHS = str.maketrans(HOMOGLYPHS)
# A digit or sign is a letter only where it touches one.
_CODED = re.compile(r"(?<![a-z0-9@$!|])[a-z]*+[0-9@$!|][a-z0-9@$!|]*+")
_DIGITS = str.maketrans(DIGITS)
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms composed, zero-width characters dropped, homoglyphs as Latin
    letters; digits and signs inside or beside a word as the letters they stand for."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = re.sub("[​-‍⁠﻿­]", "", text)
    text = text.lower()
    if _ODD.search(text):
        text = text.translate(_GLYPHS)
    return _CODED.sub(_decode, text)


def _decode(match: re.Match) -> str:
    core = match[0]
    if core.isdigit():
        return core
    # Signs at the end are punctuation: "idiot!" is "idiot", "stup!d" is "stupid".
    body = core.rstrip("!|$@")
    lead = body.lstrip("!|")
    return core[: len(body) - len(lead)] + lead.translate(_DIGITS) + core[len(body) :]


@dataclass(frozen=True)
class Lexicon:
    """Weights of folded words or phrases, exception phrases that hide matches inside them, and the
    logistic curve that turns the length-normalised sum into a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    intercept: float = 0.0
    length_scale: float = 200.0

    def curve(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.intercept + self.slope * x)))

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            machine.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        machine.make_automaton()
        return machine


def weigh(text: str, machine, length_scale: float) -> tuple[float, int]:
    """Sum of the weights of whole-word matches outside exception phrases, over a factor that grows
    with the logarithm of the words of the text; and the number of matches."""
    found, hidden = [], []
    folded = fold(text)
    last = len(folded) - 1
    if len(machine):
        for end, (size, weight) in machine.iter(folded):
            begin = end - size + 1
            if (begin and folded[begin - 1].isalpha()) or (end < last and folded[end + 1].isalpha()):
                continue
            (hidden if weight is None else found).append((begin, end, weight))
    kept = [w for a, b, w in found if not any(x <= a and b <= y for x, y, _ in hidden)]
    if not kept:
        return 0.0, 0
    words = text.count(" ") + 1
    return sum(kept) / (1.0 + LENGTH_WEIGHT * math.log1p(words / length_scale)), len(kept)


_SCORES = concat_schema(id=pa.int64(), score=pa.float64(), n_matches=pa.int64())


def score_texts(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """``id, score, n_matches`` per row."""

    def score(batches):
        machine = lexicon.automaton()
        for rows in batches:
            raw = [weigh(t, machine, lexicon.length_scale) for t in rows.column(1).to_pylist()]
            x = np.array([r for r, _ in raw], float)
            yield batch(_SCORES, rows.column(0), lexicon.curve(x), [n for _, n in raw])

    rows = docs.select(F.col(id_col).cast("long"), text_column(docs, text_col))
    return map_arrow(rows, score, "id long, score double, n_matches long")


def labelled_sample(labels: DataFrame, label_col: str, usable, most: int) -> DataFrame:
    """At most ``most`` labelled ids, by a hash of the id: ``doc_id, label``. An id with several
    labels takes the largest; NULL ids and labels are left out."""
    return (
        labels.where(usable & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )


def learn_lexicon(
    docs: DataFrame,
    sample: DataFrame,
    exceptions: Sequence[str] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Lexicon:
    """A lexicon from ``sample (doc_id, label)``, a table of bounded size (it is broadcast).

    Words are counted in Spark by the number of different neighbourhoods (the words before and
    after their first use in a document) in which documents of each label use them, so a family of
    near copies counts a word once or twice, not once per copy. Words that are surprising enough
    (SURPRISE, a log-likelihood ratio) and mostly toxic (PRECISION) are listed, however many; their
    weight is the log-odds. Each has some ten uses at least, so the list is bounded by the sample. Word pairs that hold a listed word and occur in several clean documents,
    but in no toxic one, become exception phrases. Without toxic documents the lexicon is empty and
    every score is the floor of the curve.
    """
    texts = stored(
        docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .select("text", "label")
        .dropDuplicates(["text"])
    )
    sizes = {int(r["label"]): r["count"] for r in texts.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon({}, tuple(map(fold, exceptions)), slope=1.0, intercept=-6.0)

    fields = concat_schema(word=pa.string(), label=pa.int32(), context=pa.int64())

    def first_uses(batches):
        for rows in batches:
            found, labels, contexts = [], [], []
            for text, label in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                words = ["", *_WORD.findall(fold(text)), ""]
                first: dict[str, int] = {}
                for i in range(1, len(words) - 1):
                    first.setdefault(words[i], i)
                found += first
                labels += [label] * len(first)
                contexts += [zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode()) for i in first.values()]
            yield batch(fields, found, labels, contexts)

    counts = (
        map_arrow(texts, first_uses, "word string, label int, context long")
        .distinct()
        .groupBy("word")
        .agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    )
    both_labels, n = F.col("a") + F.col("b"), toxic + clean

    def term(k, share: float):
        return F.when(k > 0, k * F.log(k / (both_labels * share))).otherwise(0.0)

    surprise = 2 * (term(F.col("a"), toxic / n) + term(F.col("b"), clean / n if clean else 1.0))
    rate = (F.col("a") + 0.5) / (both_labels + 1)
    ranked = (
        counts.where(F.length("word") > 1)
        .withColumn("surprise", surprise)
        .where((F.col("surprise") >= SURPRISE) & (rate >= PRECISION))
    )
    weights = {
        r["word"]: round(math.log((r["a"] + 0.5) / (toxic + 1)) - math.log((r["b"] + 0.5) / (clean + 1)), 4)
        for r in ranked.collect()
    }
    listed = concat_schema(label=pa.int32(), pair=pa.string())

    def word_pairs(batches):
        for rows in batches:
            labels, pairs = [], []
            for text, label in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                words = _WORD.findall(fold(text))
                hits = [i for i, w in enumerate(words) if w in weights]
                mine = {f"{words[j]} {words[j + 1]}" for i in hits for j in (i - 1, i) if 0 <= j < len(words) - 1}
                pairs += mine
                labels += [label] * len(mine)
            yield batch(listed, labels, pairs)

    harmless = (
        map_arrow(texts, word_pairs, "label int, pair string")
        .groupBy("pair")
        .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        .where("a = 0 and b >= 3")
    )
    learned = {r["pair"] for r in harmless.collect()}
    lexicon = Lexicon(weights, tuple(sorted({*map(fold, exceptions), *learned})))

    pair_fields = concat_schema(label=pa.int32(), x=pa.float64())

    def sums(batches):
        machine = lexicon.automaton()
        for rows in batches:
            x = [weigh(t, machine, lexicon.length_scale)[0] for t in rows.column(0).to_pylist()]
            yield batch(pair_fields, rows.column(1), x)

    points = map_arrow(texts, sums, "label int, x double").collect()  # bounded by the sample
    slope, intercept = fit_curve(np.array([p["x"] for p in points]), np.array([p["label"] for p in points]))
    return Lexicon(weights, lexicon.exceptions, slope, intercept)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of ``y`` on one number, by Newton steps with a small ridge."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    penalty = np.diag([ridge, ridge]) * len(x)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(
            (design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(2),
            design.T @ (y - p) - penalty @ beta,
        )
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable,
    exceptions: Sequence[str] = (),
    max_labels: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, score, n_matches`` per row of ``docs``, from a lexicon learned on ``labels (doc_id,
    toxic)`` where ``usable`` (a condition on doc_id) holds.

    The fit uses at most ``max_labels`` labelled ids; every whole text is scored. A NULL or empty
    text has no match and gets the lowest score. Repeated rows (NULL ids too) each give a row;
    other columns are ignored; no rows give none. Labels decide only which words are listed.
    """
    sample = stored(labelled_sample(labels, "toxic", usable, max_labels))
    lexicon = learn_lexicon(docs, sample, exceptions, id_col=id_col, text_col=text_col)
    return score_texts(docs, lexicon, id_col, text_col).withColumnRenamed("id", id_col)


def drop_toxic(
    docs: DataFrame, labels: DataFrame, usable, cut: float, max_labels: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose score is below ``cut``. One pass, no shuffle
    of texts; each row is judged by its text alone, so ids may be NULL or repeated."""
    sample = stored(labelled_sample(labels, "toxic", usable, max_labels))
    lexicon = learn_lexicon(docs, sample, id_col=id_col, text_col=text_col)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = lexicon.automaton()
        for texts in batches:
            raw = [weigh(t, machine, lexicon.length_scale)[0] for t in texts]
            yield pd.Series(lexicon.curve(np.array(raw, float)))

    return docs.where(score(text_column(docs, text_col)) < cut)
