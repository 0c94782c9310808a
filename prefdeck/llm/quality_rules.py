"""Quality rules with thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefdeck.llm.bytewords import NOT_SPACE, STEP, U, find_words, hash_words, mix
from prefdeck.llm.common import batch, concat_schema, flat_bytes, map_arrow, stored, text_column, text_slices

SLICE_BYTES = 1 << 20
GRAM = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_FIELDS = concat_schema(
    doc_id=pa.int64(), lang=pa.string(), source=pa.string(), n_words=pa.int64(), word_chars=pa.int64(),
    n_symbols=pa.int64(), n_dup_lines=pa.int64(), n_repeat_words=pa.int64(), n_lines=pa.int64(),
)
FEATURES = (
    "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, n_lines long"
)

@dataclass(frozen=True)
class Fence:
    """A document fails above ``Q(high) + reach * (Q(high) - Q(low))`` of its group's quantiles Q and,
    if ``both``, below the same on the other side. Nothing is added to what the sketches say."""

    low: float
    high: float
    reach: float
    both: bool = False


# Rates that are zero in most documents need quantiles far up, where the group's own habit shows.
METRICS = {
    "symbol_rate": Fence(0.5, 0.9, 3.0),
    "word_length": Fence(0.25, 0.75, 6.0, both=True),
    "dup_line_rate": Fence(0.5, 0.99, 1.0),
    "repeat_rate": Fence(0.5, 0.99, 2.0),
}


def _repeated(data: np.ndarray, text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in text order: a number per (text, hash), and whether an earlier one has it."""
    order = np.lexsort((hashes, text))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    later = np.empty(len(order), bool)
    later[order] = ~new  # lexsort is stable: the first of a run is the earliest
    return group, later


def measure_slice(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text: words, code points in words, symbols, repeated lines, words in repeated 8-word
    windows, lines with a word. Lines and windows are compared by 64-bit hashes within a text."""
    n = len(offsets) - 1
    words = find_words(data, offsets, NOT_SPACE)
    n_words = words.counts

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return total[offsets[1:]] - total[offsets[:-1]]

    word_chars = per_text(NOT_SPACE[data] & ((data & 0xC0) != 0x80))
    n_symbols = per_text(_SYMBOL[data])

    lines = find_words(data, offsets, _LINE)
    total = np.append(0, np.cumsum(NOT_SPACE[data], dtype=np.int64))
    full = total[lines.end] > total[lines.start]
    line_text = lines.text[full]
    lines.start, lines.end = lines.start[full], lines.end[full]
    _, later = _repeated(data, line_text, hash_words(data, lines))
    n_lines = np.bincount(line_text, minlength=n)
    n_dup = np.bincount(line_text[later], minlength=n)

    hashes, text = hash_words(data, words), words.text
    n_repeat = np.zeros(n, np.int64)
    if len(hashes) >= GRAM:
        window = hashes[: len(hashes) - GRAM + 1].copy()
        for k in range(1, GRAM):
            window = mix(window * STEP + hashes[k : len(hashes) - GRAM + 1 + k])
        whole = np.flatnonzero(text[: len(window)] == text[GRAM - 1 :])
        group, _ = _repeated(data, text[whole], window[whole])
        often = whole[np.bincount(group)[group] > 1] if len(whole) else whole
        change = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(change, often, 1)
        np.add.at(change, often + GRAM, -1)
        n_repeat = np.bincount(text[np.cumsum(change)[:-1] > 0], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    def emit(batches):
        for rows in batches:
            data, offsets = flat_bytes(rows.column(3))
            for low, high in text_slices(offsets, SLICE_BYTES):
                part = data[offsets[low] : offsets[high]]
                measured = measure_slice(part, offsets[low : high + 1] - offsets[low])
                yield batch(_FIELDS, *(rows.column(i)[low:high] for i in range(3)), *measured)

    rows = docs.select(
        F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), text_column(docs, text_col)
    )
    return map_arrow(rows, emit, FEATURES)


def _rates(df: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return df.withColumns(
        {
            "symbol_rate": F.col("n_symbols") / words,
            "word_length": F.col("word_chars") / words,
            "dup_line_rate": F.col("n_dup_lines") / lines,
            "repeat_rate": F.col("n_repeat_words") / words,
        }
    )


def thresholds(rated: DataFrame, prior_rows: int, k: int) -> DataFrame:
    """``lang, source`` and ``<metric>_low`` (NULL: none), ``<metric>_high`` per group of ``rated``.

    Quantiles come from KLL sketches, built map-side per language and source and merged up to
    languages and to the corpus. A group's quantiles are drawn toward those of its language, and
    these toward the corpus, as if each had ``prior_rows`` more rows of the kind above; a group of a
    few rows thus takes over its language's. A sketch compacts at random once its group has more rows
    than it holds (some hundreds at ``k`` 200), so a fence may move by a rank error of about 1.3 per
    cent of the rows from run to run.
    """
    by_source = stored(
        rated.groupBy("lang", "source").agg(
            F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in METRICS]
        )
    )
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in METRICS]]

    def quantiles(df: DataFrame, prefix: str) -> list[Column]:
        return [
            F.kll_sketch_get_quantile_double(df[m], F.lit(q)).alias(f"{prefix}{m}_{name}")
            for m, fence in METRICS.items()
            for name, q in (("low", fence.low), ("high", fence.high))
        ]

    langs = by_source.groupBy("lang").agg(*merged)
    corpus = by_source.agg(*merged)
    top = corpus.select(F.struct(*quantiles(corpus, "c_"))).scalar()
    lang = langs.select("lang", F.col("n").alias("l_n"), *quantiles(langs, "l_"))
    own = by_source.select("lang", "source", "n", *quantiles(by_source, ""))
    joined = own.join(
        lang.withColumnRenamed("lang", "l_lang"), F.col("lang").eqNullSafe(F.col("l_lang"))
    ).withColumn("c", top)
    out = []
    for m, fence in METRICS.items():
        def level(name: str) -> Column:
            upper = (F.col("l_n") * F.col(f"l_{m}_{name}") + prior_rows * F.col(f"c.c_{m}_{name}")) / (F.col("l_n") + prior_rows)
            return (F.col("n") * F.col(f"{m}_{name}") + prior_rows * upper) / (F.col("n") + prior_rows)

        low, high = level("low"), level("high")
        reach = fence.reach * (high - low)
        out += [
            (low - reach if fence.both else F.lit(None).cast("double")).alias(f"{m}_low"),
            (high + reach).alias(f"{m}_high"),
        ]
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *out)


def beyond_fences(rated: DataFrame, fences: DataFrame) -> DataFrame:
    """``rated`` with ``outside``: the metrics by which a row lies outside the fences of its group."""
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    failed = [
        F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in METRICS
    ]
    outside = F.array_compact(F.array(*failed)).alias("outside")
    return rated.join(fences, same, "left").select(*[rated[c] for c in rated.columns], outside)


def _judged(
    docs: DataFrame, min_words: int, most_repeat_percent: int, prior_rows: int, sketch_k: int,
    id_col: str, text_col: str, lang_col: str, source_col: str,
) -> DataFrame:
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    measured = stored(features(docs, id_col, text_col, lang_col, source_col))
    rated = _rates(measured).withColumn("base_failed", base)
    fences = stored(thresholds(rated.where("not base_failed"), prior_rows, sketch_k))
    return beyond_fences(rated, fences)


def quality_rules(
    docs: DataFrame,
    min_words: int = 20,
    most_repeat_percent: int = 30,
    prior_rows: int = 200,
    sketch_k: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, outside``.

    Fixed rules come first (``base_failed``); the others are fences per language and source, from
    sketches over all documents that pass the fixed rules, joined back to every row. ``outside`` names
    the metrics beyond their fence. A NULL or empty text has no words and fails. NULL languages and
    sources are groups like others. Repeated rows each give a row; other columns are ignored; no rows
    give none.
    """
    judged = _judged(docs, min_words, most_repeat_percent, prior_rows, sketch_k, id_col, text_col, lang_col, source_col)
    return judged.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"), "outside",
    )


def rejections(judged: DataFrame) -> DataFrame:
    """How many rows of :func:`quality_rules` pass the fixed rules but lie beyond each fence: ``metric,
    n_rejected, n_alone`` (rejected by this metric only)."""
    rows = judged.where("not base_failed").select(F.explode("outside").alias("metric"), F.size("outside").alias("n"))
    return rows.groupBy("metric").agg(F.count("*").alias("n_rejected"), F.count_if(F.col("n") == 1).alias("n_alone"))
