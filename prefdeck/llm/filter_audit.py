"""Which filter removes what, in every order of the filters: an audit over a sparse document-term matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefdeck.llm.bytewords import NOT_SPACE, find_words, tokens_of
from prefdeck.llm.common import LONG_ROWS, batch, concat_schema, flat_bytes, map_arrow, stored, text_column, text_slices

SHARD_BYTES = 1 << 20  # text of a shard, or one longer text
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
SIGNS = b"#$%&*|"
MOST_CLASHES = 1_000

_SHARD = concat_schema(
    docs=pa.list_(pa.int64()), parts=pa.list_(pa.string()), texts=pa.list_(pa.binary()),
    marked=pa.list_(pa.bool_()), shouted=pa.list_(pa.bool_()),
    words=pa.list_(pa.binary()), starts=pa.list_(pa.int32()), terms=pa.list_(pa.int32()), counts=pa.list_(pa.int32()),
)
SHARDS = (
    "docs array<long>, parts array<string>, texts array<binary>, marked array<boolean>, "
    "shouted array<boolean>, words array<binary>, starts array<int>, terms array<int>, counts array<int>"
)


def count_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``words, starts, terms, counts``: distinct words, and the matrix of documents by words as
    compressed sparse rows whose columns are places in ``words``. Words are compared byte by byte."""
    found = find_words(data, offsets, NOT_SPACE)
    tokens = tokens_of(data, found)
    n_words, n_docs = max(len(tokens.dictionary), 1), len(offsets) - 1
    cells = found.text * n_words + np.asarray(tokens.indices, np.int64)
    cells, counts = np.unique(cells, return_counts=True)
    starts = np.searchsorted(cells // n_words, np.arange(n_docs + 1))
    return tokens.dictionary, starts, cells % n_words, counts


def _many(values, kind: pa.DataType) -> pa.Array:
    """One row that holds a list."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def matrix_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """A row per shard of some thousand documents: ids, parts, text digests, the flags of filters C and D,
    and the documents' words as compressed sparse rows over the shard's own ``words``."""
    sign = np.zeros(256, bool)
    sign[list(SIGNS)] = True
    upper = np.zeros(256, bool)
    upper[ord("A") : ord("Z") + 1] = True

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offsets = flat_bytes(rows.column(3))
            for low, high in text_slices(offsets, shard_bytes):
                part = data[offsets[low] : offsets[high]]
                at = offsets[low : high + 1] - offsets[low]

                def per_text(flags: np.ndarray) -> np.ndarray:
                    total = np.append(0, np.cumsum(flags, dtype=np.int64))
                    return total[at[1:]] - total[at[:-1]]

                points = per_text((part & 0xC0) != 0x80)
                shouted = 100 * per_text(upper[part]) > UPPER_PERCENT * points
                marked = per_text(sign[part]) > 0
                words, starts, terms, counts = count_terms(part, at)
                columns = [rows.column(i)[low:high] for i in range(3)]
                lists = [*columns, marked, shouted, words, starts, terms, counts]
                yield batch(_SHARD, *(_many(x, t.value_type) for x, t in zip(lists, _SHARD.types)))

    text = text_column(docs, text_col)
    rows = docs.select(
        F.col(id_col).cast("long"), F.coalesce(F.col(part_col).cast("string"), F.lit("")), F.unhex(F.sha2(text, 256)), text
    )
    return map_arrow(rows, emit, SHARDS)


def word_code(word: Column) -> Column:
    """63 bits of a hash, so that negative codes are free."""
    return F.shiftrightunsigned(F.xxhash64(word), 1)


def clashing_words(words: DataFrame, code: Callable[[Column], Column]) -> dict[bytes, int]:
    """Negative codes for those of ``words (word)``, which may repeat, that share their hash with a smaller
    word.

    Chance gives n ** 2 / 2 ** 64 of them: one among four billion words. Far more would mean that the
    hash is no good, and is an error.
    """
    distinct = words.select("word").distinct().select(code(F.col("word")).alias("code"))
    shared = distinct.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    codes = [row["code"] for row in shared.limit(MOST_CLASHES + 1).collect()]
    if len(codes) > MOST_CLASHES:
        raise ValueError("too many words share a hash")
    if not codes:
        return {}
    found = words.select("word", code(F.col("word")).alias("code")).where(F.col("code").isin(codes)).distinct()
    by_code: dict[int, list[bytes]] = {}
    for row in found.collect():
        by_code.setdefault(row["code"], []).append(bytes(row["word"]))
    later = [w for c in sorted(by_code) for w in sorted(by_code[c])[1:]]
    return {w: -1 - i for i, w in enumerate(later)}


def dictionary(words: DataFrame, code: Callable[[Column], Column] = word_code) -> Callable[[Column], Column]:
    """The global dictionary of ``words (word)``, which may repeat: the code of a word, as a column of it.

    Equal words have equal codes and different words different ones, in every shard: a code is a hash
    unless another word of the table has the same, which is found out by counting. So no shard has
    to look its words up in a table of all words; only distinct words are shuffled, once folded.
    """
    clashes = clashing_words(words, code)
    if not clashes:
        return code
    listed = F.create_map(*[F.lit(x) for word, number in clashes.items() for x in (bytearray(word), number)])
    return lambda word: F.coalesce(F.element_at(listed, word).cast("long"), code(word))


_MATRIX = concat_schema(
    docs=pa.list_(pa.int64()), parts=pa.list_(pa.string()), texts=pa.list_(pa.binary()),
    marked=pa.list_(pa.bool_()), shouted=pa.list_(pa.bool_()),
    starts=pa.list_(pa.int32()), terms=pa.list_(pa.int64()), counts=pa.list_(pa.int32()),
)
MATRIX = (
    "docs array<long>, parts array<string>, texts array<binary>, marked array<boolean>, "
    "shouted array<boolean>, starts array<int>, terms array<long>, counts array<int>"
)


def _coded_shards(
    docs: DataFrame, id_col: str, text_col: str, part_col: str, shard_bytes: int, code: Callable[[Column], Column]
) -> DataFrame:
    """The shards with the dictionary's ``codes`` of their words instead of the words."""
    shards = stored(matrix_shards(docs, id_col, text_col, part_col, shard_bytes), **LONG_ROWS)
    number = dictionary(shards.select(F.explode("words").alias("word")), code)
    return shards.select(*[f.name for f in _MATRIX], F.transform("words", number).alias("codes"))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in the shard's words become codes, ascending in each row of the matrix."""
    for rows in batches:
        for i in range(rows.num_rows):
            *known, starts, terms, counts, codes = (column[i].values for column in rows.columns)
            codes = np.asarray(codes, np.int64)[np.asarray(terms)]
            order = np.lexsort((codes, np.repeat(np.arange(len(starts) - 1), np.diff(np.asarray(starts)))))
            lists = [*known, starts, codes[order], np.asarray(counts)[order]]
            yield batch(_MATRIX, *(_many(x, t.value_type) for x, t in zip(lists, _MATRIX.types)))


def document_terms(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", shard_bytes: int = SHARD_BYTES,
    code: Callable[[Column], Column] = word_code,
) -> DataFrame:
    """The document-term matrix, a row per shard: ``starts, terms, counts`` are compressed sparse rows over
    the :func:`dictionary` of the whole table, one for each of ``docs``, beside ``parts, texts``
    (digests), ``marked, shouted`` (filters D and C)."""
    return map_arrow(_coded_shards(docs, id_col, text_col, part_col, shard_bytes, code), _encode, MATRIX)


_FLAGS = concat_schema(id=pa.int64(), part=pa.string(), text=pa.binary(), mask=pa.int32())


def _flags(matrix: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters A to D per document. Row sums of the matrix are the words, its nonzeros the distinct ones."""
    for shard in matrix:
        docs, parts, texts, marked, shouted, starts, _, counts = (column[0].values for column in shard.columns)
        starts = np.asarray(starts, np.int64)
        total = np.append(0, np.cumsum(np.asarray(counts, np.int64)))
        n_words, n_terms = total[starts[1:]] - total[starts[:-1]], np.diff(starts)
        mask = (
            (n_words < MIN_WORDS).astype(np.int32)
            | (100 * n_terms < DISTINCT_PERCENT * n_words).astype(np.int32) << 1
            | shouted.to_numpy(zero_copy_only=False).astype(np.int32) << 2
            | marked.to_numpy(zero_copy_only=False).astype(np.int32) << 3
        )
        yield batch(_FLAGS, docs, parts, texts, mask)


def failed_filters(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", shard_bytes: int = SHARD_BYTES,
    code: Callable[[Column], Column] = word_code,
) -> DataFrame:
    """``id, part, text, mask`` per row of ``docs``: bit k of ``mask`` says that filter k of FILTERS fails. A to
    D follow from the matrix of :func:`document_terms`, a shard at a time, E from all ids of a text."""
    shards = _coded_shards(docs, id_col, text_col, part_col, shard_bytes, code)
    rows = stored(map_arrow(shards, lambda batches: _flags(_encode(batches)), "id long, part string, text binary, mask int"))
    # E: equal to the text of a smaller id. NULL is no smaller and has no smaller.
    first = rows.groupBy("text").agg(F.min("id").alias("first"))
    again = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first, "text").withColumn("mask", F.col("mask").bitwiseOR(again)).drop("first")


def _steps() -> Column:
    """All orders of the filters, step by step: ``filter_order, step, own`` (the bit of the step's filter),
    ``before`` (the bits of those before it)."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            rows.append(f'{{"filter_order":"{"".join(order)}","step":{step},"own":{own},"before":{before}}}')
            before |= own
    schema = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    return F.from_json(F.lit(f"[{','.join(rows)}]"), schema)


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``:
    what each of five filters does at each place of each of the 120 orders, per part.

    ``part`` is the source; NULL and the empty string are one part. A NULL text is empty. A repeated row
    counts each time; rows with the same id do not make one another's text a repeat, and NULL ids
    are neither smaller than others nor larger. An id with several labels takes the largest of each;
    NULL ids have none. Other columns are ignored; no rows give none. Texts are told apart by a
    sha256. All of it follows from counts per part and set of failed filters, 32 at most.
    """
    failed = failed_filters(docs, id_col, text_col, part_col, shard_bytes)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    cells = (
        failed.join(known, "id", "left")
        .groupBy("part", "mask")
        .agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    )
    n_orders = 120

    def total(which, value=lambda c: c["n"]) -> Column:
        return F.aggregate(
            "cells", F.lit(0).cast("long"), lambda s, c: s + F.when(which(c["mask"]), value(c)).otherwise(F.lit(0).cast("long"))
        )

    own, before = F.col("own"), F.col("before")

    def here(mask: Column) -> Column:
        return (mask.bitwiseAND(own) != 0) & (mask.bitwiseAND(before) == 0)

    # Of the filters that a document fails, each comes first in an equal share of the orders.
    share = lambda c: c["n"] * (F.lit(n_orders) / F.bit_count(c["mask"])).cast("long")
    return cells.select("part", "cells", F.inline(_steps())).select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda m: m.bitwiseAND(own) != 0, share).alias("shapley"),
    )
