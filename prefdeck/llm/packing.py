"""Packing pieces of documents into sequences by vector best fit."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefdeck.llm.common import batch, concat_schema, flat_bytes, map_arrow, stored, text_column, text_slices
from prefdeck.llm.tokenizer import SLICE_BYTES, TokenizerFile

NORM, DOT = "norm", "dot"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = concat_schema(
    doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64()
)
CHUNK_ROWS = 250_000  # pieces of one length that are numbered together


def quadratic(length: int) -> int:
    """Attention cost of a piece that attends to itself only."""
    return length * length


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents (pieces) and attention cost; and how much each
    counts when a sequence is chosen. ``policy``: NORM takes the sequence whose weighted residual
    after placing is shortest, DOT the one whose residual has the largest weighted dot product with
    the piece."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)
    policy: str = NORM
    cost: Callable[[int], int] = quadratic


@dataclass(frozen=True)
class Layout:
    """Where pieces go, as runs: piece number r of its length, ``first_rank <= r``, lies in sequence
    ``first_bin + (r - first_rank) // per_bin`` from ``offset + (r - first_rank) % per_bin * length``
    on. Sorted by (length, first_rank)."""

    length: np.ndarray
    first_rank: np.ndarray
    first_bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Ranks stay below 2**40 and lengths below 2**23, so (length, rank) is one number.
        key = self.length << 40 | self.first_rank
        run = np.searchsorted(key, length << 40 | rank, "right") - 1
        past = rank - self.first_rank[run]
        return (
            self.first_bin[run] + past // self.per_bin[run],
            self.offset[run] + past % self.per_bin[run] * length,
        )


def best_fit(histogram: dict[int, int], capacity: Capacity) -> Layout:
    """Vector best fit, longest pieces first, over counts of pieces by length.

    Equal pieces are interchangeable and equal bins too, so a step handles a whole group of bins
    with the same contents: the best group by the policy takes as many pieces per bin as every
    capacity allows. The state is one row per group. A length splits at most one group and opens at
    most two, and a group that takes pieces of a length keeps less than half of the residual that
    binds, so groups and runs are bounded by the capacity (some 10^5 at 2048 tokens), whatever the
    number of pieces.
    """
    whole = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weights = np.array(capacity.weights)
    left = np.zeros((0, 3), np.int64)  # residuals of the groups
    first = np.zeros(0, np.int64)
    size = np.zeros(0, np.int64)
    n_bins, runs = 0, []
    shortest = min(histogram, default=1)

    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, capacity.cost(length)], np.int64)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        count, rank = histogram[length], 0
        while rank < count:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                if capacity.policy == NORM:
                    after = (left[fits] - need) / whole
                    pick = fits[np.argmin((weights * after * after).sum(axis=1))]
                else:
                    pick = fits[np.argmax((weights * (need / whole) * (left[fits] / whole)).sum(axis=1))]
                room, bins, at = left[pick], int(size[pick]), int(first[pick])
            else:
                room, at = whole.astype(np.int64), n_bins
                bins, pick = None, None
            with np.errstate(divide="ignore"):
                each = int(min(room[k] // need[k] for k in range(3) if need[k]))
            each = min(each, count - rank)
            taken = (count - rank) // each
            if bins is None:
                n_bins += taken
            else:
                taken = min(taken, bins)
            runs.append((length, rank, at, each, capacity.tokens - int(room[0])))
            rank += taken * each
            rest = room - each * need
            if pick is None or taken < bins:
                if pick is not None:
                    first[pick] += taken
                    size[pick] -= taken
                left = np.vstack([left, rest])
                first, size = np.append(first, at), np.append(size, taken)
            else:
                left[pick] = rest
        live = (left[:, 0] >= shortest) & (left[:, 1] >= 1)
        left, first, size = left[live], first[live], size[live]

    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Layout(*columns, n_bins=n_bins)


def cut_pieces(
    docs: DataFrame,
    tokenizer: TokenizerFile,
    most: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per piece: a document's ids with ``end_id`` behind them, cut every ``most`` tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def cut(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = tokenizer.encoder()
        for rows in batches:
            doc_ids = rows.column(0).to_pylist()
            data, offsets = flat_bytes(rows.column(1))
            for low, high in text_slices(offsets, SLICE_BYTES):
                ids, at = encoder.encode_all(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                raw = np.insert(ids, at[1:], end_id).astype("<u4").tobytes()
                edges = (4 * (at + np.arange(len(at)))).tolist()
                out = []
                for doc_id, begin, end in zip(doc_ids[low:high], edges[:-1], edges[1:]):
                    for piece, start in enumerate(range(begin, end, 4 * most)):
                        part = raw[start : min(start + 4 * most, end)]
                        out.append((doc_id, piece, (start - begin) // 4, len(part) // 4, zlib.crc32(part)))
                yield batch(_PIECES, *map(list, zip(*out)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    return map_arrow(rows, cut, PIECES)


def place_pieces(pieces: DataFrame, capacity: Capacity) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Only the counts of pieces by length, at most one per token of capacity, are collected; the
    layout that follows from them is bounded as :func:`best_fit` says and is broadcast. Pieces are
    numbered within their length in chunks, so a length that very many documents share is spread
    over many tasks.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces)
    n_rows = pieces.count()
    n_chunks = max(256, n_rows // CHUNK_ROWS)
    chunked = pieces.withColumn(
        "_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_chunks)).cast("int")
    )
    sizes = chunked.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    histogram = {
        r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    }
    layout = best_fit(histogram, capacity)
    # Arrays only: workers need not be able to import this package.
    shared = spark.sparkContext.broadcast(
        (layout.length, layout.first_rank, layout.first_bin, layout.per_bin, layout.offset, layout.n_bins)
    )

    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        chunked.withColumn("_row", F.row_number().over(inside))
        .join(starts, ["length", "_chunk"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        bins, offsets = Layout(*shared.value).place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    return ranked.withColumn("_place", place("length", "_rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: TokenizerFile,
    capacity: Capacity,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into few sequences: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``, a row per piece.

    Only documents longer than ``capacity.tokens`` are cut. Every piece lies in one sequence, with
    no gap before it. A NULL or empty text is one piece with ``end_id`` alone. Repeated rows are
    packed once each, NULL ids too; other columns are ignored; no rows give no pieces. Sequence
    numbers are dense from 0.
    """
    return place_pieces(cut_pieces(docs, tokenizer, capacity.tokens, end_id, id_col, text_col), capacity)
