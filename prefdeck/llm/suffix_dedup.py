"""Removal of long repeated byte strings by longest previous factors in suffix order."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefdeck.llm.bytewords import STEP, U, mix
from prefdeck.llm.common import batch, concat_schema, flat_bytes, map_arrow, text_column, text_slices

MIN_LENGTH = 100
GRAM = 32  # bytes of an anchor
SLICE_BYTES = 1 << 18
LONG_TEXT = 1 << 23  # a longer text is handled in overlapping parts
SORT_BYTES = 1 << 21
HOT_ANCHOR = 20_000  # occurrences of an anchor (3 MB) beyond which its windows are compared by digest

_POSITION = U((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Windows of ``length`` bytes by the anchor they hold: ``hash, first, last, text``.

    The anchor of a window is the ``gram`` bytes in it with the smallest hash, the leftmost of
    equals, so equal windows have equal anchors at equal places. ``first:last + 1`` are the starts
    of consecutive windows with one anchor occurrence. Windows lie inside one text.
    """
    n, span = len(data), length - gram + 1
    starts = n - length + 1
    none = np.zeros(0, np.int64)
    if starts < 1:
        return none.astype(U), none, none, none
    # Hashes of 1, 2, 4, ... bytes from each place on, put together to `gram` bytes.
    step, have, whole, size = data.astype(U) + U(1), None, 0, 1
    power = int(STEP)
    while whole < gram:
        factor = U(power)
        if gram & size:
            if have is None:
                have = step
            else:
                m = n - whole - size + 1
                have = have[:m] * factor + step[whole : whole + m]
            whole += size
        step = step[:-size] * factor + step[size:]
        size *= 2
        power = power * int(STEP) & (1 << 64) - 1
    have = mix(have[: n - gram + 1])
    keys = (have & ~_POSITION) | np.arange(len(have), dtype=U)
    best, width = keys, 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if span > width:
        rest = span - width
        best = np.minimum(best[: len(best) - rest], best[rest:])
    place = (best[:starts] & _POSITION).astype(np.int64)
    # Starts of windows inside their text, text by text.
    room = np.maximum(0, np.diff(offsets) - length + 1)
    inside = np.zeros(starts, bool)
    for begin, size in zip(offsets[:-1][room > 0].tolist(), room[room > 0].tolist()):
        inside[begin : begin + size] = True
    new = np.ones(starts, bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    head = np.flatnonzero(new & inside)
    over = np.ones(starts, bool)
    over[:-1] = (place[1:] != place[:-1]) | ~inside[1:]
    tail = np.flatnonzero(over & inside)
    return have[place[head]], head, tail, np.searchsorted(offsets, head, "right") - 1


def _parts(data: np.ndarray, offsets: np.ndarray, length: int):
    """Slices ``data, offsets, first text, bytes of the first text before`` for :func:`anchors`."""
    for low, high in text_slices(offsets, SLICE_BYTES):
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        if len(part) <= LONG_TEXT:
            yield part, at, low, 0
            continue
        for begin in range(0, len(part) - length + 1, LONG_TEXT):
            piece = part[begin : begin + LONG_TEXT + length - 1]
            yield piece, np.array([0, len(piece)]), low, begin


def _rank(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    new = np.zeros(len(keys), U)
    new[1:] = keys[order][1:] != keys[order][:-1]
    ranks = np.empty(len(keys), U)
    ranks[order] = np.cumsum(new, dtype=U)
    return ranks


def earlier_matches(data: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at ``windows`` share ``length`` bytes or more with an earlier one.

    The suffixes are sorted by their first ``length`` bytes, by prefix doubling. Where neighbours
    in that order share all of them the longest common prefix reaches ``length``; inside such a run
    the longest previous factor reaches it exactly at positions with a smaller position before them
    in suffix order, or after them. Each window must have ``length`` bytes in ``data``.
    """
    if not len(windows):
        return np.zeros(0, bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rank = _rank(np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(U))
    width = 8
    while 2 * width < length:
        later = np.zeros(len(rank), U)
        later[:-width] = rank[width:] + U(1)
        rank = _rank(rank << U(32) | later)
        width *= 2
    key = rank[windows] << U(32) | rank[windows + length - width]
    order = np.lexsort((windows[::-1], key[::-1]))
    order = len(windows) - 1 - order
    position, sorted_key = windows[order], key[order]
    run = np.zeros(len(order), np.int64)
    run[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
    # Running minimum that starts anew with each run, from the left and from the right.
    shift = np.int64(len(data) + 1)
    left = np.minimum.accumulate(position - run * shift) + run * shift
    right = (np.minimum.accumulate((position + run * shift)[::-1]) - run[::-1] * shift)[::-1]
    out = np.zeros(len(windows), bool)
    out[order] = (left < position) | (right < position)
    return out


# A document's place in the order: NULL ids first, then ids, then text hashes (equal ids only).
_PLACE = "known boolean, k1 long, k2 long"
_OCCURRENCE = concat_schema(
    h=pa.int64(), known=pa.bool_(), k1=pa.int64(), k2=pa.int64(), start=pa.int64(), span=pa.binary()
)
_SPANS = concat_schema(k1=pa.int64(), k2=pa.int64(), low=pa.int64(), high=pa.int64())
SPANS = "k1 long, k2 long, low long, high long"
# Kinds of spans: removed; removed unless it is listed as FIRST as well; earliest occurrence.
MATCH, COPY, FIRST = 0, 1, 2


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``h, k1, n``: anchors of each document and how often it has them. All columns of ``texts`` go
    in, so that this reads the same shuffle as the later joins."""
    fields = concat_schema(h=pa.int64(), k1=pa.int64(), n=pa.int32())

    def emit(batches):
        for rows in batches:
            data, offsets = flat_bytes(rows.column(3))
            k1 = rows.column(1).to_numpy()
            for part, at, low, _ in _parts(data, offsets, length):
                h, _, _, text = anchors(part, at, length, gram)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(h)))
                yield batch(fields, h[head].view(np.int64), k1[low + text[head]], count.astype(np.int32))

    return map_arrow(texts, emit, "h long, k1 long, n int")


def _occurrences(found: DataFrame, wanted: str, length: int, gram: int) -> DataFrame:
    """The bytes of all windows of the anchors listed in column ``wanted``: ``h``, a document's
    place, ``start, span``."""

    def emit(batches):
        for rows in batches:
            data, offsets = flat_bytes(rows.column(3))
            known, k1, k2 = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            listed = rows.column(4)
            for part, at, low, begin in _parts(data, offsets, length):
                h, first, last, text = anchors(part, at, length, gram)
                h = h.view(np.int64)
                edges = np.searchsorted(text, np.arange(len(at)))
                keep = [
                    np.flatnonzero(np.isin(h[a:b], np.asarray(listed[low + i].values, np.int64))) + a
                    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
                ]
                keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
                raw = part.tobytes()
                spans = [raw[a : b + length] for a, b in zip(first[keep], last[keep])]
                owner = low + text[keep]
                start = first[keep] - at[text[keep]] + begin
                yield batch(_OCCURRENCE, h[keep], known[owner], k1[owner], k2[owner], start, spans)

    # "carry" is not needed here; with it, both joins on texts read one and the same shuffle.
    carry = [c for c in found.columns if c == "carry"]
    columns = found.where(F.size(wanted) > 0).select("known", "k1", "k2", "text", wanted, *carry)
    return map_arrow(columns, emit, f"h long, {_PLACE}, start long, span binary")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([[False], flags, [False]])
    change = np.flatnonzero(padded[1:] != padded[:-1])
    return change[::2], change[1::2]


def _compare(groups: list[list[tuple]], length: int):
    """Removed spans of whole anchor groups. A row is ``(known, k1, k2, start), span``."""
    out, firsts = [], []
    for rows in groups:
        best: dict[bytes, tuple] = {}
        for place, span in rows:
            if span not in best or place < best[span]:
                best[span] = place
        for place, span in rows:
            if place != best[span]:
                out.append((place[1], place[2], place[3], place[3] + len(span)))
        if len(best) > 1:
            firsts += [(place, span) for span, place in best.items()]
    if firsts:
        firsts.sort(key=lambda x: x[0])
        data = np.frombuffer(b"".join(span for _, span in firsts), np.uint8)
        sizes = np.array([len(span) for _, span in firsts])
        begin = np.cumsum(sizes) - sizes
        room = sizes - length + 1
        windows = np.arange(room.sum()) + np.repeat(begin - (np.cumsum(room) - room), room)
        flags = earlier_matches(data, windows, length)
        edge = np.append(0, np.cumsum(room))
        for i in np.unique(np.repeat(np.arange(len(firsts)), room)[flags]):
            (_, k1, k2, start), _ = firsts[i]
            for a, b in zip(*_runs(flags[edge[i] : edge[i + 1]])):
                out.append((k1, k2, start + int(a), start + int(b) - 1 + length))
    return out


def _cold_spans(occurrences: DataFrame, length: int) -> DataFrame:
    """Spans from anchors with few occurrences: a task sees whole groups, sorted by anchor, and
    compares as many at a time as fit ``SORT_BYTES``."""

    def emit(batches):
        groups, size, current = [], 0, None

        def flush():
            rows = _compare(groups, length)
            return batch(_SPANS, *(map(list, zip(*rows)) if rows else ([], [], [], [])))

        for rows in batches:
            columns = [rows.column(i).to_pylist() for i in range(6)]
            for h, known, k1, k2, start, span in zip(*columns):
                if h != current:
                    if size >= SORT_BYTES:
                        yield flush()
                        groups, size = [], 0
                    groups.append([])
                    current = h
                groups[-1].append(((known, k1, k2, start), span))
                size += len(span)
        if groups:
            yield flush()

    return map_arrow(occurrences.repartition("h").sortWithinPartitions("h"), emit, SPANS)


def _hot_spans(occurrences: DataFrame, length: int) -> DataFrame:
    """Spans from anchors with very many occurrences, without gathering any group.

    Equal byte spans fold to their earliest place with a map-side minimum; the windows of what is
    left are compared by digest in the same way. Every occurrence but the earliest of a span is a
    copy as a whole: all are listed as COPY and the earliest ones as FIRST besides, and they cancel
    out where the spans of a document meet (:func:`removed_spans`), so no join goes over them.
    """
    place = F.struct("known", "k1", "k2", "start")
    ends = [F.col("start").alias("low"), (F.col("start") + F.octet_length("span")).alias("high")]
    copies = occurrences.select("k1", "k2", *ends, F.lit(COPY).alias("kind"))
    first = (
        occurrences.groupBy(F.sha2("span", 256).alias("d"))
        .agg(F.min(F.struct(place.alias("place"), "span")).alias("best"))
        .select("best.place.*", "best.span")
    )
    firsts = first.select("k1", "k2", *ends, F.lit(FIRST).alias("kind"))
    window = first.withColumn("o", F.explode(F.sequence(F.lit(0), F.octet_length("span") - length))).select(
        F.struct("known", "k1", "k2", (F.col("start") + F.col("o")).alias("at")).alias("place"),
        F.sha2(F.substring("span", F.col("o") + 1, F.lit(length)), 256).alias("w"),
    )
    earliest = window.groupBy("w").agg(F.min("place").alias("best"))
    matched = window.join(earliest, "w").where("place <> best").select(
        "place.k1",
        "place.k2",
        F.col("place.at").alias("low"),
        (F.col("place.at") + length).alias("high"),
        F.lit(MATCH).alias("kind"),
    )
    return copies.unionByName(firsts).unionByName(matched)


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
_RESULT_FIELDS = concat_schema(
    id=pa.int64(), n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept_sha256=pa.string(), kept=pa.string()
)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside ``spans`` and the number of maximal runs inside."""
    kept, at, runs, end = [], 0, 0, -1
    for low, high in sorted(spans):
        if low > end:
            runs += 1
            kept.append(text[at:low])
        end = max(end, high)
        at = max(at, high)
    kept.append(text[at:])
    return b"".join(kept), runs


def removed_spans(spans: pa.StructArray, k2: int) -> list[tuple[int, int]]:
    """The spans to remove from the text ``k2`` among the listed ``(k2, low, high, kind)``."""
    own = spans.field(0).to_numpy() == k2
    kind = spans.field(3).to_numpy()[own]
    ends = np.stack([spans.field(1).to_numpy()[own], spans.field(2).to_numpy()[own]], axis=1)
    firsts = set(map(tuple, ends[kind == FIRST].tolist()))
    copies = [span for span in map(tuple, ends[kind == COPY].tolist()) if span not in firsts]
    return list(map(tuple, ends[kind == MATCH].tolist())) + copies


def remove_repeats(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    gram: int = GRAM,
    hot: int = HOT_ANCHOR,
    with_text: bool = True,
    carry: Sequence[str] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, kept[, carry]`` per row of ``docs``: each text without
    the bytes covered by a string of ``min_length`` bytes that also starts earlier.

    Order: ids ascending, NULL ids before all; rows with one id but different texts by a hash of the
    text. Repeated rows (same id, same text) count as one document and get one result each, as do
    NULL ids with equal texts. A NULL text is empty. Columns named in ``carry`` come back in a struct
    of that name; others are ignored. ``kept`` (NULL without ``with_text``) is what is left as text:
    matches are of bytes, and a character of which only a part is left goes too. The digest is of
    the bytes.

    Windows of ``min_length`` bytes are named by an anchor, which equal windows share. Anchors that
    occur once are dropped; the bytes around the others are shuffled by anchor, so that every group
    of equal windows meets in one task, where suffix order and longest previous factors decide.
    Anchors with more than ``hot`` occurrences take :func:`_hot_spans` instead. Texts are shuffled
    once, by id, and that shuffle serves all joins.
    """
    text = text_column(docs, text_col)
    held = [F.struct(*carry).alias("carry")] if carry else []
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *held).select(
        F.col("id").isNotNull().alias("known"),
        F.coalesce("id", F.xxhash64("text")).alias("k1"),
        F.xxhash64("text", F.col("id").isNull()).alias("k2"),
        "text",
        *["carry" for _ in held],
    )
    schema = T.StructType.fromDDL(_RESULT)
    if carry:
        schema = schema.add("carry", texts.schema["carry"].dataType)
    # Copies of a whole text fold first: only the earliest goes on, found by id in the one shuffle
    # of texts. Building a hash table of the other side spares sorting the texts.
    place = F.struct("known", "k1", "k2")
    digests = texts.select(
        place.alias("place"), F.sha2("text", 256).alias("d"), F.octet_length("text").cast("long").alias("size")
    )
    best = digests.groupBy("d").agg(F.min("place").alias("best"))
    first = best.select("best.k1", F.col("best.k2").alias("k2_first"))
    copies = (
        digests.join(best, "d")
        .where((F.col("place") != F.col("best")) & (F.col("size") >= min_length))
        .select("place.k1", "place.k2", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))
    )
    unique = texts.join(first.hint("shuffle_hash"), "k1").where(
        F.col("k2").bitwiseXOR(F.col("k2_first")) == 0  # not a join key: every join deals texts by k1 alone
    ).select(texts.columns)
    rows = _anchor_rows(unique, min_length, gram)
    repeated = (
        rows.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h", (F.col("total") > hot).alias("is_hot"))
    )
    per_text = (
        rows.select("h", "k1")
        .join(repeated, "h")
        .groupBy("k1")
        .agg(
            F.collect_list(F.when(~F.col("is_hot"), F.col("h"))).alias("cold"),
            F.collect_list(F.when(F.col("is_hot"), F.col("h"))).alias("hot"),
        )
    )
    found = unique.join(per_text.hint("shuffle_hash"), "k1")
    cold_spans = _cold_spans(_occurrences(found, "cold", min_length, gram), min_length).unionByName(copies)
    spans = cold_spans.withColumn("kind", F.lit(MATCH)).unionByName(
        _hot_spans(_occurrences(found, "hot", min_length, gram), min_length)
    )
    per_text_spans = spans.groupBy("k1").agg(F.collect_list(F.struct("k2", "low", "high", "kind")).alias("spans"))

    def cut(batches):
        for rows in batches:
            known, k1, k2 = (rows.column(i).to_pylist() for i in range(3))
            data = rows.column(3).cast(pa.large_binary())
            found = rows.column(4)
            out = []
            for i in range(len(known)):
                text = data[i].as_py()
                mine = removed_spans(found[i].values, k2[i]) if found[i].is_valid else []
                kept, runs = cut_spans(text, mine)
                out.append(
                    (k1[i] if known[i] else None, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)
                )
            done = batch(_RESULT_FIELDS, *(map(list, zip(*out)) if out else [[]] * 6))
            yield done.append_column("carry", rows.column(5)) if carry else done

    joined = texts.join(per_text_spans.hint("shuffle_hash"), "k1", "left").select("known", "k1", "k2", "text", "spans", *["carry" for _ in held])
    return map_arrow(joined, cut, schema).withColumnRenamed("id", id_col)
