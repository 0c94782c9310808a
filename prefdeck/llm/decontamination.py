"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefdeck.llm.bytewords import ALPHANUMERIC, LOWER, find_words, hash_words
from prefdeck.llm.common import (
    batch, concat_schema, flat_bytes, map_arrow, shared_folder, stored, text_column, text_slices, unused_name,
)

SLICE_BYTES = 1 << 20
BLOCK_WINDOWS = 200_000  # distinct test windows that are searched together: bounds what is broadcast
RARE_TERMS = 2  # terms of a window whose lists are intersected


def _words(text: bytes) -> list[bytes]:
    data = LOWER[np.frombuffer(text, np.uint8)]
    words = find_words(data, np.array([0, len(data)]), ALPHANUMERIC)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(words.start, words.end)]


def _term(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(hash_words(data, find_words(data, np.array([0, len(data)]), ALPHANUMERIC)).view(np.int64)[0])


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``item string, phrase string``: distinct windows of ``window`` consecutive words of each item,
    joined by spaces. An item with fewer words, but some, is one window. NULL item ids read 'null'."""
    fields = concat_schema(item=pa.string(), phrase=pa.string())

    def emit(batches):
        for rows in batches:
            items, phrases = [], []
            for item, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                words = _words(text.encode())
                found = {b" ".join(words[i : i + window]).decode() for i in range(max(1, len(words) - window + 1))} if words else ()
                items += [item] * len(found)
                phrases += found
            yield batch(fields, items, phrases)

    rows = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), text_column(benchmark, text_col).alias("text")
    )
    return map_arrow(rows, emit, "item string, phrase string").distinct()


@dataclass(frozen=True)
class Phrases:
    """A bounded block of test phrases, as terms (64-bit hashes of words)."""

    texts: tuple[str, ...]

    def terms(self) -> list[list[int]]:
        known: dict[bytes, int] = {}
        out = []
        for text in self.texts:
            words = text.encode().split(b" ")
            for w in words:
                if w not in known:
                    known[w] = _term(w)
            out.append([known[w] for w in words])
        return out


def _located(terms: np.ndarray, batches):
    """Per slice of texts: row of each text, terms that are in ``terms`` with text and position."""
    for rows in batches:
        data, offsets = flat_bytes(rows.column(1))
        for low, high in text_slices(offsets, SLICE_BYTES):
            part = LOWER[data[offsets[low] : offsets[high]]]
            words = find_words(part, offsets[low : high + 1] - offsets[low], ALPHANUMERIC)
            hashes = hash_words(part, words).view(np.int64)
            at = np.searchsorted(terms, hashes)
            at[at == len(terms)] = 0
            hit = np.flatnonzero(terms[at] == hashes) if len(terms) else np.zeros(0, np.int64)
            text = words.text[hit]
            yield rows, low, text, hashes[hit], hit - words.first[text]


def term_counts(texts: DataFrame, terms: np.ndarray) -> DataFrame:
    """``term, n``: how often each of ``terms`` occurs in all ``texts (key, text)``."""
    fields = concat_schema(term=pa.int64(), n=pa.int64())
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def emit(batches):
        total = np.zeros(len(shared.value), np.int64)
        for _, _, _, found, _ in _located(shared.value, batches):
            total += np.bincount(np.searchsorted(shared.value, found), minlength=len(total))
        some = np.flatnonzero(total)
        yield batch(fields, shared.value[some], total[some])

    return map_arrow(texts, emit, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(texts: DataFrame, terms: np.ndarray) -> DataFrame:
    """The positional inverted index of ``texts (key, text)`` for ``terms``: ``term, key, positions``
    with word positions from 0, ascending."""
    fields = concat_schema(term=pa.int64(), key=pa.binary(), positions=pa.list_(pa.int32()))
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def emit(batches):
        for rows, low, text, found, position in _located(shared.value, batches):
            keys = rows.column(0)
            order = np.lexsort((position, found, text))
            text, found, position = text[order], found[order], position[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
            head = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(head, len(text)), pa.int32()), pa.array(position, pa.int32())
            )
            yield batch(fields, found[head], keys.take(pa.array(low + text[head])), lists)

    return map_arrow(texts, emit, "term long, key binary, positions array<int>")


def _rarest(terms: list[int], counts: dict[int, int]) -> list[tuple[int, int]] | None:
    """``(term, offset)`` of the rarest distinct terms of a phrase, rarest first; None if one of its
    terms occurs nowhere."""
    first: dict[int, int] = {}
    for offset, term in enumerate(terms):
        if term not in counts:
            return None
        first.setdefault(term, offset)
    return sorted(first.items(), key=lambda x: (counts[x[0]], x[1]))[:RARE_TERMS]


@dataclass(frozen=True)
class Search:
    """A block's candidates and the phrases they are of: ``key, phrase, start``."""

    candidates: DataFrame
    phrases: Phrases


def search_block(texts: DataFrame, phrases: Phrases, within: int = 0) -> Search | None:
    """Places where a phrase may stand, from posting lists of its rarest terms.

    Counts of all test terms are taken over the whole corpus. Each phrase then reads the list of its
    rarest term, shifted by the term's offset in the phrase, and intersects it with the shifted list
    of the next rarest. With ``within`` > 0 (proximity) the lists are not shifted, and the two terms
    may be as far apart as the longest phrase and ``within`` more words allow. Phrases with a term that occurs nowhere are dropped. The number of
    candidates is at most the total length of the rarest lists.
    """
    spark = texts.sparkSession
    terms = phrases.terms()
    vocabulary = np.unique(np.array([t for ts in terms for t in ts], np.int64))
    counts = {r["term"]: r["n"] for r in term_counts(texts, vocabulary).collect()}  # bounded by the block
    plan, needed = [], set()
    for i, ts in enumerate(terms):
        rare = _rarest(ts, counts)
        if rare is None:
            continue
        (t1, o1), (t2, o2) = rare[0], rare[-1]
        needed |= {t1, t2}
        plan.append((i, t1, 0, t2, 0) if within else (i, t1, o1, t2, o2))
    if not plan:
        return None
    index = stored(postings(texts, np.array(sorted(needed), np.int64)))
    wanted = F.broadcast(spark.createDataFrame(plan, "phrase int, t1 long, o1 int, t2 long, o2 int"))
    first = (
        index.join(wanted, index["term"] == wanted["t1"])
        .select("key", "phrase", F.explode("positions").alias("p"), "o1", "t2")
        .select("key", "phrase", "t2", (F.col("p") - F.col("o1")).alias("start"))
    )
    second = (
        index.join(wanted, index["term"] == wanted["t2"])
        .select("key", "phrase", F.explode("positions").alias("p"), "o2")
        .select("key", "phrase", (F.col("p") - F.col("o2")).alias("start2"))
    )
    if within:
        reach = _reach(phrases, within)
        shifts = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift")
        second = (
            second.select("key", "phrase", "start2", shifts)
            .select("key", "phrase", (F.col("start2") + F.col("shift")).alias("start2"))
            .distinct()
        )
    both = first.join(
        second,
        (first["key"] == second["key"]) & (first["phrase"] == second["phrase"]) & (first["start"] == second["start2"]),
        "left_semi",
    )
    if not within:
        both = both.where("start >= 0")
    return Search(both.select("key", "phrase", "start").distinct(), phrases)


def _reach(phrases: Phrases, within: int) -> int:
    return max(len(ts) for ts in phrases.terms()) + within - 1


def _blocks(windows: DataFrame, most: int):
    """Distinct phrases in blocks of bounded size, each small enough for every worker."""
    phrases = stored(windows.select("phrase").distinct())
    n_blocks = -(-phrases.count() // most)
    block = F.pmod(F.xxhash64("phrase"), F.lit(max(1, n_blocks)))
    for i in range(n_blocks):
        yield Phrases(tuple(sorted(r["phrase"] for r in phrases.where(block == i).collect())))


_MATCH_FIELDS = concat_schema(key=pa.binary(), phrase=pa.string(), low=pa.int64(), high=pa.int64())


def verify(texts: DataFrame, search: Search, within: int = 0) -> DataFrame:
    """``key, phrase, low, high``: matches among the candidates, as ranges of word positions.

    Exact phrases stand word for word at their start. With ``within``, a match is a shortest range
    around a candidate's rare term of at most the phrase's length plus ``within`` words that holds all its
    words, as often as the phrase does, in any order.
    """
    phrases = texts.sparkSession.sparkContext.broadcast(search.phrases.texts)
    listed = search.candidates.groupBy("key").agg(F.collect_list(F.struct("phrase", "start")).alias("places"))

    def emit(batches):
        known: dict[int, list[bytes]] = {}
        for rows in batches:
            out = set()
            for key, text, places in zip(*(rows.column(i).to_pylist() for i in range(3))):
                words = _words(text.encode())
                for place in places:
                    i, start = place["phrase"], place["start"]
                    if i not in known:
                        known[i] = phrases.value[i].encode().split(b" ")
                    terms = known[i]
                    if not within:
                        if words[start : start + len(terms)] == terms:
                            out.add((key, phrases.value[i], start, start + len(terms)))
                        continue
                    found = _shortest(words, terms, start, within)  # start: where a rare term stands
                    if found:
                        out.add((key, phrases.value[i], *found))
            yield batch(_MATCH_FIELDS, *(map(list, zip(*sorted(out))) if out else [[]] * 4))

    joined = texts.join(listed, "key").select("key", "text", "places")
    return map_arrow(joined, emit, "key binary, phrase string, low long, high long").distinct()


def _shortest(words: list[bytes], terms: list[bytes], start: int, within: int) -> tuple[int, int] | None:
    """The shortest range around ``start`` that holds all ``terms``, leftmost of equals."""
    need: dict[bytes, int] = defaultdict(int)
    for t in terms:
        need[t] += 1
    reach = len(terms) + within
    low, missing, best = max(0, start - reach + 1), len(terms), None
    left = low
    for right in range(low, min(len(words), start + reach)):
        if words[right] in need:
            missing -= need[words[right]] > 0
            need[words[right]] -= 1
        while missing == 0:
            if right + 1 - left <= reach and (best is None or right + 1 - left < best[1] - best[0]):
                best = (left, right + 1)
            if words[left] in need:
                need[words[left]] += 1
                missing += need[words[left]] > 0
            left += 1
    return best


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """128 bits of id and text: tells rows with one id but different texts apart, not true copies."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.lit(":"), text_column(docs, text_col))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, id, text``."""
    return docs.select(
        _key(docs, id_col, text_col).alias("key"),
        F.col(id_col).cast("long").alias("id"),
        text_column(docs, text_col).alias("text"),
    )


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    within: int = 0,
    block: int = BLOCK_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """``id, item, phrase, low, high``: where windows of benchmark items stand in ``docs``, exactly
    or, with ``within``, in proximity."""
    windows = stored(benchmark_windows(benchmark, window, item_col, text_col))
    texts = _keyed(docs, id_col, text_col)
    found = _all_matches(texts.select("key", "text"), windows, within, block)
    ids = texts.select("key", "id").distinct()
    return (
        found.join(ids, "key")
        .join(windows, "phrase")
        .select(F.col("id").alias(id_col), "item", "phrase", "low", "high")
    )


def _all_matches(texts: DataFrame, windows: DataFrame, within: int, block: int) -> DataFrame:
    """The matches of all blocks, each appended to one table in the shared folder."""
    spark, schema = texts.sparkSession, "key binary, phrase string, low long, high long"
    path = shared_folder(spark)
    spark.createDataFrame([], schema).write.parquet(path)
    for phrases in _blocks(windows, block):
        search = search_block(texts, phrases, within)
        if search:
            verify(texts, search, within).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _judged(
    docs: DataFrame, benchmark: DataFrame, window: int, block: int, id_col: str, text_col: str, item_col: str
) -> DataFrame:
    """``key, id`` and what :func:`contamination` says, per row."""
    windows = stored(benchmark_windows(benchmark, window, item_col, text_col))
    texts = _keyed(docs, id_col, text_col)
    found = _all_matches(texts.select("key", "text"), windows, 0, block)

    spots = found.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spots"))
    merged = F.aggregate(
        F.sort_array("spots"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["high"] - F.greatest(x["low"], s["end"]), F.lit(0).cast("long"))).alias("n"),
            F.greatest(s["end"], x["high"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    items = (
        found.select("key", "phrase").distinct().join(windows, "phrase").groupBy("key")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hits = spots.select("key", merged.alias("n_hit")).join(items, "key", "left")
    counted = count_words(texts)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    empty = F.array().cast("array<string>")
    return counted.join(hits, "key", "left").select(
        "key",
        "id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", empty)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", empty)), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    block: int = BLOCK_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``.

    A word is hit inside any occurrence of a window. A NULL, empty or wordless text has no words and
    no hits. Repeated rows (NULL ids too) each give a row; an item id listed twice counts once, and
    a NULL item id reads 'null'. Other columns are ignored; an empty benchmark hits nothing.
    """
    judged = _judged(docs, benchmark, window, block, id_col, text_col, item_col)
    return judged.drop("key").withColumnRenamed("id", id_col)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    block: int = BLOCK_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """Rows of ``docs``, with all their columns, that :func:`contamination` leaves. Rows are judged by
    id and text together, so NULL and repeated ids are no obstacle."""
    judged = _judged(docs, benchmark, window, block, id_col, text_col, item_col)
    name = unused_name(docs, "key")
    bad = judged.where("contaminated").select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, _key(docs, id_col, text_col)).join(bad, name, "left_anti").select(*docs.columns)


def count_words(texts: DataFrame) -> DataFrame:
    """``key, id, n_words`` per row of ``texts (key, id, text)``."""
    fields = concat_schema(key=pa.binary(), id=pa.int64(), n_words=pa.int64())

    def emit(batches):
        for rows in batches:
            data, offsets = flat_bytes(rows.column(2))
            for low, high in text_slices(offsets, SLICE_BYTES):
                part = LOWER[data[offsets[low] : offsets[high]]]
                words = find_words(part, offsets[low : high + 1] - offsets[low], ALPHANUMERIC)
                yield batch(fields, rows.column(0)[low:high], rows.column(1)[low:high], words.counts)

    return map_arrow(texts.select("key", "id", "text"), emit, "key binary, id long, n_words long")
