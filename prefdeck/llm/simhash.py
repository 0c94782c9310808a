"""SimHash near-duplicates through pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from prefdeck.llm.bytewords import LOWER
from prefdeck.llm.common import flat_bytes, map_arrow, row_digest, stored, text_column, unused_name
from prefdeck.llm.graph import components

BITS = 64
HASH_SEED = 42
HOT_BLOCK = 512  # distinct fingerprints in one block beyond which it is not joined pair by pair


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Majority of each bit over the hashes of all shingles, repeats included. Fewer words than a
    shingle are one shingle; no words give zero."""
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, HASH_SEED) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(texts: DataFrame, shingle: int) -> DataFrame:
    """The columns of ``texts`` but ``text``, and ``fp``, per row; A-Z counts as a-z, words stand between
    ASCII white space."""
    carried = [c for c in texts.columns if c != "text"]

    def prints(batches):
        for rows in batches:
            data, offsets = flat_bytes(rows.column(len(carried)))
            lowered = LOWER[data].tobytes()
            fps = [
                fingerprint(lowered[a:b].split(), shingle) for a, b in zip(offsets[:-1], offsets[1:])
            ]
            found = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(carried)], found], [*carried, "fp"])

    schema = StructType([*(texts.schema[c] for c in carried), StructField("fp", LongType())])
    return map_arrow(texts.select(*carried, "text"), prints, schema)


def _blocks(n_blocks: int) -> list[int]:
    """Masks of ``n_blocks`` runs of bits, as even as can be."""
    edges = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_pairs(prints: DataFrame, distance: int, n_blocks: int, hot: int = HOT_BLOCK) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fp``, that connect exactly what links at
    ``distance`` or fewer bits connect.

    ``distance`` differing bits touch at most that many blocks, so close fingerprints agree on some
    ``n_blocks - distance`` whole blocks: those bits are the join key, and the Hamming distance is
    verified in the join. A key with more than ``hot`` fingerprints is not joined pair by pair:
    there, two fingerprints are close exactly if some number differs from each in at most half of
    the distance (rounded up and down), so each lists the numbers around it and is linked to the
    smallest fingerprint that lists the same one. That is linear in the size of the block.
    """
    masks = _blocks(n_blocks)
    keys = [
        (i, sum(masks[b] for b in chosen))
        for i, chosen in enumerate(combinations(range(n_blocks), n_blocks - distance))
    ]
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for i, m in keys
        ]
    )
    blocks = stored(prints.select("fp", F.explode(listed).alias("b")).select("b.part", "b.key", "fp"))
    sizes = blocks.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")

    cool = blocks.join(sizes.where(F.col("n") <= hot).select("part", "key"), ["part", "key"])
    a, b = cool.select("part", "key", F.col("fp").alias("u")), cool.select("part", "key", F.col("fp").alias("v"))
    joined = a.join(b, ["part", "key"]).where((F.col("u") > F.col("v")) & (_hamming(F.col("u"), F.col("v")) <= distance))

    crowded = blocks.join(sizes.where(F.col("n") > hot).select("part", "key"), ["part", "key"])
    near, far = distance // 2, (distance + 1) // 2
    # Numbers within `far` bits, and whether they are within `near` bits too, outside the key bits.
    free = {i: [_signed(1 << k) for k in range(BITS) if not m >> k & 1] for i, m in keys}

    def flips(bits: list[int], most: int) -> list[tuple[int, int]]:
        out = []
        for n in range(most + 1):
            for chosen in combinations(bits, n):
                mask = 0
                for bit in chosen:
                    mask ^= bit
                out.append((n, mask))
        return out

    by_part = F.create_map(
        *[
            x
            for i, bits in free.items()
            for x in (F.lit(i), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("flip")) for n, f in flips(bits, far)]))
        ]
    )
    around = (
        crowded.select("part", "key", "fp", F.explode(F.element_at(by_part, F.col("part"))).alias("f"))
        .select("part", "key", "fp", "f.n", F.col("fp").bitwiseXOR(F.col("f.flip")).alias("middle"))
    )
    # Every listing within `far` meets the smallest listing within `near`; the other way round is
    # the same pair. With an even distance both are the same list.
    lowest = around.where(F.col("n") <= near).groupBy("part", "key", "middle").agg(F.min("fp").alias("v"))
    starred = around.join(lowest, ["part", "key", "middle"]).where("fp <> v")
    return joined.select("u", "v").unionByName(starred.select(F.col("fp").alias("u"), "v")).distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    distance: int = 2,
    n_blocks: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, fingerprint, component_id`` per row of ``docs``.

    Copies fold into one fingerprint first; blocks, links and components are over distinct
    fingerprints only. ``component_id`` is the smallest id among all rows whose fingerprints can be
    reached over links of at most ``distance`` bits. A NULL, empty or blank text has fingerprint
    zero and is linked like any other. NULL ids take part and are never the smallest; a component
    of NULL ids alone has a NULL id. Repeated rows each give a row; other columns are ignored; no
    rows give none.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).alias("text"))
    prints = stored(fingerprints(texts, shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")))
    grouped = _rooted(classes, distance, n_blocks)
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _rooted(classes: DataFrame, distance: int, n_blocks: int) -> DataFrame:
    """``classes (fp, low)`` with the ``root`` of the component of each fingerprint."""
    rooted = components(close_pairs(classes.select("fp"), distance, n_blocks))
    return classes.join(rooted, classes["fp"] == rooted["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )


def drop_near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    distance: int = 2,
    n_blocks: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of ``docs``, with all its columns, of each component of :func:`near_duplicates`: that
    with the smallest id.

    NULL ids come last. Of rows with the same id, the one with the smallest digest of all columns
    stays; rows equal in every column count as one. All texts without words are one component.
    Rows are told apart by a 128-bit digest of all columns, which no later job can number
    otherwise. Equal rows fold map-side before texts are shuffled, once.
    """
    key = unused_name(docs, "key")
    keyed = docs.withColumn(key, row_digest(docs))
    texts = keyed.select(
        F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col(key).alias("row")).alias("low"),
        text_column(docs, text_col).alias("text"),
    )
    prints = stored(fingerprints(texts, shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("low").alias("low")))
    lowest = _rooted(classes, distance, n_blocks).groupBy("root").agg(F.min("low").alias("low"))
    kept = lowest.select(F.col("low.row").alias(key))
    distinct = keyed.groupBy(key).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return distinct.join(kept, key).select("row.*")
