"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefdeck.llm.common import stored
from prefdeck.operators.skew import dense_index, running_total

CHUNK_ROWS = 100_000  # rows of one source that are sorted together, about
LEAST_STEPS = 16  # chunks per doubling of the keys at least
HEX_DIGITS = 13  # of a digest: 52 bits, which a double holds


def n_words(text: Column) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sign_free_share(text: Column) -> Column:
    """A quality weight from 0.05 to 1: the share of characters that are none of ``#*$%&|<>{}~^``, to the
    fourth power. NULL and empty texts get 1."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.length(F.translate(text, "#*$%&|<>{}~^", ""))
    share = F.when(F.length(text) > 0, plain / F.length(text)).otherwise(F.lit(1.0))
    return F.greatest(share * share * share * share, F.lit(0.05))


def exponential_key(seed: int, weight: Column, *columns: Column) -> Column:
    """An exponential variable with the rate ``weight``, drawn from the md5 of the seed and ``columns``.

    Rows in ascending order of it are a weighted sample without replacement, whatever number is
    taken from the front: the logarithm of Efraimidis and Spirakis' key u^(1/weight), negated.
    """
    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])
    bits = F.conv(F.substring(F.md5(name), 1, HEX_DIGITS), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 4 * HEX_DIGITS)) / weight


def targets(sizes: DataFrame, weights: Sequence[float], most_epochs: float) -> DataFrame:
    """``key, source_size, target`` from ``sizes (key, source_size)``, a row per source.

    Sources take ``weights`` in turn, in the order of ``key``, and share the sum of all sizes by them. No
    target exceeds ``most_epochs`` times its source; what is too much goes to the other sources by
    weight. Each round stops the sources above the common level, which raises the level; that ends
    when none is above. Only sums leave the executors.
    """
    spark = sizes.sparkSession
    chunked = sizes.withColumn("chunk", F.substring("key", 1, 3))
    placed = dense_index(chunked, "place", order=["key"], chunk=["chunk"]).drop("chunk")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(placed.withColumns({"share": share, "cap": F.col("source_size") * float(most_epochs)}))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        stopped = F.lit(False) if level is None else F.col("share") * level > F.col("cap")
        found = rows.agg(
            F.sum(F.when(stopped, F.col("cap")).otherwise(0.0)).alias("spent"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("share"))).alias("open"),
        ).first()
        if not found["open"]:
            break
        higher = (total - found["spent"]) / found["open"]
        if level is not None and higher <= level:
            break
        level = higher
    target = F.least(F.col("cap"), F.col("share") * F.lit(float(level or 0.0)))
    return rows.select("key", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    most_epochs: float = 3.0,
    quality: Column | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``id, size, source_size, target, taken`` per row of ``docs``: how many of its words the mix takes,
    repeats counted.

    A source whose target is some multiple of its size first gives that many complete epochs. The
    rest is a sample without replacement: documents in the order of exponential keys scaled by
    ``quality`` (a column over ``docs``, positive; by default :func:`sign_free_share`), each whole while
    the budget lasts; the one at the border gives its first words. So a source takes its target
    rounded down, no document is taken more often than ``most_epochs`` times rounded up, and reruns
    agree, as keys follow from the seed, id and text alone.

    Sizes are words; a NULL, empty or blank text has none and gives none. Sources are ordered
    bytewise, NULL last; an empty name is a source of its own. NULL ids and repeated rows take part,
    each by itself; among rows equal in id and text the mix may take one or another. Other columns
    are ignored; no rows give none. Texts are read once; a source that holds most rows is cut at its
    keys, so no task sorts more than about CHUNK_ROWS of them.
    """
    source = F.col(source_col).cast("string")
    weight = sign_free_share(F.col(text_col)) if quality is None else quality.cast("double")
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("~")).alias("key"),  # NULL last
            n_words(F.col(text_col)).alias("size"),
            exponential_key(seed, weight, F.col(id_col), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("draw"),
        )
    )
    sizes = stored(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    aims = stored(targets(sizes.select("key", "source_size"), weights, most_epochs))
    # Whatever the weights, at most 0.26 / steps of a source's draws fall between neighbours of this
    # grid, as an exponential variable is nowhere denser than 1 / e per unit of its logarithm.
    steps = (LEAST_STEPS + F.ceil(F.col("n") / CHUNK_ROWS)).alias("steps")
    cut = rows.join(sizes.select("key", steps), "key").withColumn("chunk", F.floor(F.log2("draw") * F.col("steps")))
    summed = running_total(
        cut.drop("steps"), F.col("size"), "before", order=["draw", "id", "size"], chunk=["chunk"], keys=["key"]
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    extra = F.greatest(F.least(rest - F.col("before"), F.col("size")), F.lit(0))
    return summed.join(aims, "key").select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (epochs * F.col("size") + extra).cast("long").alias("taken"),
    )
