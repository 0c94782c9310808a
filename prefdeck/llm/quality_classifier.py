"""Quality classifier: random-indexing word vectors, pooled per document, and a small network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefdeck.llm.bytewords import ALPHANUMERIC, LOWER, NOT_SPACE, U, find_words, hash_words, mix
from prefdeck.llm.common import batch, concat_schema, flat_bytes, map_arrow, stored, text_column, text_slices
from prefdeck.llm.toxicity import labelled_sample

BUCKETS = 1 << 14  # rows of the table of word vectors; words share rows by hash
DIMENSIONS = 32
NONZERO = 2  # entries of an index vector
REACH = (1, 2)  # distances of the neighbours whose index vectors a word gathers
SLICE_BYTES = 1 << 19
_SIGNS = ~(ALPHANUMERIC | ~NOT_SPACE)


def find_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each token, in text order; runs of letters and digits, and runs of other
    signs, are tokens."""
    data = LOWER[data]
    words, signs = find_words(data, offsets, ALPHANUMERIC), find_words(data, offsets, _SIGNS)
    start = np.concatenate([words.start, signs.start])
    order = np.argsort(start, kind="stable")
    hashes = np.concatenate([hash_words(data, words), hash_words(data, signs)])[order]
    text = np.concatenate([words.text, signs.text])[order]
    return (hashes % U(BUCKETS)).astype(np.int64), text


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the sparse random vector of each bucket: a rule, not data."""
    draw = mix(np.arange(BUCKETS * NONZERO, dtype=U) + U(0x5EED)).reshape(BUCKETS, NONZERO)
    return (draw % U(DIMENSIONS)).astype(np.int64), np.where(draw >> U(63), 1.0, -1.0)


_NAMES = [f"c{i}" for i in range(DIMENSIONS)]
_CONTEXT = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), *((c, pa.int32()) for c in _NAMES)])
CONTEXT = "bucket int, n long, " + ", ".join(f"{c} int" for c in _NAMES)


def context_sums(texts: DataFrame) -> DataFrame:
    """``bucket, n, c0 .. c31``: per bucket, how often its words occur in all ``texts (id, text)``
    and the sum of the index vectors of their neighbours."""

    def emit(batches):
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        seen = np.zeros(BUCKETS, np.int64)
        for rows in batches:
            data, offsets = flat_bytes(rows.column(1))
            for low, high in text_slices(offsets, SLICE_BYTES):
                bucket, text = find_tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                seen += np.bincount(bucket, minlength=BUCKETS)
                for d in REACH:
                    if len(bucket) <= d:
                        continue
                    near = text[d:] == text[:-d]
                    a, b = bucket[:-d][near], bucket[d:][near]
                    for word, neighbour in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(
                                word * DIMENSIONS + places[neighbour, k], signs[neighbour, k], BUCKETS * DIMENSIONS
                            )
        used = np.flatnonzero(seen)
        columns = np.rint(total).astype(np.int32).reshape(BUCKETS, DIMENSIONS)[used].T
        for at in range(0, len(used), 2048):
            part = slice(at, at + 2048)
            yield batch(_CONTEXT, used[part].astype(np.int32), seen[used][part], *(c[part] for c in columns))

    return (
        map_arrow(texts, emit, CONTEXT)
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), *[F.sum(c).cast("double").alias(c) for c in _NAMES])
    )


@dataclass(frozen=True)
class WordVectors:
    vectors: np.ndarray  # BUCKETS x DIMENSIONS, unit rows
    weights: np.ndarray  # BUCKETS, smaller for frequent words

    @staticmethod
    def from_sums(rows: list) -> WordVectors:
        table = np.zeros((BUCKETS, DIMENSIONS))
        n = np.zeros(BUCKETS)
        for r in rows:
            n[r["bucket"]] = r["n"]
            table[r["bucket"]] = [r[c] for c in _NAMES]
        norm = np.linalg.norm(table, axis=1, keepdims=True)
        vectors = table / np.maximum(norm, 1e-9)
        share = n / max(n.sum(), 1.0)
        mean = share @ vectors
        return WordVectors((vectors - mean).astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32))


N_FEATURES = 2 * DIMENSIONS + 4
_FEATURES = concat_schema(id=pa.int64(), x=pa.list_(pa.float32()))


def pool(data: np.ndarray, offsets: np.ndarray, words: WordVectors) -> np.ndarray:
    """Per text: weighted mean and spread of its word vectors, share of tokens that repeat one of
    the two before, mean weight, share of signs among bytes, logarithm of the number of tokens."""
    n = len(offsets) - 1
    bucket, text = find_tokens(data, offsets)
    out = np.zeros((n, N_FEATURES), np.float32)
    count = np.bincount(text, minlength=n)
    weight = words.weights[bucket]
    total = np.maximum(np.bincount(text, weight, n), 1e-6)
    first = np.searchsorted(text, np.arange(n))
    some = np.flatnonzero(count)
    if len(some):
        moved = words.vectors[bucket] * weight[:, None]
        mean = np.add.reduceat(moved, first[some], axis=0) / total[some, None]
        square = np.add.reduceat(moved * words.vectors[bucket], first[some], axis=0) / total[some, None]
        out[some, :DIMENSIONS] = mean
        out[some, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
    same = np.zeros(len(bucket), bool)
    for d in REACH:
        same[d:] |= (bucket[d:] == bucket[:-d]) & (text[d:] == text[:-d])
    sign_total = np.append(0, np.cumsum(_SIGNS[data], dtype=np.int64))
    size = np.maximum(np.diff(offsets), 1)
    out[:, -4] = np.bincount(text[same], minlength=n) / np.maximum(count, 1)
    out[:, -3] = total / np.maximum(count, 1)
    out[:, -2] = (sign_total[offsets[1:]] - sign_total[offsets[:-1]]) / size
    out[:, -1] = np.log1p(count)
    return out


def document_features(texts: DataFrame, words: WordVectors) -> DataFrame:
    """``id, x`` per row of ``texts (id, text)``."""
    # Arrays only: workers need not be able to import this package.
    shared = texts.sparkSession.sparkContext.broadcast((words.vectors, words.weights))

    def emit(batches):
        table = WordVectors(*shared.value)
        for rows in batches:
            data, offsets = flat_bytes(rows.column(1))
            for low, high in text_slices(offsets, SLICE_BYTES):
                x = pool(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], table)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel(), pa.float32())
                )
                yield batch(_FEATURES, rows.column(0)[low:high], lists)

    return map_arrow(texts, emit, "id long, x array<float>")


@dataclass(frozen=True)
class Network:
    """Standardised input, a tanh layer, a logit; divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 0) -> Network:
    """Adam on the log loss with weight decay; a fifth of the rows is set aside to choose the
    temperature. With one label only (or no rows) the network is the smoothed rate."""
    d = N_FEATURES
    if len(y) < 20 or y.min() == y.max():
        rate = (y.sum() + 1.0) / (len(y) + 2.0)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 ** (epoch / 20)
        mixed = rng.permutation(used)
        for at in range(0, len(mixed), 256):
            rows = mixed[at : at + 256]
            a, b = z[rows], y[rows]
            h = np.tanh(a @ p[0] + p[1])
            q = 1.0 / (1.0 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
            e = (q - b) / len(rows)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], e.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    return Network(mean, scale, p[0], p[1], p[2], float(p[3]), best_temperature(net.logits(x[held]), y[held]))


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log loss, on a grid from 1/4 to 8."""
    grid = 2.0 ** np.linspace(-2, 3, 101)

    def loss(t: float) -> float:
        s = np.where(y > 0, logits, -logits) / t
        return float(np.mean(np.logaddexp(0, -s)))

    return float(min(grid, key=loss))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    usable,
    max_labels: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, score`` per row of ``docs``: calibrated probability of quality 1.

    Word vectors gather the contexts of all documents; their table has a fixed number of rows, so it
    is collected and broadcast at 2 MB. The network is fitted on at most ``max_labels`` labelled ids
    of ``labels (doc_id, quality)`` where ``usable`` holds, chosen by a hash of the id. A NULL or
    empty text has the features of no words and gets the score of those. Repeated rows (NULL ids
    too) each give a row; other columns are ignored; no rows give none. Without labels all scores
    are 0.5.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).alias("text"))
    words = WordVectors.from_sums(context_sums(texts).collect())  # at most BUCKETS rows
    rows = stored(document_features(texts, words))
    sample = F.broadcast(labelled_sample(labels, "quality", usable, max_labels))
    known = rows.join(sample, rows["id"] == sample["doc_id"]).orderBy(F.xxhash64("id", "x")).limit(max_labels).select("x", "label").toArrow()
    x = known.column("x").combine_chunks()
    x = np.asarray(x.values if isinstance(x, pa.ListArray) else pa.concat_arrays(x.chunks).values, np.float64).reshape(-1, N_FEATURES)
    network = train(x, known.column("label").to_numpy().astype(float))
    fields = concat_schema(id=pa.int64(), score=pa.float64())

    def score(batches):
        for part in batches:
            x = np.asarray(part.column(1).flatten(), np.float64).reshape(-1, N_FEATURES)
            yield batch(fields, part.column(0), network.probability(x))

    return map_arrow(rows, score, "id long, score double").withColumnRenamed("id", id_col)
