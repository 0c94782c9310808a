"""WARC archives of pages, and a globally ordered index of their captures by external merge."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefdeck.llm.common import batch, concat_schema, map_arrow, shared_folder, stored
from prefdeck.llm.url_filters import host_of

CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MERGE_ROWS = 100_000  # index entries that a merging task holds
READ_AHEAD = 64  # entries of a run that are Python objects at a time
RECORD = "urn:prefdeck:page:"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's or binary's bytes: 20 bytes, four groups of 5."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _boundary(token: str) -> str:
    """The first lines of every record of an archive. The token is drawn when the archive is
    written, so no payload holds it, and records can be found without reading lengths first."""
    return f"WARC/1.1{CRLF}X-Archive-Boundary: {token}{CRLF}"


def classify(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``id, url, captured, html, digest, refers_to, is_response`` from ``id, url, captured, html``.

    Among equal payloads of at least ``min_bytes`` the row with the largest id is the response. The
    winners are one row per payload, folded map-side; both sides of the join are fresh shuffles, so
    AQE splits a payload that very many pages have.
    """
    rows = pages.withColumn("digest", base32_sha1(F.col("html"))).withColumn(
        "rank", F.struct("id", F.xxhash64("url").alias("u"))
    )
    best = rows.groupBy("digest").agg(F.max("rank").alias("best"))
    same = F.col("rank").eqNullSafe(F.col("best")) | (F.octet_length("html") < min_bytes)
    return rows.join(best, "digest").select(
        "id", "url", "captured", "html", "digest", F.when(~same, F.col("best.id")).alias("refers_to"), same.alias("is_response")
    )


def write_archives(pages: DataFrame, path: str, token: str, min_bytes: int) -> None:
    """A gzipped WARC file per task, below ``path``. Written by Spark's committer: a lost task leaves
    nothing behind. Revisit records hold no payload."""
    rows = classify(pages, min_bytes)
    name = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")
    payload = F.when(F.col("is_response"), F.col("html")).otherwise("")
    length = F.octet_length(payload) + len(HTTP_HEAD)
    revisit = F.when(
        ~F.col("is_response"),
        F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "),
            name("refers_to"),
            F.lit(CRLF),
        ),
    ).otherwise("")
    record = F.concat(
        F.lit(_boundary(token) + "WARC-Type: "), F.when(F.col("is_response"), "response").otherwise("revisit"),
        F.lit(CRLF + "WARC-Record-ID: "), name("id"),
        F.lit(CRLF + "WARC-Date: "), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(CRLF + "WARC-Target-URI: "), url,
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(CRLF), revisit,
        F.lit("Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), length.cast("string"),
        F.lit(CRLF + CRLF + HTTP_HEAD), payload,
        F.lit("\r\n\r"),
    )
    # The writer's line end completes the CR LF CR LF behind a record.
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str, token: str) -> DataFrame:
    """Records of archives that :func:`write_archives` wrote with ``token``: ``id, url, captured,
    record_type, refers_to, payload_bytes, payload_digest``; length and digest are taken from the
    payload of responses, and from the header (NULL length) of revisits. A record whose length does
    not fit its header fails the read."""
    lines = spark.read.option("lineSep", _boundary(token)).text(path).where("value <> ''")
    header = F.substring_index("value", CRLF + CRLF, 1)
    raw = F.col("value").cast("binary")

    def field(name: str) -> Column:
        found = F.regexp_extract(F.concat(F.lit(CRLF), F.col("header"), F.lit(CRLF)), rf"\n{name}: ?([^\r\n]*)\r", 1)
        return F.nullif(found, F.lit(""))

    def record_id(name: str) -> Column:
        return F.regexp_extract(field(name), rf"^<{RECORD}(-?\d+)>$", 1)

    parts = (
        lines.select(raw.alias("raw"), header.alias("header"))
        .withColumn("at", F.octet_length("header") + 4)
        .withColumn("length", field("Content-Length").cast("int"))
        .withColumn("fits", F.octet_length("raw") == F.col("at") + F.col("length") + 4)
        .withColumn("block", F.when(F.col("fits"), F.col("raw")).otherwise(F.raise_error(F.lit("damaged WARC record"))))
        .withColumn("payload", F.substring("block", F.col("at") + len(HTTP_HEAD) + 1, F.col("length") - len(HTTP_HEAD)))
        .withColumn("record_type", field("WARC-Type"))
    )
    whole = F.col("record_type") == "response"
    return parts.select(
        F.nullif(record_id("WARC-Record-ID"), F.lit("")).cast("long").alias("id"),
        field("WARC-Target-URI").alias("url"),
        F.to_timestamp(field("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        "record_type",
        F.nullif(record_id("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
        F.when(whole, F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.substring(field("WARC-Payload-Digest"), 6, 32)).alias("payload_digest"),
    )


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with the length of the payload they refer to; a revisit without one fails."""
    known = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    joined = records.join(known, "payload_digest", "left")
    size = F.coalesce("payload_bytes", "full_bytes", F.raise_error(F.lit("revisit of no response")).cast("long"))
    return joined.withColumn("payload_bytes", size).drop("full_bytes")


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then what follows the host."""
    host = F.concat_ws(",", F.reverse(F.split(host_of(url), r"\.")))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.coalesce(F.concat(host, F.lit(")"), rest), F.lit(""))


class LoserTree:
    """K-way merge of sorted runs: a tournament whose inner nodes keep the losers, so the next entry
    costs one comparison per level. Runs are iterators of ``(key, entry)``; equal keys come in the
    order of the runs."""

    def __init__(self, runs: Iterable[Iterator[tuple[Any, Any]]]) -> None:
        self.runs = list(runs)
        self.heads = [next(run, None) for run in self.runs]
        self.losers = [-1] * max(1, len(self.runs))
        for i in range(len(self.runs)):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def _play(self, winner: int) -> None:
        """Send a leaf up. While the tree fills, a leaf waits at the first empty node."""
        node = (winner + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[Any]:
        while self.runs and self.heads[self.losers[0]] is not None:
            best = self.losers[0]
            yield self.heads[best][1]
            self.heads[best] = next(self.runs[best], None)
            self._play(best)


_ENTRY = concat_schema(
    url_key=pa.string(), captured_s=pa.int64(), id=pa.int64(), record_type=pa.string(), refers_to=pa.int64(),
    payload_bytes=pa.int64(), payload_digest=pa.string(), run=pa.int32(),
)
ENTRY = "url_key string, captured_s long, id long, record_type string, refers_to long, payload_bytes long, payload_digest string, run int"


def merge_runs(entries: DataFrame) -> DataFrame:
    """Index entries in the order of (url key, capture time, id), over the whole result.

    Each task sorts its entries: a run, stored with its number. Ranges of the order are then dealt
    out, each small enough for a task, also inside one url key; Spark hands a task its slices of the
    runs one behind the other, each in order, by an external sort. The slices stay in Arrow columns;
    a loser tree merges them through iterators, which hold a few entries of each run, and streams the
    result.
    """
    key = ["url_key", "captured_s", "id", "payload_digest"]
    runs = stored(
        entries.withColumn("run", F.spark_partition_id()).sortWithinPartitions(*key).select(_ENTRY.names)
    )
    n = max(1, -(-runs.count() // MERGE_ROWS), int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def entries_of(slices: list[pa.RecordBatch]) -> Iterator[tuple[Any, tuple]]:
        for rows in slices:
            for at in range(0, rows.num_rows, READ_AHEAD):
                part = rows.slice(at, READ_AHEAD)
                for e in zip(*(column.to_pylist() for column in part.columns)):
                    yield (e[0], e[1], e[2] is not None, e[2] or 0, e[6]), e

    def merge(batches):
        slices: dict[int, list[pa.RecordBatch]] = {}
        for rows in batches:
            run = rows.column(len(_ENTRY) - 1).to_numpy()
            edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            for low, high in zip(edges[:-1], edges[1:]):
                if high > low:
                    slices.setdefault(int(run[low]), []).append(rows.slice(low, high - low))
        held = []
        for entry in LoserTree(entries_of(slices[r]) for r in sorted(slices)):
            held.append(entry)
            if len(held) == 10_000:
                yield batch(_ENTRY, *map(list, zip(*held)))
                held = []
        if held:
            yield batch(_ENTRY, *map(list, zip(*held)))

    ranged = runs.repartitionByRange(n, *key).sortWithinPartitions("run", *key)
    return map_arrow(ranged, merge, ENTRY)


def archive_pages(
    pages: DataFrame,
    path: str | None = None,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    time_col: str | None = None,
) -> DataFrame:
    """Write ``pages`` as WARC archives below ``path`` (or a new shared folder), read them back, and
    return the index of captures in global order: ``id, payload_bytes, payload_digest, record_type,
    refers_to, url_key, captured_s``.

    Equal payloads of at least ``min_bytes`` bytes are stored once, with the page of the largest id;
    the others are revisit records. NULL html is an empty payload; a NULL url has an empty key.
    True copies (same id, url and html) are all what one of them is. NULL ids order before all
    others. Without ``time_col`` capture times are stand-ins that follow the id. Other columns are
    ignored; no rows give none.
    """
    spark = pages.sparkSession
    path = path or shared_folder(spark)
    token = uuid.uuid4().hex
    number = F.col(id_col).cast("long")
    time = F.col(time_col) if time_col else F.timestamp_seconds(F.pmod(F.coalesce(number, F.lit(0)), F.lit(1 << 32)))
    rows = pages.select(
        number.alias("id"), F.col(url_col).cast("string").alias("url"), time.alias("captured"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    write_archives(rows, path, token, min_bytes)
    records = stored(read_archives(spark, path, token))
    entries = resolve(records).select(
        url_key(F.col("url")).alias("url_key"), F.unix_seconds("captured").alias("captured_s"), "id", "record_type",
        "refers_to", "payload_bytes", "payload_digest",
    )
    return merge_runs(entries).select(
        F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_s"
    )
