"""The filter audit against filters applied one after the other."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import brute
from prefdeck.llm import filter_audit
from prefdeck.llm.oracle import ORACLE
from prefdeck.llm.queries import QUERIES


def failures(docs):
    """Per document: the letters of the filters that it fails."""
    first = {}
    for doc_id, _, text in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, _, text in docs:
        text = text or ""
        words = brute.SPACED.findall(text)
        out.append(
            "A" * (len(words) < 50)
            + "B" * (100 * len(set(words)) < 65 * len(words))
            + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
            + "D" * bool(re.search(r"[#$%&*|]", text))
            + "E" * (doc_id is not None and doc_id > first[text])
        )
    return out


def audit(docs, labels):
    known = {}
    for doc_id, quality, toxic in labels:
        q, t = known.get(doc_id, (None, None))
        known[doc_id] = tuple(max((x for x in pair if x is not None), default=None) for pair in ((q, quality), (t, toxic)))
    by_part = defaultdict(list)
    for (doc_id, part, _), failed in zip(docs, failures(docs)):
        by_part[part or ""].append((failed, *(known.get(doc_id, (None, None)) if doc_id is not None else (None, None))))
    out = []
    for part, rows in by_part.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = rows
            gone = []
            for step, letter in enumerate(order, 1):
                cut = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                removed_by[letter] += len(cut)
                out.append([
                    part, "".join(order), step, len(left), len(cut), sum(letter in r[0] for r in gone),
                    sum(r[0] == letter for r in rows), sum(r[1] == 1 for r in cut), sum(r[2] == 1 for r in cut), letter,
                ])
                gone += cut
        for row in out:
            if row[0] == part:
                row[9] = removed_by[row[9]]
    return sorted(map(tuple, out))


@pytest.fixture(scope="module")
def mixed(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["Big", "LOUD", "50%", "naïve", "中文", "x|y"]
    rows = []
    for i in range(300):
        pool = words if i % 3 else words[:20]
        text = draw.choice([" ", "\n", "\t  "]).join(draw.choice(pool) for _ in range(draw.choice([5, 49, 50, 51, 90])))
        rows.append((i, draw.choice(["a", "a", "a", "b", "", None]), text.upper() if i % 11 == 0 else text))
    rows += [(1000 + i, "b", rows[i % 3][2]) for i in range(120)]  # copies
    rows += [(None, "b", rows[0][2]), (None, None, None), (2000, "a", ""), (2001, "a", None), (2001, "a", None), (2002, "c", "W " * 600_000)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 1100, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*r, "m", 1) for r in rows], "doc_id long, source string, text string, mask string, n int")
    return docs.repartition(4), rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("shard_bytes", [2000, 4 << 20])
def test_audit_matches_filters_in_a_row(mixed, shard_bytes):
    docs, rows, labels, known = mixed
    got = filter_audit.filter_audit(docs, labels, shard_bytes=shard_bytes)
    assert sorted(map(tuple, got.collect())) == audit(rows, known)


def few_codes(word):
    """A hash with many clashes."""
    return F.pmod(F.xxhash64(word), F.lit(40))


@pytest.mark.parametrize("code", [filter_audit.word_code, few_codes])
def test_matrix_is_encoded_by_one_dictionary(mixed, code):
    docs, rows, _, _ = mixed
    shards = filter_audit.matrix_shards(docs, shard_bytes=2000)
    words = {w for s in shards.collect() for w in map(bytes, s.words)}
    assert words == {w.encode() for _, _, t in rows for w in brute.SPACED.findall(t or "")}
    matrix = filter_audit.document_terms(docs, shard_bytes=2000, code=code).collect()
    assert len(matrix) > 4
    seen = defaultdict(set)
    for shard in matrix:
        for i, doc_id in enumerate(shard.docs):
            low, high = shard.starts[i], shard.starts[i + 1]
            terms = shard.terms[low:high]
            assert terms == sorted(set(terms))
            seen[doc_id].add(tuple(zip(terms, shard.counts[low:high])))
    used = {t for found in seen.values() for row in found for t, _ in row}
    assert len(used) == len(words)
    texts = {d: t for d, _, t in rows[:300]}
    for doc_id in (0, 7, 299):
        (row,) = seen[doc_id]
        assert sorted(c for _, c in row) == sorted(Counter(brute.SPACED.findall(texts[doc_id])).values())
    codes = {doc_id: {t for t, _ in next(iter(seen[doc_id]))} for doc_id in (1, 2)}
    shared = set(brute.SPACED.findall(texts[1])) & set(brute.SPACED.findall(texts[2]))
    assert len(codes[1] & codes[2]) == len(shared)


def test_stored_shards_are_unpacked_a_few_at_a_time(spark):
    numbers = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda n: (n * 48 + F.col("doc_id")).cast("string"))
    texts = spark.range(48).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", numbers))
    matrix = filter_audit.document_terms(texts.withColumn("source", F.lit("a")).coalesce(1))
    (file,) = matrix.inputFiles()  # a task of 48 shards has written it
    footer = pq.read_metadata(file.removeprefix("file:"))
    groups = [footer.row_group(i) for i in range(footer.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 48
    assert max(g.total_byte_size for g in groups) < 12 << 20
    assert matrix.select(F.explode("docs"), F.size("terms")).distinct().count() == 48
    assert matrix.where(F.size("terms") != 100_000).count() == 0


def test_audit_of_odd_and_no_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.source, r.text) for r in odd_docs.collect()]
    got = filter_audit.filter_audit(odd_docs, labels).collect()
    assert sorted(map(tuple, got)) == audit(rows, [(1, 1, 0)])
    assert filter_audit.filter_audit(odd_docs, labels.limit(0)).count() == len(got)
    assert filter_audit.filter_audit(no_docs, labels).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    from compare import connect, differences

    name = "op13_filter_audit"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []
