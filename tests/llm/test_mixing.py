"""Source mixing: targets by repeated sharing, samples by sorted draws."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import brute
from prefdeck.llm import mixing
from prefdeck.llm.oracle import ORACLE
from prefdeck.llm.queries import QUERIES


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=repr):
            target[s] += unit * weight[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def check(rows, docs):
    """``rows``: of the mix; ``docs``: (doc_id, source, text)."""
    size = lambda t: len(brute.SPACED.findall(t or ""))
    totals = defaultdict(int)
    for _, source, text in docs:
        totals[source] += size(text)
    want = shared(totals)
    assert sorted((repr(r[0]), r[1]) for r in rows) == sorted((repr(d), size(t)) for d, _, t in docs)
    taken = defaultdict(int)
    for doc_id, n, source_size, target, took in rows:
        assert 0 <= took <= 3 * n
        epochs = int(target // source_size) if source_size else 0
        assert epochs * n <= took <= (epochs + 1) * n  # complete epochs come first
        taken[source_size, round(target, 6)] += took
    found = sorted((n, t, took) for (n, t), took in taken.items())
    for n, t, took in found:
        alike = sum(1 for s in totals if totals[s] == n and abs(want[s] - t) < 1e-6 * max(t, 1))
        assert alike and alike * t - alike <= took <= alike * t + 1e-6
    return taken


@pytest.fixture(scope="module")
def sources(spark):
    """A hot source, small ones, an empty name, NULL, one without words; NULL and repeated ids."""
    rows = [(i, "s0", " ".join(["w"] * (i % 40))) for i in range(900)]
    rows += [(1000 + i, f"s{i % 7}", "one two three " * (i % 5)) for i in range(60)]
    rows += [(2000 + i, None, "a b c d") for i in range(20)] + [(3000, "", "x y"), (3001, "ñ", "z"), (3002, "blank", " \n")]
    rows += [(None, "s3", "no id here")] * 2 + [(3003, "long", "word " * 20_000), (5, "s0", "same id"), (5, "s0", "same id")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, text string, size int, key string")
    return df.repartition(4), rows


@pytest.mark.parametrize("chunk_rows", [7, 100_000])
def test_mix_takes_its_targets(sources, monkeypatch, chunk_rows):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk_rows)
    docs, rows = sources
    got = list(map(tuple, mixing.mix(docs, seed=3).collect()))
    check(got, rows)
    assert sorted(got, key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(9), seed=3).collect()), key=repr)


def test_chunks_do_not_change_the_sample(sources, monkeypatch):
    docs, _ = sources
    whole = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 3)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == whole
    assert sorted(map(tuple, mixing.mix(docs, seed=1).collect()), key=repr) != whole


def test_heavier_documents_come_first(spark):
    """Inclusion follows the weights: 9 to 1 for the first of many draws."""
    rows = [(i, "a", "one") for i in range(4000)] + [(9000, "b", "x " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("heavy", F.col("doc_id") % 2 == 0)
    quality = F.when(F.col("heavy"), 9.0).otherwise(1.0)
    got = mixing.mix(docs, weights=(1.0, 8.0), quality=quality).where("source_size = 4000 and taken > 0").collect()
    heavy = sum(1 for r in got if r.doc_id % 2 == 0)
    assert heavy > 0.55 * len(got) and len({r.taken for r in got}) <= 2


def test_mix_of_odd_and_no_rows(odd_docs, no_docs):
    got = list(map(tuple, mixing.mix(odd_docs).collect()))
    check(got, [(r.doc_id, r.source, r.text) for r in odd_docs.collect()])
    assert mixing.mix(no_docs).count() == 0
    blank = odd_docs.withColumn("text", F.lit(" "))
    assert {r.taken for r in mixing.mix(blank).collect()} == {0}


def test_plan_has_no_python(spark, sf_dir):
    from test_plans import IN_PYTHON, plan_of

    assert not IN_PYTHON.search(plan_of(QUERIES["op12_source_mixing"](spark, sf_dir)))


def test_query_equals_its_sql(spark, sf_dir):
    from compare import connect, differences

    name = "op12_source_mixing"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []
