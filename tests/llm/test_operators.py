"""Each operator against brute force on small tables with nulls, ties, copies and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
import re
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from prefdeck.llm import (
    decontamination, graph, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity,
    url_filters, warc,
)
from prefdeck.llm.common import released, shared_folder
from prefdeck.llm.queries import RULES
from prefdeck.llm.tokenizer import WORD_BPE, Encoder, TokenizerFile


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_task_gives_freed_memory_back():
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    last = []

    def grow(batches):
        blocks = [bytearray(60_000) for _ in range(3_000)]
        last.append(bytearray(60_000))  # above the freed ones
        yield from batches
        del blocks

    before = resident()
    assert list(released(grow)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60


# --- 1 and 4: tokens ------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    draw = random.Random(5)
    letters = "aZé'ßñ.,!? \n\t09<|endoftext|>Σ́  S'xẞ中"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b.", "<|ENDOFTEXT|>", "İstanbul.", "É́.", "x" * 3000, ""]
    want = [np.array(ids, "<u4").tobytes() for ids in brute.token_ids(texts)]
    assert Encoder(WORD_BPE).encode([t.encode() for t in texts]) == want


def test_encoder_of_whole_texts():
    encoder = Encoder(TokenizerFile("piece_bpe_32k.model"))
    assert len(encoder.encode([b"Hello  world", b""])[0]) % 4 == 0


def test_packing_matches_brute_force(odd_docs):
    capacity = packing.Capacity(tokens=64)
    got = packing.pack_documents(odd_docs, WORD_BPE, capacity).collect()
    same([tuple(r)[:5] for r in got], brute.pieces(pairs(odd_docs), 64))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1


@pytest.mark.parametrize("policy", [packing.NORM, packing.DOT])
def test_packing_keeps_every_constraint(policy):
    draw = random.Random(1)
    histogram = {length: draw.randint(1, 50) for length in draw.sample(range(1, 400), 120)}
    capacity = packing.Capacity(1000, 4, 300_000, (1.0, 0.5, 0.5), policy)
    layout = packing.best_fit(histogram, capacity)
    bins = defaultdict(list)
    for length, count in histogram.items():
        at, offset = layout.place(np.full(count, length), np.arange(count))
        for b, o in zip(at, offset):
            bins[b].append((o, length))
    assert len(bins) == layout.n_bins
    for parts in bins.values():
        assert sum(x for _, x in parts) <= 1000 and len(parts) <= 4 and sum(x * x for _, x in parts) <= 300_000
        ends = [0, *np.cumsum([x for _, x in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1]


def test_counts_and_their_cache(spark, odd_docs, no_docs):
    path = shared_folder(spark)
    spark.createDataFrame([], token_counts.CACHE_SCHEMA).write.parquet(path)
    docs = pairs(odd_docs)
    ids = brute.token_ids([t for _, t in docs])
    want = [(d, len((t or "").encode()), len(i), len(i) > 30) for (d, t), i in zip(docs, ids)]
    for _ in range(2):  # the second time all are hits
        same(map(tuple, token_counts.token_counts(odd_docs, WORD_BPE, 30, path).collect()), want)
    stored = token_counts.read_cache(spark, path)
    assert spark.read.parquet(path).count() == stored.count() <= len(want)
    other = stored.select("content", F.lit("another version").alias("version"), F.lit(99999).cast("long").alias("n_tokens"))
    other.write.mode("append").parquet(path)
    same(map(tuple, token_counts.token_counts(odd_docs, WORD_BPE, 30, path).collect()), want)
    assert token_counts.token_counts(no_docs, WORD_BPE, 30).count() == 0


# --- 2, 7 and 10: scores and rules ------------------------------------------------------------------


def test_classifier_learns_and_stands_odd_rows(spark, sf_dir, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    scores = quality_classifier.quality_scores(docs, labels, usable).join(labels.where(~usable), "doc_id").collect()
    right = sum((r.score >= 0.3) == bool(r.quality) for r in scores)
    assert right >= 0.93 * len(scores)
    odd = quality_classifier.quality_scores(odd_docs, labels, usable).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    none = quality_classifier.quality_scores(odd_docs, labels.limit(0), usable).collect()
    assert {round(r.score, 9) for r in none} == {0.5}
    assert quality_classifier.quality_scores(no_docs, labels, usable).count() == 0


def test_pooling_and_network_match_plain_loops():
    draw = np.random.default_rng(0)
    words = quality_classifier.WordVectors(
        draw.normal(size=(quality_classifier.BUCKETS, quality_classifier.DIMENSIONS)).astype(np.float32),
        draw.random(quality_classifier.BUCKETS).astype(np.float32),
    )
    texts = ["One two, two ONE!", "", "a a b a  c", "#$% x", "ñandú 12 " * 50]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(t) for t in raw]))
    got = quality_classifier.pool(np.frombuffer(b"".join(raw), np.uint8), offsets, words)
    for text, row in zip(texts, got):
        # Runs of letters and digits, and runs of other signs, each as its bucket.
        tokens = [m.encode() for m in re.findall(r"[0-9a-z\u0080-\U0010ffff]+|[^0-9a-z\u0080-\U0010ffff\s]+", text.translate(brute.LOW))]
        buckets = [int(quality_classifier.find_tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0][0]) for t in tokens]
        weight = np.array([words.weights[b] for b in buckets])
        vectors = np.array([words.vectors[b] for b in buckets]).reshape(len(buckets), quality_classifier.DIMENSIONS)
        if len(buckets):
            mean = weight @ vectors / weight.sum()
            spread = np.sqrt(np.maximum(weight @ vectors**2 / weight.sum() - mean**2, 0))
            assert np.allclose(row[:64], [*mean, *spread], atol=2e-3)
        again = sum(b in buckets[max(0, i - 2) : i] for i, b in enumerate(buckets))
        assert row[64] == pytest.approx(again / max(len(buckets), 1))
        assert row[67] == pytest.approx(np.log1p(len(buckets)), abs=1e-6)
    net = quality_classifier.Network(*[draw.normal(size=s) for s in ((68,), (68,), (68, 5), (5,), (5,))], 0.3, 2.0)
    for x, p in zip(got.astype(float), net.probability(got.astype(float))):
        hidden = [np.tanh(sum(min(max((x[i] - net.mean[i]) / net.scale[i], -8), 8) * net.w1[i, k] for i in range(68)) + net.b1[k]) for k in range(5)]
        logit = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / 2.0
        assert p == pytest.approx(1 / (1 + math.exp(-logit)))


@pytest.mark.parametrize("seed", range(20))
def test_automaton_matches_a_naive_search(seed):
    draw = random.Random(seed)
    pieces = ["ab", "abc", "bc", "b", "ca", "ab ca", "1", "!", "é", "b c"]
    weights = {w: float(draw.randint(1, 5)) for w in draw.sample(["ab", "abc", "bc", "ca", "b"], 3)}
    hiding = tuple(draw.sample(["ab ca", "bc b", "b ca", "ca ab"], 2))
    lexicon = toxicity.Lexicon(weights, hiding)
    text = " ".join(draw.choice(pieces) for _ in range(40))
    folded = toxicity.fold(text)

    def places(phrase):
        for at in range(len(folded) - len(phrase) + 1):
            end = at + len(phrase)
            alone = not (at and folded[at - 1].isalpha()) and not (end < len(folded) and folded[end].isalpha())
            if folded[at:end] == phrase and alone:
                yield at, end

    hidden = [p for phrase in hiding for p in places(phrase)]
    found = [w for word, w in weights.items() for a, b in places(word) if not any(x <= a and b <= y for x, y in hidden)]
    score, n = toxicity.weigh(text, lexicon.automaton(), 200.0)
    assert n == len(found)
    assert score == pytest.approx(sum(found) / (1 + 0.25 * math.log1p((text.count(" ") + 1) / 200)))


def test_quality_rules_match_brute_force(odd_docs, no_docs):
    got = quality_rules.quality_rules(odd_docs).collect()
    same([tuple(r)[:7] for r in got], [(d, *brute.measures(t)) for d, t in pairs(odd_docs)])
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_rejections_are_counted_per_fence(spark, odd_docs):
    rows = [(i, " ".join(f"abc{i % 9}{k}" for k in range(40)), "en", "a") for i in range(300)]
    rows += [(900, " ".join(f"w{k} % & #" for k in range(40)), "en", "a"), (901, " ".join("z" * 60 + str(k) for k in range(30)), "en", "a")]
    judged = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    found = {r.metric: (r.n_rejected, r.n_alone) for r in quality_rules.rejections(judged).collect()}
    assert found["symbol_rate"][0] == 1 and found["word_length"][0] >= 1
    assert quality_rules.rejections(quality_rules.quality_rules(odd_docs.limit(0))).count() == 0


def test_fences_follow_their_group(spark):
    text = lambda n, word: " ".join([f"{word}{i}" for i in range(n)])
    rows = [(i, text(40 + i % 7, "abc"), "en", "a") for i in range(300)]
    rows += [(1000 + i, text(40 + i % 7, "abcdefghijklmnop"), "de", "b") for i in range(300)]
    rows += [(5000, text(40, "abcdefghijklmnopqrstuvwxyz"), "en", "a"), (5001, " ".join(f"w{i} % & #" for i in range(40)), "de", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in quality_rules.quality_rules(docs, prior_rows=20).where("not kept").orderBy("doc_id").collect()] == [5000, 5001]


def test_folding():
    assert toxicity.fold("1D10T") == "idiot" and toxicity.fold("ѕtupіd!") == "stupid!"
    assert toxicity.fold("in 1999, 24 men") == "in 1999, 24 men"
    assert toxicity.fold("tr4$h") == "trash" and toxicity.fold("a | b") == "a | b"


def test_lexicon_weights_and_exceptions(spark, odd_docs):
    lexicon = toxicity.Lexicon({"trash": 5.0}, ("trash can",), slope=2.0, intercept=-3.0)
    machine = lexicon.automaton()
    assert toxicity.weigh("the trash can is full", machine, 200)[1] == 0
    assert toxicity.weigh("you tr4sh. a trash can", machine, 200)[1] == 1
    assert toxicity.weigh("trashy", machine, 200) == (0.0, 0)
    short, long = toxicity.weigh("trash " + "a " * 10, machine, 200)[0], toxicity.weigh("trash " + "a " * 9000, machine, 200)[0]
    assert short > long > 0
    got = toxicity.score_texts(odd_docs, lexicon, "doc_id", "text").collect()
    assert len(got) == odd_docs.count() and len({r.score for r in got}) == 1


def test_toxicity_is_learned(spark, no_docs):
    draw = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = []
    for i in range(600):
        text = [draw.choice(words) for _ in range(60)]
        if i % 6 == 0:
            text.insert(draw.randint(0, 50), draw.choice(["zork", "Z0RK"]))
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    usable = F.col("doc_id") % 2 == 0
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (2, None)], "doc_id long, toxic int"))
    got = toxicity.toxicity(docs, labels, usable).collect()
    assert {r.doc_id for r in got if r.score >= 0.7} == set(range(0, 600, 6))
    assert toxicity.drop_toxic(docs, labels, usable, 0.7).count() == 500
    assert max(r.score for r in toxicity.toxicity(docs, labels.limit(0), usable).collect()) < 0.1
    assert toxicity.toxicity(no_docs, labels, usable).count() == 0


# --- 3: decontamination -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def benchmark(spark):
    phrase = "fox jumps over the lazy dog while seven wizards quietly mix potions in the old tower"
    rows = [(1, phrase), (1, phrase), (2, "one two"), (3, None), (4, "!!"), (None, "Naïve café"), (5, "nowhere to be found")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, phrase string")


@pytest.mark.parametrize("block", [9, 1000])
def test_contamination_matches_brute_force(spark, odd_docs, no_docs, benchmark, block):
    got = decontamination.contamination(odd_docs, benchmark, block=block).collect()
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    same(map(tuple, got), brute.contamination(pairs(odd_docs), items))
    assert any(r.contaminated for r in got)
    if block > 1:
        assert decontamination.contamination(no_docs, benchmark).count() == 0
        assert decontamination.contamination(odd_docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "red green blue"), (2, "blue x red y green"), (3, "red " + "x " * 30 + "green blue"), (4, "red red green")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(9, "red green blue")], "item_id long, text string")
    assert [r.doc_id for r in decontamination.matches(docs, items).collect()] == [1]
    near = decontamination.matches(docs, items, within=2).collect()
    assert {(r.doc_id, r.item, r.low, r.high) for r in near} == {(1, "9", 0, 3), (2, "9", 0, 5)}


# --- 5: repeats -------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [1, 1000])
def test_repeats_match_brute_force(spark, odd_docs, no_docs, hot):
    got = suffix_dedup.remove_repeats(odd_docs, hot=hot, carry=["lang", "key"]).collect()
    same([tuple(r)[:5] for r in got], brute.repeats(pairs(odd_docs)))
    assert all(r.carry.key == "x" for r in got)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("hot", [1, 1000])
def test_repeats_in_periodic_and_edited_texts(spark, hot):
    draw = random.Random(3)
    base = "".join(draw.choice("abcd é") for _ in range(3000))
    texts = [base, base[:1500] + "#" + base[1500:], "ab" * 400, "ab" * 300, base[700:900] * 3, "z" * 99, "z" * 100, "z" * 101, base[200:299], base[::-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, hot=hot, with_text=False).drop("kept")
    same(map(tuple, got.collect()), brute.repeats(list(enumerate(texts))))


def test_repeats_across_parts_of_long_texts(monkeypatch, spark):
    draw = random.Random(4)
    base = bytes(draw.choice(b"abcdefgh ") for _ in range(2000))
    data = np.frombuffer(base + base, np.uint8)
    monkeypatch.setattr(suffix_dedup, "LONG_TEXT", 500)
    starts = []
    for _, at, low, begin in suffix_dedup._parts(data, np.array([0, len(data)]), 100):
        h, first, last, _ = suffix_dedup.anchors(data[begin : begin + at[-1]], at, 100, 32)
        starts += [p + begin for a, b in zip(first, last) for p in range(a, b + 1)]
    assert starts == list(range(len(data) - 99))


def test_earlier_matches_by_definition():
    draw = random.Random(6)
    data = np.frombuffer(bytes(draw.choice(b"ab") for _ in range(700)), np.uint8)
    for length in (17, 33, 100):
        windows = np.arange(len(data) - length + 1)
        raw, seen, want = data.tobytes(), set(), []
        for p in windows:
            want.append(raw[p : p + length] in seen)
            seen.add(raw[p : p + length])
        assert suffix_dedup.earlier_matches(data, windows, length).tolist() == want


# --- 6: near copies ---------------------------------------------------------------------------------


def test_near_copies_match_brute_force(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    same(map(tuple, got), brute.near_groups(pairs(odd_docs)))
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("distance,n_blocks,hot", [(2, 4, 1), (2, 4, 500), (2, 5, 3), (1, 3, 1), (3, 5, 1), (3, 5, 500)])
def test_close_pairs_connect_what_links_connect(spark, distance, n_blocks, hot):
    draw = random.Random(distance * 10 + hot)
    prints = {draw.getrandbits(64) for _ in range(20)}
    for p in list(prints):
        for _ in range(6):
            for _ in range(draw.randint(1, 4)):
                p ^= 1 << draw.randint(0, 63)
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.close_pairs(df, distance, n_blocks, hot)).collect()}
    listed = list(signed)
    parent = {p: p for p in listed}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(listed):
        for b in listed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {p: roots.get(p, p) for p in listed} == {p: find(p) for p in listed}


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(5, i) for i in range(200, 260)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain + hub, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in [5, *range(200, 260)]}}


# --- 8 and 9: pages -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    link = lambda *to: "".join(f'<a class="x" href="{t}">t</a>' for t in to)
    rows = [
        (1, "https://Good.ORG/a?x=1", link("http://friend.net/", "/b")),
        (2, "http://friend.net/p", link("//other.net/q")),
        (3, "http://other.net", ""),
        (4, "http://www.bad.com/de/1", None),
        (5, "http://linker.net/x", link("http://www.bad.com/de/1", "mailto:a@b.c")),
        (6, "http://example.org/en/12#y", "same"),
        (7, "http://example.org/en/2", "same"),
        (8, None, None),
        (9, "no scheme", ""),
        (None, "http://lonely.net/z", "same"),
        (6, "http://example.org/en/12#y", "same"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")


def test_url_verdicts(spark, pages):
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, RULES).collect()]
    same(got, [
        (1, "good.org", "/a", "org/", "allow"), (2, "friend.net", "/p", None, "allow"), (3, "other.net", "", None, "allow"),
        (4, "www.bad.com", "/de/1", "com/de/", "block"), (5, "linker.net", "/x", None, "block"),
        (6, "example.org", "/en/12", "example.org/en/1", "block"), (6, "example.org", "/en/12", "example.org/en/1", "block"),
        (7, "example.org", "/en/2", "org/", "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
        (None, "lonely.net", "/z", None, "allow"),
    ])
    assert url_filters.judge_urls(pages.limit(0), RULES).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pagerank_by_power_iteration(spark, seed):
    """Against a dense matrix, with cycles, dead ends and hosts that seeds don't reach."""
    draw = random.Random(seed)
    n = 9
    edges = list({(draw.randrange(n), draw.randrange(n)): draw.randint(1, 4) for _ in range(14)}.items())
    seeds = {0: 3.0, 4: 1.0}
    got = {r.node: r.r for r in graph.settled_pagerank(
        spark.createDataFrame([(f"h{u}", f"h{v}", float(w)) for (u, v), w in edges], "u string, v string, weight double"),
        spark.createDataFrame([(f"h{k}", v) for k, v in seeds.items()], "node string, seed double"), 0.85, "r", 1e-10).collect()}
    walk, back = np.zeros((n, n)), np.zeros(n)
    for (u, v), w in edges:
        walk[u, v] += w / sum(x for (a, _), x in edges if a == u)
    back[[0, 4]] = 0.75, 0.25
    rank = back.copy()
    for _ in range(2000):
        moved = 0.85 * rank @ walk
        rank = moved + (1 - moved.sum()) * back
    assert got == pytest.approx({f"h{k}": r for k, r in enumerate(rank) if r > 1e-12}, abs=1e-8)


def test_distrust_comes_down_a_long_chain(spark):
    """12 hosts link one to the next, the last one to a blocked page."""
    names = [*(f"http://h{i}.net/" for i in range(12)), "http://www.bad.com/de/1"]
    rows = [(i, url, f'<a href="{to}">t</a>') for i, (url, to) in enumerate(zip(names, [*names[1:], "mailto:x@y.z"]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_filters.judge_urls(df, RULES).collect()
    assert {r.verdict for r in got} == {"block"} and len(got) == 13
    assert sum(r.distrust for r in got) == pytest.approx(1)


def test_archives_come_back(spark, pages):
    got = warc.archive_pages(pages).collect()
    winner = {"": 9, "same": 7}
    want = []
    for r in pages.collect():
        html = r.html or ""
        best = winner.get(html, r.page_id)
        first = r.page_id == best
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        want.append((r.page_id, len(html.encode()), digest, "response" if first else "revisit", None if first else best))
    same([tuple(r)[:5] for r in got], want)
    order = [(r.url_key, r.captured_s) for r in got]
    assert order == sorted(order)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_payloads_that_look_like_records(spark):
    html = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\nX-Archive-Boundary: 0\r\né\x00"
    rows = [(i, f"http://h{i}.net/\r\nWARC-Type: x", html + str(i) + "\r\n" * i) for i in range(4)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), min_bytes=10_000).collect()
    assert {r.page_id: r.payload_bytes for r in got} == {i: len(h.encode()) for i, _, h in rows}
    assert {r.record_type for r in got} == {"response"}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    draw = random.Random(k)
    runs = [sorted(draw.randint(0, 30) for _ in range(draw.randint(0, 20))) for _ in range(k)]
    tree = warc.LoserTree(iter([(x, (x, i)) for x in run]) for i, run in enumerate(runs))
    assert list(tree) == sorted((x, i) for i, run in enumerate(runs) for x in run)


def test_merged_runs_are_in_order_across_tasks(spark):
    draw = random.Random(9)
    rows = [
        (draw.choice(["", "org,a)/", "org,b)/x", "é"]), draw.randint(0, 3), draw.choice([None, *range(5)]), "response", None, 1, draw.choice("AB"))
        for _ in range(500)
    ]
    schema = "url_key string, captured_s long, id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
    got = warc.merge_runs(spark.createDataFrame(rows, schema).repartition(7))
    order = lambda r: (r[0].encode(), r[1], r[2] is not None, r[2] or 0, r[6])
    assert [tuple(r)[:7] for r in got.collect()] == sorted(rows, key=order)
    assert warc.merge_runs(spark.createDataFrame([], schema)).count() == 0


def test_queries_run_where_workers_lack_the_repository(tmp_path):
    """The session starts in another folder, and nothing but the driver's own path names this one."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {here!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name, query in entry.queries().items():
    if name.startswith("op") and "_" in name and name[2].isdigit() or name in ("pipeline", "pack_batches_greedy", "evaluate_python_judge"):
        print(name, len(query(spark, "/root/testdata/sf0.001").collect()), flush=True)
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.count("\n") == 16
