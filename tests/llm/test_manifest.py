"""The Merkle manifest against a tree built level by level over whole lists."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import brute
from prefdeck.llm import merkle
from prefdeck.llm.oracle import ORACLE
from prefdeck.llm.queries import QUERIES, fold_of

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes):
    """The root over ``nodes``, and per node its siblings before and after, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append((run[: k % 8], run[k % 8 + 1 :]))
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def climb(node, path):
    for before, after in path:
        node = h(*before, node, *after)
    return node


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        members = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = (members, *grow([leaf(r) for r in members]))
    root, tops = grow([trees[name][1] for name in names])
    out = []
    for name, top in zip(names, tops):
        members, subroot, paths = trees[name]
        for row, path in zip(members, paths):
            path = path + top
            claimed = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                claimed = leaf((*row[:4], row[4].translate(brute.LOW)))
            proof = h(*(s for a, b in path for s in (*a, *b)))
            folded = climb(claimed, path)
            out.append((row[0], leaf(row), subroot, root, proof, folded, folded == root))
    return out


def manifest(docs, **names):
    lower = {"text": merkle.folded_case(F.col("text"))}
    return merkle.manifest(docs, lower, fold_of(F.col("doc_id"), 3) == 0, **names)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 73, 512, 513, 700])
@pytest.mark.parametrize("levels", [1, 2, None])
def test_appending_in_blocks_gives_the_tree(n, levels):
    nodes = [h(str(i)) for i in range(n)]
    root, paths = grow(nodes)
    if levels is None:
        tree = merkle.Appender()
        for node in nodes:
            tree.append(node)
        assert tree.finish() == root
        assert [[("".join(a), "".join(b)) for a, b in p] for p in paths] == tree.witnesses
        return
    size = 8**levels
    blocks = [
        merkle._block(list(enumerate(nodes))[k : k + size], n, levels) for k in range(0, n, size)
    ]
    above, tops = grow([top for top, _ in blocks])
    assert above == root
    inside = [
        [*w, *[("".join(a), "".join(b)) for a, b in tops[i]]] for i, (_, witnesses) in enumerate(blocks) for w in witnesses
    ]
    assert inside == [[("".join(a), "".join(b)) for a, b in p] for p in paths]


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_matches_brute_force(spark, levels):
    draw = random.Random(4)
    langs = ["en"] * 6 + ["de", "fr", "é", "", None, "zz", "EN"]
    rows = [(i, draw.choice(["a", None, ""]), draw.choice(langs), draw.choice([i, None]), f"Text {i} É" * (i % 3)) for i in range(400)]
    rows += [(None, "a", "en", 1, "No id"), (None, "a", "en", 1, "No id"), (5, "a", "en", 2, "Same id"), (6, "a", "en", 2, None)]
    rows += [(7000, "a", "solo", 2, "lone Leaf"), (7001, "a", "long", 1, "Word " * 400_000)]
    rows += [(9, "hot", "en", 3, "equal Rows")] * 150
    docs = spark.createDataFrame(
        [(*r, "node", 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int"
    ).repartition(5)
    got = sorted(map(tuple, manifest(docs, block_levels=levels).collect()), key=repr)
    assert got == sorted(expected(rows), key=repr)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_manifest_of_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select(*COLUMNS).collect()]
    got = manifest(odd_docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(rows)))
    assert manifest(no_docs).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    from compare import connect, differences

    name = "op11_merkle_manifest"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []
