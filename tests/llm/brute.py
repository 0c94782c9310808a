"""The contracts once more, in plain Python over all rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

from prefdeck.llm.tokenizer import WORD_BPE

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def repeats(docs, length=100):
    out, seen = [], set()
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    done = {}
    for i in order:
        doc_id, text = docs[i]
        if (doc_id, text or "") in done:
            out.append(done[doc_id, text or ""])
            continue
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        runs = sum(1 for k in range(len(data)) if covered[k] and not (k and covered[k - 1]))
        row = (doc_id, len(data), sum(covered), runs, hashlib.sha256(kept).hexdigest())
        done[doc_id, text or ""] = row
        out.append(row)
    return out


def print_of(text):
    words = SPACED.findall((text or "").translate(LOW))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs, distance=2):
    prints = [print_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            low[find(i)].append(doc_id)
    return [(d, f"{prints[i]:016x}", min(low[find(i)], default=None)) for i, (d, _) in enumerate(docs)]


def contamination(docs, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOW))
        for k in range(max(1, len(words) - window + 1)) if words else ():
            windows[tuple(words[k : k + window])].add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        words = ALNUM.findall((text or "").translate(LOW))
        covered, found = bytearray(len(words)), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                hit = windows.get(tuple(words[k : k + size]))
                if hit:
                    found |= hit
                    covered[k : k + size] = b"\1" * size
        n, hits = len(words), sum(covered)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, n, hits, len(found), digest, hits > 0 and 20 * hits >= n))
    return out


def token_ids(texts):
    model = Tokenizer.from_file(WORD_BPE.path())
    return [e.ids for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def pieces(docs, most=2048):
    out = []
    for (doc_id, _), ids in zip(docs, token_ids([t for _, t in docs])):
        ids = [*ids, 0]
        for piece, start in enumerate(range(0, len(ids), most)):
            part = ids[start : start + most]
            out.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def measures(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, covered = Counter(grams), bytearray(len(words))
    for k, g in enumerate(grams):
        if often[g] > 1:
            covered[k : k + 8] = b"\1" * 8
    n, r = len(words), sum(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 20 or 100 * r > 30 * n)
