"""Public tokenizer files behind one small interface, with a bounded memo of words."""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from prefdeck.llm.bytewords import LOWER, NOT_SPACE, Words, find_words, hash_words, lanes_of, tokens_of
from prefdeck.llm.common import flat_bytes, worker_state

# Parts of words remembered by a worker, some 80 MB in all; the table starts anew beyond that.
MEMO_PARTS, MEMO_IDS = 800_000, 8_000_000
LANES = 3  # parts of up to 24 bytes are remembered
SLICE_BYTES = 1 << 20  # text that is encoded together
JOINED = 2_000  # words encoded in one call
_SIGN = np.zeros(256, bool)
_SIGN[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x30:0x3A] = _PLAIN[0x41:0x5B] = _PLAIN[0x61:0x7B] = True
# Letters among the characters of one and two bytes.
_LETTER = np.array([chr(c).isalpha() for c in range(0x800)])


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer file, found on each worker by the name it has in an installed package.

    ``folder``: where the file lies, or None for the installed ``public_tokenizers``.
    ``words_alone``: the tokenizer folds case, drops white space, and encodes each word between
    spaces by itself, there the letters apart from the signs behind them. The ids of a text are then
    those of its words in a row. False encodes whole texts. ``mark``: a special token whose string
    splits a text before anything else, so that many words can be encoded in one call. ``word_end``:
    what the last token of each run of letters ends with, and no other.
    """

    name: str
    folder: str | None = None
    words_alone: bool = False
    mark: str | None = None
    word_end: str | None = None

    def path(self) -> str:
        if self.folder:
            return f"{self.folder}/{self.name}"
        return importlib.import_module("public_tokenizers").path(self.name)

    def version(self) -> str:
        """A digest of the file and of the library that reads it."""
        library = "sentencepiece" if self.name.endswith(".model") else "tokenizers"
        digest = hashlib.sha256(open(self.path(), "rb").read())
        digest.update(f"{library} {importlib.import_module(library).__version__}".encode())
        return digest.hexdigest()

    def encoder(self) -> Encoder:
        return worker_state(f"encoder {self}", lambda: Encoder(self))


WORD_BPE = TokenizerFile("word_bpe_49k.json", words_alone=True, mark="<|endoftext|>", word_end="</w>")


class WordTable:
    """Ids of words in arrays: found by a 64-bit hash, checked by all bytes of the word."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending
        self.lanes = np.zeros((0, LANES), np.uint64)
        self.bytes = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.n_ids = 0

    def full(self) -> bool:
        return len(self.keys) > MEMO_PARTS or self.n_ids > MEMO_IDS

    def find(self, keys: np.ndarray, lanes: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """Places of words, -1 for those that are not here."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = (self.keys[at] == keys) & (self.bytes[at] == n_bytes) & (self.lanes[at] == lanes).all(axis=1)
        return np.where(here, at, -1)

    def store_ids(self, ids: np.ndarray) -> int:
        """Where the ``ids`` begin."""
        begin, self.n_ids = self.n_ids, self.n_ids + len(ids)
        if self.n_ids > len(self.ids):
            self.ids = np.resize(self.ids, max(self.n_ids, 2 * len(self.ids)))
        self.ids[begin : self.n_ids] = ids
        return begin

    def add(self, keys: np.ndarray, lanes: np.ndarray, n_bytes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Words that were not found; of those with one key (or with one that is here) the first stays."""
        keys, first = np.unique(keys, return_index=True)
        at = np.searchsorted(self.keys, keys)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
            keys, first, at = keys[new], first[new], at[new]
        self.keys = np.insert(self.keys, at, keys)
        self.lanes = np.insert(self.lanes, at, lanes[first], axis=0)
        self.bytes = np.insert(self.bytes, at, n_bytes[first])
        self.start = np.insert(self.start, at, start[first])
        self.size = np.insert(self.size, at, size[first])


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers, without begin, end or added special tokens."""

    def __init__(self, file: TokenizerFile) -> None:
        self.words_alone, self.mark = file.words_alone, file.mark
        self.table = WordTable()
        self.ends = None
        if file.name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=file.path())
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(file.path())
            model.no_truncation()
            model.no_padding()
            self._ids = lambda texts: [
                e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)
            ]
            self.mark_id = model.token_to_id(file.mark) if file.mark else None
            if file.word_end:
                known = model.get_vocab()
                self.ends = np.zeros(max(known.values()) + 1, bool)
                self.ends[[i for token, i in known.items() if token.endswith(file.word_end)]] = True

    def _packed(self, texts: list[bytes]) -> list[bytes]:
        return [
            np.array(ids, "<u4").tobytes() for ids in self._ids([t.decode("utf-8") for t in texts])
        ]

    def _many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words without special strings: joined by the mark, and split at its id."""
        if not self.mark:
            return self._packed(words)
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            text = f" {self.mark} ".join(w.decode("utf-8") for w in part)
            ids = np.array(self._ids([text])[0], "<u4")
            edges = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(edges) != len(part) + 1:
                raise ValueError("the mark occurs inside a word")
            packed = ids.tobytes()
            out += [packed[4 * a + 4 : 4 * b] for a, b in zip(edges[:-1], edges[1:])]
        return out

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids in a row and their number for each of ``words``, which have nothing but letters; None if some
        word is encoded in more than one run."""
        ids = np.array(self._ids([" ".join(words)])[0], np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            return None
        return ids, np.diff(last, prepend=-1)

    def _parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their number for each of distinct ``parts``."""
        texts = [p.decode("utf-8") for p in parts]
        letters = [i for i, t in enumerate(texts) if t.isalpha()] if self.ends is not None else []
        sizes = np.zeros(len(parts), np.int64)
        found, order = [], []
        for at in range(0, len(letters), JOINED):
            group = letters[at : at + JOINED]
            encoded = self._letters([texts[i] for i in group])
            if encoded is None:
                packed = self._many([parts[i] for i in group])
                encoded = np.frombuffer(b"".join(packed), "<u4"), np.array([len(x) // 4 for x in packed])
            found.append(encoded[0])
            sizes[group] = encoded[1]
            order += group
        rest = sorted(set(range(len(parts))).difference(letters))
        special = [i for i in rest if b"<|" in parts[i]]  # may hold a special string
        plain = [i for i in rest if b"<|" not in parts[i]]
        for group, encode in ((plain, self._many), (special, self._packed)):
            packed = encode([parts[i] for i in group])
            found.append(np.frombuffer(b"".join(packed), "<u4"))
            sizes[group] = [len(x) // 4 for x in packed]
            order += group
        # Back into the order of the parts.
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        begin = np.zeros(len(parts), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids[spread(begin, sizes)], sizes

    def _placed(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct ``parts`` begin in the table, and how many they are."""
        if self.table.full():
            self.table = WordTable()
        table = self.table
        data, offsets = flat_bytes(parts)
        spans = Words(offsets[:-1], offsets[1:], np.array([0, len(parts)]))
        keys, lanes = hash_words(data, spans), lanes_of(data, spans, LANES)
        n_bytes = np.diff(offsets).astype(np.int32)
        place = table.find(keys, lanes, n_bytes)
        # The lanes and size of a longer part may be those of another: it is never known.
        short = n_bytes <= 8 * LANES
        known = (place >= 0) & short
        start, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        start[known], size[known] = table.start[place[known]], table.size[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, size[new] = self._parts(parts.take(pa.array(new)).to_pylist())
            start[new] = table.store_ids(ids) + np.cumsum(size[new]) - size[new]
            kept = new[short[new]]
            table.add(keys[kept], lanes[kept], n_bytes[kept], start[kept], size[kept].astype(np.int32))
        return start, size

    def _word_parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the two parts of distinct ``words`` begin in the table, and how many they are:
        two columns, for the stem and for the signs behind it."""
        data, offsets = flat_bytes(words)
        edges, lowered = split_words(data, offsets)
        column = pa.Array.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(lowered)]
        ).dictionary_encode()
        start, size = self._placed(column.dictionary)
        part = np.asarray(column.indices).reshape(-1, 2)
        return start[part], size[part]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        if not self.words_alone:
            return np.array([len(x) // 4 for x in self._packed(_cut(data, offsets))], np.int64)
        words = find_words(data, offsets, NOT_SPACE)
        tokens = tokens_of(data, words)
        _, size = self._word_parts(tokens.dictionary)
        total = np.append(0, np.cumsum(size.sum(axis=1)[np.asarray(tokens.indices)]))
        return total[words.first[1:]] - total[words.first[:-1]]

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one entry more at the end)."""
        if not self.words_alone:
            packed = self._packed(_cut(data, offsets))
            return np.frombuffer(b"".join(packed), "<u4"), np.append(0, np.cumsum([len(x) // 4 for x in packed]))
        words = find_words(data, offsets, NOT_SPACE)
        tokens = tokens_of(data, words)
        start, size = self._word_parts(tokens.dictionary)
        ids = self.table.ids[spread(start.ravel(), size.ravel())]  # of the distinct words in a row
        whole = size.sum(axis=1)
        word = np.asarray(tokens.indices)
        ends = np.append(0, np.cumsum(whole[word]))
        return ids[spread((np.cumsum(whole) - whole)[word], whole[word])], ends[words.first]

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        ids, at = self.encode_all(np.frombuffer(b"".join(texts), np.uint8), offsets)
        ids = ids.astype("<u4", copy=False)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each ``start`` on, ``size`` of them, range after range."""
    ends = np.cumsum(size)
    out = np.repeat(start - (ends - size), size)
    out += np.arange(len(out))
    return out


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut into a stem and the signs behind it: ``edges``, from the start of a stem over its end to the
    next stem, and ``data`` with the ASCII letters of plain stems in lower case.

    A stem is plain if it has ASCII letters and digits only. Others are cut where a letter of one or
    two bytes stands before the signs. Words that may hold a special string stay whole, and so do all
    others; a part may be empty.
    """
    n = len(offsets) - 1
    edges = np.empty(2 * n + 1, np.int64)
    edges[0::2], edges[1::2] = offsets, offsets[1:]
    if not len(data):
        return edges, data
    start, end = offsets[:-1], offsets[1:]
    last = np.maximum.accumulate(np.where(_SIGN[data], -1, np.arange(len(data))))
    stop = np.maximum(last[np.maximum(end - 1, 0)] + 1, start)

    def count(flags: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return total[np.maximum(high, low)] - total[low]

    opens = np.zeros(len(data), bool)
    opens[:-1] = (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    special = count(opens, start, end - 1) > 0
    plain = (count(_PLAIN[data], start, stop) == stop - start) & (stop > start) & ~special
    final, lead = data[np.maximum(stop - 1, 0)].astype(np.int64), data[np.maximum(stop - 2, 0)].astype(np.int64)
    pair = (final >= 0x80) & (lead >= 0xC2) & (lead < 0xE0) & (stop - start > 1)
    letter = _LETTER[np.where(pair, (lead & 0x1F) << 6 | final & 0x3F, np.where(final < 0x80, final, 0))]
    cut = plain | (letter & (stop > start) & ~special)
    edges[1::2] = np.where(cut, stop, end)
    return edges, np.where(np.repeat(plain, end - start), LOWER[data], data)


def _cut(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
