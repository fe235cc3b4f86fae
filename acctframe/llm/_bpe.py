"""Exact byte-level BPE encoding through the tokenizers library, with each distinct unit of text encoded once as long as a worker remembers it.

A text is cut where the pre-tokenizer's pattern always starts a new pre-token, whatever else the text holds:
before a plain space that a non-space follows, and on both sides of a line feed between two non-spaces.  The
ids of the pieces, joined, are then the ids of the text.  Pieces of a word and punctuation are cut between these once more.  The
units are told apart by a 64-bit hash, and their ids are remembered in a cache of two generations that is bounded in bytes.
"""

from __future__ import annotations

import os

import numpy as np
import regex

from acctframe.llm import _text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of memory for each of the two generations of a worker's cache, and what a unit takes there besides its ids.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 24
#: The pre-tokenizer's pattern (a fixed value of the vocabulary file).
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes of ASCII letters; second bytes, after C3, of U+00C0 to U+00FF but the signs U+00D7 and U+00F7; and plain punctuation.
_LETTER, _LATIN, _MARK = (np.zeros(256, dtype=bool) for _ in range(3))
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_MARK[list(b".,!?;:")] = True

#: Bytes that begin a character that is no white space: U+0085, U+00A0, U+1680, U+180E, U+2000.. and U+3000 begin with C2, E1, E2 or E3.
_BEGINS = np.zeros(256, dtype=bool)
_BEGINS[0x21:0x7F] = _BEGINS[0xC3:0xE1] = _BEGINS[0xE4:0xF5] = True
_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x21:0x7F] = True


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Cache:
    """ids of units by their hash, in sorted arrays: a young generation that new units go into and the one before it."""

    def __init__(self, most: int):
        self.most = most
        self.young = self.old = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    @staticmethod
    def _find(generation: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in a generation, whether the key is there)."""
        have = generation[0]
        if not len(have):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return at, have[at] == keys

    def get(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, starts, sizes) of sorted distinct keys; make(places of missing keys) gives (flat ids, sizes)."""
        at, young = self._find(self.young, keys)
        at_old, old = self._find(self.old, keys)
        old &= ~young
        missing = np.flatnonzero(~young & ~old)
        made, made_sizes = make(missing) if len(missing) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        start, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        flat, before = [], 0
        for which, places, (_, starts, sizes, ids) in ((young, at, self.young), (old, at_old, self.old)):
            start[which], size[which] = before + starts[places[which]], sizes[places[which]]
            flat.append(ids)
            before += len(ids)
        start[missing], size[missing] = before + np.cumsum(made_sizes) - made_sizes, made_sizes
        flat.append(made)
        every = np.concatenate(flat)
        self._add(keys, np.flatnonzero(~young), every, start, size)
        return every, start, size

    def _add(self, keys: np.ndarray, new: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        have, starts, sizes, ids = self.young
        n = size[new]
        more = flat[np.repeat(start[new] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        spot = np.searchsorted(have, keys[new])
        self.young = (np.insert(have, spot, keys[new]), np.insert(starts, spot, len(ids) + np.cumsum(n) - n), np.insert(sizes, spot, n), np.concatenate((ids, more)))
        if ENTRY_BYTES * len(self.young[0]) + 4 * len(self.young[3]) > self.most:
            self.old, self.young = self.young, tuple(x[:0].copy() for x in self.young)


class Encoder:
    """Encodes batches of texts; special tokens' strings are ordinary text."""

    def __init__(self, path: str, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cache = Cache(most)

    def whole(self, text: str) -> bytes:
        """ids of text as the library gives them, without units or caches."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pretokens(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """(flat ids, sizes) of pre-tokens in the byte-level alphabet."""
        tokenize, flat, sizes = self.model.tokenize, [], []
        for t in texts:
            ids = [x.id for x in tokenize(t)]
            flat += ids
            sizes.append(len(ids))
        return flat, sizes

    def _other(self, raw: bytes) -> list[int]:
        """ids of a unit that is not plain."""
        text = raw.decode("utf-8")
        if not text.isascii():
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self._pretokens([t.translate(self.letters) for t in _PRETOKEN.findall(text)])[0]

    def _make(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, sizes) of units; the plain ones, which are one pre-token each, are translated together."""
        sizes = np.zeros(len(starts), np.int64)
        size = ends[plain] - starts[plain] + 1
        at = np.cumsum(size) - size
        joined = data[np.minimum(np.repeat(starts[plain] - at, size) + np.arange(size.sum()), len(data) - 1)]
        joined[at + size - 1] = 10  # a line feed, which no plain unit has, between them
        letters = {k: v for k, v in self.letters.items() if k != 10}
        flat, sizes[plain] = self._pretokens(joined[:-1].tobytes().decode("latin-1").translate(letters).split("\n")) if plain.any() else ([], 0)
        others = [self._other(data[a:b].tobytes()) for a, b in zip(starts[~plain].tolist(), ends[~plain].tolist(), strict=True)]
        sizes[~plain] = np.fromiter(map(len, others), np.int64, len(others))
        # plain units' ids come first in `every`, those of the others behind them; both go to their places
        every = np.array([*flat, *(x for o in others for x in o)], "<u4")
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        begin = np.empty(len(starts), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return every[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, starts there and sizes of the distinct units, each unit's place among them)."""
        unique, where, inverse = np.unique(_text.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        return *self.cache.get(unique, lambda m: self._make(data, starts[where[m]], ends[where[m]], plain[where[m]])), inverse

    def sizes(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, numbers of ids) of all units of the texts."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends, plain = units(data, offs)
        _, _, size, inverse = self._ids(data, starts, ends, plain)
        return starts, size[inverse]

    def batch(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the uint32 ids of the texts data[offs[i]:offs[i+1]], one after the other."""
        docs = len(offs) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(docs + 1, np.int64)
        starts, ends, plain = units(data, offs)
        flat, base, size, inverse = self._ids(data, starts, ends, plain)
        n = size[inverse]
        out = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=out[1:])
        ids = flat[np.repeat(base[inverse] - out[:-1], n) + np.arange(out[-1])]
        return ids, out[np.searchsorted(starts, offs)]


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, and which are plain.  A piece of a word and punctuation after it is two plain units, one
    pre-token each; any other piece is a unit that is not plain."""
    starts, ends = pieces(data, offs)
    letter = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    letter[lead] = letter[lead + 1] = True
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    before, marks = np.zeros(len(data) + 1, kind), np.zeros(len(data) + 1, kind)
    np.cumsum(letter, out=before[1:])
    np.cumsum(_MARK[data], out=marks[1:])
    first = starts + (data[starts] == 32)
    word = before[ends] - before[first]
    cut = first + word
    plain = (word > 0) & (before[cut] - before[first] == word) & (marks[ends] - marks[cut] == ends - cut)
    both = plain & (cut < ends)
    spot = np.flatnonzero(both) + 1
    out = np.insert(starts, spot, cut[both])
    return out, np.append(out[1:], len(data)), np.insert(plain, spot, True)


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces; together they hold every byte once."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    after = np.zeros(n, dtype=bool)
    after[:-1] = _BEGINS[data[1:]]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    cut[:n] = (data == 32) & after
    feed = np.flatnonzero((data == 10) & after)
    before = np.zeros(len(feed), dtype=bool)
    one = feed >= 1
    before[one] = _ASCII[data[feed[one] - 1]]
    two = feed >= 2
    before[two] |= data[feed[two] - 2] == 0xC3
    feed = feed[before]
    cut[feed] = cut[feed + 1] = True
    cut[offs[:-1]] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.append(starts[1:], n)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
