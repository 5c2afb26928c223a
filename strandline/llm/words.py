"""Vectorised splitting and hashing of whole texts.

A word is a maximal run of bytes other than space and \\x09-\\x0D, with A-Z
lower-cased.  Everything works on the Arrow buffers of a batch, so no Python
object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S31, _S27, _S30 = np.uint64(31), np.uint64(27), np.uint64(30)
#: Stands for the end of a text among word hashes.
END = np.uint64(0xD1B54A32D192ED03)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = (h ^ (h >> _S30)) * _K2
    h = (h ^ (h >> _S27)) * _K3
    return h ^ (h >> _S31)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets (n + 1) of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def hash_spans(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans raw[start : start + length]."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.ndarray((len(raw) + 1,), "<u8", buffer=padded, strides=(1,))
    h = length.astype(np.uint64) * _K1
    live, at, left = None, start, length
    while True:
        chunk = view[at]
        short = np.flatnonzero(left < 8)
        chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        if live is None:
            h = mix(h ^ chunk)
        else:
            h[live] = mix((h[live] * _K1) ^ chunk)
        more = np.flatnonzero(left > 8)
        if not more.size:
            return h
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


@dataclass
class Words:
    """Words of a batch of texts: hash, text index, and words per text."""

    h: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.per_doc)])


def split_words(column: pa.Array) -> Words:
    """Hashes of the lower-cased words of every text, in order."""
    raw, off = text_bytes(column)
    n = len(off) - 1
    if not len(raw):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, np.int64))
    low = _LOWER[raw]
    word = ~_SPACE[low]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:-1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    edges = np.searchsorted(start, off)
    per_doc = np.diff(edges)
    return Words(hash_spans(low, start, length), np.repeat(np.arange(n, dtype=np.int32), per_doc), per_doc)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of n words; a shorter text is one shingle, an empty one none."""
    per = words.per_doc
    h = words.h
    if len(h) >= n:
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = mix(g * _K1 + h[k : len(h) - n + 1 + k])
        keep = np.ones(len(g), bool)
        first = words.first
        last = first[1:]
        for k in range(1, n):  # runs that would cross the end of their text
            x = last[per > 0] - k
            keep[x[(x >= 0) & (x < len(g))]] = False
        g, doc = g[keep], words.doc[: len(keep)][keep]
    else:
        g, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((per > 0) & (per < n))
    if few.size:
        first = words.first
        extra = np.empty(few.size, np.uint64)
        for i, d in enumerate(few):
            x = np.uint64(n * 1_000_003)
            with np.errstate(over="ignore"):
                for w in h[first[d] : first[d + 1]]:
                    x = mix(x * _K1 + w)
            extra[i] = x
        g, doc = np.concatenate([g, extra]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes text after text, and the offsets of each text's set."""
    g, doc = shingles(split_words(column), n)
    order = np.argsort(g)
    if len(column) <= 1 << 16:  # a radix sort by text
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    g, doc = g[order], doc[order]
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])
        g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(column) + 1))


class HashIndex:
    """Open-addressing lookup from distinct well-mixed 64-bit keys to their places."""

    def __init__(self, keys: np.ndarray, mixed: bool = True):
        self.mixed = mixed
        self.keys = keys.astype(np.uint64)
        spread = self.keys if mixed else mix(self.keys * _K1)
        bits = max(4, int(np.ceil(np.log2(max(2, 2 * len(keys))))))
        self.shift = np.uint64(64 - bits)
        slot = (spread >> self.shift).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        i = np.arange(len(keys))
        place = i + np.maximum.accumulate(slot[order] - i) if len(keys) else i
        self.table = np.full((1 << bits) + len(keys) + 1 if not len(keys) else max(1 << bits, int(place[-1]) + 1) + 1, -1, np.int32)
        self.table[place] = order

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        keys = keys.astype(np.uint64, copy=False)
        slot = ((keys if self.mixed else mix(keys * _K1)) >> self.shift).astype(np.int64)
        live = None
        while True:
            got = self.table[slot]
            same = (got >= 0) & (self.keys[got] == keys)
            if live is None:
                out[same] = got[same]
            else:
                out[live[same]] = got[same]
            on = np.flatnonzero((got >= 0) & ~same)
            if not on.size:
                return out
            live = on if live is None else live[on]
            slot, keys = slot[on] + 1, keys[on]


def counts_of(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their weights (or how often each occurs)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        s = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        return s[at], np.diff(np.append(at, len(s)))
    order = np.argsort(keys)
    s = keys[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.add.reduceat(weights[order], at)


def range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of the equal ranges of the 64-bit keys each falls into."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cuts_of(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Offsets (parts + 1) of the ranges within sorted keys."""
    return np.searchsorted(range_of(sorted_keys, parts), np.arange(parts + 1))
