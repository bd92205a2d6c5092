"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docquarry.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2**64
_CHAIN = np.uint64(0xD6E8FEB86659FD93)
SHINGLE = 5


def _alnum() -> np.ndarray:
    """ASCII letters, digits and every byte of other characters belong to a word."""
    t = np.zeros(256, dtype=np.uint8)
    for a, b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        t[a:b] = np.arange(a, b)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


ALNUM = _alnum()
#: Codes of token bytes plus one, so that every byte but white space is distinct; A-Z as a-z.
TOKEN = np.arange(1, 257, dtype=np.uint16)
TOKEN[0x41:0x5B] = TOKEN[0x61:0x7B]
TOKEN[[0x20, *range(0x09, 0x0E)]] = 0


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2**64, for i below n at least; the longest up to 2**21 is kept."""
    kept = next(iter(_TABLES.values()), None)
    if kept is not None and len(kept[0]) >= n:
        return kept
    made = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(n, np.uint64(x))
        out[0] = 1
        with np.errstate(over="ignore"):
            made.append(np.multiply.accumulate(out))
    if n <= 1 << 21:
        _TABLES.clear()
        _TABLES[n] = made[0], made[1]
    return made[0], made[1]


@dataclass
class Words:
    hash: np.ndarray  # uint64 of each word
    doc: np.ndarray  # index of its text
    start: np.ndarray  # first byte in the joined buffer
    stop: np.ndarray
    count: np.ndarray  # words of each text
    docs: int


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and each text's offset with the total last; null is empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array, table: np.ndarray = ALNUM) -> Words:
    """Words are maximal runs of bytes whose table entry is not 0; their hash is of the entries."""
    raw, at = joined(pc.utf8_lower(pc.fill_null(texts, "")) if table is ALNUM else texts)
    n = len(raw)
    code = table[raw]
    on = code != 0
    first = np.zeros(n + 1, dtype=bool)
    first[at[:-1]] = True  # texts begin here; offset n belongs to empty texts at the end
    before = np.concatenate(([False], on[:-1])) if n else on
    start = np.flatnonzero(on & (~before | first[:n]))
    after = np.concatenate((on[1:], [False])) if n else on
    stop = np.flatnonzero(on & (~after | first[1:])) + 1
    power, inverse = _powers(max(1 << 19, 1 << int(n).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(code.astype(np.uint64) * power[:n], out=total[1:])
        h = mix64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    doc = np.searchsorted(at, start, side="right") - 1
    return Words(h, doc, start, stop, np.bincount(doc, minlength=len(at) - 1), len(at) - 1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text in their order, and the texts' indices."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = w.hash[:n].copy()
        for j in range(1, size):
            h *= _CHAIN
            h += w.hash[j : n + j]
        inside = w.doc[:n] == w.doc[size - 1 :]
        return mix64(h[inside] + np.uint64(size)), w.doc[:n][inside]


def text_shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """shingles(); a text of 1 to size - 1 words has one shingle, all its words.  Sorted by text."""
    h, d = shingles(w, size)
    extra = []
    for k in range(1, size):
        short = np.flatnonzero(w.count == k)
        if len(short):
            hk, dk = shingles(w, k)
            keep = w.count[dk] == k
            extra.append((hk[keep], dk[keep]))
    if extra:
        h, d = np.concatenate([h, *(x[0] for x in extra)]), np.concatenate([d, *(x[1] for x in extra)])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def distinct_by_text(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs sorted by text and hash, and how often each occurs."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))
