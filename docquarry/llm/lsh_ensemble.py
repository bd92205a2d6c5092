"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by their number of shingles into powers of two.  For a partition of
items with up to 2**c shingles a document is seen as windows of 2**(c+1) shingles that start every
2**c, so an item inside it always lies in a window of comparable size, however long the document
is, and the Jaccard similarity that corresponds to the containment stays above a fixed bound.  Windows and
items have one-permutation MinHash signatures of ``BINS`` coordinates; one equal coordinate (bands of one row) makes a
candidate.  A window's coordinate is worked out only where it holds a value of some item's signature, which
gives the same candidates.  Candidates are verified by the exact share of the item's distinct shingles in the whole
document.  With 64 coordinates the chance to miss an item contained to 0.8 is below e**-13.  A signature of few
shingles has few coordinates, so for items with up to 2**``FEW`` shingles every common shingle makes a candidate: none is missed.

Items are taken in blocks of about ``BLOCK`` shingles, one block after the other against all rows, so what the driver holds and
sends to executors is bounded however many items there are.

Words are runs of letters and digits in lower case; shingles are of five words.  Defined results: null and
empty texts contain nothing and are contained in nothing; an item of 1 to 4 words is one shingle of just these words;
repeated rows give their own results; very long texts are searched whole; an empty table of texts or of items gives no pair, and clean()
keeps every row where there are no items; search() ignores extra columns, clean() keeps all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import pieces, write_shared
from docquarry.llm.words import SHINGLE, distinct_by_text, shingles, text_shingles, words_of

BINS, BLOCK, FEW = 64, 2_000_000, 4


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per item: id, words of a shingle (5, or fewer for short items), distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 4 << 20):
                w = words_of(b.column("text"))
                h, d, _ = distinct_by_text(*text_shingles(w))
                ends = np.searchsorted(d, np.arange(w.docs + 1))
                rows = [h[ends[i] : ends[i + 1]].view(np.int64).tolist() for i in range(w.docs)]
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "k": pa.array(np.minimum(w.count, SHINGLE), pa.int32()), "shingles": pa.array(rows, pa.list_(pa.int64()))})

    src = items.select(items[id_col].alias("id"), items[text_col].alias("text"))
    return src.mapInArrow(run, f"id {items.schema[id_col].dataType.simpleString()}, k int, shingles array<long>")


def signature(h: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """One-permutation MinHash: the least hash of each of BINS bins, by group; the highest value where a bin is empty."""
    sig = np.full(groups * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(sig, group * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), h)
    return sig.reshape(groups, BINS)


@dataclass
class Partition:
    """Items of one shingle length and one size class."""

    log: int
    hash: np.ndarray  # signature values, sorted
    item: np.ndarray  # the item of each


@dataclass
class Index:
    """One block of items; what executors get."""

    ids: list
    size: np.ndarray  # distinct shingles of each item
    hash: dict[int, np.ndarray]  # by words of a shingle: all shingles, sorted
    item: dict[int, np.ndarray]
    parts: dict[int, list[Partition]]

    @staticmethod
    def of(rows: list) -> "Index":
        rows = sorted((r for r in rows if r["shingles"]), key=lambda r: (str(r["id"]), r["shingles"]))
        size = np.array([len(r["shingles"]) for r in rows], dtype=np.int64)
        hashes, items, parts = {}, {}, {}
        for k in sorted({r["k"] for r in rows}):
            own = [i for i, r in enumerate(rows) if r["k"] == k]
            h = np.concatenate([np.array(rows[i]["shingles"], dtype=np.int64).view(np.uint64) for i in own])
            of = np.repeat(own, size[own])
            order = np.argsort(h, kind="stable")
            hashes[k], items[k], parts[k] = h[order], of[order], []
            log = np.ceil(np.log2(size)).astype(int)
            for c in sorted(set(log[own])):
                mine = log[of] == c
                sig = signature(h[mine], of[mine], len(rows))
                i, _ = np.nonzero(sig != np.iinfo(np.uint64).max)
                v = sig[sig != np.iinfo(np.uint64).max]
                order = np.argsort(v, kind="stable")
                parts[k].append(Partition(int(c), v[order], i[order]))
        return Index([r["id"] for r in rows], size, hashes, items, parts)

    def search(self, texts: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, shared shingles) of every pair whose containment is ``least`` or more."""
        w = words_of(texts)
        out = [np.zeros((3, 0), dtype=np.int64)]
        for k, known in self.hash.items():
            h, d = shingles(w, k)
            hit = np.flatnonzero(_within(h, known))
            if not len(hit):
                continue
            first = np.searchsorted(d, np.arange(w.docs + 1))
            pair = np.unique(np.concatenate([self._candidates(p, h, d, first, hit) for p in self.parts[k]]))
            if not len(pair):
                continue
            # exact: distinct shingles of the item that the text has
            hh, dd, _ = distinct_by_text(h[hit], d[hit])
            at, item = _expand(known, self.item[k], hh)
            code, shared = np.unique(dd[at] * len(self.ids) + item, return_counts=True)
            good = np.isin(code, pair) & (shared >= least * self.size[code % len(self.ids)] - 1e-9)
            out.append(np.stack([code[good] // len(self.ids), code[good] % len(self.ids), shared[good]]))
        return tuple(np.concatenate(out, axis=1))

    def _candidates(self, p: Partition, h, d, first, hit) -> np.ndarray:
        """text * items + item where a window's signature shares a coordinate with an item's."""
        at = hit[_within(h[hit], p.hash)]
        if len(at) and p.log > FEW:
            step = 1 << p.log
            base, end = first[d[at]], first[d[at] + 1]
            window = (at - base) // step
            keep = np.zeros(len(at), dtype=bool)
            lowest = _Lowest(h, d, np.unique(d[at]), first)
            for back in (0, 1):  # the two windows that hold the position
                begin = base + np.maximum(window - back, 0) * step
                keep |= lowest(at, begin, np.minimum(begin + 2 * step, end)) == h[at]
            at = at[keep]
        i, item = _expand(p.hash, p.item, h[at])
        return d[at][i] * len(self.ids) + item


class _Lowest:
    """The least hash of a position's bin among the shingles [begin, end), by doubling: a pass for each power of two."""

    def __init__(self, h: np.ndarray, d: np.ndarray, texts: np.ndarray, first: np.ndarray):
        own = np.concatenate([np.arange(first[t], first[t + 1]) for t in texts])  # only texts that have a hit
        bins = (h[own] & np.uint64(BINS - 1)).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        self.place = own[order]  # by bin, then position
        self.start = np.searchsorted(bins[order], np.arange(BINS + 1))
        self.hash, self.bin = h[self.place], lambda at: (h[at] & np.uint64(BINS - 1)).astype(np.int64)
        self.key = bins[order] * (len(h) + 1) + self.place
        self.width = len(h) + 1

    def __call__(self, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        shift = self.bin(at) * self.width
        left, right = np.searchsorted(self.key, shift + begin), np.searchsorted(self.key, shift + end)  # never empty: at is inside
        level = np.frexp((right - left).astype(float))[1] - 1
        out, least = np.empty(len(at), dtype=np.uint64), self.hash
        for j in range(int(level.max(initial=0)) + 1):
            if j:
                half = 1 << (j - 1)
                least = np.minimum(least[:-half], least[half:])  # of 2**j values on end
            mine = np.flatnonzero(level == j)
            out[mine] = np.minimum(least[left[mine]], least[right[mine] - (1 << j)])
        return out


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each x is among the sorted known values; a bit table turns most away."""
    bits = np.uint64(22)
    table = np.zeros(1 << 22, dtype=bool)
    table[(known >> (np.uint64(64) - bits)).astype(np.int64)] = True
    out = table[(x >> (np.uint64(64) - bits)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, x[maybe]), len(known) - 1)
    out[maybe] = known[at] == x[maybe]
    return out


def _expand(known: np.ndarray, payload: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (index into x, payload) with known == x[index]; known is sorted and may repeat."""
    a, b = np.searchsorted(known, x, side="left"), np.searchsorted(known, x, side="right")
    n = b - a
    i = np.repeat(np.arange(len(x)), n)
    return i, payload[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def blocks(items: DataFrame) -> Iterator[Index]:
    """The items as indexes of about BLOCK shingles each, one at a time."""
    rows = write_shared(item_shingles(items), "items")
    total = rows.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    n = -(-total // BLOCK) or 1
    part = F.pmod(F.xxhash64("shingles"), F.lit(n))
    for i in range(n):
        yield Index.of(rows.where(part == i).collect())


def search(docs: DataFrame, items: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs: the document's id, item_id, containment, shared and size (distinct shingles)."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    b_item = _arrow(items, "item_id")

    def with_block(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in pieces(whole, "text", 1 << 20):
                    text, item, shared = index.search(b.column("text"), least)
                    size = index.size[item]
                    yield pa.RecordBatch.from_pydict({
                        "id": b.column("id").take(pa.array(text)), "item_id": pa.array([index.ids[i] for i in item], b_item), "containment": pa.array(shared / np.maximum(size, 1), pa.float64()),
                        "shared": pa.array(shared, pa.int32()), "size": pa.array(size, pa.int32())})

        return src.mapInArrow(run, f"id {kind}, item_id {item_kind}, containment double, shared int, size int")

    return _one_after_another(map(with_block, blocks(items)), "found").withColumnRenamed("id", id_col)


def _one_after_another(results: Iterator[DataFrame], name: str) -> DataFrame:
    """The union; where a block follows, the one before is written, so that only one index is held at a time."""
    out, last = None, next(results)
    for df in results:
        done = write_shared(last, name)
        out, last = done if out is None else out.unionAll(done), df
    return last if out is None else out.unionAll(last)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text contains no item to ``least``."""
    out = docs
    for i, index in enumerate(blocks(items)):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in pieces(whole, text_col, 1 << 20):
                    keep = np.ones(b.num_rows, dtype=bool)
                    keep[index.search(b.column(text_col), least)[0]] = False
                    yield b.filter(pa.array(keep))

        out = (write_shared(out, "clean") if i else out).mapInArrow(run, docs.schema)
    return out
