"""Substring deduplication by content-defined chunks of a gear rolling hash.

The gear hash of the last 32 bytes is computed at every position; a cut falls where it is the highest
within ``Plan.reach`` bytes on both sides, so cuts depend on nearby content alone and survive
insertions elsewhere.  Chunks are told apart by their 64-bit xxh3 digest.  A chunk that occurs again is repeated; its first
occurrence, by document id and position, stays.  Runs of repeated chunks of ``Plan.least`` bytes or more are
removed (passages of 50 words contain such a run; chance repeats of a few words don't).

A digest is not verified by bytes: two of n different chunks share one with probability n * n / 4e19, and a chance one of these would have to stand in
a run of repeated chunks to be removed.

Digests are exchanged in compressed blobs: every part of the documents asks, for its distinct digests, whether
they occur elsewhere and whether the first occurrence is its own.

Defined results: null and empty texts have no chunk; very long texts are cut whole, evenly where content
gives no cut; repeated rows: the first keeps its text, others lose it where it is long enough; removed spans
begin and end at character borders; null ids come last; ids that are no integers are ordered by the first 8 bytes of their text, then by place; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.blobs import ROWS, Exchange, asked, bucket_log, exchange, first_bits, unpack
from docquarry.llm.common import input_bytes, mix64
from docquarry.llm.parts import lay_out, open_part, runs_of, tasks_for

WINDOW = 32
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Plan:
    reach: int = 16  # bytes on both sides that a cut's hash must exceed: chunks of 33 bytes on average
    gap: int = 64  # longer chunks are cut at equal heights too, as in text of one short period
    most: int = 256  # longest chunk
    least: int = 120  # bytes of a run that is removed


def gear_hash(code: np.ndarray) -> np.ndarray:
    """The sum of gear[byte] << age over the last 32 bytes, at every position, by doubling."""
    h = GEAR[code]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def _highest(h: np.ndarray, reach: int) -> np.ndarray:
    """Maximum of the ``reach`` values before each position (reach is a power of two)."""
    m, step = h.copy(), 1
    while step < reach:
        m[step:] = np.maximum(m[step:], m[:-step])
        step *= 2
    out = np.zeros_like(h)
    out[1:] = m[:-1]
    return out


def chunk_ends(texts: list[bytes], plan: Plan = Plan()) -> list[np.ndarray]:
    """For each text the ends of its chunks."""
    gap = bytes(WINDOW + plan.reach)
    h = gear_hash(np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8))
    before, after = _highest(h, plan.reach), _highest(h[::-1], plan.reach)[::-1]
    at = np.flatnonzero((h > before) & (h >= after)) + 1
    ties = np.flatnonzero((h == before) & (h >= after)) + 1  # of text that repeats itself within reach
    out, begin = [], len(gap)
    for t in texts:
        end = begin + len(t)
        own = at[np.searchsorted(at, begin, side="right") : np.searchsorted(at, end)] - begin
        own = np.concatenate((own, [len(t)])) if len(t) else own[:0]
        wide = np.diff(own, prepend=0)
        if len(own) and wide.max() > plan.gap:
            own = _fill(own, wide, ties, begin, plan)
            wide = np.diff(own, prepend=0)
        if len(own) and wide.max() > plan.most:
            start = own - wide
            extra = [np.arange(s + plan.most, e, plan.most) for s, e in zip(start[wide > plan.most], own[wide > plan.most], strict=True)]
            own = np.sort(np.concatenate([own, *extra]))
        out.append(own)
        begin = end + len(gap)
    return out


def _fill(ends: np.ndarray, wide: np.ndarray, ties: np.ndarray, begin: int, plan: Plan) -> np.ndarray:
    """More cuts where chunks are longer than ``gap``: at equal heights, ``reach`` or more apart."""
    extra = []
    for a, b in zip((ends - wide)[wide > plan.gap].tolist(), ends[wide > plan.gap].tolist(), strict=True):
        last = a
        for x in (ties[np.searchsorted(ties, begin + a, side="right") : np.searchsorted(ties, begin + b)] - begin).tolist():
            if x - last >= plan.reach:
                extra.append(x)
                last = x
    return np.sort(np.concatenate([ends, np.array(extra, dtype=ends.dtype)]))


class _Part:
    """A part's chunks in document order: by id (null last), then as they come."""

    def __init__(self, row: dict, plan: Plan):
        self.texts = open_part(row["raw"], row["lengths"])
        self.ids = row["ids"]
        self.order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        self.ends = [e for a, b in runs_of(self.texts, 1 << 20) for e in chunk_ends(self.texts[a:b], plan)]
        digest, owner = [], []
        for i in self.order:
            t, at = self.texts[i], 0
            for e in self.ends[i].tolist():
                digest.append(xxhash.xxh3_64_intdigest(t[at:e]))
                at = e
            owner.append(np.full(len(self.ends[i]), _owner(self.ids[i]), dtype=np.int64))
        self.keys, self.first, self.at, self.count = np.unique(np.array(digest, dtype=np.uint64), return_index=True, return_inverse=True, return_counts=True)
        self.owner = np.concatenate(owner)[self.first] if owner else np.zeros(0, np.int64)


def _owner(doc_id) -> int:
    """A document's place in the order of ids."""
    if doc_id is None:
        return np.iinfo(np.int64).max
    return doc_id if isinstance(doc_id, int) else int.from_bytes(str(doc_id).encode()[:8].ljust(8, b"\0")) - (1 << 63)


def _merge(entries: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    keys, owner, more = entries
    known, of = np.unique(keys, return_inverse=True)
    least = np.full(len(known), np.iinfo(np.int64).max, dtype=np.int64)
    np.minimum.at(least, of, owner.view(np.int64))
    return [known, least.view(np.uint64), (np.bincount(of, weights=1 + more.astype(np.int64)) > 1).astype(np.uint8)], of


def _lead(owner: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether an entry is the first of its key: of least owner, then of the lowest part."""
    order = np.lexsort((np.arange(len(of)), owner.view(np.int64), of))
    lead = np.ones(len(of), dtype=bool)
    lead[1:] = of[order][1:] != of[order][:-1]
    out = np.zeros(len(of), dtype=bool)
    out[order[lead]] = True
    return out


def _total(_: int, entries: list[np.ndarray]) -> tuple[list[np.ndarray], dict[str, int]]:
    (_, _, more), of = _merge(entries)
    return [more[of] | np.where(_lead(entries[1], of), 2, 0).astype(np.uint8)], {}


def _give(answers: list[np.ndarray], entries: list[np.ndarray], of: np.ndarray) -> list[np.ndarray]:
    return [np.where(_lead(entries[1], of), answers[0], answers[0] & np.uint8(1))]


def _answers(parts: DataFrame, count: int, log: int, plan: Plan) -> DataFrame:
    """(part, bucket, size, blob): for each distinct digest of a part, bit 1 if it is repeated and bit 2 if its first occurrence is here."""
    bits = first_bits(log)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p = _Part(row, plan)
                yield asked(0, row["part"], [p.keys, p.owner.view(np.uint64), (p.count > 1).astype(np.uint8)], bits)

    how = Exchange((np.uint64, np.uint8), (np.uint8,), _merge, _total, _give)
    return exchange(parts.mapInArrow(ask, ROWS), log, count, how)[0].select("part", "bucket", "size", "blob")


def border(raw: bytes, at: int, up: bool) -> int:
    """The next (or last) position from ``at`` that does not split a character."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1 if up else -1
    return at


def runs(flag: np.ndarray, ends: np.ndarray, raw: bytes, least: int) -> list[tuple[int, int]]:
    """Spans of bytes over consecutive flagged chunks, ``least`` or more long, at character borders."""
    edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    begin = np.concatenate(([0], ends))
    spans = ((int(begin[a]), int(begin[b])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))
    out = ((border(raw, a, True), border(raw, b, False)) for a, b in spans if b - a >= least)
    return [(a, b) for a, b in out if b > a]


def repeats(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", text: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_chunks, n_repeated (bytes in repeated runs, first occurrences too), removed array of
    [start, end) byte spans, kept_sha256; with text=True also kept, what stays."""
    parts = lay_out(docs, id_col, text_col)
    count, log = parts.count(), bucket_log(input_bytes(parts))
    answers = _answers(parts, count, log, plan)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Part(left.to_pylist()[0], plan)
        got = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "size", "blob")), strict=True))
        flags = np.concatenate([unpack(raw, s, np.uint8)[0] for _, s, raw in got]) if got else np.zeros(0, np.uint8)
        here = flags[p.at] & 1 > 0
        later = here.copy()
        later[p.first[(flags & 2) > 0]] = False  # first occurrences of all
        n, cut, again, sha, kept = [], [], [], [], []
        begin = 0
        for i in p.order:
            raw, ends = p.texts[i], p.ends[i]
            own = slice(begin, begin + len(ends))
            begin += len(ends)
            spans = runs(later[own], ends, raw, plan.least)
            again.append(sum(b - a for a, b in runs(here[own], ends, raw, plan.least)))
            stay, pos = [], 0
            for a, b in spans:
                stay.append(raw[pos:a])
                pos = b
            stay = b"".join([*stay, raw[pos:]])
            n.append(len(ends)), cut.append([{"start": a, "end": b} for a, b in spans]), sha.append(hashlib.sha256(stay).hexdigest()), kept.append(stay.decode())
        out = {
            "id": left.column("ids").combine_chunks().flatten().take(pa.array(p.order, pa.int64())), "n_bytes": pa.array([len(p.texts[i]) for i in p.order], pa.int64()),
            "n_chunks": pa.array(n, pa.int64()), "n_repeated": pa.array(again, pa.int64()),
            "removed": pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.string())} if text else {}))

    schema = f"id {kind}, n_bytes long, n_chunks long, n_repeated long, removed array<struct<start:long,end:long>>, kept_sha256 string" + ", kept string" * text
    tasks = tasks_for(count, 2)
    return parts.repartition(tasks, "part").groupBy("part").cogroup(answers.repartition(tasks, "part").groupBy("part")).applyInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(id_col, "n_bytes", "n_chunks", "n_repeated", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
