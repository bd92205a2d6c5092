"""Suffix-array deduplication: bytes covered by a long string that also starts elsewhere.

The suffix array is built by linear grouping over Lyndon prefixes (jvm/LyndonSuffixes.java).  One
array over 100 TB can't be, so strings that may be equal are brought together first:

1. Every window of ``Plan.length`` bytes has a minimizer, the 128-byte string of lowest hash in it (the first of equals),
   which depends on the window's bytes alone.  Consecutive windows with one minimizer make a segment, their
   bytes; every window is in exactly one.  Segments are found once, while texts are laid out in parts.
2. Parts ask, in compressed blobs by the minimizer's hash, how often each of their segments occurs.  A segment that occurs
   twice is repeated throughout; one whose minimizer occurs nowhere else is not at all.
3. What is left are segments that share a minimizer but differ: one copy of each goes to the bucket of its minimizer, where
   the suffix array of the bucket's segments, with neighbours' common prefixes, tells which windows occur again.
4. Answers meet their parts again and give the bytes to remove.

A minimizer with more than ``Plan.gather`` different segments would make one bucket large.  Its windows are split by what more
they have in common: of the bytes of a window beyond its core (the minimizer at first) half lie left or half lie right of it, so the core
grows by that half and becomes a new key.  Equal windows take the same way.  This goes on until each key has
few different segments, after some nine steps at the latest, as the core then is the whole window; then the suffix arrays decide as before.

So any number of copies collapses before it is gathered, and no task gets more than a bucket.

The same exchange takes windows of ``Plan.passage`` bytes, for passages that are shorter than ``length``: ``n_passage`` counts the bytes of
maximal stretches, covered by strings of ``passage`` bytes that also start elsewhere, that hold more than ``Plan.words`` words.

Segments are told apart by 64-bit digests among those of one minimizer; all that isn't equal by digest is compared by bytes.

Defined results: null and empty texts, and those shorter than the length, lose nothing; very long texts are taken whole; repeated rows
make each other repeated; removal is by bytes, so what is kept may split characters; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import jvm
from docquarry.llm.blobs import ROWS, Exchange, asked, bucket_log, exchange, first_bits, pack, pack_sorted, unpack, unpack_sorted
from docquarry.llm.common import input_bytes, mix64, write_shared
from docquarry.llm.parts import lay_out, open_part, runs_of, tasks_for
from docquarry.llm.words import _powers

#: Bits of an answer about a segment.
REPEATED, DIFFER, OWNER, HOT = 1, 2, 4, 8
#: Bytes of whole texts that are worked on at a time.
PIECE = 1 << 20


@dataclass(frozen=True)
class Plan:
    length: int = 400  # bytes of the strings that must not occur twice
    passage: int = 256  # bytes of the strings that make up a passage; 0: none are looked for
    words: int = 50  # words that a passage has more of
    seed: int = 128  # bytes of a minimizer
    gather: int = 4096  # different segments of one minimizer that meet in a bucket; more are split
    block: int = 1 << 20  # bytes of one suffix array, about

    @property
    def lengths(self) -> tuple[int, ...]:
        return (self.length, self.passage) if self.passage else (self.length,)


def _prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte times power, from which the hash of any string follows; and the inverse powers."""
    power, inverse = _powers(max(1 << 16, 1 << int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return total, inverse


def _hashes(total: np.ndarray, inverse: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hash of the bytes [start, start + size)."""
    with np.errstate(over="ignore"):
        return mix64((total[start + size] - total[start]) * inverse[start])


def _lowest(seed: np.ndarray, wide: int) -> np.ndarray:
    """Position of the lowest of every ``wide`` values, the first of equals: of block suffixes and block prefixes.

    Values are compared by their upper bits; the lower ones, as many as ``wide`` needs, hold the place, so that equal
    windows choose alike wherever they stand.
    """
    bits = np.uint64(int(2 * wide).bit_length())
    rows = -(-len(seed) // wide)
    full = np.full(rows * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(seed)] = seed
    full = ((full >> bits) << bits).reshape(rows, wide)
    place = np.arange(wide, dtype=np.uint64)
    ahead = np.minimum.accumulate(full | (place + np.uint64(wide)), axis=1).ravel()
    back = np.minimum.accumulate((full | place)[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(seed) - wide + 1
    code = (np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.arange(n)
    return at - at % wide + code


def _segments(texts: list[bytes], plan: Plan) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length: text, first window, windows, key (lowest bit: which length) and digest of the segments of a piece."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(raw)
    if n < min(plan.lengths):
        return
    total, inverse = _prefix_sums(raw)
    with np.errstate(over="ignore"):
        seed = mix64((total[plan.seed :] - total[: -plan.seed]) * inverse[: n - plan.seed + 1])
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(texts)), size)
    for which, length in enumerate(plan.lengths):
        if n < length:
            continue
        at = _lowest(seed, length - plan.seed + 1)
        windows = n - length + 1
        doc = of[:windows]
        inside = doc == of[length - 1 :]
        new = np.ones(windows, dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & inside)
        stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        m, base = at[first], (ends - size)[doc[first]]
        with np.errstate(over="ignore"):
            digest = mix64(_hashes(total, inverse, first, stop + length - first) + (m - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (stop - first).astype(np.uint64))
            key = mix64(_hashes(total, inverse, m, plan.seed) + np.uint64(length)) & ~np.uint64(1) | np.uint64(which)
        yield doc[first], first - base, stop - first + 1, key, digest


def _stored(texts: list[bytes], plan: Plan) -> dict[str, pa.Array]:
    """The segments of a part as columns of its row: distinct (key, digest) in order, and all segments."""
    found = [(begin, *x) for begin, stop in runs_of(texts, PIECE) for x in _segments(texts[begin:stop], plan)]
    cat = lambda i: np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64)
    text = np.concatenate([x[0] + x[1] for x in found]) if found else np.zeros(0, np.int64)
    first, windows, key, digest = cat(2), cat(3), cat(4).astype(np.uint64), cat(5).astype(np.uint64)
    order = np.lexsort((digest, key))
    k, d = key[order], digest[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    pair = np.empty(len(order), dtype=np.uint32)  # index of each segment's distinct (key, digest)
    pair[order] = np.cumsum(new) - 1
    more = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
    back = np.lexsort((first, text))
    one = lambda x, kind: pa.array([x], kind)
    return {
        "n_pairs": one(int(new.sum()), pa.int32()), "n_segments": one(len(order), pa.int32()),
        "keys": one(pack_sorted(k[new], more.astype(np.uint8)), pa.binary()), "digests": one(pack(d[new]), pa.binary()),
        "segments": one(pack(text[back].astype(np.uint32), first[back].astype(np.uint64), (windows[back] * 2 + (key[back] & np.uint64(1)).astype(np.int64)).astype(np.uint32), pair[back]), pa.binary())}


_STORED = "n_pairs int, n_segments int, keys binary, digests binary, segments binary"


class Part:
    """An opened part: texts; for each segment, by text and place, its first window, windows and pair; which length a pair is of."""

    def __init__(self, row: dict, plan: Plan):
        self.texts, self.plan = open_part(row["raw"], row["lengths"]), plan
        self.text, self.first, self.windows, self.pair = (x.astype(np.int64) for x in unpack(row["segments"], row["n_segments"], np.uint32, np.uint64, np.uint32, np.uint32))
        self.which, self.example = (np.zeros(row["n_pairs"], dtype=np.int64) for _ in range(2))
        self.which[self.pair] = self.windows & 1
        self.windows >>= 1
        self.example[self.pair[::-1]] = np.arange(len(self.pair))[::-1]

    def length(self, pair: int) -> int:
        return self.plan.lengths[self.which[pair]]

    def content(self, pair: int) -> bytes:
        i = self.example[pair]
        return self.texts[self.text[i]][self.first[i] : self.first[i] + self.windows[i] - 1 + self.length(pair)]


def core_of(content: bytes, length: int, plan: Plan) -> int:
    """Where in a segment its minimizer begins."""
    total, inverse = _prefix_sums(np.frombuffer(content[:length], dtype=np.uint8))
    return int(_lowest(_hashes(total, inverse, np.arange(length - plan.seed + 1), plan.seed), length - plan.seed + 1)[0])


def _order(keys: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in the order of (key, digest), the lowest part's first; where a new pair and where a new key begins."""
    order = np.lexsort((np.arange(len(keys)), digests, keys))
    k, d = keys[order], digests[order]
    new_key = np.ones(len(k), dtype=bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= d[1:] != d[:-1]
    return order, new, new_key


def _merge(entries: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    keys, digests, more = entries
    order, new, _ = _order(keys, digests)
    of = np.empty(len(keys), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    times = np.bincount(of, weights=1 + more.astype(np.int64))
    return [keys[first], digests[first], (times > 1).astype(np.uint8)], of


def _exchange(plan: Plan) -> Exchange:
    """An answer byte for each distinct segment; sums: segments that are to be compared, and those of hot minimizers."""

    def total(_: int, entries: list[np.ndarray]) -> tuple[list[np.ndarray], dict[str, int]]:
        keys, digests, more = entries
        order, new, new_key = _order(keys, digests)
        of, of_key = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        times = np.bincount(of, weights=1 + more[order].astype(np.int64))
        kinds = np.bincount(of_key[new])  # different segments of each key
        differ = (kinds > 1) & (np.bincount(of_key[new], weights=times < 2) > 0)
        flags = np.zeros(len(keys), dtype=np.uint8)
        flags |= np.where(times[of] > 1, REPEATED, 0).astype(np.uint8)
        flags |= np.where(differ[of_key], DIFFER, 0).astype(np.uint8)
        flags |= np.where(new & differ[of_key], OWNER, 0).astype(np.uint8)  # the lowest part that has it
        flags |= np.where((kinds > plan.gather)[of_key] & differ[of_key], HOT, 0).astype(np.uint8)
        out = np.empty_like(flags)
        out[order] = flags
        owners = lambda hot: int(((flags & (OWNER | HOT)) == (OWNER | hot)).sum())
        return [out], {"gathered": owners(0), "hot": owners(HOT)}

    def give(answers: list[np.ndarray], entries: list[np.ndarray], of: np.ndarray) -> list[np.ndarray]:
        first = np.zeros(len(of), dtype=bool)
        first[np.unique(of, return_index=True)[1]] = True
        return [np.where(first, answers[0], answers[0] & np.uint8(255 - OWNER))]

    return Exchange((np.uint64, np.uint8), (np.uint8,), _merge, total, give, ("gathered", "hot"))


def _counted(parts: DataFrame, count: int, log: int, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Answers (part, bucket, size, blob), and buckets' sums."""
    bits = first_bits(log)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, more = unpack_sorted(row["keys"], row["n_pairs"], np.uint8)
                yield asked(0, row["part"], [keys, unpack(row["digests"], row["n_pairs"], np.uint64)[0], more], bits)

    rows = parts.select("part", "n_pairs", "keys", "digests").where("n_pairs > 0").mapInArrow(ask, ROWS)
    return exchange(rows, log, count, _exchange(plan))


def _flags(right: pa.Table) -> np.ndarray:
    got = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "size", "blob")), strict=True))
    return np.concatenate([unpack(raw, s, np.uint8)[0] for _, s, raw in got]) if got else np.zeros(0, np.uint8)


#: Segments on their way to a bucket's suffix array.  part -1: only there to be met, nobody waits for an answer.
_PIECES = "bucket long, part long, pairs array<int>, shifts array<int>, sizes array<int>, blob binary"
#: A segment of a minimizer with many: core [a, b) in its body, first window's number in its pair, 2 if it is repeated.
_CORES = "key long, part long, pair int, shift int, weight int, a int, b int, body binary"
#: Which windows of a pair, from number ``shift`` on, occur again: bits.
_ANSWER = "part long, pair int, shift int, size int, blob binary"


def _bucket(key: np.ndarray, log: int) -> np.ndarray:
    """The bucket of a key; even and odd ones for the two lengths, so that an array has one."""
    return (mix64(key) >> np.uint64(64 - log)).astype(np.int64) * 2 + (key & np.uint64(1)).astype(np.int64)


def _compress(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(raw)


def _leaving(parts: DataFrame, counted: DataFrame, tasks: int, log: int, plan: Plan) -> DataFrame:
    """One copy of every segment that is to be compared, as _PIECES; those of hot minimizers as _CORES in the other columns."""

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        flags = _flags(right)
        want = np.flatnonzero((flags & OWNER) > 0)
        pieces = {c: [] for c in ("bucket", "part", "pairs", "shifts", "sizes", "blob")}
        cores = {c: [] for c in ("key", "pair", "weight", "a", "body")}
        if len(want):
            row = left.to_pylist()[0]
            p, keys = Part(row, plan), unpack_sorted(row["keys"], row["n_pairs"], np.uint8)[0]
            hot = (flags[want] & HOT) > 0
            bucket = _bucket(keys[want], log)
            for b in np.unique(bucket[~hot]):
                own = want[~hot & (bucket == b)]
                texts = [p.content(i) for i in own]
                for c, x in zip(pieces, (b, row["part"], own, np.zeros(len(own), np.int32), list(map(len, texts)), _compress(b"".join(texts))), strict=True):
                    pieces[c].append(x)
            for i in want[hot]:
                body = p.content(i)
                for c, x in zip(cores, (int(keys[i].view(np.int64)), i, 2 if flags[i] & REPEATED else 1, core_of(body, p.length(i), plan), body), strict=True):
                    cores[c].append(x)
        n, m = len(pieces["part"]), len(cores["key"])
        numbers, part = pa.list_(pa.int32()), left.column("part")[0].as_py()
        none = lambda k: [None] * k
        return pa.table({
            "bucket": pa.array(pieces["bucket"] + none(m), pa.int64()), "part": pa.array([part] * (n + m), pa.int64()), "pairs": pa.array(pieces["pairs"] + none(m), numbers),
            "shifts": pa.array(pieces["shifts"] + none(m), numbers), "sizes": pa.array(pieces["sizes"] + none(m), numbers), "blob": pa.array(pieces["blob"] + none(m), pa.binary()),
            "key": pa.array(none(n) + cores["key"], pa.int64()), "pair": pa.array(none(n) + cores["pair"], pa.int32()), "shift": pa.array(none(n) + [0] * m, pa.int32()),
            "weight": pa.array(none(n) + cores["weight"], pa.int32()), "a": pa.array(none(n) + cores["a"], pa.int32()), "b": pa.array(none(n) + [a + plan.seed for a in cores["a"]], pa.int32()),
            "body": pa.array(none(n) + cores["body"], pa.binary())})

    schema = f"{_PIECES}, {', '.join(c for c in _CORES.split(', ') if not c.startswith('part '))}"
    left = parts.select("part", "lengths", "raw", "n_pairs", "n_segments", "keys", "segments").where("n_pairs > 0").repartition(tasks, "part")
    return write_shared(left.groupBy("part").cogroup(counted.select("part", "bucket", "size", "blob").repartition(tasks, "part").groupBy("part")).applyInArrow(send, schema), "differing")


def halves(body: bytes, a: int, b: int, length: int) -> list[tuple[int, int, int, int]]:
    """(first window, windows, new core's begin and end in the body) of the windows that reach left, and of those that reach right."""
    lowest, highest = max(0, b - length), min(a, len(body) - length)  # windows hold the core
    rest = length - (b - a)
    left = -(-rest // 2)
    out = []
    if (n := min(highest, a - left) - lowest + 1) > 0:
        out.append((lowest, n, a - left, b))
    if (n := highest - max(lowest, a - left + 1) + 1) > 0:
        out.append((max(lowest, a - left + 1), n, a, b + rest - left + 1))
    return out


def _split(hot: DataFrame, count: int, plan: Plan) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows of _CORES with their keys made longer until few share one: what goes to the suffix arrays, as _CORES, and answers."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c.split()[0]: [] for c in _CORES.split(", ")}
            for r in batch.to_pylist():
                which = r["key"] & 1
                length = plan.lengths[which]
                for first, windows, a, b in halves(r["body"], r["a"], r["b"], length):
                    digest = hashlib.blake2b(r["body"][a:b], digest_size=8, key=bytes([which, r["a"] - a & 1])).digest()
                    new = (int.from_bytes(digest, "little", signed=True) & ~1) | which
                    body = r["body"][first : first + windows - 1 + length]
                    for c, x in zip(out, (new, r["part"], r["pair"], r["shift"] + first, r["weight"], a - first, b - first, body), strict=True):
                        out[c].append(x)
            yield pa.RecordBatch.from_pydict({c: pa.array(x, k) for (c, x), k in zip(out.items(), (pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary()), strict=True)})

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows occur again."""
        for batch in batches:
            n = [len(x) - plan.lengths[k & 1] + 1 for k, x in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "pair": batch.column("pair"), "shift": batch.column("shift"), "size": pa.array(n, pa.int32()),
                                              "blob": pa.array([np.packbits(np.ones(k, np.uint8)).tobytes() for k in n], pa.binary())})

    ready, answers = [], []
    while count:
        rows = write_shared(hot.mapInArrow(halve, _CORES), "cores")
        same = rows.groupBy("key", "a", "b", "body").agg(F.sum("weight").alias("n"), F.min(F.struct("part", "pair", "shift")).alias("own"))
        kinds = same.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("n") < 2, 1)).alias("single"))
        known = write_shared(same.join(kinds, "key"), "core-kinds")
        again = rows.where("part >= 0").join(known.where("n > 1").select("key", "a", "b", "body"), ["key", "a", "b", "body"])
        answers.append(again.select("key", "part", "pair", "shift", "body").mapInArrow(full, _ANSWER))
        one = F.col("n") < 2
        owner = lambda c: F.when(one, F.col(f"own.{c}")).otherwise(F.lit(-1)).alias(c)
        left = known.where("kinds > 1 and single > 0").select("key", owner("part").cast("long").alias("part"), owner("pair"), owner("shift"), F.least("n", F.lit(2)).cast("int").alias("weight"), "a", "b", "body", "kinds")
        ready.append(left.where(F.col("kinds") <= plan.gather).drop("kinds"))
        hot = left.where(F.col("kinds") > plan.gather).drop("kinds")
        count = hot.count()
    return ready, answers


def _told_apart(parts: DataFrame, counted: DataFrame, tasks: int, gathered: int, hot: int, plan: Plan) -> DataFrame:
    """_ANSWER for segments that differ from others of their minimizer."""
    each = max(plan.lengths) + 150
    log = max(1, bucket_log(gathered * each, plan.block, 7, 40))
    sent = _leaving(parts, counted, tasks, log, plan)
    pieces, answers = sent.where("key is null").select(*(c.split()[0] for c in _PIECES.split(", "))), []
    if hot:
        ready, answers = _split(sent.where("key is not null").select(*(c.split()[0] for c in _CORES.split(", "))), hot, plan)

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, texts = b.column("key").to_numpy().view(np.uint64), b.column("body").to_pylist()
                list_of = lambda x: pa.array([[v] for v in x], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array((np.int64(1) << 48) + _bucket(keys, 30), pa.int64()), "part": b.column("part"), "pairs": list_of(b.column("pair").to_pylist()), "shifts": list_of(b.column("shift").to_pylist()),
                    "sizes": list_of(map(len, texts)), "blob": pa.array([_compress(t) for t in texts], pa.binary())})

        for r in ready:
            pieces = pieces.unionAll(r.mapInArrow(single, _PIECES))

    def gather(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["pairs"], r["shifts"]))
        flat = lambda c: [x for r in rows for x in r[c]]
        return pa.table({
            "text": pa.array([b"".join(zstandard.ZstdDecompressor().decompress(r["blob"], max_output_size=max(1, sum(r["sizes"]))) for r in rows)], pa.binary()),
            "lengths": pa.array([np.array(flat("sizes"), dtype=np.int32).tobytes()], pa.binary()), "least": pa.array([plan.lengths[key[0].as_py() & 1]], pa.int32()),
            "owners": pa.array([[r["part"] for r in rows for _ in r["pairs"]]], pa.list_(pa.int64())), "pairs": pa.array([flat("pairs")], pa.list_(pa.int32())), "shifts": pa.array([flat("shifts")], pa.list_(pa.int32()))})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                hit, out, begin = np.frombuffer(r["hits"], dtype=np.uint8), [], 0
                for part, pair, shift, n in zip(r["owners"], r["pairs"], r["shifts"], np.frombuffer(r["lengths"], dtype=np.int32).tolist(), strict=True):
                    windows = n - r["least"] + 1
                    if part >= 0 and hit[begin : begin + windows].any():
                        out.append((part, pair, shift, windows, np.packbits(hit[begin : begin + windows]).tobytes()))
                    begin += n
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_pydict({c: pa.array(x, k) for c, x, k in zip(("part", "pair", "shift", "size", "blob"), cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)})

    jvm.register(parts.sparkSession, "LyndonSuffixes", "lyndon_repeats", "binary")
    blocks = pieces.repartition(tasks_for((gathered + 4 * hot) * each, 16 * plan.block), "bucket").groupBy("bucket").applyInArrow(gather, "text binary, lengths binary, least int, owners array<long>, pairs array<int>, shifts array<int>")
    hits = blocks.select("lengths", "least", "owners", "pairs", "shifts", F.call_function("lyndon_repeats", "text", "lengths", "least").alias("hits"))
    out = hits.mapInArrow(answer, _ANSWER)
    for a in answers:
        out = out.unionAll(a)
    return out


def deduplicate(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, n_passage; with spans=True also removed, array of [start, end) bytes."""
    parts = lay_out(docs, id_col, text_col, 8 << 20, lambda texts: _stored(texts, plan), _STORED)
    log = bucket_log(input_bytes(parts))
    count = parts.count()
    tasks = tasks_for(count, 2)
    counted, sums = _counted(parts, count, log, plan)
    gathered, hot = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("gathered", "hot"))).first()
    told = _told_apart(parts, counted, tasks, gathered, hot, plan)
    answers = counted.select("part", "bucket", "size", "blob", F.lit(-1).alias("pair"), F.lit(0).alias("shift")).unionAll(told.select("part", F.lit(-1).cast("long").alias("bucket"), "size", "blob", "pair", "shift"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        p = Part(left.to_pylist()[0], plan)
        flags = _flags(right.filter(pc.equal(right.column("pair"), -1)))
        starts: dict[int, list[np.ndarray]] = {}  # of pairs that differ: window numbers that occur again
        for r in right.filter(pc.not_equal(right.column("pair"), -1)).select(["pair", "shift", "size", "blob"]).to_pylist():
            starts.setdefault(r["pair"], []).append(r["shift"] + np.flatnonzero(np.unpackbits(np.frombuffer(r["blob"], dtype=np.uint8), count=r["size"])))
        edge = np.searchsorted(p.text, np.arange(len(p.texts) + 1))
        told = np.zeros(len(p.which), dtype=bool)
        told[list(starts)] = True
        whole = (flags & REPEATED) > 0 if len(flags) else told
        n_spans, removed, sha, cut, passage = [], [], [], [], []
        for i, t in enumerate(p.texts):
            own = np.arange(edge[i], edge[i + 1])
            own = own[whole[p.pair[own]] | told[p.pair[own]]]
            borders = []
            for k, length in enumerate(plan.lengths):
                change = np.zeros(len(t) + 1, dtype=np.int64) if len(own) else None
                mine = own[p.which[p.pair[own]] == k]
                every = mine[whole[p.pair[mine]]]
                np.add.at(change, p.first[every], 1) if len(own) else None
                np.add.at(change, p.first[every] + p.windows[every] - 1 + length, -1) if len(own) else None
                for j in mine[~whole[p.pair[mine]]]:
                    for w in starts[p.pair[j]]:
                        np.add.at(change, w + p.first[j], 1)
                        np.add.at(change, w + p.first[j] + length, -1)
                gone = np.cumsum(change[:-1]) > 0 if len(own) else np.zeros(0, bool)
                borders.append(np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2))
            border, pos, stay = borders[0], 0, []
            for a, b in border:
                stay.append(t[pos:a])
                pos = b
            removed.append(int((border[:, 1] - border[:, 0]).sum())), n_spans.append(len(border))
            sha.append(hashlib.sha256(b"".join([*stay, t[pos:]]) if len(border) else t).hexdigest())
            cut.append([{"start": int(a), "end": int(b)} for a, b in border])
            passage.append(sum(int(b - a) for a, b in (borders[1] if plan.passage else ()) if len(t[a:b].split()) > plan.words))
        out = {
            "id": left.column("ids").combine_chunks().flatten(), "n_bytes": pa.array([len(t) for t in p.texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "n_passage": pa.array(passage, pa.int64())}
        return pa.table(out | ({"removed": pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))} if spans else {}))

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long" + ", removed array<struct<start:long,end:long>>" * spans
    return parts.drop("keys", "digests").repartition(tasks, "part").groupBy("part").cogroup(answers.repartition(tasks, "part").groupBy("part")).applyInArrow(run, schema).withColumnRenamed("id", id_col)
