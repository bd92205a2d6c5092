"""Integer arrays as compressed bytes, and key exchanges in which a part of the input asks for totals by hash.

A row for every key would cost more than the keys.  So each part sorts its distinct keys, cuts
them by their upper bits into buckets, and sends one blob a bucket; a bucket's task adds up all parts'
blobs and answers each in its order.  Blobs and answers are ordinary shuffled rows.

Buckets grow in number with the input, as parts do, so parts times buckets would grow with its square.  Beyond 2**FAN buckets
a part cuts by FAN bits only; groups of 2**FAN parts are merged bucket by bucket, and the merged keys are cut by FAN more bits, until
there are as many buckets as wanted.  Answers go back the same way.  So a part has at most 2**FAN blobs at each of a
few levels, and rows grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import write_shared

#: Bits by which keys are cut at a level.
FAN = 8


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays of one length, byte plane by byte plane."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(body)


def unpack(raw: bytes, size: int, *kinds: type) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, size * sum(np.dtype(k).itemsize for k in kinds))), dtype=np.uint8)
    out, at = [], 0
    for k in kinds:
        width = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(data[at : at + size * width].reshape(width, size).T).view(k).ravel())
        at += size * width
    return out


def pack_sorted(keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    """pack() with ascending uint64 keys as their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)), *arrays)


def unpack_sorted(raw: bytes, size: int, *kinds: type) -> list[np.ndarray]:
    keys, *rest = unpack(raw, size, np.uint64, *kinds)
    return [np.cumsum(keys, dtype=np.uint64), *rest]


def bucket_log(input_bytes: int, each: int = 8 << 20, least: int = 7, most: int = 40) -> int:
    """Buckets as a power of two for an input of so many (compressed) bytes."""
    return min(most, max(least, int(np.ceil(np.log2(max(1, input_bytes / each))))))


#: A blob of a part's keys in a bucket, and the answer to it.  kind tells several sets of keys apart.
ROWS = "kind int, bucket long, part long, size int, blob binary"


@dataclass(frozen=True)
class Exchange:
    """What an operator asks.  Lists of arrays are entries: keys and the columns beside them, of several parts on end."""

    kinds: tuple[type, ...]  # of the columns beside the keys
    answers: tuple[type, ...]  # of an answer's columns
    #: entries -> one entry a distinct key, in the order of keys, and the index of each entry's
    merge: Callable[[list[np.ndarray]], tuple[list[np.ndarray], np.ndarray]]
    #: kind, all entries of a bucket -> answer columns, an answer for each, and sums of the bucket by name
    total: Callable[[int, list[np.ndarray]], tuple[list[np.ndarray], dict[str, int]]]
    #: answers to the merged entries at each entry's index, entries, index -> answers to the entries
    give: Callable[[list[np.ndarray], list[np.ndarray], np.ndarray], list[np.ndarray]]
    sums: tuple[str, ...] = ()


def asked(kind: int, part: int, entries: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A part's (or a group's) entries, sorted by key, as ROWS: a blob for each bucket that has any."""
    at = cuts(entries[0], bits)
    return _rows(kind, part, at, [pack_sorted(*(x[i:j] for x in entries)) for _, i, j in at])


def cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of ascending 64-bit keys by their upper bits, where there are any."""
    bucket = keys >> np.uint64(64 - bits)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True)) if len(at) else []


def _rows(kind: int, part: int, at: list[tuple[int, int, int]], blobs: list[bytes]) -> pa.RecordBatch:
    n = len(at)
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([b for b, _, _ in at], pa.int64()), "part": pa.array([part] * n, pa.int64()),
        "size": pa.array([j - i for _, i, j in at], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _opened(rows: list[dict], kinds: tuple[type, ...]) -> list[np.ndarray]:
    got = [unpack_sorted(r["blob"], r["size"], *kinds) for r in rows]
    return [np.concatenate([g[i] for g in got]) for i in range(len(kinds) + 1)]


def exchange(rows: DataFrame, log: int, parts: int, how: Exchange, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers (ROWS) to all blobs, which are cut by first_bits(log) bits, and the last level's rows with each bucket's sums on one of them."""
    bits = first_bits(log) if bits is None else bits
    in_order = lambda t: sorted(t.to_pylist(), key=lambda r: (r["part"], r["bucket"]))

    def answered(rows: list[dict], columns: list[np.ndarray], sums: dict[str, int] | None = None) -> pa.Table:
        out, begin = [], 0
        for r in rows:
            out.append(r | {"blob": pack(*(c[begin : begin + r["size"]] for c in columns))})
            begin += r["size"]
        table = {c: pa.array([r[c] for r in out], k) for c, k in zip(("kind", "bucket", "part", "size", "blob"), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)}
        return pa.table(table | {c: pa.array([n] + [0] * (len(out) - 1), pa.int64()) for c, n in (sums or {}).items()})

    if bits == log:
        def total(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            own = in_order(t)
            columns, sums = how.total(key[0].as_py(), _opened(own, how.kinds))
            return answered(own, columns, sums)

        schema = ", ".join([ROWS, *(f"{c} long" for c in how.sums)])
        out = write_shared(rows.repartition(1 << max(0, log - 1), "kind", "bucket").groupBy("kind", "bucket").applyInArrow(total, schema), "totals")
        return out.select("kind", "bucket", "part", "size", "blob"), out

    step, groups = min(log, bits + FAN), max(1, -(-parts // (1 << FAN)))
    rows = write_shared(rows.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups))), "blobs")

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        entries, _ = how.merge(_opened(in_order(t), how.kinds))
        return pa.Table.from_batches([asked(key[0].as_py(), key[2].as_py(), entries, step)])

    def give(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        own = in_order(left.drop_columns(["g"]))
        entries = _opened(own, how.kinds)
        _, of = how.merge(entries)
        back = sorted(right.to_pylist(), key=lambda r: r["fine"])
        got = [unpack(r["blob"], r["size"], *how.answers) for r in back]
        return answered(own, how.give([np.concatenate([g[i] for g in got])[of] for i in range(len(how.answers))], entries, of))

    tasks = 1 << max(0, bits - 1)
    spread = lambda df: df.repartition(tasks * -(-groups // 4), "kind", "bucket", "g").groupBy("kind", "bucket", "g")
    above, sums = exchange(spread(rows).applyInArrow(merge, ROWS), log, groups, how, step)
    above = above.select("kind", F.shiftright("bucket", step - bits).alias("bucket"), F.col("part").alias("g"), F.col("bucket").alias("fine"), "size", "blob")
    return write_shared(spread(rows).cogroup(spread(above)).applyInArrow(give, ROWS), "answers"), sums


def first_bits(log: int) -> int:
    """Bits that parts cut their keys by, for 2**log buckets in the end."""
    return min(log, FAN)
