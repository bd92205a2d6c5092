"""Documents laid out as parts: about PART bytes of whole texts in one compressed row, in the shared folder.

Several passes over all texts, and answers that come back to them by part, then need no ids to be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docquarry.llm.common import pieces, write_shared
from docquarry.llm.words import joined

PART = 12 << 20


def tasks_for(size: int, each: int) -> int:
    """Tasks that get ``each`` of the size: the number grows with the input, what a task reads does not."""
    return max(1, -(-size // each))


def lay_out(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PART,
    more: Callable[[list[bytes]], dict[str, pa.Array]] | None = None, more_schema: str = "",
) -> DataFrame:
    """Rows (part, ids, lengths, raw): ids and byte lengths of the texts, whose bytes on end are raw (zstd).  Null is empty.

    ``more`` gives further columns of a part's row, of one value each, from its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, wait, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, size
            made += 1
            ids, lengths, raw = pa.concat_arrays([x[0] for x in wait]), np.concatenate([x[1] for x in wait]), b"".join(x[2] for x in wait)
            out = pa.RecordBatch.from_pydict({
                "part": pa.array([(task << 32) + made], pa.int64()), "ids": pa.array([ids], pa.list_(ids.type)), "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "raw": pa.array([zstandard.ZstdCompressor(level=3, write_checksum=False).compress(raw)], pa.binary())} | (more(_texts(raw, lengths)) if more else {}))
            wait.clear()
            size = 0
            return out

        for whole in batches:
            for b in pieces(whole, "text", 2 << 20):
                raw, at = joined(b.column("text"))
                if wait and size + len(raw) > most:
                    yield close()
                wait.append((b.column("id"), np.diff(at), raw.tobytes()))
                size += len(raw)
        if wait:
            yield close()

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"part long, ids array<{kind}>, lengths array<long>, raw binary" + (f", {more_schema}" if more else "")
    return write_shared(src.mapInArrow(run, schema), "parts")


def open_part(raw: bytes, lengths: list[int]) -> list[bytes]:
    """The texts of a part."""
    return _texts(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, sum(lengths))), lengths)


def _texts(data: bytes, lengths) -> list[bytes]:
    out, at = [], 0
    for n in lengths:
        out.append(data[at : at + n])
        at += n
    return out


def runs_of(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """[begin, stop) of texts that hold about ``most`` bytes together (one text at least)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)
