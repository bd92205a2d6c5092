"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives token bytes and ids.  Bytes are mapped to printable characters (the usual
byte-level table), every adjacent pair whose concatenation has a rank becomes a merge in rank
order, and a whole piece that is a token itself is taken at once: this is the rank-driven merge
order.  A text is cut by the pattern; each distinct piece of a batch is encoded once by the
library, as pieces never merge across their borders.  Decoding looks ids up in the reversed byte
table, so a character split over several tokens comes back whole once its bytes are joined.

Defined results: null and empty texts give no ids; white space, very long pieces and repeated rows
are ordinary; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docquarry.llm.common import pieces, texts_of

#: Entries of the per-process cache of pieces; it is emptied when full.
CACHE_PIECES = 200_000
_OPEN: dict[tuple[str, str], "Codec"] = {}


def byte_table() -> list[str]:
    """Byte -> printable character: printable Latin-1 stands for itself, the others follow from U+0100."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in same else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one rank file; opened once in a process."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks, chars = read_ranks(path), byte_table()
        shown = lambda raw: "".join(chars[b] for b in raw)
        merges = [
            (shown(token[:i]), shown(token[i:]))
            for token, _ in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        # White space as Unicode has it: the regex module's \s takes four control characters more.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # Pieces as ids; and as decimal ids and the bytes that these decode to
        self.ids: dict[str, list[int]] = {}
        self.decimal: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def _new(self, words: set[str], cache: dict) -> Iterator[tuple[str, list[int]]]:
        """Encodes pieces that a cache lacks."""
        new = [w for w in words if w not in cache]
        return ((w, e.ids) for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True))

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > CACHE_PIECES:
            self.ids.clear()
        self.ids.update(self._new(words, self.ids))

    def learn_digests(self, words: set[str]) -> None:
        if len(self.decimal) > CACHE_PIECES:
            self.decimal.clear(), self.raw.clear()
        for w, ids in self._new(words, self.decimal):
            self.decimal[w] = ",".join(map(str, ids))
            self.raw[w] = self.decode(ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def cut(self, texts: list[str]) -> list[list[str]]:
        return [self.split.findall(t) for t in texts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.cut(texts)
        self.learn(set(chain.from_iterable(found)))
        return [[i for w in words for i in self.ids[w]] for words in found]

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Code-point start and end of each token; a token inside a character has that character's span."""
        if not ids:
            return [], []
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        stop = np.cumsum([len(self.bytes_of[i]) for i in ids])
        return char[np.concatenate(([0], stop[:-1]))].tolist(), (char[stop - 1] + 1).tolist()


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = Codec(path, pattern)
    return _OPEN[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """Per row: the id, ids array<int>, and with offsets=True starts and ends array<int> in code points."""
    fields = "ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for b in pieces(whole, "text", 4 << 20):
                texts = texts_of(b)
                ids = c.encode(texts)
                out = {"id": b.column("id"), "ids": pa.array(ids, pa.list_(pa.int32()))}
                if offsets:
                    spans = [c.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                    out |= {n: pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k, n in enumerate(("starts", "ends"))}
                yield pa.RecordBatch.from_pydict(out)

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return src.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and raw binary, the bytes that the ids stand for (null ids: no bytes)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            raw = [c.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "raw": pa.array(raw, pa.binary())})

    src = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    return src.mapInArrow(run, f"id {kind}, raw binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass, for checks of whole tables: n_tokens, ids_sha256, decoded_sha256.

    The ids stay inside the pass; each piece's bytes come from decoding its ids.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for b in pieces(whole, "text", 2 << 20):
                n, ids_sha, raw_sha = [], [], []
                found = c.cut(texts_of(b))
                c.learn_digests(set(chain.from_iterable(found)))
                for words in found:
                    said = ",".join(map(c.decimal.__getitem__, words))
                    n.append(said.count(",") + 1 if words else 0)
                    ids_sha.append(hashlib.sha256(said.encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(b"".join(map(c.raw.__getitem__, words))).hexdigest())
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(raw_sha, pa.string())})

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return src.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
