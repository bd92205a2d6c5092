"""Language model by deleted interpolation of bigram, unigram and uniform estimates.

P(w | h) = l2(b) c(h,w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the context's
frequency (its power of two); l2 is 0 in the bucket of contexts that were never seen, so every context's probabilities sum to 1, with
all unknown tokens together as one.  The mixture weights of each bucket are learnt by expectation-maximisation on held-out
counts: the counts of one fold of the training documents are estimated from those of the other training folds.
Afterwards both together give the model's counts.

Tokens are the maximal runs without white space, A-Z as a-z, then one end token a document, which is also the
context of a document's first token.  Counts are of all training documents; tokens and bigrams are told apart by 64 bits of
hash, totals are 64-bit.  The order is 2: trigrams nearly double what the exchange sends, beyond the disk the check tool allows.

How it runs: documents are tokenised once into chunks (token indices and distinct token hashes, written to
the shared folder).  Chunks ask for the totals of their distinct tokens and bigrams in compressed blobs
(see blobs), the answers meet their chunks again, once for the held-out fold and once for
scoring.  The EM statistics are a histogram over (bucket, ratio bins) of bounded size, so only that, N and V
reach the driver.

Defined results: null and empty texts are one end token; repeated rows count each; very long texts
are one chunk's part and scored whole; an empty table gives an empty result; without training documents
every probability is uniform; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.blobs import ROWS, Exchange, asked, bucket_log, exchange, first_bits, pack, pack_sorted, unpack, unpack_sorted
from docquarry.llm.common import fold_of, input_bytes, mix64, pieces, write_shared
from docquarry.llm.parts import tasks_for
from docquarry.llm.words import TOKEN, words_of

END = np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0xA0761D6478BD642F)
#: Tokens of a chunk, width of a ratio bin (natural log) and number of context buckets.
CHUNK, STEP, BUCKETS = 1_000_000, 0.25, 48
TEST, HELD = 1, 2  # folds: never learnt from; held out for the weights


def _sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an END after each text, and each text's number of tokens."""
    w = words_of(texts, TOKEN)
    n = w.count + 1
    seq = np.empty(int(n.sum()), dtype=np.uint64)
    seq[np.cumsum(n) - 1] = END
    seq[np.arange(len(w.hash)) + w.doc] = w.hash
    return seq, n


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (chunk, held, ids, fold, n, size, distinct, tokens): the chunks, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        wait: dict[bool, list] = {True: [], False: []}

        def close(held: bool) -> pa.RecordBatch:
            nonlocal made
            rows, wait[held] = wait[held], []
            seq = np.concatenate([r[0] for r in rows])
            known, index = np.unique(seq, return_inverse=True)
            made += 1
            one = lambda x, kind: pa.array([x], kind)
            return pa.RecordBatch.from_pydict({
                "chunk": one((part << 32) + made, pa.int64()), "held": one(held, pa.bool_()), "ids": pa.array([pa.concat_arrays([r[2] for r in rows])], pa.list_(rows[0][2].type)),
                "fold": one(np.concatenate([r[3] for r in rows]), pa.list_(pa.int32())), "n": one(np.concatenate([r[1] for r in rows]), pa.list_(pa.int64())),
                "size": one(len(known), pa.int32()), "distinct": one(pack_sorted(known), pa.binary()), "tokens": one(pack(index.astype(np.uint32)), pa.binary())})

        for whole in batches:
            for b in pieces(whole, "text", 1 << 20):
                seq, n = _sequence(b.column("text"))
                folds, at = fold_of(b.column("id")), np.repeat(np.arange(b.num_rows), n)
                for held in (True, False):
                    own = (folds == HELD) == held
                    if own.any():
                        wait[held].append((seq[own[at]], n[own], b.column("id").filter(pa.array(own)), folds[own]))
                        if sum(len(r[0]) for r in wait[held]) >= CHUNK:
                            yield close(held)
        for held in (True, False):
            if wait[held]:
                yield close(held)

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return write_shared(src.mapInArrow(run, f"chunk long, held boolean, ids array<{kind}>, fold array<int>, n array<long>, size int, distinct binary, tokens binary"), "chunks")


class _Chunk:
    """A chunk opened: token sequence, its distinct tokens and bigrams and where each position has its own."""

    def __init__(self, row: dict):
        self.n = np.array(row["n"], dtype=np.int64)
        self.fold = np.array(row["fold"], dtype=np.int64)
        self.token = unpack(row["tokens"], int(self.n.sum()), np.uint32)[0].astype(np.int64)
        self.known = unpack_sorted(row["distinct"], row["size"])[0]
        h = self.known[self.token]
        self.end = int(np.searchsorted(self.known, END))
        with np.errstate(over="ignore"):
            context = np.concatenate(([END], h[:-1]))
            pair = mix64(context * _PAIR + h)
        self.context = np.concatenate(([self.end], self.token[:-1]))
        self.pairs, self.pair = np.unique(pair, return_inverse=True)

    def counts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(order, keys, counts in the main folds, counts in the held-out fold)."""
        of = np.repeat(self.fold, self.n)
        for order, keys, at in ((1, self.known, self.token), (2, self.pairs, self.pair)):
            main, held = (np.bincount(at[x], minlength=len(keys)).astype(np.uint64) for x in ((of != TEST) & (of != HELD), of == HELD))
            yield order, keys, main, held


_COLUMNS = ("fold", "n", "size", "distinct", "tokens")


def added(at: np.ndarray, counts: list[np.ndarray], size: int) -> np.ndarray:
    """64-bit sums of the counts, by index."""
    out = np.zeros(size, dtype=np.uint64)
    np.add.at(out, at, np.concatenate(counts).astype(np.uint64))
    return out


def _merge(entries: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    known, of = np.unique(entries[0], return_inverse=True)
    return [known, *(added(of, [x], len(known)) for x in entries[1:])], of


def _total(kind: int, entries: list[np.ndarray]) -> tuple[list[np.ndarray], dict[str, int]]:
    (_, main, held), of = _merge(entries)
    sums = {"distinct": int(((main + held) > 0).sum()), "main": int(main.sum()), "held": int(held.sum())}
    return [main[of], held[of]], sums if kind == 1 else dict.fromkeys(sums, 0)


#: Counts in the main folds and in the held-out fold; kind is the order.
COUNTS = Exchange((np.uint64, np.uint64), (np.uint64, np.uint64), _merge, _total, lambda answers, _, of: answers, ("distinct", "main", "held"))


def totals(chunks: DataFrame, count: int, log: int) -> tuple[DataFrame, DataFrame]:
    """Answers (chunk, order, bucket, size, blob) for every chunk, and buckets' sums over tokens."""
    bits = first_bits(log)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for order, keys, main, held in _Chunk(row).counts():
                    yield asked(order, row["chunk"], [keys, main, held], bits)

    answers, sums = exchange(chunks.select("chunk", *_COLUMNS).mapInArrow(ask, ROWS), log, count, COUNTS)
    return answers.select(F.col("part").alias("chunk"), F.col("kind").alias("order"), "bucket", "size", "blob"), sums


def _opened(left: pa.Table, right: pa.Table) -> tuple[_Chunk, dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk, its row, and its distinct tokens' and bigrams' counts (main, held-out)."""
    row = left.to_pylist()[0]
    parts = sorted(zip(*(right.column(c).to_pylist() for c in ("order", "bucket", "size", "blob")), strict=True))
    got = {o: [unpack(raw, s, np.uint64, np.uint64) for p, _, s, raw in parts if p == o] for o in (1, 2)}
    one = [np.concatenate([x[i] for x in got[o]]).astype(np.float64) for o in (1, 2) for i in (0, 1)]
    return _Chunk(row), row, *one


def _meet(chunks: DataFrame, answers: DataFrame, tasks: int, run, schema: str) -> DataFrame:
    return chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(run, schema)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c)[1], BUCKETS - 1)  # 0; 1; 2-3; 4-7; ...


def _bins(p: np.ndarray, uniform: float) -> np.ndarray:
    """0 where the estimate is 0, else its ratio to the uniform one in steps of STEP."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(np.log(p / uniform) / STEP) + 100, 1, 499), 0).astype(np.int64)


def learn_weights(chunks: DataFrame, answers: DataFrame, tasks: int, main: int, distinct: int) -> np.ndarray:
    """BUCKETS x 3 mixture weights (uniform, unigram, bigram) from the held-out fold."""
    uniform = 1 / (distinct + 1)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        cells, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            c, _, one, _, two, _ = _opened(left, right)
            context = one[c.context]
            p1 = one[c.token] / max(main, 1)
            p2 = two[c.pair] / np.maximum(context, 1)
            cells, n = np.unique((_bucket(context) * 500 + _bins(p2, uniform)) * 500 + _bins(p1, uniform), return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})

    got = _meet(chunks.where("held"), answers.join(chunks.where("held").select("chunk"), "chunk", "left_semi"), max(1, tasks // 4), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy().astype(float)
    b, r2, r1 = cell // 250_000, cell // 500 % 500, cell % 500
    ratio = lambda r: np.where(r > 0, np.exp((r - 100) * STEP), 0.0)
    return expectation_maximisation(b, np.column_stack([np.ones(len(b)), ratio(r1), ratio(r2)]), n)


def expectation_maximisation(bucket: np.ndarray, likelihood: np.ndarray, n: np.ndarray, turns: int = 200) -> np.ndarray:
    """Weights of each bucket; a bucket's counts are joined by ten of the weights of all buckets together."""
    def em(own: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
        w = prior.copy()
        like, k = likelihood[own], n[own]
        for _ in range(turns):
            post = like * w
            post *= (k / np.maximum(post.sum(axis=1), 1e-300))[:, None]
            new = post.sum(axis=0) + strength * prior
            new /= new.sum()
            if np.abs(new - w).max() < 1e-10:
                break
            w = new
        return w

    even = np.full(3, 1 / 3)
    every = em(np.ones(len(n), dtype=bool), even, 1e-3) if len(n) else even
    out = np.stack([em(bucket == b, every, 10.0) if (bucket == b).any() else every for b in range(BUCKETS)])
    out[0, 2] = 0.0  # a context that was never seen has no bigram estimate
    return out / out.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """Training tokens, distinct ones, and the mixture weights."""

    every: int
    distinct: int
    weights: np.ndarray
    tasks: int  # that share the chunks


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, Model]:
    """Chunks, totals and the model."""
    chunks = tokenise(docs, id_col, text_col)
    count = chunks.count()
    answers, sums = totals(chunks, count, bucket_log(input_bytes(chunks), 12 << 20))
    s = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "main", "held"))).first()
    distinct, main, every = int(s[0]), int(s[1]), int(s[1] + s[2])
    tasks = tasks_for(count, 4)
    return chunks, answers, Model(every, distinct, learn_weights(chunks, answers, tasks, main, distinct), tasks)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chunks, answers, model = learn(docs, id_col, text_col)
    every, distinct, weights = model.every, model.distinct, model.weights
    base, uniform = math.log10(every + 0.5 * (distinct + 1)), 1 / (distinct + 1)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        c, row, one_a, one_b, two_a, two_b = _opened(left, right)
        one, two, doc = one_a + one_b, two_a + two_b, np.repeat(np.arange(len(c.n)), c.n)
        count, context = one[c.token], one[c.context]
        w = weights[_bucket(context)]
        p = w[:, 0] * uniform + w[:, 1] * count / max(every, 1) + w[:, 2] * two[c.pair] / np.maximum(context, 1)
        by = lambda x: np.bincount(doc, weights=x, minlength=len(c.n))
        return pa.table({
            "id": left.column("ids").combine_chunks().flatten(), "held_out": pa.array(c.fold == TEST), "n_tokens": pa.array(c.n),
            "n_known": pa.array(by((count > 0).astype(float)).astype(np.int64)), "train_tokens": pa.array([every] * len(c.n), pa.int64()),
            "base_score": pa.array(by(np.log10(one + 0.5)[c.token] - base)), "score": pa.array(by(np.log10(p)))})

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _meet(chunks, answers, model.tasks, run, schema).withColumnRenamed("id", id_col)
