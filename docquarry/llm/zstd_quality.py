"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed in blocks, each once with a dictionary trained on good text and once with one
trained on bad text.  (bad size - good size) / size without a dictionary is positive where the text
is more like good text; a logistic curve fitted on labelled texts that neither dictionary saw turns
it into a probability.  Blocks keep the dictionary effective over all of a long text.

Bounds (documented sample): at most ``Training.most_docs`` labelled documents, those of lowest id hash.  Their whole texts are cut
into blocks, and of all blocks of each label ``most_blocks``, those of lowest hash wherever they stand, train its dictionary in the
driver.  The documents for calibration are scored whole on the cluster; the driver gets two numbers each.

Defined results: null and empty texts score what a difference of zero scores; very long texts are
compressed whole; repeated rows score alike; several labels of one document count by majority, ties as
good; null labels and labels of unknown documents are ignored; a labelled id with several rows counts once, with its least text; with
one class only (or none), or too little text for a dictionary, every text scores the smoothed share of good labels; an empty table
of documents gives an empty result; extra columns are ignored by score() and kept by keep(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import fold, texts_of, write_shared


@dataclass(frozen=True)
class Training:
    most_docs: int = 4000
    most_blocks: int = 12_000  # of each label
    block: int = 1024  # bytes compressed at a time when scoring
    sample_block: int = 2048  # bytes of a training block
    dictionary: int = 112_640
    level: int = 3
    calibration: float = 0.4  # share of the labelled documents kept from the dictionaries


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    intercept: float
    slope: float
    how: Training

    def measure(self):
        """A function text -> (bad size - good size) / plain size; opens its compressors once."""
        open_ = lambda raw: zstandard.ZstdCompressor(
            level=self.how.level, write_content_size=False, write_checksum=False, write_dict_id=False,
            **({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}))
        good, bad, none = (open_(x).compress for x in (self.good, self.bad, b""))
        step = self.how.block

        def of(text: str) -> float:
            raw = text.encode()
            g = b = n = 0
            for i in range(0, len(raw), step):
                part = raw[i : i + step]
                g += len(good(part))
                b += len(bad(part))
                n += len(none(part))
            return (b - g) / max(n, 1)

        return of

    def scorer(self):
        """A function text -> score."""
        measure = self.measure() if self.good else lambda _: 0.0
        return lambda text: 1 / (1 + math.exp(-(self.intercept + self.slope * measure(text))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Maximum likelihood of intercept and slope by Newton steps, with a slight ridge on the slope."""
    scale = max(float(np.abs(x).max()), 1e-9)
    z, w = np.column_stack([np.ones_like(x), x / scale]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (y - p) - np.array([0, 1e-3]) * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-9, 1e-3])
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def dictionaries(good: list[bytes], bad: list[bytes], how: Training) -> tuple[bytes, bytes]:
    """One dictionary of each label's blocks, of one size: the largest, halved from ``how.dictionary``, that both fill.

    A dictionary that the trainer can't fill holds little of its label's text, and sizes would differ by that alone.
    Empty ones where there is too little text for the trainer.
    """
    size = min(how.dictionary, *(sum(map(len, x)) // 4 for x in (good, bad)))
    while size >= 256:
        try:
            made = tuple(zstandard.train_dictionary(size, x).as_bytes() for x in (good, bad))
        except (zstandard.ZstdError, ValueError):
            made = (b"", b"")
        if min(map(len, made)) >= 0.9 * size:
            return made
        size //= 2
    return b"", b""


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Learns from labels whose fold is not 0 and the documents that they mark."""
    marked = (
        labels.select(labels["doc_id"].alias("i"), labels["quality"].alias("q")).where("i is not null and q is not null")
        .where(fold(F.col("i")) != 0).groupBy("i").agg(F.avg("q").alias("q"))
        .select("i", F.when(F.col("q") >= 0.5, 1).otherwise(0).alias("q"), F.xxhash64("i").alias("h"))
        .orderBy("h", "i").limit(how.most_docs)
    )
    # most_docs rows of three numbers: a bounded broadcast.  Low hashes calibrate, the others make the dictionaries
    rows = docs.select(docs["doc_id"].alias("i"), docs["text"].alias("t")).join(F.broadcast(marked), "i").groupBy("i", "h", "q").agg(F.min("t").alias("t"))
    rows = write_shared(rows.withColumn("held", F.pmod("h", F.lit(1000)) < int(1000 * how.calibration)), "labelled")
    size = how.sample_block

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, text, q in zip(b.column("h").to_pylist(), texts_of(b, "t"), b.column("q").to_pylist(), strict=True):
                raw = text.encode()
                blocks = [raw[i : i + size] for i in range(0, len(raw), size)]
                yield pa.RecordBatch.from_pydict({"q": pa.array([q] * len(blocks), pa.int32()), "raw": pa.array(blocks, pa.binary()),
                                                  "h": pa.array([xxhash.xxh64_intdigest(x, seed=n) >> 1 for n, x in enumerate(blocks, h & 0xFFFFFFFF)], pa.int64())})

    blocks = rows.where("not held").select("h", "t", "q").mapInArrow(cut, "q int, raw binary, h long")
    chosen = [sorted((r["h"], bytes(r["raw"])) for r in blocks.where(F.col("q") == q).orderBy("h", "raw").limit(how.most_blocks).collect()) for q in (1, 0)]
    total = rows.agg(F.coalesce(F.sum("q"), F.lit(0)), F.count(F.lit(1))).first()
    flat = Model(b"", b"", math.log((total[0] + 1) / (total[1] - total[0] + 1)), 0.0, how)
    if not all(chosen):
        return flat
    model = Model(*dictionaries(*([raw for _, raw in x] for x in chosen), how), 0.0, 1.0, how)
    if not model.good:
        return flat

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.measure()
        for b in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([of(t) for t in texts_of(b, "t")], pa.float64()), "q": b.column("q")})

    kept = rows.where("held").select("t", "q").mapInArrow(measure, "x double, q int").orderBy("x", "q").collect()
    if len({r["q"] for r in kept}) < 2:
        return flat
    a, b = _logistic(np.array([r["x"] for r in kept]), np.array([r["q"] for r in kept], dtype=float))
    return Model(model.good, model.bad, a, b, how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and score, the probability that the text is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "score": pa.array([of(t) for t in texts_of(b)], pa.float64())})

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text scores ``least`` or more, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            good = [of(t) >= least for t in texts_of(b, text_col)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
