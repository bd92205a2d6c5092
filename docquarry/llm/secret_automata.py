"""Secret scans: base patterns, and probabilistic automata inferred from labelled credentials.

Base spans are the leftmost non-overlapping matches of each kind's pattern whose value is long
enough.  Their values are the labelled credentials: per kind, state merging (the Hoeffding test of
Alergia) turns the prefix tree of a bounded sample into a probabilistic automaton over character
classes.  Every other run of 16 or more token characters, and what base spans leave of a run if that is as long, is a candidate; its
format likelihood under the
best credential automaton, against an automaton of ordinary candidates, decides by a fixed margin whether it becomes
a span of kind ``auto``.  The candidates contain the unlabelled credentials, so those that score like a format are cleared
from what the ordinary automaton learns; and a format counts only for runs that fit it as held-out labelled values do.

Bounds (documented sample): of each kind the distinct values of lowest hash over the whole table, at most ``Training.most`` of them,
are read into the driver and learnt from whole; values of more than ``Training.longest`` characters are no members
of the sample, nor those beyond ``Training.characters`` in all.  All values, however long, are searched and scored whole.  A kind with fewer than ``Training.least`` distinct values gets no automaton; without
any automaton no span is added.

Defined results: null and empty texts have no spans; long texts are searched whole; repeated rows and ids
are scanned each on their own; an empty table gives an empty result; scan() ignores other columns, redact() keeps all columns
whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import pieces, texts_of, write_shared

KINDS = ("assign", "access", "hex", "auto")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Maximal runs that may be credentials; matches of ACCESS and HEX that are long enough lie inside them.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Character classes of the automata and their sizes.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", "=", "-", ".")
SYMBOL = {c: i for i, chars in enumerate(CLASSES) for c in chars}
END = len(CLASSES)


@dataclass
class Training:
    most: int = 3000  # distinct values of a kind, and of ordinary candidates, that are learnt from
    longest: int = 256  # characters of a value that is learnt from: merging a fixed-length format takes their third power
    characters: int = 1_200_000  # of all values of a kind that are learnt from
    least: int = 8
    alpha: float = 0.05  # of the Hoeffding test
    margin: float = 12.0  # nats by which a credential format must be likelier than the ordinary one
    clear: float = -4.0  # nats above which a candidate is cleared from the ordinary pool
    turns: int = 10  # of clearing, at most
    slack: float = 0.25  # nats a character by which a run may fit a format worse than the worst held-out labelled value


def base_spans(text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, int, str]]]:
    """(kind, start, end, value) of the base patterns by start, then kind; and the candidate runs."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text)]
    for at, _, run in runs:
        if len(run) >= 20:
            if "AKIA" in run:
                spans += [("access", at + m.start(), at + m.end(), m[0]) for m in ACCESS.finditer(run) if len(m[0]) >= 20]
            if len(run) >= 24:
                spans += [("hex", at + m.start(), at + m.end(), m[0]) for m in HEX.finditer(run) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))), runs


def free_runs(spans, runs):
    """Candidates apart from base spans: whole runs, and what spans leave of a run where that is long enough."""
    out, k = [], 0
    for start, end, value in runs:  # both by start
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        at = start
        for _, a, b, _ in spans[k:]:
            if a >= end:
                break
            if a - at >= LEAST:
                out.append((at, a, value[at - start : a - start]))
            at = max(at, b)
        if end - at >= LEAST:
            out.append((at, end, value[at - start :]))
    return out


@dataclass
class Automaton:
    """step[state][symbol] = (next state, log probability of one character); symbol END ends a value."""

    step: list[list[tuple[int, float]]] = field(default_factory=list)

    def log_likelihood(self, value: str) -> float:
        state, total = 0, 0.0
        for c in value:
            state, p = self.step[state][SYMBOL.get(c, END - 1)]
            total += p
        return total + self.step[state][END][1]

    def fit(self, value: str) -> float:
        """Log probability a character, whatever the length."""
        state, total = 0, 0.0
        for c in value:
            state, p = self.step[state][SYMBOL.get(c, END - 1)]
            total += p
        return total / max(len(value), 1)


class _Tree:
    """Prefix tree with counts, and the merges on it."""

    def __init__(self, values: list[str], alpha: float):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[int, int]] = [{}]
        self.through: list[dict[int, int]] = [defaultdict(int)]  # counts by symbol, END included
        for v in values:
            at = 0
            for c in v:
                s = SYMBOL.get(c, END - 1)
                self.through[at][s] += 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.through.append(defaultdict(int))
                at = self.next[at][s]
            self.through[at][END] += 1
        self.total = [sum(x.values()) for x in self.through]

    def alike(self, a: int, b: int) -> bool:
        """Hoeffding compatibility of two states and, along common symbols, of what follows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not n or m <= self.bound**2:  # too few to differ, here and in all that follows b
                continue
            far = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.through[a].get(s, 0) / n - self.through[b].get(s, 0) / m) > far for s in self.through[a].keys() | self.through[b].keys()):
                return False
            todo += [(t, self.next[b][s]) for s, t in self.next[a].items() if s in self.next[b] and t != self.next[b][s]]
        return True

    def merge(self, red: int, blue: int) -> None:
        """Folds the subtree of blue into red."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.total[a] += self.total[b]
            for s, n in self.through[b].items():
                self.through[a][s] += n
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t


def infer(values: list[str], alpha: float) -> Automaton:
    """Red-blue state merging in breadth-first order."""
    t, red = _Tree(sorted(values), alpha), [0]
    known = {0}
    while True:
        # Merging changes the blue states below a red one and their counts, so they are looked up each time
        size, x, q, s = max(((t.total[x], -x, q, s) for q in red for s, x in t.next[q].items() if x not in known), default=(0, 0, 0, 0))
        if not size:
            break
        x = -x
        for r in red:
            if t.alike(r, x):
                t.next[q][s] = r
                t.merge(r, x)
                break
        else:
            red.append(x)
            known.add(x)
    index = {q: i for i, q in enumerate(red)}
    steps = []
    for q in red:
        n = t.total[q] + 0.5 * (END + 1)
        row = []
        for s in range(END + 1):
            size = len(CLASSES[s]) if s < END else 1
            row.append((index.get(t.next[q].get(s), 0), math.log((t.through[q].get(s, 0) + 0.5) / n / size)))
        steps.append(row)
    return Automaton(steps)


@dataclass
class Detector:
    formats: dict[str, Automaton]
    floors: dict[str, float]
    ordinary: Automaton
    threshold: float

    def score(self, value: str) -> float:
        """Nats by which the likeliest credential format that fits beats the ordinary one; minus infinity if none fits."""
        fitting = [a.log_likelihood(value) for k, a in self.formats.items() if a.fit(value) >= self.floors[k]]
        return max(fitting) - self.ordinary.log_likelihood(value) if fitting else -math.inf


def floor(values: list[str], how: Training) -> float:
    """The least fit of labelled values under the automaton of the other half, less the slack."""
    halves = sorted(values)[::2], sorted(values)[1::2]
    return min(a.fit(v) for a, rest in zip((infer(h, how.alpha) for h in halves), halves[::-1], strict=True) for v in rest) - how.slack


def train(labelled: dict[str, list[str]], ordinary: list[str], how: Training) -> Detector | None:
    learnt = {k: v for k, v in sorted(labelled.items()) if len(v) >= how.least}
    if not learnt:
        return None
    formats, floors = {k: infer(v, how.alpha) for k, v in learnt.items()}, {k: floor(v, how) for k, v in learnt.items()}
    pool = ordinary
    for _ in range(how.turns):
        d = Detector(formats, floors, infer(pool, how.alpha), how.margin)
        clean = [v for v in ordinary if d.score(v) <= how.clear]
        if clean == pool:
            break
        pool = clean
    return d


_FOUND = "id {kind}, spans array<struct<kind:string,start:int,end:int,value:string>>, runs array<struct<start:int,end:int,value:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
_RUN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def find_base(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base spans and the candidates apart from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 8 << 20):
                spans, runs = [], []
                for text in texts_of(b):
                    found, cand = base_spans(text)
                    spans.append([dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in found])
                    runs.append([dict(zip(("start", "end", "value"), r, strict=True)) for r in free_runs(found, cand)])
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "spans": pa.array(spans, _SPAN), "runs": pa.array(runs, _RUN)})

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return src.mapInArrow(run, _FOUND.format(kind=df.schema[id_col].dataType.simpleString()))


def learn(found: DataFrame, how: Training) -> Detector | None:
    """Trains on the distinct values of lowest hash of each kind: each task sends its lowest, the driver gets ``how.most`` at the most."""

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[str, int]] = {k: {} for k in (*KINDS[:3], "ordinary")}

        def put(kind: str, value: str) -> None:
            if len(value) <= how.longest and value not in best[kind]:
                best[kind][value] = xxhash.xxh64_intdigest(value) >> 1
                if len(best[kind]) > 4 * how.most:
                    best[kind] = dict(sorted(best[kind].items(), key=lambda e: (e[1], e[0]))[: how.most])

        for b in batches:
            for spans, runs in zip(b.column("spans").to_pylist(), b.column("runs").to_pylist(), strict=True):
                for x in spans:
                    put(x["kind"], x["value"])
                for x in runs:
                    put("ordinary", x["value"])
        rows = [(k, h, v) for k, values in best.items() for v, h in sorted(values.items(), key=lambda e: (e[1], e[0]))[: how.most]]
        kind, h, value = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.string()), "h": pa.array(h, pa.int64()), "value": pa.array(value, pa.string())})

    every = found.select("spans", "runs").mapInArrow(lowest, "kind string, h long, value string").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    by: dict[str, list[str]] = defaultdict(list)
    for r in every.withColumn("place", place).where(F.col("place") <= how.most).orderBy("kind", "place").collect():
        by[r["kind"]].append(r["value"])
    for kind, values in by.items():
        sizes = list(accumulate(map(len, values)))
        by[kind] = values[: bisect_right(sizes, how.characters)]
    return train({k: v for k, v in by.items() if k != "ordinary"}, by["ordinary"], how)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Training | None = None) -> DataFrame:
    """Per row: the id and spans array<struct<kind,start,end,score>> by start, then kind; base spans score null."""
    how = how or Training()
    found = write_shared(find_base(df, id_col, text_col), "secrets")
    detector = learn(found, how)
    kind = df.schema[id_col].dataType.simpleString()
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for b in batches:
            rows = []
            for spans, runs in zip(b.column("spans").to_pylist(), b.column("runs").to_pylist(), strict=True):
                row = [{"kind": s["kind"], "start": s["start"], "end": s["end"], "score": None} for s in spans]
                for r in runs if detector else ():
                    if (value := r["value"]) not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen[value] = detector.score(value)
                    if seen[value] > detector.threshold:
                        row.append({"kind": "auto", "start": r["start"], "end": r["end"], "score": seen[value]})
                rows.append(sorted(row, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "spans": pa.array(rows, out)})

    return found.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>").withColumnRenamed("id", id_col)


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The scan as counts, the base spans' digest and all spans as text."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, said), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        id_col, *(count(k) for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "auto")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text", how: Training | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; in the text every span, overlapping ones together, is replaced by the mark.

    A null text stays null.  Learning is as in scan().
    """
    how = how or Training()
    found = write_shared(find_base(df.select(F.lit(0).alias("k"), F.col(text_col).alias("t")), "k", "t"), "secrets")
    detector = learn(found, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            for i, text in enumerate(texts):
                if not text:
                    continue
                spans, runs = base_spans(text)
                cut = [(s[1], s[2]) for s in spans]
                cut += [(r[0], r[1]) for r in free_runs(spans, runs) if detector and detector.score(r[2]) > detector.threshold]
                if cut:
                    out, pos = [], 0
                    for start, stop in sorted(cut):
                        if start >= pos:
                            out += [text[pos:start], mark]
                        pos = max(pos, stop)
                    texts[i] = "".join([*out, text[pos:]])
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)

