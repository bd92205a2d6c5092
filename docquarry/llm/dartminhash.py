"""MinHash near-duplicate detection with DartMinHash signatures.

A text is a weighted set of five-word shingles.  The plane over an element has dyadic regions of
weight and of rank; each region holds a Poisson number of darts, drawn from hashes of (element, region),
and every dart has a coordinate, a rank and a weight position.  Of the darts below an element's
weight each coordinate keeps the earliest by rank: two texts agree in a coordinate with probability equal to
their weighted Jaccard similarity.  Only about K (ln K + 6) darts a text are thrown, as ranks
beyond a threshold set by its total weight are not looked at; a text with an empty coordinate
is thrown again with twice the threshold.

Joining: texts with the same weighted set are one row first.  Bands of the signature give buckets; in
a bucket every member is compared with the bucket's least, never all with all.  Links are verified
by the weighted Jaccard similarity of the sets (of 48-bit shingle hashes: two texts of 10,000 shingles have a false common one with
probability 4e-7).  Next, members of a bucket that are still in different classes are
compared with the least and the highest class's first member, until a round finds no new link.  What
is still in one bucket but different classes is compared last, whatever the bucket's size: those outside its largest class, in blocks,
with all members, in blocks, each pair in the first bucket that it shares.  So no link is lost for want of a common centre, no task gets more
than two blocks, and only links come out.  The price is quadratic in the members outside the largest class: a bucket of many
texts that are alike, but below 0.8 all of them, is compared throughout.  Two texts at 0.8 share a bucket with probability
1 - 3e-6, about ten buckets on average; one byte a coordinate keeps most dissimilar pairs from the exact comparison, and loses 2e-10 of those at 0.8.

Words are runs of letters and digits in lower case.  With ``weight="set"``, as in the query, each
distinct shingle has weight 1, so similarity is plain Jaccard; with "count", its number of occurrences.

Defined results: a text without words (null, empty, only marks) is a class of its own; a text of 1 to 4 words is one
shingle; very long texts are taken whole; equal texts and repeated rows share a class; a class is named by its least id (null only if
all its ids are null); an empty table gives an empty result; extra columns are ignored by classes() and kept by representatives(),
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import mix64, pieces, write_shared
from docquarry.llm.components import components, extend
from docquarry.llm.words import distinct_by_text, text_shingles, words_of

#: Rank of the first dyadic region, and bits of a packed rank.
FIRST, RANK_BITS = 0.25, 44


@dataclass(frozen=True)
class Plan:
    bands: int = 32
    rows: int = 5
    least: float = 0.8
    weight: str = "set"
    rounds: int = 3  # at most, of comparing with classes' first members before pairs

    @property
    def k(self) -> int:
        return self.bands * self.rows


@lru_cache(maxsize=256)
def _poisson(area: float) -> np.ndarray:
    """Cumulative Poisson probabilities."""
    p, out, n = math.exp(-area), [], 0
    total = 0.0
    while total < 1 - 1e-15 and n < 10 * area + 60:
        total += p
        out.append(total)
        n += 1
        p *= area / n
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(elem: np.ndarray, weight: np.ndarray, doc: np.ndarray, reach: np.ndarray, k: int, sig: np.ndarray) -> None:
    """Lowers sig[doc * k + coordinate] to the earliest dart of every element; reach is each text's rank threshold."""
    if not len(elem):
        return
    golden = np.uint64(0x9E3779B97F4A7C15)
    top = float(reach.max(initial=0))
    rho, low = 0, 0.0
    while low < top:
        high = FIRST * 2.0**rho
        nu, bottom = 0, 0.0
        while True:
            above = 2.0**nu
            take = np.flatnonzero((reach[doc] > low) & (weight > bottom))
            if not len(take):
                break
            region = mix64(elem[take] ^ mix64(np.array([(nu << 32) | (rho + 1)], dtype=np.uint64)))
            n = np.searchsorted(_poisson((high - low) * (above - bottom)), _unit(region), side="right")
            which = np.repeat(np.arange(len(take)), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            with np.errstate(over="ignore"):
                dart = mix64(region[which] + (j + 1).astype(np.uint64) * golden)
            at = take[which]
            if nu or weight.min() < 1:
                inside = bottom + _unit(mix64(dart ^ golden)) * (above - bottom) < weight[at]
                dart, at = dart[inside], at[inside]
            rank = low + _unit(dart) * (high - low)
            packed = (np.minimum(rank * 2.0**24, 2.0**RANK_BITS - 1).astype(np.uint64) << np.uint64(64 - RANK_BITS)) | (mix64(dart) >> np.uint64(RANK_BITS))
            coordinate = ((mix64(dart + golden) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(sig, doc[at] * k + coordinate, packed)
            bottom, nu = above, nu + 1
        low, rho = high, rho + 1


def signatures(elem: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """docs x k signatures of weighted sets; a text without elements has the highest value throughout."""
    empty = np.iinfo(np.uint64).max
    sig = np.full(docs * k, empty, dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=docs)
    reach = np.where(total > 0, k * (math.log(k) + 6) / np.maximum(total, 1e-300), 0.0)
    _throw(elem, weight, doc, reach, k, sig)
    for _ in range(20):
        missing = np.flatnonzero((sig.reshape(docs, k) == empty).any(axis=1) & (total > 0))
        if not len(missing):
            break
        again = np.zeros(docs)
        again[missing] = reach[missing] = 2 * reach[missing]
        own = again[doc] > 0
        _throw(elem[own], weight[own], doc[own], again, k, sig)
    return sig.reshape(docs, k)


def band_hashes(sig: np.ndarray, plan: Plan) -> np.ndarray:
    """One 64-bit hash a band."""
    h = np.broadcast_to(mix64(np.arange(1, plan.bands + 1, dtype=np.uint64)), (len(sig), plan.bands)).copy()
    for r in range(plan.rows):
        h = mix64(h ^ sig[:, r :: plan.rows][:, : plan.bands])
    return h


#: Bytes of a shingle's hash in a packed set.
WIDTH = 6


def pack(h: np.ndarray, n: np.ndarray) -> bytes:
    """A weighted set with sorted 64-bit hashes as bytes: upper 48 bits of each hash, counts where any is above 1."""
    short = h >> np.uint64(64 - 8 * WIDTH)
    planes = np.diff(short, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :WIDTH].T.tobytes()
    more = n.astype(np.uint32).tobytes() if (n > 1).any() else b""
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes + more)


def unpack(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=(WIDTH + 4) * size + 64), dtype=np.uint8)
    delta = np.zeros((size, 8), dtype=np.uint8)
    delta[:, :WIDTH] = data[: WIDTH * size].reshape(WIDTH, size).T
    n = data[WIDTH * size :].view(np.uint32) if len(data) > WIDTH * size else np.ones(size, dtype=np.uint32)
    return np.cumsum(delta.view(np.uint64).ravel(), dtype=np.uint64), n


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two packed sets."""
    (x, n), (y, m) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    shared = float(np.minimum(n[both], m[at[both]]).sum())
    return shared / (float(n.sum()) + float(m.sum()) - shared)


def _digest(h: np.ndarray, n: np.ndarray, d: np.ndarray, docs: int) -> np.ndarray:
    """One 64-bit value of each text's weighted set."""
    key = np.zeros(docs, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(key, d, mix64(h ^ mix64(n.astype(np.uint64))))
    return mix64(key).view(np.int64)


#: Texts that are thrown at a time: a short one takes as many darts as a long one.
TEXTS = 128


def sketch(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, uid, digest of the weighted set, size (distinct shingles), bands, a byte a coordinate, packed set.  Written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (p.slice(i, TEXTS) for p in pieces(whole, "text", 1 << 19) for i in range(0, p.num_rows, TEXTS)):
                w = words_of(b.column("text"))
                h, d, n = distinct_by_text(*text_shingles(w))
                if plan.weight == "set":
                    n = np.ones_like(n)
                sig = signatures(h, n.astype(float), d, w.docs, plan.k)
                bands, short = band_hashes(sig, plan), mix64(sig).astype(np.uint8)
                key = _digest(h, n, d, w.docs)
                end = np.searchsorted(d, np.arange(w.docs + 1))
                raw = [pack(h[end[i] : end[i + 1]], n[end[i] : end[i + 1]]) for i in range(w.docs)]
                yield pa.RecordBatch.from_pydict({
                    "id": b.column("id"), "digest": pa.array(key), "size": pa.array(np.diff(end), pa.int32()),
                    "bands": pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), "short": pa.array([x.tobytes() for x in short], pa.binary()), "raw": pa.array(raw, pa.binary())})

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    made = src.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, digest long, size int, bands array<long>, short binary, raw binary")
    return write_shared(made.withColumn("uid", F.monotonically_increasing_id()), "sketch")


#: Members that one group compares with one centre; most edges (three numbers each) whose ends are broadcast.
GROUP, SMALL = 256, 250_000


def verify(edges: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """The edges (a, b), ids of rows of the table, whose exact similarity is ``least`` or more, as (a, b, similarity).

    A centre ``a`` with many members is split into groups, each with a copy of its set.
    """
    groups = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    member = edges.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("uid"))
    centre = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("uid"))
    wanted = member.unionAll(centre)
    if edges.count() <= SMALL:  # then these rows, at most twice as many, go to the sets; else both are shuffled
        wanted = F.broadcast(wanted)
    rows = table.select("uid", "size", "raw").join(wanted, "uid")

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:  # GROUP sets about, and the centre's
        a = key[0].as_py()
        sets = {u: (s, r) for u, s, r in zip(*(t.column(c).to_pylist() for c in ("uid", "size", "raw")), strict=True)}
        size, raw = sets.pop(a)
        centre = unpack(raw, size)
        out = [(u, jaccard(centre, unpack(r, s))) for u, (s, r) in sets.items()]
        good = [(u, j) for u, j in out if j >= least - 1e-12]
        return pa.table({"a": pa.array([a] * len(good), pa.int64()), "b": pa.array([u for u, _ in good], pa.int64()), "similarity": pa.array([j for _, j in good], pa.float64())})

    return rows.groupBy("a", "part").applyInArrow(run, "a long, b long, similarity double")


def link(table: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digest -> uid, least id), verified links between such uids, and (node, root) of their components."""
    rep = write_shared(table.where("size > 0").groupBy("digest").agg(F.min("uid").alias("uid"), F.min("id").alias("first")), "representatives")
    band = table.where("size > 0").select("digest", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("band", "low")
    bucket = band.join(shared, "band").distinct()
    uid = lambda name: rep.select(F.col("digest").alias(name), F.col("uid").alias(f"{name}_uid"))
    bucket = write_shared(bucket.join(uid("digest"), "digest").select("band", "low", F.col("digest_uid").alias("uid")), "buckets")
    star = (
        bucket.join(uid("low"), "low").where("low_uid <> uid").groupBy(F.col("low_uid").alias("a"), F.col("uid").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    star = write_shared(star, "stars")
    best = write_shared(star.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "best")
    tried = best
    links = write_shared(verify(best, table, plan.least), "links")
    roots = components(links.select("a", "b"))
    for turn in range(plan.rounds):
        side = lambda e, c, roots=roots: e.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
        if turn == 0:
            todo = side(side(star.select("a", "b"), "a"), "b").where("a_root <> b_root").select("a", "b")
        else:
            here = side(bucket.select("band", "uid"), "uid")
            ends = here.groupBy("band").agg(F.min(F.struct("uid_root", "uid")).alias("x"), F.max(F.struct("uid_root", "uid")).alias("y")).where("x.uid_root <> y.uid_root")
            near = here.join(ends, "band").select(F.explode(F.array("x", "y")).alias("c"), "uid", "uid_root").where("c.uid_root <> uid_root")
            todo = near.select(F.least("c.uid", "uid").alias("a"), F.greatest("c.uid", "uid").alias("b")).distinct()
        past = tried.unionAll(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        todo = write_shared(todo.join(past, ["a", "b"], "left_anti"), "todo")
        if todo.isEmpty():
            break
        more = write_shared(verify(todo, table, plan.least), "links")
        tried, links, found = tried.unionAll(todo), links.unionAll(more), not more.isEmpty()
        if found:
            roots = extend(roots, more.select("a", "b"))
        elif turn:
            break
    more = write_shared(remaining(bucket, roots, table, plan), "links")
    return rep, links.unionAll(more), roots if more.isEmpty() else extend(roots, more.select("a", "b"))


#: Members outside the largest class, and members, that one task of remaining() compares.
OUTSIDE, MEMBERS = 256, 1024


def remaining(bucket: DataFrame, roots: DataFrame, table: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b, similarity) between texts of one bucket that are in different classes.

    Every member outside the bucket's largest class meets every member: blocks of OUTSIDE against blocks of MEMBERS, a
    task each, so that sets are copied but no pair is a row.  A pair is compared in the first band that it shares, if its sizes allow the
    similarity, and not once its classes have met in the task.
    """
    here = bucket.select("band", "uid").join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    by_class = here.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_class.groupBy("band").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    blocks = lambda n, each: F.ceil(n / each).cast("int")
    mixed = mixed.select("band", F.col("major.root").alias("major"), blocks(F.col("all") - F.col("major.n"), OUTSIDE).alias("rows"), blocks(F.col("all"), MEMBERS).alias("columns"))
    near = here.join(mixed, "band").withColumn("h", F.xxhash64("uid"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    asks = near.where("root <> major").select("band", "uid", "root", F.lit(True).alias("asks"), own("rows").alias("i"), every("columns").alias("j"), "major")
    met = near.select("band", "uid", "root", F.lit(False).alias("asks"), own("columns").alias("j"), every("rows").alias("i"), "major").select(asks.columns)
    rows = write_shared(asks.unionAll(met), "mixed")
    if rows.count() <= SMALL:
        rows = F.broadcast(rows)
    rows = table.select("uid", "size", "bands", "short", "raw").join(rows, "uid")
    floor = plan.k * plan.least - 6.3 * math.sqrt(plan.k * plan.least * (1 - plan.least))  # of equal coordinates

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        band, t = key[0].as_py(), t.sort_by("uid")
        uid, root, size, asks = (t.column(c).to_numpy() for c in ("uid", "root", "size", "asks"))
        bands, short = np.array(t.column("bands").to_pylist(), dtype=np.int64).reshape(len(uid), -1), np.frombuffer(b"".join(t.column("short").to_pylist()), dtype=np.uint8).reshape(len(uid), -1)
        raw, major = t.column("raw"), t.column("major")[0].as_py()
        up, sets, out = {r: r for r in root.tolist()}, {}, []

        def top(r: int) -> int:
            while up[r] != r:
                r = up[r]
            return r

        def of(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in sets:
                sets[i] = unpack(raw[i].as_py(), int(size[i]))
            return sets[i]

        member = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks).tolist():
            other = member[(root[member] != root[i]) & ((root[member] == major) | (uid[member] > uid[i]))]
            other = other[np.minimum(size[other], size[i]) >= plan.least * np.maximum(size[other], size[i]) - 1e-9]
            other = other[(short[other] == short[i]).sum(axis=1) >= floor]
            other = other[bands[i][(bands[other] == bands[i]).argmax(axis=1)] == band]
            for k in other.tolist():
                x, y = top(int(root[i])), top(int(root[k]))
                if x != y and (j := jaccard(of(i), of(k))) >= plan.least - 1e-12:
                    up[y] = x
                    out.append((int(uid[i]), int(uid[k]), j))
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(c, pa.float64())})

    return rows.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long, similarity double")


def labelled(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest, class_id and root, which tells classes apart where ids do not; null without words."""
    table = sketch(docs, plan, id_col, text_col)
    rep, _, roots = link(table, plan)
    named = rep.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").select("digest", "first", F.coalesce("root", "uid").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    name = named.join(least, "root").select("digest", "class_id", "root")
    with_words = table.where("size > 0").select("id", "digest").join(name, "digest").select("id", "digest", "class_id", "root")
    return with_words.unionAll(table.where("size = 0").select("id", "digest", F.col("id").alias("class_id"), F.lit(None).cast("long").alias("root")))


def classes(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id and class_id, the least id of its near-duplicate class."""
    return labelled(docs, plan, id_col, text_col).select(F.col("id").alias(id_col), "class_id")


def representatives(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, of which one stays for each class: that of its least id.

    Rows without words all stay.  If an id is repeated or null, one of its rows stays in every class that it names.
    """
    said = write_shared(labelled(docs, plan, id_col, text_col), "classes")
    heads = said.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull())).alias("head"))
    keep = heads.where("head").select(F.col("id").alias("keep_id"), F.col("rows").alias("keep_rows"))
    kept = docs.join(keep, docs[id_col] == keep["keep_id"])  # rows without an id are looked at by digest only
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.where("keep_rows = 1").select(*columns)
    # Repeated and null ids: for each class that the id names, the first of its rows there; rows without words all
    many = kept.where("keep_rows > 1").select(*columns, "keep_id").unionAll(docs.where(docs[id_col].isNull()).select(*columns, docs[id_col].alias("keep_id")))
    more = write_shared(_digests(many, plan, text_col).withColumn("keep_uid", F.monotonically_increasing_id()), "repeated")
    named = said.where(F.col("root").isNotNull() & F.col("id").eqNullSafe(F.col("class_id"))).select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "root").distinct()
    own = more.where("keep_size > 0").groupBy("keep_id", "keep_digest").agg(F.min("keep_uid").alias("keep_uid")).join(
        named, F.col("keep_id").eqNullSafe(F.col("own_id")) & (F.col("keep_digest") == F.col("own_digest")))
    first = own.groupBy("root").agg(F.min("keep_uid").alias("keep_uid")).select("keep_uid")
    return once.unionAll(more.where("keep_size = 0").select(*columns)).unionAll(more.join(first, "keep_uid").select(*columns))


def _digests(docs: DataFrame, plan: Plan, text_col: str) -> DataFrame:
    """The rows with keep_digest and keep_size, as sketch() has them."""
    from pyspark.sql.types import IntegerType, LongType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, text_col, 1 << 20):
                w = words_of(b.column(text_col))
                h, d, n = distinct_by_text(*text_shingles(w))
                key = _digest(h, np.ones_like(n) if plan.weight == "set" else n, d, w.docs)
                size = np.bincount(d, minlength=w.docs)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key), pa.array(size, pa.int32())], [*b.schema.names, "keep_digest", "keep_size"])

    schema = StructType([*docs.schema.fields]).add("keep_digest", LongType()).add("keep_size", IntegerType())
    return docs.mapInArrow(run, schema)
