"""Near-duplicates, decontamination, substrings, neighbours, URL templates and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import blobs, dartminhash, deleted_interpolation, gear_chunks, kmeans_tree, lsh_ensemble, lyndon_dedup, url_templates
from docquarry.llm.components import components, extend
from docquarry.llm.registry import ORACLES, QUERIES, RULES
from tests.llm.conftest import prose

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 - 1e-12:
                up[top(a)] = top(b)
    members = {}
    for x in range(len(rows)):
        members.setdefault(top(x), []).append(rows[x][0])
    name = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    return [(rows[x][0], name[top(x)]) for x in range(len(rows))]


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    want = Counter((i, i if not shingles(t) else c) for (i, t), (_, c) in zip(rows, brute_classes(rows), strict=True))
    assert Counter(map(tuple, dartminhash.classes(odd_docs).collect())) == want
    assert dartminhash.classes(no_docs).count() == 0
    kept = dartminhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    heads = Counter(r.doc_id for r in kept.collect())
    assert heads[105] == 0 and heads[0] == 1 and heads[101] == heads[100] == 1 and heads[108] == 0 and heads[107] == 1


def test_near_duplicates_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op3_dartminhash"](spark, sf).collect())) == sorted(brute_classes(rows))


@pytest.mark.parametrize("weight", ["set", "count"])
def test_one_row_of_each_class_stays_where_ids_are_null_or_equal(spark, weight):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(24)]
    rows = [(None, t) for t in texts[:12]] + [(7, t) for t in texts[12:20]] + [(i, t) for i, t in enumerate(texts[20:])]
    rows += [(None, texts[0]), (7, texts[12]), (7, texts[1] + " more"), (9, texts[2]), (9, texts[13]), (None, texts[20]), (None, None), (None, ""), (7, "")]
    kept = dartminhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), dartminhash.Plan(weight=weight))
    want = [(None, t) for t in (texts[0], *texts[3:12])] + [(7, texts[1] + " more"), (9, texts[2])] + [(7, t) for t in texts[12:20]]
    want += [(i, t) for i, t in enumerate(texts[20:])] + [(None, None), (None, ""), (7, "")]
    assert Counter(map(tuple, kept.collect())) == Counter(want)


def test_dart_signatures_estimate_weighted_jaccard():
    rng, k = np.random.default_rng(1), 4000
    elem = rng.integers(0, 2**63, 60).astype(np.uint64)
    for w in (1.0, 3.0):
        a, b = (rng.integers(1, 4, 60) * w for _ in range(2))
        b[:20] = a[:20]
        sig = dartminhash.signatures(np.concatenate([elem, elem]), np.concatenate([a, b]), np.repeat([0, 1], 60), 2, k)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k)
    assert (sig != np.iinfo(np.uint64).max).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    up = {x: x for e in edges for x in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    def put(es):
        for a, b in es:
            a, b = sorted((top(a), top(b)))
            up[b] = a

    put(edges[:60])
    half = components(spark.createDataFrame(edges[:60], "a long, b long"))
    assert {r.node: r.root for r in half.collect()} == {x: top(x) for e in edges[:60] if e[0] != e[1] for x in e}
    put(edges[60:])
    full = {r.node: r.root for r in extend(half, spark.createDataFrame(edges[60:], "a long, b long")).collect()}
    assert full == {x: top(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_leaks(docs, items, least=0.8):
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, u in items:
            v = WORD.findall((u or "").lower())
            k = min(5, len(v))
            if v:
                own = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
                if len(own & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) >= least * len(own) - 1e-9:
                    out.add((d, i))
    return out


def test_decontamination(spark, odd_docs, no_docs):
    rng = random.Random(9)
    items = [(i, prose(rng, 3 + 7 * i)) for i in range(12)] + [(50, None), (51, ""), (52, "One"), (53, "of the"), (54, prose(rng, 3000)), (55, items_text := prose(rng, 40))]
    texts = [(500 + i, f"{prose(rng, 300)} {t} {prose(rng, 2000)}") for i, t in items if t] + [(600, items_text.upper().replace(" ", " -- ")), (601, f"{items_text[:130]} x {prose(rng, 5000)} y {items_text[100:]}")]
    texts.append(texts[0])
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = lsh_ensemble.search(docs, table)
    rows = [tuple(r) for r in docs.collect()]
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(rows, items)
    kept = {r.doc_id for r in lsh_ensemble.clean(docs, table).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in brute_leaks(rows, items)}
    assert lsh_ensemble.search(no_docs, table).count() == 0 and lsh_ensemble.search(docs, table.limit(0)).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 20)) for i in range(30)]
    docs = spark.createDataFrame([(i, f"{prose(rng, 50)} {t}") for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(lsh_ensemble, "BLOCK", 100)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert len(lsh_ensemble.blocks(table)) > 3
    assert {(r.doc_id, r.item_id) for r in lsh_ensemble.search(docs, table).collect()} == brute_leaks(docs.collect(), items)


def test_no_tiny_item_is_missed_and_long_items_are_quick():
    """80,000 items of one shingle in one text each; the least of a bin over windows against brute force."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30_000)]
    items = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(80_000)]
    w = lsh_ensemble.words_of(pa.array(items))
    h, d, _ = lsh_ensemble.distinct_by_text(*lsh_ensemble.text_shingles(w))
    index = lsh_ensemble.Index.of([{"id": int(i), "k": 5, "shingles": [int(x)]} for i, x in zip(d, h.view(np.int64), strict=True)])
    for at in range(0, len(items), 8000):
        texts = [f"{prose(rng, 6)} {t} {prose(rng, 6)}" for t in items[at : at + 8000]]
        text, item, _ = index.search(pa.array(texts), 0.8)
        assert {(int(a), index.ids[b]) for a, b in zip(text, item, strict=True)} >= {(i, at + i) for i in range(len(texts))}
    values, doc = np.random.default_rng(1).integers(0, 2**63, 900).astype(np.uint64), np.repeat([0, 1, 2], 300)
    low = lsh_ensemble._Lowest(values, doc, np.array([0, 2]), np.array([0, 300, 600, 900]))
    at = np.concatenate([np.arange(300), np.arange(600, 900)])
    begin, end = np.maximum(at - 40, at // 300 * 300), np.minimum(at + 60, at // 300 * 300 + 300)
    want = [min(x for x in values[b:e] if x % np.uint64(64) == values[i] % np.uint64(64)) for i, b, e in zip(at, begin, end, strict=True)]
    assert low(at, begin, end).tolist() == want


def brute_covered(texts, k):
    seen = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                gone[i : i + k] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("plan", [lyndon_dedup.Plan(), lyndon_dedup.Plan(gather=1), lyndon_dedup.Plan(length=60, seed=20, passage=30, words=6, gather=3), lyndon_dedup.Plan(passage=0)])
def test_suffix_dedup(spark, odd_docs, no_docs, plan):
    rng = random.Random(6)
    passage = prose(rng, 120)
    more = [(700 + i, f"{prose(rng, rng.randrange(5, 90))} {passage[: rng.randrange(380, 420)]} {prose(rng, 20)}") for i in range(6)]
    more += [(720 + i, passage[:300] + f" changed{i % 2} " + passage[300:]) for i in range(3)] + [(730, "ab" * 450), (731, "é" * 260)]
    short = prose(rng, 53)  # over 50 words, below 400 bytes
    more += [(740 + i, f"{prose(rng, 30)} {short} {prose(rng, 30)}") for i in range(2)]
    docs = odd_docs.select("doc_id", "text").where("doc_id is null or doc_id not in (107, 108)").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(i, (t or "").encode()) for i, t in docs.collect()]
    want = Counter()
    near = brute_covered([t for _, t in rows], plan.passage) if plan.passage else [np.zeros(len(t), bool) for _, t in rows]
    for (i, t), gone, also in zip(rows, brute_covered([t for _, t in rows], plan.length), near, strict=True):
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], also.astype(int), [0])))).reshape(-1, 2)
        passage = sum(int(b - a) for a, b in edge if len(t[a:b].split()) > plan.words)
        want[i, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), passage] += 1
    got = lyndon_dedup.deduplicate(docs, plan).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage) for r in got) == want
    assert len(short) < 400 and (not plan.passage or all(sum(w[5] for w in want if w[0] == i) > 250 for i in (740, 741)))
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)
    assert lyndon_dedup.deduplicate(no_docs, plan).count() == 0


@pytest.mark.parametrize("length", [40, 41, 56])
def test_cores_grow_to_the_window(length):
    """Every window of a segment is in one half, down to windows alone; equal windows have equal cores on the way."""
    rng = random.Random(3)
    body = "".join(rng.choice("ab") for _ in range(70)).encode()
    todo = [(body, 0, 30, 46)]
    for _ in range(10):
        todo = [(body[f : f + n - 1 + length], s + f, a - f, b - f) for body, s, c, d in todo for f, n, a, b in lyndon_dedup.halves(body, c, d, length)]
        assert sorted(s + i for x, s, _, _ in todo for i in range(len(x) - length + 1)) == [w for w in range(70 - length + 1) if w <= 30 and w + length >= 46]
        assert all(0 <= a and b <= len(x) and a <= b - 16 for x, _, a, b in todo)
    assert all((a, b) == (0, length) and len(x) == length for x, _, a, b in todo)


def test_chunks_find_repeats_and_leave_the_rest(spark, odd_docs, no_docs):
    rng = random.Random(8)
    passage = prose(rng, 55)
    rows = [(i, f"{prose(rng, rng.randrange(20, 200))} {passage} {prose(rng, rng.randrange(20, 200))}") for i in range(12)] + [(100 + i, prose(rng, 150)) for i in range(30)] + [(200, "the " * 200), (201, "x" + "the " * 200)]
    got = {r.doc_id: r for r in gear_chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert not got[0].removed and got[0].n_repeated > 100
    assert all(len(got[i].removed) == 1 for i in range(1, 12)) and all(not got[100 + i].removed for i in range(30)) and got[201].removed
    text = dict(rows)
    for i, r in got.items():
        raw, pos, kept = text[i].encode(), 0, b""
        for s in r.removed:
            kept, pos = kept + raw[pos : s.start], s.end
        assert r.kept == (kept + raw[pos:]).decode() and r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()
    odd = gear_chunks.digest(gear_chunks.repeats(odd_docs)).collect()
    assert len(odd) == odd_docs.count() and sorted(r.n_removed > 0 for r in odd if r.doc_id == 105) == [True, True]
    assert gear_chunks.repeats(no_docs).count() == 0


def test_cuts_resist_shifts():
    rng = random.Random(2)
    text = prose(rng, 400).encode()
    a, b = gear_chunks.chunk_ends([text, b"inserted " + text])
    assert len({e + 9 for e in a.tolist()} & set(b.tolist())) >= len(a) - 3
    h = gear_chunks.gear_hash(np.frombuffer(text, dtype=np.uint8))
    assert h[100] == sum(int(gear_chunks.GEAR[text[100 - k]]) << k for k in range(32)) % 2**32


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:1500] = x[500]  # a third are one vector
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [1.0, None] * 8, 0), (9005, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")
    got = {}
    for r in kmeans_tree.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits, v = 0, x.astype(float)
    for q in range(0, 3000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(3000), d))[:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
        assert all(s == d[i] for _, s, i in mine)
        hits += len({i for *_, i in mine} & set(true.tolist()))
    assert hits / 300 >= 0.9 and len(got) == 30
    # A repeated query id with an invalid vector, vectors of other lengths, a cell with more visitors than one group holds
    more = df.union(spark.createDataFrame([(500, [0.0] * 16, 0), (8000, [1.0, 2.0], 0), (8001, [1.0, 4.0], 0), (8002, [1.0], 0), (8100, [3.0], 0), (8003, [], 0)], df.schema))
    again = {}
    for r in kmeans_tree.search(more, F.col("vec_id") % 100 == 0, kmeans_tree.Plan(group=3)).collect():
        again.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert {k: sorted(x) for k, x in again.items() if k < 8000} == {k: sorted(x) for k, x in got.items()}
    assert again[8000] == [(1, 2.0, 8001)] and sorted(again[8100]) == [(1, 2.0, 8002), (2, 2.0, 9005)] and len(again) == 32
    few = df.where("vec_id < 4")
    assert kmeans_tree.search(few, F.col("vec_id") == 0).count() == 3
    assert kmeans_tree.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_urls(spark):
    rows = [(i, f"https://a.example.com/blog/{i}.html") for i in range(40)] + [(100 + i, f"http://Shop.Example.COM/de/{i}?q=1") for i in range(40)] + [(200 + i, f"http://x.example.net/de/{i}") for i in range(30)]
    rows += [(300, None), (301, "no scheme"), (302, "http://example.org"), (303, "http://example.org/es/1#x"), (304, "http://sub.example.org/en/12"), (305, "http://example.org/en/2"), (306, "x://EXAMPLE.org?/es/"), (307, "http://notcom/fr/"), (308, "http://com/fr/a"), (100, "http://shop.example.com/de/0")]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, n int")
    got = {(r.page_id): r for r in url_templates.judge(df, url_templates.rules_of(RULES)).collect()}
    want = {300: ("", "", None), 301: ("", "", None), 302: ("example.org", "", None), 303: ("example.org", "/es/1", "example.org/es/"), 304: ("sub.example.org", "/en/12", "example.org/en/1"),
            305: ("example.org", "/en/2", "org/"), 306: ("example.org", "", None), 307: ("notcom", "/fr/", None), 308: ("com", "/fr/a", "com/fr/"), 110: ("shop.example.com", "/de/10", "com/de/")}
    assert {i: (got[i].host, got[i].path, got[i].rule) for i in want} == want
    assert got[110].verdict == "block" == got[303].verdict and got[305].verdict == "allow" == got[308].verdict
    assert all(got[200 + i].verdict == "block" for i in range(30)) and all(got[i].verdict == "allow" for i in range(40))  # learnt from /de/ elsewhere; unlabelled
    assert url_templates.judge(df, []).where("rule is not null or verdict <> 'allow'").count() == 0
    assert url_templates.judge(df.limit(0), url_templates.rules_of(RULES)).count() == 0 and len(got) == len(rows) - 1


def test_url_sections_of_large_and_small_hosts(spark):
    """Sections of a host with many of them are judged each on their own; small hosts share what is known of a section."""
    names = [a + b for a in "bcdfghjklmnpqrst" for b in "aeiouvwxyz"]
    urls = [f"http://big.example.com/{s}/{i}" for s in [*names, "de", "es"] for i in range(20)] + [f"http://example.org/es/{i}" for i in range(20)]
    urls += [f"http://small.example.net/{s}/{i}" for s in ("es", "de", "ba") for i in range(2)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r.verdict for r in url_templates.judge(df, url_templates.rules_of(RULES)).collect()}
    assert got == {u: "block" if re.search("/(de|es)/", u) else "allow" for u in urls}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf).cache()
        assert out.columns == columns and out.count() <= at.count(), name
        at = out
    rows = [tuple(r) for r in at.select("doc_id", "text").collect()]
    assert len({c for _, c in brute_classes(rows)}) == len(rows)
    assert not brute_leaks(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()])
    final = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in final.collect()} == {i for i, _ in rows} and at.where("n_chars <> length(text)").count() == 0


def test_pipeline_stages_on_odd_rows(spark, sf, odd_docs):
    """Null, empty and repeated rows and a column with a clashing name pass every stage; an empty table too."""
    docs = odd_docs.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("score"))
    for table in (docs, docs.where("false")):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, sf).cache()
            assert out.count() <= at.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == at.columns and out.schema.simpleString() == at.schema.simpleString(), name
                at = out
        left = {r.doc_id for r in at.collect()}
        assert not left if table is not docs else {100, 101} <= left


def test_clean_documents_stay(spark, sf):
    """Fresh prose without copies, items or credentials comes through the filtering stages unchanged."""
    rng = random.Random(77)
    vocabulary = [w for (t,) in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("text").limit(60).collect() for w in re.findall("[a-z]+", t)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80, 400))).capitalize() + ".", "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    at = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        at = stage(spark, at, sf)
    assert sorted((r.doc_id, r.text) for r in at.collect()) == [(i, t) for i, t, *_ in rows]


@pytest.mark.parametrize("blocks", [(256, 1024), (2, 3)])
def test_chains_of_near_duplicates(spark, monkeypatch, blocks):
    """Texts that drift away from a base in steps, many of them just at the border: no link between different texts is lost."""
    monkeypatch.setattr(dartminhash, "OUTSIDE", blocks[0])
    monkeypatch.setattr(dartminhash, "MEMBERS", blocks[1])
    rng, rows = random.Random(12), []
    for g in range(4):
        words = prose(rng, 90).split()
        for i in range(14):
            rows.append((100 * g + i, " ".join(words)))
            words[rng.randrange(len(words))] = f"new{g}x{i}"
            if i % 3 == 0:
                words[rng.randrange(len(words))] = f"more{g}x{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, dartminhash.classes(df).collect())) == sorted(brute_classes(rows))


@pytest.mark.parametrize("weight", ["set", "count"])
def test_a_large_bucket_of_near_misses(spark, monkeypatch, weight):
    """Variants of one text, most pairs below 0.8 and some just above it; by sets and by counts."""
    monkeypatch.setattr(dartminhash, "OUTSIDE", 40)
    monkeypatch.setattr(dartminhash, "MEMBERS", 60)
    rng = random.Random(21)
    base, rows = prose(rng, 160).split(), []
    for i in range(220):
        words = list(base) * (1 + (weight == "count"))  # every shingle twice
        for _ in range(rng.randrange(2, 7) * (1 + (weight == "count"))):
            words[rng.randrange(len(words))] = f"v{i}x{rng.randrange(10)}"
        rows.append((i, " ".join(words)))
    if weight == "set":
        want = sorted(brute_classes(rows))
    else:
        def bag(t):
            w = WORD.findall(t)
            return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

        bags, up = [bag(t) for _, t in rows], list(range(len(rows)))

        def top(x):
            return x if up[x] == x else top(up[x])

        for a in range(len(rows)):
            for b in range(a):
                if (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total() - 1e-9:
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
        want = sorted((x, top(x)) for x in up and range(len(rows)))
    assert 1 < len({c for _, c in want}) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, dartminhash.classes(df, dartminhash.Plan(weight=weight)).collect())) == want


def test_urls_equal_sql(spark, sf, tmp_path):
    """The whole tree in SQL, on the tables and on deep, long and odd urls."""
    import duckdb

    rng = random.Random(5)
    seg = lambda: rng.choice(["a", "b", "de", "es", "fr", "p1", "p22", "x-y-z-w", "", "é", "q" * 50])
    urls = [f"http://{rng.choice(['h.com', 'H2.com', 'sub.example.org', 'x.net'])}/{'/'.join(seg() for _ in range(rng.randrange(0, 12)))}{rng.choice(['', '?a=/b', '#c'])}" for _ in range(900)]
    urls += ["http://deep.com/de/" + "/".join(f"s{k}x" for k in range(20)) + f"/{i % 3}" for i in range(12)] + [None, "none", "http://", "http://com/de/" + "y/" * 3000]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for folder, files in ((sf, f"{sf}/pages.parquet"), (sf.replace("0.001", "0.01"), f"{sf.replace('0.001', '0.01')}/pages.parquet"), (str(tmp_path), f"{tmp_path}/pages.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{files}')")
        r = con.execute(ORACLES["op5_url_templates"])
        names = [c[0] for c in r.description]
        got = QUERIES["op5_url_templates"](spark, folder)
        assert sorted(got.columns) == sorted(names)
        key = lambda x: tuple(str(v) for v in x)
        assert sorted(map(key, (tuple(x[c] for c in names) for x in got.collect()))) == sorted(map(key, r.fetchall()))


def test_chunks_against_plain_counts(spark, odd_docs):
    """Every chunk's occurrences, the first one's owner, runs and what stays, by plain loops."""
    plan = gear_chunks.Plan()
    docs = odd_docs.select("doc_id", "text").where("doc_id is not null and doc_id <> 105")
    rows = sorted((i, (t or "").encode()) for i, t in docs.collect())
    ends = [gear_chunks.chunk_ends([t])[0].tolist() for _, t in rows]
    cut = [[t[a:b] for a, b in zip([0, *e], e)] for (_, t), e in zip(rows, ends, strict=True)]
    count, seen = Counter(c for x in cut for c in x), set()

    def long_runs(flags, t, e):
        out, k, begin = [], 0, [0, *e]
        while k < len(flags):
            j = k
            while j < len(flags) and flags[j]:
                j += 1
            a, b = begin[k], begin[j]
            if j > k and b - a >= plan.least:
                while a < len(t) and t[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(t) and t[b] & 0xC0 == 0x80:
                    b -= 1
                out.append((a, b))
            k = max(j, k + 1)
        return out

    got = {r.doc_id: r for r in gear_chunks.repeats(docs).collect()}
    for (i, t), x, e in zip(rows, cut, ends, strict=True):
        later = []
        for c in x:
            later.append(c in seen)
            seen.add(c)
        spans = long_runs(later, t, e)
        assert [(s.start, s.end) for s in got[i].removed] == spans
        assert got[i].n_repeated == sum(b - a for a, b in long_runs([count[c] > 1 for c in x], t, e)) and got[i].n_chunks == len(x)
        assert got[i].kept.encode() == b"".join(t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)]))
    named = docs.selectExpr("concat('d', lpad(doc_id, 5, '0')) AS doc_id", "text")
    assert {int(r.doc_id[1:]): r.kept_sha256 for r in gear_chunks.repeats(named).collect()} == {i: r.kept_sha256 for i, r in got.items()}


def test_exchanges_over_several_levels_agree(spark, odd_docs, monkeypatch):
    """Totals by groups of groups of parts are those of one level: tokens, chunks and segments."""
    docs = odd_docs.select("doc_id", "text").where("doc_id is null or doc_id <> 107").repartition(11)

    def results():
        model = sorted((r.doc_id or -1, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in deleted_interpolation.score(docs).collect())
        chunks = sorted((r.doc_id or -1, r.n_repeated) for r in gear_chunks.digest(gear_chunks.repeats(docs)).where("doc_id <> 105 or doc_id is null").collect())
        spans = sorted((r.doc_id or -1, r.n_removed, r.kept_sha256, r.n_passage) for r in lyndon_dedup.deduplicate(docs, lyndon_dedup.Plan(gather=4)).collect())
        return model, chunks, spans

    want = results()
    monkeypatch.setattr(blobs, "FAN", 3)
    assert blobs.first_bits(7) == 3 and results() == want


def test_suffix_dedup_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    r = con.execute(ORACLES["op9_lyndon_dedup"])
    names = [c[0] for c in r.description]
    got = QUERIES["op9_lyndon_dedup"](spark, sf)
    assert sorted(got.columns) == sorted(names) and sorted(tuple(x[c] for c in names) for x in got.collect()) == sorted(r.fetchall())
