"""Storage under concurrent writers and failures, followers, indexes, subscriptions and upkeep."""

import json
import time

import pytest
from pyspark.sql import functions as F

from docquarry import errors
from docquarry.operators import scan
from docquarry.plans.database import Database
from docquarry.plans.script import Script
from docquarry.plans.storage import Files, Storage
from docquarry.streaming import feed


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def values(c):
    return sorted(json.loads(r.d)["n"] for r in c.live().select(F.to_json("data").alias("d")).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sets_in_flight_and_pinned_versions_survive_vacuum(db):
    c = db.create("c")
    c.insert_many([{"n": i} for i in range(4)])
    c.update(1, {"n": 10})
    pinned = c.storage.version()
    base = c.storage.version()
    flying = c.storage.write(c._frame([{"id": 9, "op": "insert", "rev": 1, "data": {"n": 9}}], base.next_seq))
    assert c.vacuum() == 0
    c.storage.commit(base, [*base.sets, flying], 10, base.next_seq + 1, base.log_rows + 1)
    assert values(c) == [1, 2, 3, 9, 10]
    c.compact(force=True)
    assert c.vacuum() == 0 and c._live(pinned).count() == 4
    assert c.vacuum(0) == 3 and values(c) == [1, 2, 3, 9, 10]


def test_a_writer_that_dies_leaves_nothing_under_the_commits_name(db, monkeypatch):
    c = db.create("c")
    c.insert({"n": 1})

    def fails(*_):
        raise RuntimeError("died")

    with monkeypatch.context() as m:
        m.setattr(Files, "_place", fails)
        with pytest.raises(RuntimeError):
            c.insert({"n": 2})
    assert c.storage.versions() == [1] and not any("tmp" in n for n in c.storage.files.names(c.storage.commits))
    with monkeypatch.context() as m:
        m.setattr(Storage, "_publish", lambda *_: None)
        c.insert({"n": 3})  # dies after its commit, before its set is in place
    again = Database(db.spark, db.root).collection("c")
    assert values(again) == [1, 3] and len(c.storage.files.names(f"{c.storage.path}/data")) == 2


def test_two_writers_of_a_version(db):
    a, b = db.create("c"), Database(db.spark, db.root).collection("c")
    base = a.storage.version()
    one, two = (x.storage.write(x._frame([{"id": 1, "op": "insert", "rev": 1, "data": {"n": n}}], 1)) for n, x in enumerate((a, b)))
    a.storage.commit(base, [one], 2, 2, 1)
    with pytest.raises(errors.Conflict):
        b.storage.commit(base, [two], 2, 2, 1)
    assert values(b) == [0]
    a.set_meta(lambda m: {"indexes": {"x": False} | m.get("indexes", {})})
    b.ensure_index("y")
    a.ensure_unique_index("z")
    assert a.list_indexes() == b.list_indexes() == ["x", "y", "z"]


def test_the_stream_holds_committed_events_only(db, tmp_path):
    c = db.create("c")
    c.insert({"n": 1})
    c.storage.write(c._frame([{"id": 5, "op": "insert", "rev": 1, "data": {"n": 5}}], 2))  # never committed
    c.insert({"n": 2})
    rows = feed.watch(c, from_seq=0).select(F.to_json("data").alias("d"))
    rows.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    assert sorted(r.d for r in db.spark.read.parquet(f"file://{tmp_path}/out").collect()) == ['{"n":1}', '{"n":2}']


def test_a_follower_writes_nothing_of_its_own(db, tmp_path):
    c = db.create("c", default_ttl_seconds=1)
    c.insert({"n": 1})
    other = Database(db.spark, f"file://{tmp_path}/other", read_only=True, clock=lambda: time.time_ns() + 10**13)
    f = other.follower("c")
    assert feed.replicate(c, f) == 1
    for write in (f.reap, lambda: f.compact(force=True), lambda: f.migrate_encryption(None), lambda: f.insert({}), lambda: f.insert_rows(c.live().select("data", "key"))):
        with pytest.raises(errors.ReadOnly):
            write()
    assert other.maintain() == {"c": False}
    c.insert({"n": 2})
    rounds = iter([False, False, False, False])
    assert feed.follow(c, f, lambda: next(rounds, True), 0.01) == 1 and feed.lag(c, f) == 0 and f.log().count() == 2
    other.promote()
    assert f.reap() == 2 and f.count() == 0
    with pytest.raises(errors.Conflict):
        feed.replicate(f, db.collection("c"))


def test_subscriptions_are_fed_by_writes(db):
    c = db.create("c")
    every, some = c.subscribe(size=3), c.subscribe({"and": [{"field": "n", "op": "gt", "value": 1}, {"field": "s", "op": "regex", "value": "^a"}]})
    a = c.insert({"n": 5, "s": "abc"})
    c.insert({"n": 1, "s": "abc"})
    c.update(a, {"n": 6, "s": "b"})
    c.delete(a)
    c.unsubscribe(some)
    c.insert({"n": 7, "s": "a"})
    assert [(e["op"], e.get("seq")) for e in iter(every.take, None)] == [("INSERTED", 1), ("INSERTED", 2), ("UPDATED", 3)]
    assert [e["data"]["n"] for e in iter(some.take, None)] == [5] and every.lost


def test_indexes_prune_and_follow_writes(db):
    c = db.create("c")
    c.insert_rows(db.spark.range(500).select(F.parse_json(F.to_json(F.struct((F.col("id") % 50).alias("n"), F.lit("x").alias("s")))).alias("data"), F.lit(None).cast("string").alias("key")))
    c.ensure_index("n")
    assert "EqualTo(num,7.0)" in plan(c.index("n").candidates(c.storage.version(), scan_leaf("n", "eq", 7)))
    found = c.find({"field": "n", "op": "eq", "value": 7})
    assert found.count() == 10 and "In(id, [" in plan(found)
    first = found.orderBy("id").first().id
    c.update(first, {"n": 8})
    c.delete(first + 50)
    c.insert_many([{"n": "7"}, {"n": 7.0}, {"n": [7]}, {"m": 7}])
    assert c.index_lookup("n", 7).count() == 10  # "7" equals by text
    for op in ("gt", "gte", "lt", "lte"):
        by_scan = {r.id for r in scan.find(c.live(), {"field": "n", "op": op, "value": 40}, data="data").select("id").collect()}
        assert {r.id for r in c.index_lookup("n", 40, op).collect()} == by_scan
    c.compact(force=True)
    assert c.find({"field": "n", "op": "eq", "value": 8}).count() == 11
    c.drop_index("n")
    with pytest.raises(errors.NotFound):
        c.index_lookup("n", 7)


def scan_leaf(name, op, value):
    from docquarry.operators.filters import Field

    return Field(name, op, value)


def test_a_limit_alone_stops_early(db):
    c = db.create("c")
    c.insert_rows(db.spark.range(0, 4000, 1, 8).select(F.parse_json(F.to_json(F.struct("id"))).alias("data"), F.lit(None).cast("string").alias("key")))
    found = c.find(limit=10)
    assert found.count() == 10 and not {"TakeOrdered", "Sort ", "Exchange"} & {w for w in ("TakeOrdered", "Sort ", "Exchange") if w in plan(found)}
    assert [r.id for r in c.find(limit=3, offset=5).collect()] == [6, 7, 8]


def test_bad_lines_have_their_numbers(db, tmp_path):
    (tmp_path / "in.json").write_text("\r\n".join(['{"a": 1}'] * 7000 + ["", '{"a": ', '{"b": 2}', "[]"]))
    with pytest.raises(errors.MalformedRecord) as e:
        db.create("c").load_jsonl(f"file://{tmp_path}/in.json")
    assert e.value.line == 7002 and db.collection("c").count() == 0


def test_script_commands_and_upkeep_thread(db, tmp_path):
    out = Script(db).run(f"create c\nuse c\ninsert '{{\"n\": 1, \"g\": \"a\"}}'\ninsert '{{\"n\": 2, \"g\": \"a\"}}'\ncount '{{\"field\": \"n\", \"op\": \"gt\", \"value\": 1}}'\naggregate count,sum n g\n"
                         f"export file://{tmp_path}/out\ncreate d\nimport d file://{tmp_path}/out\ncount d\naggregate count")
    assert [o.error for o in out] == [None] * 11
    assert out[4].result == 1 and out[5].result[0]["key"] == "a" and (out[5].result[0]["count"], out[5].result[0]["sum"]) == (2, 3.0)
    assert out[8].result == out[9].result == 2 and out[10].result[0]["count"] == 2
    c = db.collection("c")
    for i in range(4):
        c.update(1, {"n": i})
    stop = db.maintain_every(0.05)
    deadline = time.time() + 60
    while c.stats()["dirty"] and time.time() < deadline:
        time.sleep(0.2)
    stop()
    assert c.stats()["dirty"] == 0 and db.upkeep_error is None


def test_a_log_scan_goes_on_from_a_position(spark, tmp_path):
    from docquarry.sources import ndjson

    entries = [{"id": i, "op": "insert", "rev": 1, "data": {"n": i}} for i in range(1, 10)]
    for n in range(3):
        (tmp_path / f"{n:04d}.log").write_text("".join(ndjson.encode(e) + "\n" for e in entries[3 * n : 3 * n + 3]) + '{"torn' * (n == 2))
    every = ndjson.read_log(spark, f"file://{tmp_path}").orderBy("seq").collect()
    assert [r.id for r in every] == list(range(1, 10))
    for k in range(9):
        got = ndjson.read_log(spark, f"file://{tmp_path}", after=tuple(every[k].seq))
        assert sorted(r.id for r in got.collect()) == list(range(k + 2, 10))


def test_log_segments_grow_in_number_with_the_log(spark, sf, monkeypatch):
    from docquarry.plans import queries
    from docquarry.sources import ndjson

    sizes, read = [], ndjson.read_log
    monkeypatch.setattr(queries, "SEGMENT", 100, raising=False)
    monkeypatch.setattr(ndjson, "read_log", lambda s, path: sizes.extend(r.n for r in s.read.text(path).groupBy("_metadata.file_name").agg(F.count("value").alias("n")).collect()) or read(s, path))
    got = queries.log_file_round_trip(spark, sf)
    rows = queries.order_log(spark, sf).count()
    assert sum(sizes) == rows and len(sizes) >= rows / 100 and max(sizes) < 200
    assert {r.o_orderkey for r in got.collect()} == {r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0").collect()}


def test_a_segment_is_cut_once_and_not_for_each_line(spark, tmp_path):
    from docquarry.sources import ndjson

    e = lambda i: ndjson.encode({"id": i, "op": "insert", "rev": 1, "data": {"n": i}})
    (tmp_path / "1").write_text(e(1) + "\n\n" + e(2))  # only the last segment's tail may be torn
    (tmp_path / "2").write_text("\n".join([e(3), e(4), e(5)[:-1]]))
    log = ndjson.read_log(spark, f"file://{tmp_path}")
    assert sorted((r.id, *r.seq) for r in log.collect()) == [(1, "1", 0), (2, "1", 2), (3, "2", 0), (4, "2", 1)]
    above, generate, _ = log._jdf.queryExecution().optimizedPlan().toString().partition("Generate posexplode")
    assert generate and "split(" not in above and "value" not in above
    (tmp_path / "3").write_text(e(6)[:-1])
    assert ndjson.read_log(spark, f"file://{tmp_path}/3").collect() == []
    (tmp_path / "3").write_text(e(6))
    assert ndjson.read_log(spark, f"file://{tmp_path}/3", torn_tail=False).first().id == 6


def test_lines_encoded_at_once_are_those_encoded_one_by_one():
    from docquarry.sources import ndjson

    rows = [(0, "insert", 1, 0, '{"b":1.5,"a":[1e-7,-0.0,"< é>"]}'), (2**63, "update", 2, 1000, '{}'), (7, "delete", None, None, None), (8, "up\"date", 0, -5, "null")]
    names = ("id", "op", "rev", "expires_at", "data")
    for row, line in zip(rows, ndjson.encode_all(iter(rows)), strict=True):
        entry = dict(zip(names, row, strict=True)) | {"data": row[4] and json.loads(row[4])}
        assert json.loads(line) == json.loads(ndjson.encode(entry)) and "\n" not in line
    assert ndjson.encode_all([]) == []
