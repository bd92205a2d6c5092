import json
import random

import pytest
from pyspark.sql import functions as F

from docquarry import errors
from docquarry.plans.crypto import Policy
from docquarry.plans.database import Database
from docquarry.plans.storage import Storage
from docquarry.sources import ndjson
from docquarry.streaming import feed


class Clock:
    now = 10**18

    def __call__(self):
        return self.now


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db", clock=Clock())


def seen(c):
    return {r.id: json.loads(r.d) for r in c.live().select("id", F.to_json("data").alias("d")).collect()}


def test_catalog(db):
    db.create("a")
    with pytest.raises(errors.AlreadyExists):
        db.create("a")
    with pytest.raises(errors.NotFound):
        db.collection("b")
    with pytest.raises(errors.InvalidArgument):
        db.create("../x")
    db.collection("b", create=True)
    assert db.list() == ["a", "b"]
    db.drop("a")
    assert db.list() == ["b"]


def test_writes(db):
    c = db.create("c")
    a, b = c.insert_many([{"n": 1}, {"n": 2}])
    assert c.update(a, {"n": 5}) == 2
    c.delete(b)
    with pytest.raises(errors.NotFound):
        c.delete(b)
    with pytest.raises(errors.ReservedField):
        c.insert({"_key": "x"})
    assert c.insert({"n": 3}) == b + 1  # ids are never given again
    assert seen(c) == {a: {"n": 5}, b + 1: {"n": 3}}
    got = c.get(a)
    assert got["rev"] == 2 and got["data"] == {"n": 5} and got["date_added"] == got["date_modified"]
    assert c.stats()["records"] == 2 and c.stats()["dirty"] == 3


def test_keys_and_cas(db):
    c = db.create("c")
    c.insert_with_key("k", {"n": 1})
    with pytest.raises(errors.DuplicateKey):
        c.insert_with_key("k", {"n": 2})
    assert c.upsert("k", {"n": 3})[1:] == (2, False) and c.upsert("l", {"n": 4})[1:] == (1, True)
    assert c.update_if_rev("k", 1, {"n": 9}) == (False, None) and c.update_if_rev("none", 1, {}) == (False, None)
    assert c.update_if_rev("k", 2, {"n": 9}) == (True, 3)
    assert c.update_if_match("k", {"n": 10}, lambda d: d["n"] == 9)[0]
    assert c.find_by_key("k")["data"] == {"n": 10, "_key": "k"} and c.exists("l") and not c.exists("m")
    assert c.update_by_key("l", {"n": 5}) == 2
    c.delete_by_key("l")
    with pytest.raises(errors.KeyNotFound):
        c.find_by_key("l")


def test_unique_and_quota(db):
    c = db.create("c", max_records=3)
    c.insert({"e": "a"})
    c.ensure_unique_index("e")
    with pytest.raises(errors.UniqueViolation):
        c.insert({"e": "a"})
    with pytest.raises(errors.UniqueViolation):
        c.insert_many([{"e": "b"}, {"e": "b"}])
    c.insert_many([{"x": 1}, {"x": 1}])  # absent fields don't clash
    with pytest.raises(errors.QuotaExceeded):
        c.insert({"e": "z"})
    assert c.list_indexes() == ["e"] and [r.id for r in c.index_lookup("e", "a").collect()] == [1]
    c.drop_index("e")
    with pytest.raises(errors.NotFound):
        c.drop_index("e")


def test_transactions(db):
    c = db.create("c")
    a = c.insert({"n": 1})
    tx = c.begin()
    b = tx.insert({"n": 2})
    tx.update(a, {"n": 3})
    assert c.count() == 1
    tx.commit()
    assert seen(c) == {a: {"n": 3}, b: {"n": 2}}
    tx = c.begin()
    tx.insert({"n": 9})
    tx.delete(999)
    with pytest.raises(errors.NotFound):
        tx.commit()
    assert c.count() == 2
    tx = c.begin()
    tx.delete(a)
    tx.update(a, {"n": 1})
    with pytest.raises(errors.NotFound):
        tx.commit()
    name = db.begin("c")
    db.transaction(name).insert({"n": 7})
    assert db.sweep(idle_seconds=-1) == 1
    with pytest.raises(errors.NotFound):
        db.commit(name)


def test_ttl(db):
    c = db.create("c", default_ttl_seconds=10)
    a = c.insert({"n": 1})
    b = c.insert({"n": 2}, expires_at=0)
    db.clock.now += 11 * 10**9
    assert set(seen(c)) == {b} and c.count() == 1
    with pytest.raises(errors.NotFound):
        c.get(a)
    assert c.reap() == 1 and c.reap() == 0
    db.clock.now -= 11 * 10**9
    assert set(seen(c)) == {b}


def test_concurrent_writers_one_wins(db):
    c = db.create("c")
    c.insert({"n": 1})
    s: Storage = c.storage
    v = s.version()
    s.commit(v, v.sets, v.next_id, v.next_seq, v.log_rows)
    with pytest.raises(errors.Conflict):
        s.commit(v, v.sets, v.next_id, v.next_seq, v.log_rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_writes_and_compaction_follow_a_model(db, seed):
    rng, c, model = random.Random(seed), db.create(f"m{seed}"), {}
    for i in range(2):
        model |= dict(zip(c.insert_many([{"n": i, "j": j} for j in range(3)]), [{"n": i, "j": j} for j in range(3)], strict=True))
    for _ in range(8):
        what = rng.random()
        if what < 0.4 or not model:
            d = {"v": rng.randint(0, 9)}
            model[c.insert(d)] = d
        elif what < 0.7:
            k, d = rng.choice(sorted(model)), {"v": rng.randint(0, 9)}
            c.update(k, d)
            model[k] = d
        else:
            k = rng.choice(sorted(model))
            c.delete(k)
            del model[k]
        if rng.random() < 0.2:
            c.compact(force=True)
    assert seen(c) == model
    c.compact(force=True)
    assert seen(c) == model and c.stats()["dirty"] == 0
    assert c.vacuum() == 0 and c.vacuum(0) > 0 and seen(c) == model


def test_pages_cover_every_row_once(db):
    c = db.create("c")
    c.insert_many([{"b": i % 7, "n": i} for i in range(40)])
    out, token = [], None
    while True:
        page = c.find_page(order_by="b:desc", limit=13, page_token=token)
        out += [r.id for r in page.rows.select("id").collect()]
        token = page.next_token
        if not token:
            break
    assert out == [r.id for r in c.find(order_by="b:desc").select("id").collect()] and len(set(out)) == 40
    with pytest.raises(errors.InvalidPageToken):
        c.find_page(order_by="b", limit=1, page_token="!!")


def test_projection_keeps_key(db):
    c = db.create("c")
    c.insert_with_key("k", {"a": 1, "b": None, "c": [1]})
    assert c.find_by_key("k", fields=["b", "zzz"])["data"] == {"b": None, "_key": "k"}


def test_load_and_export(db, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a": 1, "k": "x"}\n\n{"a": 2, "k": "y"}\n')
    c = db.create("c")
    assert c.load_jsonl(f"{tmp_path}/in.jsonl", "k") == 2 and c.exists("x")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(errors.MalformedRecord) as e:
        c.load_jsonl(f"{tmp_path}/bad.jsonl")
    assert e.value.line == 3 and c.count() == 2
    c.export_jsonl(f"file://{tmp_path}/out")
    assert sorted(r.value for r in db.spark.read.text(f"{tmp_path}/out").collect()) == ['{"_key":"x","a":1,"k":"x"}', '{"_key":"y","a":2,"k":"y"}']


def test_log_import(db, tmp_path):
    e = lambda i, op, rev, data: ndjson.encode({"id": i, "op": op, "ts": "2024-01-01T00:00:00Z", "rev": rev, "data": data})
    (tmp_path / "log").mkdir()
    (tmp_path / "log/seg-1.ndjson").write_text(e(1, "insert", 1, {"n": 1}) + "\n" + e(2, "insert", 1, {"n": 2}) + "\n")
    (tmp_path / "log/seg-2.ndjson").write_text(e(1, "update", 2, {"n": 5}) + "\n" + e(2, "delete", None, None) + "\n" + e(3, "insert", 1, {})[:20])
    c = db.create("c")
    assert c.import_log(f"{tmp_path}/log") == 4 and seen(c) == {1: {"n": 5}}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/seg-1.ndjson").write_text(e(1, "insert", 1, {"n": 1}).replace('"n":1', '"n":2') + "\n")
    with pytest.raises(Exception, match="checksum differs"):
        ndjson.read_log(db.spark, f"{tmp_path}/bad").collect()
    assert ndjson.crc32c([b"123456789", b"", b"123456789" * 2, b"a"])[[0, 1]].tolist() == [0xE3069283, 0]


def test_snapshot_and_restore(db, tmp_path):
    c = db.create("c")
    a = c.insert({"n": 1})
    db.snapshot(f"file://{tmp_path}/snap")
    c.update(a, {"n": 2})
    other = Database.restore(db.spark, f"file://{tmp_path}/snap", f"file://{tmp_path}/db2", clock=db.clock)
    assert seen(other.collection("c")) == {a: {"n": 1}} and other.collection("c").insert({}) == a + 1


def test_feed_and_replication(db, tmp_path):
    c = db.create("c")
    a = c.insert({"t": "x"})
    c.update(a, {"t": "y"})
    c.delete(a)
    assert [r.op for r in feed.changes(c).collect()] == ["INSERTED", "UPDATED", "DELETED"]
    assert [r.op for r in feed.changes(c, filter={"field": "t", "op": "neq", "value": "zzz"}).collect()] == ["INSERTED", "UPDATED"]
    other = Database(db.spark, f"file://{tmp_path}/f", clock=db.clock)
    f = other.create("c")
    other.read_only = True
    with pytest.raises(errors.ReadOnly):
        f.insert({})
    assert feed.lag(c, f) == 3 and feed.replicate(c, f) == 3 and feed.replicate(c, f) == 0 and feed.lag(c, f) == 0
    other.promote()
    assert f.insert({"n": 1}) == a + 1


def test_overflow():
    s = feed.Subscription(2)
    for i in range(4):
        s.offer(i)
    assert [s.take(), s.take(), s.take()] == [0, 1, None]
    s.offer(5)
    assert [s.take(), s.take()] == [{"op": "OVERFLOW"}, 5]


@pytest.mark.parametrize("mode", ["field", "record"])
def test_encryption(db, mode):
    c = db.create("c")
    c.policy = Policy(b"k" * 32, mode, frozenset({"ssn"} if mode == "field" else {"n"}))
    a = c.insert({"ssn": {"x": [1, "two"]}, "n": 1})
    raw = c.live().select(F.to_json("data").alias("d")).first().d
    assert "two" not in raw and c.get(a)["data"] == {"ssn": {"x": [1, "two"]}, "n": 1}
    with pytest.raises(errors.OpaqueField):
        c.find({"field": "ssn", "op": "eq", "value": 1})
    with pytest.raises(errors.OpaqueField):
        c.aggregate(group_by="ssn")
    assert c.find({"field": "n", "op": "eq", "value": 1}).count() == 1
    c.migrate_encryption(c.policy.rotated(b"q" * 32))
    assert c.policy.epoch == 2 and c.get(a)["data"]["ssn"] == {"x": [1, "two"]}
    c.migrate_encryption(None)
    assert c.get(a)["data"] == {"ssn": {"x": [1, "two"]}, "n": 1}


def test_script(db):
    from docquarry.plans.script import Script

    out = Script(db).run('# a script\ncreate c\nuse c\ninsert \'{"n": 1}\'\nnonsense\nfind \'{"field": "n", "op": "eq", "value": "1"}\'\nupdate 1 \'{"n": 2}\'\nget c 1\nstats\ndelete 9\n')
    assert [o.error is None for o in out] == [True, True, True, False, True, True, True, True, False]
    assert out[2].result == 1 and out[4].result == [{"id": 1, "rev": 1, "data": {"n": 1}}] and out[6].result["data"] == {"n": 2}


def test_group_by_and_upkeep(db):
    c = db.create("c")
    c.insert_many([{"g": 1}, {"g": "1"}, {"g": None}, {}, {"g": True}])
    assert [(g["key"], g["count"]) for g in c.group_by("g")] == [(1, 1), ("1", 1), (None, 2), (True, 1)]
    seen_, c.on_compaction = [], lambda e: seen_.append(e)
    c.update(1, {"g": 2})
    for _ in range(3):
        c.update(1, {"g": 2})
    assert db.maintain() == {"c": True} and seen_[0]["after"] == 5 and db.maintain() == {"c": False}


def test_unchanged_records_are_not_shuffled(db):
    c = db.create("c")
    c.insert_many([{"n": i} for i in range(20)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(c.live())
    c.update(3, {"n": 99})
    c.delete(4)
    assert "BroadcastHashJoin" in plan(c.live()) and c.count() == 19 and c.get(3)["data"] == {"n": 99}
    tx = c.begin()
    row = tx.insert({"n": 1})
    tx.update(row, {"n": 2})
    tx.commit()
    assert c.get(row)["data"] == {"n": 2} and c.count() == 20
    c.compact(force=True)
    assert "Exchange" not in plan(c.live()) and c.count() == 20


def test_key_check_and_provider(db):
    class Keys:
        def key(self, epoch):
            return bytes([epoch]) * 32

    c = db.create("c")
    c.encrypt(Policy.of(Keys(), 2, fields=frozenset({"s"})))
    a = c.insert({"s": 1})
    with pytest.raises(errors.InvalidArgument):
        c.encrypt(Policy(b"z" * 32, fields=frozenset({"s"})))
    c.encrypt(Policy.of(Keys(), 3, fields=frozenset({"s"})))
    assert c.get(a)["data"] == {"s": 1} and c.encryption_status()["records"] == {2: 1}


def test_promotion_guard_observation_and_tags(db, tmp_path):
    from pyspark.sql import Observation

    from docquarry.operators import scan

    c = db.create("c")
    c.insert_many([{"n": 1}, {"n": 2}])
    other = Database(db.spark, f"file://{tmp_path}/f", clock=db.clock)
    f = other.create("c")
    other.read_only = True
    with pytest.raises(errors.Conflict):
        feed.promote(c, f, other.promote)
    feed.replicate(c, f)
    feed.promote(c, f, other.promote)
    assert f.insert({}) == 3
    seen_ = Observation()
    with scan.cancellable(db.spark, "mine"):
        assert scan.find(c.live(), {"field": "n", "op": "eq", "value": 1}, data="data", observe=seen_).count() == 1
    assert seen_.get["scanned"] == 2
    scan.cancel(db.spark, "mine")
