"""A collection: reads over a pinned version of its log, and writes as atomic commits.

Writes are small batches prepared in the driver (load_jsonl and insert_rows are for large ones); each is checked against the
live view and committed at once, or checked again if another writer was first.  An expired record counts as absent everywhere.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections import deque
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.errors import AlreadyExists, Conflict, DuplicateKey, InvalidArgument, KeyNotFound, NotFound, QuotaExceeded, ReadOnly, RecordTooLarge, ReservedField, UniqueViolation
from docquarry.functions.scalars import text
from docquarry.functions.values import Fields
from docquarry.operators import aggregate as aggregation
from docquarry.operators import filters, scan
from docquarry.plans import crypto
from docquarry.plans.index import INDEXED_OPS, FieldIndex
from docquarry.plans.log import live, live_split, now_nanos, records
from docquarry.plans.storage import Storage, Version
from docquarry.sources import ndjson

RETRIES = 8
#: Candidates of an index up to which their ids are part of the plan.
FEW_IDS = 1000


#: What a log operation is called in the change feed.
EVENTS = {"insert": "INSERTED", "update": "UPDATED", "delete": "DELETED"}


@dataclass
class Subscription:
    """A bounded queue for in-process listeners: what doesn't fit is dropped, and one OVERFLOW stands for it."""

    size: int = 64
    filter: filters.Filter = filters.MatchAll()
    queue: deque = field(default_factory=deque)
    lost: bool = False

    def offer(self, event: Any) -> None:
        if len(self.queue) >= self.size:
            self.lost = True
            return
        if self.lost:
            self.queue.append({"op": "OVERFLOW"})
            self.lost = False
            if len(self.queue) >= self.size:
                self.lost = True
                return
        self.queue.append(event)

    def take(self) -> Any:
        return self.queue.popleft() if self.queue else None


class Collection:
    def __init__(self, spark, root: str, name: str, clock: Callable[[], int] = now_nanos, read_only: Callable[[], bool] = lambda: False):
        self.spark, self.name, self.clock, self._read_only = spark, name, clock, read_only
        self.storage = Storage(spark, f"{root}/{name}")
        self.policy: crypto.Policy | None = None
        self._next_id = 0
        self.on_scan: Callable[[dict], None] | None = None
        self.on_compaction: Callable[[dict], None] | None = None
        self._subscribers: list[Subscription] = []

    # meta

    def meta(self, number: int | None = None) -> dict:
        """Settings: those of the last ``_meta/<n>.json``, before there is one those of creation."""
        files, path = self.storage.files, self.storage.path
        if number is None:
            number = max([int(n[:-5]) for n in files.names(f"{path}/_meta") if n.endswith(".json")], default=0)
        at = f"{path}/_meta/{number:020d}.json" if number else f"{path}/meta.json"
        return json.loads(files.read(at)) if files.exists(at) else {}

    def set_meta(self, change: Callable[[dict], dict] | None = None, **changes: Any) -> None:
        """Stores settings, as given or as ``change`` makes them of the present ones; tried again if another writer was first."""
        files, folder = self.storage.files, f"{self.storage.path}/_meta"
        for _ in range(RETRIES):
            number = max([int(n[:-5]) for n in files.names(folder) if n.endswith(".json")], default=0)
            now = self.meta(number)
            if files.create(f"{folder}/{number + 1:020d}.json", json.dumps(now | changes | (change(now) if change else {}))):
                return
        raise Conflict("settings: other writers were first")

    def encrypt(self, policy: crypto.Policy) -> None:
        """Sets the policy; a key that doesn't fit what is stored is refused."""
        check = self.meta().get("key_check")
        if check and not crypto.key_fits(self.spark, policy, check):
            raise InvalidArgument("the key is not this collection's")
        if not check:
            self.set_meta(key_check=crypto.key_check(self.spark, policy))
        self.policy = policy

    def ensure_index(self, field: str, unique: bool = False) -> None:
        """Records the index and builds it; an existing one stays as it is."""
        if field not in self.meta().get("indexes", {}):
            if self.policy:
                self.policy.check_open({field})
            self.set_meta(lambda m: {"indexes": {field: unique} | m.get("indexes", {})})
        if not unique:
            self.index(field).refresh(self.storage.version())

    def ensure_unique_index(self, field: str) -> None:
        """Enforced from now on; duplicates that are there stay."""
        self.ensure_index(field, unique=True)

    def drop_index(self, field: str) -> None:
        if field not in self.meta().get("indexes", {}):
            raise NotFound(f"no index on {field}")
        self.set_meta(lambda m: {"indexes": {k: v for k, v in m["indexes"].items() if k != field}})
        self.index(field).drop()

    def list_indexes(self) -> list[str]:
        return sorted(self.meta().get("indexes", {}))

    def index(self, field: str) -> FieldIndex:
        return FieldIndex(self.storage, field)

    def index_lookup(self, field: str, value: Any, op: str = "eq") -> DataFrame:
        """(id) of live records whose field compares so with the value, by the index: candidates, looked at again in the live view."""
        if field not in self.meta().get("indexes", {}):
            raise NotFound(f"no index on {field}")
        return self._indexed(filters.Field(field, op, filters.literal(value))).select("id")

    def _indexed(self, leaf: filters.Field) -> DataFrame:
        """Live records that pass a leaf on an indexed field.  Few candidates go to the scans as ids, which skip row groups; many are joined."""
        self._guard(None, None, leaf.field)
        v = self.storage.version()
        ids = self.index(leaf.field).candidates(v, leaf)
        few = [r["id"] for r in ids.limit(FEW_IDS + 1).collect()]
        now = self._live(v)
        near = now.where(F.col("id").isin(few)) if len(few) <= FEW_IDS else now.join(ids, "id", "left_semi")
        return filters.where(near, leaf, "data")

    # reads

    def log(self, version: int | None = None) -> DataFrame:
        return self.storage.log(self.storage.version(version))

    def live(self, version: int | None = None) -> DataFrame:
        return self._live(self.storage.version(version))

    def _live(self, v: Version) -> DataFrame:
        plain, now = self.storage.log(v, v.plain()), self.clock()
        if not v.changing:
            return records(plain, now)
        changing = self.storage.log(v, v.changing)
        return live_split(plain, changing, now) if v.plain() else live(changing, now)

    def _open(self, df: DataFrame) -> DataFrame:
        return crypto.open_rows(df, self.policy, self.name) if self.policy else df

    def _guard(self, filter: Any = None, order_by: Any = None, *fields: str | None) -> None:
        if self.policy:
            used = set() if isinstance(filter, Column) else filters.fields_of(filters.parse(filter))
            self.policy.check_open(used | {s.field for s in scan.sort_fields(order_by)} | {f for f in fields if f})

    def find(self, filter: Any = None, order_by: Any = None, limit: int = 0, offset: int = 0, page_token: str | None = None, fields: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        self._guard(filter, order_by)
        began = time.time()
        leaf = None if isinstance(filter, Column) else filters.parse(filter)
        by_index = version is None and isinstance(leaf, filters.Field) and leaf.op in INDEXED_OPS and leaf.field in self.meta().get("indexes", {})
        out = scan.find(self._indexed(leaf) if by_index else self.live(version), None if by_index else filter, order_by, limit, offset, page_token, data="data")
        if self.on_scan:
            self.on_scan({"collection": self.name, "filter": "*" if isinstance(filter, Column) else filters.shape(filters.parse(filter)), "seconds": time.time() - began})
        return scan.project(self._open(out), fields, "data")

    def find_page(self, filter: Any = None, order_by: Any = None, limit: int = 0, page_token: str | None = None, fields: Sequence[str] | None = None) -> scan.Page:
        self._guard(filter, order_by)
        page = scan.find_page(self.live(), filter, order_by, limit, page_token, data="data")
        page.rows = scan.project(self._open(page.rows), fields, "data")
        return page

    def get(self, id: int, fields: Sequence[str] | None = None) -> dict:
        return self._one(self.live().where(F.col("id") == id), f"no record {id}", NotFound, fields)

    def find_by_key(self, key: str, fields: Sequence[str] | None = None) -> dict:
        return self._one(self.live().where(F.col("key") == key), f"no key {key!r}", KeyNotFound, fields)

    def _one(self, df: DataFrame, what: str, error: type, fields: Sequence[str] | None) -> dict:
        got = scan.project(self._open(df.limit(1)), fields, "data").withColumn("data", F.to_json("data")).collect()
        if not got:
            raise error(what)
        r = got[0].asDict()
        return r | {"data": json.loads(r["data"]), "date_added": r["ts"], "date_modified": r["ts"]}

    def exists(self, key: str) -> bool:
        return not self.live().where(F.col("key") == key).limit(1).isEmpty()

    def scan(self, filter: Any = None) -> list[dict]:
        rows = self.find(filter).orderBy("id").withColumn("data", F.to_json("data")).collect()
        return [r.asDict() | {"data": json.loads(r["data"])} for r in rows]

    def count(self, filter: Any = None) -> int:
        self._guard(filter)
        return aggregation.count(self.live(), filter, "data")

    def aggregate(self, filter: Any = None, group_by: str | None = None, field: str | None = None, aggs: Sequence[str] = ("count",), contract: bool = True) -> DataFrame:
        self._guard(filter, None, group_by, field)
        return aggregation.aggregate(self.live(), filter, group_by, field, aggs, "data", contract)

    def group_by(self, field: str, aggs: Sequence[str] = ("count",), of: str | None = None, filter: Any = None) -> list[dict]:
        """aggregate() as a list with keys as Python values."""
        rows = self.aggregate(filter, field, of, aggs).withColumn("key", F.to_json(F.struct(F.col("key").alias("k")))).collect()
        return [r.asDict() | {"key": json.loads(r["key"]).get("k")} for r in rows]

    def encryption_status(self) -> dict:
        """Live records by the epoch that sealed them."""
        from docquarry.plans.log import latest

        rows = latest(self.log()).where("op <> 'delete'").groupBy("epoch").count().collect()
        return {"mode": self.policy.mode if self.policy else None, "epoch": self.policy.epoch if self.policy else 0, "records": {r["epoch"]: r["count"] for r in rows}}

    def stats(self) -> dict:
        v = self.storage.version()
        live_rows = self._live(v).count()
        return {"name": self.name, "records": live_rows, "segments": len(v.sets), "bytes": self.storage.size(v), "dirty": v.log_rows - live_rows, "version": v.number}

    # writes

    def _checked(self, data: dict, key: str | None = None) -> dict:
        if not isinstance(data, dict):
            raise InvalidArgument("data must be an object")
        if scan.KEY in data and data[scan.KEY] != key:
            raise ReservedField(f"{scan.KEY} is reserved")
        if self.policy:
            self.policy.check_plain(data)
        data = data | ({scan.KEY: key} if key is not None else {})
        ndjson.check_size(data)
        return data

    def _deadline(self, ttl_seconds: float | None, expires_at: int | None) -> int:
        if expires_at is not None:
            return expires_at
        ttl = self.meta().get("default_ttl_seconds", 0) if ttl_seconds is None else ttl_seconds
        return self.clock() + int(ttl * 1e9) if ttl else 0

    def reserve(self, n: int = 1) -> int:
        """The first of n ids that are never given again."""
        first = max(self._next_id, self.storage.version().next_id)
        self._next_id = first + n
        return first

    def _frame(self, rows: list[dict], seq: int) -> DataFrame:
        stamp = dt.datetime.fromtimestamp(self.clock() / 1e9)
        said = [(r["id"], r["op"], stamp, r.get("rev"), None if r.get("data") is None else json.dumps(r["data"]), self.policy.epoch if self.policy else 0, r.get("expires_at", 0), seq + i) for i, r in enumerate(rows)]
        df = self.spark.createDataFrame(said, "id long, op string, ts timestamp, rev long, j string, epoch long, expires_at long, seq long")
        df = df.select("id", "op", "ts", "rev", F.parse_json("j").alias("data"), "epoch", "expires_at", "seq")
        return crypto.seal_rows(df, self.policy, self.name) if self.policy else df

    def _writable(self) -> Version:
        """The version to write on; a follower's collection takes no writes of its own, upkeep included."""
        v = self.storage.version()
        if self._read_only() or v.replica:
            raise ReadOnly(f"{self.name} takes no writes here")
        return v

    def subscribe(self, filter: Any = None, size: int = 64) -> "Subscription":
        """A bounded queue that this object's committed writes feed; see streaming.feed for other processes' writes."""
        s = Subscription(size, filters.parse(filter))
        self._subscribers.append(s)
        return s

    def unsubscribe(self, s: "Subscription") -> None:
        self._subscribers.remove(s)

    def _tell(self, rows: list[dict], seq: int) -> None:
        for s in self._subscribers:
            for i, r in enumerate(rows):
                if filters.matches(s.filter, r.get("data"), self.spark):
                    s.offer({"op": EVENTS[r["op"]], "id": r["id"], "data": r.get("data"), "seq": seq + i})

    def _write(self, prepare: Callable[[Version, DataFrame], list[dict]], note: str) -> list[dict]:
        """Prepares log rows against the live view and commits them, again if another writer was first."""
        for _ in range(RETRIES):
            base = self._writable()
            rows = prepare(base, self._live(base))
            if not rows:
                return rows
            self._unique(rows, self._live(base))
            self._quota(rows, base)
            name = self.storage.write(self._frame(rows, base.next_seq), files=1)
            next_id = max(base.next_id, self._next_id, *(r["id"] + 1 for r in rows))
            try:
                changing = [*base.changing, name] if any(r["op"] != "insert" for r in rows) else base.changing
                self.storage.commit(base, [*base.sets, name], next_id, base.next_seq + len(rows), base.log_rows + len(rows), note, changing)
                self._tell(rows, base.next_seq)
                return rows
            except Conflict:
                self.storage.discard(name)
        raise Conflict(f"{note}: other writers were first {RETRIES} times")

    def _unique(self, rows: list[dict], now: DataFrame) -> None:
        """Unique fields and keys hold among the batch and against other live records."""
        fields = [f for f, u in self.meta().get("indexes", {}).items() if u]
        fields = [*fields, scan.KEY] if any(scan.KEY in (r.get("data") or {}) for r in rows) and scan.KEY not in fields else fields
        gone = {r["id"] for r in rows}
        last = {r["id"]: r for r in rows}
        for f in fields:
            error = DuplicateKey if f == scan.KEY else UniqueViolation
            said = [text(r["data"][f]) for r in last.values() if r["op"] != "delete" and f in r["data"]]
            if len(set(said)) < len(said):
                raise error(f"{f} is repeated in the batch")
            if said:
                v = Fields(now, "data")[f]
                if not now.where(v.present & v.txt.isin(said) & ~F.col("id").isin(list(gone))).limit(1).isEmpty():
                    raise error(f"{f} is taken")

    def _quota(self, rows: list[dict], base: Version) -> None:
        self._room(sum(r["op"] == "insert" for r in rows), base)

    def _room(self, new: int, base: Version) -> None:
        m = self.meta()
        if new and m.get("max_records") and self._live(base).count() + new > m["max_records"]:
            raise QuotaExceeded(f"{self.name} holds at most {m['max_records']} records")
        if new and m.get("max_bytes") and self.storage.size(base) >= m["max_bytes"]:
            raise QuotaExceeded(f"{self.name} holds at most {m['max_bytes']} bytes")

    def insert(self, data: dict, ttl_seconds: float | None = None, expires_at: int | None = None) -> int:
        return self.insert_many([data], ttl_seconds, expires_at)[0]

    def insert_many(self, records: Iterable[dict], ttl_seconds: float | None = None, expires_at: int | None = None) -> list[int]:
        """All or none."""
        records = [self._checked(d) for d in records]
        if not records:
            return []
        first, deadline = self.reserve(len(records)), self._deadline(ttl_seconds, expires_at)
        rows = [{"id": first + i, "op": "insert", "rev": 1, "data": d, "expires_at": deadline} for i, d in enumerate(records)]
        return [r["id"] for r in self._write(lambda *_: rows, "insert")]

    def insert_with_key(self, key: str, data: dict, ttl_seconds: float | None = None, expires_at: int | None = None) -> int:
        self.ensure_unique_index(scan.KEY)
        row = {"id": self.reserve(), "op": "insert", "rev": 1, "data": self._checked(data, key), "expires_at": self._deadline(ttl_seconds, expires_at)}
        return self._write(lambda *_: [row], "insert with key")[0]["id"]

    def _current(self, now: DataFrame, test: Column) -> dict | None:
        got = now.where(test).limit(1).select("id", "key", "rev", "expires_at", F.to_json("data").alias("data")).collect()
        return got[0].asDict() if got else None

    def _replace(self, cur: dict, data: dict, expires_at: int | None) -> dict:
        return {"id": cur["id"], "op": "update", "rev": cur["rev"] + 1, "data": self._checked(data, cur["key"]), "expires_at": cur["expires_at"] if expires_at is None else expires_at}

    def update(self, id: int, data: dict, expires_at: int | None = None) -> int:
        """Replaces the whole record, keeping key and deadline (unless one is given); the new rev."""

        def prepare(_, now: DataFrame) -> list[dict]:
            cur = self._current(now, F.col("id") == id)
            if cur is None:
                raise NotFound(f"no record {id}")
            return [self._replace(cur, data, expires_at)]

        return self._write(prepare, "update")[0]["rev"]

    def update_by_key(self, key: str, data: dict, expires_at: int | None = None) -> int:
        def prepare(_, now: DataFrame) -> list[dict]:
            cur = self._current(now, F.col("key") == key)
            if cur is None:
                raise KeyNotFound(f"no key {key!r}")
            return [self._replace(cur, data, expires_at)]

        return self._write(prepare, "update by key")[0]["rev"]

    def upsert(self, key: str, data: dict) -> tuple[int, int, bool]:
        """(id, rev, whether it was new)."""
        self.ensure_unique_index(scan.KEY)

        def prepare(_, now: DataFrame) -> list[dict]:
            cur = self._current(now, F.col("key") == key)
            if cur:
                return [self._replace(cur, data, None)]
            return [{"id": self.reserve(), "op": "insert", "rev": 1, "data": self._checked(data, key), "expires_at": self._deadline(None, None)}]

        r = self._write(prepare, "upsert")[0]
        return r["id"], r["rev"], r["op"] == "insert"

    def update_if_match(self, key: str, data: dict, test: Callable[[dict], bool]) -> tuple[bool, int | None]:
        """Replaces the record if ``test`` holds of its data; (done, new rev).  A missing key is (False, None)."""

        def prepare(_, now: DataFrame) -> list[dict]:
            cur = self._current(now, F.col("key") == key)
            return [self._replace(cur, data, None)] if cur and test(json.loads(cur["data"]) | {"_rev": cur["rev"]}) else []

        rows = self._write(prepare, "update if match")
        return bool(rows), rows[0]["rev"] if rows else None

    def update_if_rev(self, key: str, rev: int, data: dict) -> tuple[bool, int | None]:
        return self.update_if_match(key, data, lambda cur: cur["_rev"] == rev)

    def delete(self, id: int) -> None:
        def prepare(_, now: DataFrame) -> list[dict]:
            if self._current(now, F.col("id") == id) is None:
                raise NotFound(f"no record {id}")
            return [{"id": id, "op": "delete"}]

        self._write(prepare, "delete")

    def delete_by_key(self, key: str) -> None:
        def prepare(_, now: DataFrame) -> list[dict]:
            cur = self._current(now, F.col("key") == key)
            if cur is None:
                raise KeyNotFound(f"no key {key!r}")
            return [{"id": cur["id"], "op": "delete"}]

        self._write(prepare, "delete by key")

    def begin(self) -> "Transaction":
        return Transaction(self)

    # bulk

    def insert_rows(self, rows: DataFrame, ttl_seconds: float | None = None) -> int:
        """Appends a DataFrame (data variant, key string or null) of any size in one commit, or nothing; how many rows.

        All that holds for single inserts holds here: reserved names, the largest record, unique keys and fields, quotas.  Ids
        follow the order of (partition, row).
        """
        self._writable()
        # Written once, so that checking, counting and numbering see the same rows whatever made them
        part = rows.select("data", "key", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
        staged = self.storage.write(part, folder="staged")
        try:
            given = self.spark.read.schema("data variant, key string, p int, m long").parquet(self.storage.at(staged))
            self._check_rows(given)
            given = given.withColumn("data", F.when(F.col("key").isNull(), F.col("data")).otherwise(_with_key("data", "key")))
            sizes = given.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
            total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if not total:
                return 0
            # A row a partition; joined, as there may be very many
            starts = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("start"))
            numbered = given.join(F.broadcast(starts), "p").withColumn("nth", F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1))
            deadline = F.lit(self._deadline(ttl_seconds, None)).cast("long")
            for _ in range(RETRIES):
                base = self._writable()
                self._check_against(given, total, base)
                first = self.reserve(total)
                df = numbered.select(
                    (F.col("nth") + first).cast("long").alias("id"), F.lit("insert").alias("op"), F.lit(dt.datetime.fromtimestamp(self.clock() / 1e9)).alias("ts"), F.lit(1).cast("long").alias("rev"), "data",
                    F.lit(self.policy.epoch if self.policy else 0).cast("long").alias("epoch"), deadline.alias("expires_at"), (F.col("nth") + base.next_seq).cast("long").alias("seq"))
                name = self.storage.write(crypto.seal_rows(df, self.policy, self.name) if self.policy else df)
                try:
                    self.storage.commit(base, [*base.sets, name], first + total, base.next_seq + total, base.log_rows + total, "insert rows")
                    return total
                except Conflict:
                    self.storage.discard(name)
            raise Conflict(f"insert rows: other writers were first {RETRIES} times")
        finally:
            self.storage.discard(staged)

    def _check_rows(self, given: DataFrame) -> None:
        """What holds for each row alone: one pass, the first reason found is raised."""
        own = F.try_variant_get("data", scan.path(scan.KEY), "variant")
        why = F.when(~F.startswith(F.schema_of_variant("data"), F.lit("OBJECT")) | F.col("data").isNull(), "data must be an object")
        why = why.when(own.isNotNull() & ~F.coalesce((F.schema_of_variant(own) == "STRING") & (F.try_variant_get(own, "$", "string") == F.col("key")), F.lit(False)), scan.KEY)
        if self.policy:
            m = F.variant_get("data", "$", "map<string,variant>")
            sealed = lambda k, v: F.coalesce((F.schema_of_variant(v) == "STRING") & F.startswith(F.try_variant_get(v, "$", "string"), F.lit(crypto.MARK)), F.lit(False))
            why = why.when(F.size(F.map_filter(m, sealed)) > 0, crypto.MARK)
            if self.policy.mode == "record":
                why = why.when(F.array_contains(F.map_keys(m), crypto.SECURE), crypto.SECURE)
        why = why.when(F.octet_length(F.to_json("data")) > ndjson.MAX_RECORD, "too large")
        bad = given.select(why.alias("why")).where("why is not null").limit(1).collect()
        if bad and bad[0]["why"] == "too large":
            raise RecordTooLarge(f"a record is at most {ndjson.MAX_RECORD} bytes")
        if bad and bad[0]["why"].startswith("data"):
            raise InvalidArgument(bad[0]["why"])
        if bad:
            raise ReservedField(f"{bad[0]['why']!r} is reserved")
        for f, error in self._unique_fields():
            v = Fields(given, "data")[f] if f != scan.KEY else None
            said = given.where(v.present).select(v.txt.alias("v")) if v else given.where("key is not null").select(F.col("key").alias("v"))
            if not said.groupBy("v").count().where("count > 1").limit(1).isEmpty():
                raise error(f"{f} is repeated in the batch")

    def _unique_fields(self) -> list[tuple[str, type]]:
        fields = [f for f, unique in self.meta().get("indexes", {}).items() if unique and f != scan.KEY]
        return [(scan.KEY, DuplicateKey), *((f, UniqueViolation) for f in fields)]

    def _check_against(self, given: DataFrame, total: int, base: Version) -> None:
        """What depends on the records that are there."""
        now = self._live(base)
        for f, error in self._unique_fields():
            mine, theirs = Fields(given, "data")[f], Fields(now, "data")[f]
            if not given.where(mine.present).select(mine.txt.alias("v")).join(now.where(theirs.present).select(theirs.txt.alias("v")), "v", "left_semi").limit(1).isEmpty():
                raise error(f"{f} is taken")
        self._room(total, base)

    def load_jsonl(self, source: str, key_field: str | None = None) -> int:
        """All objects of an NDJSON file, or none."""
        rows = ndjson.load_objects(self.spark, source, key_field)
        if key_field:
            self.ensure_unique_index(scan.KEY)
        return self.insert_rows(rows.select("data", "key"))

    def import_log(self, source: str) -> int:
        """A folder of log segments as this (empty) collection's log."""
        base = self.storage.version()
        if base.number:
            raise AlreadyExists(f"{self.name} is not empty")
        e = ndjson.numbered(ndjson.read_log(self.spark, source)).select("id", "op", "ts", "rev", "data", "epoch", "expires_at", "seq")
        name = self.storage.write(e)
        top = self.storage.log(Version(1, [name])).agg(F.max("id"), F.max("seq")).first()
        self.storage.commit(base, [name], (top[0] or 0) + 1, (top[1] or 0) + 1, top[1] or 0, "import", [name])
        return top[1] or 0

    def export_jsonl(self, target: str) -> None:
        ndjson.export_objects(self._open(self.live()), target)

    # maintenance

    def expired(self) -> DataFrame:
        from docquarry.plans.log import latest

        return latest(self.log()).where("op <> 'delete' and expires_at > 0").where(F.col("expires_at") <= self.clock())

    def reap(self) -> int:
        """Writes deletes for expired records; how many."""
        base = self._writable()
        gone = self.expired().select("id")
        n = gone.count()
        if n:
            seq = F.lit(base.next_seq)  # one position for all: their ids differ
            df = gone.select("id", F.lit("delete").alias("op"), F.lit(dt.datetime.fromtimestamp(self.clock() / 1e9)).alias("ts"), F.lit(None).cast("long").alias("rev"), F.parse_json(F.lit(None).cast("string")).alias("data"), F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("expires_at"), seq.cast("long").alias("seq"))
            name = self.storage.write(df)
            self.storage.commit(base, [*base.sets, name], base.next_id, base.next_seq + 1, base.log_rows + n, "reap", [*base.changing, name])
        return n

    def compact(self, force: bool = False, threshold: float = 0.3) -> bool:
        """Rewrites the log as the live records' last entries if enough of it is stale; file sets become one."""
        from docquarry.plans.log import latest, visible

        base = self._writable()
        if not base.sets:
            return False
        keep = latest(self.storage.log(base)).where("op <> 'delete'").where(visible(self.clock()))
        n = keep.count()
        if not force and base.log_rows and (base.log_rows - n) / base.log_rows <= threshold:
            return False
        rows = keep.select("id", F.lit("insert").alias("op"), "ts", "rev", "data", "epoch", "expires_at", "seq")
        name = self.storage.write(rows.repartitionByRange("id").sortWithinPartitions("id"), folder="base")
        self.storage.commit(base, [name], base.next_id, base.next_seq, n, "compact", [])
        if self.on_compaction:
            self.on_compaction({"collection": self.name, "before": base.log_rows, "after": n})
        return True

    def vacuum(self, retain_seconds: float = 7 * 86_400) -> int:
        """Deletes what no version of the last ``retain_seconds`` uses; how many file sets."""
        return self.storage.vacuum(retain_seconds)

    def open_writes(self) -> None:
        """Ends being a copy of another collection."""
        v = self.storage.version()
        if v.replica:
            self.storage.commit(v, v.sets, v.next_id, v.next_seq, v.log_rows, "promote", replica=False)

    def migrate_encryption(self, policy: "crypto.Policy | None") -> None:
        """Rewrites every live record under another policy."""
        base = self._writable()
        opened = self._open(self._live(base)).select("id", F.lit("insert").alias("op"), "ts", "rev", "data", F.lit(policy.epoch if policy else 0).cast("long").alias("epoch"), "expires_at", F.lit(base.next_seq).cast("long").alias("seq"))
        name = self.storage.write(crypto.seal_rows(opened, policy, self.name) if policy else opened, folder="base")
        rows = self.storage.log(Version(1, [name])).count()
        self.storage.commit(base, [name], base.next_id, base.next_seq + 1, rows, "migrate encryption", [])
        self.policy = policy
        self.set_meta(key_check=crypto.key_check(self.spark, policy) if policy else None)


def _with_key(data: str, key: str) -> Column:
    """The document with _key set."""
    as_map = F.variant_get(data, "$", "map<string,variant>")
    rest = F.map_filter(as_map, lambda k, _: k != scan.KEY)
    said = F.try_variant_get(F.parse_json(F.to_json(F.struct(F.col(key).alias("k")))), "$.k", "variant")
    return F.parse_json(F.to_json(F.map_concat(rest, F.create_map(F.lit(scan.KEY), said))))


class Transaction:
    """Writes of one collection that are committed together.  Reads don't see them before."""

    def __init__(self, collection: Collection):
        self.c, self.rows, self.done = collection, [], False
        self.began = time.time()

    def _stage(self, **row: Any) -> None:
        if self.done:
            raise InvalidArgument("the transaction has ended")
        self.rows.append(row)

    def insert(self, data: dict, ttl_seconds: float | None = None) -> int:
        row_id = self.c.reserve()  # given now, never again
        self._stage(id=row_id, op="insert", rev=1, data=self.c._checked(data), expires_at=self.c._deadline(ttl_seconds, None))
        return row_id

    def update(self, id: int, data: dict, expected_rev: int | None = None) -> None:
        self._stage(id=id, op="update", data=data, expected=expected_rev)

    def delete(self, id: int) -> None:
        self._stage(id=id, op="delete")

    def commit(self) -> int:
        """All or none; targets must exist (and have the expected rev), and none may be touched after its deletion."""
        staged, self.done = self.rows, True

        def prepare(_, now: DataFrame) -> list[dict]:
            ids = [r["id"] for r in staged if r["op"] != "insert"]
            state = {r["id"]: r.asDict() for r in now.where(F.col("id").isin(ids)).select("id", "key", "rev", "expires_at").collect()} if ids else {}
            out = []
            for r in staged:
                if r["op"] == "insert":
                    state[r["id"]] = {"id": r["id"], "key": None, "rev": 1, "expires_at": r["expires_at"]}
                    out.append(r)
                    continue
                cur = state.get(r["id"])
                if cur is None:
                    raise NotFound(f"no record {r['id']}")
                if r["op"] == "delete":
                    state[r["id"]] = None
                    out.append({"id": r["id"], "op": "delete"})
                    continue
                if r.get("expected") is not None and cur["rev"] != r["expected"]:
                    raise Conflict(f"record {r['id']} has rev {cur['rev']}")
                new = self.c._replace(cur, r["data"], None)
                state[r["id"]] = cur | {"rev": new["rev"]}
                out.append(new)
            return out

        return len(self.c._write(prepare, "transaction"))

    def rollback(self) -> None:
        self.rows, self.done = [], True
