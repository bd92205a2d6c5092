"""The engine's operators as queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from docquarry.operators.aggregate import aggregate
from docquarry.operators.filters import where
from docquarry.operators.scan import decode_token, find, find_page
from docquarry.plans.database import Database
from docquarry.plans.log import live
from docquarry.sources import ndjson
from docquarry.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{os.path.join(tempfile.gettempdir(), 'docquarry-scratch')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def positions(df: DataFrame) -> DataFrame:
    """An ordered result with each row's position: partitions are in order, so a row's is its rank after the rows of those before."""
    spark, place = df.sparkSession, scratch(df.sparkSession)
    df.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("m")).write.parquet(place)  # one sort, whose partitions then stay
    rows = spark.read.schema(StructType([*df.schema.fields]).add("p", IntegerType()).add("m", LongType())).parquet(place)
    sizes = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("start"))  # a row a partition
    return rows.join(F.broadcast(starts), "p").withColumn("pos", F.col("start") + F.col("m") + 1).drop("p", "m", "start")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _filter(name: str, table: str, what, sql: str, columns: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return where(_t(spark, sf, table), what).select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}")(run)


_O, _L = ("o_orderkey", "o_custkey", "o_totalprice"), ("l_orderkey", "l_linenumber", "l_quantity")
#: An integer from 1 as text: scientific from a million on.
_NUMBER = "CASE WHEN o_orderkey < 1000000 THEN CAST(o_orderkey AS VARCHAR) ELSE regexp_replace(left(rtrim(CAST(o_orderkey AS VARCHAR), '0'), 1) || '.' || substr(rtrim(CAST(o_orderkey AS VARCHAR), '0'), 2), '\\.$', '') || 'e+' || lpad(CAST(length(CAST(o_orderkey AS VARCHAR)) - 1 AS VARCHAR), 2, '0') END"
_leaf = lambda f, op, v: {"field": f, "op": op, "value": v}
_filter("filter_eq", "orders", _leaf("o_orderstatus", "eq", "O"), "o_orderstatus = 'O'", _O)
_filter("filter_eq_number", "lineitem", _leaf("l_quantity", "eq", "25"), "l_quantity = 25", _L)
_filter("filter_neq", "orders", _leaf("o_orderstatus", "neq", "O"), "o_orderstatus <> 'O'", _O)
_filter("filter_gt", "orders", _leaf("o_totalprice", "gt", 150000), "o_totalprice > 150000", _O)
_filter("filter_gte", "lineitem", _leaf("l_quantity", "gte", 45), "l_quantity >= 45", _L)
_filter("filter_lt", "lineitem", _leaf("l_quantity", "lt", 3), "l_quantity < 3", _L)
_filter("filter_lte", "orders", _leaf("o_orderkey", "lte", 100), "o_orderkey <= 100", _O)
_filter("filter_gt_text", "orders", _leaf("o_orderpriority", "gt", "3"), "o_orderpriority > '3'", _O)
_filter("filter_contains", "part", _leaf("p_name", "contains", "e"), "contains(p_name, 'e')", ("p_partkey", "p_name"))
_filter("filter_contains_number", "orders", _leaf("o_orderkey", "contains", "77"), f"contains({_NUMBER}, '77')", _O)
_filter("filter_regex", "customer", _leaf("c_name", "regex", "0[1-4]$"), "regexp_matches(c_name, '0[1-4]$')", ("c_custkey", "c_name"))
_filter("filter_regex_invalid", "customer", _leaf("c_name", "regex", "(unclosed"), "false", ("c_custkey", "c_name"))
_filter("filter_missing_field", "customer", _leaf("no_such_field", "neq", "x"), "false", ("c_custkey", "c_name"))
_filter("filter_and", "orders", {"and": [_leaf("o_orderstatus", "eq", "F"), _leaf("o_totalprice", "lt", 50000)]}, "o_orderstatus = 'F' AND o_totalprice < 50000", _O)
_filter("filter_or", "orders", {"or": [_leaf("o_orderstatus", "eq", "P"), _leaf("o_totalprice", "gt", 300000)]}, "o_orderstatus = 'P' OR o_totalprice > 300000", _O)
_filter("filter_nested", "orders", {"and": [{"or": [_leaf("o_orderstatus", "eq", "P"), _leaf("o_orderstatus", "eq", "F")]}, {"or": [_leaf("o_totalprice", "gt", 200000), {"and": [_leaf("o_totalprice", "lt", 20000), _leaf("o_orderkey", "gte", 50)]}]}]},
        "(o_orderstatus IN ('P', 'F')) AND (o_totalprice > 200000 OR (o_totalprice < 20000 AND o_orderkey >= 50))", _O)
_filter("filter_empty_and", "nation", {"and": []}, "true", ("n_nationkey", "n_name"))
_filter("filter_empty_or", "nation", {"or": []}, "false", ("n_nationkey", "n_name"))
_filter("filter_match_all", "nation", None, "true", ("n_nationkey", "n_name"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as documents: id and their props as VARIANT, with three more kinds of value for ``k``."""
    e = _t(spark, sf, "events")
    data = F.when(F.col("event_id") % 7 == 0, F.lit("{}")).when(F.col("event_id") % 7 == 1, F.lit('{"k": null}')).when(F.col("event_id") % 7 == 2, F.regexp_replace("props", "([0-9]+)", '"$1"')).otherwise(F.col("props"))
    return e.select(F.col("event_id").alias("id"), F.parse_json(data).alias("data"))


_DOCS = "(SELECT event_id AS id, event_id % 7 AS kind, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


@query(f"SELECT id FROM {_DOCS} WHERE kind NOT IN (0, 1) AND k = 42")
def document_eq(spark, sf):
    """Numbers and numeric strings are equal to a number by value and by text."""
    return where(_events(spark, sf), _leaf("k", "eq", 42), "data").select("id")


@query(f"SELECT id FROM {_DOCS} WHERE kind <> 0 AND (kind = 1 OR k <> 42)")
def document_neq(spark, sf):
    """A missing field is not unequal; null is."""
    return where(_events(spark, sf), _leaf("k", "neq", 42), "data").select("id")


@query(f"SELECT id FROM {_DOCS} WHERE (kind > 2 AND k >= 50) OR kind = 1 OR (kind = 2 AND CAST(CAST(k AS BIGINT) AS VARCHAR) >= '50')")
def document_gte(spark, sf):
    """Strings and null compare by text."""
    return where(_events(spark, sf), _leaf("k", "gte", 50), "data").select("id")


@query(f"SELECT CASE WHEN kind < 2 THEN 'null' WHEN kind = 2 THEN 'string' ELSE 'number' END AS kind, CASE WHEN kind < 2 THEN NULL ELSE CAST(CAST(k AS BIGINT) AS VARCHAR) END AS said, count(*) AS n FROM {_DOCS} GROUP BY ALL")
def document_group(spark, sf):
    """A number and its string are two groups, null and missing one."""
    g = aggregate(_events(spark, sf), group_by="k", data="data")
    kind = F.schema_of_variant("key")
    return g.select(F.when(kind.isNull() | (kind == "VOID"), "null").when(kind == "STRING", "string").otherwise("number").alias("kind"), F.try_variant_get("key", "$", "string").alias("said"), F.col("count").alias("n"))


@query(f"SELECT id, row_number() OVER (ORDER BY c DESC, n DESC NULLS FIRST, t DESC NULLS FIRST, id) AS pos FROM (SELECT id, CASE WHEN kind > 2 THEN 0 ELSE 1 END AS c, CASE WHEN kind > 2 THEN k END AS n, CASE WHEN kind < 2 THEN '<nil>' WHEN kind = 2 THEN CAST(CAST(k AS BIGINT) AS VARCHAR) END AS t FROM {_DOCS})")
def document_sort(spark, sf):
    """Numbers, strings, null and missing values in one total order."""
    return positions(find(_events(spark, sf), order_by="k:desc", data="data").select("id"))


@query("SELECT c_custkey, c_name FROM customer")
def projection(spark, sf):
    return find(_t(spark, sf, "customer"), fields=["c_name", "no_such_field"], id_col="c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def flagship(spark, sf):
    return find(_t(spark, sf, "orders"), {"and": [_leaf("o_orderstatus", "eq", "O"), _leaf("o_totalprice", "gte", 100000)]}, "o_totalprice:desc", 20, fields=["o_totalprice"], id_col="o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos FROM orders")
def sort_single(spark, sf):
    return positions(find(_t(spark, sf, "orders"), order_by="o_custkey", id_col="o_orderkey").select("o_orderkey"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS pos FROM orders")
def sort_multi(spark, sf):
    return positions(find(_t(spark, sf, "orders"), order_by=["o_orderstatus", "o_totalprice:desc"], id_col="o_orderkey").select("o_orderkey"))


@query("SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def sort_full(spark, sf):
    """No limit: a range-partitioned sort of all rows."""
    return find(_t(spark, sf, "orders"), order_by=["o_orderstatus", "o_totalprice:desc"], id_col="o_orderkey").select("o_orderstatus", "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 50")
def topk(spark, sf):
    return find(_t(spark, sf, "orders"), order_by="o_custkey:desc", limit=50, fields=["o_custkey"], id_col="o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25 OFFSET 40")
def limit_offset(spark, sf):
    return find(_t(spark, sf, "orders"), _leaf("o_orderstatus", "eq", "O"), limit=25, offset=40, id_col="o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 30 OFFSET 30")
def keyset_page2(spark, sf):
    o, order = _t(spark, sf, "orders"), ["o_orderpriority:desc", "o_totalprice"]
    first = find_page(o, None, order, 30, id_col="o_orderkey")
    decode_token(first.next_token, 2)
    return find_page(o, None, order, 30, first.next_token, id_col="o_orderkey").rows.select("o_orderkey")


@query("SELECT count(*) AS count FROM lineitem")
def count_all(spark, sf):
    return aggregate(_t(spark, sf, "lineitem"))


@query("SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R'")
def count_filtered(spark, sf):
    return aggregate(_t(spark, sf, "lineitem"), _leaf("l_returnflag", "eq", "R"))


_ROUND = "count(*) AS count, round(sum({0}), 2) AS sum, round(avg({0}), 4) AS avg, min({0}) AS min, max({0}) AS max, count({0}) > 0 AS numeric"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 4)})


_ALL = ("count", "sum", "avg", "min", "max")


@query(f"SELECT {_ROUND.format('l_quantity')} FROM lineitem")
def agg_whole(spark, sf):
    return _rounded(aggregate(_t(spark, sf, "lineitem"), field="l_quantity", aggs=_ALL))


@query(f"SELECT l_returnflag AS key, {_ROUND.format('l_quantity')} FROM lineitem GROUP BY 1")
def agg_group(spark, sf):
    return _rounded(aggregate(_t(spark, sf, "lineitem"), group_by="l_returnflag", field="l_quantity", aggs=_ALL))


@query(f"SELECT l_linenumber AS key, {_ROUND.format('l_quantity')} FROM lineitem WHERE l_shipdate IS NOT NULL AND l_discount > 0.05 GROUP BY 1")
def agg_group_filtered(spark, sf):
    return _rounded(aggregate(_t(spark, sf, "lineitem"), _leaf("l_discount", "gt", 0.05), "l_linenumber", "l_quantity", _ALL))


@query("SELECT o_orderstatus AS key, count(*) AS count, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS avg, 0.0::DOUBLE AS min, 0.0::DOUBLE AS max, false AS numeric FROM orders GROUP BY 1")
def agg_non_numeric(spark, sf):
    return aggregate(_t(spark, sf, "orders"), group_by="o_orderstatus", field="o_orderpriority", aggs=_ALL)


@query("SELECT count(*) AS count, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS avg, 0.0::DOUBLE AS min, 0.0::DOUBLE AS max, false AS numeric FROM orders WHERE false")
def agg_empty(spark, sf):
    return aggregate(_t(spark, sf, "orders"), _leaf("o_orderkey", "lt", -1), field="o_totalprice", aggs=_ALL)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def point_by_id(spark, sf):
    return find(_t(spark, sf, "customer"), _leaf("c_custkey", "eq", 7), id_col="c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 1::BIGINT AS rev FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def point_by_key(spark, sf):
    _, c = _nations(spark, sf)
    got = c.find_by_key(_first(spark, sf))
    return spark.createDataFrame([(got["data"]["n_nationkey"], got["rev"])], "n_nationkey long, rev long")


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every order inserted, every third updated, every fifth deleted, every seventh with a deadline of 1,000."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    o = o.withColumn("top", o.agg(F.max("o_orderkey")).scalar())
    entry = lambda op, rev, nth, price: o.select(
        F.col("o_orderkey").alias("id"), F.lit(op).alias("op"), F.lit(None).cast("timestamp").alias("ts"), F.lit(rev).cast("long").alias("rev"),
        (F.parse_json(F.to_json(F.struct(price.alias("price")))) if price is not None else F.parse_json(F.lit(None).cast("string"))).alias("data"), F.lit(0).cast("long").alias("epoch"),
        F.when(F.col("o_orderkey") % 7 == 0, 1000).otherwise(0).cast("long").alias("expires_at"), (F.col("o_orderkey") + F.lit(nth) * F.col("top")).alias("seq"))
    first = entry("insert", 1, 0, F.col("o_totalprice"))
    second = entry("update", 2, 1, F.col("o_totalprice") + 1).where("id % 3 = 0")
    third = entry("delete", None, 2, None).where("id % 5 = 0")
    return first.unionAll(second).unionAll(third)


_LIVE = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS rev, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS price FROM orders WHERE o_orderkey % 5 <> 0"


def _seen(df: DataFrame) -> DataFrame:
    return df.select("id", "rev", F.round(F.variant_get("data", "$.price", "double"), 2).alias("price"))


@query(f"{_LIVE} AND o_orderkey % 7 <> 0")
def log_resolve(spark, sf):
    return _seen(live(order_log(spark, sf), now=2000))


@query(_LIVE)
def ttl_visible(spark, sf):
    """Before the deadline everything is visible."""
    return _seen(live(order_log(spark, sf), now=999))


@query(f"{_LIVE} AND o_orderkey % 7 <> 0")
def compact(spark, sf):
    db = Database(spark, scratch(spark), clock=lambda: 2000)
    c = db.create("orders")
    log = order_log(spark, sf)
    top = log.agg(F.max("id"), F.max("seq"), F.count(F.lit(1))).first()
    name = c.storage.write(log)
    c.storage.commit(c.storage.version(), [name], top[0] + 1, top[1] + 1, top[2], "load", [name])
    c.compact(force=True)
    return _seen(c.live())


@query("SELECT c_custkey, c_name, 1::BIGINT AS rev FROM customer")
def load_jsonl(spark, sf):
    """Export as NDJSON, load again with a key."""
    where_, c = scratch(spark), _t(spark, sf, "customer")
    c.select(F.to_json(F.struct("c_custkey", "c_name")).alias("value")).coalesce(1).write.text(f"{where_}/in")
    db = Database(spark, f"{where_}/db")
    db.create("customer").load_jsonl(f"{where_}/in", "c_name")
    return db.collection("customer").live().select(F.variant_get("data", "$.c_custkey", "long").alias("c_custkey"), F.col("key").alias("c_name"), "rev")


@query("SELECT c_custkey FROM customer")
def export_round_trip(spark, sf):
    where_ = scratch(spark)
    db = Database(spark, f"{where_}/db")
    c = db.create("customer")
    rows = _t(spark, sf, "customer").select(F.parse_json(F.to_json(F.struct("c_custkey"))).alias("data"), F.lit(None).cast("string").alias("key"))
    c.insert_rows(rows)
    c.export_jsonl(f"{where_}/out")
    return ndjson.load_objects(spark, f"{where_}/out").select(F.variant_get("data", "$.c_custkey", "long").alias("c_custkey"))


def _feed_db(spark: SparkSession, sf: str):
    db = Database(spark, scratch(spark))
    c = db.create("events")
    c.insert_rows(_t(spark, sf, "events").select(F.parse_json(F.to_json(F.struct("event_id", "event_type"))).alias("data"), F.lit(None).cast("string").alias("key")))
    return db, c


@query("SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def watch_filtered(spark, sf):
    """The change feed as a stream, drained into a table."""
    db, c = _feed_db(spark, sf)
    kind = _t(spark, sf, "events").agg(F.min("event_type")).first()[0]
    stream = feed.watch(c, _leaf("event_type", "eq", f'"{kind}"'), from_seq=0).select(F.variant_get("data", "$.event_id", "long").alias("event_id"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{db.root}-feed/state").trigger(availableNow=True).start(f"{db.root}-feed/out").awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{db.root}-feed/out")


@query("SELECT event_id, event_type FROM events")
def replicate_apply(spark, sf):
    """A follower after three rounds of replication, the second with nothing new; it refuses upkeep and writes of its own in between."""
    from docquarry.errors import ReadOnly

    db, c = _feed_db(spark, sf)
    other = Database(spark, scratch(spark), clock=lambda: 2 * 10**18)
    follower = other.follower("events")
    feed.replicate(c, follower)
    feed.replicate(c, follower)
    for write in (follower.reap, lambda: follower.compact(force=True), lambda: follower.insert({})):
        try:
            write()
        except ReadOnly:
            continue
        raise AssertionError("a follower took a write")
    extra = c.insert({"event_id": -1})
    c.delete(extra)
    feed.replicate(c, follower)
    return follower.live().select(F.variant_get("data", "$.event_id", "long").alias("event_id"), F.variant_get("data", "$.event_type", "string").alias("event_type"))


@query("SELECT 'a' AS key, 2::BIGINT AS rev, 10::BIGINT AS n UNION ALL SELECT 'c', 1, 3 UNION ALL SELECT 'd', 2, 41")
def keyed_writes(spark, sf):
    """Keyed insert, upsert, compare-and-swap, delete and a transaction on one small collection."""
    c = Database(spark, scratch(spark)).create("keys")
    c.insert_with_key("a", {"n": 1})
    c.insert_with_key("b", {"n": 2})
    c.upsert("c", {"n": 3})
    c.upsert("a", {"n": 10})
    c.update_if_rev("a", 1, {"n": 99})  # stale
    c.delete_by_key("b")
    d = c.insert_with_key("d", {"n": 4})
    tx = c.begin()
    tx.update(d, {"n": 41})
    tx.commit()
    return c.live().select("key", "rev", F.variant_get("data", "$.n", "long").alias("n"))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) AS n FROM events GROUP BY 1")
def windowed_counts(spark, sf):
    """An extension: hourly counts of events by event time."""
    return _t(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("window_start"), "n")


def _nations(spark: SparkSession, sf: str, name: str = "nation", **settings):
    """A keyed collection of the nations, in one commit."""
    db = Database(spark, scratch(spark), clock=lambda: 10**18)
    c = db.create(name, **settings)
    n = _t(spark, sf, "nation")
    c.insert_rows(n.select(F.parse_json(F.to_json(F.struct("n_nationkey", "n_regionkey"))).alias("data"), F.col("n_name").alias("key")))
    return db, c


def _nation(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("n_name"), "rev", F.variant_get("data", "$.n_regionkey", "long").alias("n_regionkey"))


_N = "SELECT n_name, 1::BIGINT AS rev, n_regionkey::BIGINT AS n_regionkey FROM nation"
_FIRST = "(SELECT min(n_name) FROM nation)"


def _first(spark: SparkSession, sf: str) -> str:
    return _t(spark, sf, "nation").agg(F.min("n_name")).first()[0]


@query(f"SELECT n_name, CASE WHEN n_name = {_FIRST} THEN 2 ELSE 1 END::BIGINT AS rev, CASE WHEN n_name = {_FIRST} THEN 77 ELSE n_regionkey END::BIGINT AS n_regionkey FROM nation UNION ALL SELECT 'new', 1, 78")
def upsert(spark, sf):
    _, c = _nations(spark, sf)
    c.upsert(_first(spark, sf), {"n_regionkey": 77})
    c.upsert("new", {"n_regionkey": 78})
    return _nation(c.live())


@query(f"SELECT n_name, CASE WHEN n_name = {_FIRST} THEN 2 ELSE 1 END::BIGINT AS rev, CASE WHEN n_name = {_FIRST} THEN 90 ELSE n_regionkey END::BIGINT AS n_regionkey FROM nation")
def compare_and_swap(spark, sf):
    """The first swap wins; the second has a stale revision."""
    _, c = _nations(spark, sf)
    c.update_if_rev(_first(spark, sf), 1, {"n_regionkey": 90})
    c.update_if_rev(_first(spark, sf), 1, {"n_regionkey": 91})
    return _nation(c.live())


@query(f"{_N} WHERE n_name <> {_FIRST}")
def delete_by_key(spark, sf):
    _, c = _nations(spark, sf)
    c.delete_by_key(_first(spark, sf))
    return _nation(c.live())


@query(f"SELECT CASE WHEN n_name = {_FIRST} THEN NULL ELSE n_name END AS n_name, CASE WHEN n_name = {_FIRST} THEN 1 ELSE 1 END::BIGINT AS rev, CASE WHEN n_name = {_FIRST} THEN 5 ELSE n_regionkey END::BIGINT AS n_regionkey FROM nation")
def transaction(spark, sf):
    """One commit deletes a record and inserts another; a rolled-back one leaves nothing."""
    _, c = _nations(spark, sf)
    tx = c.begin()
    tx.delete(c.find_by_key(_first(spark, sf))["id"])
    tx.insert({"n_regionkey": 5})
    tx.commit()
    other = c.begin()
    other.insert({"n_regionkey": 6})
    other.rollback()
    return _nation(c.live())


@query(_N)
def snapshot_restore(spark, sf):
    """A restored snapshot doesn't see later writes."""
    db, c = _nations(spark, sf)
    place = scratch(spark)
    db.snapshot(f"{place}/snapshot")
    c.delete_by_key(_first(spark, sf))
    return _nation(Database.restore(spark, f"{place}/snapshot", f"{place}/db").collection("nation").live())


@query("SELECT n_name, 1::BIGINT AS rev, n_regionkey::BIGINT AS n_regionkey FROM nation")
def encrypted_read(spark, sf):
    from docquarry.plans.crypto import Policy

    db = Database(spark, scratch(spark))
    c = db.create("nation")
    c.policy = Policy(bytes(range(32)), fields=frozenset({"n_regionkey"}))
    n = _t(spark, sf, "nation")
    c.insert_rows(n.select(F.parse_json(F.to_json(F.struct("n_nationkey", "n_regionkey"))).alias("data"), F.col("n_name").alias("key")))
    c.migrate_encryption(c.policy.rotated(bytes(range(1, 33))))
    return _nation(c.find())


@query("SELECT count(*) AS reaped, 0::BIGINT AS live FROM nation")
def reap_expired(spark, sf):
    clock = [10**18]
    db = Database(spark, scratch(spark), clock=lambda: clock[0])
    c = db.create("nation", default_ttl_seconds=60)
    n = _t(spark, sf, "nation")
    c.insert_rows(n.select(F.parse_json(F.to_json(F.struct("n_nationkey"))).alias("data"), F.col("n_name").alias("key")))
    clock[0] += 61 * 10**9
    return spark.createDataFrame([(c.reap(), c.count())], "reaped long, live long")


@query("SELECT 'duplicate key' AS refused UNION ALL SELECT 'quota' UNION ALL SELECT 'unique field' UNION ALL SELECT 'reserved field'")
def refused_writes(spark, sf):
    from docquarry import errors

    size = _t(spark, sf, "nation").count()
    _, c = _nations(spark, sf, max_records=size + 1)
    c.ensure_unique_index("code")
    c.insert({"code": "x"})
    out = []
    for name, error, write in (
        ("duplicate key", errors.DuplicateKey, lambda: c.insert_with_key(_first(spark, sf), {})), ("unique field", errors.UniqueViolation, lambda: c.update_by_key(_first(spark, sf), {"code": "x"})),
        ("quota", errors.QuotaExceeded, lambda: c.insert({})), ("reserved field", errors.ReservedField, lambda: c.insert({"_key": "y"}))):
        try:
            write()
        except error:
            out.append((name,))
    return spark.createDataFrame(out, "refused string")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderkey) AS pos FROM orders ORDER BY 2 LIMIT 350")
def keyset_walk(spark, sf):
    """Seven pages by token cover each row once."""
    o, token, rows = _t(spark, sf, "orders"), None, []
    for _ in range(7):
        page = find_page(o, None, "o_orderstatus:desc", 50, token, id_col="o_orderkey")
        rows += [r.o_orderkey for r in page.rows.select("o_orderkey").collect()]
        token = page.next_token
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(rows)], "o_orderkey long, pos long")


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def index_lookup(spark, sf):
    _, c = _nations(spark, sf)
    c.ensure_index("n_regionkey")
    return c.live().join(c.index_lookup("n_regionkey", 1), "id", "left_semi").select(F.col("key").alias("n_name"))


@query("SELECT event_type AS op_type, count(*) AS n FROM events GROUP BY 1")
def changes_since(spark, sf):
    """The feed from a position: only what was committed after it."""
    _, c = _feed_db(spark, sf)
    at = feed.position(c)
    rows = _t(spark, sf, "events").select(F.parse_json(F.to_json(F.struct("event_type"))).alias("data"), F.lit(None).cast("string").alias("key"))
    c.insert_rows(rows)
    return feed.changes(c, at).groupBy(F.variant_get("data", "$.event_type", "string").alias("op_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name FROM nation WHERE n_regionkey >= 1 AND n_regionkey < 3 AND n_name <> (SELECT min(n_name) FROM nation) UNION ALL SELECT 'new'")
def index_range(spark, sf):
    """Range lookups after an update, a delete and an insert, which came after the index was built."""
    _, c = _nations(spark, sf)
    c.ensure_index("n_regionkey")
    c.delete_by_key(_first(spark, sf))
    c.upsert("new", {"n_regionkey": 77})
    c.upsert("new", {"n_regionkey": 2})
    low, high = c.index_lookup("n_regionkey", 1, "gte"), c.index_lookup("n_regionkey", 3, "lt")
    return c.live().join(low, "id", "left_semi").join(high, "id", "left_semi").select(F.col("key").alias("n_name"))


@query("SELECT 'unique field in batch' AS refused UNION ALL SELECT 'unique field taken' UNION ALL SELECT 'reserved field' UNION ALL SELECT 'key taken' UNION ALL SELECT 'key repeated' UNION ALL SELECT 'quota' UNION ALL SELECT 'bytes' "
       "UNION ALL SELECT 'left: ' || (count(*) + 1) FROM nation")
def refused_bulk_writes(spark, sf):
    """Bulk writes are held to what single ones are, and leave nothing when refused."""
    from docquarry import errors

    n = _t(spark, sf, "nation")
    size = n.count()
    _, c = _nations(spark, sf, max_records=2 * size)
    c.ensure_unique_index("code")
    c.insert({"code": "x0"})
    rows = lambda data, key="CAST(NULL AS STRING)": n.select(F.parse_json(F.expr(data)).alias("data"), F.expr(key).alias("key"))
    cases = [
        ("unique field in batch", errors.UniqueViolation, rows("""'{"code": "same"}'""")),
        ("unique field taken", errors.UniqueViolation, rows("""concat('{"code": "x', n_nationkey, '"}')""").limit(1)),
        ("reserved field", errors.ReservedField, rows("""'{"_key": "stolen"}'""").limit(1)),
        ("key taken", errors.DuplicateKey, rows("'{}'", "n_name").limit(1)),
        ("key repeated", errors.DuplicateKey, rows("'{}'", "'one'")),
        ("quota", errors.QuotaExceeded, rows("'{}'")),
    ]
    out = []
    for name, error, df in cases:
        try:
            c.insert_rows(df)
        except error:
            out.append((name,))
    small = Database(spark, scratch(spark)).create("small", max_bytes=1)
    small.insert_rows(rows("'{}'").limit(1))
    try:
        small.insert_rows(rows("'{}'").limit(1))
    except errors.QuotaExceeded:
        out.append(("bytes",))
    out.append((f"left: {c.count()}",))
    return spark.createDataFrame(out, "refused string")


@query("SELECT n_name, n_regionkey::BIGINT AS n_regionkey, row_number() OVER (ORDER BY n_regionkey, n_name) AS pos FROM nation")
def group_order(spark, sf):
    """Groups come in the order of their keys: here each group's rank with its members."""
    n = _t(spark, sf, "nation")
    g = aggregate(n, group_by="n_regionkey").select(F.col("key").cast("long").alias("n_regionkey"), "count")
    ranks = positions(g).withColumn("start", F.sum("count").over(Window.orderBy("pos")) - F.col("count")).select("n_regionkey", "start")
    inside = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    return n.select("n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"), inside.alias("r")).join(ranks, "n_regionkey").select("n_name", "n_regionkey", (F.col("start") + F.col("r")).alias("pos"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def log_file_round_trip(spark, sf):
    """The log as NDJSON segments with checksums, read back with them checked, a torn tail dropped, and resolved."""
    where_ = scratch(spark)
    log = order_log(spark, sf).select("id", "op", "rev", "expires_at", "data", "seq")
    segments = max(4, -(-log.count() // SEGMENT))
    log = log.repartitionByRange(segments, "seq").sortWithinPartitions("seq").withColumn("data", F.to_json("data")).drop("seq")
    log.mapInArrow(_lines, "value string").write.text(f"{where_}/log")
    back = ndjson.numbered(ndjson.read_log(spark, f"{where_}/log"))
    return live(back, now=2000).select(F.col("id").alias("o_orderkey"))


#: Lines of a segment, which are about 4 MiB.
SEGMENT = 40_000


def _lines(batches):
    import pyarrow as pa

    for b in batches:
        entries = zip(*(b.column(c).to_pylist() for c in ("id", "op", "rev", "expires_at", "data")), strict=True)
        yield pa.RecordBatch.from_pydict({"value": pa.array(ndjson.encode_all(entries), pa.string())})


@query("SELECT n_name, CASE WHEN n_regionkey = 0 THEN 2 ELSE 1 END::BIGINT AS rev, CASE WHEN n_regionkey = 0 THEN 100 ELSE n_regionkey END::BIGINT AS n_regionkey FROM nation")
def update_if_match(spark, sf):
    """Each record is replaced if a predicate of its data holds."""
    _, c = _nations(spark, sf)
    for r in _t(spark, sf, "nation").where("n_regionkey < 2").select("n_name").collect():
        c.update_if_match(r.n_name, {"n_regionkey": 100}, lambda d: d["n_regionkey"] == 0)
    return _nation(c.live())


@query("SELECT 'INSERTED' AS op, count(*) AS n FROM nation UNION ALL SELECT 'UPDATED', 1 UNION ALL SELECT 'DELETED', 1")
def feed_of_deletes(spark, sf):
    """Without a filter the feed has deletes too."""
    _, c = _nations(spark, sf)
    c.upsert(_first(spark, sf), {"n_regionkey": 5})
    c.delete_by_key(_first(spark, sf))
    return feed.changes(c).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name FROM nation WHERE length(n_name) > 5 AND n_regionkey < 3")
def filter_open(spark, sf):
    """A Column stands in for a filter, over the document's fields."""
    _, c = _nations(spark, sf)
    return c.find((F.length("key") > 5) & (F.variant_get("data", "$.n_regionkey", "long") < 3)).select(F.col("key").alias("n_name"))
