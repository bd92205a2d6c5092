"""NDJSON: the operation-log format, bulk load of objects, and export.

A log line is {"id", "op", "ts", "rev"?, "data"?, "epoch"?, "expires_at"?, "crc"?}; its checksum is CRC-32C over
little-endian id, op, rev, expiry and epoch where they are not 0, and the data as canonical JSON.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from docquarry.errors import MalformedRecord, RecordTooLarge

ENTRY = "id long, op string, ts timestamp, rev long, data variant, epoch long, expires_at long, crc long"
MAX_RECORD = 16 * 1024 * 1024  # bytes of one encoded record


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = np.array(_table(), dtype=np.uint32)


def crc32c(raws: list[bytes]) -> np.ndarray:
    """CRC-32C (Castagnoli) of many byte strings at once: one step takes the next byte of all that have one."""
    size = np.array([len(r) for r in raws], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    data, begin = np.frombuffer(b"".join(raws), dtype=np.uint8), np.concatenate(([0], np.cumsum(size)[:-1]))[order] if len(raws) else size
    crc = np.full(len(raws), 0xFFFFFFFF, dtype=np.uint32)
    left = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")  # strings longer than each position
    for j, n in enumerate(left.tolist()):
        crc[:n] = _CRC[(crc[:n] ^ data[begin[:n] + j]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


_ESCAPED = {ord(c): f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"}


_SPECIAL = re.compile("[<>&\u2028\u2029]")
_quoted = json.JSONEncoder(ensure_ascii=False).encode


def _string(v: str) -> str:
    text = _quoted(v)
    return text.translate(_ESCAPED) if _SPECIAL.search(text) else text


def _number(v: int | float) -> str:
    x = float(v)
    if x == int(x) and abs(x) < 1e21:
        return ("-0" if str(x)[0] == "-" else "0") if x == 0 else str(int(x))
    text = repr(x)
    if "e" not in text:
        return text
    m, _, e = text.partition("e")
    return f"{m}e{e[0] if e[0] in '+-' else '+'}{e.lstrip('+-').lstrip('0')}"


def _say(v: Any) -> str:
    if isinstance(v, str):
        return _string(v)
    if isinstance(v, dict):
        return "{" + ",".join([f"{_string(str(k))}:{_say(x)}" for k, x in sorted(v.items())]) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_say, v)) + "]"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return _number(v)
    return _quoted(v)


def canonical(data: Any) -> bytes:
    """JSON with sorted keys, no spaces, numbers as doubles in their shortest form, and <, >, & and line separators as escapes."""
    return _say(data).encode()


def covered(entry: dict) -> bytes:
    """What an entry's checksum is of."""
    raw = struct.pack("<Q", entry["id"]) + entry["op"].encode()
    for name in ("rev", "expires_at", "epoch"):
        if entry.get(name):
            raw += struct.pack("<q" if name == "expires_at" else "<Q", entry[name])
    if entry.get("data") is not None:
        raw += canonical(entry["data"])
    return raw


def checksum(entry: dict) -> int:
    return int(crc32c([covered(entry)])[0])


def encode(entry: dict) -> str:
    """One log line with its checksum."""
    out = {k: v for k, v in entry.items() if v is not None and k != "crc" and not (k in ("rev", "epoch", "expires_at") and v == 0)}
    return json.dumps(out | {"crc": checksum(entry)}, separators=(",", ":"), ensure_ascii=False)


def encode_all(entries: Iterable[tuple[int, str, int | None, int | None, str | None]]) -> list[str]:
    """Log lines of (id, op, rev, expires_at, data as JSON without line breaks); their checksums are taken at once."""
    lines, raws = [], []
    for i, op, rev, expires_at, text in entries:  # no entry outlives its turn: many live dicts cost more time in Python's GC than they take to build
        data = json.loads(text) if text else None
        raws.append(covered({"id": i, "op": op, "rev": rev, "expires_at": expires_at, "data": data}))
        rest = (("rev", rev), ("expires_at", expires_at), ("data", None if data is None else text))
        lines.append(f'{{"id":{i},"op":{_quoted(op)}' + "".join([f',"{k}":{v}' for k, v in rest if v]))
    return [f'{line},"crc":{c}}}' for line, c in zip(lines, crc32c(raws).tolist(), strict=True)]


@F.pandas_udf(BooleanType())
def _sound(lines: pd.Series) -> pd.Series:
    """Whether a line's checksum is right; lines without one are accepted."""
    raws, said = [], []
    for line in lines:
        e = json.loads(line)
        raws.append(covered(e))
        said.append(e.get("crc"))
    return pd.Series([not s or s == c for s, c in zip(said, crc32c(raws).tolist(), strict=True)], dtype=bool)


def read_log(spark: SparkSession, path: str, verify: bool = True, torn_tail: bool = True, after: tuple[str, int] | None = None) -> DataFrame:
    """All entries of a folder of segments (or one file) in log order: ENTRY and seq, by file name and line.

    The unterminated last line of the last segment is dropped if ``torn_tail``; any other bad line is an error.
    ``after`` is a position (an entry's seq: file and line) to go on from: segments before it are not read.
    Each segment is one row while it is cut into lines, so segments should stay small (4 MiB as written by the engine).
    """
    files = spark.read.text(path, wholetext=True)
    if after is not None:
        files = files.where(F.col("_metadata.file_name") >= after[0])
    files = files.select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    parts = F.split("value", "\n")
    if torn_tail:
        torn = (F.col("file") == files.agg(F.max("file")).scalar()) & ~F.endswith("value", F.lit("\n"))
        parts = F.when(torn, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    lines = files.select("file", F.posexplode(parts).alias("line", "text"))  # what is of the whole segment is said before this: after it, it would be computed for each line
    if after is not None:
        lines = lines.where((F.col("file") > after[0]) | ((F.col("file") == after[0]) & (F.col("line") > after[1])))
    lines = lines.where("trim(text) <> ''").select("file", "line", "text")
    if verify:
        lines = lines.withColumn("sound", _sound("text")).select(
            "file", "line", F.when(F.col("sound"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("checksum differs: "), F.col("file"), F.lit(":"), F.col("line").cast("string")))).alias("text"))
    got = lines.select("file", "line", F.from_json("text", ENTRY, {"mode": "FAILFAST"}).alias("e"))
    return got.select("e.*", F.struct("file", "line").alias("seq"))


def numbered(entries: DataFrame) -> DataFrame:
    """read_log()'s entries with seq as a number from 1: a file's offset, from the counts of the files before it, and the rank in it."""
    flat = entries.withColumns({"file": F.col("seq.file"), "line": F.col("seq.line")}).drop("seq")
    counts = flat.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    offsets = counts.select("file", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return flat.withColumn("rank", rank).join(offsets, "file").withColumn("seq", (F.col("offset") + F.col("rank")).cast("long")).drop("file", "line", "rank", "offset")


def load_objects(spark: SparkSession, path: str, key_field: str | None = None) -> DataFrame:
    """(data, key) of NDJSON files of objects; blank lines are skipped, the first bad line raises MalformedRecord.

    With key_field every object must hold it as a string.  Files are split among tasks; lines are counted only to tell a bad one's number.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    at = ("file", "block", "m")  # a line's place: row numbers ascend within a block
    text = lines.select(F.regexp_replace("value", "\r$", "").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    rows = text.where("trim(text) <> ''").withColumn("data", F.try_parse_json("text"))
    kind = F.schema_of_variant("data")
    why = F.when(F.col("data").isNull(), "not JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object").when(F.octet_length("text") > MAX_RECORD, "too large")
    why = why.when(F.try_variant_get("data", "$['_key']", "variant").isNotNull(), "reserved field _key") if key_field != "_key" else why
    key = F.lit(None).cast("string")
    if key_field:
        v = F.try_variant_get("data", f"$['{key_field}']", "variant")
        why = why.when(v.isNull() | (F.schema_of_variant(v) != "STRING"), f"{key_field} must be a string")
        key = F.try_variant_get(v, "$", "string")
    bad = rows.select(*at, why.alias("why")).where("why is not null").orderBy(*at).limit(1).collect()
    if bad:
        file, block, m, said = bad[0]
        before = (F.col("block") < block) | ((F.col("block") == block) & (F.col("m") < m))
        raise MalformedRecord(1 + text.where(F.col("file") == file).where(before).count(), said)
    return rows.select("data", key.alias("key"))


def export_objects(live: DataFrame, path: str) -> None:
    """Writes each record's data as one line, in id order inside each file."""
    live.sortWithinPartitions("id").select(F.to_json("data").alias("value")).write.mode("errorifexists").text(path)


def check_size(data: dict) -> None:
    if len(canonical(data)) > MAX_RECORD:
        raise RecordTooLarge(f"a record is at most {MAX_RECORD} bytes")
