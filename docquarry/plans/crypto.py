"""Encryption of fields or whole records at rest, with AES-GCM and the collection and field as associated data.

Field mode seals the named fields; record mode seals all but the named clear fields into one.  Sealed values
can't be filtered, sorted, grouped or indexed, which is refused when the plan is built, and they are opened in the last projection only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.errors import InvalidArgument, OpaqueField, ReservedField
from docquarry.functions.values import path

MARK = "\x00sealed:1:"
SECURE = "secure_data"


def derive(passphrase: str, salt: bytes) -> bytes:
    """A 256-bit key from a passphrase."""
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=2**14, r=8, p=1, dklen=32)


class KeyProvider(Protocol):
    """Where keys come from: the key of an epoch."""

    def key(self, epoch: int) -> bytes: ...


@dataclass(frozen=True)
class Policy:
    """mode "field": ``fields`` are sealed; mode "record": all but ``fields`` and _key are.  ``old`` holds earlier epochs' keys."""

    key: bytes
    mode: str = "field"
    fields: frozenset[str] = frozenset()
    epoch: int = 1
    old: dict[int, bytes] = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in ("field", "record"):
            raise InvalidArgument(f"unknown mode {self.mode!r}")
        if len(self.key) not in (16, 24, 32):
            raise InvalidArgument("the key must have 16, 24 or 32 bytes")
        if self.mode == "field" and not self.fields:
            raise InvalidArgument("field mode needs fields")
        if "_key" in self.fields and self.mode == "field":
            raise InvalidArgument("_key can't be sealed")

    @classmethod
    def of(cls, provider: KeyProvider, epoch: int, mode: str = "field", fields: frozenset[str] = frozenset()) -> "Policy":
        return cls(provider.key(epoch), mode, fields, epoch, {e: provider.key(e) for e in range(1, epoch)})

    def opaque(self, name: str) -> bool:
        return name in self.fields if self.mode == "field" else name not in self.fields and name != "_key"

    def check_open(self, names: set[str]) -> None:
        for n in sorted(names):
            if self.opaque(n):
                raise OpaqueField(f"{n} is encrypted")

    def check_plain(self, data: dict) -> None:
        if self.mode == "record" and SECURE in data:
            raise ReservedField(f"{SECURE} is reserved")
        for k, v in data.items():
            if isinstance(v, str) and v.startswith(MARK):
                raise ReservedField(f"{k} begins with a reserved mark")

    def rotated(self, key: bytes) -> "Policy":
        return Policy(key, self.mode, self.fields, self.epoch + 1, self.old | {self.epoch: self.key})

    def keys(self) -> dict[int, bytes]:
        return self.old | {self.epoch: self.key}


def _bound(collection: str, name: Column) -> Column:
    return F.concat(F.lit(f"{collection}\x1f"), name)


def _seal(v: Column, p: Policy, collection: str, name: Column) -> Column:
    body = F.aes_encrypt(F.to_json(v).cast("binary"), F.lit(p.key), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _bound(collection, name).cast("binary"))
    return F.concat(F.lit(f"{MARK}{p.epoch}:"), F.base64(body))


def _text(s: Column) -> Column:
    """A string column as a VARIANT."""
    return F.try_variant_get(F.parse_json(F.to_json(F.struct(s.alias("s")))), "$.s", "variant")


def seal_rows(df: DataFrame, p: Policy, collection: str) -> DataFrame:
    m = F.variant_get("data", "$", "map<string,variant>")
    if p.mode == "field":
        names = F.array(*(F.lit(f) for f in sorted(p.fields)))
        done = F.transform_values(m, lambda k, v: F.when(F.array_contains(names, k), _text(_seal(v, p, collection, k))).otherwise(v))
    else:
        clear = F.array(*(F.lit(f) for f in sorted(p.fields | {"_key"})))
        hidden = F.parse_json(F.to_json(F.map_filter(m, lambda k, _: ~F.array_contains(clear, k))))
        done = F.map_concat(F.map_filter(m, lambda k, _: F.array_contains(clear, k)), F.create_map(F.lit(SECURE), _text(_seal(hidden, p, collection, F.lit(SECURE)))))
    return df.withColumn("data", F.when(F.col("data").isNotNull(), F.parse_json(F.to_json(done))))


def _opened(s: Column, p: Policy, collection: str, name: Column) -> Column:
    rest = F.substring(s, len(MARK) + 1, 1 << 30)
    epoch, body = F.substring_index(rest, ":", 1), F.unbase64(F.substring_index(rest, ":", -1))
    out = None
    for e, key in p.keys().items():
        said = F.aes_decrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _bound(collection, name).cast("binary")).cast("string")
        out = F.when(epoch == str(e), said) if out is None else out.when(epoch == str(e), said)
    return F.parse_json(out.otherwise(F.raise_error(F.lit("no key for the record's epoch"))))


def open_rows(df: DataFrame, p: Policy, collection: str) -> DataFrame:
    m = F.variant_get("data", "$", "map<string,variant>")
    text = lambda v: F.try_variant_get(v, "$", "string")
    is_sealed = lambda v: (F.schema_of_variant(v) == "STRING") & F.startswith(text(v), F.lit(MARK))
    if p.mode == "field":
        done = F.transform_values(m, lambda k, v: F.when(is_sealed(v), _opened(text(v), p, collection, k)).otherwise(v))
        return df.withColumn("data", F.parse_json(F.to_json(done)))
    v = F.try_variant_get("data", path(SECURE), "variant")
    hidden = F.variant_get(_opened(text(v), p, collection, F.lit(SECURE)), "$", "map<string,variant>")
    done = F.map_concat(F.map_filter(m, lambda k, _: k != SECURE), hidden)
    return df.withColumn("data", F.when(v.isNull(), F.col("data")).otherwise(F.parse_json(F.to_json(done))))


_KNOWN = "docquarry key check"


def key_check(spark: SparkSession, p: Policy) -> str:
    """A known text under the policy's key, to be kept beside the data."""
    return spark.range(1).select(F.base64(F.aes_encrypt(F.lit(_KNOWN).cast("binary"), F.lit(p.key), F.lit("GCM"))).alias("x")).first()["x"]


def key_fits(spark: SparkSession, p: Policy, check: str) -> bool:
    """Whether one of the policy's keys made the check."""
    tried = [F.try_aes_decrypt(F.unbase64(F.lit(check)), F.lit(k), F.lit("GCM")).cast("string") == _KNOWN for k in p.keys().values()]
    return any(spark.range(1).select(*(F.coalesce(t, F.lit(False)).alias(f"k{i}") for i, t in enumerate(tried))).first())
