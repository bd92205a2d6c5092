"""find: filter, order, page and project one table.

Order ends with ascending id, under descending keys too.  Pages go by offset and limit or by a token that
holds the last row's sort values; a token's predicate is a row comparison that the scan can filter by.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docquarry.errors import InvalidArgument, InvalidPageToken
from docquarry.functions.values import Fields, path
from docquarry.operators.filters import where

KEY = "_key"


@dataclass(frozen=True)
class SortField:
    field: str
    descending: bool = False


def sort_fields(order: Any) -> list[SortField]:
    """From "a", "a:desc", ("a", True), {"field": "a", "desc": True}, SortField or a list of these."""
    if order is None:
        return []
    if isinstance(order, (str, SortField, dict)) or (isinstance(order, tuple) and len(order) == 2 and isinstance(order[1], (bool, str)) and order[1] in (True, False, "asc", "desc")):
        order = [order]
    out = []
    for x in order:
        if isinstance(x, SortField):
            out.append(x)
        elif isinstance(x, dict):
            out.append(SortField(x["field"], bool(x.get("desc", x.get("descending", False)))))
        elif isinstance(x, str):
            name, colon, way = x.rpartition(":")
            if colon and way.lower() in ("asc", "desc"):
                out.append(SortField(name, way.lower() == "desc"))
            elif colon and name and not way:
                raise InvalidArgument(f"order {x!r} lacks a direction")
            else:
                out.append(SortField(x))
        else:
            out.append(SortField(x[0], x[1] in (True, "desc")))
    if any(not s.field for s in out):
        raise InvalidArgument("order by an empty field")
    return out


def encode_token(keys: Sequence[Any], row_id: Any) -> str:
    return base64.urlsafe_b64encode(json.dumps({"k": list(keys), "i": row_id}, separators=(",", ":")).encode()).rstrip(b"=").decode()


def decode_token(token: str, keys: int) -> tuple[list[Any], Any]:
    try:
        got = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        values, row_id = got["k"], got["i"]
    except (ValueError, KeyError, TypeError):
        raise InvalidPageToken("page token can't be read") from None
    if not isinstance(values, list) or len(values) != keys:
        raise InvalidPageToken(f"page token has {len(values) if isinstance(values, list) else 'no'} keys, the order {keys}")
    return values, row_id


def _after(c: Column, value: Any, descending: bool, nulls_high: bool = True) -> tuple[Column, Column]:
    """(strictly after, equal) for one sort expression; null is above every value."""
    if value is None:
        return (c.isNotNull() if descending else F.lit(False)), c.isNull()
    lit = F.lit(value)
    after = (c < lit) if descending else (c > lit) | c.isNull()
    return F.coalesce(after, F.lit(False)) if not isinstance(value, str) else after, c == lit


def _seek(exprs: list[tuple[Column, bool]], values: list[Any]) -> Column:
    out, same = F.lit(False), F.lit(True)
    for (c, descending), v in zip(exprs, values, strict=True):
        after, equal = _after(c, v, descending)
        out, same = out | (same & after), same & equal
    return out


def project(df: DataFrame, fields: Sequence[str] | None, data: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The named top-level fields (unknown ones are left out, _key stays); none named: everything."""
    if not fields:
        return df
    if data is None:
        names = [f for f in dict.fromkeys(fields) if f in df.columns]
        return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, *([KEY] if KEY in df.columns else []), *names])))
    parts = [x for f in dict.fromkeys([*fields, KEY]) for x in (F.try_variant_get(data, path(f), "variant").alias(f),)]
    return df.withColumn(data, F.parse_json(F.to_json(F.struct(*parts))))


@dataclass
class Page:
    rows: DataFrame
    next_token: str | None


def ordered(df: DataFrame, order: Any = None, data: str | None = None, id_col: str | None = "id") -> tuple[list[tuple[Column, bool]], list[Column]]:
    """Sort expressions with their directions, id last; and the same as Spark orders."""
    names, exprs, orders = Fields(df, data), [], []
    for s in sort_fields(order):
        exprs += [(c, s.descending) for c in names[s.field].sort_keys]
        orders += names[s.field].order(s.descending)
    if id_col:
        exprs.append((F.col(id_col), False))
        orders.append(F.col(id_col).asc())
    return exprs, orders


def find(
    df: DataFrame, filter: Any = None, order_by: Any = None, limit: int = 0, offset: int = 0, page_token: str | None = None,
    fields: Sequence[str] | None = None, data: str | None = None, id_col: str | None = "id", observe: Observation | None = None,
) -> DataFrame:
    """Rows that pass the filter; ordered if an order, an offset or a token is given.

    A limit alone takes any rows that pass and stops the scan when it has them.
    """
    if limit < 0 or offset < 0:
        raise InvalidArgument("limit and offset must not be negative")
    if observe is not None:
        df = df.observe(observe, F.count(F.lit(1)).alias("scanned"))
    out = where(df, filter, data)
    if order_by or offset or page_token:
        exprs, orders = ordered(df, order_by, data, id_col)
        if page_token:
            values, row_id = decode_token(page_token, len(exprs) - 1)
            out = out.where(_seek(exprs, [*values, row_id]))
        if orders:
            out = out.orderBy(*orders)
    if offset:
        out = out.offset(offset)
    if limit:
        out = out.limit(limit)
    return project(out, fields, data, keep=[id_col] if id_col and id_col in df.columns and data is None else [])


def find_page(
    df: DataFrame, filter: Any = None, order_by: Any = None, limit: int = 0, page_token: str | None = None, fields: Sequence[str] | None = None,
    data: str | None = None, id_col: str = "id", offset: int = 0,
) -> Page:
    """One page and, if more rows follow an ordered and limited one, the token of the next."""
    rows = find(df, filter, order_by, limit + 1 if limit else 0, offset, page_token, data=data, id_col=id_col)
    token = None
    if limit and (order_by or page_token):
        exprs, _ = ordered(df, order_by, data, id_col)
        rows = rows.persist()  # limit + 1 rows: the token and the page come from one evaluation
        keys = rows.select(*(c.alias(f"k{i}") for i, (c, _) in enumerate(exprs))).collect()  # limit + 1 rows of sort values
        if len(keys) > limit:
            last = [x if not isinstance(x, float) or math.isfinite(x) else str(x) for x in keys[limit - 1]]
            token = encode_token(last[:-1], last[-1])
        rows = rows.limit(limit)
    elif limit:
        rows = rows.limit(limit)
    return Page(project(rows, fields, data, keep=[id_col] if data is None else []), token)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs of this block can be stopped by cancel() with the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
