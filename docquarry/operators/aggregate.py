"""count, sum, avg, min and max over numbers, for all rows or by one field.

Only numeric values take part in sum, avg, min and max; avg divides by how many these are.  Where a group has none, ``numeric``
is false and the four are 0.  Missing and null are one group; 1, "1" and true are three.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.errors import InvalidArgument
from docquarry.functions.values import Fields
from docquarry.operators.filters import where

AGGREGATES = ("count", "sum", "avg", "min", "max")


def aggregate(
    df: DataFrame, filter: Any = None, group_by: str | None = None, field: str | None = None, aggs: Sequence[str] = ("count",),
    data: str | None = None, contract: bool = True,
) -> DataFrame:
    """Columns key (if grouped), count and, with a field, sum, avg, min, max, numeric.

    Groups come in key order.  Without groups there is one row even over no rows; ``contract=False`` gives none then if a field
    is named, as the embedded engine does.
    """
    wrong = [a for a in aggs if a not in AGGREGATES]
    if wrong:
        raise InvalidArgument(f"unknown aggregate {wrong[0]!r}")
    if field is None and set(aggs) - {"count"}:
        raise InvalidArgument(f"{', '.join(sorted(set(aggs) - {'count'}))} needs a field")
    names, rows = Fields(df, data), where(df, filter, data)
    parts = [F.count(F.lit(1)).alias("count")]
    if field is not None:
        num = names[field].num
        num = F.lit(None).cast("double") if num is None else num
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        parts += [zero(F.sum(num)).alias("sum"), zero(F.avg(num)).alias("avg"), zero(F.min(num)).alias("min"), zero(F.max(num)).alias("max"), (F.count(num) > 0).alias("numeric")]
    if group_by is None:
        out = rows.agg(*parts)
        return out if contract or field is None else out.where("count > 0")
    v = names[group_by]
    if v.kind == "dynamic":  # a VARIANT can't be grouped: its kind, number and text are, and one value comes along
        keys = dict(zip(("key_kind", "key_num", "key_text"), v.group_keys, strict=True))
        out = rows.groupBy(*(c.alias(n) for n, c in keys.items())).agg(F.first(v.raw).alias("key"), *parts)
        order = [F.when(F.col("key_kind") == "number", 0).otherwise(1), "key_num", F.coalesce("key_text", F.when(F.col("key_kind") == "null", "<nil>"))]
        return out.orderBy(*order).select("key", *(c for c in out.columns if not c.startswith("key")))
    out = rows.groupBy(v.raw.alias("key")).agg(*parts)
    return out.orderBy(F.col("key").asc_nulls_last() if v.kind == "number" else F.coalesce(F.col("key").cast("string"), F.lit("<nil>")))


def count(df: DataFrame, filter: Any = None, data: str | None = None) -> int:
    return where(df, filter, data).count()
