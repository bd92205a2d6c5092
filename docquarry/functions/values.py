"""Dynamic values as Catalyst columns: where a field is present, its number, its text and its sort and group keys.

``Fields`` resolves a field name against a DataFrame.  A typed column's kind is known when the plan is
built, so its predicates are plain comparisons that reach the Parquet scan; a document's field is a
VARIANT whose kind is looked at row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.scalars import MISSING
from docquarry.functions.scalars import text as render


def path(field: str) -> str:
    """A JSON path to a top-level key, whatever characters it has (a dot is part of the name)."""
    return f"$['{field}']" if "'" not in field else f'$["{field}"]'


def double_text(x: Column) -> Column:
    """number_text() over a double column."""
    s = F.abs(x).cast("string")
    mantissa, exponent = F.regexp_extract(s, "^([0-9.]+)", 1), F.regexp_extract(s, "E(-?[0-9]+)$", 1)
    whole, part = F.regexp_extract(mantissa, "^([0-9]+)", 1), F.regexp_replace(F.regexp_extract(mantissa, "\\.([0-9]+)$", 1), "0+$", "")
    plain = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    e = exponent.cast("int")
    science = lambda head, tail, e: F.concat(
        head, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail)), F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(e).cast("string"), 2, "0")
    )
    three = F.when(F.length(F.abs(e).cast("string")) > 2, F.concat(F.regexp_replace(plain, "$", ""), F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(e).cast("string")))
    digits = F.regexp_replace(F.concat(F.substring(whole, 2, 400), part), "0+$", "")
    body = (
        F.when(exponent == "", F.when(F.length(whole) > 6, science(F.substring(whole, 1, 1), digits, F.length(whole) - 1)).otherwise(plain))
        .when(e == -4, F.concat(F.lit("0.000"), whole, part))
        .otherwise(F.coalesce(three, science(whole, part, e)))
    )
    negative = (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))
    return (
        F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("+Inf")).when(x == float("-inf"), F.lit("-Inf"))
        .when(negative, F.concat(F.lit("-"), body)).otherwise(body)
    )


@F.pandas_udf(T.StringType())
def _nested_text(s: pd.Series) -> pd.Series:
    import json

    return s.map(lambda x: None if x is None else render(json.loads(x)))


@dataclass(frozen=True)
class Value:
    """One field.  kind: number, string, bool, text (compared by its text) or dynamic."""

    kind: str
    raw: Column
    present: Column
    num: Column | None  # null where the value is no number
    txt: Column  # null where the value is missing
    outline: Column | None = None  # as txt, but of lists and objects only how their text begins: needs no Python

    @property
    def sort_keys(self) -> list[Column]:
        """Numbers first in numeric order, then texts by byte; missing and null as the text <nil>."""
        if self.kind == "number":
            return [self.raw]
        if self.kind == "dynamic":
            return [F.when(self.num.isNull(), 1).otherwise(0), self.num, F.when(self.num.isNull(), F.coalesce(self.txt, F.lit(MISSING)))]
        return [F.coalesce(self.txt, F.lit(MISSING))]

    def order(self, descending: bool = False) -> list[Column]:
        """Sort expressions; a missing number follows all numbers when ascending."""
        one = (lambda c: c.desc_nulls_first()) if descending else (lambda c: c.asc_nulls_last())
        return [one(c) for c in self.sort_keys]

    @property
    def group_keys(self) -> list[Column]:
        """Kind, number and text: 1, "1" and true differ; null and missing are one group."""
        if self.kind == "number":
            return [F.when(self.num.isNull(), "null").otherwise("number"), self.num, F.lit(None).cast("string")]
        if self.kind != "dynamic":
            return [F.when(self.txt.isNull(), "null").otherwise(self.kind), F.lit(None).cast("double"), self.txt]
        tag = F.schema_of_variant(self.raw)
        kind = F.when(self.num.isNotNull(), "number").when(tag.isNull() | (tag == "VOID"), "null").when(tag == "BOOLEAN", "bool").when(tag == "STRING", "string").otherwise("nested")
        return [kind, self.num, F.when(self.num.isNull() & (kind != "null"), self.txt)]


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class Fields:
    """Resolves field names: columns of a typed table, or keys of a VARIANT column ``data``.

    ``data=None``: typed.  A name without a column is a field that every row lacks.
    """

    def __init__(self, df: DataFrame, data: str | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.data = data

    def __getitem__(self, field: str) -> Value:
        return self._key(field) if self.data else self._column(field)

    def _column(self, field: str) -> Value:
        if field not in self.types:
            none = F.lit(None).cast("string")
            return Value("text", none, F.lit(False), None, none)
        kind, c = self.types[field], F.col(f"`{field.replace('`', '``')}`")
        if isinstance(kind, _NUMBERS):
            return Value("number", c, c.isNotNull(), c.cast("double"), double_text(c.cast("double")))
        if isinstance(kind, T.StringType):
            return Value("string", c, c.isNotNull(), None, c)
        if isinstance(kind, T.BooleanType):
            return Value("bool", c, c.isNotNull(), None, c.cast("string"))
        if isinstance(kind, T.VariantType):
            return self._variant(c)
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        return Value("text", c, c.isNotNull(), None, _nested_text(F.to_json(c)) if nested else c.cast("string"))

    def _key(self, field: str) -> Value:
        return self._variant(F.try_variant_get(self.data, path(field), "variant"))

    @staticmethod
    def _variant(v: Column) -> Value:
        tag = F.schema_of_variant(v)
        number = tag.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
        num = F.when(number, F.try_variant_get(v, "$", "double"))
        nested = F.when(tag.rlike("^(ARRAY|OBJECT)"), F.to_json(v))
        scalar = F.when(tag == "VOID", F.lit(MISSING)).when(number, double_text(num)).otherwise(F.try_variant_get(v, "$", "string"))
        outline = F.when(F.startswith(tag, F.lit("ARRAY")), F.lit("[")).when(F.startswith(tag, F.lit("OBJECT")), F.lit("map[")).otherwise(scalar)
        return Value("dynamic", v, v.isNotNull(), num, F.when(nested.isNotNull(), _nested_text(nested)).otherwise(scalar), outline)
