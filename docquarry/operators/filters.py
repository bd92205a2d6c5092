"""Filters: a small tree of field predicates, parsed from JSON or dicts and compiled to one Column.

Every leaf, ``neq`` too, is false where the field is missing.  Two numbers compare as doubles, anything else by
text.  An empty AND is true, an empty OR false; a regular expression that is invalid matches nothing.
"""

from __future__ import annotations

import json
import math
import operator
from dataclasses import dataclass
from functools import reduce
from typing import Any, Union

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.errors import InvalidArgument
from docquarry.functions import regexes
from docquarry.functions.scalars import compare, equal, is_number, literal, text
from docquarry.functions.values import Fields, Value

OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "regex")
_ORDER = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


@dataclass(frozen=True)
class Field:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class And:
    parts: tuple["Filter", ...]


@dataclass(frozen=True)
class Or:
    parts: tuple["Filter", ...]


@dataclass(frozen=True)
class MatchAll:
    pass


Filter = Union[Field, And, Or, MatchAll]


def parse(what: Any, lenient: bool = False) -> Filter:
    """A filter of None, JSON text, {"field", "op", "value"}, {"and": [...]} or {"or": [...]}; "and" wins over "or".

    A string value is read as JSON if it is JSON ("30" is a number, "\\"30\\"" and "x" are strings).
    An unknown op is an error, or eq if ``lenient``, as on the wire.
    """
    if isinstance(what, (Field, And, Or, MatchAll)):
        return what
    if what is None or what == "":
        return MatchAll()
    if isinstance(what, str):
        try:
            what = json.loads(what)
        except ValueError as e:
            raise InvalidArgument(f"filter is no JSON: {e}") from None
    if not isinstance(what, dict):
        raise InvalidArgument(f"filter must be an object: {what!r}")
    for name, kind in (("and", And), ("or", Or)):
        if name in what:
            return kind(tuple(parse(x, lenient) for x in what[name]))
    if "field" not in what:
        return MatchAll()
    op = what.get("op", "eq")
    if op not in OPS:
        if not lenient:
            raise InvalidArgument(f"unknown op {op!r}")
        op = "eq"
    return Field(what["field"], op, literal(what.get("value")))


def fields_of(f: Filter) -> set[str]:
    if isinstance(f, Field):
        return {f.field}
    return set().union(*map(fields_of, f.parts)) if isinstance(f, (And, Or)) else set()


def shape(f: Filter) -> str:
    """The filter's structure without its values, for logs."""
    if isinstance(f, Field):
        return f"{f.field} {f.op} ?"
    if isinstance(f, MatchAll):
        return "*"
    return f"{type(f).__name__.lower()}({', '.join(map(shape, f.parts))})"


def condition(df: DataFrame, what: Any, data: str | None = None) -> Column:
    """The filter, or a Column as it is, as one boolean Column over df."""
    if isinstance(what, Column):
        return what
    names = Fields(df, data)

    def build(f: Filter) -> Column:
        if isinstance(f, And):
            return reduce(operator.and_, map(build, f.parts), F.lit(True)) if f.parts else F.lit(True)
        if isinstance(f, Or):
            return reduce(operator.or_, map(build, f.parts)) if f.parts else F.lit(False)
        if isinstance(f, MatchAll):
            return F.lit(True)
        return leaf(df, names[f.field], f.op, f.value)

    return build(parse(what))


def matches(f: Filter, data: dict | None, spark: SparkSession) -> bool:
    """The filter over one record in plain Python; without data, as in deletes, only the empty one passes."""
    if isinstance(f, (And, Or)):
        return (all if isinstance(f, And) else any)(matches(x, data, spark) for x in f.parts)
    if isinstance(f, MatchAll):
        return True
    if data is None or f.field not in data:
        return False
    v = data[f.field]
    if f.op == "contains":
        return text(f.value) in text(v)
    if f.op == "regex":
        return regexes.found(spark, text(f.value), text(v))
    return f.op in _ORDER and (equal(v, f.value) == (f.op == "eq") if f.op in ("eq", "neq") else _ORDER[f.op](compare(v, f.value), 0))


def leaf(df: DataFrame, v: Value, op: str, want: Any) -> Column:
    """One predicate.  Its test is null only where the field is missing, where ``present`` makes it false."""
    if op == "contains":
        return v.present & F.contains(v.txt, F.lit(text(want)))
    if op == "regex":
        java = regexes.compiled(df.sparkSession, text(want))
        return F.lit(False) if java is None else v.present & v.txt.rlike(java)
    if op not in _ORDER:
        return F.lit(False)
    how = _ORDER[op]
    said = text(want)
    # How a list's or an object's text begins decides the comparison, unless the literal begins so too
    test = how(v.txt if v.outline is None or said.startswith(("[", "map[")) else v.outline, F.lit(said))
    if is_number(want) and v.kind == "number":
        test = how(v.raw, F.lit(_narrow(want)))
    elif is_number(want) and v.kind == "dynamic":
        test = F.when(v.num.isNotNull(), how(v.num, F.lit(float(want)))).otherwise(test)
    return v.present & test


def _narrow(x: Any) -> Any:
    """Whole numbers as integers, so an integer column is compared as it is stored and the scan can filter."""
    x = float(x)
    return int(x) if math.isfinite(x) and x.is_integer() and abs(x) < 2**31 else x


def where(df: DataFrame, what: Any, data: str | None = None) -> DataFrame:
    if not isinstance(what, Column):
        what = parse(what)
        if isinstance(what, MatchAll):
            return df
    return df.where(condition(df, what, data))
