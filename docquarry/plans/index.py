"""Field indexes: for every immutable file set one small Parquet table of (number, text, id), sorted by value.

A set never changes, so its part of an index is built once: at ensure_index() for what is there, and at the next lookup for
sets committed since.  A lookup reads the parts of the pinned version with the value in ``PushedFilters``, so row groups of other
values are skipped; what it finds are candidates, which the live view decides on, as later entries may have replaced theirs.
Each part carries a row count in its folder's commit marker; a part that a writer left unfinished is built again.
"""

from __future__ import annotations

import operator
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.scalars import is_number, text
from docquarry.functions.values import Fields
from docquarry.operators.filters import Field

if TYPE_CHECKING:
    from docquarry.plans.storage import Storage, Version

INDEXED_OPS = ("eq", "gt", "gte", "lt", "lte")
_HOW = {"eq": operator.eq, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


class FieldIndex:
    def __init__(self, storage: "Storage", field: str):
        self.storage, self.field = storage, field
        self.path = f"{storage.path}/index/{field.encode().hex()}"

    def _part(self, name: str) -> str:
        return f"{self.path}/{name.replace('/', '-')}"

    def refresh(self, v: "Version") -> None:
        """Builds the parts that the version's sets lack."""
        files = self.storage.files
        there = set(files.names(self.path))
        for s in v.sets:
            if s.replace("/", "-") not in there:
                log = self.storage.log(v, [s]).where("op <> 'delete'")
                value = Fields(log, "data")[self.field]
                rows = log.where(value.present).select(value.num.alias("num"), value.txt.alias("txt"), "id")
                at = f"{self.path}/.{uuid.uuid4().hex}"  # renamed into place, so a part is there whole or not at all
                rows.repartitionByRange("num", "txt").sortWithinPartitions("num", "txt").write.parquet(at)
                files.move(at, self._part(s))
                files.delete(at)

    def candidates(self, v: "Version", leaf: Field) -> DataFrame:
        """Ids of entries whose value passes the leaf: numbers against a number by value, all else by text."""
        self.refresh(v)
        if not v.sets:
            return self.storage.log(v).select("id")
        rows = self.storage.spark.read.schema("num double, txt string, id long").parquet(*map(self._part, v.sets))
        how, by_text = _HOW[leaf.op], _HOW[leaf.op](F.col("txt"), F.lit(text(leaf.value)))
        if is_number(leaf.value):
            test = how(F.col("num"), F.lit(float(leaf.value))) | (F.col("num").isNull() & by_text)
        else:
            test = by_text
        return rows.where(test).select("id").distinct()

    def drop(self) -> None:
        self.storage.files.delete(self.path)
