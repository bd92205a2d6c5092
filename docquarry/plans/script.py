"""Scripts: one command a line, ``#`` comments; a failing line is reported and the next one runs."""

from __future__ import annotations

import json
import shlex
from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F

from docquarry.errors import InvalidArgument
from docquarry.plans.database import Database


@dataclass
class Outcome:
    line: int
    command: str
    result: Any = None
    error: Exception | None = None


class Script:
    """State of one script: the database and the collection in use.

    Commands: use, collections, create, drop, insert, find, get, update, delete, count, aggregate, import, export, stats, compact, backup.  Those on a collection take its
    name first unless ``use`` has named one; JSON stands in single quotes.
    """

    def __init__(self, db: Database):
        self.db, self.current = db, None

    def run(self, text: str) -> list[Outcome]:
        out = []
        for n, line in enumerate(text.splitlines(), 1):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            done = Outcome(n, line.strip())
            try:
                done.result = self.command(line)
            except Exception as e:  # noqa: BLE001  errors don't stop a script
                done.error = e
            out.append(done)
        return out

    def command(self, line: str) -> Any:
        name, *args = shlex.split(line)
        name = {"create-collection": "create", "drop-collection": "drop"}.get(name.lower(), name.lower())
        plain = {"use": 1, "collections": 0, "create": 1, "drop": 1, "backup": 1}
        on_collection = {"insert": 1, "find": 0, "get": 1, "update": 2, "delete": 1, "stats": 0, "compact": 0, "count": 0, "aggregate": 1, "import": 1, "export": 1}
        if name in plain:
            if len(args) < plain[name]:
                raise InvalidArgument(f"{name} needs an argument")
            return getattr(self, f"_{name}")(*args[: plain[name]])
        if name not in on_collection:
            raise InvalidArgument(f"unknown command {name!r}")
        if self.current is None or (args and len(args) > on_collection[name] and args[0] in self.db.list()):
            if not args:
                raise InvalidArgument(f"{name} needs a collection")
            collection, *args = args
        else:
            collection = self.current
        if len(args) < on_collection[name]:
            raise InvalidArgument(f"{name} needs {on_collection[name]} arguments")
        return getattr(self, f"_{name}")(self.db.collection(collection), *args)

    def _use(self, name: str) -> None:
        self.current = name

    def _collections(self) -> list[str]:
        return self.db.list()

    def _create(self, name: str) -> str:
        return self.db.create(name).name

    def _drop(self, name: str) -> None:
        self.db.drop(name)

    def _backup(self, target: str) -> dict[str, int]:
        return self.db.snapshot(target)

    def _insert(self, c, data: str) -> int:
        return c.insert(json.loads(data))

    def _find(self, c, filter: str | None = None) -> list[dict]:
        rows = c.find(filter).orderBy("id").select("id", "rev", F.to_json("data").alias("data")).collect()
        return [{"id": r["id"], "rev": r["rev"], "data": json.loads(r["data"])} for r in rows]

    def _get(self, c, id: str) -> dict:
        return c.get(int(id))

    def _update(self, c, id: str, data: str) -> int:
        return c.update(int(id), json.loads(data))

    def _delete(self, c, id: str) -> None:
        c.delete(int(id))

    def _count(self, c, filter: str | None = None) -> int:
        return c.count(filter)

    def _aggregate(self, c, aggs: str, field: str = "", group_by: str = "", filter: str | None = None) -> list[dict]:
        """aggregate count,sum field group-by-field filter; an empty field or group is given as ''."""
        rows = c.aggregate(filter, group_by or None, field or None, tuple(aggs.split(",")))
        if group_by:
            rows = rows.withColumn("key", F.to_json(F.struct(F.col("key").alias("k"))))
        return [r.asDict() | ({"key": json.loads(r["key"]).get("k")} if group_by else {}) for r in rows.collect()]

    def _import(self, c, source: str, key_field: str | None = None) -> int:
        return c.load_jsonl(source, key_field)

    def _export(self, c, target: str) -> None:
        c.export_jsonl(target)

    def _stats(self, c) -> dict:
        return c.stats()

    def _compact(self, c) -> bool:
        return c.compact(force=True)
