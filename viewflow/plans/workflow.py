"""Workflows: a class's or object's views under their names."""

from __future__ import annotations

import posixpath
from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import make_importable
from ..sources import store_rows
from .views import ReuseView, View, checked_options


class Workflow:
    """Views by name: class attributes, inherited ones included, and attributes set on the object.

    ``viewdir`` is where stored views lie, each in a folder of its name beside a note of its definition. ``reuse``
    names views to read from there instead of computing them; a missing one, or one whose definition has changed
    since, raises. Views that several others read are persisted while a view is stored or shown. ``options`` are options
    for all views, or under a view's name with a dot for that one, as ``{"parallel": 8, "counts.stored": True}``; they
    come before those that a view was defined with.
    """

    def __init__(self, spark: SparkSession, viewdir: str = "viewdir", params: dict[str, Any] | None = None, reuse: list[str] = (), required: list[str] = (), options: dict[str, Any] | None = None):
        missing = [p for p in required if p not in (params or {})]
        if missing:
            raise ValueError(f"missing parameters: {', '.join(missing)}")
        self.spark, self.viewdir, self.params = make_importable(spark), viewdir.rstrip("/"), dict(params or {})
        self._reuse = {self._name_of(x) for x in reuse}
        self._options: dict[str, Any] = {}
        self.set_options(options or {})

    def set_options(self, given: dict[str, Any]) -> None:
        for key in given:
            name, _, option = key.rpartition(".")
            checked_options({option: None})
            if name:
                self.definition(name)
        self._options |= given

    def settings(self, view: View) -> dict[str, Any]:
        """A view's options: its own, those given for all, those given for its name."""
        name = self.name(view)
        every = {k: v for k, v in self._options.items() if "." not in k and (name or k == "parallel") and view.inputs}
        return {**view.settings, **every, **{k.rpartition(".")[2]: v for k, v in self._options.items() if name and k.rpartition(".")[0] == name}}

    @staticmethod
    def _name_of(given: str) -> str:
        return posixpath.basename(given.rstrip("/")).split(".")[0]

    def views(self) -> dict[str, View]:
        found = {}
        for c in reversed(type(self).__mro__):
            found |= {k: v for k, v in vars(c).items() if isinstance(v, View)}
        return found | {k: v for k, v in vars(self).items() if isinstance(v, View)}

    def definition(self, name: str) -> View:
        views = self.views()
        if name not in views:
            raise KeyError(f"no view {name}; there are {', '.join(sorted(views)) or 'none'}")
        return views[name]

    def path(self, name: str) -> str:
        return self.settings(self.definition(name)).get("stored_at") or f"{self.viewdir}/{name}"

    def name(self, view: View) -> str | None:
        return next((k for k, v in self.views().items() if v is view), None)

    def _walk(self, view: View) -> Iterator[View]:
        seen: set[int] = set()

        def go(v: View) -> Iterator[View]:
            if id(v) in seen:
                return
            seen.add(id(v))
            if not (self.name(v) in self._reuse and v is not view):
                for p in v.parents():
                    yield from go(p)
            yield v

        yield from go(view)

    def view(self, name: str) -> DataFrame:
        """The named view's DataFrame."""
        return self._frame(name, persist=False)[0]

    def _frame(self, name: str, persist: bool) -> tuple[DataFrame, list[DataFrame]]:
        top = self.definition(name)
        made: dict[int, DataFrame] = {}
        uses = Counter(id(p) for v in self._walk(top) for p in v.parents() if not (self.name(v) in self._reuse and v is not top))
        held = []
        for v in self._walk(top):
            own = name if v is top else self.name(v)
            if own in self._reuse:
                made[id(v)] = self._stored(own, v)
                continue
            df = v.frame(self.spark, made, self.settings)
            if v is not top and own and self.settings(v).get("stored"):
                made[id(v)] = self._write(own, v, df)
            elif persist and uses[id(v)] > 1 and v.inputs and not self.settings(v).get("cached"):
                made[id(v)] = df.persist(StorageLevel.MEMORY_AND_DISK)
                held.append(made[id(v)])
        return made[id(top)], held

    def _stored(self, name: str, view: View) -> DataFrame:
        note = self.spark.read.text(f"{self.path(name)}.definition").first()
        if note is None or note.value != view.lineage():
            raise ValueError(f"stored view {name} comes from another definition; store it again")
        return ReuseView(self.path(name)).frame(self.spark)

    def _write(self, name: str, view: View, df: DataFrame) -> DataFrame:
        out = store_rows(df, self.path(name), self.settings(view).get("compression", "zstd"))
        self.spark.range(1).select(F.lit(view.lineage()).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path(name)}.definition")
        return out

    def store(self, name: str) -> DataFrame:
        """Compute a view, write it under its name, and return it as stored."""
        df, held = self._frame(name, persist=True)
        try:
            return self._write(name, self.definition(name), df)
        finally:
            for x in held:
                x.unpersist()

    def cat(self, name: str) -> Iterator[str]:
        """Store a view and go through its rows as text."""
        for row in self.store(name).toLocalIterator():
            yield str(row[0]) if len(row) == 1 else str(tuple(row))

    def list(self) -> list[str]:
        """Names and definitions."""
        return [f"{k} = {v!r}" for k, v in sorted(self.views().items())]

    def pprint(self, name: str) -> str:
        """The views below a view, one a line, deeper ones further in; * marks side views, ... those shown before."""
        lines, seen = [], set()

        def show(v: View, depth: int, mark: str) -> None:
            own = self.name(v)
            lines.append(f"{'| ' * depth}{mark}{own + ' = ' if own else ''}{v!r}{' ...' if id(v) in seen and v.parents() else ''}")
            if id(v) not in seen:
                seen.add(id(v))
                for p in v.inputs:
                    show(p, depth + 1, "")
                for p in v.sides:
                    show(p, depth + 1, "*")

        show(self.definition(name), 0, "")
        return "\n".join(lines)

    def steps(self, name: str) -> list[str]:
        """What storing a view does, in order."""
        top, out = self.definition(name), []
        uses = Counter(id(p) for v in self._walk(top) for p in v.parents())
        for v in self._walk(top):
            own = name if v is top else self.name(v) or v.kind
            if own in self._reuse:
                out.append(f"reuse {own} from {self.path(own)}")
            elif v is top or (self.name(v) and self.settings(v).get("stored")):
                out.append(f"store {own} at {self.path(own)}")
            else:
                out.append(f"{'persist' if uses[id(v)] > 1 and v.inputs else 'define'} {own}")
        return out

    def tasks(self, name: str) -> list[str]:
        """The shuffles of a view's plan, and what is fused between them."""
        text = self.view(name)._jdf.queryExecution().executedPlan().toString()
        return [x.strip(" +-:*") for x in text.splitlines() if "Exchange" in x] or ["no shuffle"]

    def plan(self, name: str) -> str:
        """Spark's formatted plan."""
        return self.view(name)._sc._jvm.PythonSQLUtils.explainString(self.view(name)._jdf.queryExecution(), "formatted")

    def report(self) -> dict[str, Any]:
        """Stages that are active now, from Spark's status tracker."""
        tracker = self.spark.sparkContext.statusTracker()
        infos = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return {"jobs": list(tracker.getActiveJobsIds()), "stages": [{"name": i.name, "tasks": i.numTasks, "done": i.numCompletedTasks, "failed": i.numFailedTasks} for i in infos if i]}

    def main(self, argv: list[str] | None = None) -> int:
        from .cli import run

        return run(self, argv)
