"""Views: immutable definitions of relations, put together with ``|``, turned into DataFrames on demand."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import partial
from types import BuiltinFunctionType, CodeType, FunctionType, MethodType, ModuleType
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from .. import sources


@dataclass(frozen=True, eq=False)
class View:
    """A relation's definition: what it reads, and how its DataFrame comes from theirs.

    ``inputs`` of None in the first place is an opening that ``left | view`` fills. ``settings`` are per-view options.
    """

    kind: str
    build: Callable[..., DataFrame]
    inputs: tuple[View | None, ...] = ()
    sides: tuple[View, ...] = ()
    about: str = ""
    settings: dict[str, Any] = field(default_factory=dict)

    def __or__(self, right: View) -> View:
        if not right.inputs or right.inputs[0] is not None:
            raise TypeError(f"{right.kind} can't stand to the right of a pipe")
        return replace(right, inputs=(self, *right.inputs[1:]))

    def opts(self, **settings) -> View:
        """With options: stored (bool), stored_at (path), parallel (partitions), cached (bool), compression. Calls add up."""
        return replace(self, settings={**self.settings, **checked_options(settings)})

    def parents(self) -> tuple[View, ...]:
        if any(x is None for x in self.inputs):
            raise ValueError(f"{self.kind} has no input")
        return (*self.inputs, *self.sides)

    def frame(self, spark: SparkSession, made: dict[int, DataFrame] | None = None, settings: Callable[[View], dict] | None = None) -> DataFrame:
        """The view's DataFrame; each view below is built once. ``settings`` tells options that differ from the views' own."""
        made = {} if made is None else made
        if id(self) not in made:
            df = self.build(spark, *[p.frame(spark, made, settings) for p in self.parents()])
            own = settings(self) if settings else self.settings
            if own.get("parallel"):
                df = df.repartition(own["parallel"])
            if own.get("cached"):
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
            made[id(self)] = df
        return made[id(self)]

    def lineage(self) -> str:
        """A digest of the definition, for telling whether a stored relation is still the one defined."""
        return hashlib.sha256("|".join([self.kind, self.about, *[p.lineage() for p in self.parents()]]).encode()).hexdigest()[:16]

    def __repr__(self) -> str:
        return f"{self.kind}({self.about})"


def checked_options(settings: dict[str, Any]) -> dict[str, Any]:
    unknown = settings.keys() - {"stored", "stored_at", "parallel", "cached", "compression"}
    if unknown:
        raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
    return settings


def _about(*parts: Any) -> str:
    return ", ".join(x for x in map(_shown, parts) if x)


def _shown(x: Any, seen: tuple = ()) -> str:
    """A part of a definition as text that changes with what it does: functions by their code, defaults and whatever
    they hold or name from around them, columns by Spark's text, objects by their values."""
    if x is None:
        return ""
    if isinstance(x, str | int | float | bool | bytes):
        return x if isinstance(x, str) else repr(x)
    if id(x) in seen or len(seen) > 8:
        return "..."
    inside = lambda y: _shown(y, (*seen, id(x)))
    if isinstance(x, Column):
        return str(x._jc.toString()) if hasattr(x, "_jc") else str(x)
    if isinstance(x, FunctionType):
        return f"{x.__qualname__}:{_short(_code(x.__code__), inside(x.__defaults__), inside(x.__kwdefaults__), *map(inside, _held(x)))}"
    if isinstance(x, MethodType):
        return f"{inside(x.__self__)}.{inside(x.__func__)}"
    if isinstance(x, partial):
        return inside((x.func, x.args, x.keywords))
    if isinstance(x, dict):
        return f"{{{', '.join(f'{inside(k)}: {inside(v)}' for k, v in x.items())}}}"
    if isinstance(x, list | tuple):
        return f"({', '.join(map(inside, x))})"
    if isinstance(x, set | frozenset):
        return f"({', '.join(sorted(map(inside, x)))})"
    if isinstance(x, type | BuiltinFunctionType | ModuleType) or not hasattr(x, "__dict__"):
        return getattr(x, "__qualname__", None) or getattr(x, "__name__", None) or f"{type(x).__qualname__}({x})"
    return f"{type(x).__qualname__}:{_short(inside(vars(x)))}"


def _code(code: CodeType) -> str:
    consts = [_code(c) if isinstance(c, CodeType) else repr(c) for c in code.co_consts]
    return "|".join([code.co_code.hex(), *map(str, (code.co_names, code.co_varnames, code.co_freevars)), *consts])


def _held(f: FunctionType) -> list:
    """What a function's cells hold, and the globals that it names."""
    cells = []
    for c in f.__closure__ or ():
        try:
            cells.append(c.cell_contents)
        except ValueError:  # not filled yet
            cells.append(None)
    return cells + [f.__globals__[n] for n in f.__code__.co_names if n in f.__globals__]


def _short(*texts: str) -> str:
    return hashlib.sha256("|".join(texts).encode()).hexdigest()[:12]


def _unary(kind: str, fn: Callable[[DataFrame], DataFrame], inner: View | None, *about: Any) -> View:
    return View(kind, lambda _, df: fn(df), (inner,), about=_about(*about))


def ReadLines(*paths: str) -> View:
    return View("ReadLines", lambda s: sources.read_lines(s, *paths), about=_about(*paths))


def ReadCSV(*paths: str, **options) -> View:
    return View("ReadCSV", lambda s: sources.read_csv(s, *paths, **options), about=_about(*paths, *sorted(options.items())))


def ReadBlocks(*paths: str, is_end: Callable[[str], bool] | None = None) -> View:
    return View("ReadBlocks", lambda s: sources.read_blocks(s, *paths, is_end=is_end), about=_about(*paths, is_end))


def ReuseView(path: str) -> View:
    return View("ReuseView", lambda s: sources.reuse(s, path), about=path)


def Table(path: str) -> View:
    """A Parquet table."""
    return View("Table", lambda s: s.read.parquet(path), about=path)


def Wrap(rows: Iterable, schema: str) -> View:
    held = list(rows)
    return View("Wrap", lambda s: sources.from_rows(s, held, schema), about=_about(schema, hashlib.sha256(repr(held).encode()).hexdigest()[:16]))


def ReplaceEach(inner: View | None = None, by=None, schema: str | None = None) -> View:
    return _unary("ReplaceEach", lambda df: ops.replace_each(df, by, schema), inner, by, schema)


def Flatten(inner: View | None = None, by=None, schema: str | None = None, name: str = "value", keep: tuple[str, ...] = ()) -> View:
    return _unary("Flatten", lambda df: ops.flatten(df, by, schema, name, list(keep)), inner, by, schema, name, *keep)


def Filter(inner: View | None = None, by=None) -> View:
    return _unary("Filter", lambda df: ops.filter_rows(df, by), inner, by)


def ReplaceEachPartition(inner: View | None = None, by=None, schema: str = "value string") -> View:
    return _unary("ReplaceEachPartition", lambda df: ops.replace_each_partition(df, by, schema), inner, by, schema)


def Distinct(inner: View | None = None) -> View:
    return _unary("Distinct", ops.distinct, inner)


def Group(inner: View | None = None, by=None, reducing: ops.Reducer | None = None, retaining=None, combining: ops.Reducer | None = None, name: str = "value") -> View:
    return _unary("Group", lambda df: ops.group(df, by, reducing, retaining, combining, name), inner, by, reducing, retaining, name)


def Format(inner: View | None = None, by: Column | None = None) -> View:
    return _unary("Format", lambda df: sources.sinks.formatted(df, by), inner, by)


def Log(inner: View | None = None, logfun=None) -> View:
    return _unary("Log", lambda df: ops.log_rows(df, logfun), inner, logfun)


def LogEchoFirst(inner: View | None = None, first: int = 10) -> View:
    return _unary("LogEchoFirst", lambda df: ops.log_echo_first(df, first), inner, first)


def LogProgress(inner: View | None = None, message: str = "", interval: int = 1000) -> View:
    return _unary("LogProgress", lambda df: ops.log_progress(df, message, interval), inner, message, interval)


@dataclass(frozen=True)
class Jin:
    """A join's input: a view, its key, and whether its unmatched rows stay."""

    view: View
    by: Any = None
    outer: bool = False

    def over(self, df: DataFrame) -> ops.JoinInput:
        return ops.JoinInput(df, self.by, self.outer)


def _jin(x: Jin | View) -> Jin:
    return x if isinstance(x, Jin) else Jin(x)


def Join(*given: Jin | View) -> View:
    jins = [_jin(x) for x in given]
    if len(jins) != 2 and any(j.outer for j in jins):
        raise ValueError("outer joins have two inputs")
    return View("Join", lambda _, *dfs: ops.join(*[j.over(d) for j, d in zip(jins, dfs, strict=True)]), tuple(j.view for j in jins), about=_about(*[x for j in jins for x in (j.by, j.outer)]))


def JoinTo(right: Jin | View, by=None) -> View:
    jin = _jin(right)
    return View("JoinTo", lambda _, left, r: ops.join_to(left, jin.over(r), by), (None, jin.view), about=_about(by, jin.by, jin.outer))


def MapsideJoin(large: Jin, small: Jin, last: list) -> View:
    return View("MapsideJoin", lambda _, a, b: ops.mapside_join(a, b, large.by, small.by, last), (large.view,), (small.view,), _about(large.by, small.by, *last))


def Union(*inners: View) -> View:
    return View("Union", lambda _, *dfs: ops.union(*dfs), inners)


def UnionTo(*more: View) -> View:
    return View("UnionTo", lambda _, *dfs: ops.union(*dfs), (None, *more))


def Augment(inner: View | None = None, sideview: View | None = None, sideviews: Iterable[View] = (), loaded_by: Column | None = None, one_row: bool = False) -> View:
    """``one_row``: the side view's only row stands beside each row; else arrays of the side views' rows do."""
    sides = tuple(sideviews) if sideview is None else (sideview,)
    if not sides or (sideview is not None and tuple(sideviews)):
        raise ValueError("give sideview or sideviews")
    if one_row:
        return View("Augment", lambda _, df, side: ops.sideviews.augment_row(df, side), (inner,), sides, "one row")
    return View("Augment", lambda _, df, *s: ops.augment(df, *s, loaded_by=loaded_by), (inner,), sides, _about(loaded_by))


Map, FlatMap, MapPartitions = ReplaceEach, Flatten, ReplaceEachPartition
col = F.col
