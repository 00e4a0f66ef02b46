"""Declarative feature language compiled to Spark aggregate Columns.

A feature definition is a small JSON tree::

    {"type": "direct", "name": "sum", "key": "value", "title": "total"}
    {"type": "direct", "name": "month", "key": {"type": "direct", "name": "field",
                                                 "key": "ts", "index": "first"}}
    {"type": "predicate", "name": "in", "key": {...}, "in_values": ["a", "b"]}
    {"type": "predicate", "name": "num_unique", "key": {...}}
    {"type": "binary", "left": {...}, "op": ">", "right": 3}

``compile_feature`` turns one definition into ONE aggregate Column that is
evaluated inside a single ``groupBy(...).agg(...)`` — every feature of every
target shares the same shuffle and the same partial (map-side) aggregation.

Semantics per group (documented in the survey, §2.D):

* ``sum std max min skew mean mode log`` treat a null as 0 and ``count``
  counts every element (nulls included);
* ``day year month weekday hour second field isnot`` drop nulls; they yield
  one value per element and the feature is the average of those values,
  0 when nothing is left;
* ``index: first|last`` restricts the group to its first/last element in the
  group order (``min_by``/``max_by`` over an order struct with a unique
  tie-break), a null element then gives null;
* a nested definition applies the outer op to the inner result: a scalar
  inner value is a one-element group (mean(sum)=sum, std=0, count=1), a
  per-element inner result is aggregated element-wise.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import copy
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGG_OPS = ("sum", "std", "max", "min", "skew", "mean", "mode", "count")
ELEM_OPS = ("day", "year", "month", "weekday", "hour", "second", "field", "log", "isnot")
PREDICATES = ("in", "num_unique")
BINARY_OPS = ("=", ">", "<", "!=", "not")

# kinds of value a (sub)feature carries
NUM, TS, STR, BOOL = "num", "ts", "str", "bool"


@dataclass
class _Compiled:
    col: Column
    scalar: bool      # True: one value per group; False: one value per row
    kind: str         # NUM / TS / STR / BOOL


def _kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TS
    if isinstance(dtype, T.StringType):
        return STR
    if isinstance(dtype, T.BooleanType):
        return BOOL
    return NUM


def normalize_spec(spec: dict) -> dict:
    """Lower-case op names, default op ``field``, ``not`` -> ``isnot``."""
    s = copy.deepcopy(spec)
    t = s.get("type", "direct")
    s["type"] = t
    if t in ("direct", "recursive", "predicate"):
        name = s.get("name") or "field"
        name = str(name).lower()
        if name == "not":
            name = "isnot"
        s["name"] = name
        if isinstance(s.get("key"), dict):
            s["key"] = normalize_spec(s["key"])
    elif t == "binary":
        s["left"] = normalize_spec(dict(s["left"], type=s["left"].get("type", "direct")))
    return s


def feature_title(spec: dict) -> str:
    """Output column name; dots are escaped as fullwidth dots (H9)."""
    title = spec.get("title")
    if not title:
        title = _auto_title(spec)
    return str(title).replace(".", "．")


def _auto_title(spec: dict) -> str:
    t = spec.get("type", "direct")
    if t == "binary":
        op = {"=": "eq", ">": "gt", "<": "lt", "!=": "ne", "not": "ne"}[spec["op"]]
        return f"{_auto_title(spec['left'])}_{op}_{spec['right']}"
    name = (spec.get("name") or "field").lower()
    key = spec.get("key")
    inner = _auto_title(key) if isinstance(key, dict) else str(key)
    idx = spec.get("index")
    return f"{name}_{idx + '_' if idx else ''}{inner}"


# ---------------------------------------------------------------- element forms
def _v0(x: Column, kind: str) -> Column:
    """Numeric view of a value with null -> 0 (datetimes as epoch seconds)."""
    if kind == TS:
        x = F.unix_timestamp(x).cast("double")
    elif kind == BOOL:
        x = x.cast("double")
    elif kind == STR:
        x = _decode_bin(x)
    return F.coalesce(x.cast("double"), F.lit(0.0))


def _decode_bin(x: Column) -> Column:
    """'1'+bits code strings decode to their integer, other strings to null."""
    return F.when(x.rlike("^1[01]+$"), F.conv(F.substring(x, 2, 64), 2, 10).cast("double"))


def _elem(op: str, x: Column, kind: str) -> tuple[Column, str]:
    """Per-element value of an element op; null marks a dropped element."""
    if op in ("day", "year", "month", "weekday", "hour", "second"):
        if kind != TS:
            return F.when(x.isNotNull(), F.lit(0.0)), NUM
        fn = {"day": F.dayofmonth, "year": F.year, "month": F.month,
              "weekday": F.weekday, "hour": F.hour, "second": F.second}[op]
        return fn(x).cast("double"), NUM
    if op == "field":
        return x, kind
    if op == "log":
        v = _v0(x, kind)
        return (F.when((v == 0) | (F.abs(v) == F.lit(math.inf)), F.lit(0.0))
                 .when(v < 0, F.lit(math.nan))
                 .otherwise(F.ln(v))), NUM
    if op == "isnot":
        if kind == STR:
            falsy = x == F.lit("")
        elif kind == BOOL:
            falsy = ~x
        elif kind == TS:
            falsy = F.lit(False)
        else:
            falsy = x.cast("double") == F.lit(0.0)
        return F.when(x.isNotNull(), falsy.cast("double")), NUM
    raise ValueError(f"unknown element op {op!r}")


def _numeric(x: Column, kind: str) -> Column:
    if kind == TS:
        return F.unix_timestamp(x).cast("double")
    if kind == STR:
        return _decode_bin(x)
    return x.cast("double")


def _agg(op: str, v0: Column) -> Column:
    if op == "sum":
        return F.sum(v0)
    if op == "std":
        return F.stddev_pop(v0)
    if op == "max":
        return F.max(v0)
    if op == "min":
        return F.min(v0)
    if op == "skew":
        return F.coalesce(F.skewness(v0), F.lit(0.0))
    if op == "mean":
        return F.avg(v0)
    if op == "mode":
        return F.mode(v0, deterministic=True)
    if op == "count":
        return F.count(F.lit(1))
    raise ValueError(f"unknown aggregate op {op!r}")


def _agg_of_one(op: str, v0: Column) -> Column:
    """An aggregate op over a one-element group holding ``v0``."""
    if op in ("sum", "max", "min", "mean", "mode"):
        return v0
    if op in ("std", "skew"):
        return F.lit(0.0)
    if op == "count":
        return F.lit(1.0)
    raise ValueError(f"unknown aggregate op {op!r}")


def _collapse(c: _Compiled) -> Column:
    """Per-element values collapse to their average (0 when none is left)."""
    if c.scalar:
        return _numeric(c.col, c.kind) if c.kind != NUM else c.col
    return F.coalesce(F.avg(_numeric(c.col, c.kind)), F.lit(0.0))


# ---------------------------------------------------------------- compiler
class FeatureCompiler:
    """Compile definitions against a schema and a group order.

    ``order`` is a Column (usually ``struct(ts, id)``) ordering the elements
    of a group; it must be unique within a group for ``first``/``last``.
    ``edges`` -- boolean Columns true on exactly the first / last row of each
    group (e.g. run start/end flags) -- lets ``first``/``last`` pick with a
    fixed-width ``max(when(flag, x))`` instead of ``min_by``/``max_by`` over
    the order struct, so Spark can hash-aggregate.
    """

    def __init__(self, schema: T.StructType, order: Column | None = None,
                 edges: tuple[Column, Column] | None = None):
        self.schema = schema
        self.order = order
        self.edges = edges

    def _field(self, name: str) -> tuple[Column, str]:
        try:
            f = self.schema[name]
        except KeyError as exc:
            raise ValueError(f"feature key {name!r} is not a column") from exc
        return F.col(name), _kind_of(f.dataType)

    def compile(self, spec: dict) -> Column:
        spec = normalize_spec(spec)
        return _collapse(self._compile(spec)).cast("double").alias(feature_title(spec))

    def _compile(self, spec: dict) -> _Compiled:
        t = spec["type"]
        if t in ("direct", "recursive"):
            return self._direct(spec)
        if t == "predicate":
            return self._predicate(spec)
        if t == "binary":
            return self._binary(spec)
        raise ValueError(f"unknown feature type {t!r}")

    def _direct(self, spec: dict) -> _Compiled:
        op = spec["name"]
        if op not in AGG_OPS and op not in ELEM_OPS:
            raise ValueError(f"unknown feature op {op!r}")
        key = spec.get("key")
        if isinstance(key, dict):
            return self._nested(op, self._compile(key))
        x, kind = self._field(key)
        idx = spec.get("index")
        if idx in ("first", "last"):
            if self.edges is not None:
                flag = self.edges[0] if idx == "first" else self.edges[1]
                x1 = F.max(F.when(flag, x))
            elif self.order is None:
                raise ValueError("index first/last needs a group order")
            else:
                pick = F.min_by if idx == "first" else F.max_by
                x1 = pick(x, self.order)
            if op in ELEM_OPS:
                col, k = _elem(op, x1, kind)
                return _Compiled(col, True, k)
            return _Compiled(_agg_of_one(op, _v0(x1, kind)), True, NUM)
        if idx is not None:
            raise ValueError(f"unknown index {idx!r}")
        if op in ELEM_OPS:
            col, k = _elem(op, x, kind)
            return _Compiled(col, False, k)
        return _Compiled(_agg(op, _v0(x, kind)), True, NUM)

    def _nested(self, op: str, inner: _Compiled) -> _Compiled:
        if inner.scalar:
            if op in ELEM_OPS:
                col, k = _elem(op, inner.col, inner.kind)
                return _Compiled(col, True, k)
            return _Compiled(_agg_of_one(op, _v0(inner.col, inner.kind)), True, NUM)
        if op in ELEM_OPS:
            col, k = _elem(op, inner.col, inner.kind)
            # keep dropped elements dropped
            return _Compiled(F.when(inner.col.isNotNull(), col), False, k)
        v = _numeric(inner.col, inner.kind)
        if op == "count":
            return _Compiled(F.count(v), True, NUM)
        if op == "skew":
            return _Compiled(F.coalesce(F.skewness(v), F.lit(0.0)), True, NUM)
        return _Compiled(_agg(op, v), True, NUM)

    def _predicate(self, spec: dict) -> _Compiled:
        op = spec["name"]
        base = self._compile(spec["key"])
        if op == "in":
            values = list(spec.get("in_values") or [])
            if not base.scalar:
                return _Compiled(F.lit(0.0), True, NUM)
            hit = F.coalesce(base.col.isin(values), F.lit(False)) if values else F.lit(False)
            return _Compiled(hit.cast("double"), True, NUM)
        if op == "num_unique":
            if base.scalar:
                return _Compiled(F.lit(1.0), True, NUM)
            n = F.count_distinct(base.col)
            return _Compiled(F.when(n == 0, F.lit(1)).otherwise(n).cast("double"), True, NUM)
        raise ValueError(f"unknown predicate {op!r}")

    def _binary(self, spec: dict) -> _Compiled:
        op = spec["op"]
        if op not in BINARY_OPS:
            raise ValueError(f"unknown binary op {op!r}")
        left = _collapse(self._compile(spec["left"]))
        right = F.lit(spec["right"])
        cmp = {"=": left == right, ">": left > right, "<": left < right,
               "!=": left != right, "not": left != right}[op]
        return _Compiled(F.coalesce(cmp, F.lit(False)).cast("double"), True, NUM)


def compile_features(specs: list[dict], schema: T.StructType,
                     order: Column | None = None,
                     edges: tuple[Column, Column] | None = None) -> list[Column]:
    """Compile many definitions; duplicate titles are computed once."""
    comp = FeatureCompiler(schema, order, edges)
    seen: dict[str, Column] = {}
    for s in specs:
        title = feature_title(normalize_spec(s))
        if title not in seen:
            seen[title] = comp.compile(s)
    return list(seen.values())


class Mergeable(NamedTuple):
    """A feature of a part of a group that can be put together with those of
    other parts: ``partial`` aggregates a part's rows, ``merge`` the partials
    (given an order of the parts), ``final`` makes the feature of the result."""

    title: str
    partial: Column
    merge: Callable[[Column, Column], Column]
    final: Callable[[Column], Column]


def _merge_moments(p: Column, order: Column) -> Column:
    """Count, mean and sum of squared deviations of parts, put together pairwise."""
    def add(a: Column, b: Column) -> Column:
        n = a.n + b.n
        d = b.mean - a.mean
        return F.struct(n.alias("n"), (a.mean + d * b.n / n).alias("mean"), (a.m2 + b.m2 + d * d * a.n * b.n / n).alias("m2"))

    parts = F.collect_list(p)  # of one group: one for each bucket that it reaches into
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), add)


def mergeable_features(specs: list[dict], schema: T.StructType, edges: tuple[Column, Column]) -> list[Mergeable] | None:
    """The features of ``specs`` by parts, or None if one of them needs all rows
    of a group at once. ``edges`` are true on a part's first and last row."""
    comp = FeatureCompiler(schema, edges=edges)
    out: dict[str, Mergeable] = {}
    for s in map(normalize_spec, specs):
        op, idx = s["name"], s.get("index")
        if s["type"] not in ("direct", "recursive") or not isinstance(s.get("key"), str) or op not in AGG_OPS + ELEM_OPS:
            return None
        x, kind = comp._field(s["key"])
        v0 = _v0(x, kind)
        pair = lambda v: F.struct(F.sum(v).alias("s"), F.count(v).alias("n"))
        add = lambda p, o: F.struct(F.sum(p.s).alias("s"), F.sum(p.n).alias("n"))
        if idx in ("first", "last"):
            def final(p, op=op, kind=kind):
                if op in ELEM_OPS:
                    col, k = _elem(op, p.x, kind)
                    return _collapse(_Compiled(col, True, k))
                return _agg_of_one(op, _v0(p.x, kind))
            m = (F.max(F.when(edges[idx == "last"], F.struct(x.alias("x")))),
                 (lambda p, o: F.min_by(p, o)) if idx == "first" else (lambda p, o: F.max_by(p, o)), final)
        elif idx is not None:
            return None
        elif op in ELEM_OPS:
            col, k = _elem(op, x, kind)
            m = pair(_numeric(col, k)), add, lambda p: F.coalesce(p.s / p.n, F.lit(0.0))
        elif op in ("sum", "max", "min"):
            f = {"sum": F.sum, "max": F.max, "min": F.min}[op]
            m = f(v0), lambda p, o, f=f: f(p), lambda p: p
        elif op == "count":
            m = F.count(F.lit(1)), lambda p, o: F.sum(p), lambda p: p
        elif op == "mean":
            m = pair(v0), add, lambda p: p.s / p.n
        elif op == "std":
            n = F.count(v0).cast("double")
            m = (F.struct(n.alias("n"), F.avg(v0).alias("mean"), (F.var_pop(v0) * n).alias("m2")), _merge_moments,
                 lambda p: F.sqrt(p.m2 / p.n))
        else:
            return None
        out.setdefault(feature_title(s), Mergeable(feature_title(s), *m))
    return list(out.values())


def dedupe_specs(specs_by_target: dict[str, list[dict]]) -> dict[str, list[dict]]:
    """Common-feature elimination.

    Features whose title appears under two or more targets move to the
    ``common`` bucket and are computed once; each keeps the list of targets
    that asked for it under ``_targets``.
    """
    owners: dict[str, list[str]] = {}
    first: dict[str, dict] = {}
    for tgt, specs in specs_by_target.items():
        for s in specs:
            title = feature_title(normalize_spec(s))
            owners.setdefault(title, [])
            if tgt not in owners[title]:
                owners[title].append(tgt)
            first.setdefault(title, s)
    out: dict[str, list[dict]] = {t: [] for t in specs_by_target}
    out["common"] = []
    for title, tgts in owners.items():
        spec = dict(first[title], title=first[title].get("title") or title)
        if len(tgts) >= 2:
            out["common"].append(dict(spec, _targets=tgts))
        else:
            out[tgts[0]].append(spec)
    return out


def spec(type: str = "direct", name: str | None = None, key=None, **kw) -> dict:
    """Small constructor for feature definitions."""
    d = {"type": type, "name": name, "key": key}
    d.update(kw)
    return d


def custom_feature_title(fn, title: str | None = None) -> str:
    """A custom feature is named by its title, else by its function's name."""
    return feature_title({"title": title or getattr(fn, "__name__", "custom")})
