"""Saved views: filter expressions compiled to Columns, projection, and stable multi-key sort."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# The expression grammar. The order of the alternatives matters: an unquoted
# ``a >= 4`` reads as ``>`` with the value ``= 4``.
EXPRESSION = re.compile(r'^([\w.]+)\s*(==|!=|contains|>|<|>=|<=)\s*"?([^"]*)"?$')
STRICT = re.compile(r'^([\w.]+)\s*(==|!=|contains|>=|<=|>|<)\s*"?([^"]*)"?$')


@dataclass
class View:
    name: str = "Untitled"
    type: str = "table"
    columns: list[str] = field(default_factory=list)
    sort: list[tuple[str, str]] = field(default_factory=list)
    column_sizes: dict[str, float] = field(default_factory=dict)


@dataclass
class Base:
    filters: list[str] = field(default_factory=list)
    logic: str = "and"
    views: list[View] = field(default_factory=list)
    raw: dict[str, Any] = field(default_factory=dict)


def parse_base(text: str) -> Base:
    """A ``.base`` YAML text; a missing mapping under ``filters`` raises TypeError."""
    raw = yaml.safe_load(text) or {}
    base = Base(raw=raw)
    if "filters" in raw:
        given = raw["filters"]
        if not isinstance(given, dict):
            raise TypeError("filters must be a mapping with 'and' or 'or'")
        base.logic = "and" if "and" in given else "or"
        base.filters = [str(f) for f in given.get(base.logic) or []]
    for v in raw.get("views") or []:
        keys = [s for s in v.get("sort") or [] if isinstance(s, dict)]
        sizes = v.get("columnSize") or {}
        base.views.append(
            View(
                v.get("name", "Untitled"),
                v.get("type", "table"),
                list(v.get("order") or []),
                [(s.get("property", ""), s.get("direction", "ASC")) for s in keys],
                {k: n for k, n in sizes.items() if isinstance(n, (int, float))},
            )
        )
    return base


def property_value(name: str) -> Column:
    """A property as ``struct(type, str, items)``; null when missing."""
    def text(c: Column) -> Column:
        return F.struct(F.lit("str").alias("type"), c.alias("str"), F.lit(None).cast("array<string>").alias("items"))

    path = F.col("path")
    if name == "file.folder":
        return text(X.folder(path))
    if name == "file.name":
        return text(X.stem(path))
    if name == "file.path":
        return text(path)
    if name == "file.ext":
        return text(X.extension(path))
    if name in ("file.tags", "tags"):
        shown = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
        return F.struct(F.lit("list").alias("type"), shown.alias("str"), F.col("tags").alias("items"))
    return X.property_of(F.col("fm"), name)


def compile_filter(expression: str, strict: bool = False) -> Column:
    """One expression as a predicate; an unreadable one keeps every row.

    Values compare as strings: with a property that is no string, or missing, ``==`` and the
    orderings are false and ``!=`` is true. ``contains`` ignores case and reads any type.
    """
    m = (STRICT if strict else EXPRESSION).match(expression.strip())
    if not m:
        return F.lit(True)
    name, op, value = m.groups()
    v = property_value(name)
    is_text = v["type"] == "str"
    if op == "contains":
        empty = ((v["type"] == "str") & (v["str"] == "")) | v["type"].isin("NoneType") | (
            v["type"].isin("int", "float") & (v["str"].cast("double") == 0)) | ((v["type"] == "bool") & (v["str"] == "False")) | (
            (v["type"] == "list") & (F.size(v["items"]) == 0))
        return F.coalesce(~empty & F.contains(F.lower(v["str"]), F.lit(value.lower())), F.lit(False))
    if op == "!=":
        return ~F.coalesce(is_text & (v["str"] == value), F.lit(False))
    compare = {"==": v["str"] == value, ">": v["str"] > value, "<": v["str"] < value, ">=": v["str"] >= value, "<=": v["str"] <= value}
    return F.coalesce(is_text & compare[op], F.lit(False))


def predicate(base: Base, strict: bool = False) -> Column:
    parts = [compile_filter(f, strict) for f in base.filters]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if base.logic == "and" else (lambda a, b: a | b), parts)


def column_name(prop: str) -> str:
    return prop.replace(".", "_")


def sort_keys(sort: list[tuple[str, str]], columns: list[str]) -> list[Column]:
    """Sort keys as strings, missing values as ''; keys outside the projection do nothing."""
    keys = []
    for prop, direction in sort:
        if prop in columns:
            key = F.coalesce(F.col(column_name(prop)), F.lit(""))
            keys.append(key.desc() if str(direction).upper() == "DESC" else key.asc())
    return keys


def resolve(base: Base, notes: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of the base's first view over parsed notes: ``_path`` and the view's properties as text.

    Dots in property names become underscores. Equal rows keep the order of their paths.
    """
    view = base.views[0] if base.views else View(columns=["file.name"])
    rows = notes.where(predicate(base, strict))
    chosen = [F.when(property_value(c)["type"] != "NoneType", property_value(c)["str"]).alias(column_name(c)) for c in view.columns]
    return rows.select(F.col("path").alias("_path"), *chosen).orderBy(*sort_keys(view.sort, view.columns), "_path")


_SUMMARY = "path string, name string, n_views int, filters array<string>, logic string, views array<struct<name:string,columns:array<string>>>"


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    views = pa.list_(pa.struct([("name", pa.string()), ("columns", pa.list_(pa.string()))]))
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("n_views", pa.int32()), ("filters", pa.list_(pa.string())), ("logic", pa.string()), ("views", views)])
    for batch in batches:
        rows = []
        for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                b = parse_base(text or "")
            except (TypeError, AttributeError, ValueError, yaml.YAMLError):
                continue
            shown = [{"name": str(v.name), "columns": [str(c) for c in v.columns]} for v in b.views]
            rows.append({"path": path, "name": path.rsplit("/", 1)[-1].removesuffix(".base"), "n_views": len(b.views), "filters": b.filters, "logic": b.logic, "views": shown})
        yield pa.RecordBatch.from_pylist(rows, schema)


def summaries(texts: DataFrame) -> DataFrame:
    """``texts(path, content)`` of bases -> ``(path, name, n_views, filters, logic, views)``; unreadable ones are skipped."""
    return texts.select("path", "content").mapInArrow(_summarised, _SUMMARY)
