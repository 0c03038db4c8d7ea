"""Headers that only a whole YAML parser reads; the others never leave the JVM."""

from __future__ import annotations

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

_VALUE = pa.struct([("type", pa.string()), ("str", pa.string()), ("items", pa.list_(pa.string()))])
_READ = pa.struct([("problem", pa.string()), ("entries", pa.list_(pa.struct([("k", pa.string()), ("v", _VALUE)])))])
_TYPE = f"struct<problem:string,entries:{X.ENTRIES}>"

_PLAIN = r"(?:[A-Za-z](?:[A-Za-z0-9_./()+-]| (?=\S))*|[1-9][0-9]{0,17}|0|[1-9][0-9]{0,5}\.[0-9]{1,6}|0\.[1-9][0-9]{0,5}|\"[^\"\\]*\"|'[^'\\]*')"
_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])"
_KEY = r"(?!(?i:yes|no|on|off|true|false|null)[ ]*:)[A-Za-z_][A-Za-z0-9_]*(?:[ -][A-Za-z0-9_]+)*"
_FLOW = rf"\[(?:{_PLAIN}(?:, ?{_PLAIN})*)?\]"
#: A line that reads alike as a flat mapping's.
FLAT_LINE = rf"(?d)\A(?:{_KEY}:(?:[ ]+(?:{_PLAIN}|{_DATE}|{_FLOW}))?[ ]*|[ ]*)\z"
#: A key with a block list of plain items, all as far in as the first.
LIST_BLOCK = rf"(?md)^({_KEY}:)[ ]*\n([ ]*)-[ ]+{_PLAIN}[ ]*+(?:\n\2-[ ]+{_PLAIN}[ ]*+(?=\n|\z))*+(?=\n|\z)"


def flat(front: Column) -> Column:
    """Whether every line of a header is a key with a plain value, or belongs to a list of plain items; no key may repeat."""
    lines = F.split(F.regexp_replace(front, LIST_BLOCK, "$1 x"), "\n")
    keys = X.all_matches(front, X.ENTRY, 1)
    return F.forall(lines, lambda line: line.rlike(FLAT_LINE)) & (F.size(F.array_distinct(keys)) == F.size(keys))


def _value(v) -> dict:
    items = [str(x) for x in v] if isinstance(v, list) else None
    return {"type": type(v).__name__, "str": str(v), "items": items}


def read_header(front: str) -> dict:
    """A header's entries in order, none where it is no mapping; or the problem that keeps it from being read."""
    try:
        found = yaml.safe_load(front)
        pairs = [{"k": str(k), "v": _value(v)} for k, v in found.items()] if isinstance(found, dict) else []
        return {"problem": None, "entries": pairs}
    except (yaml.YAMLError, ValueError, TypeError, RecursionError) as e:
        return {"problem": f"header: {type(e).__name__}", "entries": None}


def _read(fronts: pa.Array) -> pa.Array:
    return pa.array([None if f is None else read_header(f) for f in fronts.to_pylist()], _READ)


def whole(front: Column) -> Column:
    """``(problem, entries)`` of a header, null where it is null; batches of headers alone go to Python."""
    return F.arrow_udf(_read, _TYPE)(front)
