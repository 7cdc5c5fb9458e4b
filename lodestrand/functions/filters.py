"""Payload filters: `key>=value` text to a condition, on columns or on a JSON payload."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = re.compile(r"^\s*([\w.]+)\s*(>=|<=|>|<|=)\s*(.*?)\s*$", re.S)
_NAMES = {">=": "gte", "<=": "lte", ">": "gt", "<": "lt"}


def parse(filters: list[str]) -> dict[str, object]:
    """{key: value} or {key: {gt/gte/lt/lte: value}}: values are JSON, or else plain text; ranges of one key are put together."""
    out: dict[str, object] = {}
    for f in filters:
        m = _FORM.match(f)
        if not m:
            raise ValueError(f"not a filter: {f!r}")
        key, op, raw = m.groups()
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        if op == "=":
            if key in out:
                raise ValueError(f"{key} is filtered twice")
            out[key] = value
            continue
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{key} {op} needs a number")
        have = out.setdefault(key, {})
        if not isinstance(have, dict) or _NAMES[op] in have:
            raise ValueError(f"{key} is filtered twice")
        have[_NAMES[op]] = value
    return out


def _holds(col: Column, want: object, is_array: bool) -> Column:
    if isinstance(want, dict):
        if not want or set(want) - {"gt", "gte", "lt", "lte", "any", "match"}:
            raise ValueError(f"not a condition: {want}")
        ok = F.lit(True)
        for op, v in want.items():
            if op == "any":
                ok = ok & (F.arrays_overlap(col, F.array(*[F.lit(x) for x in v])) if is_array else col.isin(*v))
            elif op == "match":
                ok = ok & _holds(col, v, is_array)
            else:
                n = col.try_cast("double")
                ok = ok & {"gt": n > v, "gte": n >= v, "lt": n < v, "lte": n <= v}[op]
        return ok
    if isinstance(want, list):
        return F.arrays_overlap(col, F.array(*[F.lit(x) for x in want])) if is_array else col.isin(*want)
    if want is None:
        return col.isNull()
    return F.array_contains(col, want) if is_array else col == F.lit(want)


def condition(filters: dict[str, object], columns: dict[str, Column] | None = None, arrays: tuple[str, ...] = ()) -> Column:
    """All of the filters; what can't be compared is false. Keys are columns unless `columns` says what they stand for. Catalyst pushes it to the scan where the source can take it."""
    ok = F.lit(True)
    for key, want in filters.items():
        col = (columns or {}).get(key, F.col(key))
        if want is None:
            ok = ok & col.isNull()
        else:
            ok = ok & _holds(col, want, key in arrays)
    return ok


def json_condition(filters: dict[str, object], payload: Column) -> Column:
    """The same on the keys of a JSON column."""
    typed = {}
    for key, want in filters.items():
        raw = F.get_json_object(payload, f"$.{key}")
        number = isinstance(want, (int, float)) and not isinstance(want, bool)
        typed[key] = raw.try_cast("double") if number else raw.try_cast("boolean") if isinstance(want, bool) else raw
    return condition({k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in filters.items()}, typed)
