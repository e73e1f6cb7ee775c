"""Recursive JSON rewriting on Arrow batches: the one helper that is not built in.

Built-in functions cannot rewrite JSON of unknown depth, so these functions read a text
column batch by batch. Text that is no JSON, or is nested deeper than the parser's own
limit of some thousand levels, gives null; ``leaves.unparsed`` gives records of both kinds.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_UNSAFE = str.maketrans({".": "_", " ": "_", "/": "_"})


def sanitize(x, keys: bool = True, lists: bool = True, scalars: bool = True):
    """Clean keys, lists to index-keyed objects, scalars to text, as chosen."""
    if isinstance(x, dict):
        return {(str(k).translate(_UNSAFE) if keys else k): sanitize(v, keys, lists, scalars) for k, v in x.items()}
    if isinstance(x, list):
        if lists:
            return {str(i): sanitize(v, keys, lists, scalars) for i, v in enumerate(x)}
        return [sanitize(v, keys, lists, scalars) for v in x]
    return x if isinstance(x, str) or not scalars else str(x)


def _dumps(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


#: Levels that the rewriting functions may descend; the parser stops before.
DEEPEST = 50_000


def _rewrite(f: Callable):
    def run(s: pd.Series) -> pd.Series:
        sys.setrecursionlimit(max(DEEPEST, sys.getrecursionlimit()))
        out = []
        for text in s:
            try:
                out.append(None if text is None else _dumps(f(json.loads(text))))
            except (ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")


def sanitize_keys(data: Column | str) -> Column:
    """``.``, space and ``/`` in keys -> ``_``; of keys that become equal the last wins."""
    return _rewrite(lambda x: sanitize(x, True, False, False))(data)


def lists_to_objects(data: Column | str) -> Column:
    """Lists -> objects keyed by index, at every depth."""
    return _rewrite(lambda x: sanitize(x, False, True, False))(data)


def stringify_values(data: Column | str) -> Column:
    """Every scalar as text: ``True``, ``None``, ``12``."""
    return _rewrite(lambda x: sanitize(x, False, False, True))(data)


def normalize_json(data: Column | str) -> Column:
    """N2, N3 and N4 in one pass."""
    return _rewrite(sanitize)(data)


def set_path(data: Column | str, path: str, value: Column) -> Column:
    """``data`` with text ``value`` at a dotted path; objects on the way are made.

    Null data counts as an empty object. What is no object, no JSON or nested too deeply for
    the parser gives null.
    """
    keys = path.split(".")

    def run(s: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for text, value in zip(s, values, strict=True):
            try:
                x = json.loads(text) if text is not None else {}
                if not isinstance(x, dict):
                    out.append(None)
                    continue
                at = x
                for k in keys[:-1]:
                    if not isinstance(at.get(k), dict):
                        at[k] = {}
                    at = at[k]
                at[keys[-1]] = value
                out.append(_dumps(x))
            except (ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(data, value)


def normalize_event(x: dict) -> dict:
    """An event-log record in the shape that rules and search expect."""
    event = dict(x.get("Event") or {})
    system = dict(event.get("System") or {})
    if not isinstance(system.get("EventID"), dict) and system.get("EventID") is not None:
        system["EventID"] = {"#text": system["EventID"]}
    if system.get("Correlation") is None:
        system.pop("Correlation", None)
    event["System"] = system
    data = event.get("EventData")
    if isinstance(data, dict) and isinstance(data.get("Data"), str):
        data = {**data, "DataText": data["Data"]}
        del data["Data"]
        event["EventData"] = data
    created = system.get("TimeCreated") or {}
    when = (created.get("#attributes") or created if isinstance(created, dict) else {}).get("SystemTime")

    def clean(v):
        if isinstance(v, dict):
            out = {}
            for k, y in v.items():
                if y is None:
                    continue
                if k == "#attributes" and isinstance(y, dict):
                    out |= {f"@{a}".replace(".", "_"): clean(b) for a, b in y.items() if b is not None}
                elif k == "#text" and isinstance(y, list):
                    out["#text"] = "\n".join(map(str, y))
                else:
                    out[k.replace(".", "_")] = clean(y)
            return out
        return [clean(y) for y in v] if isinstance(v, list) else v

    return {"@timestamp": when or "1700-01-01T00:00:00", "Event": clean(event)}


def flatten_event(x: dict) -> dict[str, str]:
    """One level of text: System un-prefixed, EventData under ``Data.``."""
    out: dict[str, str] = {}

    def walk(v, path: str) -> None:
        if isinstance(v, dict):
            for k, y in v.items():
                if k == "#attributes" and isinstance(y, dict):
                    walk(y, path)
                elif k == "#text" and isinstance(y, list):
                    out.update({f"{path}{i}": str(t) for i, t in enumerate(y)})
                elif k == "#text":
                    walk(y, path)
                else:
                    walk(y, f"{path}.{k}" if path else k)
        elif isinstance(v, list):
            for i, y in enumerate(v):
                walk(y, f"{path}{i}")
        else:
            out[path] = str(v)

    event = x.get("Event") or {}
    walk(event.get("System") or {}, "")
    for name, part in event.items():
        if name != "System":
            walk(part, "Data" if name == "EventData" else name)
    return out


def normalize_evtx_json(data: Column | str) -> Column:
    return _rewrite(normalize_event)(data)


def flatten_event_map(data: Column | str) -> Column:
    return F.from_json(_rewrite(flatten_event)(data), "map<string,string>")
