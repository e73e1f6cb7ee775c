"""User extensions: parsers of files and modules over tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

PARSERS: dict[str, Callable] = {}


def register_parser(name: str, fn: Callable) -> None:
    """``fn(path, content)`` gives dicts, or ``(None, error)``; it may be a generator."""
    PARSERS[name] = fn


def run_parser(files: DataFrame, name: str) -> DataFrame:
    """Rows of a registered parser over ``files(path, content)``: path, data (JSON), error.

    A file that fails gives one row with its error; rows it gave before stay.
    """
    fn = PARSERS[name]

    def run(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    got = fn(path, bytes(content))
                    if isinstance(got, tuple) and len(got) == 2 and got[0] is None:
                        rows.append((path, None, str(got[1])))
                        continue
                    for r in got:
                        rows.append((path, json.dumps(r, ensure_ascii=False, default=str), None))
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=["path", "data", "error"])
                            rows = []
                except Exception as e:  # noqa: BLE001  a user's parser may raise anything
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "data", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, data string, error string")


@dataclass
class Module:
    name: str
    extract: Callable[..., DataFrame]
    check: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    serialize: Callable[[DataFrame], DataFrame] | None = None


MODULES: dict[str, Module] = {}


def register_module(name: str, extract: Callable, check: Callable | None = None, serialize: Callable | None = None) -> None:
    """A module of three DataFrame functions."""
    MODULES[name] = Module(name, extract, check, serialize)


def run_module(name: str, iocs: DataFrame | None, *tables: DataFrame) -> dict[str, DataFrame]:
    """``results``, and where the module has them ``detected`` and ``timeline``."""
    m = MODULES[name]
    out = {"results": m.extract(*tables)}
    if m.check and iocs is not None:
        out["detected"] = m.check(out["results"], iocs)
    if m.serialize:
        out["timeline"] = m.serialize(out["results"])
    return out
