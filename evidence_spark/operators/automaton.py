"""Many patterns in one pass over a text: Aho-Corasick automata, sent to the tasks.

A text is read once, whatever the number of patterns, and gives the patterns it contains.
An automaton is built once in each worker process from a broadcast list of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters of the patterns of one automaton (a node for each at most, about 60 bytes).
AUTOMATON_CHARS = 2_000_000

_BUILT: dict[str, object] = {}


def _automaton(key: str, pairs: Sequence[tuple[str, object]]):
    """The automaton of this process for a list; of lists used before only the last few stay."""
    if key not in _BUILT:
        import ahocorasick

        while len(_BUILT) >= 4:
            _BUILT.pop(next(iter(_BUILT)))
        values: dict[str, list] = {}
        for pattern, value in pairs:
            values.setdefault(pattern, []).append(value)
        built = ahocorasick.Automaton()
        for pattern, own in values.items():
            built.add_word(pattern, own)
        built.make_automaton()
        _BUILT[key] = built
    return _BUILT[key]


def contained(spark: SparkSession, text: Column, pairs: Sequence[tuple[str, object]], kind: str = "string") -> Column:
    """Values, as a sorted array of ``kind``, of the patterns that ``text`` contains.

    ``pairs`` are (pattern, value); patterns are not empty and, unless there is but one, hold
    ``AUTOMATON_CHARS`` characters at most in all. A null text contains none.
    """
    if len(pairs) > 1 and sum(len(p) for p, _ in pairs) > AUTOMATON_CHARS:
        raise ValueError("too many patterns for one automaton")
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(list(pairs))
    of = {"string": pa.string(), "int": pa.int32()}[kind]

    def find(texts: pa.Array) -> pa.Array:
        built = _automaton(key, sent.value)
        found = [sorted({v for _, own in built.iter(t) for v in own}) if t else [] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(of))

    return F.arrow_udf(find, f"array<{kind}>")(text)
