"""Which rules may fire on a record: an index over what their conditions require.

A rule that needs a field to have one of some whole values is found by that value: a hash
of the record's value chooses among buckets of rules. A rule whose patterns hold literal
text is found by an automaton that reads the record's fields once. The others are found by
their channel where it is plain, or are tried on each record. Only the rules found are
evaluated, so the cost of a record follows its candidates, not the number of rules.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions.records import get_path
from evidence_spark.operators.automaton import AUTOMATON_CHARS, contained

#: Buckets of the rules of one field, at most.
BUCKETS = 64
#: Literals that are looked for one by one; more are looked for by an automaton.
FEW = 24
#: Shortest literal that is worth looking for.
LITERAL = 3

_SPECIAL = re.compile(r"\[[!^]?\]?[^\]]*\]|[*?\[]")


def literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a glob contains, lower-cased."""
    return max(_SPECIAL.split(pattern.lower()), key=len)


def _requirement(values: Sequence) -> tuple[str, frozenset] | None:
    """What one of the patterns ``values`` needs of a field: (kind, literals)."""
    kinds, found = set(), set()
    for x in values:
        if isinstance(x, int) and not isinstance(x, bool):
            kinds.add("number")
            found.add(x)
        elif isinstance(x, bool) or x is None:
            kinds.add("whole")
            found.add(str(x).lower())
        elif x.startswith("$") and len(x) > 1:
            return None
        elif x:
            kinds.add("part" if _SPECIAL.search(x) else "whole")
            found.add(literal(x))
    if kinds == {"part", "whole"}:
        kinds = {"part"}
    if len(kinds) != 1 or kinds == {"part"} and min(map(len, found)) < LITERAL:
        return None
    return kinds.pop(), frozenset(found)


def anchor(rule, ruleset: Mapping) -> tuple[str, str, frozenset] | None:
    """(kind, path, literals) of which a record must have one for ``rule`` to fire.

    Kinds are whole, number and part (of the value at the path) and channel.
    """
    options, seen, todo = [], set(), [rule]
    while todo:
        r = todo.pop()
        if r.name in seen:
            continue
        seen.add(r.name)
        for path, want in r.include.items():
            need = _requirement(want if isinstance(want, list) else [want])
            if need:
                kind, found = need
                options.append(((kind == "part", len(found) if kind != "part" else -min(map(len, found)), path), (kind, path, found)))
        todo += [ruleset[n] for n in r.calls if n in ruleset]
    if options:
        return min(options, key=lambda x: x[0])[1]
    if rule.channel and not _SPECIAL.search(rule.channel):
        return "channel", "", frozenset([rule.channel.lower()])
    return None


def _bucket(value: str | int, n: int) -> int:
    return value % n if isinstance(value, int) else zlib.crc32(value.encode("utf-8", "surrogatepass")) % n


def text(value: str) -> str:
    """A string as a literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found_rules(df: DataFrame, rules: Sequence, ruleset: Mapping, condition: Callable[[int], str | Column], channel: str = "data_type") -> DataFrame:
    """``df``, which has ``v``, with ``_found``: the sorted numbers of the rules that match.

    ``condition(i)`` is the condition of rule ``i``, as SQL text or, where it has none, as a
    Column that is tried on each record. Text is put together into one expression for each
    field, so that hundreds of rules are planned quickly.
    """
    by: dict[tuple[str, str], list[tuple[int, frozenset]]] = defaultdict(list)
    always: list[int] = []
    tests = [condition(i) for i in range(len(rules))]
    for i, rule in enumerate(rules):
        need = anchor(rule, ruleset) if isinstance(tests[i], str) else None
        if need is None:
            always.append(i)
        else:
            by[need[:2]].append((i, need[2]))

    def numbers(own: Sequence[int]) -> str:
        return f"array({', '.join(f'CASE WHEN {tests[i]} THEN {i} END' for i in own)})"

    groups: list[Column] = []
    columns: dict[str, Column] = {}
    parts: list[tuple[str, int, frozenset]] = []
    for (kind, path), own in sorted(by.items()):
        if kind == "part":
            parts += [(path, i, found) for i, found in own]
            continue
        name = f"_a{len(columns)}"
        value = F.col(channel) if kind == "channel" else get_path("v", path)
        columns[name] = value.try_cast("long") if kind == "number" else F.lower(value)
        literals = sorted(set().union(*(found for _, found in own)))
        n = 1
        while n < min(len(literals), BUCKETS):
            n *= 2
        buckets: dict[int, list[int]] = defaultdict(list)
        for i, found in own:
            for b in sorted({_bucket(x, n) for x in found}):
                buckets[b].append(i)
        place = f"pmod({name}, {n}L)" if kind == "number" else f"pmod(crc32(encode({name}, 'UTF-8')), {n}L)"
        known = ", ".join(f"{x}L" if kind == "number" else text(x) for x in literals)
        pick = " ".join(f"WHEN {b}L THEN {numbers(some)}" for b, some in sorted(buckets.items()))
        groups.append(F.expr(f"CASE WHEN {name} IN ({known}) THEN CASE {place} {pick} END END"))

    out = df.withColumns(columns)
    if parts:
        paths = {p: f"_p{k}" for k, p in enumerate(sorted({p for p, _, _ in parts}))}
        out = out.withColumns({name: F.lower(get_path("v", p)) for p, name in paths.items()})
        literals = set().union(*(found for _, _, found in parts))
        if len(literals) <= FEW or sum(map(len, literals)) > AUTOMATON_CHARS:
            for path, i, found in parts:
                test = " OR ".join(f"contains({paths[path]}, {text(x)})" for x in sorted(found))
                groups.append(F.expr(f"CASE WHEN {test} THEN {numbers([i])} END"))
        else:
            n = min(len(parts), 2 * BUCKETS)
            buckets, pairs = defaultdict(list), set()
            for k, (_, i, found) in enumerate(parts):
                buckets[k % n].append(i)
                pairs |= {(x, k % n) for x in found}
            out = out.withColumn("_b", contained(df.sparkSession, F.concat_ws("\n", *paths.values()), sorted(pairs), "int"))
            # a record that contains none of the literals is through after one test
            some = ", ".join(f"CASE WHEN array_contains(_b, {b}) THEN {numbers(own)} END" for b, own in sorted(buckets.items()))
            groups.append(F.expr(f"CASE WHEN size(_b) > 0 THEN flatten(array_compact(array({some}))) END"))
        columns |= dict.fromkeys([*paths.values(), "_b"])
    plain = [i for i in always if isinstance(tests[i], str)]
    if plain:
        groups.append(F.expr(numbers(plain)))
    groups += [F.array(F.when(tests[i], F.lit(i))) for i in always if not isinstance(tests[i], str)]
    found = F.array_sort(F.array_compact(F.flatten(F.array_compact(F.array(*groups))))) if groups else F.array().cast("array<int>")
    return out.withColumn("_found", found).drop(*columns)
