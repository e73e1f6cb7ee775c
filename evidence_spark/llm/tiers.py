"""Hierarchical packing of documents into windows of several context sizes.

Documents become token ids (BPE over lower-cased words, then an end id). Ids beyond a full
long window are windows of their own; what is left of each document is routed to the
smallest tier that holds it. Tiers are packed from the longest down: a window starts with
the largest document of its tier, its gap is filled from the shorter tiers, largest fit
first, and what no document fits is filled by cutting one, so that a window is full.
Windows of a tier are dealt to step groups of equal tokens and even attention cost.

A task packs its own partition in bounded buffers and carries what fills no window into the
next one, so that nothing is shuffled; the last few ids of a task are cut at powers of two.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import small_batches

#: Window sizes, powers of two, longest first.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens of the windows of one step group.
STEP_TOKENS = 1 << 16
#: Tokens that a task holds before it packs them.
BUFFER_TOKENS = 1 << 22
#: Distinct words, and bytes of their ids, that a process remembers.
KNOWN_WORDS = 1_000_000
KNOWN_BYTES = 1 << 25
#: Characters of the texts of which the words are looked up together.
LOOKUP_CHARS = 1_000_000
#: Texts of these characters are cut into words as the tokenizer cuts them (tests compare each).
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ž‐-‧‰-⁞]*+")

_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts by ``tokenizers``, which sees every distinct word once.

    The vocabulary drops white space and case and never merges across words, so the ids of
    a text are those of its words one after the other. Texts with a special token or with
    characters outside of ``_PLAIN`` go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.held = 0
        # the standard library's matcher is faster, and has letters as a list
        letters, digits = ("".join(c for c in map(chr, range(0x80, 0x180)) if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}"))
        self.words = re.compile(rf"[a-z{letters}]+|[0-9{digits}]|'(?:[stmd]|re|ve|ll)|[^\s0-9a-z{letters}{digits}]+").findall

    @classmethod
    def of(cls, path: str | None = None) -> WordEncoder:
        """The encoder of this process for a tokenizer file."""
        import public_tokenizers

        path = path or public_tokenizers.path("word_bpe_49k.json")
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _learn(self, words: list[str]) -> None:
        got = self.tok.encode(" ".join(words), add_special_tokens=False)
        first = np.fromiter((s for s, _ in got.offsets), np.int64, len(got.ids))
        begin = np.cumsum([0] + [len(w) + 1 for w in words])
        edge = (4 * np.searchsorted(first, begin)).tolist()
        ids = np.array(got.ids, "<u4").tobytes()
        self.known.update((w, ids[s:e]) for w, s, e in zip(words, edge, edge[1:], strict=False))
        self.held += len(ids)

    def ids(self, texts: list[str | None], known_words: int = KNOWN_WORDS):
        """Ids of each text and the end id, as bytes of little-endian unsigned 32-bit."""
        end_id = END_ID.to_bytes(4, "little")
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < LOOKUP_CHARS):
                size += len(texts[end] or "")
                end += 1
            split = []
            for text in texts[at:end]:
                plain = not text or (_PLAIN.fullmatch(text) and not any(x in text for x in self.special))
                split.append(self.words((text or "").lower()) if plain else None)
            if len(self.known) > known_words or self.held > KNOWN_BYTES:
                self.known.clear()
                self.held = 0
            new = set(chain.from_iterable(w for w in split if w)).difference(self.known)
            if new:
                self._learn(list(new))
            for text, words in zip(texts[at:end], split, strict=True):
                if words is None:
                    yield np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end_id
                else:
                    yield b"".join(map(self.known.__getitem__, words)) + end_id
            at = end


class _Pool:
    """Spans (item, start, length) by length."""

    def __init__(self, spans) -> None:
        self.by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, start, n in spans:
            self.by[n].append((item, start))
        self.lens = sorted(self.by)
        self.total = sum(n * len(x) for n, x in self.by.items())

    def _pop(self, at: int) -> tuple[int, int, int]:
        n = self.lens[at]
        item, start = self.by[n].pop()
        if not self.by[n]:
            del self.by[n], self.lens[at]
        self.total -= n
        return item, start, n

    def take(self, room: int) -> tuple[int, int, int]:
        """The longest span of at most ``room``, else the front of the shortest longer one."""
        at = bisect_right(self.lens, room)
        if at:
            return self._pop(at - 1)
        item, start, n = self._pop(0)
        if n - room not in self.by:
            insort(self.lens, n - room)
        self.by[n - room].append((item, start + room))
        self.total += n - room
        return item, start, room

    def rest(self) -> list[tuple[int, int, int]]:
        return [(item, start, n) for n, x in self.by.items() for item, start in x]


def pack_tiers(spans, tiers: tuple[int, ...] = TIERS, last: bool = True):
    """Full windows of spans of at most ``tiers[0]``: ``[(size, [span])]``, and the spans left.

    Where ``last`` is not set, spans that fill no longest window are left. Else none is:
    the end is cut at ever smaller powers of two.
    """
    pool, windows = _Pool(spans), []

    def fill(size: int) -> None:
        window, room = [], size
        while room:
            span = pool.take(room)
            window.append(span)
            room -= span[2]
        windows.append((size, window))

    for size, low in zip(tiers, (*tiers[1:], 0), strict=True):
        while pool.total >= (size if last else max(tiers)) and pool.lens[-1] > low:
            fill(size)
    if not last:
        return windows, pool.rest()
    size = tiers[-1]
    while pool.total:
        size //= 2
        if pool.total >= size:
            fill(size)
    return windows, []


def step_groups(windows, step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group number for each window: of one size, ``step_tokens`` at most, costs balanced.

    The cost of a window is the sum of squares of its spans. Windows are dealt to the
    groups of their size by falling cost, there and back.
    """
    out, first = [0] * len(windows), 0
    by = defaultdict(list)
    for i, (size, window) in enumerate(windows):
        by[size].append((-sum(n * n for _, _, n in window), i))
    for size, costs in by.items():
        groups = -(-len(costs) // max(1, step_tokens // size))
        for k, (_, i) in enumerate(sorted(costs)):
            turn, g = divmod(k, groups)
            out[i] = first + (groups - 1 - g if turn % 2 else g)
        first += groups
    return out


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, tier int, step_group long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def pack_hierarchy(docs: DataFrame, tiers: tuple[int, ...] = TIERS, tokenizer_path: str | None = None, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Pieces of all documents with their window, its tier and its step group.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they
    occur; ties in length go in any order. A null doc_id stays null. Texts of any length
    are cut into windows of the longest tier and a rest. An empty table gives no rows;
    columns other than doc_id and text are not read. Every window is full: its tokens are
    its tier, a power of two. A task ends with at most one window of each power below the
    shortest tier. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier, step_group.
    """
    small_batches(docs.sparkSession)
    longest = tiers[0]

    def run(batches):
        encoder = WordEncoder.of(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        done = Counter()
        held: dict[int, tuple[int | None, int, bytes]] = {}  # item -> doc, tokens, ids
        spans: list[tuple[int, int, int]] = []

        def pack(last: bool):
            nonlocal spans, held
            full = [(longest, [s]) for s in spans if s[2] == longest]
            windows, rest = pack_tiers([s for s in spans if s[2] < longest], tiers, last)
            windows = full + windows
            groups = step_groups(windows, step_tokens)
            out = []
            for (size, window), group in zip(windows, groups, strict=True):
                off = 0
                for item, start, n in window:
                    doc, tokens, ids = held[item]
                    out.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, base + done["windows"], off, size, base + done["groups"] + group))
                    off += n
                done["windows"] += 1
            done["groups"] += max(groups, default=-1) + 1
            spans = rest
            held = {item: held[item] for item, _, _ in rest}
            for at in range(0, len(out), 20_000):
                yield _batch(out[at : at + 20_000])

        size = 0
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), encoder.ids(b.column(1).to_pylist()), strict=True):
                n, item = len(ids) // 4, done["items"]
                done["items"] += 1
                held[item] = (doc, n, ids)
                spans += [(item, s, longest) for s in range(0, n - longest + 1, longest)]
                if n % longest:
                    spans.append((item, n - n % longest, n % longest))
                size += n
                if size >= buffer_tokens:
                    yield from pack(False)
                    size = sum(n for _, _, n in spans)
        yield from pack(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
