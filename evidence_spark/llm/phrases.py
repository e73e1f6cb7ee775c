"""Phrase collocations: counts by double-array tries, scores and subsumption by joins.

Words are counted by language; those that are frequent get ids. Texts become streams of
ids with a zero wherever no phrase can pass: between pieces and at other words. For each
length a Bloom filter of saturated counts, summed over all tasks, tells which phrases may
be frequent; a phrase whose first or last words fail the filter before is not counted
(Apriori). What passes is listed once, put into double-array tries of bounded size and
sent to the tasks, where numpy walks the trie from all positions at once, word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.llm.common import cut, drop_cut, mix, small_batches, span_hashes

LONGEST = 4
LEAST = 30
TOP = 2000
#: Keys of frequent words that tasks are sent at once (8 bytes each).
VOCABULARY = 4_000_000
#: Phrases of one trie.
TRIE_PHRASES = 500_000
#: Slots of the filter: a power of two of at least an eighth of all words, between these.
SLOTS = (1 << 16, 1 << 30)
#: Slots that a task counts at once.
COUNTED = 1 << 26
#: Slots that are summed together.
RUN = 1 << 16
#: Bytes of text that are hashed at once, and ids of a stored row.
PART = 1 << 18
ROW_IDS = 512
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Phrases that a task collects before it hands them on.
HELD_PHRASES = 1_000_000
#: Phrases that one task should rank.
RANKED = 50_000

_CUTS = b".,;:!?\n\x0b\x0c\r"
_CUT = np.isin(np.arange(256), list(_CUTS))
_APART = _CUT | np.isin(np.arange(256), [32, 9])
_TO_SPACE = bytes.maketrans(_CUTS + b"\t", b" " * (len(_CUTS) + 1))
_BYTE = np.random.Generator(np.random.PCG64(34)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_WORD = np.random.Generator(np.random.PCG64(35)).integers(1 << 62, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# -- words -------------------------------------------------------------------------------


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _stream(raw: bytes, lang: str) -> np.ndarray:
    """Keys of the words of a text, all negative, and a zero between pieces."""
    buf = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([0], (~_APART[buf]).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keys = (mix(span_hashes(_BYTE[buf], start, end) ^ _seed(lang)) | np.uint64(1 << 63)).view(np.int64)
    cuts = np.cumsum(_CUT[buf], dtype=np.int64)
    piece = cuts[start]
    apart = np.diff(piece, prepend=0) > 0
    last = len(buf) > 0 and cuts[-1] > (piece[-1] if len(piece) else 0)
    out = np.zeros(len(keys) + np.count_nonzero(apart) + last, np.int64)
    out[np.arange(len(keys)) + np.cumsum(apart)] = keys
    return out


def _parts(raw: bytes):
    """A long text in parts that end before a byte that is in no word."""
    at = 0
    while len(raw) - at > PART:
        end = at + PART
        while end < len(raw) and not _APART[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _key_streams(batch: pa.RecordBatch):
    """Streams of the texts of a batch (lang, text), each ending with a zero."""
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            groups.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass").lower())
    for lang, texts in groups.items():
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= PART):
                size += len(texts[end]) + 1
                end += 1
            for part in _parts(b"\n".join(texts[at:end]) + b"\n"):
                yield _stream(part, lang)
            at = end


def _count_words(batches):
    """Rows (lang, word, key, f): words as often as they occur; null counts all words."""

    def rows(held):
        for lang, counts in held.items():
            if counts:
                keys = np.concatenate([_stream(p, lang) for p in _parts(b" ".join(counts))])
                text = [w.decode("utf-8", "surrogatepass") for w in counts]
                cols = [pa.array([lang] * (len(text) + 1)), pa.array([None, *text], pa.string()), pa.array(np.append(0, keys)), pa.array([counts.total(), *counts.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "word", "key", "f"])

    held: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                words = text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split(b" ")
                counts = held.setdefault(lang, Counter())
                counts.update(words)
                del counts[b""]
        if sum(map(len, held.values())) > HELD_WORDS:
            yield from rows(held)
            held = {}
    yield from rows(held)


def _to_ids(values: np.ndarray, keys: np.ndarray, base: int) -> np.ndarray:
    """Keys that are among the sorted ``keys`` become ``base`` + their place, from 1."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, base + 1 + at, values)


def _compact(values: np.ndarray) -> np.ndarray:
    """Ids in runs of two or more, a zero after each run; keys that are left are zeros."""
    ids = np.where(values > 0, values, 0)
    ids = np.append(ids, 0)
    has = ids > 0
    before, after = np.append(False, has[:-1]), np.append(has[1:], False)
    run = has & (before | after)
    return ids[run | np.append(False, run[:-1])].astype(np.int32)


def _stored(ids: np.ndarray):
    """Rows of about ``ROW_IDS`` ids that end with a zero."""
    if len(ids):
        zeros = np.flatnonzero(ids == 0) + 1
        ends = zeros[np.searchsorted(zeros, np.arange(ROW_IDS, len(ids), ROW_IDS))]
        edges = np.unique(np.concatenate(([0], ends, [len(ids)])))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))], ["ids"])


def encode(texts: DataFrame, vocabulary: DataFrame, at_once: int = VOCABULARY) -> tuple[DataFrame, DataFrame, int]:
    """Written streams of ids, the vocabulary with its ids, and the number of ids.

    ``texts`` has lang and text, ``vocabulary`` lang, word, key and f. Up to ``at_once``
    keys are sent to the tasks. More go in several parts, each in a pass over streams of
    keys, so that a task holds one part only.
    """
    spark = texts.sparkSession
    total = vocabulary.count()
    parts = max(1, -(-total // at_once))
    base, words, streams = 0, vocabulary.withColumn("id", F.col("key")), None
    for p in range(parts):
        keys = np.sort(vocabulary.where(F.pmod("key", F.lit(parts)) == p).select("key").distinct().toArrow().column(0).to_numpy())
        if not len(keys):
            continue
        sent = spark.sparkContext.broadcast(keys)

        def number(batches, sent=sent, base=base):
            for b in batches:
                yield b.set_column(b.num_columns - 1, "id", pa.array(_to_ids(b.column(b.num_columns - 1).to_numpy(), sent.value, base)))

        def direct(batches, sent=sent):
            for b in batches:
                values = [_to_ids(s, sent.value, 0) for s in _key_streams(b)]
                yield from _stored(_compact(np.concatenate(values))) if values else ()

        def replace(batches, sent=sent, base=base):
            for b in batches:
                lists = b.column(0)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(lists.offsets, pa.array(_to_ids(lists.values.to_numpy(), sent.value, base)))], ["ids"])

        words = cut(words.mapInArrow(number, "lang string, word string, key long, f long, id long"))
        if parts == 1:
            return cut(texts.mapInArrow(direct, "ids array<int>")), words, len(keys)
        if streams is None:
            streams = cut(texts.mapInArrow(_as_rows, "ids array<long>"))
        step = cut(streams.mapInArrow(replace, "ids array<long>"))
        drop_cut(streams)
        streams = step
        base += len(keys)
    if streams is None:
        return spark.createDataFrame([], "ids array<int>"), words, 0
    return cut(streams.mapInArrow(_compact_rows, "ids array<int>")), words, base


def _as_rows(batches):
    for b in batches:
        streams = list(_key_streams(b))
        if streams:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(streams)], pa.list_(pa.int64()))], ["ids"])


def _compact_rows(batches):
    for b in batches:
        yield from _stored(_compact(b.column(0).flatten().to_numpy()))


# -- candidates --------------------------------------------------------------------------


def _slots(ids: np.ndarray, at: np.ndarray, n: int, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, and two slots of the filter, of the phrases of ``n`` words at places ``at``."""
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h += ids[at + j].astype(np.uint64) * _WORD[j]
    h = mix(h + np.uint64(n))
    low = np.uint64(slots - 1)
    return h, (h & low).astype(np.int64), ((h >> np.uint64(33)) & low).astype(np.int64)


def _may_be(ids: np.ndarray, at: np.ndarray, n: int, bits: np.ndarray, slots: int) -> np.ndarray:
    """Places in ``at`` whose phrase of ``n`` words passes the filter of that length."""
    _, a, b = _slots(ids, at, n, slots)
    a, b = (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1 for s in (a, b))
    return at[(a & b).astype(bool)]


def _eligible(ids: np.ndarray, n: int, filters: list, slots: int) -> np.ndarray:
    """Places of phrases of ``n`` words of which both parts of n - 1 words pass the filters."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    for m in range(2, n):
        some = _may_be(ids, at, m, filters[m - 2].value, slots)
        place = np.zeros(len(ids) + 1, bool)
        place[some] = True
        at = some[place[some + 1]]
    return at


def _filter(streams: DataFrame, n: int, filters: list, slots: int, least: int) -> np.ndarray:
    """Bits of the slots that phrases of ``n`` words reach ``least`` times or more.

    Counts stop at 255, which changes no bit as ``least`` is less.
    """
    spark = streams.sparkSession
    step = min(slots, COUNTED)
    bits = np.zeros(slots // 8, np.uint8)

    for low in range(0, slots, step):

        def count(batches, low=low):
            have = np.zeros(step, np.uint8)
            for b in batches:
                ids = b.column(0).flatten().to_numpy()
                _, x, y = _slots(ids, _eligible(ids, n, filters, slots), n, slots)
                s = np.concatenate((x, y)) - low
                s, c = np.unique(s[(s >= 0) & (s < step)], return_counts=True)
                have[s] = np.minimum(have[s] + np.minimum(c, 255), 255)
            runs = have.reshape(-1, min(step, RUN))
            some = np.flatnonzero(runs.any(axis=1))
            for i in range(0, len(some), 64):
                own = some[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([zlib.compress(runs[r].tobytes(), 1) for r in own], pa.binary())], ["run", "counts"])

        def total(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    c = np.frombuffer(zlib.decompress(c), np.uint8).astype(np.uint16)
                    sums[r] = np.minimum(sums[r] + c, 255).astype(np.uint16) if r in sums else c
            rows = [(r, np.packbits(c >= least).tobytes()) for r, c in sums.items()]
            cols = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["run", "counts"])

        schema = "run long, counts binary"
        found = streams.mapInArrow(count, schema).repartition("run").mapInArrow(total, schema).toArrow()
        width = min(step, RUN) // 8
        for r, c in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            bits[low // 8 + r * width : low // 8 + (r + 1) * width] = np.frombuffer(c, np.uint8)
    return bits


_IDS = [f"w{j + 1}" for j in range(LONGEST)]
_IDS_SCHEMA = ", ".join(f"{c} int" for c in _IDS)


def _phrase_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], _IDS)


def candidates(streams: DataFrame, words: int, least: int = LEAST) -> DataFrame:
    """Phrases of 2 to 4 ids (0 for none) that pass the filters: a superset of the frequent ones."""
    spark = streams.sparkSession
    slots = min(SLOTS[1], max(SLOTS[0], 1 << (max(words // 8, 1) - 1).bit_length()))
    filters: list = []
    for n in range(2, LONGEST + 1):
        filters.append(spark.sparkContext.broadcast(_filter(streams, n, filters, slots, least)))

    def propose(batches):
        held, size = [], 0  # hashes and ids of phrases, each once in a batch

        def once():
            h = np.concatenate([x for x, _ in held])
            _, first = np.unique(h, return_index=True)
            return h[first], np.concatenate([x for _, x in held])[first]

        for b in batches:
            ids = b.column(0).flatten().to_numpy()
            for n in range(2, LONGEST + 1):
                at = _may_be(ids, _eligible(ids, n, filters, slots), n, filters[n - 2].value, slots)
                if not len(at):
                    break
                h, first = np.unique(_slots(ids, at, n, slots)[0], return_index=True)
                rows = np.zeros((len(first), LONGEST), np.int32)
                for j in range(n):
                    rows[:, j] = ids[at[first] + j]
                held.append((h, rows))
                size += len(h)
            if size > HELD_PHRASES:
                held = [once()]
                size = len(held[0][0])
                if 2 * size > HELD_PHRASES:
                    yield packed(*held[0])
                    held, size = [], 0
        if held:
            yield packed(*once())

    def packed(h, rows):
        """A row for each run of hashes, so that a phrase of many tasks is not many rows."""
        run = (h >> np.uint64(56)).astype(np.int64)  # h is sorted
        edges = np.searchsorted(run, np.arange(257))
        some = np.flatnonzero(np.diff(edges))
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[edges[r] : edges[r + 1]].tobytes() for r in some], pa.binary())], ["run", "phrases"])

    def unpacked(batches):
        held = np.empty((0, 2), np.int64)
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, 2)
            held = np.concatenate((held, rows))
            held = held[np.lexsort(held.T)]
            held = held[np.append(True, (np.diff(held, axis=0) != 0).any(axis=1))] if len(held) else held
        rows = held.view(np.int32)
        for i in range(0, len(rows), 100_000):
            yield _phrase_batch(rows[i : i + 100_000])

    found = cut(streams.mapInArrow(propose, "run long, phrases binary").repartition("run").mapInArrow(unpacked, _IDS_SCHEMA))
    for f in filters:
        f.unpersist()
    return found


# -- double-array tries ------------------------------------------------------------------


class Trie:
    """Double-array trie of phrases of ids, each id a fixed number of bytes.

    The child of state ``s`` for byte ``c`` is ``base[s] ^ c`` where ``check`` holds ``s``
    there. ``term`` has the number of the phrase that ends in a state, or -1.
    """

    def __init__(self, phrases: np.ndarray, width: int) -> None:
        self.width = width
        self.phrases = phrases[np.lexsort(phrases.T[::-1])]
        size = (self.phrases > 0).sum(axis=1) * width
        shift = np.arange(8 * width - 8, -8, -8)
        byte = ((self.phrases[:, :, None] >> shift) & 255).reshape(len(phrases), -1)
        cur, parent, label, nodes = np.zeros(len(phrases), np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
        for d in range(byte.shape[1]):
            on = np.flatnonzero(size > d)
            if not len(on):
                break
            new = np.append(True, (np.diff(cur[on]) != 0) | (np.diff(byte[on, d]) != 0))
            parent.append(cur[on][new])
            label.append(byte[on, d][new])
            cur[on] = nodes - 1 + np.cumsum(new)
            nodes += np.count_nonzero(new)
        self.parent, self.label = np.concatenate(parent)[1:], np.concatenate(label)[1:]
        slot = self._place(nodes)
        self.term = np.full(len(self.base), -1, np.int32)
        self.term[slot[cur]] = np.arange(len(phrases))
        del self.parent, self.label

    def _place(self, nodes: int) -> np.ndarray:
        """Slots of all nodes. Rows of many children get blocks of 256 alone, the others fill gaps."""
        rng = np.random.default_rng(0)
        parents, first, count = np.unique(self.parent, return_index=True, return_counts=True)
        base = np.zeros(nodes, np.int64)
        many = count > 16
        base[parents[many]] = 256 * np.arange(1, 1 + np.count_nonzero(many))
        free = np.ones(256 * (2 + np.count_nonzero(many)), bool)
        free[:256] = False  # the root's block: leaves lead there, and nothing else does
        own = many[np.searchsorted(parents, self.parent)]
        free[base[self.parent[own]] ^ self.label[own]] = False
        for k in range(16, 0, -1):
            rows = np.flatnonzero(count == k)
            tries = 0
            while len(rows):
                open_slots = np.flatnonzero(free)
                if tries % 12 == 11 or len(open_slots) < 2 * k * len(rows) + 256:
                    free = np.append(free, np.ones(256 * (1 + 3 * k * len(rows) // 256), bool))
                    open_slots = np.flatnonzero(free)
                tries += 1
                labels = self.label[first[rows][:, None] + np.arange(k)]
                to = (rng.permutation(open_slots)[: len(rows)] if k == 1 else rng.choice(open_slots, len(rows))) ^ labels[:, 0]
                slots = to[:, None] ^ labels
                ok = free[slots].all(axis=1)
                owner = np.full(len(free), -1, np.int32)
                owner[slots[ok]] = np.flatnonzero(ok)[:, None]
                ok &= (owner[slots] == np.arange(len(rows))[:, None]).all(axis=1)
                base[parents[rows[ok]]] = to[ok]
                free[slots[ok]] = False
                rows = rows[~ok]
        slot = np.append(0, base[self.parent] ^ self.label)
        self.base, self.check = np.zeros(len(free), np.int32), np.full(len(free), -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[self.parent]
        return slot

    def walk(self, ids: np.ndarray):
        """Numbers of the phrases that start anywhere in ``ids``, length by length."""
        ids = np.concatenate((ids, np.zeros(LONGEST, ids.dtype)))
        at = np.flatnonzero(ids)
        state = np.zeros(len(at), np.int32)
        for j in range(LONGEST):
            word = ids[at + j]
            for d in range(8 * self.width - 8, -8, -8):
                to = self.base[state] ^ ((word >> d) & 255)
                ok = self.check[to] == state
                at, state, word = at[ok], to[ok], word[ok]
            term = self.term[state]
            yield term[term >= 0]


def count_phrases(streams: DataFrame, phrases: DataFrame, ids: int, least: int = LEAST, at_once: int = TRIE_PHRASES) -> DataFrame:
    """Written counts (w1..w4, f) of the phrases that occur ``least`` times or more.

    Phrases are split by their first word into tries of about ``at_once``; each trie is
    sent to the tasks for a pass over the streams of its own.
    """
    spark = streams.sparkSession
    width = max(1, -(-ids.bit_length() // 8))
    parts = max(1, -(-phrases.count() // at_once))
    out = []
    for p in range(parts):
        rows = phrases.where(F.pmod(F.xxhash64("w1"), F.lit(parts)) == p).select(*_IDS).toArrow()
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast(Trie(np.stack([c.to_numpy() for c in rows.columns], axis=1), width))

        def count(batches, sent=sent):
            trie = sent.value
            found = np.zeros(len(trie.phrases), np.int64)
            for b in batches:
                for term in trie.walk(b.column(0).flatten().to_numpy()):
                    found += np.bincount(term, minlength=len(found))
            at = np.flatnonzero(found)
            for i in range(0, len(at), 100_000):
                own = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(trie.phrases[own, j], pa.int32()) for j in range(LONGEST)), pa.array(found[own])], [*_IDS, "f"])

        out.append(cut(streams.mapInArrow(count, f"{_IDS_SCHEMA}, f long").groupBy(*_IDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)))
        sent.unpersist()
    if not out:
        return spark.createDataFrame([], f"{_IDS_SCHEMA}, f long")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


# -- scores ------------------------------------------------------------------------------


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Rows of each lang up to rank ``k`` by score and a, ties at the end included.

    While there are many, a lang is ranked in parts first, so no task ranks them all.
    """
    order = (F.col("score").desc(), F.col("a").desc())
    n = rows.count()
    while n > RANKED:
        parts = -(-n // RANKED)
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("p"), F.lit(parts))).orderBy(*order)
        fewer = cut(rows.withColumn("place", F.rank().over(own)).where(F.col("place") <= k).drop("place"))
        drop_cut(rows)
        rows, before, n = fewer, n, fewer.count()
        if 2 * n > before:
            break
    return rows.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= k).drop("place")


def collocations(docs: DataFrame, k: int = TOP, least: int = LEAST, vocabulary_at_once: int = VOCABULARY, phrases_at_once: int = TRIE_PHRASES) -> DataFrame:
    """The ``k`` best phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, and a null lang is ``und``. Repeated rows count as often as they
    occur. Equal scores rank by count, then by phrase in byte order, so ranks are unique. Long
    texts are read whole. An empty table, and one where nothing is frequent, give no rows.
    Columns other than text and lang are not read. ``least`` is at most 255.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be between 1 and 255")
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = cut(
        texts.mapInArrow(_count_words, "lang string, word string, key long, f long")
        .groupBy("lang", "word", "key").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("word").isNull())
    )
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    streams, words, ids = encode(texts, words.where("word is not null"), vocabulary_at_once)
    proposed = candidates(streams, total, least)
    counted = count_phrases(streams, proposed, ids, least, phrases_at_once)
    drop_cut(proposed)
    drop_cut(streams)

    phrases = cut(counted.select(F.filter(F.array(*_IDS), lambda x: x > 0).alias("p"), "f"))
    every = phrases.select("p", "f", F.lit(None).cast("string").alias("lang")).unionByName(words.select(F.array(F.col("id").cast("int")).alias("p"), "f", "lang"))
    cuts = phrases.select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("head"), F.expr("slice(p, k + 1, size(p) - k)").alias("tail"))
    scored = (
        cuts.join(every.select(F.col("p").alias("head"), F.col("f").alias("l"), "lang"), "head")
        .join(every.select(F.col("p").alias("tail"), F.col("f").alias("r")), "tail")
        .withColumn("score", F.expr("(cast(a as decimal(20, 0)) * 2000000bd) div cast(l + r as decimal(20, 0))"))
        .groupBy("p", "a").agg(F.max("lang").alias("lang"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    inner = phrases.where(F.size("p") > 2).select("f", F.explode(F.expr("flatten(transform(sequence(2, size(p) - 1), n -> transform(sequence(1, size(p) - n + 1), s -> slice(p, s, n))))")).alias("p"))
    over = inner.groupBy("p").agg(F.max("f").alias("over"))
    kept = scored.join(over, "p", "left").where(F.expr("over is null or cast(over as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80"))
    best = cut(_top(cut(kept.select("lang", "p", "a", "cut.l", "cut.r", "cut.score")), k))
    spelled = (
        best.select("lang", "p", F.posexplode("p").alias("place", "id")).join(words.select(F.col("id").cast("int").alias("id"), "word"), "id")
        .groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (
        best.join(spelled, ["lang", "p"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
        .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
