"""Packing documents into fixed-length training sequences by local search.

Documents become token ids (byte-level BPE, then an end id). Those longer than a sequence
are cut into full pieces, of which the first may be shorter. Full pieces fill a sequence
alone. The others are dealt by hash into shards of bounded size; in each shard a best-fit
start is improved by moves that raise the sum of squared fills: a document moves to a
fuller bin, or one or two documents change places with one, until bins become empty.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import cut, small_batches

SEQ_LEN = 2048
END_ID = 0
END = END_ID.to_bytes(4, "little")
#: Pieces that one shard should hold; a shard wastes about one sequence.
SHARD_PIECES = 20_000

#: Distinct words of which a process remembers the ids, for its next tasks too (some 120 to 230 bytes each).
KNOWN_WORDS = 2_000_000
#: Characters of the texts of which the words are looked up together.
LOOKUP_CHARS = 2_000_000
#: Characters of which the words are found here as the tokenizer finds them (tests compare
#: each one): other texts, and those with a special token, go to the tokenizer whole.
_PLAIN = regex.compile(r"[\x00-\u0530\u2000-\u206f\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]*+")
#: A space that does not start a word.
_LOOSE = regex.compile(r"^ | $| \s")

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts by ``tokenizers``, which sees every distinct word once.

    The byte-level vocabulary merges bytes within the pieces of its public pattern only,
    and a piece always begins at a space that a word follows. So the ids of a text are
    those of its words, each with the space before it, one after the other. Ids of words
    not met before come from one call on all of them in a row.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str | None = None) -> Encoder:
        """The encoder of this process for a tokenizer file."""
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of words that follow a space."""
        row = [f" {w}" for w in words]
        got = self.tok.encode("".join(row), add_special_tokens=False)
        ends = np.cumsum([1 if w.isalpha() else len(self.pieces(x)) for w, x in zip(words, row, strict=True)])
        edge = (4 * np.searchsorted(np.array(got.word_ids, np.int64), np.concatenate(([0], ends)))).tolist()
        ids = np.array(got.ids, "<u4").tobytes()
        self.known.update((w, ids[s:e]) for w, s, e in zip(words, edge, edge[1:], strict=False))

    def ids(self, texts: list[str | None], known_words: int = KNOWN_WORDS):
        """Ids of each text and the end id, as bytes of little-endian unsigned 32-bit."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < LOOKUP_CHARS):
                size += len(texts[end] or "")
                end += 1
            split = []
            for text in texts[at:end]:
                plain = text and _PLAIN.fullmatch(text) and not _LOOSE.search(text) and not any(x in text for x in self.special)
                split.append(text.split(" ") if plain else None)
            if len(self.known) > known_words:
                self.known.clear()
            new = set(filterfalse(self.known.__contains__, chain.from_iterable(w[1:] for w in split if w)))
            if new:
                self._learn(list(new))
            for text, words in zip(texts[at:end], split, strict=True):
                if words is None:
                    yield (self._whole(text) if text else b"") + END
                else:
                    yield self._whole(words[0]) + b"".join(map(self.known.__getitem__, words[1:])) + END
            at = end


def cut_pieces(n: int, size: int = SEQ_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pack_lengths(lengths: list[int], size: int = SEQ_LEN) -> list[list[int]]:
    """Bins of item numbers, each of at most ``size`` in all."""
    bins: list[list[int]] = []
    fill: list[int] = []
    open_bins: dict[int, list[int]] = defaultdict(list)  # room -> bins with that room
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b = len(bins)
            bins.append([])
            fill.append(0)
        else:
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        bins[b].append(i)
        fill[b] += n
        room = size - fill[b]
        if room > 0:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append(b)
    _improve(bins, fill, lengths, size, -(-sum(lengths) // size))
    return [b for b in bins if b]


def _sums(items: list[int], lengths: list[int]) -> np.ndarray:
    """Lengths that no, one or two items of a bin have together."""
    u, n = np.unique([lengths[i] for i in items], return_counts=True)
    i, j = np.triu_indices(len(u))
    ok = (i != j) | (n[i] > 1)
    return np.unique(np.concatenate(([0], u, (u[i] + u[j])[ok])))


def _items(items: list[int], lengths: list[int], total: int) -> list[int]:
    """The fewest items, two at most, that have a length together."""
    if not total:
        return []
    at: dict[int, int] = {}
    for i in items:
        if lengths[i] == total:
            return [i]
    for i in items:
        if total - lengths[i] in at:
            return [i, at[total - lengths[i]]]
        at[lengths[i]] = i
    raise ValueError(total)


class _Options:
    """What each underfull bin can give back, as rows of (sum, sum + room, fill, bin).

    Rows of a changed bin are blanked and written anew at the end. A length for which no
    row was found is therefore looked up in later rows only, unless from an emptier bin.
    """

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: list[int], size: int) -> None:
        self.bins, self.fill, self.lengths, self.size = bins, fill, lengths, size
        self.rows = np.empty((4, 1024), np.int64)
        self.build()

    def build(self) -> None:
        self.end = self.live = 0
        self.place: dict[int, tuple[int, int]] = {}
        self.none: dict[int, tuple[int, int]] = {}  # length -> least fill, rows looked up
        for b in range(len(self.bins)):
            self.write(b)

    def write(self, b: int) -> None:
        if b in self.place:
            s, e = self.place.pop(b)
            self.rows[1, s:e] = -1
            self.live -= e - s
        room = self.size - self.fill[b]
        if not self.bins[b] or room <= 0:
            return
        sums = _sums(self.bins[b], self.lengths)
        s, e = self.end, self.end + len(sums)
        while e > self.rows.shape[1]:
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)), axis=1)
        self.rows[0, s:e], self.rows[1, s:e], self.rows[2, s:e], self.rows[3, s:e] = sums, sums + room, self.fill[b], b
        self.place[b], self.end = (s, e), e
        self.live += e - s

    def best(self, a: int, n: int) -> tuple[int, int] | None:
        """Bin of at least the fill of ``a``, and what it gives back for a length ``n``."""
        least, start = self.none.get(n, (0, 0))
        f = self.fill[a]
        if n not in self.none or f < least:
            least, start = f, 0
        back, reach, fill, of = self.rows[:, start : self.end]
        at = np.flatnonzero((back < n) & (reach >= n) & (fill >= f))
        other = at[of[at] != a]
        if not len(other):
            if not len(at) and f <= least:
                self.none[n] = (f, self.end)
            return None
        gain = n - back[other]
        pick = other[np.argmax(gain * (fill[other] - f + gain))]
        return int(of[pick]), int(back[pick])

    def changed(self, *bins: int) -> None:
        for b in bins:
            self.write(b)
        if self.end > 2 * self.live + 20_000:
            self.build()


def _improve(bins: list[list[int]], fill: list[int], lengths: list[int], size: int, least: int = 0) -> bool:
    """Moves and exchanges until none helps or ``least`` bins are left; True where something moved.

    Each step takes an item of one bin, emptiest first, and looks among all bins of at
    least its fill for the one that gains most by a move, a one-for-one or a two-for-one
    exchange. As the fuller bin gains what the emptier one loses, the sum of squared fills
    grows with each step, which ends the search.
    """
    used = sum(map(bool, bins))
    if used <= least:
        return False
    options, any_moved, moved = _Options(bins, fill, lengths, size), False, True
    while moved:
        moved = False
        for a in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < size), key=lambda b: fill[b]):
            for i in sorted(bins[a], key=lambda i: -lengths[i]):
                n = lengths[i]
                found = options.best(a, n) if fill[a] < size else None
                if found is None:
                    continue
                b, back = found
                gives = _items(bins[b], lengths, back)
                bins[a].remove(i)
                bins[b].append(i)
                for j in gives:
                    bins[b].remove(j)
                    bins[a].append(j)
                fill[a] += back - n
                fill[b] += n - back
                options.changed(a, b)
                moved = any_moved = True
                if not bins[a]:
                    used -= 1
                    if used <= least:
                        return True
    return any_moved


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _batch(rows: list[tuple], width: int) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * width
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=False)], _NAMES[:width])


def token_pieces(docs: DataFrame, size: int = SEQ_LEN, tokenizer_path: str | None = None, known_words: int = KNOWN_WORDS, keep_words: bool = True) -> DataFrame:
    """One row per piece of every whole text, with the crc32 of its ids.

    ``known_words`` and ``keep_words`` (for the next task of a process) trade memory for time.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = Encoder.of(tokenizer_path)
        for b in batches:
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.ids(b.column(1).to_pylist(), known_words), strict=True):
                out += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_pieces(len(ids) // 4, size))]
            yield _batch(out, 5)
        if not keep_words:
            encoder.known.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def pack_documents(docs: DataFrame, size: int = SEQ_LEN, tokenizer_path: str | None = None, shard_pieces: int = SHARD_PIECES, known_words: int = KNOWN_WORDS, keep_words: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they
    occur, and dealt one by one like any others. A null doc_id stays null. An empty table
    gives no rows; columns other than doc_id and text are not read. Full pieces are
    sequences of their own and are not shuffled. Columns: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.
    """
    pieces = cut(token_pieces(docs, size, tokenizer_path, known_words, keep_words))
    number = F.monotonically_increasing_id()  # of a row in the written table
    full = pieces.where(F.col("length") == size).select("*", (number * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < size)
    shards = max(1, -(-part.count() // shard_pieces))
    dealt = part.withColumn("shard", F.pmod(F.xxhash64(number), F.lit(shards)).cast("int")).repartition(shards, "shard")

    def run(batches):
        per: dict[int, list[tuple]] = defaultdict(list)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                per[row[5]].append(row[:5])
        for shard, rows in per.items():
            rows.sort(key=lambda r: tuple(-1 if x is None else x for x in r))
            out = []
            for seq, group in enumerate(pack_lengths([r[3] for r in rows], size)):
                off = 0
                for i in group:
                    out.append((*rows[i], 2 * (seq * shards + shard), off))
                    off += rows[i][3]
                if len(out) >= 20_000:
                    yield _batch(out, 7)
                    out = []
            yield _batch(out, 7)

    return full.unionByName(dealt.mapInArrow(run, f"{PIECE_SCHEMA}, sequence_id long, `offset` long"))
