"""Ranked lexical search by presence masks: the best documents of each item.

Terms of all documents are looked up among the items' terms once, and what is found is
written as postings. A task then takes documents in blocks. For an item, a bit for each of
its terms is set in the masks of the documents that hold the term; documents with one mask
form a group, whose score is at most the sum of the terms' largest parts in the block.
Groups are scored by falling bounds until the next bound is below the tenth score so far,
which ends the search without losses. Tasks give their ten best, which are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.llm.common import cut, drop_cut, small_batches, span_hashes

TOP = 10
#: Characters of the items that are searched together; their terms are what tasks are sent.
ITEM_CHARS = 4_000_000
#: Documents, and postings, of a block.
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 2_000_000
#: Bytes of text that are hashed at once.
PART = 1 << 18
#: Documents that are scored together at least.
STEP = 128

_BYTE = np.random.Generator(np.random.PCG64(33)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
#: Bytes of terms: digits, letters and whatever is not ASCII.
_TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _hash_part(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([0], _TERM[buf].view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(_BYTE[buf], start, end), start


def term_hashes(texts: list[str | None]):
    """Hashes of the terms of whole texts, a bounded part at a time: (first text, hashes, text of each hash).

    The texts of one call are numbered on; those of a part may be one piece of a long text.
    """
    group, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if group and size + len(raw) > PART:
            yield from _joined(group, first)
            group, first, size = [], i, 0
        at = 0
        while len(raw) - at > PART:  # a part ends before a byte that is in no term
            end = at + PART
            while end < len(raw) and _TERM[raw[end]]:
                end += 1
            h, _ = _hash_part(raw[at:end])
            yield i, h, np.zeros(len(h), np.int64)
            at = end
        group.append(raw[at:] if at else raw)
        size += len(group[-1]) + 1
    if group:
        yield from _joined(group, first)


def _joined(group: list[bytes], first: int):
    h, start = _hash_part(b" ".join(group))
    begin = np.cumsum([0] + [len(x) + 1 for x in group[:-1]])
    yield first, h, np.searchsorted(begin, start, "right") - 1


def _postings(terms: np.ndarray):
    """Rows (doc_id, n, terms, tfs) of documents, for the sorted hashes ``terms``."""
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            n, of, found = np.zeros(len(texts), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for first, h, text in term_hashes(texts):
                n += np.bincount(text + first, minlength=len(texts))
                at = np.searchsorted(terms, h)
                hit = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == h)
                of.append(text[hit] + first)
                found.append(at[hit])
            key, tf = np.unique(np.concatenate(of) * len(terms) + np.concatenate(found), return_counts=True)
            doc, term = np.divmod(key, len(terms))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
            cols = [b.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n", "terms", "tfs"])

    return run


def _count(width: int):
    """Documents that hold each term; then documents with terms, and all their terms."""

    def run(batches):
        total = np.zeros(width + 2, np.int64)
        for b in batches:
            total[:width] += np.bincount(b.column(1).values.to_numpy(), minlength=width)
            n = b.column(0).to_numpy()
            total[width] += np.count_nonzero(n)
            total[width + 1] += n.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "df"])

    return run


def document_lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """``100 - 75 + ((75 * n * docs) div total)``, exact where products pass 64 bits, too."""
    if not len(n) or int(n.max()) * docs < (1 << 63) // 75:
        return 25 + 75 * n * docs // total
    return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)


class Block:
    """Postings of a block of documents by term, with the part that each gives to a score."""

    def __init__(self, docs: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, count: int, total: int) -> None:
        # ties go to the smallest id, so documents are numbered by id; null comes last
        order = np.argsort(np.array([np.inf if d is None else 0 for d in docs]), kind="stable")
        order = order[np.argsort(np.array([docs[i] if docs[i] is not None else (1 << 63) - 1 for i in order], np.int64), kind="stable")]
        place = np.empty(len(docs), np.int64)
        place[order] = np.arange(len(docs))
        self.ids = [docs[i] for i in order]
        doc = np.repeat(place, sizes)
        by = np.lexsort((doc, terms))
        self.doc = doc[by]
        m = document_lengths(n, count, total)[order][self.doc] if total else np.empty(0, np.int64)
        tf = tfs[by]
        self.part = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        self.term, self.start = np.unique(terms[by], return_index=True)
        self.end = np.append(self.start[1:], len(by))
        self.most = np.maximum.reduceat(self.part, self.start) if len(by) else np.empty(0, np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, top: list[tuple[int, int, int | None]], k: int) -> list:
        """``top`` with this block's documents: the ``k`` best of (-score, id is null, id).

        ``terms`` are the item's, each once; ``weights`` hold their repeats.
        """
        if not len(self.term):
            return top
        at = np.searchsorted(self.term, terms)
        have = self.term[np.minimum(at, len(self.term) - 1)] == terms
        at, weights = at[have], weights[have]
        lists = [slice(self.start[t], self.end[t]) for t in at]
        masks = np.zeros((len(self.ids), -(-len(lists) // 64)), np.uint64)
        for j, s in enumerate(lists):
            masks[self.doc[s], j // 64] |= np.uint64(1 << (j % 64))
        some = np.flatnonzero(masks.any(axis=1))
        if not len(some):
            return top
        masks = np.ascontiguousarray(masks[some])
        keys = masks[:, 0] if masks.shape[1] == 1 else masks.view([("", np.uint64)] * masks.shape[1])[:, 0]
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        most = weights * self.most[at]
        bound = np.zeros(len(first), np.int64)
        for j in range(len(lists)):
            bound += ((masks[first, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * most[j]
        ranked = np.argsort(-bound, kind="stable")
        members = some[np.argsort(np.argsort(ranked)[group], kind="stable")]  # by the rank of their group
        ends = np.cumsum(np.bincount(group)[ranked])
        done = g = 0
        while g < len(ranked):
            if len(top) == k and -top[-1][0] > bound[ranked[g]]:
                break
            g = min(len(ranked), max(g + 1, int(np.searchsorted(ends, done + STEP))))
            docs = np.sort(members[done : ends[g - 1]])
            done = int(ends[g - 1])
            score = np.zeros(len(docs), np.int64)
            for w, s in zip(weights, lists, strict=True):
                own = self.doc[s]
                i = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                score += np.where(own[i] == docs, w * self.part[s][i], 0)
            best = np.argsort(-score, kind="stable")[:k]
            found = [(-int(score[i]), self.ids[docs[i]] is None, self.ids[docs[i]]) for i in best if score[i] > 0]
            top = sorted(top + found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        return top


def _search(items: list[tuple[int | None, np.ndarray, np.ndarray]], count: int, total: int, k: int):
    def run(batches):
        top = [[] for _ in items]
        held: list[tuple] = []

        def flush() -> None:
            cols = [np.concatenate(x) for x in zip(*(h[1:] for h in held), strict=True)]
            block = Block([d for h in held for d in h[0]], *cols, count, total)
            for i, (_, terms, weights) in enumerate(items):
                top[i] = block.search(terms, weights, top[i], k)
            held.clear()

        docs = postings = 0
        for b in batches:
            lists, tfs = b.column(2), b.column(3)
            held.append((b.column(0).to_pylist(), b.column(1).to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), tfs.flatten().to_numpy()))
            docs, postings = docs + b.num_rows, postings + len(held[-1][3])
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                flush()
                docs = postings = 0
        if held:
            flush()
        rows = [(item, doc, -score) for (item, _, _), best in zip(items, top, strict=True) for score, _, doc in best]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item: first of parts of an item's rows, then of all."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    parts = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, item_chars: int = ITEM_CHARS) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Only documents with a score above 0 are given; equal scores rank by ascending doc_id, a
    null doc_id last. Every row is a document, repeated rows too. Null and empty texts have
    no terms. Long texts are read whole. Items without terms, and empty tables, give no
    rows; of several texts of an item_id (null is one) the smallest counts. Columns other
    than doc_id, text and item_id, text are not read.

    Items are taken in blocks of at most ``item_chars`` characters, or of one item; only a
    block's terms are sent to tasks, and each block reads the documents anew.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = cut(items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text")).where("text is not null"))
    found = [_block_search(texts, block, k) for block in _blocks(asked, item_chars)]
    drop_cut(asked)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _blocks(asked: DataFrame, item_chars: int):
    """Items in blocks of bounded size."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        over = asked.groupBy(block.alias("block")).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("items")).where((F.col("chars") > item_chars) & (F.col("items") > 1))
        if over.isEmpty():
            break
        n *= 2
    for i in range(n):
        rows = [(r["item_id"], r["text"]) for r in asked.where(block == i).collect()]
        if rows:
            yield rows


def _block_search(texts: DataFrame, items: list[tuple[int | None, str]], k: int) -> DataFrame:
    spark = texts.sparkSession
    own = [np.unique(np.concatenate([np.empty(0, np.uint64), *(h for _, h, _ in term_hashes([text]))]), return_counts=True) for _, text in items]
    terms = np.unique(np.concatenate([np.empty(0, np.uint64), *(h for h, _ in own)]))
    if not len(terms):
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    postings = cut(texts.mapInArrow(_postings(terms), "doc_id long, n long, terms array<int>, tfs array<long>"))
    counts = postings.select("n", "terms").mapInArrow(_count(len(terms)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(terms) + 2, np.int64)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    count, total = int(df[-2]), int(df[-1])
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(x) + 1))) for x in df[:-2]], np.int64)
    asked = []
    for (item, _), (h, times) in zip(items, own, strict=True):
        at = np.searchsorted(terms, h)
        asked.append((item, at, times * weight[at]))
    best = cut(_best(postings.mapInArrow(_search(asked, count, total, k), "item_id long, doc_id long, score long"), k))
    drop_cut(postings)
    return best
