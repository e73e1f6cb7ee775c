"""Exact Jaccard self-join of documents on word shingles by T-occurrence search.

A document is the set of hashes of its 5-word shingles. Two sets of sizes n and m reach
Jaccard t only if they share T = t/(1+t) * (n+m) shingles. The search for the partners of
a document (the query) is DivideSkip: inverted lists say which documents have a shingle;
of the query's lists the L longest are set aside, the others are merged by a heap, which
counts how often each document occurs; documents that occur T - L times or more are
binary-probed in the long lists, and those that reach the overlap they need are links.

How that runs on Spark:

* Equal sets are one class; its smallest doc_id stands for all (nothing is lost: they link).
* Routing: the ``n - ceil(t*n) + 1`` rarest shingles of two linked documents have one in
  common, so a shuffle by these tells which documents may meet. Frequent shingles (from
  counts over all documents) come last in the order, so common passages rarely route.
* Round 1 routes each member of such a list to the list's smallest document only, so a list
  of g documents gives g - 1 places. That document is the query of a cell, its members are
  indexed in inverted lists, and the search runs cell by cell. Links make components.
* Round 2 does the same for members of a list whose components still differ; any other pair
  cannot change the result. Together the rounds decide every pair that matters, so the join
  is exact. Cells with many members are split, each part with the query.
* A pair is routed only while the shingles seen missing do not already exceed what the
  threshold lets two documents differ by. A parity sketch (each hash flips one of 1024
  bits) bounds the difference of the whole sets from below: two sketches never differ in
  more bits than the sets do in hashes. Neither filter can lose a link.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import components, cut, drop_cut, gram_hashes, hash_words, mix, small_batches

WORDS = 5
#: Similarity 0.8 as a whole number of hundredths.
PERCENT = 80
#: A hash in more documents than this counts as frequent; only the order depends on it.
FREQUENT = 24
#: At most so many frequent hashes are told to the tasks (8 bytes each).
MAX_FREQUENT = 1_000_000
#: Frequencies are counted for the hashes below this share of the hash range.
LOW_SHARE = 0.3
#: Members of a list whose sketches are compared in one task with as many others.
CHUNK = 8192
#: Members of one part of a cell, and hashes that are indexed at once.
CELL_MEMBERS, CELL_HASHES = 256, 4_000_000
#: Weight of the length of lists in the number of long ones, as DivideSkip's authors give it.
LONG_WEIGHT = 0.0085
#: Probes of long lists at once.
PROBES = 1_000_000
#: 64-bit words of a parity sketch.
SKETCH = 16


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text (A-Z lower-cased)."""
    out = []
    for _, h, offsets in hash_words(texts, lower=True):
        grams = gram_hashes(h, k)
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if e - s >= k:
                out.append(np.unique(grams[s : e - k + 1]))
            else:
                out.append(mix(gram_hashes(h[s:e], e - s) + np.uint64(e - s)) if e > s else np.empty(0, np.uint64))
    return out


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _frequent(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes that more than FREQUENT documents have, counted over all of them."""
    top = np.uint64(int(LOW_SHARE * 2**64))

    def run(batches):
        for b in batches:
            sets = [h[: np.searchsorted(h, top)] for h in shingle_sets(b.column(1).to_pylist(), k)]
            h, c = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    counts = texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > FREQUENT)
    rows = counts.orderBy(F.desc("c"), "h").limit(MAX_FREQUENT).select("h").toArrow().column(0)
    return np.sort(rows.to_numpy().astype(np.int64).view(np.uint64))


def _signatures(texts: DataFrame, frequent, k: int, percent: int) -> DataFrame:
    """doc_id, class (hash of the whole set; null if empty), size, and the short lists' hashes."""

    def run(batches):
        hot = frequent.value
        for b in batches:
            cls, size, prefix, sketch = [], [], [], []
            for h in shingle_sets(b.column(1).to_pylist(), k):
                n = len(h)
                size.append(n)
                if not n:
                    cls.append(None)
                    prefix.append(None)
                    sketch.append(None)
                    continue
                cls.append(int(mix((mix(h) * np.arange(1, 2 * n, 2, dtype=np.uint64)).sum(keepdims=True)).view(np.int64)[0]))
                sketch.append(np.packbits(np.bincount(h >> np.uint64(54), minlength=64 * SKETCH) & 1).view(np.int64))
                at = np.searchsorted(hot, h)
                is_hot = (hot[np.minimum(at, len(hot) - 1)] == h) if len(hot) else np.zeros(n, bool)
                p = n - _need(n, percent) + 1
                prefix.append(np.concatenate([h[~is_hot], h[is_hot]])[:p].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "cls", "n", "prefix", "sketch"])

    return texts.mapInArrow(run, "doc_id long, cls long, n long, prefix array<long>, sketch array<long>")


def _prune(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) over all their common short lists that can still reach the threshold.

    ``pairs`` has a row per common hash: a, n, pa (place of the hash in a's order) and b,
    m, pb. Up to the last common place, a has pa + 1 hashes, b pb + 1, of which c are
    common; and of the two, the one whose short lists end first has no further common one
    among them. All these are in the symmetric difference, which the threshold bounds.
    """
    t = percent
    g = pairs.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.count("*").alias("c"))
    short = lambda n: F.expr(f"{n} - ceil({t} * {n} / 100D) + 1")
    differ = F.col("pa") + F.col("pb") + 2 - 2 * F.col("c") + F.least(short("n") - F.col("pa") - 1, short("m") - F.col("pb") - 1)
    most = F.expr(f"(n + m) * {100 - t} / {100 + t}D")
    return g.where((F.least("n", "m") * 100 >= F.greatest("n", "m") * t) & (differ <= most + 1e-6)).select("a", "b", most.alias("most"))


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose parity sketches differ in no more bits than the threshold allows."""
    left = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    bits = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH)), F.lit(0))
    return pairs.join(left, "a").join(right, "b").where(bits <= F.col("most") + 1e-6).select("a", "b")


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of list members of different components that no filter rules out.

    ``lists`` has h, len, d, n, p (place of h in d's order), comp and sketch. A list longer
    than CHUNK is dealt to chunks, and each pair of chunks is compared in one task, block
    by block in numpy; only pairs that pass are rows. With the overlap o that n and m need,
    a common hash must be among the first n - o + 1 of one and m - o + 1 of the other, the
    hashes before the first common one are in the difference, and so are at least as many
    hashes as the parity sketches differ in bits.
    """
    k = F.ceil(F.col("len") / CHUNK).cast("int")
    dealt = lists.withColumn("c", F.pmod(F.xxhash64("d"), k).cast("long")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1)))
    dealt = dealt.select("h", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), "c", "d", "n", F.col("p").cast("long").alias("p"), "comp", "sketch")
    dealt = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    def compare(v: np.ndarray, s: np.ndarray):
        left = v[:, 3] == v[0, 1]
        right = v[:, 3] == v[0, 2]
        a, b, sa, sb = v[left], v[right], s[left], s[right]
        for at in range(0, len(a), 128):
            x, sx = a[at : at + 128], sa[at : at + 128]
            n, m = x[:, 5][:, None], b[:, 5][None, :]
            o = -(-percent * (n + m) // (100 + percent))
            px, pb = x[:, 6][:, None], b[:, 6][None, :]
            may = (x[:, 7][:, None] != b[:, 7][None, :]) & (px <= n - o) & (pb <= m - o) & (px + pb <= n + m - 2 * o)
            if v[0, 1] == v[0, 2]:
                may &= x[:, 4][:, None] < b[:, 4][None, :]
            u, w = np.nonzero(may)
            if len(u):
                differ = np.bitwise_count(sx[u] ^ sb[w]).sum(1)
                ok = differ <= (n + m - 2 * o)[u, w]
                yield x[u[ok], 4], b[w[ok], 4]

    def run(batches):
        v, s = np.empty((0, 8), np.int64), np.empty((0, SKETCH), np.uint64)

        def done(v, s):
            edge = [0, *(np.flatnonzero((v[1:, :3] != v[:-1, :3]).any(1)) + 1), len(v)]
            found = [p for f, t in zip(edge, edge[1:], strict=False) if t - f > 1 for p in compare(v[f:t], s[f:t])]
            a, b = (np.concatenate([p[i] for p in found]) if found else np.empty(0, np.int64) for i in (0, 1))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            both = np.unique(np.stack([lo, hi], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            v = np.concatenate([v, np.stack([batch.column(i).to_numpy() for i in range(8)], 1)])
            s = np.concatenate([s, batch.column(8).flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)])
            if not len(v):
                continue
            last = np.flatnonzero((v[:, :3] == v[-1, :3]).all(1))[0]
            yield done(v[:last], s[:last])
            v, s = v[last:], s[last:]
        yield done(v, s)

    return dealt.mapInArrow(run, "a long, b long").distinct()


class Lists:
    """Inverted lists of some sets: for each hash, the numbers of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        hashes = np.concatenate(sets)
        members = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self.members = members[order]
        self.keys, start = np.unique(hashes[order], return_index=True)
        self.start = np.append(start, len(hashes))
        # list number and member in one value: sorted, as lists and their members are
        self.places = np.repeat(np.arange(len(self.keys)), np.diff(self.start)) * len(sets) + self.members

    def partners(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets that reach the similarity with a sorted set, by DivideSkip."""
        n, m = len(query), self.sizes
        able = (m > 0) & (100 * m >= percent * n) & (100 * n >= percent * m)
        if not n or not able.any():
            return np.empty(0, np.int64)
        need = -(-percent * (n + m) // (100 + percent))
        t = int(need[able].min())
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        length = self.start[at + 1] - self.start[at]
        if len(at) < t:
            return np.empty(0, np.int64)
        at = at[np.argsort(length, kind="stable")]
        n_long = min(t - 1, int(t / (LONG_WEIGHT * math.log2(max(int(length.max()), 1)) + 1)), len(at))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        lists = [self.members[s:e].tolist() for s, e in zip(self.start[short].tolist(), self.start[short + 1].tolist(), strict=True)]
        seen = [(k, sum(1 for _ in same)) for k, same in groupby(heapq.merge(*lists))]
        found = np.array([(k, c) for k, c in seen if c >= t - n_long and able[k]], np.int64).reshape(-1, 2)
        who, total = found[:, 0], found[:, 1]
        step = max(1, PROBES // max(1, len(who)))
        for s in range(0, len(long), step):
            probe = long[s : s + step, None] * len(m) + who[None, :]
            hit = np.minimum(np.searchsorted(self.places, probe), len(self.places) - 1)
            total = total + (self.places[hit] == probe).sum(0)
        return who[total >= need[who]]


def _search(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among routed pairs (a, b): ``a`` is the query of a cell, ``b`` its member.

    Each text goes to its cells once, the query to every part of its cell.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL_MEMBERS).cast("int").alias("parts"))
    member = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("b").alias("doc_id"))
    query = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("a").alias("doc_id"))
    routed = cut(member.unionByName(query))
    cells = texts.join(routed, "doc_id").select("a", "part", "side", "doc_id", "text")
    small_batches(texts.sparkSession, 500)

    def run(batches):
        cell, queries, members, ids, held = None, [], [], [], 0
        last, seen = None, set()  # the document of the row before, and its sets so far
        links: list[tuple[int, int]] = []

        def search():
            if members and queries:
                lists = Lists(members)
                for q in queries:
                    links.extend((cell[0], ids[i]) for i in lists.partners(q, percent).tolist())

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), shingle_sets(batch.column(4).to_pylist(), k), strict=True)
            for a, part, side, doc, found in rows:
                if (a, part) != cell or held > CELL_HASHES:
                    search()
                    members, ids, held = [], [], 0
                    if (a, part) != cell:
                        cell, queries = (a, part), []
                if (a, part, side, doc) != last:
                    last, seen = (a, part, side, doc), set()
                if (same := found.tobytes()) in seen:  # a repeated row
                    continue
                seen.add(same)
                if side == 0:
                    queries.append(found)
                elif len(found):
                    members.append(found)
                    ids.append(doc)
                    held += len(found)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])
                links.clear()
        search()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    dealt = cells.repartition("a", "part").sortWithinPartitions("a", "part", "side", "doc_id")
    out = cut(dealt.mapInArrow(run, "a long, b long"))
    drop_cut(routed)
    return out


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document.

    Links are pairs with 100 * intersection >= percent * union. Null and empty texts have
    an empty set and are their own component. Rows that repeat a doc_id are one document,
    linked through each of its texts; all its rows with words have one component. A null
    doc_id is not compared and has the component of equal texts, else null. An empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(texts, k))
    sig = cut(_signatures(texts, frequent, k, percent))
    known = sig.where("cls is not null and doc_id is not null")
    classes = cut(known.groupBy("cls").agg(F.min(F.struct("doc_id", "n", "prefix", "sketch")).alias("r")).select("cls", F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.prefix").alias("prefix"), F.col("r.sketch").alias("sketch")))

    rows = classes.select(F.col("rep").alias("d"), "n", F.posexplode("prefix").alias("p", "h"))
    lists = cut(rows.join(rows.groupBy("h").agg(F.min("d").alias("lead"), F.count("*").alias("len")).where("len > 1"), "h"))
    lead = lists.where("d = lead").select("h", F.col("d").alias("a"), "n", F.col("p").alias("pa"))
    first = lists.where("d <> lead").select("h", F.col("d").alias("b"), F.col("n").alias("m"), F.col("p").alias("pb")).join(lead, "h")
    links = _search(cut(_sketched(_prune(first, percent), classes)), texts, k, percent)
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    if repeated.limit(1).count():  # texts of one doc_id are one document
        own = known.join(repeated, "doc_id").join(classes.select("cls", "rep"), "cls").select("doc_id", "rep").distinct()
        links = links.union(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b"))
    comp = components(links)

    # round 2: lists that still touch several components
    now = classes.select(F.col("rep").alias("d"), "sketch").join(comp.withColumnRenamed("id", "d"), "d", "left")
    mine = lists.join(now, "d").withColumn("comp", F.coalesce("component", "d")).select("h", "len", "d", "n", "p", "comp", "sketch")
    open_lists = mine.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("h")
    small_batches(spark, 10_000)
    again = cut(_across(mine.join(open_lists, "h"), percent))
    drop_cut(lists)
    more = _search(again, texts, k, percent)
    if more.limit(1).count():
        comp = components(links.union(more))
    small_batches(spark)
    of_class = classes.select("cls", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("found"))
    got = sig.select("doc_id", "n", "cls").join(of_class, "cls", "left")
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays (the one with the least hash of all columns);
    rows without a doc_id stay. All columns stay, whatever their names.
    """
    found = jaccard_components(docs, k, percent).where("doc_id is not null")
    per = found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("rows"))
    marks = cut(per.where("c <> doc_id or rows > 1").select(F.col("doc_id").alias("id"), (F.col("c") == F.col("doc_id")).alias("stays")))
    names = docs.columns
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    if not marks.where("stays").limit(1).count():
        return row.join(marks, "id", "left_anti").select("row.*")
    both = row.join(marks, "id", "left")
    once = both.where("stays").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return both.where("stays is null").select("row.*").unionByName(once.select("row.*"))
