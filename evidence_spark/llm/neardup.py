"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes through the mean of all vectors, writes the signs of a
vector's projections one after the other, and orders all vectors by that word. Vectors of a small angle often share long
prefixes and so stand close together: each is compared, by exact cosine, with the
neighbours in a bounded window. Passes with other hyperplanes find what one pass misses,
and the verified pairs of all passes are united.

The order is cut into blocks at quantiles of a bounded sample of keys, and a key that fills
several blocks is dealt over them, so a block has a bounded number of rows whatever the
data; windows end at block borders, which other passes place elsewhere. Exactly equal
vectors are one representative with a count before any pass, so thousands of copies neither
fill a window nor a block.

A window shows only a part of a large group of near copies. Vectors for which the passes
find many links are therefore compared with every vector of their component, block against
block, which counts their links in it exactly; the other end of such a link counts it, too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import components, cut, mix, small_batches

THRESHOLD = 0.9
#: Passes at least; more follow from the number of vectors (:func:`passes_for`).
PASSES = 12
#: Share of the pairs just at the threshold that the passes should meet.
RECALL = 0.997
#: Passes at most: a mean cosine just below the threshold would ask for more.
MOST_PASSES = 192
PASSES_AT_ONCE = 4
BITS = 62
WINDOW = 256
BLOCK_ROWS = 4096
#: Keys that the driver sees to place block borders, at most about so many.
SAMPLE_KEYS = 20_000
CHUNK = 256
#: Values of the neighbour lists that one batch may hold.
LIST_VALUES = 2_000_000
#: Rows of a component that one comparison of blocks holds on each side.
GROUP_ROWS = 4096


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, mean: float = 0.0) -> int:
    """Passes that meet :data:`RECALL` of the pairs at the threshold among ``n`` vectors.

    A pass shows a pair if the sign words agree to the depth at which about a window of
    vectors shares a prefix; each sign agrees with probability 1 - angle / pi. ``mean`` is
    the squared length of the mean of the unit vectors, which is their mean cosine: seen
    from the mean, a pair of vectors of a narrow cone is further apart. Where the mean cosine
    itself suffices, most vectors have many links and are compared exactly.
    """
    if mean >= threshold:
        return PASSES
    depth = math.log2(max(1.0, n / window))
    seen = (threshold - mean) / (1 - mean)
    agree = 1 - math.acos(max(-1.0, min(1.0, seen))) / math.pi
    meet = max(1e-6, agree**depth)
    return PASSES if meet >= 1 else min(MOST_PASSES, max(PASSES, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))))


def mean_vectors(classes: DataFrame) -> dict[int, np.ndarray]:
    """The mean unit vector of each vector length."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in unit_groups(b.column(0)):
                own = np.append(x.sum(axis=0), len(x))
                total[x.shape[1]] = total.get(x.shape[1], 0) + own
        for d, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(np.arange(d + 1)), pa.array(own)], ["d", "i", "x"])

    got = classes.select("embedding").mapInArrow(sums, "d long, i long, x double").groupBy("d", "i").agg(F.sum("x").alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    for r in got:  # a number for each dimension and length
        out.setdefault(r["d"], np.zeros(r["d"] + 1))[r["i"]] = r["x"]
    return {d: x[:-1] / x[-1] for d, x in out.items()}


def tie_order(x: np.ndarray, p: int) -> np.ndarray:
    """Projections that order rows of equal sign words in a pass."""
    return x @ np.random.Generator(np.random.PCG64([p, x.shape[1], 1])).standard_normal(x.shape[1])


def deal_runs(keys: np.ndarray, rep: np.ndarray, cuts: np.ndarray, p: int) -> np.ndarray:
    """Blocks of keys; one that is a border several times is dealt over the blocks between."""
    lo, hi = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
    spread = mix(rep.astype(np.uint64) + np.uint64((p + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % (hi - lo + 1).astype(np.uint64)
    return np.where(hi - lo > 1, lo + spread.astype(np.int64), hi)


def sign_keys(x: np.ndarray, passes: range) -> np.ndarray:
    """Sign words of unit rows for some passes: (passes, rows) of int64."""
    out = np.empty((len(passes), len(x)), np.int64)
    powers = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
    for i, p in enumerate(passes):
        planes = np.random.Generator(np.random.PCG64([p, x.shape[1]])).standard_normal((x.shape[1], BITS))
        out[i] = ((x @ planes) > 0) @ powers
    return out


def _rows(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(a.offsets.to_numpy())


def unit_groups(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors for each vector length in a list column."""
    flat, size = _rows(column)
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = flat[start[at][:, None] + np.arange(d)[None, :]]
        peak = np.abs(x).max(1, keepdims=True)
        x = x / peak
        out.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def window_links(x: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), both ways, of rows at most ``window`` apart with a cosine that suffices."""
    left, right = [], []
    for s in range(0, len(x), CHUNK):
        lo, hi = max(0, s - window), min(len(x), s + CHUNK + window)
        i, j = np.nonzero(x[s : s + CHUNK] @ x[lo:hi].T >= threshold)
        i, j = i + s, j + lo
        ok = (i != j) & (np.abs(i - j) <= window)
        left.append(i[ok])
        right.append(j[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def local_roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that links reach within a block."""
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    ``vectors`` has vec_id and embedding (array of float or double); other columns, labels
    too, are not read. Null, empty and zero vectors and those with null or non-finite
    components link with nothing. Vectors of different lengths do not link. Rows that
    repeat a vec_id count as vectors of their own that share its component.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(e, lambda v: v != 0)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(~bad, F.lit(False)).alias("ok"))
    same = [F.when(F.col("ok"), F.xxhash64("embedding", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    ided = every.select("vec_id", "embedding", *same)
    classes = cut(
        ided.where("h1 is not null and vec_id is not null").groupBy("h1", "h2")
        .agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    )
    total = classes.count()
    means = mean_vectors(classes)
    passes = passes or max((passes_for(total, threshold, window, float(m @ m)) for m in means.values()), default=PASSES)
    blocks = max(1, -(-total // block_rows))
    share = min(1.0, SAMPLE_KEYS / max(total, 1))

    def keys(batches):
        for b in batches:
            for _, x in unit_groups(b.column(0)):
                k = sign_keys(x - means[x.shape[1]], range(passes))
                yield pa.RecordBatch.from_arrays([pa.array(list(k.T), pa.list_(pa.int64()))], ["k"])

    sample = classes.where(F.pmod(F.xxhash64("rep", F.lit(6)), F.lit(1_000_000)) < int(share * 1_000_000)).select("embedding")
    seen = np.array([r["k"] for r in sample.mapInArrow(keys, "k array<long>").collect()], np.int64).reshape(-1, passes)
    cuts = np.quantile(seen, np.arange(1, blocks) / blocks, axis=0, method="nearest").T if len(seen) else np.zeros((passes, 0), np.int64)

    def dealt(part: range):
        def run(batches):
            for b in batches:
                for at, x in unit_groups(b.column(1)):
                    rows = b.take(pa.array(at))
                    for p, k in zip(part, sign_keys(x - means[x.shape[1]], part), strict=True):
                        block = p * blocks + deal_runs(k, rows.column(0).to_numpy(), cuts[p], p)
                        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(block), pa.array(k)], ["rep", "embedding", "n", "block", "key"])

        return run

    def compare(batches):
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        block = t.column("block").to_numpy()
        for one in np.unique(block):
            part = t.take(pa.array(np.flatnonzero(block == one)))
            rep, n, key = (part.column(c).to_numpy() for c in ("rep", "n", "key"))
            for at, x in unit_groups(part.column("embedding")):
                order = np.lexsort((tie_order(x - means[x.shape[1]], int(one) // blocks), key[at]))
                at, x = at[order], x[order]
                i, j = window_links(x, window, threshold)
                if not len(i):
                    continue
                ids, count = rep[at], n[at]
                root = local_roots(len(at), i, j, ids)
                by = np.argsort(i, kind="stable")
                i, j = i[by], j[by]
                own, first = np.unique(i, return_index=True)
                offsets = pa.array(np.append(first, len(i)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array(root[own]), pa.ListArray.from_arrays(offsets, pa.array(ids[j])), pa.ListArray.from_arrays(offsets, pa.array(count[j]))],
                    ["rep", "root", "near", "times"],
                )

    emb = classes.schema["embedding"].dataType.simpleString()
    found = None
    for s in range(0, passes, PASSES_AT_ONCE):
        part = range(s, min(passes, s + PASSES_AT_ONCE))
        out = classes.select("rep", "embedding", "n").mapInArrow(dealt(part), f"rep long, embedding {emb}, n long, block long, key long").repartition(max(1, blocks * len(part)), "block")
        out = cut(out.mapInArrow(compare, "rep long, root long, near array<long>, times array<long>"))
        found = out if found is None else found.union(out)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("near", "times")]

    def union(batches):
        for b in batches:
            links, near_classes = [], []
            for i in range(len(b)):
                near, times = (b.column(c)[i].values.to_numpy() for c in (1, 2))
                first = np.unique(near, return_index=True)[1]
                links.append(int(times[first].sum()))
                near_classes.append(len(first))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(links, pa.int64()), pa.array(near_classes, pa.int64())], ["rep", "links", "near"])

    def linked(found: DataFrame) -> DataFrame:
        small_batches(spark, max(1, LIST_VALUES // (2 * window * passes)))
        out = cut(found.groupBy("rep").agg(*lists).mapInArrow(union, "rep long, links long, near long"))
        small_batches(spark, 4000)
        return out

    links = linked(found.select("rep", "near", "times"))
    comp = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    whole = _whole_groups(classes, links, comp, threshold, window)
    links = links.drop("near")
    if whole is not None:
        exact, back = whole
        # a vector that is not crowded has the links of its windows and those that crowded ones have to it
        one_end = back.select("rep").distinct()
        more = linked(found.select("rep", "near", "times").join(one_end, "rep", "left_semi").unionByName(back)).drop("near")
        links = links.join(more.withColumnRenamed("links", "more"), "rep", "left").join(exact, "rep", "left").select("rep", F.coalesce("exact", "more", "links").alias("links"))
    per = classes.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    per = per.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = ided.drop("embedding").join(per, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _whole_groups(classes: DataFrame, links: DataFrame, comp: DataFrame, threshold: float, window: int) -> tuple[DataFrame, DataFrame] | None:
    """``rep, exact``: links within their component of the vectors whose windows are crowded;
    and ``rep, near, times``: the crowded vectors that each other one links to.

    Each of them is compared with every vector of the component, a block of one against a
    block of the other in a group of rows, so no task holds more than two blocks at once.
    """
    crowded = links.where(F.col("near") >= max(1, window // 4)).select("rep", F.lit(True).alias("crowded"))
    row = cut(comp.withColumnRenamed("id", "rep").join(crowded, "rep", "left"))
    size = row.groupBy("component").agg(F.count("*").alias("m"), F.count("crowded").alias("q")).where("q > 0")
    size = cut(size.select("component", F.ceil(F.col("m") / GROUP_ROWS).cast("int").alias("ms"), F.ceil(F.col("q") / GROUP_ROWS).cast("int").alias("qs")))
    tasks = size.agg(F.sum(F.col("ms").cast("long") * F.col("qs"))).first()[0]
    if not tasks:
        return None
    row = row.join(size, "component").join(classes.select("rep", "embedding", "n"), "rep").withColumns({"h": F.xxhash64("rep"), "crowded": F.coalesce("crowded", F.lit(False))})
    ms, qs = F.sequence(F.lit(0), F.col("ms") - 1), F.sequence(F.lit(0), F.col("qs") - 1)
    one = row.where("crowded").withColumns({"side": F.lit(0), "u": F.pmod("h", "qs").cast("int")}).withColumn("v", F.explode(ms))
    other = row.withColumns({"side": F.when(F.col("crowded"), 1).otherwise(2), "v": F.pmod("h", "ms").cast("int")}).withColumn("u", F.explode(qs))
    both = one.unionByName(other).select("component", "u", "v", "side", "rep", "embedding", "n").repartition(min(int(tasks), 20_000), "component", "u", "v")

    def across(t: pa.Table) -> pa.Table:
        side, rep, n = (t.column(c).to_numpy() for c in ("side", "rep", "n"))
        ids, count, ends, near, times = ([np.empty(0, np.int64)] for _ in range(5))
        for at, x in unit_groups(t.column("embedding")):
            a, b = side[at] == 0, side[at] > 0
            own, to, weight, plain = rep[at][a], rep[at][b], n[at][b], side[at][b] == 2
            y, xa = x[b].T, x[a]
            for s in range(0, len(xa), CHUNK):
                hit = xa[s : s + CHUNK] @ y >= threshold
                hit &= own[s : s + CHUNK, None] != to[None, :]
                ids.append(own[s : s + CHUNK])
                count.append(hit @ weight)
                i, j = np.nonzero(hit[:, plain])
                ends.append(to[plain][j])
                near.append(own[s : s + CHUNK][i])
                times.append(n[at][a][s : s + CHUNK][i])
        ids, count, ends, near, times = map(np.concatenate, (ids, count, ends, near, times))
        by = np.argsort(ends, kind="stable")
        back, first = np.unique(ends[by], return_index=True)
        offsets = pa.array(np.append(np.zeros(len(ids) + 1), np.append(first[1:], len(ends)) if len(back) else []).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[by])) for v in (near, times)]
        return pa.table({"rep": np.append(ids, back), "exact": pa.array([*count.tolist(), *[None] * len(back)], pa.int64()), "near": lists[0], "times": lists[1]})

    got = cut(both.groupBy("component", "u", "v").applyInArrow(across, "rep long, exact long, near array<long>, times array<long>"))
    exact = cut(got.where("exact is not null").groupBy("rep").agg(F.sum("exact").alias("exact")))
    return exact, got.where("exact is null").select("rep", "near", "times")
