"""Removal of long repeated word passages by compaction of a De Bruijn graph.

Every window of 20 words is an edge from its first to its last 19 words, the nodes.
Consecutive edges that share a minimiser (the least hash among the 7-grams of a window)
are kept together as one piece, an edge between the nodes at its ends: pieces are cut by
content alone, so a repeated passage falls into equal pieces wherever it stands.

* A node's in- and out-degree count the different pieces that end and start there. Where
  both are 1, every text that comes in goes on the same way, or ends. Repeated pieces that
  meet at such a node, and whose first occurrences follow each other in one document, are
  linked; joins that double the length of the links (pointer jumping) give each piece the
  head of its nonbranching path and its distance from it.
* Later occurrences of the pieces of a path, at the same distance from where the path
  would begin, are one span. The first occurrence gives the source coordinates.
* Equal windows always have the same minimiser. Where a minimiser has several different
  pieces (a passage ends inside one: the graph branches there), the single edges of the
  first occurrence of each piece are compared.

A window is repeated if its words start earlier: in a document of smaller id, or earlier
in the same one. Each word of a repeated window goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import cut, drop_cut, gram_hashes, hash_words, mix, small_batches, span_hashes

WINDOW = 20
MINIMISER = 7

def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def least_in_runs(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the first of the least values in each run of ``n``, by doubling."""
    at, width = np.arange(len(x)), 1

    def meet(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(x[right] < x[left], right, left)

    while 2 * width <= n:
        at = meet(at[:-width], at[width:])
        width *= 2
    rest = n - width
    return meet(at[: len(at) - rest], at[rest:]) if rest else at


def pieces(w: np.ndarray, offsets: np.ndarray, k: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, ...]:
    """Text, minimiser, content, tail and head node, first window and number of windows of each piece.

    ``w`` has the word hashes of several texts, one after the other from ``offsets`` on.
    """
    n = len(w) - k + 1
    none = (np.empty(0, np.int64),) * 7
    if n <= 0:
        return none
    grams = gram_hashes(w, m)
    least = least_in_runs(grams, k - m + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(np.arange(n) + k <= offsets[1:][text[:n]])
    if not len(at):
        return none
    least = least[at]
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))))
    size = np.diff(new, append=len(at))
    start = at[new]
    after = start + size
    spread = mix(w)
    content, tail, head = (span_hashes(spread, s, e).view(np.int64) for s, e in ((start, after + k - 1), (start, start + k - 1), (after, after + k - 1)))
    return text[start], grams[least[new]].view(np.int64), content, tail, head, start - offsets[:-1][text[start]], size


def _pieces_of(texts: DataFrame, k: int, m: int, graph: bool) -> DataFrame:
    """Pieces of all texts: content, doc_id, start, size and, for the graph, mini, tail and head."""
    schema = "content long, doc_id long, start int, size int" + (", mini long, tail long, head long" if graph else "")

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, w, offsets in hash_words(b.column(1).to_pylist()):
                text, mini, content, tail, head, start, size = pieces(w, offsets, k, m)
                out = [content, ids[first + text], start.astype(np.int32), size.astype(np.int32), mini, tail, head]
                names = ["content", "doc_id", "start", "size", "mini", "tail", "head"]
                n = 7 if graph else 4
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out[:n]], names[:n])

    return texts.mapInArrow(run, schema)


def compact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``content, src, path, dist``: the nonbranching path of each edge and its place in it.

    ``edges`` are repeated pieces (content, tail, head, size and src, the place of the first
    occurrence), ``nodes`` the nodes (node) of in- and out-degree 1. An edge follows another
    at such a node where its first occurrence follows, too, which also rules out cycles.
    ``path`` is the content of the first edge, ``dist`` the windows before this one.
    """
    came = edges.select(F.col("head").alias("node"), F.col("content").alias("prev"), F.col("size").alias("step"), F.col("src.doc_id").alias("d"), (F.col("src.start") + F.col("size")).alias("s"))
    goes = edges.select(F.col("tail").alias("node"), "content", F.col("src.doc_id").alias("to_d"), F.col("src.start").alias("to_s"))
    # at these nodes one edge ends and one starts, so a join by node gives a row each
    links = nodes.join(came, "node").join(goes, "node").where("d = to_d and s = to_s and prev <> content").select("content", "prev", "step")
    links = cut(links)
    # an edge that only others follow is the head of its path
    heads = links.select(F.col("prev").alias("content")).join(links.select("content"), "content", "left_anti")
    state = links.select("content", F.col("prev").alias("path"), F.col("step").alias("dist"), F.lit(False).alias("done"))
    state = cut(state.unionByName(heads.select("content", F.col("content").alias("path"), F.lit(0).alias("dist"), F.lit(True).alias("done"))))
    drop_cut(links)
    while state.where("not done").limit(1).count():
        up = state.select(F.col("content").alias("path"), F.col("path").alias("top"), F.col("dist").alias("more"), F.col("done").alias("ends"))
        longer = state.where("not done").join(up, "path").select("content", F.col("top").alias("path"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ends").alias("done"))
        new = cut(state.where("done").unionByName(longer))
        drop_cut(state)
        state = new
    placed = state.select("content", "path", "dist")
    out = cut(edges.select("content", "src").join(placed, "content", "left").select("content", "src", F.coalesce("path", "content").alias("path"), F.coalesce("dist", F.lit(0)).alias("dist")))
    drop_cut(state)
    return out


def _windows_of(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Hash and place of each window in the wanted pieces (doc_id, parts of (start, size))."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            lists = b.column(2)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            start, size = (flat.field(i).to_numpy().astype(np.int64) for i in range(2))
            for first, w, offsets in hash_words(b.column(1).to_pylist()):
                g = gram_hashes(w, k)
                n = len(offsets) - 1
                lo, hi = bounds[first], bounds[first + n]
                text = np.repeat(np.arange(n), np.diff(bounds[first : first + n + 1]))
                size_here = size[lo:hi]
                doc = np.repeat(text, size_here)
                place = np.repeat(start[lo:hi] - np.concatenate(([0], np.cumsum(size_here)[:-1])), size_here) + np.arange(size_here.sum())
                ok = place + k <= np.diff(offsets)[doc]
                doc, place = doc[ok], place[ok]
                yield pa.RecordBatch.from_arrays([pa.array(g[offsets[doc] + place].view(np.int64)), pa.array(ids[first + doc]), pa.array(place.astype(np.int32))], ["win", "doc_id", "start"])

    return texts.join(wanted, "doc_id").select("doc_id", "text", "parts").mapInArrow(run, "win long, doc_id long, start int")


def repeated_spans(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Spans of repeated words: doc_id, start, end (exclusive), src_doc, src_start.

    The words from ``start`` to ``end`` of doc_id also stand from ``src_start`` on in
    src_doc, earlier in the order of the module's text. Spans may overlap.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    place = F.min(F.struct("doc_id", "start")).alias("src")
    firsts = _pieces_of(texts, k, m, True).groupBy("mini", "content").agg(place, *[F.first(c).alias(c) for c in ("size", "tail", "head")], F.count("*").alias("n"))
    # of a piece that occurs once the content is not looked at again
    firsts = cut(firsts.select("mini", F.when(F.col("n") > 1, F.col("content")).alias("content"), "src", "size", "tail", "head"))

    # degrees of the nodes over all different pieces
    ends = firsts.select(F.explode(F.array(F.struct(F.col("tail").alias("node"), F.lit(0).alias("into")), F.struct(F.col("head").alias("node"), F.lit(1).alias("into")))).alias("x"))
    nodes = ends.groupBy("x.node").agg(F.count("*").alias("all"), F.sum("x.into").alias("into")).where("`all` = 2 and `into` = 1").select("node")
    edges = compact(firsts.where("content is not null").select("content", "tail", "head", "size", "src"), nodes)

    # later occurrences, joined along their paths
    again = _pieces_of(texts, k, m, False).join(edges, "content").where((F.col("doc_id") != F.col("src.doc_id")) | (F.col("start") != F.col("src.start")))
    whole = again.groupBy("doc_id", "path", (F.col("start") - F.col("dist")).alias("begin")).agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("size")) + (k - 1)).alias("end"), F.first("src.doc_id").alias("src_doc"), F.min("src.start").alias("src_start")
    )
    whole = cut(whole.select("doc_id", "start", "end", "src_doc", "src_start"))
    drop_cut(edges)

    # branches: several pieces of one minimiser
    branch = cut(firsts.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1").select("mini"))
    parts = firsts.join(branch, "mini").groupBy(F.col("src.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("src.start").alias("start"), "size")).alias("parts"))
    wins = cut(_windows_of(texts, cut(parts), k))
    drop_cut(firsts)
    first_win = cut(wins.groupBy("win").agg(F.min(F.struct("doc_id", "start")).alias("src"), F.count("*").alias("n")).where("n > 1").select("win", "src"))
    single = wins.join(first_win, "win").where((F.col("doc_id") != F.col("src.doc_id")) | (F.col("start") != F.col("src.start")))
    single = single.select("doc_id", "start", (F.col("start") + k).alias("end"), F.col("src.doc_id").alias("src_doc"), F.col("src.start").alias("src_start"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of ``docs``.

    Null and empty texts have no words. A null doc_id is not compared and keeps its words.
    Rows that repeat a doc_id with the same text are one document and fare alike. Other
    columns are not read.
    """
    spans = cut(repeated_spans(docs, k, m).select("doc_id", "start", "end"))
    per_doc = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = src.join(per_doc, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, np.int64)
                for s in found or ():
                    gone[min(s["start"], len(words))] += 1
                    gone[min(s["end"], len(words))] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                kept = b" ".join([w for w, y in zip(words, stays.tolist(), strict=True) if y])
                rows.append((doc, len(words), int(len(words) - stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
