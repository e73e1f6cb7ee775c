"""Language identification by the nearest of several TF-IDF centroids per language.

Character 1- to 3-grams of the lower-cased text (runs of anything but letters count as
one space) are hashed to ``dims`` counts, damped by ``log1p``, weighted by inverse
document frequency and scaled to length 1. Spherical k-means splits the training vectors
of each language into a few centroids; a text goes to the language of its nearest
centroid by cosine, and is marked rejected where that cosine is lower than the least
that the training vectors of that language keep to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import crc_mod, cut, drop_cut, small_batches

DIMS = 4096
#: Labelled rows that the centroids are fitted on, at most for each language.
SAMPLE_PER_LANG = 1000
CENTROIDS = 4
#: Languages of which the shares to sample may be broadcast.
BROADCAST_LANGS = 10_000
#: A text is rejected below this share of the lowest training cosine of its language.
REJECT_SHARE = 0.5

_TABLE: dict[int, np.ndarray] = {}


def _classes() -> np.ndarray:
    """Code point -> lower-cased letter, or a space for all but letters."""
    if not _TABLE:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                out[c] = ord(low) if len(low := ch.lower()) == 1 else c
        _TABLE[0] = out
    return _TABLE[0]


def gram_counts(text: str, dims: int = DIMS) -> np.ndarray | None:
    """Hashed counts of the 1- to 3-grams of the whole text; None without a letter."""
    c = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    if len(c) < 3:
        return None
    a = c * np.uint32(2654435761)
    b = a[:-1] * np.uint32(31) + c[1:] * np.uint32(2246822519)
    t = b[:-1] * np.uint32(131) + c[2:] * np.uint32(3266489917)
    out = np.zeros(dims, np.int64)
    for h in (a, b, t):
        h = h ^ (h >> np.uint32(15))
        out += np.bincount(((h * np.uint32(2246822519)) >> np.uint32(8)) & np.uint32(dims - 1), minlength=dims)
    return out


@dataclass
class LangModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts, dtype=np.float32)
        v *= self.idf.astype(np.float32)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return v

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score between 0 and 1, and whether the distance rejects the text."""
        pred, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows, at = [], []
        for i, t in enumerate(texts):
            if t and (c := gram_counts(t, len(self.idf))) is not None:
                rows.append(c)
                at.append(i)
        if not rows or not len(self.owner):
            return pred, score, rejected
        sim = self.vectors(np.array(rows, np.float32)) @ self.centroids.T
        best = sim.argmax(1)
        for i, b, s in zip(at, best, sim[np.arange(len(best)), best], strict=True):
            k = self.owner[b]
            pred[i], score[i], rejected[i] = self.langs[k], float(min(1.0, max(0.0, s))), bool(s < self.floor[k])
        return pred, score, rejected


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centroids are far-apart rows."""
    cent = x[:1]
    for _ in range(min(k, len(x)) - 1):
        cent = np.vstack([cent, x[(x @ cent.T).max(1).argmin()]])
    for _ in range(rounds):
        own = (x @ cent.T).argmax(1)
        new = [x[own == j].mean(0) if (own == j).any() else cent[j] for j in range(len(cent))]
        cent = np.array([c / max(np.linalg.norm(c), 1e-12) for c in new])
    return cent


def _fit_language(counts: np.ndarray, idf: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Centroids of the count vectors of one language, and the least cosine that it keeps to."""
    v = LangModel([], idf, np.zeros((0, len(idf))), np.zeros(0, int), np.zeros(0)).vectors(counts)
    cents = _cluster(v, k)
    return cents, REJECT_SHARE * float((v @ cents.T).max(1).min())


def fit_langid(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, dims: int = DIMS, k: int = CENTROIDS) -> LangModel:
    """Fit on at most about ``per_lang`` training rows of each language.

    Training rows have text, a lang, and a crc32 of doc_id that is not 2 modulo 4. The
    sample is the rows of each language with the smallest hashes of doc_id: a counting
    pass that does not read texts sets the share to take. Every language is clustered in a
    task of its own, which holds its bounded sample; the driver only gets document
    frequencies and the centroids (at most ``k`` rows for each language). A language of
    which no sampled text has a letter is not learned.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2))
    per = rows.groupBy("lang").agg(F.least(F.lit(per_lang) / F.count("*"), F.lit(1.0)).alias("share"))
    few = per.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    picked = rows.join(F.broadcast(per) if few else per, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.col("share") * 1_000_000).where("text is not null")
    small_batches(docs.sparkSession)

    def counts(batches):
        for b in batches:
            c = [gram_counts(t, dims) for t in b.column(1).to_pylist()]
            keep = [i for i, x in enumerate(c) if x is not None]
            at = [np.flatnonzero(c[i]).astype(np.int32) for i in keep]
            n = [c[i][x].astype(np.int32) for i, x in zip(keep, at, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["lang", "at", "n"])

    sample = cut(picked.select("lang", "text").mapInArrow(counts, "lang string, at array<int>, n array<int>"))

    def seen_in(batches):
        total = np.zeros(dims + 1, np.int64)
        for b in batches:
            total[0] += len(b)
            total[1:] += np.bincount(b.column(0).flatten().to_numpy(), minlength=dims)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["place", "n"])

    df = np.zeros(dims + 1, np.int64)
    for r in sample.select("at").mapInArrow(seen_in, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most dims + 1 rows
        df[r["place"]] = r["n"]
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1.0

    def fit(t: pa.Table) -> pa.Table:
        x = np.zeros((len(t), dims), np.float32)
        for i, (at, n) in enumerate(zip(t.column("at").to_pylist(), t.column("n").to_pylist(), strict=True)):
            x[i, at] = n
        # one order whatever the order of arrival
        cents, floor = _fit_language(x[sorted(range(len(x)), key=lambda i: x[i].tobytes())], idf, k)
        return pa.table({"lang": [t.column("lang")[0].as_py()] * len(cents), "centroid": [c.astype("<f4").tobytes() for c in cents], "floor": [floor] * len(cents)})

    got = sorted(sample.groupBy("lang").applyInArrow(fit, "lang string, centroid binary, floor double").collect())
    drop_cut(sample)
    names = sorted({r["lang"] for r in got})
    at = {name: j for j, name in enumerate(names)}
    cents = np.array([np.frombuffer(r["centroid"], "<f4") for r in got], np.float32).reshape(-1, dims)
    floor = np.zeros(len(names))
    for r in got:
        floor[at[r["lang"]]] = r["floor"]
    return LangModel(names, idf, cents, np.array([at[r["lang"]] for r in got], int), floor)


def identify_language(docs: DataFrame, model: LangModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every whole text.

    Null texts, and texts without a letter, get ``und``, score 0 and are rejected. Other
    columns of ``docs`` are not read. No row is dropped; repeated rows repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            pred, score, rejected = m.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held)
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known_language(docs: DataFrame, model: LangModel) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns and no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            _, _, rejected = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
