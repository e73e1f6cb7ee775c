"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.functions.storage import cut, drop_cut

__all__ = ["components", "crc_mod", "cut", "drop_cut", "gram_hashes", "hash_words", "mix", "small_batches", "span_hashes", "table"]

#: Rows that one Arrow batch may hold, so that a batch of long texts stays small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch for the plans that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_mod(col: str, m: int):
    """crc32 of an id as text, modulo ``m``."""
    return F.crc32(F.col(col).cast("string")) % m


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(id, component)``.

    Every id that occurs in an edge gets the smallest id reachable from it. Labels
    spread over edges and then jump to their label's label, so the number of rounds
    follows the logarithm of the longest chain. Only a flag reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both)
    lab = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = (
            both.join(lab.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("m"))
        )
        cur = lab.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("c"))
        root = lab.select(F.col("id").alias("c"), F.col("component").alias("up"))
        new = cut(cur.join(root, "c", "left").select("id", "was", F.least("c", F.coalesce("up", "c")).alias("component")))
        moved = new.where("component <> was").limit(1).count()
        drop_cut(lab)
        lab = new.drop("was")
        if not moved:
            drop_cut(both)
            return lab


_ODD = np.random.Generator(np.random.PCG64(20)).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: Bytes that are hashed at once.
PART = 1 << 18
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(21)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POWERS: dict[int, np.ndarray] = {}


def powers(inverse: bool, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2**64, or of its inverse."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, PART + 1), _P_INV if inverse else _P, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * PART:
            _POWERS[inverse] = have
    return have[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of a sequence of 64-bit values, from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(False, len(values)), out=total[1:])
    return mix((total[end] - total[start]) * powers(True, len(values) + 1)[start] + (end - start).astype(np.uint64))


def _hash_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a buffer."""
    buf = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([0], (~_SPACE[buf]).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(_BYTE[buf], start, end), start


def _parts(raw: bytes):
    """A long text in parts that end between words."""
    at = 0
    while len(raw) - at > PART:
        end = max(raw.rfind(c, at, at + PART) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end <= at:
            ends = [e for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (e := raw.find(c, at + PART)) >= 0]
            end = min(ends, default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


def hash_words(texts: list[str | None], lower: bool = False):
    """Word hashes of whole texts, a bounded part of the list at a time.

    Yields (first text, hashes, offsets): text ``first + i`` has the hashes from
    ``offsets[i]`` to ``offsets[i + 1]``. Words are runs of anything but the six ASCII
    white-space characters; ``lower`` lower-cases A-Z.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= PART):
            size += len(raw[end]) + 1
            end += 1
        joined = b" ".join(raw[at:end])
        joined = joined.lower() if lower else joined
        if end - at == 1:
            h = np.concatenate([_hash_bytes(x)[0] for x in _parts(joined)])
            yield at, h, np.array([0, len(h)])
        else:
            h, start = _hash_bytes(joined)
            begin = np.cumsum([0] + [len(x) + 1 for x in raw[at:end]])
            yield at, h, np.searchsorted(start, begin)
        at = end


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes (empty where there are fewer)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += w[j : j + n] * _ODD[j]
    return mix(h)
