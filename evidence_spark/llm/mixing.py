"""Temperature mixing of sources, in Spark expressions only.

A source with token share q gets weight q^a / sum(q^a). The exponent a in [0, 1] is found
by bisection: the entropy of the weights falls with a, and so does the largest number of
times that a source must repeat to fill its share of the token budget. The weights are
then realised as budgeted block permutations: documents of a source lie in hashed blocks;
each epoch visits the blocks in its own pseudo-random order; whole epochs are taken while
the budget lasts, and the last epoch ends inside one block at the document that fills it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidence_spark.llm.common import cut

#: Tokens of a block while a source has fewer than MAX_BLOCKS of them.
BLOCK_TOKENS = 65_536
#: Blocks of a source at most: with more data, blocks grow.
MAX_BLOCKS = 4096
BISECTIONS = 20
#: Halvings that one pass over the sources allows for.
STEPS_AT_ONCE = 5
#: Target entropy as a share of that of equal weights, and the most repetitions.
ENTROPY_SHARE = 0.95
MAX_REPEATS = 4.0
#: Sources that may be broadcast (a few numbers each).
BROADCAST_SOURCES = 100_000


def tokens(text: Column) -> Column:
    """White-space separated words of a text, at least 1."""
    t = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.greatest(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1, F.lit(1)).cast("long")


@dataclass
class Mix:
    exponent: float
    budget: float
    sources: DataFrame  # src, n_docs, n_tokens, weight, epochs, rest, blocks


def solve_exponent(sources: DataFrame, budget: float, entropy: float, max_repeats: float) -> float:
    """The exponent that meets the target entropy, raised until the repetition limit holds.

    Halving of the interval [0, 1], STEPS_AT_ONCE steps to a pass over the sources: a pass
    tries all exponents that these steps may come to, and the search goes down among them.
    """
    most = math.log(max_repeats) if max_repeats > 0 else math.inf
    ends = sources.agg(F.min("n_tokens").alias("low"), F.max("n_tokens").alias("top")).first()
    low, top = math.log(ends["low"]), math.log(ends["top"])

    def tried(exponents: list[float]) -> dict[float, tuple[float, float]]:
        """Entropy of the weights, and log of the most repeats, for each exponent."""
        rows = sources.select((F.ln(F.col("n_tokens").cast("double")) - top).alias("ln"), F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
        got = rows.withColumn("u", F.exp(F.col("a") * F.col("ln"))).groupBy("a").agg(F.sum("u").alias("z"), F.sum(F.expr("u * a * ln")).alias("wl"))
        out = {}
        for r in got.collect():  # a row for each exponent
            # the source with the fewest tokens repeats most, as exponents are at most 1
            repeats = r["a"] * (low - top) - math.log(r["z"]) + math.log(max(budget, 1e-300)) - low
            out[r["a"]] = (math.log(r["z"]) - r["wl"] / r["z"], repeats)
        return out

    def bisect(ok) -> float:
        """The largest exponent that is ok, where small ones are."""
        lo, width, first = 0.0, 1.0, True
        for _ in range(BISECTIONS // STEPS_AT_ONCE):
            width /= 2**STEPS_AT_ONCE
            at = tried([lo + i * width for i in range(1, 2**STEPS_AT_ONCE + first)])
            if first and ok(at[1.0]):
                return 1.0
            first = False
            n = 2**STEPS_AT_ONCE
            left, right = 0, n
            while right - left > 1:
                mid = (left + right) // 2
                left, right = (mid, right) if ok(at[lo + mid * width]) else (left, mid)
            lo += left * width
        return lo

    a = bisect(lambda x: x[0] >= entropy)
    if tried([a])[a][1] > most:
        flat = bisect(lambda x: x[1] > most)
        a = max(a, min(1.0, flat + 2.0**-BISECTIONS))
    return a


def _light(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), "doc_id", tokens(F.col("text")).alias("tok"))


def _block(blocks: Column, src: Column, doc: Column) -> Column:
    return F.pmod(F.xxhash64(src, doc, F.lit(1)), blocks)


def plan_mix(docs: DataFrame, budget: float | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> Mix:
    """Weights and budgets per source. The budget is all tokens unless it is given.

    A limit on repeats that no exponent keeps (a budget of more than ``max_repeats`` times
    all tokens) lowers the budget to that many times all tokens. Null sources are one
    source; null and empty texts count one token. An empty table has no sources.
    """
    s = cut(_light(docs).groupBy("src").agg(F.count("*").alias("n_docs"), F.sum("tok").alias("n_tokens")))
    head = s.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    budget = float(budget if budget is not None else head["t"] or 0)
    if max_repeats > 0:
        budget = min(budget, max_repeats * float(head["t"] or 0))
    if not head["n"]:
        return Mix(1.0, budget, s.select("*", *[F.lit(0.0).alias(c) for c in ("weight", "epochs", "rest", "blocks")]))
    a = solve_exponent(s, budget, entropy_share * math.log(head["n"]), max_repeats)
    z = s.agg(F.sum(F.pow(F.col("n_tokens").cast("double"), F.lit(a)))).first()[0]
    out = s.withColumn("weight", F.pow(F.col("n_tokens").cast("double"), F.lit(a)) / z)
    out = out.withColumn("share", F.col("weight") * budget).withColumn("epochs", F.floor(F.col("share") / F.col("n_tokens") + 1e-9))
    out = out.withColumn("rest", F.greatest(F.col("share") - F.col("epochs") * F.col("n_tokens"), F.lit(0.0)))
    blocks = F.least(F.greatest(F.ceil(F.col("n_tokens") / BLOCK_TOKENS), F.lit(1)), F.lit(MAX_BLOCKS))
    return Mix(a, budget, cut(out.withColumn("blocks", blocks).drop("share")))


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a row per source) marked for broadcast where its counted rows allow it."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def mix_sources(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` repeated or left out as ``mix`` says; all columns stay, whatever their names.

    A source gets whole epochs, then documents in the order of its next epoch while what
    they hold stays within the rest of its budget. Null sources are one source. Rows that
    repeat a doc_id, or lack one, fall in one block and stay together; null and empty texts
    count one token. An empty table gives no rows.
    """
    return mixed_rows(docs, mix).select("row.*")


def mixed_rows(docs: DataFrame, mix: Mix) -> DataFrame:
    """The copies that :func:`mix_sources` takes: row (a struct), src, epoch, block, rank.

    Sorting by src, epoch, the block's order key and rank gives the permutations.
    """
    src = _small(mix.sources.select("src", "epochs", "rest", "blocks"))
    key = F.xxhash64("src", "epochs", "block")
    light = _light(docs).join(src.where("rest > 0"), "src").withColumn("block", _block(F.col("blocks"), F.col("src"), F.col("doc_id")))
    per_block = light.groupBy("src", "rest", "epochs", "block").agg(F.sum("tok").alias("tok")).withColumn("key", key)
    before = F.coalesce(F.sum("tok").over(W.partitionBy("src").orderBy("key", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = cut(per_block.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tok") > F.col("rest"))).select("src", F.col("block").alias("cut_block"), F.col("key").alias("cut_key"), "before"))
    rank = F.xxhash64("doc_id", "epochs", F.lit(2))
    inside = light.join(_small(edge), "src").where("block = cut_block").groupBy("src", "rest", "before", rank.alias("rank")).agg(F.sum("tok").alias("tok"))
    so_far = F.col("before") + F.sum("tok").over(W.partitionBy("src").orderBy("rank"))
    last = inside.withColumn("so_far", so_far).where("so_far <= rest").groupBy("src").agg(F.max("rank").alias("cut_rank"))
    ends = mix.sources.select("src", "epochs", "rest", "blocks").join(edge, "src", "left").join(last, "src", "left")
    ends = _small(cut(ends.select(F.col("src").alias("_src"), "epochs", "rest", "blocks", "cut_key", "cut_block", "cut_rank")))

    # the document is one nested column, so that its columns clash with none of these
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), "doc_id")
    data = row.join(ends, row["src"] == ends["_src"]).withColumn("block", _block(F.col("blocks"), F.col("src"), F.col("doc_id")))
    mine = F.xxhash64("src", "epochs", "block")
    earlier = (mine < F.col("cut_key")) | ((mine == F.col("cut_key")) & (F.col("block") < F.col("cut_block")))
    in_edge = (F.col("block") == F.col("cut_block")) & (rank <= F.col("cut_rank"))
    extra = F.when(F.col("rest") <= 0, F.lit(False)).when(F.col("cut_block").isNull(), F.lit(True)).otherwise(earlier | F.coalesce(in_edge, F.lit(False)))
    times = (F.col("epochs") + extra.cast("int")).cast("int")
    data = data.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    return data.select("row", "src", "epoch", "block", F.xxhash64("doc_id", "epoch", F.lit(2)).alias("rank"))


def mixed_report(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, rank and the source's weight, per copy.

    Null sources stay null and are weighed as one source. Null and empty texts count one
    token. Repeated rows repeat; other columns are not read.
    """
    out = mixed_rows(docs.select("doc_id", "source", "text"), mix)
    w = _small(mix.sources.select("src", "weight"))
    return out.join(w, "src").select("row.doc_id", "row.source", tokens(F.col("row.text")).alias("n_tokens"), "epoch", "block", "rank", "weight")
