"""Toxicity of text restored from obfuscation by a noisy-channel decoder.

A character trigram model is counted over the words of all documents. A token with signs
of obfuscation (look-alike symbols, separators between letters, long repetitions, letters
set apart by spaces) becomes a lattice: at each place the letters it may stand for, or
nothing. Viterbi decoding finds the most likely word under the trigram model and the cost
of each disguise. Words, restored where needed and with repeated letters squeezed, then
meet a lexicon whose weights are learned from labels, and a logistic model turns the
heaviest weights of a document into its score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import crc_mod, cut, small_batches

#: Labelled documents that weights and the logistic model are fitted on, at most, per label.
SAMPLE_PER_LABEL = {1: 6000, 0: 12_000}
#: Entries of the lexicon and of the trigram table, at most.
MAX_LEXICON = 20_000
MAX_TRIGRAMS = 200_000
PRIOR = 5.0
LEAST_WEIGHT = 1.5
#: Distinct words that a task holds before it hands their counts on.
FLUSH = 200_000

# Look-alike symbols and the letters they stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
SEPARATORS = frozenset("._-*~·•'’`^/\\,:")
EDGE = ".,;:!?\"'()[]{}<>|&%#*$@+=~`^/\\-_…“”‘’«»¿¡·•"
#: What a token may lose at its ends before it is decoded: no look-alikes.
DECORATION = "".join(c for c in EDGE if c not in LOOKALIKE)
#: Look-alikes that are usual punctuation at the start or the end of a word.
USUAL_START, USUAL_END = frozenset("(<¡|+"), frozenset("!|+")
COST_SYMBOL, COST_SKIP, COST_REPEAT, COST_DROP = 1.0, 0.2, 0.3, 6.0
#: A gap between single letters that ends a word, and one between longer pieces that does not.
COST_SPACE, COST_JOIN = 1.0, 2.0
#: Pieces of words have at most so many characters, and a letter or end less likely than this.
PIECE_CHARS, ODD_PIECE = 4, -5.0

_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
_RUN = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"(.)\1\1")
_LETTERS = re.compile(r"[^\W\d_]")


def squeeze(word: str) -> str:
    return _RUN.sub(r"\1", word)


@dataclass
class CharModel:
    """Log probabilities of a letter after two others, with backing off to fewer."""

    tri: dict[str, float]
    unseen: float

    @classmethod
    def of(cls, counts: dict[str, int]) -> CharModel:
        context: Counter = Counter()
        for g, n in counts.items():
            context[g[:2]] += n
        letters = max(2, len({g[2] for g in counts}))
        return cls({g: math.log((n + 0.1) / (context[g[:2]] + 0.1 * letters)) for g, n in counts.items()}, math.log(0.1 / (50 + 0.1 * letters)))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character, the letters it may be, or '' for none, with their costs."""
    out = []
    first, last = len(token) - len(token.lstrip(EDGE)), len(token.rstrip(EDGE))
    for i, c in enumerate(token):
        if c in LOOKALIKE:
            options = [(x, COST_SYMBOL) for x in LOOKALIKE[c]]
            if not c.isdigit():
                unusual = (i < first and c not in USUAL_START) or (i >= last and c not in USUAL_END)
                options.append(("", COST_DROP if unusual else COST_SYMBOL))
        elif c.isalpha():
            options = [(c, 0.0)]
        else:
            options = [("", COST_SKIP)]
        if i and c == token[i - 1]:
            options.append(("", COST_REPEAT))
        out.append(options)
    return out


_JOINED = "\x1f"


def decode(token: str | list[str], model: CharModel) -> str:
    """The most likely word behind a token, or the words behind pieces set apart by spaces.

    A gap between pieces either ends a word or not; a word of several pieces has a mark
    at each gap inside it.
    """
    pieces = [token] if isinstance(token, str) else token
    best: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
    for k, piece in enumerate(pieces):
        if k:
            single = len(piece) == len(pieces[k - 1]) == 1
            new = {ctx: (score - (0.0 if single else COST_JOIN), (path, _JOINED)) for ctx, (score, path) in best.items()}
            ended = max(((score + (model.tri.get(ctx + "$", model.unseen) if ctx != "^^" else 0.0), path) for ctx, (score, path) in best.items()), key=lambda x: x[0])
            ended = (ended[0] - (COST_SPACE if single else 0.0), (ended[1], " "))
            if "^^" not in new or ended[0] > new["^^"][0]:
                new["^^"] = ended
            best = new
        for options in lattice(piece):
            new = {}
            for ctx, (score, path) in best.items():
                for letter, cost in options:
                    if letter:
                        s, key, p = score - cost + model.tri.get(ctx + letter, model.unseen), ctx[1] + letter, (path, letter)
                    else:
                        s, key, p = score - cost, ctx, path
                    if key not in new or s > new[key][0]:
                        new[key] = (s, p)
            best = new
    path = max(((s + model.tri.get(ctx + "$", model.unseen), p) for ctx, (s, p) in best.items()), key=lambda x: x[0])[1]
    letters: list[str] = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer(dict):
    """Token -> squeezed restored word ('' if it holds none), remembered."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model
        self.odd: dict[str, bool] = {}
        self.runs: dict[tuple[str, ...], list[str]] = {}

    def is_odd(self, token: str) -> bool:
        """Whether a short token is unlikely to be a word of its own."""
        if token not in self.odd:
            if len(self.odd) > 300_000:
                self.odd.clear()
            w = token.strip(DECORATION)
            odd = 1 < len(w) <= PIECE_CHARS and w[:1].isalpha() and w.isascii()
            if odd:
                got = f"^^{self.restore(token)}$"
                seen = [self.model.tri.get(got[i : i + 3], self.model.unseen) for i in range(len(got) - 2)]
                odd = len(got) > 3 and min(seen) < ODD_PIECE
            self.odd[token] = odd
        return self.odd[token]

    def joined(self, pieces: list[str]) -> list[str]:
        """Squeezed words that are made of several of the pieces."""
        key = tuple(c for p in pieces if (c := p.strip(DECORATION) or p))
        if key not in self.runs:
            if len(self.runs) > 50_000:
                self.runs.clear()
            words = decode(list(key), self.model).split(" ") if sum(map(str.isalpha, "".join(key))) > 1 else []
            self.runs[key] = [squeeze(w.replace(_JOINED, "")) for w in words if _JOINED in w.strip(_JOINED)]
        return self.runs[key]

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        word = self[token] = squeeze(self.restore(token))
        return word

    def restore(self, token: str) -> str:
        if not token.isascii():
            token = unicodedata.normalize("NFKC", token).lower()
        core, inner = token.strip(DECORATION), token.strip(EDGE)
        if core.isalpha() and not _LONG_RUN.search(core):
            return core
        letters = len(_LETTERS.findall(inner))
        if not letters or 3 * letters < len(inner) - sum(c in SEPARATORS for c in inner):
            return ""
        return decode(core, self.model)


def words_of(text: str | None, restorer: Restorer) -> set[str]:
    """Squeezed restored words of a whole text."""
    if not text:
        return set()
    low = text.lower()
    tokens = low.split()
    different = set(tokens)
    out = set(map(restorer.__getitem__, different))
    for m in _SPACED.finditer(low):
        out.update(restorer.joined(m[0].split()))
    odd = {w for w in different if len(w) <= PIECE_CHARS + 2 and restorer.is_odd(w)}
    if odd:
        for k, w in enumerate(tokens):
            if w in odd:
                out.update(restorer.joined([t for t in tokens[max(0, k - 1) : k + 2] if len(t) <= PIECE_CHARS + 2]))
    out.discard("")
    return out


def char_counts(docs: DataFrame) -> DataFrame:
    """Character trigram counts (with ends) over the clean words of all documents."""
    small_batches(docs.sparkSession)

    def words(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(t.lower().split())
            if len(seen) > FLUSH:
                yield flush()
        if seen:
            yield flush()

    def grams(batches):
        for b in batches:
            seen: Counter = Counter()
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = word.strip(EDGE)
                if w.isalpha() and len(w) < 40:
                    w = f"^^{w}$"
                    for i in range(len(w) - 2):
                        seen[w[i : i + 3]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

    vocabulary = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return vocabulary.mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class ToxicModel:
    chars: CharModel
    weights: dict[str, float]
    beta: np.ndarray

    def features(self, words: set[str]) -> list[float]:
        w = sorted((self.weights[x] for x in words if x in self.weights), reverse=True)
        return [1.0, w[0] if w else 0.0, w[1] if len(w) > 1 else 0.0, min(sum(w[2:]), 20.0)]

    def score(self, words: set[str]) -> float:
        return float(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.beta, self.features(words))))))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic model by damped Newton steps, both labels weighing the same."""
    beta = np.zeros(x.shape[1])
    w = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * len(y) * beta * np.array([0, *[1] * (len(beta) - 1)]) / 100
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * len(y) * np.eye(len(beta)) / 100
        step = np.linalg.solve(h, g)
        beta = beta + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on training rows: crc32 of doc_id not 0 modulo 5, with text and a toxic label.

    The character model counts over all documents. Weights are smoothed log odds of a word
    over groups of alike documents (those with the same least word hash), so that many
    copies of a text count once. They come from seven tenths of a bounded sample; the
    logistic model from the rest. Of several labels of a doc_id, 1 holds; labels other than
    0 and 1, and rows without a doc_id, are not used. Without both labels every score is
    that of no evidence.
    """
    spark = docs.sparkSession
    grams = char_counts(docs).orderBy(F.desc("n"), "gram").limit(MAX_TRIGRAMS).collect()
    chars = CharModel.of({r["gram"]: r["n"] for r in grams})
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(crc_mod("doc_id", 5) != 0).where("toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    per = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = ToxicModel(chars, {}, np.array([-3.0, 0.0, 0.0, 0.0]))
    if len(per) < 2:
        return none
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_PER_LABEL[1] / per[1])).otherwise(min(1.0, SAMPLE_PER_LABEL[0] / per[0]))
    pick = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < share * 1_000_000).limit(2 * sum(SAMPLE_PER_LABEL.values()))
    # bounded by the limit above, 12 bytes a row
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(pick), "doc_id").where("text is not null")
    shared = spark.sparkContext.broadcast(chars)

    def tokens(batches):
        restorer = Restorer(shared.value)
        for b in batches:
            out = defaultdict(set)
            for doc, text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text, restorer)
                if words:
                    alike = min(map(xxhash.xxh32_intdigest, words))
                    words.add("")
                    for w in words:
                        out[w, toxic].add(alike)
            rows = [(w, t, a) for (w, t), group in out.items() for a in group]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["word", "toxic", "alike"])

    small_batches(spark)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(10))
    counts = sample.where(fold < 7).mapInArrow(tokens, "word string, toxic int, alike long").distinct()
    counts = cut(counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")).where("t >= 3 or word = ''"))
    total = counts.where("word = ''").first()
    if total is None or not total["t"] or not total["n"]:
        return none
    q = total["t"] / (total["t"] + total["n"])
    weight = F.log((F.col("t") + PRIOR * q) / (F.col("n") + PRIOR * (1 - q))) - math.log(q / (1 - q))
    lexicon = counts.where("word <> ''").select("word", "t", weight.alias("w")).where(F.col("w") > LEAST_WEIGHT).orderBy(F.desc(F.col("w") * F.sqrt("t")), "word").limit(MAX_LEXICON).collect()
    model = ToxicModel(chars, {r["word"]: float(r["w"]) for r in lexicon}, none.beta)
    given = spark.sparkContext.broadcast(model)

    def describe(batches):
        restorer = Restorer(given.value.chars)
        for b in batches:
            f = [given.value.features(words_of(t, restorer)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(f, pa.list_(pa.float64()))], ["toxic", "f"])

    rows = sample.where(fold >= 7).mapInArrow(describe, "toxic int, f array<double>").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if not rows or y.min() == y.max():
        return none
    model.beta = _logistic(np.array([r["f"] for r in rows]), y)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text.

    Null and empty texts get the score of no evidence. Repeated rows repeat; a null doc_id
    stays null and is not held out; an empty table gives no rows. Columns other than doc_id
    and text are not read, and doc_id only names the row and its fold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        restorer = Restorer(shared.value.chars)
        for b in batches:
            s = [shared.value.score(words_of(t, restorer)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held)
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
