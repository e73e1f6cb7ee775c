"""Personal data by candidate spans and gradient-boosted trees, in Spark expressions only.

Base spans (email, ip, card, phone) follow fixed patterns with checks and always stay.
High-recall generators propose further, overlapping spans: obfuscated addresses, numbers
with any separators, phone numbers without a prefix, IPv6. Boosted trees score each
proposal from its format and context, and a threshold for each kind selects.

There are no labels for what the patterns miss, so the fit makes its own: each base span of
all documents is disguised (``@`` spelled out, dots bracketed, other separators, no prefix)
inside its own context, and proposals that find it there again are the positive cases of its
kind. Proposals of the texts as they are that touch no base span are the negative ones. Every
document takes part: one half of them fits the trees, the thresholds are calibrated on the
other, which the trees have not seen. Cases are counted by their features, so what is fitted
stays small; the trees run as a plain SQL expression, without a shuffle.

The patterns are written so that Java's matcher needs neither recursion nor repeated
scans on very long texts: separators that may stand inside a span are first replaced by
one placeholder of the same length, which turns repeated groups into character runs.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import cut, drop_cut

KINDS = ("email", "ip", "card", "phone")
MARK, JOINT, OTHER = "\u0001", "\u0004", "\u0003"
#: Precision that a kind's threshold must keep on the calibration half, where every proposal
#: of the undisguised texts counts as wrong, and the disguised spans it must find there.
PRECISION, LEAST_HITS = 0.95, 5
CONTEXT = 24
#: Characters of context that a disguised span keeps on each side.
AROUND = 40
#: Matches of which the places are gathered at once (even: matches alternate with other text).
BLOCK = 512
_SPAN = "array<struct<s:int,e:int>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn check of a string of at most 20 digits."""
    p = F.lpad(d, 20, "0")
    doubled = F.translate(p, "0123456789", "0246813579")
    total = sum((F.substring(p if i % 2 == 0 else doubled, i, 1).cast("int") for i in range(1, 21)), F.lit(0))
    return total % 10 == 0


def _spans(text: Column, pattern: str, valid, guard: Column) -> Column:
    """Places of the valid matches of ``pattern`` as an array of (s, e), in code points."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    none = F.from_json(F.lit("[]"), _SPAN)

    def step(a: Column, x: Column) -> Column:
        end = a["pos"] + F.length(x)
        more = F.concat(a["out"], F.array(F.struct(a["pos"].alias("s"), end.alias("e"))))
        return F.struct((a["i"] + 1).alias("i"), end.alias("pos"), F.when((a["i"] % 2 == 1) & valid(x), more).otherwise(a["out"]).alias("out"))

    def places(x: Column, pos: Column) -> Column:
        return F.aggregate(x, F.struct(F.lit(0).alias("i"), pos.alias("pos"), none.alias("out")), step)

    def blocks(p: Column) -> Column:
        # arrays grow by copying, so long ones are put together from blocks
        def more(a: Column, at: Column) -> Column:
            got = F.transform(F.array(F.slice(p, at, F.lit(BLOCK))), lambda x: places(x, a["pos"]))
            return F.struct(got[0]["pos"].alias("pos"), F.concat(a["out"], F.transform(got, lambda g: g["out"])).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), F.from_json(F.lit("[]"), f"array<{_SPAN}>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(p), F.lit(BLOCK)), start, more, lambda a: a["out"]))

    found = F.transform(F.array(pieces), lambda p: F.when(F.size(p) <= BLOCK, places(p, F.lit(0))["out"]).otherwise(blocks(p)))[0]
    return F.when(guard, found).otherwise(none)


def base_spans(t: Column) -> dict[str, Column]:
    """Arrays of base spans per kind of a text without MARK or JOINT characters."""
    dots = F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOINT)
    seps = F.regexp_replace(t, r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)
    local = r"A-Za-z0-9._%+\-" + JOINT
    email = rf"(?:\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++{JOINT}[A-Za-z0-9{JOINT}-]++"
    ip = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    card = rf"[0-9][0-9{JOINT}]++"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

    def is_card(x: Column) -> Column:
        d = F.translate(x, JOINT, "")
        return F.length(d).between(12, 19) & luhn(d)

    return {
        "email": _spans(dots, email, lambda x: F.lit(True), F.contains(t, F.lit("@"))),
        "ip": _spans(t, ip, lambda x: x.rlike(rf"^{part}(?:\.{part}){{3}}$"), t.rlike(r"[0-9]\.[0-9]")),
        "card": _spans(seps, card, is_card, t.rlike("[0-9]")),
        "phone": _spans(t, phone, lambda x: F.length(_digits(x)).between(9, 15), F.contains(t, F.lit("+"))),
    }


def _one(f, arg):
    """``f`` with its second argument set; Spark's lambdas are told apart by their arity."""
    return lambda c: f(c, arg)


_DOT = r"(?:\.|[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\))[\x20]?)"
#: Generators of further candidates: kind and pattern.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[\x20]?(?:\(at\)|\[at\]|\{at\}|\[@\]|\(@\))[\x20]?[A-Za-z0-9-]{1,63}+(?:" + _DOT + r"[A-Za-z0-9-]{1,63}+){1,8}"),
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}+\)?[\x20./-]{1,2}[0-9]{3,4}+[\x20.-][0-9]{3,4}+(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}+[./_][0-9]{4}+[./_][0-9]{4}+[./_][0-9]{4}+(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:" + _DOT + r"[0-9]{1,3}+){3}(?![0-9.])"),
    ("number", r"(?<![0-9A-Za-z])[0-9][0-9\x20().-]{5,23}[0-9](?![0-9A-Za-z])"),
)
CUES = r"(?i)(?:tel|phone|call|fax|mobile|contact|mail|card|visa|credit|ip|addr|host|server)[^A-Za-z]{0,4}$"
FEATURES = ("which", "length", "n_digits", "n_seps", "n_groups", "marks", "luhn", "letters", "cue", "line_start", "rounded")


def _proposals(t: Column) -> Column:
    """Candidates of all generators with kind and features, as one array of structs."""
    found = []
    for kind, pattern in GENERATORS:
        guard = t.rlike(r"[(\[{](?:at|@)[)\]}]") if kind == "email" else F.contains(t, F.lit(":")) if "A-F" in pattern else t.rlike(r"[0-9][\x20]?[(\[{]") if kind == "ip" else t.rlike("[0-9]{3}")
        spans = _spans(t, pattern, lambda x: F.lit(True), guard)

        def described(c: Column, kind: str) -> Column:
            x = F.trim(F.substring(t, c["s"] + 1, c["e"] - c["s"]))
            d = _digits(x)
            left = F.substring(t, F.greatest(c["s"] + 1 - CONTEXT, F.lit(1)), F.least(c["s"], F.lit(CONTEXT)))
            as_int = lambda b: b.cast("int")
            n = F.length(d)
            sure = F.when(n.between(13, 19), F.lit("card")).otherwise(F.lit("phone")) if kind == "number" else F.lit(kind)
            return F.struct(
                c["s"].alias("s"), (c["s"] + F.length(x)).alias("e"), sure.alias("kind"),
                sum((F.when(sure == k, F.lit(i)).otherwise(F.lit(0)) for i, k in enumerate(KINDS)), F.lit(0)).alias("which"),
                F.length(x).alias("length"), n.alias("n_digits"), (F.length(x) - n).alias("n_seps"),
                F.size(F.split(x, "[^0-9]+")).alias("n_groups"), F.length(F.regexp_replace(x, r"[^()\[\]{}]", "")).alias("marks"),
                as_int(n.between(12, 19) & luhn(d)).alias("luhn"), F.length(F.regexp_replace(x, "[^A-Za-z]", "")).alias("letters"),
                as_int(left.rlike(CUES)).alias("cue"), as_int((c["s"] == 0) | left.rlike(r"\n$")).alias("line_start"), as_int(d.rlike("000$")).alias("rounded"),
            )

        found.append(F.transform(spans, _one(described, kind)))
    return F.concat(*found)


def _candidates(t: Column) -> Column:
    """The proposals of a text, null where a look at it shows that there are none."""
    return F.when(t.rlike(r"[0-9]{2}|[(\[{](?:at|@)[)\]}]|:|[0-9][\x20]?[(\[{]"), _proposals(t))


@dataclass
class PiiModel:
    """Boosted trees as an SQL expression over a candidate ``c``; none: base spans only.

    ``thresholds`` has the kinds that are selected at all, ``measured`` what held on the
    calibration half: kind -> (precision, share of the proposed disguised spans selected).
    """

    margin: str = ""
    thresholds: dict[str, float] = field(default_factory=dict)
    trees: list[str] = field(default_factory=list)
    measured: dict[str, tuple[float, float]] = field(default_factory=dict)


def _tree_sql(text: str) -> str:
    """The SQL expression of a tree's debug text."""
    lines = [x for x in text.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]

    def node(k: int) -> tuple[str, int]:
        line = lines[k].strip()
        if line.startswith("Predict"):
            return f"({float(line.split(':')[1])}D)", k + 1
        feature, value = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        yes, k = node(k + 1)
        no, k = node(k + 1)
        return f"(CASE WHEN c.{FEATURES[int(feature)]} <= {float(value)}D THEN {yes} ELSE {no} END)", k

    return node(0)[0]


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK + JOINT, OTHER + OTHER)


def _disguised(x: Column, kind: Column, how: Column) -> Column:
    """A base span as someone might write it who wants to get past patterns."""
    d = _digits(x)
    tail = F.right(d, F.lit(10))
    area, mid, end = F.substring(tail, 1, 3), F.substring(tail, 4, 3), F.substring(tail, 7, 4)
    in_turn = lambda *ways: F.when(how == 0, ways[0]).when(how == 1, ways[1]).otherwise(ways[2])
    at = lambda a: F.regexp_replace(x, "@", a)
    return (
        F.when(kind == "email", in_turn(at(" (at) "), F.regexp_replace(at("[at]"), r"\.(?=[A-Za-z]+$)", "[dot]"), F.regexp_replace(at("(@)"), r"\.(?=[A-Za-z]+$)", " (dot) ")))
        .when(kind == "ip", in_turn(F.regexp_replace(x, r"\.", "[.]"), F.regexp_replace(x, r"\.", "(.)"), F.regexp_replace(x, r"\.", "[dot]")))
        .when(kind == "card", F.regexp_replace(d, "([0-9]{4})(?=[0-9])", in_turn(F.lit("$1."), F.lit("$1_"), F.lit("$1/"))))
        .otherwise(in_turn(F.concat(F.lit("("), area, F.lit(") "), mid, F.lit("-"), end), F.concat_ws(".", area, mid, end), F.concat_ws("-", area, mid, end)))
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """``half, label, c``: candidates for the fit, of all documents, in one pass over the texts."""
    tag = lambda c, k: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(k).alias("kind"))
    part = docs.select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("half"), _clean(F.col("text")).alias("t"))
    part = part.withColumn("base", F.concat(*[F.transform(a, _one(tag, k)) for k, a in base_spans(F.col("t")).items()]))

    def again(b: Column) -> Column:
        x = F.substring(F.col("t"), b["s"] + 1, b["e"] - b["s"])
        left = F.substring(F.col("t"), F.greatest(b["s"] + 1 - AROUND, F.lit(1)), F.least(b["s"], F.lit(AROUND)))
        new = _disguised(x, b["kind"], F.pmod(F.xxhash64(x, F.lit(13)), F.lit(3)))
        place = F.struct(F.length(left).alias("s"), F.length(F.concat(left, new)).alias("e"), b["kind"].alias("kind"))
        return F.struct(F.lit(1.0).alias("label"), F.concat(left, new, F.substring(F.col("t"), b["e"] + 1, F.lit(AROUND))).alias("t"), F.array(place).alias("spans"))

    plain = F.struct(F.lit(0.0).alias("label"), F.col("t"), F.col("base").alias("spans"))
    # outer: for an inner explode Spark adds filters that compute the array anew
    cases = part.select("half", F.explode_outer(F.concat(F.array(plain), F.transform("base", again))).alias("x")).select("half", "x.*")
    found = cases.select("half", "label", "spans", F.explode_outer(_candidates(F.col("t"))).alias("c")).where("c IS NOT NULL")
    met = "exists(spans, b -> b.s < c.e AND b.e > c.s AND (label = 0 OR b.kind = c.kind))"
    return found.where(f"{met} = (label = 1)").select("half", "label", "c")


def _bins(rows: int) -> int:
    """Bins with which the trees look at every value of every row; fewer than the root of the rows make them sample."""
    return max(1024, math.isqrt(rows) + 1)


def fit_pii(docs: DataFrame) -> PiiModel:
    """Fit trees and thresholds on the candidates of all documents.

    Rows of one doc_id are in the same half; null texts have no candidates. Without cases
    of both labels there is no model, and base spans are all that is found. A kind of which
    no threshold keeps the precision is not selected.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = training_rows(docs).select("half", "label", "c.*")
    flat = cut(rows.groupBy("half", "label", "kind", *FEATURES).agg(F.count("*").cast("double").alias("weight")))
    count = {r["label"]: r["n"] for r in flat.where("half = 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return PiiModel()
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(flat.where("half = 0")).select("x", "label", "weight")
    gbt = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=8, maxDepth=3, maxBins=_bins(sum(count.values())), stepSize=0.3, seed=11).fit(train)
    trees = [f"{w} * {_tree_sql(t.toDebugString)}" for w, t in zip(gbt.treeWeights, gbt.trees, strict=True)]
    model = PiiModel(" + ".join(trees), {}, trees)
    names = ", ".join(f"'{x}', {x}" for x in FEATURES)
    scored = flat.where("half = 1").withColumn("c", F.expr(f"named_struct({names})")).select("kind", "label", "weight", F.round(F.expr(_score(model)), 2).alias("score"))
    table = scored.groupBy("kind", "score").agg(F.sum("weight").alias("n"), F.sum(F.expr("weight * label")).alias("hits")).orderBy("kind", F.desc("score")).collect()
    drop_cut(flat)
    for kind in KINDS:  # at most 101 rows each
        mine = [r for r in table if r["kind"] == kind]
        total = hits = 0.0
        for r in mine:
            total, hits = total + r["n"], hits + r["hits"]
            if r["score"] >= 0.5 and hits >= LEAST_HITS and hits >= PRECISION * total:
                model.thresholds[kind] = float(r["score"]) - 0.005
                model.measured[kind] = (hits / total, hits / sum(x["hits"] for x in mine))
    return model


def _score(model: PiiModel) -> str:
    return f"1 / (1 + exp(-2 * ({model.margin})))"


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), ``t``, and ``base`` and ``spans``.

    ``base`` and ``spans`` are arrays of (s, k, e) in code points, sorted; k numbers KINDS.
    Null texts count as empty. Repeated rows repeat; no row is dropped or added.
    """
    tag = lambda c, k: F.struct(c["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), c["e"].alias("e"))
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), _clean(docs["text"]).alias("t"))
    tagged = [F.transform(a, _one(tag, k)) for k, a in base_spans(F.col("t")).items()]
    out = out.withColumn("base", F.array_sort(F.concat(*tagged)))
    if not model.thresholds:
        return out.withColumn("spans", F.col("base"))
    out = out.withColumn("c", _candidates(F.col("t")))
    least = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in model.thresholds.items()) + " ELSE 2.0 END"
    keep = f"filter(coalesce(c, array()), c -> NOT exists(base, b -> b.s < c.e AND b.e > c.s) AND {_score(model)} >= {least})"
    out = out.withColumn("more", F.expr(f"array_sort(transform({keep}, c -> named_struct('s', c.s, 'k', c.which, 'e', c.e)))"))
    # of overlapping proposals the leftmost stays
    apart = F.expr(
        "aggregate(more, named_struct('end', 0, 'out', slice(more, 1, 0)), "
        "(a, c) -> IF(c.s >= a.end, named_struct('end', c.e, 'out', concat(a.out, array(c))), a), a -> a.out)"
    )
    return out.select("row", "t", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def _text_of(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", names[c["k"]], c["s"].cast("string"), c["e"].cast("string"))), ",")


def pii_report(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, base counts per kind, base_sha256, and all spans as text.

    Null and empty texts have no spans (and the hash of empty text). Repeated rows repeat; a
    null doc_id stays null; an empty table gives no rows. Other columns are not read.
    """
    found = find_pii(docs.select("doc_id", "text"), model)
    counts = [F.size(F.filter("base", _one(lambda c, k: c["k"] == k, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(_text_of("base"), 256).alias("base_sha256"), _text_of("spans").alias("spans"))


def redact_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; same rows and columns.

    Overlapping spans are replaced together by the tag of the first. ``n_chars``, where
    there is such a column, becomes the new length. Null texts stay null.
    """
    found = find_pii(docs, model)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("row.text").cast("string")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        more = F.concat(a["out"], F.substring(text, a["pos"] + 1, c["s"] - a["pos"]), tags[c["k"]])
        return F.struct(F.greatest(a["pos"], c["e"]).alias("pos"), F.when(c["s"] >= a["pos"], more).otherwise(a["out"]).alias("out"))

    new = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    out = found.select("row", F.when(F.size("spans") > 0, new).otherwise(text).alias("new"))
    made = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
