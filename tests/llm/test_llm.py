"""Training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import DATA, rows
from evidence_spark.llm import common, htmltext, jaccard, jpeg, langid, mixing, neardup, packing, pii, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, source=None):
    data = [(i, t, "en" if i % 2 else "fr", source(i) if source else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


LONG = " ".join(f"w{i * i % 977}" for i in range(6000))
ODD = [None, "", "   ", "a", "a b c", LONG, LONG, "x" * 50_000, "\u0001\u0004 odd 😀 text", "1234 " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns."""
    from pyspark.sql import functions as F

    df = docs_of(spark, ODD)
    repeat = spark.createDataFrame([(5, LONG, None, None, None), (None, "no id at all", None, None, None)], SCHEMA)
    return df.union(repeat).withColumns({"h": F.lit(1), "n": F.lit("x"), "cls": F.lit(2), "rep": F.lit(3), "block": F.lit(4), "src": F.lit("q"), "tok": F.lit(0), "weight": F.lit(0.5)})


def union_find(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# -- components --------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long"))))
    want = union_find({x for e in edges for x in e}, edges)
    assert all(got.get(k, k) == v for k, v in want.items())


# -- toxicity ----------------------------------------------------------------------------


def test_decoding():
    text = "the loser and the idiot are stupid or moron in other toil " * 50
    counts = Counter()
    for w in text.split():
        w = f"^^{w}$"
        counts.update(w[i : i + 3] for i in range(len(w) - 2))
    r = toxicity.Restorer(toxicity.CharModel.of(counts))
    for token, word in {"1d10t": "idiot", "l0ser": "loser", "m.o.r.o.n": "moron", "stuuuupid": "stupid", "lo$er": "loser", "idiot!!": "idiot", "the": "the", "1234567": "", "$$$": ""}.items():
        assert r[token] == toxicity.squeeze(word), token
    assert "idiot" in toxicity.words_of("you i d i o t here", r)


def test_decoding_of_ends_and_gaps():
    text = "you are a loser and the idiot has a stupid ass or moron in as many other words " * 50
    counts = Counter()
    for w in text.split():
        w = f"^^{w}$"
        counts.update(w[i : i + 3] for i in range(len(w) - 2))
    r = toxicity.Restorer(toxicity.CharModel.of(counts))
    for token, word in {"$tup1d": "stupid", "a$$": "ass", "!diot": "idiot", "idiot!!!!!!!!!!!!!!!!": "idiot", "(loser)": "loser", "m0r0n!": "moron"}.items():
        assert r[token] == toxicity.squeeze(word), token
    for run in ("y o u i d i o t", "a i d i o t", "i  d  i  o  t", "you id iot now", "a $ t u p i d i d i o t"):
        assert "idiot" in toxicity.words_of(run, r), run
    assert {"you", "idiot"} <= toxicity.words_of("y o u i d i o t", r)


def test_viterbi_equals_all_paths():
    """The decoded word of a token against all paths through its lattice."""
    import itertools

    counts = Counter()
    for w in ("the loser and the idiot are stupid or moron in other toil as is it at " * 5).split():
        w = f"^^{w}$"
        counts.update(w[i : i + 3] for i in range(len(w) - 2))
    model = toxicity.CharModel.of(counts)

    def worth(path):
        ctx, total = "^^", 0.0
        for letter, cost in path:
            total -= cost
            if letter:
                total += model.tri.get(ctx + letter, model.unseen)
                ctx = ctx[1] + letter
        return total + model.tri.get(ctx + "$", model.unseen)

    for token in ("1d10t", "l0$er", "m.o.r.0.n", "stuup1d", "$tup!d", "a$$", "!!x", "7h3", "aa@@", "(|<"):
        best = max(worth(p) for p in itertools.product(*toxicity.lattice(token)))
        got = toxicity.decode(token, model)
        assert max(worth(p) for p in itertools.product(*toxicity.lattice(token)) if "".join(x for x, _ in p) == got) == pytest.approx(best), token


def test_labels_of_one_document(spark):
    """Of several labels 1 holds; other labels and rows without an id are not used."""
    rng = np.random.default_rng(12)
    some = ["".join(rng.choice(list("aeioubdgklmnprst"), 6)) for _ in range(3000)]
    texts = [" ".join([*rng.choice(some, 8), *(("good", "day", "friend") if i % 2 else ("you", "idiot", "loser"))]) for i in range(400)]
    docs = docs_of(spark, texts)
    labels = [(i, (i + 1) % 2) for i in range(400)] + [(i, 0) for i in range(0, 400, 2)] + [(None, 1), (3, 7), (5, None)]
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights.get("idiot", 0) > toxicity.LEAST_WEIGHT and "frien" not in model.weights
    got = dict(rows(toxicity.score_toxicity(docs, model), "doc_id", "predicted"))
    assert got == {i: (i + 1) % 2 for i in range(400)}


def test_toxicity(spark, docs, odd):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = np.mean([r["predicted"] == r["toxic"] for r in got])
    caught = np.mean([r["predicted"] for r in got if r["toxic"] == 1])
    assert right > 0.97 and caught > 0.85
    assert toxicity.score_toxicity(odd, model).count() == odd.count()
    none = toxicity.fit_toxicity(docs_of(spark, ["a b"]), labels.where("false"))
    assert toxicity.score_toxicity(docs_of(spark, ["a b", None]), none).where(F.col("score") < 0.5).count() == 2
    assert toxicity.score_toxicity(odd.where("false"), model).count() == 0


# -- vectors -----------------------------------------------------------------------------


def test_vectors(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(v).collect()}
    pdf = v.toPandas()
    e = np.array(pdf.embedding.tolist(), float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    i, j = np.nonzero(e @ e.T >= 0.9)
    pairs = [(int(pdf.vec_id[a]), int(pdf.vec_id[b])) for a, b in zip(i, j, strict=True) if a != b]
    degree = Counter(a for a, _ in pairs)
    found = sum(r["n_links"] for r in got.values())
    assert all(r["n_links"] <= degree[k] for k, r in got.items())
    assert found >= 0.9 * len(pairs)
    comp = union_find(list(got), pairs)
    assert np.mean([got[k]["component_id"] == c for k, c in comp.items()]) > 0.99
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_odd_vectors(spark):
    data = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [1.0, None], 0), (7, [1.0, 0.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [float("inf"), 0.0], 0), (10, [], 0), (11, [1e-300, 1e-310], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got[1] == (3, 1) and got[2] == (3, 1) and got[8] == (3, 1) and got[11] == (3, 1)
    assert all(got[k] == (0, k) for k in (3, 4, 5, 6, 7, 9, 10))
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_passes_follow_the_table():
    """Planted pairs just above the threshold are met in larger tables too."""
    rng = np.random.default_rng(4)
    n, pairs, cosine = 60_000, 1000, 0.905
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, 64))
    y -= (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    x[pairs : 2 * pairs] = cosine * x[:pairs] + (1 - cosine**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = np.zeros(pairs, bool)
    for p in range(neardup.passes_for(n)):
        place = np.empty(n, int)
        place[np.argsort(neardup.sign_keys(x, range(p, p + 1))[0])] = np.arange(n)
        met |= abs(place[:pairs] - place[pairs : 2 * pairs]) <= neardup.WINDOW
    assert met.mean() >= 0.995
    assert neardup.passes_for(100) == neardup.PASSES < neardup.passes_for(100_000) < neardup.passes_for(10_000_000)


def test_crowded_groups(spark):
    """Thousands of near copies, some of which differ by rounding only, keep all links."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((2, 32))
    near = [c + s * rng.standard_normal((3000, 32)) for c, s in zip(centre, (1e-9, 0.1), strict=True)]
    x = np.concatenate([*near, rng.standard_normal((500, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df, block_rows=512).collect()}
    e = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = (e @ e.T >= 0.9).sum(1) - 1
    assert [got[i]["n_links"] for i in range(6000)] == degree[:6000].tolist()
    assert all(got[i]["component_id"] == i // 3000 * 3000 for i in range(6000))
    cuts = np.array([1, 5, 5, 5, 9])
    block = neardup.deal_runs(np.full(4000, 5), np.arange(4000), cuts, 0)
    assert sorted(set(block.tolist())) == [1, 2, 3, 4] and np.bincount(block).max() < 1200


def test_groups_of_one_point(spark):
    """6,000 vectors around one point, with default parameters: the recall of links and components."""
    rng = np.random.default_rng(6)
    for noise in (1e-6, 0.02):
        x = rng.standard_normal(64)
        x = x / np.linalg.norm(x) + noise * rng.standard_normal((6000, 64))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
        e = x / np.linalg.norm(x, axis=1, keepdims=True)
        degree = (e @ e.T >= 0.9).sum(1) - 1
        assert sum(r["n_links"] for r in got.values()) >= 0.9 * degree.sum()
        assert all(r["n_links"] <= degree[k] for k, r in got.items())
        assert {r["component_id"] for r in got.values()} == {0}


def test_repeated_ids_and_clashing_columns(spark):
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "2 as n", "3 as h1", "4 as links", "5 as component", "6 as ok")
    got = rows(neardup.near_duplicates(df), "vec_id", "component_id", "kept")
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (None, None, False)], key=repr)


# -- personal data -----------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 if k == 2 else True
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and luhn) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


HARD = [
    "a@b.com_x@c.d.e 1.2.3.4.5 999.1.1.1", "x..y@z-.q.w. a@b a@.c 4111 1111 1111 1111-", "4111-1111-1111-1111 +1 (205) 555-0199, +49 30 1234567890123456", "a@b.c.d@e.f g%h@i.j",
    "\U0001f600 x@y.zz \U0001f600 10.0.0.256 010.000.0.1", "", None, "+1+2 345 678 9012 +", "1" * 5000, "a" * 20000 + "@b.c", "a@" + "b." * 3000 + "c", "4111  1111 1111 1111", "1.2.3.4.5.6.7.8", "é@a.b ñx@a.b",
]


def test_pii(spark, docs, texts, odd):
    hard = docs_of(spark, HARD)
    model = pii.fit_pii(docs)
    for df, text in ((docs, texts), (hard, dict(enumerate(HARD)))):
        for r in pii.pii_report(df, model).collect():
            want = plain_spans(text[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), r["doc_id"]
            assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in want.split(",")) for k in pii.KINDS]
    out = {r["doc_id"]: r["text"] for r in pii.redact_pii(hard, model).collect()}
    assert out[3] == "[EMAIL]@e.f [EMAIL]" and out[6] is None and out[5] == ""
    assert pii.redact_pii(odd, model).columns == odd.columns and pii.redact_pii(odd, model).count() == odd.count()
    assert pii.pii_report(docs.where("false"), pii.fit_pii(docs.where("false"))).count() == 0


def test_many_spans_in_one_text(spark):
    model = pii.PiiModel()
    text = "a 10.0.0.1 b " * 3000 + "x@y.zz"
    got = pii.pii_report(docs_of(spark, [text, "q 1.2.3.4 " * (pii.BLOCK // 2), "1.2.3.4 " * (pii.BLOCK // 2 + 1)]), model).orderBy("doc_id").collect()
    assert [r["n_ip"] for r in got] == [3000, pii.BLOCK // 2, pii.BLOCK // 2 + 1]
    assert got[0]["spans"] == plain_spans(text)


def test_trees_add_disguised_spans(spark):
    """Spans that no pattern finds, planted in texts that the fit has not seen."""
    rng = np.random.default_rng(8)
    words = "the red item was sent on time and we count more of it".split()

    def some(x):
        return f"{' '.join(rng.choice(words, 6))} {x} {' '.join(rng.choice(words, 6))}"

    def card():
        d = rng.integers(0, 10, 15).tolist()
        s = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(d))
        return "".join(map(str, [*d, -s % 10]))

    made = []
    for i in range(600):
        made += [some(f"{rng.choice(['joe', 'a.b', 'info', f'n{i}'])}@{rng.choice(['mail.', ''])}{rng.choice(['site.net', 'example.org'])}"), some(".".join(map(str, rng.integers(0, 10 ** rng.integers(1, 4, 4)) % 256))), some(card()), some(f"+1 (205) 555-{i:04d}"), some(f"{i} of 12 345"), some(f"{rng.integers(10**15, 10**16)}"), some(f"20{i % 10}.11.12")]
    model = pii.fit_pii(docs_of(spark, made))
    assert set(model.thresholds) == set(pii.KINDS) and all(p >= pii.PRECISION for p, _ in model.measured.values())
    c = card()
    planted = {
        "email": [some("joe (at) mail.example.org"), some("a.b[at]site[dot]net")], "ip": [some("192[.]168[.]4[.]20"), some("88(.)8(.)141(.)4")],
        "card": [some("_".join(c[i : i + 4] for i in range(0, 16, 4))), some(".".join(c[i : i + 4] for i in range(0, 16, 4)))], "phone": [some("(205) 555-0199"), some("205-555-0188")],
    }
    texts = [t for group in planted.values() for t in group] + [some(f"{i} of 300 400") for i in range(40)] + [some(f"20{i % 10}.10.11") for i in range(40)]
    got = pii.pii_report(docs_of(spark, texts), model).orderBy("doc_id").collect()
    assert all(sum(r[f"n_{k}"] for k in pii.KINDS) == 0 for r in got)
    assert [r["spans"].split(":")[0] for r in got[:8]] == [k for k, group in planted.items() for _ in group]
    assert all(r["spans"] == "" for r in got[8:])
    out = pii.redact_pii(docs_of(spark, texts[:1]), model).first()
    assert "[EMAIL]" in out["text"] and "joe" not in out["text"] and out["n_chars"] == len(out["text"])


def test_pii_fits_on_all_documents(spark):
    """No document is left out of the fit, however many there are, nor any value out of the trees' splits."""
    from pyspark.sql import functions as F

    n = 30_000
    made = spark.range(n).selectExpr("id as doc_id", "concat('to joe', id, '@mail.site.net or 12 345 of them or 2024.11.12') as text")
    got = pii.training_rows(made).groupBy("half", "label").agg(F.count("*").alias("n")).collect()
    assert {label: sum(r["n"] for r in got if r["label"] == label) for label in (0.0, 1.0)} == {0.0: n, 1.0: n}
    assert all(r["n"] > 0.4 * n for r in got)
    assert all(max(pii._bins(x) ** 2, 10_000) >= x for x in (0, 5, 20_000, 5_000_000, 10**9 + 7))


def test_pii_cases_of_a_text(spark):
    """Disguised base spans are positive cases, other proposals negative ones, single digits included."""
    got = pii.training_rows(docs_of(spark, ["at 1.2.3.4 now", "say 11 222 3333 to", None, ""]))
    assert rows(got, "label", "c.kind") == [(0.0, "phone"), (0.0, "phone"), (1.0, "ip")]
    model = pii.PiiModel("2.0D", {"ip": 0.5})
    assert pii.pii_report(docs_of(spark, ["at 1[.]2[.]3[.]4 now"]), model).first()["spans"] == "ip:3:16"


def test_pii_of_odd_rows(spark, docs, odd):
    clash = odd.selectExpr("*", "1 as row", "2 as t", "3 as base", "4 as spans", "5 as c", "6 as more", "7 as _t", "8 as new")
    model = pii.fit_pii(docs)
    out = pii.redact_pii(clash, model)
    assert out.columns == clash.columns and out.count() == odd.count()
    assert rows(out.where("doc_id in (0, 1, 2)"), "doc_id", "text", "row") == [(0, None, 1), (1, "", 1), (2, "   ", 1)]
    got = pii.pii_report(clash, model)
    assert got.count() == odd.count() and rows(got.where("doc_id = 0"), "n_email", "spans", "base_sha256") == [(0, "", hashlib.sha256(b"").hexdigest())]
    assert pii.redact_pii(odd.where("false"), model).count() == 0


# -- mixing ------------------------------------------------------------------------------


def test_mixing(spark):
    from pyspark.sql import functions as F

    docs = docs_of(spark, [" ".join(["w"] * (1 + i % 7)) for i in range(3000)], lambda i: "big" if i % 3 else f"s{i % 4}" if i % 12 else None)
    mix = mixing.plan_mix(docs, entropy_share=0.97)
    s = {r["src"]: r for r in mix.sources.collect()}
    total = sum(r["n_tokens"] for r in s.values())
    w = {k: r["n_tokens"] ** mix.exponent for k, r in s.items()}
    for k, r in s.items():
        assert r["weight"] == pytest.approx(w[k] / sum(w.values()))
    h = -sum(r["weight"] * np.log(r["weight"]) for r in s.values())
    assert h == pytest.approx(0.97 * np.log(len(s)), abs=1e-4)
    out = mixing.mixed_report(docs, mix).collect()
    took = defaultdict(int)
    for r in out:
        took[r["source"] or ""] += r["n_tokens"]
    for k, r in s.items():
        assert r["weight"] * total - 7 <= took[k] + 7 and took[k] <= r["weight"] * total + 1e-6
    assert max(Counter((r["doc_id"], r["epoch"]) for r in out).values()) == 1
    limited = mixing.plan_mix(docs, entropy_share=1.0, max_repeats=1.5)
    assert max(r["weight"] * total / r["n_tokens"] for r in limited.sources.collect()) <= 1.5 + 1e-3
    empty = mixing.plan_mix(docs.where("false"))
    assert mixing.mix_sources(docs.where("false"), empty).count() == 0
    same = mixing.plan_mix(docs, entropy_share=0.0)
    assert same.exponent == 1.0 and mixing.mixed_report(docs, same).agg(F.count_distinct("doc_id")).first()[0] == 3000


def test_mixing_blocks(spark):
    """The whole choice of documents against a plain walk over blocks and ranks."""
    n = 2000
    docs = docs_of(spark, [" ".join(["w"] * (1 + i * i % 11)) for i in range(n)], lambda i: "big" if i % 4 else f"s{i % 3}")
    from pyspark.sql import functions as F

    mix = mixing.plan_mix(docs, entropy_share=1.0)
    mix.sources = mix.sources.withColumn("blocks", F.lit(16).cast("long"))
    key = docs.select("doc_id", "source", F.expr("pmod(xxhash64(source, doc_id, 1), 16L) as block"))
    hashes = {r["doc_id"]: r for r in key.collect()}
    s = {r["src"]: r for r in mix.sources.collect()}
    made = docs.select("doc_id", "source").join(mix.sources, F.col("source") == F.col("src"))
    order = {r["doc_id"]: (r["k"], r["r"]) for r in made.join(key.select("doc_id", "block"), "doc_id").select("doc_id", F.expr("xxhash64(src, epochs, block) as k"), F.expr("xxhash64(doc_id, epochs, 2) as r")).collect()}
    want = Counter()
    for src, m in s.items():
        mine = sorted((k for k, r in hashes.items() if r["source"] == src), key=lambda k: (order[k][0], hashes[k]["block"], order[k][1]))
        left = m["rest"]
        for k in mine:
            want[k] += int(m["epochs"])
        for k in mine:
            left -= 1 + k * k % 11
            if left < 0:
                break
            want[k] += 1
    got = Counter(r["doc_id"] for r in mixing.mixed_report(docs, mix).collect())
    assert got == +want


def test_mixing_of_odd_rows(spark, odd):
    clash = odd.selectExpr("*", "1 as rest", "2 as epochs", "3 as blocks", "4 as cut_key", "5 as cut_block", "6 as cut_rank", "7 as row", "8 as epoch", "9 as rank", "10 as n_tokens", "11 as `_src`")
    mix = mixing.plan_mix(clash)
    out = mixing.mix_sources(clash, mix)
    assert out.columns == clash.columns and 0 < out.count() <= 4 * odd.count()
    report = mixing.mixed_report(clash, mix)
    assert {r["n_tokens"] for r in report.where("doc_id in (0, 1, 2)").collect()} <= {1}
    alone = mixing.plan_mix(odd, budget=1e9, max_repeats=2.0)
    assert mixing.mixed_report(odd, alone).groupBy("doc_id", "source", "n_tokens").count().agg({"count": "max"}).first()[0] <= 4
    total = mixing.mixed_report(odd, alone).agg({"n_tokens": "sum"}).first()[0]
    assert total == 2 * odd.select(mixing.tokens(odd.text).alias("t")).agg({"t": "sum"}).first()[0]


def test_exponents(spark):
    """The exponent of many skewed sources against a direct bisection."""
    sizes = np.array([10**k + k for k in range(1, 10)], float)
    df = spark.createDataFrame([(f"s{i}", int(n)) for i, n in enumerate(sizes)], "src string, n_tokens long")

    def entropy(a):
        w = sizes**a / (sizes**a).sum()
        return -(w * np.log(w)).sum()

    for share in (0.3, 0.6, 0.95):
        target = share * np.log(len(sizes))
        a = mixing.solve_exponent(df, sizes.sum(), target, 0)
        assert entropy(a) == pytest.approx(target, abs=1e-4)
    a = mixing.solve_exponent(df, sizes.sum(), 0.95 * np.log(len(sizes)), 4.0)
    assert (sizes ** (a - 1) / (sizes**a).sum()).max() * sizes.sum() == pytest.approx(4.0, abs=1e-3)


# -- media -------------------------------------------------------------------------------


def test_round_trip():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 576 * k, dtype=np.uint8).tobytes() for k in (1, 2, 30, 400)] + [b"\xff" * 576, b"\x00" * 1152, bytes([255, 0] * 288)]
    files = jpeg.write_jpegs(payloads)
    for p, images, f in zip(payloads, jpeg.read_jpegs(files), files, strict=True):
        assert b"".join(im.luma.tobytes() for im in images) == p
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"


def bits_of(code):
    out = bytearray()
    code += "1" * (-len(code) % 8)
    for i in range(0, len(code), 8):
        out.append(int(code[i : i + 8], 2))
        if out[-1] == 255:
            out.append(0)
    return bytes(out)


def test_colour_with_ac_terms():
    """Two 16x16 units of 4:2:0 colour with AC terms, coded bit by bit."""
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 4, *[1] * 63])) + seg(0xC0, struct.pack(">BHHB", 8, 16, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    # DC: categories 0..3 in 2 bits; AC: end 0, (0,1) 10, skip of 16 110
    head += seg(0xC4, bytes([0, 0, 4, *[0] * 14, 0, 1, 2, 3])) + seg(0xC4, bytes([0x10, 1, 1, 1, *[0] * 13, 0x00, 0x01, 0xF0])) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    dc = {0: "00", 1: "011", -1: "010", 3: "1011", -3: "1000", 7: "11111", -7: "11000"}
    steps, code = [7, -3, 1, 0, -7, 3, 0, -1], ""
    for unit in range(2):
        for k in range(4):
            code += dc[steps[4 * unit + k]] + ("101" + "110" + "100" + "0" if k % 2 else "0")
        code += dc[3] + "0" + dc[-1] + "1010"
    im = jpeg.read_jpegs([head + bits_of(code) + b"\xff\xd9"])[0][0]
    level = np.cumsum(steps)
    want = np.clip((level * 4 + 1028) // 8, 0, 255)
    assert im.luma.tolist() == [[want[0], want[1], want[4], want[5]], [want[2], want[3], want[6], want[7]]]


def test_media_query(spark, docs, texts, odd):
    for r in jpeg.media_features(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    got = jpeg.media_features(odd).collect()
    assert len(got) == odd.count() and len({r["feature"] for r in got if r["doc_id"] in (5, 6)}) == 1
    files = spark.createDataFrame([(1, jpeg.write_jpegs([b"\x80" * 576])[0]), (2, b"none"), (3, None)], "id long, m binary").toDF("id", "m")
    assert [(r["width"], r["error"] is None) for r in jpeg.jpeg_columns(files, "m", "id").orderBy("id").collect()] == [(192, True), (None, False), (None, True)]


# -- pages -------------------------------------------------------------------------------


def test_layout():
    page = """<html><head><title>A &amp; B</title><style>p{}</style></head><body><h1>Head</h1><p>One<p>Two <b>bold</b> x<br>line2
<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x</ol><table><tr><td>k<td>vvv<tr><td>longer<td>2</table><pre>a
  b</pre><div hidden>no</div><div style="display: none">no</div><p aria-hidden=true>no</p>tail <script>x="</p>"</script>end &lt;"""
    title, text = htmltext.render(page)
    assert title == "A & B"
    assert text == "Head\n\nOne\n\nTwo bold x\nline2\n\n- a\n- b\n  - c\n- d\n\n3. x\n\nk       vvv\nlonger  2\n\na\n  b\n\ntail end <"
    for odd in ("", "<", "<a '" * 50, "<div>" * 3000 + "x", "</p></div>", "<table><tr><td>" * 200, "&#xFFFFFF;", "<p title='a>b'>c", "<!-- open", "<title>t", "<td>x</td>"):
        htmltext.render(odd)


def test_long_attributes():
    for n in (100, 5000, 300_000):
        value = "x" * n + "<b>leak</b>" + "y" * n
        for q in "\"'":
            assert htmltext.render(f"<p>a<div data-x={q}{value}{q} style='display:none'>hidden</div><p title = {q}{value}{q}>b")[1] == "a\n\nb"
    assert htmltext.render("<p it's>a</p><p>it's b")[1] == "a\n\nit's b"
    assert htmltext.render("<p title='open>a<p>b")[1] == "a\n\nb"
    for odd in ("<a x=\"", "<a x='\"", "<a ", "<a x=\"<a y='"):
        for end in ("", ">", ">\"", ">'\"", "=\">\""):
            htmltext.render(odd * 100_000 + end)


def visible_words(page):
    """The words that a plain removal of tags and of unseen elements leaves."""
    import html

    plain = re.sub(r"(?s)<(script|style|title|head|template|noscript)\b[^>]*>.*?</\1>|<!--.*?-->", " ", page)
    return Counter(html.unescape(re.sub(r"(?s)<[^>]*>", " ", plain)).split())


def test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r for r in htmltext.extract_text(pages).collect()}
    for r in pages.collect():
        words = visible_words(r["html"])
        mine = Counter(w for w in got[r["page_id"]]["text"].split() if w != "-")
        assert sum((mine - words).values()) <= 0.05 * sum(mine.values())
        assert sum((words - mine).values()) <= 0.05 * sum(words.values())


def test_odd_pages(spark):
    long = "<p>" + "word " * 200_000
    data = [(1, None, None, 1), (2, "u", "", 2), (3, "u", long, 3), (3, "u", long, 3), (None, None, "<p>x", 4)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text int").selectExpr("*", "1 as n_chars", "'q' as title")
    got = sorted(rows(htmltext.extract_text(df), "page_id", "title", "text", "n_chars", "n_lines"), key=lambda r: (r[0] or 0, r[3] or 0))
    body = ("word " * 200_000).strip()
    assert got == [(None, "", "x", 1, 1), (1, None, None, None, 0), (2, "", "", 0, 0), (3, "", body, len(body), 1), (3, "", body, len(body), 1)]
    assert htmltext.extract_text(df.where("false")).count() == 0


def test_rendering_of_any_tags():
    """Random pages of visible elements: their words come out whole and in order."""
    rng = np.random.default_rng(5)
    tags = "div p ul ol li b span pre br hr blockquote dl dt dd h1 a em section".split()
    for _ in range(1500):
        parts, words = [], []
        for k in range(rng.integers(1, 40)):
            t = rng.choice(tags)
            parts.append((f"<{t}>", f"</{t}>", f"<{t} start='--5'>", f" w{k} ")[rng.integers(4)])
            if parts[-1].startswith(" "):
                words.append(f"w{k}")
        assert re.findall(r"w\d+", htmltext.render("".join(parts))[1]) == words
    cells = "".join(f"<tr><td>a{i}<td>{'x' * (i % 7)}b{i}" for i in range(50))
    lines = htmltext.render(f"<table>{cells}</table>")[1].split("\n")
    assert len(lines) == 50 and len({re.search(r"x*b\d+", x).start() for x in lines}) == 1


def test_list_numbers():
    for start, first in (("--5", "1. "), ("\u00b2", "1. "), ("-3", "-3. "), ("7", "7. "), ("99999999999", "1. ")):
        assert htmltext.render(f"<ol start='{start}'><li>a")[1] == f"{first}a"


def test_deep_pages_take_linear_time():
    import time

    n = 30_000
    for page in ("<div>" * n + "<li>" * n, "<b>" * n + "<p>" * n, "<div>" * n + "</span>" * n, "<ul><li>x" * n, "<table>" * n + "<td>x" * n):
        began = time.process_time()
        htmltext.render(page)
        assert time.process_time() - began < 8
    wide = "<table>" + "<tr><td>a<td>b" * 5000 + "<tr><td>" + "x" * 100_000 + "<td>c</table>"
    assert len(htmltext.render(wide)[1]) < 3_000_000


# -- language ----------------------------------------------------------------------------


def test_language(spark, docs, odd):
    model = langid.fit_langid(docs)
    got = langid.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    out = {r["doc_id"]: r for r in langid.identify_language(odd.where("doc_id is not null"), model).collect()}
    assert all(out[k]["lang_pred"] == "und" and out[k]["rejected"] and out[k]["score"] == 0 for k in (0, 1, 2, 9))
    assert langid.keep_known_language(odd, model).columns == odd.columns
    none = langid.fit_langid(docs.where("false"))
    assert rows(langid.identify_language(docs_of(spark, ["abc"]), none), "lang_pred") == [("und",)]


def test_nearest_centroid_by_plain_cosines(spark):
    """Every prediction against cosines with all centroids, and fits that repeat."""
    rng = np.random.default_rng(4)
    made = [" ".join("".join(rng.choice(list(letters), 5)) for _ in range(20)) for letters in ("abcde", "vwxyz", "lmnop") for _ in range(60)]
    df = docs_of(spark, made).selectExpr("doc_id", "text", "element_at(array('A', 'B', null), cast(doc_id / 60 as int) + 1) as lang")
    model = langid.fit_langid(df)
    assert model.langs == ["A", "B"] and len(model.owner) == 2 * langid.CENTROIDS
    again = langid.fit_langid(df.repartition(7))
    assert np.array_equal(model.centroids, again.centroids) and np.array_equal(model.floor, again.floor)
    texts = ["abcde abc", "vwxyz zyx", "lmnop", "a", "", None, "12 3"]
    pred, score, rejected = model.predict(texts)
    for t, p, s, r in zip(texts, pred, score, rejected, strict=True):
        c = langid.gram_counts(t) if t else None
        if c is None:
            assert (p, s, r) == ("und", 0.0, True)
            continue
        v = np.log1p(c) * model.idf
        cos = model.centroids @ (v / np.linalg.norm(v))
        assert p == model.langs[model.owner[cos.argmax()]] and s == pytest.approx(cos.max(), abs=1e-5)
        assert r == (cos.max() < model.floor[model.langs.index(p)])
    assert rejected[2]
    many = docs_of(spark, [f"{chr(97 + i // 26)}{chr(97 + i % 26)} word" for i in range(676)]).selectExpr("doc_id", "text", "concat('l', doc_id) as lang")
    assert len(langid.fit_langid(many).langs) > 500


# -- shingles ----------------------------------------------------------------------------


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_links(sets):
    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    links = []
    for k, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < k)
        links += [(k, j) for j, o in common.items() if 100 * o >= 80 * (len(s) + len(sets[j]) - o)]
    return links


def check_jaccard(df, texts):
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(df).collect()}
    sets = {k: shingles(t) for k, t in texts.items()}
    want = union_find(list(sets), jaccard_links(sets))
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(got[k]["n_shingles"] == len(s) for k, s in sets.items())


def test_jaccard_tables(docs, texts):
    check_jaccard(docs, texts)


def test_jaccard_groups(spark, monkeypatch):
    """A large group near the threshold, a common passage, chains, short texts, and small chunks."""
    monkeypatch.setattr(jaccard, "CHUNK", 32)
    monkeypatch.setattr(jaccard, "CELL_MEMBERS", 16)
    monkeypatch.setattr(jaccard, "CELL_HASHES", 500)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    passage = " ".join(f"p{i}" for i in range(40))
    made = []
    for _ in range(160):
        w = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 7)):
            w[k] = f"x{rng.integers(1 << 30)}"
        made.append(" ".join(w))
    for i in range(80):
        made.append(" ".join(f"u{i}_{j}" for j in range(rng.integers(2, 60))) + " " + passage)
    chain = [f"c{i}" for i in range(400)]
    made += [" ".join(chain[k : k + 100]) for k in range(0, 240, 8)]
    made += ["a b", "A B", "a b c", "", None, "a b c d e", "a  b\tc\nd e", "É b c d e", "é b c d e"]
    check_jaccard(docs_of(spark, made), dict(enumerate(made)))


def test_t_occurrence_search(monkeypatch):
    """DivideSkip over inverted lists against all intersections, whatever the number of long lists."""
    rng = np.random.default_rng(0)
    for trial in range(300):
        monkeypatch.setattr(jaccard, "LONG_WEIGHT", (0.0085, 1.0, 100.0)[trial % 3])
        base = rng.integers(0, 400, rng.integers(1, 80)).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(1, 40)):
            x = base[rng.random(len(base)) > rng.random() * 0.3]
            sets.append(np.unique(np.concatenate([x, rng.integers(0, 1000, rng.integers(0, 12)).astype(np.uint64)])))
        query = np.unique(base)
        want = [i for i, x in enumerate(sets) if (o := len(np.intersect1d(x, query))) and 100 * o >= 80 * (len(x) + len(query) - o)]
        assert jaccard.Lists(sets).partners(query, 80).tolist() == want


def test_jaccard_edges(spark, odd):
    out = jaccard.jaccard_components(odd)
    assert out.count() == odd.count()
    assert rows(out.where("doc_id in (5, 6)"), "component_id") == [(5,)] * 3
    assert rows(out.where("doc_id in (0, 1, 2)"), "n_shingles", "component_id") == [(0, 0), (0, 1), (0, 2)]
    assert rows(out.where("doc_id is null"), "component_id") == [(None,)]
    assert jaccard.jaccard_components(odd.where("false")).count() == 0


def test_one_of_each_stays(spark, odd):
    kept = jaccard.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 0
    assert kept.where("doc_id = 5").count() == 1 and kept.where("doc_id is null").count() == 1
    assert kept.count() == odd.count() - 2
    assert jaccard.keep_one_of_each(odd.where("false")).count() == 0
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    df = spark.createDataFrame([(1, a), (2, b), (2, a), (3, b), (4, c), (4, c), (4, None)], "doc_id long, text string").selectExpr("*", "1 as id", "2 as stays", "3 as row")
    assert rows(jaccard.jaccard_components(df), "doc_id", "component_id") == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4)]
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns and rows(kept, "doc_id") == [(1,), (4,)]


# -- packing -----------------------------------------------------------------------------


def test_pieces():
    assert packing.cut_pieces(5, 4) == [(0, 1), (1, 4)] and packing.cut_pieces(8, 4) == [(0, 4), (4, 4)] and packing.cut_pieces(4, 4) == [(0, 4)]


def test_local_search():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 100, 200).tolist()
        bins = packing.pack_lengths(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(200))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        plain = []
        for n in sorted(sizes, reverse=True):  # first fit, largest first
            at = next((k for k, f in enumerate(plain) if f + n <= 100), None)
            if at is None:
                plain.append(n)
            else:
                plain[at] += n
        assert len(bins) <= len(plain)
    bins, fill = [[0], [1, 2]], [50, 90]
    packing._improve(bins, fill, [50, 45, 45], 100)
    assert sum(f * f for f in fill) >= 50 * 50 + 90 * 90


def test_local_search_reaches_all_bins():
    """Lengths on which best fit is far from the bound: no exchange is left untried."""
    rng = np.random.default_rng(7)
    for low, high in ((400, 900), (500, 1100)):
        sizes = rng.integers(low, high, 600).tolist()
        bins = packing.pack_lengths(sizes, 2048)
        assert sorted(i for b in bins for i in b) == list(range(600))
        fill = [sum(sizes[i] for i in b) for b in bins]
        assert max(fill) <= 2048
        for a, mine in enumerate(bins):
            for n in {sizes[i] for i in mine}:
                for b, other in enumerate(bins):
                    if a != b and fill[b] >= fill[a]:
                        room, gives = 2048 - fill[b], [sizes[j] for j in other]
                        back = [0, *gives, *(x + y for k, x in enumerate(gives) for y in gives[:k])]
                        assert not any(0 < n - x <= room for x in back)


def plain_tokenizer():
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(df, texts):
    t = plain_tokenizer()
    got = defaultdict(list)
    at = defaultdict(list)
    for r in packing.pack_documents(df).collect():
        got[r["doc_id"]].append(r)
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == set(texts)
    for k, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(got[k], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == packing.cut_pieces(len(ids))
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine]
    for places in at.values():
        end = 0
        for off, n in sorted(places):
            assert off == end
            end += n
        assert end <= 2048
    return at


SPECIAL = ["<|endoftext|> a", "a <|endoftext|><|endoftext|>", "<|endoftext", "<| endoftext |>", "  two  spaces ", " \n\n\t x\n \ny", "\u0558\U00010940 1\u2089", "it's 'll\xa0 \u2003x", "\x1ca\x1f b", "", None]


def test_packing(spark, docs, texts, odd):
    at = check_packing(docs, texts)
    total = sum(n for p in at.values() for _, n in p)
    assert len(at) <= -(-total // 2048) + 1
    check_packing(docs_of(spark, SPECIAL), dict(enumerate(SPECIAL)))
    out = packing.pack_documents(odd)
    assert out.where("piece = 0").count() == odd.count()
    assert out.where("doc_id = 0").select("length").first()[0] == 1
    assert packing.pack_documents(odd.where("false")).count() == 0
    repeats = packing.pack_documents(docs_of(spark, ["a b c"] * 3000).selectExpr("7L as doc_id", "text"), shard_pieces=500)
    seq = repeats.groupBy("sequence_id").count().collect()
    assert repeats.count() == 3000 and 5 < len(seq) <= 14


def test_words_are_split_as_the_tokenizer_does():
    e = packing.Encoder.of()
    pre = e.tok.pre_tokenizer
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        if packing._PLAIN.fullmatch(c):
            s = f"a{c}a 1{c}1 .{c}.  {c}"
            assert e.pieces(s) == [s[x:y] for _, (x, y) in pre.pre_tokenize_str(s)], hex(ord(c))


def test_words_are_remembered():
    rng = np.random.default_rng(11)
    parts = ["a", "b", "'s", " ", "  ", "\n", "\t", "1", "\u00e9", ".", "!", "\xa0", "\u4e2d", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(3000)]
    e = packing.Encoder.of()
    for text, got in zip(texts, e.ids(texts), strict=True):
        assert got == np.array([*e.tok.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes(), text


def test_local_search_improves_the_start(monkeypatch):
    rng = np.random.default_rng(0)
    sizes = rng.integers(600, 1100, 3000).tolist()
    done = len(packing.pack_lengths(sizes, 2048))
    monkeypatch.setattr(packing, "_improve", lambda *a, **k: False)
    assert done < len(packing.pack_lengths(sizes, 2048))


# -- passages ----------------------------------------------------------------------------


def plain_removal(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        w = WORD.findall(texts[k] or "")
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            x = tuple(w[p : p + 20])
            if x in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(x)
        out[k] = (len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def check_removal(df, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df).collect()}
    assert got == plain_removal(texts)


def test_passages(docs, texts):
    check_removal(docs, texts)


def test_passage_cases(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    long = [f"l{i}" for i in range(120)]
    made = ["x " * 200, " ".join(long), " ".join(long[30:90]) + " end", "start " + " ".join(long[50:]), " ".join(long[:19]), " ".join(long[:20]), None, "", "a"]
    made += [" ".join(rng.choice(words[:2], 150)) for _ in range(6)]
    made += [" ".join(np.concatenate([rng.choice(words, 30), long[a : a + 40], rng.choice(words, 10)])) for a in (0, 10, 20, 70)]
    check_removal(docs_of(spark, made), dict(enumerate(made)))


def test_passage_spans(spark, odd):
    long = [f"l{i}" for i in range(120)]
    df = docs_of(spark, [" ".join(long), "a b " + " ".join(long[20:100]) + " c"])
    for r in substring.repeated_spans(df).collect():
        assert r["doc_id"] == 1 and r["src_doc"] == 0 and r["src_start"] == r["start"] + 18
    assert substring.remove_repeats(odd).count() == odd.count()
    assert substring.remove_repeats(odd.where("false")).count() == 0


def test_words_of_letters_are_not_searched_for_pieces():
    import public_tokenizers

    from evidence_spark.llm.packing import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked, pieces = [], e.pieces
    e.pieces = lambda x: asked.append(x) or pieces(x)
    text = "a alpha Ölähre éauxß ªº ʰa gamma, x1 it's d.\nEf 日本 жук"
    got = next(iter(e.ids([text])))
    assert np.frombuffer(got, "<u4").tolist() == [*e.tok.encode(text, add_special_tokens=False).ids, 0]
    assert sorted(asked) == [" d.\nEf", " gamma,", " it's", " x1"]
