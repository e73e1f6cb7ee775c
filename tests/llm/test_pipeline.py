"""The pipeline's stages on the smallest data, each judged on its own input."""

import pytest

import __spark_entry__
import corpus_pipeline as P
from conftest import DATA
from evidence_spark.llm.common import cut


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(cut(stage(spark, out[-1], DATA)))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_clean_documents_stay(stages):
    n = [df.count() for df in stages]
    assert n[1] >= 0.99 * n[0] and n[2] == n[3] and 0 < n[2] <= n[1]


def test_near_duplicates_stage_equals_its_operator(stages):
    from evidence_spark.llm.jaccard import jaccard_components

    want = {r["doc_id"] for r in jaccard_components(stages[1]).where("doc_id = component_id").collect()}
    assert {r["doc_id"] for r in stages[2].select("doc_id").collect()} == want


def test_no_base_personal_data_is_left(stages):
    from evidence_spark.llm.pii import PiiModel, pii_report

    left = pii_report(stages[3], PiiModel()).agg({f"n_{k}": "sum" for k in ("email", "phone", "ip")}).first()
    assert sum(left) == 0


def test_packing_covers_all_rows(stages):
    pieces = stages[5]
    assert pieces.where("piece = 0").count() == stages[4].count()
    assert pieces.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_stages(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    data = [
        (1, LONG, "en", "a", 1), (2, LONG, "en", None, 1), (3, None, "en", "a", 0), (4, "", None, "b", 0), (5, "write to joe@site.org or +1 (205) 555-0199 now please", "en", "b", None),
        (5, "write to joe@site.org or +1 (205) 555-0199 now please", "en", "b", None), (6, "12 34", "en", None, 5), (None, "a row without an id", None, "a", 3), (7, "short", "fr", "a", 5), (8, "short", "fr", "b", 5), (None, None, None, None, None),
    ]
    names = "row id stays t base spans src epoch block rank rest cls rep tok _src part side".split()
    docs = spark.createDataFrame(data, SCHEMA).selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(names)])
    out = [docs]
    for _, stage in P.STAGES[1:]:
        out.append(cut(stage(spark, out[-1], DATA)))
    return out


def test_language_stage_on_odd_rows(spark, odd_stages):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = odd_stages[0]
    more = base.limit(5).union(base.limit(5)).selectExpr("cast(null as long) as doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "n_chars")
    both = base.unionByName(more).selectExpr("*", *[f"0 as `{c}`" for c in docs.columns[5:]]).union(docs)
    got = P.language(spark, both, DATA)
    assert got.columns == docs.columns
    texts = [r["text"] for r in got.select("text").collect()]
    assert None not in texts and "" not in texts and "12 34" not in texts
    assert got.where("doc_id is null").count() >= 10 and len(texts) >= base.count() * 0.99
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert P.language(spark, unlabelled, DATA).count() == 0


def test_stages_on_odd_rows(odd_stages):
    docs, near, private, mixed, packed = odd_stages
    assert all(df.columns == docs.columns for df in odd_stages[:-1])
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    assert ids(near) == [1, 3, 4, 5, 6, 7, None, None]
    assert ids(private) == ids(near)
    assert [(r["text"], r["n_chars"]) for r in private.where("doc_id = 5").collect()] == [("write to [EMAIL] or [PHONE] now please", 38)]
    assert private.where("doc_id = 1").first()["text"] == LONG and private.where("doc_id = 3").first()["text"] is None
    assert set(ids(mixed)) <= set(ids(near)) and mixed.count() > 0
    assert packed.where("piece = 0").count() == mixed.count()


def test_stages_on_an_empty_table(spark, odd_stages):
    docs = odd_stages[0].where("false")
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns


def test_mixing_stage_equals_its_operator(stages):
    """Every source keeps to its budget, and the whole epochs of each document are there."""
    from collections import Counter

    from evidence_spark.llm.mixing import plan_mix, tokens

    docs, mixed = stages[3], stages[4]
    mix = plan_mix(docs)
    plan = {r["src"]: r for r in mix.sources.collect()}
    size = docs.select("doc_id", "source", tokens(docs.text).alias("n")).collect()
    times = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert set(times) <= {r["doc_id"] for r in size}
    used = Counter()
    for r in size:
        epochs = int(plan[r["source"] or ""]["epochs"])
        assert epochs <= times[r["doc_id"]] <= epochs + 1
        used[r["source"] or ""] += r["n"] * times[r["doc_id"]]
    for src, p in plan.items():
        share = p["weight"] * mix.budget
        assert share - max(r["n"] for r in size) <= used[src] <= share + 1


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names
