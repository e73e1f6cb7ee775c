"""Hierarchical packing, collocations and ranked search against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from evidence_spark.llm import htmltext, lexical, neardup, phrases, tiers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i * i % 977}" for i in range(6000))
ODD = [None, "", "   ", "a", "Don't STOP: it's 3.5 €, naïve café", LONG, LONG, "x" * 50_000, "\u0001 odd 😀 <|endoftext|> text here", "１２ Ⅳ ǅ İ ſ ﬁ", "a,b;c d\te\x0bf\x0cg\x1ch"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns of clashing names."""
    rows_ = [(i, t, None if i == 3 else "en" if i % 2 else "fr") for i, t in enumerate(ODD)] + [(5, LONG, "fr"), (None, "no id at all a b", None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(1) for c in ("n", "f", "p", "id", "key", "word", "score", "rank", "start", "tier", "terms")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


# -- hierarchical packing ----------------------------------------------------------------


def check_packing(got, texts):
    """Every id once, in full windows, with the tokenizer's own ids."""
    import public_tokenizers
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, have = Counter(), Counter()
    for doc, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, tiers.END_ID]
        want.update((doc, len(ids), at) for at in range(len(ids)))
    raw = {(doc, len(x)): np.array(x, "<u4").tobytes() for doc, text in texts for x in [[*tok.encode(text or "", add_special_tokens=False).ids, tiers.END_ID]]}
    windows = defaultdict(list)
    for r in got:
        have.update((r.doc_id, r.doc_tokens, at) for at in range(r.start, r.start + r.length))
        assert zlib.crc32(raw[r.doc_id, r.doc_tokens][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        windows[r.sequence_id].append(r)
    assert have == want
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == w[0].tier and at & (at - 1) == 0 and at <= 2048
        assert len({(r.tier, r.step_group) for r in w}) == 1
    return windows


def test_tiers(spark, docs):
    small = [(r.doc_id, r.text) for r in docs.collect()]
    windows = check_packing(tiers.pack_hierarchy(docs.repartition(3)).collect(), small)
    assert {w[0].tier for w in windows.values()} >= {2048, 1024, 512}
    assert sum(w[0].tier < 256 for w in windows.values()) <= 3 * 8  # the ends of three tasks
    check_packing(tiers.pack_hierarchy(docs.coalesce(1), buffer_tokens=20_000).collect(), small)


def test_tiers_odd(spark, odd):
    got = tiers.pack_hierarchy(odd).collect()
    check_packing(got, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert not tiers.pack_hierarchy(odd.limit(0)).collect()


def test_word_encoder_equals_tokenizer():
    import public_tokenizers
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain = "".join(c for c in map(chr, range(1, 0x2100)) if tiers._PLAIN.fullmatch(c))
    rng = np.random.default_rng(7)
    texts = [f"{c}a'S b{c} {c}{c}1{c}" for c in plain] + ["".join(rng.choice(list(plain), 40)) for _ in range(300)] + ODD
    enc = tiers.WordEncoder.of()
    for text, got in zip(texts, enc.ids(texts), strict=True):
        want = [*tok.encode(text or "", add_special_tokens=False).ids, tiers.END_ID]
        assert np.frombuffer(got, "<u4").tolist() == want, text


def test_gaps_are_filled_from_shorter_tiers():
    windows, rest = tiers.pack_tiers([(0, 0, 1500), (1, 0, 548), (2, 0, 600), (3, 0, 424), (4, 0, 90)], last=True)
    assert not rest
    assert (2048, [(0, 0, 1500), (1, 0, 548)]) in windows  # an exact fit, nothing is cut
    assert (1024, [(2, 0, 600), (3, 0, 424)]) in windows
    assert sorted(size for size, _ in windows) == [2, 8, 16, 64, 1024, 2048]
    windows, rest = tiers.pack_tiers([(0, 0, 2000)], last=False)
    assert not windows and rest == [(0, 0, 2000)]


def test_step_groups_are_even():
    rng = np.random.default_rng(1)
    spans = [(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 2048, 4000))]
    windows, _ = tiers.pack_tiers(spans)
    groups = tiers.step_groups(windows, 1 << 15)
    tokens, cost, sizes = Counter(), Counter(), {}
    for (size, window), g in zip(windows, groups, strict=True):
        assert sizes.setdefault(g, size) == size
        tokens[g] += size
        cost[g] += sum(n * n for _, _, n in window)
    assert max(tokens.values()) <= 1 << 15
    of = [c / tokens[g] for g, c in cost.items() if sizes[g] == 2048]
    assert max(of) < 1.1 * min(of)


# -- collocations ------------------------------------------------------------------------


def brute_collocations(texts, k, least):
    """lang, rank, phrase, a, l, r, n, score from plain counts of all phrases."""
    f, n = Counter(), Counter()
    for lang, text in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(ws)
            f.update((lang, *ws[s : s + m]) for m in range(1, 5) for s in range(len(ws) - m + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[s : s + m]) for p, a in often.items() for m in range(2, len(p) - 1) for s in range(1, len(p) - m + 1) if 100 * a >= 80 * f[p[0], *p[s : s + m]]}
    out = defaultdict(list)
    for p, a in often.items():
        if p not in gone:
            score, _, l, r = min((2_000_000 * a // (f[p[: c + 1]] + f[p[0], *p[c + 1 :]]), c, f[p[: c + 1]], f[p[0], *p[c + 1 :]]) for c in range(1, len(p) - 1))
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for lang, x in out.items() for i, (score, a, p, l, r) in enumerate(sorted(x)[:k]))


COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("vocabulary", "at_once"), [(10**6, 10**6), (50, 40)])
def test_collocations(spark, docs, vocabulary, at_once):
    texts = [(r.lang, r.text) for r in docs.collect()]
    got = phrases.collocations(docs, 60, 8, vocabulary, at_once)
    want = brute_collocations(texts, 60, 8)
    assert len(want) > 60 and any(len(x[2].split()) == 4 for x in want)
    assert rows(got, *COLS) == sorted(want, key=repr)


def test_collocations_odd(spark, odd):
    texts = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    extra = [("en", "the quick brown fox, the quick"), (None, "quick brown. quick brown fox"), ("und", "quick brown\tfox"), ("en", "the quick brown"), ("", "quick brown quick brown")]
    df = odd.select("text", "lang", "f", "p").unionByName(spark.createDataFrame([(lang, t, 1, 1) for lang, t in extra], "lang string, text string, f int, p int"))
    got = phrases.collocations(df, 10_000, 2)
    assert rows(got, *COLS) == sorted(brute_collocations(texts + extra, 10_000, 2), key=repr)
    assert not phrases.collocations(df.limit(0)).collect()
    assert not phrases.collocations(df.where("text = 'a'")).collect()


def test_ranking_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", 50)
    want = brute_collocations([(r.lang, r.text) for r in docs.collect()], 20, 8)
    assert rows(phrases.collocations(docs, 20, 8), *COLS) == sorted(want, key=repr)


def test_filter_in_slices(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "COUNTED", 1 << 14)
    monkeypatch.setattr(phrases, "RUN", 1 << 10)
    want = brute_collocations([(r.lang, r.text) for r in docs.collect()], 20, 8)
    assert rows(phrases.collocations(docs, 20, 8), *COLS) == sorted(want, key=repr)


def test_trie():
    rng = np.random.default_rng(5)
    for width, most in ((1, 40), (2, 60_000), (3, 10**7)):
        words = rng.integers(1, most, 300)
        ids = rng.choice(words, 30_000, p=np.arange(300, 0, -1) / 45150).astype(np.int32)
        ids[rng.integers(0, len(ids), 3000)] = 0
        found = {tuple(p) for s in rng.integers(0, len(ids) - 4, 4000) for n in (2, 3, 4) if 0 not in (p := ids[s : s + n].tolist())}
        array = np.array([[*p, *[0] * (4 - len(p))] for p in found], np.int32)
        trie = phrases.Trie(array, width)
        counts = np.zeros(len(found), np.int64)
        for term in trie.walk(ids):
            counts += np.bincount(term, minlength=len(found))
        got = {tuple(x for x in p if x): c for p, c in zip(trie.phrases.tolist(), counts.tolist(), strict=True)}
        have = Counter(tuple(ids[s : s + n].tolist()) for n in (2, 3, 4) for s in range(len(ids) - n + 1))
        assert got == {p: have[p] for p in found}


# -- ranked search -----------------------------------------------------------------------


def brute_search(texts, items, k=10):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))

    docs = [(d, Counter(terms(t))) for d, t in texts]
    n, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        found = []
        for d, c in docs:
            m = 25 + 75 * c.total() * n // total if total else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def test_lexical(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(lexical.lexical_search(docs, items), "item_id", "rank", "doc_id", "score") == sorted(want, key=repr)
    monkeypatch.setattr(lexical, "STEP", 1)
    assert rows(lexical.lexical_search(docs.repartition(5), items, item_chars=2000), "item_id", "rank", "doc_id", "score") == sorted(want, key=repr)


def test_lexical_odd(spark, odd):
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    asked = [(1, LONG), (2, None), (3, ""), (4, "A a odd 😀 no id naïve"), (5, "b"), (None, "id w4"), (6, "...")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumns({"doc_id": F.lit(7), "score": F.lit(1)})
    got = lexical.lexical_search(odd, items)
    assert rows(got, "item_id", "rank", "doc_id", "score") == sorted(brute_search(texts, [(i, t) for i, t in asked if t]), key=repr)
    assert not lexical.lexical_search(odd.limit(0), items).collect()
    assert not lexical.lexical_search(odd, items.limit(0)).collect()


def test_search_stops_early():
    """Groups below the tenth score are never scored, and ties are kept by id."""
    n = 5000
    rng = np.random.default_rng(2)
    has = rng.random((n, 12)) < 0.3
    doc, term = np.nonzero(has)
    block = lexical.Block(list(range(n)), has.sum(axis=1).astype(np.int64) + 1, has.sum(axis=1), term.astype(np.int64), np.ones(len(term), np.int64), n, int(has.sum()) + n)
    weights = np.arange(1, 13, dtype=np.int64) * 100
    top = block.search(np.arange(12), weights, [], 10)
    parts = np.zeros((n, 12), np.int64)
    parts[block.doc, np.repeat(block.term, block.end - block.start)] = block.part
    want = sorted((-int(s), False, i) for i, s in enumerate(parts @ weights))[:10]
    assert top == want


def test_document_lengths_beyond_64_bits():
    n = np.array([10**9, 5])
    assert lexical.document_lengths(n, 10**12, 10**15).tolist() == [25 + 75 * 10**21 // 10**15, 25]


# -- near duplicates of vectors in a cone ------------------------------------------------


def cone(n, mean, pairs, rng, d=64):
    """Unit vectors of a mean cosine, with pairs planted at cosine 0.905."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    r = unit(rng.standard_normal((n, d - 1)))
    i, j = rng.choice(n // 2, pairs, replace=False), n // 2 + np.arange(pairs)
    seen = (0.905 - mean) / (1 - mean)
    other = rng.standard_normal((pairs, d - 1))
    other = unit(other - (other * r[i]).sum(1, keepdims=True) * r[i])
    r[j] = seen * r[i] + math.sqrt(1 - seen * seen) * other
    return np.concatenate((np.full((n, 1), math.sqrt(mean)), math.sqrt(1 - mean) * r), axis=1), i, j


@pytest.mark.parametrize("mean", [0, 0.5, 0.7, 0.8])
def test_recall_in_cones(mean):
    n = 50_000
    x, i, j = cone(n, mean, 1500, np.random.default_rng(1))
    m = x.mean(0)
    met = np.zeros(len(i), bool)
    blocks = -(-n // neardup.BLOCK_ROWS)
    for p in range(neardup.passes_for(n, mean=float(m @ m))):
        k = neardup.sign_keys(x - m, range(p, p + 1))[0]
        place = np.empty(n, np.int64)
        place[np.argsort(k, kind="stable")] = np.arange(n)
        block = np.searchsorted(np.quantile(k, np.arange(1, blocks) / blocks, method="nearest"), k, side="right")
        met |= (np.abs(place[i] - place[j]) <= neardup.WINDOW) & (block[i] == block[j])
    assert met.mean() > 0.99


@pytest.mark.parametrize("mean", [0.5, 0.8])
def test_links_of_a_cone_have_two_ends(spark, mean):
    """Pairs, loose chains and a crowded group in a cone: nearly all links, and each counted twice."""
    rng = np.random.default_rng(3)
    n = 6000
    x, _, _ = cone(n, mean, 400, rng)
    centre = x[0]
    group = centre + rng.standard_normal((500, 64)) * np.linspace(0.01, 0.06, 500)[:, None]
    x = np.concatenate((x, group / np.linalg.norm(group, axis=1, keepdims=True)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(df).collect()}
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    want = hit.sum(1)
    assert sum(got.values()) % 2 == 0
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.99 * want.sum()


# -- layout of pages ---------------------------------------------------------------------


def shown(page):
    return htmltext.render(page)[1]


def test_cells_with_spans_and_lines():
    assert shown("<table><tr><td rowspan=2>R<td>x<tr><td>y<tr><td>long cell<td>z</table>") == "R          x\n           y\nlong cell  z"
    assert shown("<table><tr><td colspan=2>wide heading<td>c<tr><td>a<td>b<td>d</table>") == "wide heading  c\na  b  d"
    assert shown("<table><tr><td><pre>a\n  b</pre><td>q<p>r</table>") == "a    q\n  b  r"
    assert shown("<table><tr><td>o<td><table><tr><td>1<td>2<tr><td>33<td>4</table><td>e</table>") == "o  1   2  e\n   33  4"
    assert len(shown("<table>" + "<tr>" + "<td colspan=1000 rowspan=0>w" * 3000 + "<tr><td>x" * 3000)) > 6000


def test_visibility():
    assert shown("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>z") == "yes\nz"
    assert shown("<style>.x, p.y {display:none} #k{display: none} @media print { .z{display:none} } @import 'a'; em{visibility:hidden}</style><p class='a x'>1<p class=z>2<p id=k>3<p>4<em>5</em>6") == "2\n\n46"
    assert shown("<details>a<summary>S</summary>b</details><details open>c<summary>T</summary>d</details><dialog>e</dialog><dialog open>f</dialog>g") == "S\nc\nT\nd\nf\ng"
    assert shown("<div hidden><details><summary>a</summary>b</details></div>c") == "c"
    assert shown("<p hidden>a<b style='visibility:visible'>b</b><p>c") == "c"


def test_list_numbers_breaks_and_form_text():
    assert shown("<ol><li value=5>a<li>b</ol><ol reversed start=3><li>x<li>y</ol>") == "5. a\n6. b\n\n3. x\n2. y"
    assert shown("a<br>b<br><br>c<textarea> t &amp; u </textarea><select><option>A<option>B</select>") == "a\nb\n\nc t & u A B"


def test_columns_of_random_tables():
    """Each cell starts where its column does: the widths of the columns before it and two spaces each."""
    rng = np.random.default_rng(11)
    for _ in range(200):
        rows_, n = [], 0
        for _ in range(rng.integers(1, 6)):
            row = []
            for _ in range(rng.integers(1, 5)):
                row.append((f"c{n}" + "x" * int(rng.integers(0, 5)), int(rng.choice([1, 1, 1, 2, 3])), int(rng.choice([1, 1, 1, 2, 3]))))
                n += 1
            rows_.append(row)
        grid, width, place = {}, Counter(), {}
        for r, row in enumerate(rows_):
            at = 0
            for word, cols, spans in row:
                while (r, at) in grid:
                    at += 1
                place[word] = (r, at)
                grid.update({(r + i, at + j): word for i in range(spans) for j in range(cols)})
                width[at] = max(width[at], len(word) if cols == 1 else 0)
                at += cols
        plain = {at for row in rows_ for word, cols, _ in row if cols == 1 for at in [place[word][1]]}
        got = shown("<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={s}>{w}" for w, c, s in row) for row in rows_)).split("\n")
        for line, row in zip(got, rows_, strict=True):
            end = 0
            for word, _, _ in row:
                want = sum(width[k] + 2 for k in plain if k < place[word][1])
                at = line.index(word)
                assert at == want or (at == end + 2 and end > want), (got, word)
                end = at + len(word)
