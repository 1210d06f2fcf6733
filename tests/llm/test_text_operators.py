"""Alignment of tokenizers, extraction of main text and ranked search against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fungo.llm import alignment, html, search

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
ODD = [
    (1, None, "x"),
    (2, "", "x"),
    (3, "... 123 !!", None),
    (4, "the cat sat on the mat", "x"),
    (4, "the cat sat on the mat", "x"),
    (None, "The CAT\n\n  sat\ttwice \n on it", "x"),
    (None, "the cat", "x"),
    ((1 << 60) + 1, "the cat sat on the mat", "x"),
    ((1 << 60) + 3, "<|endoftext|> <s> café 日本語 ▁ x", "x"),
    (7, "very long words, " * 40_000, "x"),
]
ODD_SCHEMA = "doc_id long, text string, row string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA).repartition(3)


# --- alignment -----------------------------------------------------------------------------------------------------


@lru_cache(1)
def _tokens():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), alignment.ByteLevel(P.path("byte_bpe_50k.json")).bytes


def _plain(texts):
    """Figures of each text by whole-text encoding and a walk along both token lists."""
    a, b, spelt = _tokens()
    docs, count = [], Counter()
    for text in texts:
        s = " " + (text or "")
        x, y = (a.encode(s, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        xb = [spelt[i] for i in x]
        yb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in (b.id_to_piece(i) for i in y)]
        if b"".join(xb) != s.encode() or b"".join(yb) != s.encode():
            x, y, xb, yb = [], [], [], []
        ends = [np.cumsum([len(t) for t in bs]).tolist() for bs in (xb, yb)]
        links, groups, i, j, gi, gj = Counter(), [], 0, 0, 0, 0
        while i < len(x):
            links[x[i], y[j]] += 1
            d = ends[0][i] - ends[1][j]
            if d == 0:
                groups.append(",".join(map(str, x[gi : i + 1])) + "|" + ",".join(map(str, y[gj : j + 1])))
                gi, gj = i + 1, j + 1
            i, j = i + (d <= 0), j + (d >= 0)
        count.update(links)
        docs.append((len(x), len(y), groups, links))
    most = Counter()
    for (_, q), n in count.items():
        most[q] = max(most[q], n)
    out = []
    for n_a, n_b, groups, links in docs:
        best = sum(n for p, n in links.items() if count[p] == most[p[1]])
        out.append((n_a, n_b, len(groups), links.total(), best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_PAIRS, 300, 0])
def test_alignment_equals_plain_walk(spark, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in FIGURES) for r in alignment.align(docs, frequent=frequent).collect()}
    rows = docs.collect()
    assert got == dict(zip([r["doc_id"] for r in rows], _plain([r["text"] for r in rows]), strict=True))


def test_alignment_of_odd_rows(spark, odd):
    got = sorted((r["doc_id"] or -1, *(r[c] for c in FIGURES)) for r in alignment.align(odd).collect())
    want = sorted((i or -1, *f) for (i, _, _), f in zip(ODD, _plain([t for _, t, _ in ODD]), strict=True))
    assert got == want
    assert alignment.align(odd.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .\n\t\r 　▁'é日\U0001f600\x00\x1c0<s>")), max_size=40))
def test_stretches_spell_whole_texts(text):
    aligner = _ALIGNER
    sums, digests, pairs, times = alignment._counted(aligner, [text, None, text])
    (n_a, n_b, n_groups, n_links, _, _, digest) = _plain([text])[0]
    assert sums[0, 1:5].tolist() == [n_a, n_b, n_groups, n_links] == sums[2, 1:5].tolist() and digests == [digest, "", digest]
    assert sums[1].tolist() == [0] * 6 and sum(times[0].as_py()) == n_links


_ALIGNER = alignment.Aligner(*alignment._paths(None, None), held=50)


def test_products_against_dense_matrices(spark, odd):
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.concatenate((rng.integers(1, n + 1, 12), [n]))) for _ in range(2))
        dense = [(np.searchsorted(e, np.arange(n), side="right")[None, :] == np.arange(len(e))[:, None]).astype(int) for e in (a, b)]
        want = dense[0] @ dense[1].T
        row, col, value = alignment.overlap_links(a, b)
        got = np.zeros_like(want)
        got[row, col] = value
        assert (got == want).all()
        groups = alignment.shared_ends(a, b)
        in_a, in_b = alignment.group_matrix(a, groups), alignment.group_matrix(b, groups)
        row, col, value = alignment.product(in_a, alignment.transposed(in_b, len(groups)), len(b))
        shared = np.searchsorted(groups, a)[:, None] == np.searchsorted(groups, b)[None, :]
        assert sorted(zip(row, col, strict=True)) == sorted(zip(*np.nonzero(shared), strict=True)) and (value == 1).all()
        assert alignment.product_sizes(in_a, alignment.transposed(in_b, len(groups))).sum() == shared.sum()
    for r in alignment.token_links(odd.where("doc_id in (3, 4)")).collect():
        assert sum(x["bytes"] for x in r["links"]) == 1 + len(dict((k, t) for k, t, _ in ODD)[r["doc_id"]])


# --- main text -----------------------------------------------------------------------------------------------------


def _of_template(page):
    found = re.search(r"<article>(.*?)</article>", page, re.DOTALL)
    text = re.sub(r"<(?:/?(?:p|h1)|br)>", " ", found[1])
    return " ".join(entities.unescape(re.sub(r"</?b>", "", text)).split())


def test_main_text_of_whole_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == _of_template(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]
    assert len(got) == pages.count()


def test_main_text_without_marked_article(spark):
    """The same pages with the article's own mark taken away: lines alone have to find it."""
    pages = [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert sum(html.main_text(b)[0] == _of_template(p) for p, b in zip(pages, bare, strict=True)) >= 0.97 * len(pages)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>only a menu</nav>", ""),
        ("<p>a &lt;b&gt; &amp;amp; c</p>", "a <b> &amp; c"),
        ("plain words\n and  more", "plain words and more"),
        ("<article><h1>T</h1><p>one<div class='ad'>buy</div><p>two <em>in</em>line</p></article><footer>f</footer>", "T one two inline"),
        ("<article><header><h1>T</h1></header><p>x<aside>side</aside><form>q</form><p>y</article>", "T x y"),
        ("<main><article><p>text</p></article><section id='comments'><article><p>a long comment of a reader</p></article></section></main>", "text"),
        ("<article><p title='a>b'>q</p><!-- <p>no</p> --><script>var p='</p>'</script><style>p{}</style>z", "q z"),
        ("<div class='cookie-notice'><p>We use cookies on this page, and you have to know</p></div><div><h1>Head</h1><p>" + "word " * 30 + "</p><p>End.</p></div>", "Head " + "word " * 30 + "End."),
        ("<article><p>a&nbsp;b  c</p><pre> x\n y</pre></article>", "a b c x y"),
        ("<script>never closed <p>x</p>", ""),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page)[0] == text


def test_extraction_of_odd_rows(spark):
    rows = [(None, "u", None, 1), (1, None, "<p>" + "long text " * 100_000, 2), (1, None, "<p>x", 3), (2, "u", "", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 999_999]
    assert html.extract(pages.limit(0)).count() == 0


def test_deep_and_broken_markup_is_quick():
    for page in ("<" * 100_000, "<a b='" * 50_000, "<!--" * 50_000, "<b>" * 100_000 + "</i></a>" * 10_000, "<div class='x'>" * 50_000 + "deep"):
        html.main_text(page)


# --- ranked search -------------------------------------------------------------------------------------------------


def _sql(docs: pd.DataFrame, benchmark: pd.DataFrame) -> list[tuple]:
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("benchmark", benchmark)
    return sorted(con.sql(search.ORACLE).fetchall())


@pytest.mark.parametrize("block_terms", [search.BLOCK_TERMS, 100])
def test_search_equals_sql(spark, block_terms):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, search.rank(docs.repartition(5), items, block_terms=block_terms).collect()))
    assert got == _sql(docs.toPandas(), items.toPandas())


def test_search_ties_repeats_and_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "The cat!", 5), (1, "mat", 6), (None, "cat sat", 7), (2, None, 8), (3, "nothing_like", 9)], "item_id int, text string, rank int")
    got = search.rank(odd, items).collect()
    cat = sorted((r["rank"], r["doc_id"]) for r in got if r["item_id"] is None)
    assert [d for _, d in cat] == [4, 4, (1 << 60) + 1, None, None] and [k for k, _ in cat] == [1, 2, 3, 4, 5]
    assert {r["item_id"] for r in got} == {1, None} and len([r for r in got if r["item_id"] == 1]) == 8
    assert search.rank(odd.limit(0), items).count() == 0 and search.rank(odd, items.limit(0)).count() == 0


def test_walk_drops_no_ranked_document():
    """Trees of random vectors with many ties: the best by pruning are the best of all."""
    rng = np.random.default_rng(3)
    weights = rng.integers(0, 40, 60)
    items = [np.unique(rng.integers(0, 60, rng.integers(0, 9))) for _ in range(37)]
    rows = [np.unique(rng.integers(0, 60, rng.integers(0, 12))) for _ in range(700)]
    values = [rng.integers(1, 4, len(r)) for r in rows]
    seen = search.Search(items, weights, 5, np.zeros(len(items), np.int64))
    for start in range(0, 700, 150):
        part, v = rows[start : start + 150], values[start : start + 150]
        level = search.Level(np.concatenate(([0], np.cumsum([len(r) for r in part]))), np.concatenate(part), np.concatenate(v))
        seen.walk(level, list(range(start, start + len(part))))
    got = sorted((r["item_row"], -r["score"], r["doc_id"]) for r in seen.found().to_pylist())
    want = []
    for i, terms in enumerate(items):
        scores = [(-int(sum(weights[t] * x for t, x in zip(r, v, strict=True) if t in terms)), d) for d, (r, v) in enumerate(zip(rows, values, strict=True))]
        want += [(i, s, d) for s, d in sorted(scores)[:5] if s < 0]
    assert got == sorted(want)
