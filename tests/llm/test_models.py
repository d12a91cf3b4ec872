"""Trained operators: held-out accuracy, plain recomputation, and odd input."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from countermill.llm import bloom_lm, html_crf, toxicity, weak_quality
from countermill.llm.common import all_unpacked, packed, unpacked
from countermill.llm.dom_blocks import blocks
from countermill.llm.page_maker import Maker, labelled_pages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_labeller_model_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    n, good = 20_000, rng.random(20_000) < 0.7
    right = np.linspace(0.65, 0.95, 9)
    votes = np.where(rng.random((n, 9)) < 0.2, 0, np.where(rng.random((n, 9)) < right, np.where(good, 1, 2)[:, None], np.where(good, 2, 1)[:, None]))
    codes = votes @ (3 ** np.arange(8, -1, -1))
    patterns, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    posterior, tables, share = weak_quality.fit_labellers(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.03
    assert np.abs(tables[0, :, 1] - 0.8 * right).max() < 0.04
    assert ((posterior[back] > 0.5) == good).mean() > 0.97


def test_quality_against_labels_it_never_saw(docs, labels):
    rows = weak_quality.scored(docs).join(labels, "doc_id").collect()
    kept = [r.kept for r in rows if r.quality == 1]
    gone = [not r.kept for r in rows if r.quality == 0]
    assert sum(kept) >= 0.99 * len(kept)
    assert sum(gone) >= 0.9 * len(gone)


def test_quality_of_odd_rows(tricky, nothing):
    rows = weak_quality.scored(tricky).collect()
    assert len(rows) == tricky.count()
    by_id = {r.doc_id: r for r in rows}
    assert not by_id[4].kept and not by_id[5].kept and not by_id[6].kept and by_id[4].score == 0.0
    assert by_id[1].score == by_id[2].score
    good = weak_quality.good_documents(tricky)
    assert good.columns == tricky.columns and good.count() == sum(r.kept for r in rows)
    assert weak_quality.scored(nothing).count() == 0


def test_toxicity_of_held_out_rows(spark):
    """About 350 toxic texts in four languages, each with ten words of its own, to learn from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.scored(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.01


def test_toxicity_weights_are_few(docs, labels):
    at, w = toxicity.train(docs, labels)
    assert 0 < len(at) < 5000 and (w != 0).all()


def test_toxicity_odd_rows(spark, tricky, nothing, labels):
    marks = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    rows = toxicity.scored(tricky, marks).collect()
    assert len(rows) == tricky.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.scored(nothing, marks).count() == 0
    unlabelled = toxicity.scored(tricky, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in unlabelled} == {0.5}


def plain_tokens(text):
    return [*(text or "").encode().lower().split(), None]


def base_scores(rows):
    counts = Counter()
    for doc_id, text in rows:
        if zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 != 2:
            counts.update(plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    for doc_id, text in rows:
        own = plain_tokens(text)
        yield doc_id, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)


@pytest.mark.parametrize("most_words", [16_000_000, 10])
def test_base_scores_equal_plain_counting(spark, docs, most_words):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d: x for d, *x in base_scores(rows)}
    for r in bloom_lm.scored(docs, most_words=most_words).collect():
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_model_beats_single_word_counts_on_held_out_rows(docs):
    rows = [r for r in bloom_lm.scored(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_filter_never_undercounts_and_rarely_overcounts(docs):
    _, model = bloom_lm.train(docs)
    counts = Counter()
    for r in docs.collect():
        counts.update(plain_tokens(r.text)[:-1])
    words = list(counts)
    hashes = bloom_lm.WordHashes()
    got = model.count(bloom_lm.key_of(hashes.of(words)), 0)
    true = np.array([counts[w] for w in words])
    low = bloom_lm.value_of(bloom_lm.level_of(true, 0), 0)
    assert (got >= low).all() and (got > low).mean() < 0.12
    unseen = hashes.of([f"never {i}".encode() for i in range(5000)])
    assert (model.count(bloom_lm.key_of(unseen), 0) > 0).mean() < 0.12


def test_a_small_filter_leaves_out_rare_ngrams_only(docs):
    _, model = bloom_lm.train(docs, most_bits=1 << 16)
    unseen = bloom_lm.key_of(bloom_lm.WordHashes().of([f"never {i}".encode() for i in range(5000)]))
    assert len(model.bits) * 8 <= 1 << 16 and (model.count(unseen, 0) > 0).mean() < 0.12


def test_open_ngrams_cross_one_shuffle_and_are_not_stored(docs, monkeypatch):
    """They were stored with the texts and then shuffled, which put them on disk twice."""
    tables, stored = [], bloom_lm.stored

    def kept(df, **options):
        tables.append(df)
        return stored(df, **options)

    monkeypatch.setattr(bloom_lm, "stored", kept)
    result = bloom_lm.scored(docs, most_bits=1 << 16, flush=20_000)
    assert len(tables) == 2 and not any({"keys1", "keys2"} & set(table.columns) for table in tables)
    assert result.count() == docs.count()


def test_work_is_alike_with_and_without_room_for_all_ngrams(docs, monkeypatch):
    """A filter without room asked for a second exchange of n-grams, so disk and time rose in a step with the input."""
    tables, gathered, stored = [], [], bloom_lm.stored

    def kept(df, **options):
        tables[-1].append(df.schema)
        return stored(df, **options)

    monkeypatch.setattr(bloom_lm, "stored", kept)
    monkeypatch.setattr(type(docs), "toPandas", lambda df: gathered.append(df))
    for bits in (1 << 16, 1 << 28):
        tables.append([])
        bloom_lm.scored(docs, most_bits=bits, flush=20_000)
    assert tables[0] == tables[1] and not gathered


def test_scores_are_those_of_the_whole_filter(docs):
    """Segments that tasks fill and probe give the levels that the filter in one piece gives."""
    _, model = bloom_lm.train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2))
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in bloom_lm.scored(docs, flush=50_000).collect():
        codes, before, _ = bloom_lm.token_codes([texts[r.doc_id]], bloom_lm.WordHashes())
        assert r.score == pytest.approx(model.log10(codes, before).sum(), rel=1e-9)


def test_codes_of_words_come_back_from_their_keys():
    codes = np.random.default_rng(3).integers(0, 1 << 64, 1000, np.uint64)
    assert (bloom_lm.code_of(bloom_lm.key_of(codes)) == codes).all()


@pytest.mark.parametrize("most_words", [16_000_000, 0])
def test_ngrams_left_out_of_a_small_filter_keep_their_counts(docs, most_words):
    """Scores are those of a filter with room for all, but for false positives, which are never rarer than an n-gram left out."""
    columns = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    small, large = (
        {r.doc_id: r for r in bloom_lm.scored(docs, most_words=most_words, most_bits=bits, flush=20_000).select(columns).collect()}
        for bits in (1 << 18, 1 << 28)
    )
    assert small.keys() == large.keys()
    for doc_id, r in small.items():
        assert tuple(r)[:3] == tuple(large[doc_id])[:3] and r.base_score == pytest.approx(large[doc_id].base_score)
    per_token = np.array([(r.score - large[d].score) / r.n_tokens for d, r in small.items()])
    assert np.abs(per_token).mean() < 0.03 and np.abs(per_token).max() < 0.3


def test_probabilities_of_next_words_sum_to_about_one(docs):
    _, model = bloom_lm.train(docs)
    words = sorted({w for r in docs.collect() for w in plain_tokens(r.text)[:-1]})
    codes = bloom_lm.WordHashes().of(words)
    for before in codes[:: len(codes) // 5]:
        total = (10 ** model.log10(codes, np.full(len(codes), before))).sum()
        assert 0.8 < total < 1.25


def test_language_model_odd_rows(tricky, nothing):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    want = sorted(((d, n, k, t, round(b, 6)) for d, n, k, t, b in base_scores(rows)), key=str)
    got = bloom_lm.scored(tricky).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    again = bloom_lm.scored(tricky, most_words=0).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in again), key=str) == want
    assert bloom_lm.scored(nothing).count() == 0
    untrained = bloom_lm.scored(tricky.where(F.col("doc_id").isin(1) & (F.crc32(F.lit("1").cast("binary")) % 7 == 2)))
    assert untrained.count() in (0, 1)


def test_blocks_of_a_page():
    page = "<p>a &amp; b<br>c<p>d <i>e</i><!-- x --><script>no()</script> f<ul><li>g<li><a href='>'>h</a></ul>tail &nbsp; end<div class=x id='side-Bar'>z</div><b"
    found = blocks(page)
    assert [b.text for b in found] == ["a & b c", "d e f", "g", "h", "tail end", "z"]
    assert found[3].linked == 1 and found[5].path == (("div", "x side bar"),)
    assert blocks("") == [] and blocks("<!-- open") == [] and blocks("a < b") [0].text == "a < b"
    assert blocks("<script>var a = '<p>x</p>'")== []


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p title="' + "x" * 9000 + ' > tail">text</p><p>b</p>', ["text", "b"]),
        ("<p title='" + "> " * 5000 + "'>text</p>", ["text"]),
        ("<p>a</p><svg-icon>x</svg-icon><video-player>y</video-player><style-guide>z</style-guide><p>b</p>", ["a", "xyz", "b"]),
        ("<p>a</p><svg><path d='M0'/><text>x</text></svg><p>b</p>", ["a", "b"]),
        ("<p>a</p><svg><p>b</p><video src=x><p>c</p><canvas>", ["a", "b", "c"]),
        ("<p>a</p><svg><p>b</p><svg><g>x</g></svg><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><svg><svg>x</svg>y</svg><SVG/><p>b</p>", ["a", "b"]),
        ("<p>a</p><object data=x>what stands in</object><p>b</p>", ["a", "what stands in", "b"]),
        ("<p>a</p><script>if (a < b) '</p>'</script ><p>b</p><style>p>a{}", ["a", "b"]),
        ("<p>a</p><script-x>c</script-x><!-- x", ["a", "c"]),
        ("<p class=it's>a</p><p id='one>b</p><p>c", ["a", "b", "c"]),
        ("<p title=\"a>b</p><p>c</p>", ["b", "c"]),
        ("<p>1 < 2 <3</p><a", ["1 < 2 <3"]),
    ],
)
def test_markup_that_must_not_swallow_text(page, want):
    assert [b.text for b in blocks(page)] == want


def test_a_very_long_page_with_open_quotes():
    page = "<p>a</p>" + "<i x=\"'>t</i>" * 20_000 + '<p>b</p>' + "<div a=1>" * 20_000 + "<p>c</p>" + "<svg>" * 5000
    found = [b.text for b in blocks(page)]
    assert found[0] == "a" and found[-1] == "c"


def test_main_text_of_made_pages_it_was_not_trained_on():
    chain = html_crf.fit(labelled_pages(1, 240))
    right = total = 0
    for page, labels in labelled_pages(99, 120):
        got = chain.decode([chain.score(b) for b in page])
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_equals_all_paths():
    from itertools import product

    chain = html_crf.Chain({}, [[0.3, -0.5], [-0.2, 0.6]], [0.0, 0.1])
    rng = np.random.default_rng(0)
    for _ in range(20):
        scores = rng.normal(size=6).tolist()
        value = lambda path: chain.start[path[0]] + sum(s for s, p in zip(scores, path) if p) + sum(chain.moves[a][b] for a, b in zip(path, path[1:]))
        best = max(product((0, 1), repeat=6), key=value)
        assert chain.decode(scores) == [bool(x) for x in best]


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_crf.extracted(pages).collect()}
    assert len(got) == pages.count()
    for row in pages.collect():
        want = "\n\n".join(b.text for b in blocks(row.html) if any(tag == "article" for tag, _ in b.path))
        assert got[row.page_id].text == want
        assert got[row.page_id].n_chars == len(want) and got[row.page_id].url == row.url


def test_odd_pages(spark):
    page, texts = Maker(3).page()
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", page), (3, "w", "<div>" * 5000 + "deep"), (4, "x", "plain text only"), (5, "y", "<" * 2000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = html_crf.extracted(pages).collect()
    assert len(got) == 7 and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert texts[-1] in next(r.text for r in got if r.page_id is None)
    assert html_crf.extracted(pages.limit(0)).count() == 0


def test_packed_arrays_take_less_room_and_come_back():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2000, 60_000):
        keys = np.unique(rng.integers(0, 1 << 55, n, dtype=np.uint64))
        levels = rng.geometric(0.5, n).astype(np.uint16)
        assert (unpacked(packed(keys, True), np.uint64, True) == keys).all()
        assert (unpacked(packed(levels), np.uint16) == levels).all()
    assert len(packed(keys, True)) < 0.7 * keys.nbytes and len(packed(levels)) < 0.3 * levels.nbytes
    assert len(zlib.compress(packed(keys[:2000], True))) < 0.8 * keys[:2000].nbytes
    column = pa.chunked_array([[packed(keys[:10], True), b""], [packed(keys[10:], True)]], pa.binary())
    assert (all_unpacked(column, np.uint64, True) == keys).all()
