"""Token files: exact round trips, the wavelet matrix against arrays, and the whole pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from countermill.llm import decontaminate, mixing, wavelet, weak_quality
from countermill.session import work_folder

from .test_pairs import brute_components, brute_matches

SMALL = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(wavelet.byte_bpe_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85  '<|>aAé1."), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_apart_give_the_ids_of_the_whole_text(text):
    encode = wavelet.encoder(wavelet.byte_bpe_path())
    assert encode(text) == encode.whole(text)


@pytest.mark.parametrize("n, top", [(0, 5), (1, 2), (511, 300), (512, 300), (513, 3), (5000, 50_000)])
def test_wavelet_matrix_equals_the_array(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint16)
    matrix = wavelet.WaveletMatrix.build(ids, 16)
    assert (matrix.decode() == ids).all()
    for place in rng.integers(0, max(n, 1), 20)[: n and 20].tolist():
        assert matrix.access(place) == ids[place]
    for value in {0, 1, 7, int(ids[0]) if n else 3, 65_536, -1}:
        where = np.flatnonzero(ids == value) if 0 <= value < 65_536 else []
        assert matrix.count(value) == len(where)
        assert [matrix.find(value, i) for i in range(min(5, len(where)))] == list(where[:5])
        assert matrix.find(value, len(where)) == -1
        if n > 10:
            assert matrix.count(value, 3, n - 4) == sum(3 <= p < n - 4 for p in where)


def expected(rows, library) -> list[tuple]:
    """Rows sorted as the files are: by id, nulls first, then text."""
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_tokens", [1 << 20, 700])
def test_round_trip_of_a_table(spark, library, shard_tokens):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    got = wavelet.token_files(docs, shard_tokens=shard_tokens).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == expected(rows, library)


def test_odd_rows_and_empty_tables(tricky, nothing, library):
    rows = [(r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()]
    assert sorted(map(tuple, wavelet.token_files(tricky).collect()), key=str) == expected(rows, library)
    assert wavelet.token_files(nothing).count() == 0


def test_lookups_in_a_file(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = work_folder(spark, "lookup")
    wavelet.write_shards(docs, path, shard_tokens=20_000)
    ids = [i for r in sorted(docs.collect(), key=lambda r: r.doc_id) for i in [*library.encode(r.text, add_special_tokens=False).ids, 2]]
    shards = [wavelet.matrix_of(r.asDict()) for r in spark.read.parquet(path).orderBy("shard").collect()]
    assert len(shards) > 3 and sum(s.n for s in shards) == len(ids)
    assert sum(s.count(2) for s in shards) == ids.count(2)
    assert shards[1].access(17) == ids[shards[0].n + 17]


def test_stages_and_columns(spark, tricky, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "source mixing", "token output"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, tricky, SMALL).columns == tricky.columns
        assert stage(spark, nothing, SMALL).count() == 0


def test_pipeline_equals_brute_force(spark, library):
    """Every stage again in plain Python, but for the trained scorer, whose decisions are taken over."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in weak_quality.scored(docs).collect() if r.kept}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept]
    alike = brute_components([(d, t) for d, t, _ in rows], 80)
    rows = [r for r in rows if alike[r[0]] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_matches([(d, t) for d, t, _ in rows], items, 0.8)}
    rows = [r for r in rows if r[0] not in leaked]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r.doc_id: round(r.taken / r.size) for r in mixing.mix(frame).collect() if r.size}
    mixed = [(d, t) for d, t, _ in rows for _ in range(copies.get(d, 0))]
    got = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert sorted(got, key=str) == expected(mixed, library)
    assert Counter(d for d, _ in mixed) == Counter(d for d, *_ in got)
    assert decontaminate.matches(frame, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
