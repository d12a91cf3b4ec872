"""The n-gram Jaccard join against brute force: links, components, lists in parts, and the filters."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import connect, differences
from countermill.llm import common, skip_join

from .conftest import SCHEMA, edited, prose
from .test_pairs import brute_components, shingles


def check(docs, percent: int = 80, **options) -> None:
    """Rows without an id have no component; the others have that of brute force."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows, percent)
    got = skip_join.joined(docs, percent, **options).collect()
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == sorted(((d, len(shingles(t))) for d, t in rows), key=str)
    assert {(r.doc_id, r.component_id) for r in got} == {(d, want.get(d)) for d, _ in rows}


def families(seed: int) -> list[str]:
    """Exact groups, near groups whose copies are not all alike, chains, and texts that share long passages."""
    rng = random.Random(seed)
    rows = []
    for size in (120, 90, 40):
        base = prose(rng, size)
        rows += [base] * 5 + [edited(rng, base, rng.randint(1, 5)) for _ in range(30)]
        chain = base
        for _ in range(8):
            chain = edited(rng, chain, 1)
            rows.append(chain)
    shared = prose(rng, 60)
    rows += [f"{prose(rng, 30)} {shared} {prose(rng, rng.randint(1, 20))}" for _ in range(40)]
    rows += [prose(rng, n) for n in (1, 2, 3, 4, 5, 6)] * 2 + [prose(rng, 60) for _ in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def family_docs(spark):
    rows = [(1000 - i, t, "en", "a", 1) for i, t in enumerate(families(2))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("percent, part_entries", [(80, skip_join.LIST), (60, 3)])
def test_families_of_copies(family_docs, percent, part_entries):
    """With three entries a part, most lists are taken by pairs of parts."""
    check(family_docs, percent, part_entries=part_entries)


def test_links_are_all_pairs_of_different_sets(family_docs):
    links, members = (df.collect() for df in skip_join.linked_sets(family_docs))
    sets: dict = {}
    for r in family_docs.collect():
        if shingles(r.text):
            sets.setdefault(shingles(r.text), set()).add(r.doc_id)
    want = set()
    listed = sorted(sets, key=len)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if 100 * len(a & b) >= 80 * len(a | b):
                want.add(frozenset((min(sets[a]), min(sets[b]))))
    by_node: dict = {}
    for r in members:
        by_node.setdefault(r.node, set()).add(r.doc_id)
    assert sorted(map(sorted, by_node.values())) == sorted(map(sorted, sets.values()))
    got = [frozenset((min(by_node[r.u]), min(by_node[r.v]))) for r in links]
    assert set(got) == want and len(got) == len(want) > 50


def test_documents_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert differences(skip_join.joined(docs), skip_join.SQL, connect("/root/testdata/sf0.001")) is None


def test_odd_rows(spark, tricky, nothing):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and documents of several texts."""
    base = "one two three four five six seven eight nine ten"
    other = "quite another text of some words"
    several = [(107, base), (107, other), (109, other), (103, base), (103, None)]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in several], SCHEMA)
    check(tricky.unionByName(more, allowMissingColumns=True))
    assert skip_join.joined(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=20), st.integers(0, 60))
def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles(a, extra, drop):
    b = set(sorted(a)[drop:]) | extra
    if b:
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert skip_join.differing_bits(skip_join.parity_bits(x), skip_join.parity_bits(y)) <= len(a ^ b)


@settings(max_examples=100, deadline=None)
@given(st.randoms(use_true_random=False), st.sampled_from([50, 80, 95]), st.integers(1, 400))
def test_skipped_blocks_hold_no_pair(rng, percent, entries):
    """Short and long lists: exactly the pairs that sizes, positions, labels and parts allow."""
    n = np.array(sorted(rng.randint(1, 60) for _ in range(entries)))
    pos = np.array([rng.randint(0, min(4, x - 1)) for x in n.tolist()])
    order = np.lexsort((pos, n))
    n, pos = n[order], pos[order]
    label, part = (np.array([rng.randint(0, 2) for _ in n]) for _ in range(2))
    one_part = rng.random() < 0.5
    got = Counter()
    for i, j in skip_join.block_pairs(n, pos, label, part, one_part, percent):
        got.update(zip(i.tolist(), j.tolist(), strict=True))
    want = Counter()
    for i in range(entries):
        for j in range(i + 1, entries):
            fits = 100 * n[i] >= percent * n[j] and (100 + percent) * min(n[i] - pos[i], n[j] - pos[j]) >= percent * (n[i] + n[j])
            if fits and label[i] != label[j] and (one_part or part[i] != part[j]):
                want[i, j] += 1
    assert got == want
    if entries <= skip_join.BLOCK:
        one = np.full(entries, one_part)
        i, j = skip_join.short_pairs(np.array([0]), np.array([entries]), n, pos, label, one, part, percent)
        assert Counter(zip(i.tolist(), j.tolist(), strict=True)) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAb \n\x0bé", max_size=12), max_size=6), st.sampled_from([3, 8, 1 << 19]))
def test_word_codes_tell_words_apart(texts, stretch):
    before = common.HASH_BYTES
    common.HASH_BYTES = stretch
    try:
        hasher = common.WordCodes()
        column = pa.array([b"zz", *(t.encode() for t in texts)], pa.binary()).slice(1)
        codes, places = hasher.of(column)
        words = [t.encode().lower().split() for t in texts]
        assert places.tolist() == np.cumsum([0, *map(len, words)]).tolist()
        pairs = set(zip([w for own in words for w in own], codes.tolist(), strict=True))
        assert len(pairs) == len({w for w, _ in pairs}) == len({c for _, c in pairs})
        assert [len(s) for s in hasher.shingle_sets(column)] == [len(shingles(t)) for t in texts]
    finally:
        common.HASH_BYTES = before


def test_stretches_hold_all_rows():
    texts = [b"x" * n for n in (0, 5, 100, 3, 0, 7, 200, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.binary())], ["i", "t"]).slice(1)
    parts = list(common.in_stretches(iter([batch]), 1, 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(1, 8))
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 10 for p in parts)
