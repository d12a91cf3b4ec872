"""Near-duplicates, components and decontamination against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from countermill.llm import decontaminate, minmax_dedup
from countermill.llm.common import stored
from countermill.llm.components import components

from .conftest import SCHEMA, edited, prose


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(words, words[1:], words[2:], words[3:], words[4:]))


def brute_components(rows: list[tuple], percent: int) -> dict:
    sets = [(doc_id, shingles(text)) for doc_id, text in rows if doc_id is not None]
    parent = {doc_id: doc_id for doc_id, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, (a, s) in enumerate(sets):
        common = Counter(j for g in s for j in holders[g] if j > i)
        for j, n in common.items():
            b, other = sets[j]
            if 100 * n >= percent * (len(s) + len(other) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def check(docs, percent: int = 85) -> None:
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows, percent)
    got = minmax_dedup.near_duplicates(docs, percent).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == sorted(((d, len(shingles(t))) for d, t in rows), key=str)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id == r.component_id)


def test_all_documents_of_a_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_families_of_copies(spark):
    """Exact groups, near groups whose copies are not all alike, chains, and pairs around the limit."""
    rng = random.Random(2)
    rows = []
    for _ in range(4):
        base = prose(rng, 120)
        rows += [base] * 6 + [edited(rng, base, rng.randint(1, 4)) for _ in range(25)]
        chain = base
        for _ in range(8):
            chain = edited(rng, chain, 1)
            rows.append(chain)
    rows += [prose(rng, 60) for _ in range(20)]
    rng.shuffle(rows)
    check(spark.createDataFrame([(1000 - i, t, "en", "a", 1) for i, t in enumerate(rows)], SCHEMA))


def test_odd_rows(tricky, nothing):
    known = tricky.where("doc_id is not null")
    check(known)
    alone = {r.doc_id: r for r in minmax_dedup.near_duplicates(tricky).collect() if r.doc_id is None}
    assert alone[None].component_id is None and alone[None].kept
    assert minmax_dedup.near_duplicates(nothing).count() == 0
    stay = minmax_dedup.without_near_duplicates(tricky)
    assert stay.columns == tricky.columns
    assert Counter(r.doc_id for r in stay.collect()) == {1: 1, None: 2, **dict.fromkeys([4, 5, 6, 7, 9, 10, 11, 12, 13], 1)}


def test_signature_agreement_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = minmax_dedup.signature(codes[:1000]), minmax_dedup.signature(codes[250:1250])
    assert abs((a == b).mean() - 750 / 1250) < 0.15


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    nodes = list(range(200))
    rng.shuffle(nodes)
    pairs = [(nodes[i], nodes[i + 1]) for i in range(99)] + [(nodes[100], nodes[i]) for i in range(101, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = {n: min(nodes[:100]) for n in nodes[:100]} | {n: min(nodes[100:160]) for n in nodes[100:160]}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("pairs, rounds", [([(n, 1) for n in range(2, 200)], 1), ([(n, n + 1) for n in range(1, 200)], 8)])
def test_components_end_with_the_round_that_makes_stars(spark, monkeypatch, pairs, rounds):
    done = []
    monkeypatch.setattr("countermill.llm.components.stored", lambda links: done.append(1) or stored(links))
    assert {r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()} == {1}
    assert 1 <= len(done) <= rounds


def brute_matches(docs: list[tuple], items: list[tuple], threshold: float) -> set:
    found = set()
    texts = [(doc_id, decontaminate.plain_words(body or "")) for doc_id, body in docs]
    joined: dict = {}
    for doc_id, words in texts:
        joined[doc_id] = joined.get(doc_id, "") + " ".join(words) + "|"
    for item_id, text in items:
        item = decontaminate.plain_words(text or "")
        size = min(5, len(item))
        if not item:
            continue
        bag = Counter(tuple(item[i : i + size]) for i in range(len(item) - size + 1))
        for doc_id, words in texts:
            if not any(" ".join(g) in joined[doc_id] for g in bag):
                continue
            for at in range(len(words) - len(item) + 1):
                own = Counter(tuple(words[at + i : at + i + size]) for i in range(len(item) - size + 1))
                if sum((own & bag).values()) >= threshold * sum((own | bag).values()):
                    found.add((doc_id, item_id))
    return found


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(30)] + [(90, "short one here"), (91, None), (92, ""), (93, "...")]
    rows = []
    for n in range(60):
        body = prose(rng, rng.randint(20, 150)).split(" ")
        if n % 2:
            passage = edited(rng, items[rng.randrange(30)][1], rng.choice((0, 0, 1, 1, 2)))
            at = rng.randrange(len(body))
            body[at:at] = passage.upper().split(" ") if n % 3 == 0 else passage.split(" ")
        rows.append((n, " ".join(body)))
    rows += [(70, "x Short, ONE here! y"), (71, items[3][1]), (71, items[3][1]), (72, None), (73, "")]
    rows.append((74, prose(rng, 5000) + " " + items[5][1] + " " + prose(rng, 5000)))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    return docs, spark.createDataFrame(items, "item_id long, text string"), rows, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_leaks_equal_brute_force(leaks, block_bytes):
    docs, benchmark, rows, items = leaks
    want = brute_matches(rows, items, 0.8)
    got = decontaminate.matches(docs, benchmark, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(want) > 10
    clean = decontaminate.decontaminated(docs, benchmark, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows if i not in {d for d, _ in want})


def test_blocks_find_every_fingerprint_within_the_radius():
    import numpy as np

    rng = random.Random(4)
    items = decontaminate.Items([(i, prose(rng, 20)) for i in range(50)], 0.8, 19)
    prints = items.prints[20]
    for _ in range(200):
        code = prints[rng.randrange(50)]
        for bit in rng.sample(range(64), rng.randint(0, 24)):
            code ^= np.uint64(1) << np.uint64(bit)
        want = np.flatnonzero(np.bitwise_count(prints ^ code) <= 19).tolist()
        assert sorted(items.within(20, code)) == want


def test_radius_lets_borderline_pairs_through():
    """Windows of 40 words just above a similarity of 0.8 with an item, the hardest ones there are."""
    import numpy as np

    rng = random.Random(6)
    found = pairs = chosen = 0
    while pairs < 1500:
        texts = [prose(rng, 40) for _ in range(25)]
        items = decontaminate.Items(list(enumerate(texts)), 0.8, 19)
        for i, text in enumerate(texts):
            words = text.split(" ")
            words[rng.choice((0, 1, 2, 3, 37, 38, 39, 36))] = "otherword"
            window = items.windows(items.hasher.of([" ".join(words)])[0], 5)
            similarity = decontaminate.bag_similarity(window, items.by_words[40][i][1])
            if 0.8 <= similarity < 0.9:
                pairs += 1
                code = decontaminate.fingerprint(window)
                found += i in items.within(40, code)
                chosen += len(items.candidates(code)) / 25
    assert found / pairs > 0.998
    assert chosen / pairs < 0.25


def test_plain_codes_are_those_of_plain_words():
    rng = random.Random(3)
    signs = "aAbé ÉßÑ\u00a0\u3000\u201c\u201d¿×÷_-.\x1c\n日本İ"
    hasher = decontaminate.PlainCodes()
    seen: dict = {}
    for _ in range(1500):
        texts = ["".join(rng.choice(signs) for _ in range(rng.choice((0, 1, 5, 20)))) for _ in range(3)]
        codes, places = hasher.of(texts)
        words = [decontaminate.plain_words(t) for t in texts]
        assert [places[i + 1] - places[i] for i in range(3)] == [len(w) for w in words]
        for word, code in zip((w for own in words for w in own), codes.tolist(), strict=True):
            assert seen.setdefault(word, code) == code
    assert len(set(seen.values())) == len(seen)


def test_odd_rows_and_empty_tables(spark, tricky, nothing):
    benchmark = spark.createDataFrame([(1, "One two")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(tricky, benchmark).collect()} == {7, 8}
    assert decontaminate.decontaminated(tricky, benchmark).count() == tricky.count() - 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(tricky, none).count() == 0
    assert decontaminate.decontaminated(tricky, none).count() == tricky.count()
    assert decontaminate.matches(nothing, benchmark).count() == 0
