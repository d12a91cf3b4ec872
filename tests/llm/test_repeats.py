"""Long repeats against a table of all 400-byte strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from countermill.llm import suffix_levels as S

from .conftest import SCHEMA, edited, prose


def brute(rows: list[tuple]) -> list[tuple]:
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    out = []
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = bytes(gone).replace(b"\0", b" ").split()
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs, **options) -> None:
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in S.removed_repeats(docs, **options).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_all_documents_of_a_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_planted_repeats(spark, batches):
    rng = random.Random(batches)
    passages = [prose(rng, n) for n in (30, 60, 75, 90, 150, 400)]
    rows = []
    for n in range(80):
        text = prose(rng, rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(passages)
            cut = rng.randrange(len(passage) // 3 + 1)
            text += " " + passage[cut : len(passage) - rng.randrange(len(passage) // 3 + 1)] + prose(rng, rng.randint(0, 60))
        rows.append(text)
    base = prose(rng, 500)
    rows += [base] * 3 + [edited(rng, base, k) for k in (1, 2, 5, 10)] + [base[100:] + base, "é" * 900, "abc" * 500]
    rows += ["the same line of text, again and again and once more\n" * 40, "x" * 399, "x" * 400, None, ""]
    check(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(rows)], SCHEMA), batches=batches, segment_bytes=1 << 14)


def test_a_key_with_more_runs_than_a_level_keeps(spark, monkeypatch):
    """One 300-byte passage inside many texts; levels keep two runs of a key."""
    monkeypatch.setattr(S, "MOST", 2)
    rng = random.Random(6)
    passage = prose(rng, 60)[:300]
    long = prose(rng, 120)
    rows = [prose(rng, 60) + passage + prose(rng, 60) for _ in range(30)]
    rows += [prose(rng, 30) + long + prose(rng, 30) for _ in range(12)] + rows[:5]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(rows)], SCHEMA)
    check(docs.coalesce(3), segment_bytes=1 << 14)


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 1000)
    rng = random.Random(7)
    base = prose(rng, 1500)
    rows = [base, prose(rng, 37) + base[500:6000] + prose(rng, 50), base[3000:] + base[3000:5000]]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(rows)], SCHEMA)
    covered = Counter()
    for _, part in S.pieces(base.encode()):
        covered[len(part)] += 1
        assert len(part) <= 1399
    check(docs)


def test_odd_rows_and_empty_tables(tricky, nothing):
    check(tricky)
    assert S.removed_repeats(nothing).count() == 0


def test_levels_merge_geometrically(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, prose(rng, 200), "en", "a", 1) for i in range(40)], SCHEMA)
    family = S.Levels()
    packed = S.stored(S.packed_entries(docs, 7, 8))
    ranks = []
    for batch in range(7):
        family.add(packed.where(f"batch = {batch} and segment >= 0"))
        ranks.append([rank for rank, _ in family.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]


def test_equal_windows_share_a_side():
    rng = random.Random(1)
    same = prose(rng, 200).encode()
    a, b = prose(rng, 50).encode() + same, prose(rng, 90).encode() + same + b"tail"
    keys = []
    for text in (a, b):
        runs = S.Runs(np.frombuffer(text, np.uint8))
        keys.append(set(np.concatenate([k for k, _ in runs.sides()]).tolist()))
    assert len(keys[0] & keys[1]) > 3


def test_whole_texts_go_to_python_in_bounded_batches(spark):
    """No stage takes more than 2,000 texts at a time from the session's 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    try:
        spark.conf.set(name, "10000")
        S.removed_repeats(docs)

        def counted(batches):
            for batch in batches:
                yield S.pa.RecordBatch.from_arrays([S.pa.array([batch.num_rows], S.pa.int32())], ["rows"])

        sizes = docs.mapInArrow(counted, "rows int")
        assert max(r.rows for r in sizes.collect()) <= 2000
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("cases, copies", [(120, 1), (3, 300)])
def test_a_window_between_two_sides_is_no_repeat_of_itself(spark, cases, copies):
    """A window on the border of an anchor's sides was compared under both, and met itself where they met in one
    segment, or, under keys of many runs, in one chunk."""
    rng = random.Random(11)

    def letters(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))

    texts = []
    for _ in range(cases):
        text = letters(1000)
        runs = S.Runs(np.frombuffer(text.encode(), np.uint8))
        border = runs.anchor - S.SIDE
        at = int(border[np.argmax(np.minimum(border - runs.first, runs.last - border))])
        texts.append(text)
        for _ in range(copies):
            texts.append(letters(300) + text[max(0, at - 50) : at + 300] + letters(300))
            texts.append(letters(300) + text[at + 100 : at + 450] + letters(300))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r for r in S.removed_repeats(docs).collect() if r.n_removed] == []
