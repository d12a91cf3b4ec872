"""Mixing and the rule ledger: against SQL, against plain Python, and on odd input."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from compare import connect, differences
from countermill.llm import mixing, queries, rule_ledger

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.SQL[name], duck) is None


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_runs_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("sql, run", [(mixing.SQL, lambda d: mixing.mix(d)), (rule_ledger.SQL, lambda d: rule_ledger.judged(rule_ledger.ledger(d)).drop("n_lines", "n_marks"))])
def test_odd_rows_equal_sql(tricky, sql, run):
    import duckdb

    con = duckdb.connect()
    frame = tricky.select("doc_id", "text", "source").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    assert differences(run(tricky), sql, con) is None


def test_empty_tables(nothing):
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0
    assert rule_ledger.ledger(nothing).count() == 0
    assert {r.n_failed for r in rule_ledger.ablations(rule_ledger.ledger(nothing)).collect()} <= {0}


def water(sizes: list[int], weights: list[int], total: float, most: int) -> list[float]:
    """Round by round: clamp, share the excess among the others, until none is above."""
    targets = [total * w / sum(weights) for w in weights]
    capped: set[int] = set()
    while True:
        over = [i for i, t in enumerate(targets) if i not in capped and t > most * sizes[i]]
        if not over:
            return targets
        capped |= set(over)
        rest = total - sum(most * sizes[i] for i in capped)
        free = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [most * sizes[i] if i in capped else rest * weights[i] / free for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 2000, 30, 5000, 7, 900], [1, 1, 10_000], [0, 0, 5, 8]])
def test_targets_equal_rounds_of_clamping(spark, sizes):
    sources = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sources).collect()}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_documents_are_whole_and_near_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = Counter(r.text for r in docs.collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.collect())
    assert max(copies.values()) <= 2
    assert all(r.text in texts for r in out.collect())


def test_odd_rows_mix(tricky):
    assert mixing.mixed_documents(tricky).columns == tricky.columns


def repeated_words(words: list[str]) -> int:
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(covered)


def test_ledger_equals_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in rule_ledger.ledger(docs).collect()}
    for row in docs.collect():
        words = [w.decode() for w in row.text.encode().split()]
        r = got[row.doc_id]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), repeated_words(words))


def test_policies_and_ablations_read_stored_bits(spark):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([0, 0, 1, 2, 3, 4, 4, 12, 16])], "doc_id long, failed_bits long")
    assert rule_ledger.judged(rows, 1).where("kept").count() == 6
    assert rule_ledger.judged(rows, 2).where("kept").count() == 2
    got = {r.rule: (r.n_failed, r.n_failed_alone) for r in rule_ledger.ablations(rows).collect()}
    assert got["symbols"] == (3, 2) and got["few_words"] == (2, 1) and got["shouting"] == (1, 1)
    assert got["repeated_lines"] == (1, 0)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = rule_ledger.judged(rule_ledger.ledger(docs)).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in rows)
