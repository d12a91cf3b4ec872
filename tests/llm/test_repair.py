"""Conversation repair and fill-in-the-middle: SQL, brute force over all edits, and exact round trips."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import connect, differences
from countermill.llm import conversation_repair as repair
from countermill.llm import conversation_sql, fill_middle

SMALL = "/root/testdata/sf0.001"


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Uniform-cost search over edit sequences (cost, audit), without states or weights."""
    heap = [(0, "", 0, "")]
    while True:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if len(audit) > 3 * len(rows) + 4:
            continue

        def go(letter: str, price: int, to: int, made: str) -> None:
            if re.fullmatch("s?(ua)*u?", made):
                heapq.heappush(heap, (cost + price, audit + letter, to, made))

        if i < len(rows):
            initial, fault = rows[i]
            extra = 3 if fault == repair.TRUNCATED else 0
            go("D", 4, i + 1, roles)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                if initial:
                    go("K", extra, i + 1, roles + initial)
                for made in "ua":
                    go("R", 3 + extra, i + 1, roles + made)
        for made in "ua":
            go("I", 3, i, roles + made)


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=6)


@settings(max_examples=400, deadline=None)
@given(ROWS, st.integers(1, 4))
def test_least_weight_is_the_cheapest_sequence(rows, run):
    width = repair.width_of(len(rows))
    got = repair.written(repair.least_weights(rows, {0: 0, 3: 0}, width)[0], width)
    assert got == cheapest(rows)
    if rows:
        placed = [(i, *row) for i, row in enumerate(rows)]
        names = [f.split()[0] for f in repair.RUNS.split(", ")]
        runs = [dict(zip(names, repair.run_of(1, i, placed[i : i + run]))) for i in range(0, len(placed), run)]
        assert repair.chained(1, runs)[-2:] == got
        assert repair.read(*got, width) == repair.least_weights(rows, {0: 0, 3: 0}, width)[0]


def plain_result(rows: list[tuple]) -> dict:
    """conv_id to the result, from rows (conv_id, turn, role, text) taken one by one."""
    out, kept = {}, {}
    for conv_id, turn, role, text in rows:
        kept.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        hit = zlib.crc32(name.encode()) % 20
        if hit == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
        kept[conv_id] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for conv_id, found in kept.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes = set(), []
        for _, role, text in found:
            end = re.sub("[\x20\x09-\x0d]", "", text)[-1:]
            fault = 1 if not end else 2 if (role, text) in seen else 0 if end in ".!?" else 3
            seen.add((role, text))
            codes.append((role[:1], fault))
        cost, audit = cheapest(codes)
        made, at, last = [], 0, ""
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else found[at]
            at += letter != "I"
            if letter != "D":
                role = role if letter == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                made.append(f"{role}:{text}")
        turns = {t for t, _, _ in found if t is not None}
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(sum(f == k for _, f in codes) for k in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(codes, codes[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return out


def as_dict(df) -> dict:
    rows = df.collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, ties, repeated rows, unknown roles, empty and long texts, clashing extra columns."""
    rng = random.Random(7)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "no", " \n", "", None, "Why?", "né…", "long " * 3000 + "!"])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None, turn * 3]), role, text))
    rows += rows[:20]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("copy", "cost", "audit", "place", "kind", "rows"):
        df = df.withColumn(name, F.lit("extra"))
    return rows, df


def test_odd_conversations(odd):
    rows, df = odd
    assert as_dict(repair.repaired(df)) == plain_result(rows)


def test_long_conversations_take_the_same_edits(odd):
    rows, df = odd
    want = plain_result(rows)
    assert as_dict(repair.repaired_long(repair.damaged(df), 2)) == want
    assert as_dict(repair.repaired(df, short_rows=6)) == want


def test_one_long_conversation(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {t % 900}{rng.choice(['.', '.', ''])}") for t in range(9000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = as_dict(repair.repaired(df))
    whole = as_dict(repair.repaired(df, short_rows=1 << 20))
    assert got == whole


def test_no_conversations(spark):
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    # Dropped as a whole: crc32("20:0") is a multiple of 20 for the first such number.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = as_dict(repair.repaired(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long = as_dict(repair.repaired_long(repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))))
    assert long == got


def test_conversations_against_sql(spark):
    df = repair.repaired(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    assert differences(df, conversation_sql.SQL, connect(SMALL)) is None


def test_fill_middle_against_sql(spark):
    df = fill_middle.digests(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert differences(df, fill_middle.SQL, connect(SMALL)) is None


def middle_by_hand(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    words = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(words[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_fill_middle_on_odd_rows(spark, tricky, nothing, chunk):
    extra = [(20 + i, f"a{m}b c d e", "en", "a", 1) for i, m in enumerate(("<P>", "<S>", "<M>", "<P", "S>", "P><", "日本 <"))]
    docs = tricky.select("doc_id", "text", "kept", "row").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
            "doc_id", "text", "'x' AS kept", "'y' AS row"
        )
    )
    if chunk == 1:
        docs = docs.where("length(coalesce(text, '')) < 10000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [middle_by_hand(*r) for r in rows]
    texts = Counter((r.doc_id, r.form, r.output) for r in fill_middle.output_texts(docs, chunk=chunk).collect())
    assert texts == Counter((d, form, out) for d, _, form, _, _, out in want)
    assert all(fill_middle.restored_text(out, form) in {t or "" for d, t in rows if d == doc_id} for doc_id, form, out in texts)
    got = Counter(tuple(r) for r in fill_middle.digests(docs, chunk=chunk).collect())
    assert got == Counter((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows, strict=True))
    assert fill_middle.digests(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ<>PSM \n.é日"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_units_are_those_of_the_pattern(text):
    starts = fill_middle.unit_starts(text.encode()).tolist()
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    offsets, at = [], 0
    for unit in units:
        offsets.append(at)
        at += len(unit.encode())
    assert starts == offsets
