"""Repair of conversations by one integer minimum.

A conversation's rows are edited so that its role initials read `(s?(ua)+)?`: Keep (0), Rerole to user or
assistant (3), Delete (4, the only edit of a blank or duplicate row) and Insert an empty user or assistant
message anywhere (3). An undeleted truncated row adds 3.

A sequence of edits is one integer. Its high digits are the cost. Its low digits are the audit letters, of
three bits each and in ASCII order (D 1, I 2, K 3, R 4), the first letter in the highest place of a fixed
width and zeros behind the last one. The smaller integer is then the cheaper sequence and, of equally cheap
ones, the ASCII-least audit. The rows and the grammar's four states make a directed acyclic graph; the weight
of a node is the ordinary minimum over its edges, from the last row to the first, where an edit in front of a
sequence moves its letters one place down. The audit alone decides every role of the repaired conversation.

Rows come together by one shuffle on conv_id, sorted inside the partitions, and conversations of at most
SHORT_ROWS rows and SHORT_BYTES bytes are repaired as the stream passes. A longer conversation is never held
by one task: it is cut along (turn, role, text) into runs of at most RUN rows that any task may take, a run
becomes the table of least integers from each state to each state, and the tables are chained from the last
run to the first. That is exact, as of two equally cheap audits of the same rows none begins the other. Its
texts are then streamed behind the audit into the digest; only the digest itself, which has to see the texts
one after the other, runs through one task, and it holds one batch.

Defined results: nulls read as one space where text is needed, so a null text is blank; null turns come first
and count in no gap; a null conv_id is one conversation. Rows of the same turn are taken in the order of role
and text after the damage, so repeated rows are neighbours and the second is a duplicate. A conversation whose
rows were all dropped has zeros, an empty audit and the digest of the empty string. Other columns are not
looked at. Roles other than those with initials s, u and a can only be reroled or deleted. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countermill.llm.common import stored

#: Characters that count as white space, and the ends of a whole sentence.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: Audit letters in ASCII order; a letter is its place in this text, zero is the padding.
LETTERS = "\0DIKR"
D, I, K, R = 1, 2, 3, 4
BITS = 3

#: States: nothing yet, after a system, after a user, after an assistant message.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ACCEPTING = (START, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after an inserted or reroled message.
MADE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

SHORT_ROWS = 4096
SHORT_BYTES = 16 << 20
RUN = 512


def least_weights(rows: list[tuple[str, int]], last: dict[int, int], width: int) -> list[int | None]:
    """The least integer from each state before the rows (initial, fault) to the states in `last`, which
    maps a state after the rows to the weight of what follows. None where there is no way."""
    low = BITS * width
    mask = (1 << low) - 1

    def before(letter: int, cost: int, weight: int | None) -> int | None:
        if weight is None:
            return None
        return (((weight >> low) + cost) << low) | (letter << (low - BITS)) | ((weight & mask) >> BITS)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def with_inserts(w: list[int | None]) -> list[int | None]:
        user = least(w[USER], before(I, INSERT, w[ASSISTANT]))
        assistant = least(w[ASSISTANT], before(I, INSERT, w[USER]))
        opened = before(I, INSERT, user)
        return [least(w[START], opened), least(w[SYSTEM], opened), user, assistant]

    weights = with_inserts([last.get(q) for q in STATES])
    for initial, fault in reversed(rows):
        deleted = [before(D, DELETE, w) for w in weights]
        if fault not in (BLANK, DUPLICATE):
            extra = CUT_OFF if fault == TRUNCATED else 0
            for q in STATES:
                kept = before(K, KEEP + extra, weights[KEPT[q, initial]]) if (q, initial) in KEPT else None
                deleted[q] = least(deleted[q], kept, before(R, REROLE + extra, weights[MADE[q]]))
        weights = with_inserts(deleted)
    return weights


def width_of(rows: int) -> int:
    """Letters that suffice: nothing costs more than deleting all rows and inserting two messages."""
    return rows + (DELETE * rows + 2 * INSERT) // INSERT + 1


def written(weight: int, width: int) -> tuple[int, str]:
    """Cost and audit of a weight."""
    low = BITS * width
    cost, digits = weight >> low, weight & ((1 << low) - 1)
    octal = f"{digits:0{width}o}".rstrip("0")
    return cost, octal.translate({ord(str(i)): letter for i, letter in enumerate(LETTERS)})


def read(cost: int, audit: str, width: int) -> int:
    """The weight of a cost and an audit."""
    digits = int("".join(str(LETTERS.index(c)) for c in audit) or "0", 8)
    return (cost << (BITS * width)) | (digits << (BITS * (width - len(audit))))


NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)


def fault_of(text: str, seen_before: bool) -> int:
    end = text.rstrip(BLANKS)[-1:]
    if not end:
        return BLANK
    if seen_before:
        return DUPLICATE
    return NO_FAULT if end in ENDS else TRUNCATED


class Rebuilt:
    """Follows an audit over the rows of a conversation and digests the repaired messages one by one."""

    def __init__(self, audit: str):
        self.letters = iter(audit)
        self.state = START
        self.digest = hashlib.sha256()
        self.messages = 0

    def _add(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.messages else "").encode() + f"{role}:{text}".encode())
        self.messages += 1

    def _make(self, text: str) -> None:
        self.state = MADE[self.state]
        self._add(ROLES[self.state], text)

    def row(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self._make("")
                continue
            if letter == "K":
                self.state = KEPT[self.state, role[:1]]
                self._add(role, text)
            elif letter == "R":
                self._make(text)
            return

    def end(self) -> str:
        for _ in self.letters:
            self._make("")
        return self.digest.hexdigest()


def gaps_of(turns: set[int]) -> int:
    return min(max(turns) - min(turns) + 1 - len(turns), (1 << 63) - 1) if turns else 0


def repaired_conversation(rows: list[tuple[int | None, str, str]]) -> tuple:
    """Rows (turn, role, text) in order to gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    seen: set[tuple[str, str]] = set()
    codes, faults = [], [0] * 4
    for _, role, text in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        codes.append((role[:1], fault))
        faults[fault] += 1
    width = width_of(len(rows))
    cost, audit = written(least_weights(codes, dict.fromkeys(ACCEPTING, 0), width)[START], width)
    rebuilt = Rebuilt(audit)
    for _, role, text in rows:
        rebuilt.row(role, text)
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(codes, codes[1:]))
    turns = {turn for turn, _, _ in rows if turn is not None}
    return gaps_of(turns), *faults[1:], illegal, cost, audit, rebuilt.end()


RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def as_batches(rows: Iterator[tuple], schema: str, most: int = 5000) -> Iterator[pa.RecordBatch]:
    fields = pa.schema([(name, TYPES[kind]) for name, kind in (field.split() for field in schema.split(", "))])
    kept: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), fields, strict=True)], schema=fields)

    for row in rows:
        kept.append(row)
        if len(kept) >= most:
            yield batch()
            kept = []
    if kept:
        yield batch()


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage; a dropped row stays as one with no role and no text."""
    text = F.coalesce("text", F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = F.crc32(key.cast("binary")) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(hit == 0, F.lit(None)).when(hit == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(hit == 0, F.lit(None))
        .when(hit == 1, F.lit(""))
        .when(hit == 2, F.translate(text, ENDS, ""))
        .otherwise(text)
        .alias("text"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def in_order() -> list[Column]:
    return [F.col(name).asc_nulls_first() for name in ("turn", "role", "text")]


def together(rows: DataFrame, *first: Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *first, *in_order())


def repaired_streams(rows: DataFrame) -> DataFrame:
    """Conversations of a bounded size, each repaired as its rows come by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for conv_id, group in groupby(streamed(batches), key=lambda r: r[0]):
                yield conv_id, *repaired_conversation([r[1:] for r in group if r[2] is not None])

        yield from as_batches(results(), RESULT)

    return together(rows).select("conv_id", "turn", "role", "text").mapInArrow(run, RESULT)


RUNS = (
    "conv_id long, place long, rows long, blank long, duplicate long, truncated long, illegal long, first_role string, "
    "last_role string, low long, high long, turns long, first_turn long, last_turn long, ways string"
)


def run_of(conv_id: int | None, place: int, rows: list[tuple[int | None, str, int]]) -> tuple:
    """What a run of rows (turn, initial, fault) adds to its conversation. Ways: cost and audit from each
    state to each state, one line each."""
    codes = [(initial, fault) for _, initial, fault in rows]
    width = width_of(len(rows))
    ways = []
    for target in STATES:
        for q, weight in enumerate(least_weights(codes, {target: 0}, width)):
            if weight is not None:
                cost, audit = written(weight, width)
                ways.append(f"{q} {target} {cost} {audit}")
    faults = [sum(f == kind for _, f in codes) for kind in (BLANK, DUPLICATE, TRUNCATED)]
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(codes, codes[1:]))
    turns = [turn for turn, _, _ in rows if turn is not None]
    ends = (min(turns), max(turns), len(set(turns)), turns[0], turns[-1]) if turns else (None, None, 0, None, None)
    return conv_id, place, len(rows), *faults, illegal, codes[0][0], codes[-1][0], *ends, "\n".join(ways)


def runs_of_long(rows: DataFrame, run_rows: int = RUN) -> DataFrame:
    """Long conversations as runs in order, wherever a task boundary falls. Duplicates are found before, by
    the first row of each role and text, as a run does not see the rows before it."""
    text_key = F.md5(F.col("text").cast("binary"))
    same = Window.partitionBy("conv_id", "role", text_key).orderBy(F.col("turn").asc_nulls_first())
    marked = rows.where("role is not null").withColumn("again", F.row_number().over(same) > 1)
    ordered = marked.repartitionByRange(F.col("conv_id").asc_nulls_first(), *in_order()).sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), *in_order(), "again"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def runs() -> Iterator[tuple]:
            place = first
            for conv_id, group in groupby(streamed(batches), key=lambda r: r[0]):
                kept: list[tuple] = []
                for _, turn, role, text, again in group:
                    kept.append((turn, role[:1], fault_of(text, again)))
                    if len(kept) == run_rows:
                        yield run_of(conv_id, place, kept)
                        place, kept = place + 1, []
                if kept:
                    yield run_of(conv_id, place, kept)
                    place += 1

        yield from as_batches(runs(), RUNS, 200)

    return stored(ordered.select("conv_id", "turn", "role", "text", "again").mapInArrow(run, RUNS))


CHAINED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def chained(conv_id: int | None, runs: list[dict]) -> tuple:
    """The runs of one conversation, in order, to its counts, cost and audit."""
    width = width_of(sum(r["rows"] for r in runs))
    low = BITS * width
    mask = (1 << low) - 1
    weights: dict[int, int] = dict.fromkeys(ACCEPTING, 0)
    for r in reversed(runs):
        found: dict[int, int] = {}
        for line in r["ways"].split("\n"):
            q, target, cost, audit = line.split(" ")
            if (after := weights.get(int(target))) is None:
                continue
            way = read(int(cost) + (after >> low), audit, width) | ((after & mask) >> (BITS * len(audit)))
            found[int(q)] = min(way, found.get(int(q), way))
        weights = found
    faults = [sum(r[name] for r in runs) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(r["illegal"] for r in runs)
    illegal += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(runs, runs[1:]))
    timed = [r for r in runs if r["turns"]]
    gaps = 0
    if timed:
        shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
        distinct = sum(r["turns"] for r in timed) - shared
        gaps = min(max(r["high"] for r in timed) - min(r["low"] for r in timed) + 1 - distinct, (1 << 63) - 1)
    return conv_id, gaps, *faults, illegal, *written(weights[START], width)


def repaired_long(rows: DataFrame, run_rows: int = RUN) -> DataFrame:
    """Conversations of any size: runs, one chain of runs per conversation, then the texts behind the audit."""

    def chain(key: tuple, table: pa.Table) -> pa.Table:
        found = chained(key[0].as_py(), table.sort_by("place").to_pylist())
        return pa.Table.from_batches(list(as_batches(iter([found]), CHAINED)))

    audits = stored(runs_of_long(rows, run_rows).groupBy("conv_id").applyInArrow(chain, CHAINED))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    heads = audits.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for conv_id, group in groupby(streamed(batches), key=lambda r: r[0]):
                rebuilt = Rebuilt("")
                for _, kind, _, role, text in group:
                    if kind == 0:
                        rebuilt = Rebuilt(text)
                    elif role is not None:
                        rebuilt.row(role, text)
                yield conv_id, rebuilt.end()

        yield from as_batches(results(), "conv_id long, repaired_sha256 string")

    digests = (
        together(heads.unionByName(texts), F.col("kind"))
        .select("conv_id", "kind", "turn", "role", "text")
        .mapInArrow(run, "conv_id long, repaired_sha256 string")
    )
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        digests.alias("d")
        .join(audits.alias("a"), F.col("d.conv_id").eqNullSafe(F.col("a.conv_id")), "left")
        .select(
            "d.conv_id",
            *(F.coalesce(f"a.{name}", F.lit(0)).cast("long").alias(name) for name in counts),
            F.coalesce("a.audit", F.lit("")).alias("audit"),
            "repaired_sha256",
        )
    )


def repaired(conversations: DataFrame, short_rows: int = SHORT_ROWS, short_bytes: int = SHORT_BYTES) -> DataFrame:
    """Per conversation after the damage: counts, cost, audit and the digest of the repaired messages."""
    rows = damaged(conversations)
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    # A row may be doubled, so half the bounds hold for the rows as they come.
    long = stored(sizes.where((F.col("rows") > short_rows // 2) | (F.col("bytes") > short_bytes // 2)).select("conv_id"))
    if long.isEmpty():
        return repaired_streams(rows)
    same = F.col("r.conv_id").eqNullSafe(F.col("l.conv_id"))
    short = rows.alias("r").join(long.alias("l"), same, "left_anti")
    rest = rows.alias("r").join(long.alias("l"), same, "left_semi")
    return repaired_streams(short).unionByName(repaired_long(rest))
