"""Exact removal of long repeats with a logarithmic family of sampled suffix arrays.

A suffix array of every byte does not fit a few times the input, so suffixes are sampled: of each window
of LENGTH bytes the 32-byte string with the smallest hash is its anchor, the leftmost if several are. Equal
windows have equal anchors at equal places, so all windows of one anchor form a run of neighbouring
starts, and only anchors are indexed, about one in 185 bytes. A window lies on an anchor with at
least 184 bytes on one side of it, so two equal windows agree on that side: the index orders anchors by
the fingerprint of `the anchor and 184 bytes to its left` and of `the anchor and 184 bytes to its right`.

Batches of documents are added one after another. A batch's suffix array, sorted by these keys and cut
into segments by them, is merge-scanned against every level there is: equal neighbours are long matches.
Then it becomes a level itself, and while two levels have the same rank they merge into one of the next.
A level keeps one entry per key and run content, whatever the number of copies.

A match of equal runs settles all their windows at once. Where runs agree on a side but not whole, at the
ends of repeats, the bytes of that side's windows go to one place per key and are compared window by
window. A key with more than MOST different runs, such as a passage in a third of all texts, keeps MOST of
them in a level, and all its windows are dealt out by their own fingerprints instead, so none is lost and
no key is ever gathered. Tasks merge what they hold before it is shuffled, so a key has at most MOST
entries, and a window one, from each task's chunk. Windows are equal if 96 bits of two fingerprints are.

Defined results: null text: no bytes. Texts shorter than LENGTH: nothing removed. Repeated rows are
copies of each other and go whole if they are long enough. Rows with one id are judged each by its own
text. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countermill.llm.common import bounded_batches, joined, mixed, stored, text_bytes

LENGTH = 400
GRAM = 32
GRAMS = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
MOST = 256
NO_ID = -(1 << 63)
PIECE = 1 << 20
#: One random 64-bit number per byte value, and two odd bases for rolling sums.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
DUP, PART, HOT, RIGHT = 1, 2, 4, 128


class Rolling:
    """Fingerprints of any substring of a piece of text in constant time each."""

    powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
    inverse: list[np.ndarray] = [np.ones(1, np.uint64)] * 2

    def __init__(self, data: np.ndarray):
        n = len(data)
        codes = BYTES[data]
        self.sums = []
        for k, base in enumerate(BASES):
            if len(Rolling.powers[k]) <= n:
                for held, step in ((Rolling.powers, base), (Rolling.inverse, pow(base, -1, 1 << 64))):
                    steps = np.full(n + 1, step, np.uint64)
                    steps[0] = 1
                    held[k] = np.cumprod(steps)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * Rolling.powers[k][:n], out=total[1:])
            self.sums.append(total)

    def of(self, start, size, base: int = 0) -> np.ndarray:
        total = self.sums[base]
        return mixed((total[start + size] - total[start]) * Rolling.inverse[base][start])

    def all(self, size: int, first: int = 0, last: int | None = None, base: int = 0) -> np.ndarray:
        """Fingerprints of the strings of this size that start at first to last."""
        total = self.sums[base]
        last = len(total) - size if last is None else last
        return mixed((total[first + size : last + size] - total[first:last]) * Rolling.inverse[base][first:last])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window: running minima from both ends of blocks as wide as the window."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Runs:
    """The runs of a piece of text: first and last start, anchor, content and side fingerprints."""

    def __init__(self, data: np.ndarray):
        self.roll = Rolling(data)
        grams = self.roll.all(GRAM)
        place = np.arange(len(grams), dtype=np.uint64)
        least = window_minima((grams & np.uint64(0xFFFFFFFF00000000)) | place, GRAMS)
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        self.first = np.concatenate([[0], change])
        self.last = np.concatenate([change - 1, [len(anchor) - 1]])
        self.anchor = anchor[self.first]
        size = (self.last - self.first + LENGTH).astype(np.uint64)
        self.content = joined(self.roll.of(self.first, size.astype(np.int64)), size, (self.anchor - self.first).astype(np.uint64))

    def sides(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of the left and of the right side, with the runs that have windows there."""
        left = np.flatnonzero(self.first <= self.anchor - SIDE)
        yield self.roll.of(self.anchor[left] - SIDE, SIDE + GRAM) ^ np.uint64(1), left
        right = np.flatnonzero(self.last > self.anchor - SIDE)
        yield self.roll.of(self.anchor[right], GRAM + SIDE), right


def pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text in which every window lies whole in exactly one."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        part = data[start : start + PIECE + LENGTH - 1]
        if len(part) >= LENGTH:
            yield start, part


ENTRY = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("flag", "u1")])
#: Stands for a segment in rows of what a task has found in its own chunk.
FOUND = -1
PACKED = "batch int, segment int, entries binary"
STEP = "kind string, segment int, entries binary"


def document_entries(doc: int, text: bytes) -> np.ndarray:
    """Entries of a document; a run content that occurs in it again has two."""
    found = []
    for _, part in pieces(text):
        runs = Runs(part)
        for side, (key, which) in enumerate(runs.sides()):
            own = np.zeros(len(which), ENTRY)
            own["key"], own["content"], own["doc"], own["flag"] = key, runs.content[which], doc, side * RIGHT
            found.append(own)
    if not found:
        return np.zeros(0, ENTRY)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows["content"], rows["key"]))]
    same = np.concatenate([[False], (rows["key"][1:] == rows["key"][:-1]) & (rows["content"][1:] == rows["content"][:-1])])
    return rows[~(same & np.concatenate([[False], same[:-1]]))]


def packed_entries(documents: DataFrame, batches: int, segments: int, flush: int = 300_000) -> DataFrame:
    """Entries of all documents, packed by batch and by segment of the key."""
    shift = np.uint64(64 - (segments.bit_length() - 1))

    def emit(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for batch, parts in held.items():
            rows = np.concatenate(parts)
            found, rows = merge_scan(rows, np.zeros(len(rows), bool), np.ones(len(rows), bool))
            cuts = np.searchsorted(rows["key"] >> shift, np.arange(segments + 1, dtype=np.uint64))
            own = [(s, rows[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            own.append((FOUND, found.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch] * len(own), pa.int32()), pa.array([s for s, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())],
                ["batch", "segment", "entries"],
            )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for part in rows:
            for doc, batch, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                own = document_entries(doc, text)
                if len(own):
                    held.setdefault(batch, []).append(own)
                    size += len(own)
                if size >= flush:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    batch = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(batches)).cast("int")
    return documents.select(doc_key(), batch.alias("batch"), text_bytes().alias("text")).mapInArrow(run, PACKED)


def doc_key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")


def merge_scan(rows: np.ndarray, old: np.ndarray, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a new batch and of levels (old), scanned in one order. Returns what was found, as entries
    with the flags that are news to them, and a level of the merged entries: one per key and content, at
    most MOST per key.

    DUP: the run repeats whole. PART: its key has other runs too, so its windows are to be compared; that
    is said once per content. HOT: the key has more than MOST runs."""
    order = np.lexsort((rows["doc"], ~old, rows["content"], rows["key"]))
    rows, merged = rows[order], merged[order]
    if not len(rows):
        return rows, rows
    new_key = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])
    new_class = new_key | np.concatenate([[True], rows["content"][1:] != rows["content"][:-1]])
    heads = np.flatnonzero(new_class)
    size = np.diff(np.append(heads, len(rows)))
    flags = np.bitwise_or.reduceat(rows["flag"], heads)
    keys = np.cumsum(new_key)[heads] - 1
    runs = np.bincount(keys)[keys]
    dup = np.where((size > 1) | (flags & DUP > 0), DUP, 0).astype(np.uint8)
    hot = np.bincount(keys, (flags & HOT) > 0)[keys] > 0
    part = np.where(runs > 1, PART, 0) | np.where((runs > MOST) | hot, PART | HOT, 0) | (flags & RIGHT)
    out = rows.copy()
    out["flag"] |= np.repeat(dup, size)
    out["flag"][heads] |= part.astype(np.uint8) | flags
    level = np.flatnonzero(merged)
    first = np.unique((np.cumsum(new_class) - 1)[level], return_index=True)
    kept = rows[level[first[1]]]
    kept["flag"] = (dup | part.astype(np.uint8) | flags)[first[0]]
    own_keys = keys[first[0]]
    rank = np.arange(len(kept)) - np.searchsorted(own_keys, own_keys)
    news = out["flag"] & ~rows["flag"]
    found = out[news > 0]
    found["flag"] = news[news > 0] | (found["flag"] & RIGHT)
    return found, kept[rank < MOST]


class Levels:
    """The family: ranked levels of sorted entries by segment, in the shared folder."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Scans a batch against all levels, then merges levels of equal rank."""
        rank, merged = 0, 0
        for held, _ in reversed(self.levels):
            if held != rank:
                break
            rank, merged = rank + 1, merged + 1
        rows = batch.select(F.lit(-1).alias("place"), "segment", "entries")
        for place, (_, level) in enumerate(self.levels):
            rows = rows.union(level.select(F.lit(place).alias("place"), "segment", "entries"))
        first_merged = len(self.levels) - merged

        def scan(table: pa.Table) -> pa.Table:
            parts = [np.frombuffer(data, ENTRY) for data in table["entries"].to_pylist()]
            places = np.repeat(table["place"].to_numpy(), [len(p) for p in parts])
            found, level = merge_scan(np.concatenate(parts), places >= 0, (places < 0) | (places >= first_merged))
            segment = table["segment"][0].as_py()
            return pa.table(
                [pa.array(["level", "found"]), pa.array([segment] * 2, pa.int32()), pa.array([level.tobytes(), found.tobytes()], pa.binary())],
                names=["kind", "segment", "entries"],
            )

        out = stored(rows.groupBy("segment").applyInArrow(scan, STEP))
        self.levels = [*self.levels[:first_merged], (rank, out.where("kind = 'level'"))]
        self.found.append(out.where("kind = 'found'"))


def matches(documents: DataFrame, batches: int, segments: int) -> DataFrame:
    """doc, content, flag of every run that repeats whole (DUP) or has windows to compare: PART and HOT of the
    left side, and two bits higher of the right."""
    family = Levels()
    packed = stored(packed_entries(documents, batches, segments))
    for batch in range(batches):
        family.add(packed.where((F.col("batch") == batch) & (F.col("segment") != FOUND)))

    def unpack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for data in part.column(0).to_pylist():
                own = np.frombuffer(data, ENTRY)
                flag = own["flag"].astype(np.int32)
                flag = ((flag & DUP) | ((flag & (PART | HOT)) << np.where(flag & RIGHT, 2, 0))).astype(np.int32)
                columns = [own["doc"], own["content"].astype(np.int64), flag]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "content", "flag"])

    found = packed.where(F.col("segment") == FOUND).select("entries")
    for more in family.found:
        found = found.union(more.select("entries"))
    return found.mapInArrow(unpack, "doc long, content long, flag int")


def spans_of(starts: np.ndarray, n: int) -> np.ndarray:
    """Maximal runs of bytes covered by the windows at these starts, as (first, end) pairs."""
    starts = np.unique(starts)
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH) + 1
    return np.stack([starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + LENGTH], 1)


def digest(text: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    """Bytes removed, spans, SHA-256 of the rest."""
    code, at = hashlib.sha256(), 0
    for first, end in spans.tolist():
        code.update(memoryview(text)[at:first])
        at = end
    code.update(memoryview(text)[at:])
    return int((spans[:, 1] - spans[:, 0]).sum()), len(spans), code.hexdigest()


SPAN = np.dtype([("key", "<u8"), ("start", "<u4"), ("n", "<u4"), ("hot", "u1")])


def settled(text: bytes, flags: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows known to repeat, and spans of windows to compare. Windows with at least SIDE bytes
    before the anchor belong to the left key, the others to the right one."""
    sure, compare = [], []
    for offset, part in pieces(text):
        runs, seen = Runs(part), set()
        known = np.array([flags.get(c, 0) for c in runs.content.astype(np.int64).tolist()], np.int32)
        for r in np.flatnonzero(known & DUP).tolist():
            sure.append(np.arange(runs.first[r], runs.last[r] + 1) + offset)
        for side, (keys, which) in enumerate(runs.sides()):
            bits = known[which] >> 2 * side
            for i in np.flatnonzero(bits & PART).tolist():
                r = which[i]
                if (side, int(runs.content[r])) in seen:
                    continue
                seen.add((side, int(runs.content[r])))
                border = int(runs.anchor[r]) - SIDE
                first, last = (int(runs.first[r]), min(border, int(runs.last[r]))) if side == 0 else (max(border + 1, int(runs.first[r])), int(runs.last[r]))
                compare.append((keys[i], first + offset, last - first + 1, bits[i] & HOT > 0))
    return np.concatenate(sure) if sure else np.zeros(0, np.int64), np.array(compare, SPAN)


FIRST = (
    "doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
    " text binary, sure binary, spans binary"
)


def first_pass(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Finished rows, and open ones with their text, sure starts and spans to compare."""
    per_doc = found.groupBy(F.col("doc").alias("key")).agg(
        F.collect_list("content").alias("contents"), F.collect_list("flag").alias("flags")
    )
    rows = documents.select("doc_id", doc_key(), F.xxhash64("doc_id", "text").alias("row"), text_bytes().alias("text"))
    both = rows.join(per_doc, F.col("doc") == F.col("key"), "left").select("doc_id", "row", "text", "contents", "flags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIRST.split(", ")]
        kinds = [*[pa.int64()] * 5, pa.string(), *[pa.binary()] * 3]
        for batch in batches:
            out = []
            for doc_id, row, text, contents, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known: dict[int, int] = {}
                for content, flag in zip(contents or (), flags or (), strict=True):
                    known[content] = known.get(content, 0) | flag
                sure, compare = settled(text, known) if known else (np.zeros(0, np.int64), ())
                if len(compare):
                    out.append((doc_id, row, len(text), None, None, None, text, sure.astype("<u4").tobytes(), compare.tobytes()))
                else:
                    out.append((doc_id, row, len(text), *digest(text, spans_of(sure, len(text))), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return stored(both.mapInArrow(run, FIRST))


def fingerprints(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the windows at these starts."""
    roll = Rolling(data)
    return roll.of(starts, LENGTH), (roll.of(starts, LENGTH, 1) >> np.uint64(32)).astype(np.uint32)


def grouped_starts(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """(row, its starts in bytes)."""
    order = np.argsort(rows, kind="stable")
    rows, starts = rows[order], starts[order]
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    parts = [x.astype("<u4").tobytes() for x in np.split(starts, heads[1:])] if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array(rows[heads], pa.int64()), pa.array(parts, pa.binary())], ["row", "starts"])


DEALT = np.dtype([("row", "<i8"), ("start", "<u4"), ("n", "<u4")])


def compared(unsure: DataFrame, segments: int, flush: int = 4 << 20) -> DataFrame:
    """(row, starts) of windows under a key of few runs: their bytes meet in the key's segment."""
    shift = np.uint64(64 - (segments.bit_length() - 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def close() -> pa.RecordBatch:
            rows = [(s, np.array(a, DEALT).tobytes(), b"".join(b)) for s, (a, b) in held.items()]
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            columns = zip(zip(*rows, strict=True), kinds, strict=True) if rows else [([], k) for k in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["segment", "spans", "data"])

        for batch in batches:
            for row, text, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = np.frombuffer(data, SPAN)
                spans = spans[spans["hot"] == 0]
                for segment, start, n in zip((spans["key"] >> shift).tolist(), spans["start"].tolist(), spans["n"].tolist(), strict=True):
                    own = held.setdefault(segment, ([], []))
                    own[0].append((row, start, n))
                    own[1].append(text[start : start + n + LENGTH - 1])
                    size += n + LENGTH - 1
                if size >= flush:
                    yield close()
                    held, size = {}, 0
        yield close()

    def judge(table: pa.Table) -> pa.Table:
        spans = np.concatenate([np.frombuffer(x, DEALT) for x in table["spans"].to_pylist()])
        data = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8)
        n = spans["n"].astype(np.int64)
        lengths = n + LENGTH - 1
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = fingerprints(data, within + np.repeat(np.cumsum(lengths) - lengths, n))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        again = np.zeros(len(a), bool)
        again[1:] |= same
        again[:-1] |= same
        hits = order[again]
        rows, starts = np.repeat(spans["row"], n)[hits], (np.repeat(spans["start"], n) + within)[hits]
        return pa.Table.from_batches([grouped_starts(rows, starts)])

    return (
        unsure.select("row", "text", "spans")
        .mapInArrow(deal, "segment int, spans binary, data binary")
        .groupBy("segment")
        .applyInArrow(judge, "row long, starts binary")
    )


HELD = np.dtype([("a", "<u8"), ("b", "<u4"), ("row", "<i8"), ("start", "<u4")])
CODE = np.dtype([("a", "<u8"), ("b", "<u4"), ("many", "u1")])


def compared_hot(unsure: DataFrame, segments: int, flush: int = 500_000) -> DataFrame:
    """(row, starts) of windows under a key of many runs. Each task's chunk keeps its windows and deals their
    distinct fingerprints out; one bit per fingerprint comes back to the chunk."""
    shift = np.uint64(64 - (segments.bit_length() - 1))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["b"], rows["a"]))]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([rows.tobytes()], pa.binary())], ["chunk", "rows"])

        for batch in batches:
            for row, text, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = np.frombuffer(data, SPAN)
                for start, n in spans[["start", "n"]][spans["hot"] > 0].tolist():
                    rows = np.zeros(n, HELD)
                    rows["row"], rows["start"] = row, np.arange(start, start + n)
                    rows["a"], rows["b"] = fingerprints(np.frombuffer(text[start : start + n + LENGTH - 1], np.uint8), np.arange(n))
                    held.append(rows)
                    size += n
                if size >= flush:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    def heads_of(rows: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.frombuffer(data, HELD)
                heads = heads_of(rows)
                own = np.empty(len(heads), CODE)
                own["a"], own["b"] = rows["a"][heads], rows["b"][heads]
                own["many"] = np.diff(np.append(heads, len(rows))) > 1
                cuts = np.searchsorted(own["a"] >> shift, np.arange(segments + 1, dtype=np.uint64))
                parts = [(s, own[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                columns = [pa.array([s for s, _ in parts], pa.int32()), pa.array([chunk] * len(parts)), pa.array([x for _, x in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "chunk", "codes"])

    def judge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, CODE) for x in table["codes"].to_pylist()]
        rows = np.concatenate(parts)
        order = np.lexsort((rows["b"], rows["a"]))
        heads = heads_of(rows[order])
        size = np.diff(np.append(heads, len(rows)))
        again = np.empty(len(rows), bool)
        again[order] = np.repeat((size > 1) | (np.add.reduceat(rows["many"][order].astype(np.int64), heads) > 0), size)
        ends = np.cumsum([len(p) for p in parts])
        bits = [again[e - len(p) : e].tobytes() for e, p in zip(ends, parts, strict=True)]
        return pa.table([table["chunk"], table["segment"], pa.array(bits, pa.binary())], names=["chunk", "segment", "bits"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.frombuffer(data, HELD)
                bits = np.frombuffer(b"".join(p["bits"] for p in sorted(parts, key=lambda p: p["segment"])), bool)
                rows = rows[np.repeat(bits, np.diff(np.append(heads_of(rows), len(rows))))]
                yield grouped_starts(rows["row"], rows["start"])

    held = stored(unsure.select("row", "text", "spans").mapInArrow(chunks, "chunk long, rows binary"))
    bits = (
        held.mapInArrow(deal, "segment int, chunk long, codes binary")
        .groupBy("segment")
        .applyInArrow(judge, "chunk long, segment int, bits binary")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("segment", "bits")).alias("parts"))
    )
    return held.join(bits, "chunk").select("rows", "parts").mapInArrow(answer, "row long, starts binary")


def removed_repeats(documents: DataFrame, batches: int = 4, segment_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. segment_bytes: text per segment of the index."""
    bounded_batches(documents.sparkSession)
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = 1 << max(3, (int(size) // segment_bytes).bit_length())
    first = first_pass(documents, matches(documents, batches, segments))
    unsure = first.where("spans is not null")
    starts = compared(unsure, segments).union(compared_hot(unsure, segments))
    again = starts.groupBy("row").agg(F.collect_list("starts").alias("again"))
    both = unsure.select("doc_id", "row", "n_bytes", "text", "sure").join(again, "row", "left").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, text, sure, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = np.frombuffer(sure + b"".join(more or ()), "<u4").astype(np.int64)
                out.append((doc_id, n, *digest(text, spans_of(starts, n))))
            kinds = [*[pa.int64()] * 4, pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rest = first.where("spans is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return rest.union(both.mapInArrow(run, schema))
