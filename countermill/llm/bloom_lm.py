"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and of pairs of neighbouring words, over all training texts, are quantised to levels
and held in a Bloom filter: an n-gram of level q is inserted q times, as (n-gram, 1) to (n-gram, q), and
its level is found again by probing 1, 2, ... until a probe misses. The filter is cut into segments by
hash, each of a fixed number of bits. Bits in all: 8 per training byte of text, up to `most_bits` (32 MB by
default). Where a segment has no room for all its n-grams, those of the lowest counts stay out of the
filter and keep their levels in a table beside it. An n-gram whose level in the filter is below all that the
segment took in is looked up in that table, so every n-gram has its level at every size.

Scoring sends n-grams to segments, at every size of the input alike: a stretch of texts sends its distinct
n-grams, with their counts in its training texts, to the tasks of their segments. Such a task adds up the
counts, fills its segments, probes them for every n-gram it was sent and sends levels, and the exact counts
of words, back to the stretches. No filter or table of words is gathered or broadcast. Keys travel in order,
as the byte planes of their differences, compressed. `train` fills the same segments and gives the filter whole.

Score: log10 of p(word | word before), where p(w | v) = (c(v, w) + m p(w)) / (c(v) + m) with Dirichlet
weight m and p(w) = (c(w) + 1) / (sum of c + distinct words + 1), all c from the filter. A text starts
after an end and ends with one.

base_score uses exact counts.

Defined results: null and empty texts have one token, the end. Null ids count as the empty text in the
crc32. Repeated rows count and are scored each. Without training texts N and V are 0 and every token is
unknown. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countermill.llm.common import (
    MIX,
    WordHashes,
    all_unpacked,
    bounded_batches,
    crc_of_id,
    in_stretches,
    joined,
    mixed,
    packed,
    stored,
    text_bytes,
    unmixed,
    unpacked,
)

PROBES = 4
END = np.uint64(0xE0D)
COUNTS = "segment int, keys1 binary, counts1 binary, keys2 binary, counts2 binary"
SEGMENTS = (
    "segment int, bits binary, low1 long, low2 long, n long, v long, mass double, keys binary, counts binary, "
    "left1 binary, levels1 binary, left2 binary, levels2 binary"
)
#: Segments that one task fills and probes at most.
TOGETHER = 8
#: The level of an n-gram that is to be looked up among those left out.
OPEN = np.uint16(0xFFFF)
ASKED = (
    "place long, stretch long, texts binary, words binary, tokens binary, "
    "keys1 binary, counts1 binary, keys2 binary, counts2 binary"
)
ANSWERED = (
    "stretch long, part int, texts binary, words binary, tokens binary, "
    "levels1 binary, known1 binary, levels2 binary, n long, v long, mass double"
)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def names_of(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def levels(base: float, top: float = 1e15) -> np.ndarray:
    """Smallest count of each level: every small number has its own, larger ones grow by the base."""
    out = [1.0]
    while out[-1] < top:
        out.append(max(out[-1] + 1, np.ceil(out[-1] * base)))
    return np.array(out)


LEVELS = (levels(1.1), levels(1.3))


def level_of(counts: np.ndarray, order: int) -> np.ndarray:
    return np.searchsorted(LEVELS[order], counts, side="right")


def value_of(level: np.ndarray, order: int) -> np.ndarray:
    """The count a level stands for: the geometric middle of its range, 0 for level 0."""
    edges = LEVELS[order]
    middle = np.sqrt(edges[:-1] * (edges[1:] - 1))
    return np.where(level > 0, middle[np.maximum(level, 1) - 1], 0.0)


def key_of(codes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    return mixed(codes + MIX[1]) if before is None else joined(before, codes)


def code_of(keys: np.ndarray) -> np.ndarray:
    """The codes of words from their keys."""
    return unmixed(keys) - MIX[1]


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (segments.bit_length() - 1))).astype(np.int64) if segments > 1 else np.zeros(len(keys), np.int64)


def hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of (key, level)."""
    one = mixed(keys + np.asarray(level, np.uint64) * MIX[0])
    return one, (one >> np.uint64(32)) | np.uint64(1)


def place(one: np.ndarray, two: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Bit numbers of a probe within a segment of a power of two bits."""
    return ((one + np.uint64(probe) * two) & np.uint64(bits - 1)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def token_codes(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens of several texts, the code before each, and tokens per text."""
    lists = [text.lower().split() for text in texts]
    sizes = np.array([len(x) + 1 for x in lists], np.int64)
    codes = np.full(int(sizes.sum()), END, np.uint64)
    ends = np.cumsum(sizes)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = False
    codes[inner] = hashes.of([w for x in lists for w in x])
    return codes, np.concatenate([[END], codes[:-1]]).astype(np.uint64), sizes


def partial_counts(documents: DataFrame, segments: int, flush: int = 1_500_000) -> DataFrame:
    """Counts of words and pairs as each task sees them, in packed arrays per segment."""

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        codes, before = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        counted = []
        for keys in (key_of(codes), key_of(codes, before)):
            keys, counts = np.unique(keys, return_counts=True)
            cuts = np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))
            counted.append((keys, counts.astype(np.uint32), cuts))
        columns = [pa.array(np.arange(segments, dtype=np.int32))]
        for keys, counts, cuts in counted:
            for values in (keys, counts):
                parts = [packed(values[a:b], values is keys) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns.append(pa.array(parts, pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names_of(COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                held.append(token_codes(batch.column(0).slice(at, 200).to_pylist(), hashes))
                size += len(held[-1][0])
                if size >= flush:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return documents.select(text_bytes().alias("text")).mapInArrow(run, COUNTS)


def lowest(counts: np.ndarray, order: int, room: int) -> tuple[int, int]:
    """The lowest count whose n-grams and all commoner ones fit, and the insertions they need."""
    kinds, n = np.unique(counts, return_counts=True)
    need = np.cumsum((n * level_of(kinds, order))[::-1])[::-1]
    fits = np.flatnonzero(need <= room)
    return (int(kinds[fits[0]]), int(need[fits[0]])) if len(fits) else (1 << 62, 0)


def filled(counted: list[tuple[np.ndarray, np.ndarray]], segment_bits: int) -> tuple[np.ndarray, list[int]]:
    """The bits of a segment from keys and counts of its words and of its pairs, and per order the lowest count
    that it took in. N-grams of lower counts are left out."""
    room = int(segment_bits * np.log(2) / PROBES)
    bits = np.zeros(segment_bits, bool)
    low1, used = lowest(counted[0][1], 0, room // 2)
    low2, _ = lowest(counted[1][1], 1, room - used)
    for order, (keys, n), low in ((0, counted[0], low1), (1, counted[1], low2)):
        keys, level = keys[n >= low], level_of(n[n >= low], order)
        j = 0
        while len(keys):
            j += 1
            hashes = hashed(keys, j)
            for probe in range(PROBES):
                bits[place(*hashes, probe, segment_bits)] = True
            keys, level = keys[level > j], level[level > j]
    return np.packbits(bits, bitorder="little"), [low1, low2]


def mass_of(counts: np.ndarray) -> float:
    """The sum of the counts of words as their levels give them."""
    return float(value_of(level_of(counts, 0), 0).sum())


def filled_segments(counts: DataFrame, segment_bits: int) -> DataFrame:
    """One row per segment: its bits, the lowest counts in it where some n-grams are left out (else 0), the
    exact counts of its words, and the n-grams left out with their levels."""

    def fill(table: pa.Table) -> pa.Table:
        joined_up = []
        for order in ("1", "2"):
            keys = all_unpacked(table[f"keys{order}"], np.uint64, True)
            joined_up.append(summed(keys, all_unpacked(table[f"counts{order}"], np.uint32).astype(np.int64)))
        bits, lows = filled(joined_up, segment_bits)
        left = []
        for order, ((keys, n), low) in enumerate(zip(joined_up, lows, strict=True)):
            left += [packed(keys[n < low], True), packed(level_of(n[n < low], order).astype(np.uint16))]
        words, n1 = joined_up[0]
        row = [
            table["segment"][0].as_py(), bits.tobytes(),
            lows[0] if left[0] else 0, lows[1] if left[2] else 0, int(n1.sum()), len(words), mass_of(n1), packed(words, True), packed(n1), *left,
        ]
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 6]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names_of(SEGMENTS))

    return counts.groupBy("segment").applyInArrow(fill, SEGMENTS)


def ngrams(codes: np.ndarray, before: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of the distinct words, tokens and those before them, and of the distinct pairs, and their places."""
    words, at_word = np.unique(np.concatenate([codes, before]), return_inverse=True)
    return [(key_of(words), at_word), np.unique(key_of(codes, before), return_inverse=True)]


class Model:
    """The filter and the numbers that go with it. `lows` has, per order and segment, the lowest count that
    the segment took in where it left some n-grams out, else 0."""

    def __init__(self, bits: np.ndarray, segment_bits: int, n: int, v: int, mass: float, weight: float, lows: np.ndarray):
        self.bits, self.segment_bits, self.n, self.v, self.mass, self.weight = bits, segment_bits, n, v, mass, weight
        self.segments = len(bits) * 8 // segment_bits
        self.floors = [level_of(lows[order], order) for order in (0, 1)]

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Levels by repeated membership probes, level after level until one misses."""
        level = np.zeros(len(keys), np.int64)
        alive, start = np.arange(len(keys)), segment_of(keys, self.segments) * self.segment_bits
        for j in range(1, len(LEVELS[order])):
            one, two, begin = *hashed(keys[alive], j), start[alive]
            for probe in range(PROBES):
                at = place(one, two, probe, self.segment_bits) + begin
                hit = self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0
                alive, one, two, begin = alive[hit], one[hit], two[hit], begin[hit]
            level[alive] = j
            if not len(alive):
                break
        return level

    def settled(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Levels, and OPEN for an n-gram that can only be among those left out."""
        level = self.levels(keys, order).astype(np.uint16)
        level[level < self.floors[order][segment_of(keys, self.segments)]] = OPEN
        return level

    def count(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Counts as far as the filter has them."""
        return value_of(self.levels(keys, order), order)

    def log10(self, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 p(code | code before) of each token, with counts as far as the filter has them."""
        (words, at_word), (pairs, at_pair) = ngrams(codes, before)
        single = self.count(words, 0)
        own, context = single[at_word[: len(codes)]], single[at_word[len(codes) :]]
        return log10_of(own, context, self.count(pairs, 1)[at_pair], self.v, self.mass, self.weight)


def log10_of(own: np.ndarray, context: np.ndarray, both: np.ndarray, v: int, mass: float, weight: float) -> np.ndarray:
    """log10 p(word | word before) from the counts of the word, of the one before and of both."""
    p = (own + 1) / (mass + v + 1)
    return np.log10((np.minimum(both, np.minimum(own, context)) + weight * p) / (context + weight))


def layout(documents: DataFrame, most_bits: int) -> tuple[int, int]:
    """Segments of the filter for these training texts, and bits of each."""
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = 1 << min(20, max(4, (int(size) // (1 << 21)).bit_length()))
    bits = max(segments << 10, min(most_bits, 1 << (8 * int(size)).bit_length()))
    return segments, bits // segments


def train(
    documents: DataFrame, most_bits: int = 1 << 28, weight: float = 100.0
) -> tuple[DataFrame, Model]:
    """The stored segments with exact word counts, and the model."""
    segments, segment_bits = layout(documents, most_bits)
    rows = stored(filled_segments(partial_counts(documents, segments), segment_bits), drop_shuffles=True)
    found = np.zeros(segments * segment_bits // 8, np.uint8)
    for segment, part in rows.select("segment", "bits").toPandas().itertuples(index=False):
        found[segment * segment_bits // 8 : (segment + 1) * segment_bits // 8] = np.frombuffer(part, np.uint8)
    lows = np.zeros((2, segments), np.int64)
    for segment, low1, low2 in rows.select("segment", "low1", "low2").toPandas().itertuples(index=False):
        lows[:, segment] = low1, low2
    n, v, mass = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "mass"))).first()
    return rows, Model(found, segment_bits, int(n), int(v), float(mass), weight, lows)


def scored(
    documents: DataFrame, most_words: int | None = None, most_bits: int = 1 << 28, weight: float = 100.0, flush: int = 1_500_000
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. `flush`: tokens of a stretch.
    `most_words`, the words that were broadcast at most, has no effect any more: none are."""
    bounded_batches(documents.sparkSession)
    held_out = crc_of_id() % 7 == 2
    segments, segment_bits = layout(documents.where(~held_out), most_bits)
    rows = documents.select("doc_id", held_out.alias("held_out"), text_bytes().alias("text"))
    asked = asked_ngrams(rows, segments, flush)
    back = stored(answered_ngrams(asked, segments, segment_bits, weight), drop_shuffles=True)
    n, v, mass = back.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "mass"))).first()
    scores = stored(finished(back.where("stretch >= 0"), int(n), int(v), float(mass), weight), drop_shuffles=True)
    return scores.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score"
    )


def together_of(segments: int) -> int:
    """Segments to a task: fewer of a small filter, so that it is dealt out widely too."""
    return min(TOGETHER, max(1, segments // 64))


def asked_ngrams(rows: DataFrame, segments: int, flush: int) -> DataFrame:
    """Per stretch of texts its tokens, as places among its words, under a place of their own below 0, and for each
    task that holds segments its distinct n-grams there, with their counts in training texts."""
    together = together_of(segments)
    places = segments // together
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]

    def emit(held: list, n: int) -> pa.RecordBatch:
        stretch = (TaskContext.get().partitionId() << 32) + n
        codes, before, sizes = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        texts = pa.Table.from_batches([h[0] for h in held]).append_column("n_tokens", pa.array(sizes)).combine_chunks()
        learnt = np.repeat(~texts["held_out"].to_numpy(), sizes)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(texts)
        words, at_word = np.unique(key_of(codes), return_inverse=True)
        pairs, at_pair = np.unique(key_of(codes, before), return_inverse=True)
        counted = []
        for keys, at in ((words, at_word), (pairs, at_pair)):
            counts = np.bincount(at[learnt], minlength=len(keys)).astype(np.uint32)
            counted.append((keys, counts, np.searchsorted(segment_of(keys, segments) // together, np.arange(places + 1))))
        out = [(-1 - stretch, stretch, sink.getvalue().to_pybytes(), packed(words, True), packed(at_word.astype(np.uint32)), *[None] * 4)]
        for task in range(places):
            sent = []
            for keys, counts, cuts in counted:
                own = slice(cuts[task], cuts[task + 1])
                sent += [packed(keys[own], True), packed(counts[own])]
            if sent[0] or sent[2]:
                out.append((task, stretch, None, None, None, *sent))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names_of(ASKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, n = WordHashes(), [], 0, 0
        for part in in_stretches(batches, 2, 1 << 20):
            held.append((part.select([0, 1]), *token_codes(part.column(2).to_pylist(), hashes)))
            size += len(held[-1][1])
            if size >= flush:
                yield emit(held, n)
                held, size, n = [], 0, n + 1
        if held:
            yield emit(held, n)

    return rows.mapInArrow(run, ASKED)


def answered_ngrams(asked: DataFrame, segments: int, segment_bits: int, weight: float) -> DataFrame:
    """Per stretch and task the levels of the n-grams sent and the exact counts of the words among them, per task
    the sums over its words, and the tokens as they came."""
    names, together = names_of(ANSWERED), together_of(segments)
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int64(), pa.int64(), pa.float64()]

    def judged(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
        """Levels of all words and pairs of one segment, of those in no training text too."""
        bits, lows = filled([(k[n > 0], n[n > 0]) for k, n in zip(keys, counts, strict=True)], segment_bits)
        model = Model(bits, segment_bits, 0, 0, 0.0, weight, np.array([[low if (n[n > 0] < low).any() else 0] for low, n in zip(lows, counts, strict=True)]))
        levels = []
        for order in (0, 1):
            level, n = model.settled(keys[order], order), counts[order]
            left = level == OPEN
            level[left] = np.where(n[left] < lows[order], level_of(n[left], order), 0)
            levels.append(level)
        return levels

    def answer(asked: pa.Table) -> pa.Table:
        first = asked["place"][0].as_py()
        if first < 0:
            rows = asked.num_rows
            own = [asked["stretch"], pa.array([-1] * rows, pa.int32()), asked["texts"], asked["words"], asked["tokens"]]
            return pa.table([*own, *(pa.nulls(rows, k) for k in kinds[5:])], names=names)
        keys, counts, backs, cuts = [], [], [], []
        for order in "12":
            sent = [unpacked(data, np.uint64, True) for data in asked[f"keys{order}"].to_pylist()]
            distinct, back = np.unique(np.concatenate(sent), return_inverse=True)
            n = np.bincount(back, all_unpacked(asked[f"counts{order}"], np.uint32), len(distinct)).astype(np.int64)
            keys.append(distinct)
            counts.append(n)
            backs.append(np.split(back, np.cumsum([len(x) for x in sent])[:-1]))
            cuts.append(np.searchsorted(segment_of(distinct, segments) - first * together, np.arange(together + 1)))
        levels = [np.zeros(len(k), np.uint16) for k in keys]
        n = v = mass = 0
        for segment in range(together):
            own = [slice(c[segment], c[segment + 1]) for c in cuts]
            for order, level in enumerate(judged([k[o] for k, o in zip(keys, own, strict=True)], [c[o] for c, o in zip(counts, own, strict=True)])):
                levels[order][own[order]] = level
            learnt = counts[0][own[0]][counts[0][own[0]] > 0]
            n, v, mass = n + int(learnt.sum()), v + len(learnt), mass + mass_of(learnt)
        out = [(-1, first, *[None] * 6, n, v, mass)]
        for stretch, words, pairs in zip(asked["stretch"].to_pylist(), *backs, strict=True):
            answers = (packed(levels[0][words]), packed(counts[0][words]), packed(levels[1][pairs]))
            out.append((stretch, first, None, None, None, *answers, None, None, None))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return asked.groupBy("place").applyInArrow(answer, ANSWERED)


def finished(back: DataFrame, n: int, v: int, mass: float, weight: float) -> DataFrame:
    """Scores of the texts of every stretch. Tasks hold ranges of keys, so answers by task are in order of the keys."""
    bottom = float(np.log10(n + v + 1))

    def finish(rows: pa.Table) -> pa.Table:
        own = pa.compute.less(rows["part"], 0)
        stretch, answers = rows.filter(own), rows.filter(pa.compute.invert(own)).sort_by("part")
        with pa.ipc.open_stream(stretch["texts"][0].as_buffer()) as reader:
            texts = reader.read_all()
        sizes = texts["n_tokens"].to_numpy()
        starts = np.cumsum(sizes) - sizes
        at_word = unpacked(stretch["tokens"][0].as_py(), np.uint32)
        # The last token is an end, and so is what comes before the first.
        at_before = np.append(at_word[-1], at_word[:-1])
        word = code_of(unpacked(stretch["words"][0].as_py(), np.uint64, True))
        at_pair = np.unique(key_of(word[at_word], word[at_before]), return_inverse=True)[1]
        single = value_of(all_unpacked(answers["levels1"], np.uint16).astype(np.int64), 0)
        both = value_of(all_unpacked(answers["levels2"], np.uint16).astype(np.int64), 1)
        exact = all_unpacked(answers["known1"], np.int64)
        score = np.add.reduceat(log10_of(single[at_word], single[at_before], both[at_pair], v, mass, weight), starts)
        known = np.add.reduceat((exact > 0).astype(np.int64)[at_word], starts)
        base = np.add.reduceat(np.log10(exact + 1.0)[at_word], starts) - sizes * bottom
        columns = [texts["doc_id"], texts["held_out"], pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)]
        return pa.table(columns, names=names_of(SCORES))

    return back.groupBy("stretch").applyInArrow(finish, SCORES)
