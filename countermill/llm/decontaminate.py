"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A document is compared with an item through its windows of as many words as the item has, at every
word. A window's fingerprint is the 64-bit SimHash of its 5-word shingles, weighted by how often each
occurs in the window. Items are indexed by four disjoint blocks of 16 fingerprint bits: two fingerprints
within the radius of 19 differ in at most four bits of some block, so looking up all values that near
misses none. Candidates within the radius are then confirmed by the weighted Jaccard similarity of the
shingles themselves. At a similarity of 0.8 two fingerprints differ in 9.7 of 64 bits on average; a test
counts how many pairs just above 0.8 the radius lets through. Exact copies never differ.

Before fingerprints are made, windows are counted: one with fewer shingles that items of its length have
than `threshold` times its shingles cannot reach the threshold with any of them, so most texts need
no fingerprint at all and nothing is lost. The words of many texts are coded and looked up at once.

Items come in blocks of bounded bytes, each broadcast and applied to all documents; a benchmark of any
size is a number of passes, never a larger broadcast.

Words: runs of non-space characters, lower-cased, without signs at either end; words of signs only
do not count. Defined results: null and empty texts match nothing; items without words match nothing;
items of fewer than five words match as one shingle. Repeated rows are judged each; one row per
(doc_id, item_id) and document row. No rows: no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countermill.llm.common import WordCodes, in_stretches, joined, mixed

SHINGLE = 5
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: White space beyond ASCII, and the separators that str.split takes for white space.
SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes of text that are looked at together; a look takes some forty times as many bytes of memory.
LOOK_BYTES = 1 << 20
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_places long"


def plain_words(text: str) -> list[str]:
    return [w for w in (EDGES.sub("", x) for x in text.lower().split()) if w]


_ASCII_WORD = np.array([chr(c).isascii() and chr(c).isalnum() for c in range(128)] + [True] * 128)
#: Second bytes after 0xC3 that are signs: the times and the division sign. All others there are letters.
_C3_SIGNS = (0x97, 0xB7)


class PlainCodes:
    """Codes of the plain words of many texts at once, without a look at single words but those that start
    or end in a sign beyond ASCII or in a letter beyond Latin-1."""

    def __init__(self):
        self.words = WordCodes()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all plain words, and the place of each text's first one."""
        lowered = (SPACES.sub(" ", t) if not t.isascii() or SPACES.search(t) else t for t in map(str.lower, texts))
        text, starts, stops, places = self.words.spans(pa.array([t.encode() for t in lowered], pa.binary()))
        if not len(starts):
            return np.empty(0, np.uint64), places
        solid = _ASCII_WORD[text]
        where = np.arange(len(text))
        following = np.minimum.accumulate(np.where(solid, where, len(text))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(solid, where, -1))
        begin, end = following[starts], before[stops - 1] + 1
        kept = begin < stops
        begin, end = begin[kept], end[kept]
        places = np.concatenate([[0], np.cumsum(kept)])[places]

        head, second = text[begin], text[np.minimum(begin + 1, len(text) - 1)]
        tail, lead = text[end - 1], text[np.maximum(end - 2, 0)]
        plain_head = (head < 0x80) | ((head == 0xC3) & ~np.isin(second, _C3_SIGNS))
        plain_tail = (tail < 0x80) | ((lead == 0xC3) & ~np.isin(tail, _C3_SIGNS))
        codes = self.words.codes(text, begin, end)
        odd = np.flatnonzero(~(plain_head & plain_tail))
        if len(odd):
            spelled = [EDGES.sub("", text[begin[i] : end[i]].tobytes().decode()).encode() for i in odd.tolist()]
            codes[odd] = self.spelled(spelled)
            full = np.ones(len(codes), bool)
            full[odd[[not w for w in spelled]]] = False
            codes, places = codes[full], np.concatenate([[0], np.cumsum(full)])[places]
        return codes, places

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Codes of words given one by one."""
        ends = np.cumsum([0, *map(len, words)])
        return self.words.codes(np.frombuffer(b"".join(words), np.uint8), ends[:-1], ends[1:])


class Codes:
    """A set of 64-bit codes that many codes are looked up in."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.low = np.zeros(1 << 18, bool)
        self.low[(self.codes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code in the set, -1 for one that is not in it."""
        out = np.full(len(codes), -1)
        maybe = np.flatnonzero(self.low[(codes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.codes, codes[maybe]), len(self.codes) - 1)
        found = self.codes[at] == codes[maybe]
        out[maybe[found]] = at[found]
        return out


#: Bits of a block of a fingerprint.
BLOCK_BITS = 16


class Items:
    """A block of benchmark items, indexed for lookup of windows.

    The index holds the fingerprints of all items by each of four blocks of 16 bits. Two fingerprints within
    a radius of 4 r + 3 bits agree on some block but for r bits, so all values that near are looked up.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        self.hasher = PlainCodes()
        known, places = self.hasher.of([text or "" for _, text in items])
        self.vocabulary = Codes(known)
        self.by_words: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        shingles: dict[int, dict[int, list[np.ndarray]]] = defaultdict(lambda: defaultdict(list))
        for (item_id, _), start, stop in zip(items, places[:-1].tolist(), places[1:].tolist(), strict=True):
            if stop > start:
                size = min(SHINGLE, stop - start)
                own = self.windows(known[start:stop], size)
                self.by_words[stop - start].append((item_id, own))
                shingles[size][stop - start].append(own)
        #: Per size all shingles, and per length of item which of them its items have.
        self.shingles: dict[int, tuple[Codes, dict[int, np.ndarray]]] = {}
        for size, by_length in shingles.items():
            every = Codes(np.concatenate([codes for own in by_length.values() for codes in own]))
            has = {n: np.isin(every.codes, np.concatenate(own)) for n, own in by_length.items()}
            self.shingles[size] = every, has

        self.prints = {n: np.array([fingerprint(codes) for _, codes in own], np.uint64) for n, own in self.by_words.items()}
        every = np.concatenate([*self.prints.values(), np.empty(0, np.uint64)])
        self.lengths = np.repeat([*self.prints, 0], [*map(len, self.prints.values()), 0])
        self.numbers = np.concatenate([*(np.arange(len(p)) for p in self.prints.values()), np.empty(0, np.int64)])
        self.every = every
        near = -(-(radius + 1) // 4) - 1
        masks = np.arange(1 << BLOCK_BITS)
        self.near = masks[np.bitwise_count(masks) <= near]
        self.blocks = []
        for start in range(0, 64, BLOCK_BITS):
            value = ((every >> np.uint64(start)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.blocks.append((start, order, np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1))))

    @staticmethod
    def windows(codes: np.ndarray, size: int) -> np.ndarray:
        n = len(codes) - size + 1
        return joined(*(codes[i : i + n] for i in range(size))) if n > 0 else np.empty(0, np.uint64)

    def candidates(self, code: np.uint64) -> np.ndarray:
        """Places of the fingerprints that agree with this one on some block but for a few bits."""
        found = []
        for start, order, heads in self.blocks:
            values = self.near ^ ((int(code) >> start) & ((1 << BLOCK_BITS) - 1))
            begin, end = heads[values], heads[values + 1]
            for b, e in zip(begin[end > begin].tolist(), end[end > begin].tolist(), strict=True):
                found.append(order[b:e])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def within(self, length: int, code: np.uint64) -> list[int]:
        """Places of the items of this length whose fingerprint is within the radius."""
        places = self.candidates(code)
        places = places[self.lengths[places] == length]
        return self.numbers[places[np.bitwise_count(self.every[places] ^ code) <= self.radius]].tolist()

    def find(self, texts: list[str]) -> list[dict[int, tuple[float, int, int]]]:
        """Per text: item_id to (best similarity, its first word, number of places)."""
        out: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        if not self.by_words:
            return out
        codes, places = self.hasher.of(texts)
        known = self.vocabulary.places(codes) >= 0
        text_of = np.repeat(np.arange(len(texts)), np.diff(places))
        for size, (benchmark, lengths) in self.shingles.items():
            n = len(codes) - size + 1
            if n <= 0:
                continue
            usable = text_of[:n] == text_of[size - 1 :]
            for i in range(size):
                usable &= known[i : n + i]
            starts = np.flatnonzero(usable)
            if not len(starts):
                continue
            which = benchmark.places(joined(*(codes[starts + i] for i in range(size))))
            hits, which = starts[which >= 0], which[which >= 0]
            for row in np.unique(text_of[hits]).tolist():
                first, stop = int(places[row]), int(places[row + 1])
                own = slice(*np.searchsorted(hits, [first, stop]))
                self.confirm(codes[first:stop], size, hits[own] - first, which[own], out[row])
        return out

    def confirm(self, codes: np.ndarray, size: int, hits: np.ndarray, which: np.ndarray, found: dict[int, tuple[float, int, int]]) -> None:
        """Adds to `found` the items whose windows these codes hold, given where which shingles occur. A window
        is looked up if enough of its shingles belong to items of its length."""
        shingles = self.windows(codes, size)
        for length, has in self.shingles[size][1].items():
            width = length - size + 1
            if width > len(shingles):
                continue
            marked = np.zeros(len(shingles) + 1, np.int64)
            marked[hits[has[which]] + 1] = 1
            total = np.cumsum(marked)
            count = total[width:] - total[:-width]
            for place in np.flatnonzero(count >= self.threshold * width).tolist():
                window = shingles[place : place + width]
                for near in self.within(length, fingerprint(window)):
                    item_id, wanted = self.by_words[length][near]
                    similarity = bag_similarity(window, wanted)
                    if similarity >= self.threshold:
                        best, first, n = found.get(item_id, (0.0, place, 0))
                        found[item_id] = (similarity, place, n + 1) if similarity > best else (best, first, n + 1)


_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(shingles: np.ndarray) -> np.uint64:
    """64-bit SimHash; a shingle that occurs n times weighs n."""
    ones = ((mixed(shingles)[:, None] >> _BITS) & np.uint64(1)).sum(0)
    return np.bitwise_or.reduce((2 * ones > len(shingles)).astype(np.uint64) << _BITS)


def bag_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles: sum of smaller weights over sum of larger ones."""
    keys, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(place[: len(a)], minlength=len(keys))
    right = np.bincount(place[len(a) :], minlength=len(keys))
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about this many bytes of text; one block is held at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(
    documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 19, block_bytes: int = 4 << 20
) -> DataFrame:
    """One row per document and item found in it."""
    spark = documents.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    for block in item_blocks(benchmark, block_bytes):
        items = spark.sparkContext.broadcast(Items(block, threshold, radius))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in in_stretches(batches, 1, LOOK_BYTES):
                rows = []
                texts = [text or "" for text in batch.column(1).to_pylist()]
                for doc_id, found in zip(batch.column(0).to_pylist(), items.value.find(texts), strict=True):
                    for item_id, (similarity, first, n) in sorted(found.items()):
                        rows.append((doc_id, item_id, similarity, first, n))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                names = [field.split()[0] for field in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        out = out.union(documents.select("doc_id", "text").mapInArrow(run, SCHEMA))
    return out


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 19, block_bytes: int = 4 << 20
) -> DataFrame:
    """The documents, all columns, in which no item is found."""
    spark = documents.sparkSession
    place = documents.columns.index("text")
    for block in item_blocks(benchmark, block_bytes):
        items = spark.sparkContext.broadcast(Items(block, threshold, radius))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in in_stretches(batches, place, LOOK_BYTES):
                clean = [not found for found in items.value.find([text or "" for text in batch.column(place).to_pylist()])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
