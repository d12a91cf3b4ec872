"""Token ids of a corpus in wavelet-matrix files.

Documents are range-partitioned and sorted by doc_id, tokenized in place and written in shards: each
row of the Parquet output is one shard of about `shard_tokens` ids as a wavelet matrix, with its
documents' ids and lengths. Parquet is the container because Spark's writer commits whole files to
any store and a lost executor's half-written file never counts.

A wavelet matrix stores bit b of all ids as plane b, each plane in the order that a stable partition
by the planes above gives. Counts of ones before every 512th bit give rank in constant time; rank
gives access to an id, counting of an id and the places where it occurs, without unpacking the shard.

Tokenizing: the pre-tokenizer of byte-level BPE never joins a word to what stands before its space, so
in texts without adjacent white space every word is encoded alone, once, and looked up after, the words
of many texts at a time. Other texts go to the library whole.

Defined results: null and empty texts hold the end id only. Null doc_ids come first. Repeated rows and
ties are ordered by text. A document is never cut between shards; one longer than a shard has a
shard of its own. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countermill.llm.common import MIX, WordCodes, crc, in_stretches, mixed, text_bytes
from countermill.session import work_folder

BLOCK = 512
FORMAT = "shard long, first_doc long, n_tokens long, bits int, doc_ids binary, doc_nulls binary, lengths binary, zeros binary, planes binary, ranks binary"


class WaveletMatrix:
    """A sequence of ids below 2**bits with access, count and occurrence lookup."""

    def __init__(self, n: int, bits: int, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, blocks = len(ids), len(ids) // BLOCK + 1
        planes = np.zeros((bits, blocks * BLOCK // 8), np.uint8)
        ranks = np.zeros((bits, blocks), np.uint32)
        zeros = np.zeros(bits, np.int64)
        for level in range(bits):
            ones = (ids >> ids.dtype.type(bits - 1 - level)) & ids.dtype.type(1) != 0
            packed = np.packbits(ones, bitorder="little")
            planes[level, : len(packed)] = packed
            sums = np.bitwise_count(planes[level].view(np.uint64)).reshape(blocks, -1).sum(1)
            np.cumsum(sums[:-1], out=ranks[level, 1:])
            low = ids[~ones]
            zeros[level] = len(low)
            ids = np.concatenate([low, ids[ones]])
        return cls(n, bits, zeros, planes, ranks)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back, zeros = np.empty(self.n, kind), int(self.zeros[level])
            back[~ones] = ids[:zeros]
            back[ones] = ids[zeros:] | kind(1 << (self.bits - 1 - level))
            ids = back
        return ids

    def rank(self, level: int, place: int) -> int:
        """Ones of a plane before a place."""
        block, rest = divmod(place, BLOCK)
        count = int(self.ranks[level, block]) if block < self.ranks.shape[1] else int(self.n - self.zeros[level])
        if rest:
            start = block * BLOCK // 8
            piece = self.planes[level, start : start + (rest + 7) // 8].copy()
            if rest % 8:
                piece[-1] &= (1 << rest % 8) - 1
            count += int(np.bitwise_count(piece).sum())
        return count

    def select(self, level: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) bit of this value in a plane."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self.rank(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > nth:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, place: int) -> int:
        value = 0
        for level in range(self.bits):
            ones = self.rank(level, place)
            bit = self.rank(level, place + 1) - ones
            place = int(self.zeros[level]) + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank(level, start), self.rank(level, end)
            if value >> (self.bits - 1 - level) & 1:
                start, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id between two places."""
        if not 0 <= value < 1 << self.bits:
            return 0
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def find(self, value: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of an id, -1 if there are fewer."""
        if not 0 <= value < 1 << self.bits:
            return -1
        a, b = self._range(value, 0, self.n)
        if a + nth >= b or nth < 0:
            return -1
        place = a + nth
        for level in range(self.bits - 1, -1, -1):
            if value >> (self.bits - 1 - level) & 1:
                place = self.select(level, 1, place - int(self.zeros[level]))
            else:
                place = self.select(level, 0, place)
        return place


class UnitIds:
    """Ids of units of text by their 64-bit codes: an open-addressed table of a bounded number of units, so
    that many codes are looked up at once."""

    def __init__(self, kind: str, most: int = 1_500_000):
        self.kind, self.most, self.bits = kind, most, most.bit_length() + 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.places = np.full(1 << self.bits, -1, np.int32)
        self.units = 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.usable = np.zeros(1 << 16, bool)
        self.ids, self.used = np.zeros(1 << 18, self.kind), 0

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code's unit, -1 for one that is not known."""
        out = np.full(len(codes), -1, np.int32)
        slot, left = (codes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(codes))
        while len(left):
            place = self.places[slot]
            hit = (self.keys[slot] == codes) & (place >= 0)
            out[left[hit]] = place[hit]
            on = ~hit & (place >= 0)
            left, codes, slot = left[on], codes[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, codes: np.ndarray, units: list[list[int] | None]) -> None:
        """Different codes that are not known, with their ids; None for a unit that has none of its own."""
        first, count = self.units, len(units)
        while first + count > len(self.starts):
            self.starts, self.lengths, self.usable = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.usable))
        lengths = np.array([len(u or ()) for u in units], np.int64)
        flat = np.array([i for u in units for i in u or ()], self.kind)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.lengths[first : first + count] = lengths
        self.starts[first : first + count] = self.used + np.cumsum(lengths) - lengths
        self.usable[first : first + count] = [u is not None for u in units]
        self.used += len(flat)
        self.units += count
        slot, place = (codes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(first, first + count, dtype=np.int32)
        while len(place):
            free = np.flatnonzero(self.places[slot] < 0)
            taken, one = np.unique(slot[free], return_index=True)
            self.keys[taken], self.places[taken] = codes[free[one]], place[free[one]]
            rest = np.ones(len(place), bool)
            rest[free[one]] = False
            codes, place, slot = codes[rest], place[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)


SPACE, NEWLINE = 0x20, 0x0A
#: What stands before a unit: the start of the text, a space, or a new line.
AT_START, AFTER_SPACE, AFTER_NEWLINE = range(3)


class Encoder:
    """Texts to ids, as the library gives them for the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.kind = "<u2" if top < 1 << 16 else "<u4"
        self.bits = max(1, int(top).bit_length())
        self.words, self.known = WordCodes(lower=False), UnitIds(self.kind)
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, text: str) -> bytes:
        return self.all([text.encode()])[0].tobytes()

    def learn(self, codes: np.ndarray, units: list[tuple[int, str]]) -> None:
        """Encodes new units (what stands before, word), all in one call."""
        apart = [not (w[:1].isspace() or w[-1:].isspace()) for _, w in units]
        spelled = [" " + w if before == AFTER_SPACE else w for before, w in units]
        ids: list[list[int] | None] = []
        for at in range(0, len(units), 20_000):
            part = self.tokenizer.encode_batch_fast(spelled[at : at + 20_000], add_special_tokens=False)
            for code, (before, _), good in zip(part, units[at : at + 20_000], apart[at : at + 20_000], strict=True):
                ids.append((self.newline + code.ids if before == AFTER_NEWLINE else code.ids) if good else None)
        self.known.add(codes, ids)

    def all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of many texts. Units of all texts in which no white space meets white space are coded and looked
        up at once; the other texts go to the library one by one."""
        plain = [i for i, t in enumerate(texts) if not white_space_meets(t)]
        out: list[np.ndarray | None] = [None] * len(texts)
        data = np.frombuffer(b"".join([texts[i] for i in plain]), np.uint8)
        ends = np.cumsum([0, *(len(texts[i]) for i in plain)])
        cuts = np.flatnonzero((data == SPACE) | (data == NEWLINE))
        starts, stops = np.sort(np.concatenate([ends[:-1], cuts + 1])), np.sort(np.concatenate([cuts, ends[1:]]))
        first = np.arange(len(plain)) + np.searchsorted(cuts, ends[:-1])
        before = np.where(data[starts - 1] == NEWLINE, AFTER_NEWLINE, AFTER_SPACE) if len(data) else np.zeros(len(starts), int)
        before[first] = AT_START
        starts, stops, before, first = signs_apart(data, starts, stops, before, first)

        codes = mixed(self.words.codes(data, starts, stops) + before.astype(np.uint64) * MIX[1])
        place = self.known.find(codes)
        if (place < 0).any():
            new, at = np.unique(codes[place < 0], return_index=True)
            if self.known.units + len(new) > self.known.most:
                self.known.clear()
                new, at = np.unique(codes, return_index=True)
                where = at
            else:
                where = np.flatnonzero(place < 0)[at]
            self.learn(new, [(int(before[i]), data[starts[i] : stops[i]].tobytes().decode()) for i in where.tolist()])
            place = self.known.find(codes)

        counts = self.known.lengths[place]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.known.ids[np.repeat(self.known.starts[place] - upto[:-1], counts) + np.arange(upto[-1])]
        odd = np.concatenate([[0], np.cumsum(~self.known.usable[place])])
        borders = np.append(first, len(starts))
        whole = odd[borders[1:]] > odd[borders[:-1]]
        for i, start, stop, bad in zip(plain, upto[borders[:-1]].tolist(), upto[borders[1:]].tolist(), whole.tolist(), strict=True):
            if not bad:
                out[i] = ids[start:stop]
        return [np.frombuffer(self.whole(t.decode()), self.kind) if o is None else o for o, t in zip(out, texts, strict=True)]


#: Signs that end words and sentences.
_SIGNS = np.isin(np.arange(256), list(b".,;:!?"))
_LETTERS = np.array([chr(c).isascii() and chr(c).isalnum() for c in range(128)] + [False] * 128)


def signs_apart(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple:
    """Units whose last signs follow an ASCII letter or digit as two units. The pre-tokenizer parts them
    there, and so there are fewer different units to encode."""
    if not len(data):
        return starts, stops, before, first
    cut = np.flatnonzero((stops > starts) & _SIGNS[data[stops - 1]])
    at = stops[cut] - 1
    # A unit with more signs than that stays whole.
    for _ in range(64):
        more = (at > starts[cut]) & _SIGNS[data[at - 1]]
        if not more.any():
            break
        at[more] -= 1
    parted = (at > starts[cut]) & _LETTERS[data[at - 1]]
    cut, at = cut[parted], at[parted]
    ends = stops.copy()
    ends[cut] = at
    return (
        np.insert(starts, cut + 1, at),
        np.insert(ends, cut + 1, stops[cut]),
        np.insert(before, cut + 1, AT_START),
        first + np.searchsorted(cut, first),
    )


def white_space_meets(text: bytes) -> bool:
    return b"  " in text or b"\n\n" in text or b" \n" in text or b"\n " in text or text[:1] == b"\n" == text[-1:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def byte_bpe_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shards(
    documents: DataFrame, end_id: int = 2, shard_tokens: int = 1 << 20, tokenizer: str | None = None
) -> DataFrame:
    """One row per shard. tokenizer: path of a byte-level BPE file; by default the public 50k one, looked up on each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or byte_bpe_path())
        end = np.array([end_id], encode.kind)
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        lengths: list[int] = []
        size = number = 0
        task = None

        def close() -> pa.RecordBatch:
            data = np.concatenate(held)
            matrix = WaveletMatrix.build(data, encode.bits)
            columns = [
                [(task << 32) + number],
                [ids[0]],
                [len(data)],
                [encode.bits],
                [np.array([i or 0 for i in ids], "<i8").tobytes()],
                [np.packbits([i is None for i in ids]).tobytes()],
                [np.array(lengths, "<i8").tobytes()],
                [matrix.zeros.tobytes()],
                [matrix.planes.tobytes()],
                [matrix.ranks.tobytes()],
            ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
            names = [field.split()[0] for field in FORMAT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in in_stretches(batches, 1):
            task = partition_number() if task is None else task
            codes = encode.all(batch.column(1).to_pylist())
            for doc_id, code in zip(batch.column(0).to_pylist(), codes, strict=True):
                held += [code, end]
                ids.append(doc_id)
                lengths.append(len(code) + 1)
                size += len(code) + 1
                if size >= shard_tokens:
                    yield close()
                    held, ids, lengths, size, number = [], [], [], 0, number + 1
        if held:
            yield close()

    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.select("doc_id", text_bytes().alias("text")).mapInArrow(run, FORMAT)


def partition_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def write_shards(documents: DataFrame, path: str, **options) -> None:
    shards(documents, **options).write.option("compression", "zstd").parquet(path)


def matrix_of(row: dict) -> WaveletMatrix:
    bits, blocks = row["bits"], row["n_tokens"] // BLOCK + 1
    return WaveletMatrix(
        row["n_tokens"],
        bits,
        np.frombuffer(row["zeros"], np.int64),
        np.frombuffer(row["planes"], np.uint8).reshape(bits, -1),
        np.frombuffer(row["ranks"], np.uint32).reshape(bits, blocks),
    )


def read_documents_back(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    # One shard is a whole matrix of several MB; a small batch keeps few of them in a worker at once.
    files = spark.read.schema(FORMAT).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "n_tokens").select(
        F.col("shard").alias("at"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                data = matrix_of(row).decode().astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                empty = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8), count=len(lengths)).astype(bool)
                view = memoryview(data).cast("B")
                sums = [crc(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lengths), row["shard"])),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=empty),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    ["shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    read = files.mapInArrow(run, "shard long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return read.join(starts, F.col("shard") == F.col("at")).select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(documents: DataFrame, **options) -> DataFrame:
    """Writes the shards to the shared folder and returns what reading them back gives per document."""
    spark = documents.sparkSession
    path = work_folder(spark, "tokens")
    write_shards(documents, path, **options)
    return read_documents_back(spark, path)
