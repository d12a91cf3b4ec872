"""Helpers the corpus operators share: words, hashes, stored tables and Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countermill.session import work_folder

#: A word is a run of bytes that are no ASCII white space; bytes.split() without arguments cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read again, so that no later
    stage computes them anew and a lost executor costs a read. Shuffle files of the write, which nothing
    reads after it, stay on disk until the JVM collects their owners, or go at its end with `drop_shuffles`."""
    spark = df.sparkSession
    path = work_folder(spark, "table")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    try:
        if drop_shuffles:
            spark.conf.set(name, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole documents go to Python and back in Arrow batches of at most so many rows, as the executor's JVM and
    its workers hold several batches at a time beside the heap. Smaller batches stay as they are set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text is an empty one."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str, text: int | None = None) -> DataFrame:
    """step turns an Arrow batch into columns of the schema, in its order. With the place of a text column a
    batch is a stretch of bounded bytes."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if text is None else in_stretches(batches, text):
            if batch.num_rows:
                columns = step(batch)
                yield pa.RecordBatch.from_arrays([as_array(columns[name]) for name in names], names)

    return df.mapInArrow(run, schema)


def as_array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


class WordHashes(dict):
    """64-bit hashes of words, kept between batches up to a number of words."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers of the mixing steps: the fractions of the golden ratio and of the square roots of 3 and 5.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBB67AE8584CAA73B), np.uint64(0x3C6EF372FE94F82B | 1))


def mixed(codes: np.ndarray) -> np.ndarray:
    """Spreads 64-bit codes so that every bit depends on all others."""
    codes = codes ^ (codes >> np.uint64(32))
    codes = codes * MIX[0]
    codes = codes ^ (codes >> np.uint64(29))
    codes = codes * MIX[1]
    return codes ^ (codes >> np.uint64(32))


def unmixed(codes: np.ndarray) -> np.ndarray:
    """The codes that `mixed` was given."""
    one, two = (np.uint64(pow(int(factor), -1, 1 << 64)) for factor in MIX[:2])
    codes = (codes ^ (codes >> np.uint64(32))) * two
    codes = codes ^ (codes >> np.uint64(29)) ^ (codes >> np.uint64(58))
    codes = codes * one
    return codes ^ (codes >> np.uint64(32))


def joined(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit code per row of equally long columns; the order of the columns counts."""
    code = np.full(len(columns[0]), MIX[2], np.uint64)
    for column in columns:
        code = mixed(code * MIX[0] + column)
    return code


def shingle_codes(codes: np.ndarray, size: int = 5) -> np.ndarray:
    """Codes of the windows of `size` words; a shorter text is one window, an empty one has none."""
    n = len(codes)
    if n == 0:
        return codes
    if n < size:
        return joined(*(codes[i : i + 1] for i in range(n)), np.array([n], np.uint64))
    return joined(*(codes[i : n - size + 1 + i] for i in range(size)))


#: Bytes of text that are hashed at once. A longer word is hashed on its own.
HASH_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordCodes:
    """64-bit codes of the words of many texts at once, by default with ASCII letters lower-cased.

    A word's code is a polynomial over random values of its bytes. With running sums over a stretch of text
    and powers of an odd base, which has an inverse modulo 2^64, it is a difference of two sums, so no word
    is cut out or looked up.
    """

    def __init__(self, lower: bool = True):
        base = int(MIX[0])
        self.letters = _LOWER if lower else np.arange(256, dtype=np.uint8)
        self.value = mixed(np.arange(1, 257, dtype=np.uint64) * MIX[1])[self.letters]
        self.power, self.inverse = (_powers(b, HASH_BYTES + 1) for b in (base, pow(base, -1, 1 << 64)))

    def spans(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of a binary column without nulls, the start and stop of every word in them, and the place
        of each text's first word among the words."""
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        text = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        in_word = _IN_WORD[text]
        # A word starts where the byte before is white space or belongs to another text.
        first = in_word.copy()
        first[1:] &= ~in_word[:-1]
        borders = ends[:-1][ends[:-1] < len(text)]
        first[borders] = in_word[borders]
        starts = np.flatnonzero(first)
        after = np.flatnonzero(in_word[:-1] & (~in_word[1:] | first[1:])) + 1
        stops = np.append(after, len(text)) if len(text) and in_word[-1] else after
        return text, starts, stops, np.searchsorted(starts, ends)

    def codes(self, text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Codes of these parts of a text, which follow one another."""
        codes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            # Whole words of one stretch of text.
            to = int(np.searchsorted(stops, starts[at] + HASH_BYTES, "right"))
            if to == at:
                codes[at] = xxhash.xxh3_64_intdigest(self.letters[text[starts[at] : stops[at]]].tobytes())
                at += 1
                continue
            low, high = starts[at], stops[to - 1]
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.value[text[low:high]] * self.power[: high - low], out=sums[1:])
            begin, end = starts[at:to] - low, stops[at:to] - low
            codes[at:to] = (sums[end] - sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * MIX[2]
            at = to
        return mixed(codes)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of a binary column without nulls, and the place of each text's first word."""
        text, starts, stops, places = self.spans(column)
        return self.codes(text, starts, stops), places

    def shingle_sets(self, column: pa.Array, size: int = 5) -> list[np.ndarray]:
        """Per text the distinct codes of its windows of `size` words, in order; a shorter text is one window."""
        codes, places = self.of(column)
        windows = joined(*(codes[i : len(codes) - size + 1 + i] for i in range(size))) if len(codes) >= size else codes[:0]
        sets = []
        for start, stop in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            found = windows[start : stop - size + 1].copy() if stop - start >= size else shingle_codes(codes[start:stop], size)
            found.sort()
            sets.append(found[np.append(True, found[1:] != found[:-1])] if len(found) else found)
        return sets


_ZSTD = pa.Codec("zstd", compression_level=1)
#: Shorter planes are left to the compression of Spark's blocks.
_LONG = 1 << 16


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """An array in bytes that take little room: its byte planes, of the differences where values are in order."""
    if not len(values):
        return b""
    values = np.diff(values, prepend=values.dtype.type(0)) if rising else np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    if len(planes) < _LONG:
        return bytes(8) + planes
    return len(planes).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unpacked(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    """The array that `packed` was given."""
    if not data:
        return np.empty(0, kind)
    size, data = int.from_bytes(data[:8], "little"), data[8:]
    planes = np.frombuffer(_ZSTD.decompress(data, size, asbytes=True) if size else data, np.uint8)
    values = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def all_unpacked(column: pa.ChunkedArray, kind: type, rising: bool = False) -> np.ndarray:
    """The arrays of a column, one after the other."""
    return np.concatenate([np.empty(0, kind), *(unpacked(data, kind, rising) for data in column.to_pylist())])


def in_stretches(batches: Iterator[pa.RecordBatch], place: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices that hold at most so many bytes in a text column, or one row."""
    for batch in batches:
        column = batch.column(place)
        wide = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1] if len(column) else []
        row = 0
        while row < batch.num_rows:
            rows = max(1, int(np.searchsorted(ends[row:], int(ends[row]) + most, "right")) - 1)
            yield batch.slice(row, rows)
            row += rows


def seeded_order(seed: int, column: str = "doc_id") -> Column:
    """A fixed pseudo-random order of documents."""
    return F.xxhash64(F.lit(seed), F.col(column))


def crc(data: bytes) -> int:
    return zlib.crc32(data)
