"""Fill-in-the-middle texts by secondary-sort assembly.

A text is cut into units (a run of ASCII letters, or any other single code point). Two hashed unit counts
divide it into prefix, middle and suffix, and a hashed draw chooses its form: plain (the text itself), psm
(`<P>`prefix`<S>`suffix`<M>`middle) or spm (`<S>`suffix`<P>`prefix`<M>`middle).

1. `pieces` cuts every segment into pieces of at most CHUNK units and gives each piece its document and its
   position in the output; markers are pieces of their own, and a head carries the document's counts.
2. One shuffle by document and a sort by (document, output position) inside the partitions, the DataFrame
   form of repartitionAndSortWithinPartitions, bring a document's output together piece by piece.
   `assembled` streams it into a digest and holds one piece at a time, whatever the length of the text.
3. The same stream reads the markers of the output, which tell the segment of what follows, and gives every
   piece its place in the restored text. A second sort inside the same partitions, without a shuffle, puts
   the pieces back into text order, and `restored` streams them into the digest of the exact rebuilt text.

Defined results: a null text is an empty one; an empty text is plain with n = 0. A text that contains one of
the markers stays plain, so markers in an output are always real ones. A null doc_id hashes as an empty
number. Each input row is a document of its own: repeated rows and rows that share a doc_id give equally many
rows, told apart by the row's number in the table. Other columns are not looked at. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countermill.llm.common import text_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: The order of the segments in an output of each form, and in the text.
OUTPUT_ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
TEXT_ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

#: Units of a piece, and bytes of the pieces that are handed on at once.
CHUNK = 4096
BATCH_BYTES = 4 << 20

PIECES = (
    "row long, position long, data binary, doc_id long, n long, form string, prefix_chars long, middle_chars long"
)
PLACED = PIECES + ", output_sha256 string"


def unit_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which the units of a UTF-8 text start."""
    codes = np.frombuffer(text, np.uint8)
    lower = codes | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    follows = np.zeros(len(codes), bool)
    follows[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~follows & ((codes & 0xC0) != 0x80))


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def chosen_form(text: bytes, h3: int, h4: int, plain_from: int, spm_below: int) -> str:
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= plain_from:
        return "plain"
    return "spm" if h4 % 100 < spm_below else "psm"


def restored_text(output: str, form: str) -> str:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    parts = re.split("(<[PSM]>)", output)
    segments = dict(zip(parts[1::2], parts[2::2], strict=True))
    return segments["<P>"] + segments["<M>"] + segments["<S>"]


def hashed_words(column: str = "doc_id", seed: int = 1) -> list[Column]:
    """The first four 32-bit words of the sha256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def pieces(documents: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, chunk: int = CHUNK) -> DataFrame:
    """The outputs of all documents as pieces: row, position in the output, data. A document's head has
    position -1, no data, and the document's doc_id, n, form, prefix_chars and middle_chars."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", text_bytes().alias("text"), *hashed_words(seed=seed)
    )

    def cut(row: int, doc_id: int | None, text: bytes, h1: int, h2: int, h3: int, h4: int) -> Iterator[tuple]:
        starts = unit_starts(text)
        n = len(starts)
        form = chosen_form(text, h3, h4, plain_from, spm_below)
        if form == "plain":
            segments = [(None, 0, n)]
            counts = (None, None)
        else:
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            spans = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, n)}
            segments = [(m, *spans[m]) for m in OUTPUT_ORDER[form]]
            ends = [int(starts[u]) if u < n else len(text) for u in (low, high)]
            counts = code_points(text[: ends[0]]), code_points(text[ends[0] : ends[1]])
        yield row, -1, None, doc_id, n, form, *counts
        position = 0
        for marker, first, last in segments:
            if marker:
                yield row, position, marker, None, None, None, None, None
                position += 1
            for u in range(first, last, chunk):
                v = min(u + chunk, last)
                data = text[int(starts[u]) : int(starts[v]) if v < n else len(text)]
                yield row, position, data, None, None, None, None, None
                position += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_pieces() -> Iterator[tuple]:
            for batch in batches:
                for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield from cut(*values)

        yield from in_batches(all_pieces(), PIECES)

    return rows.mapInArrow(run, PIECES)


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def in_batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows whose third value is data, as Arrow batches of a bounded number of rows and bytes."""
    names, types = zip(*(field.split() for field in schema.split(", ")), strict=True)
    kept: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = zip(*kept, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, types, strict=True)], list(names))

    for row in rows:
        kept.append(row)
        size += len(row[2] or b"")
        if len(kept) >= 20_000 or size >= BATCH_BYTES:
            yield batch()
            kept, size = [], 0
    if kept:
        yield batch()


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def assembled(cut: DataFrame) -> DataFrame:
    """Pieces in output order inside each partition. Streams every document's output into a digest and
    returns the same pieces with their place in the restored text as position; heads come with the digest."""
    together = cut.repartition("row").sortWithinPartitions("row", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed() -> Iterator[tuple]:
            head, digest, segment, count = None, None, 0, 0
            for row, position, data, *about in streamed(batches):
                if position < 0:
                    if head:
                        yield *head, digest.hexdigest()
                    head, digest, segment, count = (row, -1, None, *about), hashlib.sha256(), 0, 0
                    form = about[2]
                    continue
                digest.update(data)
                if form != "plain" and data in MARKERS:
                    segment = TEXT_ORDER[data]
                    continue
                yield row, (segment << 48) + count, data, *about, None
                count += 1
            if head:
                yield *head, digest.hexdigest()

        yield from in_batches(placed(), PLACED)

    return together.mapInArrow(run, PLACED)


RESULT = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
)


def restored(placed: DataFrame) -> DataFrame:
    """What `assembled` returns, sorted once more in its own partitions and streamed into a digest of the
    rebuilt text: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            head, digest = None, None
            for _, position, data, *about in streamed(batches):
                if position < 0:
                    if head:
                        yield *head, digest.hexdigest()
                    head, digest = about, hashlib.sha256()
                else:
                    digest.update(data)
            if head:
                yield *head, digest.hexdigest()

        names, types = zip(*(field.split() for field in RESULT.split(", ")), strict=True)
        rows: list[tuple] = []
        for result in results():
            rows.append(result)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows), types, strict=True)], list(names))
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows), types, strict=True)], list(names))

    return placed.sortWithinPartitions("row", "position").mapInArrow(run, RESULT)


def digests(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return restored(assembled(pieces(documents, **settings)))


def output_texts(documents: DataFrame, **settings) -> DataFrame:
    """row, doc_id, form, output: the transformed texts themselves, each in one value, from the same sorted pieces."""
    together = pieces(documents, **settings).repartition("row").sortWithinPartitions("row", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def outputs() -> Iterator[tuple]:
            head, parts = None, []
            for row, position, data, *about in streamed(batches):
                if position < 0:
                    if head:
                        yield head[0], head[1], b"".join(parts), head[2]
                    head, parts = (row, about[0], about[2]), []
                else:
                    parts.append(data)
            if head:
                yield head[0], head[1], b"".join(parts), head[2]

        yield from in_batches(outputs(), "row long, doc_id long, output binary, form string")

    made = together.mapInArrow(run, "row long, doc_id long, output binary, form string")
    return made.select("row", "doc_id", "form", F.col("output").cast("string").alias("output"))


SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
    FROM documents
), hashes AS (
    SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
           CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM words
), cuts AS (
    SELECT doc_id, text, units, n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
           least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high
    FROM hashes
), parts AS (
    SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:low], ''), '') AS prefix,
           coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
           coalesce(array_to_string(units[high + 1:], ''), '') AS suffix
    FROM cuts
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
