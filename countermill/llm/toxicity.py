"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its pairs of neighbouring words and its pairs with one word between,
lower-cased and without signs at their ends, hashed to 2**20 coordinates; a feature counts once however
often it occurs. FTRL-proximal gives each coordinate its own rate and keeps it at zero until its summed
gradient passes the L1 limit, so the model is a short list of weights: its length is bounded by the
coordinates, and in practice a few thousand.

Labels come from `labels.toxic` of rows whose crc32 of the id is not 0 modulo 5, at most `sample` of them
by a hash of the id. The sample is fitted in one task, in the order of that hash; the driver sees the
weights only. Scores never look at ids, labels, language or source.

Defined results: null and empty texts score as the intercept alone. Null ids count as the empty text in
the crc32 and have no label. Repeated labels: toxic if any row says so; null labels are no labels.
Repeated documents: each is scored, the first of an id trains. Without labels every score is 0.5
(predicted 1, as the contract's limit says). No rows: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countermill.llm.common import WordHashes, crc_of_id, joined

BITS = 20
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class PlainHashes(WordHashes):
    """Raw words to the hash of their plain form; 0 if nothing is left."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.most:
            self.clear()
        word = EDGES.sub("", raw.lower())
        self[raw] = code = xxhash.xxh3_64_intdigest(word.encode()) | 1 if word else 0
        return code


_KINDS = np.arange(1, 4, dtype=np.uint64)


def coordinates(text: str, hashes: PlainHashes) -> np.ndarray:
    """Coordinates of words, pairs and skip pairs, repeats included."""
    codes = hashes.of(text.split())
    codes = codes[codes != 0]
    parts = [joined(codes)]
    if len(codes) > 1:
        parts.append(joined(codes[:-1], codes[1:]))
    if len(codes) > 2:
        parts.append(joined(codes[:-2], codes[2:] ^ _KINDS[2]))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates and L1 and L2 penalties; coordinate 2**BITS is the intercept."""

    def __init__(self, alpha: float = 3.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        moved = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, moved, 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        after = n + slope * slope
        self.z[at] += slope - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[at] = after


def train(documents: DataFrame, labels: DataFrame, sample: int = 12_000, epochs: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(crc_of_id() % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    )
    # at most `sample` rows of three numbers, so the broadcast has a bound
    chosen = F.broadcast(known.orderBy("h", "doc_id").limit(sample))
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").select("h", "toxic", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = PlainHashes(), {}
        for batch in batches:
            for h, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.unique(coordinates(text, hashes)).astype(np.int32)
                if h not in seen or (len(at), at.tobytes()) < (len(seen[h][0]), seen[h][0].tobytes()):
                    seen[h] = (at, float(toxic > 0))
        model = Ftrl()
        for _ in range(epochs):
            for h in sorted(seen):
                model.learn(*seen[h])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    fitted = rows.repartition(1).mapInArrow(run, "at long, w double").toPandas()
    return fitted["at"].to_numpy(np.int64), fitted["w"].to_numpy(float)


def scored(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        table = np.zeros((1 << BITS) + 1, np.float32)
        table[at] = w
        hashes = PlainHashes()
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = coordinates(text or "", hashes)
                found = np.unique(found[table[found] != 0])
                scores[i] = 1 / (1 + np.exp(-np.clip(float(table[found].sum()) + float(table[-1]), -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return documents.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
