"""Quality classifier from weak labels.

Nine heuristic labellers vote good, bad or nothing on every document. A document's votes are one
pattern; patterns are counted over all documents, so expectation-maximisation works on at most 3**9
counted patterns whatever the corpus size. It estimates the share of good documents and, per class,
how often each labeller votes what. The posterior of a pattern is the soft label of its documents.

A linear scorer over hashed features (shapes and endings of words, adjacent equal words, ranges of the
measures) is fitted by logistic regression on the soft labels of `sample` documents, chosen by a hash of
the whole row; the scorer, not the votes, decides on every document.

Defined results: null and empty texts have no words, get no vote and the score of an empty feature
set; they are rejected, as there is nothing to keep. Repeated rows get equal scores. Null ids are
scored like others. No rows: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countermill.llm.common import in_stretches, text_bytes

BUCKETS = 1 << 14
#: The commonest function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which"
    " de la le et les des en un une du que est dans qui par pour au il sur pas plus ne se ce avec sont"
    " der die und den von zu das mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass"
    " el y los del las con no su para una al lo como si sobre este ya entre cuando todo esta".split()
)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
MEASURES = ("symbols", "pipes", "marks", "upper", "echo", "lines", "distinct", "function", "length")


def measures(text: bytes, words: list[bytes]) -> tuple[float, ...]:
    """Shares, most of them per word: the nine numbers that labellers vote on."""
    n = len(words)
    letters = len(text) - len(text.translate(None, _LETTERS))
    upper = len(text) - len(text.translate(None, _UPPER))
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    lower = list(map(bytes.lower, words))
    return (
        (len(text) - len(text.translate(None, b"#*$%&<>"))) / n,
        text.count(b"|") / n,
        (len(text) - len(text.translate(None, b"!?"))) / n,
        upper / max(1, letters),
        sum(map(bytes.__eq__, lower, lower[1:])) / n,
        1 - len(set(lines)) / len(lines),
        len(set(lower)) / n ** 0.75,
        # a short text may well have none
        sum(map(FUNCTION_TEXTS.__contains__, lower)) / n if n >= 30 else 0.07,
        sum(map(len, words)) / n,
    )


FUNCTION_TEXTS = frozenset(w.encode() for w in FUNCTION_WORDS)
#: Per labeller: bad above, good below (or the other way round where bad < good); between is no vote. Junk is of
#: one kind or another, so what finds one kind has no opinion on texts without it: those labellers never vote good.
NEVER = -1.0
LIMITS = {
    "symbols": (0.05, NEVER),
    "pipes": (0.05, NEVER),
    "marks": (0.2, NEVER),
    "upper": (0.5, NEVER),
    "echo": (0.12, NEVER),
    "lines": (0.5, NEVER),
    "distinct": (0.5, 1.4),
    "function": (0.02, 0.12),
    "length": (20.0, NEVER),
}


def votes(values: tuple[float, ...]) -> int:
    """The pattern: base-3 digits, 0 no vote, 1 good, 2 bad."""
    pattern = 0
    for name, value in zip(MEASURES, values, strict=True):
        bad, good = LIMITS[name]
        if bad < good:
            value, bad, good = -value, -bad, -good
        pattern = pattern * 3 + (2 if value > bad else 1 if value < good else 0)
    return pattern


def digits(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(MEASURES) - 1, -1, -1)) % 3


def pattern_counts(documents: DataFrame) -> DataFrame:
    """pattern, n over all documents that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes(measures(t, w)) for t in batch.column(0).to_pylist() if (w := t.split())]
            kinds, n = np.unique(np.array(found, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["pattern", "n"])

    rows = documents.select(text_bytes().alias("text")).mapInArrow(run, "pattern long, n long")
    return rows.groupBy("pattern").agg(F.sum("n").alias("n"))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for two classes and independent labellers: per pattern the posterior of good, per labeller
    P(vote | class), and the share of good. Starts from any vote for bad; the pseudo-counts say that a labeller
    seldom calls a good document bad, which keeps the classes from changing places."""
    marks = digits(patterns)
    one_hot = (marks[:, :, None] == np.arange(3)).astype(float)
    good = 1 / (1 + np.exp(4.0 * (marks == 2).sum(1) - (marks == 1).sum(1) - 1.0))
    prior = np.array([[[4.0, 4.0, 0.2]], [[2.0, 1.0, 2.0]]]) * max(1.0, counts.sum() / 1000)
    share = 0.5
    for _ in range(rounds):
        weight = np.stack([good, 1 - good]) * counts
        tables = np.einsum("cp,pjv->cjv", weight, one_hot) + prior
        tables /= tables.sum(2, keepdims=True)
        share = (weight[0].sum() + 1) / (counts.sum() + 2)
        log = np.einsum("pjv,cjv->cp", one_hot, np.log(tables)) + np.log([[share], [1 - share]])
        good = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return good, tables, share


class Shapes(dict):
    """Two hashed features of a word: its shape and its last characters' kinds."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        kinds = bytes(_KIND[b] for b in word)
        shape = bytes(b for i, b in enumerate(kinds) if not i or kinds[i - 1] != b)
        self[word] = pair = (zlib.crc32(b"s" + shape[:12]) % BUCKETS, zlib.crc32(b"e" + kinds[-3:]) % BUCKETS)
        return pair


_KIND = [
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 46 if b in b".,;:" else b
    for b in range(256)
]


def features(text: bytes, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values: shares of word features, and one bucket per range of each measure."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    pairs = np.array(list(map(shapes.__getitem__, words)), np.int64)
    kinds, n = np.unique(pairs, return_counts=True)
    ranges = [
        zlib.crc32(f"{name} {int(np.clip(value * 20, 0, 400) ** 0.5 * 4)}".encode()) % BUCKETS
        for name, value in zip(MEASURES, measures(text, words), strict=True)
    ]
    return np.concatenate([kinds, ranges]), np.concatenate([n / len(words), np.full(len(ranges), 0.5)])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 30, rate: float = 0.5) -> np.ndarray:
    """Logistic regression with adaptive rates on soft labels; the last weight is the intercept."""
    weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    for _ in range(epochs):
        for index, value, label in rows:
            at, x = np.append(index, BUCKETS), np.append(value, 1.0)
            error = 1 / (1 + np.exp(-np.clip(weights[at] @ x, -30, 30))) - label
            slope = error * x + 1e-5 * weights[at]
            squares[at] += slope * slope
            weights[at] -= rate * slope / np.sqrt(squares[at])
    return weights


def score(text: bytes, weights: np.ndarray, shapes: Shapes) -> float:
    index, value = features(text, shapes)
    return float(1 / (1 + np.exp(-np.clip(weights[index] @ value + weights[-1], -30, 30)))) if len(index) else 0.0


def train(documents: DataFrame, sample: int = 2000, seed: int = 3) -> np.ndarray:
    """Weights of the scorer. The labeller model sees every document; `sample` bounds the documents
    whose features go to the one task that fits the scorer."""
    counted = pattern_counts(documents).toPandas()
    if not len(counted):
        return np.zeros(BUCKETS + 1)
    patterns = counted["pattern"].to_numpy(np.int64)
    order = np.argsort(patterns)
    patterns = patterns[order]
    good, _, _ = fit_labellers(patterns, counted["n"].to_numpy(float)[order])
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    rows = documents.select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), text_bytes().alias("text"))
    limit = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, seen = Shapes(), {}
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h not in seen and text.split():
                    label = posterior.get(votes(measures(text, text.split())), 0.5)
                    seen[h] = (*features(text, shapes), label)
        weights = fit_scorer([seen[h] for h in sorted(seen)])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()])], ["weights"])

    fitted = rows.where(F.col("h") <= limit).repartition(1).mapInArrow(run, "weights binary").first()
    return np.frombuffer(fitted[0])


def scored(documents: DataFrame, weights: np.ndarray | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, score, kept."""
    weights = train(documents, **options) if weights is None else weights
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            scores = np.array([score(t, shared.value, shapes) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array(scores >= threshold)], ["doc_id", "score", "kept"]
            )

    return documents.select("doc_id", text_bytes().alias("text")).mapInArrow(run, "doc_id long, score double, kept boolean")


def good_documents(documents: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents, all columns, that the scorer keeps."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, **options))
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in in_stretches(batches, place):
            texts = batch.column(place).to_pylist()
            keep = [score((t or "").encode(), shared.value, shapes) >= threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
