"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

Each block is main text or not. Its score adds weights of the elements it stands in (tags, and words in
their class, id, role and itemprop), of its parent, and of its text (length, links, ending, capitals,
digits, words of notices); neighbouring labels add a transition weight. Weights are fitted by the
gradient of the likelihood (forward-backward) on labelled pages, and a page's labels are the best path
(Viterbi).

Labelled pages: pages made by rule from layouts with known main text (page_maker), and at most `sample`
pages of the table, by a hash of the page, whose markup states the article itself.

Defined results: null, empty and text-less pages give an empty text. Repeated rows are extracted each.
Unclosed elements, comments and tags at the end of a cut page end with it. No rows: no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countermill.llm.dom_blocks import Block, blocks
from countermill.llm.page_maker import labelled_pages

NOTICE = re.compile(
    r"©|copyright|all rights reserved|cookie|privacy|subscribe|newsletter|sign (?:in|up)|log ?in|advert|sponsor|share|follow us"
    r"|read more|related|comments?\b|reply|search|menu|skip to|terms of|droits réservés|datenschutz|impressum|derechos reservados",
    re.I,
)
#: A page states its article by one of these elements; inside it, these are not the article.
STATED = ("article", "main")
ASIDE = frozenset("nav aside footer form header menu button".split())


@lru_cache(maxsize=50_000)
def path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    found = {"top" if len(path) < 3 else "deep"}
    for tag, named in path:
        found.add(f"in {tag}")
        found.update(f"named {part}" for part in named.split())
    if path:
        found.add(f"parent {path[-1][0]}")
        found.update(f"own {part}" for part in path[-1][1].split())
    return tuple(sorted(found))


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    found = [f"words {min(7, words.bit_length())}", f"links {min(4, 4 * block.linked // len(text))}"]
    found.append("ends" if text[-1] in ".!?…:;\"'»”" else "open")
    found.append(f"commas {min(3, text.count(','))}")
    if text[0].isupper():
        found.append("capital")
    if text.isupper():
        found.append("shouts")
    if any(c.isdigit() for c in text[:200]):
        found.append("digits")
    if words < 40 and NOTICE.search(text):
        found.append("notice")
    return found


class Chain:
    """Weights of the field. Scores are those of `main`; `other` scores nothing but its transitions."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]], start: list[float]):
        self.weights, self.moves, self.start = weights, moves, start
        self.paths: dict[tuple, float] = {}

    def score(self, block: Block) -> float:
        get = self.weights.get
        score = self.paths.get(block.path)
        if score is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            score = self.paths[block.path] = sum(get(f, 0.0) for f in path_features(block.path))
        return score + sum([get(f, 0.0) for f in text_features(block)])

    def decode(self, scores: list[float]) -> list[bool]:
        """Viterbi: the best labels of a page."""
        if not scores:
            return []
        (oo, om), (mo, mm) = self.moves
        other, main = self.start[0], self.start[1] + scores[0]
        back: list[tuple[bool, bool]] = []
        for score in scores[1:]:
            a, b, c, d = other + oo, main + mo, other + om, main + mm
            back.append((b > a, d > c))
            other, main = max(a, b), max(c, d) + score
        label = main > other
        labels = [label]
        for from_main in reversed(back):
            label = from_main[label]
            labels.append(label)
        return labels[::-1]


def log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def fit(pages: list[tuple[list[Block], list[bool]]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-3) -> Chain:
    """Adaptive gradient ascent on the likelihood of the labels, page after page."""
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-3)
    moves, start = [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0]
    seen = [([(*path_features(b.path), *text_features(b)) for b in page], labels) for page, labels in pages if page]
    step_squares = defaultdict(lambda: 1e-3)

    def step(key, slope: float) -> float:
        step_squares[key] += slope * slope
        return rate * slope / math.sqrt(step_squares[key])

    for _ in range(epochs):
        for page, labels in seen:
            scores = [sum(weights[f] for f in features) for features in page]
            n = len(scores)
            ahead = [(start[0], start[1] + scores[0])]
            for s in scores[1:]:
                o, m = ahead[-1]
                ahead.append((log_add(o + moves[0][0], m + moves[1][0]), log_add(o + moves[0][1], m + moves[1][1]) + s))
            behind = [(0.0, 0.0)] * n
            for i in range(n - 2, -1, -1):
                o, m = behind[i + 1]
                m += scores[i + 1]
                behind[i] = (log_add(moves[0][0] + o, moves[0][1] + m), log_add(moves[1][0] + o, moves[1][1] + m))
            total = log_add(*ahead[-1])
            expected = [[0.0, 0.0], [0.0, 0.0]]
            for i in range(1, n):
                for a in (0, 1):
                    for b in (0, 1):
                        p = math.exp(min(0.0, ahead[i - 1][a] + moves[a][b] + (scores[i] if b else 0.0) + behind[i][b] - total))
                        expected[a][b] += float(labels[i - 1] == a and labels[i] == b) - p
            for i, features in enumerate(page):
                slope = float(labels[i]) - math.exp(min(0.0, ahead[i][1] + behind[i][1] - total))
                for f in features:
                    g = slope - l2 * weights[f]
                    squares[f] += g * g
                    weights[f] += rate * g / math.sqrt(squares[f])
            first = float(labels[0]) - math.exp(min(0.0, ahead[0][1] + behind[0][1] - total))
            start[1] += step("start", first)
            for a in (0, 1):
                for b in (0, 1):
                    moves[a][b] += step((a, b), expected[a][b])
    return Chain(dict(weights), moves, start)


def stated_labels(page: list[Block]) -> list[bool] | None:
    """Labels of a page that marks its article up, else None."""
    for kind in STATED:
        inside = [any(tag == kind for tag, _ in b.path) for b in page]
        if any(inside) and not all(inside):
            return [
                own and not any(tag in ASIDE or "comment" in named or "ad" in named.split() for tag, named in b.path)
                for own, b in zip(inside, page, strict=True)
            ]
    return None


def train(pages: DataFrame, made: int = 240, sample: int = 160, seed: int = 1) -> Chain:
    """`made` pages by rule, and at most `sample` pages of the table that state their article."""
    rows = pages.select(F.xxhash64(F.lit(seed), "page_id", "url").alias("h"), "html")
    ids = rows.select("h").orderBy("h").limit(sample)
    limit = ids.agg(F.max("h")).first()[0]
    training = labelled_pages(seed, made)
    if limit is not None:
        for row in rows.where((F.col("h") <= limit) & F.col("html").isNotNull()).limit(sample).toLocalIterator():
            page = blocks(row.html)
            if (labels := stated_labels(page)) is not None:
                training.append((page, labels))
    return fit(training)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    labels = chain.decode([chain.score(b) for b in found])
    return "\n\n".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def extracted(pages: DataFrame, chain: Chain | None = None, **options) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or train(pages, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, shared.value) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
