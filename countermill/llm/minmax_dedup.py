"""Near-duplicates by min-max hashing.

Every permutation of a document's shingle codes gives two signature values, its minimum and its
maximum, so 60 permutations give 120 values; bands of five of them are the buckets. A pair at a
similarity of 0.85 shares no band with a probability below 1e-6.

1. Documents with the same shingle set are one node, whose id is its smallest doc_id.
2. A bucket's smallest node is its centre. Each node is paired with the smallest centre of its buckets, one
   pair per node, never all pairs, and the pair is confirmed on full shingle sets.
3. That settles groups around a centre. Where a bucket's nodes are still in several components, nodes outside
   the bucket's main component are compared with the others of the bucket, in blocks of BLOCK nodes: a block's
   intersections are a product of matrices, and a block returns only links that join components of its own,
   so what leaves it grows with its nodes and not with its pairs. Pairs inside a component need no look.
4. Components of the confirmed links.

Defined results: null and empty texts, and texts without words, have an empty set, n_shingles 0,
and stay alone. Rows that share a doc_id are one document with several texts; each row keeps its
own n_shingles. Null doc_id: n_shingles is given, component_id is null, kept is true. Ties are broken
by doc_id. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countermill.llm.common import WordHashes, map_batches, mixed, shingle_codes, stored, text_bytes
from countermill.llm.components import centres

PERMUTATIONS = 60
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Distinct 5-word shingles of a text in order of their codes."""
    return np.unique(shingle_codes(hashes.of(text.lower().split())))


def signature(codes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the codes under each permutation (an odd multiplier and a mixing step)."""
    out = np.empty(2 * PERMUTATIONS, np.uint64)
    for p in range(PERMUTATIONS):
        seen = codes * _MULTIPLIERS[p]
        seen ^= seen >> np.uint64(31)
        out[2 * p], out[2 * p + 1] = seen.min(), seen.max()
    return out


_MULTIPLIERS = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
#: Band b holds five neighbouring values of one kind, minima or maxima, so a band has five permutations.
_ORDER = np.concatenate([np.arange(0, 2 * PERMUTATIONS, 2), np.arange(1, 2 * PERMUTATIONS, 2)])


def bands(codes: np.ndarray) -> np.ndarray:
    values = signature(codes)[_ORDER].reshape(BANDS, ROWS)
    code = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        code = mixed(code * _MULTIPLIERS[0] + values[:, row])
    return code.view(np.int64)


def signed_sets(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the digest of the set and its bands."""
    hashes = WordHashes(200_000)

    def step(batch: pa.RecordBatch) -> dict:
        sizes, digests, rows = [], [], []
        for text in batch.column(1).to_pylist():
            codes = shingle_set(text, hashes)
            sizes.append(len(codes))
            digests.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None)
            rows.append(bands(codes) if len(codes) else np.empty(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return {
            "doc_id": batch.column(0),
            "n_shingles": pa.array(sizes, pa.int64()),
            "digest": pa.array(digests, pa.binary()),
            "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows))),
        }

    return map_batches(
        documents.select("doc_id", text_bytes().alias("text")),
        step,
        "doc_id long, n_shingles long, digest binary, bands array<long>",
        text=1,
    )


def full_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, codes): the shingle sets of these documents only."""
    hashes = WordHashes(200_000)

    def step(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(text, hashes) for text in batch.column(1).to_pylist()]
        return {"node": batch.column(0), "codes": pa.array([s.tobytes() for s in sets], pa.binary())}

    texts = documents.select("doc_id", text_bytes().alias("text")).join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return stored(map_batches(texts, step, "node long, codes binary", text=1).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("codes").alias("a")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("codes").alias("b")), "v")
        .select("u", "v", "a", "b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                short, long = sorted((len(a), len(b)))
                common = len(np.intersect1d(a, b, assume_unique=True)) if 100 * short >= percent * long else 0
                keep.append(short > 0 and 100 * common >= percent * (short + long - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return stored(both.mapInArrow(compare, "u long, v long"))


#: Nodes of one side of a block, and shingles that a product of matrices takes at once.
BLOCK = 512
WIDTH = 8192


def intersections(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at these places with all sets. Shingles that only one set
    has are left out; the others are taken a few thousand at a time, which bounds the matrices."""
    codes = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(codes, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    column, owner = (np.cumsum(n > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(rows), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        a, b = np.searchsorted(column, [start, start + WIDTH])
        has = np.zeros((len(sets), WIDTH), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        out += has[rows] @ has.T
    return out.astype(np.int64)


def joining_links(nodes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], outside: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of nodes outside the main component with any others, as many as join different components."""
    rows = np.flatnonzero(outside)
    sizes = np.array([len(s) for s in sets])
    common = intersections(sets, rows)
    linked = (100 * common >= percent * (sizes[rows][:, None] + sizes - common)) & (parts[rows][:, None] != parts)
    head: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := head.get(x, x)) != x:
            head[x] = x = head.get(up, up)
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = find(int(parts[rows[i]])), find(int(parts[j]))
        if a != b:
            head[a] = b
            out.append((int(nodes[rows[i]]), int(nodes[j])))
    return out


def crossing_links(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that share a bucket and are in different components."""
    named = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    counts = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = (
        counts.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"))
        .where("parts > 1")
        .select(
            "bucket",
            F.col("main.component").alias("main"),
            F.ceil(F.col("main.n") / BLOCK).alias("inside"),
            F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("apart"),
        )
    )
    outside = F.col("component") != F.col("main")
    # Blocks of the main component have numbers below those of the rest; a pair of blocks has one of the rest.
    block = F.when(outside, F.pmod(F.xxhash64("node"), F.col("apart")) + F.col("inside")).otherwise(F.pmod(F.xxhash64("node"), F.col("inside")))
    others = F.when(outside, F.sequence(F.lit(0).cast("long"), F.col("inside") + F.col("apart") - 1)).otherwise(
        F.sequence(F.col("inside"), F.col("inside") + F.col("apart") - 1)
    )
    paired = (
        named.join(split, "bucket")
        .select("bucket", "node", "component", outside.alias("outside"), block.alias("block"), F.explode(others).alias("other"))
        .select("bucket", "node", "component", "outside", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )

    def link(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["codes"]]
        nodes, parts = table["node"].to_numpy(), table["component"].to_numpy()
        found = joining_links(nodes, parts, sets, table["outside"].to_numpy().astype(bool), percent)
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["u", "v"])

    return stored(paired.join(sets, "node").groupBy("bucket", "low", "high").applyInArrow(link, "u long, v long").where("u <> v"))


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows = stored(signed_sets(documents))
    known = rows.where("doc_id is not null")
    classes = known.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    classes = stored(classes)
    members = known.join(classes.select("digest", "node"), "digest").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    alike = stored(members.where("u <> v"))
    every = classes.select("node", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    buckets = stored(every.join(shared, "bucket").select("bucket", "node", "low"))

    sets = full_sets(documents, buckets.select("node").distinct())
    nearest = buckets.where("node <> low").groupBy(F.col("node").alias("v")).agg(F.min("low").alias("u"))
    links = confirmed(nearest, sets, percent)
    labels = centres(links.union(alike))
    more = crossing_links(buckets, labels, sets, percent)
    if not more.isEmpty():
        labels = centres(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    found = labels.withColumnRenamed("node", "doc_id")
    component = F.coalesce("component", "doc_id")
    return (
        rows.join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_near_duplicates(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that stay: one of each component, and of rows with one doc_id the one with the
    smallest text. Rows without an id all stay."""
    gone = near_duplicates(documents, percent).where("not kept").select("doc_id").distinct()
    left = documents.join(gone, "doc_id", "left_anti").select(F.struct(*documents.columns).alias("d"))
    salt = F.when(F.col("d.doc_id").isNull(), F.xxhash64("d.text"))
    place = F.row_number().over(Window.partitionBy("d.doc_id", salt).orderBy("d.text"))
    return left.select("d", place.alias("place")).where("place = 1 or d.doc_id is null").select("d.*")
