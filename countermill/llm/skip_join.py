"""N-gram Jaccard join with set-relation skipping.

Sets of word shingles link when 100 * intersection >= percent * union. Equal sets are one node.

1. `signed_rows` reads every text once: the size of its set, a digest, a parity bitmap, and on the side how
   many sets hold a shingle, counted for all shingles in a table of SLOTS slots. The sum of these tables has
   a fixed size and gives the order of all shingles, rare ones first, equal counts by code. Whatever the
   counts are, one order for all sets makes the prefix filter exact.
2. `index_lists`: a set goes into the lists of the first shingles of its order, as many as any linked set must
   share one of. Shingles that very many sets hold come last in the order and are hardly ever listed; a list
   that may still be long is cut into parts.
3. Within a list an entry's position bounds what two sets can share behind it. Lists are sorted by size and
   position and cut into blocks, and pairs of blocks whose sizes or positions leave too little are skipped whole
   (`listed_pairs`). What passes is held against the parity bitmaps: two bitmaps differ in at most as many bits
   as the sets differ in shingles, so a pair that differs in too many is no link.
4. Every node first takes one hub, the smallest node of the lists it shares most often. The hub pair is
   compared in full, and what the node lacks and has beyond its hub is kept.
5. Nodes that hubs have brought into one component need no look at each other. Pairs of different components
   are verified per (hub, other node): the hub's intersection with the other node is worked out once, and the
   answer of each set of that hub follows from it by the few shingles that set lacks or has beyond the hub.
6. Components of the links; a component's name is its smallest doc_id.

`links` gives all links between different sets, without step 4's skipping, with their membership.

Defined results: null and empty texts and texts without words have an empty set, n_shingles 0, and link with
nothing. A text of fewer words than a shingle is one shingle. Rows that share a doc_id are one document with
several texts: each row keeps its own n_shingles, and what links to one of them reaches the others. A null
doc_id has its n_shingles, no component and no links. Other columns are not looked at. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countermill.llm.common import WordCodes, in_stretches, mixed, stored, text_bytes
from countermill.llm.components import components

SIZE = 5
#: Counters of the order of shingles, four bytes each: the size of what is broadcast, whatever the corpus.
SLOTS = 1 << 20
SLOT_BITS = 20
PIECE = 1 << 14
#: Entries of a list that one task takes at once, and of a block that is skipped or compared as a whole.
LIST = 4096
BLOCK = 64
#: A hub's answers serve a set that has at least this similarity with it, in percent.
ALIKE = 60


def digest_of(codes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None


def parity_bits(codes: np.ndarray) -> bytes:
    """A bitmap of two to four bits per shingle: whether an odd number of shingles falls on a bit."""
    size = 1 << max(6, (2 * len(codes) - 1).bit_length())
    places = (mixed(codes) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=size) & 1, bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """In how many bits two parity bitmaps differ; the longer one is folded to the length of the shorter."""
    x, y = sorted(((len(v), int.from_bytes(v, "little")) for v in (a, b)))
    length, folded = y
    while length > x[0]:
        half = 4 * length
        folded = (folded & ((1 << half) - 1)) ^ (folded >> half)
        length //= 2
    return (folded ^ x[1]).bit_count()


def least_common(a, b, percent: int):
    """The smallest intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


ROWS = "doc_id long, n_shingles long, digest binary, bits binary, piece int, counts binary"


def signed_rows(documents: DataFrame) -> DataFrame:
    """One row per document row, and rows with pieces of the table of counts (piece not null)."""
    words = WordCodes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in in_stretches(batches, 1):
            sets = words.shingle_sets(batch.column(1), SIZE)
            if sets:
                slots = np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)
                counts += np.bincount(slots.astype(np.int64), minlength=SLOTS)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest_of(s) for s in sets], pa.binary()),
                    pa.array([parity_bits(s) if len(s) else None for s in sets], pa.binary()),
                    none.cast(pa.int32()),
                    none.cast(pa.binary()),
                ],
                [f.split()[0] for f in ROWS.split(", ")],
            )
        yield count_pieces(counts)

    return documents.select("doc_id", text_bytes().alias("text")).mapInArrow(run, ROWS)


def count_pieces(counts: np.ndarray) -> pa.RecordBatch:
    """A table of counts as rows of ROWS: places and counts of the slots in use, a piece of the table each."""
    pieces, packed = [], []
    for piece in range(SLOTS // PIECE):
        part = counts[piece * PIECE : (piece + 1) * PIECE]
        used = np.flatnonzero(part)
        if len(used):
            pieces.append(piece)
            packed.append(used.astype("<u2").tobytes() + np.minimum(part[used], 0xFFFFFFFF).astype("<u4").tobytes())
    none = pa.nulls(len(pieces))
    columns = [none.cast(t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
    columns += [pa.array(pieces, pa.int32()), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ROWS.split(", ")])


def slot_counts(rows: DataFrame) -> np.ndarray:
    """The sum of all tables of counts: SLOTS counters of four bytes, added up piece by piece in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                used = np.frombuffer(data, "<u2", len(data) // 6)
                total = sums.setdefault(piece, np.zeros(PIECE, np.int64))
                total[used] += np.frombuffer(data, "<u4", offset=2 * len(used))
        if sums:
            full = [np.minimum(s, 0xFFFFFFFF).astype("<u4").tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(full, pa.binary())], ["piece", "counts"])

    pieces = rows.where("piece is not null").select("piece", "counts").repartition("piece")
    total = np.zeros(SLOTS, np.uint32)
    for piece, data in pieces.mapInArrow(run, "piece int, counts binary").collect():
        total[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(data, "<u4")
    return total


def in_order(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The codes of a set, rare ones first."""
    return codes[np.lexsort((codes, counts[(codes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))]


def listed_prefixes(documents: DataFrame, counts: np.ndarray, percent: int, part_entries: int = LIST) -> DataFrame:
    """doc_id, digest, n and the first codes of each set, with the number of parts of each code's list."""
    words = WordCodes()
    bound = max(part_entries, 4 * int(counts.mean()) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_stretches(batches, 1):
            digests, sizes, lists = [], [], []
            for codes in words.shingle_sets(batch.column(1), SIZE):
                digests.append(digest_of(codes))
                sizes.append(len(codes))
                lists.append(in_order(codes, counts)[: prefix_length(len(codes), percent)] if len(codes) else codes)
            flat = np.concatenate(lists) if lists else np.empty(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            parts = -(-counts[(flat >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64) // bound)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(offsets),
                        pa.StructArray.from_arrays(
                            [pa.array(flat.view(np.int64)), pa.array(parts.astype(np.int32))], ["code", "parts"]
                        ),
                    ),
                ],
                ["doc_id", "digest", "n", "listed"],
            )

    schema = "doc_id long, digest binary, n long, listed array<struct<code: long, parts: int>>"
    return documents.select("doc_id", text_bytes().alias("text")).where("doc_id is not null").mapInArrow(run, schema)


def may_share(n: str, pos: str, m: str, place: str, percent: int) -> Column:
    """Whether sets of n and m shingles that share the one at pos and place, and none before, can link."""
    return F.expr(f"{100 + percent} * least({n} - {pos}, {m} - {place}) >= {percent} * ({n} + {m})")


def index_lists(documents: DataFrame, nodes: DataFrame, counts: np.ndarray, percent: int, part_entries: int = LIST) -> DataFrame:
    """Entries (code, part, parts, node, n, pos) of lists with more than one set, and the smallest set of
    the entry's part of the list as its hub, null where it cannot link."""
    prefixes = listed_prefixes(documents, counts, percent, part_entries)
    named = prefixes.join(nodes.select("digest", "doc_id", "node"), ["digest", "doc_id"]).select(
        "node", F.col("n").cast("int").alias("n"), F.posexplode("listed").alias("pos", "e")
    )
    entries = named.select(
        F.col("e.code"), "node", "n", "pos", F.col("e.parts").alias("parts"),
        F.pmod(F.xxhash64("node"), F.col("e.parts")).cast("int").alias("part"),
    )
    part = Window.partitionBy("code", "part")
    listed = entries.withColumn("first", F.min(F.struct("node", "n", "pos")).over(part)).withColumn(
        "last", F.max("node").over(part)
    )
    hub = F.when(
        (F.col("first.node") < F.col("node")) & may_share("n", "pos", "first.n", "first.pos", percent), F.col("first.node")
    )
    return stored(
        listed.where("first.node < last or parts > 1").select("code", "part", "parts", "node", "n", "pos", hub.alias("hub"))
    )


def with_bits(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes and parity bitmaps leave a link possible."""
    left = nodes.select(F.col("node").alias("u"), F.col("n").alias("a"), F.col("bits").alias("x"))
    right = nodes.select(F.col("node").alias("v"), F.col("n").alias("b"), F.col("bits").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (2, 3))
            allowed = (a + b - 2 * least_common(a, b, percent)).tolist()
            bits = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), allowed, strict=True)
            keep = pa.array([most >= 0 and differing_bits(x, y) <= most for x, y, most in bits], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["u", "v"])

    near = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b", "x", "y")
    return near.mapInArrow(run, "u long, v long")


def full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, codes) of the wanted nodes (node, doc_id, digest), read again from their texts."""
    words = WordCodes()
    texts = documents.select("doc_id", text_bytes().alias("text")).join(wanted.select("doc_id", "node", "digest"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_stretches(batches, 0):
            nodes, sets = [], []
            found = words.shingle_sets(batch.column(0), SIZE)
            for codes, node, digest in zip(found, *(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                if digest_of(codes) == digest:
                    nodes.append(node)
                    sets.append(codes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "codes"])

    return stored(texts.select("text", "node", "digest").mapInArrow(run, "node long, codes binary").distinct())


def codes_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two ordered sets, looking up the smaller one in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    places = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(places, len(b) - 1)] == a))


def compared_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of a node and its hub: whether they link, and for a highly similar hub what the node
    lacks (minus) and has beyond it (plus)."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("codes").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("codes").alias("b")), "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, alike, minus, plus = [], [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own, hub = codes_of(x), codes_of(y)
                common = shared(own, hub)
                union = len(own) + len(hub) - common
                linked.append(100 * common >= percent * union)
                alike.append(100 * common >= ALIKE * union)
                minus.append(np.setdiff1d(hub, own, True).tobytes() if alike[-1] else None)
                plus.append(np.setdiff1d(own, hub, True).tobytes() if alike[-1] else None)
            columns = [pa.array(linked, pa.bool_()), pa.array(alike, pa.bool_()), pa.array(minus, pa.binary()), pa.array(plus, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["u", "v", "linked", "alike", "minus", "plus"])

    schema = "u long, v long, linked boolean, alike boolean, minus binary, plus binary"
    return stored(both.select("u", "v", "a", "b").mapInArrow(run, schema))


def block_pairs(n: np.ndarray, pos: np.ndarray, label: np.ndarray, part: np.ndarray, one_part: bool, percent: int) -> Iterator[tuple]:
    """Places (i, j) of entries of one list, in order of size and position, that may link and have different
    labels. Blocks are skipped by size, by position, and where all of both have one label."""
    starts = np.arange(0, len(n), BLOCK)
    most = [n[s : s + BLOCK].max() for s in starts]
    first = [pos[s : s + BLOCK].min() for s in starts]
    labels = [(label[s : s + BLOCK].min(), label[s : s + BLOCK].max()) for s in starts]
    for x, s in enumerate(starts):
        left = slice(s, s + BLOCK)
        for y in range(x, len(starts)):
            right = slice(starts[y], starts[y] + BLOCK)
            if 100 * most[x] < percent * n[starts[y]]:
                break
            if (100 + percent) * min(most[x] - first[x], most[y] - first[y]) < percent * (n[s] + n[starts[y]]):
                continue
            if labels[x][0] == labels[x][1] == labels[y][0] == labels[y][1]:
                continue
            a, b = n[left][:, None], n[right]
            rest = np.minimum(a - pos[left][:, None], b - pos[right])
            fits = ((100 + percent) * rest >= percent * (a + b)) & (label[left][:, None] != label[right])
            if not one_part:
                fits &= part[left][:, None] != part[right]
            i, j = np.nonzero(fits)
            if x == y:
                i, j = i[i < j], j[i < j]
            yield i + s, j + starts[y]


def listed_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v), u < v, of entries (code, part, parts, node, n, pos, label) of one list that the
    block and position filters pass and whose labels differ. A list in parts is taken by pairs of parts."""
    many = entries.where("parts > 1").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    spread = entries.where("parts = 1").select("*", F.col("part").alias("other")).unionByName(many)
    keyed = spread.select(
        "code", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "n", "pos", "node", "label", "part"
    )
    ordered = keyed.repartition("code", "low", "high").sortWithinPartitions("code", "low", "high", "n", "pos", "node")

    def pairs_of(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        code, low, high, n, pos, node, label, part = columns
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(code)))
        found = [short_pairs(starts, lengths, n, pos, label, low == high, part, percent)]
        for s, length in zip(starts[lengths > BLOCK].tolist(), lengths[lengths > BLOCK].tolist(), strict=True):
            e = s + length
            for i, j in block_pairs(n[s:e], pos[s:e], label[s:e], part[s:e], low[s] == high[s], percent):
                found.append((i + s, j + s))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        once = np.unique(np.stack([u, v], 1)[u != v], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            # The last list may go on in the next batch.
            last = np.ones(len(columns[0]), bool)
            for c in columns[:3]:
                last &= c == c[-1]
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield pairs_of([c[:cut] for c in columns])
            kept = [c[cut:] for c in columns]
        if kept is not None and len(kept[0]):
            yield pairs_of(kept)

    return ordered.mapInArrow(run, "u long, v long").distinct()


def short_pairs(starts, lengths, n, pos, label, one_part, part, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs in all short lists at once, by their distance in the list."""
    short = lengths <= BLOCK
    end = np.repeat(np.where(short, starts + lengths, 0), lengths)
    active = np.flatnonzero(np.arange(len(n)) + 1 < end)
    distance, left, right = 1, [], []
    while len(active):
        other = active + distance
        near = 100 * n[active] >= percent * n[other]
        active, other = active[near], other[near]
        rest = np.minimum(n[active] - pos[active], n[other] - pos[other])
        fits = ((100 + percent) * rest >= percent * (n[active] + n[other])) & (label[active] != label[other])
        fits &= one_part[active] | (part[active] != part[other])
        left.append(active[fits])
        right.append(other[fits])
        distance += 1
        active = active[active + distance < end[active]]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


ANSWERS = "hub long, other long, kind int, node long, n long, m long, x binary, y binary"


def derived_links(pairs: DataFrame, hubs: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (u, v). u's answer follows from its hub's: both sets of (hub, v) are met once,
    then every u of that hub is answered by what it lacks and has beyond the hub."""
    alike = hubs.where("alike").select("u", F.col("v").alias("hub"), "minus", "plus")
    sizes = nodes.select("node", "n")
    asked = (
        pairs.join(alike, "u", "left")
        .join(sizes.select(F.col("node").alias("u"), "n"), "u")
        .join(sizes.select(F.col("node").alias("v"), F.col("n").alias("m")), "v")
        .select(
            F.coalesce("hub", "u").alias("hub"), F.col("v").alias("other"), F.lit(1).alias("kind"), F.col("u").alias("node"),
            "n", "m", F.col("minus").alias("x"), F.col("plus").alias("y"),
        )
    )
    asked = stored(asked)
    none = F.lit(None).cast("long")
    heads = (
        asked.select("hub", "other").distinct()
        .join(sets.select(F.col("node").alias("hub"), F.col("codes").alias("x")), "hub")
        .join(sets.select(F.col("node").alias("other"), F.col("codes").alias("y")), "other")
        .select("hub", "other", F.lit(0).alias("kind"), none.alias("node"), none.alias("n"), none.alias("m"), "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other, common = np.empty(0, np.uint64), 0
        for batch in batches:
            found = []
            for _, v, kind, node, n, m, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    other = codes_of(y)
                    common = shared(codes_of(x), other)
                    continue
                both = common
                if x is not None:
                    both += shared(codes_of(y), other) - shared(codes_of(x), other)
                if 100 * both >= percent * (n + m - both):
                    found.append((node, v))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    rows = heads.unionByName(asked).repartition("hub", "other").sortWithinPartitions("hub", "other", "kind")
    return stored(rows.select(*(f.split()[0] for f in ANSWERS.split(", "))).mapInArrow(run, "u long, v long"))


class Join:
    """The tables that a join of one corpus goes through."""

    def __init__(self, documents: DataFrame, percent: int = 80, part_entries: int = LIST):
        self.documents, self.percent = documents, percent
        rows = stored(signed_rows(documents).withColumn("row", F.monotonically_increasing_id()))
        self.rows = rows.where("piece is null").select("row", "doc_id", "n_shingles", "digest", "bits")
        known = self.rows.where("doc_id is not null and n_shingles > 0")
        #: Different sets: a set's node is its smallest row, doc_id its smallest document.
        self.nodes = stored(
            known.groupBy("digest").agg(
                F.min("row").alias("node"),
                F.min("doc_id").alias("doc_id"),
                F.min("n_shingles").alias("n"),
                F.min("bits").alias("bits"),
            )
        )
        self.lists = index_lists(documents, self.nodes, slot_counts(rows), percent, part_entries)

    def sets_of(self, *nodes: DataFrame) -> DataFrame:
        wanted = nodes[0].select(F.col(nodes[0].columns[0]).alias("node"))
        for more in nodes[1:]:
            wanted = wanted.union(more.select(F.col(more.columns[0]).alias("node")))
        return full_sets(self.documents, self.nodes.join(wanted.distinct(), "node", "left_semi"))

    def verified(self, pairs: DataFrame, hubs: DataFrame, sets: DataFrame | None) -> DataFrame:
        """The links among candidate pairs; sets: full sets that are at hand."""
        near = stored(with_bits(pairs, self.nodes, self.percent))
        based = hubs.where("alike").select("u", F.col("v").alias("hub"))
        needed = near.select("v").union(near.join(based, "u", "left").select(F.coalesce("hub", "u")))
        if sets is None:
            return derived_links(near, hubs, self.sets_of(needed), self.nodes, self.percent)
        fresh = stored(needed.distinct().join(sets.select(F.col("node").alias("v")), "v", "left_anti"))
        more = sets.unionByName(self.sets_of(fresh))
        return derived_links(near, hubs, more, self.nodes, self.percent)

    def hubs(self) -> tuple[DataFrame, DataFrame]:
        """Each node's hub compared in full (see `compared_hubs`), and the full sets this took."""
        met = self.lists.where("hub is not null").groupBy(F.col("node").alias("u"), F.col("hub").alias("v")).agg(F.count("*").alias("times"))
        best = met.groupBy("u").agg(F.max_by("v", F.struct("times", -F.col("v"))).alias("v"))
        near = stored(with_bits(best, self.nodes, self.percent))
        sets = self.sets_of(near.select("u"), near.select("v"))
        return compared_hubs(near, sets, self.percent), sets

    def links(self) -> DataFrame:
        """All links (u, v) between different sets, as nodes."""
        hubs, sets = self.hubs()
        candidates = listed_pairs(self.lists.select("*", F.col("node").alias("label")).drop("hub"), self.percent)
        return self.verified(candidates, hubs, sets)

    def joined(self) -> DataFrame:
        """(node, component) with all links followed, where pairs inside a component are not looked at."""
        hubs, sets = self.hubs()
        # Texts of one document reach each other.
        known = self.rows.where("doc_id is not null and n_shingles > 0").select("doc_id", "digest").distinct()
        several = known.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1")
        texts = known.join(several, "doc_id").join(self.nodes.select("digest", "node"), "digest")
        same = texts.groupBy("doc_id").agg(F.min("node").alias("v")).join(texts.select("doc_id", "node"), "doc_id")
        certain = hubs.where("linked").select("u", "v").unionByName(same.select(F.col("node").alias("u"), "v"))
        labels = components(certain)

        named = self.lists.drop("hub").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        whole = Window.partitionBy("code", "part")
        open_lists = (
            named.withColumn("least", F.min("label").over(whole))
            .withColumn("most", F.max("label").over(whole))
            .where("least <> most or parts > 1")
            .drop("least", "most")
        )
        more = self.verified(listed_pairs(open_lists, self.percent), hubs, sets)
        return labels if more.isEmpty() else components(certain.unionByName(more))


def linked_sets(documents: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links (u, v) between different sets, and the membership (doc_id, node) of documents in sets."""
    join = Join(documents, percent)
    members = join.rows.join(join.nodes.select("digest", "node"), "digest").where("doc_id is not null")
    return join.links(), members.select("doc_id", "node").distinct()


def joined(documents: DataFrame, percent: int = 80, part_entries: int = LIST) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    join = Join(documents, percent, part_entries)
    named = join.nodes.join(join.joined(), "node", "left").select(
        "digest", "doc_id", F.coalesce("component", "node").alias("component")
    )
    named = stored(named)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = named.select("digest", "component").join(least, "component").select("digest", "component_id")
    empty = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return (
        join.rows.join(found, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", empty)).alias("component_id"))
    )


SQL = r"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS id, doc_id,
           list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), sets AS (
    SELECT id, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
               WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
    FROM texts
), nodes AS (
    SELECT min(doc_id) AS node, list_sort(shingles) AS shingles FROM sets WHERE len(shingles) > 0 GROUP BY list_sort(shingles)
), held AS (
    SELECT node, len(shingles) AS n, unnest(shingles) AS shingle FROM nodes
), common AS (
    SELECT a.node AS u, b.node AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
    FROM held a JOIN held b ON a.shingle = b.shingle AND a.node < b.node GROUP BY a.node, b.node
), links AS (
    SELECT u, v FROM common WHERE 100 * c >= 80 * (n + m - c)
    UNION SELECT n.node, s.doc_id FROM sets s JOIN nodes n ON n.shingles = list_sort(s.shingles)
), both_ways AS (
    SELECT u, v FROM links UNION SELECT v, u FROM links
), reach AS (
    SELECT u, u AS v FROM both_ways
    UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON b.u = r.v
), least AS (
    SELECT u, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN least ON u = doc_id
"""
