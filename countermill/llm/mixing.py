"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions run here. A source's target is its weight's share of the wanted total, at
most `max_epochs` times its size; what a capped source leaves goes to the others by weight until
none is above its cap. All caps are found in one pass over the sources in order of cap by weight:
a source is capped if it still is when every source before it is.

A source at r times its size takes each document floor(r) times. The rest, a fraction of its words,
is dealt along a seeded order of its documents: each gives all its words until the fraction is
used up, and the document at the border gives a part of its words. The running sum along that order
is taken by buckets of the order first and within a bucket after, so that no source, however large,
is summed in one task.

Defined results: null or empty text: size 0, takes 0. Null source: a source of its own, last in
order. Null doc_id: ordered as an empty id. Repeated rows: each is a row of its own; equal rows may
share a total differently only in which of them is called first. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countermill.llm.common import WORD, stored


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2
) -> DataFrame:
    """(source, source_size) to targets. One row per source is ordered in one place; documents are not."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("wanted", F.sum("source_size").over(everything) * share)
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn(
            "capped",
            F.col("cap") * (F.col("all_weights") - F.col("weights_before"))
            <= F.col("weight") * (F.col("wanted") - F.col("caps_before")),
        )
        .withColumn("caps", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("capped_weights", F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything))
    )
    level = (F.col("wanted") - F.col("caps")) * F.col("weight") / (F.col("all_weights") - F.col("capped_weights"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    bucket_digits: int = 3,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken. bucket_digits: hexadecimal digits of a document's
    seeded key that name its bucket; a bucket of a source is what one task orders."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stored(
        documents.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            F.substring(key, 1, bucket_digits).alias("bucket"),
        )
    )
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(
        buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs
    )
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.source", "b.bucket", "ahead", "source_size", "target", whole.alias("whole"))
        .withColumn("rest", F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size"))
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - so_far))
    return (
        sized.alias("d")
        .join(
            ahead.alias("a"),
            F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.bucket") == F.col("a.bucket")),
        )
        .select("doc_id", "d.source", "d.bucket", "key", "size", "source_size", "target", "whole", "rest", "ahead")
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("whole") * F.col("size") + part).cast("long").alias("taken"),
        )
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken. A document at the border of its source's
    fraction is taken whole once more if at least half of it is, so that no text is cut."""
    copies = F.round(F.sum("taken") / F.sum("size")).cast("int")
    counts = mix(documents, **options).where("taken > 0").groupBy("doc_id").agg(copies.alias("copies")).where("copies > 0")
    whole = documents.select(F.struct("*").alias("d")).alias("w")
    repeated = whole.join(counts.alias("c"), F.col("w.d.doc_id").eqNullSafe(F.col("c.doc_id")))
    return repeated.select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS wanted
  FROM sources
), ordered AS (
  SELECT *, CAST(sum(weight) OVER () AS BIGINT) AS all_weights,
         CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps_before,
         CAST(coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS weights_before
  FROM ranked
), judged AS (
  SELECT *, cap * (all_weights - weights_before) <= weight * (wanted - caps_before) AS capped FROM ordered
), targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE (wanted - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT)) * weight
                   / (all_weights - CAST(sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS BIGINT)) END AS target
  FROM judged
), budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole
  FROM targets
), along AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.whole, b.budget - b.whole * b.source_size AS rest,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS so_far
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(whole * size + least(size, greatest(0, rest - so_far)) AS BIGINT) AS taken
FROM along
"""
