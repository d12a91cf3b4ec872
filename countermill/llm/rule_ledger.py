"""Quality rules as a ledger of bits: every rule runs once, policies and ablations read the stored bits.

Only DataFrame functions run here. `ledger` measures a text and sets bit r of `failed_bits` if rule r
fails. A policy is a mask of rules under a version; a document is kept if it fails none of them.
Policies and ablations then work on stored bits and never on texts.

Repeated 3-word windows are found by sorting the windows' 64-bit codes with their places inside the
row, so a text stays in its row whatever its length.

Defined results: null text is an empty one: it has no words and fails `few_words`. Repeated rows
and null ids: one ledger row each. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countermill.llm.common import WORD

#: The rules by bit: a name and the condition under which a text fails.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_symbols > 0.3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines"),
    ("shouting", "n_marks > 0.5 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
)
BIT = {name: 1 << place for place, (name, _) in enumerate(RULES)}

#: Rules that a text must pass under a version of the policy. The base is version 1.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "shouting", "short_words", "long_words"),
}


def mask(version: int) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def measurements(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id and what the rules look at."""
    texts = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    words = texts.select(
        "doc_id",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "!?", ""))).cast("long").alias("n_marks"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    kept = ["doc_id", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_words"]
    windows = words.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "n_marks",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("w").cast("long").alias("n_words"),
        F.expr(
            "array_sort(transform(slice(w, 1, greatest(size(w) - 2, 0)),"
            " (x, i) -> struct(xxhash64(x, get(w, i + 1), get(w, i + 2)) as h, i as i)))"
        ).alias("s"),
    )
    places = windows.select(
        *kept,
        F.expr(
            "array_sort(transform(filter(transform(s, (x, k) -> struct("
            "get(s, k - 1).h <=> x.h or get(s, k + 1).h <=> x.h as again, x.i as i)), x -> x.again), x -> x.i))"
        ).alias("p"),
    )
    covered = "aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (a, x) -> a + x)"
    return places.select(*kept, F.expr(covered).cast("long").alias("n_repeat_words"))


def ledger(documents: DataFrame) -> DataFrame:
    """The measurements and the failure bits of all rules."""
    bits = [F.when(F.expr(condition), F.lit(1 << place)).otherwise(0) for place, (_, condition) in enumerate(RULES)]
    total = bits[0].cast("long")
    for bit in bits[1:]:
        total = total.bitwiseOR(bit.cast("long"))
    return measurements(documents).withColumn("failed_bits", total)


def judged(rows: DataFrame, version: int = 2) -> DataFrame:
    """base_failed and kept under a version of the policy."""
    bits = F.col("failed_bits")
    return rows.withColumn("base_failed", bits.bitwiseAND(F.lit(mask(1))) != 0).withColumn(
        "kept", bits.bitwiseAND(F.lit(mask(1) | mask(version))) == 0
    )


def ablations(rows: DataFrame, version: int = 2) -> DataFrame:
    """Per rule of the policy: documents it fails, and those it alone fails (kept without it). The
    ledger is first counted by its bits, of which there are 2 to the number of rules at most."""
    wanted = mask(version)
    by_bits = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(wanted)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[version]])
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        by_bits.withColumn("r", F.explode(rules))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        )
    )


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM t
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), again AS (
  SELECT r, unnest([i, i + 1, i + 2]) AS i
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i) AS n FROM again GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS BIGINT) AS n_marks,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c USING (r)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
            + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
            + (CASE WHEN n_symbols > 0.3 * n_words THEN 4 ELSE 0 END)
            + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END)
            + (CASE WHEN n_marks > 0.5 * n_words THEN 16 ELSE 0 END)
            + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
            + (CASE WHEN word_chars > 25 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits, base_failed,
       failed_bits = 0 AS kept
FROM b
"""
