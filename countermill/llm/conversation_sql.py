"""The repair of conversations in SQL, to compare with: recursive queries over rows and over audit letters.

A weight is a text here, the cost in six digits and then the audit letters, so the least text is the
cheapest sequence and of those the ASCII-least. The checksum of a key is worked out bit by bit.
"""

from __future__ import annotations


def _before(letter: str, cost: str, weight: str) -> str:
    return f"lpad(CAST(CAST({weight}[1:6] AS INT) + {cost} AS VARCHAR), 6, '0') || '{letter}' || {weight}[7:]"


def _with_inserts(source: str) -> str:
    """Weights d0 to d3 before inserts to weights w0 to w3, where a message may be inserted first."""
    return f"""
        SELECT conv_id, i, least(d0, {_before("I", "3", "w2")}) AS w0, least(d1, {_before("I", "3", "w2")}) AS w1, w2, w3
        FROM (SELECT *, least(d2, {_before("I", "3", "d3")}) AS w2, least(d3, {_before("I", "3", "d2")}) AS w3 FROM {source})"""


def _choice(state: int, kept: dict[str, int], made: int) -> str:
    keeps = " ".join(f"WHEN '{initial}' THEN w{to}" for initial, to in kept.items())
    keep = _before("K", "extra", f"(CASE initial {keeps} END)")
    return (
        f"least({_before('D', '4', f'w{state}')}, CASE WHEN free THEN least({keep}, {_before('R', '(3 + extra)', f'w{made}')}) END)"
        f" AS d{state}"
    )


SQL = rf"""
WITH RECURSIVE hits AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
                   || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: ascii(ch)::BIGINT)),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))
           ), 4294967295::BIGINT) % 20 AS hit
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
           CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE hit WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM hits WHERE hit <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
    FROM damaged
), faulty AS (
    SELECT *, role[1:1] AS initial,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM placed
), linked AS (
    SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM faulty
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM linked GROUP BY conv_id
), steps AS (
    {_with_inserts("(SELECT conv_id, n AS i, '000000' AS d0, NULL::VARCHAR AS d1, NULL::VARCHAR AS d2, '000000' AS d3 FROM counts)")}
    UNION ALL
    {_with_inserts(f'''(
            SELECT conv_id, i - 1 AS i, {_choice(0, {"s": 1, "u": 2}, 2)}, {_choice(1, {"u": 2}, 2)},
                   {_choice(2, {"a": 3}, 3)}, {_choice(3, {"u": 2}, 2)}
            FROM (SELECT s.*, f.initial, f.fault NOT IN ('blank', 'duplicate') AS free,
                         CASE f.fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra
                  FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.place = s.i))''')}
), decided AS (
    SELECT conv_id, CAST(w0[1:6] AS BIGINT) AS cost, w0[7:] AS audit FROM steps WHERE i = 0
), spelled AS (
    SELECT conv_id, audit, 0 AS k, 0 AS used, 0 AS state, '' AS made FROM decided
    UNION ALL
    SELECT conv_id, audit, k + 1, used + CASE letter WHEN 'I' THEN 0 ELSE 1 END,
           CASE WHEN letter = 'D' THEN state WHEN letter = 'K' AND initial = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
           CASE WHEN letter = 'D' THEN made
                ELSE made || CASE WHEN made = '' THEN '' ELSE chr(10) END
                     || CASE WHEN letter = 'K' THEN role WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':'
                     || CASE WHEN letter = 'I' THEN '' ELSE text END END
    FROM (SELECT s.*, s.audit[s.k + 1:s.k + 1] AS letter, f.initial, f.role, f.text
          FROM spelled s LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.place = s.used + 1
          WHERE s.k < length(s.audit))
), texts AS (
    SELECT conv_id, made FROM spelled WHERE k = length(audit)
), every AS (
    SELECT DISTINCT conv_id FROM conversations
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM every e
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN decided d ON d.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""
