"""SQL of the queries that SQL can express; the others rest on tokenizers, trained models, hashes or a search."""

from __future__ import annotations

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_INTEGERS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"

HARD_NEGATIVES = f"""
WITH moved AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTEGERS} AS v
    FROM embeddings WHERE {_WHOLE} AND label IS NOT NULL
),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
           CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
    FROM moved a JOIN moved r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
),
positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def _vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Each round assigns all parts and means them; a last assignment gives the codes."""
    distance = "list_sum(list_transform(range(1, len(s.v) + 1), lambda i: (s.v[i] - b.v[i]) * (s.v[i] - b.v[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        near{r} AS (
            SELECT vec_id, p, any_value(s.v) AS v, CAST(min({distance} * {entries} + e) AS BIGINT) AS best
            FROM split s JOIN book{r} b USING (p) GROUP BY vec_id, p
        )""")
        if r < rounds:
            steps.append(f"""
            mean{r} AS (
                SELECT p, e, list(c ORDER BY i) AS v FROM (
                    SELECT p, best % {entries} AS e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS c
                    FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM near{r}) GROUP BY ALL
                ) GROUP BY p, e
            ),
            book{r + 1} AS (
                SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e
            )""")
    return f"""
    WITH kept AS (SELECT vec_id, label, {_INTEGERS} AS v FROM embeddings WHERE {_WHOLE}),
    split AS (
        SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v
        FROM (SELECT *, unnest(range({parts})) AS p FROM kept)
    ),
    book0 AS (
        SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, v FROM split
        QUALIFY e < {entries}
    ),{",".join(steps)},
    coded AS (
        SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code,
               CAST(sum(best // {entries}) AS BIGINT) AS error
        FROM near{rounds} GROUP BY vec_id
    ),
    digest AS (
        SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), digest
    """


ORACLES: dict[str, str] = {"op11_hard_negatives": HARD_NEGATIVES, "op13_vector_codes": _vector_codes()}
