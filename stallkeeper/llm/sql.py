"""The queries that SQL can express, as DuckDB SQL over the same tables.

The others are tested by brute force in tests/llm: BPE, compression, fingerprints, gear hashes,
fitted models, sketches, approximate neighbours, and shards that follow from hashes of Spark's own.
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (
    r"list_filter(string_split_regex(" + _LOWERED + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), "
    "lambda x: x <> '')"
)

LINE_DEDUP = """
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), numbered AS (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM split
), lines AS (
    SELECT doc_id, pos, parts[pos] AS line,
           translate(
               trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM numbered
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS dropped
    FROM lines LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
           AS kept_sha256
FROM judged GROUP BY doc_id
"""

DECONTAMINATION = f"""
WITH d AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (
    SELECT item_id, {_WORDS} AS w FROM benchmark
), item_starts AS (
    SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0
), item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n,
           array_to_string(w[s + 1 : s + 10], ' ') AS content
    FROM item_starts
), sizes AS (
    SELECT DISTINCT n FROM item_windows
), doc_starts AS (
    SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s
    FROM d, sizes WHERE len(w) >= n
), doc_windows AS (
    SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS content FROM doc_starts
), found AS (
    SELECT DISTINCT doc_id, s, n, item_id FROM doc_windows JOIN item_windows USING (n, content)
), places AS (
    SELECT doc_id, unnest(range(s, s + n)) AS place FROM found
), hits AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM places GROUP BY doc_id
), names AS (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found
), leaks AS (
    SELECT doc_id, count(name) AS n_items, string_agg(name, ',' ORDER BY name) AS ids
    FROM names GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN leaks USING (doc_id)
"""


def _vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of assigning every part to every entry and taking means, one after another."""

    def nearest(book: str) -> str:
        return f"""
    SELECT r, p, min({{'d': d, 'e': e}}) AS best
    FROM (SELECT r, p, e, sum((x - c) * (x - c)) AS d FROM points JOIN {book} USING (p, i)
          GROUP BY r, p, e)
    GROUP BY r, p"""

    refined = "".join(
        f"""
), near{n} AS ({nearest(f"book{n}")}
), means{n} AS (
    SELECT p, best.e AS e, i, sum(x) AS s, count(*) AS n FROM points JOIN near{n} USING (r, p)
    GROUP BY p, best.e, i
), book{n + 1} AS (
    SELECT p, e, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c
    FROM book{n} LEFT JOIN means{n} USING (p, e, i)"""
        for n in range(rounds)
    )
    return f"""
WITH kept AS (
    SELECT vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS (
    SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r,
           len(v) // {parts} AS size FROM kept
), places AS (
    SELECT r, v, size, unnest(range(len(v))) AS place FROM numbered
), points AS (
    SELECT r, place // size AS p, place % size AS i, v[place + 1] AS x FROM places
), book0 AS (
    SELECT p, r AS e, i, x AS c FROM points WHERE r < {entries}{refined}
), final AS ({nearest(f"book{rounds}")}
), coded AS (
    SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
           CAST(sum(best.d) AS BIGINT) AS error
    FROM final GROUP BY r
), digest AS (
    SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS books
    FROM book{rounds}
)
SELECT vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       books AS codebooks_sha256
FROM numbered JOIN coded USING (r), digest
"""


VECTOR_CODES = _vector_codes()

LEXICAL_SEARCH = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), sizes AS (
    SELECT count(*) AS docs, sum(len(w)) AS total FROM d WHERE len(w) > 0
), lengths AS (
    SELECT r, doc_id, 25 + (75 * len(w) * docs) // total AS m FROM d, sizes WHERE len(w) > 0
), postings AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
    FROM postings, sizes GROUP BY term, docs
), items AS (
    SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
), wanted AS (
    SELECT item, item_id, term, count(*) AS repeats
    FROM (SELECT item, item_id, unnest(w) AS term FROM items) GROUP BY item, item_id, term
), scores AS (
    SELECT item, item_id, r, doc_id,
           sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
    FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r)
    GROUP BY item, item_id, r, doc_id
), ranked AS (
    SELECT item_id, doc_id, score,
           row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 10
"""
