"""The queries of ``queries.py`` in SQL of a second engine, where SQL can express them."""

from __future__ import annotations

# Fixed value: A-Z in lower case, other letters unchanged.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Words of the near-duplicate contract.
SPACED_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

SHINGLES = f"""
words AS (SELECT doc_id, {SPACED_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
    FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM grams a JOIN grams b ON a.g = b.g
    WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
"""

OP4 = f"""
WITH RECURSIVE {SHINGLES}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c USING (doc_id)
"""

# Words of the decontamination contract.
PLAIN_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WINDOWS = f"""
item_words AS (SELECT item_id, {PLAIN_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size,
           unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                                 lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win
    FROM item_words WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_words AS (SELECT doc_id, {PLAIN_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
doc_windows AS (
    SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS start,
           unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
    FROM doc_words, sizes WHERE len(w) >= size),
found AS (SELECT doc_id, start, d.size, item_id FROM doc_windows d JOIN item_windows i ON d.win = i.win AND d.size = i.size),
places AS (SELECT DISTINCT doc_id, unnest(range(start, start + size)) AS place FROM found),
hit AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM found GROUP BY doc_id)
"""

OP8 = f"""
WITH {WINDOWS}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = f"""
WITH words AS (SELECT doc_id, {SPACED_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 11)) AS start,
           unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS win
    FROM words WHERE len(w) >= 13),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
repeated AS (SELECT doc_id, start FROM windows JOIN firsts USING (win) WHERE first < doc_id),
places AS (SELECT DISTINCT doc_id, unnest(range(start, start + 13)) AS place FROM repeated),
gone AS (SELECT doc_id, list(place) AS gone FROM places GROUP BY doc_id),
kept AS (
    SELECT doc_id, len(w) AS n_words, len(coalesce(gone, [])) AS n_removed,
           CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS k
    FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

# Vector codes: ``assigned`` picks each part's nearest entry, a round replaces entries by floors of means.
ASSIGNED = """
    SELECT vec_id, label, part, v, entry, distance FROM (
        SELECT x.vec_id, x.label, x.part, x.v, c.entry,
               list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS distance,
               row_number() OVER (PARTITION BY x.vec_id, x.part ORDER BY distance, c.entry) AS place
        FROM parts x JOIN {0} c USING (part)) WHERE place = 1"""

ROUND = """
    SELECT c.part, c.entry, CASE WHEN n IS NULL THEN c.v ELSE m.v END AS v
    FROM {0} c LEFT JOIN (
        SELECT part, entry, count(*) AS n, list(m ORDER BY i) AS v FROM (
            SELECT part, entry, i, floor(sum(x)::HUGEINT / count(*))::BIGINT AS m
            FROM (SELECT part, entry, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM {1}) GROUP BY part, entry, i)
        GROUP BY part, entry) m USING (part, entry)"""

OP12 = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS (
    SELECT vec_id, label, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] AS v FROM kept, range(16) p(part)),
book0 AS (
    SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v
    FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
near0 AS ({ASSIGNED.format("book0")}),
book1 AS ({ROUND.format("book0", "near0")}),
near1 AS ({ASSIGNED.format("book1")}),
book2 AS ({ROUND.format("book1", "near1")}),
near2 AS ({ASSIGNED.format("book2")}),
coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error
    FROM near2 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded
"""

# A phrase is its words joined by spaces, which no word holds.
GRAMS_OF = "SELECT lang, {0} AS size, unnest(list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i:i + {0} - 1], ' '))) AS gram FROM w"

GRAM_COUNTS = f"""
pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS ({" UNION ALL ".join(GRAMS_OF.format(n) for n in (1, 2, 3, 4))}),
f AS MATERIALIZED (SELECT lang, size, gram, count(*) AS a FROM grams GROUP BY lang, size, gram),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang)
"""

OP13 = f"""
WITH {GRAM_COUNTS},
candidates AS MATERIALIZED (SELECT lang, size, gram, a, string_split(gram, ' ') AS w FROM f WHERE a >= 30 AND size > 1),
cuts AS (
    SELECT lang, gram, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scores AS (
    SELECT c.lang, c.gram, c.a, c.k, l.a AS l, r.a AS r, (2000000 * c.a::HUGEINT) // (l.a + r.a) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.gram = c.first JOIN f r ON r.lang = c.lang AND r.gram = c.rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
inside AS (
    SELECT lang, array_to_string(w[i:i + part - 1], ' ') AS gram, max(a) AS longer FROM (
        SELECT lang, w, a, part, unnest(range(1, size - part + 2)) AS i
        FROM candidates, range(2, 4) s(part) WHERE part < size) GROUP BY ALL),
left_over AS (
    SELECT c.lang, c.gram AS phrase, a, l, r, score FROM lowest c LEFT JOIN inside i USING (lang, gram)
    WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def llm_reference_sql() -> dict[str, str]:
    return {"op4_minhash_dedup": OP4, "op6_repeated_passages": OP6, "op8_decontamination": OP8, "op12_vector_codes": OP12, "op13_collocations": OP13}
