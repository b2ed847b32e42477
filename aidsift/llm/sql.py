"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from .importance import BUCKETS
from .line_rules import MAX_REPEAT, MAX_SHARE, MIN_DOCS, MIN_LEFT, MIN_WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
WORD_11 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _crc32(blob: str, table: str) -> str:
    """CRC-32 of a blob, folded over its bytes by ``table``, the list of the 256 one-byte remainders."""
    each = f"list_transform(range(1, 2 * octet_length({blob}), 2), lambda i: CAST('0x' || substr(hex({blob}), i, 2) AS BIGINT))"
    return (f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {each}), "
            f"lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1])))")


_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

OP11 = rf"""
WITH RECURSIVE crc_steps AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, {_STEP}, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT i, c AS v FROM crc_steps WHERE k = 8),
texts AS (
  SELECT 0 AS target, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_11}') AS w FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_11}') FROM benchmark),
feats AS (
  SELECT target, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
counted AS (SELECT target, r, f, count(*) AS n FROM feats GROUP BY ALL),
distinct_feats AS (SELECT DISTINCT f, encode(f) AS b FROM counted),
crc_list AS (SELECT list(v ORDER BY i) AS tab FROM crc_table),
buckets AS (SELECT f, {_crc32('b', 'tab')} % {BUCKETS} AS bucket FROM distinct_feats, crc_list),
sums AS (SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM counted JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT CAST(sum(coalesce(s, 0)) AS DOUBLE) AS S1, CAST(sum(coalesce(t, 0)) AS DOUBLE) AS T1 FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (S1 + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (T1 + {BUCKETS})))) AS BIGINT) AS g
          FROM sums, totals),
weights AS (SELECT r, CAST(sum(n * g) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS m FROM counted JOIN buckets USING (f) JOIN gains USING (bucket)
            WHERE target = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(m, 0) AS n_features,
         coalesce((total - ((total % m) + m) % m) // m, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM texts LEFT JOIN weights USING (r) WHERE target = 0),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) AS place,
                  count(*) OVER (PARTITION BY n_words >= 20) AS many FROM final)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND place <= 25 * many // 100 THEN place END AS rank FROM placed"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
grams AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (r, g), range(5) t(k) GROUP BY r),
lines AS (
  SELECT r, host, text, l, array_to_string(regexp_extract_all(translate(l, '{UPPER}', '{LOWER}'), '{WORD}'), ' ') AS norm, len(regexp_extract_all(l, '{WORD}')) AS n
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}')),
dups AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
frequent AS (SELECT host, norm FROM lines JOIN hosts USING (host) GROUP BY host, norm, docs
             HAVING count(DISTINCT text) > {MIN_DOCS} AND 100 * count(DISTINCT text) > {MAX_SHARE} * docs),
gone AS (SELECT r, sum(n) AS n FROM lines JOIN frequent USING (host, norm) GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(w) - coalesce(gone.n, 0) AS n_left
  FROM d LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_left AS BIGINT) AS n_left,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words)
         AND NOT (n_left < {MIN_WORDS} OR 100 * n_left < {MIN_LEFT} * n_words) AS kept
FROM base"""

ORACLES = {"op11_importance_resampling": OP11, "op12_quality_rules": OP12}
