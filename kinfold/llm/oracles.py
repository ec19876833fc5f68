"""DuckDB statements of the training-data operators that SQL can express whole."""

from __future__ import annotations

from kinfold.llm import quality, topk

#: Integer products stay below 2^53 here, so sums of doubles are exact.
TOP_K = f"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id))
WHERE rank <= 10"""

_RATES = {
    "symbol_rate": "1000 * n_symbols // greatest(n_words, 1)",
    "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)",
    "word_length": "100 * word_chars // greatest(n_words, 1)",
    "upper_rate": "1000 * n_upper // greatest(word_chars, 1)",
}
_LONG = "\nUNION ALL\n".join(
    f"SELECT doc_id, lang, source, n_words, '{name}' AS rate, CAST({value} AS BIGINT) AS value, {quality.SLACK[name]} AS slack FROM m"
    for name, value in _RATES.items()
)
QUALITY = rf"""WITH t AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, words[i:i + 4] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t)),
repeats AS (
  SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS w FROM
    (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM grams) WHERE times > 1)
  GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^{quality.SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(body) - length(regexp_replace(body, '\p{{Lu}}+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN repeats USING (doc_id)),
rates AS MATERIALIZED ({_LONG}),
cells AS MATERIALIZED (
  SELECT lang, source, rate, slack, (((value >> b) + 1) << b) - 1 AS edge, count(*) AS n
  FROM (SELECT *, greatest(0, length(ltrim(CAST(CAST(value AS BIT) AS VARCHAR), '0')) - 6) AS b FROM rates WHERE n_words > 0)
  GROUP BY ALL),
whole AS (
  SELECT lang, rate, edge, sum(n) OVER (PARTITION BY lang, rate ORDER BY edge) AS below,
    sum(n) OVER (PARTITION BY lang, rate) AS n
  FROM (SELECT lang, rate, edge, sum(n) AS n FROM cells GROUP BY ALL)),
groups AS (SELECT lang, source, rate, slack, sum(n) AS n FROM cells GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, g.rate, g.slack, w.edge,
    (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source, g.rate ORDER BY w.edge)
      + {quality.PRIOR}::DOUBLE * w.below / w.n) / (g.n + {quality.PRIOR}) AS share
  FROM groups g JOIN whole w ON g.lang IS NOT DISTINCT FROM w.lang AND g.rate = w.rate
  LEFT JOIN cells c ON c.lang IS NOT DISTINCT FROM g.lang AND c.source IS NOT DISTINCT FROM g.source
    AND c.rate = g.rate AND c.edge = w.edge),
limits AS (
  SELECT lang, source, rate, high + greatest({quality.SPREAD}::DOUBLE * (high - low), slack) AS fence FROM (
    SELECT lang, source, rate, slack, min(edge) FILTER (share >= 0.25 - 1e-9) AS low,
      min(edge) FILTER (share >= 0.75 - 1e-9) AS high FROM shares GROUP BY ALL)),
verdict AS (
  SELECT doc_id, bool_and(coalesce(value <= fence, false)) AS within FROM rates r LEFT JOIN limits l
    ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source AND r.rate = l.rate
  GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND within AS kept
FROM (SELECT *, n_words < {quality.MIN_WORDS}
  OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m) JOIN verdict USING (doc_id)"""

ORACLES: dict[str, str] = {"op6_exact_top_k": TOP_K, "op10_quality_rules": QUALITY}
