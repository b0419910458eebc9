"""DuckDB statements for the training-data queries that SQL can express."""

_BEST = r"""
WITH f AS (
  SELECT *, regexp_replace(cik, '[^0-9]', '', 'g') AS num, regexp_replace(accession_number, '[^0-9]', '', 'g') AS acc, trim(end_date) AS ed
  FROM financial_facts
), k AS (
  SELECT CASE WHEN length(num) >= 10 THEN num ELSE lpad(num, 10, '0') END AS k_cik, trim(regexp_replace(concept, '^.*:', '')) AS k_concept, upper(trim(unit)) AS k_unit,
    fiscal_year AS k_year, fact_id, value, entity_name, accession_number,
    coalesce(starts_with(form, '10-K'), false) AS annual,
    CASE WHEN regexp_matches(ed, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(replace(left(ed, 10), '-', '') AS BIGINT) WHEN regexp_matches(ed, '^[0-9]{8}') THEN CAST(left(ed, 8) AS BIGINT) ELSE -1 END AS day,
    CASE WHEN length(acc) = 18 THEN CAST(right(acc, 8) AS BIGINT) ELSE -1 END AS filing,
    value IS NOT NULL AND NOT isnan(value) AS has_value, entity_name IS NOT NULL AND trim(entity_name) <> '' AS has_entity
  FROM f WHERE num <> '' AND concept IS NOT NULL AND unit IS NOT NULL AND fiscal_year IS NOT NULL AND fact_id IS NOT NULL
), r AS (
  SELECT *, row(annual, day, filing, fact_id) AS o FROM k
)
SELECT k_cik AS cik, k_concept AS concept, k_unit AS unit, k_year AS fiscal_year, arg_max(fact_id, o) AS fact_id,
  coalesce(arg_max(fact_id, o) FILTER (has_value), 0) AS value_fact_id, coalesce(arg_max(fact_id, o) FILTER (has_entity), 0) AS entity_fact_id, coalesce(arg_max(fact_id, o) FILTER (filing >= 0), 0) AS accession_fact_id
FROM r GROUP BY ALL HAVING count(DISTINCT fact_id) > 1
"""

_FIELDS = {"value": "has_value", "entity_name": "has_entity", "accession_number": "filing >= 0", "end_date": "day >= 0", "form": "trim(form) <> ''", "fiscal_period": "trim(fiscal_period) <> ''"}
_SURVIVORS = _BEST[: _BEST.index("SELECT k_cik AS cik")].replace("value, entity_name, accession_number,", "value, entity_name, accession_number, end_date, form, fiscal_period,", 1) + (
    "SELECT k_cik AS cik, k_concept AS concept, k_unit AS unit, k_year AS fiscal_year, arg_max(fact_id, o) AS fact_id, "
    + ", ".join(f"arg_max({f}, o) FILTER ({has}) AS {f}, coalesce(arg_max(fact_id, o) FILTER ({has}), 0) AS {f}_fact_id" for f, has in _FIELDS.items())
    + " FROM r GROUP BY ALL"
)

_TOP = """
WITH c AS (SELECT query_id, chunk_id, score, rank FROM retrieved_chunks WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, rank ASC NULLS LAST) AS r FROM c),
t AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank ASC NULLS LAST, chunk_id) AS place FROM b WHERE r = 1)
SELECT query_id, CAST(place AS INTEGER) AS place, chunk_id FROM t WHERE place <= 10
"""

_LOG = """
WITH q AS (SELECT DISTINCT ON (query_id) query_id, lower(trim(strategy)) AS strategy, strftime(created_at, '%Y-%m-%d') AS log_day, latency_ms, groundedness FROM query_log WHERE query_id IS NOT NULL),
m AS (
  SELECT log_day, strategy, 'latency_ms' AS measure, latency_ms AS v FROM q WHERE strategy <> '' AND latency_ms >= 0 AND NOT isnan(latency_ms)
  UNION ALL SELECT log_day, strategy, 'groundedness', groundedness FROM q WHERE strategy <> '' AND groundedness BETWEEN 0 AND 1
)
"""

_FOUND = _LOG + """
SELECT log_day, strategy, measure FROM m GROUP BY ALL
HAVING (measure = 'latency_ms' AND quantile_disc(v, 0.95) > 1500) OR (measure = 'groundedness' AND quantile_disc(v, 0.1) < 0.5)
"""

_PERCENTILES = _LOG + """, a AS (SELECT * FROM m UNION ALL SELECT 'all', strategy, measure, v FROM m),
g AS (SELECT log_day, strategy, measure, list_sort(list(v)) AS vs, count(*) AS n FROM a GROUP BY ALL)
SELECT log_day, strategy, measure, p, n, vs[greatest(1, CAST(ceil(p * n - 1e-9) AS BIGINT))] AS value FROM g, (SELECT unnest([0.1, 0.5, 0.9, 0.95, 0.99])::DOUBLE AS p)
"""

SQL = {"p2_found": _BEST, "p2_survivors": _SURVIVORS, "p3_found": _TOP, "p5_found": _FOUND, "p5_percentiles": _PERCENTILES}

# all pairs that share a shingle, counted: exact, and feasible for the small tables only
_SHARED = r"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT chunk_id, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM c),
s AS (SELECT chunk_id, text, w, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
"""

SQL["p4_found"] = _SHARED + """u AS (SELECT hash(w) AS k, chunk_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, a.k AS ka, b.k AS kb, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT DISTINCT x AS chunk_id_a, y AS chunk_id_b FROM p WHERE shared >= 0.6 * (n + m - shared) - 1e-9
"""

SQL["p4_links"] = _SHARED + """r AS (SELECT text, min(chunk_id) AS rep FROM c GROUP BY 1), u AS (SELECT r.rep, any_value(len(s)) AS n, unnest(any_value(s)) AS g FROM s JOIN r USING (text) GROUP BY r.rep, text),
p AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL)
SELECT x AS chunk_id_a, y AS chunk_id_b, round(shared / (n + m - shared), 9) AS similarity FROM p WHERE shared >= 0.6 * (n + m - shared) - 1e-9
"""

SQL["p4_members"] = """
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)
SELECT chunk_id, min(chunk_id) OVER w AS rep, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY text)
"""
