"""Building blocks of the DuckDB statements."""

from __future__ import annotations

from groundline.functions import vocabulary as V


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(text: str, content: bool = False) -> str:
    found = f"regexp_extract_all(lower(coalesce({text}, '')), {lit(V.TOKEN)})"
    if not content:
        return found
    return stems(f"list_filter({found}, lambda x: x NOT IN ({', '.join(map(lit, V.STOPWORDS))}))")


def stems(words: str) -> str:
    irregular = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in V.IRREGULAR.items())
    plural = f"""CASE WHEN length(x) <= 3 OR NOT regexp_full_match(x, '[a-z]+') THEN x ELSE coalesce(CASE x {irregular} END,
      CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN left(x, length(x) - 3) || 'y'
           WHEN x LIKE '%sses' OR (regexp_matches(x, '(ch|sh|x|z|s)es$') AND length(x) > 4) THEN left(x, length(x) - 2)
           WHEN x LIKE '%s' AND NOT regexp_matches(x, '(sis|ss|us|is|ies)$') THEN left(x, length(x) - 1) ELSE x END) END"""

    def cut(n: int, silent: str) -> str:
        bare = f"left(x, length(x) - {n})"
        single = f"CASE WHEN regexp_matches({bare}, '(bb|dd|ff|gg|ll|mm|nn|pp|rr|tt)$') THEN left({bare}, length({bare}) - 1) ELSE {bare} END"
        return f"regexp_replace({single}, '({silent})$', '\\1e')"

    verb = f"""CASE WHEN x LIKE '%ing' AND length(x) > 5 AND regexp_matches(x, '^[a-z]*[aeiouy][a-z]*ing$') THEN {cut(3, "at|iz|bl|us|iv")}
      WHEN x LIKE '%ed' AND length(x) > 4 AND regexp_matches(x, '^[a-z]*[aeiouy][a-z]*ed$') THEN {cut(2, "at|iz|bl|us|iv|s|c")} ELSE x END"""
    return f"list_transform(list_transform({words}, lambda x: {plural}), lambda x: {verb})"


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {lit(V.SOLID + '+')})"


def containment(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct({a})) ELSE 0.0 END"


#: BM25 of the standing queries over all chunks, with headings, stop words dropped, stems: query_id, chunk_id, score.
BM25 = f"""
c AS (SELECT DISTINCT ON (chunk_id) chunk_id, section_heading, text FROM chunks ORDER BY chunk_id, coalesce(doc_id, -9), position),
ct AS (SELECT chunk_id, {tokens("coalesce(section_heading, '') || ' ' || coalesce(text, '')", True)} AS t FROM c),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ct),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM ct) GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens("query", True)}) AS term FROM probe_queries) GROUP BY ALL),
tf AS (SELECT chunk_id, dl, term, count(*) AS f FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM ct) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
hits AS (SELECT query_id, chunk_id, sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term), st GROUP BY ALL HAVING score > 0)
"""

DENSE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL),
hits AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_inner_product(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hits QUALIFY rank <= 25)
"""
