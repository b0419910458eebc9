"""The registry of core queries and their DuckDB statements."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.config import Settings
from groundline.functions import text as T
from groundline.functions import vocabulary as V
from groundline.operators import answers, chunking, dense, fusion, lexical, metrics, planning, references, relevance, rerank, store
from groundline.plans import evaluate, search, service, sql
from groundline.runtime import materialise, release, shared_dir, table
from groundline.sources import judgements
from groundline.sources.abstracts import parse_articles
from groundline.sources.files import enriched, read_directory, write_markdown
from groundline.sources.filings import list_filings, normalise_cik, split_items, us_gaap_facts
from groundline.sources.html import page_text
from groundline.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
CORE: dict[str, Query] = {}
CORE_SQL: dict[str, str] = {}


def query(statement: str | None = None):
    """Registers a query under its function's name, with its statement if SQL can express it."""

    def register(f: Query) -> Query:
        CORE[f.__name__] = f
        if statement:
            CORE_SQL[f.__name__] = statement
        return f

    return register


# ---------------------------------------------------------------- text


@query(f"SELECT doc_id, len({sql.tokens('text')}) AS n_tokens, len({sql.tokens('text', True)}) AS n_content, len(list_distinct({sql.tokens('text')})) AS n_distinct FROM documents")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text", busy=True).select("doc_id", *[F.size(c).cast("bigint").alias(n) for n, c in (("n_tokens", T.tokens(t)), ("n_content", T.content_tokens(t)), ("n_distinct", F.array_distinct(T.tokens(t))))])


@query(f"WITH w AS (SELECT DISTINCT unnest({sql.tokens('text')}) AS word FROM documents) SELECT word, {sql.stems('[word]')}[1] AS stem FROM w")
def stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents", "text", busy=True).select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query()
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents", "doc_id", "text", busy=True).where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@query()
def normalise_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", busy=True).select("doc_id", T.normalise_whitespace(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5(F.col("t")).alias("digest"))


@query()
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", busy=True).select("doc_id", T.clean_document_text(F.col("text")).alias("text"))
    return chunking.drop_boilerplate(docs, "doc_id", "text").select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("SELECT doc_id, left(sha256(concat_ws('␟', source_type, coalesce(source_file, text))), 16) AS stable_id FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.stable_hash(F.col("source_type"), F.coalesce("source_file", "text")).alias("stable_id"))


_STRIPPED = f"regexp_replace(regexp_replace(raw, {sql.lit('^' + V.BLANK + '+')}, ''), {sql.lit(V.BLANK + '+$')}, '')"


#: Texts that show what the documents of the test tables happen not to hold: metadata in the first characters, recurring lines.
SHOWN = [
    (-1, "Form 10-K\nAnnual report for the fiscal year ended December 31, 2021.\nCentral Index Key: 0001234567\nPage head\nOne\nPage head\nTwo\n  Page head \nThree"),
    (-2, "form 8-k of a company, fiscal year ending in spring 1999, central index key (CIK) 98765 " + "x" * 4000 + " fiscal year ended 2011"),
    (-3, "same\nsame\nother line\nother line\nother line of a long text that has far more than twelve words in it and so stays\nother line\nsame"),
]


def _and_shown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").unionByName(spark.createDataFrame(SHOWN, "doc_id bigint, text string"))


_AND_SHOWN = "(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql.lit(t)})" for i, t in SHOWN) + ") AS x(doc_id, text))"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM {_AND_SHOWN}), s AS (SELECT doc_id, {_STRIPPED} AS line FROM l)
SELECT doc_id, line, count(*) AS n FROM s WHERE line <> '' AND len({sql.words('line')}) <= 12 GROUP BY ALL HAVING count(*) >= 3""")
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.boilerplate_lines(_and_shown(spark, d), "doc_id", "text")


@query(f"""WITH h AS (SELECT doc_id, substring(text, 1, 4000) AS h FROM {_AND_SHOWN})
SELECT doc_id, nullif(regexp_extract(h, {sql.lit(V.FISCAL_YEAR)}, 1), '') AS fiscal_year, upper(nullif(regexp_extract(h, {sql.lit(V.FORM_TYPE)}, 1), '')) AS form_type,
  nullif(regexp_extract(h, '(?:^|[^\\p{{L}}\\p{{N}}_])((?:19|20)\\d{{2}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '') AS first_year FROM h""")
def infer_metadata(spark: SparkSession, d: str) -> DataFrame:
    h = F.substring("text", 1, 4000)
    found = lambda p, g: F.nullif(F.regexp_extract(h, p, g), F.lit(""))
    return _and_shown(spark, d).select("doc_id", found(V.FISCAL_YEAR, 1).alias("fiscal_year"), F.upper(found(V.FORM_TYPE, 1)).alias("form_type"), found(V.YEAR, 0).alias("first_year"))


@query("""SELECT doc_id, CASE source_type
  WHEN 'sec_filing' THEN coalesce(nullif(concat_ws(' - ', nullif(company_name, ''), nullif(form_type, ''), CASE WHEN fiscal_year <> 0 THEN 'FY' || fiscal_year END), ''), nullif(title, ''), CAST(doc_id AS VARCHAR))
  WHEN 'biomedical_abstract' THEN coalesce(nullif(title, ''), CAST(doc_id AS VARCHAR)) || CASE WHEN coalesce(journal, '') <> '' AND publication_year IS NOT NULL THEN ' (' || journal || ', ' || publication_year || ')' ELSE '' END
  ELSE coalesce(nullif(title, ''), CAST(doc_id AS VARCHAR)) END AS label FROM documents""")
def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    from groundline.sources.files import citation_label

    meta = F.struct("title", "company_name", "form_type", "fiscal_year", "journal", "publication_year")
    return table(spark, d, "documents").select("doc_id", meta.alias("m"), "source_type").select("doc_id", citation_label(F.col("source_type"), F.col("m"), F.lit(None).cast("string"), F.col("doc_id").cast("string")).alias("label"))


_SPACES = "[ \\t\\r\\f\\x0b]+"
_BLANK_LINE = V.BLANK.replace(r"\s", r"\t\f\r ").replace("[", "[", 1)


@query(f"""WITH a AS (SELECT doc_id, regexp_replace(text, '{_SPACES}', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^{_BLANK_LINE}+', '', 'g'), '(?m){_BLANK_LINE}+$', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM b)
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(t, '^({_BLANK_LINE}|\\n)+', ''), '({_BLANK_LINE}|\\n)+$', '') AS t FROM c)""")
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    """The white space rules on the texts as they are, without the Unicode normalisation before them."""
    t = table(spark, d, "documents", "doc_id", "text", busy=True).where("text is not null").select("doc_id", T.collapsed(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(r"SELECT doc_id, regexp_replace('postgresql://me:' || doc_id || '@' || coalesce(url, 'db:5432/x'), '(//[^:/@]+):[^@]*@', '\1:***@') AS url FROM documents")
def redacted_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.redact_url(F.concat(F.lit("postgresql://me:"), F.col("doc_id").cast("string"), F.lit("@"), F.coalesce("url", F.lit("db:5432/x")))).alias("url"))


# ---------------------------------------------------------------- sources


@query("""WITH f AS (SELECT *, lpad(regexp_replace(cik, '[^0-9]', '', 'g'), CAST(greatest(10, length(regexp_replace(cik, '[^0-9]', '', 'g'))) AS INTEGER), '0') AS c FROM financial_facts
  WHERE regexp_matches(cik, '[0-9]') AND concept IS NOT NULL AND unit IS NOT NULL AND fact_id IS NOT NULL)
SELECT c AS cik, concept, unit, fiscal_year, CASE WHEN NOT isnan(value) THEN value END AS value, end_date, accession_number FROM f WHERE form LIKE '10-K%' AND fiscal_year IS NOT NULL AND fiscal_period = 'FY'
QUALIFY row_number() OVER (PARTITION BY c, concept, fiscal_year ORDER BY coalesce(end_date, '') DESC, unit DESC, fact_id DESC, accession_number DESC) = 1""")
def facts_transpose(spark: SparkSession, d: str) -> DataFrame:
    """The fact table nested as company facts come (concept, unit, entries), and turned into rows again."""
    f = table(spark, d, "financial_facts").where("cik rlike '[0-9]' and concept is not null and unit is not null and fact_id is not null").withColumn("c", normalise_cik(F.col("cik")))
    entry = F.struct(F.col("fact_id"), F.col("end_date").alias("end"), F.col("value").alias("val"), F.col("accession_number").alias("accn"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), "form")
    f = f.groupBy("c", "concept", "unit").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    units = f.groupBy("c", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "e"))).alias("units"))
    facts = units.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units").alias("b")))).alias("us-gaap"))
    facts = facts.select(F.col("c").alias("cik"), F.lit("x").alias("entityName"), F.struct("us-gaap").alias("facts"))
    concepts = [r[0] for r in table(spark, d, "financial_facts").select("concept").where("concept is not null").distinct().collect()]
    out = us_gaap_facts(facts, concepts)
    return out.select("cik", "concept", "unit", "fiscal_year", F.when(~F.isnan("value"), F.col("value")).alias("value"), "end_date", "accession_number")


@query("""WITH f AS (SELECT *, lpad(regexp_replace(cik, '[^0-9]', '', 'g'), CAST(greatest(10, length(regexp_replace(cik, '[^0-9]', '', 'g'))) AS INTEGER), '0') AS c FROM documents WHERE regexp_matches(cik, '[0-9]')),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS n FROM f WHERE upper(form_type) = '10-K')
SELECT c AS cik, CAST(doc_id AS VARCHAR) AS accession_number, strftime(filing_date, '%Y-%m-%d') AS filing_date,
  'https://www.sec.gov/Archives/edgar/data/' || ltrim(c, '0') || '/' || replace(CAST(doc_id AS VARCHAR), '-', '') || '/' || coalesce(source_file, '') AS document_url FROM r WHERE n <= 3""")
def filings_list(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the column-oriented lists of a company's submissions, and their annual reports as rows, three a company."""
    f = table(spark, d, "documents").where("cik rlike '[0-9]'").withColumn("c", normalise_cik(F.col("cik")))
    key = F.col("doc_id").cast("string")
    row = F.struct("doc_id", key.alias("a"), F.coalesce("form_type", F.lit("")).alias("f"), F.coalesce(F.date_format("filing_date", "yyyy-MM-dd"), F.lit("")).alias("d"), F.coalesce("source_file", F.lit("")).alias("p"))
    g = f.groupBy("c").agg(F.array_sort(F.collect_list(row)).alias("x"))
    recent = F.struct(F.col("x.a").alias("accessionNumber"), F.col("x.f").alias("form"), F.col("x.d").alias("filingDate"), F.col("x.d").alias("reportDate"), F.col("x.p").alias("primaryDocument"))
    s = g.select(F.col("c").alias("cik"), F.lit("n").alias("name"), F.array().cast("array<string>").alias("tickers"), F.struct(recent.alias("recent")).alias("filings"))
    return list_filings(s, ["10-K"], 3).select("cik", "accession_number", F.nullif("filing_date", F.lit("")).alias("filing_date"), "document_url")


@query("""WITH d AS (SELECT doc_id, pmid, publication_year, list_filter(mesh_terms, lambda m: trim(m) <> '') AS mesh FROM documents WHERE source_type = 'biomedical_abstract' AND pmid IS NOT NULL)
SELECT pmid, publication_year, coalesce(len(mesh), 0) AS n_mesh, CAST('Abstract: ' || doc_id || '<&>' AS VARCHAR) AS said, 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' AS url FROM d""")
def abstract_records(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts written as article sets, a thousand texts of markup, and parsed again."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = table(spark, d, "documents").where("source_type = 'biomedical_abstract' and pmid is not null")
    mesh = F.array_join(F.transform(F.coalesce("mesh_terms", F.array().cast("array<string>")), lambda m: F.concat(F.lit("<MeshHeading><DescriptorName>"), esc(m), F.lit("</DescriptorName></MeshHeading>"))), "")
    year = F.coalesce(F.concat(F.lit("<Year>"), F.col("publication_year").cast("string"), F.lit("</Year>")), F.lit(""))
    xml = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), "pmid", F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), year, F.lit("</PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle><Abstract>"),
        F.lit('<AbstractText Label="ABSTRACT">'), F.col("doc_id").cast("string"), F.lit("&lt;&amp;<i>&gt;</i></AbstractText></Abstract></Article><MeshHeadingList>"), mesh, F.lit("</MeshHeadingList></MedlineCitation></PubmedArticle></PubmedArticleSet>"),
    )
    a = parse_articles(docs.select(xml.alias("payload")), "payload")
    said = F.concat(F.col("sections")[0]["heading"], F.lit(": "), F.col("sections")[0]["text"])
    return a.select("pmid", "publication_year", F.size(F.filter("mesh_terms", lambda m: m != "")).alias("n_mesh"), said.alias("said"), "url")


_HEAD = lambda p, g=1: f"nullif(regexp_extract(left(text, 4000), {sql.lit(p)}, {g}), '')"
_FIRST_LINE = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^ +', ''), ' +$', '')), lambda x: x <> '')[1]"


@query(f"""WITH e AS (SELECT doc_id, source_type, company_name, title, text, coalesce(fiscal_year, CASE WHEN source_type = 'sec_filing' THEN CAST({_HEAD(V.FISCAL_YEAR)} AS INTEGER) END) AS fiscal_year,
  coalesce(form_type, CASE WHEN source_type = 'sec_filing' THEN upper({_HEAD(V.FORM_TYPE)}) END) AS form_type, coalesce(cik, CASE WHEN source_type = 'sec_filing' THEN lpad({_HEAD(V.CIK)}, 10, '0') END) AS cik,
  coalesce(publication_year, CASE WHEN source_type = 'biomedical_abstract' THEN CAST(nullif(regexp_extract(left(text, 4000), '(?:^|[^\\p{{L}}\\p{{N}}_])((?:19|20)\\d{{2}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '') AS INTEGER) END) AS publication_year FROM documents)
SELECT doc_id, fiscal_year, form_type, cik, publication_year, coalesce(nullif(title, ''), CASE WHEN source_type = 'sec_filing' AND company_name IS NOT NULL THEN trim(concat_ws(' ', company_name, coalesce(form_type, 'filing'), CAST(fiscal_year AS VARCHAR))) END,
  CASE WHEN length({_FIRST_LINE}) > 120 THEN regexp_replace(left({_FIRST_LINE}, 117), ' [^ ]*$', '') || '...' ELSE {_FIRST_LINE} END, '') AS title FROM e""")
def enriched_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata completed from the first characters of each text, a feature of the operator."""
    meta = F.struct("title", "company_name", "form_type", "fiscal_year", "cik", "publication_year")
    docs = table(spark, d, "documents").select("doc_id", "source_type", "text", meta.alias("metadata"))
    return enriched(docs).select("doc_id", *[f"metadata.{c}" for c in ("fiscal_year", "form_type", "cik", "publication_year", "title")])


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, source_type, title, company_name, CASE WHEN length(trim(cik)) < 10 THEN lpad(trim(cik), 10, '0') ELSE trim(cik) END AS cik, fiscal_year, coalesce(len(authors), 0) AS n_authors
FROM documents WHERE trim(title) <> '' AND (cik IS NULL OR trim(cik) <> '')""")
def markdown_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Titled documents written as Markdown files with front matter, and read again."""
    docs = table(spark, d, "documents").where("trim(title) <> '' and (cik is null or trim(cik) <> '')")
    meta = F.struct("title", "company_name", "cik", "fiscal_year", "authors")
    folder = f"{shared_dir(spark).rstrip('/')}/groundline/{spark.sparkContext.applicationId}/markdown-{uuid.uuid4().hex}"
    write_markdown(docs.select("doc_id", "source_type", F.coalesce("text", F.lit("")).alias("text"), meta.alias("metadata"), F.array().cast("array<struct<heading:string,text:string>>").alias("sections")), folder)
    got, _ = read_directory(spark, folder)
    m = lambda c: F.col(f"metadata.{c}").alias(c)
    return got.select(F.regexp_extract("metadata.source_file", r"^(.*)\.md$", 1).alias("doc_id"), "source_type", m("title"), m("company_name"), m("cik"), m("fiscal_year"), F.size("metadata.authors").alias("n_authors"))


@query("SELECT doc_id, 'Head & <tail> ' || doc_id || ' size ' || coalesce(n_chars, 0) AS words FROM documents")
def html_words(spark: SparkSession, d: str) -> DataFrame:
    """Pages with markup, entities and scripts around each document's numbers, and their text."""
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><style>p {x: 1}</style><script>var a = '<p>no</p>';</script></head><body><h1>Head &amp; &lt;tail&gt;</h1><!-- not this --><div><p><b>"), F.col("doc_id").cast("string"),
        F.lit("</b></p><ul><li>size&nbsp;</li><li>"), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit("</li></ul></div></body></html>"),
    )
    read = F.pandas_udf(lambda pages: pages.map(page_text), "string")
    return table(spark, d, "documents").select("doc_id", F.array_join(T.words(read(page)), " ").alias("words"))


@query("""WITH q AS (SELECT DISTINCT query_id, query, relevant FROM qrels WHERE query_id IS NOT NULL), r AS (SELECT query_id, unnest(relevant) AS r, generate_subscripts(relevant, 1) - 1 AS target FROM q)
SELECT query_id, CAST(target AS INTEGER) AS target, r.document AS document, len(coalesce(r.sections, [])) AS n_sections FROM r""")
def judgement_targets(spark: SparkSession, d: str) -> DataFrame:
    """Judgements written as the one JSON document that a judgement file is, and read again."""
    q = table(spark, d, "qrels").where("query_id is not null").select("query_id", "query", "type", "relevant", "answer_terms").groupBy("query_id", "query", "relevant").agg(F.first("type").alias("type"), F.first("answer_terms").alias("answer_terms"))
    folder = f"{shared_dir(spark).rstrip('/')}/groundline/{spark.sparkContext.applicationId}/judgements-{uuid.uuid4().hex}"
    whole = q.agg(F.to_json(F.struct(F.lit("1").alias("version"), F.collect_list(F.struct("query_id", "query", "type", "relevant", "answer_terms")).alias("queries"))).alias("value"))
    whole.coalesce(1).write.text(folder)
    return judgements.targets(judgements.read_judgements(spark, folder)).select("query_id", "target", "document", F.size("sections").alias("n_sections"))


# ---------------------------------------------------------------- chunks


@query(f"""WITH w AS (SELECT doc_id, text, {sql.words('text')} AS w, list_transform(regexp_split_to_array(text, {sql.lit(V.SOLID + '+')}), lambda g: length(g)) AS g FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, len(w) AS n FROM w WHERE len(w) > 0),
s AS (SELECT *, unnest(CASE WHEN n <= 180 THEN [0] ELSE list_filter(range(0, n, 140), lambda s: s = 0 OR s - 140 + 180 < n) END) AS s FROM n),
e AS (SELECT *, least(s + 180, n) AS e, s // 140 AS position FROM s WHERE s = 0 OR least(s + 180, n) - s >= 40),
b AS (SELECT *, coalesce(list_sum(list_transform(w[1:s], lambda x: length(x))), 0) + list_sum(g[1:s + 1]) AS b FROM e),
c AS (SELECT doc_id, CAST(position AS INTEGER) AS position, CASE WHEN n < 40 THEN text ELSE array_to_string(w[s + 1:e], ' ') END AS t, CASE WHEN n < 40 THEN 0 ELSE b END AS char_start,
  CASE WHEN n < 40 THEN length(text) ELSE b + list_sum(list_transform(w[s + 1:e], lambda x: length(x))) + coalesce(list_sum(g[s + 2:e]), 0) END AS char_end FROM b)
SELECT doc_id, position, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, left(sha256(concat_ws('␟', CAST(doc_id AS VARCHAR), CAST(position AS VARCHAR), substring(t, 1, 64))), 16) AS chunk_id FROM c""")
def fixed_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, d, "documents", "doc_id", "text", busy=True), "doc_id", "text", 180, 40, 40).drop("text")


@query()
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", busy=True).select("doc_id", T.nfkc(F.col("text")).alias("nf"))
    docs = docs.select("doc_id", T.collapsed(F.col("nf")).alias("text"), chunking.markdown_sections(F.col("nf")).alias("sections"))
    return chunking.section_windows(docs, "doc_id", "text", "sections").select("doc_id", "position", "section_heading", "char_start", "char_end", "chunk_id", T.token_count(F.col("text")).alias("tokens"))


@query()
def item_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source_type", "text", busy=True).where("source_type = 'sec_filing' and text is not null").select("doc_id", split_items(F.regexp_replace("text", r"(?m)^#+ *", "")).alias("s"))
    return docs.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.heading", "s.order", F.length("s.text").alias("n_chars"))


@query("""WITH r AS (SELECT DISTINCT doc_id, char_start AS s, char_end AS e FROM chunks WHERE doc_id IS NOT NULL AND char_start IS NOT NULL AND char_end IS NOT NULL),
w AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT doc_id, min(s) AS "start", max(e) AS "end" FROM i GROUP BY doc_id, island""")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "chunks").where("doc_id is not null").select("doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end")).distinct()
    return chunking.merged_ranges(r, "doc_id").select("doc_id", "start", "end")


# ---------------------------------------------------------------- retrieval


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each id once: the one of the lowest document and position (rows delivered twice are equal)."""
    order = Window.partitionBy("chunk_id").orderBy(F.coalesce("doc_id", F.lit(-9)), "position")
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "position", "section_heading", "text")
    return c.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def _described(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source_type", "company_name", "title", "ticker", "journal", "cik", "source_file")
    return _chunks(spark, d).join(docs, "doc_id", "left")


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    hits = lexical.bm25_scores(table(spark, d, "probe_queries"), _chunks(spark, d), "query_id", "query", "chunk_id", lexical.indexed_text(F.col("section_heading"), F.col("text")))
    return lexical.top_k(hits, "query_id", "score", "chunk_id", k)


@query(f"WITH {sql.BM25} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _vectors(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return dense.dense_top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", k)


@query(f"WITH {sql.DENSE} SELECT query_id, vec_id, score, rank FROM top WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, 10)


@query()
def lsi_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", busy=True)
    settings = Settings()
    fitted = dense.latent_of_texts(docs, "doc_id", F.col("text"), settings.embedding, settings.seed)
    asked = materialise(fitted.vectors().where("doc_id % 20 = 0"), "asked")
    found = materialise(fitted.nearest(asked, "doc_id", 5), "nearest")
    fitted.discard()
    return found


@query("""WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 3 * x) AS e FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v)
SELECT vec_id, round(e[1] / n, 6) AS first, round(list_inner_product(e, e) / (n * n), 6) AS norm FROM n""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", dense.l2_normalise(F.transform("embedding", lambda x: 3 * x.cast("double"))).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(dense.cosine(F.col("v"), F.col("v")), 6).alias("norm"))


def _two_lists(spark: SparkSession, d: str, k: int = 50) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "retrieved_chunks").where("query_id is not null and chunk_id is not null")
    best = r.groupBy("query_id", "chunk_id").agg(*[F.max(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("lexical_score", "dense_score")])
    lists = []
    for c in ("lexical_score", "dense_score"):
        scored = best.select("query_id", "chunk_id", F.col(c).alias("score")).where("score is not null" + (" and score > 0" if c == "lexical_score" else ""))
        lists.append(fusion.ranked(scored, "query_id", "chunk_id", k=k))
    return lists[0], lists[1]


_TWO = """b AS (SELECT query_id, chunk_id, max(CASE WHEN NOT isnan(lexical_score) THEN lexical_score END) AS l, max(CASE WHEN NOT isnan(dense_score) THEN dense_score END) AS d
  FROM retrieved_chunks WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
lx AS (SELECT query_id, chunk_id, l, row_number() OVER (PARTITION BY query_id ORDER BY round(l, 9) DESC, chunk_id) AS rank FROM b WHERE l > 0 QUALIFY rank <= 50),
dn AS (SELECT query_id, chunk_id, d, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9) DESC, chunk_id) AS rank FROM b WHERE d IS NOT NULL QUALIFY rank <= 50)"""


@query(f"""WITH {_TWO}, u AS (SELECT query_id, chunk_id, rank FROM lx UNION ALL SELECT query_id, chunk_id, rank FROM dn), f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10""")
def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    f = fusion.reciprocal_rank_fusion(_two_lists(spark, d), "query_id", "chunk_id")
    return fusion.ranked(f, "query_id", "chunk_id", k=10).withColumn("score", F.round("score", 9))


@query(f"""WITH {_TWO}, u AS (SELECT query_id, chunk_id, coalesce(l, 0) AS l, coalesce(d, 0) AS d FROM (SELECT query_id, chunk_id, l FROM lx) FULL JOIN (SELECT query_id, chunk_id, d FROM dn) USING (query_id, chunk_id)),
m AS (SELECT *, min(l) OVER w AS l0, max(l) OVER w AS l1, min(d) OVER w AS d0, max(d) OVER w AS d1 FROM u WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, chunk_id, 0.45 * (CASE WHEN l1 - l0 < 1e-12 THEN 0.0 ELSE (l - l0) / (l1 - l0) END) + 0.55 * (CASE WHEN d1 - d0 < 1e-12 THEN 0.0 ELSE (d - d0) / (d1 - d0) END) AS score FROM m)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10""")
def fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    f = fusion.weighted_fusion(*_two_lists(spark, d), "query_id", "chunk_id")
    return fusion.ranked(f, "query_id", "chunk_id", k=10, digits=6).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_POOLED = _TWO.replace("QUALIFY rank <= 50", "QUALIFY rank <= CASE WHEN ascii(right(query_id, 1)) % 2 = 0 THEN 120 ELSE 50 END")


@query(f"""WITH {_POOLED}, u AS (SELECT query_id, chunk_id, coalesce(l, 0) AS l, coalesce(d, 0) AS d FROM (SELECT query_id, chunk_id, l FROM lx) FULL JOIN (SELECT query_id, chunk_id, d FROM dn) USING (query_id, chunk_id)),
m AS (SELECT *, min(l) OVER w AS l0, max(l) OVER w AS l1, min(d) OVER w AS d0, max(d) OVER w AS d1 FROM u WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, chunk_id, 0.45 * (CASE WHEN l1 - l0 < 1e-12 THEN 0.0 ELSE (l - l0) / (l1 - l0) END) + 0.55 * (CASE WHEN d1 - d0 < 1e-12 THEN 0.0 ELSE (d - d0) / (d1 - d0) END) AS score FROM m)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 30""")
def hybrid_pool(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of both lists, each cut to the query's own pool: 120 deep where it is scoped (here by its id), else 50."""
    own = F.when(F.ascii(F.right("query_id", F.lit(1))) % 2 == 0, 120).otherwise(50)
    lex, den = (fusion.within_pool(hits, own) for hits in _two_lists(spark, d, 120))
    f = fusion.weighted_fusion(lex, den, "query_id", "chunk_id")
    return fusion.ranked(f, "query_id", "chunk_id", k=30, digits=6).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("""WITH b AS (SELECT query_id, chunk_id, max(score) AS score, arg_max(source_type, score) AS st FROM retrieved_chunks WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM b QUALIFY r <= 40),
s AS (SELECT *, coalesce(st = 'biomedical_abstract', false) AS m, max(CASE WHEN st = 'biomedical_abstract' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS hits FROM p)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE m OR hits = 0 QUALIFY rank <= 10""")
def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "retrieved_chunks").where("query_id is not null and chunk_id is not null and score is not null and not isnan(score)")
    b = r.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max_by("source_type", "score").alias("st"))
    pool = fusion.ranked(b, "query_id", "chunk_id", k=40)
    kept = fusion.scope_or_all(pool, "query_id", F.col("st") == "biomedical_abstract", F.lit(True))
    return fusion.ranked(kept, "query_id", "chunk_id", k=10).select("query_id", "chunk_id", "rank")


@query("""WITH b AS (SELECT query_id, chunk_id, retrieved_at, score, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, retrieved_at) AS r FROM retrieved_chunks
  WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieved_at, chunk_id) AS rank FROM b WHERE r = 1 QUALIFY rank <= 10""")
def merge_best(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "retrieved_chunks").where("query_id is not null and chunk_id is not null and score is not null and not isnan(score)").select("query_id", "chunk_id", "score", "retrieved_at")
    return fusion.merge_results(r, "query_id", "chunk_id", "retrieved_at", 10).select("query_id", "chunk_id", "score", "rank")


def _pairs(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    hits = _bm25(spark, d, k).withColumn("lexical_score", F.round("score", 6)).withColumn("dense_score", F.lit(0.0)).withColumn("score", F.col("lexical_score"))
    return hits.join(_chunks(spark, d), "chunk_id").join(table(spark, d, "probe_queries").select("query_id", "query"), "query_id")


_BI = lambda t: f"list_transform(range(1, len({t})), lambda i: {t}[i] || '_' || {t}[i + 1])"


@query(f"""WITH {sql.BM25}, k AS (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 30),
p AS (SELECT k.*, p.query, c.text, {sql.tokens('p.query', True)} AS qt, {sql.tokens('c.text', True)} AS ct2, {sql.tokens('c.section_heading', True)} AS ht,
  regexp_replace(regexp_replace(lower(p.query), '^[? ]+', ''), '[? ]+$', '') AS phrase FROM k JOIN c USING (chunk_id) JOIN probe_queries p USING (query_id)),
b AS (SELECT *, {_BI('qt')} AS qb, {_BI('ct2')} AS cb, list_position(list_transform(ct2, lambda x: list_contains(qt, x)), true) AS pos FROM p)
SELECT query_id, chunk_id, score AS lexical_score, score AS fused_score, round({sql.containment('qt', 'ct2')}, 9) AS query_containment,
  round(CASE WHEN len(qt) > 0 AND len(ct2) > 0 THEN len(list_intersect(qt, ct2)) / len(list_distinct(list_concat(qt, ct2))) ELSE 0.0 END, 9) AS token_jaccard, round({sql.containment('qb', 'cb')}, 9) AS bigram_containment,
  round(CASE WHEN len(ht) > 0 THEN {sql.containment('qt', 'ht')} ELSE 0.0 END, 9) AS heading_match, least(len(ct2) / 200.0::DOUBLE, 2.0::DOUBLE) AS length_ratio,
  round(CASE WHEN coalesce(pos, 0) > 0 THEN (pos - 1) / greatest(len(ct2), 1) ELSE 1.0 END, 9) AS first_match_position, CASE WHEN phrase <> '' AND contains(lower(text), phrase) THEN 1.0::DOUBLE ELSE 0.0 END AS exact_phrase FROM b""")
def rerank_features(spark: SparkSession, d: str) -> DataFrame:
    f = rerank.features(_pairs(spark, d))
    rounded = [F.round(c, 9).alias(c) for c in ("query_containment", "token_jaccard", "bigram_containment", "heading_match", "first_match_position")]
    return f.select("query_id", "chunk_id", "lexical_score", "fused_score", *rounded, "length_ratio", "exact_phrase")


# ---------------------------------------------------------------- judgements and metrics


def _targets(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qrels").select("query_id", F.posexplode("relevant").alias("target", "r"))
    return q.select("query_id", "target", "r.document", F.filter("r.sections", lambda s: s.isNotNull()).alias("sections")).where("document is not null")


def _judged_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").where("source_file is not null").select("doc_id", F.col("source_file").alias("document"))
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "section_heading", "char_start", "char_end").distinct().join(docs, "doc_id")
    spans = c.where("section_heading is not null").groupBy("document", F.col("section_heading").alias("heading")).agg(F.min("char_start").alias("start"), F.max("char_end").alias("end"))
    return c, spans


_RESOLVED = """t AS (SELECT DISTINCT query_id, target, document, sections FROM (SELECT query_id, target - 1 AS target, r.document AS document, coalesce(list_filter(r.sections, lambda s: s IS NOT NULL), []) AS sections
  FROM (SELECT query_id, unnest(relevant) AS r, generate_subscripts(relevant, 1) AS target FROM qrels)) WHERE document IS NOT NULL),
jc AS (SELECT DISTINCT chunk_id, section_heading, char_start, char_end, source_file AS document FROM chunks c JOIN documents d ON c.doc_id = d.doc_id WHERE source_file IS NOT NULL),
sp AS (SELECT document, section_heading AS heading, min(char_start) AS s, max(char_end) AS e FROM jc WHERE section_heading IS NOT NULL GROUP BY ALL),
nm AS (SELECT query_id, target, document, unnest(sections) AS heading FROM t),
rg AS (SELECT query_id, target, document, s, e FROM nm JOIN sp USING (document, heading) WHERE s IS NOT NULL AND e IS NOT NULL),
rw AS (SELECT *, max(e) OVER (PARTITION BY query_id, target, document ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg),
ri AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, target, document ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM rw),
mg AS (SELECT query_id, target, document, min(s) AS s, max(e) AS e FROM ri GROUP BY query_id, target, document, island),
ln AS (SELECT query_id, target, document, sum(e - s) AS n FROM mg GROUP BY ALL),
cv AS (SELECT query_id, target, document, chunk_id, char_start, char_end, sum(greatest(least(char_end, e) - greatest(char_start, s), 0)) AS c FROM mg JOIN jc USING (document) GROUP BY ALL),
rel AS (SELECT query_id, chunk_id FROM cv JOIN ln USING (query_id, target, document) WHERE c / greatest(char_end - char_start, 1) >= 0.4 OR c / greatest(n, 1) >= 0.6
  UNION SELECT query_id, chunk_id FROM t JOIN jc USING (document) WHERE len(sections) = 0
  UNION SELECT query_id, chunk_id FROM nm JOIN jc ON nm.document = jc.document AND nm.heading = jc.section_heading WHERE (query_id, target) NOT IN (SELECT (query_id, target) FROM ln))"""


@query(f"WITH {_RESOLVED} SELECT DISTINCT query_id, chunk_id FROM rel")
def qrels_resolve(spark: SparkSession, d: str) -> DataFrame:
    c, spans = _judged_chunks(spark, d)
    return relevance.resolve(_targets(spark, d), c, spans)


@query(f"WITH {_RESOLVED} SELECT DISTINCT query_id FROM t WHERE query_id NOT IN (SELECT query_id FROM rel)")
def qrels_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return relevance.unresolved(_targets(spark, d), qrels_resolve(spark, d))


def _run(spark: SparkSession, d: str) -> DataFrame:
    """Dense hits with their relevance: vectors of the query's label, the query itself left out of the judgements."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    relevant = asked.join(v, F.col("q_label") == F.col("label")).where("query_id <> vec_id").select("query_id", "vec_id")
    run = _vectors(spark, d, 25).join(v, "vec_id").join(asked, "query_id").select("query_id", "vec_id", "rank", "q_label", (F.length(F.col("vec_id").cast("string")) * 30).alias("tokens"))
    return metrics.judged(run, relevant, "query_id", "vec_id")


_RUN = f"""{sql.DENSE}, rel AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.label = b.label AND a.vec_id <> b.vec_id),
nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
jd AS (SELECT t.query_id, t.vec_id, t.rank, q.label AS q_label, length(CAST(t.vec_id AS VARCHAR)) * 30 AS tokens, CASE WHEN r.vec_id IS NULL THEN 0 ELSE 1 END AS hit, coalesce(n, 0) AS n,
  sum(CASE WHEN r.vec_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY t.query_id ORDER BY t.rank ROWS UNBOUNDED PRECEDING) AS so_far
  FROM top t LEFT JOIN rel r USING (query_id, vec_id) LEFT JOIN nr ON nr.query_id = t.query_id JOIN v q ON q.vec_id = t.query_id)"""


def _metric_sql(ks: list[int]) -> str:
    out = ["query_id", "any_value(q_label) AS q_label", "CAST(max(n) AS BIGINT) AS n_relevant", "round(coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN rank END), 0.0), 9) AS reciprocal_rank"]
    for k in ks:
        ideal = f"list_sum(list_transform(range(1, CAST(least(max(n), {k}) AS BIGINT) + 1), lambda r: 1.0::DOUBLE / log2(r + 1)))"
        inside = f"hit = 1 AND rank <= {k}"
        out += [
            f"round(CASE WHEN max(n) > 0 THEN count(*) FILTER ({inside}) / max(n) ELSE 0.0 END, 9) AS recall_at_{k}", f"round(count(*) FILTER ({inside}) / {k}, 9) AS precision_at_{k}",
            f"round(CASE WHEN max(n) > 0 THEN coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER ({inside}), 0.0) / {ideal} ELSE 0.0 END, 9) AS ndcg_at_{k}",
            f"round(CASE WHEN max(n) > 0 THEN coalesce(sum(so_far / rank) FILTER ({inside}), 0.0) / least(max(n), {k}) ELSE 0.0 END, 9) AS map_at_{k}",
        ]
    return ", ".join(out)


_KS = [1, 3, 5, 10]
_MEASURES = ["reciprocal_rank", *[f"{m}_at_{k}" for k in _KS for m in ("recall", "precision", "ndcg", "map")]]


@query(f"WITH {_RUN} SELECT {_metric_sql(_KS)} FROM jd GROUP BY query_id")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.ranking_metrics(_run(spark, d), "query_id", _KS, "q_label")
    return m.select("query_id", "q_label", F.col("n_relevant").cast("bigint").alias("n_relevant"), *[F.round(c, 9).alias(c) for c in _MEASURES])


@query(f"WITH {_RUN}, pq AS (SELECT {_metric_sql(_KS)} FROM jd GROUP BY query_id) SELECT q_label, count(*) AS queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _MEASURES)} FROM pq GROUP BY GROUPING SETS ((q_label), ())")
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.by_type(retrieval_metrics(spark, d), "q_label", *_MEASURES)
    return m.select("q_label", "queries", *[F.round(c, 6).alias(c) for c in _MEASURES])


@query(f"""WITH {_RUN}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM jd), k AS (SELECT * FROM u WHERE used <= 400 OR rank = 1)
SELECT query_id, round(CASE WHEN max(n) > 0 THEN sum(hit) / max(n) ELSE 0.0 END, 9) AS recall_at_budget, round(sum(hit) / count(*), 9) AS precision_at_budget,
  round(CASE WHEN max(n) > 0 THEN coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (hit = 1), 0.0) / list_sum(list_transform(range(1, greatest(CAST(least(max(n), count(*)) AS BIGINT), 1) + 1), lambda r: 1.0::DOUBLE / log2(r + 1))) ELSE 0.0 END, 9) AS ndcg_at_budget,
  count(*) AS budget_chunks, CAST(sum(tokens) AS BIGINT) AS budget_tokens_used FROM k GROUP BY query_id""")
def metrics_budget(spark: SparkSession, d: str) -> DataFrame:
    b = metrics.budget_metrics(_run(spark, d), "query_id", "tokens", 400)
    return b.select("query_id", *[F.round(c, 9).alias(c) for c in ("recall_at_budget", "precision_at_budget", "ndcg_at_budget")], "budget_chunks", F.col("budget_tokens_used").cast("bigint").alias("budget_tokens_used"))


@query("""WITH q AS (SELECT DISTINCT ON (query_id) * FROM query_log WHERE latency_ms >= 0 AND NOT isnan(latency_ms))
SELECT strategy, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.9), 6) AS p90_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms
FROM q GROUP BY strategy""")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_log").where("latency_ms >= 0 and not isnan(latency_ms)").select("query_id", "strategy", "latency_ms").dropDuplicates(["query_id"])
    s = metrics.latency_summary(q, "latency_ms", "strategy")
    return s.select("strategy", "n", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p90_ms", "p95_ms", "p99_ms")])


@query()
def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_log").where("groundedness between 0 and 1").select("query_id", "groundedness").dropDuplicates(["query_id"])
    return metrics.bootstrap_intervals(q, ["groundedness"]).drop("measure")


_TRUNCATED = "CASE WHEN length(k.text) > 240 THEN regexp_replace(left(k.text, 237), '(?s) [^ ]*$', '') || '...' ELSE k.text END"


@query(f"""WITH k AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks), j AS (SELECT k.chunk_id, k.doc_id, d.doc_id IS NOT NULL AS resolvable, {sql.tokens(_TRUNCATED, True)} AS q, {sql.tokens('d.text', True)} AS t
  FROM k LEFT JOIN documents d ON k.doc_id = d.doc_id),
s AS (SELECT *, CASE WHEN resolvable THEN {sql.containment('q', 't')} ELSE 0.0 END AS s FROM j)
SELECT chunk_id, doc_id, resolvable, round(s, 9) AS support_score, resolvable AND s >= 0.35 AS verified FROM s""")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "chunks", "chunk_id", "doc_id", "text", busy=True).select("chunk_id", "doc_id", T.truncate(F.col("text"), 240).alias("quote"), "text").distinct().select("chunk_id", "doc_id", "quote")
    docs = table(spark, d, "documents", "doc_id", "text", busy=True).select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("text"))
    cited = k.select(F.col("doc_id").alias("query_id"), F.col("chunk_id").alias("cited"), F.col("doc_id").alias("chunk_id"), "quote")
    v = answers.verify(cited, docs.withColumn("text", F.coalesce("text", F.lit(""))))
    return v.select(F.col("cited").alias("chunk_id"), F.col("query_id").alias("doc_id"), "resolvable", F.round("support_score", 9).alias("support_score"), "verified")


@query(f"""WITH q AS (SELECT DISTINCT query_id, answer_terms, list_distinct(list_filter(list_transform(relevant, lambda r: r.document), lambda x: x IS NOT NULL)) AS docs FROM qrels),
j AS (SELECT q.query_id, d.doc_id, q.answer_terms AS terms, array_to_string({sql.words("lower(d.text)")}, ' ') AS low, list_concat({sql.tokens('d.text')}, {sql.words("lower(d.text)")}) AS single
  FROM q JOIN documents d ON list_contains(q.docs, d.source_file)),
p AS (SELECT *, list_transform(coalesce(terms, []), lambda t: array_to_string({sql.words('lower(t)')}, ' ')) AS plain FROM j)
SELECT query_id, doc_id, round(CASE WHEN len(plain) > 0 THEN len(list_filter(plain, lambda t: CASE WHEN contains(t, ' ') THEN contains(low, t) ELSE list_contains(single, t) END)) / len(plain) ELSE 0.0 END, 9) AS completeness FROM p""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qrels").select("query_id", "answer_terms", F.explode(F.array_distinct(F.transform("relevant", lambda r: r["document"]))).alias("source_file")).where("source_file is not null").distinct()
    j = q.join(table(spark, d, "documents").select("doc_id", "source_file", "text"), "source_file")
    return j.select("query_id", "doc_id", F.round(metrics.completeness(F.coalesce("text", F.lit("")), F.col("answer_terms")), 9).alias("completeness"))


def _split(text: str) -> str:
    """Sentences of a text without line breaks, in SQL: cut behind every stop, put together again behind abbreviations."""
    marked = f"regexp_replace(replace({text}, chr(10), ' '), '([.!?])([ \\t\\n\\x0b\\f\\r]+)([A-Z(\"''0-9])', '\\1\\2␞\\3', 'g')"
    short = "|".join(a[:-1].replace(".", "\\.") for a in V.ABBREVIATIONS)
    for _ in range(2):
        marked = f"regexp_replace({marked}, '(^|[ ␞])((?i:{short}|[a-z])\\.[ \\t\\n\\x0b\\f\\r]+)␞', '\\1\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, '␞'), lambda p: regexp_replace(regexp_replace(regexp_replace(p, '([.!?])[ \\t\\n\\x0b\\f\\r]+$', '\\1'), '^ +', ''), ' +$', '')), lambda p: p <> '')"


@query(f"""WITH s AS (SELECT doc_id, {_split("text")} AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the texts as they are: the rules without the Unicode normalisation before them."""
    s = table(spark, d, "documents", "doc_id", "text", busy=True).where("text is not null").select("doc_id", T.sentences(F.col("text"), normalised=True).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@query(f"""WITH k AS (SELECT DISTINCT ON (chunk_id) chunk_id, doc_id, text FROM chunks ORDER BY chunk_id, coalesce(doc_id, -9), position),
s AS (SELECT chunk_id, doc_id, unnest({_split("text")}) AS s FROM k WHERE doc_id IS NOT NULL AND text IS NOT NULL),
t AS (SELECT chunk_id, doc_id, list_distinct({sql.tokens("s", True)}) AS t, len({sql.tokens("s", True)}) AS n FROM s), e AS (SELECT doc_id, {sql.tokens("text", True)} AS p FROM documents),
v AS (SELECT chunk_id, CASE WHEN n < 3 THEN 1.0 WHEN e.p IS NULL THEN 0.0 ELSE len(list_intersect(t, p)) / len(t) END AS v FROM t LEFT JOIN e USING (doc_id))
SELECT chunk_id, round(avg(CASE WHEN v >= 0.35 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS groundedness FROM v GROUP BY chunk_id""")
def groundedness(spark: SparkSession, d: str) -> DataFrame:
    """Share of each chunk's sentences that its document supports."""
    k = _chunks(spark, d).where("doc_id is not null and text is not null")
    s = k.select("doc_id", "chunk_id", F.explode(T.sentences(F.col("text"), normalised=True)).alias("s")).select("doc_id", "chunk_id", T.content_tokens(F.col("s")).alias("s"))
    e = table(spark, d, "documents").select("doc_id", T.content_tokens(F.col("text")).alias("p"))
    supported = metrics.sentence_support(s, e, "doc_id", "s", "p")
    return metrics.groundedness(supported, "chunk_id").withColumn("groundedness", F.round("groundedness", 9))


@query(f"""WITH k AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks WHERE doc_id IS NOT NULL), j AS (SELECT k.doc_id, d.doc_id IS NOT NULL AND d.text IS NOT NULL AS ok, {sql.tokens("k.text", True)} AS q, {sql.tokens("d.text", True)} AS t FROM k LEFT JOIN documents d ON k.doc_id = d.doc_id),
s AS (SELECT doc_id, ok, ok AND (len(q) < 3 OR CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(list_distinct(q)) ELSE 0.0 END >= 0.35) AS good FROM j)
SELECT doc_id, count(*) AS citations, round(count(*) FILTER (ok) / count(*), 9) AS resolvable, round(count(*) FILTER (good) / count(*), 9) AS supported FROM s GROUP BY doc_id""")
def citation_shares(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as citations of their documents: the shares that resolve and that are supported."""
    k = table(spark, d, "chunks", "chunk_id", "doc_id", "text", busy=True).where("doc_id is not null").distinct()
    docs = table(spark, d, "documents", "doc_id", "text", busy=True).select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), "text")
    cited = k.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("chunk_id").alias("marker"), F.col("text").alias("quote"))
    c = answers.citation_correctness(cited, docs)
    return c.select(F.col("query_id").alias("doc_id"), "citations", F.round("resolvable", 9).alias("resolvable"), F.round("supported", 9).alias("supported"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) AS n, list_sum(list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT))) AS total FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\[\\d+\\]')")
def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.markers(F.col("text")).alias("m")).where(F.size("m") > 0)
    return m.select("doc_id", F.size("m").alias("n"), F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]*\\[([02-9]|\\d\\d+)\\]', '', 'g'), '[ \\t\\n\\x0b\\f\\r]*\\[1\\]', ' [1]', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def stripped_markers(spark: SparkSession, d: str) -> DataFrame:
    """Reference marks other than [1] taken out of every text."""
    t = T.strip_unresolvable_markers(F.col("text"), F.array(F.lit(1)))
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.md5(t).alias("digest"))


@query(f"""WITH b AS (SELECT query_id, chunk_id, retrieved_at, score, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, retrieved_at) AS r FROM retrieved_chunks
  WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
m AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieved_at, chunk_id) AS rank FROM b WHERE r = 1 QUALIFY rank <= 10),
k AS (SELECT DISTINCT ON (chunk_id) chunk_id, doc_id, text FROM chunks ORDER BY chunk_id, coalesce(doc_id, -9), position),
s AS (SELECT m.query_id, k.doc_id, m.rank, k.text FROM m JOIN k USING (chunk_id) WHERE k.doc_id IS NOT NULL AND k.text IS NOT NULL),
c AS (SELECT query_id, doc_id, min(rank) AS rank, arg_min(text, rank) AS text FROM s GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS marker, CASE WHEN length(text) > 240 THEN regexp_replace(left(text, 237), '(?s) [^ ]*$', '') || '...' ELSE text END AS quote FROM c""")
def cited_documents(spark: SparkSession, d: str) -> DataFrame:
    """One citation for each document among a query's ten best chunks, numbered by first use."""
    spans = merge_best(spark, d).select("query_id", "chunk_id", F.col("rank").alias("span_ix")).join(_chunks(spark, d).select("chunk_id", "doc_id", F.col("text").alias("span")), "chunk_id")
    spans = spans.where("doc_id is not null and span is not null").select("query_id", F.col("doc_id").alias("chunk_id"), "span_ix", "span")
    return answers.citations(spans).select("query_id", F.col("chunk_id").alias("doc_id"), "marker", "quote")


@query("""WITH b AS (SELECT query_id, chunk_id, doc_id, retrieved_at, score, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, retrieved_at) AS r FROM retrieved_chunks
  WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
m AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieved_at, chunk_id) AS rank FROM b WHERE r = 1),
h AS (SELECT query_id, arg_min(cik, rank) AS cik FROM m JOIN documents USING (doc_id) WHERE cik <> '' GROUP BY 1),
q AS (SELECT DISTINCT query_id, query FROM query_log WHERE query_id IS NOT NULL), y AS (SELECT DISTINCT query_id, CAST(unnest(CASE WHEN len(regexp_extract_all(query, '\\b(?:19|20)\\d{2}\\b')) > 0 THEN regexp_extract_all(query, '\\b(?:19|20)\\d{2}\\b') ELSE [NULL] END) AS INTEGER) AS year FROM q),
f AS (SELECT cik, concept, unit, fiscal_year, fact_id FROM financial_facts WHERE form LIKE '10-K%' AND fiscal_year IS NOT NULL AND fiscal_period = 'FY'
  QUALIFY row_number() OVER (PARTITION BY cik, concept, fiscal_year ORDER BY coalesce(end_date, '') DESC, accession_number DESC NULLS LAST, fact_id DESC) = 1)
SELECT query_id, f.cik, concept, fiscal_year, unit, fact_id FROM y JOIN h USING (query_id) JOIN f ON f.cik = h.cik AND (year IS NULL OR fiscal_year = year)
QUALIFY row_number() OVER (PARTITION BY query_id, year ORDER BY fiscal_year DESC, concept, unit) <= 25""")
def query_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the company of each query's best hit that has one, for the years the query names."""
    r = table(spark, d, "retrieved_chunks").where("query_id is not null and chunk_id is not null and score is not null and not isnan(score)").select("query_id", "chunk_id", "doc_id", "score", "retrieved_at")
    best = fusion.merge_results(r, "query_id", "chunk_id", "retrieved_at", 1 << 30).select("query_id", "doc_id", "rank")
    hits = best.join(table(spark, d, "documents").select("doc_id", "cik"), "doc_id")
    queries = table(spark, d, "query_log").where("query_id is not null").select("query_id", "query").distinct()
    facts = store.annual_facts(table(spark, d, "financial_facts"))
    return search.structured_facts(hits, queries, facts).select("query_id", "cik", "concept", "fiscal_year", "unit", "fact_id")


@query()
def mmr_answers(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "probe_queries").select("query_id", "query")
    evidence = materialise(_bm25(spark, d, 10).join(_chunks(spark, d).select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "rank", "text"), "evidence")
    return answers.answers(q, evidence)


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """The judgements, resolved and written before there are vectors beside them."""
    found = materialise(qrels_resolve(spark, d), "judgements")
    release(spark)
    return found


def _training_rows(spark: SparkSession, d: str, index: search.Index, settings: Settings, relevant: DataFrame, last: bool = False) -> DataFrame:
    """Candidates of the judged queries in both lists, with features and labels."""
    queries = table(spark, d, "qrels").select("query_id", "query").where("query_id is not null and query is not null").distinct()
    return evaluate.training_rows(index, queries, relevant, settings, last)


@query()
def rerank_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Judged queries: fused candidates, a model trained on half of the queries, the other half's hits reranked."""
    settings = Settings()
    relevant = _relevant(spark, d)
    rows = _training_rows(spark, d, search.build_index(_described(spark, d), settings), settings, relevant, last=True)
    half = F.pmod(F.xxhash64("query_id"), F.lit(2)) == 0
    model = rerank.fit(rows.where(half))
    return rerank.rerank(model, rows.where(~half), "query_id", "chunk_id", 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), "label", "rerank_score")


@query()
def answer_probe_queries(spark: SparkSession, d: str) -> DataFrame:
    """The whole path for the standing queries: plan, search terms and vectors, fuse, scope, rerank, merge, answer.

    The reranker is fitted on the training half of the judged queries.
    """
    settings = Settings()
    relevant = _relevant(spark, d)
    index = search.build_index(_described(spark, d), settings)
    rows = _training_rows(spark, d, index, settings, relevant)
    index.model = rerank.fit(rows.where(relevance.in_training(F.col("query_id"), seed=settings.seed)))
    return search.answer(index, table(spark, d, "probe_queries").select("query_id", "query"), settings)


# ---------------------------------------------------------------- plans


@query(f"""WITH q AS (SELECT DISTINCT query FROM query_log WHERE query IS NOT NULL), t AS (SELECT query, list_distinct({sql.tokens('query', True)}) AS t FROM q),
c AS (SELECT query, len(list_intersect(t, {sql.stems(repr(V.FINANCIAL))})) AS f, len(list_intersect(t, {sql.stems(repr(V.BIOMEDICAL))})) AS b FROM t)
SELECT query, CASE WHEN f > b AND f > 0 THEN 'financial_lookup' WHEN b > 0 THEN 'biomedical_search' ELSE 'document_search' END AS tool FROM c""")
def plan_route(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_log").select("query").where("query is not null").distinct()
    return q.select("query", planning.route(F.col("query")).alias("tool"))


def _trimmed(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[ ?,]+', ''), '[ ?,]+$', '')"


def _left_over(parts: str) -> str:
    bare = f"list_reduce(list_prepend(regexp_replace(q, {sql.lit(V.COMPARISON)}, ' ', 'g'), {parts}), lambda x, p: replace(x, p, ' '))"
    return _trimmed(f"array_to_string(regexp_extract_all(replace({bare}, ' and ', ' '), {sql.lit(V.SOLID + '+')}), ' ')")


_ONE_WORD = V.COMPARISON.replace(r"(?i)\b", "", 1).removesuffix(r"\b")
_NAMES = lambda t: f"list_filter(list_transform(regexp_extract_all({t}, {sql.lit(V.NAME)}), lambda n: array_to_string(regexp_split_to_array(regexp_replace(n, {sql.lit(f'(?i)^(?:(?:{_ONE_WORD})(?:[ \\t\\n]+|$))+')}, ''), '[ \\t\\n]+'), ' ')), lambda n: contains(n, ' '))"
_FIRSTS = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_TOOL = lambda t: f"""CASE WHEN len(list_intersect(list_distinct({sql.tokens(t, True)}), {sql.stems(repr(V.FINANCIAL))})) > len(list_intersect(list_distinct({sql.tokens(t, True)}), {sql.stems(repr(V.BIOMEDICAL))})) THEN 'financial_lookup'
  WHEN len(list_intersect(list_distinct({sql.tokens(t, True)}), {sql.stems(repr(V.BIOMEDICAL))})) > 0 THEN 'biomedical_search' ELSE 'document_search' END"""  # noqa: E731


@query(f"""WITH a AS (SELECT DISTINCT query AS q FROM query_log WHERE query IS NOT NULL),
b AS (SELECT q, regexp_matches(q, {sql.lit(V.COMPARISON)}) AS cmp, {_FIRSTS(f"list_concat(regexp_extract_all(q, {sql.lit(V.YEAR)}), regexp_extract_all(q, {sql.lit(V.FISCAL)}))")} AS periods, {_FIRSTS(_NAMES("q"))} AS names,
  list_filter(list_transform(string_split(regexp_replace(q, '(?i)[ \\t\\n]+and[ \\t\\n]+(what|how|why|which|who|when|does|did|is|are|was|were)\\b', '␞\\1', 'g'), '␞'), lambda p: {_trimmed("p")}), lambda p: trim(p) <> '') AS joined FROM a),
c AS (SELECT *, CASE WHEN cmp AND len(periods) > 1 THEN 'temporal_comparison' WHEN cmp AND len(names) > 1 THEN 'entity_comparison' WHEN len(joined) > 1 THEN 'conjunction' ELSE 'single_hop' END AS strategy, {_left_over("periods")} AS no_p, {_left_over("names")} AS no_n FROM b),
e AS (SELECT q, strategy, names, unnest(s[1:3]) AS sub_query, unnest(range(0, len(s[1:3]))) AS sub_ix FROM (SELECT *, CASE strategy WHEN 'temporal_comparison' THEN list_transform(periods, lambda p: trim(no_p || ' ' || p))
  WHEN 'entity_comparison' THEN list_transform(names, lambda n: trim(n || ' ' || no_n)) WHEN 'conjunction' THEN list_transform(joined, lambda p: CASE WHEN p LIKE '%?' THEN p ELSE p || '?' END) ELSE [q] END AS s FROM c))
SELECT q AS query, CAST(sub_ix AS INTEGER) AS sub_ix, sub_query, {_TOOL("sub_query")} AS tool, CASE WHEN strategy = 'entity_comparison' THEN ({_NAMES("sub_query")})[1] ELSE names[1] END AS entity, strategy FROM e""")
def plan_queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_log").select("query").where("query is not null").distinct()
    return planning.plans(q.withColumn("text", F.col("query")), "query", "text")


# ---------------------------------------------------------------- tables


@query("""SELECT cik, concept, fiscal_year, unit, fact_id, CASE WHEN NOT isnan(value) THEN value END AS value, end_date FROM financial_facts WHERE form LIKE '10-K%' AND fiscal_year IS NOT NULL AND fiscal_period = 'FY'
QUALIFY row_number() OVER (PARTITION BY cik, concept, fiscal_year ORDER BY coalesce(end_date, '') DESC, accession_number DESC NULLS LAST, fact_id DESC) = 1""")
def facts_dedup(spark: SparkSession, d: str) -> DataFrame:
    return store.annual_facts(table(spark, d, "financial_facts")).select("cik", "concept", "fiscal_year", "unit", "fact_id", "value", "end_date")


@query("""SELECT cik, concept, fiscal_year, unit, fact_id FROM (SELECT DISTINCT cik, concept, fiscal_year, unit, fact_id FROM financial_facts WHERE fiscal_year IS NOT NULL AND concept IN ('Revenues', 'Assets'))
ORDER BY fiscal_year DESC, concept, cik, unit, fact_id LIMIT 25""")
def facts_lookup(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "financial_facts").where("fiscal_year is not null").select("cik", "concept", "fiscal_year", "unit", "fact_id").distinct()
    return store.lookup_facts(f, concepts=["Revenues", "Assets"], tie=["cik", "unit", "fact_id"])


@query("""WITH b AS (SELECT * FROM financial_facts WHERE received_at >= TIMESTAMP '2019-01-01' QUALIFY row_number() OVER (PARTITION BY cik, concept, fiscal_year, unit ORDER BY received_at DESC, fact_id DESC) = 1),
t AS (SELECT * FROM financial_facts WHERE received_at < TIMESTAMP '2019-01-01')
SELECT cik, concept, fiscal_year, unit, fact_id, received_at FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.cik = t.cik AND b.concept = t.concept AND b.fiscal_year = t.fiscal_year AND b.unit = t.unit)
UNION ALL SELECT cik, concept, fiscal_year, unit, fact_id, received_at FROM b""")
def upsert_facts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "financial_facts")
    out = store.upsert(f.where("received_at < timestamp_ntz '2019-01-01 00:00:00'"), f.where("received_at >= timestamp_ntz '2019-01-01 00:00:00'"), store.KEYS["financial_facts"], "received_at", "fact_id")
    return out.select("cik", "concept", "fiscal_year", "unit", "fact_id", "received_at")


@query("""WITH n AS (SELECT DISTINCT doc_id FROM chunks WHERE created_at >= TIMESTAMP '2019-06-01' AND doc_id IS NOT NULL)
SELECT DISTINCT chunk_id, doc_id, position FROM chunks WHERE doc_id IS NOT NULL AND (created_at >= TIMESTAMP '2019-06-01' OR doc_id NOT IN (SELECT doc_id FROM n))""")
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the second half of 2019 replace all older ones of the same documents."""
    c = table(spark, d, "chunks").where("doc_id is not null")
    new = F.col("created_at") >= F.lit("2019-06-01 00:00:00").cast("timestamp_ntz")
    return store.replace_groups(c.where(~new), c.where(new), ["doc_id"]).select("chunk_id", "doc_id", "position").distinct()


@query("SELECT strategy, count(*) AS queries, CAST(round(sum(round(latency_ms * 1000)) FILTER (latency_ms >= 0 AND NOT isnan(latency_ms))) AS BIGINT) AS latency_us FROM query_log GROUP BY strategy")
def log_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "query_log").withColumn("latency_ms", F.when((F.col("latency_ms") >= 0) & ~F.isnan("latency_ms"), F.round(F.col("latency_ms") * 1000)))
    return service.counters(rows).select("strategy", "queries", F.col("latency_sum").cast("bigint").alias("latency_us"))


@query("SELECT DISTINCT chunk_id, doc_id FROM chunks c WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM deletions WHERE doc_id IS NOT NULL)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "deletions").where("doc_id is not null").select("doc_id").distinct()
    return table(spark, d, "chunks").select("chunk_id", "doc_id").join(gone, "doc_id", "left_anti").distinct().select("chunk_id", "doc_id")


@query("SELECT query_id, query, created_at FROM (SELECT DISTINCT query_id, query, created_at FROM query_log) ORDER BY created_at DESC, query_id LIMIT 20")
def recent_queries(spark: SparkSession, d: str) -> DataFrame:
    return store.recent_queries(table(spark, d, "query_log").select("query_id", "query", "created_at").distinct())


@query("SELECT source_type, lang, count(*) AS documents, sum(n_chars) AS n_chars FROM documents GROUP BY ROLLUP (source_type, lang)")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("source_type", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("n_chars"))


@query("""WITH q AS (SELECT DISTINCT ON (query_id) created_at, CASE WHEN groundedness BETWEEN 0 AND 1 THEN CAST(round(groundedness * 1e9) AS BIGINT) END AS g, CASE WHEN latency_ms >= 0 AND NOT isnan(latency_ms) THEN CAST(round(latency_ms * 1e9) AS BIGINT) END AS l FROM query_log),
w AS (SELECT *, unnest([time_bucket(INTERVAL 5 MINUTES, created_at), time_bucket(INTERVAL 5 MINUTES, created_at) - INTERVAL 5 MINUTES]) AS window_start FROM q)
SELECT window_start, window_start + INTERVAL 10 MINUTES AS window_end, count(*) AS queries, ((2 * sum(g) + 1000 * count(g)) // (2000 * count(g))) / 1e6 AS mean_groundedness, ((2 * sum(l) + 1000 * count(l)) // (2000 * count(l))) / 1e6 AS mean_latency FROM w GROUP BY window_start""")
def query_log_windows(spark: SparkSession, d: str) -> DataFrame:
    return monitor.log_windows(table(spark, d, "query_log").select("query_id", "created_at", "groundedness", "latency_ms").dropDuplicates(["query_id"]))


# ---------------------------------------------------------------- references


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*(table(spark, d, t) for t in ("chunks", "qrels", "documents", "deletions")))


_P1 = """
WITH s AS (
  SELECT d.doc_id, source_file, ingested_at, section_headings, coalesce(x.last_deleted >= d.ingested_at, false) AS gone
  FROM documents d LEFT JOIN (SELECT doc_id, max(deleted_at) AS last_deleted FROM deletions WHERE doc_id IS NOT NULL GROUP BY 1) x USING (doc_id)
), c AS (
  SELECT DISTINCT 'chunks' AS ref_table, strftime(created_at, '%Y-%m') AS period, chunk_id AS ref_id, CAST(c.doc_id AS VARCHAR) AS doc_key, '' AS section
  FROM chunks c LEFT JOIN s ON c.doc_id = s.doc_id
  WHERE c.doc_id IS NOT NULL AND (s.doc_id IS NULL OR s.gone OR coalesce(s.ingested_at > c.created_at, false))
), t AS (SELECT query_id, judged_at, unnest(relevant) AS r FROM qrels
), u AS (
  SELECT t.query_id, t.judged_at, t.r.document AS document, t.r.sections AS sections, s.section_headings,
    s.doc_id IS NOT NULL AND NOT s.gone AND NOT coalesce(s.ingested_at > t.judged_at, false) AS holds
  FROM t LEFT JOIN s ON t.r.document = s.source_file WHERE t.r.document IS NOT NULL
), v AS (SELECT query_id, judged_at, document, section_headings, unnest(sections) AS section FROM u WHERE holds)
SELECT * FROM c
UNION ALL SELECT DISTINCT 'qrels', strftime(judged_at, '%Y-%m'), query_id, document, '' FROM u WHERE NOT holds
UNION ALL SELECT DISTINCT 'qrels', strftime(judged_at, '%Y-%m'), query_id, document, section FROM v
  WHERE section IS NOT NULL AND NOT coalesce(list_contains(section_headings, section), false)
"""


@query(_P1)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


@query(f"SELECT ref_table, period, count(*) AS n_orphans, count(DISTINCT ref_id) AS n_referring FROM ({_P1}) GROUP BY 1, 2")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))
