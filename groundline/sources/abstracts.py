"""Biomedical abstracts: article XML as delivered by the public efetch and esearch interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions import text as T
from groundline.sources.files import SECTIONS

_ARTICLE = r"(?s)<PubmedArticle[ >].*?</PubmedArticle>"


def _plain(xml: Column) -> Column:
    """Text of an XML fragment: tags out, the five entities and numeric references resolved."""
    bare = F.regexp_replace(xml, "<[^>]*>", "")
    return F.xpath_string(F.concat(F.lit("<a>"), bare, F.lit("</a>")), F.lit("a"))


def search_ids(payload: Column) -> Column:
    """Ids of an esearch JSON payload in order of relevance."""
    return F.from_json(payload, "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]


def parse_articles(payloads: DataFrame, xml: str) -> DataFrame:
    """Documents of article-set payloads: doc_id, source_type, text, title, pmid, journal, authors, publication_year, mesh_terms, url, sections.

    Labelled parts of an abstract become sections (heading in title case); records without an abstract are left out.
    Inline markup is kept as its text. Everything runs in the JVM.
    """
    a = payloads.select(F.explode(F.regexp_extract_all(xml, F.lit(_ARTICLE), F.lit(0))).alias("x"))
    one = lambda path: T.collapsed(F.xpath_string("x", F.lit(path)))
    many = lambda path: F.transform(F.xpath("x", F.lit(path)), lambda v: T.collapsed(v))
    part = F.regexp_extract_all("x", F.lit(r"(?s)<AbstractText(?: [^>]*)?(?<!/)>.*?</AbstractText>"), F.lit(0))
    attribute = lambda p, name: F.regexp_extract(F.regexp_extract(p, r"^<AbstractText([^>]*)>", 1), rf'(?<![A-Za-z]){name}="([^"]*)"', 1)

    def section(p: Column, i: Column) -> Column:
        label = F.initcap(F.trim(F.coalesce(F.nullif(attribute(p, "Label"), F.lit("")), F.nullif(attribute(p, "NlmCategory"), F.lit("")), F.lit(""))))
        return F.struct(F.coalesce(F.nullif(label, F.lit("")), F.lit("Abstract")).alias("heading"), T.collapsed(_plain(p)).alias("text"), i.alias("order"), (label != "").alias("labelled"))

    a = a.withColumn("parts", F.filter(F.transform(part, section), lambda s: s["text"] != "")).where(F.size("parts") > 0)
    author = F.regexp_extract_all("x", F.lit(r"(?s)<Author[ >].*?</Author>"), F.lit(0))
    name = lambda p, tag: T.collapsed(_plain(F.regexp_extract(p, rf"(?s)<{tag}>(.*?)</{tag}>", 1)))
    authors = F.transform(F.filter(author, lambda p: name(p, "LastName") != ""), lambda p: F.trim(F.concat_ws(" ", name(p, "LastName"), name(p, "Initials"))))
    dated = "PubmedArticle/MedlineCitation/Article/Journal/JournalIssue/PubDate"
    year = F.coalesce(F.nullif(one(f"{dated}/Year"), F.lit("")), F.substring(one(f"{dated}/MedlineDate"), 1, 4))
    said = F.transform("parts", lambda s: F.when(s["labelled"], F.concat(s["heading"], F.lit(": "), s["text"])).otherwise(s["text"]))
    a = a.select(
        one("PubmedArticle/MedlineCitation/PMID").alias("pmid"), one("PubmedArticle/MedlineCitation/Article/ArticleTitle").alias("title"),
        F.coalesce(F.nullif(one("PubmedArticle/MedlineCitation/Article/Journal/ISOAbbreviation"), F.lit("")), one("PubmedArticle/MedlineCitation/Article/Journal/Title")).alias("journal"),
        authors.alias("authors"), F.when(year.rlike(r"^\d+$"), year.cast("int")).alias("publication_year"), many("PubmedArticle/MedlineCitation/MeshHeadingList/MeshHeading/DescriptorName/text()").alias("mesh_terms"),
        "parts", F.array_join(said, "\n\n").alias("body"),
    )
    text = T.collapsed(F.concat_ws("\n\n", F.nullif("title", F.lit("")), "body"))
    sections = F.transform("parts", lambda s: F.struct(s["heading"].alias("heading"), s["text"].alias("text"), s["order"].alias("order"))).cast(SECTIONS)
    return a.select(
        T.stable_hash(F.lit("biomedical_abstract"), F.coalesce(F.nullif("pmid", F.lit("")), text)).alias("doc_id"), F.lit("biomedical_abstract").alias("source_type"), text.alias("text"), "title", "pmid", "journal", "authors",
        "publication_year", "mesh_terms", F.when(F.col("pmid") != "", F.format_string("https://pubmed.ncbi.nlm.nih.gov/%s/", "pmid")).alias("url"), sections.alias("sections"),
    )


# The public interface's address and the number of records of one request.
EUTILS, RECORDS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils", 100


def search_url(query: str, most: int, email: str, first_year: int | None = None, last_year: int | None = None) -> str:
    from urllib.parse import urlencode

    dates = {"datetype": "pdat", "mindate": first_year, "maxdate": last_year} if first_year and last_year else {}
    return f"{EUTILS}/esearch.fcgi?" + urlencode({"db": "pubmed", "term": query, "retmax": most, "retmode": "json", "sort": "relevance", "email": email, **dates})


def fetch_urls(ids: list[str], email: str) -> list[str]:
    """Addresses of the records, a hundred to a request, for the paged source."""
    return [f"{EUTILS}/efetch.fcgi?db=pubmed&retmode=xml&email={email}&id={','.join(ids[i : i + RECORDS])}" for i in range(0, len(ids), RECORDS)]


def search_and_fetch(spark: SparkSession, query: str, most: int, email: str, pages: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Documents of the ``most`` records most relevant to a query. ``pages`` reads addresses, as http.read_pages does.

    No record found gives no documents; an answer that is no article set is an error.
    """
    found = pages([search_url(query, most, email)]).select(search_ids(F.col("payload")).alias("ids")).first()
    ids = list(dict.fromkeys((found["ids"] if found else None) or []))[:most]
    payloads = pages(fetch_urls(ids, email)).select(F.when(F.col("payload").contains("PubmedArticleSet"), F.col("payload")).otherwise(F.raise_error(F.lit("no article set: malformed abstracts"))).alias("payload"))
    return parse_articles(payloads, "payload")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Recorded payloads, one whole file a row: path, payload."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def summarise(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.size("mesh_terms") > 0).alias("with_mesh_terms"), F.min("publication_year").alias("year_min"), F.max("publication_year").alias("year_max"))
