"""Filings: submissions and company facts as delivered by the public JSON interface, and 10-K sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.functions import text as T
from groundline.functions import vocabulary as V
from groundline.runtime import materialise
from groundline.sources.html import page_text

SUBMISSIONS = """cik string, name string, tickers array<string>, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,
filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>>"""
ENTRY = "struct<form:string,fy:int,fp:string,val:double,end:string,accn:string>"
COMPANY_FACTS = f"cik bigint, entityName string, facts struct<`us-gaap`:map<string,struct<units:map<string,array<{ENTRY}>>>>>"
# The concepts taken by default, and the address of filed documents.
CONCEPTS = ["Revenues", "NetIncomeLoss", "Assets", "Liabilities"]
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/%s/%s/%s"


def normalise_cik(cik: Column) -> Column:
    """Ten digits; a value without digits raises."""
    number = F.regexp_replace(cik, r"\D", "")
    return F.when(number == "", F.raise_error(F.concat(F.lit("not a usable CIK: "), cik))).when(F.length(number) < 10, F.lpad(number, 10, "0")).otherwise(number)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).json(path, multiLine=True, mode="FAILFAST")


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPANY_FACTS).json(path, multiLine=True, mode="FAILFAST")


def ticker_to_cik(tickers: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """``wanted`` (ticker) with the cik of the ticker map (ticker, cik), whatever the case.

    An unknown ticker has a null cik; with ``strict`` it is an error.
    """
    m = tickers.select(F.upper("ticker").alias("t"), normalise_cik(F.col("cik").cast("string")).alias("cik"))
    out = wanted.join(m, F.upper("ticker") == F.col("t"), "left").drop("t")
    return out.withColumn("cik", F.coalesce("cik", F.raise_error(F.concat(F.lit("unknown ticker: "), F.col("ticker"))))) if strict else out


# Where a company's submissions lie.
SUBMISSIONS_AT = "https://data.sec.gov/submissions/CIK%s.json"


def fetch_filings(spark: SparkSession, ciks: list[str], forms: list[str], limit: int, pages: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Documents of the latest filings of companies. ``pages`` reads addresses (url, payload), as http.read_pages does.

    The addresses of the filings wanted, ``limit`` for each of the named companies, pass the driver.
    """
    got = pages([SUBMISSIONS_AT % c.rjust(10, "0") for c in ciks]).select(F.from_json("payload", SUBMISSIONS).alias("s")).select("s.*")
    listed = materialise(list_filings(got, forms, limit), "filings")
    bodies = pages([r["document_url"] for r in listed.select("document_url").collect()])
    text = bodies.mapInPandas(_page_texts, "document_url string, body string")
    return build_documents(listed.join(text, "document_url"), "body")


def _page_texts(batches):
    for pdf in batches:
        yield pdf.assign(body=[page_text(p or "") for p in pdf["payload"]]).rename(columns={"url": "document_url"})[["document_url", "body"]]


def list_filings(submissions: DataFrame, forms: list[str], limit: int | None = None) -> DataFrame:
    """Column-oriented arrays as rows, of the given forms, the first ``limit`` of each company in file order."""
    r = F.col("filings.recent")
    rows = submissions.select("cik", "name", "tickers", F.posexplode(F.arrays_zip(*[F.coalesce(r[c], F.array().cast("array<string>")).alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")])).alias("pos", "f"))
    rows = rows.where(F.upper("f.form").isin(*[f.upper() for f in forms]))
    if limit is not None:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).where(F.col("r") <= limit)
    number = F.regexp_replace("f.accessionNumber", "-", "")
    return rows.select(
        normalise_cik(F.col("cik")).alias("cik"), F.col("name").alias("company_name"), "tickers", F.col("f.accessionNumber").alias("accession_number"), F.col("f.form").alias("form"),
        F.col("f.filingDate").alias("filing_date"), F.col("f.reportDate").alias("report_date"), F.col("f.primaryDocument").alias("primary_document"),
        F.format_string(ARCHIVE, F.regexp_replace("cik", "^0+", ""), number, F.col("f.primaryDocument")).alias("document_url"), "pos",
    )


def split_items(text: Column) -> Column:
    """10-K text (in NFKC) cut at its Item headings: array<struct<heading, text, order>>; else one 'Full Text'."""
    marked = F.regexp_replace(text, rf"(?imd){V.ITEM}", "\u0001$1\u0002$2\u0003")
    parts = F.slice(F.split(marked, "\u0001"), 2, 1 << 30)
    titles = F.create_map(*[F.lit(x) for kv in V.ITEM_TITLES.items() for x in kv])

    def section(p: Column, i: Column) -> Column:
        number = F.upper(F.substring_index(p, "\u0002", 1))
        inline = F.regexp_replace(F.substring_index(F.substring_index(p, "\u0003", 1), "\u0002", -1), r"^[ .:\-]+|[ .:\-]+$", "")
        title = F.coalesce(F.nullif(inline, F.lit("")), F.try_element_at(titles, number), F.lit(""))
        heading = F.regexp_replace(F.trim(F.concat(F.lit("Item "), number, F.lit(". "), title)), r"\.+$", "")
        return F.struct(heading.alias("heading"), T.collapsed(F.substring_index(p, "\u0003", -1)).alias("text"), i.alias("order"))

    found = F.filter(F.transform(parts, section), lambda s: s["text"] != "")
    whole = F.filter(F.array(F.struct(F.lit("Full Text").alias("heading"), T.collapsed(text).alias("text"), F.lit(0).alias("order"))), lambda s: s["text"] != "")
    return F.when(F.size(parts) > 0, found).otherwise(whole)


def build_documents(filings: DataFrame, body: str) -> DataFrame:
    """Documents of filings (list_filings with a text column): the fiscal year is that of the report, else of the filing."""
    nf = filings.withColumn("nf", T.nfkc(F.col(body)))
    year = F.substring(F.coalesce(F.nullif("report_date", F.lit("")), "filing_date"), 1, 4).cast("int")
    return nf.select(
        T.stable_hash(F.lit("sec_filing"), F.col("accession_number")).alias("doc_id"), F.lit("sec_filing").alias("source_type"), T.collapsed(F.col("nf")).alias("text"),
        F.trim(F.concat_ws(" ", "company_name", "form", year.cast("string"))).alias("title"), "company_name", F.get("tickers", F.lit(0)).alias("ticker"), "cik", F.col("form").alias("form_type"),
        year.alias("fiscal_year"), F.to_date("filing_date").alias("filing_date"), F.col("document_url").alias("url"), split_items(F.col("nf")).alias("sections"),
    )


def us_gaap_facts(facts: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """Annual figures of company facts as rows; of each (concept, year) the one with the latest end date.

    The unit is not part of the key; among equal end dates the later entry in file order (by concept, unit) wins.
    """
    f = facts.select(normalise_cik(F.col("cik").cast("string")).alias("cik"), F.col("entityName").alias("entity_name"), F.explode("facts.us-gaap").alias("concept", "block"))
    f = f.where(F.col("concept").isin(*(concepts or CONCEPTS)))
    f = f.select("cik", "entity_name", "concept", F.explode("block.units").alias("unit", "entries")).select("cik", "entity_name", "concept", "unit", F.posexplode("entries").alias("pos", "e"))
    f = f.where("e.form like '10-K%' and e.fy is not null and e.fp = 'FY'")
    order = Window.partitionBy("cik", "concept", "e.fy").orderBy(F.coalesce("e.end", F.lit("")).desc(), F.col("unit").desc(), F.col("pos").desc())
    return f.withColumn("r", F.row_number().over(order)).where("r = 1").select("cik", "entity_name", "concept", "unit", F.col("e.fy").alias("fiscal_year"), F.col("e.val").alias("value"), F.col("e.end").alias("end_date"), F.col("e.accn").alias("accession_number"))
