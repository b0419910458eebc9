"""Documents from files: Markdown with front matter, plain text, HTML, PDF through an extractor."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from groundline.config import AcquisitionError
from groundline.functions import text as T
from groundline.operators.chunking import markdown_sections
from groundline.sources.html import page_text

# File suffixes read, source types, metadata fields of a document.
SUFFIXES = ["txt", "md", "markdown", "htm", "html", "pdf"]
SOURCE_TYPES = ["sec_filing", "biomedical_abstract", "user_document"]
FIELDS = """title company_name ticker cik form_type fiscal_year filing_date pmid journal authors publication_year mesh_terms url language source_file""".split()
_LISTS, _INTS, _DATES = {"authors", "mesh_terms"}, {"fiscal_year", "publication_year"}, {"filing_date"}

SECTIONS = "array<struct<heading:string,text:string,order:int>>"
METADATA = "struct<" + ",".join(f"{f}:{'array<string>' if f in _LISTS else 'int' if f in _INTS else 'date' if f in _DATES else 'string'}" for f in FIELDS) + ",extras:map<string,string>>"


def _front_matter(head: str) -> tuple[dict, str | None]:
    import yaml

    try:
        parsed = yaml.safe_load(head) or {}
    except yaml.YAMLError as e:
        return {}, f"malformed front matter: {e}"
    return (parsed, None) if isinstance(parsed, dict) else ({}, "front matter is no mapping")


def _metadata(matter: dict) -> dict:
    import datetime

    out: dict = {}
    for f in FIELDS:
        v = matter.get(f)
        if f in _LISTS:
            out[f] = [str(x) for x in v] if isinstance(v, list) else []
        elif f in _INTS:
            out[f] = int(v) if v is not None else None
        elif f in _DATES:
            out[f] = v if isinstance(v, datetime.date) or v is None else datetime.date.fromisoformat(str(v))
        else:
            out[f] = None if v is None else str(v)
    if out["cik"]:
        out["cik"] = out["cik"].strip().rjust(10, "0")
    out["language"] = out["language"] or "en"
    out["extras"] = {k: str(v) for k, v in matter.items() if k not in FIELDS and k != "source_type"}
    return out


def _parse(pdf_text: Callable[[bytes], str] | None):
    def one(path: str, content: bytes) -> dict:
        name = path.rsplit("/", 1)[-1]
        suffix = name.rsplit(".", 1)[-1].lower()
        matter, error, raw = {}, None, ""
        if suffix == "pdf":
            if pdf_text is None:
                error = "no PDF extractor is set"
            else:
                try:
                    raw = pdf_text(content)
                except Exception as e:  # noqa: BLE001
                    error = f"unreadable PDF: {e}"
        else:
            raw = content.decode("utf-8", errors="replace")
            if suffix in ("htm", "html"):
                raw = page_text(raw)
            elif m := re.match(r"\A---\s*\n(.*?)\n---\s*\n", raw, re.S):
                matter, error = _front_matter(m.group(1))
                raw = raw[m.end() :]
        source = str(matter.get("source_type", "user_document"))
        if error is None and source not in SOURCE_TYPES:
            error = f"unknown source_type {source!r}"
        try:
            meta = _metadata(matter)
        except (ValueError, TypeError) as e:
            meta, error = _metadata({}), error or f"bad metadata: {e}"
        meta["title"] = meta["title"] or re.sub("[_-]", " ", name.rsplit(".", 1)[0]).strip().title()
        meta["source_file"] = name
        return {"path": path, "suffix": suffix, "source_type": source, "raw": raw, "metadata": meta, "error": error}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=["path", "suffix", "source_type", "raw", "metadata", "error"])

    return run


def read_directory(spark: SparkSession, folder: str, recursive: bool = True, pdf_text: Callable[[bytes], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents of a folder and its unreadable files: (doc_id, source_type, text, metadata, sections, path), (path, error).

    Files of other suffixes are left out. The document's id depends on its type and file name.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    parsed = files.select("path", "content").mapInPandas(_parse(pdf_text), f"path string, suffix string, source_type string, raw string, metadata {METADATA}, error string")
    good = parsed.where("error is null").withColumn("nf", T.nfkc(F.col("raw")))
    marked = F.col("suffix").isin("md", "markdown")
    docs = good.select(
        T.stable_hash(F.col("source_type"), F.col("metadata.source_file")).alias("doc_id"), "source_type", T.collapsed(F.col("nf")).alias("text"), "metadata",
        F.when(marked, markdown_sections(F.col("nf"))).otherwise(F.array().cast(SECTIONS)).cast(SECTIONS).alias("sections"), "path",
    )
    return docs, parsed.where("error is not null").select("path", "error")


def require_documents(docs: DataFrame, folder: str) -> DataFrame:
    """The documents, or an error where there are none."""
    if not docs.head(1):
        raise AcquisitionError(f"no supported documents under {folder}")
    return docs


def enriched(docs: DataFrame) -> DataFrame:
    """Metadata that the source did not give, inferred from the first 4000 characters, by source type."""
    from groundline.functions import vocabulary as V

    head, kind = F.substring("text", 1, 4000), F.col("source_type")
    found = lambda p, g=1: F.nullif(F.regexp_extract(head, p, g), F.lit(""))
    m = F.col("metadata")
    filing, abstract = kind == "sec_filing", kind == "biomedical_abstract"
    year = F.coalesce(m["fiscal_year"], F.when(filing, found(V.FISCAL_YEAR).cast("int")))
    form = F.coalesce(m["form_type"], F.when(filing, F.upper(found(V.FORM_TYPE))))
    cik = F.coalesce(m["cik"], F.when(filing, T.pad_cik(found(V.CIK))))
    published = F.coalesce(m["publication_year"], F.when(abstract, found(V.YEAR, 0).cast("int")))
    first_line = F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    title = F.coalesce(F.nullif(m["title"], F.lit("")), F.when(filing & m["company_name"].isNotNull(), F.trim(F.concat_ws(" ", m["company_name"], F.coalesce(form, F.lit("filing")), year.cast("string")))), T.truncate(first_line, 120), F.lit(""))
    return docs.withColumn("metadata", m.withField("fiscal_year", year).withField("form_type", form).withField("cik", cik).withField("publication_year", published).withField("title", title))


def citation_label(source_type: Column, meta: Column, heading: Column, doc_id: Column) -> Column:
    """Provenance of a chunk, by source type."""
    fallback = F.coalesce(F.nullif(meta["title"], F.lit("")), doc_id)
    year = F.when(meta["fiscal_year"].isNotNull() & (meta["fiscal_year"] != 0), F.concat(F.lit("FY"), meta["fiscal_year"].cast("string")))
    filing = F.concat_ws(" - ", *[F.nullif(x, F.lit("")) for x in (meta["company_name"], meta["form_type"])], year, F.nullif(heading, F.lit("")))
    abstract = F.when((F.coalesce(meta["journal"], F.lit("")) != "") & meta["publication_year"].isNotNull(), F.concat(fallback, F.lit(" ("), meta["journal"], F.lit(", "), meta["publication_year"].cast("string"), F.lit(")"))).otherwise(fallback)
    return F.when(source_type == "sec_filing", F.coalesce(F.nullif(filing, F.lit("")), fallback)).when(source_type == "biomedical_abstract", abstract).otherwise(fallback)


def _markdown(row) -> str:
    """A document with its metadata as front matter; its sections, if it has any, under their headings."""
    import json

    meta = {k: v for k, v in json.loads(row["meta"]).items() if v not in (None, [], {}) and k not in ("extras", "source_file")}
    head = "\n".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in {"source_type": row["source_type"], **meta}.items())
    body = "\n\n".join(f"## {s['heading']}\n\n{s['text']}" for s in row["sections"] or []) or row["text"]
    return f"---\n{head}\n---\n\n{body}\n"


class MarkdownSink(DataSource):
    """``df.write.format("markdown_files")``: a file <doc_id>.md for each row, in a folder of any file system Arrow knows
    (local, hdfs, s3). Tasks write to names of their own; a file is given its name when all tasks are through."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _MarkdownWriter(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    moves: list


class _MarkdownWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def _place(self):
        from pyarrow import fs

        local = re.sub("^file:/*", "/", self.folder)
        files, folder = fs.FileSystem.from_uri(self.folder) if "://" in local else (fs.LocalFileSystem(), local)
        files.create_dir(folder, recursive=True)
        return files, folder.rstrip("/")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from uuid import uuid4

        files, folder = self._place()
        moves = []
        for row in rows:
            part = f"{folder}/.{row['doc_id']}-{uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(_markdown(row).encode())
            moves.append((part, f"{folder}/{row['doc_id']}.md"))
        return _Written(moves)

    def commit(self, messages: list) -> None:
        files, _ = self._place()
        for part, name in (m for message in messages if message for m in message.moves):
            files.move(part, name)

    def abort(self, messages: list) -> None:
        files, _ = self._place()
        for part, _name in (m for message in messages if message for m in message.moves):
            files.delete_file(part)


def write_markdown(docs: DataFrame, folder: str) -> None:
    """One Markdown file with front matter for each document, written by the executors to a shared folder."""
    docs.sparkSession.dataSource.register(MarkdownSink)
    docs.select("doc_id", "source_type", "text", F.to_json("metadata").alias("meta"), "sections").write.format("markdown_files").mode("append").option("path", folder).save()


def write_chunks_jsonl(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks as JSON lines; returns the counts by source type."""
    chunks.write.mode("overwrite").json(path)
    return chunks.sparkSession.read.schema(chunks.schema).json(path).groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks"))
