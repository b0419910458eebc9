"""Chunking, judgements, planning, sources, store, streams and answers."""

import json
import re

import pytest
from pyspark.sql import functions as F

from groundline.config import ConfigurationError, Settings
from groundline.functions import text as T
from groundline.operators import answers, chunking, planning, relevance, store
from groundline.plans import search
from groundline.sources import abstracts, files, filings, html, http, judgements
from groundline.streaming import monitor


def test_fixed_windows(spark):
    long = "  " + " \n".join(f"w{i}" for i in range(100)) + " "
    docs = spark.createDataFrame([(1, long), (2, " few words "), (3, None), (4, "  ")], "d int, t string")
    got = chunking.fixed_windows(docs, "d", "t", 30, 10, 12).orderBy("d", "position").collect()
    spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", long)]
    want = [(s, min(s + 30, 100)) for s in range(0, 100, 20)]
    want = [(s, e) for s, e in want if s == 0 or s - 20 + 30 < 100]
    one = [r for r in got if r.d == 1]
    assert [(r.char_start, r.char_end) for r in one] == [(spans[s][0], spans[e - 1][1]) for s, e in want if e - s >= 12]
    assert [r.text.split()[0] for r in one] == [f"w{s}" for s, e in want if e - s >= 12]
    assert [(r.d, r.text, r.char_start, r.char_end) for r in got if r.d > 1] == [(2, " few words ", 0, 11)]


def test_packing():
    s = ["a b c d", "e f g h", "i j", "k l m n o p q r s t u v", "w"]
    got = chunking.packed(s, 10, 4, 3)
    assert got[0] == "a b c d e f g h i j" and all(x in " ".join(got) for x in s)
    assert chunking.packed(["a b c d", "e"], 3, 0, 1) == ["a b c d", "e"]
    assert chunking.packed(["a b c d e f"], 5, 1, 4) == ["a b c d e f"] and chunking.packed([], 10, 4, 3) == []
    # a carry takes one sentence at least, even one beyond the overlap
    assert chunking.packed(["a b c", "d e f", "g h i"], 6, 1, 1) == ["a b c d e f", "d e f g h i"]


def test_section_windows(spark):
    text = "Intro here.\n\n## First\n\nAlpha one two. Beta three four.\n\n## Second\n\nGamma five."
    docs = spark.createDataFrame([(1, text), (2, "Plain text only."), (3, "")], "d int, t string").withColumn("s", chunking.markdown_sections(F.col("t")))
    got = chunking.section_windows(docs, "d", "t", "s", 5, 2, 1).orderBy("d", "position").collect()
    assert [(r.d, r.position, r.section_heading) for r in got] == [(1, 0, "First"), (1, 1, "First"), (1, 2, "Second"), (2, 0, None)]
    assert all(text[r.char_start :].startswith(r.text[:10]) for r in got if r.d == 1)


def test_boilerplate(spark):
    docs = spark.createDataFrame([(1, "H\na\nH \nb\n H\nc"), (2, "x\nx"), (3, None)], "d int, t string")
    assert [r.t for r in chunking.drop_boilerplate(docs, "d", "t").orderBy("d").collect()] == ["a\nb\nc", "x\nx", None]


def test_ranges(spark):
    r = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 8, 12), ("a", 20, 21), ("b", 0, 3), ("b", None, 3)], "g string, start int, end int")
    assert sorted(tuple(x) for x in chunking.merged_ranges(r, "g").collect()) == [("a", 0, 12), ("a", 20, 21), ("b", 0, 3)]


def test_section_spans_and_resolution(spark):
    text = "Same body. tail Same body. end"
    docs = spark.createDataFrame([("f", text, [("A", "Same body."), ("B", "Same body."), ("C", "missing"), ("B", "end")])], "f string, t string, s array<struct<heading:string,text:string>>")
    spans = relevance.section_spans(docs, "f", "t", "s").withColumnRenamed("f", "document")
    assert sorted((r.heading, r.start, r.end) for r in spans.collect()) == [("A", 0, 10), ("B", 27, 30)]
    chunks = spark.createDataFrame([("c1", "f", "A", 0, 12), ("c2", "f", "X", 8, 30), ("c3", "g", "C", 0, 5), ("c4", None, "A", 0, 5)], "chunk_id string, document string, section_heading string, char_start int, char_end int")
    targets = spark.createDataFrame([("q1", 0, "f", ["A"]), ("q2", 0, "f", None), ("q3", 0, "g", ["C"]), ("q4", 0, "g", ["Z"]), ("q5", 0, "f", ["A", "B"])], "query_id string, target int, document string, sections array<string>")
    rel = relevance.resolve(targets, chunks, spans)
    assert sorted(tuple(r) for r in rel.collect()) == [("q1", "c1"), ("q2", "c1"), ("q2", "c2"), ("q3", "c3"), ("q5", "c1")]
    assert [r[0] for r in relevance.unresolved(targets, rel).collect()] == ["q4"]


def test_training_split(spark):
    ids = spark.createDataFrame([(f"q{i:03d}",) for i in range(1000)] + [(None,)], "query_id string")
    parts = ids.select("query_id", relevance.in_training(F.col("query_id")).alias("a"), relevance.in_training(F.col("query_id"), 0.1).alias("b"), relevance.in_training(F.col("query_id"), seed=1).alias("c")).collect()
    assert 450 < sum(r.a for r in parts) < 550 and 70 < sum(r.b for r in parts) < 130 and all(r.a for r in parts if r.b) and any(r.a != r.c for r in parts)
    assert not parts[-1].a
    with pytest.raises(ConfigurationError):
        relevance.in_training(F.col("query_id"), 1.0)


PLANS = {
    "Compare Bluefern Energy revenue in 2023 versus 2024": ("temporal_comparison", ["Bluefern Energy revenue in 2023", "Bluefern Energy revenue in 2024"], "Bluefern Energy", "financial_lookup"),
    "Compare Bluefern Energy against Corvane Payments margin": ("entity_comparison", ["Bluefern Energy margin", "Corvane Payments margin"], None, "financial_lookup"),
    "What is the trial endpoint and how many patients enrolled?": ("conjunction", ["What is the trial endpoint?", "how many patients enrolled?"], None, "biomedical_search"),
    "Who approves access?": ("single_hop", ["Who approves access?"], None, "document_search"),
}


def test_plans(spark):
    q = spark.createDataFrame([*[(i, t) for i, t in enumerate(PLANS)], (9, None)], "q int, t string")
    got = planning.plans(q, "q", "t").orderBy("q", "sub_ix").collect()
    for i, (strategy, subs, entity, tool) in enumerate(PLANS.values()):
        mine = [r for r in got if r.q == i]
        assert [r.sub_query for r in mine] == subs and {r.strategy for r in mine} == {strategy} and mine[0].tool == tool
        if strategy == "entity_comparison":
            # "Energy margin" is no name: its second word is not capitalised
            assert [r.entity for r in mine] == ["Bluefern Energy", "Corvane Payments"]
        elif entity:
            assert {r.entity for r in mine} == {entity}
    assert planning.plans(q, "q", "t", enabled=False).count() == 4
    year = spark.createDataFrame([("compare fiscal 2024 and 2023 sales",)], "t string").select(planning.periods(F.col("t"))).first()[0]
    assert year == ["2024", "2023", "fiscal 2024"]


def test_html():
    page = "<html><head><title>x</title></head><body><script>no()</script><h1>A</h1><p>b &amp; c<br>d</p><noscript>n</noscript><div>e</div></body></html>"
    assert re.sub(r"\s+", " ", html.page_text(page)).strip() == "A b & c d e" and html.page_text(None) is None


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_b.md").write_text("---\nsource_type: sec_filing\ncik: 1234567\nfiscal_year: 2024\ncolour: red\nauthors: [A, B]\n---\n\npre\n\n## One ##\n\nBody one.\n\n## Empty\n\n## Two\n\nBody two.")
    (tmp_path / "sub" / "p.html").write_text("<p>Hi</p><p>there</p>")
    (tmp_path / "bad.md").write_text("---\n- list\n---\n\nx")
    (tmp_path / "odd.txt").write_text("---\nsource_type: nothing\n---\nx")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.csv").write_text("x")
    docs, bad = files.read_directory(spark, str(tmp_path))
    got = {r.metadata.source_file: r for r in docs.collect()}
    assert set(got) == {"a_b.md", "p.html"} and {r.path.rsplit("/", 1)[-1] for r in bad.collect()} == {"bad.md", "odd.txt", "scan.pdf"}
    md = got["a_b.md"]
    assert md.metadata.cik == "0001234567" and md.metadata.title == "A B" and md.metadata.extras == {"colour": "red"} and md.metadata.authors == ["A", "B"]
    assert [(s.heading, s.text, s.order) for s in md.sections] == [("One", "Body one.", 0), ("Two", "Body two.", 2)] and md.text.startswith("pre\n\n## One")
    assert got["p.html"].text.split() == ["Hi", "there"]
    out = tmp_path / "out"
    files.write_markdown(docs, str(out))
    again, _ = files.read_directory(spark, str(out))
    assert {r.metadata.cik for r in again.collect()} == {"0001234567", None} and len(list(out.iterdir())) == 2


def test_enrichment(spark):
    base = spark.createDataFrame([("sec_filing", "Form 10-k. For the fiscal year ended June 30, 2021. Central Index Key: 12345"), ("biomedical_abstract", "In 1999 we"), ("user_document", "\n  First line \nx 2001")], "source_type string, text string")
    meta = F.struct(F.lit(None).cast("string").alias("title"), F.lit("Acme").alias("company_name"), F.lit(None).cast("string").alias("form_type"), F.lit(None).cast("int").alias("fiscal_year"), F.lit(None).cast("string").alias("cik"), F.lit(None).cast("int").alias("publication_year"), F.lit("J").alias("journal"))
    got = {r.source_type: r.metadata for r in files.enriched(base.withColumn("metadata", meta)).collect()}
    f = got["sec_filing"]
    assert (f.fiscal_year, f.form_type, f.cik, f.title) == (2021, "10-K", "0000012345", "Acme 10-K 2021")
    assert got["biomedical_abstract"].publication_year == 1999 and got["user_document"].title == "First line" and got["user_document"].publication_year is None


def test_filings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"cik": "1234", "name": "Acme", "tickers": ["ACM"], "filings": {"recent": {"accessionNumber": ["0000001234-24-000001", "0000001234-24-000002", "0000001234-23-000009"], "form": ["10-K", "8-K", "10-k"], "filingDate": ["2024-02-01", "2024-01-01", "2023-02-01"], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}}}))
    f = filings.list_filings(filings.read_submissions(spark, str(tmp_path / "s.json")), ["10-K"])
    rows = f.orderBy("pos").collect()
    assert [r.accession_number[-1] for r in rows] == ["1", "9"] and rows[0].document_url.endswith("/1234/000000123424000001/a.htm")
    d = filings.build_documents(f.withColumn("body", F.lit("Item 1. Business\nWe make.\nITEM 1A\n" + "Risk " * 40)), "body").first()
    assert d.fiscal_year in (2024, 2023) and [(s.heading, s.text) for s in d.sections] == [("Item 1. Business", "We make."), ("Item 1A. Risk Factors", ("Risk " * 40).strip())]
    assert filings.build_documents(f.withColumn("body", F.lit("none")), "body").first().sections[0].heading == "Full Text"
    entry = lambda fy, val, end, form="10-K", fp="FY": {"form": form, "fy": fy, "fp": fp, "val": val, "end": end, "accn": "a"}
    facts = {"cik": 1234, "entityName": "Acme", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [entry(2024, 5.5e9, "2024-06-30"), entry(2024, 5.6e9, "2024-12-31"), entry(2023, 5.2e9, "2023-12-31"), entry(2024, 1.0, "2025-01-01", "10-Q")]}}, "NetIncomeLoss": {"units": {"USD": [entry(2024, 4.1e8, "2024-12-31")]}}, "Other": {"units": {"USD": [entry(2024, 1.0, "2024-12-31")]}}}}}
    (tmp_path / "f.json").write_text(json.dumps(facts))
    got = {(r.concept, r.fiscal_year): r.value for r in filings.us_gaap_facts(filings.read_company_facts(spark, str(tmp_path / "f.json"))).collect()}
    assert got == {("Revenues", 2024): 5.6e9, ("Revenues", 2023): 5.2e9, ("NetIncomeLoss", 2024): 4.1e8}


ARTICLES = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>11</PMID><Article><Journal><ISOAbbreviation>J Med</ISOAbbreviation><Title>Journal</Title><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>A <i>bold</i> trial</ArticleTitle><Abstract><AbstractText Label="METHODS">We <b>did</b> &amp; saw.</AbstractText><AbstractText NlmCategory="RESULTS">Fine.</AbstractText><AbstractText/></Abstract>
<AuthorList><Author><LastName>Ng</LastName><Initials>A B</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article><MeshHeadingList><MeshHeading><DescriptorName>Humans</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><Title>Other</Title><JournalIssue><PubDate><MedlineDate>1998 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>Plain.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>13</PMID><Article><ArticleTitle>None</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_abstracts(spark):
    docs = abstracts.parse_articles(spark.createDataFrame([(ARTICLES,)], "x string"), "x").orderBy("pmid")
    a, b = docs.collect()
    assert (a.pmid, a.journal, a.publication_year, a.authors, a.mesh_terms) == ("11", "J Med", 2020, ["Ng A B"], ["Humans"])
    assert a.text == "A bold trial\n\nMethods: We did & saw.\n\nResults: Fine." and [s.heading for s in a.sections] == ["Methods", "Results"]
    assert (b.journal, b.publication_year, b.text, b.sections[0].heading) == ("Other", 1998, "T\n\nPlain.", "Abstract")
    s = abstracts.summarise(docs).first()
    assert tuple(s) == (2, 1, 1998, 2020)
    ids = spark.createDataFrame([('{"esearchresult":{"idlist":["3","1"]}}',)], "p string").select(abstracts.search_ids(F.col("p"))).first()[0]
    assert ids == ["3", "1"]


def test_judgements(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"version": "1", "note": "x", "queries": [{"query_id": "q", "query": "t", "relevant": [{"document": "a"}, {"document": "b", "sections": ["S"]}]}]}))
    j = judgements.read_judgements(spark, str(tmp_path / "q.json"))
    assert j.first()["type"] == "single_hop" and [(r.document, r.sections) for r in judgements.targets(j).orderBy("target").collect()] == [("a", []), ("b", ["S"])]
    (tmp_path / "e.json").write_text('{"queries": []}')
    with pytest.raises(ValueError):
        judgements.read_judgements(spark, str(tmp_path / "e.json"))


def test_http():
    import urllib.error

    slept, now = [], [0.0]
    slots = http.Slots(2, clock=lambda: now[0], sleep=slept.append)
    slots.take(), slots.take()
    assert slept == [0.5]
    now[0] = 9.1
    slots.take()
    assert slept == [0.5, pytest.approx(0.4)]
    calls = []

    class Page:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b"ok"

    def opener(request, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        return Page()

    slept.clear()
    assert http.fetch("http://x.example", {}, http.Slots(1e9, clock=lambda: 0.0, sleep=slept.append), opener) == "ok"
    assert [s for s in slept if s > 1] == [2.0, 4.0]


def test_store(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    b = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    once = store.upsert(t, b, ["k"], "n")
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a", 1), (2, "d", 2), (3, "e", 1)]
    assert sorted(tuple(r) for r in store.upsert(once, b, ["k"], "n").collect()) == sorted(tuple(r) for r in once.collect())
    facts = spark.createDataFrame([("1", "A", 2020, "U", 1.0), ("1", "B", 2021, "U", 2.0), ("2", "A", 2021, "U", 3.0)], "cik string, concept string, fiscal_year int, unit string, value double")
    assert [r.value for r in store.lookup_facts(facts, cik="1", fiscal_year=0).collect()] == [2.0, 1.0]
    wanted = spark.createDataFrame([("q", "1", None), ("r", "2", 2021), ("s", None, 2021)], "query_id string, cik string, fiscal_year int")
    assert sorted((r.query_id, r.value) for r in store.facts_of_queries(wanted, facts).collect()) == [("q", 1.0), ("q", 2.0), ("r", 3.0)]


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([("2020-01-01 00:01:00", 0.5, 100.0), ("2020-01-01 00:07:00", 0.9, 3000.0), ("2020-01-01 01:00:00", 1.0, 1.0)], "t string, groundedness double, latency_ms double").withColumn("created_at", F.col("t").cast("timestamp")).drop("t")
    w = monitor.log_windows(log)
    assert w.count() == 5 and monitor.alerts(w).count() == 3
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.log_windows(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # windows that the watermark has not passed stay open
    assert spark.table("w").count() == 3
    drop = tmp_path / "drop"
    drop.mkdir()
    for i, rows in enumerate(([{"k": 1, "v": "a"}, {"k": 2, "v": "b"}], [{"k": 2, "v": "c"}])):
        (drop / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        monitor.ingest(spark, str(drop), "k int, v string", str(tmp_path / "t"), ["k"], str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(tuple(r) for r in monitor.current(spark, str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]


EVIDENCE = [
    ("q", "c1", 1, "Bluefern revenue grew nine percent in fiscal 2024. Turbine margin fell as steel costs rose sharply. Short one."),
    ("q", "c2", 2, "Turbine margin fell as steel costs rose sharply. Unrelated staffing notes were filed in the annex."),
    ("e", "c3", 1, "Tiny."),
]


def test_answers(spark):
    ev = spark.createDataFrame(EVIDENCE, "query_id string, chunk_id string, rank int, text string")
    qs = spark.createDataFrame([("q", "Why did turbine margin fall?"), ("e", "What?"), ("n", "Nothing found")], "query_id string, query string")
    spans = answers.candidate_spans(ev).where("query_id = 'q'").orderBy("ord").collect()
    assert [s.span for s in spans][1] == "Turbine margin fell as steel costs rose sharply." and len({s.span for s in spans}) == len(spans)
    got = {r.query_id: r for r in answers.answers(qs, ev).collect()}
    assert got["q"].groundedness == 1.0 and got["q"].n_citations == got["q"].n_verified >= 1 and "turbine" in got["q"].text.lower() and "[1]" in got["q"].text
    assert got["n"].text.startswith("The indexed corpus does not contain") and got["n"].groundedness == 0.0 and got["e"].n_spans == 0
    cited = answers.citations(answers.select_spans(qs, ev))
    wrong = cited.withColumn("chunk_id", F.lit("gone"))
    assert answers.citation_correctness(cited, ev).first().supported == 1.0 and answers.citation_correctness(wrong, ev).first().resolvable == 0.0

    class Client:
        def complete(self, prompt):
            return "Fell [1] and rose [9]." if "[1]" in prompt else ""

    prompts = answers.numbered_prompts(qs, ev.withColumn("label", F.col("chunk_id")))
    valid = spark.createDataFrame([("q", [1, 2])], "query_id string, markers array<int>")
    assert {r.query_id: r.text for r in answers.completed(prompts, Client(), valid).collect()}["q"] == "Fell [1] and rose."


def test_whole_path(spark):
    chunks = spark.createDataFrame(
        [("c1", 1, "Bluefern Energy turbine margin fell in 2023 as steel costs rose across all plants.", "Results", "sec_filing", "Bluefern Energy", "10-K", None, None, "0000000001"),
         ("c2", 2, "Corvane Payments margin rose in 2023 because chargeback losses fell at every branch.", "Results", "sec_filing", "Corvane Payments", "10-K", None, None, "0000000002"),
         ("c3", 3, "Patients in the trial reached the endpoint after twelve weeks of placebo treatment.", "Methods", "biomedical_abstract", None, "Trial", None, "J", None)],
        "chunk_id string, doc_id int, text string, section_heading string, source_type string, company_name string, title string, ticker string, journal string, cik string",
    )
    s = Settings()
    index = search.build_index(chunks, s)
    qs = spark.createDataFrame([("a", "Compare Bluefern Energy against Corvane Payments margin"), ("b", "Which patients reached the trial endpoint?")], "query_id string, query string")
    found, plan, _ = search.evidence_for(index, qs, s)
    got = {(r.query_id, r.chunk_id) for r in found.collect()}
    assert {("a", "c1"), ("a", "c2"), ("b", "c3")} <= got and ("b", "c1") not in got
    out = {r.query_id: r for r in search.answer(index, qs, s).collect()}
    assert out["a"].n_subqueries == 2 and out["a"].tools_used == ["financial_lookup"] and out["b"].groundedness == 1.0
    assert index.describe().count() == 3


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 7\nchunking:\n  target_tokens: 120\nevaluation:\n  k_values: [5, 1, 5]\n")
    s = Settings.from_yaml(str(tmp_path / "c.yaml")).with_overrides({"retrieval.top_k": "20", "reranking.enabled": "false"})
    assert (s.seed, s.chunking.target_tokens, s.retrieval.top_k, s.reranking.enabled, s.evaluation.k_values) == (7, 120, 20, False, [1, 5])
    for bad in ({"retrieval.nope": 1}, {"nope": 1}, {"retrieval": 1}, {"chunking.overlap_tokens": 300}, {"retrieval.lexical_weight": 0.0, "retrieval.dense_weight": 0.0}, {"retrieval.candidate_k": 5}, {"evaluation.primary_k": 4}):
        with pytest.raises(ConfigurationError):
            Settings().with_overrides(bad)


def test_labels(spark):
    meta = F.struct(F.lit("T").alias("title"), F.lit("Acme").alias("company_name"), F.lit("10-K").alias("form_type"), F.lit(2024).alias("fiscal_year"), F.lit("J").alias("journal"), F.lit(2020).alias("publication_year"))
    df = spark.createDataFrame([("sec_filing", "Risk"), ("biomedical_abstract", None), ("user_document", None)], "s string, h string").withColumn("m", meta)
    got = [r[0] for r in df.select(files.citation_label(F.col("s"), F.col("m"), F.col("h"), F.lit("id"))).collect()]
    assert got == ["Acme - 10-K - FY2024 - Risk", "T (J, 2020)", "T"]


def test_token_helpers(spark):
    assert spark.range(1).select(F.size(T.words(F.lit("a b")))).first()[0] == 2


def test_evaluation_and_saved_index(spark, tmp_path):
    from groundline.operators import rerank
    from groundline.plans import evaluate

    texts = ["turbine margin fell in the northern plant this year", "chargeback losses fell at every branch of the bank", "placebo patients reached the trial endpoint late", "wind output grew with new turbine towers offshore"]
    chunks = spark.createDataFrame([(f"c{i}", i, t, "Head", "user_document", None, None, None, None, "0000000007" if i == 0 else None) for i, t in enumerate(texts)], "chunk_id string, doc_id int, text string, section_heading string, source_type string, company_name string, title string, ticker string, journal string, cik string")
    s = Settings().with_overrides({"reranking.enabled": False, "evaluation.token_budget": 10})
    index = search.build_index(chunks, s)
    judged = spark.createDataFrame([("a", "turbine margin 2021", "single_hop"), ("b", "trial endpoint", "other")], "query_id string, query string, type string")
    relevant = spark.createDataFrame([("a", "c0"), ("b", "c2")], "query_id string, chunk_id string")
    per_query = evaluate.evaluate_retrieval(index, judged, relevant, s)
    out = evaluate.compare(s, lambda x: evaluate.evaluate_retrieval(index, judged, relevant, x), {"default": {}, "lexical_only": evaluate.VARIANTS["lexical_only"]})
    assert per_query.count() == 2 and out["default"]["metrics"]["recall_at_1"] == 1.0 and set(out["default"]["by_query_type"]) == {"single_hop", "other"}
    assert "| lexical_only | 1.000" in evaluate.markdown_table(out, ["reciprocal_rank", "nothing"])
    index.model = rerank.fit(evaluate.training_rows(index, judged.select("query_id", "query"), relevant, s))
    search.save_index(index, str(tmp_path / "i"))
    again = search.load_index(spark, str(tmp_path / "i"))
    hits = search.search(again, judged.select(F.col("query_id").alias("qid"), "query"), Settings(), 2)
    assert {r.chunk_id for r in hits.where("rank = 1").collect()} == {"c0", "c2"}
    facts = spark.createDataFrame([("0000000007", "Revenues", 2021, "USD", 1.0), ("0000000007", "Revenues", 2020, "USD", 2.0)], "cik string, concept string, fiscal_year int, unit string, value double")
    got = search.structured_facts(hits.withColumnRenamed("qid", "query_id").drop("query"), judged.select("query_id", "query"), facts)
    assert ("a", 1.0) in {(r.query_id, r.value) for r in got.collect()} and len(evaluate.sweep_settings(s)) == 12
    targets = spark.createDataFrame([("z", 0, "f", [])], "query_id string, target int, document string, sections array<string>")
    with pytest.raises(Exception, match="match no chunk"):
        evaluate.checked_relevance(targets, spark.createDataFrame([], "chunk_id string, document string, section_heading string, char_start int, char_end int"), spark.createDataFrame([], "document string, heading string, start int, end int"))
    assert "response" in search.responses(judged).columns
    assert len(abstracts.fetch_urls([str(i) for i in range(250)], "a@b.example")) == 3


def test_tables(spark):
    store.create_tables(spark, "groundline_test")
    assert spark.table("groundline_test.chunks").count() == 0
    store.drop_tables(spark, "groundline_test")
    spark.sql("DROP DATABASE groundline_test")
