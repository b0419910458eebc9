"""Text functions against worked examples and a plain Python reading of the rules."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundline.functions import text as T
from groundline.functions import vocabulary as V


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


STEMS = {
    "turbines": "turbine", "editing": "edit", "reported": "report", "analyses": "analysis", "studies": "study", "classes": "class", "boxes": "box", "running": "run", "planned": "plan", "increased": "increase",
    "placed": "place", "data": "datum", "gas": "gas", "string": "string", "basis": "basis", "status": "status", "operating": "operate", "its": "its", "10-k": "10-k", "series": "sery", "having": "have", "seed": "seed",
}


def test_stems(spark):
    assert values(spark, T.stem, list(STEMS)) == list(STEMS.values())


def test_tokens(spark):
    assert values(spark, T.tokens, ["The U.S. rate-cut: 3.5% in Q4's", None, "", "ÀB c"]) == [["the", "u.s", "rate-cut", "3.5", "in", "q4's"], [], [], ["b", "c"]]
    assert values(spark, T.content_tokens, ["What were the reported margins?"]) == [["report", "margin"]]


def test_sentences(spark):
    found = values(spark, T.sentences, ["Bluefern Inc. reported revenue. It grew 3.5 percent. J. Smith agreed.", None, "  ", "One.\nTwo! (Three) lower. four", "Inc. Next"])
    assert found == [["Bluefern Inc. reported revenue.", "It grew 3.5 percent.", "J. Smith agreed."], None, [], ["One.", "Two!", "(Three) lower. four"], ["Inc. Next"]]


def plain_normalise(text):
    text = re.sub(r"[ \t\r\f\v]+", " ", unicodedata.normalize("NFKC", text).replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in text.split("\n"))).strip()


def plain_sentences(text):
    pieces = [p.strip() for p in re.split(V.SENTENCE_END, plain_normalise(text).replace("\n", " ")) if p.strip()]
    out = []
    for p in pieces:
        last = out[-1].rsplit(" ", 1)[-1].lower() if out else ""
        if out and (last in V.ABBREVIATIONS or re.fullmatch(r"[a-z]\.", last)):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


ODD = ["a b  c\n \n\n\n d　e \r\n x y", "ﬁne ① ％ é", "  lead\n\n\ntrail \n ", "x\x1cy\x85z", "\t\n", "No. 5 was left. No. Then Dr. Who (came). \"Yes.\" A. B. C"]


def test_normalise_and_split_like_the_rules(spark):
    assert values(spark, T.normalise_whitespace, ODD) == [plain_normalise(t) for t in ODD]
    assert values(spark, T.sentences, ODD) == [plain_sentences(t) for t in ODD]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB. 1\n 　!?(\"'cIn\t", max_size=40), min_size=20, max_size=60))
def test_sentences_of_random_texts(spark, texts):
    assert values(spark, T.sentences, texts) == [plain_sentences(t) for t in texts]


def test_overlap_measures(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], ["a"]), (["a"], [])], "a array<string>, b array<string>")
    got = [tuple(r) for r in df.select(T.jaccard(F.col("a"), F.col("b")), T.containment(F.col("a"), F.col("b"))).collect()]
    assert got == [(pytest.approx(1 / 3), 0.5), (0.0, 0.0), (0.0, 0.0)]


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(T.bigrams(F.col("a"))).collect()] == [["a_b", "b_c"], [], []]


def test_truncate_and_hash(spark):
    assert values(spark, lambda t: T.truncate(t, 12), ["short", "some longer text", "unbrokenandlong", "exactly12chr"]) == ["short", "some...", "unbrokena...", "exactly12chr"]
    import hashlib

    assert values(spark, lambda t: T.stable_hash(F.lit("x"), t), ["y"]) == [hashlib.sha256("x␟y".encode()).hexdigest()[:16]]


def test_cleaning(spark):
    text = "Page 3 of 10\nTable of Contents\n© 2020 Someone\nRevenue ........ 12\nWow!!!!! ok -----\n- 4 -\n12 | page\nKept page 3 line"
    assert values(spark, T.clean_document_text, [text]) == ["Revenue\nWow! ok -\n\nKept page 3 line"]


def test_markers(spark):
    df = spark.createDataFrame([("A [1] and [7] then[2].", [1, 2])], "t string, v array<int>")
    got = df.select(T.markers(F.col("t")).alias("m"), T.strip_unresolvable_markers(F.col("t"), F.col("v")).alias("s")).first()
    assert got.m == [1, 7, 2] and got.s == "A [1] and then [2]."


def test_entities(spark):
    got = values(spark, T.entities, ["Compare Bluefern Energy against Corvane Payments in 2024", "Compare Bluefern", "the Corvane Payments and Corvane Payments", "Versus Alpha"])
    assert got == [["Bluefern Energy", "Corvane Payments"], [], ["Corvane Payments"], []]


def test_small_ones(spark):
    assert values(spark, T.redact_url, ["postgresql://user:secret@host:5432/x", "sqlite:///x"]) == ["postgresql://user:***@host:5432/x", "sqlite:///x"]
    assert values(spark, T.pad_cik, ["1234567", " 12345678901 "]) == ["0001234567", "12345678901"]
    assert values(spark, T.token_count, ["a b c　d\u0085e", "", None]) == [5, 0, 0]
