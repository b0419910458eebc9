"""Near-duplicates, encoding, mixing and sentences."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundline.llm import mixing, neardup, sentences, tokenize

VOCABULARY = f"{tokenize.TOKENIZERS}/{tokenize.BYTE_BPE}"


# ---------------------------------------------------------------- near-duplicates


def brute_pairs(rows, width, at_least):
    sets = {}
    for k, t in rows:
        if k is not None and t is not None:
            sets.setdefault(k, []).append(neardup.shingles(t, width))
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(x and y and len(x & y) >= at_least * len(x | y) for x in sets[a] for y in sets[b]):
                out.add((a, b))
    return out


def family(rng, n, edits):
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(n)]
    for _ in range(edits):
        base[rng.randrange(n)] = "edit" + str(rng.random())[2:8]
    return base


@pytest.mark.parametrize(("width", "at_least"), [(3, 0.6), (5, 0.8)])
def test_pairs_like_brute_force(spark, width, at_least):
    rng = random.Random(5)
    rows = []
    for f in range(40):
        base = family(rng, 60, 0)
        for v in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(60)] = f"x{rng.random()}"
            rows.append((f"k{f}-{v}", " ".join(copy)))
    rows += [("same1", "One two, THREE four five six"), ("same2", "one two three  four five six!"), ("same3", "one two three  four five six!"), ("short1", "a b"), ("short2", "a b"), ("none", None), (None, "one two three four five six"), ("empty", ""), ("empty2", "")]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "chunk_id string, text string, id int, k string").repartition(4)
    got = {tuple(r) for r in neardup.similar_pairs(df, "chunk_id", "text", width, at_least).collect()}
    want = brute_pairs(rows, width, at_least)
    assert got <= want and len(want - got) <= 0.01 * len(want), want - got


def test_copies_beyond_the_limit_form_a_star(spark):
    t, u = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven"
    rows = [(f"a{i:02d}", t) for i in range(20)] + [("b0", u), ("b1", u)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = {tuple(r) for r in neardup.similar_pairs(df, "chunk_id", "text", 3, 0.6, copy_pairs=16).collect()}
    assert got == {("a00", f"a{i:02d}") for i in range(1, 20)} | {("a00", "b0"), ("b0", "b1")}


def test_lists_with_many_texts_are_tiled_over_partitions(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(f"k{i:02d}", f"{base} tail{i}") for i in range(60)], "chunk_id string, text string")
    seen = []

    def spied(tiles, f=neardup.numbered_tile_pairs):
        out = f(tiles)
        seen.append((tiles.groupBy("list").count().agg(F.max("count")).first()[0], out.select(F.spark_partition_id()).distinct().count(), tiles.agg(F.sum(F.length("blob"))).first()[0]))
        return out

    monkeypatch.setattr(neardup, "numbered_tile_pairs", spied)
    monkeypatch.setattr(neardup, "HELD_POSTINGS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert neardup.similar_classes(df, "text", 3, 0.6, tile=8).count() == 60 * 59 // 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    most_tiles, partitions, size = seen[0]
    # tiles of one list go to several partitions, and what leaves the lists' own task is linear in their texts
    assert most_tiles >= 8 and partitions >= 3 and size <= 60 * (neardup.COORDINATES - neardup.MATCHES + 1) * neardup.HELD.itemsize


def test_the_rarest_values_are_posted():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 2**32, (500, neardup.COORDINATES), dtype=np.uint32)
    sig[:, :20] = sig[0, :20]  # values that all texts have
    counts = np.bincount((neardup._pairs_hashed(sig) % np.uint64(neardup.CELLS)).astype(np.int64).ravel(), minlength=neardup.CELLS).astype(np.int32)
    p = neardup.postings(np.arange(500), sig, counts, 12).reshape(-1, 500)
    # 21 are posted: the 12 of a text's own first, common ones only behind them
    assert len(p) == 21 and all(len(np.unique(p["key"][i])) >= 499 for i in range(12)) and len(np.unique(p["key"][12:])) <= 10


def test_links_and_members_state_all(spark):
    t, u = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven"
    rows = [(f"a{i:02d}", t) for i in range(20)] + [("b0", u), ("b1", u), ("c", "else"), (None, t), ("d", None), ("b0", u)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "chunk_id string, text string, h1 int, rep string")
    assert [tuple(r)[:2] for r in neardup.similar_links(df, "chunk_id", "text", 3, 0.6).collect()] == [("a00", "b0")]
    members = sorted((r.chunk_id, r.rep, r.n) for r in neardup.class_members(df, "chunk_id", "text").collect())
    assert members == [(f"a{i:02d}", "a00", 20) for i in range(20)] + [("b0", "b0", 2), ("b1", "b0", 2), ("c", "c", 1)]


def test_numbers_of_several_files_in_one_batch():
    import pyarrow as pa

    sig = np.arange(4 * neardup.COORDINATES, dtype=np.uint32).reshape(4, -1)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 1 << 33, (1 << 33) + 5]), pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "signature"])
    out = list(neardup._post_batches(np.zeros(neardup.CELLS, np.int32), 2, 12)(iter([batch])))
    got = {int(r["row"]) + base for b in out for base, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) for r in np.frombuffer(blob, neardup.POSTING)}
    assert got == {0, 1, 1 << 33, (1 << 33) + 5}


def test_nothing_is_similar_to_nothing(spark):
    assert neardup.similar_pairs(spark.createDataFrame([], "chunk_id string, text string"), "chunk_id", "text").count() == 0


def test_signatures_do_not_cross_texts():
    texts = ["a b c d e", "x", None, "f g h i", "a b c d e"]
    rows, sig = neardup.signatures(texts, 3)
    assert list(rows) == [0, 3, 4] and (sig[0] == sig[2]).all() and (sig[0] != sig[1]).any()
    alone = [neardup.signatures([t], 3)[1][0] for t in ("a b c d e", "f g h i")]
    assert (alone[0] == sig[0]).all() and (alone[1] == sig[1]).all()


def test_words_are_letters_marks_and_digits():
    assert neardup.words("Ab_c-D́é हिन्दी x²") == ["ab", "c", "d́é", "हिन्दी", "x²"] and neardup.words(None) == []


def test_signature_agreement_estimates_similarity():
    rng = random.Random(0)
    base = family(rng, 300, 0)
    near = base[:240] + family(rng, 60, 0)
    _, sig = neardup.signatures([" ".join(base), " ".join(near)], 3)
    a, b = neardup.shingles(" ".join(base), 3), neardup.shingles(" ".join(near), 3)
    assert abs(np.mean(sig[0] == sig[1]) - len(a & b) / len(a | b)) < 0.2


# ---------------------------------------------------------------- encoding

TEXTS = [
    None, "", " ", "  two  spaces ", "plain words, it's fine", "<|endoftext|> is text", "tab\tand\nline \n\n end", "ünïcödé 東京 हिन्दी ไทย 🧪‍🔬", "a b 　c  ", "x" * 3000, " " * 700, "\n \n  \n x",
    "word " * 2000, "mixed 123,456.78 (§4) " * 300, "漢字" * 900, "á 'll 've don't" * 50, "﻿bom \x00 nul",
]


@pytest.mark.parametrize("how", [{}, {"chunk": 64, "overlap": 32}, {"chunk": 90, "overlap": 24, "deal": 200, "deal_overlap": 40}, {"deal": 1000, "deal_overlap": 64}])
def test_ids_like_the_whole_text(spark, how):
    plain = tokenize.encoder(VOCABULARY)._bpe
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, "x"), (9, TEXTS[9], 1, "x"), (None, "null key", 1, "x")], "doc_id int, text string, id int, ids string").repartition(3)
    got = [(r.doc_id, r.ids) for r in tokenize.encode_corpus(docs, **how).collect()]
    assert len(got) == len(TEXTS) + 3
    for i, ids in got:
        assert ids == plain.encode_ordinary("null key" if i is None else TEXTS[i] or ""), i
    counted = sorted((str(r.doc_id), r.n_tokens) for r in tokenize.count_tokens(docs, **how).collect())
    assert counted == sorted((str(i), len(ids)) for i, ids in got)


ODD = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\xa0'aB1.,é漢\x1c\x85"), st.characters(blacklist_categories=["Cs"])), max_size=80)


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_pieces_encode_and_decode_exactly(text):
    enc = tokenize.encoder(VOCABULARY)
    for chunk, overlap in ((1024, 64), (12, 11), (16, 12)):
        ids = list(enc.ids(text, chunk, overlap))
        assert ids == enc._bpe.encode_ordinary(text) and enc.count(text, chunk, overlap) == len(ids) and enc.decode(ids) == text


def test_chunks_of_real_texts_are_stitched():
    import pyarrow.parquet as pq

    seams, texts = [], pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    stitched = 0
    for t in filter(None, texts):
        before = len(seams)
        assert tokenize.pretokens(t, seams=seams) == tokenize._find(t)
        stitched += len(seams) > before
    assert len(seams) > 500 and stitched > len(texts) / 2


def test_only_the_overlap_without_a_boundary_is_widened():
    seams: list[int] = []
    text = "plain words " * 500 + "x" * 5000 + " plain words" * 500
    assert tokenize.pretokens(text, seams=seams) == tokenize._find(text)
    assert seams.count(64) >= 6 and 1 <= sum(w > 64 for w in seams) <= 4


def test_same_ids_as_the_other_file():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    enc = tokenize.encoder(VOCABULARY)
    for t in filter(None, TEXTS):
        assert list(enc.ids(t)) == other.encode(t, add_special_tokens=False).ids


def test_counts(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "s"), (3, "", None)], "doc_id int, text string, source string")
    assert [(r.doc_id, r.source, r.n_tokens) for r in tokenize.count_tokens(df).orderBy("doc_id").collect()] == [(1, "s", 2), (2, "s", 0), (3, None, 0)]
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing

SIZED, TARGETS = "doc_id int, source string, n_tokens bigint, w double", "mix_name string, source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, **how):
    mix, report = mixing.mix_sources(spark.createDataFrame(docs, SIZED), spark.createDataFrame(targets, TARGETS), **how)
    return [r.asDict() for r in mix.collect()], {(r.mix_name, r.source): r.asDict() for r in report.collect()}


def fill(shares, caps, total):
    """Water-filling by bisection on the water level."""
    lo, hi = 0.0, total / min(s for s in shares if s > 0) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(c, s * mid) for s, c in zip(shares, caps)) < total:
            lo = mid
        else:
            hi = mid
    return [min(c, s * hi) for s, c in zip(shares, caps)]


@pytest.mark.parametrize("seed", range(3))
def test_shares_come_near_their_goals(spark, seed):
    rng = random.Random(seed)
    docs = [(i, rng.choice("aaabbc"), rng.randint(1, 50), rng.choice([1.0, 0.5, 0.25])) for i in range(800)] + [(900, None, 9, 1.0), (901, "a", 0, 1.0)]
    targets = [("m", "a", 1.0, None), ("m", "b", 3.0, 2), ("m", "c", 4.0, 3), ("m", "gone", 2.0, 5), ("n", "c", 0.5, 9), ("n", "b", 0.5, 1), ("n", "x", None, 1), (None, "a", 1.0, 1)]
    mix, report = mixed(spark, docs, targets, buckets=8)
    size = {s: sum(n for _, t, n, _ in docs if t == s) for s in "abc"}
    goal = fill([1, 3, 4], [size["a"], 2 * size["b"], 3 * size["c"]], sum(size.values()))
    for s, g in zip("abc", goal):
        r = report["m", s]
        assert r["goal_tokens"] == pytest.approx(g, rel=1e-6, abs=0.01) and abs(r["tokens"] - g) <= 50
    assert report["m", "gone"]["tokens"] == 0 and report["n", "x"]["tokens"] == 0 and set(r["mix_name"] for r in mix) == {"m", "n"}
    caps = {("m", "a"): 1, ("m", "b"): 2, ("m", "c"): 3, ("n", "c"): 9, ("n", "b"): 1}
    assert all(0 < r["copies"] <= caps[r["mix_name"], r["source"]] for r in mix) and len({(r["mix_name"], r["doc_id"]) for r in mix}) == len(mix)
    # the extra copy is one at most: copies of a source differ by one
    for key in caps:
        c = {r["copies"] for r in mix if (r["mix_name"], r["source"]) == key}
        assert max(c) - min(c) <= 1
    again, _ = mixed(spark, docs, targets, buckets=4096)
    key = lambda r: (r["mix_name"], r["doc_id"], r["copies"])
    assert sorted(map(key, again)) == sorted(map(key, mix))


def test_weights_change_the_odds(spark):
    docs = [(i, "a", 10, 1.0 if i % 2 else 0.25) for i in range(2000)] + [(5000, "b", 20_000, 1.0)]
    mix, report = mixed(spark, docs, [("m", "a", 1.0, 1), ("m", "b", 3.0, 2)])
    taken = [r["doc_id"] for r in mix if r["source"] == "a"]
    assert report["m", "a"]["tokens"] == 10_000 and sum(i % 2 for i in taken) == pytest.approx(800, abs=60)


def test_empty_mixes(spark):
    mix, report = mixed(spark, [], [("m", "a", 1.0, 1)])
    assert mix == [] and report["m", "a"]["tokens"] == 0 and report["m", "a"]["share"] is None
    assert mixed(spark, [(1, "a", 5, 1.0)], [])[0] == []


# ---------------------------------------------------------------- sentences

CASES = {
    "# Head line\nBody one. Body two!\n\n- item. one\n* item two\nLast": ["# Head line", "Body one.", "Body two!", "- item. one", "* item two", "Last"],
    "We paid $3.5 million to Acme Inc. in Jan. 2020. Dr. J. Smith of the U.S. unit left.": ["We paid $3.5 million to Acme Inc. in Jan. 2020.", "Dr. J. Smith of the U.S. unit left."],
    "Refund from the U.S. Backlog rose, cf. Fig. 10A. mardoxacin was given.": ["Refund from the U.S.", "Backlog rose, cf. Fig. 10A.", "mardoxacin was given."],
    "He asked, \"Is it enough?\" before the vote. \"Yes. We are.\" Then he left.": ["He asked, \"Is it enough?\" before the vote.", "\"Yes.", "We are.\"", "Then he left."],
    "Rash in 3 patients.[12] Mean was 4.\n(All sold.) Lost... and found.": ["Rash in 3 patients.[12]", "Mean was 4.", "(All sold.)", "Lost... and found."],
    "near the delta.All authors agree. Data go to Acme Corp.. Set x=1 in a.yaml; done.": ["near the delta.", "All authors agree.", "Data go to Acme Corp..", "Set x=1 in a.yaml; done."],
    "antibodies to hepatitis E. Patients left. See E. coli and Mr. E. Foo.": ["antibodies to hepatitis E.", "Patients left.", "See E. coli and Mr. E. Foo."],
    "审计师写道：“库存少了6,651件。没有解释。”“我们将关闭，”他说。为何？": ["审计师写道：“库存少了6,651件。", "没有解释。”", "“我们将关闭，”他说。", "为何？"],
    "「拠点を閉鎖する。」と述べた。なった！": ["「拠点を閉鎖する。」と述べた。", "なった！"],
    "क्या बेचा? डॉ. आरवेंद्र ने 2 मि.ग्रा. खुराक दी। अंत": ["क्या बेचा?", "डॉ. आरवेंद्र ने 2 मि.ग्रा. खुराक दी।", "अंत"],
    "قال د. سالم: «سنغلق 7 فرعا». هل دفعت؟ نعم": ["قال د. سالم: «سنغلق 7 فرعا».", "هل دفعت؟", "نعم"],
    "Am 25. Juli stieg er im 3. Quartal auf 3 Mio. Euro, d. h. nur teilweise (s. Abb. 4). Wie hoch?": ["Am 25. Juli stieg er im 3. Quartal auf 3 Mio. Euro, d. h. nur teilweise (s. Abb. 4).", "Wie hoch?"],
    "Продала в 2016 г., а в 2015 г. Ген найден (см. рис. 3). «Да», — сказал он за 3 тыс. руб. в год!": ["Продала в 2016 г., а в 2015 г.", "Ген найден (см. рис. 3).", "«Да», — сказал он за 3 тыс. руб. в год!"],
    "Le Dr Roy (cf. fig. 9) a baissé de 3 % en 2014 ! Quel est le montant ?": ["Le Dr Roy (cf. fig. 9) a baissé de 3 % en 2014 !", "Quel est le montant ?"],
    "¡Perdió 3 euros! ¿Cuánto pagó? El Sr. P. Roy de EE. UU. crecieron, p. ej. los otros.": ["¡Perdió 3 euros!", "¿Cuánto pagó?", "El Sr. P. Roy de EE. UU. crecieron, p. ej. los otros."],
    "โรงงานหยุดผลิต 12 วันและเสียหาย 429 ชิ้นในปี 2009 บริษัทมีรายได้ 41.56 ล้านบาทในปี 2009 เพิ่มขึ้นร้อยละ 5.0 จากปีก่อน ผู้ป่วยได้รับยา 43.46 มก. เป็นเวลา 8 สัปดาห์": [
        "โรงงานหยุดผลิต 12 วันและเสียหาย 429 ชิ้นในปี 2009", "บริษัทมีรายได้ 41.56 ล้านบาทในปี 2009 เพิ่มขึ้นร้อยละ 5.0 จากปีก่อน", "ผู้ป่วยได้รับยา 43.46 มก. เป็นเวลา 8 สัปดาห์",
    ],
    "﻿  One line\nwrapped on.\r\n\r\nNext   para": ["One line\nwrapped on.", "Next   para"],
}


@pytest.mark.parametrize("text", list(CASES), ids=range(len(CASES)))
def test_units(text):
    assert [text[a:b] for a, b in sentences.spans(text)] == CASES[text]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB1 .!?\n\r\"“”«»()[]。」。ก -*#﻿"), st.characters(blacklist_categories=["Cs"])), max_size=120))
def test_units_cover_all_but_white_space_in_order(text):
    at = 0
    for a, b in sentences.spans(text):
        assert at <= a < b and not text[at:a].strip(sentences._TRIM) and not {text[a], text[b - 1]} & set(sentences._TRIM)
        at = b
    assert not text[at:].strip(sentences._TRIM)


def test_units_of_a_table(spark):
    docs = spark.createDataFrame([(1, "One. Two.", 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (None, "Key.", 5), (1, "One. Two.", 5)], "doc_id int, text string, sent_start int")
    got = sorted((tuple(r) for r in sentences.sentence_units(docs).collect()), key=str)
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (None, 0, 4)]
    assert sentences.sentence_units(docs.limit(0)).count() == 0
    said = spark.createDataFrame([(1, "One. Two.", "xx"), (2, "One. Two.", None)], "doc_id int, text string, lang string")
    assert sentences.sentence_units(said, lang="lang").count() == 4


def test_long_text_is_linear():
    import time

    text = "This is sentence no. 5 of Acme Inc. \"Quoted?\" he asked. " * 20_000
    t = time.process_time()
    assert len(sentences.spans(text)) == 40_000
    assert time.process_time() - t < 20


SCRIPTS = {
    "Armenian": ["Երեւան։", "Մեծ է։", "Այո։"], "Ethiopic": ["ሰላም።", "ነው።", "እሺ"], "Khmer": ["ខ្ញុំ។", "ទៅ។", "ផ្ទះ"], "Burmese": ["မြန်မာ။", "ကောင်း။", "အိုကေ"],
    "Tibetan": ["བོད།", "ཡིག།", "ད"], "doubled": ["What‼", "Now⁉", "Yes"], "wide": ["全角．", "終わり．", "はい３．５です"], "Han before a digit or letter": ["收入增长。", "2019年下降！", "a组"],
}


@pytest.mark.parametrize("script", list(SCRIPTS))
def test_terminators_of_all_scripts(script):
    for gap in (" ", "  ") if not script.startswith(("wide", "Han")) else ("", " "):
        text = gap.join(SCRIPTS[script])
        assert [text[a:b] for a, b in sentences.spans(text)] == SCRIPTS[script]


def test_every_terminator_and_closer_of_the_property_data():
    for c in sentences.STOPS:
        if c not in ".…":
            text = f"Aa{c} Bb"
            assert len(sentences.spans(text)) == 2, hex(ord(c))
    for c in sentences.CLOSERS:
        if c not in sentences.QUOTES and c not in "'’":
            text = f"Aa!{c} Bb"
            assert sentences.spans(text)[0] == (0, 4), hex(ord(c))


def test_abbreviations_follow_the_language():
    english, german = "This is of the plant and of the hall. It was no z. Bigger ones are in the north.", "Das ist die Halle und der Hof, z. B. von der Firma."
    assert len(sentences.spans(english, "en")) == 3 and len(sentences.spans(english)) == 3
    assert len(sentences.spans(german, "de")) == 1 and len(sentences.spans(german, "en")) == 1 and len(sentences.spans(german)) == 1
    assert sentences.languages_of("short", None) == frozenset(sentences.TOLD_BY) and sentences.languages_of(english, "DE-at") == {"en", "de"}


def test_quoted_text_costs_twice_for_twice_the_length():
    import time

    took = []
    for times in (1, 4):
        text = 'He said "go on. And on" then, "why. Not" said it. ' * 4000 * times + '"'
        began = time.process_time()
        sentences.spans(text)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_uniform_is_uniform(spark):
    u = [r[0] for r in spark.range(2000).select(mixing.uniform(1, F.col("id"))).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03
