"""Sentence boundaries across languages and scripts.

The rules follow the character-property scheme of sentence breaking. Terminators, closing marks and the characters
that extend a terminator are read from the Sentence_Break, Quotation_Mark and General_Category properties, so those of
every script count: terminators of scripts without case end a sentence as they stand, those of the others if what
follows allows it. Closing quotes and brackets, reference marks and blanks extend a sentence. On top lie abbreviation
suppression, by the languages a text is written in, and the reading of quotations: a quotation that goes on in the
same sentence does not end it. Scripts without terminators (Thai) break at blanks between clauses.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _having(properties: str) -> str:
    """All characters with the given properties, in code order."""
    return "".join(regex.findall(properties, _EVERY))


_EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
# What the properties leave out: the ellipsis, and the shad that ends a clause or sentence in Tibetan.
_FULL_STOPS = _having(r"\p{Sentence_Break=ATerm}")
_TERMINATORS = _having(r"\p{Sentence_Break=STerm}") + "\u0f0d\u0f0e"
STOPS = _FULL_STOPS + _TERMINATORS + "…"
#: Wide terminators, behind which no blank is written.
DENSE = frozenset(c for c in STOPS if unicodedata.east_asian_width(c) in "WFH")
#: Terminators of scripts without case; those of ASCII and of general punctuation serve scripts with case.
CASELESS = frozenset(c for c in _TERMINATORS if c not in DENSE and ord(c) > 0x7F and not 0x2000 <= ord(c) < 0x2070 and not 0x2E00 <= ord(c) < 0x2E80)
CLOSERS = _having(r"[\p{Sentence_Break=Close}--\p{Ps}--\p{Pi}]".replace("[", "(?V1)[", 1))
OPENERS = _having(r"[\p{Ps}\p{Pi}]") + "\"'¿¡"
QUOTES = frozenset(_having(r"[\p{Quotation_Mark}--[\p{Ps}‘‚„‛‟‹«]]".replace("[", "(?V1)[", 1)))
#: Marks and format characters belong to the character before them.
EXTENDERS = _having(r"[\p{Sentence_Break=Extend}\p{Sentence_Break=Format}--\ufeff]".replace("[", "(?V1)[", 1))
del _EVERY

# Abbreviations by language and by what may follow them in the same sentence.
# Never final: titles, references, comparisons; a sentence does not end behind them.
NEVER = {
    "en": """mr mrs ms dr prof st hon gov sen rep pres mt ft gen col capt lt sgt rev vs v cf viz approx ca suppl fig figs no nos sec art
        para paras ext ed eds vol pp p al e.g i.e""",
    "de": "dr prof nr st z b d.h u.a z.b s.o s.u bzw vgl evtl ggf inkl zzgl sog abb abs tab art d u s cf vs p pp ca",
    "fr": "mme mlle dr prof m nr c.-à-d fig figs cf art arts vol p pp ex ed v vs no nos ca al abs",
    "es": "sr sra sres srta dr dra prof núm p.ej ej ee cf fig figs art arts vol pp p ed vs no ca al",
    "ru": "рис см т.е т.д стр гл табл им ул",
    "other": "डॉ श्री प्रो मि.ग्रा कि.ग्रा मि.ली रु د أ م มก ดร นพ พญ พ.ศ ค.ศ กก ซม มม มล",
}
# Before a number only (No. 7, Jan. 5, p. 3): elsewhere they may end a sentence.
BEFORE_NUMBER = frozenset("no nos nr sec art fig p pp ch jan feb mar apr jun jul aug sep sept oct nov dec ext para abs рис стр мес г núm th".split())
# May end a sentence: behind them a capital letter, but not a small one, begins the next. Forms of companies, months
# and units are met in every language.
FINAL_TOO = {
    "every": """inc corp co ltd llc plc llp bros mfg gmbh kg ag etc jr esq dept univ assn est min max hr hrs jan feb mar apr jun jul aug sep sept
        oct nov dec mon tue wed thu fri sat sun km h q.d b.i.d t.i.d i.v i.m s.c a.m p.m u.s u.k u.n e.u s.a n.v s.p.a b.v d.c""",
    "de": "usw sek std mio mrd tsd",
    "es": "uu",
    "ru": "тыс млн млрд руб коп г гг мес в вв т е д км кг мг",
}
# Frequent words by which a language is told: three of them in a text are taken for enough.
TOLD_BY = {
    "en": frozenset("the of and to in is was for with that by on from are were".split()),
    "de": frozenset("der die das und den dem des von mit ist im für auf nicht eine einer wurde wird zu".split()),
    "fr": frozenset("le la les des et du un une dans pour est par sur au aux qui en".split()),
    "es": frozenset("el la los las de y del un una en para por con se que su al fue".split()),
}
_CODES = {"english": "en", "eng": "en", "german": "de", "deutsch": "de", "deu": "de", "ger": "de", "french": "fr", "français": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "español": "es", "spa": "es"}
_SCRIPT_BOUND = ("ru", "other")
# Units that end a sentence even before a small letter, unless a small function word follows.
UNITS = frozenset("h min s ms sec hr hrs kg km mg gb mb".split())
FUNCTION_WORDS = frozenset("a an and as at below above before after by during for from in into is of on or per than that the then to under was were when while with without".split())
# Words before a single capital that name a kind (hepatitis E., group B.), so that the capital is no initial.
KINDS = frozenset("hepatitis group groups type types vitamin stage grade class classes phase arm arms level plan tier option zone area category factor cohort exhibit appendix schedule table section part series figure strain influenza and or form annex unit".split())
COMPANY_FORMS = frozenset("inc corp co ltd llc plc llp s.a n.v".split())
STATES = frozenset("government department congress treasury senate supreme army navy federal district court dollar dollars securities food patent subsidiary unit".split())
GERMAN_ORDINAL = re.compile(r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Halbjahr|Jahrhundert|Jahrestag|Auflage|Kapitel|Klasse|Stock|Tag|Woche|Monat|Mal)\b")
GERMAN_BEFORE = frozenset("am im vom zum bis der die das den dem des seit ab beim zur und".split())
# Thai words that go on with a clause behind a blank.
THAI_ON = re.compile("เพิ่มขึ้น|ลดลง|และ|หรือ|แต่|โดย|ซึ่ง|ที่|จาก|เป็น|ใน|ให้|ของ|กับ|เพื่อ|จน|ถึง|คิดเป็น|รวม|เมื่อ|ก็|ได้|ภายใน|ตั้งแต่")
THAI = "฀-๿"

SPACE = r"[\s﻿]"
def _candidate(upto: str) -> re.Pattern:
    """Terminators with what extends them, for texts of characters up to a given one: short classes are read fast.

    A terminator of a script with case is none right before a small letter or a digit.
    """
    within = lambda chars: "".join(re.escape(c) for c in sorted(chars) if c <= upto)
    free, extenders = within(DENSE | CASELESS), within(EXTENDERS)
    stop = rf"[{within(STOPS)}]+(?:{f'(?<=[{free}])|' if free else ''}(?![0-9a-z,;]))" + (f"[{extenders}]*" if extenders else "")
    return re.compile(rf"{stop}(?:[\s ]?»|[{within(CLOSERS)}“])*(?:\[\d{{1,4}}(?:[,–-] ?\d{{1,4}})*\])*")


_CANDIDATES = {upto: _candidate(upto) for upto in ("\x7f", "\uffff", "\U0010ffff")}


def _candidates(text: str) -> re.Pattern:
    if text.isascii():
        return _CANDIDATES["\x7f"]
    return _CANDIDATES["\uffff" if max(text) <= "\uffff" else "\U0010ffff"]


_SKIP = re.compile(r"[^\w\"'“‘„‚«([{‹「『（【〈《〔〖¿¡$€£—–-]*")
_LONE_CR = re.compile(r"\r(?!\n)")
_HEADING = re.compile(r"[ \t﻿]{0,4}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t﻿]{0,8}[-*][ \t]")
_THAI_GAP = re.compile(rf"(?<=[{THAI}0-9%)]){SPACE}+(?=[{THAI}])")
_THAI_ANY = re.compile(rf"[{THAI}]")
_THAI_YEAR = re.compile(r"(?:ปี|พ\.ศ\.|ค\.ศ\.)\s*\d{4}\Z")
_WORD = re.compile(r"\w[\w'’-]*")
_TRIM = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000" + "\x1c\x1d\x1e\x1f\ufeff"


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Stretches that a unit can't cross, and whether the stretch is one unit (a heading or list line)."""
    begin, at, size = None, 0, len(text)
    if "\r" in text:
        text = _LONE_CR.sub("\n", text)
    while at < size:
        end = text.find("\n", at) + 1 or size
        line = text[at : min(end, at + 16)]
        if not line.strip(_TRIM) and not text[at:end].strip(_TRIM):
            if begin is not None:
                yield begin, at, False
            begin = None
        elif "#" in line and _HEADING.match(line) or ("-" in line or "*" in line) and _ITEM.match(line):
            if begin is not None:
                yield begin, at, False
            begin = None
            yield at, end, True
        elif begin is None:
            begin = at
        at = end
    if begin is not None:
        yield begin, size, False


_APART = frozenset(_TRIM + "\"'“”„«»()[]{}（）「」—–/")
_STOP_SET, _CLOSER_SET, _OPENER_SET = frozenset(STOPS) | frozenset(EXTENDERS), frozenset(CLOSERS), frozenset(OPENERS)


class Abbreviations:
    """Abbreviations of some languages; those of other scripts can't be mistaken and always count."""

    def __init__(self, languages: frozenset[str]):
        of = lambda lists: frozenset(w for k, v in lists.items() if k in languages or k == "every" or k in _SCRIPT_BOUND for w in v.split())
        self.never, self.final_too = of(NEVER), of(FINAL_TOO)
        self.listed = self.never | BEFORE_NUMBER | self.final_too | UNITS


_ALL = frozenset(TOLD_BY)
_BY_LANGUAGES = {_ALL: Abbreviations(_ALL)}
_LISTED = _BY_LANGUAGES[_ALL].listed


def languages_of(text: str, lang: str | None) -> frozenset[str]:
    """Languages whose abbreviations count in a text: those its frequent words tell, and the one it is said to have.

    The statement alone is not relied on; a text that tells none has them all.
    """
    found = set(text.lower().split())
    told = {k for k, words in TOLD_BY.items() if len(found & words) >= 3}
    said = re.split("[-_]", (lang or "").strip().lower())[0]
    said = _CODES.get(said, said)
    return frozenset(told | ({said} & _ALL) if told else _ALL)


class _Text:
    """A text with what is found out about it once, and only if it is asked for."""

    def __init__(self, text: str, lang: str | None):
        self.text, self.lang, self._known, self._at = text, lang, None, {}

    def abbreviations(self) -> Abbreviations:
        if self._known is None:
            languages = languages_of(self.text, self.lang)
            self._known = _BY_LANGUAGES.get(languages) or _BY_LANGUAGES.setdefault(languages, Abbreviations(languages))
        return self._known

    def count(self, mark: str, lo: int, hi: int) -> int:
        """How often ``mark`` stands between two offsets; the text is read once for it."""
        if mark not in self._at:
            self._at[mark] = [m.start() for m in re.finditer(re.escape(mark), self.text)]
        at = self._at[mark]
        return bisect_left(at, hi) - bisect_left(at, lo)


def _word(text: str, lo: int, end: int) -> str:
    """The last word before ``end``, at most 40 characters of it."""
    at, lo = end, max(lo, end - 40)
    while at > lo and text[at - 1] not in _APART:
        at -= 1
    return text[at:end]


def _initial(word: str) -> bool:
    return len(word) == 1 and word.isupper()


def _ends(known: _Text, lo: int, stop: int, mark: str, tail: str, gap: str, at: int, hi: int) -> bool:
    """Whether a sentence ends behind the terminator ``mark`` at ``stop`` with its closing marks ``tail``."""
    text = known.text
    first = text[at]
    mark = mark.rstrip(EXTENDERS)
    if mark[-1] in DENSE:
        # a wide full stop within a number
        if mark[-1] in _FULL_STOPS and first.isdigit() and not gap and text[stop - 1 : stop].isdigit():
            return False
        # a quotation that a particle takes up goes on
        return not (tail and tail[-1] in QUOTES and (first in "とってのはをがに、，,—–" or (first.islower() and not gap)))
    if mark[-1] in CASELESS:
        return not (tail and tail[-1] in QUOTES and first in "—–,،،")
    quoted = bool(tail) and any(c in QUOTES for c in tail)
    if first in ",;:،؛，、；：" or (first in ")]»”" and gap == ""):
        return False
    if first in "—–-" and (quoted or not gap or first == "—"):
        return quoted is False and bool(gap) and first == "-"
    real = at if first.isalnum() else _SKIP.match(text, at).end()
    nxt = text[real] if real < hi else ""
    lower = nxt.islower()
    if not gap:
        # a missing blank: only a capital, a quotation or bracket begins the next sentence
        before = text[stop - 1] if stop > lo else ""
        if mark != "." and (first.isupper() or first in _OPENER_SET):
            return True
        if first.isupper() and (before.islower() or before.isdigit() or before in _CLOSER_SET or before == "%" or tail):
            follows = text[at + 1 : at + 2]
            return not before.islower() or not follows or follows != "."
        if first.isupper() and before.isupper() and text[at + 1 : at + 2].islower():
            return len(_word(text, lo, stop)) > 1
        return first in _OPENER_SET and first not in "\"'" and (before.islower() or before.isdigit() or bool(tail)) and text[at + 1 : at + 2].isupper()
    if quoted and lower:
        return False
    if "…" in mark or len(mark) > 2 and set(mark) == {"."}:
        return not lower
    if mark[-1] != ".":
        return True
    if len(mark) == 2:
        return True
    if tail and lower and not quoted and any(c in ")]}）" for c in tail):
        return bool(re.match(r"\w*[A-Z]", text[real : real + 12]))
    if tail:
        return True
    word = _word(text, max(lo, stop - 40), stop)
    low = word.lower()
    own = known.abbreviations() if low in _LISTED else _BY_LANGUAGES[_ALL]
    if low not in own.listed:
        low = low.lstrip("¿¡").removeprefix("l'").removeprefix("d'")
    if not low:
        return not lower
    mixed, following = False, ""
    if lower:
        m = _WORD.match(text, real)
        following = m.group() if m else ""
        mixed = not following.islower()
    if _initial(word):
        previous = _word(text, lo, _back(text, lo, stop - len(word)))
        if previous.lower() in KINDS and previous.islower():
            return not lower or mixed or following not in FUNCTION_WORDS
        return mixed
    if low in UNITS:
        previous = _word(text, lo, _back(text, lo, stop - len(word)))
        if previous and previous[-1].isdigit():
            return mixed or not lower or following not in FUNCTION_WORDS
    if low in BEFORE_NUMBER and nxt.isdigit():
        previous = _word(text, lo, _back(text, lo, stop - len(word)))
        return low == "г" and previous.isdigit() and len(previous) == 4
    if low in ("г", "гг"):
        return not lower and nxt not in "—–"
    if low in own.never and not (low in ("no", "d", "s", "b", "u", "m", "n", "p", "v") and word != low):
        return False
    if low in own.final_too:
        if lower:
            return mixed and low not in COMPANY_FORMS
        if low in ("mio", "mrd", "tsd"):
            return False
        m = _WORD.match(text, real)
        following = m.group().lower() if m else ""
        if low in ("u.s", "u.k", "u.n", "e.u") and following in STATES:
            return False
        if low in COMPANY_FORMS and following in COMPANY_FORMS:
            return False
        if low in ("q.d", "i.v", "a.m", "p.m", "b.i.d", "t.i.d") and nxt.isdigit():
            return False
        return True
    if lower and re.fullmatch(r"(?:\w\.)+\w", word):
        return mixed
    if low.isdigit() and len(low) <= 2 and nxt.isupper() and GERMAN_ORDINAL.match(text, real):
        previous = _word(text, lo, _back(text, lo, stop - len(word)))
        return previous.lower() not in GERMAN_BEFORE
    return True


def _back(text: str, lo: int, at: int) -> int:
    """The end of the word before ``at``: blanks and a trailing stop passed over."""
    while at > lo and text[at - 1] in _TRIM:
        at -= 1
    return at


def _clause_gaps(text: str, lo: int, hi: int) -> Iterator[int]:
    """Where a script without terminators ends a sentence: a blank between clauses."""
    for m in _THAI_GAP.finditer(text, lo, hi):
        before = text[m.start() - 1]
        if before.isdigit() or before in "%)":
            if not (before.isdigit() and _THAI_YEAR.search(text, max(lo, m.start() - 12), m.start())):
                continue
        if not THAI_ON.match(text, m.end()):
            yield m.start()


def spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Offsets (start, end exclusive) of every sentence unit, in order; none for null and blank texts.

    ``lang`` is the language the text is said to be in; it may be missing or wrong.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    known, candidate, paragraph, looked = _Text(text, lang), _candidates(text), 0, 0
    thai = not text.isascii() and _THAI_ANY.search(text) is not None

    def add(a: int, b: int) -> None:
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        if a < b:
            out.append((a, b))

    for lo, hi, single in blocks(text):
        if single:
            add(lo, hi)
            continue
        # the paragraph begins behind the last empty line
        paragraph, looked = max(paragraph, text.rfind("\n\n", looked, lo), text.rfind("\r\n\r\n", looked, lo)), max(lo - 3, 0)
        cuts = []
        last = lo
        for m in candidate.finditer(text, lo, hi):
            stop, end = m.span()
            run = text[stop:end]
            if run == "." and end + 1 < hi and text[end] in " \n" and text[end + 1].isalnum():
                # a plain word, a blank and a letter or digit: most ends of sentences
                word = _word(text, lo, stop)
                if len(word) > 3 and word.isalnum() and word.lower() not in _LISTED:
                    cuts.append(end)
                    last = end
                    continue
            n = 1
            while n < len(run) and run[n] in _STOP_SET:
                n += 1
            mark, tail = run[:n], run[n:]
            # a quote that opens the next sentence is no closing one
            if tail and (k := _own_closers(known, paragraph, last, stop, tail)) < len(tail):
                tail, end = tail[:k], stop + n + k
            at = end
            while at < hi and text[at] in _TRIM:
                at += 1
            if at < hi and _ends(known, lo, stop, mark, tail, text[end:at], at, hi):
                cuts.append(end)
                last = end
        if thai:
            cuts = sorted({*cuts, *_clause_gaps(text, lo, hi)})
        a = lo
        for c in cuts:
            add(a, c)
            a = c
        add(a, hi)
    return out


def _own_closers(known: _Text, paragraph: int, lo: int, stop: int, tail: str) -> int:
    """How many characters of ``tail`` close something of the sentence that began at ``lo``.

    A straight quotation mark closes if one is open in the sentence, or was at its start in the paragraph.
    """
    for k, c in enumerate(tail):
        if c == '"' and known.count('"', lo, stop) % 2 == 0 and known.count('"', paragraph, lo) % 2 == 0:
            return k
        if c == "“" and not known.count("„", lo, stop):
            return k
        if c == "[":
            break
    return len(tail)


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends, counts = [], [], []
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = spans(text, lang)
            counts.append(len(found))
            for a, b in found:
                starts.append(a)
                ends.append(b)
        rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [batch.schema.names[0], "sent_start", "sent_end"])


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """Sentence units of every row: key, sent_start, sent_end (code points, end exclusive).

    ``lang`` names the column with a text's stated language, if there is one; a missing or wrong statement does no
    harm. Null, empty and blank texts have no units; a null key is kept; repeated rows give repeated units; an empty
    table gives no rows; other columns are not looked at. Texts are read whole, at a cost linear in their length.
    """
    kind = docs.schema[key].dataType.simpleString()
    said = F.lit(None).cast("string") if lang is None else F.col(lang).cast("string")
    return docs.select(key, docs[text].cast("string").alias("text__"), said.alias("lang__")).mapInArrow(_span_batches, f"`{key}` {kind}, sent_start int, sent_end int")
