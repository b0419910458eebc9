"""Text functions as columns: everything but Unicode normalisation stays inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from groundline.functions import vocabulary as V


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


# Lambdas as SQL text: one parsed expression each, instead of a call into the JVM for every node of the tree.
_SPOKEN = f"w -> w NOT IN ({_quoted(V.STOPWORDS)})"
_IRREGULAR = f"map({_quoted(x for pair in V.IRREGULAR.items() for x in pair)})"
# most words end otherwise: they are told by their last letter, without a pattern or a lookup
_WITHOUT_PLURAL = f"""w -> CASE
    WHEN length(w) <= 3 OR NOT right(w, 1) IN ('s', 'e', 'n', 'd', 'g', 'a') THEN w
    WHEN w IN ({_quoted(x for x in V.IRREGULAR if len(x) > 3)}) THEN try_element_at({_IRREGULAR}, w)
    WHEN NOT endswith(w, 's') OR NOT w RLIKE '^[a-z]+$' THEN w
    WHEN endswith(w, 'ies') AND length(w) > 4 THEN concat(substring(w, 1, length(w) - 3), 'y')
    WHEN endswith(w, 'sses') OR (length(w) > 4 AND w RLIKE '(?:ch|sh|x|z|s)es$') THEN substring(w, 1, length(w) - 2)
    WHEN NOT w RLIKE '(?:sis|ss|us|is|ies)$' THEN substring(w, 1, length(w) - 1)
    ELSE w END"""


def _cut(ending: str, silent: str) -> str:
    """The word without an ending, a doubled consonant made single, a silent e put back."""
    return rf"regexp_replace(regexp_replace(regexp_replace(w, '{ending}$', ''), r'([bdfglmnprt])\1$', '$1'), '({silent})$', '$1e')"


_WITHOUT_INFLECTION = f"""w -> CASE
    WHEN endswith(w, 'ing') AND length(w) > 5 AND w RLIKE '^[a-z]*[aeiouy][a-z]*ing$' THEN {_cut("ing", "at|iz|bl|us|iv")}
    WHEN endswith(w, 'ed') AND length(w) > 4 AND w RLIKE '^[a-z]*[aeiouy][a-z]*ed$' THEN {_cut("ed", "at|iz|bl|us|iv|s|c")}
    ELSE w END"""


def tokens(text: Column, drop_stopwords: bool = False, stemming: bool = False) -> Column:
    """Lower-case word tokens in order; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(V.TOKEN), F.lit(0))
    if drop_stopwords:
        found = F.call_function("filter", found, F.expr(_SPOKEN))
    return stems(found) if stemming else found


def content_tokens(text: Column) -> Column:
    """Stemmed tokens without stop words: what every overlap measure compares."""
    return tokens(text, drop_stopwords=True, stemming=True)


def stem(word: Column) -> Column:
    """Inflectional stem of one word."""
    return F.element_at(stems(F.array(word)), 1)


def stems(words: Column) -> Column:
    """Stems of an array of words: irregular words and plurals first, then verb endings."""
    return F.call_function("transform", F.call_function("transform", words, F.expr(_WITHOUT_PLURAL)), F.expr(_WITHOUT_INFLECTION))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def collapsed(text: Column) -> Column:
    """White space rules alone, for text that is in NFKC."""
    text = F.regexp_replace(text, r"[ \t\r\f\x0b]+", " ")
    # (?d): only a line feed ends a line
    text = F.regexp_replace(text, rf"(?md)^(?:(?!\n){V.BLANK})+|(?:(?!\n){V.BLANK})+$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, rf"^{V.BLANK}+|{V.BLANK}+\z", "")


def normalise_whitespace(text: Column) -> Column:
    """NFKC, single blanks, stripped lines and at most one empty line in a row."""
    return collapsed(nfkc(text))


def words(text: Column) -> Column:
    """White-space words in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(V.SOLID + "+"), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of white-space words."""
    return F.size(words(text))


def _abbreviated() -> str:
    alternatives = "|".join(a[:-1].replace(".", r"\.") for a in V.ABBREVIATIONS)
    return rf"(?<! (?i:{alternatives}|[a-z])\.)(?<!^(?i:{alternatives}|[a-z])\.)"


def sentences(text: Column, normalised: bool = False) -> Column:
    """Sentences of a text; one that ends on an abbreviation or a single initial goes on.

    The look-behind does the rejoining: a blank behind an abbreviation is simply no border.
    """
    flat = F.replace(text if normalised else normalise_whitespace(text), F.lit("\n"), F.lit(" "))
    pieces = F.split(flat, V.SENTENCE_END.replace(r"\s+", _abbreviated() + r"\s+", 1))
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union of two token sets that is in both; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def containment(needle: Column, hay: Column) -> Column:
    """Share of the needle's distinct tokens that the hay has; 0 for an empty needle."""
    return F.when(F.size(needle) > 0, F.size(F.array_intersect(needle, hay)) / F.size(F.array_distinct(needle))).otherwise(F.lit(0.0))


def bigrams(found: Column) -> Column:
    n = F.size(found)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(found, 1, F.greatest(n - 1, F.lit(1))), F.slice(found, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws("_", a, b)))


def stable_hash(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts, joined by the unit separator's symbol."""
    return F.substring(F.sha2(F.concat_ws("␟", *parts), 256), 1, length)


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    """Text cut at a word border to at most so many characters, with a suffix if it was cut."""
    cut = F.regexp_replace(F.substring(text, 1, most - len(suffix)), "(?s) [^ ]*$", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit(suffix))).otherwise(text)


def clean_document_text(text: Column) -> Column:
    """Page furniture, contents and copyright lines, dot leaders and punctuation runs removed."""
    for pattern, by in ((V.PAGE_LINE, ""), (V.CONTENTS_LINE, ""), (V.COPYRIGHT_LINE, ""), (V.DOT_LEADER, " "), (V.PUNCTUATION_RUN, "$1")):
        # white space and word characters are those of all scripts
        text = F.regexp_replace(text, "(?Ud)" + pattern, by)
    return normalise_whitespace(text)


def markers(text: Column) -> Column:
    """Citation markers of a text in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(V.MARKER), F.lit(1)), lambda m: m.cast("int"))


def strip_unresolvable_markers(text: Column, valid: Column) -> Column:
    """Markers without a citation are removed with the blanks before them; the others follow one blank.

    The text is cut at its markers, and each piece is put together again with its marker if that is valid.
    """
    pieces = F.split(text, r"\s*\[\d+\]")
    found = F.regexp_extract_all(text, F.lit(V.MARKER), F.lit(1))
    kept = F.transform(found, lambda m: F.when(F.array_contains(valid, m.cast("int")), F.concat(F.lit(" ["), m, F.lit("]"))).otherwise(F.lit("")))
    return F.array_join(F.zip_with(pieces, kept, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"(//[^:/@]+):[^@]*@", "$1:***@")


def pad_cik(cik: Column) -> Column:
    """Ten digits; longer ones are kept whole."""
    bare = F.trim(cik)
    return F.when(F.length(bare) < 10, F.lpad(bare, 10, "0")).otherwise(bare)


def primary_entity(text: Column) -> Column:
    """The first name of several capitalised words, without leading words of comparison; null if there is none."""
    return F.get(entities(text), F.lit(0))


def entities(text: Column) -> Column:
    """Distinct names of at least two words left after leading words of comparison are taken off, in order."""
    found = F.regexp_extract_all(text, F.lit(V.NAME), F.lit(0))
    one = V.COMPARISON.replace(r"(?i)\b", "", 1).removesuffix(r"\b")
    bare = F.transform(found, lambda n: F.array_join(F.split(F.regexp_replace(n, rf"^(?i)(?:{one}(?:\s+|$))+", ""), r"\s+"), " "))
    return F.array_distinct(F.filter(bare, lambda n: n.contains(" ")))
