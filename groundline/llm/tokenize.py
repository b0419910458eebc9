"""Encoding of a whole corpus with a byte-level BPE of the public tokenizer files.

Every text is cut to overlapping chunks. Each chunk is pre-tokenised on its own; two neighbours are stitched at the
first pre-token boundary both have in their overlap, behind which they agree, and the pre-tokens between the stitches
are encoded. Where an overlap has no common boundary (an unbroken run of letters, say), that overlap alone is widened
until it has one, so the result is exact for every text. Decoding concatenates the raw bytes.

The chunks of one text are handled in the task that holds it: a corpus of many texts is parallel by its texts and is
not shuffled. A text of more than ``deal`` characters is dealt out to all tasks in stretches, which are stitched by the
same rule through a join.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.runtime import materialise

#: Folder of the public vocabulary files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Characters of a chunk and of the overlap to the next.
CHUNK, OVERLAP = 1024, 64
#: Characters of a stretch, and of the overlap to the next, of a text that is dealt out to all tasks.
DEAL, DEAL_OVERLAP = 1 << 18, 512
CACHE_ENTRIES, CACHE_CHARS = 400_000, 24

# The split pattern that belongs to the vocabulary, and the white space it knows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: The end of a chunk may cut a pre-token, so boundaries in its last few characters prove nothing.
_UNSURE = 8


@lru_cache(maxsize=2)
def _matcher(ascii_only: bool):
    """The vocabulary's pattern with its own white space spelt out; the plain letters and digits for ASCII texts."""
    import regex

    spaces = "".join(c for c in SPACES if c.isascii()) if ascii_only else SPACES
    pattern = PATTERN.replace(r"[^\s", f"[^{spaces}").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    if ascii_only:
        return re.compile(pattern.replace(r"\p{L}\p{N}]", "A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")).findall
    return regex.compile(pattern).findall


def _find(text: str) -> list[str]:
    return _matcher(text.isascii())(text)


def _seam(left: list[str], right: list[str], start: int, end: int) -> tuple[int, int] | None:
    """The first boundary that ``left``, which ends at ``end``, and ``right``, which begins at ``start``, have in
    common: how many pre-tokens of each lie before it."""
    at, i, ours = end, len(left), {}
    while i and at > start:
        if at < end - _UNSURE:
            ours[at] = i
        i -= 1
        at -= len(left[i])
    if at == start:
        ours[at] = i
    at = start
    for j, token in enumerate(right):
        if at in ours:
            return ours[at], j
        at += len(token)
        if at >= end - _UNSURE:
            break
    return None


def pretokens(text: str, chunk: int = CHUNK, overlap: int = OVERLAP, seams: list[int] | None = None) -> list[str]:
    """Pre-tokens of a text by overlapping chunks, the same as those of the text as one piece.

    ``seams``, if given, gets the width of every overlap that was stitched.
    """
    find, size, done = _find, len(text), []
    end = min(size, chunk + overlap)
    left = find(text[:end])
    while end < size:
        start = end - overlap
        far = min(size, start + chunk + overlap)
        right = find(text[start:far])
        met = _seam(left, right, start, end)
        if met:
            done += left[: met[0]]
            left, end = right[met[1] :], far
            if seams is not None:
                seams.append(overlap)
            continue
        # no common boundary: the open rest behind the last sure one is read on, twice as far as before
        at, i = end, len(left)
        while i and at >= end - _UNSURE:
            i -= 1
            at -= len(left[i])
        done += left[:i]
        end = min(size, max(far, at + 2 * (end - at)))
        left = find(text[at:end])
        if seams is not None:
            seams.append(end - at)
    done += left
    return done


class _Cache(dict):
    """What of a pre-token is kept: its ids, or their number."""

    def __init__(self, encode, keep):
        self._encode, self._keep = encode, keep

    def __missing__(self, piece: str):
        value = self._keep(self._encode(piece))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = value
        return value


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ids, self._counts = _Cache(self._bpe.encode_ordinary, tuple), _Cache(self._bpe.encode_ordinary, len)

    def ids(self, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[int]:
        return chain.from_iterable(map(self._ids.__getitem__, pretokens(text or "", chunk, overlap)))

    def count(self, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        return sum(map(self._counts.__getitem__, pretokens(text or "", chunk, overlap)))

    def decode(self, ids: list[int]) -> str:
        """Concatenates the raw bytes of the tokens."""
        return self._bpe.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder and cache for each Python worker and vocabulary file."""
    return Encoder(path)


def _texts(column: pa.Array) -> Iterator[str | None]:
    return (x.as_py() for x in column) if len(column) < 64 else iter(column.to_pylist())


def _encode_batches(path: str, chunk: int, overlap: int):
    """Rows (..., text) -> (..., ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in _texts(batch.column(batch.num_columns - 1)):
                flat.extend(enc.ids(text, chunk, overlap))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])

    return run


def _count_batches(path: str, chunk: int, overlap: int):
    """Rows (..., text) -> (..., n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = pa.array((enc.count(t, chunk, overlap) for t in _texts(batch.column(batch.num_columns - 1))), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n_tokens"])

    return run


def _deal_batches(deal: int, overlap: int):
    """Rows (row, text) -> stretches (row, k, start, last, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                for k, start in enumerate(range(0, len(text), deal)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "k": k, "start": start, "last": start + deal >= len(text), "text": text[start : start + deal + overlap]}], _STRETCH)

    return run


_STRETCH = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])


def _boundary_batches(overlap: int, chunk: int, small: int):
    """Stretches -> the pre-token boundaries that their overlaps hold: row, seam, side (0 left, 1 right), bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, k, start, last, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = list(accumulate(map(len, pretokens(text, chunk, small)), initial=0))
                if k:
                    out.append((row, k, 1, [start + c for c in cuts if c < overlap - _UNSURE]))
                if not last:
                    # a stretch but the first may begin within a pre-token: the match with its neighbour decides
                    out.append((row, k + 1, 0, [start + c for c in cuts if len(text) - overlap <= c < len(text) - _UNSURE]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["row", "seam", "side", "bounds"])

    return run


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, run, a, b, parts) -> (row, run, text): the parts put together, from a to b (null: to the end)."""
    for batch in batches:
        texts = ["".join(parts)[a : None if b is None else b] for a, b, parts in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["row", "run", "text"])


def _dealt(long: DataFrame, path: str, chunk: int, small: int, deal: int, overlap: int) -> DataFrame:
    """Token ids of long texts (row, text), whose stretches spread over all tasks: row, ids.

    Neighbours that have no common boundary in their overlap are put together and encoded as one; the others are not
    held up by them.
    """
    stretches = long.mapInArrow(_deal_batches(deal, overlap), "row bigint, k int, start bigint, last boolean, text string").repartition("row", "k")
    seams = stretches.mapInArrow(_boundary_batches(overlap, chunk, small), "row bigint, seam int, side int, bounds array<bigint>")
    # a left stretch is sure behind its own first stitch only; what lies before it is the neighbour's
    bounds = lambda side: F.max(F.when(F.col("side") == side, F.col("bounds")))
    seams = seams.groupBy("row", "seam").agg(F.array_min(F.array_intersect(bounds(0), bounds(1))).alias("cut"))
    order = Window.partitionBy("row").orderBy("k")
    runs = stretches.join(seams.withColumnRenamed("seam", "k"), ["row", "k"], "left").withColumn("run", F.count("cut").over(order))
    part = F.when(F.col("last") | (F.lead("run").over(order) > F.col("run")), F.col("text")).otherwise(F.substring("text", 1, deal))
    runs = runs.withColumn("part", part).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("cut").alias("cut"), F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p"))
    begin = F.coalesce("cut", F.lit(0))
    pieces = runs.select("row", "run", (begin - F.col("start")).alias("a"), (F.lead("cut").over(Window.partitionBy("row").orderBy("run")) - F.col("start")).alias("b"), F.col("p.part").alias("parts"))
    coded = pieces.mapInArrow(_cut_batches, "row bigint, run bigint, text string").mapInArrow(_encode_batches(path, chunk, small), "row bigint, run bigint, ids array<int>")
    return coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("p")).select("row", F.flatten("p.ids").alias("ids"))


def _split(docs: DataFrame, text: str, deal: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose chunks stay where they are, and the rows to be dealt out, numbered by ``row__``.

    The number tells repeated rows apart; it is drawn once, since these few rows are written down.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    return docs.where(size <= deal), materialise(docs.where(size > deal).withColumn("row__", F.monotonically_increasing_id()), "long-texts")


def encode_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = BYTE_BPE, chunk: int = CHUNK, overlap: int = OVERLAP, deal: int = DEAL, deal_overlap: int = DEAL_OVERLAP
) -> DataFrame:
    """Token ids of every row of ``docs``: key, ids.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text; a null key is
    kept; repeated rows give repeated rows; an empty table gives no rows; other columns are not looked at. Texts of
    any length are encoded whole, by chunks; those beyond ``deal`` characters spread over all tasks.
    """
    path, kind = f"{folder}/{vocabulary}", docs.schema[key].dataType.simpleString()
    short, long = _split(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")), "text", deal)
    out = short.mapInArrow(_encode_batches(path, chunk, overlap), f"id {kind}, ids array<int>")
    coded = _dealt(long.select(F.col("row__").alias("row"), "text"), path, chunk, overlap, deal, deal_overlap)
    out = out.unionByName(long.select("id", F.col("row__").alias("row")).join(coded, "row").select("id", "ids"))
    return out.select(F.col("id").alias(key), "ids")


def count_tokens(
    docs: DataFrame, text: str = "text", folder: str = TOKENIZERS, vocabulary: str = BYTE_BPE, chunk: int = CHUNK, overlap: int = OVERLAP, deal: int = DEAL, deal_overlap: int = DEAL_OVERLAP
) -> DataFrame:
    """The rows of ``docs`` with ``text`` replaced by its number of tokens, n_tokens (0 for null and empty)."""
    path, others = f"{folder}/{vocabulary}", [c for c in docs.columns if c != text]
    short, long = _split(docs.select(*others, F.col(text).cast("string").alias(text)), text, deal)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    counted = short.mapInArrow(_count_batches(path, chunk, overlap), f"{schema}n_tokens bigint")
    coded = _dealt(long.select(F.col("row__").alias("row"), F.col(text).alias("text")), path, chunk, overlap, deal, deal_overlap)
    return counted.unionByName(long.join(coded.select(F.col("row").alias("row__"), F.size("ids").cast("bigint").alias("n_tokens")), "row__").select(*others, "n_tokens"))
