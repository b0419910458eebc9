"""Near-duplicate texts by a signature-coordinate inverted join.

Each text's set of word shingles gets a signature of min-wise coordinates, and texts are posted under coordinate-value
pairs. A pair of texts is wanted if at least MATCHES of its COORDINATES collide. So it shares one of the first
COORDINATES - MATCHES + 1 pairs of either text in any order all texts agree on, and only this prefix is posted: the
rarest values first, by a sketch of all values' counts, so that common values are skipped and never form long lists.
Postings carry the signature's values packed to four bits each; the lists of equal pairs are merged, collisions are
counted over all coordinates, and pairs below the match threshold are skipped. The rest is kept once and checked
exactly against the sets themselves.

Copies of one text are one class, signed and posted once, so a group of copies never makes pairs. Postings travel
packed, a few bytes each, in buckets of keys. A list of very many texts leaves its task as numbered tiles, of a size in
all that is linear in the list; pairs of tile numbers are then spread over all tasks and merged there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.runtime import broadcast_if_small, materialise

#: Coordinates of a signature, and the collisions from which a pair is kept. A pair of similarity s collides in a
#: binomial number of coordinates; with CHANCE it is missed with probability 0.45 % at 0.6, 0.07 % at 0.65, 0.007 % at 0.7.
COORDINATES, MATCHES = 32, 12
#: Collisions as counted, on four bits of each value: by chance one more than on the values themselves.
CHANCE = 1
#: Cells of the sketch of all values' counts, of bounded size whatever the number of texts; and its slices.
CELLS, SLICE = 1 << 20, 1 << 12
#: Texts of one list that are merged in one task; a longer list is cut to tiles of this size.
TILE = 4096
#: Postings of one bucket (a task's share) aimed at, and held in memory before long lists are taken out.
BUCKET_POSTINGS, HELD_POSTINGS = 1_500_000, 6_000_000

#: A posting within its bucket: 32 bits of the coordinate-value pair, the text's number, its packed signature.
POSTING = np.dtype([("key", "<u4"), ("row", "<u4"), ("lo", "<u8"), ("hi", "<u8")])
#: The same with the text's full number, as merged.
HELD = np.dtype([("key", "<u8"), ("id", "<i8"), ("lo", "<u8"), ("hi", "<u8")])
_ONES = np.uint64(0x1111111111111111)
#: The part of a text's number that a posting holds; the rest is its blob's base.
_LOW = np.int64(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _ascii_words():
    import re

    return re.compile("[a-z0-9]+")


@lru_cache(maxsize=1)
def _any_words():
    import regex

    return regex.compile(r"[\p{L}\p{M}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters, marks and digits of the lower-cased text."""
    low = (text or "").lower()
    return (_ascii_words() if low.isascii() else _any_words()).findall(low)


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hash() -> _WordHash:
    return _WordHash()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def shingle_hashes(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the texts that have a shingle, the 64-bit hashes of all their shingles, and where each row's begin."""
    table = _word_hash()
    lists = [words(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    rows = np.flatnonzero(sizes >= width)
    if not len(rows):
        return rows, np.empty(0, np.uint64), np.empty(0, np.int64)
    flat = np.fromiter((table[w] for i in rows for w in lists[i]), np.uint64, int(sizes[rows].sum()))
    h = flat[: len(flat) - width + 1].copy()
    for k in range(1, width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - width + 1 + k]
    # windows that cross two texts are taken out
    ends = np.cumsum(sizes[rows])
    ok = np.ones(len(flat), bool)
    for k in range(1, width):
        ok[ends - k] = False
    return rows, _mix(h[ok[: len(h)]]), np.r_[0, np.cumsum(sizes[rows] - width + 1)[:-1]]


def signatures(texts: list[str | None], width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the texts that have a shingle, and their COORDINATES min-wise values (uint32)."""
    rows, h, starts = shingle_hashes(texts, width)
    out = np.empty((len(rows), COORDINATES), np.uint32)
    if not len(rows):
        return rows, out
    h32 = (h >> np.uint64(32)).astype(np.uint32)
    mul, add = _multipliers(COORDINATES, seed)
    for c in range(COORDINATES):
        v = (h32 ^ add[c]) * mul[c]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, c] = np.minimum.reduceat(v, starts)
    return rows, out


def _pairs_hashed(sig: np.ndarray) -> np.ndarray:
    """The coordinate-value pairs of signatures, hashed to 64 bits."""
    coordinate = (np.arange(1, sig.shape[1] + 1, dtype=np.uint64) << np.uint64(32))[None, :]
    return _mix(sig.astype(np.uint64) | coordinate)


def _packed(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four bits of each coordinate's value, 16 coordinates to a word."""
    four = _mix(sig.astype(np.uint64)) & np.uint64(15)
    out = []
    for part in (four[:, :16], four[:, 16:]):
        word = np.zeros(len(sig), np.uint64)
        for k in range(part.shape[1]):
            word |= part[:, k] << np.uint64(4 * k)
        out.append(word)
    return out[0], out[1]


def _sign_batches(width: int):
    """Rows (h1, h2, text) -> (h1, h2, signature); copies within a batch are signed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)
            first = np.unique(h, axis=0, return_index=True)[1]
            texts = batch.column(2).take(pa.array(first)).to_pylist()
            rows, sig = signatures(texts, width)
            bytes_ = pa.array([r.tobytes() for r in sig], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h[first][rows, 0]), pa.array(h[first][rows, 1]), bytes_], ["h1", "h2", "signature"])

    return run


def _as_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of a partition -> its counts of the sketch's cells, slice by slice."""
    cells = np.zeros(CELLS, np.int64)
    for batch in batches:
        if batch.num_rows:
            cells += np.bincount((_pairs_hashed(_as_matrix(batch.column(0))) % np.uint64(CELLS)).astype(np.int64).ravel(), minlength=CELLS)
    if cells.any():
        parts = cells.reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary())], ["slice", "counts"])


def _added_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
    # an order of the values is all that is wanted of the counts
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(t, 2**31 - 1).astype(np.int32).tobytes() for t in total.values()], pa.binary())], ["slice", "counts"])


def value_counts(signed: DataFrame) -> np.ndarray:
    """The sketch: how often the values that hash to a cell occur in all signatures; CELLS numbers in any case."""
    counted = signed.select("signature").mapInArrow(_count_batches, "slice int, counts binary").repartition("slice").mapInArrow(_added_slices, "slice int, counts binary")
    out = np.zeros((CELLS // SLICE, SLICE), np.int32)
    for r in counted.collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def postings(ids: np.ndarray, sig: np.ndarray, counts: np.ndarray, matches: int) -> np.ndarray:
    """Postings of signatures under the rarest of their coordinate-value pairs."""
    pairs, size = _pairs_hashed(sig), sig.shape[1] - matches + 1
    seen = counts[pairs % np.uint64(len(counts))].astype(np.uint64)
    # rarest first, and among equals in the order of the pair: the same order for all texts
    order = np.argsort((np.minimum(seen, np.uint64(2**31 - 1)) << np.uint64(32)) | (pairs >> np.uint64(32)), axis=1, kind="stable")[:, :size]
    lo, hi = _packed(sig)
    out = np.empty((size, len(sig)), HELD)
    out["key"], out["id"], out["lo"], out["hi"] = np.take_along_axis(pairs, order, 1).T, ids, lo, hi
    return out.reshape(-1)


def _post_batches(counts: np.ndarray, buckets: int, matches: int):
    """Signatures (id, signature) -> packed postings (bucket, base, blob); ``base`` is added to a blob's row numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            matrix = _as_matrix(batch.column(1))
            for base in np.unique(all_ids & ~_LOW):
                yield pack(all_ids[all_ids & ~_LOW == base] & _LOW, base, matrix[all_ids & ~_LOW == base])

    def pack(ids: np.ndarray, base: int, matrix: np.ndarray) -> pa.RecordBatch:
        wide = postings(ids, matrix, counts, matches)
        bucket = (wide["key"] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        wide, bucket = wide[order], bucket[order]
        p = np.empty(len(wide), POSTING)
        p["key"], p["row"], p["lo"], p["hi"] = wide["key"] >> np.uint64(32), wide["id"], wide["lo"], wide["hi"]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = [p[a:b].tobytes() for a, b in zip(starts, np.r_[starts[1:], len(p)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(starts), base)), pa.array(blobs, pa.binary())], ["bucket", "base", "blob"])

    return run


def _differing(x: np.ndarray) -> np.ndarray:
    """Number of coordinates in which packed values, given as their exclusive or, differ."""
    x = x | (x >> np.uint64(2))
    x |= x >> np.uint64(1)
    x &= _ONES
    return np.bitwise_count(x)


def _merge_lists(p: np.ndarray, end: np.ndarray, matches: int) -> Iterator[np.ndarray]:
    """Pairs (id, id) within sorted lists of one key: element k against k + d, for growing d; lists that are through
    are skipped, and so are pairs with too few collisions."""
    lo, hi, ids = (np.ascontiguousarray(p[f]) for f in ("lo", "hi", "id"))
    live, most, d = np.arange(len(p)), COORDINATES - matches - CHANCE, 1
    while len(live):
        live = live[live + d < end[live]]
        for a in range(0, len(live), 1 << 18):
            i = live[a : a + (1 << 18)]
            j = i + d
            hit = _differing(lo[i] ^ lo[j]) + _differing(hi[i] ^ hi[j]) <= most
            if hit.any():
                yield np.stack([ids[i[hit]], ids[j[hit]]], 1)
        d += 1


def _pair_batch(pairs: list[np.ndarray]) -> pa.RecordBatch:
    ab = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    ab = np.unique(np.sort(ab, axis=1), axis=0)
    ab = ab[ab[:, 0] != ab[:, 1]]
    n = len(ab)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["a", "b", "list", "tile", "blob"])


def _tile_batch(key: int, number: int, p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([number], pa.int32()), pa.array([p.tobytes()], pa.binary())], ["a", "b", "list", "tile", "blob"])


_MERGED = "a bigint, b bigint, list bigint, tile int, blob binary"


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
    return starts, np.diff(np.r_[starts, len(keys)])


def _merge_batches(matches: int, tile: int, held_most: int):
    """Rows (bucket, base, blob) sorted by bucket -> pairs (a, b), and numbered tiles of lists of more than ``tile`` texts.

    A long list is taken out as soon as what is held grows too large, and what comes for it later is passed on in
    tiles, so a task never holds more than its bucket's short lists and a bound.
    """

    class Bucket:
        def __init__(self, number: int):
            self.number, self.parts, self.size, self.long, self.tiles = number, [], 0, {}, {}

        def add(self, base: int, blob: bytes) -> Iterator[pa.RecordBatch]:
            p = np.frombuffer(blob, POSTING)
            held = np.empty(len(p), HELD)
            held["key"], held["id"], held["lo"], held["hi"] = p["key"], p["row"].astype(np.int64) + base, p["lo"], p["hi"]
            self.parts.append(held)
            self.size += len(held)
            if self.size > held_most:
                yield from self.without_long()

        def without_long(self) -> Iterator[pa.RecordBatch]:
            p = np.concatenate(self.parts)
            p = p[np.argsort(p["key"], kind="stable")]
            starts, sizes = _runs(p["key"])
            keys = p["key"][starts]
            known = np.isin(keys, np.fromiter(self.long, np.uint64, len(self.long)))
            long = (sizes > tile) | known
            for s in np.flatnonzero(long):
                key, run = int(keys[s]), p[starts[s] : starts[s] + sizes[s]]
                run = np.concatenate([self.long[key], run]) if key in self.long else run
                whole = len(run) // tile * tile
                for a in range(0, whole, tile):
                    yield self.tile(key, run[a : a + tile])
                self.long[key] = run[whole:]
            kept = p[~np.repeat(long, sizes)]
            self.parts, self.size = [kept], len(kept)

        def tile(self, key: int, run: np.ndarray) -> pa.RecordBatch:
            self.tiles[key] = self.tiles.get(key, -1) + 1
            return _tile_batch((self.number << 32) | key, self.tiles[key], run)

        def finish(self) -> Iterator[pa.RecordBatch]:
            if not self.parts:
                return
            yield from self.without_long()
            for key, run in self.long.items():
                if len(run):
                    yield self.tile(key, run)
            p = self.parts[0]
            starts, sizes = _runs(p["key"])
            # a pair that only one text has is shared by nobody
            shared = np.repeat(sizes > 1, sizes)
            end = np.repeat(starts + sizes, sizes) - np.cumsum(~shared)
            pairs = list(_merge_lists(p[shared], end[shared], matches))
            if pairs:
                yield _pair_batch(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for batch in batches:
            for number, base, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket is None or number != bucket.number:
                    if bucket:
                        yield from bucket.finish()
                    bucket = Bucket(number)
                yield from bucket.add(base, blob)
        if bucket:
            yield from bucket.finish()

    return run


def _tile_pairs(matches: int):
    """Rows (left tile, right tile or null for the left one with itself) -> pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(x.as_py(), HELD)
                other = None if y.as_py() is None else np.frombuffer(y.as_py(), HELD)
                pairs, most = [], COORDINATES - matches - CHANCE
                y = x if other is None else other
                lo, hi, ids = (np.ascontiguousarray(y[f]) for f in ("lo", "hi", "id"))
                for k in range(len(x)):
                    begin = k + 1 if other is None else 0
                    hit = np.flatnonzero(_differing(lo[begin:] ^ x["lo"][k]) + _differing(hi[begin:] ^ x["hi"][k]) <= most) + begin
                    if len(hit):
                        pairs.append(np.stack([np.full(len(hit), x["id"][k]), ids[hit]], 1))
                yield _pair_batch(pairs).select(["a", "b"])

    return run


def numbered_tile_pairs(tiles: DataFrame) -> DataFrame:
    """All pairs of tile numbers of each long list with their tiles, spread over all tasks: left, right.

    Pairs are numbers until they are joined to their tiles; each has a partition of its own, not its list's.
    """
    t = tiles.select("list", "tile", "blob")
    most = t.groupBy("list").agg(F.max("tile").alias("most"))
    pairs = most.select("list", F.explode(F.sequence(F.lit(0), "most")).alias("i"), "most").select("list", "i", F.explode(F.sequence("i", "most")).alias("j"))
    met = pairs.join(t.select("list", F.col("tile").alias("i"), F.col("blob").alias("left")), ["list", "i"]).join(t.select("list", F.col("tile").alias("j"), F.col("blob").alias("right")), ["list", "j"])
    return met.repartition("list", "i", "j").select("left", F.when(F.col("i") != F.col("j"), F.col("right")).alias("right"))


def _similar_batches(width: int, at_least: float):
    """Rows (a, b, text_a, text_b) -> (a, b, similarity) of the pairs whose sets are similar enough.

    The sets are taken by the 64-bit hashes of their shingles, once for each text of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            _, first, at = np.unique(ends, return_index=True, return_inverse=True)
            texts = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first)).to_pylist()
            rows, h, starts = shingle_hashes(texts, width)
            sets: list[frozenset] = [frozenset()] * len(texts)
            for r, part in zip(rows, np.split(h, starts[1:]), strict=True):
                sets[r] = frozenset(part.tolist())
            n = batch.num_rows
            both = np.fromiter((len(sets[x] & sets[y]) for x, y in zip(at[:n].tolist(), at[n:].tolist(), strict=True)), np.int64, n)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            union = sizes[at[:n]] + sizes[at[n:]] - both
            keep = np.flatnonzero((union > 0) & (both >= at_least * union - 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(both[keep] / np.maximum(union[keep], 1))], ["a", "b", "similarity"])

    return run


def text_class(text: str) -> list[Column]:
    """Class of a text, h1 and h2: 128 bits, one value for all its exact copies."""
    return [F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")]


_CLASS = ["h1", "h2"]


def similar_classes(rows: DataFrame, text: str, width: int = 5, at_least: float = 0.8, matches: int = MATCHES, tile: int = TILE) -> DataFrame:
    """Pairs of different texts with nearly the same set of word shingles: a1, a2, b1, b2 (their classes), similarity.

    Null texts and texts of fewer than ``width`` words have no shingles and are in no pair; copies are one class;
    empty tables give no pairs; other columns are not looked at. Every pair found is exact; a pair of similarity s is
    missed where too few coordinates collide, with probability 0.45 % at 0.6 and below 0.01 % from 0.7 on.
    """
    texts = rows.select(*text_class(text), F.col(text).cast("string").alias("text")).where("text is not null")
    signed = texts.mapInArrow(_sign_batches(width), "h1 bigint, h2 bigint, signature binary").dropDuplicates(_CLASS)
    signed = materialise(signed.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "signature"), "signatures")
    counts = value_counts(signed)
    buckets = max(24, -(-signed.count() * (COORDINATES - matches + 1) // BUCKET_POSTINGS))
    posted = signed.select("id", "signature").mapInArrow(_post_batches(counts, buckets, matches), "bucket int, base bigint, blob binary")
    merged = posted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge_batches(matches, tile, HELD_POSTINGS), _MERGED)
    merged = materialise(merged, "merged")
    candidates, tiles = merged.where("blob is null").select("a", "b"), merged.where("blob is not null")
    if tiles.head(1):
        candidates = candidates.unionByName(numbered_tile_pairs(tiles).mapInArrow(_tile_pairs(matches), "a bigint, b bigint"))
    candidates = materialise(candidates.distinct(), "candidates")
    n = candidates.count()
    ends = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ends = materialise(signed.select("id", *_CLASS).join(broadcast_if_small(ends, 2 * n, 16), "id"), "ends")
    # the texts of candidates alone, each class once; no text of any other row moves
    held = texts.join(broadcast_if_small(ends, 2 * n, 32), _CLASS).dropDuplicates(["id"])
    both = candidates.join(held.select(F.col("id").alias("a"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("text").alias("text_a")), "a")
    both = both.join(held.select(F.col("id").alias("b"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("text").alias("text_b")), "b")
    similar = both.select("a", "b", "text_a", "text_b").mapInArrow(_similar_batches(width, at_least), "a bigint, b bigint, similarity double")
    named = lambda side: ends.select(F.col("id").alias(side), F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"))
    return similar.join(named("a"), "a").join(named("b"), "b").select("a1", "a2", "b1", "b2", "similarity")


def class_members(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Members of the classes of equal texts: {key}, h1, h2, rep (the class's smallest key), n (its members).

    Rows with a null key or text are in no class; repeated rows count once; a key that comes with several texts is a
    member of each of their classes.
    """
    members = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), *text_class(text)).distinct()
    sized = members.groupBy(*_CLASS).agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n"))
    return members.join(sized, _CLASS).select(F.col("k").alias(key), *_CLASS, "rep", "n")


def similar_links(rows: DataFrame, key: str, text: str, width: int = 5, at_least: float = 0.8, **how: int) -> DataFrame:
    """Pairs of classes with nearly the same text by their representatives: {key}_a, {key}_b (smaller first), similarity.

    With class_members this states every link, whatever the number of copies.
    """
    links = materialise(similar_classes(rows, text, width, at_least, **how), "links")
    reps = class_members(rows, key, text).select(*_CLASS, "rep").distinct()
    named = links.join(reps.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("rep").alias("x")), ["a1", "a2"]).join(reps.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("rep").alias("y")), ["b1", "b2"])
    return named.where("x <> y").groupBy(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).agg(F.max("similarity").alias("similarity"))


#: Members of a class (or product of two classes' members) up to which all pairs of copies are written out.
COPY_PAIRS = 4096


def similar_pairs(rows: DataFrame, key: str, text: str, width: int = 5, at_least: float = 0.8, copy_pairs: int = COPY_PAIRS, **how: int) -> DataFrame:
    """Pairs of different keys with nearly the same text: {key}_a, {key}_b (smaller first).

    Pairs of classes are carried over to their members. Up to ``copy_pairs`` pairs from one pair of classes (or one
    class) all are written out; groups of exact copies beyond that come as a star: every member is linked to its
    class's smallest key, and the smallest keys of similar classes to each other. No link between different texts is
    lost, and a group of copies never grows by its square; similar_links and class_members state the same for any
    number of copies without a limit. Null and repeated keys are taken as class_members does.
    """
    links = materialise(similar_classes(rows, text, width, at_least, **how).select("a1", "a2", "b1", "b2"), "links")
    members = class_members(rows, key, text).withColumnRenamed(key, "k")
    # copies of a text without shingles are similar to nothing
    copied = members.where("n > 1")
    spoken = rows.where(F.col(text).isNotNull()).select(*text_class(text), F.col(text).alias("text")).join(copied.select(*_CLASS).distinct(), _CLASS, "left_semi").dropDuplicates(_CLASS)
    copied = copied.join(spoken.mapInArrow(_has_shingles(width), "h1 bigint, h2 bigint"), _CLASS, "left_semi")
    side = lambda s: members.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("k").alias(f"k_{s}"), F.col("rep").alias(f"rep_{s}"), F.col("n").alias(f"n_{s}"))
    # of a class with too many members only the representative goes on
    sizes = members.select(*_CLASS, "n").distinct()
    sized = links.join(sizes.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("n").alias("m_a")), ["a1", "a2"]).join(sizes.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("n").alias("m_b")), ["b1", "b2"])
    sized = sized.select("a1", "a2", "b1", "b2", (F.col("m_a") * F.col("m_b") <= copy_pairs).alias("all"))
    across = sized.join(side("a"), ["a1", "a2"]).where("all or k_a = rep_a").join(side("b"), ["b1", "b2"]).where("all or k_b = rep_b").select("k_a", "k_b")
    few = F.col("n") * F.col("n") <= copy_pairs
    own = copied.where(few).select(*_CLASS, F.col("k").alias("k_a"))
    within = own.join(own.withColumnRenamed("k_a", "k_b"), _CLASS).select("k_a", "k_b")
    star = copied.where(~few).select(F.col("k").alias("k_a"), F.col("rep").alias("k_b"))
    pairs = across.unionByName(within).unionByName(star).where("k_a <> k_b")
    return pairs.select(F.least("k_a", "k_b").alias(f"{key}_a"), F.greatest("k_a", "k_b").alias(f"{key}_b")).distinct()


def _has_shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([len(words(t)) >= width for t in batch.column(2).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], _CLASS)

    return run
