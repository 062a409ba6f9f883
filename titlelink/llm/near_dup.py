"""Operator 10: near-duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles (ASCII lower case; fewer words: the whole sequence). Documents
with the same set form a class, and only its representative (the least doc_id) goes on. A signature has 64 components of 16
bits; two sets of similarity 0.75 differ in 16 of them on average and in more than 31 about once in 100,000 pairs.

Multi-index: 16 chunks of 4 components. Signatures that differ in at most 31 components differ in at most one component of some chunk
(pigeonhole: 16 * 2 > 31), so the four ways to leave out one component of each chunk give 64 keys, one of which they share. A pair
is looked at under its first shared key only. Within a key, pairs at a distance of at most 31, whose sizes allow the similarity,
connect. The parts that are connected so are then compared on full sets, and what is confirmed gives the components.

A group (of a key, or a part) is dealt out over blocks of rows. Its least member is copied to each block; what is like it is connected
without meeting the rest. Only members unlike it are compared with all others, block by block. So no group emits all its pairs, whatever
its size, unless its members are really unlike. Nothing is dropped, capped or sampled, and links, fingerprints and components
stay on the executors.

Nulls and edge cases: a null or empty text, or one without words, has an empty set and links with nothing; a document of one to four words
links with those of the same words; a null doc_id links with nothing and is its own null component; rows that share a doc_id
are one document with the union of their links; empty tables give an empty result; other columns are ignored by `near_duplicates`
and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table, text_bytes

SHINGLE = 5
PARTS, CHUNKS, PER_CHUNK = 64, 16, 4
DISTANCE = 31
SHARE = 75
BLOCK = 512
#: Shingles that a block of a part holds, about.
BLOCK_SHINGLES = 4_000_000
SMALL = 16
#: Rows of a few longs that may be broadcast after a count.
MOST_BROADCAST = 1_000_000
_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if counted to be small."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    code = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        code = code * _STEP + each[k : k + len(code)]
    code ^= code >> np.uint64(29)
    code *= _MIX
    code ^= code >> np.uint64(32)
    return np.unique(code)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of 64 minima, under orders given by odd factors."""
    least = np.full(PARTS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[k : k + 2048, None] * _FACTORS[None, :]).min(axis=0), out=least)
    return ((least * _STEP) >> np.uint64(48)).astype(np.uint16)


_FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, sig binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, ones, twos, signs = [], [], [], []
        for raw in batch.column(1).to_pylist():
            found = shingle_set(raw)
            digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<i8")
            sizes.append(len(found))
            ones.append(int(digest[0]))
            twos.append(int(digest[1]))
            signs.append(signature(found).astype("<u2").tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(signs, pa.binary())],
            names=["doc_id", "n_shingles", "d1", "d2", "sig"],
        )


def features(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_features, _FEATURES)


def _variants(signs: np.ndarray) -> np.ndarray:
    """The 64 keys of each signature: the number of the chunk and of the component left out, and the other three."""
    chunks = signs.reshape(-1, CHUNKS, PER_CHUNK).astype(np.int64)
    out = np.empty((len(signs), CHUNKS, PER_CHUNK), np.int64)
    for left in range(PER_CHUNK):
        a, b, c = (chunks[:, :, k] for k in range(PER_CHUNK) if k != left)
        out[:, :, left] = (np.arange(CHUNKS) * PER_CHUNK + left) << 48 | a << 32 | b << 16 | c
    return out.reshape(len(signs), -1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, rows=1024):
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, PARTS)
        keys = _variants(signs)
        rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(rep)], names=["key", "rep"])


class _Sets:
    """Which rows of a group are connected."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def top(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Connect rows pairwise; the pairs that were new."""
        new = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (p := self.top(x)) != (q := self.top(y)):
                self.parent[p] = q
                new.append((x, y))
        return new


def _agree(x: np.ndarray, y: np.ndarray, variant: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows of signatures are near enough and may be similar by size; and whether they also meet here under their first shared key."""
    same = x == y
    good = (same.sum(-1) >= PARTS - DISTANCE) & (100 * np.minimum(nx, ny) >= SHARE * np.maximum(nx, ny))
    here = good.copy()
    if good.any():
        chunks = same.reshape(*same.shape[:-1], CHUNKS, PER_CHUNK)
        count = chunks.sum(-1)
        first = (count >= PER_CHUNK - 1).argmax(-1)
        inside = np.take_along_axis(chunks, first[..., None, None], axis=-2)[..., 0, :]
        left = np.where(inside.all(-1), 0, (~inside).argmax(-1))
        here &= first * PER_CHUNK + left == variant
    return good, here


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups: rows of like first `keys` columns, which come together, are never parted."""
    held: list[pa.RecordBatch] = []  # rows of the last group so far

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        # Large offsets: the group's binary values may be more than 2 GB, and stay one batch.
        columns = [[p.column(k) for p in parts] for k in range(parts[0].num_columns)]
        wide = [[c.cast(pa.large_binary()) for c in cs] if pa.types.is_binary(cs[0].type) else cs for cs in columns]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(cs) for cs in wide], names=parts[0].schema.names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        same = np.all([c == c[-1] for c in columns], axis=0)
        cut = 0 if same.all() else int(batch.num_rows - np.argmin(same[::-1]))
        if held and any(held[-1].column(k)[0].as_py() != columns[k][0] for k in range(keys)):
            yield whole(held)
            held = []
        if cut:
            yield whole([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield whole(held)


def _pairs(reps: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    return [(min(p, q), max(p, q)) for p, q in zip(reps[x].tolist(), reps[y].tolist(), strict=True) if p != q]


def _rows(pairs: list[tuple[int, int]], first: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.asarray(pairs, np.int64).reshape(-1, 2) + first
    return both[:, 0], both[:, 1]


_FOUND = "a long, b long, loose boolean"


def _found(edges: list[tuple[int, int]], loose: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = edges + loose
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64()), pa.array([False] * len(edges) + [True] * len(loose), pa.bool_())], names=["a", "b", "loose"]
    )


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
    return np.append(np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))), batch.num_rows)


class _Signatures:
    """Near signatures of rows (key, i, blocks, rep, n_shingles, sig) of groups."""

    SCHEMA = "n_shingles long, sig binary"

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.key = batch.column(0).to_numpy(zero_copy_only=False)
        self.size = batch.column(at).to_numpy(zero_copy_only=False)
        self.signs = np.frombuffer(b"".join(batch.column(at + 1).to_pylist()), "<u2").reshape(-1, PARTS)

    def compare(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, here) of the near pairs of rows x with rows y of one group."""
        for k in range(0, len(x), 32):
            own = x[k : k + 32]
            good, here = _agree(self.signs[own][:, None, :], self.signs[y][None, :, :], self.key[own[0]] >> 48, self.size[own][:, None], self.size[y][None, :])
            p, q = np.nonzero(good)
            yield own[p], y[q], here[p, q]


class _Shingles:
    """Similar sets of rows (part, i, blocks, rep, shingles) of groups."""

    SCHEMA = "shingles binary"

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.raw = batch.column(at)

    def sets(self, rows: np.ndarray) -> list[np.ndarray]:
        return [np.frombuffer(self.raw[k].as_py(), "<u8") for k in rows.tolist()]

    def compare(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        many = self.sets(y)
        sizes = np.asarray([len(t) for t in many])
        every, owner = np.concatenate(many), np.repeat(np.arange(len(y)), sizes)
        if len(x) <= 8:
            for own, one in zip(x.tolist(), self.sets(x), strict=True):
                hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
                both = np.bincount(owner[hit], minlength=len(y))
                q = np.flatnonzero(100 * both >= SHARE * (len(one) + sizes - both))
                yield np.full(len(q), own), y[q], np.ones(len(q), bool)
            return
        few = self.sets(x)
        lengths = np.asarray([len(t) for t in few])
        known = np.unique(np.concatenate(few))
        held = known[np.minimum(np.searchsorted(known, every), len(known) - 1)] == every
        owner, number = owner[held], np.searchsorted(known, every[held])
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        mine, own = np.repeat(np.arange(len(x)), lengths), np.searchsorted(known, np.concatenate(few))
        order = np.argsort(own, kind="stable")
        mine, own = mine[order], own[order]
        both = np.zeros((len(x), len(y)), np.float32)
        step = max(256, min(8192, (16 << 20) // (4 * (len(x) + len(y)))))
        for low in range(0, len(known), step):
            grids = []
            for n, rows, cols in ((len(x), mine, own), (len(y), owner, number)):
                p, q = np.searchsorted(cols, [low, low + step])
                grid = np.zeros((n, step), np.float32)
                grid[rows[p:q], cols[p:q] - low] = 1
                grids.append(grid)
            both += grids[0] @ grids[1].T
        p, q = np.nonzero(100 * both >= SHARE * (lengths[:, None] + sizes[None, :] - both))
        yield x[p], y[q], np.ones(len(p), bool)


def _within(kind) -> object:
    """Edges between the like rows of each group (key, i), which rows of `kind` follow with blocks and rep; rows come sorted by these. Each row
    is compared with the group's least rep, and those unlike it with all. In a group of several blocks, which all hold the least
    rep, rows that stay unconnected with it are told as loose (key, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 2):
            starts, rows = _starts(batch, 2), kind(batch, 4)
            key, blocks, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            sizes = np.diff(starts)
            edges: list[tuple[int, int]] = []
            loose: list[tuple[int, int]] = []
            few = (sizes <= SMALL) & (blocks[starts[:-1]] == 1) & (kind is _Signatures)
            group = np.repeat(np.arange(len(sizes)), sizes)
            for lag in range(1, min(SMALL, int(sizes[few].max(initial=0)))):  # small groups of all keys at once
                at = np.flatnonzero(few[group[:-lag]] & (group[:-lag] == group[lag:]))
                for k in range(0, len(at), 8192):
                    x = at[k : k + 8192]
                    y = x + lag
                    _, here = _agree(rows.signs[x], rows.signs[y], key[x] >> 48, rows.size[x], rows.size[y])
                    edges += _pairs(rep, x[here], y[here])
            for g in np.flatnonzero(~few & ((sizes > 1) | (blocks[starts[:-1]] > 1))).tolist():
                a, b = int(starts[g]), int(starts[g + 1])
                every = np.arange(a, b)
                lead = a + int(rep[a:b].argmin())
                joined = _Sets(b - a)
                near = np.zeros(b - a, bool)
                near[lead - a] = True
                for x, y, here in rows.compare(np.asarray([lead]), every):
                    joined.join(x - a, y - a)
                    near[y - a] = True
                    edges += _pairs(rep, x[here], y[here])
                rest = every[~near]
                if len(rest):
                    for x, y, here in rows.compare(rest, every):
                        new = joined.join(x - a, y - a)
                        if kind is _Signatures:
                            edges += _pairs(rep, x[here], y[here])
                        else:
                            edges += _pairs(rep, *_rows(new, a))
                if blocks[a] > 1:
                    home = joined.top(lead - a)
                    loose += [(int(key[a]), int(rep[k])) for k in rest.tolist() if joined.top(k - a) != home]
            if edges or loose:
                yield _found(edges, loose)

    return run


def _across(kind) -> object:
    """Edges between the loose rows and all rows of each group (key, i, j), in which `side` 0 comes before 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 3):
            starts, rows = _starts(batch, 3), kind(batch, 5)
            side, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            edges: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                cut = a + int(np.count_nonzero(side[a:b] == 0))
                if a < cut < b:
                    joined = _Sets(b - a)
                    for x, y, _ in rows.compare(np.arange(a, cut), np.arange(cut, b)):
                        edges += _pairs(rep, *_rows(joined.join(x - a, y - a), a))
            if edges:
                yield _found(edges, [])

    return run


def _linked(rows: DataFrame, key: str, kind) -> DataFrame:
    """Edges (a, b) that connect whatever is alike within the groups of rows (key, blocks, lead, rep, those of kind).

    A group is dealt out over its blocks, each with the group's least rep, so the work is linear in what is alike. The rows that aren't
    connected with it there are compared with all rows of their group, in blocks too: those alone are copied, once for each block of
    the others.
    """
    own = [c.split(" ")[0] for c in kind.SCHEMA.split(", ")]
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    dealt = rows.withColumn(
        "i",
        F.explode(F.when((F.col("blocks") > 1) & (F.col("rep") == F.col("lead")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block))),
    )
    dealt = dealt.select(key, "i", "blocks", "rep", *own).repartition(key, "i").sortWithinPartitions(key, "i")
    found = materialise(dealt.mapInArrow(_within(kind), _FOUND), "found")
    edges, loose = found.where("not loose").select("a", "b"), found.where("loose").select(F.col("a").alias(key), F.col("b").alias("rep")).distinct()
    if not loose.limit(1).count():
        return edges
    counts = materialise(loose.groupBy(key).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts")), "loose")
    every = rows.join(small(counts), key).select(key, "parts", "blocks", "rep", *own)
    left = every.join(small(loose), [key, "rep"], "left_semi").withColumn("i", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts"))).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)),
    )
    right = every.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("j", block)
    both = [x.select(key, "i", "j", F.lit(n).alias("side"), "rep", *own) for n, x in enumerate((left, right))]
    met = both[0].unionByName(both[1]).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "side")
    return edges.unionByName(met.mapInArrow(_across(kind), _FOUND).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(rep, root) for each node of the graph, root being the least of its component: alternating stars, written at each round.

    The stars' centres are broadcast if the edges are few; else they are written before their joins, so that the edges of a hot one can be
    split over tasks.
    """

    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    at = materialise(edges.select("a", "b").distinct(), "edges")
    seen = told(at)
    while True:
        centres = F.broadcast if 2 * seen[0] <= MOST_BROADCAST else lambda df: materialise(df, "centres")
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(centres(least), "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(centres(down), "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        at = materialise(moved.unionByName(down.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        before, seen = seen, told(at)
        if before == seen:
            return at.select(F.col("b").alias("rep"), F.col("a").alias("root")).unionByName(at.select(F.col("a").alias("rep"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach), kept (it is that one)."""
    found = materialise(features(docs), "features")
    classes = found.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.count("*").alias("c"),
    )
    classes = materialise(classes, "classes")
    keys = classes.select("rep", "sig").mapInArrow(_keys, "key long, rep long")
    # Counted before they are joined: a key that many share is split over tasks, and most keys are of one row and go.
    counts = materialise(
        keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("lead")).where("c > 1").select(
            "key", F.ceil(F.col("c") / F.lit(BLOCK)).alias("blocks"), "lead",
        ),
        "keys",
    )
    shared = materialise(keys.join(small(counts), "key"), "shared")
    signed = shared.join(classes.select("rep", "n_shingles", "sig"), "rep")
    parts = materialise(components(_linked(signed, "key", _Signatures)), "parts")

    members = parts.join(classes.select("rep", "n_shingles"), "rep")
    sized = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).alias("blocks"))
    sized = materialise(parts.join(small(materialise(sized, "sizes")), "root").select("rep", F.col("root").alias("part"), "blocks"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_bytes().alias("text")).join(small(sized), "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [shingle_set(t).astype("<u8").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.binary())], names=["rep", "part", "blocks", "shingles"])

    whole = texts.select("rep", "part", "blocks", "text").mapInArrow(sets, "rep long, part long, blocks long, shingles binary").withColumn("lead", F.col("part"))
    links = _linked(whole.where("octet_length(shingles) > 0"), "part", _Shingles)
    copies = classes.where("c > 1").select("d1", "d2", "n_shingles", "rep")
    placed = found.join(copies, ["d1", "d2", "n_shingles"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"),
    )
    placed = materialise(placed, "placed")
    # A doc_id with several texts joins their classes.
    least = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("m")).where("a < m").drop("m")
    joined = placed.join(least, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    roots = components(links.unionByName(joined))
    ended = placed.join(roots, "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return ended.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns. Rows with a null doc_id, or one that other rows have too, go by their
    id and text: rows alike in both are one (that with the least other columns), others are grouped by their texts alone. A group keeps its
    least doc_id, such rows last."""
    id_, row = F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    repeated = materialise(docs.where(id_.isNotNull()).groupBy(id_.alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id", F.lit(True).alias("_again")), "repeated")
    any_ = repeated.limit(1).count() > 0
    marked = docs.join(small(repeated), id_ == F.col("_id"), "left").drop("_id") if any_ else docs.withColumn("_again", F.lit(None).cast("boolean"))
    marked = marked.withColumn("_row", F.when(id_.isNull() | F.col("_again"), row).otherwise(id_))
    kept = materialise(near_duplicates(marked.select(F.col("_row").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_kept")).distinct(), "kept")
    rows = marked.join(small(kept), F.col("_row") == F.col("_kept"), "left_semi")
    several = id_.isNull() | F.coalesce("_again", F.lit(False))
    once = rows.where(several).groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("_r")).select("_r.*")
    return rows.where(~several).select(*docs.columns).unionByName(once)


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
