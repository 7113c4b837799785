"""N-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

Two documents link when ``den * |A and B| >= num * |A or B|`` over their distinct n-word
shingles (64-bit hashes; words are lower-cased A-Z, cut at ASCII white space).  The join
is exact over hashes and returns, per document, its set size and its component.

1. ``profiles``: per document the set size and a 128-bit fingerprint of the set; documents of
   one fingerprint are one class from here on, however many copies there are.  The same
   pass counts, in a sketch of fixed size, in how many documents a shingle occurs.
2. ``postings``: linked sets share a shingle among each one's first
   n - ceil(num n / den) + 1 in any common order; the order is rarest first by the sketch, so
   passages that many documents share come last.  Shingles that the sketch shows to be
   unique are left out.  Entries travel as binary blocks to hash buckets, and only
   those become rows that have a partner of a possible size and place in the order; shingles
   that the sketch shows to be very frequent skip the buckets.
3. Tiles of one shingle: pairs within the size ratio compare parity bitmaps (bit i is the
   parity of the elements hashed to i, about one bit an element).  Bits that differ count
   elements of one set only, so ``(|A| + |B| - differing bits) / 2`` bounds the overlap from
   above.  Pairs that pass only join clusters: a tile returns a spanning forest.
4. Tiles of one cluster: each class ships its sorted set; pairs pass the size ratio, the
   bitmap bound and the exact intersection, unless already linked through others.  A tile
   again returns a spanning forest, so no group's pairs are ever listed.

A group that would make a large tile is cut into salted blocks, dealt anew for each group, and
searched in two rounds (``linked``): every block on its own, then, with one label for all that is linked so
far, pairs of blocks of equal or adjacent size bands (a factor den/num wide).  Rows of one
label are not compared any more, groups of one label are done, and large labels have blocks of
their own that never meet.  Nothing is capped: m sets of one shingle that do not link cost
m^2 / (2 blocks) comparisons, but m near copies do not.

Defined results: null, empty and blank texts have an empty set, link with nothing and are
their own component; texts of fewer than n words have one shingle; repeated rows are
exact copies (one component; equal doc_ids stay rows of their own); a null doc_id takes
part but is never a component's id unless all are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import bytewords as bw
from .components import components
from .workers import ready

SKETCH_BITS = 22
MEMBER_BITS = 25
CHUNKS = 64
#: Shingles counted at least this often by the sketch do not go through the buckets.
FREQUENT = 20_000
#: Classes per block of a shingle's tile, shingles per block of a cluster's tile.
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 16_384


class Sets:
    """Distinct shingle sets of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int) -> None:
        n_docs = len(offsets) - 1
        h, doc = bw.word_hashes(data, offsets, bw.NOT_BLANK)
        sh, sd = bw.shingle_hashes(h, doc, n_docs, n)
        self.flat, self.ends = bw.distinct_sets(sh, sd, n_docs)
        self.size = np.diff(self.ends)
        self.doc = np.repeat(np.arange(n_docs), self.size)

    def fingerprints(self) -> np.ndarray:
        """(texts, 2) 64-bit words; meaningless for empty sets."""
        out = np.zeros((len(self.size), 2), np.uint64)
        has = np.flatnonzero(self.size)
        if len(has):
            for k, seed in enumerate((0xA5A5A5A5DEADBEEF, 0x0123456789ABCDEF)):
                s = np.add.reduceat(bw.mix(self.flat ^ np.uint64(seed)), self.ends[has])
                out[has, k] = bw.mix(s + self.size[has].astype(np.uint64))
        return out

    def first_of_each(self, prints: np.ndarray) -> np.ndarray:
        """Numbers of the texts with a set, the first of each fingerprint only."""
        has = np.flatnonzero(self.size)
        _, first = np.unique(prints[has], axis=0, return_index=True)
        return has[np.sort(first)]

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]


def _bytes16(prints: np.ndarray) -> pa.Array:
    return bw.binary_rows(np.ascontiguousarray(prints).ravel(), np.arange(len(prints) + 1) * 2)


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set as 64-bit words; the width is the power of two at or above its size, 64 at least."""
    width = max(64, 1 << (max(1, len(values)) - 1).bit_length())
    bits = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows, words) narrowed to fewer words; parity survives xor of the halves."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1) if maps.shape[1] != words else maps


# -- arrays of fixed size, added up over all tasks -------------------------------------------


def _array_rows(total: np.ndarray) -> Iterator[tuple[int, bytes]]:
    pack = zstandard.ZstdCompressor(level=1)
    for i, part in enumerate(np.split(total, CHUNKS)):
        if part.any():
            yield i, pack.compress(part.astype(np.uint32).tobytes())


def _sum_arrays(rows: DataFrame, bits: int) -> np.ndarray:
    """Sum of the 2^bits counters whose chunks are ``rows`` (chunk, counts); saturates at 65535."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts")):
                part = np.frombuffer(unpack.decompress(counts.as_py()), np.uint32)
                sums[chunk] = sums[chunk] + part if chunk in sums else part.astype(np.uint64)
        pack = zstandard.ZstdCompressor(level=1)
        for chunk, total in sums.items():
            small = np.minimum(total, 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([pack.compress(small.tobytes())], pa.binary())], names=["chunk", "counts"])

    out = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.uint16)
    unpack = zstandard.ZstdDecompressor()
    # 64 rows of a fixed size
    for r in rows.select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[r.chunk] = np.frombuffer(unpack.decompress(bytes(r.counts)), np.uint16)
    return out.ravel()


# -- 1 and 2: profiles and postings --------------------------------------------------------------


def _profiles(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "size", "class", "chunk", "counts"]
        doc_type = None
        for b in batches:
            doc_type = b.column("doc_id").type
            for first, data, offsets in bw.slices(b.column("text")):
                sets = Sets(data, offsets, n)
                np.add.at(total, _places(sets.flat, SKETCH_BITS), np.uint32(1))
                k = len(sets.size)
                prints = _bytes16(sets.fingerprints())
                prints = pa.compute.if_else(pa.array(sets.size > 0), prints, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, k), pa.array(sets.size, pa.int64()), prints, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                    names=names,
                )
        for chunk, counts in _array_rows(total) if doc_type is not None else ():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, doc_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([chunk], pa.int32()), pa.array([counts], pa.binary())],
                names=names,
            )

    return run


_POSTINGS = "bucket int, base long, tokens binary, items binary, sizes binary, ranks binary, class binary, size long, bitmap binary"
_POSTING_NAMES = [f.split()[0] for f in _POSTINGS.split(", ")]
#: Entries that go out together, in one block per bucket.
BATCH_ENTRIES = 120_000
#: Shingle tiles of at most this many entries are pruned pair by pair in their bucket.
FEW = 64


def _postings(sketch, n: int, num: int, den: int, bucket_bits: int) -> Callable:
    """Blocks of prefix entries by bucket (bucket -1: frequent shingles) and, with bucket null, the classes they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        base = TaskContext.get().partitionId() << 40
        for b in batches:
            # entries of several slices go out together; items are numbered from ``start``
            start, held = base, []
            for _, data, offsets in bw.slices(b.column("text")):
                sets = Sets(data, offsets, n)
                if not len(sets.flat):
                    continue
                prints = sets.fingerprints()
                kept = sets.first_of_each(prints)
                number = np.full(len(sets.size), -1)
                number[kept] = np.arange(len(kept))
                mine = number[sets.doc] >= 0
                token, doc = sets.flat[mine], sets.doc[mine]
                count = counts[_places(token, SKETCH_BITS)]
                order = np.lexsort((token, count, doc))
                token, doc, count = token[order], doc[order], count[order]
                begin = np.zeros(len(sets.size), np.int64)
                begin[kept] = np.concatenate(([0], np.cumsum(sets.size[kept])))[:-1]
                rank = np.arange(len(doc)) - begin[doc]
                prefix = sets.size - -(-num * sets.size // den) + 1
                use = (rank < prefix[doc]) & (count > 1)
                token, doc, count, rank = token[use], doc[use], count[use], rank[use]
                # a place in the order, in 256ths of the set, rounded down
                place = (rank * 256 // sets.size[doc]).astype(np.uint8)
                bucket = np.where(count >= FREQUENT, -1, (token & np.uint64((1 << bucket_bits) - 1)).astype(np.int64))
                item = number[doc] + (base - start)
                held.append((bucket, token, item.astype(np.uint32), sets.size[doc].astype(np.uint32), place))
                docs = kept[np.unique(number[doc])]
                if len(docs):
                    yield _class_rows(sets, prints, docs, base + number[docs])
                base += len(kept)
                if sum(len(h[0]) for h in held) > BATCH_ENTRIES:
                    yield from _entry_rows(held, start)
                    start, held = base, []
            yield from _entry_rows(held, start)

    return run


def _class_rows(sets: Sets, prints: np.ndarray, docs: np.ndarray, refs: np.ndarray) -> pa.RecordBatch:
    m = len(docs)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(m, pa.int32()),
            pa.array(refs, pa.int64()),
            *[pa.nulls(m, pa.binary())] * 4,
            _bytes16(prints[docs]),
            pa.array(sets.size[docs], pa.int64()),
            pa.array([bitmap(sets.of(i)).tobytes() for i in docs], pa.binary()),
        ],
        names=_POSTING_NAMES,
    )


def _entry_rows(held: list[tuple[np.ndarray, ...]], start: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket of the held entries."""
    if not sum(len(h[0]) for h in held):
        return
    bucket, *columns = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    k, ends = len(cut), np.append(cut, len(bucket))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cut], pa.int32()),
            pa.array(np.full(k, start), pa.int64()),
            *[bw.binary_rows(c[order], ends) for c in columns],
            pa.nulls(k, pa.binary()),
            pa.nulls(k, pa.int64()),
            pa.nulls(k, pa.binary()),
        ],
        names=_POSTING_NAMES,
    )


def _paired(token: np.ndarray, size: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Booleans over entries sorted by (token, size): has a partner that size and place allow.

    If the pair's first common shingle stands at places i and j, at most the rest of either set is
    common; so a linked pair passes at its first common shingle, if nowhere else.
    """
    keep = np.zeros(len(token), bool)
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    count = np.diff(np.append(start, len(token)))
    rest = size - place.astype(np.int64) * size // 256
    for m in np.unique(count[(count > 1) & (count <= FEW)]):
        i, j = np.triu_indices(m, 1)
        first = start[count == m][:, None]
        x, y = first + i, first + j
        ok = (den * size[x] >= num * size[y]) & ((num + den) * np.minimum(rest[x], rest[y]) >= num * (size[x] + size[y]))
        keep[x[ok]] = keep[y[ok]] = True
    many = np.repeat(count > FEW, count)
    near = many[1:] & (token[1:] == token[:-1]) & (den * size[:-1] >= num * size[1:])
    keep[1:] |= near
    keep[:-1] |= near
    return keep


def _shared_entries(num: int, den: int) -> Callable:
    """Rows sorted by bucket; (token, ref) of entries that have a possible partner in their bucket, all of bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        current = None

        def told() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            token, ref, size, place = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((size, token))
            token, ref = token[order], ref[order]
            keep = _paired(token, size[order], place[order], num, den)
            yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(ref[keep])], names=["token", "ref"])

        for b in batches:
            for bucket, base, *parts in zip(*[b.column(c).to_pylist() for c in ("bucket", "base", "tokens", "items", "sizes", "ranks")]):
                token, item, size, place = (np.frombuffer(x, t) for x, t in zip(parts, (np.uint64, np.uint32, np.uint32, np.uint8)))
                ref = item.astype(np.int64) + base
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ref)], names=["token", "ref"])
                    continue
                if bucket != current:
                    yield from told()
                    current = bucket
                held.append((token, ref, size.astype(np.int64), place))
        yield from told()

    return run


# -- tiles ----------------------------------------------------------------------------------------


def _band(num: int, den: int) -> Column:
    """Sizes in steps of den/num: linked sets are in one band or in two that follow each other."""
    return F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")


def own_tiles(rows: DataFrame, group: str, weight: Column, block: int, seeds: int) -> DataFrame:
    """First round: ``rows`` with the number ``salts`` of blocks of their group, ``tile`` and ``side``.

    A group whose weights sum to at most ``block`` is one tile; of others every block is one on its own, and
    every row is in ``seeds`` blocks, dealt anew for each group and seed."""
    totals = rows.groupBy(group).agg(F.sum(weight).alias("_w"), F.count("*").alias("_m")).where("_m > 1")
    df = rows.join(totals, group).withColumn("salts", F.least(F.ceil(F.col("_w") / block), F.col("_m")).cast("int"))
    salt = lambda i: F.xxhash64(F.col(group), F.lit(i), F.pmod(F.xxhash64("class", group, F.lit(i)), F.col("salts")))
    dealt = F.array(*[salt(i) for i in range(seeds)])
    places = F.when(F.col("salts") <= 1, F.array(F.xxhash64(F.col(group)))).otherwise(dealt)
    return df.withColumn("tile", F.explode(places)).withColumn("side", F.lit(0)).drop("_w", "_m")


def pair_tiles(rows: DataFrame, group: str, weight: Column, block: int, num: int, den: int) -> DataFrame:
    """Second round: ``rows`` (with ``label``) of groups of several blocks, with the tiles in which two blocks meet.

    A group whose rows have one label is done.  In others, a label of half a block or more has blocks of its
    own, which never meet each other; the rows of smaller labels share blocks, which also meet themselves.
    Blocks meet if their size bands are equal or follow each other."""
    open_ = rows.groupBy(group).agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select(group)
    df = rows.join(open_, group).withColumn("_band", _band(num, den))
    sizes = df.groupBy(group, "_band", "label").agg(F.sum(weight).alias("_w"))
    sizes = written(sizes.withColumn("_own", F.col("_w") * 2 >= block), "label-sizes")
    key = [F.col(group).alias("_group"), F.col("_band").alias("_in")]
    large = sizes.where("_own").select(*key, F.col("label").alias("_of"), F.ceil(F.col("_w") / block).cast("int").alias("_n"))
    small = sizes.where("NOT _own").groupBy(*key).agg(F.ceil(F.sum("_w") / block).cast("int").alias("_n"))
    every = large.unionByName(small.withColumn("_of", F.lit(None).cast(large.schema["_of"].dataType)))
    blocks = every.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("_group", F.struct("_in", "_of", "_salt").alias("_b"))
    blocks = blocks.groupBy("_group").agg(F.collect_list("_b").alias("_blocks"))
    # a row's own block: its label's if that has blocks, else one of the shared ones
    held = large.select("_group", "_in", F.col("_of").alias("_large"), F.col("_n").alias("_many"))
    mixed = small.select(F.col("_group").alias("_g2"), F.col("_in").alias("_i2"), F.col("_n").alias("_few"))
    df = df.join(held, (F.col(group) == F.col("_group")) & (F.col("_band") == F.col("_in")) & (F.col("label") == F.col("_large")), "left").drop("_group", "_in")
    df = df.join(mixed, (F.col(group) == F.col("_g2")) & (F.col("_band") == F.col("_i2")), "left").drop("_g2", "_i2")
    salt = F.when(F.col("_large").isNotNull(), F.pmod(F.xxhash64("class"), F.col("_many"))).otherwise(F.pmod(F.xxhash64("label"), F.col("_few")))
    df = df.withColumn("_mine", F.struct(F.col("_band").alias("_in"), F.col("_large").alias("_of"), salt.cast("int").alias("_salt")))
    df = df.join(blocks.withColumnRenamed("_group", "_g3"), F.col(group) == F.col("_g3")).drop("_g3")
    mine = F.col("_mine")
    # a shared block meets itself too: its labels have not met
    meets = lambda b: (F.abs(b["_in"] - mine["_in"]) <= 1) & ~F.coalesce(b["_of"] == mine["_of"], F.lit(False))
    number = lambda b: F.xxhash64(F.col(group), b["_in"], F.coalesce(b["_of"], F.lit(b"").cast("binary")), b["_salt"])
    tile = lambda b: F.struct(
        F.xxhash64(F.least(number(mine), number(b)), F.greatest(number(mine), number(b))).alias("tile"),
        (number(mine) > number(b)).cast("int").alias("side"),
    )
    df = df.withColumn("_place", F.explode(F.transform(F.filter("_blocks", meets), tile)))
    return df.select(*rows.columns, "_place.tile", "_place.side")


def linked(rows: DataFrame, group: str, weight: Column, block: int, num: int, den: int, attach: Callable[[DataFrame], DataFrame], sets: bool, seeds: int) -> DataFrame:
    """Links (a, b) that connect what the pairs of ``rows`` (group, class, size) within a group connect.

    The first round compares within blocks; what it links gets one label, and the second round neither compares
    rows of one label nor tells their links, and leaves out groups that have one label only.  So a
    family of m near copies tells about m links for each group it is in, not m^2 / block."""
    columns = ["tile", "side", "class", "size"]

    def compare(tiles: DataFrame, labelled: bool) -> DataFrame:
        told = attach(tiles).repartition("tile").sortWithinPartitions("tile").mapInArrow(_compare(num, den, sets, labelled), "a binary, b binary")
        return written(told.distinct(), "tile-links")

    first = written(own_tiles(rows, group, weight, block, seeds), "own-tiles")
    links = compare(first.select(*columns), False)
    rest = first.where("salts > 1").select(group, "class", "size").distinct()
    if rest.isEmpty():
        return links
    labels = components(links).withColumnRenamed("node", "_class").withColumnRenamed("label", "_label")
    rest = rest.join(labels, F.col("class") == F.col("_class"), "left").withColumn("label", F.coalesce("_label", "class")).drop("_class", "_label")
    rest = written(rest, "labelled")
    more = compare(pair_tiles(rest, group, weight, block, num, den).select(*columns, "label"), True)
    return links.unionByName(more)


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Rows of one tile at a time, from batches sorted by tile."""
    held: dict[str, list] = {n: [] for n in names}
    current = None
    for b in batches:
        tiles = b.column("tile").to_numpy()
        cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
        cols = {n: b.column(n).to_pylist() for n in names}
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if tiles[lo] != current:
                if len(held[names[0]]) > 1:
                    yield held
                held, current = {n: [] for n in names}, tiles[lo]
            for n in names:
                held[n] += cols[n][lo:hi]
    if len(held[names[0]]) > 1:
        yield held


def _may_link(size: np.ndarray, other: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes with at least ``apart`` elements in one only can still link."""
    return (num + den) * ((size + other - apart) // 2) >= num * (size + other)


class Forest:
    """Labels of a tile's rows, merged as links are found."""

    def __init__(self, n: int, label: np.ndarray | None = None) -> None:
        self.label = np.arange(n) if label is None else label.copy()
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.links.append((i, j))
            self.label[self.label == max(a, b)] = min(a, b)


def tile_links(
    size: np.ndarray,
    side: np.ndarray,
    maps: list[np.ndarray],
    num: int,
    den: int,
    exact: Callable[[int, int], bool] | None = None,
    label: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a tile that pass (size ratio, bitmap bound, then ``exact`` if given).

    Rows of one ``label`` count as linked already."""
    n = len(size)
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    maps = [maps[i] for i in order]
    forest = Forest(n, None if label is None else label[order])
    split = side.any() and not side.all()
    last = np.searchsorted(size, size * den // num, side="right")  # sizes within the ratio
    start = 0
    while start < n:
        # rows whose partners' bitmaps have the same width as the largest of them, in one matrix
        words = len(maps[start])
        stop = start
        while stop < n and len(maps[stop]) == words:
            stop += 1
        reach = int(last[start:stop].max())
        matrix = np.concatenate([fold(np.stack(group), words) for group in _same_width(maps[start:reach])])
        for i in range(start, stop):
            js = np.arange(i + 1, last[i])
            js = js[forest.label[js] != forest.label[i]]
            if split:
                js = js[side[js] != side[i]]
            if not len(js):
                continue
            apart = np.bitwise_count(matrix[js - start] ^ matrix[i - start]).sum(axis=1, dtype=np.int64)
            for j in js[_may_link(size[i], size[js], apart, num, den)].tolist():
                if forest.label[i] != forest.label[j] and (exact is None or exact(int(order[i]), int(order[j]))):
                    forest.join(i, j)
        start = stop
    return [(int(order[i]), int(order[j])) for i, j in forest.links]


def _same_width(maps: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    lo = 0
    for i in range(1, len(maps) + 1):
        if i == len(maps) or len(maps[i]) != len(maps[lo]):
            yield maps[lo:i]
            lo = i


def _link_rows(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], names=["a", "b"])


def _compare(num: int, den: int, sets: bool, labelled: bool = False) -> Callable:
    """Links of tiles: by bitmaps alone, or exactly by the rows' sorted sets."""
    names = ("class", "side", "size", "set" if sets else "bitmap", *(("label",) if labelled else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for tile in _runs(batches, names):
            size, side = np.array(tile["size"], np.int64), np.array(tile["side"])
            label = np.unique(tile["label"], return_inverse=True)[1] if labelled else None
            if label is not None and label.max() == 0:
                continue
            arrays = [np.frombuffer(x, np.uint64) for x in tile[names[3]]]
            exact = None
            if sets:
                values, arrays = arrays, [bitmap(v) for v in arrays]

                def exact(i: int, j: int, values=values) -> bool:
                    x, y = (values[i], values[j]) if len(values[i]) <= len(values[j]) else (values[j], values[i])
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                    return den * both >= num * (len(x) + len(y) - both)

            elif len(size) == 2 and not _may_link(size[:1], size[1:], np.zeros(1, np.int64), num, den)[0]:
                continue  # most tiles are two classes of quite different size
            out += [(tile["class"][i], tile["class"][j]) for i, j in tile_links(size, side, arrays, num, den, exact, label)]
            if len(out) > 10_000:
                yield _link_rows(out)
                out = []
        yield _link_rows(out)

    return run


# -- the join --------------------------------------------------------------------------------------


def _member_table(members: DataFrame) -> np.ndarray:
    """A bit table of fixed size over the class fingerprints of ``members``: no false negatives."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << MEMBER_BITS, bool)  # a byte each: 32 MB a task
        for b in batches:
            prints = np.frombuffer(b"".join(b.column("class").to_pylist()), np.uint64)[::2]
            total[_places(prints, MEMBER_BITS)] = True
        for chunk, counts in _array_rows(total):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([counts], pa.binary())], names=["chunk", "counts"])

    return _sum_arrays(members.select("class").mapInArrow(mark, "chunk int, counts binary"), MEMBER_BITS) > 0


def _member_sets(members, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = members.value
        for b in batches:
            for _, data, offsets in bw.slices(b.column("text")):
                sets = Sets(data, offsets, n)
                prints = sets.fingerprints()
                docs = sets.first_of_each(prints)
                docs = docs[np.unpackbits(table[_places(prints[docs, 0], MEMBER_BITS) >> 3][:, None], axis=1, bitorder="little")[np.arange(len(docs)), _places(prints[docs, 0], MEMBER_BITS) & 7] > 0] if len(docs) else docs
                if len(docs):
                    yield pa.RecordBatch.from_arrays(
                        [_bytes16(prints[docs]), pa.array([sets.of(i).tobytes() for i in docs], pa.binary())], names=["class", "set"]
                    )

    return run


def classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, class) of all documents, and the links between classes (a spanning forest of all)."""
    spark = docs.sparkSession
    ready(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    first = written(texts.mapInArrow(_profiles(n), f"doc_id {kind}, size long, class binary, chunk int, counts binary"), "profiles")
    profiles = first.where("chunk IS NULL").select("doc_id", "size", "class")
    sketch = spark.sparkContext.broadcast(_sum_arrays(first.where("chunk IS NOT NULL"), SKETCH_BITS))

    # about a thousand documents a bucket
    bucket_bits = max(4, min(20, (profiles.count() // 1000).bit_length()))
    entries = written(texts.mapInArrow(_postings(sketch, n, num, den, bucket_bits), _POSTINGS), "postings")
    blocks = entries.where("bucket IS NOT NULL").select("bucket", "base", "tokens", "items", "sizes", "ranks")
    # frequent shingles need no bucket, so their blocks are spread
    spread = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("base", "items"))
    shared = blocks.repartition(spread).sortWithinPartitions("bucket").mapInArrow(_shared_entries(num, den), "token long, ref long")
    owners = entries.where("bucket IS NULL").select(F.col("base").alias("ref"), "class", "size", "bitmap")
    rows = shared.join(owners.drop("bitmap"), "ref").groupBy("token", "class").agg(F.first("size").alias("size"))
    rows = written(rows, "shared-shingles")
    # the bitmaps, most of a row's bytes, join last
    maps = owners.groupBy("class").agg(F.first("bitmap").alias("bitmap"))
    near = linked(rows, "token", F.lit(1), BLOCK_CLASSES, num, den, lambda tiles: tiles.join(maps, "class"), sets=False, seeds=1)

    clusters = components(near)
    members = clusters.withColumnRenamed("node", "class")
    table = spark.sparkContext.broadcast(np.packbits(_member_table(members), bitorder="little"))
    sets = texts.mapInArrow(_member_sets(table, n), "class binary, set binary").groupBy("class").agg(F.first("set").alias("set"))
    sets = sets.join(members, "class").withColumn("size", F.expr("octet_length(set) div 8"))
    sets = written(sets, "member-sets")
    bare = sets.select(F.col("label").alias("cluster"), "class", "size")
    attach = lambda tiles: tiles.join(sets.select("class", "set"), "class")
    links = linked(bare, "cluster", F.col("size"), BLOCK_SHINGLES, num, den, attach, sets=True, seeds=2)
    return profiles, links


def join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    ``num / den`` is the least Jaccard similarity of a link.
    """
    profiles, links = classes(docs, n, num, den)
    labels = components(links)
    firsts = profiles.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"))
    named = firsts.join(labels.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("label", F.coalesce("label", "class"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = named.join(lowest, "label").select("class", "component_id")
    out = profiles.join(of_class, "class", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _marked(n: int, names: list[str]) -> Callable:
    """Adds ``key``: the class and doc_id of a row; rows with an empty set get keys of their own.

    Of rows with equal keys (repeated rows) the first of a batch goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, data, offsets in bw.slices(b.column("text")):
                sets = Sets(data, offsets, n)
                part = b.slice(first, len(sets.size))
                prints = _bytes16(sets.fingerprints()).to_pylist()
                keys: dict[str, int] = {}
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    number += 1
                    keys.setdefault(f"{prints[i].hex()}:{'' if doc_id is None else doc_id}" if sets.size[i] else f"blank {number}", i)
                rows = part.take(pa.array(list(keys.values()), pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(keys), pa.string())], names=[*names, "_jaccard_key"])

    return run


def representatives(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one row of each component: of its smallest doc_id, and of its repeated rows one.

    Rows with an empty set all stay.
    """
    profiles, links = classes(docs, n, num, den)
    labels = components(links)
    firsts = profiles.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"))
    named = firsts.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    # nulls last, so a component keeps a row with an id if it has one
    best = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "class")).alias("k"))
    key = F.concat(F.lower(F.hex("k.class")), F.lit(":"), F.coalesce(F.col("k.first").cast("string"), F.lit("")))
    chosen = best.select(key.alias("_jaccard_key"), F.lit(True).alias("_jaccard_chosen"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    marked = docs.mapInArrow(_marked(n, docs.columns), ", ".join([*fields, "_jaccard_key string"]))
    kept = marked.join(chosen, "_jaccard_key", "left").where(F.col("_jaccard_chosen") | F.col("_jaccard_key").startswith("blank "))
    return kept.dropDuplicates(["_jaccard_key"]).select(*[f"`{c}`" for c in docs.columns])
