"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Two documents link when the Jaccard similarity of their sets of distinct
word shingles is at least ``NUM / DEN``.  The join finds the exact components of
this relation without listing the pairs inside a group:

1. Every text becomes a sorted set of 64-bit shingle hashes, its size and a digest
   of the set.  Equal sets are one node.  Shingles in many documents are counted on the way.
2. Linked sets of n shingles keep, within the first ``KEPT`` of each in hash order,
   at least ``NUM / DEN - (1 - KEPT)`` of n in common.  These parts are dealt out by hash
   in packed buckets, where a task sees which shingles another set has too; sets
   with fewer of those can link with nothing and are done, which most are.  Only the
   others' arrays are written, once for each set, with a parity bitmap whose width
   follows the size band.
3. Under one global order, rare shingles first, then by hash, linked sets share a
   shingle within their first n - ceil(n * NUM / DEN) + 1.  A tile is a shingle and two
   neighbouring size bands; linked sets are never more than a band apart.
4. Each set of a tile is paired with the tile's leader, the set whose
   prefix is most common around it, like the original among its copies.  Sizes,
   then bitmap bit counts, bound the overlap from above; what is left is decided by
   intersecting the sorted arrays, in cells that hold the leader's array once.  This links
   nearly every group of copies in a number of pairs linear in its size.
5. Tiles whose sets all lie in their leader's component are done.  Sets
   with a common tile share a leader, so what is left lies inside families:
   components of all pairs of step 4, linked or not.  A dense family, whose
   tiles would compare more pairs than it has, is compared as a whole; in a sparse
   one the tiles are, one of each kind with equal members.  Only sets outside the
   largest component are compared with all others, cut into cells of bounded size on
   both sides.  A dense family's cell intersects what the bounds let through and joins
   components as it finds them, so it gives no more links than it has sets; what a
   tile's cell lets through is intersected as in step 4.  So no link between components is lost.

Entries of a very frequent shingle are dealt to several buckets by set; each
has its own leader, and the leaders are paired with one of them.

The order and the counts of step 2 only decide what is cheap, never what is found.
Sets and nodes are told apart by 64-bit hashes of shingles and the first 64 bits of a digest.

Defined cases: a text with fewer words than a shingle is one shingle; one
without words, or null, has an empty set and is linked with nothing; texts may be of any
length, hashed in windows; a row with a null id has a null component and links nothing;
rows with the same id are one document that has the links of all its texts; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import BROADCAST_ROWS, attach, discard, keep, releasing, ship, slices
from assayer.llm.components import components
from assayer.llm.shingles import shingle_sets

WORDS = 5
NUM, DEN = 75, 100
#: The part of each set, as a fraction, that is dealt out to see what others have too.
KEPT_NUM, KEPT_DEN = 2, 5
#: Hashes that a task holds while it counts or packs them.
BLOCK = 1_000_000
#: Dealt shingles meant for one bucket, and sets and buckets meant for one sum over buckets.
DEALT, SUMMED = 2_000_000, 100_000
#: A shingle in at least this share of the documents comes last in the order; at most 1/HOT_SHARE times the mean set size can be.
HOT_SHARE = 1 / 2000
HOT_LEAST = 24
#: Prefix entries meant for one bucket.
BUCKET = 400_000
#: Documents of one shingle above which its entries go to several buckets.
SPLIT = 1_000_000
#: Pairs that a task remembers having told already.
REMEMBERED = 100_000
#: Sets meant for either side of a cell, and partners that share one copy of a set's array.
CELL, PARTNERS = 256, 64
SETS = "kind int, doc_id long, n long, digest binary, node long, shingle long, docs long"
BIG, SMALL = 1 << 16, 64


def bitmap_width(n: int) -> int:
    """The size band's width in bits."""
    return min(BIG, max(SMALL, 1 << max(0, n - 1).bit_length()))


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity of the number of hashes at each bit."""
    width = bitmap_width(len(hashes))
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact: intersects two sorted arrays."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
    for batch in slices(batches):
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        hashes, bounds = shingle_sets(texts, WORDS)
        for i, doc in enumerate(batch.column(0).to_pylist()):
            yield doc, hashes[bounds[i] : bounds[i + 1]]


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digest and node of each document (kind 0); shingles that are frequent in a block of documents (kind 1)."""
    names = [x.split()[0] for x in SETS.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    rows: list[tuple] = []
    block: list[np.ndarray] = []
    seen: set[bytes] = set()
    held = 0

    def frequent() -> Iterator[pa.RecordBatch]:
        if not block:
            return
        keys, counts = np.unique(np.concatenate(block), return_counts=True)
        often = counts >= max(3, HOT_SHARE * len(block))
        n = int(often.sum())
        if n:
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), none, none, pa.nulls(n, pa.binary()), none, pa.array(keys[often].view(np.int64)), pa.array(counts[often])], names)

    for doc, hashes in _documents(batches):
        digest = _digest(hashes) if len(hashes) else None
        rows.append((0, doc, len(hashes), digest, _node(digest) if digest else None, None, None))
        if digest and digest not in seen:
            seen.add(digest)
            block.append(hashes.copy())
            held += len(hashes)
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
        if held >= BLOCK:
            yield from frequent()
            block, seen, held = [], set(), 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    yield from frequent()


def dealt(n: int) -> int:
    """How many of n shingles, in hash order, are dealt out."""
    return n - n * (KEPT_DEN - KEPT_NUM) // KEPT_DEN


def needed(n: int) -> int:
    """How many of the dealt shingles a linked set has in common at least: each leaves out at most its last ones."""
    return -(-n * (NUM * KEPT_DEN - DEN * (KEPT_DEN - KEPT_NUM)) // (DEN * KEPT_DEN))


SPREAD = "bucket int, nodes binary, needs binary, counts binary, keys binary"


def _binary(row_lists: list[list], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row_lists[0], pa.int32()), *(pa.array(c, pa.binary()) for c in row_lists[1:])], [x.split()[0] for x in names.split(", ")])


def _spread(hot: np.ndarray, buckets: int):
    """Dealt shingles packed into a row for each bucket and block of sets; equal sets of a block only once.

    A hot shingle is not dealt but known to be another's too, so the set needs one fewer;
    a set of hot shingles alone goes to a bucket without any.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        needs: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, node, need = np.concatenate(parts), np.array(nodes, np.int64), np.array(needs, np.int32)
            owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
            alone = np.flatnonzero([not len(p) for p in parts]).astype(np.int32)
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, owner, bucket = (keys[order] >> np.uint64(32)).astype(np.uint32), owner[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            columns: list[list] = [[], [], [], [], []]
            for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
                who, counts = np.unique(owner[a:b], return_counts=True)
                for column, x in zip(columns, (int(bucket[a]), node[who].tobytes(), need[who].tobytes(), counts.astype(np.uint32).tobytes(), keys[a:b].tobytes()), strict=True):
                    column.append(x)
            if len(alone):
                for column, x in zip(columns, (int(node[alone[0]] % buckets), node[alone].tobytes(), need[alone].tobytes(), np.zeros(len(alone), np.uint32).tobytes(), b""), strict=True):
                    column.append(x)
            yield _binary(columns, SPREAD)

        seen: set[int] = set()
        for doc, hashes in _documents(batches):
            if doc is None or not len(hashes) or (node := _node(_digest(hashes))) in seen:
                continue
            first = hashes[: dealt(len(hashes))]
            if len(hot):
                first = first[hot[np.minimum(np.searchsorted(hot, first), len(hot) - 1)] != first]
            seen.add(node)
            nodes.append(node)
            needs.append(needed(len(hashes)) - (dealt(len(hashes)) - len(first)))
            parts.append(first.copy())
            held += len(first) + 1
            if held >= BLOCK:
                yield from out()
                nodes, needs, parts, seen, held = [], [], [], set(), 0
        if parts:
            yield from out()

    return run


SEEN = "part int, nodes binary, needs binary, counts binary"


def _seen(parts: int):
    """Of a bucket's sets: how many of their shingles another set has, packed by part; those with none only where none is needed."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes, needs, counts, keys = (np.concatenate([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]) for name, kind in (("nodes", np.int64), ("needs", np.int32), ("counts", np.uint32), ("keys", np.uint32)))
        names, first, place = np.unique(nodes, return_index=True, return_inverse=True)
        owner = np.repeat(place, counts)
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])  # a set that several blocks have counts once
        keys, owner = keys[new], owner[new]
        _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
        shared = np.bincount(owner[times[at] > 1], minlength=len(names)).astype(np.uint32)
        needs = needs[first]
        told = (shared > 0) | (needs <= 0)
        names, needs, shared = names[told], needs[told], shared[told]
        part = (names % parts).astype(np.int64)
        out = [[], [], [], []]
        for p in np.unique(part).tolist():
            own = part == p
            for column, x in zip(out, (p, names[own].tobytes(), needs[own].tobytes(), shared[own].tobytes()), strict=True):
                column.append(x)
        return pa.Table.from_batches([_binary(out, SEEN)])

    return run


def _alive(key: tuple, rows: pa.Table) -> pa.Table:
    """Sets that have as many shingles in common with others as a link needs."""
    nodes, needs, counts = (np.concatenate([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]) for name, kind in (("nodes", np.int64), ("needs", np.int32), ("counts", np.uint32)))
    names, first, place = np.unique(nodes, return_index=True, return_inverse=True)
    return pa.table({"node": names[np.bincount(place, counts) >= needs[first]]})


ARRAYS = "node long, n long, bitmap binary, hashes binary"


def _arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, bounds = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], WORDS)
        sets = [x for x in (hashes[bounds[i] : bounds[i + 1]] for i in range(batch.num_rows)) if len(x)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_node(_digest(x)) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
            [x.split()[0] for x in ARRAYS.split(", ")],
        )


def prefix(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The set's first shingles in the global order, of which linked sets share one."""
    n = len(hashes)
    size = n - -(-NUM * n // DEN) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        often = hot[at] == hashes
        if often[:size].any():
            return np.concatenate((hashes[~often][:size], hashes[often]))[:size]
    return hashes[:size]


def _band_edges() -> np.ndarray:
    """The least size of each band: one that is DEN / NUM times as large is at most one band up."""
    edges = [1]
    while len(edges) < BANDS:
        edges.append(edges[-1] * DEN // NUM + 1)
    return np.array(edges, np.int64)


#: Bands of a tile; the last has all larger sets.
BANDS = 64
EDGES = _band_edges()


PACKED = "bucket int, nodes binary, bands binary, ranks binary, counts binary, keys binary"


def _deal(hot: np.ndarray, splits: np.ndarray, buckets: int):
    """Prefixes packed into a row for each bucket and block of sets.

    ``splits``: by hot shingle, into how many buckets its entries go.
    """
    extra = np.concatenate(([0], np.cumsum(np.where(splits > 1, splits, 0)))) if len(splits) else np.zeros(1, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        ns: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts])
            owner = np.repeat(np.arange(len(parts)), sizes)
            nodes = np.array(ids, np.int64)
            bands = (np.searchsorted(EDGES, np.array(ns, np.int64), side="right") - 1).astype(np.uint8)
            # How common a set's prefix is in this block: the mean logarithm of its shingles' counts.
            _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
            ranks = (np.bincount(owner, np.log2(times)[at]) / sizes * 2000).clip(0, 65535).astype(np.uint16)
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            if extra[-1]:
                place = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                wide = (hot[place] == keys) & (splits[place] > 1)
                bucket[wide] = buckets + extra[place[wide]] + nodes[owner[wide]] % splits[place[wide]]
            order = np.argsort(bucket, kind="stable")
            keys, owner, bucket = keys[order], owner[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            columns: list[list] = [[], [], [], [], [], []]
            for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
                who, counts = np.unique(owner[a:b], return_counts=True)
                row = (int(bucket[a]), nodes[who].tobytes(), bands[who].tobytes(), ranks[who].tobytes(), counts.astype(np.uint32).tobytes(), (keys[a:b] >> np.uint64(32)).astype(np.uint32).tobytes())
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            yield _binary(columns, PACKED)

        for batch in slices(batches):
            for node, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(node)
                ns.append(n)
                parts.append(prefix(np.frombuffer(body, np.uint64), hot).copy())
                held += len(parts[-1])
                if held >= BLOCK:
                    yield from out()
                    ids, ns, parts, held = [], [], [], 0
        if parts:
            yield from out()

    return run


TILES = "tile long, node long, leader long"
#: Where a tile's number holds the bucket, above the band and below the shingle.
PLACE, BUCKET_BITS = 64, 25


def _tiles(buckets: int):
    """Sets of each tile that has more than one, with the tile's leader.

    A bucket that holds a part of one shingle's entries keeps even a single one.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        packed = [[np.frombuffer(x, kind) for x in rows.column(name).to_pylist()] for name, kind in (("nodes", np.int64), ("bands", np.uint8), ("ranks", np.uint16), ("counts", np.uint32), ("keys", np.uint32))]
        nodes, bands, ranks = (np.concatenate([np.repeat(x, c) for x, c in zip(values, packed[3], strict=True)]) for values in packed[:3])
        keys = np.concatenate(packed[4]).astype(np.int64)
        # Each set is in the tile of its band and the next, and in that of the band before and its own.
        low = bands > 0
        group = np.concatenate((keys * BANDS + bands, keys[low] * BANDS + bands[low] - 1))
        home = np.concatenate((np.ones(len(keys), bool), np.zeros(int(low.sum()), bool)))
        nodes, ranks = np.concatenate((nodes, nodes[low])), np.concatenate((ranks, ranks[low]))
        order = np.lexsort((nodes, np.iinfo(np.uint16).max - ranks, group))
        group, nodes, home = group[order], nodes[order], home[order]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        at = np.cumsum(first) - 1
        leader = nodes[first][at]
        whole = bucket < buckets
        # A tile without sets of its first band is part of the next one.
        kept = (np.bincount(at)[at] > 1) & (np.bincount(at, home)[at] > 0) if whole else np.ones(len(group), bool)
        # Parts of one shingle lie in neighbouring buckets, but their tile is the same.
        tile = ((group // BANDS) << (BUCKET_BITS + 6)) | ((bucket if whole else buckets) * PLACE) | (group % BANDS)
        return pa.table({"tile": tile[kept], "node": nodes[kept], "leader": leader[kept]})

    return run


def folded(maps: np.ndarray) -> np.ndarray:
    """Bitmaps, one a row, at half their width: parities of halves add."""
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def within_bounds(n: np.ndarray, maps: list[bytes], m: np.ndarray, others: list[bytes]) -> np.ndarray:
    """For each pair of sets, False only if sizes or bitmaps prove that it is less similar than the threshold."""
    total = n + m
    good = DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)
    widths = np.array([[len(x), len(y)] for x, y in zip(maps, others, strict=True)]).reshape(-1, 2)
    for w, v in np.unique(widths[good], axis=0).tolist():
        own = np.flatnonzero(good & (widths[:, 0] == w) & (widths[:, 1] == v))
        x, y = (np.frombuffer(b"".join(side[i] for i in own), np.uint64).reshape(len(own), -1) for side in (maps, others))
        while x.shape[1] > y.shape[1]:
            x = folded(x)
        while y.shape[1] > x.shape[1]:
            y = folded(y)
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        # overlap <= (n + m - apart) / 2 must reach NUM * (n + m) / (NUM + DEN)
        good[own] = (NUM + DEN) * (total[own] - apart) >= 2 * NUM * total[own]
    return good


def _checked(small: DataFrame) -> DataFrame:
    """Broadcast if it is small enough; else joined by a shuffle."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def renamed(kept: DataFrame, *names: str) -> DataFrame:
    """A kept table with other column names, which is still one."""
    out = kept.toDF(*names)
    out._kept_at = kept._kept_at
    return out


def _intersect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, part, role, node, n, bitmap, hashes come sorted; the first of a cell has the set a.

    Bounds come first; only what they let through is intersected.
    """
    cell, mine = None, None
    for batch in slices(batches):
        links: list[tuple[int, int]] = []
        for a, part, role, node, n, bits, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not role:
                cell, mine = (a, part), (np.array([n]), [bits], np.frombuffer(body, np.uint64).copy())
            elif cell == (a, part) and within_bounds(mine[0], mine[1], np.array([n]), [bits])[0] and linked(mine[2], np.frombuffer(body, np.uint64)):
                links.append((a, node))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def _verify(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Links among distinct kept pairs a, b, by bounds and exact intersection.

    A cell is a set with at most about PARTNERS partners; it gets each array once.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts")).where("parts > 1")
    cells = attach(pairs, many, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"), F.col("b").alias("node"), F.lit(1).alias("role"))
    cells = cells.union(cells.select("a", "part", F.col("a").alias("node"), F.lit(0).alias("role")).distinct())
    cells = F.broadcast(cells) if pairs.count() <= BROADCAST_ROWS // 2 else cells
    rows = cells.join(arrays, "node").select("a", "part", "role", "node", "n", "bitmap", "hashes")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(releasing(_intersect), "a long, b long")


def cell_pairs(docs: np.ndarray, comps: np.ndarray, sizes: np.ndarray, maps: list[bytes], side: np.ndarray, crossing: bool) -> list[tuple[int, int]]:
    """Pairs of a cell, across components, that the bounds don't exclude.

    ``crossing``: only between the two sides, which are different parts of one tile.
    """
    order = np.argsort(sizes, kind="stable")
    docs, comps, sizes, side, maps = docs[order], comps[order], sizes[order], side[order], [maps[i] for i in order]
    widths = np.array([8 * len(m) for m in maps])
    out: list[tuple[int, int]] = []
    # A row for each document at its band's width, and folded to half of it, for the band below.
    own = {w: np.frombuffer(b"".join(maps[i] for i in np.flatnonzero(widths == w)), np.uint64).reshape(-1, w // 64) for w in np.unique(widths)}
    half = {w: m[:, : w // 128] ^ m[:, w // 128 :] for w, m in own.items() if w > SMALL}
    first = {w: int(np.searchsorted(widths, w)) for w in own}
    top = np.searchsorted(sizes * NUM, sizes * DEN, side="right")
    for i in range(len(docs) - 1):
        if top[i] <= i + 1:
            continue
        w = int(widths[i])
        mine = own[w][i - first[w]]
        for v, rows in ((w, own[w]), (2 * w, half.get(2 * w))):
            if rows is None:
                continue
            a, b = max(i + 1, first[v]), min(int(top[i]), first[v] + len(rows))
            if a >= b:
                continue
            apart = np.bitwise_count(rows[a - first[v] : b - first[v]] ^ mine).sum(axis=1, dtype=np.int64)
            total = sizes[a:b] + sizes[i]
            good = ((NUM + DEN) * (total - apart) >= 2 * NUM * total) & (comps[a:b] != comps[i])
            if crossing:
                good &= side[a:b] != side[i]
            out += [(int(docs[i]), int(docs[j])) for j in np.flatnonzero(good) + a]
    return out


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a cell is of bounded size."""
    cell, rows, told = None, [], set()

    def found() -> list[tuple[int, int]]:
        docs, comps, sizes, side = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 4))
        got = [tuple(sorted(p)) for p in cell_pairs(docs, comps, sizes, [r[3] for r in rows], side, True)]
        if len(told) > REMEMBERED:
            told.clear()
        got = [p for p in dict.fromkeys(got) if p not in told]
        told.update(got)
        return got

    pairs: list[tuple[int, int]] = []
    for batch in slices(batches):
        for *key, doc, comp, n, bits, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tuple(key) != cell:
                if len(rows) > 1:
                    pairs += found()
                cell, rows = tuple(key), []
            rows.append((doc, comp, n, bits, side))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])
            pairs = []
    if len(rows) > 1 and (pairs := found()):
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def solve(docs: list[int], comps: list[int], side: list[int], sets: list[np.ndarray], crossing: bool) -> list[tuple[int, int]]:
    """Links of a cell that join its components; at most one fewer than there are components.

    ``crossing``: only between the two sides, which are different parts of one family.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    root = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    width = min(BIG, 8 * bitmap_width(int(sizes[-1])))
    odd = np.empty((len(docs), width // 64), np.uint64)
    for row, i in enumerate(order):
        bits = np.bincount((sets[i] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        odd[row] = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)
    top = np.searchsorted(sizes * NUM, sizes * DEN, side="right")
    sides = np.array(side)[order]
    out = []
    for i in range(len(docs)):
        a, b = i + 1, int(top[i])
        if a >= b:
            continue
        apart = np.bitwise_count(odd[a:b] ^ odd[i]).sum(axis=1, dtype=np.int64)
        total = sizes[a:b] + sizes[i]
        good = (NUM + DEN) * (total - apart) >= 2 * NUM * total
        if crossing:
            good &= sides[a:b] != sides[i]
        for j in np.flatnonzero(good) + a:
            x, y = int(order[i]), int(order[j])
            c, d = find(comps[x]), find(comps[y])
            if c != d and linked(sets[x], sets[y]):
                root[c] = d
                out.append((docs[x], docs[y]))
    return out


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a cell is of bounded size."""
    cell, rows = None, []

    def found() -> list[tuple[int, int]]:
        return solve([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], True)

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    for batch in slices(batches):
        for *key, node, comp, role, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tuple(key) != cell:
                if len({r[1] for r in rows}) > 1 and (links := found()):
                    yield batch_of(links)
                cell, rows = tuple(key), []
            rows.append((node, comp, role, np.frombuffer(body, np.uint64)))
    if len({r[1] for r in rows}) > 1 and (links := found()):
        yield batch_of(links)


def _cut(rows: DataFrame, comps: DataFrame, group: str) -> DataFrame:
    """Rows (group, i, j, node, component, role) of the cells that compare the sets of each group.

    Sets outside the group's largest component (role 0) meet all sets (role 1) once; both
    sides are cut into parts of about CELL sets.
    """
    rows = attach(rows, comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = keep(rows.select(group, "node", "component"), "grouped")
    parts = rows.groupBy(group, "component").agg(F.count(F.lit(1)).alias("sets"))
    parts = parts.groupBy(group).agg(F.max_by("component", F.struct("sets", "component")).alias("main"), F.sum("sets").alias("all"), F.max("sets").alias("most"))
    parts = parts.where("most < all").select(group, "main", F.ceil((F.col("all") - F.col("most")) / CELL).alias("minor"), F.ceil(F.col("all") / CELL).alias("major"))
    rows = attach(rows, keep(parts, "parts"), group)

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    few = rows.where("component <> main").withColumn("i", F.pmod(F.xxhash64("node"), F.col("minor"))).withColumn("j", every("major")).withColumn("role", F.lit(0))
    many = rows.withColumn("j", F.pmod(F.xxhash64("node"), F.col("major"))).withColumn("i", every("minor")).withColumn("role", F.lit(1))
    columns = (group, "i", "j", "node", "component", "role")
    return few.select(*columns).union(many.select(*columns))


def _in_cells(cells: DataFrame, arrays: DataFrame, group: str, *columns: str) -> DataFrame:
    """Cells with the named columns of ``arrays``, each cell's rows next to each other."""
    rows = cells.join(arrays.select("node", *columns), "node")
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = keep(docs.mapInArrow(releasing(_describe), SETS), "sets")
    sets = described.where("kind = 0").select("doc_id", "n", "digest", "node")
    plain = sets.select("doc_id", F.col("n").alias("n_shingles"))
    solid = sets.where("doc_id is not null and n > 0").select("doc_id", "node", "digest", "n")
    total, entries = solid.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return plain.withColumn("component_id", F.col("doc_id"))

    bound = max(HOT_LEAST, HOT_SHARE * total)
    frequent = described.where("kind = 1").groupBy("shingle").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= bound).toArrow()
    hot = np.asarray(frequent.column("shingle"), np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, splits = hot[order], -(-np.asarray(frequent.column("docs"), np.int64)[order] // SPLIT)
    share = spark.sparkContext.broadcast((hot, splits))

    # Sets that have enough in common with others.
    buckets = max(4, math.ceil(entries * KEPT_NUM / KEPT_DEN / DEALT))
    parts = max(4, math.ceil(total * min(buckets, entries / total) / SUMMED))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _spread(share.value[0], buckets)(batches)

    seen = docs.mapInArrow(releasing(spread), SPREAD).groupBy("bucket").applyInArrow(_seen(parts), SEEN)
    alive = seen.groupBy("part").applyInArrow(_alive, "node long")
    classes = keep(solid.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("node").alias("node"), F.count(F.lit(1)).alias("docs")), "classes")
    chosen = keep(classes.join(alive, "node", "left_semi").select("doc_id").distinct(), "chosen")
    arrays = keep(docs.join(_checked(chosen), "doc_id", "left_semi").mapInArrow(releasing(_arrays), ARRAYS), "arrays")
    count, different, entries = arrays.agg(F.count(F.lit(1)), F.countDistinct("node"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count > different:  # rows were given several times
        arrays = keep(arrays.dropDuplicates(["node"]), "arrays")

    links = _links(arrays, share, splits, int(entries))
    share.destroy()

    # Documents with equal sets, and of linked sets, are linked with the first of each.
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    node = keep(classes.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(ends, "node", "left_semi"), "ends")
    for side in "ab":
        links = attach(links, renamed(node, side, f"{side}_doc"), side)
    links = keep(links, "links")
    for table in (arrays, chosen):
        discard(table)
    several = keep(classes.where("docs > 1").select("digest", F.col("doc_id").alias("a")), "several")
    equal = attach(solid, several, "digest").select("a", F.col("doc_id").alias("b"))
    found = components(equal.where("a <> b").union(links.select("a_doc", "b_doc")))
    return plain.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _links(arrays: DataFrame, share: Broadcast, splits: np.ndarray, entries: int) -> DataFrame:
    """Links (a, b) between the sets that give the components of all links; a kept table."""
    buckets = max(4, math.ceil(entries * (DEN - NUM) / DEN / BUCKET))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _deal(*share.value, buckets)(batches)

    tiles = keep(arrays.select("node", "n", "hashes").mapInArrow(releasing(deal), PACKED).groupBy("bucket").applyInArrow(_tiles(buckets), TILES), "tiles")
    stars = tiles.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    if split := bool((splits > 1).any()):
        heads = tiles.where(F.shiftright("tile", 6).bitwiseAND((1 << BUCKET_BITS) - 1) == buckets).select("tile", "leader").distinct()
        tops = heads.groupBy("tile").agg(F.min("leader").alias("top"))
        heads = keep(heads.join(tops, "tile"), "heads")
        stars = stars.union(heads.where("leader <> top").select("top", "leader"))
        tiles = tiles.join(heads, ["tile", "leader"], "left").select("tile", "node", F.coalesce("top", "leader").alias("leader"))
    stars = keep(stars.distinct(), "stars")
    links = keep(_verify(stars, arrays), "verified")
    first = keep(components(links), "first")

    # What still joins different components.
    pairs = tiles.where("leader <> node").select("leader", "node").distinct() if split else stars.toDF("leader", "node")
    apart = attach(pairs, renamed(first, "node", "node_in"), "node", "left")
    apart = attach(apart, renamed(first, "leader", "leader_in"), "leader", "left")
    apart = keep(apart.where(F.coalesce("node_in", "node") != F.coalesce("leader_in", "leader")).select("node", "leader"), "apart")
    if not apart.limit(1).count():
        return links
    families = keep(components(stars).withColumnRenamed("component", "family"), "families")
    mixed = keep(tiles.join(_checked(apart), ["node", "leader"], "left_semi").select("tile").distinct(), "mixed")
    members = keep(tiles.join(_checked(mixed), "tile", "left_semi"), "members")
    # By tile its family, and a fingerprint of its members.
    sizes = members.groupBy("tile").agg(
        F.count(F.lit(1)).alias("sets"), F.min("leader").alias("node"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node")).alias("xor")
    )
    sizes = keep(attach(sizes, families, "node"), "sizes")
    cost = sizes.groupBy("family").agg(F.sum(F.col("sets").cast("double") * F.col("sets")).alias("in_tiles"))
    whole = attach(cost, families.groupBy("family").agg(F.count(F.lit(1)).alias("members")), "family")
    whole = keep(whole.select("family", (F.col("members").cast("double") * F.col("members") <= F.col("in_tiles")).alias("dense")), "whole")

    found = links
    done = [tiles, stars, first, apart, families, mixed, members, sizes, whole]
    if whole.where("dense").limit(1).count():
        dense = attach(families, whole.where("dense").select("family"), "family")
        dense = _in_cells(_cut(dense, first, "family"), arrays, "family", "hashes").select("family", "i", "j", "node", "component", "role", "hashes")
        found = keep(links.union(dense.mapInArrow(releasing(_solve), "a long, b long")), "verified")
        done.append(links)
    if whole.where("not dense").limit(1).count():
        # Sparse families: their tiles, those with equal members once.
        kinds = attach(sizes, whole.where("not dense").select("family"), "family").groupBy("sets", "sum", "xor").agg(F.min("tile").alias("tile"))
        kinds = keep(kinds.select("tile"), "kinds")
        sparse = members.join(_checked(kinds), "tile", "left_semi").select("tile", "node")
        cells = _in_cells(_cut(sparse, first, "tile"), arrays, "tile", "n", "bitmap").select("tile", "i", "j", "node", "component", "n", "bitmap", "role")
        rest = keep(cells.mapInArrow(releasing(_cells), "a long, b long").distinct(), "rest")
        done += [kinds, rest]
        if rest.limit(1).count():
            done.append(found)
            found = keep(found.union(_verify(rest, arrays)), "verified")
    for table in done:
        if table is not found and hasattr(table, "_kept_at"):
            discard(table)
    return found
