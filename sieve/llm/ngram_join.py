"""N-gram Jaccard join: texts whose sets of word n-grams overlap enough, by count vectors in R-trees.

A document's set holds the hashes of its distinct ``size``-word shingles.  The hashes fall into groups; the
numbers of shingles in each group are a point.  The overlap of two sets is at most the sum of the
coordinates' minima, and for a box of points at most that with the box's upper corner: an R-tree over the
points skips boxes that can't reach the overlap needed, and pairs that survive are verified on the sets.

Points of unrelated texts of one length all lie close together, so one tree over a corpus would have to be read
nearly whole for each query.  The trees are therefore built inside partitions that lose no pair: two sets of
similarity t share one of the first n - ceil(t n) + 1 shingles in any common order (the order puts hashes of frequent
groups of a bounded sketch last, so that passages many documents share hardly meet).

1. One scan gives each document's set size and digest, and the sketch.  Equal sets form a class; the least key stands for it.
2. A second scan gives the prefixes of the classes.  Dealt by shingle, those drop out that no other class shares whose
   size and whose place of the shingle allow a link.
   Shingles with the same classes (long copies share hundreds) count as one group from here on.
3. The classes of each group meet as points, in a tree (a single leaf if they are few); those without any partner that
   the bound allows drop out.  Groups over ``PART`` are split into pairs of parts, so no task holds an unbounded group.
4. Every class left joins the partition of its least shared shingle, now with its set.  A tree in each partition finds the
   components there: a search from text to text over those not yet reached.  Partitions over ``PART`` are split.
5. Where classes of several components still share a group, each component sends its pair of the best bound: no more rows than
   came in.  Points of 1,024 coordinates bound these pairs again, the rest is verified on the sets, and linked components merge.
6. What is left apart is settled without further rounds.  The wide points bound the pairs between components inside each group;
   a group with few pairs for its rows sends them for verification, in a denser one the rows in pairs bring their
   sets, and a search over the group gives links that span it, never all its pairs.
7. Links between components are joined by label propagation over written tables.

Two texts link when 100 * |A & B| >= percent * |A | B|.  Copies are never expanded into pairs, and pairs inside a
component found already aren't either, as they change no component.

Defined cases: words are runs of characters other than ASCII white space, lower-cased in A-Z; a text of fewer words
than ``size`` but not none has one shingle, the whole sequence; null, empty or blank texts have none, link with
nothing and are their own component; null ids form components like others, whose id is the least that isn't null; repeated
ids count as rows of their own; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash

from ._jobs import materialise, small_batches, unique_keys
from ._text import LOWER, SPACE_WORD, Loads, blocks, column_bytes, ragged, window_hash, words

SIZE = 5
PERCENT = 80
SKETCH_BITS = 20
PART = 4096
PART_SHINGLES = 1 << 22
GROUPS = 64
WIDE_BITS = 10
FANOUT = 32
BROADCAST_ROWS = 500_000
NEAR = 64
FEW = 16
HELD = 200_000
U64 = np.uint64


# ---- sets ------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each document of a block."""
    low = LOWER[data]
    start, end, first = words(low, offsets, SPACE_WORD)
    h = Loads(low).hash(start, end)
    grams = window_hash(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= size:
            s = np.sort(grams[a : b - size + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(window_hash(h[a:b], n))
        else:
            out.append(np.zeros(0, U64))
    return out


def needed(n, m, percent: int):
    """Least overlap of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def count_vectors(flat: np.ndarray, sizes: np.ndarray, groups: int) -> np.ndarray:
    """Points: how many hashes of each set fall into each group."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    group = (flat >> U64(64 - int(groups).bit_length() + 1)).astype(np.int64)
    return np.bincount(row * groups + group, minlength=len(sizes) * groups).reshape(-1, groups).astype(np.int32)


class CountTree:
    """R-tree over count vectors, packed bottom-up in the order of size and then of the first coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.points, self.sizes, self.percent = points, sizes, percent
        self.order = np.lexsort((points[:, 0], sizes)) if len(sizes) else np.zeros(0, np.int64)
        self.levels = []  # from the leaves up: (upper corners, least sizes, most sizes)
        upper, least, most = points[self.order], sizes[self.order], sizes[self.order]
        while len(upper) > FANOUT:
            cut = np.arange(0, len(upper), FANOUT)
            upper, least, most = np.maximum.reduceat(upper, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((upper, least, most))

    def query(self, point: np.ndarray, size: int) -> np.ndarray:
        """Indices of points whose bound reaches the needed overlap with this one."""
        alive = None
        for upper, least, most in reversed(self.levels):
            box = np.arange(len(upper)) if alive is None else self._children(alive, len(upper))
            fits = (100 * most[box] >= self.percent * size) & (self.percent * least[box] <= 100 * size)
            box = box[fits]
            bound = np.minimum(upper[box], point).sum(1)
            alive = box[bound >= needed(np.maximum(least[box], self.percent * size // 100), size, self.percent)]
        at = self.order if alive is None else self.order[self._children(alive, len(self.order))]
        if not len(at):
            return at
        m = self.sizes[at]
        at = at[(100 * m >= self.percent * size) & (self.percent * m <= 100 * size)]
        bound = np.minimum(self.points[at], point).sum(1)
        return at[bound >= needed(self.sizes[at], size, self.percent)]

    @staticmethod
    def _children(nodes: np.ndarray, n: int) -> np.ndarray:
        child = (nodes[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
        return child[child < n]


def overlaps(one: np.ndarray, flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one ascending set with others."""
    if not len(start):
        return np.zeros(0, np.int64)
    values = flat[ragged(start, sizes)]
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    hit = np.concatenate([[0], np.cumsum(one[at] == values)])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return hit[edge[1:]] - hit[edge[:-1]]


def components(flat: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each set the least index in its component under links among these sets."""
    n = len(sizes)
    start = np.cumsum(sizes) - sizes
    root = np.full(n, -1, np.int64)
    if n == 2:
        common = overlaps(flat[: sizes[0]], flat, start[1:], sizes[1:])[0]
        return np.array([0, 0 if 100 * common >= percent * (sizes.sum() - common) else 1])
    groups = 1 << int(np.clip(int(sizes.mean()) // 8, 16, 512)).bit_length()
    points = count_vectors(flat, sizes, groups)
    tree = CountTree(points, sizes, percent)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        queue = [seed]
        while queue:
            x = queue.pop()
            near = tree.query(points[x], int(sizes[x]))
            near = near[root[near] < 0]
            if len(near):
                common = overlaps(flat[start[x] : start[x] + sizes[x]], flat, start[near], sizes[near])
                linked = near[100 * common >= percent * (sizes[near] + sizes[x] - common)]
                root[linked] = seed
                queue += linked.tolist()
        if (root >= 0).all():
            break
    return root


# ---- kernels ---------------------------------------------------------------------------------


def _scan_sets(size: int):
    """Rows (key, n, digest, digest2, points), and at the task's end the chunks of its sketch with key = null."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["key", "n", "d1", "d2", "points", "chunk"]
        for batch in batches:
            for block, data, offsets in blocks(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                flat = np.concatenate(sets) if sets else np.zeros(0, U64)
                sketch += np.bincount((flat >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                digest = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], U64).reshape(-1, 2).view(np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                points = np.minimum(count_vectors(flat, sizes, GROUPS), 255).astype(np.uint8)
                points = pa.array([p.tobytes() for p in points], pa.binary())
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1]), points, pa.nulls(len(sets), pa.binary())], names=names)
        cuts = np.split(np.minimum(sketch, (1 << 32) - 1).astype("<u4"), 16)
        if sketch.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(16, pa.int64()), pa.array(np.arange(16)), pa.nulls(16, pa.int64()), pa.nulls(16, pa.int64()), pa.nulls(16, pa.binary()), pa.array([c.tobytes() for c in cuts], pa.binary())], names=names)

    return run


def frequent_groups(sums: np.ndarray) -> np.ndarray:
    """Groups of the sketch well above the mean: they hold a shingle of many documents."""
    mean = sums.mean()
    return sums > mean + 8 * np.sqrt(mean) + 32


def _prefixes(size: int, percent: int, frequent):
    """Rows (key, n, prefix): the first shingles in the order (frequent group, hash), for the document of the least key of each set in a batch.

    The least key of all copies of a set is the least in its batch as well, so the document that stands for the set is never left out.
    """

    def run(batches):
        often = frequent.value
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
            if (np.diff(order) < 0).any():
                batch = batch.take(pa.array(order))
            seen = set()
            for block, data, offsets in blocks(batch, "text"):
                keys, n, blobs = [], [], []
                for key, s in zip(block.column(0).to_pylist(), shingle_sets(data, offsets, size)):
                    if not len(s):
                        continue
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    if digest in seen:
                        continue
                    seen.add(digest)
                    late = often[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                    keys.append(key)
                    n.append(len(s))
                    blobs.append(np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "n", "prefix"])

    return run


def _explode(batches):
    """Rows (shingle, key, spot): spot is n << 32 | place in the prefix."""
    for batch in batches:
        _, offsets = column_bytes(batch.column(2))
        raw, _ = column_bytes(batch.column(2))
        count = np.diff(offsets) // 8
        place = ragged(np.zeros(len(count), np.int64), count)
        keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.tobytes(), np.int64)), pa.array(np.repeat(keys, count)), pa.array(np.repeat(n << 32, count) | place)], names=["shingle", "key", "spot"])


def may_link(shingle: np.ndarray, spot: np.ndarray, percent: int) -> np.ndarray:
    """Which rows, in the order (shingle, spot), have a partner of their shingle that sizes and places allow.

    If the shingle is the first that two prefixes share, the overlap is at most what follows it in either.
    In groups over ``NEAR`` rows all rows count.
    """
    n, place = spot >> 32, spot & 0xFFFFFFFF
    keep = np.zeros(len(spot), bool)
    for step in range(1, NEAR):
        same = np.flatnonzero(shingle[step:] == shingle[:-step])
        if not len(same):
            return keep
        i, j = same, same + step
        need = needed(n[i], n[j], percent)
        ok = (100 * n[i] >= percent * n[j]) & (n[i] - place[i] >= need) & (n[j] - place[j] >= need)
        keep[i[ok]] = True
        keep[j[ok]] = True
    edge = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1], [True]]))
    size = np.diff(edge)
    return keep | np.repeat(size >= NEAR, size)


def _shared_only(percent: int):
    """The rows that may link with another row of their shingle; input in the order (shingle, spot)."""
    names = ["shingle", "key", "spot"]

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3  # the rows of the last shingle so far
        large = None  # a shingle of so many rows that they go on as they come
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # ascending
            keep = may_link(rows[0][:cut], rows[2][:cut], percent)
            if large is not None:
                keep |= rows[0][:cut] == large
            out = [x[:cut][keep] for x in rows]
            held = [x[cut:] for x in rows]
            if len(held[0]) > HELD:
                large = held[0][0]
                out = [np.concatenate([x, h]) for x, h in zip(out, held)]
                held = [h[:0] for h in held]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)
        if len(held[0]):
            keep = may_link(held[0], held[2], percent) | (held[0] == large if large is not None else False)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in held], names=names)

    return run


def _sets_of(size: int):
    """Rows (part, key, n, wide, set) of texts; wide: a point of many more coordinates, for pairs of long texts."""

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, "text"):
                for row, s in enumerate(shingle_sets(data, offsets, size)):
                    wide = np.minimum(np.bincount((s >> U64(64 - WIDE_BITS)).astype(np.int64), minlength=1 << WIDE_BITS), 255).astype(np.uint8)
                    part, key = block.column(2)[row].as_py(), block.column(0)[row].as_py()
                    columns = [pa.array([part], pa.int64()), pa.array([key], pa.int64()), pa.array([len(s)], pa.int64()), pa.array([wide.tobytes()]), pa.array([s.tobytes()])]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "n", "wide", "set"])

    return run


def _grouped(batches, column: int):
    """Runs of rows with the same value in a column, as lists of columns; input in the order of that column."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(column).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(cut, cut[1:]):
            if held and held[0].column(column)[0].as_py() != g[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _part_components(percent: int):
    """Rows (key, component, n, wide, set) from rows (part, key, n, wide, set) in the order of the parts."""

    def run(batches):
        for group in _grouped(batches, 0):
            keys = group.column(1).to_numpy()
            order = np.argsort(keys)
            own = keys
            if len(keys) > 1:
                raw, offsets = column_bytes(group.column(4))
                sizes = (np.diff(offsets) // 8)[order]
                flat = np.frombuffer(raw.tobytes(), U64)[ragged(offsets[:-1][order] // 8, sizes)]
                own = np.empty(len(keys), np.int64)
                own[order] = keys[order][components(flat, sizes, percent)]
            out = pa.table([pa.array(keys), pa.array(own), *(group.column(i) for i in (2, 3, 4))], names=["key", "component", "n", "wide", "set"])
            yield from out.to_batches()

    return run


def _point_bound(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sums of the coordinates' minima of pairs of uint8 points; 255 or more bounds nothing."""
    least = np.minimum(one, two).astype(np.int32)
    return least.sum(1) + (least == 255).any(1) * (1 << 40)


def _near(group, side, spot, points, percent: int, comp=None):
    """Index pairs of rows of a group whose sizes, places and points allow a link (and whose components differ), with their bounds.

    A group of at most ``FANOUT`` rows is one leaf, and the leaves of all such groups are read together; a larger one gets a tree.
    """
    n, place = spot >> 32, spot & 0xFFFFFFFF
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(edge)
    row_size = np.repeat(size, size)
    one_side = np.repeat(np.minimum.reduceat(side, edge[:-1]) == np.maximum.reduceat(side, edge[:-1]), size)
    chunk = max(1, (1 << 23) // points.shape[1])

    def fits(i, j):
        ok = one_side[i] | (side[i] != side[j])
        if comp is not None:
            ok &= comp[i] != comp[j]
        i, j = i[ok], j[ok]
        need = needed(n[i], n[j], percent)
        small, great = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (100 * small >= percent * great) & (n[i] - place[i] >= need) & (n[j] - place[j] >= need)
        i, j, need = i[ok], j[ok], need[ok]
        bound = np.concatenate([np.zeros(0, np.int64), *(_point_bound(points[i[k : k + chunk]], points[j[k : k + chunk]]) for k in range(0, len(i), chunk))])
        ok = bound >= need
        return i[ok], j[ok], bound[ok]

    found = [(np.zeros(0, np.int64),) * 3]
    leaf = row_size <= FANOUT
    for step in range(1, FANOUT):
        i = np.flatnonzero((group[step:] == group[:-step]) & leaf[step:])
        if not len(i):
            break
        found.append(fits(i, i + step))
    for g in np.flatnonzero(size > FANOUT):
        lo, hi = edge[g], edge[g + 1]
        own = points[lo:hi].astype(np.int32)
        own[own == 255] = 1 << 20
        tree = CountTree(own, n[lo:hi], percent)
        for i in range(lo, hi):
            near = lo + tree.query(own[i - lo], int(n[i]))
            near = near[near > i]
            if len(near):
                found.append(fits(np.full(len(near), i), near))
    return tuple(np.concatenate([x[k] for x in found]) for k in range(3))


def _whole_groups(batches, width: int):
    """Batches cut so that no group (the first column, in its order) is divided; as lists of arrays, points as a matrix of ``width`` columns."""

    def arrays(table):
        out = [table.column(i).to_numpy() for i in range(table.num_columns - 1)]
        raw, _ = column_bytes(table.column(table.num_columns - 1))
        return [*out, raw.reshape(len(out[0]), width)]

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        cut = int(np.flatnonzero(g == g[-1])[0])
        if cut:
            held.append(batch.slice(0, cut))
            yield arrays(pa.Table.from_batches(held))
            held = []
        elif held and held[0].column(0)[-1].as_py() != g[0]:
            yield arrays(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield arrays(pa.Table.from_batches(held))


def _survivors(percent: int):
    """The rows (group, key, spot, points) that may link, from rows (group, side, name, key, spot, points) in the order (group, spot)."""

    def run(batches):
        for group, side, name, key, spot, points in _whole_groups(batches, GROUPS):
            rows = np.unique(np.concatenate(_near(group, side, spot, points, percent)[:2]))
            blob = pa.array([p.tobytes() for p in points[rows]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(name[rows]), pa.array(key[rows]), pa.array(spot[rows]), blob], names=["shingle", "key", "spot", "points"])

    return run


def _best_partners(percent: int):
    """For each group and component the pair (a, b, ca, cb, bound) of the best bound with another component.

    Rows (group, side, key, spot, component, points) in the order (group, spot); side: -1 for a whole group, else the part of
    a split one, where only rows of different parts, or of the one part, meet.
    """

    def run(batches):
        for group, side, key, spot, comp, points in _whole_groups(batches, GROUPS):
            i, j, bound = _near(group, side, spot, points, percent, comp)
            if not len(i):
                continue
            score = np.minimum(bound, 1 << 30) * 1000 // ((spot[i] >> 32) + (spot[j] >> 32))
            own = np.concatenate([i, j])
            by = np.lexsort((np.concatenate([key[j], key[i]]), key[own], -np.concatenate([score, score]), comp[own], group[own]))
            own, at = own[by], by % len(i)
            first = np.ones(len(own), bool)
            first[1:] = (group[own[1:]] != group[own[:-1]]) | (comp[own[1:]] != comp[own[:-1]])
            at = np.unique(at[first])
            i, j, score = i[at], j[at], score[at]
            swap = comp[i] > comp[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[i], key[j], comp[i], comp[j], score)], names=["a", "b", "ca", "cb", "bound"])

    return run


def _wide_survivors(percent: int):
    """What the wide points leave of rows (group, side, key, spot, component, wide) in the order (group, spot).

    A group with at most ``FEW`` pairs for each row sends these pairs (a, ca, b, cb), a denser one its rows that are in pairs (group, side, a, ca).
    """
    names = ["group", "side", "a", "ca", "b", "cb"]

    def run(batches):
        for group, side, key, spot, comp, points in _whole_groups(batches, 1 << WIDE_BITS):
            i, j, _ = _near(group, side, spot, points, percent, comp)
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            own = np.searchsorted(edge, i, "right") - 1  # group of each pair
            dense = np.bincount(own, minlength=len(edge) - 1) > FEW * np.diff(edge)
            rows = np.unique(np.concatenate([i[dense[own]], j[dense[own]]]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in (group, side, key, comp)), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names=names)
            i, j = i[~dense[own]], j[~dense[own]]
            i, j = np.where(key[i] < key[j], i, j), np.where(key[i] < key[j], j, i)
            pairs = np.unique(np.stack([key[i], comp[i], key[j], comp[j]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32()), *(pa.array(pairs[:, k]) for k in range(4))], names=names)

    return run


def spanning_links(side: np.ndarray, comp: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (component, component) that join the components of the rows of a group as all links among its rows would.

    Rows whose components have been joined already aren't compared again.
    """
    n = len(sizes)
    start = np.cumsum(sizes) - sizes
    label = np.unique(comp, return_inverse=True)[1]
    one_side = side.min() == side.max()
    groups = 1 << int(np.clip(int(sizes.mean()) // 8, 16, 512)).bit_length()
    points = count_vectors(flat, sizes, groups)
    tree = CountTree(points, sizes, percent)
    out = []
    for x in range(n):
        near = tree.query(points[x], int(sizes[x]))
        near = near[(near > x) & (label[near] != label[x]) & (one_side | (side[near] != side[x]))]
        if not len(near):
            continue
        common = overlaps(flat[start[x] : start[x] + sizes[x]], flat, start[near], sizes[near])
        for y in near[100 * common >= percent * (sizes[near] + sizes[x] - common)].tolist():
            if label[y] != label[x]:
                out.append((int(min(comp[x], comp[y])), int(max(comp[x], comp[y]))))
                label[label == label[y]] = label[x]
        if (label == label[0]).all():
            break
    return out


def _group_links(percent: int):
    """Spanning links (ca, cb) of rows (group, side, key, component, set) in the order (group, key)."""

    def run(batches):
        for group in _grouped(batches, 0):
            raw, offsets = column_bytes(group.column(4))
            sizes = np.diff(offsets) // 8
            links = spanning_links(group.column(1).to_numpy(), group.column(3).to_numpy(), np.frombuffer(raw.tobytes(), U64), sizes, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["ca", "cb"])

    return run


def _bounded(percent: int):
    """Rows (a, b, ca, cb) whose wide points allow a link, from rows (a, b, ca, cb, n_a, wide_a, n_b, wide_b)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                rows = batch.slice(lo, 2000)
                one, two = (column_bytes(rows.column(i))[0].reshape(-1, 1 << WIDE_BITS) for i in (5, 7))
                n, m = rows.column(4).to_numpy(), rows.column(6).to_numpy()
                bound = np.minimum(_point_bound(one, two), np.minimum(n, m))
                yield rows.select([0, 1, 2, 3]).filter(pa.array(bound >= needed(n, m, percent)))

    return run


def _verify(percent: int):
    """Rows (ca, cb) of pairs that link, from rows (a, b, ca, cb, set_a, set_b)."""

    def run(batches):
        for batch in batches:
            ra, oa = column_bytes(batch.column(4))
            rb, ob = column_bytes(batch.column(5))
            linked = []
            for i in range(batch.num_rows):
                a = np.frombuffer(ra[oa[i] : oa[i + 1]].tobytes(), U64)
                b = np.frombuffer(rb[ob[i] : ob[i + 1]].tobytes(), U64)
                common = overlaps(a, b, np.zeros(1, np.int64), np.array([len(b)]))[0]
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3)], names=["ca", "cb"]).filter(pa.array(linked, pa.bool_()))

    return run


# ---- jobs ------------------------------------------------------------------------------------


def connected(edges):
    """(node, root) for all nodes of the edges (ca, cb): the least node reachable.

    Every round gives each node the least label around it and then its label's label, over a written table.
    """
    from pyspark.sql import functions as F

    both = materialise(edges.select(F.col("ca").alias("u"), F.col("cb").alias("v")).unionByName(edges.select(F.col("cb").alias("u"), F.col("ca").alias("v"))).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        new = labels.join(around.withColumnRenamed("u", "node"), "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialise(new.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"), "labels")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def _sketch(scanned):
    """Sums of the tasks' sketches; 16 rows of bounded size come to the driver."""
    from pyspark.sql import functions as F

    def add(batches):
        for group in _grouped(batches, 0):
            total = sum(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in group.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([group.column(0)[0].as_py()]), pa.array([total.astype("<i8").tobytes()])], names=["part", "sums"])

    parts = scanned.where("chunk is not null").select(F.col("n").alias("part"), "chunk")
    rows = parts.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part long, sums binary").collect()
    sums = np.zeros((16, (1 << SKETCH_BITS) // 16), np.int64)
    for r in rows:
        sums[r["part"]] = np.frombuffer(r["sums"], "<i8")
    return sums.reshape(-1)


def _merge(members, roots):
    """members with the components of (node, root) renamed."""
    from pyspark.sql import functions as F

    if roots.count() <= BROADCAST_ROWS:
        roots = F.broadcast(roots)
    joined = members.join(roots.withColumnRenamed("node", "component"), "component", "left")
    return joined.select("key", F.coalesce("root", "component").alias("component"), "n", "wide", "set")


def _dealt(rows, counted, *columns: str):
    """Rows dealt by shingle as (group, side, ...): a shingle of over ``PART`` rows, or ``PART_SHINGLES`` of their sets, meets itself as pairs of parts.

    ``counted``: (shingle, rows, weight).  Each row goes to the pairs that hold its part.
    """
    from pyspark.sql import functions as F

    rows = rows.join(counted, "shingle")
    parts = F.least("rows", F.greatest(F.ceil(F.col("rows") / F.lit(PART)), F.ceil(F.col("weight") / F.lit(PART_SHINGLES)))).cast("int")
    part = F.pmod(F.xxhash64("key"), parts).cast("int")
    rows = rows.select("*", F.when(parts <= 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), parts - 1)).alias("others"), part.alias("own"))
    rows = rows.withColumn("other", F.explode("others"))
    side = F.when(F.col("other") < 0, F.lit(-1)).otherwise(F.col("own")).cast("int")
    group = F.when(F.col("other") < 0, F.col("shingle")).otherwise(F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select(group.alias("group"), side.alias("side"), *columns).repartition("group").sortWithinPartitions("group", "spot")


def _counted():
    from pyspark.sql import functions as F

    return [F.count("*").alias("rows"), F.sum(F.shiftright("spot", 32)).alias("weight")]


def _signed(rows, group: str, *columns: str):
    """(group, name): name is the same for groups of the same rows, told by their number, least key and 128 bits of sums of hashes of ``columns``."""
    from pyspark.sql import functions as F

    sums = []
    for seed in (1, 2):  # halves of 32 bits, whose sums can't overflow
        h = F.xxhash64(*columns, F.lit(seed))
        sums += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"lo{seed}"), F.sum(F.shiftright(h, 32)).alias(f"hi{seed}")]
    signed = rows.groupBy(group).agg(*sums, F.count("*").alias("rows"), F.min("key").alias("least"))
    names = [c for c in signed.columns if c != group]
    return signed.join(signed.groupBy(*names).agg(F.min(group).alias("name")), names).select(group, "name")


def _merged_groups(shared):
    """Rows (shingle, key, spot) of one shingle for all that have the same keys; spot holds the least place.

    Two classes meet in as many shingles as they share, but need to meet only once.
    """
    from pyspark.sql import functions as F

    rows = shared.join(_signed(shared, "shingle", "key"), "shingle")
    return rows.groupBy(F.col("name").alias("shingle"), "key").agg(F.min("spot").alias("spot"))


def _candidates(shared, points, percent: int):
    """The rows of ``shared`` that trees over the points leave, with their points, written."""
    from pyspark.sql import functions as F

    rows = _dealt(shared.join(points, "key"), shared.groupBy("shingle").agg(*_counted()), "shingle", "key", "spot", "points")
    left = rows.mapInArrow(_survivors(percent), "shingle long, key long, spot long, points binary")
    return materialise(left.groupBy("shingle", "key").agg(F.min("spot").alias("spot"), F.first("points").alias("points")), "candidates")


def _apart(candidates, members, *columns: str):
    """Candidates in groups of several components, dealt as (group, side, ...)."""
    from pyspark.sql import functions as F

    rows = candidates.join(members, "key")
    several = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *_counted()).where("lo <> hi")
    return _dealt(rows, several.select("shingle", "rows", "weight"), *columns)


def _best_links(candidates, members, percent: int):
    """Written links (ca, cb) among the best pairs of components that share a group; None without pairs."""
    from pyspark.sql import functions as F

    dealt = _apart(candidates, members.select("key", "component"), "key", "spot", "component", "points")
    pairs = dealt.mapInArrow(_best_partners(percent), "a long, b long, ca long, cb long, bound long")
    pairs = materialise(pairs.groupBy("ca", "cb").agg(F.max(F.struct("bound", "a", "b")).alias("x")).select("x.a", "x.b", "ca", "cb"), "pairs")
    near = _both_sides(pairs, members, ["n", "wide"])
    if near is None:
        return None
    with small_batches(pairs.sparkSession):
        pairs = materialise(near.mapInArrow(_bounded(percent), "a long, b long, ca long, cb long"), "pairs")
        full = _both_sides(pairs, members, ["set"])
        return None if full is None else materialise(full.mapInArrow(_verify(percent), "ca long, cb long").distinct(), "links")


def _last_links(candidates, members, percent: int):
    """Written links (ca, cb) that join all components with linked members; None if none is left to compare."""
    from pyspark.sql import functions as F

    spark = candidates.sparkSession
    dealt = _apart(candidates.drop("points"), members.select("key", "component", "wide"), "key", "spot", "component", "wide")
    with small_batches(spark, 2000):
        apart = materialise(dealt.mapInArrow(_wide_survivors(percent), "group long, side int, a long, ca long, b long, cb long"), "apart")
    out = []
    with small_batches(spark):
        pairs = materialise(apart.where("b is not null").select("a", "b", "ca", "cb").distinct(), "pairs")
        full = _both_sides(pairs, members, ["set"])
        if full is not None:
            out.append(full.mapInArrow(_verify(percent), "ca long, cb long"))
        dense = apart.where("b is null").select("group", "side", F.col("a").alias("key"), F.col("ca").alias("component"))
        own = _signed(dense, "group", "key", "side").where("group = name").select("group")
        dense = materialise(dense.join(own, "group", "left_semi"), "dense")
        if n := dense.count():  # members stay where they are if the rows are few enough to broadcast
            rows = members.select("key", "set").join(F.broadcast(dense) if n <= BROADCAST_ROWS else dense, "key")
            rows = rows.select("group", "side", "key", "component", "set").repartition("group").sortWithinPartitions("group", "key")
            out.append(rows.mapInArrow(_group_links(percent), "ca long, cb long"))
        return materialise(reduce(lambda x, y: x.unionByName(y), out).distinct(), "links") if out else None


def _both_sides(pairs, members, columns: list[str]):
    """Pairs (a, b, ca, cb) with columns of both members; None without pairs.  Members stay where they are if the pairs are few enough to broadcast."""
    from pyspark.sql import functions as F

    n = pairs.count()
    if not n:
        return None
    own = F.broadcast(pairs) if n <= BROADCAST_ROWS else pairs

    def side(x: str):
        return members.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])

    one = side("a").join(own, "a").select("a", "b", "ca", "cb", *[f"{c}_a" for c in columns])
    two = side("b").join(own.select("a", "b"), "b").select("a", "b", *[f"{c}_b" for c in columns])
    return one.join(two, ["a", "b"]).select("a", "b", "ca", "cb", *[f"{c}_a" for c in columns], *[f"{c}_b" for c in columns])


def ngram_components(df, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT):
    """Per row: id, n_shingles, class_id (least id with the same set), component_id (least id reachable by links)."""
    from pyspark.sql import functions as F

    rows = _components(df.select(F.col(id_col), F.col(text_col)), id_col, text_col, size, percent)
    if df.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte"):
        direct = rows.agg(F.sum(F.when(F.col("__row_key") == F.col("__row_id"), 0).otherwise(1)).alias("x")).first()["x"]
        if not direct:
            t = df.schema[id_col].dataType
            return rows.select(F.col("__row_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("class").cast(t).alias("class_id"), F.col("component").cast(t).alias("component_id"))
    names = rows.groupBy("component").agg(F.min("__row_id").alias("component_id"))
    classes = rows.groupBy("class").agg(F.min("__row_id").alias("class_id"))
    return rows.join(names, "component").join(classes, "class").select(F.col("__row_id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def keep_one(df, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT):
    """The rows of one document of each component, the first in the order of ids, with all their columns."""
    rows = _components(df, id_col, text_col, size, percent, columns=True)
    return rows.where("__component = __row_key").select(*[f"`{c}`" for c in df.columns])


def _components(df, id_col: str, text_col: str, size: int, percent: int, columns: bool = False):
    """Rows (__row_key, __row_id, n, class, component), or with ``columns`` the input's columns and (__row_key, __component)."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    keyed = unique_keys(df, id_col, text_col, "__row_key")
    texts = keyed.select(F.col("__row_key").alias("key"), F.col(text_col).alias("text"))
    scanned = materialise(texts.mapInArrow(_scan_sets(size), "key long, n long, d1 long, d2 long, points binary, chunk binary"), "sets")
    docs = scanned.where("key is not null")
    least = docs.groupBy("d1", "d2", "n").agg(F.min("key").alias("class"))
    classes = docs.select("key", "n", "d1", "d2").join(least, ["d1", "d2", "n"]).select("key", "n", F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("key")).alias("class"))
    frequent = spark.sparkContext.broadcast(frequent_groups(_sketch(scanned)))
    heads = least.where("n > 0").select(F.col("class").alias("key"))
    prefixes = texts.mapInArrow(_prefixes(size, percent, frequent), "key long, n long, prefix binary").join(heads, "key", "left_semi")
    exploded = prefixes.mapInArrow(_explode, "shingle long, key long, spot long")
    shared = materialise(exploded.repartition("shingle").sortWithinPartitions("shingle", "spot").mapInArrow(_shared_only(percent), "shingle long, key long, spot long"), "shared")

    candidates = _candidates(_merged_groups(shared), docs.select("key", "points"), percent)

    home = candidates.groupBy("key").agg(F.min("shingle").alias("home"))
    crowd = home.groupBy("home").agg(F.count("*").alias("rows"))
    home = materialise(home.join(crowd, "home").select("key", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.ceil(F.col("rows") / F.lit(PART)))).alias("part")), "homes")
    if home.count() <= BROADCAST_ROWS:  # else the texts are shuffled
        home = F.broadcast(home)
    sets = texts.join(home, "key").select("key", "text", "part").mapInArrow(_sets_of(size), "part long, key long, n long, wide binary, set binary")
    found = sets.repartition("part").sortWithinPartitions("part").mapInArrow(_part_components(percent), "key long, component long, n long, wide binary, set binary")
    with small_batches(spark):
        members = materialise(found, "members")
    for settle in (_best_links, _last_links):
        links = settle(candidates, members, percent)
        if links is not None and not links.isEmpty():
            members = _merge(members, connected(links))
    # the least key of a component: members' labels are keys of members, joined components take the least label
    final = members.groupBy("component").agg(F.min("key").alias("least"))
    member = members.select("key", "component").join(final, "component").select(F.col("key").alias("class"), "least")
    out = classes.join(member, "class", "left").select("key", "n", "class", F.coalesce("least", "class").alias("component"))
    if columns:
        return keyed.join(out.select(F.col("key").alias("__row_key"), F.col("component").alias("__component")), "__row_key")
    return keyed.select("__row_key", F.col(id_col).alias("__row_id")).join(out.withColumnRenamed("key", "__row_key"), "__row_key")
