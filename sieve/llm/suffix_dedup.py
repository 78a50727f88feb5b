"""Suffix-array dedup: removal of every byte covered by a long string that also starts earlier.

A start is a position whose next ``SPAN`` bytes lie in its document.  Its string is removed if the same
string also starts earlier (a smaller document key, or the same document and an earlier start), that is if
its longest previous factor has ``SPAN`` bytes or more.  Strings are judged on the input.

Each start belongs to one anchor: the least-hashed ``GRAM`` bytes inside its string (the leftmost of
equals).  Equal strings have equal anchors at equal distances, so all earlier matches of a start lie among
the occurrences of its anchor.  The starts of one occurrence of an anchor are neighbours; they and the bytes they reach
are its context.

1. Every document gives one row for each anchor occurrence: hash of the anchor, hash of the context, place.
   Occurrences of one context inside a batch are compared byte for byte and settled there (all but the first are removed), so a
   passage that many documents share sends one row a batch.
2. Rows are dealt by anchor and streamed in order.  Of equal contexts (128 bits of hashes) all but the first are removed.  Only the
   first occurrences of anchors that have several contexts stay open.
3. Open contexts fetch their bytes and are dealt by anchor again.  There the suffixes are put in the order of their first
   ``SPAN`` bytes (prefix doubling, equal ones by place); the previous and next smaller positions in that order are the only
   earlier suffixes that can share the most, and the longer of the two common prefixes is the longest previous
   factor.  A start whose factor has ``SPAN`` bytes goes.  An anchor with over
   ``HOT`` open contexts (a common line in ever different surroundings) is dealt by the hash of each of its
   strings instead, and streamed.
4. Removed ranges meet their documents, which are shuffled once.

No stage holds a group of unbounded size.  Only copies of whole contexts in different batches are told by hashes alone, of
128 bits; everything else is compared by its bytes.

Defined cases: null or empty text: nothing to remove; texts shorter than ``SPAN`` stay; texts of any length are
taken whole; ids that are null, repeated or no integers are ordered by (id, text), null last; an empty table gives
an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from ._jobs import materialise, release, unique_keys
from ._text import BLOCK, Loads, Prefix, blocks, column_bytes, kind, mix, per_doc, ragged

SPAN = 100
GRAM = 32
HOT = 20_000
_PLACE = np.uint64((1 << 28) - 1)
U64 = np.uint64


def _pieces(batch: pa.RecordBatch):
    """(document of each piece, its first byte there, bytes, offsets): blocks, with long texts cut so that pieces share SPAN - 1 bytes."""
    at = 0
    for block, data, offsets in blocks(batch, "text", BLOCK // 2):
        n = block.num_rows
        if len(data) <= 4 * BLOCK or n > 1:
            yield np.arange(at, at + n), np.zeros(n, np.int64), data, offsets
        else:
            for lo in range(0, len(data), 2 * BLOCK):
                piece = data[lo : lo + 2 * BLOCK + SPAN - 1]
                yield np.array([at]), np.array([lo]), piece, np.array([0, len(piece)])
        at += n


def contexts(data: np.ndarray, offsets: np.ndarray):
    """(anchor hash, context hash, first start, starts) of every anchor occurrence of a block, ascending."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none.astype(U64), none.astype(U64), none, none
    prefix = Prefix(data)
    n = len(data) - GRAM + 1
    place = np.arange(n)
    grams = prefix.hash(place, place + GRAM)
    least = (grams & ~_PLACE) | place.astype(U64)
    width = 1
    while 2 * width <= SPAN - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - GRAM + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & _PLACE).astype(np.int64)  # one for each start 0..len(data) - SPAN
    valid = np.zeros(len(anchor) + 1, np.int64)
    lo, hi = offsets[:-1], offsets[1:] - SPAN + 1
    real = hi > lo
    np.add.at(valid, lo[real], 1)
    np.add.at(valid, hi[real], -1)
    starts = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(starts):
        return none.astype(U64), none.astype(U64), none, none
    own = anchor[starts]
    doc = np.searchsorted(offsets, starts, "right")
    edge = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])]))
    first, count = starts[edge], np.diff(np.append(edge, len(starts)))
    return grams[own[edge]], Loads(data).hash(first, first + count + SPAN - 1), first, count


def _anchors(batches):
    """Rows (anchor, context, key, place): place is start << 32 | starts, with bit 31 set for a removed range of that many bytes."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if (np.diff(keys) < 0).any():
            order = np.argsort(keys, kind="stable")
            keys, batch = keys[order], batch.take(pa.array(order))
        parts = []
        for row, base, data, offsets in _pieces(batch):
            a, c, first, count = contexts(data, offsets)
            d = np.searchsorted(offsets, first, "right") - 1
            parts.append((a, c, row[d], first - offsets[d] + base[d], count))
        if not parts:
            continue
        a, c, row, start, count = (np.concatenate(x) for x in zip(*parts))
        _, first, entry = np.unique(mix(a ^ mix(c)), return_index=True, return_inverse=True)
        later = np.ones(len(a), bool)
        later[first] = False
        data, offsets = column_bytes(batch.column(1))
        own = np.flatnonzero(later)
        known = first[entry[own]]
        other = own[~equal_ranges(data, offsets[row[own]] + start[own], count[own], offsets[row[known]] + start[known], count[known])]
        if len(other):  # different contexts with one hash stay open: another hash of their own sends them to step 3
            later[other] = False
            c[other] = mix(c[other] + np.arange(1, len(other) + 1).astype(U64))
            first = np.flatnonzero(~later)
        r, s, e = merged(row[later], start[later], start[later] + count[later] + SPAN - 1)
        salt = mix(keys[r].astype(U64) + s.astype(U64))
        first.sort()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a[first], salt]).view(np.int64)),
                pa.array(np.concatenate([c[first], np.zeros(len(r), U64)]).view(np.int64)),
                pa.array(np.concatenate([keys[row[first]], keys[r]])),
                pa.array(np.concatenate([start[first] << 32 | count[first], s << 32 | 1 << 31 | (e - s)])),
            ],
            names=["anchor", "context", "key", "place"],
        )


def equal_ranges(data: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """Whether contexts of n and of m starts from a and b hold the same bytes."""
    same = n == m
    for lo in range(0, len(a), chunk):
        i = lo + np.flatnonzero(same[lo : lo + chunk])
        size = n[i] + SPAN - 1
        wrong = data[ragged(a[i], size)] != data[ragged(b[i], size)]
        if wrong.any():
            same[i[np.add.reduceat(wrong, np.cumsum(size) - size) > 0]] = False
    return same


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Ranges of equal rows joined where they touch; input in the order (row, start) with ends ascending in a row."""
    if not len(row):
        return row, start, end
    edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > end[:-1])]))
    return row[edge], start[edge], end[np.append(edge[1:], len(row)) - 1]


def _classify(batches):
    """From rows in the order (anchor, context, key, place): removed ranges (anchor null) and open contexts."""
    carry = None  # the last anchor, its last context, and its first row as long as it is the only one
    for batch in batches:
        a, c, k, p = (batch.column(i).to_numpy() for i in range(4))
        passing = (p >> 31 & 1).astype(bool)
        out = [(k[passing], p[passing] >> 32, (p[passing] >> 32) + (p[passing] & (1 << 31) - 1), None)]
        a, c, k, p = a[~passing], c[~passing], k[~passing], p[~passing]
        if len(a):
            last = carry if carry else (None,) * 3
            new_a = np.concatenate([[a[0] != last[0]], a[1:] != a[:-1]])
            new_c = new_a.copy()
            new_c[0] |= c[0] != last[1]
            new_c[1:] |= c[1:] != c[:-1]
            start, end = p >> 32, (p >> 32) + (p & (1 << 31) - 1) + SPAN - 1
            out.append((k[~new_c], start[~new_c], end[~new_c], None))
            rep = np.flatnonzero(new_c)
            held = last[2] if last[0] is not None and a[0] == last[0] else None
            ra, rk, rs, re = a[rep], k[rep], start[rep], end[rep]
            several = np.zeros(len(rep), bool)
            if len(rep):
                several[1:] |= ra[1:] == ra[:-1]
                several[:-1] |= ra[1:] == ra[:-1]
                several |= (ra == last[0]) if last[0] is not None else False
                if held is not None and ra[0] == last[0]:
                    out.append((np.array([held[0]]), np.array([held[1]]), np.array([held[2]]), ra[:1]))
                    held = None
            out.append((rk[several], rs[several], re[several], ra[several]))
            tail = held
            if len(rep) and ra[-1] == a[-1] and not several[-1]:
                tail = (int(rk[-1]), int(rs[-1]), int(re[-1]))
            elif len(rep) and ra[-1] == a[-1]:
                tail = None
            carry = (a[-1], c[-1], tail)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([x[0] for x in out]).astype(np.int64)),
                pa.array(np.concatenate([x[1] for x in out]).astype(np.int64)),
                pa.array(np.concatenate([x[2] for x in out]).astype(np.int64)),
                pa.chunked_array([pa.nulls(len(x[0]), pa.int64()) if x[3] is None else pa.array(x[3]) for x in out]).combine_chunks(),
            ],
            names=["key", "start", "end", "anchor"],
        )


def _extract(batches):
    """Bytes of the open contexts: (anchor, key, start, bytes), or of a hot anchor each string under its own hash."""
    for batch in batches:
        keys = batch.column(0).to_numpy().astype(np.int64)
        at = 0
        for block, data, offsets in blocks(batch, "text"):
            n = block.num_rows
            lists = block.column(2)
            counts = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            start, end, anchor, hot = (np.asarray(flat.field(i)) for i in range(4))
            row = np.repeat(np.arange(n), counts)
            hot = hot.astype(bool)
            whole = (anchor[~hot], keys[at + row[~hot]], start[~hot], offsets[row[~hot]] + start[~hot], (end - start)[~hot])
            parts = [whole]
            if hot.any():
                m = (end - start)[hot] - SPAN + 1
                s = ragged(start[hot], m)
                r = np.repeat(row[hot], m)
                g = offsets[r] + s
                parts.append((Prefix(data).hash(g, g + SPAN).view(np.int64), keys[at + r], s, g, np.full(len(s), SPAN)))
            a, k, s, g, size = (np.concatenate(x) for x in zip(*parts))
            edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data[ragged(g, size)]))])
            single = np.concatenate([np.zeros(len(whole[0]), bool), np.ones(len(a) - len(whole[0]), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(single), pa.array(a), pa.array(k), pa.array(s), raw.cast(pa.binary())], names=["single", "anchor", "key", "start", "bytes"])
            at += n


def suffix_ranks(data: np.ndarray, depth: int = SPAN) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The first eight bytes of every suffix as a number, and (width, rank of the first ``width`` bytes) up to ``depth`` (8 or more).

    Widths double; beyond the end count zero bytes.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
    n = len(data)
    word = np.zeros(n, U64)
    for j in range(8):
        word = word << U64(8) | padded[j : j + n]
    rank = np.unique(word, return_inverse=True)[1].astype(np.int32) + 1
    levels, width = [(8, rank)], 8
    while width < depth:
        step = min(width, depth - width)
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * np.int64(n + 2) + ahead, return_inverse=True)[1].astype(np.int32) + 1
        width += step
        levels.append((width, rank))
    return word, levels


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each of distinct values the place of the nearest smaller one before it, -1 if there is none."""
    before = np.arange(-1, len(values) - 1)
    left = np.arange(len(values))
    for _ in range(64):
        left = left[before[left] >= 0]
        left = left[values[before[left]] > values[left]]
        if not len(left):
            return before
        before[left] = before[before[left]]  # all between that place and this one is greater
    stack: list[int] = []
    numbers = values.tolist()
    for i, v in enumerate(numbers):  # a long ascent: one pass over all
        while stack and numbers[stack[-1]] > v:
            stack.pop()
        before[i] = stack[-1] if stack else -1
        stack.append(i)
    return before


def common_prefix(word: np.ndarray, levels: list[tuple[int, np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at x and y share, of less than ``depth``: each width at most once, then single bytes."""
    size = np.zeros(len(x), np.int64)
    for width, rank in reversed(levels[:-1]):
        size += width * (rank[x + size] == rank[y + size])
    wrong = word[x + size] ^ word[y + size]
    return np.minimum(size + sum((wrong >> U64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8)), levels[-1][0] - 1)


def longest_previous(data: np.ndarray, starts: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """The longest previous factor, at most ``depth``, of each of the ascending ``starts`` among them; ``depth`` bytes follow each.

    In suffix order, equal ones by place, the earlier suffix that shares most with a suffix is its previous or its next smaller position.
    Of suffixes with the same first ``depth`` bytes all but the first have it right before them; the first meets the first of other such runs.
    """
    word, levels = suffix_ranks(data, depth)
    rank = levels[-1][1][starts]
    order = np.argsort(rank, kind="stable")
    opens = np.ones(len(order), bool)
    opens[1:] = rank[order[1:]] != rank[order[:-1]]
    lead = order[opens]
    lpf = np.full(len(starts), depth, np.int64)
    lpf[lead] = 0
    last = len(lead) - 1
    for place in (previous_smaller(lead), last - previous_smaller(lead[::-1])[::-1]):
        there = np.flatnonzero((place >= 0) & (place <= last))
        shared = common_prefix(word, levels, starts[lead[there]], starts[lead[place[there]]])
        lpf[lead[there]] = np.maximum(lpf[lead[there]], shared)
    return lpf


def _factors(batches):
    """Removed ranges among rows in the order (single, anchor, key or bytes, ...)."""
    held: list = []
    size = 0
    last = None

    def flush(rows):
        if not rows:
            return None
        texts = [r[3] for r in rows]
        data = np.frombuffer(b"".join(texts), np.uint8)
        length = np.array([len(t) for t in texts], np.int64)
        edge = np.cumsum(length) - length
        row = np.repeat(np.arange(len(rows)), length - SPAN + 1)
        starts = ragged(edge, length - SPAN + 1)
        hit = longest_previous(data, starts) >= SPAN
        row, inside = row[hit], starts[hit] - edge[row[hit]]
        row, s, e = merged(row, inside, inside + SPAN)
        key, base = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        return _ranges(key[row], base[row] + s, base[row] + e)

    for batch in batches:
        single = batch.column(0).to_numpy(zero_copy_only=False)
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(1, 5))))
        key, start = [], []
        for one, row in zip(single, rows):
            if one:  # streamed: in a run of equal strings all but the first go
                if (row[0], row[3]) == last:
                    key.append(row[1])
                    start.append(row[2])
                last = (row[0], row[3])
            else:
                if size > BLOCK // 2 and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if key:
            yield _ranges(np.array(key), np.array(start), np.array(start) + SPAN)
    if held:
        yield flush(held)


def _ranges(key, start, end):
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["key", "start", "end"])


def _with_ranges(df, id_col: str, text_col: str):
    """The rows with ``__gone``: array of removed (start << 32 | end), null if none."""
    from pyspark.sql import functions as F

    docs = unique_keys(df, id_col, text_col, "__row_key").where("__row_key is not null")
    texts = docs.select(F.col("__row_key").alias("key"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(_anchors, "anchor long, context long, key long, place long")
    marks = rows.repartition("anchor").sortWithinPartitions("anchor", "context", "key", "place").mapInArrow(_classify, "key long, start long, end long, anchor long")
    marks = materialise(marks, "marks")
    release(df.sparkSession)  # the rows of all anchors are the largest shuffle but that of the texts
    open_ = marks.where("anchor is not null")
    hot = open_.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    open_ = open_.join(hot, "anchor", "left").select("key", F.struct("start", "end", "anchor", F.coalesce("hot", F.lit(False)).alias("hot")).alias("o"))
    wanted = open_.groupBy("key").agg(F.collect_list("o").alias("open"))
    schema = "single boolean, anchor long, key long, start long, bytes binary"
    pieces = texts.join(wanted, "key").select("key", "text", "open").mapInArrow(_extract, schema)
    order = ["single", "anchor", F.when(F.col("single"), F.col("bytes")), "key", "start"]
    factors = pieces.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_factors, "key long, start long, end long")
    gone = marks.where("anchor is null").select("key", "start", "end").unionByName(factors)
    ranges = gone.groupBy("key").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("__gone"))
    return docs.join(ranges.withColumnRenamed("key", "__row_key"), "__row_key", "left")


def gone_mask(data: np.ndarray, offsets: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which bytes of a block the ranges of its rows cover."""
    lists = lists.fill_null([]) if lists.null_count else lists
    flat = np.asarray(lists.flatten(), np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, offsets[row] + (flat >> 32), 1)
    np.add.at(cover, offsets[row] + (flat & 0xFFFFFFFF), -1)
    return np.cumsum(cover)[:-1] > 0


def removed_bytes(df, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes left, concatenated)."""
    from pyspark.sql import functions as F

    rows = _with_ranges(df.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, "_t", BLOCK // 2):
                gone = gone_mask(data, offsets, block.column(2))
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                opens |= gone & np.isin(np.arange(len(data)), offsets)
                removed = per_doc(gone, offsets)
                kept = data[~gone].tobytes()
                edge = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
                sha = [hashlib.sha256(kept[s:e]).hexdigest() for s, e in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(per_doc(opens, offsets)), pa.array(sha)], names=names)

    picked = rows.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), "__gone")
    return picked.mapInArrow(run, f"`{id_col}` {kind(df, id_col)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars"):
    """The rows with their repeated text removed; rows whose text goes completely are left out.

    A character stays whole if any of its bytes does.  ``chars_col``, where the table has it, follows the text.
    """
    rows = _with_ranges(df, id_col, text_col).select(*[f"`{c}`" for c in df.columns], "__gone")
    names, schema = df.columns, df.schema
    at = names.index(text_col)
    count = names.index(chars_col) if chars_col in names else None

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, text_col, BLOCK // 2):
                gone = gone_mask(data, offsets, block.column(block.num_columns - 1))
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                width = np.diff(np.append(lead, len(data)))
                stays = np.add.reduceat(~gone, lead) > 0 if len(lead) else np.zeros(0, bool)
                left = np.repeat(stays, width) if len(lead) else np.zeros(0, bool)
                size = per_doc(left, offsets)
                edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                text = pa.LargeStringArray.from_buffers(block.num_rows, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data[left])))
                text = pa.compute.if_else(block.column(at).is_null(), pa.scalar(None, pa.large_string()), text)
                columns = [block.column(i) for i in range(block.num_columns - 1)]
                columns[at] = text.cast(columns[at].type)
                if count is not None:
                    columns[count] = pa.compute.if_else(block.column(at).is_null(), columns[count], pa.compute.utf8_length(text).cast(columns[count].type))
                out = pa.RecordBatch.from_arrays(columns, names=names)
                yield out.filter(pa.array((size > 0) | (np.diff(offsets) == 0)))

    return rows.mapInArrow(run, schema)
