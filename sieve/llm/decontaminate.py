"""Benchmark decontamination: hits of test n-grams in training texts.

Texts are lower-cased in A-Z and cut into words of digits, letters and all
characters beyond ASCII.  A window is ``size`` consecutive words of a benchmark item;
an item of fewer words, but not none, is one window.  A document word inside any
occurrence of a window is hit.

The windows form a hash set that is broadcast: the benchmark's words as ids of a vocabulary, and per window its hash, its
place and its item.  It is built in the driver from at most ``MAX_BROADCAST`` / 16 bytes of text (26 bytes of memory
for each while it is built, 4 then) and broadcast if the arrays, measured, have at most ``MAX_BROADCAST`` bytes.  A larger benchmark meets
the documents by a shuffle on 128-bit hashes instead.

With a broadcast set, documents are scanned in blocks: words are found in the vocabulary by hash and compared byte for byte, and runs
of known words are hashed window by window; every hash that is found is compared with the window id by id.  After a shuffle
each window found is compared with the document's words byte for byte.  So hash collisions can't give a hit on either way.

Defined cases: null or empty text has no words and no hit; an item without words has no window; items
with a null id hit words like others and count as one item, which the list of items leaves out; an empty benchmark hits nothing; equal rows give equal results, one per row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from ._jobs import materialise, unique_keys
from ._text import ALNUM_WORD, BLOCK, LOWER, Loads, blocks, column_bytes, distinct, kind, mix, per_doc, ragged, window_hash, words

SIZE = 10
MAX_BROADCAST = 256 << 20
_OTHER = np.uint64(0x6A09E667F3BCC909)  # makes the second of two hashes


def _by_name(item: str | None):
    """Sort key of item ids, null first."""
    return item is not None, item or ""


class Windows:
    """The windows of a benchmark: vocabulary, the items' words as ids, and per length the windows' hashes in ascending order."""

    def __init__(self, ids: list[str | None], texts: pa.Array, size: int):
        data, offsets = column_bytes(texts)
        low = LOWER[data]
        start, end, first = words(low, offsets, ALNUM_WORD)
        known = distinct(low, start, end)
        self.hash, self.size = known.hash, known.size
        self.text = Loads(low[ragged(known.start, known.size)])
        self.place = np.cumsum(known.size) - known.size
        self.most = int(np.unique(known.hash, return_counts=True)[1].max(initial=0))  # vocabulary words with one hash
        self.wid = known.entry.astype(np.int32)
        self.ids = sorted(set(ids), key=_by_name)
        rank = {x: i for i, x in enumerate(self.ids)}
        item_of = np.array([rank[x] for x in ids], np.int32)
        count = np.diff(first)
        self.by_length = {}
        for n in np.unique(np.minimum(count[count > 0], size)).tolist():
            own = np.flatnonzero(np.minimum(count, size) == n)
            at = ragged(first[own], count[own] - n + 1)
            item = np.repeat(item_of[own], count[own] - n + 1)
            key = window_hash(self.wid.astype(np.uint64), n)[at]
            order = np.lexsort((at, item, key))
            key, at, item = key[order], at[order], item[order]
            keep = np.ones(len(at), bool)  # without repeats of a window in an item
            i = np.flatnonzero((key[1:] == key[:-1]) & (item[1:] == item[:-1]))
            keep[i[self._same(self.wid, at[i], at[i + 1], n)] + 1] = False
            self.by_length[n] = (key[keep], at[keep], item[keep])

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hash, self.size, self.text.bytes, self.place, self.wid)) + sum(x.nbytes for own in self.by_length.values() for x in own)

    def _same(self, wid: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the windows of ids from a are the benchmark's from b."""
        same = np.ones(len(a), bool)
        for j in range(n):
            same &= wid[a + j] == self.wid[b + j]
        return same

    def lookup(self, loads: Loads, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Vocabulary id of each word, -1 if it has none."""
        wid = np.full(len(start), -1, np.int64)
        h = loads.hash(start, start + size)
        lo = np.searchsorted(self.hash, h)
        for k in range(self.most):
            at = np.minimum(lo + k, len(self.hash) - 1)
            i = np.flatnonzero((wid < 0) & (lo + k < len(self.hash)) & (self.hash[at] == h))
            same = loads.equal(start[i], size[i], self.text, self.place[at[i]], self.size[at[i]])
            wid[i[same]] = at[i[same]]
        return wid

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Words' starts and ends, first word of each document, hit mask of the words, and (document, item) pairs."""
        low = LOWER[data]
        start, end, first = words(low, offsets, ALNUM_WORD)
        hit = np.zeros(len(start), bool)
        pairs = [np.zeros((0, 2), np.int64)]
        if len(self.hash) == 0 or len(start) == 0:
            return start, end, first, hit, pairs[0]
        wid = self.lookup(Loads(low), start, end - start)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        unknown = np.concatenate([[0], np.cumsum(wid < 0)])
        for n, (keys, place, item) in self.by_length.items():
            if len(wid) < n:
                continue
            # starts of windows all of whose words are known, inside one document
            s = np.flatnonzero((unknown[n:] == unknown[:-n]) & (doc[n - 1 :] == doc[: len(doc) - n + 1]))
            k = window_hash(wid.astype(np.uint64), n)[s]
            lo = np.searchsorted(keys, k, "left")
            found = np.searchsorted(keys, k, "right") - lo
            s, at = np.repeat(s, found), ragged(lo, found)
            same = self._same(wid, s, place[at], n)
            s, at = s[same], at[same]
            hit[(s[:, None] + np.arange(n)).reshape(-1)] = True
            pairs.append(np.stack([doc[s], item[at]], 1))
        return start, end, first, hit, np.unique(np.concatenate(pairs), axis=0)


def normalised(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one space after each, and where each starts."""
    size = end - start
    place = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    out[ragged(place, size)] = low[ragged(start, size)]
    return out, place


def _window_rows(lengths: list[int] | None, size: int):
    """Rows (key, n, at, h1, h2) of all windows of texts: of the given lengths, or each text's own (``size``, or all its words if
    fewer) with a sixth column for the window's words."""

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, "text", BLOCK // 4):
                low = LOWER[data]
                start, end, first = words(low, offsets, ALNUM_WORD)
                h = Loads(low).hash(start, end)
                count = np.diff(first)
                doc = np.repeat(np.arange(len(count)), count)
                text, place = normalised(low, start, end)
                for n in lengths or range(1, size + 1):
                    if len(h) < n:
                        continue
                    one, two = window_hash(h, n), window_hash(mix(h ^ _OTHER), n)
                    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
                    if lengths is None and n < size:
                        at = at[count[doc[at]] == n]
                    keys = block.column(0).take(pa.array(doc[at]))
                    columns = [keys, pa.array(np.full(len(at), n)), pa.array(at - first[doc[at]]), pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64))]
                    names = ["key", "n", "at", "h1", "h2"]
                    if lengths is None:
                        room = place[at + n - 1] + (end - start)[at + n - 1] - place[at]
                        edge = np.concatenate([[0], np.cumsum(room)]).astype(np.int64)
                        grams = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(text[ragged(place[at], room)]))])
                        columns.append(grams.cast(pa.binary()))
                        names.append("gram")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _found_by_shuffle(texts, benchmark, item_col: str, text_col: str, size: int):
    """(key, found): for texts (key, text) the windows (at, n, item, gram) whose 128-bit hashes are equal, still to be compared."""
    from pyspark.sql import functions as F

    ddl = "key {}, n long, at long, h1 long, h2 long"
    items = benchmark.select(F.col(item_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    grams = items.mapInArrow(_window_rows(None, size), ddl.format("string") + ", gram binary").select(F.col("key").alias("item"), "n", "h1", "h2", "gram").distinct()
    grams = materialise(grams, "grams")
    lengths = sorted(r["n"] for r in grams.select("n").distinct().collect())  # at most ``size`` numbers
    spots = texts.mapInArrow(_window_rows(lengths or [size], size), ddl.format("long"))
    found = spots.join(grams, ["n", "h1", "h2"])
    return found.groupBy("key").agg(F.collect_list(F.struct("at", "n", "item", "gram")).alias("found"))


def _compared(block: pa.RecordBatch, column: int, data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, first, hit mask, item lists) of a block from windows (at, n, item, gram) found for its rows."""
    low = LOWER[data]
    start, end, first = words(low, offsets, ALNUM_WORD)
    hit = np.zeros(len(start), bool)
    lists = block.column(column)
    lists = lists.fill_null([]) if lists.null_count else lists
    row = np.repeat(np.arange(block.num_rows), np.diff(np.asarray(lists.offsets)))
    names: list[set] = [set() for _ in range(block.num_rows)]
    if len(row):
        flat = lists.flatten()
        at, n = (np.asarray(flat.field(k)) for k in (0, 1))
        text, place = normalised(low, start, end)
        a, b = first[row] + at, first[row] + at + n - 1
        grams, edge = column_bytes(flat.field(3))
        same = Loads(text).equal(place[a], place[b] + (end - start)[b] - place[a], Loads(grams), edge[:-1], np.diff(edge))
        hit[ragged(a[same], n[same])] = True
        for d, i in zip(row[same].tolist(), flat.field(2).filter(pa.array(same)).to_pylist()):
            names[d].add(i)
    return start, end, first, hit, [sorted(x, key=_by_name) for x in names]


def _marked(docs, benchmark, id_col: str, text_col: str, item_col: str, item_text_col: str, size: int, limit: int):
    """(docs, marks): marks(block, data, offsets) gives (starts, ends, first, hit mask, sorted item lists, null first) of a block of docs.

    A benchmark of up to ``limit`` bytes as windows is broadcast; a larger one meets the windows of the documents by a shuffle, and
    docs carry what was found in one more column at the end.
    """
    from pyspark.sql import functions as F

    n = benchmark.agg(F.sum(F.octet_length(F.col(item_text_col).cast("string")))).first()[0] or 0
    windows = None
    if n <= limit // 16:
        table = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).toArrow()
        windows = Windows(table.column(0).to_pylist(), table.column(1), size)
    if windows is not None and windows.nbytes <= limit:
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def marks(block, data, offsets):
            w = shared.value
            start, end, first, hit, pairs = w.scan(data, offsets)
            lists = [[] for _ in range(block.num_rows)]
            for d, i in pairs.tolist():  # in the order of names
                lists[d].append(w.ids[i])
            return start, end, first, hit, lists

        return docs, marks

    keyed = unique_keys(docs, id_col, text_col, "__row_key")
    found = _found_by_shuffle(keyed.select(F.col("__row_key").alias("key"), F.col(text_col).alias("text")), benchmark, item_col, item_text_col, size)
    joined = keyed.join(found.select(F.col("key").alias("__row_key"), F.col("found").alias("__found")), "__row_key", "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__found"), lambda block, data, offsets: _compared(block, block.num_columns - 1, data, offsets)


def contamination(docs, benchmark, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, limit: int = MAX_BROADCAST):
    """Per document: id, n_words, n_hit, n_items, items (sorted strings), items_sha256, contaminated."""
    from pyspark.sql import functions as F

    schema = f"`{id_col}` {kind(docs, id_col)}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
    names = [id_col, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
    rows, marks = _marked(docs.select(F.col(id_col), F.col(text_col)), benchmark, id_col, text_col, item_col, item_text_col, size, limit)

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, text_col):
                _, _, first, hit, lists = marks(block, data, offsets)
                n_hit = per_doc(hit, first)
                named = [[i for i in x if i is not None] for x in lists]
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]
                columns = [pa.array(np.diff(first)), pa.array(n_hit), pa.array([len(x) for x in lists], pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(sha), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays([block.column(0), *columns], names=names)

    return rows.mapInArrow(run, schema)


def drop_contaminated(docs, benchmark, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, limit: int = MAX_BROADCAST):
    """The documents without a hit, with all their columns."""
    rows, marks = _marked(docs, benchmark, id_col, text_col, item_col, item_text_col, size, limit)
    schema, width = docs.schema, len(docs.columns)

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, text_col):
                _, _, first, hit, _ = marks(block, data, offsets)
                yield block.select(range(width)).filter(pa.array(per_doc(hit, first) == 0))

    return rows.mapInArrow(run, schema)


def remove_spans(docs, benchmark, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, limit: int = MAX_BROADCAST):
    """All documents; each run of hit words goes, from its first byte to its last, and the rest stays as it is."""
    rows, marks = _marked(docs, benchmark, id_col, text_col, item_col, item_text_col, size, limit)
    schema, width = docs.schema, len(docs.columns)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for block, data, offsets in blocks(batch, text_col):
                start, end, first, hit, _ = marks(block, data, offsets)
                doc = np.repeat(np.arange(block.num_rows), np.diff(first))
                cut = np.zeros(len(data) + 1, np.int64)
                np.add.at(cut, start[hit], 1)
                np.add.at(cut, end[hit], -1)
                joined = np.flatnonzero(hit[1:] & hit[:-1] & (doc[1:] == doc[:-1]))  # the gap between two hit words
                np.add.at(cut, end[joined], 1)
                np.add.at(cut, start[joined + 1], -1)
                gone = np.cumsum(cut)[:-1] > 0
                left = np.concatenate([[0], np.cumsum(per_doc(~gone, offsets))]).astype(np.int64)
                text = pa.LargeStringArray.from_buffers(block.num_rows, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(data[~gone])))
                text = pa.compute.if_else(block.column(at).is_null(), pa.scalar(None, pa.large_string()), text)
                yield block.select(range(width)).set_column(at, batch.schema.field(at), text.cast(batch.schema.field(at).type))

    return rows.mapInArrow(run, schema)
