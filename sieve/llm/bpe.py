"""Byte-level BPE encoding and decoding with a public vocabulary.

A text is cut into pre-tokens; each distinct pre-token of up to ``SHORT`` bytes is merged with a
contiguous rank array: the part boundaries and the ranks of adjacent parts stand side by side, the
least rank is found by a scan, its boundary is deleted, and the ranks of the two neighbours are
refreshed.  Words of one length form a matrix, so a scan, a deletion and a refresh are each one
array operation over all of them.  A longer pre-token (a scan for each merge would take quadratic
time) is merged with a heap of ranks over linked parts; the order of merges is the same.

Ids equal those of the tokenizers library for the same file without added special tokens:
the strings of special tokens that stand in a text get their own ids.

Defined cases: null or empty text has no tokens and decodes to an empty text; very long texts are taken whole;
equal rows give equal results, one per row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa

from ._text import WordCache, distinct, kind, map_text, ragged

SHORT = 64
_NONE = np.iinfo(np.int32).max
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = range(4)


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[_SPACES] = SPACE
    return table


_class_table: list[np.ndarray] = []


def char_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and class of each character."""
    if not _class_table:
        _class_table.append(_classes())
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    code = lead
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        p, b = at[wide], lead[wide]
        c1, c2, c3 = (padded[p + j] & 63 for j in (1, 2, 3))
        code = lead.copy()
        code[wide] = np.where(b < 0xE0, (b & 31) << 6 | c1, np.where(b < 0xF0, (b & 15) << 12 | c1 << 6 | c2, (b & 7) << 18 | c1 << 12 | c2 << 6 | c3))
    return at, _class_table[0][np.minimum(code, 0x10FFFF)]


def pretokens(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens start.  ``edges`` are the ascending bounds of independent texts, 0 and len(data) included.

    Pre-tokens are contractions after an apostrophe, runs of letters, of numbers or of other characters, each with one
    space before it, and the white space that is left: of a run before a character the last one stands alone.
    """
    at, c = char_classes(data)
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    opens = np.zeros(n, bool)
    cut = np.searchsorted(at, edges[edges < len(data)])
    opens[cut] = True
    start = opens.copy()
    start[1:] |= c[1:] != c[:-1]
    space = c == SPACE
    last = np.zeros(n, bool)  # the last of a run of white space before a character of the same text
    last[:-1] = space[:-1] & ~space[1:] & ~opens[1:]
    start[last] = True
    joined = np.flatnonzero(last & (data[at] == 0x20)) + 1
    start[joined] = False
    quote = np.flatnonzero(start & (data[at] == 39))
    if len(quote):
        end = edges[np.searchsorted(edges, at[quote], "right")]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        b1, b2 = padded[at[quote] + 1], padded[at[quote] + 2]
        one = np.isin(b1, np.frombuffer(b"stmd", np.uint8)) & (at[quote] + 2 <= end)
        two = (((b1 == 114) | (b1 == 118)) & (b2 == 101) | (b1 == 108) & (b2 == 108)) & (at[quote] + 3 <= end)
        for hits, size in ((one, 2), (two, 3)):
            q = quote[hits]
            start[q + 1] = False
            after = q + size
            start[after[after < n]] = True
    return at[start]


class ByteBpe:
    """Vocabulary, merges and special tokens of a tokenizers file of a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        # printable stand-ins of the 256 bytes: Latin-1's visible characters stand for themselves, the others follow from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        tokens = [b""] * size
        for text, i in vocab.items():
            tokens[i] = bytes(stand[ch] for ch in text) if all(ch in stand for ch in text) else text.encode()
        for text, i in self.special.items():
            tokens[i] = text
        self.tokens = tokens
        self.byte_id = np.zeros(256, np.int32)
        for ch, b in stand.items():
            self.byte_id[b] = vocab[ch]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.width = np.int64(size)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], np.arange(len(pairs), dtype=np.int32)[order], made
        self.size_of = np.array([len(t) for t in tokens], np.int64)
        self.bytes_pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.bytes_start = np.cumsum(self.size_of) - self.size_of
        names = [f"{i},".encode() for i in range(size)]
        self.name_size = np.array([len(t) for t in names], np.int64)
        self.name_pool = np.frombuffer(b"".join(names), np.uint8)
        self.name_start = np.cumsum(self.name_size) - self.name_size
        self.cache = WordCache()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent pairs; ``_NONE`` where they don't merge."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of one length: a row of byte ids each.  Returns rows of ids and their sizes."""
        n, width = parts.shape
        done, size = parts.copy(), np.full(n, width, np.int64)
        if width < 2:
            return done, size
        rows = np.arange(n)
        rank = np.full((n, width), _NONE, np.int32)
        rank[:, :-1] = self.rank(parts[:, :-1], parts[:, 1:])
        columns = np.arange(width)
        left = width
        while len(rows):
            j = rank.argmin(1)
            i = np.arange(len(rows))
            least = rank[i, j]
            over = least == _NONE
            if over.any():
                done[rows[over]] = parts[over]
                size[rows[over]] = left
                live = ~over
                rows, parts, rank, j, least = rows[live], parts[live], rank[live], j[live], least[live]
                if not len(rows):
                    break
                i = np.arange(len(rows))
            parts[i, j] = self.made[least]
            # delete the boundary after j
            source = np.minimum(columns + (columns > j[:, None]), width - 1)
            parts = np.take_along_axis(parts, source, 1)
            rank = np.take_along_axis(rank, source, 1)
            left -= 1
            rank[:, left - 1 :] = _NONE
            # refresh the neighbours
            right = np.flatnonzero(j < left - 1)
            rank[right, j[right]] = self.rank(parts[right, j[right]], parts[right, j[right] + 1])
            before = np.flatnonzero(j > 0)
            rank[before, j[before] - 1] = self.rank(parts[before, j[before] - 1], parts[before, j[before]])
        return done, size

    def merge_long(self, parts: list[int]) -> list[int]:
        """Merge one long word with a heap; least rank first, leftmost first among equals."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids: list[int] = list(parts)
        first = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, k: int) -> None:
            pair = ids[i], ids[k]
            if pair not in known:
                known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] != _NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = after[i] if ids[i] == a else n
            if k >= n or ids[k] != b:
                continue
            ids[i], ids[k] = int(self.made[r]), -1
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]

    def encode_words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, flat, and how many each has."""
        ids: list = [None] * len(start)
        counts = np.zeros(len(start), np.int64)
        groups = []
        for width in np.unique(size):
            at = np.flatnonzero(size == width)
            if width <= SHORT:
                parts, n = self.merge_short(self.byte_id[data[start[at][:, None] + np.arange(width)]])
                counts[at] = n
                groups.append((at, parts, n))
            else:
                for i in at:
                    ids[i] = np.array(self.merge_long(self.byte_id[data[start[i] : start[i] + size[i]]].tolist()), np.int32)
                    counts[i] = len(ids[i])
        where = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for at, parts, n in groups:
            inside = np.arange(parts.shape[1]) < n[:, None]
            flat[ragged(where[at], n)] = parts[inside]
        for i, x in enumerate(ids):
            if x is not None:
                flat[where[i] : where[i] + counts[i]] = x
        return flat, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and tokens of each text."""
        edges = np.unique(np.concatenate([[0], offsets, [len(data)]]))
        special = self._specials(data, offsets)
        if special:
            edges = np.unique(np.concatenate([edges, *[[s, s + n] for s, n, _ in special]]))
        start = pretokens(data, edges)
        size = np.diff(np.append(start, len(data)))
        found = distinct(data, start, start + size)
        rows = self.cache.rows(found, lambda new: self.encode_words(data, found.start[new], found.size[new]))
        ids, count = self.cache.ids(rows[found.entry])
        if special:
            ids, start, count = self._place(ids, start, count, special)
        total = np.concatenate([[0], np.cumsum(count)])
        first = total[np.searchsorted(start, offsets, "left")]
        return ids, np.diff(first)

    def _specials(self, data, offsets) -> list[tuple[int, int, int]]:
        """(position, bytes, id) of the special tokens in the texts, ascending."""
        raw, found = data.tobytes(), []
        for text, i in self.special.items():
            p = raw.find(text)
            while p >= 0:
                if offsets[np.searchsorted(offsets, p, "right")] >= p + len(text):
                    found.append((p, len(text), i))
                    p = raw.find(text, p + len(text))
                else:
                    p = raw.find(text, p + 1)
        out, end = [], 0
        for x in sorted(found):
            if x[0] >= end:
                out.append(x)
                end = x[0] + x[1]
        return out

    def _place(self, ids, start, count, special):
        """Put one id in the place of what a special token's characters were encoded to."""
        total = np.concatenate([[0], np.cumsum(count)])
        owner = np.full(len(start), -1, np.int64)
        lead = np.zeros(len(start), bool)
        for k, (p, n, _) in enumerate(special):
            a, b = np.searchsorted(start, [p, p + n], "left")
            owner[a:b] = k
            lead[a] = True
        keep = np.repeat(owner < 0, count)
        new_count = np.where(owner < 0, count, lead)
        where = np.cumsum(new_count) - new_count
        out = np.zeros(int(new_count.sum()), np.int32)
        plain = owner < 0
        out[ragged(where[plain], new_count[plain])] = ids[keep]
        out[where[lead]] = [special[k][2] for k in owner[lead]]
        return out, start, new_count

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, one after another."""
        return self.bytes_pool[ragged(self.bytes_start[ids], self.size_of[ids])]

    def decode(self, ids) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")

    def names(self, ids: np.ndarray) -> np.ndarray:
        """Decimal ids, each with a comma after it."""
        return self.name_pool[ragged(self.name_start[ids], self.name_size[ids])]


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The model of a file, loaded once in a process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode(df, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: id, ids (array of int)."""

    def kernel(block, data, offsets):
        ids, n = load(path).encode(data, offsets)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))]

    return map_text(df, text_col, kernel, f"`{id_col}` {kind(df, id_col)}, ids array<int>", [id_col])


def decode(df, path: str, id_col: str = "doc_id", ids_col: str = "ids"):
    """Per row: id, text of the ids (null: empty)."""

    def run(batches):
        model = load(path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind(df, id_col)}, text string")


def round_trip(df, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: id, n_tokens, and digests of the ids and of the text decoded from them; ids stay inside the task."""

    def kernel(block, data, offsets):
        model = load(path)
        ids, n = model.encode(data, offsets)
        first = np.concatenate([[0], np.cumsum(n)])
        names, name_end = model.names(ids), np.concatenate([[0], np.cumsum(model.name_size[ids])])[first]
        text, text_end = model.decode_bytes(ids), np.concatenate([[0], np.cumsum(model.size_of[ids])])[first]
        names, text = memoryview(names), text.tobytes()
        a = [hashlib.sha256(names[s : max(s, e - 1)]).hexdigest() for s, e in zip(name_end[:-1].tolist(), name_end[1:].tolist())]
        b = [hashlib.sha256(text[s:e].decode("utf-8", "replace").encode()).hexdigest() for s, e in zip(text_end[:-1].tolist(), text_end[1:].tolist())]
        return [pa.array(n), pa.array(a), pa.array(b)]

    return map_text(df, text_col, kernel, f"`{id_col}` {kind(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string", [id_col])
