"""Quality rules: counts of a text, and the fertility of a public tokeniser on it.

A document is rejected by the base rules (too few words, or mostly repeated
three-word windows) or by the tokeniser: characters per token, the share of
tokens that are byte fallbacks, and the entropy of the token distribution must lie
in the band of the document's language.  Every word is encoded by a SentencePiece
model as a text of its own, so a distinct word is encoded once per block of text and
remembered; the figures cover all words of the whole text.

Defined cases: a null or empty text has no words, all counts are 0 and it is rejected
(fewer than ``min_words`` words); a null or unknown language uses the band ``"*"``;
equal rows give equal results, one per row; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

from ._text import SPACE_WORD, WordCache, distinct, kind, map_text, mix, per_doc, slices, words

#: language -> least and most characters per token, most share of byte-fallback tokens, least and most
#: evenness (entropy of the tokens over that of equally frequent ones).  Fixed bands, set with a
#: margin outside what rows labelled as good show, so that clean text stays.
BANDS = {
    "en": (1.75, 6.0, 0.05, 0.715, 1.5),
    "de": (1.85, 6.0, 0.05, 0.690, 1.5),
    "fr": (1.70, 6.0, 0.05, 0.680, 1.5),
    "es": (1.62, 6.0, 0.05, 0.695, 1.5),
    "*": (0.5, 12.0, 0.50, 0.5, 1.5),
}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Entropy is measured against that of this many equally frequent tokens, or of the text's tokens if fewer.
_EVEN_TOKENS = 400


class Fertility:
    """Pieces of distinct words under one SentencePiece model, kept for the words seen lately."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.cache = WordCache()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.model.encode(texts, num_threads=1)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.fromiter(chain.from_iterable(pieces), np.int32, int(size.sum())), size


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each document of a block, and the words found."""
    start, end, first = words(data, offsets, SPACE_WORD)
    found = distinct(data, start, end)
    n_words = np.diff(first)
    leads = (data & 0xC0) != 0x80
    inside = SPACE_WORD[data] & leads
    doc = np.repeat(np.arange(len(n_words)), n_words)
    again = np.zeros(len(start), bool)
    if len(start) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        twice = at[_again(doc[at], *(found.entry[at + j] for j in range(3)))[0]]
        for j in range(3):
            again[twice + j] = True
    # lines: runs between \n and ends of documents
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    # an empty document has one empty line, and a \n at the very end of a document starts an empty line;
    # starts and ends pair up because both lists hold one entry per line, in order
    filled = np.searchsorted(start, ends, "left") > np.searchsorted(start, line_start, "left")
    line_start, ends = line_start[filled], ends[filled]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    later = _again(line_doc, distinct(data, line_start, ends).entry)[1]
    n_lines = len(n_words)
    return {
        "n_words": n_words,
        "word_chars": per_doc(inside, offsets),
        "n_symbols": per_doc(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_doc[later], minlength=n_lines).astype(np.int64),
        "n_repeat_words": per_doc(again, first),
        "words": found,
        "first": first,
        "doc": doc,
    }


def _again(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the rows found twice or more, and of those with an equal one before."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + c.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    i, j = order[:-1][same], order[1:][same]
    if not all((c[i] == c[j]).all() for c in columns):  # different rows with one hash: sort the rows themselves
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
    later = np.zeros(len(h), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def fertility(counts: dict, data: np.ndarray, pieces: Fertility) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and entropy in bits for each document of a block."""
    found = counts["words"]
    rows = pieces.cache.rows(found, lambda new: pieces.encode(slices(data, found.start[new], found.size[new])))
    ids, size = pieces.cache.ids(rows[found.entry])
    n_tokens = per_doc(size, counts["first"])
    n_docs = len(counts["n_words"])
    token_doc = np.repeat(np.arange(n_docs), n_tokens)
    n_bytes = np.bincount(token_doc[pieces.is_byte[ids]], minlength=n_docs)
    key = np.sort(token_doc * len(pieces.is_byte) + ids)
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    c = np.diff(edges).astype(float)
    d = key[edges[:-1]] // len(pieces.is_byte) if len(key) else np.zeros(0, np.int64)
    clogc = np.bincount(d, c * np.log2(np.maximum(c, 1)), minlength=n_docs)
    n = np.maximum(n_tokens, 1)
    return n_tokens, n_bytes, np.log2(n) - clogc / n


def judge(block: pa.RecordBatch, data, offsets, pieces: Fertility, lang: str | None, min_words: int, max_repeat: float, bands: dict) -> dict:
    """All figures and verdicts for a block of documents."""
    c = base_counts(data, offsets)
    n_tokens, n_bytes, entropy = fertility(c, data, pieces)
    n = np.maximum(n_tokens, 1)
    per_token = c["word_chars"] / n
    share = n_bytes / n
    even = np.where(n_tokens > 1, entropy / np.log2(np.clip(n, 2, _EVEN_TOKENS)), 1.0)
    langs = block.column(block.schema.get_field_index(lang)).to_pylist() if lang else [None] * block.num_rows
    band = np.array([bands.get(x, bands["*"]) for x in langs]).reshape(-1, 5)
    failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat * c["n_words"])
    kept = ~failed & (per_token >= band[:, 0]) & (per_token <= band[:, 1]) & (share <= band[:, 2]) & (even >= band[:, 3]) & (even <= band[:, 4] + 1e-9)
    return c | {"base_failed": failed, "kept": kept, "n_tokens": n_tokens, "chars_per_token": per_token, "byte_share": share, "evenness": even}


_OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "evenness")
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, evenness double"
_loaded: dict[str, Fertility] = {}


def _pieces(model: str) -> Fertility:
    if model not in _loaded:
        _loaded[model] = Fertility(model)
    return _loaded[model]


def quality_rules(df, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", min_words: int = 50, max_repeat: float = 50, bands: dict | None = None):
    """One row per input row: the id, the counts, the tokeniser's figures and the verdict ``kept``."""
    bands = BANDS if bands is None else bands
    keep = [id_col]

    def kernel(block, data, offsets):
        r = judge(block, data, offsets, _pieces(model), lang_col, min_words, max_repeat, bands)
        return [pa.array(r[k]) for k in _OUT]

    ddl = f"`{id_col}` {kind(df, id_col)}, {_DDL}"
    if lang_col is None:
        return map_text(df, text_col, kernel, ddl, keep)
    return map_text(df, text_col, kernel, ddl, keep, extra=[lang_col])


def keep_good(df, model: str, text_col: str = "text", lang_col: str | None = "lang", min_words: int = 50, max_repeat: float = 50, bands: dict | None = None):
    """The rows that pass the rules, with all their columns."""
    bands = BANDS if bands is None else bands
    from ._text import blocks

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, text_col):
                yield block.filter(pa.array(judge(block, data, offsets, _pieces(model), lang_col, min_words, max_repeat, bands)["kept"]))

    return df.mapInArrow(run, df.schema)
