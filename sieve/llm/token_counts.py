"""Token counts of fields or sections, from one encoding of the whole document.

The whole text is encoded once; every token keeps the span of characters it stands for.  The spans are
joined with the spans of the sections by their offsets, and a token that crosses a boundary is given
to one section by the rule: ``start`` (the section of its first character, the default), ``end`` (of its last)
or ``most`` (the one with most of its characters, the first of equals).  So the counts of the sections
add up to the document's tokens, which separate encodings of the sections do not.

A section is a line with the ``\\n`` that ends it (``count_sections``), or a field with the separator after
it (``count_fields``).  A token that holds a part of a character's bytes counts as a span of
that character.

Defined cases: a null or empty text has no tokens and no sections; a null field counts as
empty and keeps its place; equal rows give equal results, one per row; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._text import blocks, kind, map_text
from .bpe import load

RULES = ("start", "end", "most")


def attribute(model, data: np.ndarray, offsets: np.ndarray, section: np.ndarray, rule: str):
    """Tokens of each document and section, and crossing tokens of each document.

    ``section`` holds the ascending byte positions where sections start; every document's start is among them
    unless the document is empty.
    """
    ids, n = model.encode(data, offsets)
    size = model.size_of[ids]
    end = np.cumsum(size)
    start = end - size
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that start before a byte
    first_char, last_char = leads[start + 1] - 1, leads[end] - 1
    section_char = leads[section]
    a = np.searchsorted(section_char, first_char, "right") - 1
    b = np.searchsorted(section_char, last_char, "right") - 1
    if rule == "start":
        own = a
    elif rule == "end":
        own = b
    else:
        bound = np.append(section_char, leads[-1])
        own, most = a.copy(), bound[a + 1] - first_char
        step = 1
        while (open_ := a + step <= b).any():
            k = np.minimum(a + step, b)
            part = np.where(open_, np.minimum(bound[k + 1], last_char + 1) - section_char[k], 0)
            better = part > most
            own[better], most = k[better], np.maximum(part, most)
            step += 1
    doc_of = np.repeat(np.arange(len(n)), n)
    tokens = np.bincount(own, minlength=len(section)).astype(np.int64)
    crossing = np.bincount(doc_of[a != b], minlength=len(n)).astype(np.int64)
    chars = np.diff(np.append(section_char, leads[-1]))
    return n, tokens, crossing, chars


def _line_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    after = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([offsets[:-1], after]))
    return bounds[bounds < len(data)]


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def count_sections(df, path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "start"):
    """Per row: id, n_tokens, n_sections, n_crossing, and for each line its characters and tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def kernel(block, data, offsets):
        section = _line_starts(data, offsets)
        n, tokens, crossing, chars = attribute(load(path), data, offsets, section, rule)
        first = np.searchsorted(section, offsets, "left")
        return [pa.array(n), pa.array(np.diff(first).astype(np.int64)), pa.array(crossing), _lists(chars, first), _lists(tokens, first)]

    ddl = f"`{id_col}` {kind(df, id_col)}, n_tokens long, n_sections long, n_crossing long, section_chars array<long>, section_tokens array<long>"
    return map_text(df, text_col, kernel, ddl, [id_col])


def count_fields(df, path: str, fields: list[str], id_col: str = "doc_id", separator: str = "\n", rule: str = "start"):
    """Per row: id, n_tokens of the fields joined by the separator, n_crossing, and tokens per field in the order of ``fields``.

    A field that comes out empty together with its separator (only the last can) has no token.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    from pyspark.sql import functions as F

    cols = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    sizes = F.array(*[F.octet_length(c).cast("long") + (len(separator.encode()) if i < len(fields) - 1 else 0) for i, c in enumerate(cols)])
    rows = df.select(F.col(id_col).alias("_id"), F.concat_ws(separator, *cols).alias("_text"), sizes.alias("_sizes"))

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, "_text"):
                part = np.array(block.column(2).to_pylist(), np.int64).reshape(-1, len(fields))
                at = (offsets[:-1, None] + np.cumsum(part, 1) - part).reshape(-1)
                real = np.flatnonzero(part.reshape(-1) > 0)
                n, tokens, crossing, _ = attribute(load(path), data, offsets, at[real], rule)
                counts = np.zeros(len(at), np.int64)
                counts[real] = tokens
                first = np.arange(block.num_rows + 1) * len(fields)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n), pa.array(crossing), _lists(counts, first)], names=[id_col, "n_tokens", "n_crossing", "field_tokens"])

    return rows.mapInArrow(run, f"`{id_col}` {kind(df, id_col)}, n_tokens long, n_crossing long, field_tokens array<long>")
