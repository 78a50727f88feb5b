"""Quality classifier: averaged vectors of hashed words and character n-grams, a softmax over two classes, trained by SGD.

Every word (run of characters other than ASCII white space) has features: itself, its n-grams of 3 and 4 characters,
its first and last two characters, and a mark if it equals the word before it; each is hashed into a row of one table
of ``DIM``-dimensional vectors (the mark has the last row).
A document is the average of the rows of all features of all its words, and a linear softmax over the average
gives the class.  Table and softmax are learned together by stochastic gradient descent in numpy.

Training uses labelled rows with crc32(id as text) mod 3 <> 1 only: at most ``max_rows`` of them, the first by hash of
the id, with texts of at most ``max_bytes`` bytes, so what reaches the driver is bounded by
max_rows * max_bytes.  Labels, language, source and id play no part in a score.  As the softmax is linear, a score needs
one number for each table row (the difference of the classes' logits), which is broadcast: 8 * ``BUCKETS`` bytes.

Defined cases: null, empty or blank texts have no feature and get the training rows' share of label 1; without training
rows of both classes every score is that share (0.5 without any); null labels are left out, of several labels of one id the
least counts; null ids are never held out and never labelled; equal texts get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._text import BLOCK, SPACE_WORD, Prefix, blocks, kind, map_text, mix, ragged, words

DIM = 16
BUCKETS = 1 << 18
EPOCHS = 5
RATE = 0.6
U64 = np.uint64


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: Prefix) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the features of each word, flat, and how many each word has."""
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    a, b = np.searchsorted(lead, start), np.searchsorted(lead, end)
    n = b - a
    parts = [(np.arange(len(start)), prefix.hash(start, end))]
    for k in (3, 4):
        count = np.maximum(n - k + 1, 0)
        at = ragged(a, count)
        parts.append((np.repeat(np.arange(len(start)), count), prefix.hash(lead[at], lead[at + k]) ^ U64(k)))
    for salt, at in ((0x5151, a), (0xA3A3, b - 2)):
        long = np.flatnonzero(n >= 2)
        parts.append((long, mix(prefix.hash(lead[at[long]], lead[at[long] + 2]) + U64(salt))))
    word = np.concatenate([p[0] for p in parts])
    row = (np.concatenate([p[1] for p in parts]) % U64(BUCKETS)).astype(np.int32)
    order = np.argsort(word, kind="stable")
    return row[order], np.bincount(word, minlength=len(start))


def documents_features(data: np.ndarray, offsets: np.ndarray):
    """(distinct words' rows flat, rows of each, word of each occurrence, first occurrence of each document, occurrences marked as repeats)."""
    start, end, first = words(data, offsets, SPACE_WORD)
    prefix = Prefix(data)
    _, index, inverse = np.unique(prefix.hash(start, end), return_index=True, return_inverse=True)
    flat, count = word_features(data, start[index], end[index], prefix)
    again = np.zeros(len(inverse), bool)
    again[1:] = inverse[1:] == inverse[:-1]
    again[first[:-1][first[:-1] < len(inverse)]] = False
    return flat, count, inverse, first, again


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Difference of the logits (label 1 less label 0) of each table row, and last the prior log-odds."""
    share = labels.mean() if len(labels) else 0.5
    prior = np.log((share + 1e-9) / (1 - share + 1e-9)) if 0 < share < 1 else (-20.0, 20.0)[share >= 1]
    if len(labels) == 0:
        prior = 0.0
    out = np.zeros(BUCKETS + 2)
    out[-1] = prior
    if not 0 < share < 1:
        return out
    bags = []
    for block, data, offsets in blocks(pa.record_batch({"text": texts}), "text", BLOCK // 4):
        flat, count, inverse, first, again = documents_features(data, offsets)
        where = np.cumsum(count) - count
        for d in range(block.num_rows):
            own = inverse[first[d] : first[d + 1]]
            marks = np.full(int(again[first[d] : first[d + 1]].sum()), BUCKETS, np.int32)
            rows, n = np.unique(np.concatenate([flat[ragged(where[own], count[own])], marks]), return_counts=True)
            bags.append((rows, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    soft = np.zeros((2, DIM), np.float32)
    weight = 0.5 / np.array([1 - share, share])  # both classes weigh alike
    step, steps = 0, EPOCHS * len(labels)
    for _ in range(EPOCHS):
        for d in rng.permutation(len(labels)):
            rate = RATE * (1 - step / steps)
            step += 1
            rows, w = bags[d]
            if not len(rows):
                continue
            own = table[rows]
            h = w @ own
            z = soft @ h
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[d]] -= 1
            g = np.float32(rate * weight[labels[d]]) * p
            back = g @ soft
            soft -= np.outer(g, h)
            table[rows] = own - np.outer(w * np.float32(len(rows) ** 0.5), back)  # rare shares still move their rows
    out[:-1] = table @ (soft[1] - soft[0])
    return out


def scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    flat, count, inverse, first, again = documents_features(data, offsets)
    n = len(offsets) - 1
    per_word = np.bincount(np.repeat(np.arange(len(count)), count), weights[flat], minlength=len(count))
    doc = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(doc, per_word[inverse] + weights[-2] * again, minlength=n)
    size = np.bincount(doc, count[inverse] + again, minlength=n)
    logit = np.where(size > 0, total / np.maximum(size, 1), weights[-1])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def held_out(id_col: str):
    """Column: crc32 of the id as text has remainder 1 modulo 3."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit(df, labels, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 6000, max_bytes: int = 20_000) -> np.ndarray:
    """Weights learned from at most ``max_rows`` labelled rows that aren't held out."""
    from pyspark.sql import functions as F

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_i")).agg(F.min(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_i"), "_i").limit(max_rows)
    rows = df.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).where(F.octet_length("_t") <= max_bytes)
    picked = rows.join(F.broadcast(known), "_i").orderBy(F.xxhash64("_i"), "_i", "_t").limit(max_rows).select("_t", "_y").toArrow()
    if not picked.num_rows:
        return train(pa.array([], pa.string()), np.zeros(0, np.int64))
    return train(picked.column(0).combine_chunks(), np.asarray(picked.column(1)).astype(np.int64))


def classify(df, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: id, held_out, score (0 to 1, higher: label 1 likelier), predicted."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def kernel(block, data, offsets):
        s = scores(shared.value, data, offsets)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    rows = df.withColumn("_held", held_out(id_col))
    out = map_text(rows, text_col, kernel, f"`{id_col}` {kind(df, id_col)}, held_out boolean, score double, predicted int", [id_col, "_held"])
    return out
