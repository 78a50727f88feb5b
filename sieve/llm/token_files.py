"""Token-id files: raw id payloads with a minimal perfect hash index over the document keys.

A shard holds the documents of a range of keys in ascending order.  Its file is, all little-endian:

* 8 uint64: magic, documents, distinct keys, ids, levels, words of bits, bytes of an id (2 or 4), 0
* uint64[levels]: positions of each level of the hash
* uint64[words]: the levels' bits, one after another
* uint32[words]: the bits set before each word
* uint32[keys]: fingerprint of each key, by hash value
* uint32[keys]: the first document of each key, by hash value
* uint64[documents + 1]: where each document's ids start
* uint64[documents] and uint8[documents]: keys as 64-bit patterns, and 1 for a null key
* uint16[ids] or uint32[ids]: the payload, of two bytes an id if the vocabulary has at most 2**16

The hash is built level by level: a key goes to a position of the level, positions with one key are
kept, and the others' keys go to the next level; the rank of a key's bit is its value.  A lookup tests one bit
a level, ranks it by the stored count and the bits of one word, compares the 32-bit fingerprint, then the stored key: nothing of the
file is read besides, so it takes constant time in the number of documents.

Beside the shards the folder holds ``manifest``, a Parquet table of them with the first key of each: ``Reader`` maps a key to its shard by
these bounds, and to its ids by the shard's hash.

Rows are dealt by ranges of (key, hash of the text), so many rows of one key are many shards' work as well.  Shards are encoded and written by
tasks through the file system of the folder under a name of their own and
then renamed, so a task that runs again writes the same file again and a lost executor costs nothing that is done.

Defined cases: null or empty text: only the end id; a null key sorts first and can be looked up as None; repeated keys
stand side by side, ordered by hash of text and text, and a lookup gives the first; an empty table writes no file and
gives an empty table; other columns play no part; tokenisers of up to 2**32 ids.
"""

from __future__ import annotations

import os
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa

from ._jobs import materialise, shared_folder, small_batches
from ._text import BLOCK, SPACE_WORD, WordCache, blocks, distinct, gather, mix, ragged, words
from .bpe import LETTER, NUMBER, char_classes

MAGIC = 0x3253444954564953
SHARD_BYTES = 12 << 20  # bytes of text for each shard
U64 = np.uint64


# ---- minimal perfect hash --------------------------------------------------------------------


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 1, U64) * U64(0x9E3779B97F4A7C15))) % U64(size)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + U64(0xD1B54A32D192ED03)) >> U64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their bits, for distinct uint64 keys."""
    sizes, bits, left, level = [], [], keys, 0
    while len(left):
        size = max(64, -(-2 * len(left) // 64) * 64)
        p = _position(left, level, size)
        count = np.bincount(p, minlength=size)
        bits.append(count == 1)
        sizes.append(size)
        left = left[count[p] != 1]
        level += 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


class Index:
    """Lookup of keys by the levels of ``build_hash``, as words of 64 bits and the number of bits set before each word."""

    def __init__(self, sizes: list[int], words: np.ndarray, before: np.ndarray):
        self.sizes, self.words, self.before = sizes, words, before

    @classmethod
    def of(cls, sizes: list[int], bits: np.ndarray) -> Index:
        words = np.packbits(bits, bitorder="little").view("<u8")
        count = np.bitwise_count(words)
        return cls(sizes, words, (np.cumsum(count, dtype=np.int64) - count).astype("<u4"))

    def value(self, keys: np.ndarray) -> np.ndarray:
        """Hash value of each key, -1 if none of its bits is set (then it isn't a key)."""
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            p = base + _position(keys[open_], level, size)
            word, bit = self.words[p >> 6], (p & 63).astype(U64)
            hit = (word >> bit & U64(1)).astype(bool)
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[open_[hit]] = self.before[p[hit] >> 6].astype(np.int64) + below[hit]
            open_ = open_[~hit]
            base += size
        return out


# ---- a shard ---------------------------------------------------------------------------------


def _patterns(keys: list) -> tuple[np.ndarray, np.ndarray]:
    null = np.array([k is None for k in keys], bool)
    return np.array([0 if k is None else int(k) & 0xFFFFFFFFFFFFFFFF for k in keys], U64), null


def _hashed(pattern: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Distinct 64-bit values of the keys: null gets a value that mixing gives to no small integer."""
    return np.where(null, U64(0xA5A5A5A55A5A5A5B), mix(pattern + U64(1)))


def pack(keys: list, payloads: list[np.ndarray], width: int = 4) -> bytes:
    """File image of documents given in their order; ``width``: bytes of an id."""
    pattern, null = _patterns(keys)
    hashed = _hashed(pattern, null)
    keys_, first = np.unique(hashed, return_index=True)
    sizes, bits = build_hash(keys_)
    index = Index.of(sizes, bits)
    value = index.value(keys_)
    prints, slots = np.zeros(len(keys_), np.uint32), np.zeros(len(keys_), np.uint32)
    prints[value], slots[value] = _fingerprint(keys_), first
    start = np.concatenate([[0], np.cumsum([len(p) for p in payloads])]).astype(U64)
    head = np.array([MAGIC, len(keys), len(keys_), int(start[-1]), len(sizes), len(index.words), width, 0], U64)
    body = np.concatenate([np.zeros(0, np.uint32), *payloads]).astype(f"<u{width}")
    return b"".join(x.tobytes() for x in (head, np.array(sizes, U64), index.words, index.before, prints, slots, start, pattern, null.astype(np.uint8), body))


class Shard:
    """A shard's file image, read in place: only the head is looked at before a lookup."""

    def __init__(self, image):
        head = np.frombuffer(image, U64, 8)
        if int(head[0]) != MAGIC:
            raise ValueError("not a token-id file")
        n, k, ids, levels, w, width = (int(x) for x in head[1:7])
        at = 64

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(image, kind, count, at)
            at += out.nbytes
            return out

        sizes = take(U64, levels).astype(np.int64).tolist()
        self.index = Index(sizes, take("<u8", w), take("<u4", w))
        self.prints, self.slots = take(np.uint32, k), take(np.uint32, k)
        self.start = take(np.int64, n + 1)
        self.pattern, self.null = take(U64, n), take(np.bool_, n)
        self.payload = take(f"<u{width}", ids)

    def find(self, keys: list) -> np.ndarray:
        """The first document of each key, -1 if it isn't here."""
        pattern, null = _patterns(keys)
        hashed = _hashed(pattern, null)
        value = self.index.value(hashed)
        if not len(self.slots):
            return value
        safe = np.maximum(value, 0)
        slot = self.slots[safe].astype(np.int64)
        same = (value >= 0) & (self.prints[safe] == _fingerprint(hashed)) & (self.pattern[slot] == pattern) & (self.null[slot] == null)
        return np.where(same, slot, -1)

    def ids(self, document: int) -> np.ndarray:
        return self.payload[self.start[document] : self.start[document + 1]].astype("<u4")


# ---- encoding --------------------------------------------------------------------------------


class WordEncoder:
    """The tokenizers library, run on each distinct word between ASCII white space and remembered.

    For a model whose pre-tokens hold no white space, a text's ids are its words' ids one after another.  Distinct words
    go to the library many at a time.  Words of letters, ASCII digits and ASCII signs (without apostrophes and ``<``) have a known
    number of pre-tokens, each of which ends with a token that ends a word: they are joined by spaces and cut apart at
    those.  Other words are encoded one by one.
    """

    TOGETHER = 2000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part; threads of the library cost memory
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        for text in ("a b", "a  b\n\tc. d'e", " a ", "x1 22 ,.;é <|endoftext|>z"):
            whole = self.model.encode(text, add_special_tokens=False).ids
            if whole != [i for w in text.split() for i in self.model.encode(w, add_special_tokens=False).ids]:
                raise ValueError("this model's tokens depend on the white space around words")
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        names = self.model.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in names.items() if t.endswith(suffix)]] = True
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4  # bytes of an id
        self.cache = WordCache(800_000)

    def pretokens(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pre-tokens of each word, 0 where that isn't plain: runs of letters or of signs, and single digits."""
        at, c = char_classes(data)
        byte = data[at]
        odd = (byte == 39) | (byte == 60) | ((byte >= 0x80) & (c != LETTER))
        opens = np.ones(len(at), bool)
        opens[1:] = (c[1:] != c[:-1]) | (c[1:] == NUMBER)
        a, b = np.searchsorted(at, start), np.searchsorted(at, end)
        opens[a] = True
        runs, strange = (np.concatenate([[0], np.cumsum(x)]) for x in (opens, odd))
        return np.where(strange[b] > strange[a], 0, runs[b] - runs[a])

    def _apart(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), self.TOGETHER) for e in self.model.encode_batch_fast(texts[i : i + self.TOGETHER], add_special_tokens=False)]

    def _words(self, texts: list[str], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and how many each has; count: their pre-tokens, 0 if unknown."""
        size = np.zeros(len(texts), np.int64)
        parts, done = [], []  # ids, and the words they belong to
        plain = np.flatnonzero((count > 0) & self.ends.any())
        rest = [np.flatnonzero((count == 0) | (not self.ends.any()))]
        for i in range(0, len(plain), self.TOGETHER):
            own = plain[i : i + self.TOGETHER]
            ids = np.array(self.model.encode_batch_fast([" ".join([texts[j] for j in own])], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != count[own].sum() or cut[-1] != len(ids):
                rest.append(own)  # not as expected: these go one by one
                continue
            size[own] = np.diff(cut[np.cumsum(count[own]) - 1], prepend=0)
            parts.append(ids)
            done.append(own)
        rest = np.concatenate(rest)
        for j, x in zip(rest.tolist(), self._apart([texts[j] for j in rest])):
            size[j] = len(x)
            parts.append(np.array(x, np.int32))
        done = np.concatenate([*done, rest])
        flat = np.concatenate([np.zeros(0, np.int32), *parts])
        where = np.empty(len(texts), np.int64)  # start of each word in flat
        where[done] = np.cumsum(size[done]) - size[done]
        return flat[ragged(where, size)], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and how many each text has."""
        start, end, first = words(data, offsets, SPACE_WORD)
        found = distinct(data, start, end)

        def unknown(new):
            size = found.size[new]
            own, stop = data[ragged(found.start[new], size)], np.cumsum(size)
            return self._words(gather(own, stop - size, size).to_pylist(), self.pretokens(own, stop - size, stop))

        rows = self.cache.rows(found, unknown)
        ids, size = self.cache.ids(rows[found.entry])
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[first])


_loaded: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


# ---- jobs ------------------------------------------------------------------------------------


def _store(folder: str):
    """(file system, path) of a folder with a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, image: bytes) -> None:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(image)
    store.move(own, f"{path}/{name}")


def qualified(spark, folder: str) -> str:
    """A folder with the scheme of Spark's file system for it, for readers other than Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def write_token_files(df, path: str, folder: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES):
    """Encode and write every row; gives the written table of shards (shard, documents, ids, first_key).

    The key must be an integer column.  Texts are shuffled once, by ranges that Spark draws from a bounded sample of keys.
    """
    from pyspark.sql import functions as F

    spark = df.sparkSession
    folder = qualified(spark, folder)
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    shards = max(1, min(-(-size["b"] // shard_bytes), size["n"] or 1))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        encoder = _encoder(path)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        keys, payloads = [], []
        for batch in batches:
            for block, data, offsets in blocks(batch, "text", BLOCK // 2):
                ids, n = encoder.encode(data, offsets)
                keys += block.column(0).to_pylist()
                payloads += [np.concatenate([x, end]).astype(f"<u{encoder.width}") for x in np.split(ids, np.cumsum(n)[:-1])]
        if keys:
            own = TaskContext.get().partitionId()
            _put(folder, f"shard-{own:08d}.tok", pack(keys, payloads, encoder.width))
            columns = [pa.array([own], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([sum(map(len, payloads))], pa.int64()), pa.array(keys[:1], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "documents", "ids", "first_key"])

    with small_batches(spark, 2000):
        dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


MANIFEST = "shard long, documents long, ids long, first_key long"


class Reader:
    """Keyed access to a folder of token-id files: ``get`` gives the ids of documents by their keys."""

    def __init__(self, folder: str, keep: int = 64):
        from pyarrow import parquet

        self.store, self.path = _store(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        rows = parquet.read_table(f"{self.path}/manifest", filesystem=self.store, columns=["shard", "first_key"]).sort_by("shard")
        self.shards = rows.column("shard").to_pylist()
        self.bounds = [self._order(k) for k in rows.column("first_key").to_pylist()]
        self.keep, self.open = keep, {}

    @staticmethod
    def _order(key: int | None) -> tuple[bool, int]:
        return key is not None, key or 0

    def _shard(self, i: int) -> Shard:
        if i not in self.open:
            if len(self.open) >= self.keep:
                del self.open[next(iter(self.open))]
            name = f"{self.path}/shard-{self.shards[i]:08d}.tok"
            local = self.store.type_name == "local"
            with pa.memory_map(name) if local else self.store.open_input_file(name) as f:
                self.open[i] = Shard(f.read_buffer())
        return self.open[i]

    def get(self, keys: list[int | None]) -> list[np.ndarray | None]:
        """The ids of each key's first document, None for keys that aren't there."""
        out: list = [None] * len(keys)
        asked: dict[int, list[int]] = {}
        for j, key in enumerate(keys):
            i = bisect_left(self.bounds, self._order(key))  # the first shard that starts at the key or after it
            if i < len(self.bounds) and self.bounds[i] == self._order(key):
                asked.setdefault(i, []).append(j)
            if i:
                asked.setdefault(i - 1, []).append(j)  # the one before may end with the key
        for i in sorted(asked):
            shard = self._shard(i)
            for j, document in zip(asked[i], shard.find([keys[j] for j in asked[i]]).tolist()):
                if document >= 0 and out[j] is None:
                    out[j] = shard.ids(document)
        return out


def read_token_files(spark, folder: str, id_col: str = "doc_id"):
    """Per document in the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    Every document is found through the index of its shard; shards follow one another in the order of their names.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = int(batch.column(0)[i].as_py().rpartition("shard-")[2].partition(".")[0])
                s = Shard(batch.column(1)[i].as_buffer())
                keys = [None if z else int(p) for p, z in zip(s.pattern.astype(np.int64), s.null)]
                first = s.find(keys)  # repeated keys: the first of them
                own = np.arange(len(keys))
                if (first < 0).any() or (s.pattern[first] != s.pattern[own]).any():
                    raise ValueError(f"shard {shard}: the index doesn't find its keys")
                crc = [zlib.crc32(memoryview(s.ids(d))) for d in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), shard)), pa.array(keys, pa.int64()), pa.array(s.start[:-1]), pa.array(np.diff(s.start)), pa.array(crc, pa.int64())],
                    names=["shard", id_col, "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    with small_batches(spark, 4):
        found = materialise(files.mapInArrow(run, f"shard long, `{id_col}` long, at long, n_tokens long, ids_crc32 long"), "found")
    # starts of shards in two steps, neither of which sees a row for each document: blocks of shards, then shards in their block
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.shiftright("shard", 12))
    blocks_ = totals.groupBy("block").agg(F.sum("n").alias("n"))
    blocks_ = blocks_.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("shard")) - F.col("n")
    base = totals.select("shard", "block", inside.alias("inside")).join(blocks_, "block").select("shard", (F.col("before") + F.col("inside")).alias("base"))
    return found.join(base, "shard").select(id_col, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, folder: str | None = None):
    """Write a table's token-id files to a new folder of the shared one, and read them back."""
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    shards = write_token_files(df, path, folder, end_id, id_col, text_col)
    if shards.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, id_col)
