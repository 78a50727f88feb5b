"""URL filter: rules and listed URLs held as sorted arrays of 64-bit xxhash digests.

An index is one file image: the sorted digests, the offsets and the bytes of the full strings.  A worker writes it
to a scratch file of its own once and memory-maps it.  A probe hashes its candidate strings, finds them by vectorised binary search,
and confirms each hit against the stored string, so a digest collision can't decide a verdict.

A rule is (verdict, host, path): it fits its host and all subdomains where the path
of the URL starts with the rule's.  The longest fitting rule string (host + path)
wins, then the one with the longer host, then block before allow.  Where no rule fits, the list decides: ``block`` if the URL's host,
or its host + path, is an entry, else ``allow``.  Hosts of rules, entries and URLs are lower-cased in A-Z and nowhere else.

The list may be a Python list or a table of any size, with the same result.  One whose index has at most ``MAX_BROADCAST`` bytes is broadcast.
The index of a larger one is written to the shared folder in shards by the first bits of the digest; the distinct strings
that URLs without a rule ask for meet their shard, and those found are joined to the URLs again.  Digests spread evenly and the number of shards follows both
sides, so no shard is large, whatever hosts are common.

Defined cases: null, or no ``://``: host and path are empty, no rule fits, ``allow``.
Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased
(a port or user name stays part of it); path: from there up to ``?``, ``#`` or the end.
Null and empty entries fit nothing; an empty list allows.
Equal rows give equal results, one per row; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash

from ._jobs import materialise
from ._text import LOWER, blocks, column_bytes, distinct, gather, kind, ragged

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_BROADCAST = 64 << 20
SHARD_BYTES = 4 << 20  # of an index
SHARD_PROBES = 100_000
BROADCAST_ROWS = 500_000
_UPPER, _LOW = (bytes(range(a, a + 26)).decode() for a in (65, 97))
_ASCII_LOWER = str.maketrans(_UPPER, _LOW)


# ---- index -----------------------------------------------------------------------------------


def digest(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))


def build_index(strings: list[bytes]) -> bytes:
    """File image: count, digests in ascending order, offsets, strings in that order."""
    strings = sorted(set(strings))
    d = digest(strings)
    order = np.argsort(d, kind="stable")
    body = [strings[i] for i in order]
    offsets = np.zeros(len(body) + 1, np.uint64)
    offsets[1:] = np.cumsum([len(x) for x in body], dtype=np.uint64)
    return np.uint64(len(body)).tobytes() + d[order].tobytes() + offsets.tobytes() + b"".join(body)


class DigestIndex:
    """A memory-mapped index image."""

    def __init__(self, image: bytes):
        path = os.path.join(tempfile.gettempdir(), f"urls-{hashlib.sha256(image).hexdigest()[:16]}-{os.getpid()}.idx")
        with open(path, "wb") as f:
            f.write(image)
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        os.unlink(path)  # the mapping stays; nothing is left behind in the scratch folder
        n = int(np.frombuffer(self.map, np.uint64, 1)[0])
        self.digests = np.frombuffer(self.map, np.uint64, n, 8)
        self.offsets = np.frombuffer(self.map, np.uint64, n + 1, 8 + 8 * n)
        self.base = 8 + 8 * n + 8 * (n + 1)

    def string(self, i: int) -> bytes:
        return self.map[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])]

    def place(self, strings: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """The place of each string in the index, -1 if it isn't there."""
        d = digest(strings) if digests is None else digests
        out = np.full(len(d), -1, np.int64)
        lo, hi = (np.searchsorted(self.digests, d, side) for side in ("left", "right"))
        for i in np.flatnonzero(hi > lo):
            out[i] = next((j for j in range(lo[i], hi[i]) if self.string(j) == strings[i]), -1)
        return out


_loaded: dict = {}


def _index(image: bytes) -> DigestIndex:
    """The index of an image, mapped once in a process; a large one is known by the object, which a broadcast keeps."""
    key = hashlib.sha256(image).hexdigest() if len(image) < 1 << 16 else id(image)
    if key not in _loaded:
        _loaded[key] = (DigestIndex(image), image)
    return _loaded[key][0]


# ---- a block of URLs -------------------------------------------------------------------------


def split_urls(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with hosts lower-cased, and where each URL's host starts, its path starts and its path ends."""
    end = offsets[1:]

    def first(places: np.ndarray, start: np.ndarray) -> np.ndarray:
        at = np.searchsorted(places, start)
        return np.minimum(np.append(places, len(data))[at], end)

    marks = np.flatnonzero((data[:-2] == 58) & (data[1:-1] == 47) & (data[2:] == 47)) if len(data) > 2 else np.zeros(0, np.int64)
    mark = first(marks, offsets[:-1])
    host = np.where(mark + 3 <= end, mark + 3, end)
    path = first(np.flatnonzero((data == 47) | (data == 63) | (data == 35)), host)
    stop = np.where(path < end, first(np.flatnonzero((data == 63) | (data == 35)), path), end)
    low = data.copy()
    at = ragged(host, path - host)
    low[at] = LOWER[data[at]]
    return low, host, path, stop


class Rules:
    """The rules' index, and for each of its strings the verdict, lengths and text."""

    def __init__(self, rules):
        kept: dict[bytes, str] = {}
        for verdict, host, path in rules:
            s = (host.translate(_ASCII_LOWER) + path).encode()
            if host and "/" not in host and path[:1] in ("", "/"):  # no other rule can fit
                kept[s] = "block" if "block" in (verdict, kept.get(s)) else verdict
        self.image = build_index(list(kept))
        order = sorted(kept)
        order = [order[i] for i in np.argsort(digest(order), kind="stable")]  # as in the index
        self.text = [s.decode() for s in order]
        self.verdict = [kept[s] for s in order]
        self.rank = np.argsort(np.argsort([(len(t) << 32) + len(t.partition("/")[0]) for t in self.text], kind="stable"), kind="stable") if order else np.zeros(0, np.int64)
        self.paths = sorted({len(s) - len(s.partition(b"/")[0]) for s in order})

    def decide(self, low: np.ndarray, host: np.ndarray, path: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The place of the deciding rule of each URL, -1 if none fits."""
        best = np.full(len(host), -1, np.int64)
        if not self.text:
            return best
        dots = np.flatnonzero(low == 46) + 1
        lo, hi = np.searchsorted(dots, host, "right"), np.searchsorted(dots, path, "right")
        inside = np.maximum(hi - lo, 0)
        some = np.flatnonzero(path > host)
        row = np.concatenate([some, np.repeat(np.arange(len(host)), inside)])
        start = np.concatenate([host[some], dots[ragged(lo, inside)]])
        rows, starts, ends = [], [], []
        for n in self.paths:
            fits = start < path[row]
            fits &= stop[row] - path[row] >= n
            rows.append(row[fits])
            starts.append(start[fits])
            ends.append(path[row[fits]] + n)
        row, start, end = (np.concatenate(x) for x in (rows, starts, ends))
        place = probe(_index(self.image), low, start, end)
        row, place = row[place >= 0], place[place >= 0]
        order = np.argsort(self.rank[place], kind="stable")
        best[row[order]] = place[order]  # the last written has the greatest rank
        return best


def probe(index: DigestIndex, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place in the index of each byte range, -1 if it isn't there; each distinct one is looked up once."""
    found = distinct(data, start, end)
    raw = data.tobytes()
    place = index.place([raw[s : s + z] for s, z in zip(found.start.tolist(), found.size.tolist())])
    return place[found.entry] if len(place) else np.zeros(0, np.int64)


# ---- jobs ------------------------------------------------------------------------------------


def _normal(entry: str) -> bytes:
    host, slash, path = entry.partition("/")
    return (host.translate(_ASCII_LOWER) + slash + path).encode()


def _split_kernel(rules: Rules, listed, names: list[str]):
    """Rows (id, host, path, rule, verdict) of (id, url); the verdict is null where the list is to decide and ``listed`` is no broadcast."""

    def run(batches):
        for batch in batches:
            for block, data, offsets in blocks(batch, "_url"):
                low, host, path, stop = split_urls(data, offsets)
                best = rules.decide(low, host, path, stop)
                rule = [rules.text[i] if i >= 0 else None for i in best.tolist()]
                verdict = [rules.verdict[i] if i >= 0 else None for i in best.tolist()]
                if listed is not None:
                    index = _index(listed.value)
                    hit = np.zeros(len(best), bool)
                    for end in (path, stop):
                        hit |= (probe(index, low, host, end) >= 0) & (path > host)
                    verdict = [v or ("block" if h else "allow") for v, h in zip(verdict, hit.tolist())]
                columns = [gather(low, host, path - host).cast(pa.string()), gather(low, path, stop - path).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([block.column(0), *columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=names)

    return run


def _digests(batches):
    """Rows (digest, s) of strings."""
    for batch in batches:
        raw, offsets = column_bytes(batch.column(0))
        raw = raw.tobytes()
        d = digest([raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())])
        yield pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), batch.column(0)], names=["digest", "s"])


def _pack(key, table):
    image = build_index([s.encode() for s in table.column("s").to_pylist()])
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "image": pa.array([image], pa.binary())})


def _find(key, probes, images):
    if not images.num_rows or not probes.num_rows:
        return probes.select(["s"]).slice(0, 0)
    index = DigestIndex(images.column("image")[0].as_py())
    strings = [s.encode() for s in probes.column("s").to_pylist()]
    place = index.place(strings, probes.column("digest").to_numpy().view(np.uint64))
    return probes.select(["s"]).filter(pa.array(place >= 0))


def _found(wanted, entries, size: int):
    """The strings of ``wanted`` (s, distinct) that are entries (s, distinct); ``size``: bytes of the entries' index."""
    from pyspark.sql import functions as F

    wanted = materialise(wanted, "wanted")
    shards = max(1, -(-size // SHARD_BYTES), -(-wanted.count() // SHARD_PROBES))
    bits = int(shards - 1).bit_length()

    def dealt(rows):
        rows = rows.mapInArrow(_digests, "digest long, s string")
        return rows.withColumn("shard", F.shiftrightunsigned("digest", 64 - bits) if bits else F.lit(0).cast("long"))

    images = materialise(dealt(entries).groupBy("shard").applyInArrow(_pack, "shard long, image binary"), "images")
    return materialise(dealt(wanted).groupBy("shard").cogroup(images.groupBy("shard")).applyInArrow(_find, "s string"), "found")


def filter_urls(df, id_col: str = "page_id", url_col: str = "url", rules=RULES, listed=(), list_col: str = "entry", limit: int | None = None):
    """One row per input row: id, host, path, the rule that decides (null if none) and the verdict.

    ``listed``: blocked ``host`` or ``host/path`` strings, a list or a table with the column ``list_col``; an index of over ``limit``
    (``MAX_BROADCAST``) bytes isn't broadcast.
    """
    from pyspark.sql import functions as F

    spark, limit = df.sparkSession, MAX_BROADCAST if limit is None else limit
    names = [id_col, "host", "path", "rule", "verdict"]
    ddl = f"`{id_col}` {kind(df, id_col)}, host string, path string, rule string, verdict string"
    urls = df.select(F.col(id_col), F.col(url_col).alias("_url"))
    if isinstance(listed, (list, tuple, set, frozenset)):
        strings, entries = sorted({_normal(x) for x in listed if x}), None
        size = sum(map(len, strings)) + 16 * len(strings)
    else:
        host = F.substring_index(list_col, "/", 1)
        entry = F.concat(F.translate(host, _UPPER, _LOW), F.expr(f"substring(`{list_col}`, length(substring_index(`{list_col}`, '/', 1)) + 1)"))
        entries = listed.where(F.col(list_col).isNotNull() & (F.col(list_col) != "")).select(entry.alias("s")).distinct()
        size = int(entries.agg(F.sum(F.octet_length("s") + 16)).first()[0] or 0)
        strings = None
    if size <= limit:
        if strings is None:
            strings = [r["s"].encode() for r in entries.collect()]
        return urls.mapInArrow(_split_kernel(Rules(rules), spark.sparkContext.broadcast(build_index(strings)), names), ddl)
    if entries is None:
        entries = spark.createDataFrame([(s.decode(),) for s in strings], "s string")
    judged = materialise(urls.mapInArrow(_split_kernel(Rules(rules), None, names), ddl), "judged")
    open_ = judged.where(F.col("verdict").isNull() & (F.col("host") != ""))
    found = _found(open_.select(F.explode(F.array("host", F.concat("host", "path"))).alias("s")).distinct(), entries, size)
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    hosts, pages = found.select(F.col("s").alias("_h"), F.lit(True).alias("_by_host")), found.select(F.col("s").alias("_p"), F.lit(True).alias("_by_page"))
    out = judged.join(hosts, F.col("host") == F.col("_h"), "left").join(pages, F.concat("host", "path") == F.col("_p"), "left")
    blocked = (F.col("_by_host").isNotNull() | F.col("_by_page").isNotNull()) & (F.col("host") != "")
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"))
