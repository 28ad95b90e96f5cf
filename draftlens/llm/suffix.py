"""Suffix-array dedup of repeated passages.

Every byte covered by a ``length``-byte string that also starts earlier (smaller id,
or same document and earlier start) is removed.

1. The minimizer of a window of ``length`` bytes (its smallest ``SEED``-byte hash) depends
   on the window alone, so equal windows share it. Runs of windows with one minimizer
   ("spans") are found in one pass; hashes of minimizers seen twice go to sorted, mapped
   arrays. All other spans can't repeat and go no further.
2. Spans of repeated minimizers are reduced by their bytes, keeping the first place, before
   the shuffle: what many documents share becomes one row. A later copy repeats wholly.
3. The different spans of a minimizer meet in one task, which builds a suffix array of
   their bytes by two-stage sorting: suffixes smaller than their successor are sorted
   directly, the others are induced by scans over the first-byte buckets. Adjacent common
   prefixes of ``length`` bytes or more join equal windows; all but the first repeat.
   A minimizer with more than ``GROUP`` different spans is split again and again by halves
   of the windows' offsets, with all bytes that a half's windows have in common as the new
   key, down to single windows; so no group is unbounded.
4. A last pass over the documents unites the windows, counts and cuts.

Rows: null text counts as empty. Strings never cross rows. A null id comes after all others. Rows that share
an id, or have none, are documents of their own, in an order that is the same in every run over the same
files (``common.numbered``): of equal rows one keeps its bytes. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLACE, HashSet, Mapped, Writer, by_part, checkpointed, input_bytes, numbered, partitions, places, power_of_two, release, removed, scratch, small, stored, trim

SEED = 32
#: Different spans of one key that a task sorts together; larger groups are split.
GROUP = 512
_LAST = (1 << 63) - 1
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _loads(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The 8 bytes at each position (or at each of the given ones) as big-endian numbers; data has 8 bytes to spare."""
    n = len(data) - 8
    view = np.ndarray((n,), dtype=">u8", buffer=data, strides=(1,))
    return (view if at is None else view[at]).astype(np.uint64)


class Spans:
    """Spans of many texts: arrays doc, start (in the doc), windows, seed (offset of the minimizer) and key."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        sizes = np.array([len(x) for x in texts], np.int64)
        self.use = np.flatnonzero(sizes >= length)
        n = sizes[self.use]
        self.base = np.cumsum(n) - n
        self.data = np.frombuffer(b"".join([*(texts[i] for i in self.use), b"\xff" * 128]), np.uint8)
        self.doc = self.at = self.start = self.windows = self.seed = self.key = np.empty(0, np.int64)
        total = int(n.sum())
        if not total:
            return
        word = _loads(self.data)
        h = word[:total] * _MUL[0]
        for i in range(1, SEED // 8):
            h += word[8 * i : 8 * i + total] * _MUL[i]
        h ^= h >> np.uint64(31)
        h *= _MUL[1]
        h ^= h >> np.uint64(29)
        # low bits hold the place: a window's least number is its leftmost least hash
        bits = np.uint64(32)
        low = (h >> bits << bits) | np.arange(total, dtype=np.uint64)
        width, reach = length - SEED + 1, 1
        while reach * 2 <= width:
            np.minimum(low[:-reach], low[reach:], out=low[:-reach])
            reach *= 2
        if reach < width:
            np.minimum(low[: -(width - reach)], low[width - reach :], out=low[: -(width - reach)])
        place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        valid = np.ones(total, bool)
        for i in range(1, length):
            valid[self.base + n - i] = False
        new = np.empty(total, bool)
        new[0] = True
        np.not_equal(place[1:], place[:-1], out=new[1:])
        new[self.base] = True
        new &= valid
        self.at = np.flatnonzero(new)
        owner = np.searchsorted(self.base, self.at, side="right") - 1
        ends = np.minimum(np.r_[self.at[1:], total], (self.base + n - length + 1)[owner])
        self.doc, self.start, self.windows = self.use[owner], self.at - self.base[owner], ends - self.at
        self.seed, self.key = place[self.at] - self.at, h[place[self.at]]


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def _slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of a batch with about so many bytes of text: the first row's number, and the texts."""
    held, size, at = [], 0, 0
    for i in range(batch.num_rows):
        x = batch.column(column)[i].as_py()
        x = b"" if x is None else x.encode() if isinstance(x, str) else x
        if held and size + len(x) > most:
            yield at, held
            held, size, at = [], 0, i
        held.append(x)
        size += len(x)
    if held:
        yield at, held


def repeated_seeds(docs: DataFrame, text: str, length: int) -> HashSet:
    """The hashes of minimizers that occur in more than one span."""
    spark = docs.sparkSession
    size = input_bytes(docs, text)
    bits = max(6, power_of_two(size / 64e6).bit_length() - 1)
    most = max(1_500_000, 8 << bits)  # a packed array for each part should hold some keys

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            part = (keys >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(keys)] if len(keys) else np.zeros(1, np.int64)
            rows = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[a]) for a, _ in rows], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([keys[a:b][n[a:b] > 1].tobytes() for a, b in rows], pa.binary())], names=["part", "seen", "again"]
            )
            held.clear()

        for batch in batches:
            for _, texts in _slices(batch, 0):
                held.append(Spans(texts, length).key)
                if sum(map(len, held)) > most:
                    yield from flush()
        yield from flush()
        trim()

    base = scratch(spark, "seeds")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parts, rows = Writer(base), [], []
        for part, table in by_part(batches):
            seen = [np.frombuffer(x, np.uint64) for x in table.column("seen").to_pylist()]
            again = [np.frombuffer(x, np.uint64) for x in table.column("again").to_pylist()]
            keys, n = np.unique(np.concatenate(seen), return_counts=True)
            rows.append(out.put(np.union1d(keys[n > 1], np.concatenate(again))))
            parts.append(part)
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32())} | places(rows))
        trim()

    blobs = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(gather, "part int, seen binary, again binary")
    blobs = blobs.repartition(min(1 << bits, partitions(docs, size)), "part").sortWithinPartitions("part")
    found = blobs.mapInArrow(merge, f"part int, {PLACE}").toPandas()  # four numbers for each part of 64 MB of text
    return HashSet(bits, Mapped(base, 1 << bits, *(found[c].to_numpy() for c in ("part", "file", "at", "size"))))


def two_stage(data: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """The needed positions, sorted by the ``depth`` bytes there.

    data ends in 128 bytes 0xFF, which no text holds; needed holds, with each suffix that is
    larger than its successor, that successor too.
    """
    n = len(data) - 128
    step = np.sign(data[1 : n + 1].astype(np.int16) - data[:n])
    change = np.where(step != 0, np.arange(n), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    smaller = np.ones(n, bool)
    inside = change < n
    smaller[inside] = step[change[inside]] > 0  # a run of equal bytes has the type of its end
    # stage one: suffixes smaller than their successor, directly
    direct = np.flatnonzero(needed & smaller)
    first = _loads(data, direct)
    order = np.argsort(first, kind="stable")
    direct, first = direct[order], first[order]
    group = np.cumsum(np.r_[True, first[1:] != first[:-1]]) - 1 if len(direct) else np.empty(0, np.int64)
    tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(direct) else np.empty(0, np.int64)
    for d in range(8, depth, 8):
        if not len(tied):
            break
        word = _loads(data, np.minimum(direct[tied] + d, n + 100))
        g = group[tied]
        o = np.lexsort((word, g))
        direct[tied] = direct[tied][o]
        word, g = word[o], g[o]
        split = np.r_[True, (g[1:] != g[:-1]) | (word[1:] != word[:-1])]
        group[tied] = tied[np.flatnonzero(split)[np.cumsum(split) - 1]]
        _, back, count = np.unique(group[tied], return_inverse=True, return_counts=True)
        tied = tied[count[back] > 1]
    # stage two: scan the buckets by first byte; each suffix puts its larger predecessor into that one's bucket
    heads = np.searchsorted(data[direct], np.arange(257))
    arrived: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        parts = arrived[c]
        queue = np.concatenate(parts) if parts else np.empty(0, np.int64)
        row = [queue]
        while len(queue):
            p = queue[queue > 0] - 1
            queue = p[(data[p] == c) & needed[p] & ~smaller[p]]
            row.append(queue)
        row.append(direct[heads[c] : heads[c + 1]])
        here = np.concatenate(row)
        out.append(here)
        p = here[here > 0] - 1
        p = p[(data[p] > c) & needed[p] & ~smaller[p]]
        if len(p):
            ch = data[p]
            o = np.argsort(ch, kind="stable")
            p, ch = p[o], ch[o]
            cuts = np.r_[0, np.flatnonzero(ch[1:] != ch[:-1]) + 1, len(ch)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                arrived[int(ch[a])].append(p[a:b])
    return np.concatenate(out)


def repeated_windows(contents: list[bytes], docs: np.ndarray, rows: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Ranges (doc, row, first window, last window) of windows that also start earlier, among these contents."""
    sizes = np.array([len(x) for x in contents], np.int64)
    data = np.frombuffer(b"\xff".join(contents) + b"\xff" * 128, np.uint8)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    n = len(data) - 128
    is_window = np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, base, 1)
    np.add.at(edge, base + sizes - length + 1, -1)
    is_window[:] = np.cumsum(edge[:-1]) > 0
    needed = is_window.copy()
    grow = base + sizes - length
    while len(grow):  # up to the next suffix that is smaller than its successor, at the latest before the mark
        falls = data[grow] >= data[grow + 1]
        grow = grow[falls] + 1
        grow = grow[grow < n]
        needed[grow] = True
    order = two_stage(data, needed, length)
    order = order[is_window[order]]
    # adjacent common prefixes, up to ``length``
    same = np.arange(len(order) - 1)
    for d in [*range(0, length - 7, 8), length - 8]:
        same = same[_loads(data, order[same] + d) == _loads(data, order[same + 1] + d)]
    joined = np.zeros(len(order), bool)
    joined[same + 1] = True
    cls = np.cumsum(~joined) - 1
    member = np.zeros(len(order), bool)
    member[same] = member[same + 1] = True
    order, cls = order[member], cls[member]
    owner = np.searchsorted(base, order, side="right") - 1
    doc, row, at = docs[owner], rows[owner], starts[owner] + order - base[owner]
    o = np.lexsort((at, row, doc, cls))
    doc, row, at, cls = doc[o], row[o], at[o], cls[o]
    later = np.r_[False, cls[1:] == cls[:-1]] if len(cls) else np.empty(0, bool)
    doc, row, at = doc[later], row[later], at[later]
    o = np.lexsort((at, row, doc))
    doc, row, at = doc[o], row[o], at[o]
    if not len(doc):
        return doc, row, at, at
    cut = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)]
    begin = np.flatnonzero(cut)
    return doc[begin], row[begin], at[begin], at[np.r_[begin[1:], len(at)] - 1]


_RANGE = "doc long, row long, a long, b long"


def _ranges(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "row", "a", "b"])


def coverage(docs: DataFrame, length: int = 100, group: int = GROUP) -> tuple[HashSet, DataFrame]:
    """The repeated minimizers of (doc, row, text), and per row (doc, row, firsts: starts of spans that come first, ranges: windows in these that repeat)."""
    spark = docs.sparkSession
    src = docs.select("doc", "text", "row")
    seeds = repeated_seeds(src, "text", length)
    parts = partitions(src, input_bytes(src, "text"), 16 << 20)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for at, texts in _slices(batch, 1):
                s = Spans(texts, length)
                keep = np.flatnonzero(seeds.contains(s.key)) if len(s.key) else np.empty(0, np.int64)
                raw = s.data.tobytes()
                begin = s.at[keep].tolist()
                end = (s.at[keep] + s.windows[keep] + length - 1).tolist()
                content = pa.array([raw[a:b] for a, b in zip(begin, end, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.key[keep].view(np.int64) if len(keep) else [], pa.int64()), content, pa.array(s.seed[keep], pa.int32()), pa.array(ids[at + s.doc[keep]], pa.int64()), pa.array(rows[at + s.doc[keep]], pa.int64()), pa.array(s.start[keep], pa.int64())],
                    names=["key", "content", "seed", "doc", "row", "start"],
                )
        trim()

    def firsts(df: DataFrame) -> DataFrame:
        place = F.min(F.struct("doc", "row", "start")).alias("first")
        return df.groupBy("key", "content", "seed").agg(place, F.count("*").alias("n")).select("key", "content", "seed", "first.*", "n")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents: list[bytes] = []
        keys: list[int] = []
        ids: list[int] = []
        rows: list[int] = []
        starts: list[int] = []
        size = 0

        def flush(to: int) -> pa.RecordBatch:
            k = np.array(keys[:to])
            _, back, count = np.unique(k, return_inverse=True, return_counts=True)
            use = np.flatnonzero(count[back] > 1)
            if not len(use):
                return _ranges([], [], [], [])
            return _ranges(*repeated_windows([contents[i] for i in use], *(np.array(x, np.int64)[use] for x in (ids, rows, starts)), length))

        for batch in batches:
            for key, content, doc, row, start in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size > 4 << 20 and key != keys[-1]:
                    yield flush(len(keys))
                    for x in (contents, keys, ids, rows, starts):
                        x.clear()
                    size = 0
                keys.append(key)
                contents.append(content)
                ids.append(doc)
                rows.append(row)
                starts.append(start)
                size += len(content)
        if keys:
            yield flush(len(keys))
        trim()

    found: list[DataFrame] = []
    level = firsts(src.mapInArrow(spans, "key long, content binary, seed int, doc long, row long, start long"))
    base = level = stored(level, "spans")
    release(spark)
    lo, hi = 0, length - SEED
    level = level.withColumn("lo", F.lit(lo)).withColumn("hi", F.lit(hi))
    kept: list[DataFrame] = [base]
    while True:
        counts = level.groupBy("key").count().filter(F.col("count") > group).select(F.col("key").alias("hot"))
        hot = checkpointed(counts)
        n_hot = hot.count()
        if n_hot and small(hot, 8, n_hot):
            hot = F.broadcast(hot)
        fits = level.join(hot, F.col("key") == F.col("hot"), "left_anti") if n_hot else level
        fits = fits.select("key", "content", "doc", "row", "start").repartition(parts, "key").sortWithinPartitions("key")
        found.append(checkpointed(fits.mapInArrow(sort, _RANGE)))
        release(spark)
        if not n_hot:
            break

        def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for content, seed, doc, row, start, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                    mid = (lo + hi) // 2
                    for x, y in ((lo, mid), (mid + 1, hi)):
                        # windows start at seed - o for an offset o of the minimizer; those in this half and in this span
                        s0, s1 = max(0, seed - y), min(len(content) - length, seed - x)
                        if s0 <= s1 and x <= y:
                            common = content[seed - x : seed - y + length]
                            key = int.from_bytes(hashlib.blake2b(common + bytes((x, y)), digest_size=8).digest(), "little", signed=True)
                            rows.append((key, content[s0 : s1 + length], seed - s0, doc, row, start + s0, x, y))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "content", "seed", "doc", "row", "start", "lo", "hi"])

        rows = level.join(hot, F.col("key") == F.col("hot"), "left_semi").select("content", "seed", "doc", "row", "start", "lo", "hi")
        rows = stored(rows.mapInArrow(halves, "key long, content binary, seed int, doc long, row long, start long, lo int, hi int"), "halves")
        first = F.min(F.struct("doc", "row", "start")).alias("first")
        level = stored(rows.groupBy("key", "content", "seed", "lo", "hi").agg(first, F.count("*").alias("n")).select("key", "content", "seed", "first.*", "lo", "hi", "n"), "level")
        # a copy of a piece repeats in all its windows; pieces are equal if their key and 128 bits of hashes are
        same = [F.xxhash64("content").alias("c1"), F.xxhash64(F.lit(1), "content").alias("c2")]
        twice = level.filter("n > 1").select("key", *same, F.struct("doc", "row", "start").alias("first"), F.length("content").alias("size"))
        again = rows.select("key", *same, "doc", "row", "start").join(checkpointed(twice), ["key", "c1", "c2"]).filter("struct(doc, row, start) <> first")
        found.append(checkpointed(again.select("doc", "row", F.col("start").alias("a"), (F.col("start") + F.col("size") - length).alias("b"))))
        kept += [rows, level]
    windows = found[0]
    for x in found[1:]:
        windows = windows.unionByName(x)
    marks = base.select("doc", "row", F.col("start").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(windows)
    per_doc = marks.repartition(parts, "doc", "row").groupBy("doc", "row").agg(F.collect_list(F.when(F.col("b").isNull(), F.col("a"))).alias("firsts"), F.collect_list(F.when(F.col("b").isNotNull(), F.struct("a", "b"))).alias("ranges"))
    per_doc = stored(per_doc, "marks")
    for df in kept:
        removed(spark, df)
    return seeds, per_doc


def _cut(texts: list[bytes], marks: list[tuple[list, list]], seeds: HashSet, length: int) -> list[np.ndarray]:
    """For each text a mask of the bytes to remove."""
    s = Spans(texts, length)
    sizes = [len(x) for x in texts]
    delta = [np.zeros(n + 1, np.int32) if n >= length else None for n in sizes]
    if len(s.key):
        for i in np.flatnonzero(seeds.contains(s.key)).tolist():
            d, a = int(s.doc[i]), int(s.start[i])
            if a not in marks[d][0]:
                delta[d][a] += 1
                delta[d][a + int(s.windows[i]) + length - 1] -= 1
    for d, (_, ranges) in enumerate(marks):
        for a, b in ranges:
            if delta[d] is not None and b + length <= sizes[d]:
                delta[d][a] += 1
                delta[d][b + length] -= 1
    return [np.cumsum(x[:-1]) > 0 if x is not None else np.zeros(n, bool) for x, n in zip(delta, sizes, strict=True)]


def _with_marks(docs: DataFrame, id_col: str, text_col: str, length: int, group: int) -> tuple[HashSet, DataFrame]:
    """(doc, text, row, columns of docs as c0, c1, ..., firsts, ranges)."""
    at = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    doc, text = F.col(f"c{at[id_col]}").cast("long"), F.col(f"c{at[text_col]}").cast("string")
    rows = numbered(docs).select(F.coalesce(doc, F.lit(_LAST)).alias("doc"), text.alias("text"), "row", *[f"c{i}" for i in range(len(docs.columns)) if i != at[text_col]])
    seeds, per_row = coverage(rows, length, group)
    parts = partitions(docs, input_bytes(rows, "text"), 16 << 20)
    return seeds, rows.repartition(parts, "doc", "row").join(per_row.repartition(parts, "doc", "row"), ["doc", "row"], "left")


def _marks(firsts: pa.Array, ranges: pa.Array, at: int, n: int) -> list[tuple[set, list]]:
    f, r = firsts[at : at + n].to_pylist(), ranges[at : at + n].to_pylist()
    return [(set(x or ()), [(y["a"], y["b"]) for y in z or ()]) for x, z in zip(f, r, strict=True)]


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    seeds, joined = _with_marks(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "doc_id", "text", length, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch, 1):
                n, rows = len(texts), []
                for x, gone in zip(texts, _cut(texts, _marks(batch.column(2), batch.column(3), at, n), seeds, length), strict=True):
                    k = int(gone.sum())
                    rest = np.frombuffer(x, np.uint8)[~gone].tobytes() if k else x
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if k else 0
                    rows.append((len(x), k, runs, hashlib.sha256(rest).hexdigest()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + n], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select(F.col("c0").alias("doc_id"), "text", "firsts", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, group: int = GROUP) -> DataFrame:
    """docs with the repeated bytes cut from the text; a character that loses a byte goes with it.

    A row whose whole text repeats is dropped; rows that came without text stay.
    """
    seeds, joined = _with_marks(docs, id_col, text_col, length, group)
    at_text = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, ranges = batch.column(len(names)), batch.column(len(names) + 1)
            for at, texts in _slices(batch, at_text):
                n, out, keep = len(texts), [], []
                for i, (x, gone) in enumerate(zip(texts, _cut(texts, _marks(firsts, ranges, at, n), seeds, length), strict=True)):
                    if not gone.any():
                        out.append(batch.column(at_text)[at + i].as_py())
                        keep.append(True)
                        continue
                    raw = np.frombuffer(x, np.uint8)
                    lead = np.cumsum((raw & 0xC0) != 0x80) - 1
                    whole = np.zeros(int(lead[-1]) + 1, bool)
                    np.logical_or.at(whole, lead, gone)
                    rest = raw[~whole[lead]].tobytes().decode()
                    out.append(rest)
                    keep.append(bool(rest))
                cols = [pa.array(out, pa.string()) if j == at_text else batch.column(j)[at : at + n] for j in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    columns = [F.col("text").alias(n) if i == at_text else F.col(n) for i, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType() if i == at_text else f.dataType) for i, (n, f) in enumerate(zip(names, docs.schema.fields, strict=True))])
    return joined.select(*columns, "firsts", "ranges").mapInArrow(run, schema).toDF(*docs.columns)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """op3: bytes of all documents that repeat an earlier string of 100 bytes."""
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
