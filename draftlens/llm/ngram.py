"""Interpolated modified Kneser-Ney language model over word pairs.

Counting runs in Spark on packed arrays instead of a row for each n-gram:

1. Word hashes (XXH64) are counted: each task sorts and sums its own, sends one packed array to
   each of 2^bits parts by leading hash bits, and each part is merged into a sorted array of
   hashes with counts, a file in the shared folder. A word's number is its place in all parts.
2. Pairs of numbers (previous word or start, word or end) go the same way, by a hash of the
   pair, and give sorted arrays of pairs with counts. Each part also sends, by ranges of
   numbers, how many pairs with count 1, 2 and more a context has in it, and how many different
   contexts a word has; these are summed into plain arrays by number.
3. Workers map all the files and score batches of documents: words and pairs are made distinct,
   sorted, and looked up by binary search.

    P(w|v) = max(c(vw) - D(c), 0) / c(v) + g(v) P(w),   g(v) = sum_i D_i n_i(v) / c(v)
    P(w)   = max(n(.w) - E(n), 0) / n(..) + h / (V + 1)

with discounts D, E for counts of 1, 2, 3 and more, from counts of counts, and one place for
all unknown words. The order is two: pairs keep all counts of all documents within the
shuffle's budget.

The number of parts, and of files that hold them, follows the input's size; a part's array is bounded. Workers map
few files at a time, and visit each once for a batch of documents (``common.Mapped``). A frequent word is
summed in each task first, so it is one entry for each task.

Rows: null text counts as empty: one end token. Repeated rows count and score each. A null id is
trained on and not held out. Without training documents every probability is 1. Texts may be of
any length. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Mapped, Writer, by_part, input_bytes, partitions, power_of_two, release, removed, scratch, stored
from .langid import held_out

#: Tokens that a task gathers before it sends packed arrays.
FLUSH = 2_000_000
#: Counts below this stand in one byte; larger ones in a list of their own.
BYTE = 255
_UNKNOWN = np.int64(-1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    kinds = "".join(a.dtype.char for a in arrays).encode().ljust(16)
    return zstandard.ZstdCompressor(level=1).compress(head[:8] + kinds + head[8:] + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    kinds, sizes, at = raw[8:24].decode().strip(), np.frombuffer(raw, np.int64, n, 24).tolist(), 24 + 8 * n
    out = []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, np.dtype(kind), size, at))
        at += out[-1].nbytes
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(counts[order], start) if len(start) else counts[:0]


def _least(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint8 if not len(a) or a.max() < 1 << 8 else np.uint16 if a.max() < 1 << 16 else np.uint64)


def word_hashes(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each text."""
    words, sizes = [], []
    for x in texts:
        w = (x.encode() if isinstance(x, str) else x or b"").lower().split()
        words += w
        sizes.append(len(w))
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)), np.array(sizes, np.int64)


def _texts(batches: Iterator[pa.RecordBatch], column: int, chars: int = 6 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of batches with about so many characters."""
    for batch in batches:
        values = batch.column(column).to_pylist()
        at = size = 0
        for i, x in enumerate(values):
            size += len(x) if x else 0
            if size >= chars or i + 1 == len(values):
                yield batch.slice(at, i + 1 - at), values[at : i + 1]
                at, size = i + 1, 0


class Files:
    """The model's arrays in mapped files, and its numbers."""

    def __init__(self, bits: int) -> None:
        self.bits = bits

    # --- words
    def number_words(self) -> None:
        self.sizes = self.keys.size // 8
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.n_words = int(self.sizes.sum())
        self.end, self.start = self.n_words, self.n_words + 1
        if self.n_words + 2 >= 1 << 32:
            raise ValueError("more than 2^32 different words: pairs of their numbers don't fit into 64 bits")
        self.shift = max(8, int(self.n_words + 2).bit_length() - self.bits)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted distinct hashes."""
        number, count = np.full(len(hashes), _UNKNOWN), np.zeros(len(hashes), np.int64)
        for part, a, b in self.keys.runs((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            if self.sizes[part]:
                keys = self.keys.array(part, np.uint64)
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == hashes[a:b])
                number[a + hit] = self.offsets[part] + at[hit]
                count[a + hit] = self.counts.array(part, np.uint64)[at[hit]]
        return number, count

    # --- pairs
    def part_of(self, pairs: np.ndarray) -> np.ndarray:
        h = pairs * _MIX
        h ^= h >> np.uint64(32)
        return ((h * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(pairs), np.int64)
        part = self.part_of(pairs)
        order = np.argsort(part, kind="stable")
        for p, a, b in self.pairs.runs(part[order]):
            if self.pairs.size[p]:
                keys, want = self.pairs.array(p, np.uint64), pairs[order[a:b]]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == want)
                got = self.bytes.array(p, np.uint8)[at[hit]].astype(np.int64)
                if (big := got == BYTE).any():
                    many = self.many.array(p, np.uint64).reshape(2, -1)
                    got[big] = many[1][np.searchsorted(many[0], want[hit][big])]
                out[order[a + hit]] = got
        return out

    def by_number(self, table: Mapped, width: int, numbers: np.ndarray) -> np.ndarray:
        """Rows of a table of ``width`` columns by sorted numbers; zeros where it has none."""
        out = np.zeros((len(numbers), width), np.int64)
        for r, a, b in table.runs(numbers >> self.shift):
            if table.size[r]:
                out[a:b] = table.array(r, np.uint64).reshape(-1, width)[numbers[a:b] - (r << self.shift)]
        return out


def _runs(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of runs of equal values."""
    if len(parts):
        cut = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)]
        yield from zip(parts[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2, 3 and more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return min(max(d[0], 0.05), 1.0), min(max(d[1], 0.05), 2.0), min(max(d[2], 0.05), 3.0)


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def train(docs: DataFrame, text_col: str = "text") -> Files:
    """Count the model of docs; its files stay in the shared folder for as long as it is used."""
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    size = input_bytes(text, "text")
    bits = max(6, power_of_two(size / 16e6).bit_length() - 1)
    flush = max(FLUSH, 8 << bits)  # a packed array for each part should hold some keys
    files = min(1 << bits, partitions(docs, size))
    model = Files(bits)

    def send(keys: list[np.ndarray], part_of) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        part = part_of(k)
        order = np.argsort(part, kind="stable")
        rows = [(p, packed(_split(x := k[order[a:b]]), x.astype(np.uint32), _least(n[order[a:b]]))) for p, a, b in _runs(part[order])]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "blob"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        leading = lambda k: (k >> np.uint64(64 - bits)).astype(np.int64)
        for _, texts in _texts(batches, 0):
            held.append(word_hashes(texts)[0])
            if sum(map(len, held)) >= flush:
                yield from send(held, leading)
                held = []
        if held:
            yield from send(held, leading)

    def merged(blobs: DataFrame, merge, schema: str) -> DataFrame:
        return blobs.repartition(files, "part").sortWithinPartitions("part").mapInArrow(merge, schema)

    def mapped(base: str, found, name: str, parts: int = 1 << bits) -> Mapped:
        return Mapped(base, parts, *(np.array(found[c], np.int64) for c in ("part", f"{name}_file", f"{name}_at", f"{name}_size")))

    word_base, pair_base, number_base = (scratch(spark, x) for x in ("words", "pairs", "numbers"))

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = Writer(word_base), []
        for part, table in by_part(batches):
            keys, counts = summed(*_joined(table))
            rows.append((part, int(counts.sum()), *out.put(keys), *out.put(counts.astype(np.uint64))))
        out.close()
        yield _rows(rows, ["part", "total", *_place("keys"), *_place("counts")])

    # some numbers for each part of 16 MB of text
    words = merged(text.mapInArrow(count_words, "part int, blob binary"), merge_words, _longs("part", "total", *_place("keys"), *_place("counts"))).toPandas()
    model.keys, model.counts = mapped(word_base, words, "keys"), mapped(word_base, words, "counts")
    n_docs = text.count()
    release(spark)
    model.number_words()
    model.n_docs = n_docs
    model.n_tokens = int(words["total"].sum()) + n_docs
    model.n_types = model.n_words + bool(n_docs)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, texts in _texts(batches, 0):
            before, after, _ = model_numbers(model, texts)[:3]
            held.append((before.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64))
            if sum(map(len, held)) >= flush:
                yield from send(held, model.part_of)
                held = []
        if held:
            yield from send(held, model.part_of)

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(pair_base)
        names = ["kind", "part", "blob", "stats"]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        for part, table in by_part(batches):
            keys, counts = summed(*_joined(table))
            many = counts >= BYTE
            put = [*out.put(keys), *out.put(np.minimum(counts, BYTE).astype(np.uint8)), *out.put(np.stack([keys[many], counts[many].astype(np.uint64)]))]
            rows = [(0, part, b"", [len(keys), *_counts_of_counts(counts), *put])]
            v = (keys >> np.uint64(32)).astype(np.int64)
            at, back = np.unique(v, return_inverse=True)
            kind = np.stack([np.bincount(back, counts == 1, len(at)), np.bincount(back, counts == 2, len(at)), np.bincount(back, counts >= 3, len(at)), np.bincount(back, counts, len(at))], axis=1).astype(np.int64)
            for r, a, b in _runs(at >> model.shift):
                rows.append((1, r, packed(at[a:b].astype(np.uint32), *(_least(kind[a:b, i]) for i in range(4))), []))
            at, n = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
            for r, a, b in _runs(at >> model.shift):
                rows.append((2, r, packed(at[a:b].astype(np.uint32), _least(n[a:b])), []))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        out.close()

    pairs = merged(text.mapInArrow(count_pairs, "part int, blob binary"), merge_pairs, "kind int, part int, blob binary, stats array<long>")
    pairs = stored(pairs, "pair-sums")
    release(spark)
    found = pairs.filter("kind = 0").select("part", "stats").toPandas()
    stats = np.array(found["stats"].tolist(), np.int64).reshape(-1, 14)
    model.pairs, model.bytes, model.many = (Mapped(pair_base, 1 << bits, found["part"].to_numpy(), *stats[:, i : i + 3].T) for i in (5, 8, 11))
    model.n_pairs = int(stats[:, 0].sum())
    model.pair_discounts = _discounts(stats[:, 1:5].sum(axis=0).tolist())

    def merge_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rows = Writer(number_base), []
        for part, table in by_part(batches):
            kind, r = part % 2 + 1, part // 2
            out = np.zeros((1 << model.shift, 4 if kind == 1 else 1), np.uint64)
            for blob in table.column("blob").to_pylist():
                at, *columns = unpacked(blob)
                for i, c in enumerate(columns):
                    out[at.astype(np.int64) - (r << model.shift), i] += c.astype(np.uint64)
            stats = _counts_of_counts(out[:, 0]) + [int((out[:, 0] >= 3).sum())] if kind == 2 else [0] * 5
            rows.append((kind, r, *stats, *file.put(out)))
        file.close()
        yield _rows(rows, ["kind", "part", "n1", "n2", "n3", "n4", "more", *_place("table")])

    numbers = pairs.filter("kind > 0").select((F.col("part") * 2 + F.col("kind") - 1).alias("part"), "blob")
    got = merged(numbers, merge_numbers, _longs("kind", "part", "n1", "n2", "n3", "n4", "more", *_place("table"))).toPandas()
    ranges = (model.n_words + 2 >> model.shift) + 1
    model.contexts, model.after = (mapped(number_base, got[got["kind"] == kind], "table", ranges) for kind in (1, 2))
    t = got[["n1", "n2", "n3", "n4", "more"]].sum().astype(int).tolist()
    model.word_discounts = _discounts(t[:4])
    d = model.word_discounts
    model.rest = (d[0] * t[0] + d[1] * t[1] + d[2] * t[4]) / model.n_pairs if model.n_pairs else 1.0
    removed(spark, pairs)
    release(spark)
    return model


def _place(name: str) -> list[str]:
    return [f"{name}_{x}" for x in ("file", "at", "size")]


def _longs(*names: str) -> str:
    return ", ".join(f"{n} long" for n in names)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def _split(keys: np.ndarray) -> np.ndarray:
    """Differences of the upper halves of sorted keys; they compress well."""
    return np.diff((keys >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0))


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for blob in table.column("blob").to_pylist():
        high, low, n = unpacked(blob)
        keys.append(np.cumsum(high, dtype=np.uint64) << np.uint64(32) | low)
        counts.append(n.astype(np.int64))
    return np.concatenate(keys), np.concatenate(counts)


def model_numbers(model: Files, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every token (words, then the end) of the texts: the number before it, its own, its count; and tokens by text."""
    hashes, sizes = word_hashes(texts)
    known, back = np.unique(hashes, return_inverse=True)
    number, count = model.words(known)
    n = sizes + 1
    ends = np.cumsum(n) - 1
    own, times = np.full(int(n.sum()), model.end, np.int64), np.full(int(n.sum()), model.n_docs, np.int64)
    is_word = np.ones(len(own), bool)
    is_word[ends] = False
    own[is_word], times[is_word] = number[back], count[back]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[ends - n + 1] = model.start
    return before, own, times, n


def log10_probabilities(model: Files, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    floor = 1.0 / (model.n_types + 1)
    # words without context
    words, w_back = np.unique(own, return_inverse=True)
    after = model.by_number(model.after, 1, np.maximum(words, 0))[:, 0] * (words >= 0)
    e = np.array([0.0, *model.word_discounts])
    alone = np.maximum(after - e[np.minimum(after, 3)], 0) / max(1, model.n_pairs) + model.rest * floor
    # contexts
    contexts, c_back = np.unique(before, return_inverse=True)
    table = model.by_number(model.contexts, 4, np.maximum(contexts, 0)) * (contexts >= 0)[:, None]
    d = np.array([0.0, *model.pair_discounts])
    total = table[:, 3]
    weight = np.where(total > 0, table[:, :3] @ d[1:] / np.maximum(total, 1), 1.0)
    p = weight[c_back] * alone[w_back]
    both = np.flatnonzero((before >= 0) & (own >= 0) & (total[c_back] > 0))
    pairs, back = np.unique((before[both].astype(np.uint64) << np.uint64(32)) | own[both].astype(np.uint64), return_inverse=True)
    count = model.pair_counts(pairs)[back]
    p[both] += (count - d[np.minimum(count, 3)]) / total[c_back[both]]
    return np.log10(p)


def scored(docs: DataFrame, model: Files, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 1):
            before, own, times, n = model_numbers(model, texts)
            first = np.cumsum(n) - n
            base = np.log10((times + 1) / (model.n_tokens + model.n_types + 1))
            score = np.add.reduceat(log10_probabilities(model, before, own), first)
            cols = [n, np.add.reduceat((times > 0).astype(np.int64), first), np.full(len(n), model.n_tokens, np.int64), np.add.reduceat(base, first), score, 10 ** np.minimum(-score / n, 300.0)]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's score under a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = held_out("doc_id", 7, 2)
    found = scored(docs, train(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
