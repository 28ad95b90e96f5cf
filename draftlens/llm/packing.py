"""Best-fit packing of tokenized documents into sequences.

A document's ids and a separator are cut into pieces of at most ``room`` tokens. Pieces
are packed best-fit decreasing: the longest first, each into the open sequence that it
leaves the least room in. A segment tree over the remaining capacities finds that sequence
in logarithmic time. Pieces of one length, and sequences with the same room, are
interchangeable, so the driver packs the histogram of lengths (``room`` rows at most,
whatever the table's size): a step puts a run of equal pieces into a run of equal sequences.
The result is what packing all pieces one by one gives. It is a short list of (length, first
rank, sequences, offset); the pieces of a length are ranked by a given order (their ids, or their training
positions) and look their places up. Ranks are running totals over ranges
(``common.running``), so a length that a third of all pieces have is no single task. With an order, sequences
are numbered by their earliest piece, so a curriculum shows in the sequences.

Tokens: a text is the tokens of its white-space-separated parts in a row (the
tokenizer never joins across white space), so a worker remembers parts.

Rows: null text counts as empty, which is one piece with the separator alone. Rows that repeat an id, or
have none, are packed each. Empty tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_order, numbered, running, small, stored

ROOM = 2048
SEPARATOR = 0
#: Parts, and words of parts, that a worker remembers in each of two generations, and their longest.
MEMO, LONGEST = 400_000, 64


class _Parts(dict):
    """Bytes of the little-endian 32-bit ids of white-space-separated parts of texts.

    A full generation becomes the old one, from which what is asked for again moves on, so frequent parts are not computed anew.
    """

    #: Parts of printable ASCII and Latin letters need no normalisation but lower case.
    plain = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
    #: How the tokenizer's splitter cuts such parts.
    pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-`{-~]+").findall

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        # the printable stand-ins that byte-level vocabularies use
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def piece(self, word: str) -> bytes:
        if (got := self.words.get(word)) is None:
            if (got := self.old_words.get(word)) is None:
                text = word if word.isascii() else "".join(self.shown[b] for b in word.encode())
                got = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(word) <= LONGEST:
                if len(self.words) >= MEMO:
                    self.old_words, self.words = self.words, {}
                self.words[word] = got
        return got

    def __missing__(self, part: str) -> bytes:
        if (got := self.old.get(part)) is not None:
            pass
        elif self.plain(part) and "<|" not in part:
            got = b"".join(map(self.piece, self.pieces(part.lower())))
        else:
            got = np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= LONGEST:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[part] = got
        return got


#: White space for str.split that the tokenizer may see otherwise; such texts are parted at spaces alone.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_LOADED: dict[str, _Parts] = {}


def _parts(path: str) -> _Parts:
    if path not in _LOADED:
        _LOADED[path] = _Parts(path)
    return _LOADED[path]


def pieces(rows: DataFrame, tokenizer: str, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids binary of 32-bit numbers]) for each piece of each (doc_id, row, text)."""
    end = np.array([SEPARATOR], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _parts(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows: list[tuple] = []
                for doc, row, text in zip(*(batch.column(i)[at : at + 1000].to_pylist() for i in range(3)), strict=True):
                    data = b"".join(map(known.__getitem__, text.split(" ") if _ODD(text) else text.split())) + end if text else end
                    for k, a in enumerate(range(0, len(data), 4 * room)):
                        part = data[a : a + 4 * room]
                        rows.append((doc, row, k, k * room, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * (6 + with_ids)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.select("doc_id", "row", "text").mapInArrow(run, schema)


class Capacities:
    """A segment tree over remaining capacities: which of them some open sequence has."""

    def __init__(self, room: int) -> None:
        self.size = 1 << room.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, some: bool) -> None:
        i = self.size + capacity
        self.any[i] = some
        while i := i >> 1:
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def least(self, capacity: int) -> int | None:
        """The least capacity of an open sequence that is no smaller."""
        i = self.size + capacity
        if self.any[i]:
            return capacity
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def packed(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of the histogram: (length, first rank, end rank, first sequence, per sequence, offset).

    The pieces of a length with ranks in [first, end) go, ``per sequence`` at a time, into
    sequences in a row from the first one, from the offset on.
    """
    tree = Capacities(room)
    open_: dict[int, list[tuple[int, int]]] = {}
    steps: list[tuple[int, int, int, int, int, int]] = []
    new = 0

    def put(capacity: int, first: int, end: int) -> None:
        if capacity and first < end:
            if not open_.setdefault(capacity, []):
                tree.set(capacity, True)
            open_[capacity].append((first, end))

    for length in sorted(histogram, reverse=True):
        at, end = 0, histogram[length]
        while at < end:
            capacity = tree.least(length)
            if capacity is None:
                # each new sequence is the tightest until it is full
                per = room // length
                n, rest = divmod(end - at, per)
                if n:
                    steps.append((length, at, at + n * per, new, per, 0))
                    put(room - per * length, new, new + n)
                if rest:
                    steps.append((length, at + n * per, end, new + n, rest, 0))
                    put(room - rest * length, new + n, new + n + 1)
                new += n + bool(rest)
                at = end
            else:
                # the tightest sequence takes pieces as long as it stays the tightest
                first, last = open_[capacity][-1]
                per = capacity // length
                n = min(last - first, (end - at) // per)
                if n:
                    left, took = first + n, n * per
                else:
                    left, per = first + 1, end - at
                    n, took = 1, per
                steps.append((length, at, at + took, first, per, room - capacity))
                open_[capacity].pop()
                if left < last:
                    open_[capacity].append((left, last))
                if not open_[capacity]:
                    tree.set(capacity, False)
                put(capacity - per * length, first, first + n)
                at += took
    return steps


def placed(cut: DataFrame, order: list[str], room: int = ROOM) -> DataFrame:
    """cut with sequence_id and offset; it has length and the columns of ``order``, which tell pieces apart, and is read more than once."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # room rows at most
    steps = packed(counts, room)
    table = spark.createDataFrame(steps or [], "_length long, _first long, _end long, _sequence long, _per long, _offset long")
    ranked = running(cut, ["length"], order, {"_rank": F.lit(1)}, sum(counts.values()))
    # the plan's size goes with the room, not with the pieces
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    inside = F.col("_rank") - F.col("_first")
    return ranked.join(F.broadcast(table) if small(table, 48, len(steps)) else table, here).select(
        *cut.columns, (F.col("_sequence") + F.floor(inside / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_offset") + F.pmod(inside, F.col("_per")) * F.col("length")).alias("offset")
    )


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, ordered: bool = False) -> DataFrame:
    """The pieces of docs with their sequence and offset.

    ordered: the files' order is the training order. Pieces of a length are then dealt in it, sequences are numbered by their
    earliest piece, and each piece has its row's ``position`` in the order, which tells copies of a document apart.
    """
    at = {c: F.col(f"c{i}") for i, c in reversed(list(enumerate(docs.columns)))}
    rows = in_order(docs) if ordered else numbered(docs)
    key = F.col("position") if ordered else F.col("row")
    rows = rows.select(at[id_col].cast("long").alias("doc_id"), key.alias("row"), at[text_col].cast("string").alias("text"))
    cut = stored(pieces(rows, tokenizer, room), "pieces")
    if not ordered:
        return placed(cut, ["doc_id", "piece", "row"], room).drop("row")
    found = stored(placed(cut, ["row", "piece"], room), "placed")
    first = found.groupBy("sequence_id").agg(F.min("row").alias("first"))
    number = running(first, [], ["first", "sequence_id"], {"number": F.lit(1)}, first.count())
    number = number.select("sequence_id", F.col("number").cast("long").alias("number"))
    return found.join(number, "sequence_id").drop("sequence_id").withColumnsRenamed({"number": "sequence_id", "row": "position"})


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents packed into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
