"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine.

A text is a bag of terms, over all terms of the examples: its words (runs of letters and digits, in lower case), whole; for words of more than
``STEM`` letters their first ones too, so that inflections meet; and for scripts that put no spaces between words all pairs of
neighbouring characters. Examples and texts are TF-IDF vectors of length 1; a term's weight also has a factor that grows from ``FLOOR`` to 1
with its chi-square against the label, so that the words of the subject don't drown what the label is about, but no
term is left out.

The index is inverted: for each term the examples that have it, in blocks of ``BLOCK`` examples with each term's largest
weight in the block. Similar examples are neighbours in the index (they are halved again and again along their main
direction), which makes the blocks' bounds tight. A query visits blocks by falling bound and stops when the
bound is below the k-th best cosine, so the k nearest are exact. They vote with weight 1 / (margin + distance) for
their label, times how frequent the label is over how frequent it is in the sample; a logistic curve, fitted on the
examples' votes for each other, makes the vote a probability.

Training reads a bounded sample: at most ``MAX_EXAMPLES`` labelled rows, half of them of each label if there are as
many, and at most ``MAX_CHARS`` characters, drawn by a hash, whatever the tables' sizes. The index is as bounded
and is sent to the workers. All documents are scored, over their whole texts.

Rows: null and empty texts, and texts without a known term, get the share of label 1. Labels that are null or other than 0 and 1
teach nothing; rows with several labels count as several examples, equal ones as one. Without examples all scores are 0.
Repeated rows score alike. The id is used to draw examples and as evidence only. A column that has the name of
an output gives way to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from .common import small, trim
from .langid import held_out

MAX_EXAMPLES = 2_000
MAX_CHARS = 16_000_000
#: Characters of a longer word that make a term besides the word, so that its inflections meet.
STEM = 6
#: The factor of a term's weight: FLOOR + (1 - FLOOR) * c^2 / (c^2 + CHI^2) for a chi-square of c.
FLOOR = 0.02
CHI = 30.0
NEAREST = 15
BLOCK = 32
MARGIN = 0.05
#: Pieces that a worker remembers.
MEMO = 200_000
_RUNS = re.compile(r"[^\W_]+").findall
#: Bytes, with a space for each ASCII character that is no letter or digit.
_BREAKS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
#: Thai and Lao, Burmese, Khmer, Japanese and Chinese: words without spaces between them.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+)")


def _terms(piece: str) -> list[str]:
    """The terms of a piece of ``pieces_of``."""
    if piece.isascii():  # one run
        return [piece, piece[:STEM]] if len(piece) > STEM else [piece]
    out = []
    for run in _RUNS(piece):
        for i, part in enumerate(_UNSPACED.split(run)):  # every second part is without spaces
            if i % 2:
                out += [part[j : j + 2] for j in range(max(1, len(part) - 1))]
            elif part:
                out.append(part)
                if len(part) > STEM:
                    out.append(part[:STEM])
    return out


def pieces_of(text: str) -> list[str]:
    """A text in lower case, cut at white space and at each ASCII character that is no letter or digit."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).decode("utf-8", "surrogatepass").split()


def terms_of(text: str) -> list[str]:
    return list(chain.from_iterable(map(_terms, pieces_of(text))))


class _Memo(dict):
    """Numbers of the known terms in a piece."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms = terms

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        got = self[piece] = tuple([self.terms[g] for g in _terms(piece) if g in self.terms])
        return got


def _clusters(terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order of sparse rows in which similar ones are neighbours, by halving along the main direction of a sketch."""
    n = len(sizes)
    h = terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sketch = np.zeros((n, 64))
    row = np.repeat(np.arange(n), sizes)
    np.add.at(sketch, (row, (h >> np.uint64(58)).astype(np.int64)), np.where(h >> np.uint64(32) & np.uint64(1), weights, -weights))
    order, todo = [], [np.arange(n)]
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            order.append(part)
            continue
        x = sketch[part] - sketch[part].mean(axis=0)
        v = np.linspace(1.0, 2.0, 64)
        for _ in range(12):
            v = x.T @ (x @ v)
            v /= max(np.linalg.norm(v), 1e-300)
        part = part[np.argsort(x @ v, kind="stable")]
        half = BLOCK * -(-len(part) // (2 * BLOCK))
        todo += [part[half:], part[:half]]
    return np.concatenate(order) if order else np.empty(0, np.int64)


class Nearest:
    """The block-max index over labelled examples; share: how frequent label 1 is among all labelled rows."""

    def __init__(self, examples: list[tuple[int | None, str, int]], k: int = NEAREST, share: float | None = None) -> None:
        self.k = k
        examples = sorted(set(examples), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
        y = np.array([y for *_, y in examples], np.float64)
        number = {}
        bags = []
        for _, text, _ in examples:
            c: Counter = Counter()
            for w, n in Counter(text.split()).items():
                for g in terms_of(w):
                    c[number.setdefault(g, len(number))] += n
            bags.append((np.fromiter(c, np.int64, len(c)), np.fromiter(c.values(), np.float64, len(c))))
        n, ones, width = len(examples), y.sum(), len(number)
        sizes = np.array([len(t) for t, _ in bags], np.int64)
        term = np.concatenate([t for t, _ in bags]) if bags else np.empty(0, np.int64)
        times = np.concatenate([c for _, c in bags]) if bags else np.empty(0)
        owner = np.repeat(np.arange(n), sizes)
        among = np.bincount(term, minlength=width)
        toxic = np.bincount(term, y[owner], width)
        rest = np.maximum(n - among, 1)
        # chi-square of presence against the label
        chi = n * (toxic * (n - ones - among + toxic) - (ones - toxic) * (among - toxic)) ** 2 / np.maximum(ones * (n - ones) * among * rest, 1) * (among < n)
        self.idf = (np.log((1 + n) / (1 + among)) + 1) * (FLOOR + (1 - FLOOR) * chi**2 / (chi**2 + CHI**2))
        self.names = list(number)
        self.terms = number
        self.memo = _Memo(number)
        w = (1 + np.log(times)) * self.idf[term]
        w /= np.maximum(np.sqrt(np.bincount(owner, w * w, n)), 1e-300)[owner] if n else 1
        order = _clusters(term, w, sizes)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.labels = [examples[i][0] for i in order.tolist()], y[order]
        self.share = (float(y.mean()) if n else 0.0) if share is None else share
        drawn = float(y.mean()) if n else 0.5
        # a vote counts as much as its label is rarer in the sample than it should be
        ratio = np.array([(1 - self.share) / max(1 - drawn, 1e-9), self.share / max(drawn, 1e-9)])
        self.votes = ratio[self.labels.astype(int)]
        # postings by term; a cell is the postings of a term in a block, with where they start and their largest weight (rounded up)
        o = np.lexsort((place[owner], term))
        t, self.docs, self.weights = term[o], place[owner][o].astype(np.int32), w[o]
        self.blocks = -(-n // BLOCK)
        key = t * max(1, self.blocks) + self.docs // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.starts = np.r_[first, len(key)].astype(np.int32)
        self.block = (self.docs[first] // BLOCK).astype(np.int32)
        most = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0)
        self.most = np.nextafter(most.astype(np.float32), np.float32(np.inf))
        self.dense = self.places = None
        self.cells = np.searchsorted(t[first], np.arange(width + 1)).astype(np.int32)
        self.a, self.b = 1.0, 0.0
        if n >= 20:
            self._fit([(t, self._weights(t, c)) for t, c in (bags[i] for i in order.tolist())])

    def _weights(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        v = (1 + np.log(times)) * self.idf[terms]
        return v / max(np.sqrt((v * v).sum()), 1e-300)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's known terms and their TF-IDF weights, of length 1."""
        numbers = list(chain.from_iterable(map(self.memo.__getitem__, pieces_of(text))))
        terms, times = np.unique(np.array(numbers, np.int64), return_counts=True)
        return terms, self._weights(terms, times)

    def _products(self, start: np.ndarray, n: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples and products of runs of postings, each with a weight of the query."""
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(start - (ends - n), n)
        return self.docs[at], np.repeat(q, n) * self.weights[at]

    def cosines(self, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The exact cosines of the examples of some blocks, in their order; of the others zero."""
        if 2 * len(blocks) > self.blocks:  # the postings of whole terms
            start, end = self.starts[self.cells[terms]], self.starts[self.cells[terms + 1]]
        else:
            self._tables()
            rows, blocks = self.places[terms], np.sort(blocks)
            start, end = rows[:, blocks].ravel(), rows[:, blocks + 1].ravel()
            some = np.flatnonzero(end > start)
            start, end, q = start[some], end[some], q[some // max(1, len(blocks))]
        start = start.astype(np.int64)
        return np.bincount(*self._products(start, end - start, q), self.blocks * BLOCK)

    def _tables(self) -> None:
        """For each term and block the largest weight and where its postings start; made where they are used, as they are larger than all else."""
        if self.dense is None:
            n = np.diff(self.cells)
            self.dense = np.zeros((len(n), self.blocks), np.float32)
            self.dense[np.repeat(np.arange(len(n)), n), self.block] = self.most
            many = np.zeros((len(n), self.blocks + 1), np.int32)
            many[np.repeat(np.arange(len(n)), n), self.block + 1] = np.diff(self.starts)
            many[:, 0] = self.starts[self.cells[:-1]]
            self.places = np.cumsum(many, axis=1, dtype=np.int32, out=many)

    def bounds(self, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What no cosine of a block's examples exceeds."""
        self._tables()
        return q @ self.dense[terms]

    def nearest(self, terms: np.ndarray, q: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines, nearest first, ties to the smaller number."""
        bound = self.bounds(terms, q) if len(terms) else np.zeros(self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        least = 0.0
        for blocks in (order[:4], order):
            # a block whose bound is below the k-th best cosine has none of the k nearest
            blocks = blocks[bound[blocks] >= least - 1e-12]
            c = self.cosines(terms, q, blocks)
            if 0 <= skip < len(c):
                c[skip] = 0.0
            i = np.flatnonzero(c > max(0.0, least - 1e-12)) if least else np.flatnonzero(c)
            i = i[np.lexsort((i, -c[i]))[: self.k]]
            if len(i) < self.k:
                continue
            least = float(c[i[-1]])
            if not (bound[order[4:]] >= least - 1e-12).any():
                break
        return i, c[i]

    def vote(self, i: np.ndarray, cosine: np.ndarray) -> float:
        w = self.votes[i] / (MARGIN + np.maximum(0.0, 1 - cosine))
        # a vote by the labels' frequencies at full distance
        return float(((w * self.labels[i]).sum() + min(max(self.share, 1e-3), 1 - 1e-3)) / (w.sum() + 1.0))

    def _fit(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """A logistic curve from the log odds of votes without oneself to the labels, which count by their frequency."""
        p = np.array([self.vote(*self.nearest(t, q, i)) for i, (t, q) in enumerate(bags)])
        x, y, c = np.log(p / (1 - p)), self.labels, self.votes
        a, b = 1.0, 0.0
        for _ in range(50):
            s = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = np.maximum(c * s * (1 - s), 1e-9)
            g = np.array([(c * (s - y) * x).sum() + 0.1 * (a - 1), (c * (s - y)).sum() + 0.1 * b])
            step = np.linalg.solve([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]], g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        if a > 0:
            self.a, self.b = float(a), float(b)

    def score(self, text: str | None) -> tuple[float, list, list[str]]:
        """Probability of label 1, the nearest examples' ids, and the weightiest terms that the text shares with the examples."""
        if not text or not self.ids:
            return self.share, [], []
        terms, q = self.vector(text)
        i, cosine = self.nearest(terms, q)
        if not len(i):
            return self.share, [], []
        p = self.vote(i, cosine)
        s = 1 / (1 + np.exp(-np.clip(self.a * np.log(p / (1 - p)) + self.b, -30, 30)))
        top = np.lexsort((terms, -q))[:5]
        return float(s), [self.ids[j] for j in i[:5].tolist()], [self.names[t].strip() for t in terms[top].tolist()]

    def __getstate__(self):
        return self.__dict__ | {"memo": None, "dense": None, "places": None}

    def __setstate__(self, state):
        self.__dict__ |= state | {"memo": _Memo(state["terms"])}


def _even(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_examples: int = MAX_EXAMPLES, max_chars: int = MAX_CHARS) -> Nearest:
    """Fit on a bounded sample of the labelled rows."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id IS NOT NULL")
    counts = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return Nearest([])
    half = max_examples // 2
    few = []
    for y, n in counts.items():
        room = half + max(0, half - counts.get(1 - y, 0))
        # the rows of the least hashes; the rate only keeps the sort small
        drawn = known.filter((F.col("_y") == y) & (_even("_id") < min(1.0, 2.0 * room / n + 1e-3))).distinct()
        few.append(drawn.orderBy(_even("_id"), "_id").limit(room))
    few = few[0].unionByName(few[1]) if len(few) > 1 else few[0]
    body = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # max_examples rows of two numbers
    text = body.join(F.broadcast(few) if small(few, 16, max_examples) else few, "_id").filter(F.length("_text") <= max_chars).distinct()
    chars = text.agg(F.sum(F.length("_text"))).first()[0] or 0
    text = text.filter(_even("_text") < 0.9 * max_chars / chars) if chars > max_chars else text
    rows = text.orderBy(_even("_text"), "_id", "_y").limit(max_examples).collect()
    return Nearest([(r._id, r._text, r._y) for r in rows], share=counts.get(1, 0) / total)


def scored(docs: DataFrame, model: Nearest, text_col: str = "text") -> DataFrame:
    """docs with score, evidence (the ids of the nearest examples) and terms shared with the examples."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    outputs = ("score", "evidence", "terms")
    keep = [i for i, c in enumerate(docs.columns) if c not in outputs]
    names, at = [f"c{i}" for i in keep], len(keep)
    fields = docs.schema.fields
    rows = docs.toDF(*(f"c{i}" for i in range(len(fields)))).select(*names, F.col(f"c{docs.columns.index(text_col)}").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                got = [m.score(x) for x in part.column(at).to_pylist()]
                cols = [pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.list_(pa.int64())), pa.array([x[2] for x in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *cols], names=[*names, *outputs])
        m.memo.clear()
        trim()

    schema = StructType()
    for n, i in zip(names, keep, strict=True):
        schema = schema.add(n, fields[i].dataType)
    schema = schema.add("score", DoubleType()).add("evidence", ArrayType(LongType())).add("terms", ArrayType(StringType()))
    return rows.mapInArrow(run, schema).toDF(*(docs.columns[i] for i in keep), *outputs)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.filter(~held_out("doc_id")))
    found = scored(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "terms")
