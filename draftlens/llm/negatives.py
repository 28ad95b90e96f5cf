"""Hard negatives for contrastive training: product quantisation with stored residual norms.

Components become integers, ``floor(256 x)``; a score is an integer inner product. Each pair of
components is replaced by the nearest of 256 centroids, and what remains once more by the nearest of 256 others
(two levels; the centroids are fitted on a bounded sample, ``SAMPLE`` rows). A row keeps its codes and, for each level, the norm of
what the codes leave, rounded up. With tables of an anchor's products with all centroids the score of a row is a sum
of looked-up numbers, to within

    |a.x - sum of the table's numbers|  <=  |a| * (the row's residual norm)

by Cauchy and Schwarz. So the filter is rigorous: a row whose upper bound is below the k-th best lower bound,
or whose bounds miss the window, can't be in the result. The second level is looked up only for rows that the
first leaves; integer vectors are read, by their place in the blocks' files, only for rows that both leave, and
these are scored exactly.

Rows are packed into blocks; each block of anchors is sent to each block of rows (a stated query set against all
rows) and carries codes, norms, ids and labels, not vectors. First every anchor's positives are found, then, with
the windows that their scores give, the negatives; each tile returns a few rows an anchor, which are ranked by a window
whose limit Spark applies before the shuffle.

Of rows with one label and equal integer vectors only the first by id can be in a result (ties go to the smaller
id), so ``k`` + 1 of them are kept, by a rank that is limited before the shuffle too; a vector that a third of all rows have is no hot key.

Rows: without id, label or vector, or with a null or non-finite component, they take no part; a zero vector does, an empty one
does not. Vectors only meet those with as many components. Rows that repeat an id are rows each, as anchors too;
none is its own positive or negative. Integers are held to 32 bits and scores to 64 (the ends of the range stand for what lies beyond).
Fewer rows than asked for are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Mapped, Writer, numbered, scratch, small, stored, trim

#: Rows in a block, and anchors.
BLOCK = 16384
ANCHORS = 128
#: Components in a part of a vector, and centroids of a part.
PART = 2
CENTROIDS = 256
#: Rows that the centroids are fitted on: the first by a hash, and no more than this many components in all.
SAMPLE = 8192
SAMPLE_COMPONENTS = 1 << 22
SCALE = 256


# --- product quantisation ----------------------------------------------------------------------


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = np.argmax(x[i : i + 8192] @ centres.T - half, axis=1)
    return out


def _centres(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n centroids of x by Lloyd's rounds from an even draw of its sorted rows; always the same ones for the same x."""
    start = x[np.lexsort(x.T[::-1])]
    centres = start[np.linspace(0, len(start) - 1, n).astype(int)].astype(np.float64)
    for _ in range(rounds):
        at = _nearest(x, centres)
        count = np.bincount(at, minlength=n)
        sums = np.stack([np.bincount(at, x[:, j], n) for j in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


class Quantiser:
    """Two levels of centroids for each part of vectors of one length."""

    def __init__(self, sample: np.ndarray) -> None:
        self.dim = sample.shape[1]
        self.cuts = [(i, min(i + PART, self.dim)) for i in range(0, self.dim, PART)]
        self.levels: list[list[np.ndarray]] = []
        left = sample.astype(np.float64)
        for _ in range(2):
            books = [_centres(left[:, a:b], CENTROIDS) for a, b in self.cuts]
            left = left - np.concatenate([c[_nearest(left[:, a:b], c)] for (a, b), c in zip(self.cuts, books, strict=True)], axis=1)
            self.levels.append(books)

    def encode(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the codes (uint8, one for each part) and residual norms, rounded up."""
        out, left = [], x.astype(np.float64)
        whole = np.linalg.norm(left, axis=1)
        for books in self.levels:
            codes = np.stack([_nearest(left[:, a:b], c) for (a, b), c in zip(self.cuts, books, strict=True)], axis=1)
            left = left - np.concatenate([c[codes[:, m]] for m, c in enumerate(books)], axis=1)
            # more than what rounding of the sums below, and to single precision, can add
            norm = np.linalg.norm(left, axis=1) * (1 + 1e-6) + whole * 1e-9 + 1e-6
            out.append((codes.astype(np.uint8), np.nextafter(norm.astype(np.float32), np.float32(np.inf))))
        return out

    def tables(self, anchor: np.ndarray) -> list[np.ndarray]:
        """For each level the anchor's products with all centroids of all parts, one after the other."""
        a64 = anchor.astype(np.float64)
        return [np.concatenate([c @ a64[a:b] for (a, b), c in zip(self.cuts, books, strict=True)]) for books in self.levels]


def fitted(rows: DataFrame) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors in the sample; other lengths are left to exact scores."""
    found = rows.select(F.size("q").alias("n"), "q").orderBy(F.xxhash64("row", F.lit(11)), "id").limit(SAMPLE).collect()
    out = {}
    for dim in sorted({r["n"] for r in found}):
        own = [r["q"] for r in found if r["n"] == dim][: max(1, SAMPLE_COMPONENTS // dim)]
        out[dim] = Quantiser(np.array(own, np.int64))
    return out


class Block:
    """A block's ids, labels, codes and norms; its vectors are read by place."""

    def __init__(self, row: dict, base: str) -> None:
        self.dim = row["dim"]
        self.ids, self.rows, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "labels"))
        parts = -(-self.dim // PART)
        # the codes as places in an anchor's table
        self.codes = [np.frombuffer(row[c], np.uint8).reshape(-1, parts) + np.arange(parts, dtype=np.int32) * CENTROIDS for c in ("codes0", "codes1") if row[c]]
        self.norms = [np.frombuffer(row[c], np.float32) for c in ("norms0", "norms1") if row[c]]
        self.vectors = Mapped(base, 1, np.array([0]), np.array([row["file"]]), np.array([row["at"]]), np.array([row["size"]])).array(0, np.int32).reshape(-1, self.dim)

    def bounds(self, level: int, tables: list[np.ndarray], norm: float, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of the rows ``at``, by the levels up to this one."""
        middle = np.zeros(len(at))
        for i in range(level + 1):
            middle += tables[i][self.codes[i][at]].sum(axis=1)
        slack = norm * self.norms[level][at].astype(np.float64)
        return middle - slack, middle + slack

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer scores of the rows ``at``."""
        x = self.vectors[at].astype(np.int64)
        most = int(np.abs(x).max(initial=0)) * int(np.abs(anchor).max(initial=0)) * self.dim
        if most < 1 << 62:
            return x @ anchor
        wide = x.astype(object) @ anchor.astype(object)
        return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in wide], np.int64)

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places within ``at`` of the k best: higher scores, then smaller ids."""
        # -score would overflow at the end of the range; ~score orders alike
        return np.lexsort((self.rows[at], self.ids[at], ~scores))[:k]


def _kth(x: np.ndarray, k: int) -> float:
    return -np.inf if len(x) < k else float(np.partition(x, len(x) - k)[len(x) - k])


def in_windows(block: Block, q: Quantiser | None, anchor: np.ndarray, at: np.ndarray, windows: list[tuple[float, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``at`` that may be among the k best of a window, with their exact scores."""
    if q is not None:
        tables, norm = q.tables(anchor), math.sqrt(float((anchor.astype(np.float64) ** 2).sum())) * (1 + 1e-9)
        for level in range(len(q.levels)):
            low, high = block.bounds(level, tables, norm, at)
            keep = np.zeros(len(at), bool)
            for least, most in windows:
                sure = _kth(low[(low >= least) & (high <= most)], k)
                keep |= (high >= max(least, sure)) & (low <= most)
            at = at[keep]
    return at, block.exact(anchor, at)


# --- blocks and tiles --------------------------------------------------------------------------

_BLOCK = "dim int, block int, ids binary, rows binary, labels binary, codes0 binary, norms0 binary, codes1 binary, norms1 binary, file long, at long, size long"


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    return table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim)


def _blocks(rows: DataFrame, size: int, books, base: str) -> DataFrame:
    """The rows in blocks of about ``size``; codes in the result, vectors in files below ``base``."""
    n = max(1, -(-rows.count() // size))

    def pack(key, table):
        dim, block = key[0].as_py(), key[1].as_py()
        x = _vectors(table, dim)
        out = Writer(base, secrets.randbits(62))  # a task packs several blocks
        file, at, length = out.put(x)
        out.close()
        q = books.value.get(dim)
        codes = q.encode(x) if q is not None else [(np.empty(0, np.uint8), np.empty(0, np.float32))] * 2
        ints = [table.column(c).to_numpy().astype(np.int64) for c in ("id", "row", "label")]
        cells = [*ints, *(a for level in codes for a in level)]
        trim()
        return pa.table([pa.array([dim], pa.int32()), pa.array([block], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells), *(pa.array([v], pa.int64()) for v in (file, at, length))], names=[c.split()[0] for c in _BLOCK.split(", ")])

    dealt = rows.select("id", "row", "label", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("row", "id"), F.lit(n)).cast("int").alias("block"))
    return stored(dealt.groupBy("dim", "block").applyInArrow(pack, _BLOCK), "blocks")


def _tiles(blocks: DataFrame, anchors: DataFrame, tile, out: str, base: str, books, size: int) -> DataFrame:
    """``tile`` of each block with each block of anchors: (anchor's id, row, label, vector, positives) to rows of ``out``."""
    n = max(1, -(-anchors.count() // size))
    packed = (
        anchors.withColumn("part", F.pmod(F.xxhash64("row", "id"), F.lit(n)).cast("int"))
        .groupBy(F.size("q").alias("d"), "part")
        .agg(F.collect_list(F.struct("id", "row", "label", "q", "positives")).alias("anchors"))
    )
    places = blocks.select("dim", F.col("block").alias("to"))
    sent = packed.join(F.broadcast(places) if small(places, 16) else places, F.col("dim") == F.col("d")).select("d", "to", "anchors")
    met = blocks.join(sent, (F.col("dim") == F.col("d")) & (F.col("block") == F.col("to"))).drop("d", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                block, q = Block(row, base), books.value.get(row["dim"])
                found = []
                for a in row["anchors"]:
                    found += tile(block, q, a, np.array(a["q"], np.int64))
                schema = schema or [c.split()[0] for c in out.split(", ")]
                columns = list(zip(*found, strict=True)) if found else [[]] * len(schema)
                types = [pa.int32() if c.endswith(" int") else pa.int64() for c in out.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema)
            trim()

    return met.mapInArrow(run, out)


def mined(table: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    rows of the same label the first rows of other labels whose scores are within ``window`` hundredths of the positive's.

    is_anchor and label are expressions over the table's own columns.
    """
    spark = table.sparkSession
    plain = numbered(table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"), is_anchor.alias("is_anchor"))).toDF("id", "label", "v", "is_anchor", "row")
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-(1 << 31)), F.least(F.lit((1 << 31) - 1), F.floor(x.cast("double") * SCALE))).cast("int"))
    rows = plain.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0) & finite).select("id", "row", "label", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), whole.alias("q"))
    rows = stored(rows, "vectors")
    books = spark.sparkContext.broadcast(fitted(rows))
    base = scratch(spark, "vectors")
    equal = Window.partitionBy("label", "q").orderBy("id", "row")
    first = rows.withColumn("_n", F.row_number().over(equal)).filter(F.col("_n") <= max(positives, negatives) + 1)
    blocks = _blocks(first, block, books, base)
    wanted = rows.filter("is_anchor")

    def alike(b: Block, q: Quantiser | None, a: dict, x: np.ndarray) -> list[tuple]:
        at = np.flatnonzero((b.labels == a["label"]) & ~((b.ids == a["id"]) & (b.rows == a["row"])))
        at, score = in_windows(b, q, x, at, [(-np.inf, np.inf)], positives)
        return [(a["id"], a["row"], int(b.ids[at[i]]), int(b.rows[at[i]]), int(score[i])) for i in b.first(at, score, positives)]

    low, high = window

    def unlike(b: Block, q: Quantiser | None, a: dict, x: np.ndarray) -> list[tuple]:
        ends = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in a["positives"]]  # whole numbers, so no rounding
        if not ends:
            return []
        at, score = in_windows(b, q, x, np.flatnonzero(b.labels != a["label"]), ends, negatives)
        out = []
        for p, (least, most) in zip(a["positives"], ends, strict=True):
            inside = (score >= least) & (score <= most)
            of = at[inside]
            out += [(a["id"], a["row"], p["no"], int(b.ids[of[i]]), int(b.rows[of[i]]), int(score[inside][i])) for i in b.first(of, score[inside], negatives)]
        return out

    none = F.array().cast("array<struct<no:int,id:bigint,score:bigint>>")
    near = _tiles(blocks, wanted.withColumn("positives", none), alike, "anchor long, anchor_row long, id long, near_row long, score long", base, books, anchors)
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "id", "near_row")
    near = near.withColumn("no", F.row_number().over(order("anchor", "anchor_row"))).filter(F.col("no") <= positives)
    near = near.filter(F.col("score") >= 0)  # of a negative score no window holds anything
    near = stored(near.groupBy("anchor", "anchor_row").agg(F.sort_array(F.collect_list(F.struct("no", "id", "score"))).alias("positives")), "positives")
    again = wanted.join(near, (F.col("id") == F.col("anchor")) & (F.col("row") == F.col("anchor_row"))).drop("anchor", "anchor_row")
    far = _tiles(blocks, again, unlike, "anchor long, anchor_row long, no int, id long, near_row long, score long", base, books, anchors)
    far = far.withColumn("rank", F.row_number().over(order("anchor", "anchor_row", "no"))).filter(F.col("rank") <= negatives)
    given = near.select(F.col("anchor").alias("_a"), F.col("anchor_row").alias("_r"), F.inline("positives").alias("_no", "positive_id", "positive_score"))
    joined = far.join(given, (F.col("anchor") == F.col("_a")) & (F.col("anchor_row") == F.col("_r")) & (F.col("no") == F.col("_no")))
    return joined.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: ten negatives for each of the five positives of every hundredth vector; a seventh of the labels is moved on by one."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mined(table, F.col("vec_id") % 100 == 0, moved)


OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, b.r AS b,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)
), p AS (
  SELECT a, anchor_id, no, id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) AS no FROM s WHERE alike) WHERE no <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.no ORDER BY s.score DESC, s.id, s.b)::INT AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
