"""Near-duplicates by exact Jaccard similarity of word shingles.

Texts are sets of hashes of their ``k``-word shingles; two are linked if their Jaccard
similarity is at least ``similarity``. In any one order of all shingles, linked sets of sizes
a and b share one of their first a - ceil(similarity * a) + 1 and b - ceil(similarity * b) + 1
(the prefixes), so sets that meet at no prefix shingle are never compared, and no
linked pair is missed. Shingles in many prefixes come last in the order: what many texts
have in common is in a prefix only if a text has little else.

Equal sets are one node. The sets lie in files in the shared folder, of which tasks read
single sets. Nodes with a common prefix shingle meet in one task; pairs that are connected already,
or that differ too much in size or in what is left behind the shingle, aren't read. A task
returns a forest of verified pairs; ``simhash.components`` connects the tasks' forests.

``grouped`` can start from SimHash fingerprints: nodes whose fingerprints are linked are verified on their sets first, and what these
links connect is not compared again. As fingerprints within few bits miss most pairs near the least similarity, prefixes find the others.

Rows: a null text counts as empty; texts without words have the empty set and are alike. Texts
of fewer words than ``k`` are one shingle. ``near_duplicates`` links rows without id to nothing; ``grouped`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, filesystem, numbered, partitions, release, scratch
from .simhash import components, shingle_hashes
from .simhash import links as fingerprint_links

K = 5
SIMILARITY = 0.8
#: Prefixes that a shingle may be in before it is moved to the end of the order, at least.
COMMON = 32
#: Shingles at the end of the order, about, at most; sent to the workers.
MOVED = 1_000_000
#: Hashes of sets, and pairs, that a worker remembers.
MEMO = 4_000_000
PAIRS = 200_000
_AT = 40  # bits of a set's place in its file


def prefix_length(n: int, similarity: float = SIMILARITY) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


class Sets:
    """Reads sets from the files that ``written`` made; loc is a file's number and the set's place in it. Few files are open at a time."""

    OPEN = 32

    def __init__(self, base: str) -> None:
        self.store, self.path = filesystem(base)
        self.files: dict[int, pa.NativeFile] = {}

    def read(self, loc: int, n: int) -> np.ndarray:
        number = loc >> _AT
        if (f := self.files.pop(number, None)) is None:
            while len(self.files) >= self.OPEN:
                self.files.pop(next(iter(self.files))).close()  # the longest unused
            f = self.store.open_input_file(f"{self.path}/{number}.u64")
        self.files[number] = f
        return np.frombuffer(f.read_at(8 * n, 8 * (loc & (1 << _AT) - 1)), np.uint64)


def written(rows: DataFrame, base: str, k: int) -> DataFrame:
    """(doc, row, fp, fp2, n, loc) of each (doc, row, text): its set's hash (two of 64 bits), size and place.

    A part of the rows is a file, of the part's number. rows are a scan of files, so all attempts of a task write the same bytes; each writes a file of its own name, which
    takes the part's name once it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(base)
        store.create_dir(path, recursive=True)
        number, at = TaskContext.get().partitionId(), 0
        own = f"{path}/{number}-{TaskContext.get().taskAttemptId()}.part"
        with store.open_output_stream(own) as f:
            for batch in batches:
                texts = batch.column(2).cast(pa.binary())
                fps, more, sizes, locs = [], [], [], []
                for x in texts:
                    s = np.unique(shingle_hashes(x.as_py() or b"", k)).tobytes()
                    f.write(s + bytes(8))  # the place of an empty set is its own too
                    fps.append(xxh64_intdigest(s, 7))
                    more.append(xxh64_intdigest(s, 8))
                    sizes.append(len(s) // 8)
                    locs.append(number << _AT | at)
                    at += len(s) // 8 + 1
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, more)), pa.array(sizes, pa.int64()), pa.array(locs, pa.int64())], names=["doc", "row", "fp", "fp2", "n", "loc"])
        store.move(own, f"{path}/{number}.u64")

    return rows.select("doc", "row", "text").mapInArrow(run, "doc long, row long, fp long, fp2 long, n long, loc long")


def prefixes(nodes: DataFrame, base: str, last: np.ndarray, similarity: float) -> DataFrame:
    """(key, node, size, start) for each prefix shingle of each node; size holds the set's size and the shingle's position.

    last: sorted shingles that come at the end of the order; the others are ordered by their hashes.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, end = Sets(base), shared.value
        for batch in batches:
            keys, counts = [], []
            node, n, start = (np.asarray(batch.column(i)) for i in range(3))
            for place, size in zip(node.tolist(), n.tolist(), strict=True):
                s, p = sets.read(place, size), prefix_length(size, similarity)
                if len(end):
                    moved = end[np.minimum(np.searchsorted(end, s), len(end) - 1)] == s
                    s = np.r_[s[~moved], s[moved]]
                keys.append(s[:p])
                counts.append(p)
            c = np.array(counts, np.int64)
            position = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            cols = [flat.view(np.int64), np.repeat(node, c), np.repeat(n, c) << 32 | position, np.repeat(start, c)]
            for at in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in cols], names=["key", "node", "size", "start"])

    return nodes.select("node", "n", "start").mapInArrow(run, "key long, node long, size long, start long")


def common_shingles(nodes: DataFrame, base: str, similarity: float, most: int) -> np.ndarray:
    """Sorted shingles in more than ``most`` prefixes (or more, if they would be over ``MOVED``), as far as two rounds of counting find them."""
    last = np.empty(0, np.uint64)
    for _ in range(2):
        rows = prefixes(nodes, base, last, similarity).groupBy("key").count().filter(F.col("count") > most)
        rows = checkpointed(rows)
        total = rows.agg(F.sum("count")).first()[0] or 0
        found = rows.filter(F.col("count") > max(most, total // MOVED)).select("key").toArrow().column(0).to_numpy()
        release(nodes.sparkSession)
        new = np.setdiff1d(found.astype(np.int64).view(np.uint64), last)
        last = np.union1d(last, new)
        if not len(new):
            break
    return last


class Forest:
    """Verified pairs that connect the nodes a task has seen."""

    def __init__(self, base: str, similarity: float) -> None:
        self.sets, self.similarity = Sets(base), similarity
        self.up: dict[int, int] = {}
        self.known: dict[int, np.ndarray] = {}
        self.held = 0
        self.unlike: set[tuple[int, int]] = set()

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def set_of(self, loc: int, n: int) -> np.ndarray:
        if (got := self.known.get(loc)) is None:
            if self.held > MEMO:
                self.known, self.held = {}, 0
            got = self.known[loc] = self.sets.read(loc, n)
            self.held += n
        return got

    def linked(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether the sets of two (node, n) are similar; a node is the place of its set."""
        pair = (a[0], b[0]) if a[0] < b[0] else (b[0], a[0])
        if pair in self.unlike:
            return False
        s, t = (self.set_of(*a), self.set_of(*b)) if a[1] >= b[1] else (self.set_of(*b), self.set_of(*a))
        both = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
        if both >= self.similarity * (a[1] + b[1] - both) - 1e-9:
            return True
        if len(self.unlike) >= PAIRS:
            self.unlike.clear()
        self.unlike.add(pair)
        return False

    def join(self, a: int, b: int) -> None:
        p, q = self.find(a), self.find(b)
        self.up[max(p, q)] = min(p, q)

    def group(self, node: np.ndarray, size: np.ndarray, start: np.ndarray) -> None:
        """Connect the nodes that have a shingle in common; start: a node that is known to be connected, or -1."""
        for i in np.flatnonzero(start >= 0).tolist():
            self.join(int(node[i]), int(start[i]))
        n, left = size >> 32, (size >> 32) - (size & (1 << 32) - 1)
        rows = list(zip(node.tolist(), n.tolist(), strict=True))
        # near copies in a large group mostly link to its first row, which leaves few pairs
        if len(rows) > 16:
            for i in range(1, len(rows)):
                if self.find(rows[0][0]) != self.find(rows[i][0]) and self.near(n, left, 0, i) and self.linked(rows[0], rows[i]):
                    self.join(rows[0][0], rows[i][0])
        roots = np.array([self.find(r[0]) for r in rows])
        names, counts = np.unique(roots, return_counts=True)
        if len(names) == 1:
            return
        # all pairs of different roots have one that is not of the most frequent root
        for i in np.flatnonzero(roots != names[counts.argmax()]).tolist():
            while True:
                best = np.minimum(left[i], left)
                can = (roots != roots[i]) & (best * (1 + self.similarity) >= self.similarity * (n[i] + n) - 1e-6)
                for j in np.flatnonzero(can).tolist():
                    if self.linked(rows[i], rows[j]):
                        self.join(rows[i][0], rows[j][0])
                        root = self.find(rows[i][0])
                        roots[(roots == roots[i]) | (roots == roots[j])] = root
                        break
                else:
                    break

    def near(self, n: np.ndarray, left: np.ndarray, i: int, j: int) -> bool:
        best = min(left[i], left[j])
        return best * (1 + self.similarity) >= self.similarity * (n[i] + n[j]) - 1e-6

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


def fingerprinted(docs: DataFrame, marks: DataFrame, base: str, similarity: float, max_bits: int = 3) -> DataFrame:
    """(u, v) with u > v: nodes whose fingerprints are linked and whose sets are similar.

    docs: as ``written`` gives them; marks: (row, mark), the fingerprint of each row. A node has the mark of its first row; of nodes with one mark each is compared with the first.
    """
    marked = docs.select("row", "fp", "fp2", "n", "loc").join(marks, "row")
    nodes = checkpointed(marked.groupBy("fp", "fp2", "n").agg(F.min(F.struct("loc", "mark")).alias("x")).select(F.col("x.loc").alias("node"), "n", F.col("x.mark").alias("mark")))
    heads = checkpointed(nodes.groupBy("mark").agg(F.min(F.struct("node", "n")).alias("x")).select("mark", F.col("x.node").alias("head"), F.col("x.n").alias("head_n")))
    near = fingerprint_links(heads.select(F.col("mark").alias("node"), F.col("mark").alias("fp")), max_bits)
    of = lambda side: heads.select(F.col("mark").alias(side), F.col("head").alias(f"{side}_head"), F.col("head_n").alias(f"{side}_n"))
    across = near.join(of("u"), "u").join(of("v"), "v").select(F.col("u_head").alias("a"), F.col("u_n").alias("a_n"), F.col("v_head").alias("b"), F.col("v_n").alias("b_n"))
    within = nodes.join(heads, "mark").filter("node <> head").select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("head").alias("b"), F.col("head_n").alias("b_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(base, similarity)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [(max(a, b), min(a, b)) for a, n, b, m in rows if n and m and forest.linked((a, n), (b, m))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    return checkpointed(across.unionByName(within).mapInArrow(run, "u long, v long"))


def links(nodes: DataFrame, base: str, similarity: float, most: int) -> DataFrame:
    """(u, v) with u > v: links that connect the same nodes as all similar pairs would."""
    last = common_shingles(nodes, base, similarity, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(base, similarity), None
        for batch in batches:
            cols = [np.asarray(c).astype(np.int64) for c in batch.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            starts = np.r_[0, np.flatnonzero(np.diff(cols[0])) + 1]
            ends = np.r_[starts[1:], len(cols[0])]
            for a, b in zip(starts[:-1][(ends - starts)[:-1] > 1].tolist(), ends[:-1][(ends - starts)[:-1] > 1].tolist(), strict=True):
                forest.group(*(c[a:b] for c in cols[1:]))
            held = [c[starts[-1] :] for c in cols]
        if held is not None and len(held[0]) > 1:
            forest.group(*held[1:])
        rows = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], names=["u", "v"])

    # about (1 - similarity) of all hashes, as rows of 24 bytes and what they take in a shuffle
    size = int((nodes.agg(F.sum("n")).first()[0] or 0) * (1 - similarity) * 36)
    met = prefixes(nodes, base, last, similarity).repartition(partitions(nodes, size), "key").sortWithinPartitions("key")
    return checkpointed(met.mapInArrow(run, "u long, v long"))


def grouped(rows: DataFrame, k: int = K, similarity: float = SIMILARITY, most: int = COMMON, fingerprints: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(doc, row, root) of (doc, row, text): rows that links connect have one root.

    fingerprints: ``simhash.fingerprints``, to start from what they link; the groups are the same.
    """
    spark = rows.sparkSession
    base = scratch(spark, "shingles")
    docs = checkpointed(written(rows, base, k))
    # equal sets are one node, named after the least place of one
    nodes = checkpointed(docs.groupBy("fp", "fp2", "n").agg(F.min("loc").alias("node")))
    known = None if fingerprints is None else fingerprinted(docs, fingerprints(rows, "row", "text").toDF("row", "mark"), base, similarity)
    start = F.lit(-1).cast("long") if known is None else F.coalesce("start", F.lit(-1))
    at = nodes if known is None else checkpointed(nodes.join(checkpointed(components(known)).withColumnRenamed("root", "start"), "node", "left"))
    found = links(at.withColumn("start", start), base, similarity, most)
    roots = components(found if known is None else found.unionByName(known))
    named = checkpointed(nodes.join(roots, "node", "left").select(F.col("fp").alias("f"), F.col("fp2").alias("f2"), F.col("n").alias("m"), F.coalesce("root", "node").alias("root")))
    out = checkpointed(docs.join(named, (F.col("fp") == F.col("f")) & (F.col("fp2") == F.col("f2")) & (F.col("n") == F.col("m"))).select("doc", "row", "root"))
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, similarity: float = SIMILARITY, most: int = COMMON) -> DataFrame:
    """(doc_id, component_id) for each row; component_id is the smallest id reachable over links; null for rows without id."""
    rows = numbered(df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")))
    found = grouped(rows.filter("c0 IS NOT NULL").select(F.col("c0").alias("doc"), "row", F.col("c1").alias("text")), k, similarity, most)
    least = found.groupBy("root").agg(F.min("doc").alias("component_id"))
    none = rows.filter("c0 IS NULL").select(F.col("c0").alias("doc_id"), F.lit(None).cast("long").alias("component_id"))
    return found.join(least, "root").select(F.col("doc").alias("doc_id"), "component_id").unionByName(none)
