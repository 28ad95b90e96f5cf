"""SimHash near-duplicates: fingerprints, pivot distance tables, linked components.

``fingerprints`` gives each text a 64-bit SimHash of its word shingles.
``links`` finds every pair of distinct fingerprints within ``max_bits`` differing
bits and returns enough of the pairs to connect the same components. Fingerprints
are first dealt to blocks that any linked pair must share (the 64 bits are cut into
``max_bits + 2`` segments; two of them agree), so nothing is compared with all of
the table. In a block, a table of Hamming distances to reference fingerprints
(pivots) is computed; by the triangle inequality a pair whose distance vectors
differ by more than ``max_bits`` in any coordinate is discarded, and only survivors
are verified. A block with more than ``BLOCK`` fingerprints is dealt again by more
bits, so no task gets an unbounded block.

Rows: a null text counts as empty; a text without words has fingerprint zero and
links like any other; a row without id links like any other too, and has the smallest id that it
reaches, null if it reaches none. Repeated rows get the same result; of rows that share an id each has its own text's
component. Empty tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, numbered, release, small

#: Distinct fingerprints that one block may hold before it is dealt again by more bits.
BLOCK = 1024
PIVOTS = 16
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, len(words) - k + 1)


def simhash(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprint of each array of hashes: a bit is 1 if set in over half of them.

    Bits are counted in byte lanes of 64-bit words, up to 255 hashes at a time.
    """
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, n = np.concatenate([hashes[i] for i in full]), sizes[full]
    pieces = (n + 254) // 255
    first = np.repeat(np.cumsum(n) - n, pieces)
    starts = first + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    owners = np.cumsum(pieces) - pieces
    fp = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(j)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owners, axis=0)
        for b in range(8):
            fp |= (2 * counts[:, b] > n).astype(np.uint64) << np.uint64(8 * b + j)
    out[full] = fp
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, len(texts), 512):
                hashes = [shingle_hashes(x.as_py() or b"", k) for x in texts[at : at + 512]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 512], pa.array(simhash(hashes).view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(max_bits: int) -> list[int]:
    edges = np.linspace(0, 64, max_bits + 3).round().astype(int)
    segments = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(segments, 2)]


def _finer(mask: int, max_bits: int) -> list[int]:
    """mask with one more segment of the other bits; a linked pair that agrees on mask agrees on one of these."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(rest, np.int64), max_bits + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_links(masks: np.ndarray, values: np.ndarray, fps: np.ndarray, max_bits: int, pivots: np.ndarray, earlier: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that join the components within blocks of equal (mask, value); rows come sorted by these.

    earlier: for a mask, masks of which the pair's agreement means that another block sees it.
    """
    n = len(fps)
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    cut = np.r_[True, (masks[1:] != masks[:-1]) | (values[1:] != values[:-1])]
    block = np.cumsum(cut) - 1
    order = np.lexsort((table[:, 0], block))
    block, table, f, m = block[order], table[order], fps[order], masks[order]
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    live, lag = np.arange(n - 1), 1
    while len(live):
        # rows are sorted by the first pivot distance: once it differs too much it does for larger lags
        live = live[live + lag < n]
        live = live[(block[live] == block[live + lag]) & (table[live + lag, 0] - table[live, 0] <= max_bits)]
        other = live + lag
        near = np.abs(table[live] - table[other]).max(axis=1) <= max_bits if len(live) else np.zeros(0, bool)
        a, b = live[near], other[near]
        diff = f[a] ^ f[b]
        ok = np.bitwise_count(diff) <= max_bits
        a, b, diff = a[ok], b[ok], diff[ok]
        if len(a):
            seen = np.zeros(len(a), bool)
            for mask in np.unique(m[a]):
                at = m[a] == mask
                for e in earlier.get(int(mask), ()):
                    seen[at] |= (diff[at] & np.uint64(e)) == 0
            a, b = a[~seen], b[~seen]
            fresh = parent[a] != parent[b]
            for x, y in zip(a[fresh].tolist(), b[fresh].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    left.append(x)
                    right.append(y)
        lag += 1
        if lag % 64 == 0:
            while (parent != (up := parent[parent])).any():
                parent = up
    return order[np.array(left, np.int64)], order[np.array(right, np.int64)]


def links(nodes: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(u, v) with u > v: links that connect the same nodes as all pairs within max_bits would.

    nodes: (node long, fp long), fp distinct.
    """
    first = _masks(max_bits)
    earlier = {m: first[:i] for i, m in enumerate(first)}
    rng = np.random.default_rng(7)
    pivots = rng.integers(0, 1 << 64, PIVOTS, dtype=np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = up[x]
            return x

        def work(cols: list[np.ndarray]) -> None:
            masks, values, fps, ids = cols
            a, b = block_links(masks, values, fps, max_bits, pivots, earlier)
            for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    up[max(p, q)] = min(p, q)

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(c).astype(np.int64).view(np.uint64) if i < 3 else np.asarray(c).astype(np.int64) for i, c in enumerate(batch.columns)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            at = int(np.argmax(last)) if len(last) else 0
            if at:
                work([c[:at] for c in cols])
            held = [c[at:] for c in cols]
        if held is not None and len(held[0]):
            work(held)
        rows = [(x, find(x)) for x in list(up)]
        rows = [(x, y) for x, y in rows if x != y]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], names=["u", "v"])

    def dealt(df: DataFrame, masks: list[int]) -> DataFrame:
        options = F.array(*[F.lit(_signed(m)) for m in masks])
        return df.select("node", "fp", F.explode(options).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            node, fp, mask = (c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2)))
            rows = []
            for x, f, m in zip(node, fp, mask, strict=True):
                for y in known.setdefault(m, _finer(m & (1 << 64) - 1, max_bits)):
                    rows.append((x, f, _signed(y), _signed(f & (1 << 64) - 1 & y)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, names=["node", "fp", "mask", "value"])

    todo, found = dealt(nodes, first), []
    while True:
        hot = checkpointed(todo.groupBy("mask", "value").count().filter(F.col("count") > block).select(F.col("mask").alias("hm"), F.col("value").alias("hv")))
        any_hot = not hot.isEmpty()
        same = (F.col("mask") == F.col("hm")) & (F.col("value") == F.col("hv"))
        fits = todo.join(hot, same, "left_anti") if any_hot else todo
        spread = fits.select("mask", "value", "fp", "node").repartition("mask", "value").sortWithinPartitions("mask", "value")
        found.append(checkpointed(spread.mapInArrow(compare, "u long, v long")))
        if not any_hot:
            break
        todo = checkpointed(todo.join(hot, same, "left_semi").select("node", "fp", "mask").mapInArrow(finer, "node long, fp long, mask long, value long"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of an edge (u, v) the smallest node it is connected to.

    Alternating large-star and small-star rounds: nodes hang themselves on the
    smallest neighbour until only stars are left. Minima are combined before the
    shuffle; joins are between checkpointed tables, so that a hub's rows can be split.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = checkpointed(oriented(edges))
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        # large star: a larger neighbour v of u gets u's smallest
        edges = checkpointed(oriented(edges.join(low, F.col("v") == F.col("k")).select("u", F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))))
        low = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        # small star: u and its smaller neighbours get the smallest of them
        edges = checkpointed(oriented(edges.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))))
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest id reachable over links, null where no row reached has an id."""
    docs = checkpointed(fingerprints(df, id_col, text_col, k))
    nodes = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("node")))
    # an id that rows of several fingerprints share is no name of a node: the fingerprint is
    named = nodes.select(F.col("fp").alias("node"), "fp")
    roots = components(links(named, max_bits, block)).withColumnRenamed("node", "fp")
    rooted = checkpointed(nodes.join(roots, "fp", "left").select("fp", "node", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("node").alias("component_id"))
    roots = checkpointed(rooted.join(least, "root").select(F.col("fp").alias("f"), "component_id"))
    out = docs.join(roots, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component_id")
    release(df.sparkSession)
    return out


def grouped(rows: DataFrame, k: int = 3, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc, row, root) of (doc, row, text): rows whose fingerprints are linked have one root."""
    found = checkpointed(fingerprints(rows, "row", "text", k).withColumnRenamed("doc_id", "row").join(rows.select("doc", "row"), "row"))
    nodes = found.select(F.col("fp").alias("node"), "fp").distinct()
    roots = checkpointed(components(links(checkpointed(nodes), max_bits, block)))
    return found.join(roots, F.col("fp") == F.col("node"), "left").select("doc", "row", F.coalesce("root", "fp").alias("root"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=grouped, **options) -> DataFrame:
    """The rows of docs less all but one of each near-duplicate group: the smallest id stays.

    ``groups`` takes (doc, row, text) and gives each row's group as (doc, row, root). Rows without id are rows like others and come
    last in their group; of rows that share an id each goes or stays for its own group, and of equal rows one stays.
    """
    rows = numbered(docs)
    at = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    keyed = rows.select(F.col(f"c{at[id_col]}").cast("long").alias("doc"), "row", F.col(f"c{at[text_col]}").cast("string").alias("text"))
    found = checkpointed(groups(keyed, **options))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first"), F.count("*").alias("n"))
    stays = checkpointed(first.select(F.col("first.doc").alias("_doc"), F.col("first.row").alias("_row")))
    gone = found.join(stays, (F.col("row") == F.col("_row")) & F.col("doc").eqNullSafe(F.col("_doc")), "left_anti")
    gone = checkpointed(gone.select(F.col("doc").alias("_doc"), F.col("row").alias("_row")))
    gone = F.broadcast(gone) if small(gone, 24) else gone
    kept = rows.join(gone, (F.col("row") == F.col("_row")) & F.col(f"c{at[id_col]}").cast("long").eqNullSafe(F.col("_doc")), "left_anti")
    return kept.drop("row").toDF(*docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprints and components of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
