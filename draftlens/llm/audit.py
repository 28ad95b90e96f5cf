"""How filters interact: what each removes after any others, by part and in every order.

Each filter's failures, the labels and the parts of a partition's rows are packed into bit sets (64 rows a
word; the rows of a part begin at a word of their own, so a part is a range of words). For each set of filters that
may stand before another, AND-NOT leaves the rows that are still there, and popcounts, added up
by ranges of words, give the counts of all parts at once. With n filters there are n * 2^(n-1) pairs of (filters
before, filter); a partition returns that many rows for each part, Spark adds them up, and an order is a path through
these counts, so the 120 orders of five filters cost no further pass.

The failure of having an earlier equal text needs all texts: rows are (id, SHA-256 of the text), each
hash's smallest id is an aggregate that is combined before the shuffle, and rows look it up. Hashes (and ids, for the labels) of over a
thousandth of all rows, at most a thousand then, are looked up in a broadcast table, all others by a join.

Rows: a null text is empty. A row without id fails E against no row and makes none fail; rows of one id and text don't make each
other fail. A row has a label if any row of ``labels`` with its id has it. A null part counts with the empty string. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stored

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost", "unique_fails")
#: Keys of more than one row in so many are looked up in a broadcast table; there can't be more of them.
HOT = 1000
#: Rows that are packed together; parts whose counts a task holds before it sends them on.
CHUNK = 1 << 16
HELD = 4096


def text_failures(text: str) -> dict[str, Column]:
    """The failures that a text shows by itself, by the filter's letter."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 2 * F.length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def looked_up(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """rows with the columns of ``table``, which has one row for each key, ``key`` among them; nulls where it has none.

    Rows of a key that is in over one of ``HOT`` rows look it up in a broadcast table of at most ``HOT`` rows.
    """
    often = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).count().filter(F.col("count") * HOT > total).select("_k")
    hot = stored(often, "hot")
    mine = table.withColumnRenamed(key, "_key")
    near = mine.join(F.broadcast(hot), F.col("_key") == F.col("_k"), "left_semi")
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), F.col(key) == F.col("_k"), "left").drop("_k")
    of_hot = marked.filter(F.col("_hot") | F.col(key).isNull()).drop("_hot").join(F.broadcast(near), F.col(key) == F.col("_key"), "left").drop("_key")
    of_rest = marked.filter(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot").join(mine, F.col(key) == F.col("_key"), "left").drop("_key")
    return of_hot.unionByName(of_rest)


def earlier_equal(rows: DataFrame, total: int) -> DataFrame:
    """rows (id, hash, ...) with ``E``: whether a row of a smaller id has the same hash."""
    firsts = rows.groupBy("hash").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    found = looked_up(rows, "hash", firsts, total)
    return found.withColumn("E", F.coalesce(F.col("id") > F.col("_first"), F.lit(False))).drop("_first", "hash")


def subsets(letters: str) -> list[tuple[str, str]]:
    """(filters before, filter) for all filters and sets of others."""
    return [("".join(s), f) for f in letters for n in range(len(letters)) for s in combinations([x for x in letters if x != f], n)]


class Index:
    """Bit sets of rows: a bit is a row, and each part begins at a word of its own."""

    def __init__(self, part: np.ndarray, flags: dict[str, np.ndarray]) -> None:
        order = np.argsort(part, kind="stable")
        self.parts, start, size = np.unique(part[order], return_index=True, return_counts=True)
        words = -(-size // 64)
        self.starts = np.r_[0, np.cumsum(words)[:-1]].astype(np.int64)
        self.place = np.arange(len(part)) - np.repeat(start, size) + np.repeat(self.starts * 64, size)
        self.n = int(words.sum())
        self.order = order
        self.rows = self.packed(np.ones(len(part), bool))
        self.sets = {k: self.packed(v) for k, v in flags.items()}

    def packed(self, flag: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.n * 64, bool)
        bits[self.place] = flag[self.order]
        return np.packbits(bits).view(np.uint64)

    def count(self, bits: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.starts)

    def counts(self, letters: str) -> np.ndarray:
        """For each part and each of ``subsets`` the numbers of ``COUNTS``."""
        alive = {"": self.rows}
        for n in range(1, len(letters) + 1):
            for s in combinations(letters, n):
                alive["".join(s)] = alive["".join(s[:-1])] & ~self.sets[s[-1]]
        out = []
        unique = {f: self.count(alive["".join(x for x in letters if x != f)] & self.sets[f]) for f in letters}
        for before, f in subsets(letters):
            there, fails = alive[before], self.sets[f]
            lost = there & fails
            out.append([self.count(b) for b in (there & ~fails, lost, fails & ~there, lost & self.sets["good"], lost & self.sets["toxic"])] + [unique[f]])
        return np.array(out).transpose(2, 0, 1)


def interactions(rows: DataFrame, letters: str) -> DataFrame:
    """(part, before, filter, ``COUNTS``...) of rows (part, a flag for each letter, good, toxic)."""
    pairs = subsets(letters)
    flags = [*letters, "good", "toxic"]

    def sums(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(list(held.values())) if held else np.empty((0, len(COUNTS)), np.int64)
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(list(held), len(pairs)).tolist() if n else [], pa.string()), pa.array([b for b, _ in pairs] * n, pa.string()), pa.array([f for _, f in pairs] * n, pa.string()), *(pa.array(values[:, i], pa.int64()) for i in range(len(COUNTS)))],
            names=["part", "before", "filter", *COUNTS],
        )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def add(table: pa.Table) -> None:
            coded = table.column("part").combine_chunks().dictionary_encode()
            names = coded.dictionary.to_pylist()
            found = Index(np.asarray(coded.indices), {c: table.column(c).to_numpy() for c in flags})
            for p, values in zip(found.parts.tolist(), found.counts(letters), strict=True):
                held[names[p]] = held[names[p]] + values if names[p] in held else values

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= CHUNK:
                add(pa.Table.from_batches(waiting))
                waiting = []
            if len(held) >= HELD:
                yield sums(held)
                held = {}
        if sum(b.num_rows for b in waiting):
            add(pa.Table.from_batches(waiting))
        yield sums(held)

    made = rows.select("part", *flags).mapInArrow(index, f"part string, before string, filter string, {', '.join(f'{c} long' for c in COUNTS)}")
    return made.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])


def along_orders(found: DataFrame, letters: str) -> DataFrame:
    """The counts of ``interactions`` along every order of the filters, with each filter's removals over all orders."""
    spark = found.sparkSession
    steps = [("".join(o), k + 1, "".join(sorted(o[:k])), o[k]) for o in permutations(letters) for k in range(len(letters))]
    paths = spark.createDataFrame(steps, "filter_order string, step int, _before string, _filter string")
    times = F.create_map(*[F.lit(x) for n in range(len(letters)) for x in (n, factorial(n) * factorial(len(letters) - 1 - n))])
    shares = found.groupBy(F.col("part").alias("_part"), F.col("filter").alias("_of")).agg(F.sum(F.col("removed") * times[F.length("before")]).alias("shapley"))
    with_all = found.join(shares, (F.col("part") == F.col("_part")) & (F.col("filter") == F.col("_of")))
    out = with_all.join(F.broadcast(paths), (F.col("before") == F.col("_before")) & (F.col("filter") == F.col("_filter")))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in names])


def audited(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step; ``failures`` (over ``text``) by letter, and E (an earlier equal text) besides."""
    shown = failures if failures is not None else text_failures(text)
    letters = "".join(sorted([*shown, "E"]))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = F.unhex(F.sha2(body, 256)).alias("hash")
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), hashed, *[f.alias(k) for k, f in shown.items()]), "failures")
    total = rows.count()
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = looked_up(earlier_equal(rows, total), "id", marks, total)
    known = known.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    return along_orders(interactions(known, letters), letters)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: five filters over all documents, by source, in all 120 orders."""
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INT + (100 * len(list_distinct(w)) < 50 * len(w))::INT * 2 + (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT * 4
      + regexp_matches(t, '[#$%&*|]')::INT * 8 + coalesce(w.doc_id > first, false)::INT * 16 AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(letter, bit)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
p AS (
  SELECT filter_order, step::INT AS step, f.letter, f.bit, (SELECT coalesce(sum(x.bit), 0) FROM f x WHERE contains(left(filter_order, step - 1), x.letter))::INT AS before
  FROM o, range(1, 6) AS s(step) JOIN f ON f.letter = substr(filter_order, step, 1)
),
r AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & before > 0 AND fails & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost
  FROM g, p GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r
"""
