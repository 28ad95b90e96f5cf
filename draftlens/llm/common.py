"""Helpers that the corpus operators share: scratch space, mapped files, running totals."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process (as in tests) a fresh local one is set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="corpus-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else "file://" + os.path.abspath(base)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as compressed Parquet in the shared folder and read again; for wide intermediate rows."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``stored`` frame that nothing reads any more."""
    jvm = spark._jvm
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Give a Python worker's freed memory back; workers are used again by later stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have none
        pass


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> bool:
    """Whether df, measured now, is within the session's broadcast threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return (df.count() if rows is None else rows) * row_bytes <= limit


def input_bytes(df: DataFrame, text: str) -> int:
    """Bytes of input, from the plan's statistics; counted where the plan has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 60:
        return size
    return int(df.select(F.sum(F.octet_length(text))).first()[0] or 0)


def power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def partitions(df: DataFrame, size: int, each: int = 32 << 20) -> int:
    """Shuffle partitions for about so many bytes: the session's number at least."""
    return min(1 << 16, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each)))


def _is_scan(df: DataFrame) -> bool:
    """Whether df only selects from files, so that each reading gives the same rows by file and place."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.nodeName() in ("LogicalRelation", "Relation") or plan.nodeName().startswith(("LogicalRelation", "Relation"))


def numbered(docs: DataFrame, *extra: Column) -> DataFrame:
    """docs with columns c0, c1, ... in place of its own, and ``row``, which tells rows with one id apart.

    A row is the hash of its file and its place there: however often, and on whatever executors, the file is read,
    it is the same. What is no plain scan of Parquet files is written to the shared folder first. Columns that stand for
    the user's names can't clash with any. extra: more columns, from the files' metadata.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row")
    if _is_scan(docs):
        try:
            return plain.select("*", row, *extra)
        except AnalysisException:  # files of another format
            pass
    return stored(plain, "rows").select("*", row, *extra)


def in_order(docs: DataFrame) -> DataFrame:
    """``numbered`` with ``position``, a number that grows in the order in which the rows were written to the files."""
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    return numbered(docs, (F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias("position"))


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], rows: int) -> DataFrame:
    """df with, for each name of ``values``, the sum of the value over the rows before it in its group.

    ``order`` must end in a column that tells rows apart. The rows are cut into ranges of (group, order), so a group, and
    rows that only differ in the last column, may lie in any number of ranges and no task holds a whole group. The
    ranges are written, summed, the few sums of a group are added up, and a row adds what its range holds before it.
    Values must not be null. rows: about how many there are.
    """
    ranges = max(1, min(1 << 14, rows // 100_000))
    hidden = {name: f"_v{i}" for i, name in enumerate(values)}
    at = df.select("*", *[v.alias(hidden[n]) for n, v in values.items()])
    at = stored(at.repartitionByRange(ranges, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = at.groupBy(*group, "_part").agg(*[F.sum(h).alias(f"{h}_sum") for h in hidden.values()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = [F.coalesce(F.sum(f"{h}_sum").over(before), F.lit(0)).alias(f"{h}_base") for h in hidden.values()]
    sums = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), *base)
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = at.select("*", *[F.coalesce(F.sum(h).over(inside), F.lit(0)).alias(f"{h}_in") for h in hidden.values()])
    cond = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return at.join(sums, cond).select(*df.columns, *[(F.col(f"{h}_in") + F.col(f"{h}_base")).alias(n) for n, h in hidden.items()])


def spread_of(*columns: str) -> Column:
    """An even number in [0, 1) from the MD5 of the columns; plain SQL engines can compute it too."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


# --- files of sorted arrays that workers map ---------------------------------------------------


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends arrays to one file, which is named by the task's attempt, so a repeated task writes another.

    A task that writes several files gives each a number of its own.
    """

    def __init__(self, base: str, number: int | None = None) -> None:
        store, path = filesystem(base)
        store.create_dir(path, recursive=True)
        self.number, self.at = TaskContext.get().taskAttemptId() if number is None else number, 0
        self.out = store.open_output_stream(f"{path}/{self.number}")

    def put(self, array: np.ndarray) -> tuple[int, int, int]:
        """Append an array; its file, place and number of bytes."""
        data = np.ascontiguousarray(array).tobytes()
        self.out.write(data + bytes(-len(data) % 8))
        place = (self.number, self.at, len(data))
        self.at += len(data) + -len(data) % 8
        return place

    def close(self) -> None:
        self.out.close()


PLACE = "file long, at long, size long"


def places(rows: list[tuple[int, int, int]]) -> dict[str, pa.Array]:
    """Columns of ``PLACE``."""
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return {n: pa.array(c, pa.int64()) for n, c in zip(("file", "at", "size"), cols, strict=True)}


class Mapped:
    """Arrays of numbered parts in few files. Only ``OPEN`` files are mapped at a time."""

    OPEN = 64

    def __init__(self, base: str, parts: int, part: np.ndarray, file: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        self.base = base
        self.file, self.at, self.size = np.full(parts, -1, np.int64), np.zeros(parts, np.int64), np.zeros(parts, np.int64)
        self.file[part], self.at[part], self.size[part] = file, at, size
        self.maps: dict[int, object] = {}

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    def array(self, part: int, dtype) -> np.ndarray:
        file, at, size = int(self.file[part]), int(self.at[part]), int(self.size[part])
        if not size:
            return np.empty(0, dtype)
        parts = urlparse(self.base)
        local = parts.scheme in ("", "file")
        key = file if local else ~part
        if (got := self.maps.pop(key, None)) is None:
            while len(self.maps) >= self.OPEN:
                self.maps.pop(next(iter(self.maps)))  # the longest unused; unmapped once no array refers to it
            if local:
                with open(f"{unquote(parts.path)}/{file}", "rb") as f:
                    got = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            else:  # a part of a file in a remote store is copied to an unnamed local one
                store, path = filesystem(self.base)
                with store.open_input_file(f"{path}/{file}") as src, tempfile.TemporaryFile() as f:
                    for i in range(at, at + size, 1 << 22):
                        f.write(src.read_at(min(1 << 22, at + size - i), i))
                    f.flush()
                    got = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.maps[key] = got
        return np.frombuffer(got, dtype, size // np.dtype(dtype).itemsize, at if local else 0)

    def runs(self, parts: np.ndarray):
        """(part, start, end) of the runs of equal parts, by file, so each file is mapped once."""
        if len(parts):
            cut = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)]
            part, a, b = parts[cut[:-1]], cut[:-1], cut[1:]
            order = np.lexsort((self.at[part], self.file[part]))
            yield from zip(part[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True)


class HashSet:
    """A set of 64-bit hashes as sorted, mapped arrays, one for each range of the leading bits."""

    def __init__(self, bits: int, files: Mapped) -> None:
        self.bits, self.files = bits, files

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether the set has it."""
        order = np.argsort(keys)
        sorted_keys = keys[order]
        found = np.zeros(len(keys), bool)
        parts = (sorted_keys >> np.uint64(64 - self.bits)).astype(np.int64)
        for part, a, b in self.files.runs(parts):
            if len(arr := self.files.array(part, np.uint64)):
                at = np.searchsorted(arr, sorted_keys[a:b])
                found[a:b] = arr[np.minimum(at, len(arr) - 1)] == sorted_keys[a:b]
        out = np.empty(len(keys), bool)
        out[order] = found
        return out


def by_part(batches, column: str = "part"):
    """(part, table) of the rows of each part; batches come sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.asarray(batch.column(column))
        cut = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)].tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and held[0].column(column)[0].as_py() != part[a]:
                yield held[0].column(column)[0].as_py(), pa.concat_tables(held)
                held = []
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield held[0].column(column)[0].as_py(), pa.concat_tables(held)
