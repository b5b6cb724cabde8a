"""Shared helpers of the operators: scratch tables, Arrow text buffers, hashing, Bloom filters."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words wherever a contract speaks of words.
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.gettempdir() + "/tallygrove-shared"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below this application's folder, which goes when the driver's Python ends."""
    root = f"{shared_dir(spark)}/tallygrove-{spark.sparkContext.applicationId}"
    _forget_at_exit(spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@functools.cache
def _forget_at_exit(spark: SparkSession, root: str) -> None:
    def forget() -> None:
        try:
            remove(spark, root)
        except Exception:  # the JVM may be gone already; nothing is left to tell
            pass

    atexit.register(forget)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders through Hadoop's file system, whatever store they are in."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back. Its path is added to ``keep``."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hadoop_size(spark: SparkSession, df: DataFrame) -> int:
    """Bytes of the files that a frame reads, from Spark's own statistics of the plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# --- what a Python worker keeps -----------------------------------------------------------------------

_held: dict = {}


def held(key: tuple, make):
    """One object a Python worker, which its tasks share until a task of ``tidy`` runs there, or one that holds another."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def roomy(spark: SparkSession, cpus: int = 2) -> ResourceProfile | None:
    """For a stage whose Python workers need much memory: tasks of two cores each, so half as many workers stand beside the JVM at a time.

    None, and all tasks as ever, where a stage can't ask for this: local mode, executors of one core, or those that come and go.
    """
    conf = spark.sparkContext.getConf()
    cores = re.fullmatch(r"local-cluster\[\s*\d+\s*,\s*(\d+)\s*,\s*\d+\s*\]", conf.get("spark.master", ""))
    cores = int(cores[1]) if cores else int(conf.get("spark.executor.cores", "0"))
    if cores < cpus or conf.get("spark.master", "").startswith("local[") or conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus)).build


def give_back(spark: SparkSession) -> None:
    """Have the executors' JVMs return the heap that earlier stages left, before workers beside them need the room: a task for each core.

    A heap that a shuffle has grown stays grown until a full collection. In local mode there is one JVM, and so one task.
    """
    n = 1 if spark.sparkContext.master.startswith("local[") else spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def trim() -> None:
    """Give freed memory back to the machine: a worker outlives its tasks, and the next stage's workers need room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def lean() -> None:
    """Large arrays go back to the machine as soon as they are freed, where the C library can be told so."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def leave() -> None:
    """Let go of what tasks of other operators left in this worker."""
    lean()
    if _held:
        _held.clear()
        trim()


def tidy(run):
    """A task's function that begins without what tasks of other operators left, and leaves nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave()  # by its name, so that it is the worker's own
        yield from run(batches)
        trim()

    return task


# --- Arrow text -------------------------------------------------------------------------------


def text_slices(col: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: (first row, end row, UTF-8 bytes, offsets from 0).

    Null texts count as empty. A text longer than ``most`` is a run of its own, whole.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all texts of a run; none crosses from text to text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~solid[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    first[inner] = True
    starts = np.flatnonzero(solid & first)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, ~solid[1:]
    last[inner - 1] = True
    return starts, np.flatnonzero(solid & last) + 1


# --- hashing ----------------------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)


@functools.lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by polynomial prefix sums modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = 1 << max(12, int(len(data)).bit_length())
    up, down = _powers(_P, n), _powers(_P_INV, n)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# --- Bloom filter of a fixed size -----------------------------------------------------------------

BLOOM_BITS = 1 << 23  # 1 MB whatever the input; beyond its capacity it only lets more rows through


def _bloom_spots(ids: np.ndarray) -> np.ndarray:
    h = mixed(ids.astype(np.uint64) + np.uint64(0x51ED2701))
    return np.stack([(h >> np.uint64(s)) & np.uint64(BLOOM_BITS - 1) for s in (0, 20, 40)]).astype(np.int64)


def bloom_of(df: DataFrame, col: str) -> np.ndarray:
    """Bits of the non-null longs of a column. Partial bitmaps meet by slice before the driver gets 1 MB."""
    slices, width = 16, BLOOM_BITS // 8 // 16

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            ids = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            bits[_bloom_spots(ids).ravel()] = True
        packed = np.packbits(bits).tobytes()
        yield pa.RecordBatch.from_pydict({"s": pa.array(range(slices), pa.int32()), "bits": pa.array([packed[i * width : (i + 1) * width] for i in range(slices)], pa.binary())})

    def union(t: pa.Table) -> pa.Table:
        bits = np.zeros(width, np.uint8)
        for x in t.column("bits").to_pylist():
            bits |= np.frombuffer(x, np.uint8)
        return pa.table({"s": t.column("s").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = df.select(F.col(col).cast("long")).mapInArrow(partial, "s int, bits binary").groupBy("s").applyInArrow(union, "s int, bits binary").collect()
    out = b"".join(bytes(r["bits"]) for r in sorted(rows, key=lambda r: r["s"]))
    return np.frombuffer(out, np.uint8) if out else np.zeros(BLOOM_BITS // 8, np.uint8)


def in_bloom(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    spots = _bloom_spots(ids)
    return ((bits[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1).all(axis=0)


# --- hot keys -------------------------------------------------------------------------------------


def split_hot(df: DataFrame, key: list[str], ident: str, most: int) -> DataFrame:
    """Deal each key's rows into blocks of about ``most`` rows, and each row to all pairs of blocks it is in.

    Adds ``lo``, ``hi`` (the pair of blocks) and ``blk`` (the row's own). A key of up to ``most`` rows
    has the one pair (0, 0). No task then holds more than about two blocks, however hot a key is.
    """
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    out = df.join(n, key).withColumn("_nb", F.ceil(F.col("_n") / F.lit(most)).cast("int"))
    out = out.withColumn("blk", F.pmod(F.xxhash64(ident, F.lit(7)), F.col("_nb")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return out.withColumns({"lo": F.least("blk", "_o"), "hi": F.greatest("blk", "_o")}).drop("_o", "_n", "_nb")


# --- connected components -------------------------------------------------------------------------


def pairs_of(df: DataFrame, *cols: tuple[str, str]) -> DataFrame:
    """(u, v): of each row a pair for each two columns."""
    return df.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in cols])).alias("p")).select("p.u", "p.v")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Pairs of longs (a, b) to (v, root): root is the smallest value that v reaches. Only linked v are listed.

    Alternating large-star and small-star steps; every round is a written table, so a lost executor
    costs one round at most. Minima are pre-aggregated, and edges meet them in joins that Spark splits where a hub is hot.
    """
    spark, keep = edges.sparkSession, []
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = save(e, "edges", keep)
    seen = None
    for _ in range(rounds):
        # both rows of a pair come from one scan: a union would have what is below it planned and run twice
        both = pairs_of(e, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select("u", "m", F.greatest("v", "m").alias("hi"), F.least("v", "m").alias("lo"))
        small = pairs_of(small, ("hi", "lo"), ("u", "m")).where("u <> v").distinct()
        e = save(small, "stars", keep)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if len(keep) > 1:
            remove(spark, keep.pop(0))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select(F.col("v"), F.col("v").alias("root")).distinct())


# --- files that tasks write and read themselves -----------------------------------------------------


def open_fs(uri: str):
    """(file system, path) of a URI, in any store that Arrow reaches; Hadoop's names of a store are known too."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}.get(scheme, scheme) + colon + rest if colon else uri)


class Rolling:
    """Files of one task, written under temporary names and renamed when whole.

    A task that runs again writes the same bytes to the same final names, so whichever attempt ends
    last leaves a right file; files of attempts that died keep temporary names and are in no manifest.
    """

    def __init__(self, root: str, part: int, suffix: str) -> None:
        self.fs, self.root = open_fs(root)
        self.part, self.suffix, self.seq = part, suffix, 0
        self.out = None
        self.fs.create_dir(self.root, recursive=True)

    def start(self):
        self.name = f"part-{self.part:06d}-{self.seq:05d}{self.suffix}"
        self.temp = f"{self.root}/_temporary-{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.temp, compression=None), 0
        return self

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.out.close()
        final = f"{self.root}/{self.name}"
        there = self.fs.get_file_info(final)
        if there.is_file and there.size == self.size:  # an earlier attempt's, and the bytes don't depend on the attempt
            self.fs.delete_file(self.temp)
        else:
            if there.is_file:  # not every store renames onto a name that exists
                self.fs.delete_file(final)
            self.fs.move(self.temp, final)
        self.out, self.seq = None, self.seq + 1
        return self.name


def commit(manifest: DataFrame, root: str) -> DataFrame:
    """Write the manifest below the files that it names, last of all; a folder that has one already is refused."""
    path = f"{root.rstrip('/')}/manifest"
    manifest.write.parquet(path)
    return manifest.sparkSession.read.schema(manifest.schema).parquet(path)


def manifest_of(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a folder that was written, in this session or another."""
    return spark.read.parquet(f"{root.rstrip('/')}/manifest")


# --- ranges that are the same in every run --------------------------------------------------------


LEAST_ID = -(1 << 63)


def range_bounds(slim: DataFrame, col: str, tie: str, size: str, per: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of as many ranges of (long column, nulls first; ``tie``, a long) as Spark shuffles to, of about equal sums of ``size``.

    They come from a sample by hash, about ``per`` rows a range, so the same rows give the same bounds in every run,
    unlike the ranges that Spark samples by itself.
    """
    n = parts(slim.sparkSession)
    every = max(1, slim.count() // (per * n))
    key = F.coalesce(F.col(col), F.lit(LEAST_ID)).alias("_at")
    some = slim.select(key, tie, size).where(F.pmod(F.xxhash64("_at", tie, F.lit(3)), F.lit(every)) == 0).groupBy("_at", tie).agg(F.sum(size).cast("double")).collect()
    some.sort(key=lambda r: (r[0], r[1]))
    ids, ties = (np.array([r[k] for r in some], np.int64) for k in (0, 1))
    upto = np.cumsum([r[2] or 0.0 for r in some])
    cut = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], n + 1)[1:-1])) if len(some) and upto[-1] > 0 else np.zeros(0, np.int64)
    return ids[cut], ties[cut]


def range_shards(df: DataFrame, col: str, tie: str, bounds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows dealt to the ranges, so that partition k is range k and rows with one value of the column, or none, may be cut by ``tie``.

    Adds ``shard``, the number of the range, and ``_at``, the column with nulls as the least long.
    """
    ids, ties = bounds

    @F.pandas_udf(T.IntegerType())
    def shard(at: pd.Series, tie: pd.Series) -> pd.Series:
        x, y = at.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(ids, x, side="left"), np.searchsorted(ids, x, side="right")
        for k in np.flatnonzero(high > low):  # a bound has this very value
            low[k] += np.searchsorted(ties[low[k] : high[k]], y[k], side="right")
        return pd.Series(low.astype("int32"))

    df = df.withColumn("_at", F.coalesce(F.col(col), F.lit(LEAST_ID)))
    return df.withColumn("shard", shard("_at", tie)).repartitionById(parts(df.sparkSession), "shard")


# --- many small groups in one task ------------------------------------------------------------------


def grouped(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn(table) -> iterator of record batches`` for the rows of each key, without a call from Spark a group.

    Rows are dealt by key and sorted; a task walks its batches and cuts them where the key changes.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k) for k in keys]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                v = c.to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(c[x].as_py() for c in cols)
                if held and key != last:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(b.slice(x, y - x))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition(parts(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(tidy(walk), schema)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Fewer rows a batch for what runs inside, where rows are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def without(df: DataFrame, ident: str, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows whose id, null or not, isn't in the one column of ``ids``; those are sent to all tasks only if few."""
    name = free_name(df, "gone")
    gone = save(ids.toDF(name).distinct(), "gone")
    return df.join(F.broadcast(gone) if gone.count() <= most else gone, F.col(ident).eqNullSafe(gone[name]), "left_anti")


def quoted(name: str) -> str:
    """A column's name as it stands in an expression, also one with dots or marks in it."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rows_apart(df: DataFrame, ident: str) -> tuple[DataFrame, str]:
    """The frame and a column that tells its rows apart: the id, or where ids repeat or lack, a number that a written copy carries."""
    if not df.groupBy(ident).count().where((F.col("count") > 1) | F.col(ident).isNull()).limit(1).count():
        return df, ident
    row = free_name(df, "row")
    return save(df.withColumn(row, F.monotonically_increasing_id()), "rows"), row
