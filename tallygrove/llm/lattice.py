"""Embedding near-dedup by lattice hashing.

Unit vectors are projected to 8 dimensions by several random rotations and decoded to the nearest point of
the E8 lattice. A vector is indexed in its own cell of every table and also looks into the lattice
neighbours that lie nearest to it. Vectors that meet in a cell are compared by cosine in
double precision. Equal vectors are one class, so copies meet no one twice; hot cells are split into
blocks; components are found by the star algorithm.

Edge cases: a vector that is null, empty, zero or holds null or non-finite components, or has a null
label, links with nothing and is a component of its own (with a null id: a null component). Vectors of different lengths don't
link. Rows that repeat an id are vectors of their own: they count as each other's links. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, grouped, mixed, save, split_hot, tidy

LEAST = 0.93
#: Rotations, neighbouring cells looked into, lattice units a unit vector is long before the projection.
TABLES, PROBES, SCALE = 6, 4, 5.0
#: Rows of a block of a hot cell.
BLOCK = 1500


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s, t in itertools.product((1, -1), repeat=2)]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*pairs, *halves], float)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    gap = x - near
    row = np.flatnonzero(near.sum(axis=1) % 2)
    col = np.abs(gap[row]).argmax(axis=1)
    near[row, col] += np.where(gap[row, col] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: integer points with an even sum, or those moved by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def rotation(table: int, dim: int) -> np.ndarray:
    g = np.random.default_rng([table, dim]).normal(size=(dim, 8))
    q = np.linalg.qr(g)[0] if dim >= 8 else g / np.sqrt(8)
    return q * np.sqrt(dim / 64) if dim >= 8 else q


def cells(vecs: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Keys (rows, tables, 1 + probes) of each vector's own cell and of those it looks into."""
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    near = roots()
    odd = mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(vecs), tables, 1 + probes), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(tables):
            x = unit @ rotation(t, vecs.shape[1]) * scale
            p = decode(x)
            top = np.argsort(-((x - p) @ near.T), axis=1, kind="stable")[:, :probes]
            points = np.concatenate([p[:, None], p[:, None] + near[top]], axis=1)
            out[:, t] = mixed((np.rint(2 * points).astype(np.int64).astype(np.uint64) * odd).sum(axis=2) + np.uint64(t * 1_000_003 + vecs.shape[1]))
    return out


def usable(df: DataFrame, ident: str, vec: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(id, vec, label) of vectors that can link, and (id) of the others."""
    d = df.select(F.col(ident).cast("long").alias("id"), F.col(vec).alias("v"), F.col(label).alias("label"))
    ok = F.col("v").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    ok = ok & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = F.coalesce(ok, F.lit(False))
    return d.where(ok), d.where(~ok).select("id")


def links(df: DataFrame, ident: str = "vec_id", vec: str = "embedding", label: str = "label", least: float = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: id, cls), (classes: cls, mult), (pairs of classes: a, b), each pair once."""
    good, _ = usable(df, ident, vec, label)
    good = good.withColumn("cls", F.xxhash64(F.col("label").cast("string"), F.transform("v", lambda x: x.cast("double") + F.lit(0.0))))
    keep: list[str] = []
    members = save(good.select("id", "cls"), "members", keep)
    classes = save(good.groupBy("cls").agg(F.count(F.lit(1)).alias("mult"), F.min_by("v", F.coalesce("id", F.lit(2**62))).alias("v"), F.first("label").cast("string").alias("label")), "classes", keep)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) for x in b.column("v")])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for part in np.array_split(at, -(-len(at) // 4096)):
                    some = b.take(pa.array(part))
                    m = np.array(some.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)
                    m = m / np.abs(m).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
                    keys = cells(m)
                    n, (tables, each) = len(part), keys.shape[1:]
                    row = pa.array(np.repeat(np.arange(n), tables * each))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), some.column("label").take(row), some.column("cls").take(row), pa.array(np.tile(np.arange(each) == 0, n * tables))], names=["key", "label", "cls", "home"])

    at = classes.select("cls", "label", F.col("v").cast("array<double>").alias("v")).mapInArrow(tidy(keyed), "key long, label string, cls long, home boolean")
    at = save(at, "cells", keep)
    # a cell whose members are one class, or none of them at home, has no pair
    full = at.groupBy("key", "label").agg(F.min("cls").alias("_lo"), F.max("cls").alias("_hi"), F.max("home").alias("_home")).where("_lo < _hi and _home").select("key", "label")
    # vectors follow only to the cells that have pairs
    dealt = split_hot(at.join(full, ["key", "label"]), ["key", "label"], "cls", BLOCK).join(classes.select("cls", "v"), "cls")

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cls, home, blk = (t.column(c).to_numpy() for c in ("cls", "home", "blk"))
        if t.num_rows < 2 or cls.min() == cls.max():
            return
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        m = np.concatenate([np.array(c.flatten().to_numpy(zero_copy_only=False), float) for c in t.column("v").chunks]).reshape(len(cls), -1)
        m = m / np.abs(m).max(axis=1)[:, None]
        m /= np.sqrt((m * m).sum(axis=1))[:, None]
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            i, j = np.nonzero(m[rows] @ m[right].T >= least)
            i, j = rows[i], right[j]
            ok = (cls[i] != cls[j]) & (home[i] | home[j])
            if ok.any():
                pairs = np.unique(np.stack([np.minimum(cls[i], cls[j])[ok], np.maximum(cls[i], cls[j])[ok]]), axis=1)
                yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    pairs = save(grouped(dealt, ["key", "label", "lo", "hi"], meet, "a long, b long").distinct(), "links", keep)
    return members, classes.select("cls", "mult"), pairs


def near_dedup(df: DataFrame, ident: str = "vec_id", vec: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """Per row: ident, n_links, component_id, kept."""
    members, classes, pairs = links(df, ident, vec, label, least)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("mult").alias("other"))
    roots_ = components(pairs).select(F.col("v").alias("cls"), "root")
    info = classes.join(linked, "cls", "left").join(roots_, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), (F.coalesce("other", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"))
    low = members.groupBy("cls").agg(F.min("id").alias("low"))
    info = info.join(low, "cls")
    best = info.groupBy("root").agg(F.min("low").alias("component_id"))
    info = save(info.join(best, "root").select("cls", "n_links", "component_id"), "classes-told")
    out = members.join(info, "cls").select("id", "n_links", "component_id")
    _, rest = usable(df, ident, vec, label)
    out = out.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(ident), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Null labels, null, zero or odd vectors link with nothing; the driver's tables have none of other lengths.
SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)
    AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS ok FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93),
r(id, low) AS (SELECT vec_id, vec_id FROM e UNION SELECT p.b, r.low FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
