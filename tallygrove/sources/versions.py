"""Partitioned tables that are updated in place: only partitions whose rows changed are written, and a reader sees all of an update or nothing.

Below the root: ``data/v=<version>/...``, the partitions that an update wrote, and ``manifest/v=<version>``, which says for each
partition its version, rows and a hash of them. The newest manifest that was written whole is the table: Spark's own commit, which puts ``_SUCCESS`` last, is
the pointer. Earlier versions stay readable until ``sweep``. Partition columns are texts, an empty one is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that were written whole, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("v=")) for f in found)


def _tried(spark: SparkSession, root: str) -> int:
    """The highest version that was begun."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*/v=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(f.getPath().getName().removeprefix("v=")) for f in found), default=0)


def _parts(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, hash): the same for the same rows in any order; repeats count."""
    h = F.xxhash64(F.to_json(F.struct(*[c for c in df.columns if c not in by]), {"ignoreNullFields": "false"}))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    done = _versions(spark, root)
    at = version if version is not None else done[-1] if done else None
    if at is None:
        return None
    if at not in done:
        raise ValueError(f"no version {at}")
    return spark.read.parquet(f"{root}/manifest/v={at}")


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table, or an earlier version of it."""
    m = manifest(spark, root, version)
    if m is None:
        raise ValueError("no version was written whole")
    kept = [r[0] for r in m.select("_at").distinct().collect()]  # versions, which are few
    cols = [c for c in m.columns if c not in ("rows", "hash", "_at")]
    paths = [f"{root}/data/v={v}" for v in kept]
    if not paths:
        raise ValueError("the table has no partition")
    # partitions by their values as text, as folders are named after them; which are in use is the manifest's to say
    kind = StructType([StructField(f.name, StringType() if f.name in cols else f.dataType) for f in spark.read.option("basePath", f"{root}/data").option("mergeSchema", True).parquet(*paths).schema])
    data = spark.read.schema(kind).option("basePath", f"{root}/data").parquet(*paths)
    on = [data[c].cast("string").eqNullSafe(m[c]) for c in cols] + [data["v"] == m["_at"]]
    return data.join(m.select(*cols, "_at"), on, "left_semi").drop("v")


def update(df: DataFrame, root: str, by: list[str], replace: bool = False) -> dict[str, int]:
    """Write the partitions of ``df`` whose rows differ from the table's; returns how many were written, kept and dropped.

    Partitions that ``df`` doesn't have stay, or with ``replace`` go. A run that fails at any point leaves the table as it was.
    """
    spark = df.sparkSession
    old = manifest(spark, root)
    new_at = _tried(spark, root) + 1
    typed = df.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in by})  # a folder can't be named after an empty text
    now = _parts(typed, by)
    if old is None:
        told = now.withColumn("_at", F.lit(new_at)).withColumn("_new", F.lit(True)).withColumn("_gone", F.lit(False))
    else:
        o = old.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("rows").alias("_rows"), F.col("hash").alias("_hash"), F.col("_at").alias("_was"))
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        both = now.join(o, on, "full_outer")
        have, had = F.col("rows").isNotNull(), F.col("_was").isNotNull()
        same = have & had & (F.col("rows") == F.col("_rows")) & (F.col("hash") == F.col("_hash"))
        told = both.select(
            *[F.when(have, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in by], F.coalesce("rows", "_rows").alias("rows"), F.coalesce("hash", "_hash").alias("hash"),
            F.when(have & ~F.coalesce(same, F.lit(False)), F.lit(new_at)).otherwise(F.col("_was")).alias("_at"), (have & ~F.coalesce(same, F.lit(False))).alias("_new"), (~have & F.lit(replace)).alias("_gone"),
        )
    told = told.cache()
    try:
        n = {bool(r["_new"]): r["n"] for r in told.where("not _gone").groupBy("_new").agg(F.count(F.lit(1)).alias("n")).collect()}
        gone = told.where("_gone").count()
        if n.get(True):
            changed = told.where("_new").select(*[F.col(c).alias(f"_{c}") for c in by])
            rows = typed.join(changed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left_semi")
            rows.repartition(*by).write.partitionBy(*by).parquet(f"{root}/data/v={new_at}")
        if n.get(True) or gone or old is None:
            told.where("not _gone").select(*by, "rows", "hash", "_at").write.parquet(f"{root}/manifest/v={new_at}")
        return {"written": n.get(True, 0), "kept": n.get(False, 0), "dropped": gone}
    finally:
        told.unpersist()


def sweep(spark: SparkSession, root: str) -> list[int]:
    """Remove versions of data that the newest manifest doesn't name, and earlier manifests; what versions of data went."""
    done = _versions(spark, root)
    if not done:
        return []
    kept = {r[0] for r in manifest(spark, root).select("_at").distinct().collect()}
    fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = []
    for kind, keep in (("data", kept), ("manifest", {done[-1]})):
        pattern = fs_of(f"{root}/{kind}/v=*")
        fs = pattern.getFileSystem(conf)
        for f in fs.globStatus(pattern) or []:
            v = int(f.getPath().getName().removeprefix("v="))
            if v not in keep:
                fs.delete(f.getPath(), True)
                gone += [v] if kind == "data" else []
    return sorted(gone)
