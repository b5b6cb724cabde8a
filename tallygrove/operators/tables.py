"""Shaping: first-wins, unnesting, unpivoting, maps, surrogate keys, normalised program rows."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import category, falsy_or, num


def first_wins(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def surrogate(df: DataFrame, order: list[Column | str], name: str = "id", within: list[str] | None = None) -> DataFrame:
    """Insertion order as a key, from 1, by an order that tells rows apart (rows that it doesn't share a number).

    Only the order's columns are numbered, and joined back: sorted ranges, a rank within each, and the counts of those before.
    They are checkpointed, as Spark samples the ranges' bounds anew whenever it plans.
    """
    if within:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    own, names = [f"_o{k}" for k in range(len(cols))], [f"_k{k}" for k in range(len(cols))]
    d = df.withColumns(dict(zip(own, cols, strict=True)))
    keys = d.select(*[F.col(a).alias(b) for a, b in zip(own, names, strict=True)]).distinct()
    keys = checkpointed(keys.repartitionByRange(n, *names).sortWithinPartitions(*names).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    keys = keys.select(*names, part.alias("_part"), at.alias("_in"))
    size = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    size = size.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row a range
    keys = keys.join(F.broadcast(size.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_before")
    same = functools.reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, names, strict=True)])
    return d.join(keys, same).drop(*own, *names)


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut by a table below ``scratch_root``."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*dfs: DataFrame) -> None:
    """Delete tables that ``checkpointed`` wrote, once nothing reads them any more."""
    for df in dfs:
        sc = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(path))
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def scratch_root(spark: SparkSession) -> str:
    """An application's own folder below that which the cluster names (``spark.checkpoint.dir``); a local one only in local mode, where none is named.

    It goes when the driver's Python ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    root = f"{base.rstrip('/')}/tallygrove-{sc.applicationId}-tables"
    _forget_at_exit(spark, root)
    return root


@functools.cache
def _forget_at_exit(spark: SparkSession, root: str) -> None:
    def forget() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already; nothing is left to tell
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(forget)


def weights_map(df: DataFrame, key: list[str], code: str, weight: str) -> DataFrame:
    """Key to a map of summed weights a code; null weights are skipped."""
    s = df.where(F.col(weight).isNotNull()).groupBy(*key, code).agg(F.sum(weight).alias("_w"))
    return s.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(code), F.col("_w"))))).alias("weights"))


def unpivot_slots(df: DataFrame, key: list[str], slots: list[dict[str, str]]) -> DataFrame:
    """Flat slots to rows (key, slot, fields); a slot whose fields are all null or empty is dropped."""
    names = list(slots[0])
    rows = F.array(*[F.struct(F.lit(k + 1).alias("slot"), *[F.col(s[n]).cast("string").alias(n) for n in names]) for k, s in enumerate(slots)])
    kept = F.filter(rows, lambda r: F.greatest(*[F.coalesce(r[n], F.lit("")) for n in names]) != "")
    return df.select(*key, F.explode(kept).alias("s")).select(*key, "s.*")


def pivot_features(df: DataFrame, key: list[str], concept: str, weight: str, features: list[str]) -> DataFrame:
    """Dense feature columns, 0 where absent; rows whose features sum to 0 are dropped. Features are given, so one shuffle does."""
    p = df.where(F.col(concept).isin(features)).groupBy(*key).agg(*[F.coalesce(F.sum(F.when(F.col(concept) == f, F.col(weight))), F.lit(0.0)).alias(f) for f in features])
    total = F.lit(0.0)
    for f in features:
        total = total + F.col(f)
    return p.where(total != 0)


def vocabulary(df: DataFrame, key: list[str], concept: str, least: int = 5) -> DataFrame:
    """(concept, df, feature): the concepts that ``least`` keys or more have, numbered from 0 in their order."""
    freq = df.where(F.col(concept).isNotNull()).select(*key, concept).distinct().groupBy(concept).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    return surrogate(checkpointed(freq), [concept], "feature").withColumn("feature", F.col("feature") - 1)


def sparse_vectors(df: DataFrame, key: list[str], concept: str, weight: str, vocab: DataFrame) -> DataFrame:
    """Key to the features it has, rising, and their summed weights; keys whose weights sum to 0 are dropped. As many features as the data has."""
    w = df.join(vocab.select(concept, "feature"), concept).groupBy(*key, "feature").agg(F.sum(weight).alias("_w"))
    v = w.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("feature", F.col("_w").alias("weight")))).alias("_v"), F.sum("_w").alias("_sum")).where("_sum <> 0")
    return v.select(*key, F.transform("_v", lambda x: x["feature"]).alias("features"), F.transform("_v", lambda x: x["weight"]).alias("weights"))


def normalise_program(p: Column, has_codes: Column) -> dict[str, Column]:
    """Columns of a search row from a raw program struct (all texts), by the presence of its code list."""
    comps = F.when(F.size(p["weighted_components"]) > 0, p["weighted_components"]).otherwise(p["weighted_subjects"])
    comps = F.coalesce(comps, F.array().cast("array<struct<code:string,name:string,weight:string,threshold:string>>"))
    split = F.transform(comps, lambda c: F.struct(F.array_distinct(F.filter(F.split(F.coalesce(c["code"], F.lit("")), "[,/ +]+"), lambda x: x.rlike(r"^\d+$"))).alias("codes"), num(c["weight"]).alias("w")))
    every = F.flatten(F.transform(split, lambda c: c["codes"]))
    in_range = F.filter(every, lambda x: x.try_cast("int").between(61, 89))
    listed = F.filter(F.coalesce(p["subject_codes"], F.array().cast("array<string>")), lambda x: x.rlike(r"^\d+$"))
    pairs = F.flatten(F.transform(F.filter(split, lambda c: c["w"].isNotNull()), lambda c: F.transform(c["codes"], lambda x: F.struct(x.alias("code"), c["w"].alias("w")))))
    total = lambda ps, k: F.aggregate(F.filter(ps, lambda x: x["code"] == k), F.lit(0.0), lambda a, x: a + x["w"])
    entries = lambda ps: F.transform(F.array_sort(F.array_distinct(F.transform(ps, lambda x: x["code"]))), lambda k: F.struct(k, total(ps, k)))
    weights = F.map_from_entries(F.get(F.transform(F.array(pairs), entries), 0))  # pairs are made once, not once a code
    return {
        "subject_codes": F.array_sort(F.array_distinct(F.when(has_codes, listed).otherwise(in_range))),
        "weights": F.when(has_codes, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(weights),
        "tcas_code": falsy_or(p["tcas_code"], p["program_code"]),
        "program_name_th": falsy_or(p["program_name_th"], p["faculty_major_th"]),
        "program_name_en": falsy_or(p["program_name_en"], p["major_name_en"]),
        "faculty_th": falsy_or(p["faculty_th"]),
        "min_gpax": F.when(p["min_gpax"].isNotNull(), p["min_gpax"]).otherwise(num(p["gpax_min"])),
        "seats": p["seats"],
        "topic": F.lit(None).cast("string"),
    }


def relational(docs: DataFrame, institutions: DataFrame) -> dict[str, DataFrame]:
    """The four tables of (university_id, round, path, pos, program struct): first row of a key wins."""
    p = F.col("program")
    rows = docs.select("university_id", "round", "path", "pos", "source", "program", falsy_or(p["tcas_code"], p["program_code"]).alias("code"), falsy_or(p["program_name_th"], p["faculty_major_th"]).alias("name"))
    rows = first_wins(rows.withColumn("_key", F.when(F.col("code") != "", F.col("code")).otherwise(F.col("name"))), ["university_id", "round", "_key"], ["path", "pos"])
    rows = checkpointed(rows)  # once for the numbers and all tables
    rows = surrogate(rows, ["path", "pos"])
    comps = F.when(F.size(p["weighted_components"]) > 0, p["weighted_components"]).otherwise(p["weighted_subjects"])
    weighed = rows.select("id", F.posexplode(comps).alias("k", "c")).select("id", F.lit(0).alias("src"), "k", F.trim("c.code").alias("subject_code"), F.col("c.name").alias("name"), num(F.col("c.weight")).alias("weight_percent"), num(F.col("c.threshold")).alias("min_threshold"))
    bare = rows.select("id", F.posexplode(p["subject_codes"]).alias("k", "c")).select("id", F.lit(1).alias("src"), "k", F.trim("c").alias("subject_code"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("weight_percent"), F.lit(None).cast("double").alias("min_threshold"))
    both = weighed.unionByName(bare).where(F.col("subject_code") != "")
    ps = first_wins(both, ["id", "subject_code"], ["src", "k"]).select(F.col("id").alias("program_id"), "subject_code", "weight_percent", "min_threshold")
    from ..functions.lexicon import SUBJECT_EN

    spark = docs.sparkSession
    en = spark.createDataFrame(list(SUBJECT_EN.items()), "code string, name_en string")
    th = both.groupBy(F.col("subject_code").alias("code")).agg(F.min_by("name", F.struct("id", "src", "k")).alias("name_th"))
    subject = th.join(en, "code", "full_outer").select("code", "name_th", "name_en", category(F.col("code")).alias("category"))
    program = rows.select("id", "university_id", "round", F.col("code").alias("tcas_code"), F.col("name").alias("program_name_th"), falsy_or(p["program_name_en"], p["major_name_en"]).alias("program_name_en"), falsy_or(p["faculty_th"]).alias("faculty_th"), p["seats"].alias("seats"), F.coalesce(p["min_gpax"], num(p["gpax_min"])).alias("min_gpax"), p["min_total_score"].alias("min_total"), F.lit(None).cast("string").alias("topic"), "source")
    return {"university": institutions, "program": program, "program_subject": ps, "subject": subject}
