"""Mixing sources to target weights with DataFrame functions only.

Each row gets a hash-random key, of its id and text, so that rows that share an id or have none are spread too and only equal
rows tie. Rows are dealt, within their source, to ranges of that key (as many
as the source needs, so that a hot source is spread), prefix sums of sizes run inside a range and over
the ranges' totals, and each source is cut at its exact budget; budgets beyond one epoch repeat it.

Edge cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its
own, the last; rows that repeat are rows of their own; with no words at all every target is 0. A
source's budget is its target, rounded down; one row a source may be taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, quoted, save

#: By rank of the source, repeating; share of all sizes; most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Rows a range of keys holds on average.
RANGE_ROWS = 2000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(src, source_size) to targets. Sources in order of cap / weight: those before the level are capped."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = per_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))).withColumn("_w", w)
    t = t.withColumn("_cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_r", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("_left", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    t = t.withColumn("_level", F.col("_left") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    t = t.withColumn("_level", F.min_by(F.when(F.col("_level") <= F.col("_r"), F.col("_level")), F.when(F.col("_level") <= F.col("_r"), F.col("_r"))).over(every))
    return t.select("src", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))


def plan(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (), **kw) -> DataFrame:
    """Per row: ident, size, source_size, target, taken, and the columns of ``carry`` as ``c_<place>``."""
    base = df.select(F.col(ident).alias("id"), F.col(source).alias("src"), words(F.col(text)).alias("size"), F.md5(F.concat_ws("\x1f", F.coalesce(F.col(ident).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))).alias("key"), *[F.col(quoted(c)).alias(f"c_{i}") for i, c in enumerate(carry)])
    base = base.withColumn("spot", F.conv(F.substring("key", 1, 8), 16, 10).cast("long"))
    slim = save(base.select("src", "size", "spot"), "sizes")
    per = save(targets_with_ranges(slim, **kw), "targets")
    # ranges' totals come before: few rows, a count for each source and range
    cut = lambda d: d.withColumn("rng", F.shiftright(F.col("spot") * F.col("ranges"), 32).cast("int"))
    same = F.col("src").eqNullSafe(F.col("t_src"))
    per_named = per.withColumnRenamed("src", "t_src")
    tot = cut(slim.join(F.broadcast(per_named.select("t_src", "ranges")) if _small(per) else per_named.select("t_src", "ranges"), same)).groupBy("src", "rng").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("src").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).select(F.col("src").alias("o_src"), F.col("rng").alias("o_rng"), "ahead")
    rows = cut(base.join(F.broadcast(per_named) if _small(per) else per_named, same))
    rows = rows.join(tot, F.col("src").eqNullSafe(F.col("o_src")) & (F.col("rng") == F.col("o_rng")))
    run = Window.partitionBy("src", "rng").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - full * F.col("source_size")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select(F.col("id").alias(ident), "size", "source_size", "target", taken.cast("long").alias("taken"), *[f"c_{i}" for i in range(len(carry))])


def targets_with_ranges(slim: DataFrame, **kw) -> DataFrame:
    per = slim.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    ranges = per.select(F.col("src").alias("r_src"), F.ceil(F.col("_n") / RANGE_ROWS).cast("long").alias("ranges"))
    return targets(per.select("src", "source_size"), **kw).join(ranges, F.col("src").eqNullSafe(F.col("r_src"))).drop("r_src")


def _small(per: DataFrame, most: int = 100_000) -> bool:
    """One row a source: broadcast only when they are counted and few."""
    return per.count() <= most


def mix(df: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """The mixed rows with the input's own columns: whole repeats, and one text a source cut after its last word taken."""
    cols = df.columns
    p = plan(df, ident, text, source, carry=tuple(cols), **kw)
    body = F.col(f"c_{cols.index(text)}")
    part = F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(F.lit(0))
    repeats = F.expr("array_repeat(cast(null as bigint), cast(if(size > 0, taken div size, 0) as int))")
    p = p.withColumn("_cuts", F.concat(repeats, F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    p = p.withColumn("_cut", F.explode("_cuts"))
    heads = F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(heads, F.lit(1), F.col("_cut").cast("int")), "")
    new = F.when(F.col("_cut").isNull(), body).otherwise(head)
    return p.select(*[(new if c == text else F.col(f"c_{i}")).alias(c) for i, c in enumerate(cols)])


def query(spark, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src ASC NULLS LAST) AS rk FROM d GROUP BY src),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((rk - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / w AS r, coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
    coalesce(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - cb) / ((sum(w) OVER ()) - wb) AS level FROM r),
v AS (SELECT arg_min(level, r) FILTER (WHERE level <= r) AS level FROM l),
t AS (SELECT l.src, l.source_size, least(l.cap, v.level * l.w) AS target FROM l, v),
o AS (SELECT d.*, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY d.key, d.doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t ON d.src IS NOT DISTINCT FROM t.src),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM o)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken FROM b"""
