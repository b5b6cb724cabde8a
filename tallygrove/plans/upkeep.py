"""Upkeep over the tables: names that are nearly the same, features that the data has, partitions that changed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import enrich, fuzzy, tables
from ..sources import versions
from .catalogue import register, table


@register("""WITH a AS (SELECT DISTINCT p_type, p_name AS name FROM part WHERE p_size <= 25), b AS (SELECT DISTINCT p_type, p_name AS best FROM part WHERE p_size > 25)
SELECT p_type, name, best, levenshtein(name, best)::INT AS dist FROM a JOIN b USING (p_type) WHERE levenshtein(name, best) <= 3""")
def fuzzy_near(spark, d):
    """All pairs of names of a type that three edits part at most."""
    p = table(spark, d, "part")
    a, b = (p.where(w).select("p_type", F.col("p_name").alias("name")).distinct() for w in ("p_size <= 25", "p_size > 25"))
    return fuzzy.edit_pairs(a, b, "p_type", 3)


@register()
def fill_fuzzy_seats(spark, d):
    """Sizes that lack come from the most similar name of the same brand; names there are cut short by one character."""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("seats"))
    known = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("ord"), "p_brand", F.expr("substring(p_name, 2)").alias("name"), F.col("p_size").alias("seats"))
    return enrich.fill_fuzzy(rows, known, "p_brand", "name", "seats").select("id", "seats")


_CONCEPT = "l_returnflag || '-' || (l_partkey % 40)"


@register(f"""WITH x AS (SELECT l_orderkey AS pid, {_CONCEPT} AS concept, l_quantity AS w FROM lineitem), v AS (SELECT concept, count(DISTINCT pid) AS df FROM x GROUP BY 1 HAVING df >= 5),
n AS (SELECT concept, row_number() OVER (ORDER BY concept) - 1 AS feature FROM v), s AS (SELECT pid, feature, sum(w) AS w FROM x JOIN n USING (concept) GROUP BY ALL)
SELECT pid, string_agg(feature || ':' || w::BIGINT, ',' ORDER BY feature) AS vector FROM s GROUP BY 1 HAVING sum(w) <> 0""")
def features_discovered(spark, d):
    """Vectors over the concepts that five orders or more have, whatever these are."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pid"), F.expr(_CONCEPT).alias("concept"), F.col("l_quantity").alias("w"))
    v = tables.sparse_vectors(x, ["pid"], "concept", "w", tables.vocabulary(x, ["pid"], "concept"))
    return v.select("pid", F.array_join(F.zip_with("features", "weights", lambda i, w: F.concat(i.cast("string"), F.lit(":"), w.cast("long").cast("string"))), ",").alias("vector"))


@register("""WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_brand LIKE '%1%' THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_brand NOT LIKE '%3%')
SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS total, CASE WHEN p_brand LIKE '%1%' THEN 2 ELSE 1 END AS version FROM p GROUP BY 1""")
def update_in_place(spark, d):
    """A partitioned table is written, then updated by one where some partitions changed and some are gone, and read back."""
    root = f"{tables.scratch_root(spark)}/parts-{uuid.uuid4().hex}"
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    versions.update(p, root, ["p_brand"])
    new = p.where("p_brand not like '%3%'").withColumn("p_size", F.when(F.col("p_brand").contains("1"), F.col("p_size") + 1).otherwise(F.col("p_size")))
    versions.update(new, root, ["p_brand"], replace=True)
    at = versions.manifest(spark, root).select("p_brand", F.col("_at").alias("version"))
    return versions.read(spark, root).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").cast("long").alias("total")).join(at, "p_brand")
