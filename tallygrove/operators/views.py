"""Result views: criteria of hits, side-by-side comparison, routing by intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .enrich import first_match


def display_codes(codes: Column, names: Column, most: int = 5) -> Column:
    """The first codes by name, or by code where a map has none."""
    return F.array_join(F.transform(F.slice(codes, 1, most), lambda c: F.coalesce(F.try_element_at(names, c), c)), ", ")


def criteria(hits: DataFrame, programs: DataFrame, parts: DataFrame, subjects: DataFrame, name: str = "name", most: int = 10) -> DataFrame:
    """Weights of the programs that hits name: (rank, code, subject, weight), heaviest first; hits are joined once, not asked one by one."""
    top = hits.where(F.col("rank") <= most)
    p = first_match(top, programs, name, "id").where(F.col("match_id").isNotNull())
    d = p.join(parts.where(F.col("weight").isNotNull()), F.col("match_id") == parts["program_id"]).join(subjects, "code", "left")
    return d.select("rank", name, "code", F.coalesce("subject", "code").alias("subject"), "weight").orderBy("rank", F.desc("weight"), "code")


def comparison(hits: DataFrame, fields: list[str], most: int = 4) -> DataFrame:
    """A row a field, a column a hit (p1, p2, ...)."""
    d = hits.where(F.col("rank") <= most).select("rank", F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for i, f in enumerate(fields)])).alias("s")).select("rank", "s.*")
    return d.groupBy("no", "field").agg(*[F.max(F.when(F.col("rank") == k, F.col("v"))).alias(f"p{k}") for k in range(1, most + 1)]).orderBy("no").drop("no")


def route(intent: str | None) -> str:
    """What a search's result is shown as."""
    return {"criteria": "criteria", "compare": "comparison", "career": "notice", "cost": "notice"}.get(intent or "", "hits")
