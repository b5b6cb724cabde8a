"""Filling gaps from a catalog: exact, by name, and by similarity within an institution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name, squash
from .fuzzy import similar


def fill_exact(rows: DataFrame, catalog: DataFrame, ident: str, code: str, name: str, seats: str) -> DataFrame:
    """Null seats from the catalog's code, else its squashed name (first row of each, by ``ord``); 0 counts as missing."""
    by_code = catalog.groupBy(F.col(code).alias("_code")).agg(F.min_by(seats, "ord").alias("_s1"))
    by_name = catalog.groupBy(squash(F.col(name)).alias("_name")).agg(F.min_by(seats, "ord").alias("_s2"))
    d = rows.join(by_code, F.col(code) == F.col("_code"), "left").join(by_name, squash(F.col(name)) == F.col("_name"), "left")
    new = F.coalesce(F.nullif("_s1", F.lit(0)), F.nullif("_s2", F.lit(0)))
    return d.withColumn(seats, F.coalesce(F.col(seats), new)).drop("_code", "_s1", "_name", "_s2")


def fuzzy_pairs(left: DataFrame, right: DataFrame, block: str, name: str, least: float = 90.0) -> DataFrame:
    """(block, name, best, score) of distinct names: the most similar right name of the same block, first by name of equals.

    Names are distinct and squashed before they meet, by grams that are rare and that similar ones must share, never all with all.
    """
    a, b = (df.select(block, squash(F.col(name)).alias("name")).distinct() for df in (left, right))
    top = similar(a, b, block, least).groupBy(block, "name").agg(F.min_by(F.struct("best", "score"), F.struct(-F.col("score"), "best")).alias("t"))
    return top.select(block, "name", "t.best", "t.score")


def fill_fuzzy(rows: DataFrame, catalog: DataFrame, block: str, name: str, seats: str, least: float = 90.0) -> DataFrame:
    """Null seats from the catalog's most similar name within the block; of equal names the last row by ``ord``."""
    known = catalog.where(F.col(seats).isNotNull())
    last = known.groupBy(block, squash(F.col(name)).alias("best")).agg(F.max_by(seats, "ord").alias("_new"))
    pairs = fuzzy_pairs(rows.where(F.col(seats).isNull()), known, block, name, least).join(last, [block, "best"]).select(block, F.col("name").alias("_name"), "_new")
    d = rows.withColumn("_name", squash(F.col(name))).join(pairs, [block, "_name"], "left")
    return d.withColumn(seats, F.coalesce(seats, "_new")).drop("_name", "_new")


def lookup(df: DataFrame, dim: DataFrame, key: list[str], value: str, default: str) -> DataFrame:
    """Left lookup with a default; Catalyst broadcasts the dimension if it is small."""
    return df.join(dim.select(*key, F.col(value)), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def first_match(probe: DataFrame, build: DataFrame, key: str, ident: str) -> DataFrame:
    """Each probe row with the smallest matching id, null without one."""
    return probe.join(build.groupBy(key).agg(F.min(ident).alias("match_id")), key, "left")


def requested(ids: DataFrame, institutions: DataFrame, key: str) -> DataFrame:
    """Each id that was asked for, once, and whether the list has it."""
    have = institutions.select(key).distinct().withColumn("known", F.lit(True))
    return ids.select(key).distinct().join(have, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def first_candidate(rows: DataFrame, files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Each row with the first file, by path, of its keys; null without one."""
    return rows.join(files.groupBy(*keys).agg(F.min(path).alias(path)), keys, "left")


def any_of(*cols: Column) -> Column:
    """Whether any of the texts is there and not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols]).isNotNull()


def download_manifest(institutions: DataFrame, key: str, fields: list[str], present: DataFrame) -> DataFrame:
    """A row a url that an institution publishes: (key, field, url, path, status), ``skip`` where the path is present, else ``todo``."""
    urls = institutions.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("url")) for f in fields])).alias("u")).select(key, "u.*").where(any_of(F.col("url")))
    base = F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1)
    rows = urls.withColumn("path", F.concat_ws("/", F.col(key).cast("string"), F.concat("field", F.lit("__"), safe_name(base))))
    there = present.select("path").distinct().withColumn("_there", F.lit(True))
    return rows.join(there, "path", "left").select(key, "field", "url", "path", F.when(F.col("_there"), "skip").otherwise("todo").alias("status"))


def assign(labels: DataFrame, mapping: DataFrame, keys: list[str], value: str = "canonical", default: str = "other") -> DataFrame:
    """Labels with their word of a fixed vocabulary, from a table that a person or a model made; the first of repeated keys by its word."""
    return lookup(labels, mapping.groupBy(*keys).agg(F.min(value).alias(value)), keys, value, default)


def targets(manifest: DataFrame, archetypes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Files of a manifest (university_id, pdfs: array of round_key, path, status) that were fetched, with their archetype."""
    d = manifest.select("university_id", F.explode("pdfs").alias("f")).select("university_id", F.col("f.round_key").alias("round"), F.col("f.path").alias("path"), F.col("f.status").alias("status"))
    d = d.where(F.col("status").isin("ok", "skip")).join(archetypes, ["university_id", "round"])
    return d if only is None else d.join(only, ["university_id", "round"], "left_semi")
