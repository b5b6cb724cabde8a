"""Sources and sinks: nested JSON documents, text, search rows, pages; versioned writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

COMPONENT = "struct<category:string,test_or_subject_code:string,subject_code:string,subject_name_th:string,weight_percent:string,min_threshold_percent:string,min_threshold:string>"
PROGRAM = f"struct<tcas_code:string,program_code:string,project_code:string,round_label:string,program_name_th:string,program_name_en:string,major_name_en:string,faculty_th:string,faculty_major_th:string,other_conditions_th:string,topic:string,seats:int,min_gpax:double,min_total_score:double,gpax_min:string,subject_codes:array<string>,weighted_components:array<{COMPONENT}>,weighted_subjects:array<{COMPONENT}>>"
ITEM = "struct<item_no:string,text:string,faculty_th:string,target_group_th:string,target_program_th:string,contact_th:string>"
DOC = f"university_id string, university string, round string, round_label string, archetype string, count int, program_count int, item_count int, programs array<{PROGRAM}>, items array<{ITEM}>"
SEARCH_ROW = "university string, university_id string, round string, tcas_code string, faculty_th string, program_name_th string, program_name_en string, seats int, min_gpax double, subject_codes array<string>, topic string, source string, weights map<string,double>"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_documents(spark: SparkSession, path: str, admission: bool = False) -> DataFrame:
    """One row a JSON file below a folder, with id and round from the file's name where the document has none."""
    d = spark.read.schema(DOC).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("path", F.col("_metadata.file_path"))
    if not admission:
        d = d.where(~F.col("path").endswith("_admission.json"))
    base = file_name(F.col("path"))
    return d.withColumn("university_id", F.substring(base, 1, 3)).withColumn("round", F.coalesce(F.nullif("round", F.lit("")), F.substring(base, 5, 2)))


def read_documents_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents as ``read_documents`` gives them, files that are no document: path, reason, text).

    A file of broken JSON, or one whose top is no object or that lacks both programs and items, is told of and the rest is read.
    A file of no bytes isn't there, as for every reader.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", F.col("content").cast("string").alias("text"))
    d = d.where(~file_name(F.col("path")).endswith("_admission.json"))
    parsed = d.withColumn("doc", F.from_json("text", f"{DOC}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    reason = F.when(~F.col("text").rlike(r"\S"), "empty").when(F.col("doc._broken").isNotNull() | F.col("doc").isNull(), "broken JSON").when(F.col("doc.programs").isNull() & F.col("doc.items").isNull(), "no programs and no items")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where("reason is null").select("path", "doc.*").drop("_broken", "university_id")
    base = file_name(F.col("path"))
    good = good.withColumn("university_id", F.substring(base, 1, 3)).withColumn("round", F.coalesce(F.nullif("round", F.lit("")), F.substring(base, 5, 2)))
    return good, parsed.where("reason is not null").select("path", "reason", "text")


def programs_of(docs: DataFrame) -> DataFrame:
    """Programs with their place; component arrays brought to (code, name, weight, threshold)."""
    one = lambda c: F.struct(F.coalesce(c["test_or_subject_code"], c["subject_code"]).alias("code"), c["subject_name_th"].alias("name"), c["weight_percent"].alias("weight"), F.coalesce(c["min_threshold"], c["min_threshold_percent"]).alias("threshold"))
    d = docs.select("path", "university_id", "university", "round", F.coalesce("archetype", F.lit("?")).alias("source"), F.posexplode("programs").alias("pos", "program"))
    p = F.col("program")
    return d.withColumn("program", p.withField("weighted_components", F.transform(p["weighted_components"], one)).withField("weighted_subjects", F.transform(p["weighted_subjects"], one)))


def read_search_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH_ROW).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: name, id, round, text."""
    d = spark.read.text(path, wholetext=True).withColumn("name", file_name(F.col("_metadata.file_path")))
    return d.select("name", F.substring("name", 1, 3).alias("university_id"), F.substring("name", 5, 2).alias("round"), F.col("value").alias("text"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``uid:round[:chunk]``; blank ones are dropped."""
    d = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").select(F.split("v", ":").alias("p"))
    return d.select(F.get("p", 0).alias("university_id"), F.get("p", 1).alias("round"), F.get("p", 2).try_cast("int").alias("chunk"))


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A landed catalog; gzip is read by its extension."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_binary(spark: SparkSession, path: str, convert: Callable[[bytes], str], glob: str = "*") -> DataFrame:
    """(path, text, error): files through a client's converter (PDF, OCR); a file that fails is told of, not fatal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    out.append((p, convert(bytes(c)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, f"{type(e).__name__}: {e}"[:120]))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    return d.mapInPandas(run, "path string, text string, error string")


def extract_with(chunks: DataFrame, client: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """Rows that a client (say a language model) finds in (id, chunk, text); failed chunks have one row with an error.

    A row that doesn't fit the schema is a failure of its chunk too.
    """
    ddl = f"id string, chunk int, error string, {schema}"
    kind = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, k, t in zip(*(b.column(c).to_pylist() for c in ("id", "chunk", "text")), strict=True):
                try:
                    found = pa.RecordBatch.from_pylist([r | {"id": i, "chunk": k, "error": None} for r in client(t)], schema=kind)
                except Exception as e:  # noqa: BLE001
                    found = pa.RecordBatch.from_pylist([{"id": i, "chunk": k, "error": (str(e) or type(e).__name__)[:120]}], schema=kind)
                yield found

    return chunks.select("id", "chunk", "text").mapInArrow(run, ddl)


def write_search_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("university_id", "round")) -> None:
    """JSON below one folder a key; only the keys in the frame are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def delete_partitions(junk: DataFrame, path: str, by: tuple[str, ...] = ("university_id", "round")) -> int:
    """Delete the folders of the keys that a frame names, say those without a program; how many there were.

    Keys come to the driver one by one, as a file system is asked for each.
    """
    spark, gone = junk.sparkSession, 0
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in junk.select(*by).distinct().toLocalIterator():
        p = hadoop("/".join([path, *[f"{c}={v}" for c, v in zip(by, r, strict=True)]]))
        gone += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; with ``bom`` the first column's name carries the mark that spreadsheets look for."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """A new version beside the earlier ones, which stay as backups."""
    path = f"{root}/v{version:06d}"
    df.write.mode("error").parquet(path)
    return path
