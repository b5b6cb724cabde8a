"""Incremental runs: new files are taken once, keys keep their first row across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructField, StructType

from ..operators.tables import first_wins


def unprocessed(files: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return files.join(done, key, "left_anti")


def _unseen(_: tuple, lots: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a key that no batch before had; the state of a key is that it was seen."""
    if state.exists:
        return
    state.update((True,))
    yield from lots


def first_seen(stream: DataFrame, key: list[str]) -> DataFrame:
    """A stream's rows whose keys are in no earlier batch. Rows travel as JSON, so that no type is bent; null keys are keys.

    What a batch costs depends on its own keys, not on how many were seen: the state store looks up and writes these alone.
    """
    schema = stream.schema
    told = stream.select(F.to_json(F.struct(*[F.col(k) for k in key]), {"ignoreNullFields": "false"}).alias("key"), F.to_json(F.struct(*schema.names), {"ignoreNullFields": "false"}).alias("row"))
    new = told.groupBy("key").applyInPandasWithState(_unseen, "key string, row string", "seen boolean", "append", "NoTimeout")
    loose = StructType([StructField(f.name, f.dataType, True) for f in schema])
    return new.select(F.from_json("row", loose).alias("r")).select("r.*")


def ingest(spark: SparkSession, source: str, schema: str, key: list[str], order: list[str], sink: str, checkpoint: str):
    """Take what is new below ``source`` (Parquet) into ``sink``, first row of each key wins, and stop; returns the query.

    The checkpoint has which files were taken and which keys were seen, so a run that is repeated adds nothing and a batch
    reads nothing of the sink; a batch that is repeated after a failure replaces its own folder.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        first_wins(df, key, order).withColumn("batch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    stream = first_seen(spark.readStream.schema(schema).parquet(source), key)
    return stream.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
