"""Quality classifier: learned hashed word and character n-gram vectors averaged per document (see ``subword``).

Case is kept, and a word that repeats the one before it is a feature. A document is good at a score of 0.5 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subword

KIND = subword.Kind(grams=(3, 4), words=True, lower=False, train_bytes=3 << 20)
LEAST = 0.5


def assess(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return subword.score(docs, subword.fit(docs, labels, "quality", KIND), KIND, LEAST, **kw)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier takes for good, with their own columns."""
    cols = docs.columns
    return assess(docs, labels, carry=tuple(cols)).where("predicted = 1").select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(cols)])


def query(spark, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
