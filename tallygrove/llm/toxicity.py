"""Toxicity: subword-bag embeddings averaged into a linear softmax (see ``subword``).

Only character n-grams of lower-cased words are features, so a misspelling shares most of its vectors with the
word that it bends. Averages are over windows of 5 words, one from every word on, as a few words in thousands make a text toxic; so words before or after change no verdict to the better. A document is toxic at a score of 0.7 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import subword

KIND = subword.Kind(grams=(3, 4, 5), window=5, blanks=30, train_bytes=3 << 20)
LEAST = 0.7


def assess(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return subword.score(docs, subword.fit(docs, labels, "toxic", KIND), KIND, LEAST, **kw)


def query(spark, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
