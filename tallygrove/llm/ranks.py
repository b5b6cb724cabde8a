"""Exact places of rows within their groups, by histograms of digits, without a sort of a whole group.

A group of more than ``most`` rows is a bucket that is split by a digit of its first key that isn't
the same in all its rows; the digit is as wide as the bucket's own span and size need. A histogram of (bucket, digit) gives each
part its first place: that of the bucket plus the counts of the digits before. Parts that are still large are split by
their own next digit, so rows that crowd in a narrow range, or share whole keys, only take more rounds. What is small in the end is
numbered by a window over that part alone.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Rows of a part that one window numbers; digits a round has at most.
MOST, WIDEST = 2000, 12
#: Rows of a table that goes to all tasks at most.
FEW = 50_000


def sent_if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A written table of short rows, marked to go to all tasks if it is counted and small; else Spark shuffles it and splits hot keys."""
    return F.broadcast(df) if df.count() <= most else df


def exact_places(rows: DataFrame, group: str, keys: list[Column], order: list[Column], most: int = MOST) -> DataFrame:
    """The rows with ``place``, a long from 0 within their group, in the order of ``order``.

    ``keys`` are non-null longs, no two more than 2**63 apart in one key, that rise with the order; the last ones tell equal rows apart. ``rows`` is a
    written table, ``group`` has no nulls.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    spans = [F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]]

    def open_buckets(stats: DataFrame) -> DataFrame:
        """Buckets to split: which key, from what value, by how many bits to the right."""
        stage = F.coalesce(*[F.when(F.col(f"max{c}") > F.col(f"min{c}"), F.struct(F.lit(i).alias("i"), F.col(f"min{c}").alias("lo"), F.col(f"max{c}").alias("hi"))) for i, c in enumerate(names)])
        b = stats.where(F.col("_n") > most).withColumn("_s", stage).where(F.col("_s").isNotNull())
        bits = lambda x: F.length(F.bin(x))
        width = F.least(F.lit(WIDEST), bits(F.expr(f"(_n * 4) div {most}")))
        return b.select(group, "_base", F.col("_s.i").alias("_i"), F.col("_s.lo").alias("_lo"), F.greatest(F.lit(0), bits(F.col("_s.hi") - F.col("_s.lo")) - width).cast("int").alias("_shift"))

    cur = rows.withColumn("_base", F.lit(0).cast("long"))
    closed: list[DataFrame] = []
    named = save(rows.groupBy(F.col(group).alias("_g")).count().where(F.col("count") > most).select("_g"), "large")
    some = named.count()
    if some:
        large = sent_if_few(named)
        closed.append(cur.join(large, F.col(group) == F.col("_g"), "left_anti"))
        cur = cur.join(large, F.col(group) == F.col("_g"), "left_semi")
        buckets = save(open_buckets(cur.withColumns(dict(zip(names, keys, strict=True))).groupBy(group, "_base").agg(*spans)), "buckets")
    while some:
        own = cur.join(sent_if_few(buckets), [group, "_base"])
        key = functools.reduce(lambda c, i: c.when(F.col("_i") == i, keys[i]), range(1, len(keys)), F.when(F.col("_i") == 0, keys[0]))
        own = own.withColumn("_digit", F.call_function("shiftright", key - F.col("_lo"), F.col("_shift"))).drop("_i", "_lo", "_shift")
        parts = own.withColumns(dict(zip(names, keys, strict=True))).groupBy(group, "_base", "_digit").agg(*spans)
        before = Window.partitionBy(group, "_base").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        parts = save(parts.withColumn("_first", F.col("_base") + F.coalesce(F.sum("_n").over(before), F.lit(0))), "parts")
        buckets = save(open_buckets(parts.drop("_base").withColumnRenamed("_first", "_base")), "buckets")
        some = buckets.count()
        heads = parts.select(group, "_base", "_digit", "_first").join(sent_if_few(buckets.select(group, F.col("_base").alias("_first"), F.lit(True).alias("_open"))), [group, "_first"], "left")
        own = own.join(sent_if_few(save(heads, "heads")), [group, "_base", "_digit"]).drop("_base", "_digit").withColumnRenamed("_first", "_base")
        own = save(own, "places")
        closed.append(own.where("_open is null").drop("_open"))
        cur = own.where("_open").drop("_open")
    every = functools.reduce(DataFrame.unionByName, closed) if closed else cur
    at = Window.partitionBy(group, "_base").orderBy(*order)
    return every.withColumn("place", F.col("_base") + F.row_number().over(at) - 1).drop("_base")


def long_keys(c: Column) -> list[Column]:
    """A nullable long, nulls first, as keys that don't overflow."""
    return [c.isNotNull().cast("long"), F.coalesce(F.shiftright(c, 32), F.lit(0)).cast("long"), F.coalesce(c.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0)).cast("long")]


def hex_keys(c: Column, digits: int) -> list[Column]:
    """Hexadecimal digests of one length as keys of 15 digits."""
    return [F.conv(F.substring(c, i + 1, min(15, digits - i)), 16, 10).cast("long") for i in range(0, digits, 15)]


def text_keys(c: Column, most: int) -> list[Column]:
    """A nullable text of up to ``most`` bytes, nulls first, bytewise, as keys of 7 bytes; shorter ones sort first as missing bytes count as 0 and their number follows."""
    raw = F.rpad(F.hex(F.coalesce(c, F.lit("")).cast("binary")), 2 * most + 14, "0")
    return [c.isNotNull().cast("long"), *[F.conv(F.substring(raw, 2 * i + 1, 14), 16, 10).cast("long") for i in range(0, most, 7)], F.coalesce(F.octet_length(c), F.lit(0)).cast("long")]
