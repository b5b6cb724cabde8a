"""Similarity joins of names by filter and verify: numbered character pairs, rarest first, then exact scores.

Names are squashed (no blanks, lower case), so a weighted ratio is one of two things. Lengths within 1.5 of each other: the
Indel ratio, which allows ``d = s (n + m)`` insertions and deletions for lengths n and m, with ``s = 1 - least / 100``. Each of them
spoils two pairs at most, so the names share ``max(n, m) - 1 - 2 d`` pairs, which is least for equal lengths:
``n (1 - 4 s) - 1``. Up to 8 times as long: 0.9 of the best Indel ratio of the shorter with a window of the longer of its
length, so the shorter one shares as many with all of the longer, for ``least / 0.9``. Beyond: 0.6 of that, too little.
Of names that share k of their n pairs one of any n - k + 1 of either is common, so only the rarest so many are joined. Where
names are so short that no pair need be shared, single characters stand in, of which ``n least / (200 - least)`` are shared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import fuzz_wratio
from .tables import checkpointed

#: Lengths' ratio from which parts are compared, and beyond which nothing is similar; weight of parts.
PART, FAR, WEIGHT = 1.5, 8, 0.9


def _numbered(grams: Column) -> Column:
    """Repeated grams told apart by their number."""
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("\u0001"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def _grams(name: Column, width: int) -> Column:
    return F.when(F.length(name) >= width, _numbered(F.transform(F.sequence(F.lit(1), F.length(name) - width + 1), lambda i: F.substring(name, i, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def _shortest(least: float) -> float:
    """Up to this length names may be similar without a common pair."""
    s = 1 - least / 100
    return math.inf if 4 * s >= 1 else math.floor(1 / (1 - 4 * s) + 1e-9)


def _prefix(n: Column, width: Column, least: float) -> Column:
    """How many of the rarest grams of a name of n characters must meet the other's."""
    s = 1 - least / 100
    return F.when(width == 2, F.floor(4 * s * n + 1e-9) + 1).otherwise(n - F.ceil(n * least / (200 - least) - 1e-9) + 1)


def candidates(a: DataFrame, b: DataFrame, block: str, least: float) -> DataFrame:
    """(block, name, best): pairs of the distinct squashed names of both sides (block, name) that may reach ``least``, over 60, of a weighted ratio."""
    if not 60 < least <= 100:
        raise ValueError("the bounds are proved for scores over 60")
    lots = []
    for side, df in (("a", a), ("b", b)):
        c = F.col("name")
        longest = _shortest(least) * max((200 - least) / least, 1.0)
        inside = _shortest(min(100.0, least / WEIGHT)) * FAR if least <= 100 * WEIGHT else 0
        single = F.length(c) <= F.lit(float(max(longest, inside)))
        g = df.where("name <> ''").select(F.lit(side).alias("side"), block, "name", F.length(c).alias("n"), F.explode(F.concat(F.transform(_grams(c, 2), lambda x: F.struct(F.lit(2).alias("w"), x.alias("g"))), F.when(single, F.transform(_grams(c, 1), lambda x: F.struct(F.lit(1).alias("w"), x.alias("g")))).otherwise(F.array().cast("array<struct<w:int,g:string>>")))).alias("t"))
        lots.append(g.select("side", block, "name", "n", "t.w", "t.g"))
    every = checkpointed(lots[0].unionByName(lots[1]))
    often = every.groupBy("w", "g").agg(F.count(F.lit(1)).alias("f"))
    at = Window.partitionBy("side", block, "name", "w").orderBy("f", "g")  # a name's own grams
    ranked = checkpointed(every.join(often, ["w", "g"]).withColumn("at", F.row_number().over(at)))
    n = F.col("n")
    one = ranked.where(F.col("side") == "a").select(block, "w", "g", "name", n.alias("n"), "at")
    two = ranked.where(F.col("side") == "b").select(block, "w", "g", F.col("name").alias("best"), n.alias("m"), F.col("at").alias("at2"))
    near = lambda df, k, c: df.where(F.col(c) <= _prefix(F.col(k), F.col("w"), least))
    like = near(one, "n", "at").join(near(two, "m", "at2"), [block, "w", "g"]).where((F.col("n") * least <= F.col("m") * (200 - least)) & (F.col("m") * least <= F.col("n") * (200 - least)))
    pairs = like.select(block, "name", "best", "n", "m").distinct().where(F.levenshtein("name", "best") <= F.floor((1 - least / 100) * (F.col("n") + F.col("m")) + 1e-9))
    pairs = pairs.select(block, "name", "best")
    if least <= 100 * WEIGHT:
        u = min(100.0, least / WEIGHT)
        part = lambda df, k, c: df.where(F.col(c) <= _prefix(F.col(k), F.col("w"), u))
        longer = lambda x, y: (F.col(x) >= PART * F.col(y)) & (F.col(x) <= FAR * F.col(y))
        inner = part(one, "n", "at").join(two, [block, "w", "g"]).where(longer("m", "n"))
        outer = one.join(part(two, "m", "at2"), [block, "w", "g"]).where(longer("n", "m"))
        pairs = pairs.unionByName(inner.select(block, "name", "best")).unionByName(outer.select(block, "name", "best"))
    return pairs.distinct()


def similar(a: DataFrame, b: DataFrame, block: str, least: float, scorer=fuzz_wratio) -> DataFrame:
    """(block, name, best, score) of all pairs that reach ``least``."""
    return candidates(a, b, block, least).withColumn("score", scorer("name", "best")).where(F.col("score") >= least)


def edit_pairs(a: DataFrame, b: DataFrame, block: str, most: int) -> DataFrame:
    """(block, name, best, dist) of all pairs of (block, name) at an edit distance of up to ``most``, by the same filter.

    An edit spoils two pairs at most, so of n - 1 pairs any 2 ``most`` + 1 have one that is shared; names too short for that are
    compared by their single characters, of which an edit spoils one.
    """
    lots = []
    for side, df in (("a", a), ("b", b)):
        c = F.col("name")
        short = F.length(c) <= 3 * most + 2
        both = F.concat(F.transform(_grams(c, 2), lambda x: F.struct(F.lit(2).alias("w"), x.alias("g"))), F.when(short, F.concat(F.transform(_grams(c, 1), lambda x: F.struct(F.lit(1).alias("w"), x.alias("g"))), F.array(F.struct(F.lit(0).alias("w"), F.lit("").alias("g"))))).otherwise(F.array().cast("array<struct<w:int,g:string>>")))
        lots.append(df.select(F.lit(side).alias("side"), block, "name", F.length(c).alias("n"), F.explode(both).alias("t")).select("side", block, "name", "n", "t.w", "t.g"))
    every = checkpointed(lots[0].unionByName(lots[1]))
    often = every.groupBy("w", "g").agg(F.count(F.lit(1)).alias("f"))
    at = Window.partitionBy("side", block, "name", "w").orderBy("f", "g")
    # a name of ``most`` characters or fewer may share none: it has the empty gram, as all that it can be near to
    keep = F.when(F.col("w") == 2, 2 * most + 1).when(F.col("w") == 1, most + 1).otherwise(F.when(F.col("n") <= 2 * most, 1).otherwise(0))
    ranked = checkpointed(every.join(often, ["w", "g"]).withColumn("at", F.row_number().over(at)).where(F.col("at") <= keep))
    one = ranked.where(F.col("side") == "a").select(block, "w", "g", "name", "n")
    two = ranked.where(F.col("side") == "b").select(block, "w", "g", F.col("name").alias("best"), F.col("n").alias("m"))
    met = one.join(two, [block, "w", "g"]).where(F.abs(F.col("n") - F.col("m")) <= most).select(block, "name", "best").distinct()
    return met.withColumn("dist", F.levenshtein("name", "best")).where(F.col("dist") <= most)
