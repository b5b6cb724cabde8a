"""Segmentation by a dictionary of any size, as a plan: a lattice of known words and the cheapest way through it.

A text is cut at changes of script first. Every distinct run without blanks between words meets the dictionary in one join, by all its
substrings of lengths that words have; what is known becomes the run's lattice, a list of starts for each end. The way through
with the fewest unknown characters, then the fewest pieces, then the earliest starts, is an ``aggregate`` over the ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a script that doesn't part its words.
JOINED = "\\u0E00-\\u0E7F"
RUN = rf"(?s)(?U:\s)+|[{JOINED}]+|\p{{Nd}}+(?:\.\p{{Nd}}+)?|[\p{{L}}\p{{Nl}}\p{{No}}&&[^{JOINED}]]+|."


def _way(lattice: Column) -> Column:
    """Per end of a prefix, from the empty one: unknown characters, pieces, where the last piece starts, whether it is known."""
    zero = F.lit(0)
    first = F.array(F.struct(zero.alias("u"), zero.alias("p"), zero.alias("at"), F.lit(False).alias("known")))

    def step(best: Column, x: Column) -> Column:
        known = F.transform(x["starts"], lambda s: F.struct(F.get(best, s)["u"].alias("u"), (F.get(best, s)["p"] + 1).alias("p"), s.alias("at"), F.lit(True).alias("known")))
        before = F.get(best, x["end"] - 1)
        alone = F.array(F.struct((before["u"] + 1).alias("u"), (before["p"] + 1).alias("p"), (x["end"] - 1).alias("at"), F.lit(False).alias("known")))
        return F.concat(best, F.array(F.array_min(F.when(F.array_contains(x["starts"], x["end"] - 1), known).otherwise(F.concat(known, alone)))))

    return F.aggregate(lattice, first, step)


def _pieces(run: Column, way: Column) -> Column:
    """The pieces of the way that ends with the run; unknown ones that meet are one."""
    none = F.array().cast("array<struct<piece:string,known:boolean>>")

    def back(acc: Column, _: Column) -> Column:
        last = F.get(way, acc["at"])
        more = F.array(F.struct(F.substring(run, last["at"] + 1, acc["at"] - last["at"]).alias("piece"), last["known"].alias("known")))
        return F.when(acc["at"] > 0, F.struct(last["at"].alias("at"), F.concat(more, acc["out"]).alias("out"))).otherwise(acc)

    cuts = F.aggregate(F.sequence(F.lit(1), F.length(run)), F.struct(F.length(run).alias("at"), none.alias("out")), back, lambda acc: acc["out"])

    def merge(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        one = F.array(F.struct(F.concat(last["piece"], x["piece"]).alias("piece"), F.lit(False).alias("known")))
        return F.when((F.size(out) > 0) & ~x["known"] & ~F.try_element_at(out, F.lit(-1))["known"], F.concat(F.slice(out, 1, F.size(out) - 1), one)).otherwise(F.concat(out, F.array(x)))

    return F.transform(F.aggregate(cuts, none, merge), lambda x: x["piece"])


def cut_runs(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, pieces) of the distinct runs in the column ``run``; ``words`` has the column ``word``, repeats and nulls don't matter."""
    once = runs.select("run").distinct()
    known = words.where(F.col("word").rlike(f"^[{JOINED}]+$")).select("word").distinct()
    lengths = [r[0] for r in known.select(F.length("word")).distinct().collect()]  # a word's length is bounded, so these are few
    size = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    ends = once.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("end"))
    subs = ends.select("run", "end", F.explode_outer(F.filter(size, lambda n: n <= F.col("end"))).alias("n"))
    subs = subs.withColumn("word", F.substring(F.col("run"), F.col("end") - F.col("n") + 1, F.col("n")))
    met = subs.join(known.withColumn("_known", F.lit(True)), "word", "left")
    lattice = met.groupBy("run", "end").agg(F.collect_list(F.when(F.col("_known"), F.col("end") - F.col("n"))).alias("starts"))
    lattice = lattice.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("end", "starts"))).alias("lattice"))
    # the way is made once, as the element of an array that a lambda reads
    return lattice.select("run", F.get(F.transform(F.array(_way(F.col("lattice"))), lambda way: _pieces(F.col("run"), way)), 0).alias("pieces"))


def segment(texts: DataFrame, ident: str, text: str, words: DataFrame) -> DataFrame:
    """(ident, tokens): blanks are tokens too, so that they make up the text. Idents are distinct; a null or empty text has no token."""
    runs = texts.select(F.col(ident).alias("_id"), F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))).alias("at", "run"))
    cut = cut_runs(runs.where(F.col("run").rlike(f"^[{JOINED}]")), words)
    told = runs.join(cut, "run", "left").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("pieces", F.array("run")).alias("ps")))).alias("rs"))
    none = F.array().cast("array<string>")
    ids = texts.select(F.col(ident).alias("_own"))
    return ids.join(told, F.col("_own").eqNullSafe(F.col("_id")), "left").select(F.col("_own").alias(ident), F.coalesce(F.flatten(F.transform("rs", lambda r: r["ps"])), none).alias("tokens"))
