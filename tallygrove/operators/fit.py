"""Score-fit ranking: how well a person's scores meet the weights of each program."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A person's scores are few; beyond this they are joined by shuffle.
FEW = 10_000


def parse_scores(spark: SparkSession, args: list[str], rescale: dict[str, float] | None = None) -> DataFrame:
    """(code, score) of arguments ``code:value``; malformed ones are skipped, of a repeated code the last counts, GPAX is put on 0 to 100."""
    rescale = {"GPAX": 25.0} if rescale is None else rescale
    out: dict[str, float] = {}
    for a in args:
        code, sep, value = a.partition(":")
        try:
            v = float(value)
        except ValueError:
            continue
        if sep:
            out[code.strip()] = v * rescale.get(code.strip(), 1.0)
    return spark.createDataFrame(list(out.items()), "code string, score double")


def rescale(code: Column, value: Column, which: str = "GPAX", by: float = 25.0) -> Column:
    return F.when(code == which, value * by).otherwise(value)


def fit(components: DataFrame, scores: DataFrame, weak: tuple[str, ...] = ("GPAX",)) -> DataFrame:
    """(pid, fit, coverage, total_w, got_w) of (pid, code, weight) and (code, score).

    Weights that are null don't count. A program needs a match on a code that isn't ``weak``. Fit is the
    weighted mean of the matched scores, coverage the matched share of all weight; a matched weight of 0 drops the program.
    One pass: the left join keeps unmatched weights for the total, sums are partial before the shuffle.
    """
    small = F.broadcast(scores) if scores.count() <= FEW else scores
    d = components.where(F.col("weight").isNotNull()).join(small, "code", "left")
    hit = F.col("score").isNotNull()
    strong = hit & ~F.col("code").isin(*weak) if weak else hit
    g = d.groupBy("pid").agg(
        F.sum("weight").alias("total_w"),
        F.sum(F.when(hit, F.col("weight"))).alias("got_w"),
        F.sum(F.when(hit, F.col("weight") * F.col("score"))).alias("_sum"),
        F.count_if(strong).alias("_strong"),
    )
    g = g.where("_strong > 0 and got_w <> 0")
    return g.select("pid", (F.col("_sum") / F.col("got_w")).alias("fit"), F.coalesce(F.try_divide("got_w", "total_w"), F.lit(0.0)).alias("coverage"), "total_w", "got_w")


def my_fit(programs: DataFrame, institutions: DataFrame, components: DataFrame, scores: DataFrame, limit: int = 15, weak: tuple[str, ...] = ("GPAX",)) -> DataFrame:
    """Programs (pid, institution_id, ...) of known institutions by coverage, then fit, then pid; ranked from 1."""
    known = programs.join(institutions, "institution_id")
    top = fit(components.join(known.select("pid"), "pid", "left_semi"), scores, weak)
    top = top.orderBy(F.desc(F.round("coverage", 6)), F.desc(F.round("fit", 6)), "pid").limit(limit)
    rank = Window.orderBy(F.desc(F.round("coverage", 6)), F.desc(F.round("fit", 6)), "pid")  # over ``limit`` rows
    return known.join(F.broadcast(top.withColumn("rank", F.row_number().over(rank))), "pid")


def fit_details(components: DataFrame, scores: DataFrame) -> DataFrame:
    """Per program the matched components as 'code:weight', by weight."""
    d = components.where(F.col("weight").isNotNull()).join(scores, "code")
    lot = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("code").alias("code"))))
    return d.groupBy("pid").agg(F.array_join(F.transform(lot, lambda x: F.concat(x["code"], F.lit(":"), (-x["w"]).cast("long").cast("string"))), ", ").alias("detail"))
