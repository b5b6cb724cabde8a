"""Conjunctive filters, similarity ranking, top-k."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import keyword_score
from ..functions.text import squash
from .signals import signals_of_text
from .tables import checkpointed


def superset(codes: Column, required: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in required]), codes)) == 0


def predicates(sig: dict) -> list[Column]:
    """Only signals that are there become predicates, so that the scan sees plain filters."""
    name = F.lower(F.coalesce("name", F.lit("")))
    out: list[Column] = []
    if sig.get("university"):
        out.append(F.contains("university", F.lit(sig["university"])))
    if sig.get("subjects"):
        out.append(superset(F.coalesce("codes", F.array().cast("array<string>")), sig["subjects"]))
    if sig.get("seats_min"):
        out.append(F.coalesce("seats", F.lit(0)) >= sig["seats_min"])
    if sig.get("round"):
        out.append(F.col("round") == sig["round"])
    if sig.get("gpax"):
        out.append(F.coalesce("min_gpax", F.lit(0.0)) <= sig["gpax"])
    if sig.get("intl"):
        out.append(F.contains(name, F.lit("นานาชาติ")) | F.contains(name, F.lit("international")))
    if sig.get("format_kw"):
        out.append(F.contains(name, F.lit(sig["format_kw"])))
    if sig.get("phrase_active"):
        out.append(F.contains(squash(F.col("name")), F.lit(sig["phrase"])))
    return out


def filtered(programs: DataFrame, sig: dict) -> DataFrame:
    for p in predicates(sig):
        programs = programs.where(p)
    return programs


def score_bound(name: Column, keywords: list[str]) -> Column:
    """What ``keyword_score`` can't exceed, by the characters that a name shares with each keyword.

    A keyword of m characters that shares c of them with a name of n, or with a part of it, has a common subsequence of c at most with a
    part that is as long at least; so neither ratio is over 200 c / (min(m, n) + c). One with blanks in it can reach 100.
    """
    n = F.coalesce(name, F.lit(""))
    out = F.lit(0.0)
    for k in keywords:
        if not k or k.split() != [k]:
            out = out + 100.0
            continue
        count = lambda ch: F.length(n) - F.length(F.replace(n, F.lit(ch), F.lit("")))
        c = F.lit(0)
        for ch, m in Counter(k).items():
            c = c + F.least(F.lit(m), count(ch))
        out = out + F.coalesce(F.try_divide(200.0 * c, F.least(F.lit(len(k)), F.length(n)) + c), F.lit(0.0))
    return out / len(keywords) + 1e-6


def to_score(names: DataFrame, keywords: list[str], k: int) -> DataFrame:
    """Of distinct names (name) those that can be among the k best: the ones whose bound reaches the k-th best score of those with the highest bounds."""
    bound = checkpointed(names.withColumn("_bound", score_bound(F.col("name"), keywords)))
    kws = F.array(*[F.lit(w) for w in keywords])
    first = bound.orderBy(F.desc("_bound"), "name").limit(max(4 * k, 32)).withColumn("score", keyword_score("name", kws))
    best = first.orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    return bound.where(F.col("_bound") >= (best["least"] if best["n"] == k else -1.0)).drop("_bound")


def search(programs: DataFrame, text: str, k: int = 8, order: str = "ord") -> tuple[dict, DataFrame]:
    """Signals and the k best rows of (university, name, codes, seats, round, min_gpax, ``order``).

    Names are scored once each, and only those that can be among the k best; ties go by seats, then by ``order``.
    """
    sig = signals_of_text(programs.sparkSession, text)
    rows = filtered(programs, sig)
    if sig["keywords"]:
        kws = F.array(*[F.lit(w) for w in sig["keywords"]])
        names = to_score(rows.select("name").distinct(), sig["keywords"], k).withColumnRenamed("name", "_name").withColumn("score", keyword_score("_name", kws))
        rows = rows.join(names, F.col("name").eqNullSafe(F.col("_name"))).drop("_name")
    else:
        rows = rows.withColumn("score", F.lit(0.0))
    return sig, rows.orderBy(F.desc("score"), F.desc(F.coalesce("seats", F.lit(0))), order).limit(k)


def runtime_name(en: Column, faculty: Column, th: Column) -> Column:
    blank = F.lit("")
    return F.trim(F.concat(F.coalesce(en, blank), F.lit(" "), F.coalesce(faculty, blank), F.lit(" "), F.coalesce(th, blank)))
