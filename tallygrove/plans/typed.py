"""Typed search end to end: signals of a table of texts, and the rows that whole searches leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, signals
from .catalogue import register, table

#: By the remainder of a part's key: what a text says, and what is understood.
SAID = (
    (4, 1, ("chula", "มช", "mahidol", ""), ("Chulalongkorn", "Chiang Mai", "Mahidol", None)),
    (4, 4, ("รอบ 1", "โควตา", "admission", ""), ("R1", "R2", "R3", None)),
    (4, 16, ("engineering", "วิทยาศาสตร์", "law", ""), ("Engineering", "Science", "Law", None)),
    (3, 64, ("physics", "คณิตศาสตร์ เคมี", ""), ("64", "61,65", "")),
)


def _of(words: tuple, n: int, by: int):
    return F.element_at(F.array(*[F.lit(x) for x in words]), (F.floor(F.col("p_partkey") / by) % n + 1).cast("int"))


def _sql(words: tuple, n: int, by: int) -> str:
    return f"[{', '.join('NULL' if x is None else repr(x) for x in words)}][(p_partkey // {by} % {n} + 1)::INT]"


@register(f"""SELECT p_partkey AS id, {_sql(SAID[0][3], 4, 1)} AS university, {_sql(SAID[1][3], 4, 4)} AS round, {_sql(SAID[2][3], 4, 16)} AS faculty, {_sql(SAID[3][3], 3, 64)} AS subjects,
p_size AS seats_min, round(2 + p_size / 100, 2)::DOUBLE AS gpax, p_partkey % 5 = 0 AS intl FROM part""")
def typed_signals(spark, d):
    words = [_of(said, n, by) for n, by, said, _ in SAID]
    text = F.concat_ws(" ", *words, F.lit("more than"), F.col("p_size").cast("string"), F.lit("seats GPAX"), F.round(2 + F.col("p_size") / 100, 2).cast("string"), F.when(F.col("p_partkey") % 5 == 0, "international"))
    s = signals.signals_of(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")))
    return s.select("id", "signals.university", "signals.round", "signals.faculty", F.array_join("signals.subjects", ",").alias("subjects"), "signals.seats_min", "signals.gpax", "signals.intl")


_PROGRAMS = """p AS (SELECT p_partkey AS id, p_name || [' International', ' ภาคพิเศษ', ' พลังงาน ทดแทน ยั่งยืน'][(p_partkey % 3 + 1)::INT] AS name, ['Chulalongkorn University', 'Mahidol University'][(p_partkey % 2 + 1)::INT] AS university,
    'R' || (p_partkey // 2 % 4 + 1) AS round, p_size AS seats, p_retailprice / 500 AS min_gpax, CASE WHEN p_partkey % 7 < 4 THEN ['61', '64'] END AS codes FROM part)"""


def programs(spark, d):
    k = F.col("p_partkey")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (k % len(x) + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), F.concat("p_name", pick(" International", " ภาคพิเศษ", " พลังงาน ทดแทน ยั่งยืน")).alias("name"), pick("Chulalongkorn University", "Mahidol University").alias("university"), F.concat(F.lit("R"), F.floor(k / 2) % 4 + 1).alias("round"), F.col("p_size").alias("seats"), (F.col("p_retailprice") / 500).alias("min_gpax"), F.when(k % 7 < 4, F.array(F.lit("61"), F.lit("64"))).alias("codes"))


@register(f"""WITH {_PROGRAMS}
SELECT 'limits' AS search, id, name FROM p WHERE contains(university, 'Chulalongkorn') AND seats >= 10 AND min_gpax <= 3.0 AND (contains(lower(name), 'international') OR contains(name, 'นานาชาติ'))
UNION ALL SELECT 'round', id, name FROM p WHERE contains(university, 'Mahidol') AND round = 'R2' AND contains(name, 'ภาคพิเศษ') AND list_has_all(coalesce(codes, []), ['61', '64'])
UNION ALL SELECT 'phrase', id, name FROM p WHERE contains(lower(replace(name, ' ', '')), 'พลังงานทดแทนยั่งยืน')""")
def typed_search(spark, d):
    """Three searches, each with as many rows as there are: filters by every signal."""
    p = programs(spark, d)
    n = p.count()
    texts = {"limits": "chula GPAX 3.0 more than 10 seats international", "round": "mahidol รอบ 2 ภาคพิเศษ math physics", "phrase": "พลังงานทดแทน ยั่งยืน"}
    lots = [search.search(p, t, k=n, order="id")[1].select(F.lit(s).alias("search"), "id", "name") for s, t in texts.items()]
    return lots[0].unionByName(lots[1]).unionByName(lots[2])
