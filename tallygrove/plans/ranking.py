"""Score-fit, search and view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import extract_one, keyword_score
from ..functions.text import squash
from ..operators import enrich, fit, search, views
from .catalogue import register, table

SCORES = [("AF", 72.5), ("NO", 55.0), ("RF", 88.0)]
_SCORES_SQL = "(VALUES ('AF', 72.5::DOUBLE), ('NO', 55.0::DOUBLE), ('RF', 88.0::DOUBLE)) AS s(code, score)"
_COMP_SQL = "SELECT l_orderkey AS pid, l_returnflag || l_linestatus AS code, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL"


def components(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("pid"), F.concat("l_returnflag", "l_linestatus").alias("code")).agg(F.sum("l_quantity").alias("weight"))


def scores(spark):
    return spark.createDataFrame(SCORES, "code string, score double")


_FIT_SQL = f"""c AS ({_COMP_SQL}), f AS (SELECT pid, sum(weight) AS total_w, sum(CASE WHEN score IS NOT NULL THEN weight END) AS got_w,
  sum(weight * score) AS ws, count(*) FILTER (WHERE score IS NOT NULL AND code <> 'RF') AS strong
  FROM c LEFT JOIN {_SCORES_SQL} USING (code) GROUP BY pid),
g AS (SELECT pid, ws / got_w AS fit, got_w / total_w AS coverage, total_w, got_w FROM f WHERE strong > 0 AND got_w <> 0)"""


@register(f"""WITH {_FIT_SQL} SELECT o_orderkey AS pid, c_name AS institution, round(fit, 4) AS fit, round(coverage, 4) AS coverage, total_w,
row_number() OVER (ORDER BY round(coverage, 6) DESC, round(fit, 6) DESC, pid)::INT AS rank
FROM g JOIN orders ON o_orderkey = pid JOIN customer ON c_custkey = o_custkey ORDER BY rank LIMIT 20""")
def fit_rank(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("institution_id"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("institution_id"), F.col("c_name").alias("institution"))
    top = fit.my_fit(orders, customer, components(spark, d), scores(spark), 20, weak=("RF",))
    return top.select("pid", "institution", F.round("fit", 4).alias("fit"), F.round("coverage", 4).alias("coverage"), "total_w", "rank")


@register(f"""WITH c AS ({_COMP_SQL}) SELECT pid, string_agg(code || ':' || weight::BIGINT, ', ' ORDER BY weight DESC, code) AS detail
FROM c JOIN {_SCORES_SQL} USING (code) GROUP BY pid""")
def fit_detail(spark, d):
    return fit.fit_details(components(spark, d), scores(spark))


@register(f"""WITH {_FIT_SQL} SELECT pid, round(fit, 4) AS fit, round(coverage, 4) AS coverage, total_w, got_w FROM g""")
def fit_components(spark, d):
    return fit.fit(components(spark, d), scores(spark), weak=("RF",)).select("pid", F.round("fit", 4).alias("fit"), F.round("coverage", 4).alias("coverage"), "total_w", "got_w")


_PROG_SQL = """SELECT p_partkey AS id, any_value(p_name) AS name, any_value(p_brand) AS university, any_value(p_type) AS round, any_value(p_size) AS seats,
  any_value(p_retailprice) / 500 AS min_gpax, list_sort(list_distinct(list(l_returnflag || l_linestatus) FILTER (WHERE l_returnflag IS NOT NULL))) AS codes
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey"""


def programs(spark, d):
    """Parts in the role of programs, the flags of their lines in that of subject codes."""
    li = table(spark, d, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("c")).groupBy("l_partkey").agg(F.array_sort(F.collect_set("c")).alias("codes"))
    p = table(spark, d, "part").join(li, F.col("l_partkey") == F.col("p_partkey"), "left")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("university"), F.col("p_type").alias("round"), F.col("p_size").alias("seats"), (F.col("p_retailprice") / 500).alias("min_gpax"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


@register(f"""WITH p AS ({_PROG_SQL}) SELECT id, name, seats FROM p WHERE contains(university, 'Brand') AND list_has_all(coalesce(codes, []), ['NO', 'RF'])
AND coalesce(seats, 0) >= 10 AND coalesce(min_gpax, 0) <= 3.0""")
def search_filter(spark, d):
    sig = {"university": "Brand", "subjects": ["NO", "RF"], "seats_min": 10, "gpax": 3.0}
    return search.filtered(programs(spark, d), sig).select("id", "name", "seats")


@register(f"""WITH c AS (SELECT l_orderkey AS pid, list_distinct(list(l_returnflag || l_linestatus)) AS codes FROM lineitem GROUP BY 1)
SELECT pid, len(codes)::INT AS n_codes FROM c WHERE list_has_all(codes, ['AF', 'NO'])""")
def required_subset(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pid")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("codes"))
    return c.where(search.superset(F.col("codes"), ["AF", "NO"])).select("pid", F.size("codes").alias("n_codes"))


@register()
def search_topk(spark, d):
    """Similarity search over part names; names are few and repeat, so each distinct one is scored once."""
    p = programs(spark, d)
    names = p.select("name").distinct().withColumn("score", keyword_score("name", F.array(F.lit("steel"), F.lit("green"))))
    return p.join(names, "name").orderBy(F.desc("score"), F.desc("seats"), "id").limit(8).select("id", "name", "score", "seats")


@register("""SELECT p_partkey AS id, p_name AS name, levenshtein(p_name, 'small red box')::INT AS dist FROM part
ORDER BY dist, p_size DESC, p_partkey LIMIT 8""")
def search_topk_lev(spark, d):
    p = table(spark, d, "part").withColumn("dist", F.levenshtein("p_name", F.lit("small red box")))
    return p.orderBy("dist", F.desc("p_size"), "p_partkey").limit(8).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "dist")


@register()
def rank_average(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", F.round(keyword_score("p_name", F.array(F.lit("stel"), F.lit("small"))), 4).alias("score"))


@register()
def similarity_best(spark, d):
    """The most similar of a few typed names, by weighted ratio."""
    typed = ["smal red", "lrge steel", "gren", "box"]

    @F.pandas_udf("typed string, score double")
    def best(names):
        import pandas as pd

        return pd.DataFrame([extract_one(n, typed) for n in names], columns=["typed", "score"])

    return table(spark, d, "part").select("p_name").distinct().withColumn("b", best("p_name")).select("p_name", "b.typed", F.round("b.score", 4).alias("score"))


@register("""SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(replace(p_name, ' ', '')), lower(replace(
  replace(replace(regexp_replace('GR 12 > st', '[0-9]+\\.?[0-9]*|[><=]', ' ', 'g'), 'GR', 'red'), 'st', ''), ' ', '')))""")
def phrase_search(spark, d):
    from ..functions.text import one_space

    raw = F.lit("GR 12 > st")
    abbreviations = F.create_map(F.lit("GR"), F.lit("red"), F.lit("st"), F.lit(""))
    kept = F.split(one_space(F.regexp_replace(raw, r"\d+\.?\d*|[><=]", " ")), " ")
    phrase = squash(F.array_join(F.transform(kept, lambda t: F.coalesce(F.try_element_at(abbreviations, t), t)), ""))
    return table(spark, d, "part").where(F.contains(squash(F.col("p_name")), phrase)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@register("""WITH m AS (SELECT p_name, min(p_partkey) AS match_id FROM part WHERE p_size > 25 GROUP BY 1)
SELECT p_partkey AS id, p_name AS name, match_id FROM part LEFT JOIN m USING (p_name)""")
def first_match_probe(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    return enrich.first_match(p.select("id", "name"), p.where("p_size > 25").withColumnRenamed("id", "pid"), "name", "pid").select("id", "name", "match_id")


_HITS_SQL = "SELECT p_name AS name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS rank, p_brand, p_size FROM part QUALIFY rank <= 10"


def _hits(spark, d):
    from pyspark.sql import Window

    by = [F.desc("p_retailprice"), F.col("p_partkey")]
    top = table(spark, d, "part").orderBy(*by).limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*by))).select(F.col("p_name").alias("name"), "rank", "p_brand", "p_size")


@register(f"""WITH h AS ({_HITS_SQL}), m AS (SELECT p_name AS name, min(p_partkey) AS pid FROM part GROUP BY 1),
c AS (SELECT l_partkey AS pid, l_returnflag || l_linestatus AS code, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL),
s(code, subject) AS (VALUES ('AF', 'old'), ('NO', 'open'))
SELECT rank, name, code, coalesce(subject, code) AS subject, weight FROM h JOIN m USING (name) JOIN c USING (pid) LEFT JOIN s USING (code)""")
def criteria_view(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("program_id"), F.concat("l_returnflag", "l_linestatus").alias("code")).agg(F.sum("l_quantity").alias("weight"))
    subjects = spark.createDataFrame([("AF", "old"), ("NO", "open")], "code string, subject string")
    progs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return views.criteria(_hits(spark, d).select("name", "rank"), progs, li, subjects)


@register(f"""WITH h AS ({_HITS_SQL}), l AS (SELECT rank, 'p_brand' AS field, p_brand AS v FROM h UNION ALL SELECT rank, 'p_size', p_size::VARCHAR FROM h)
SELECT field, max(v) FILTER (WHERE rank = 1) AS p1, max(v) FILTER (WHERE rank = 2) AS p2, max(v) FILTER (WHERE rank = 3) AS p3, max(v) FILTER (WHERE rank = 4) AS p4
FROM l GROUP BY field""")
def compare_view(spark, d):
    return views.comparison(_hits(spark, d), ["p_brand", "p_size"])


@register("""WITH p AS (SELECT DISTINCT p_type, p_name FROM part WHERE p_size <= 25), q AS (SELECT DISTINCT p_type, p_name AS best FROM part WHERE p_size > 25)
SELECT p_type, p_name AS name, arg_min(best, levenshtein(p_name, best) * 1000000 + rk) AS best, min(levenshtein(p_name, best))::INT AS dist FROM
(SELECT p.*, best, rank() OVER (ORDER BY best) AS rk FROM p JOIN q USING (p_type)) GROUP BY ALL""")
def fuzzy_join(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size <= 25").select("p_type", F.col("p_name").alias("name")).distinct()
    b = p.where("p_size > 25").select("p_type", F.col("p_name").alias("best")).distinct()
    j = a.join(b, "p_type").withColumn("dist", F.levenshtein("name", "best"))
    return j.groupBy("p_type", "name").agg(F.min_by("best", F.struct("dist", "best")).alias("best"), F.min("dist").alias("dist"))


@register()
def fuzzy_join_wratio(spark, d):
    p = table(spark, d, "part")
    return enrich.fuzzy_pairs(p.where("p_size <= 25"), p.where("p_size > 25"), "p_type", "p_name", 80.0)


@register("""SELECT c_custkey, coalesce(n_name, '?') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey""")
def lookup_default(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return enrich.lookup(table(spark, d, "customer"), n, ["c_nationkey"], "nation", "?").select("c_custkey", "nation")


@register("""WITH f AS (SELECT md5(coalesce(text, '')) AS k, arg_min(quality, doc_id) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT doc_id, coalesce(nullif(l.quality, 0), nullif(f.q, 0))::INT AS quality FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN f ON f.k = md5(coalesce(d.text, ''))""")
def enrich_exact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("k"))
    labels = table(spark, d, "labels").select("doc_id", "quality")
    by_text = docs.join(labels, "doc_id").groupBy("k").agg(F.min_by("quality", "doc_id").alias("q"))
    j = docs.join(labels, "doc_id", "left").join(by_text, "k", "left")
    return j.select("doc_id", F.coalesce(F.nullif("quality", F.lit(0)), F.nullif("q", F.lit(0))).alias("quality"))


@register("""WITH h(status, round, handler) AS (VALUES ('1-URGENT', 'O', 'criteria'), ('2-HIGH', 'F', 'index'), ('2-HIGH', 'O', 'list'))
SELECT o_custkey AS university_id, o_orderpriority AS round, o_orderkey::VARCHAR AS path, handler FROM orders JOIN h ON h.status = o_orderpriority AND h.round = o_orderstatus
WHERE o_orderkey % 4 < 2 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey NOT IN (SELECT doc_id FROM labels)""")
def manifest_targets(spark, d):
    """Orders as the files of a manifest a customer; known kinds only, of some customers, but for those that are done."""
    from ..streaming.ingest import unprocessed

    status = F.element_at(F.array(F.lit("ok"), F.lit("skip"), F.lit("fail:Timeout"), F.lit("todo")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    one = F.struct(F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("round_key"), F.col("o_orderkey").cast("string").alias("path"), status.alias("status"))
    manifest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("university_id")).agg(F.collect_list(one).alias("pdfs"))
    kinds = F.explode(F.array(*[F.struct(F.lit(r).alias("round"), F.lit(h).alias("handler")) for r, h in (("1-URGENT|O", "criteria"), ("2-HIGH|F", "index"), ("2-HIGH|O", "list"))])).alias("k")
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("university_id"), "c_acctbal", kinds).select("university_id", "c_acctbal", "k.*")
    got = enrich.targets(manifest, known.drop("c_acctbal"), known.where("c_acctbal > 0").select("university_id", "round"))
    got = unprocessed(got, table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path")), ["path"])
    return got.select("university_id", F.split("round", "\\|")[0].alias("round"), "path", "handler")


@register("""SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS w, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC, l_linestatus)::INT AS k
FROM lineitem GROUP BY 1, 2 QUALIFY k <= 4""")
def topn_per_group(spark, d):
    from pyspark.sql import Window

    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.sum("l_quantity").alias("s"))
    g = g.withColumn("k", F.row_number().over(Window.partitionBy("flag").orderBy(F.desc("s"), "status"))).where("k <= 4")
    return g.select("flag", "status", F.round("s", 2).alias("w"), "k")
