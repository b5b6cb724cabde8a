"""Shaping, dedupe, set and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, learn, tables
from ..streaming.ingest import unprocessed
from .catalogue import register, table


@register("""SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) = 1""")
def dedupe_first(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("m"))
    return tables.first_wins(t, ["lang", "m"], ["doc_id"]).select("doc_id", "lang")


@register("""SELECT user_id, arg_min_null(event_type, event_id) AS first_type, arg_max_null(event_type, event_id) AS last_type, arg_min_null(value, event_id) AS first_value FROM events GROUP BY 1""")
def first_last_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"), F.min_by("value", "event_id").alias("first_value"))


_KEY = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@register(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_KEY}) = 1""")
def insert_or_ignore(spark, d):
    return tables.first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _KEY.split(", ")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register("""SELECT l_orderkey AS pid, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INT AS pos, l_partkey AS code, l_quantity AS weight FROM lineitem""")
def unnest_components(spark, d):
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pid")).agg(F.array_sort(F.collect_list(one)).alias("comps"))
    return g.select("pid", F.posexplode("comps").alias("pos", "c")).select("pid", "pos", F.col("c.l_partkey").alias("code"), F.col("c.l_quantity").alias("weight"))


@register("""SELECT p_partkey AS id, slot::INT AS slot, code, weight FROM (SELECT p_partkey, 1 AS slot, p_brand AS code, p_size::VARCHAR AS weight FROM part
UNION ALL SELECT p_partkey, 2, nullif(p_type, 'STANDARD'), CASE WHEN p_size > 25 THEN p_size::VARCHAR END FROM part) WHERE coalesce(code, '') <> '' OR coalesce(weight, '') <> ''""")
def unpivot_slots(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.nullif("p_type", F.lit("STANDARD")).alias("t"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("w"))
    return tables.unpivot_slots(p, ["id"], [{"code": "p_brand", "weight": "p_size"}, {"code": "t", "weight": "w"}])


@register("""SELECT l_orderkey AS pid, l_returnflag AS code, round(sum(l_quantity), 2) AS weight FROM lineitem GROUP BY ALL""")
def weights_map(spark, d):
    m = tables.weights_map(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "pid"), ["pid"], "l_returnflag", "l_quantity")
    return m.select("pid", F.explode("weights").alias("code", "w")).select("pid", "code", F.round("w", 2).alias("weight"))


@register("""SELECT p_partkey AS id, CASE WHEN p_size BETWEEN 61 AND 89 THEN 'A-Level' WHEN p_size IN (21, 30, 40, 50) THEN 'TPAT' ELSE 'other' END AS category,
CASE WHEN p_size IS NULL THEN 4 ELSE 3 END AS rk FROM part""")
def category_case(spark, d):
    code = F.col("p_size").cast("string")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.category(code).alias("category"), T.feature_rank(code)[0].alias("rk"))


FLAGS = ["A", "N", "R"]
_PIV = "SELECT l_orderkey AS pid, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0)::DOUBLE AS A, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0)::DOUBLE AS N, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0)::DOUBLE AS R FROM lineitem GROUP BY 1"


def features(spark, d):
    return tables.pivot_features(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "pid"), ["pid"], "l_returnflag", "l_quantity", FLAGS)


@register(f"""WITH p AS ({_PIV}) SELECT * FROM p WHERE A + N + R <> 0""")
def features_pivot(spark, d):
    return features(spark, d)


@register(f"""WITH p AS ({_PIV}), s AS (SELECT avg(A) ma, avg(N) mn, avg(R) mr, stddev_pop(A) sa, stddev_pop(N) sn, stddev_pop(R) sr FROM p)
SELECT pid, round((A - ma) / sa, 5) AS A, round((N - mn) / sn, 5) AS N, round((R - mr) / sr, 5) AS R FROM p, s""")
def standardise(spark, d):
    return learn.standardise(features(spark, d), FLAGS).select("pid", *[F.round(c, 5).alias(c) for c in FLAGS])


@register("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)
SELECT vec_id, arg_max(c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.c)) AS label FROM embeddings e, c GROUP BY vec_id""")
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    c = learn.mean_vectors(e, "label", "embedding")
    return learn.nearest(e.select("vec_id", "embedding"), c, "vec_id", "embedding", "label")


@register("""WITH t AS (SELECT label AS cluster, (vec_id % 7)::VARCHAR AS lab, count(*) AS n FROM embeddings GROUP BY ALL),
r AS (SELECT cluster, arg_max(lab, n * 100 + lab::INT) AS r FROM t GROUP BY cluster)
SELECT cluster, CASE WHEN row_number() OVER (PARTITION BY r ORDER BY cluster) > 1 THEN r || '#' || cluster ELSE r END AS representative FROM r""")
def cluster_rep(spark, d):
    t = table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster"), (F.col("vec_id") % 7).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return learn.representatives(t)


@register()
def kmeans_topics(spark, d):
    return learn.kmeans(table(spark, d, "embeddings").select("vec_id", "embedding"), vec="embedding", k=8, starts=10, scale=True).select("vec_id", "topic")


@register()
def agglomerative(spark, d):
    """The vectors themselves, each under its id, at the reference's cut."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.lit(1).alias("n"))
    return learn.cluster_labels(e, "vec_id", "embedding", "n")


@register()
def mlp_classify(spark, d):
    """Quality from coarse counts of a text: accuracy report on the held-out fifth."""
    docs = table(spark, d, "documents")
    size = F.greatest(F.length("text"), F.lit(1))
    f = docs.select("doc_id", *[(F.regexp_count("text", F.lit(rx)) / size).alias(k) for k, rx in (("caps", "[A-Z]"), ("marks", "[!|#$%&*]"), ("digits", "[0-9]"), ("stops", "[.,]"))])
    t = learn.stratified_split(f.join(table(spark, d, "labels"), "doc_id"), "quality", ["doc_id"])
    return learn.report(learn.classify(t, ["caps", "marks", "digits", "stops"], "quality", (64, 32), 400), "quality", "prediction")


def _part_weights(spark, d):
    """A part's summed quantities by flag, standardised."""
    w = tables.pivot_features(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "pid"), ["pid"], "l_returnflag", "l_quantity", FLAGS)
    return learn.standardise(tables.checkpointed(w), FLAGS)


@register()
def mlp_topic(spark, d):
    """The topic that k-means gives a program (a part) by its weights, learnt from these: report on the held-out fifth."""
    t = learn.stratified_split(learn.kmeans(_part_weights(spark, d), FLAGS, starts=3), "topic", ["pid"])
    return learn.report(learn.classify(t, FLAGS, "topic", (64, 32), 400), "topic", "prediction")


@register()
def mlp_institution(spark, d):
    """The institution of a program (the brand of a part) from its weights: report on the held-out fifth."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_brand").alias("institution"))
    t = learn.stratified_split(learn.encode_label(_part_weights(spark, d).join(p, "pid"), "institution"), "institution", ["pid"])
    return learn.report(learn.classify(t, FLAGS, "label_id", (64, 32), 400), "label_id", "prediction")


@register("""WITH p AS (SELECT quality AS l, (d.doc_id % 3 > 0)::INT AS p FROM labels JOIN documents d USING (doc_id)),
s AS (SELECT l AS label, count(*) AS support, count(*) FILTER (WHERE l = p) AS tp FROM p GROUP BY 1), q AS (SELECT p AS label, count(*) AS said FROM p GROUP BY 1)
SELECT label, support, round(tp / said, 6) AS precision, round(tp / support, 6) AS recall, round(2 * (tp / said) * (tp / support) / (tp / said + tp / support), 6) AS f1 FROM s JOIN q USING (label)""")
def eval_report(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id").withColumn("p", (F.col("doc_id") % 3 > 0).cast("int"))
    return learn.report(t, "quality", "p")


@register("""SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8)) AS is_train, (dense_rank() OVER (ORDER BY label) - 1)::INT AS label_id FROM embeddings""")
def split_encode(spark, d):
    t = learn.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "label", ["vec_id"])
    return learn.encode_label(t, "label").select("vec_id", "label", "is_train", "label_id")


@register("""WITH a AS (SELECT doc_id AS k, quality AS v FROM labels), b AS (SELECT doc_id AS k, (n_chars % 2)::INT AS v FROM documents WHERE doc_id % 3 <> 0)
SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS common,
count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND coalesce(a.v, 0) = coalesce(b.v, 0)) AS agree FROM a FULL JOIN b ON a.k = b.k""")
def keyset_compare(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.col("quality").alias("v"))
    b = table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("v"))
    return extract.compare(a, b, "doc_id", "v")


@register("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS big, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY 1 ORDER BY n DESC""")
def counters(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("big"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))
    return g.orderBy(F.desc("n"))


@register("""SELECT event_id, (props->>'k')::INT AS k, coalesce(props->>'missing', '?') AS m FROM events""")
def scan_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int, missing string").alias("p")).select("event_id", "p.k", F.coalesce("p.missing", F.lit("?")).alias("m"))


@register("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def anti_skip(spark, d):
    return unprocessed(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@register("""WITH c AS (SELECT l_orderkey, l_returnflag AS code, l_quantity AS w, l_linenumber AS k, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
p AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders)
SELECT id, o_orderkey::VARCHAR AS tcas_code, substr(o_orderpriority, 1, 1) AS round, coalesce(sum(w), 0)::DOUBLE AS total, coalesce(list_sort(list_distinct(list(code) FILTER (WHERE code IS NOT NULL))), []) AS subject_codes FROM p LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY ALL""")
def program_rows(spark, d):
    """Orders as nested programs, unnested again into rows with a surrogate key."""
    comps = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("code"), F.col("l_quantity").alias("w"))).alias("c"))
    o = table(spark, d, "orders").join(comps, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<struct<code:string,w:double>>")
    rows = o.select("o_orderkey", F.struct(F.col("o_orderkey").cast("string").alias("tcas_code"), F.substring("o_orderpriority", 1, 1).alias("round"), F.coalesce("c", none).alias("c")).alias("program"))
    rows = tables.surrogate(rows, ["o_orderkey"])
    c = F.col("program.c")
    return rows.select("id", "program.tcas_code", "program.round", F.aggregate(c, F.lit(0.0), lambda a, x: a + x["w"]).alias("total"), F.array_sort(F.array_distinct(F.transform(c, lambda x: x["code"]))).alias("subject_codes"))
