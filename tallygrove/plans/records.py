"""The operators on records: programs as nested documents, their texts, and the upkeep around them.

Parts play the programs of institutions (their brands), the lines of orders their components, and customers' orders
the lines of documents in text; the SQL derives what is found from the tables, not from the texts.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich, extract, learn, tables
from ..sources import documents
from .catalogue import register, table


def _or_null(when: str, value) -> F.Column:
    return F.when(F.expr(when), value)


#: Keys of parts that share a document of an institution and round, so no document grows with the table.
KEYS = 20_000


def raw_documents(spark: SparkSession, d: str, keys: int = KEYS) -> DataFrame:
    """JSON documents of an institution and round, a range of keys each, parsed as files are; ``first``: programs in those before."""
    line = F.struct(F.col("l_linenumber").alias("k"), F.col("l_orderkey").alias("o"), (60 + F.col("l_linenumber")).cast("string").alias("test_or_subject_code"), F.col("l_returnflag").alias("subject_name_th"), F.col("l_quantity").cast("int").cast("string").alias("weight_percent"), F.lit("10").alias("min_threshold_percent"))
    comps = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.dropFields("k", "o")).alias("weighted_components"))
    p = table(spark, d, "part").join(comps, "p_partkey", "left")
    program = F.struct(
        F.col("p_partkey"), _or_null("p_partkey % 10 <> 0", F.concat(F.lit("T"), (F.col("p_partkey") % 40).cast("string"))).alias("tcas_code"), _or_null("p_partkey % 20 <> 0", F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("program_code"),
        F.col("p_name").alias("program_name_th"), _or_null("p_size % 2 = 0", F.col("p_type")).alias("major_name_en"), F.col("p_size").alias("seats"), _or_null("p_size % 3 <> 0", F.round(F.col("p_retailprice") / 500, 2)).alias("min_gpax"), F.lit("2.5").alias("gpax_min"),
        _or_null("p_size % 5 = 0", F.array(F.lit("71"), F.lit("62"), F.lit("x"))).alias("subject_codes"), "weighted_components",
    )
    key = (F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 3, "0").alias("university_id"), F.concat(F.lit("R"), (F.col("p_size") % 4 + 1).cast("string")).alias("round"), F.floor(F.col("p_partkey") / keys).alias("chunk"))
    docs = p.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(program)), lambda x: x.dropFields("p_partkey")).alias("programs"))
    before = Window.partitionBy("university_id", "round").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a document
    sizes = table(spark, d, "part").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int")).drop("n")
    same = functools.reduce(Column.__and__, [docs[c].eqNullSafe(sizes[c]) for c in ("university_id", "round", "chunk")])
    text = docs.join(sizes, same).select(docs["university_id"], docs["round"], "first", F.to_json(F.struct(F.lit("list").alias("archetype"), "programs")).alias("j"))
    parsed = text.select("university_id", "round", "first", F.concat_ws("/", "university_id", "round").alias("path"), F.from_json("j", documents.DOC).alias("doc"))
    return parsed.select("path", "university_id", F.lit(None).cast("string").alias("university"), "round", "first", "doc.archetype", "doc.programs")


def raw_programs(spark: SparkSession, d: str, keys: int = KEYS) -> DataFrame:
    """The documents' programs, numbered through the documents of an institution and round."""
    docs = raw_documents(spark, d, keys)
    own = documents.programs_of(docs.withColumn("path", F.struct("path", "first")))
    return own.withColumns({"pos": F.col("path.first") + F.col("pos"), "path": F.col("path.path")})


_RAW = """p AS (SELECT lpad(regexp_extract(p_brand, '([0-9]+)', 1), 3, '0') AS university_id, 'R' || (p_size % 4 + 1) AS round, *,
    CASE WHEN p_partkey % 10 <> 0 THEN 'T' || (p_partkey % 40) WHEN p_partkey % 20 <> 0 THEN 'P' || p_partkey ELSE '' END AS code FROM part),
q AS (SELECT *, university_id || '/' || round AS path, (row_number() OVER (PARTITION BY university_id, round ORDER BY p_partkey) - 1)::INT AS pos FROM p),
f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY university_id, round, CASE WHEN code <> '' THEN code ELSE p_name END ORDER BY pos) = 1),
n AS (SELECT *, row_number() OVER (ORDER BY path, pos) AS id FROM f),
c AS (SELECT l_partkey AS p_partkey, (60 + l_linenumber)::VARCHAR AS code, l_returnflag AS name, l_quantity::INT::DOUBLE AS w,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey, l_returnflag, l_quantity::INT::VARCHAR) AS k FROM lineitem)"""


def _tables(spark, d):
    brands = table(spark, d, "part").select(F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 3, "0").alias("university_id")).distinct()
    return tables.relational(raw_programs(spark, d), brands)


@register(f"""WITH {_RAW} SELECT id, university_id, round, code AS tcas_code, p_name AS program_name_th, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS program_name_en, '' AS faculty_th,
p_size AS seats, CASE WHEN p_size % 3 <> 0 THEN round(p_retailprice / 500, 2) ELSE 2.5::DOUBLE END AS min_gpax, 'list' AS source FROM n""")
def relational_program(spark, d):
    return _tables(spark, d)["program"].drop("min_total", "topic")


@register(f"""WITH {_RAW}, u AS (SELECT id, 0 AS src, k, c.code, w, 10.0::DOUBLE AS t FROM n JOIN c USING (p_partkey)
UNION ALL SELECT id, 1, k, v, NULL, NULL FROM n, (VALUES (0, '71'), (1, '62'), (2, 'x')) AS b(k, v) WHERE p_size % 5 = 0)
SELECT id AS program_id, code AS subject_code, w AS weight_percent, t AS min_threshold FROM u QUALIFY row_number() OVER (PARTITION BY id, code ORDER BY src, k) = 1""")
def relational_program_subject(spark, d):
    return _tables(spark, d)["program_subject"]


@register(f"""WITH {_RAW}, u AS (SELECT id, 0 AS src, k, c.code, c.name FROM n JOIN c USING (p_partkey) UNION ALL SELECT id, 1, k, v, NULL FROM n, (VALUES (0, '71'), (1, '62'), (2, 'x')) AS b(k, v) WHERE p_size % 5 = 0)
SELECT code, arg_min(name, (id, src, k)) FILTER (WHERE name IS NOT NULL) AS name_th, CASE WHEN code = 'x' THEN 'other' ELSE 'A-Level' END AS category FROM u GROUP BY code""")
def relational_subject(spark, d):
    """Subjects that some program has; those that only the list of English names has are left out here."""
    return _tables(spark, d)["subject"].select("code", "name_th", "category").join(_tables(spark, d)["program_subject"].select(F.col("subject_code").alias("code")).distinct(), "code", "left_semi")


@register(f"""WITH {_RAW}, g AS (SELECT p_partkey, list_sort(list_distinct(list(code) FILTER (WHERE code::INT BETWEEN 61 AND 89))) AS codes FROM c GROUP BY 1),
s AS (SELECT p_partkey, code, sum(w) AS w FROM c GROUP BY ALL), m AS (SELECT p_partkey, string_agg(code || ':' || w::BIGINT, ',' ORDER BY code) AS weights FROM s GROUP BY 1)
SELECT path, pos, code AS tcas_code, p_name AS program_name_th, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS program_name_en, p_size AS seats,
CASE WHEN p_size % 3 <> 0 THEN round(p_retailprice / 500, 2) ELSE 2.5::DOUBLE END AS min_gpax, CASE WHEN p_size % 5 = 0 THEN ['62', '71'] ELSE coalesce(codes, []) END AS subject_codes,
CASE WHEN p_size % 5 = 0 THEN '' ELSE coalesce(weights, '') END AS weights FROM q LEFT JOIN g USING (p_partkey) LEFT JOIN m USING (p_partkey)""")
def search_rows(spark, d):
    rows = raw_programs(spark, d)
    cols = tables.normalise_program(F.col("program"), F.coalesce(F.size("program.subject_codes") > 0, F.lit(False)))
    out = rows.select("path", "pos", *[c.alias(k) for k, c in cols.items()])
    weights = F.array_join(F.transform(F.array_sort(F.map_entries("weights")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("long").cast("string"))), ",")
    return out.withColumn("weights", weights).drop("topic", "faculty_th")


# --- documents in text ---------------------------------------------------------------------------------

_KIND = "['criteria', 'index', 'list', 'matrix'][1 + (c_custkey % 4)::INT]"
#: A document's lines of records, numbered as they stand.
_LINES = f"""o AS (SELECT c_custkey AS doc_id, {_KIND} AS kind, o_orderkey AS k, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey)"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): a customer's orders as lines of one of four kinds of document; a text without orders is empty."""
    k = F.col("o_orderkey").cast("string")
    num = lambda m, plus=0: (F.col("o_orderkey") % m + plus).cast("string")
    bar = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.lit(x) if isinstance(x, str) else x for x in c]), F.lit(" |"))
    criteria = F.concat(F.lit("สาขาวิชา วิชา"), k, F.lit(" TCAS CODE: C"), k, F.lit(" จำนวนรับตามแผน "), num(300), F.lit("\nรหัสวิชา "), num(40, 55))
    index = bar("1", F.concat(F.lit("A"), F.lpad(k, 8, "0")), F.concat(F.lit("หลักสูตร"), k), num(6000))
    lists = F.concat(F.lit("  "), num(1000), F.lit(". โครงการ ที่ "), k, F.lit(" "))
    cells = [F.lit("")] * 27
    for at, c in ((1, F.lpad(num(1000), 3, "0")), (2, F.concat(F.lit("คณะ"), k)), (3, F.lit("2.75")), (4, num(50)), (5, F.lit("-")), (7, F.lit("10")), (16, F.concat(num(29, 61), F.lit(" / คณิต"))), (17, F.lit("30")), (25, F.lit("60.5")), (26, num(100))):
        cells[at] = c
    matrix = bar(*cells)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("criteria", "index", "list", "matrix")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    d_ = table(spark, d, "customer").withColumn("kind", kind).join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    line = F.when(F.col("kind") == "criteria", criteria).when(F.col("kind") == "index", index).when(F.col("kind") == "list", lists).otherwise(matrix)
    lines = F.array_sort(F.collect_list(F.when(F.col("o_orderkey").isNotNull(), F.struct("o_orderkey", line.alias("line")))))
    return d_.groupBy(F.col("c_custkey").alias("doc_id")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


@register(f"""WITH {_LINES} SELECT doc_id, r::BIGINT AS block, 'C' || k AS tcas_code, 'สาขาวิชาวิชา' || k AS program_name_th, (k % 300)::INT AS seats,
CASE WHEN k % 40 + 55 BETWEEN 61 AND 89 THEN [(k % 40 + 55)::VARCHAR] ELSE [] END AS subject_codes FROM o WHERE kind = 'criteria'""")
def parse_criteria(spark, d):
    return extract.parse_criteria(texts(spark, d))


@register(f"""WITH {_LINES} SELECT doc_id, (r - 1)::INT AS line_no, 'A' || lpad(k::VARCHAR, 8, '0') AS tcas_code, 'หลักสูตร' || k AS program_name_th, 1 AS seats FROM o WHERE kind = 'index'""")
def parse_index(spark, d):
    """Seats are the first cell that could be a number of seats, here the running number."""
    return extract.parse_index(texts(spark, d))


@register(f"""WITH {_LINES} SELECT doc_id, (r - 1)::INT AS line_no, (k % 1000)::VARCHAR AS item_no, (k % 1000) || '. โครงการ ที่ ' || k AS text FROM o WHERE kind = 'list'""")
def list_items(spark, d):
    return extract.parse_list(texts(spark, d))


@register(f"""WITH {_LINES}, m AS (SELECT *, unnest([1, 2, 3]) AS c FROM o WHERE kind = 'matrix')
SELECT doc_id, (r - 1)::INT AS line_no, lpad((k % 1000)::VARCHAR, 3, '0') AS program_code, 'คณะ' || k AS faculty_major_th, 2.75::DOUBLE AS min_gpax, 60.5::DOUBLE AS min_total_score, (k % 100)::INT AS seats,
['GPAX', 'TGAT1', 'A-Level'][c] AS category, CASE WHEN c = 3 THEN (k % 29 + 61)::VARCHAR END AS code, CASE WHEN c = 3 THEN 'คณิต' END AS name, [(k % 50)::DOUBLE, 10.0::DOUBLE, 30.0::DOUBLE][c] AS weight FROM m""")
def parse_matrix(spark, d):
    m = extract.parse_matrix(texts(spark, d))
    return m.withColumn("c", F.explode("weighted_components")).select("doc_id", "line_no", "program_code", "faculty_major_th", "min_gpax", "min_total_score", "seats", "c.*")


@register(f"""WITH {_LINES}, n AS (SELECT doc_id, any_value(kind) AS kind, count(*) AS n FROM o GROUP BY 1)
SELECT c_custkey AS doc_id, coalesce(kind, 'criteria') AS archetype, coalesce(n, 0) AS n FROM customer LEFT JOIN n ON doc_id = c_custkey""")
def best_parse(spark, d):
    return extract.best_parse(texts(spark, d))


@register(f"""WITH {_LINES}, l AS (SELECT doc_id, any_value(kind) AS kind, sum(CASE kind WHEN 'criteria' THEN length('สาขาวิชา วิชา TCAS CODE: C จำนวนรับตามแผน ' || k || k || (k % 300) || chr(10) || 'รหัสวิชา ' || (k % 40 + 55)) ELSE 0 END) + count(*) - 1 AS n FROM o GROUP BY 1)
SELECT d.doc_id FROM documents d WHERE length(text) >= 800 AND d.doc_id NOT IN (SELECT doc_id FROM l WHERE kind <> 'index')""")
def prose_texts(spark, d):
    """Long texts without a record; what was parsed are the texts of ``texts`` but for the index tables'."""
    parsed = extract.best_parse(texts(spark, d)).where("archetype <> 'index'").select("doc_id", "n")
    return extract.prose(table(spark, d, "documents"), parsed).select("doc_id")


@register("""SELECT o_custkey AS doc_id, '| a | b / c |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || o_orderstatus || ' | ' || (o_orderkey % 7) || ' |', chr(10) ORDER BY o_orderkey) AS markdown FROM orders GROUP BY 1""")
def markdown_tables(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.array("o_orderstatus", (F.col("o_orderkey") % 7).cast("string")).alias("cells"))
    heads = o.select("doc_id").distinct().withColumn("h", F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("line_no"), F.array(F.lit("a"), F.lit("b")).alias("cells")), F.struct(F.lit(-1).cast("long").alias("line_no"), F.array(F.lit("a"), F.lit("c\n")).alias("cells"))))).select("doc_id", "h.*")
    return extract.render(heads.unionByName(o), "doc_id")


# --- upkeep --------------------------------------------------------------------------------------------


@register("""WITH i AS (SELECT DISTINCT o_custkey + (o_orderkey % 3) * 1000000 AS id FROM orders) SELECT id, id IN (SELECT c_custkey FROM customer) AS known FROM i""")
def requested_ids(spark, d):
    ids = table(spark, d, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 3 * 1000000).alias("id"))
    return enrich.requested(ids, table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")


@register("""WITH e AS (SELECT doc_id AS id, 'R' || (doc_id % 4) AS round FROM documents WHERE n_chars < 800), f AS (SELECT page_id AS id, 'R' || (page_id % 3) AS round, min(url) AS path FROM pages GROUP BY ALL)
SELECT id, round, path FROM e LEFT JOIN f USING (id, round)""")
def first_candidate(spark, d):
    e = table(spark, d, "documents").where("n_chars < 800").select(F.col("doc_id").alias("id"), F.concat(F.lit("R"), (F.col("doc_id") % 4).cast("string")).alias("round"))
    f = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("R"), (F.col("page_id") % 3).cast("string")).alias("round"), F.col("url").alias("path"))
    return enrich.first_candidate(e, f, ["id", "round"])


_URLS = """u AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN url END AS file_path_1, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 5 > 0 THEN url END AS file_path_2 FROM pages)"""


def _urls(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.expr("case when page_id % 2 = 0 then url end").alias("file_path_1"), F.expr("case when page_id % 3 = 0 then '' when page_id % 5 > 0 then url end").alias("file_path_2"))


@register(f"""WITH {_URLS}, l AS (SELECT id, 'file_path_1' AS field, file_path_1 AS url FROM u UNION ALL SELECT id, 'file_path_2', file_path_2 FROM u),
m AS (SELECT *, id || '/' || field || '__' || coalesce(nullif(translate(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')), '/\\" ', '____'), ''), 'x') AS path FROM l WHERE coalesce(url, '') <> '')
SELECT *, CASE WHEN path IN (SELECT path FROM m WHERE id % 4 = 0) THEN 'skip' ELSE 'todo' END AS status FROM m""")
def download_manifest(spark, d):
    rows = enrich.download_manifest(_urls(spark, d), "id", ["file_path_1", "file_path_2"], table(spark, d, "pages").select(F.lit("").alias("path")).limit(0))
    return enrich.download_manifest(_urls(spark, d), "id", ["file_path_1", "file_path_2"], rows.where("id % 4 = 0"))


@register(f"""WITH {_URLS} SELECT id, coalesce(nullif(file_path_1, ''), nullif(file_path_2, '')) IS NOT NULL AS published FROM u""")
def any_published(spark, d):
    return _urls(spark, d).select("id", enrich.any_of(F.col("file_path_1"), F.col("file_path_2")).alias("published"))


@register("""SELECT p_partkey AS id, CASE p_brand WHEN 'Brand#1' THEN 'one' WHEN 'Brand#2' THEN 'aside' ELSE 'other' END AS canonical FROM part""")
def assign_labels(spark, d):
    known = spark.createDataFrame([("Brand#1", "one"), ("Brand#2", "two"), ("Brand#2", "aside")], "p_brand string, canonical string")
    return enrich.assign(table(spark, d, "part"), known, ["p_brand"]).select(F.col("p_partkey").alias("id"), "canonical")


@register("""WITH l AS (SELECT p_brand AS topic, avg(p_size) AS a, avg(p_retailprice / 500) AS b, avg((p_partkey % 7)::DOUBLE) AS c, avg((p_partkey % 2)::DOUBLE) AS d, avg(p_size * 2) AS e FROM part GROUP BY 1),
u AS (SELECT topic, unnest([-a, -b, -c, -d, -e]) AS w, unnest([0, 1, 2, 3, 4]) AS k, unnest(['size', 'price', 'c', 'd', 'e']) AS name FROM l),
t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY topic ORDER BY w, k) <= 4)
SELECT topic, coalesce(string_agg(name, ' + ' ORDER BY w, k) FILTER (WHERE w < -1), '(misc)') AS label FROM t GROUP BY 1""")
def topic_label(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("topic"), F.col("p_size").alias("a"), (F.col("p_retailprice") / 500).alias("b"), (F.col("p_partkey") % 7).alias("c"), (F.col("p_partkey") % 2).alias("d"), (F.col("p_size") * 2).alias("e"))
    return learn.topic_labels(p, ["a", "b", "c", "d", "e"], {"a": "size", "b": "price"})


@register("""WITH c AS (SELECT DISTINCT unnest([p_size::VARCHAR, p_brand, lpad((p_partkey % 90)::VARCHAR, 3, '0')]) AS code FROM part)
SELECT code, row_number() OVER (ORDER BY regexp_full_match(code, '[0-9]+'), CASE WHEN regexp_full_match(code, '[0-9]+') THEN code::BIGINT ELSE 0 END, code)::INT AS place FROM c""")
def code_order(spark, d):
    c = table(spark, d, "part").select(F.explode(F.array(F.col("p_size").cast("string"), "p_brand", F.lpad((F.col("p_partkey") % 90).cast("string"), 3, "0"))).alias("code")).distinct()
    return tables.surrogate(c, T.code_order(F.col("code")), "place").withColumn("place", F.col("place").cast("int"))


@register("""SELECT p_partkey AS id, ['R1', 'R2', 'R3', 'R4', 'handicap', NULL][(1 + p_partkey % 6)::INT] AS round FROM part""")
def round_of_file(spark, d):
    field = F.element_at(F.array(*[F.lit(x) for x in ("1", "2", "3", "4", "handicap", "5")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.round_of_file(F.concat(F.lit("file_path_"), field, F.lit("__a__b.pdf"))).alias("round"))


@register(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS m FROM documents""")
def tidy_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.tidy_lines(F.col("text"))).alias("m"))


@register("""WITH v AS (SELECT l_orderkey, l_linenumber, unnest([l_quantity, l_discount / 7, -l_extendedprice * 1000, l_tax * l_discount / 10000, 0]) AS x, unnest(range(5)) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, k::INT AS k, format('{:g}', x) AS said FROM v""")
def format_numbers(spark, d):
    xs = F.array("l_quantity", F.col("l_discount") / 7, -F.col("l_extendedprice") * 1000, F.col("l_tax") * F.col("l_discount") / 10000, F.lit(0.0))
    each = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(xs).alias("k", "x"))
    return T.generals(each, "x", "said").select("l_orderkey", "l_linenumber", "k", "said")


@register("""WITH n AS (SELECT page_id, md5(page_id::VARCHAR) AS h FROM pages) SELECT page_id, row_number() OVER (ORDER BY h, page_id) <= floor((SELECT count(*) FROM pages) * 0.8) AS is_train FROM n""")
def plain_split(spark, d):
    return learn.plain_split(table(spark, d, "pages").select("page_id"), ["page_id"]).select("page_id", "is_train")


@register("""WITH p AS (SELECT quality AS l, (doc_id % 3 > 0)::INT AS p FROM labels) SELECT count(*) AS n, count(*) FILTER (WHERE l = p) AS hits, round(count(*) FILTER (WHERE l = p) / count(*), 6) AS accuracy FROM p""")
def accuracy(spark, d):
    return learn.accuracy(table(spark, d, "labels").withColumn("p", (F.col("doc_id") % 3 > 0).cast("int")), "quality", "p")


@register("""WITH p AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS seats FROM part),
c AS (SELECT p_partkey AS ord, p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'x' || p_partkey ELSE 'c' || (p_partkey % 300) END AS code, lower(replace(p_name, ' ', '')) AS name, p_partkey % 40 AS seats FROM part WHERE p_size % 3 <> 0),
a AS (SELECT code, arg_min(seats, ord) AS s1 FROM c GROUP BY 1), b AS (SELECT name, arg_min(seats, ord) AS s2 FROM c GROUP BY 1)
SELECT p_partkey AS id, coalesce(seats, nullif(s1, 0), nullif(s2, 0))::BIGINT AS seats FROM p LEFT JOIN a ON a.code = 'c' || (p_partkey % 400) LEFT JOIN b ON b.name = lower(replace(p_name, ' ', ''))""")
def fill_exact(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), "p_brand", F.concat(F.lit("c"), (F.col("p_partkey") % 400).cast("string")).alias("code"), F.upper("p_name").alias("name"), F.expr("cast(case when p_size % 3 <> 0 then p_size end as bigint)").alias("seats"))
    cat = p.where("p_size % 3 <> 0").select(F.col("p_partkey").alias("ord"), F.expr("case when p_partkey % 2 = 0 then 'x' || p_partkey else 'c' || (p_partkey % 300) end").alias("code"), F.col("p_name").alias("name"), (F.col("p_partkey") % 40).alias("seats"))
    return enrich.fill_exact(rows, cat, "p_brand", "code", "name", "seats").select("id", "seats")
