"""Text, extraction and lexicon queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, signals
from .catalogue import register, table

LEXICON = [(1, "licensed under", "license"), (2, "released under", "license"), (3, "password", "secret"), (4, "token", "secret"), (5, "the", "english"), (6, "der", "german"), (7, "que", "romance")]
_LEX_SQL = "(VALUES " + ", ".join(f"({o}, '{k}', '{v}')" for o, k, v in LEXICON) + ") AS x(ord, kw, label)"


@register(f"""SELECT doc_id, arg_min(label, ord) AS label, min(ord)::INT AS ord FROM documents JOIN {_LEX_SQL} ON contains(lower(text), kw) GROUP BY doc_id""")
def lexicon_signals(spark, d):
    lex = spark.createDataFrame(LEXICON, "ord int, kw string, label string")
    return signals.lexicon_match(table(spark, d, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id", "text", lex)


@register(f"""WITH t AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[ \\n]+')) AS token FROM conversations)
SELECT token, arg_min(label, levenshtein(token, kw) * 1000 + ord) AS label FROM t JOIN {_LEX_SQL}
ON token = kw OR (length(token) >= 4 AND levenshtein(token, kw) <= 1) WHERE regexp_full_match(token, '[a-z]+') GROUP BY token""")
def lexicon_fuzzy(spark, d):
    toks = table(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), "[ \\n]+")).alias("token")).where("token rlike '^[a-z]+$'")  # DuckDB's distance is one of bytes
    return signals.match_tokens(toks, spark.createDataFrame(LEXICON, "ord int, kw string, label string"))


@register()
def lexicon_fuzzy_documents(spark, d):
    """All distinct tokens of documents, whatever their characters; without SQL, as DuckDB's distance is one of bytes."""
    toks = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[ \\n]+")).alias("token"))
    return signals.match_tokens(toks, spark.createDataFrame(LEXICON, "ord int, kw string, label string"))


@register(f"""WITH s AS (SELECT doc_id, arg_min(label, ord) AS label FROM documents JOIN {_LEX_SQL} ON contains(lower(text), kw) GROUP BY doc_id)
SELECT doc_id, label, list_sort(list_distinct(list(kw))) AS synonyms, arg_min(kw, ord) AS first_kw FROM s JOIN {_LEX_SQL} USING (label) GROUP BY ALL""")
def lexicon_expand(spark, d):
    lex = spark.createDataFrame(LEXICON, "ord int, kw string, label string")
    s = signals.lexicon_match(table(spark, d, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id", "text", lex).select("doc_id", "label")
    words = lex.groupBy("label").agg(F.array_sort(F.collect_set("kw")).alias("synonyms"), F.min_by("kw", "ord").alias("first_kw"))
    return s.join(F.broadcast(words), "label")


STOP = ("the", "of", "and", "to", "in", "a")


@register("""WITH t AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[ \\n]+')) AS w FROM conversations)
SELECT w AS token, count(*) AS n FROM t WHERE w <> '' AND lower(w) NOT IN ('the', 'of', 'and', 'to', 'in', 'a') AND NOT regexp_full_match(w, '\\p{Nd}+') AND regexp_matches(w, '[\\p{L}\\p{N}]') GROUP BY 1""")
def token_keywords(spark, d):
    t = table(spark, d, "conversations").select(F.explode(F.split("text", "[ \\n]+")).alias("token")).where("token <> ''")
    return t.where(~F.lower("token").isin(*STOP) & ~T.is_noise(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT p_partkey AS id, nullif(regexp_extract('over ' || p_size || ' GPAX: ' || (p_size / 10.0)::DECIMAL(9, 1), '(?:more than|over|>)\\s*([0-9]+)', 1), '')::INT AS seats,
nullif(regexp_extract('over ' || p_size || ' gpax: ' || (p_size / 10.0)::DECIMAL(9, 1), '(?i)(?:GPAX)\\s*[: ]?\\s*([0-9]+\\.?[0-9]*)', 1), '')::DOUBLE AS gpax FROM part""")
def regex_threshold(spark, d):
    said = F.concat(F.lit("over "), F.col("p_size").cast("string"), F.lit(" gpax: "), (F.col("p_size") / 10.0).cast("decimal(9,1)").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.nullif(F.regexp_extract(said, signals.SEATS, 1), F.lit("")).try_cast("int").alias("seats"), F.nullif(F.regexp_extract(said, signals.GPAX, 1), F.lit("")).try_cast("double").alias("gpax"))


@register("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{2}') AS c FROM documents)
SELECT doc_id, list_sort(list_distinct(list_filter(c, lambda x: x::INT BETWEEN 61 AND 89))) AS codes, len(c)::INT AS n FROM t WHERE len(c) > 0""")
def regex_find_all(spark, d):
    c = F.regexp_extract_all("text", F.lit("[0-9]{2}"), F.lit(0))
    t = table(spark, d, "documents").select("doc_id", c.alias("c")).where(F.size("c") > 0)
    return t.select("doc_id", F.array_sort(F.array_distinct(F.filter("c", lambda x: x.try_cast("int").between(61, 89)))).alias("codes"), F.size("c").alias("n"))


@register("""SELECT doc_id, md5(lower(regexp_replace(text, '\\s+', '', 'g'))) AS key_md5, length(trim(regexp_replace(text, '\\s+', ' ', 'g')))::INT AS n FROM documents""")
def ws_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.squash(F.col("text"))).alias("key_md5"), F.length(T.one_space(F.col("text"))).alias("n"))


@register("""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([a-zà-ÿ])\\s+([a-zà-ÿ])', '\\1\\2', 'g'), '([a-zà-ÿ])\\s+([a-zà-ÿ])', '\\1\\2', 'g')) AS m FROM documents""")
def squeeze_between(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.squeeze_between(F.col("text"), "a-z\\u00E0-\\u00FF")).alias("m"))


@register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
b AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z].*\\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY line_no) AS r FROM b WHERE block > 0)
SELECT doc_id, block::BIGINT AS block, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM k WHERE r <= 3 GROUP BY ALL""")
def line_blocks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    b = extract.blocks(rows, "doc_id", F.col("line").rlike("^[A-Z].*\\.$"), 3)
    return b.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@register("""WITH p AS (SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations),
c AS (SELECT *, ((dense_rank() OVER (PARTITION BY conv_id ORDER BY page) - 1) // 2)::INT AS chunk FROM p)
SELECT conv_id, turn, page::BIGINT AS page, chunk FROM c""")
def page_segments(spark, d):
    return extract.segments(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", 2).select("conv_id", "turn", "page", "chunk")


@register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, list_transform(string_split(trim(trim(line), '|'), '|'), lambda x: trim(x)) AS cells FROM l WHERE contains(line, '|') AND NOT contains(line, '---'))
SELECT doc_id, len(cells)::INT AS n_cells, cells[1] AS first_cell, cells[3] AS third_cell FROM c""")
def table_cells(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("contains(line, '|') and not contains(line, '---')")
    c = rows.select("doc_id", T.cells(F.col("line")).alias("cells"))
    return c.select("doc_id", F.size("cells").alias("n_cells"), F.get("cells", 0).alias("first_cell"), F.get("cells", 2).alias("third_cell"))


@register("""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS a, len(regexp_extract_all(text, '\\|')) AS b, len(regexp_extract_all(text, '!!')) AS c FROM documents)
SELECT doc_id, CASE WHEN a = greatest(a, b, c) THEN 'criteria' WHEN b = greatest(a, b, c) THEN 'matrix' ELSE 'index' END AS kind, greatest(a, b, c)::INT AS n FROM n""")
def parser_choice(spark, d):
    n = {"criteria": "[0-9]+", "matrix": "\\|", "index": "!!"}
    t = table(spark, d, "documents").select("doc_id", *[F.regexp_count("text", F.lit(rx)).alias(k) for k, rx in n.items()])
    c = {k: F.col(k) for k in n}
    return t.select("doc_id", extract.best_of(c, tuple(n)).alias("kind"), F.greatest(*c.values()).alias("n"))


@register("""SELECT doc_id, CASE WHEN regexp_matches(text, 'TCAS\\s*CODE[:\\s]*([0-9A-Za-z]+)') THEN 'criteria' WHEN regexp_matches(text, '\\|\\s*[0-9]+\\s*\\|\\s*[0-9]+\\s*\\|\\s*[0-9]+\\s*\\|') THEN 'matrix'
WHEN length(text) - length(replace(text, '|', '')) > 50 THEN 'index' ELSE 'unknown' END AS kind FROM documents""")
def archetype(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.archetype(F.col("text")).alias("kind"))


@register("""SELECT doc_id, regexp_extract(text, '([A-Za-z0-9._]+)@([a-z0-9.]+)', 1) AS user_part, regexp_extract(text, '([0-9]{1,4})', 1) AS first_number FROM documents""")
def capture_first(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "([A-Za-z0-9._]+)@([a-z0-9.]+)", 1).alias("user_part"), F.regexp_extract("text", "([0-9]{1,4})", 1).alias("first_number"))


@register("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host,
regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS base_name,
translate(regexp_extract(url, '://(.*)$', 1), '/\\" ', '____') AS safe FROM pages""")
def url_parts(spark, d):
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.element_at(F.split(bare, "/"), -1).alias("base_name"), T.safe_name(F.regexp_extract("url", "://(.*)$", 1)).alias("safe"))


@register("""SELECT p_partkey AS id, list_sort(list_distinct(string_split_regex(p_brand || ',' || p_type || ' ' || p_size, '[,/ +]+'))) AS codes,
trim(string_split(p_brand || ' / ' || p_type, '/')[1]) AS code, trim(string_split(p_brand || ' / ' || p_type, '/')[2]) AS name, p_brand || '||' || p_type AS composite,
string_split(p_brand || '||' || p_type, '||')[2] AS second FROM part""")
def split_codes(spark, d):
    code, name = T.code_name(F.concat("p_brand", F.lit(" / "), "p_type"))
    both = F.concat_ws("||", "p_brand", "p_type")
    codes = F.array_sort(F.array_distinct(F.split(F.concat("p_brand", F.lit(","), "p_type", F.lit(" "), F.col("p_size").cast("string")), "[,/ +]+")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), codes.alias("codes"), code.alias("code"), name.alias("name"), both.alias("composite"), F.get(F.split(both, r"\|\|"), 1).alias("second"))


_NUM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


@register(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*')) AS w FROM documents),
n AS (SELECT doc_id, w, CASE WHEN regexp_matches(w, '{_NUM}') THEN try_cast(w AS DOUBLE) END AS v FROM t)
SELECT doc_id, w, v, round_even(v, 1) AS r, try_cast(trunc(v) AS INT) AS i, greatest(v, 5.0) AS g FROM n""")
def scalar_casts(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"), F.lit(0))).alias("w")).withColumn("v", T.num(F.col("w")))
    return t.select("doc_id", "w", "v", F.bround("v", 1).alias("r"), F.col("v").try_cast("int").alias("i"), F.when(F.col("v").isNull(), 5.0).otherwise(F.greatest("v", F.lit(5.0))).alias("g"))


@register()
def nfkc_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.nfkc("text")).alias("m"))


@register("""WITH t AS (SELECT doc_id, list_distinct(string_split_regex(text, '[ \\n]+')) AS ws FROM documents), x AS (SELECT doc_id, unnest(ws) AS w FROM t)
SELECT w AS token, count(*) AS df FROM x WHERE w <> '' GROUP BY 1 HAVING count(*) >= 5""")
def doc_freq(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \\n]+"))).alias("token")).where("token <> ''")
    return x.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 5")


@register("""SELECT source, lang, (n_chars // 1000)::BIGINT AS k, count(*) AS n FROM documents GROUP BY ALL""")
def label_freq(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang", F.floor(F.col("n_chars") / 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT doc_id, length(text)::INT AS chars, strlen(text)::INT AS bytes, (length(text) >= 800)::INT AS long_chars, (strlen(text) >= 800)::INT AS long_bytes FROM documents""")
def inventory(spark, d):
    c, b = F.length("text"), F.octet_length("text")
    return table(spark, d, "documents").select("doc_id", c.alias("chars"), b.alias("bytes"), (c >= 800).cast("int").alias("long_chars"), (b >= 800).cast("int").alias("long_bytes"))


@register("""SELECT p_partkey AS id, CASE WHEN trim(concat_ws(' ', p_brand, p_type)) <> '' THEN trim(concat_ws(' ', p_brand, p_type)) ELSE 'other' END AS label FROM part""")
def label_text(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.label_text(F.lit(""), F.col("p_brand"), F.col("p_type")).alias("label"))


@register("""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE contains(text, '|')),
c AS (SELECT doc_id, line_no, list_transform(string_split(trim(trim(line), '|'), '|'), lambda x: trim(x)) AS cells, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS r FROM r WHERE contains(line, '|')),
s AS (SELECT *, coalesce(min(CASE WHEN regexp_full_match(coalesce(cells[2], ''), '[0-9]+') OR regexp_full_match(coalesce(cells[3], ''), '[0-9]+') THEN r END) OVER (PARTITION BY doc_id), 0) AS start, max(len(cells)) OVER (PARTITION BY doc_id) AS n FROM c),
h AS (SELECT doc_id, r, unnest(cells) AS v, unnest(range(len(cells))) AS k FROM s WHERE r < greatest(start, 1)),
u AS (SELECT doc_id, k, v, min(r) AS r FROM h WHERE v <> '' GROUP BY ALL), m AS (SELECT doc_id, k, string_agg(v, ' / ' ORDER BY r) AS name FROM u GROUP BY ALL),
e AS (SELECT doc_id, unnest(range(max(n))) AS k FROM s GROUP BY doc_id)
SELECT doc_id, list(coalesce(name, 'col' || k) ORDER BY k) AS header FROM e LEFT JOIN m USING (doc_id, k) GROUP BY doc_id""")
def render_table(spark, d):
    rows = table(spark, d, "documents").where("contains(text, '|')").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("contains(line, '|')")
    return extract.header_of(rows.select("doc_id", "line_no", T.cells(F.col("line")).alias("cells")), "doc_id")


@register("""SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS k FROM documents QUALIFY k BETWEEN 5 AND 14""")
def row_slice(spark, d):
    t = table(spark, d, "documents").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")))
    return t.where("k between 5 and 14").select("doc_id", "k")
