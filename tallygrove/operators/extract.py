"""Rule-based extraction: lines to program rows, pages, tables, and the choice among parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cells, code_name, dash_num, lines, squeeze_between

#: What documents say before a code, a name, a number of seats, a subject, an item and a row of three numbers.
CODE = r"TCAS\s*CODE[:\s]*([0-9A-Za-z]+)"
NAME = r"(สาขาวิชา[^|\n]*?)\s*TCAS"
PLAN = r"จำนวนรับตามแผน[^\d]*(\d+)"
SUBJECT = r"รหัสวิชา[^\d]*(\d{2})"
ITEM = r"(\d{1,3})\.\s*(?:การรับสมัคร|โครงการ|รับ)"
ROW = r"\|\s*\d+\s*\|\s*\d+\s*\|\s*\d+\s*\|"
BLOCK = 40
#: Fixed places of the matrix's columns.
MATRIX = {"code": 1, "name": 2, "min_gpax": 3, "gpax_w": 4, "tgat_w": 5, "tgat1_w": 7, "tgat2_w": 9, "tpat_subj": 11, "tpat_w": 12, "alevel1": 16, "alevel1_w": 17, "alevel2": 18, "alevel2_w": 19, "alevel3": 20, "alevel3_w": 21, "alevel4": 22, "alevel4_w": 23, "min_total": 25, "seats": 26}


def exploded(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, line_no, line), from 0."""
    return df.select(ident, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def blocks(rows: DataFrame, ident: str, header: Column, most: int = BLOCK) -> DataFrame:
    """Lines with their block: a header owns what follows up to the next header, ``most`` lines in all. Others go."""
    w = Window.partitionBy(ident).orderBy("line_no")
    d = rows.withColumn("is_header", header).withColumn("block", F.sum(F.col("is_header").cast("int")).over(w)).where("block > 0")
    return d.withColumn("in_block", F.row_number().over(Window.partitionBy(ident, "block").orderBy("line_no"))).where(F.col("in_block") <= most)


def parse_criteria(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    rows = exploded(df, ident, text).withColumn("line", squeeze_between(F.col("line")))
    b = blocks(rows, ident, F.col("line").rlike(CODE))
    found = F.filter(F.regexp_extract_all("line", F.lit(SUBJECT), F.lit(1)), lambda c: c.try_cast("int").between(61, 89))
    head = F.when(F.col("is_header"), F.col("line"))
    g = b.groupBy(ident, "block").agg(F.max(head).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(found)))).alias("subject_codes"))
    return g.select(ident, "block", F.regexp_extract("h", CODE, 1).alias("tcas_code"), F.btrim(F.regexp_extract("h", NAME, 1), F.lit(" |")).alias("program_name_th"), F.nullif(F.regexp_extract("h", PLAN, 1), F.lit("")).try_cast("int").alias("seats"), "subject_codes")


def table_rows(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, line_no, cells) of lines that are rows of a table in text."""
    return exploded(df, ident, text).where(F.col("line").startswith("|") & ~F.contains("line", F.lit("---"))).select(ident, "line_no", cells(F.col("line")).alias("cells"))


def parse_index(df: DataFrame, ident: str = "doc_id", text: str = "text", parity: bool = False) -> DataFrame:
    """Code, name and seats of index tables. ``parity`` keeps the known defect that no name is ever found."""
    c = F.col("cells")
    code = F.get(F.filter(c, lambda x: x.rlike("^[0-9A-Za-z]{8,}$")), 0)
    seats = F.get(F.filter(c, lambda x: x.rlike(r"^\d+$") & F.coalesce(x.try_cast("int").between(1, 5000), F.lit(False))), 0).try_cast("int")
    name = F.lit(None).cast("string") if parity else F.get(F.filter(c, lambda x: x.rlike("[\\u0E00-\\u0E7F]") & (F.length(x) > 3)), 0)
    d = table_rows(df, ident, text).select(ident, "line_no", code.alias("tcas_code"), name.alias("_name"), seats.alias("seats"))
    d = d.where("tcas_code is not null and (_name is not null or seats is not null)")
    return d.select(ident, "line_no", "tcas_code", F.coalesce("_name", F.lit("")).alias("program_name_th"), "seats")


def parse_list(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    d = exploded(df, ident, text).withColumn("_sq", squeeze_between(F.col("line"))).where(F.col("_sq").rlike(ITEM))
    return d.select(ident, "line_no", F.regexp_extract("_sq", ITEM, 1).alias("item_no"), F.substring(F.trim(F.btrim("line", F.lit("| "))), 1, 300).alias("text"))


def parse_matrix(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Programs of the wide matrix, components as an array. A missing 27th cell is null seats."""
    at = lambda k: F.get("cells", F.lit(MATRIX[k]))
    d = table_rows(df, ident, text).where((F.size("cells") >= 26) & at("code").rlike(r"^\d{3}$"))
    none = F.lit(None).cast("string")
    comp = lambda cat, code, name, w: F.struct(F.lit(cat).alias("category"), code.alias("code"), name.alias("name"), w.alias("weight"))
    lots = []
    for cat, k in (("GPAX", "gpax_w"), ("TGAT", "tgat_w"), ("TGAT1", "tgat1_w"), ("TGAT2", "tgat2_w")):
        lots.append(F.when(dash_num(at(k)).isNotNull(), comp(cat, none, none, dash_num(at(k)))))
    subj = at("tpat_subj")
    lots.append(F.when(((subj != "") & (subj != "-")) | dash_num(at("tpat_w")).isNotNull(), comp("TPAT", F.nullif(subj, F.lit("-")), none, dash_num(at("tpat_w")))))
    for k in ("alevel1", "alevel2", "alevel3", "alevel4"):
        code, name = code_name(at(k))
        w = dash_num(at(k + "_w"))
        lots.append(F.when((F.coalesce(code, F.lit("")) != "") | (F.coalesce(name, F.lit("")) != "") | w.isNotNull(), comp("A-Level", code, name, w)))
    seats = F.when(at("seats").rlike(r"^\d+$"), at("seats").try_cast("int"))
    return d.select(ident, "line_no", at("code").alias("program_code"), at("name").alias("faculty_major_th"), dash_num(at("min_gpax")).alias("min_gpax"), F.array_compact(F.array(*lots)).alias("weighted_components"), dash_num(at("min_total")).alias("min_total_score"), seats.alias("seats"))


def best_of(counts: dict[str, Column], order: tuple[str, ...] = ("criteria", "matrix", "index", "list")) -> Column:
    """The parser with most records; of equals the earlier."""
    most = F.greatest(*counts.values())
    out = F.lit(order[0])
    for k in reversed(order):
        out = F.when(counts[k] == most, k).otherwise(out)
    return out


def best_parse(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, archetype, n) by counting each parser's records."""
    lots = None
    for kind, parse in (("criteria", parse_criteria), ("matrix", parse_matrix), ("index", parse_index), ("list", parse_list)):
        n = parse(df, ident, text).groupBy(ident).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        lots = n if lots is None else lots.unionByName(n)
    wide = lots.groupBy(ident).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("criteria", "matrix", "index", "list")])
    d = df.select(ident).join(wide, ident, "left").na.fill(0, ["criteria", "matrix", "index", "list"])
    c = {k: F.col(k) for k in ("criteria", "matrix", "index", "list")}
    return d.select(ident, best_of(c).alias("archetype"), F.greatest(*c.values()).alias("n"))


def archetype(text: Column) -> Column:
    return (
        F.when(text.rlike(CODE), "criteria")
        .when(F.contains(text, F.lit("ค่าน้ำหนัก")) | text.rlike(ROW), "matrix")
        .when(squeeze_between(text).rlike(r"\d{1,3}\.\s*(การรับสมัคร|โครงการ)"), "list")
        .when(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) > 50, "index")
        .otherwise("unknown")
    )


def segments(rows: DataFrame, ident: str, order: str, marker: Column, per: int = 8) -> DataFrame:
    """Page number by a running count of markers (0 before the first), and its chunk of ``per`` pages."""
    d = rows.withColumn("page", F.sum(marker.cast("int")).over(Window.partitionBy(ident).orderBy(order)))
    rank = F.dense_rank().over(Window.partitionBy(ident).orderBy("page"))
    return d.withColumn("chunk", F.floor((rank - 1) / per).cast("int"))


def split_pages(text: Column) -> Column:
    """Blocks that each begin with a page marker; text before the first is a block if it isn't blank."""
    return F.filter(F.split(text, r"(?=<!-- page \d+ -->)"), lambda p: p.rlike(r"(?U)\S"))


def chunk_pages(text: Column, per: int) -> Column:
    pages = split_pages(text)
    n = F.ceil(F.size(pages) / per).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(pages, i * per + 1, F.lit(per)), "\n\n"))).otherwise(F.array().cast("array<string>"))


def header_of(rows: DataFrame, ident: str) -> DataFrame:
    """Per table of (ident, line_no, cells): merged header. Data begin with the first row that has digits in its second or third cell."""
    coded = F.exists(F.slice("cells", 2, 2), lambda c: c.rlike(r"^\d+$"))
    w = Window.partitionBy(ident)
    d = rows.withColumn("r", F.row_number().over(w.orderBy("line_no")) - 1).withColumn("start", F.coalesce(F.min(F.when(coded, F.col("r"))).over(w), F.lit(0)))
    d = d.withColumn("n_col", F.max(F.size("cells")).over(w)).withColumn("is_head", F.col("r") < F.greatest("start", F.lit(1)))
    heads = d.where("is_head").select(ident, "r", "n_col", F.posexplode("cells").alias("c", "v")).withColumn("v", F.trim(F.replace(F.replace("v", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("/"))))
    names = heads.where("v <> ''").groupBy(ident, "c").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"])), " / ").alias("name"))
    every = d.groupBy(ident).agg(F.max("n_col").alias("n")).select(ident, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
    full = every.join(names, [ident, "c"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("col"), "c")))
    return full.groupBy(ident).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "name"))), lambda x: x["name"]).alias("header"))


def clean_cell(c: Column) -> Column:
    return F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("/")))


def render(rows: DataFrame, ident: str) -> DataFrame:
    """Per table of (ident, line_no, cells): its text, with the merged header, a rule and the rows of data."""
    coded = F.exists(F.slice("cells", 2, 2), lambda c: c.rlike(r"^\d+$"))
    w = Window.partitionBy(ident)
    d = rows.withColumn("r", F.row_number().over(w.orderBy("line_no")) - 1).withColumn("start", F.greatest(F.coalesce(F.min(F.when(coded, F.col("r"))).over(w), F.lit(0)), F.lit(1)))
    data = d.where("r >= start").groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("r", "cells"))).alias("data"))
    line = lambda cs: F.concat(F.lit("| "), F.array_join(cs, " | "), F.lit(" |"))
    n = F.size("header")
    body = F.transform(F.coalesce("data", F.array().cast("array<struct<r:int,cells:array<string>>>")), lambda x: line(F.transform(F.sequence(F.lit(0), n - 1), lambda k: clean_cell(F.get(x["cells"], k)))))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), n), "|"), F.lit("|"))
    return header_of(rows, ident).join(data, ident, "left").select(ident, F.array_join(F.concat(F.array(line(F.col("header")), rule), body), "\n").alias("markdown"))


def prose(df: DataFrame, parsed: DataFrame, ident: str = "doc_id", text: str = "text", least: int = 800) -> DataFrame:
    """Long texts that no parser found a record in; ``parsed`` has (ident, n)."""
    return df.where(F.length(text) >= least).join(parsed.where("n > 0").select(ident), ident, "left_anti")


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys only left, only right, common, and how many common ones agree (null as 0)."""
    x, y = a.select(F.col(key).alias("k"), F.col(value).alias("va"), F.lit(True).alias("ina")), b.select(F.col(key).alias("k"), F.col(value).alias("vb"), F.lit(True).alias("inb"))
    d = x.join(y, "k", "full_outer")
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    return d.agg(F.count_if(F.col("inb").isNull()).alias("only_left"), F.count_if(F.col("ina").isNull()).alias("only_right"), F.count_if(both).alias("common"), F.count_if(both & (F.coalesce("va", F.lit(0)) == F.coalesce("vb", F.lit(0)))).alias("agree"))
