"""Text helpers as Column expressions; only Unicode normalisation and segmentation need Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def squash(c: Column) -> Column:
    """All white space (Unicode) away, lower case: a match key."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def squeeze_between(c: Column, chars: str = "\\u0E00-\\u0E7F") -> Column:
    """White space between two characters of a class goes."""
    return F.regexp_replace(c, rf"(?<=[{chars}])(?U:\s+)(?=[{chars}])", "")


def falsy_or(*cols: Column) -> Column:
    """The first string that is neither null nor empty, else an empty one."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def num(c: Column) -> Column:
    """A double where the whole text is a plain number, else null (Java's suffixes and hex don't count)."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def dash_num(c: Column) -> Column:
    """As ``num``, with a dash or blank as null."""
    return num(F.nullif(F.trim(c), F.lit("-")))


def int_of(c: Column) -> Column:
    """Truncated integer of a number text, else null."""
    return num(c).try_cast("int")


def thai_digits(c: Column) -> Column:
    return F.translate(c, "๐๑๒๓๔๕๖๗๘๙", "0123456789")


def code_name(cell: Column) -> tuple[Column, Column]:
    """Code and name of 'code / name'; a cell without a slash is a name; dash or blank is neither."""
    t = F.trim(cell)
    none = (t == "") | (t == "-") | t.isNull()
    at = F.instr(t, "/")
    code = F.when(~none & (at > 0), F.trim(F.substring(t, F.lit(1), at - 1)))
    name = F.when(none, None).when(at > 0, F.trim(F.substring(t, at + 1, F.length(t)))).otherwise(t)
    return code, name


def cells(row: Column) -> Column:
    """Cells of a row of a table in text, outer bars away."""
    return F.transform(F.split(F.btrim(F.trim(row), F.lit("|")), r"\|"), lambda c: F.trim(c))


def lines(text: Column) -> Column:
    """Lines as Python's splitlines cuts them, but for a last empty one."""
    return F.split(F.regexp_replace(text, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])$", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def category(code: Column) -> Column:
    c = F.trim(F.coalesce(code, F.lit("")))
    between = F.coalesce(F.when(c.rlike(r"^\d+$"), c.try_cast("int")).between(61, 89), F.lit(False))
    return (
        F.when(c == "GPAX", "GPAX")
        .when(c.startswith("TGAT") | c.isin("90", "91", "92", "93"), "TGAT")
        .when(c.startswith("TPAT") | c.isin("21", "30", "40", "50"), "TPAT")
        .when(between, "A-Level")
        .otherwise("other")
    )


def feature_rank(code: Column) -> tuple[Column, Column, Column]:
    """Sort key: GPAX, TGAT*, TPAT*, digits by number, the rest by text."""
    digits = code.rlike(r"^\d+$")
    rank = F.when(code == "GPAX", 0).when(code.startswith("TGAT"), 1).when(code.startswith("TPAT"), 2).when(digits, 3).otherwise(4)
    return rank, F.coalesce(F.when(digits, code.try_cast("long")), F.lit(0)), code


def label_text(category_: Column, code: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", code, name)), F.lit("")), F.nullif(category_, F.lit("")), F.lit("other"))


def code_order(code: Column) -> tuple[Column, Column, Column]:
    """Sort key: codes that aren't numbers by text, then numbers by value."""
    digits = code.rlike(r"^\d+$")
    return digits, F.coalesce(F.when(digits, code.try_cast("long")), F.lit(0)), code


#: Rounds by the name of the catalog's field, which files are named after.
ROUND_OF_FIELD = {"file_path_1": "R1", "file_path_2": "R2", "file_path_3": "R3", "file_path_4": "R4", "file_path_handicap": "handicap"}


def round_of_file(name: Column) -> Column:
    """The round of a file that is named ``<field>__<anything>``, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUND_OF_FIELD.items() for x in kv]), F.regexp_extract(name, r"^(file_path_\w+?)__", 1))


def tidy_lines(text: Column) -> Column:
    """Line ends without blanks, one empty line at most between lines, none around the text."""
    ends = F.regexp_replace(text, r"(?U)[^\S\n]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(ends, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


def title(c: Column) -> Column:
    """Each run of letters with a capital first."""
    return F.array_join(F.transform(F.split(c, r"(?<=\P{L})(?=\p{L})|(?<=\p{L})(?=\P{L})"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def general(x: Column) -> Column:
    """A number as C's %g writes it: six digits that count, no zeros at the end.

    Of two that are equally near, the even one for binary fractions, else the larger.
    """
    full = F.regexp_replace(F.format_string("%.16e", F.abs(x)), r"\.", "")
    tie = (F.substring(full, 7, 11) == "50000000000") & F.substring(full, 6, 1).isin("0", "2", "4", "6", "8") & (x * 1024 == F.floor(x * 1024))
    said = F.regexp_replace(F.format_string("%.5e", F.abs(x)), r"\.", "")
    said = F.when(tie, F.concat(F.substring(full, 1, 6), F.substring(full, 18, 9))).otherwise(said)
    digits = F.rtrim(F.substring(said, 1, 6), F.lit("0"))
    power = F.substring(said, 8, 9).cast("int")
    dot = lambda a, b: F.concat(a, F.when(b != "", F.concat(F.lit("."), b)).otherwise(F.lit("")))
    rest = lambda n: F.substring(digits, n + 1, F.lit(9))
    plain = F.when(power >= 0, dot(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, "0"), rest(power + 1))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    wide = F.concat(dot(F.substring(digits, 1, 1), rest(F.lit(1))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), "0"))
    size = F.when(x == 0, F.lit("0")).when(power.between(-4, 5), plain).otherwise(wide)
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), size))


#: Powers of ten that doubles hold exactly.
TENS = [float(10**k) for k in range(23)]


def generals(df: DataFrame, col: str, name: str) -> DataFrame:
    """The input with ``general`` of a column, by arithmetic and step by step, so that nothing is made twice.

    Six digits are a rounded product with a power of ten; its error is far below the distance from a half that is asked for. Halves of whole
    numbers are exact and go to the even one. What is nearer to a half, or very large or small, is written by ``general``.
    """
    x, tens = F.col(col), F.array(*[F.lit(t) for t in TENS])
    size = F.abs(x)
    d = df.withColumn("_p", F.when(size.between(1e-16, 1e26), F.floor(F.log10(size)).cast("int")))
    d = d.withColumn("_y", F.when(F.col("_p") <= 5, size * F.get(tens, 5 - F.col("_p"))).otherwise(size / F.get(tens, F.col("_p") - 5)))
    clear = F.abs(F.col("_y") - F.floor("_y") - 0.5) > 1e-6
    d = d.withColumn("_m", F.when((size == F.floor(size)) & (size < float(1 << 53)), F.rint("_y")).when(clear, F.floor(F.col("_y") + 0.5)).cast("long"))
    over = F.col("_m") >= 1_000_000  # rounded up to the next power, or a logarithm that came out short
    d = d.withColumns({"_p": F.when(over, F.col("_p") + 1).otherwise(F.col("_p")), "_d": F.rtrim(F.when(over, F.lit("100000")).otherwise(F.col("_m").cast("string")), F.lit("0"))})
    p, digits, n = F.col("_p"), F.col("_d"), F.length("_d")
    dot = lambda at: F.when(n > at, F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, F.lit(6)))).otherwise(F.rpad(digits, at, F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), digits)
    wide = F.concat(dot(F.lit(1)), F.when(p < 0, "e-").otherwise("e+"), F.lpad(F.abs(p).cast("string"), 2, "0"))
    said = F.when(p.between(0, 5), dot(p + 1)).when(p.between(-4, -1), small).otherwise(wide)
    # a lambda, so that the long expression isn't part of the generated code
    rest = F.get(F.transform(F.array(x), general), 0)
    out = F.when(x == 0, F.lit("0")).when(digits.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), said)).otherwise(rest)
    return d.withColumn(name, out).drop("_p", "_y", "_m", "_d")


def is_noise(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$") | ~token.rlike(r"[\p{L}\p{N}]")


def safe_name(c: Column) -> Column:
    """File name: slashes, quotes and blanks to underscores, 'x' for nothing."""
    return F.coalesce(F.nullif(F.translate(c, '/\\" ', "____"), F.lit("")), F.lit("x"))


def encode_path(url: Column) -> Column:
    """Percent-encode the segments of a url's path; scheme and host stay, the query goes."""
    base = F.regexp_replace(url, r"\?.*$", "")
    head = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", 0)
    tail = F.substring(base, F.length(head) + 1, F.length(base))
    return F.concat(head, F.replace(F.array_join(F.transform(F.split(tail, "/"), lambda s: F.url_encode(s)), "/"), F.lit("+"), F.lit("%20")))


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, white space collapsed; ASCII texts pass."""
    import re
    import unicodedata

    def one(x: str | None) -> str | None:
        return None if x is None else re.sub(r"\s+", " ", x if x.isascii() else unicodedata.normalize("NFKC", x)).strip()

    for s in batches:
        yield s.map(one, na_action="ignore")
