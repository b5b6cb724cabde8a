"""Typed search: signals of free texts as a plan over a table of them, and lexicon matches.

Python runs only for Unicode normalisation and, once a distinct token, for the similarity with the lexicons' few keys.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import lexicon as L
from ..functions.similarity import extract_one
from ..functions.text import is_noise, nfkc, squash, thai_digits
from .segment import JOINED, segment
from .tables import checkpointed

FUZZY = 85
SIGNALS = "university string, subjects array<string>, seats_min int, keywords array<string>, round string, gpax double, intl boolean, faculty string, major string, format string, format_kw string, intent string, phrase string, phrase_active boolean"
#: What a number of seats and a grade stand after.
SEATS = r"(?:more than|over|มากกว่า|>)\s*(\d+)"
GPAX = r"(?i)(?:GPAX|เกรด)\s*[: ]?\s*(\d+\.?\d*)"


def _nfkc(table: dict) -> dict:
    """Keys normalised as texts are, so that composed vowels match; the first of equal keys stays."""
    out: dict = {}
    for k, v in table.items():
        out.setdefault(unicodedata.normalize("NFKC", k), v)
    return out


UNI, SUBJ, ROUND, FACULTY, MAJOR, FORMAT, INTENT, ABBREV = (_nfkc(t) for t in (L.UNI, L.SUBJ, L.ROUND, L.FACULTY, L.MAJOR, L.FORMAT, L.INTENT, L.ABBREV))
STOP = {unicodedata.normalize("NFKC", w) for w in L.STOP}


#: Rows of a lexicon that texts are compared with one by one.
MOST_WORDS = 10_000


def _few(lexicon: DataFrame) -> DataFrame:
    """A lexicon for all tasks. It is counted first: beyond its bound, nothing is cut, the query stops."""
    n = lexicon.count()
    if n > MOST_WORDS:
        raise ValueError(f"a lexicon of {n} rows; {MOST_WORDS} are the most")
    return F.broadcast(lexicon)


# --- as plans ------------------------------------------------------------------------------------------


def first_hit(text: Column, table: dict[str, str]) -> Column:
    """Label of the first keyword, in declaration order, that a text contains; a chain of tests, no join."""
    out = F.lit(None).cast("string")
    for kw, label in reversed(table.items()):
        out = F.when(F.contains(text, F.lit(kw)), label).otherwise(out)
    return out


#: Keywords up to which a chain of tests, which ends with the first hit, is written out.
CHAIN = 200


def lexicon_match(texts: DataFrame, ident: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(ident, label, ord) of each text that contains a keyword of the lexicon (ord, kw, label): its first hit wins.

    The lexicon is counted: up to ``MOST_WORDS`` rows it comes into the plan, so texts are read once and neither joined nor shuffled; a larger
    one meets them by grams, with the same result.
    """
    if lexicon.count() > MOST_WORDS:
        return match_by_grams(texts, ident, text, lexicon)
    rows = [(F.lit(r["kw"]), F.struct(F.lit(r["label"]).alias("label"), F.lit(r["ord"]).alias("ord"))) for r in lexicon.where("kw is not null").orderBy("ord").collect()]

    def hit(t: Column) -> Column:
        if not rows:
            return F.lit(None).cast("struct<label:string,ord:int>")
        if len(rows) > CHAIN:
            table = F.array(*[F.struct(kw.alias("kw"), what.alias("what")) for kw, what in rows])
            return F.get(F.filter(table, lambda x: F.contains(t, x["kw"])), 0)["what"]
        out = F
        for kw, what in rows:
            out = out.when(F.contains(t, kw), what)
        return out

    # the text, and the hit, are an array's one element, so each is made once
    once = F.filter(F.transform(F.array(F.col(text)), hit), lambda h: h.isNotNull())
    return texts.select(ident, F.explode(once).alias("_h")).select(ident, "_h.label", "_h.ord")


def match_by_grams(texts: DataFrame, ident: str, text: str, lexicon: DataFrame, width: int = 4) -> DataFrame:
    """As ``lexicon_match``, for a lexicon of any size: a text that contains a keyword contains its grams, so they are joined by one.

    A keyword's gram is the one of its ``width`` characters that the fewest keywords have, or a shorter keyword itself. Only texts and
    keywords that share it are compared. The hit of the least ``ord`` wins, of equal ones the first label.
    """
    lex = lexicon.where("kw is not null").select(F.struct("ord", "label", "kw").alias("hit"), F.col("kw").alias("_kw"), F.length("kw").alias("_n"))
    grams = lambda c, n, w: F.when(n >= w, F.array_distinct(F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substring(c, i, F.lit(w))))).otherwise(F.array().cast("array<string>"))
    long = lex.where(F.col("_n") >= width).select("hit", F.explode(grams(F.col("_kw"), F.col("_n"), width)).alias("g"))
    rare = long.join(long.groupBy("g").agg(F.count(F.lit(1)).alias("f")), "g").groupBy("hit").agg(F.min(F.struct("f", "g"))["g"].alias("g"))
    keys = checkpointed(rare.select("hit", "g").unionByName(lex.where((F.col("_n") < width) & (F.col("_n") > 0)).select("hit", F.col("_kw").alias("g"))))
    sizes = [r[0] for r in keys.select(F.length("g")).distinct().collect()]  # up to ``width``
    # texts are told apart by a number, as idents may repeat
    t = checkpointed(texts.select(F.col(ident).alias("id"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row")).where("t is not null"))
    none = F.array().cast("array<string>")
    said = t.select("row", F.explode(F.concat(none, *[grams(F.col("t"), F.length("t"), w) for w in sizes])).alias("g"))
    met = said.join(keys, "g").groupBy("row").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    empty = lex.where("_n = 0").agg(F.min("hit")).first()[0]  # an empty keyword is in every text
    always = F.lit(None).cast("struct<ord:int,label:string,kw:string>") if empty is None else F.struct(F.lit(empty["ord"]).cast("int").alias("ord"), F.lit(empty["label"]).cast("string").alias("label"), F.lit("").alias("kw"))
    first = F.get(F.filter("hits", lambda h: F.contains(F.col("t"), h["kw"])), 0)
    hit = F.least(F.struct(first["ord"].cast("int").alias("ord"), first["label"].alias("label"), first["kw"].alias("kw")), always) if empty is not None else first
    hit = F.when(first.isNull(), always).otherwise(hit) if empty is not None else hit
    out = t.join(met, "row", "left").select("id", F.explode(F.filter(F.array(hit), lambda h: h.isNotNull())).alias("h"))
    return out.select(F.col("id").alias(ident), "h.label", "h.ord")


def match_tokens(tokens: DataFrame, lexicon: DataFrame, most: int = 1) -> DataFrame:
    """(token, label) of distinct tokens: exact, else least edit distance up to ``most`` for 4 characters or more, first key of equals."""
    d = F.levenshtein("token", "kw")
    near = tokens.select("token").distinct().join(_few(lexicon), (F.col("token") == F.col("kw")) | ((F.length("token") >= 4) & (F.abs(F.length("token") - F.length("kw")) <= most) & (d <= most)))
    return near.groupBy("token").agg(F.min_by("label", F.struct(d, F.col("ord"))).alias("label"))


def remove_all(text: Column, words: list[str]) -> Column:
    """Literals replaced by a blank, in order."""
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(" "))
    return text


def own_words() -> list[str]:
    """The search's own terms, which a general word list is added to."""
    tables = (L.UNI, L.SUBJ, L.FACULTY, L.MAJOR, L.FORMAT, L.INTENT, L.ROUND, L.ABBREV)
    own = {*L.CORE, *L.STOP, *L.ABBREV.values(), *(k for t in tables for k in t)}
    own |= {m for t in (L.FACULTY, L.MAJOR) for _, terms in t.values() for m in terms.split()}
    return sorted({unicodedata.normalize("NFKC", w) for w in own})


def fuzzy(token: str, table: dict[str, str], least: float = FUZZY) -> str | None:
    """Exact, else the most similar key of at least ``least``, for tokens of 4 characters or more."""
    if token in table:
        return table[token]
    best = extract_one(token, list(table)) if len(token) >= 4 else None
    return table[best[0]] if best and best[1] >= least else None


@F.pandas_udf(StructType([StructField("uni", StringType()), StructField("subj", StringType())]))
def token_labels(tokens: pd.Series) -> pd.DataFrame:
    """Institution and subject of each token, as it stands or in lower case."""
    both = [[fuzzy(t, table) or fuzzy(t.lower(), table) for table in (UNI, SUBJ)] for t in tokens]
    return pd.DataFrame(both, columns=["uni", "subj"], dtype=object)


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Lexicons go into the plan as one SQL text each: a Column a key takes the driver longer to build than to run.


def _strings(xs) -> Column:
    return F.expr(f"cast(array({', '.join(map(_text, xs))}) as array<string>)")


def _rows(table: dict[str, str]) -> Column:
    """A lexicon as an array of its keys in lower case and their values."""
    return F.expr(f"array({', '.join(f'struct({_text(k.lower())} as k, {_text(v)} as v)' for k, v in table.items())})")


def _scan(col: str, table: dict[str, str]) -> Column:
    """As ``first_hit``."""
    return F.expr(f"case {' '.join(f'when contains({col}, {_text(k)}) then {_text(v)}' for k, v in table.items())} end")


def _removed(col: str, words: list[str]) -> Column:
    """As ``remove_all``."""
    for w in words:
        col = f"replace({col}, {_text(w)}, ' ')"
    return F.expr(col)


def signals_of(df: DataFrame, text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """The input with ``signals``, a struct of filters, keywords and the phrase that is left; texts are parsed once each.

    ``words`` (word) is a general word list for the segmentation. A null text has the signals of an empty one.
    """
    spark = df.sparkSession
    d = spark.createDataFrame([(w,) for w in own_words()], "word string")
    d = d if words is None else d.unionByName(words.select("word"))
    t = df.select(F.col(text).alias("raw")).distinct().withColumn("whole", F.coalesce(nfkc("raw"), F.lit("")))
    rest = _removed("whole", [k for table in (UNI, ROUND, INTENT, FACULTY, MAJOR, FORMAT) for k in table])  # what is removed makes and breaks later hits
    # a column that says which text, as a null one is a text too
    t = t.withColumns({"rest": F.regexp_replace(rest, r"\p{Nd}+\.?\p{Nd}*|[><=]", " "), "key": F.coalesce(F.concat(F.lit("t"), "raw"), F.lit("n"))})
    t = checkpointed(t)
    toks, left = segment(t, "key", "whole", d), segment(t, "key", "rest", d).withColumnRenamed("tokens", "left")
    toks = checkpointed(toks)
    each = toks.select("key", F.posexplode("tokens").alias("at", "token"))
    # both tables are written: a filter on labels would go below the distinct and to the join's other side, and label every token of every text
    once = checkpointed(each.select("token").distinct().repartition(spark.sparkContext.defaultParallelism, "token"))
    labels = checkpointed(once.select("token", token_labels("token").alias("l"))).select("token", "l.*").where("uni is not null or subj is not null")
    said = each.join(labels, "token").groupBy("key").agg(F.min_by("uni", F.when(F.col("uni").isNotNull(), F.col("at"))).alias("near"), F.array_sort(F.collect_set("subj")).alias("subjects"))
    t = checkpointed(t.join(toks, "key").join(left, "key").join(said, "key", "left").withColumn("low", F.lower("whole")))
    first = {name: {k: v[0] for k, v in table.items()} for name, table in (("faculty", FACULTY), ("major", MAJOR), ("format", FORMAT))}
    group = lambda rx: F.nullif(thai_digits(F.regexp_extract("whole", rx, 1)), F.lit(""))
    t = t.withColumns({
        "university": F.coalesce(_scan("low", UNI), "near"),
        "subjects": F.coalesce("subjects", _strings([])),
        "seats_min": group("(?U)" + SEATS).try_cast("int"),
        "round": _scan("low", ROUND),
        "gpax": group(GPAX.replace("(?i)", "(?iU)")).try_cast("double"),
        "intl": F.contains("low", F.lit("นานาชาติ")) | F.contains("low", F.lit("international")),
        **{name: _scan("low", table) for name, table in first.items()},
        "format_kw": F.nullif(_scan("low", {k: v[1] or "" for k, v in FORMAT.items()}), F.lit("")),
        "intent": _scan("low", INTENT),
    })
    stop = _strings(sorted(STOP))
    kept = lambda x: ~F.array_contains(stop, F.lower(x)) & ~is_noise(x)
    keys = lambda rows, hit: F.transform(F.filter(rows, lambda r: F.coalesce(hit(r["v"]), F.lit(False))), lambda r: r["k"])
    used = [keys(_rows(table), lambda v: (v == F.col("university")) | F.array_contains("subjects", v)) for table in (UNI, SUBJ)]
    used += [keys(_rows(first[name]), lambda v, name=name: v == F.col(name)) for name in ("faculty", "major")]

    def terms(name: str, table: dict) -> Column:
        """Match terms of the first row with the label."""
        of: dict[str, str] = {}
        for label, match in table.values():
            of.setdefault(label, match)
        out = _strings([])
        for label, match in of.items():
            out = F.when(F.col(name) == label, _strings(match.split())).otherwise(out)
        return out

    t = t.withColumns({"used": F.concat(*used), "terms": F.array_distinct(F.concat(terms("faculty", FACULTY), terms("major", MAJOR)))})
    t = t.withColumn("keywords", F.filter("tokens", lambda x: kept(x) & ~F.array_contains("used", F.lower(x))))
    t = t.withColumn("keywords", F.concat("keywords", F.filter("terms", lambda m: ~F.array_contains("keywords", m) & ~F.array_contains(stop, F.lower(m)))))
    abbrev = F.create_map(*[F.lit(x) for kv in ABBREV.items() for x in kv])
    t = t.withColumn("left", F.filter("left", lambda x: kept(x)))
    t = t.withColumn("phrase", squash(F.array_join(F.transform("left", lambda x: F.coalesce(F.try_element_at(abbrev, x), x)), "")))
    t = t.withColumn("phrase_active", (F.size("left") >= 2) & (F.length("phrase") > 3) & F.col("phrase").rlike(f"[{JOINED}]"))
    names = [f.split()[0] for f in SIGNALS.split(", ")]
    out = t.select(F.col("raw").alias("_t"), F.struct(*names, F.col("raw")).alias("signals"))
    return df.join(out, F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")


def signals_of_text(spark: SparkSession, text: str | None) -> dict:
    """The signals of one text, on the driver."""
    return signals_of(spark.createDataFrame([(text,)], "text string")).first()["signals"].asDict(recursive=True)
