"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

First, of every window of every document only hashes are made and looked up among the benchmark's; then, for the few
documents with any, the windows whole. Texts are cut into words and numbers. Numbers, units after a number, and capitalised words within a sentence
become typed placeholders; other words are lower-cased, and punctuation falls away. Every window of 8 such
tokens of every document is hash-joined with those of the benchmark, in a second form too: with its numbers as the only
placeholders. As what stands before a word makes it a name or a unit, only that form is the same in every context. Of an
item, the words that begin a sentence are also taken as names, and so is that of a document where it begins a window. Matches on one diagonal (document place minus
item place) are an occurrence. A window counts if it has no slots or they hold the item's own values, and otherwise
if each holds the value that most places of its slot have on the diagonal; where a slot has no such value, only
the former count. A document holds an item if the windows that count are all the item's, or at least 6
(13 tokens on end), so re-parameterised questions are caught and chance templates aren't.

Windows whose numbers are more than half of their tokens are hashed with the values behind them, so they match only
where these are the item's own; those with more than half placeholders, names and units included, have the second form only. So that they don't raise the bar for re-parameterised questions, the windows of fewer
placeholders also suffice if they are all of the item's, or 6. Edge cases: a null or empty text has
no window; an item of 4 to 7 tokens is one window of its own length, a shorter one is found where a text has its tokens and no more; equal
items are each found, and items without an id are one item; rows that repeat a document id count together; a null id is a document like
any other; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns, rows_apart, save, without

WINDOW, SHORTEST, ENOUGH = 8, 4, 6
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "inch", "inches", "ft", "feet", "yards", "miles", "lb", "lbs", "oz", "pounds", "kmh", "mph", "dollars", "cents", "euros", "percent", "degrees", "watts", "kw", "volts", "hz", "meters", "metres", "liters", "litres", "grams")
NUM, UNIT, NAME = "\u0001#", "\u0001U", "\u0001N"
#: Between a slot's value and its place.
PLACE = "\u0002"
NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"  # possessive: a group that could be given back is matched by recursion
TOKEN = rf"\x01?\x03?(?:{NUMBER}|[\p{{L}}\p{{M}}]+)"
#: A unit, with the number before it as the digit 0.
UNIT_AFTER = rf"(0[^\p{{L}}\p{{M}}0-9]*+)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])"
#: Matches where so many tokens follow that there is a window; tried only where a run of tokens begins.
SHORTEST_OR_MORE = r"(?<![\p{L}\p{M}0-9])(?<![0-9][.,])(?:(?:[0-9]++(?:[.,][0-9]++)*+|[\p{L}\p{M}]++)[^\p{L}\p{M}0-9]*+){%d}" % SHORTEST
#: Before a capitalised word that no sentence begins with.
WITHIN = r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll},;:] )"  # what few places have comes first
#: Before any capitalised word: what an item's sentences begin with may stand within a document's.
ANYWHERE = r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}])"
#: Stands before a capitalised word that begins a sentence, and where it goes, as texts are or once other names are marked.
OPENING = "\u0003"
FIRST = r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}])(?<![\p{Ll},;:] )"
LEFT = r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}\x01])"
MARKS = "\u0001" + OPENING


def _canon(toks: Column) -> Column:
    def one(t: Column, i: Column) -> Column:
        low = F.lower(F.translate(t, MARKS, ""))
        first = F.substring(t, 1, 1)
        before = F.substring(F.get(toks, i - 1), 1, 1)
        unit = F.coalesce(low.isin(*UNITS) & before.between("0", "9"), F.lit(False))
        return F.when(first.between("0", "9"), NUM).when((first == "\u0001") & ~(unit & t.startswith(MARKS)), NAME).when(unit, UNIT).otherwise(low)

    return F.transform(toks, one)


def windows(df: DataFrame, ident: str, text: str, sizes: tuple[int, ...] = (WINDOW,), placed: bool = False, names: str = WITHIN, openings: bool = False) -> DataFrame:
    """(id, pos, h, slots, loose) of the windows of these sizes; slots: the values behind their placeholders, typed; loose: few enough of them for other values.

    With ``placed`` also places: those of the slots in the text. With ``openings`` only the windows that begin with a capitalised
    word that isn't a name by ``names``, and have no other, as if it were one.
    """
    own = F.translate(F.col(text), MARKS, PLACE * 2)  # the marks are no marks in a text
    own = F.regexp_replace(own, names, "\u0001")
    own = F.regexp_replace(own, LEFT, MARKS) if openings else own
    d = df.select(F.col(ident).alias("id"), F.regexp_extract_all(own, F.lit(TOKEN), F.lit(0)).alias("toks"))
    # no filter on their number: it would be put before the join that leaves few texts, and cut all of them
    d = d.withColumn("canon", _canon(F.col("toks")))
    marked = F.exists("canon", lambda c: c.startswith("\u0001"))

    def val(c: Column, i: Column) -> Column:
        said = F.concat(c, F.get("words", i))
        return F.when(c.startswith("\u0001"), F.concat(said, F.lit(PLACE), i.cast("string")) if placed else said)

    d = d.withColumn("words", F.transform("toks", lambda t: F.translate(F.lower(t), MARKS, "")))
    plain = F.zip_with("canon", "words", lambda c, t: F.xxhash64(F.when(c == NUM, c).otherwise(t)))
    opens = F.zip_with("toks", "canon", lambda t, c: (t.startswith(MARKS) & (c == NAME)).cast("int")) if openings else F.lit(None).cast("array<int>")
    d = d.select("id", F.transform("canon", lambda c: F.xxhash64(c)).alias("hs"), plain.alias("ps"), F.when(marked, F.transform("canon", val)).alias("vals"), opens.alias("opens"))
    none = F.array().cast("array<string>")
    lots = []
    for w in sizes:
        size = F.lit(w)

        def one(i: Column) -> Column:
            held = F.when(F.col("vals").isNotNull(), F.array_compact(F.slice(F.col("vals"), i + 1, size))).otherwise(none)  # noqa: B023
            return F.struct(i.alias("pos"), F.xxhash64(size, F.slice(F.col("hs"), i + 1, size)).alias("h"), F.xxhash64(size, F.slice(F.col("ps"), i + 1, size)).alias("p"), held.alias("slots"), F.lit(w // 2).alias("most"))  # noqa: B023

        every = F.sequence(F.lit(0), F.size("hs") - w)
        if openings:
            alone = lambda i: (F.get("opens", i) == 1) & ~F.exists(F.slice(F.col("opens"), i + 2, w - 1), lambda x: x == 1)  # noqa: B023, E731
            every = F.filter(every, alone)
        lot = F.transform(every, one)
        lots.append(F.when(F.size("hs") >= w, lot).otherwise(F.array().cast("array<struct<pos:int,h:bigint,p:bigint,slots:array<string>,most:int>>")))
    d = d.select("id", F.explode(lots[0] if len(lots) == 1 else F.concat(*lots)).alias("w"))
    d = d.select("id", "w.pos", "w.h", "w.p", "w.slots", "w.most", (F.size("w.slots") <= F.col("w.most")).alias("loose"))
    if placed:
        d = d.withColumn("places", F.transform("slots", lambda v: F.substring_index(v, PLACE, -1).cast("int"))).withColumn("slots", F.transform("slots", lambda v: F.substring_index(v, PLACE, 1)))
    d = d.withColumn("nums", F.filter("slots", lambda v: v.startswith(NUM)))
    more = ["places"] if placed else []
    own = [F.filter("places", lambda v, i: F.get("slots", i).startswith(NUM)).alias("places")] if placed else []
    one = F.struct(F.when(F.size("nums") <= F.col("most"), F.col("p")).otherwise(F.xxhash64("p", "nums")).alias("h"), F.col("nums").alias("slots"), *own)
    both = F.array(one, F.struct("h", "slots", *more))
    d = d.select("id", "pos", "loose", F.explode(F.when(F.col("loose") & (F.size("nums") < F.size("slots")), both).otherwise(F.array(one))).alias("w"))
    return d.select("id", "pos", "loose", "w.*")


def window_hashes(df: DataFrame, ident: str, text: str, sizes: tuple[int, ...] = (WINDOW,), names: str = WITHIN, openings: bool = False) -> DataFrame:
    """(id, g): hashes of the windows of these sizes, with all their placeholders and with numbers only; no places and no values.

    With ``openings`` also those of windows that begin with a capitalised word that isn't a name by ``names``, as if it were one.

    Placeholders are put into the whole text, as digits: 0 a number, 1 a name, 2 a unit. Windows that are equal as ``windows``
    makes them are equal here; the two small sigmas count as one, as a whole text's lower case depends on what follows.
    """
    low = lambda t: F.replace(F.lower(t), F.lit("ς"), F.lit("σ"))
    shown = F.regexp_replace(F.col(text), FIRST, OPENING) if openings else F.col(text)
    plain = F.regexp_replace(low(shown), NUMBER, "0")
    d = df.select(F.col(ident).alias("id"), F.col(text).alias("t"), plain.alias("plain"))
    named = F.regexp_replace(F.regexp_replace("t", NUMBER, "0"), names + r"[\p{L}\p{M}]++", "1")
    slots = F.col("t").rlike(names) | F.col("plain").rlike(UNIT_AFTER)
    d = d.select("id", "plain", F.when(slots, F.regexp_replace(low(named), UNIT_AFTER, "$12")).alias("typed"))
    toks = lambda t, mark="": F.regexp_extract_all(t, F.lit(rf"[0-2]|{mark}[\p{{L}}\p{{M}}]++"), F.lit(0))
    hashes = lambda t: F.transform(t, lambda x: F.xxhash64(x))
    if openings:
        bare = lambda x: F.when(x.startswith(OPENING), F.substring(x, 2, 1 << 30)).otherwise(x)
        d = d.select("id", toks("plain", f"{OPENING}?").alias("ts"), "typed")
        d = d.select("id", F.transform("ts", lambda x: F.xxhash64(bare(x))).alias("ps"), F.filter(F.transform("ts", lambda x, i: F.when(x.startswith(OPENING), i)), lambda i: i.isNotNull()).alias("at"), "typed")
    else:
        d = d.select("id", hashes(toks("plain")).alias("ps"), F.lit(None).cast("array<int>").alias("at"), "typed")
    d = d.select("id", "ps", "at", F.when(F.col("typed").isNotNull(), hashes(toks("typed"))).alias("hs")).withColumn("os", F.coalesce("hs", "ps"))
    none = F.array().cast("array<bigint>")

    def lot(of: str, w: int) -> Column:
        one = lambda i: F.xxhash64(F.lit(w), *[F.get(of, i + k) for k in range(w)])
        return F.when(F.size(of) >= w, F.transform(F.sequence(F.lit(0), F.size(of) - w), one)).otherwise(none)

    def opened(w: int) -> Column:
        one = lambda i: F.xxhash64(F.lit(w), F.xxhash64(F.lit("1")), *[F.get("os", i + k) for k in range(1, w)])
        return F.coalesce(F.transform(F.filter("at", lambda i: i <= F.size("os") - w), one), none)

    own = F.concat(*[lot("ps", w) for w in sizes], *[opened(w) for w in sizes if openings])
    return d.select("id", F.explode(F.when(F.col("hs").isNull(), own).otherwise(F.concat(own, *[lot("hs", w) for w in sizes]))).alias("g"))


def benchmark_items(bench: DataFrame, item: str, text: str) -> tuple[DataFrame, tuple[int, ...]]:
    """(item, text, _w: the size of its windows) and the sizes that occur."""
    sized = bench.select(F.col(item).alias("item"), F.col(text).alias("text"), F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("_n")).where(F.col("_n") >= SHORTEST)
    sized = save(sized.withColumn("_w", F.least("_n", F.lit(WINDOW))), "benchmark")
    return sized, tuple(sorted(r["_w"] for r in sized.select("_w").distinct().collect()))  # 5 values at most


def suspects(docs: DataFrame, items: DataFrame, sizes: tuple[int, ...], ident: str, text: str, most: int) -> DataFrame:
    """(ident, text) of the documents with any window of the benchmark's: who else can't hold an item.

    Of each window only a hash is made here, so what is made of a whole window is made for few documents.
    """
    lots = [window_hashes(items.where(F.col("_w") == w), "item", "text", (w,), names).select("g") for w in sizes for names in (WITHIN, ANYWHERE)]
    if not lots:
        return docs.select(ident, text).limit(0)
    known = save(functools.reduce(DataFrame.unionByName, lots).distinct(), "benchmark-hashes")
    small = known.count() <= 4 * most  # longs
    ids = save(window_hashes(docs, ident, text, sizes, openings=True).join(F.broadcast(known) if small else known, "g", "left_semi").select("id").distinct(), "suspects")
    same = docs[ident].eqNullSafe(ids["id"])
    return docs.select(ident, text).join(F.broadcast(ids) if ids.count() <= most else ids, same, "left_semi")


def benchmark_windows(items: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(item, bpos, h, bslots, places, loose, item_windows, item_loose)."""
    lots = [windows(items.where(F.col("_w") == w), "item", "text", (w,), True, names) for w in sizes for names in (WITHIN, ANYWHERE)]
    lots = functools.reduce(DataFrame.unionByName, lots) if lots else windows(items, "item", "text", placed=True)
    lots = lots.select(F.col("id").alias("item"), F.col("pos").alias("bpos"), "h", F.col("slots").alias("bslots"), "places", "loose").distinct()
    n = lots.groupBy(F.col("item").alias("_item")).agg(F.countDistinct("bpos").alias("item_windows"), F.countDistinct(F.when(F.col("loose"), F.col("bpos"))).alias("item_loose"))
    return save(lots.join(n, F.col("item").eqNullSafe(F.col("_item"))).drop("_item"), "benchmark-windows")


def find(docs: DataFrame, bench: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = 100_000) -> DataFrame:
    """Pairs: ident, item, n_windows, item_windows, exact (every slot has the item's own value)."""
    items, sizes = benchmark_items(bench, item, item_text)
    known = benchmark_windows(items, sizes)
    held = suspects(docs, items, sizes, ident, text, most)
    own = [windows(held, ident, text, sizes or (WINDOW,), openings=o).drop("loose") for o in (False, True)]
    own = own[0].unionByName(own[1])
    # the benchmark's windows go to all tasks only if they are few
    small = F.broadcast(known) if known.count() <= most else known
    hits = own.join(small, "h").where(F.size("slots") == F.size("bslots")).select("id", "item", "pos", "bpos", "slots", "bslots", "places", "loose", "item_windows", "item_loose")
    hits = save(hits.distinct(), "hits").withColumn("off", F.col("pos") - F.col("bpos")).withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in (("k", "id"), ("ik", "item"))})
    key = ["k", "ik", "off"]
    slot = hits.where(F.size("slots") > 0).select(*key, F.explode(F.arrays_zip("bslots", "slots", "places")).alias("s"))
    vote = slot.groupBy(*key, F.col("s.bslots").alias("b"), F.col("s.slots").alias("d")).agg(F.countDistinct("s.places").alias("n")).withColumn("own", F.col("d") == F.col("b"))
    most = F.max(F.struct("n", "own", "d"))
    vote = vote.groupBy(*key, "b").agg(most.alias("m"), F.sum("n").alias("all"), F.max(~F.col("own")).alias("new"))
    # the item's own value needs no more places than any other
    clear = F.col("m.own") | (2 * F.col("m.n") > F.col("all"))
    odd = vote.groupBy(*key).agg(F.max(~clear).alias("torn"), F.max("new").alias("new"), F.map_from_entries(F.collect_list(F.struct("b", "m.d"))).alias("held"))
    hits = hits.join(odd, key, "left")
    fits = F.forall(F.arrays_zip("bslots", "slots"), lambda s: F.element_at("held", s["bslots"]) == s["slots"])
    hits = hits.where((F.size("slots") == 0) | (F.col("slots") == F.col("bslots")) | (~F.col("torn") & fits))
    n_loose = F.countDistinct(F.when(F.col("loose"), F.col("bpos"))).alias("n_loose")
    told = hits.groupBy("id", "item", "item_windows", "item_loose").agg(F.countDistinct("bpos").alias("n_windows"), n_loose, (~F.coalesce(F.max("new"), F.lit(False))).alias("exact"))
    enough = (F.col("n_windows") >= F.least("item_windows", F.lit(ENOUGH))) | ((F.col("n_loose") > 0) & (F.col("n_loose") >= F.least("item_loose", F.lit(ENOUGH))))
    told = told.where(enough).select("id", "item", "n_windows", "item_windows", "exact")
    return told.unionByName(find_short(docs, bench, ident, text, item, item_text)).select(F.col("id").alias(ident), F.col("item").alias(item), "n_windows", "item_windows", "exact")


def find_short(docs: DataFrame, bench: DataFrame, ident: str, text: str, item: str, item_text: str) -> DataFrame:
    """The documents whose tokens are those of an item that is too short for a window, as rows of ``find``."""

    def whole(df: DataFrame, ident: str, text: str, name: str) -> DataFrame:
        toks = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
        d = df.where(~F.col(text).rlike(SHORTEST_OR_MORE)).select(F.col(ident).alias(name), F.array_join(toks, " ").alias("words"))
        return d.where("words <> ''")

    items = save(whole(bench, item, item_text, "item"), "short-items")
    d = whole(docs, ident, text, "id") if items.limit(1).count() else docs.select(F.col(ident).alias("id"), F.lit("").alias("words")).limit(0)
    one = F.lit(1).cast("long")
    return d.join(items, "words").groupBy("id", "item").agg(one.alias("n_windows"), one.alias("item_windows"), F.lit(True).alias("exact")).select("id", "item", "n_windows", "item_windows", "exact")


def clean(docs: DataFrame, bench: DataFrame, ident: str = "doc_id", **kw) -> DataFrame:
    """The rows whose texts hold no item; rows that repeat an id, or have none, are judged each by itself."""
    rows, row = rows_apart(docs, ident)
    return without(rows, row, find(rows, bench, row, **kw).select(row)).select(*own_columns(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
