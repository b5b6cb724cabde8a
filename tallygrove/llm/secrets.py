"""Secret scans with SQL functions only: three patterns, and sliding-window entropy over candidate strings.

Every whole text is searched for assignments, access keys and long hexadecimal strings. Then candidate
strings (runs of 20 or more key characters that aren't plain words) are read character by character: a window
of 20 moves along, the counts of its characters change by one in and one out, and the sum of
``count * log2(count)`` with them, which gives the window's Shannon entropy. Each class of characters has
its own alphabet and threshold, and every candidate is of one class. What overlaps a pattern's span adds no span, nor does
what is within 64 characters of an allow-listed string; the rest of a long candidate is read all the same.

Offsets are code points, ends exclusive. Edge cases: a null or empty text has no spans; rows that
repeat are scanned each; other columns are ignored; very long texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the query's contract: kind, pattern, group that is measured, least length.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # a maximal run, so shorter runs need not be matched to be dropped
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Class, what its candidates look like, alphabet, bits a character from which a window counts. The first that fits is used.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 2.9),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.4),
    ("lower", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 3.4),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.8),
    # with one case and symbols; 99 in 100 windows of random characters have 3.48 bits or more
    ("lower_marks", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9+/_=-]+$", "0123456789abcdefghijklmnopqrstuvwxyz+/_=-", 3.45),
    ("upper_marks", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9+/_=-]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.45),
)
ALLOW = r"(?i:example|sample|dummy|placeholder|changeme|your_?key|xxxx|0000000|12345678|abcdefgh|(.)\1{5})"

#: Characters on either side of an allow-listed string that add no span either.
REACH = 64
#: Elements that are summed in one go; characters of a block of spans.
BLOCK, NEAR = 256, 2048

SPAN = "array<struct<s:int,k:int,e:int,kind:string,body:string>>"


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def sums_before(sizes: Column) -> Column:
    """For each of an array's ints, the sum of those before it; in blocks, as an array that grows is copied each time."""

    def run(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def all_of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / F.lit(BLOCK)).cast("int") - 1, F.lit(0))), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
        ahead = lambda bs: run(F.transform(bs, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)))
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, ahead(bs), lambda x, o: F.transform(run(x), lambda v: v + o))))

    return bound(sizes, all_of)


def spans(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches; offsets are the lengths of what lies between them, summed."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.zip_with(F.arrays_zip(whole.alias("hit"), body.alias("body")), F.split(text, pattern, -1), lambda m, g: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m["hit"]), F.lit(0)).alias("n"), m["body"].alias("body")))

    def placed(rs: Column) -> Column:
        at = sums_before(F.transform(rs, lambda r: r["gap"] + r["n"]))
        one = lambda r, x: F.struct((x + r["gap"]).alias("s"), F.lit(rank).alias("k"), (x + r["gap"] + r["n"]).alias("e"), F.lit(kind).alias("kind"), r["body"].alias("body"))
        return F.filter(F.zip_with(rs, at, one), lambda x: F.length(x["body"]) >= least)

    return F.when(text.rlike(pattern), bound(rows, placed).cast(SPAN)).otherwise(F.array().cast(SPAN))


def _cln(c: Column) -> Column:
    """count * log2(count), 0 for 0."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_range(body: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """Start of the first and end of the last window whose entropy is at least ``bits``; null if none is.

    The state is one count a letter of the alphabet and the sum of count * log2(count).
    """
    state = "struct<i:int,n:array<int>,sum:double,lo:int,hi:int>"
    codes = F.transform(F.split(body, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    zero = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi")).cast(state)
    most = math.log2(window)

    def step(acc: Column, p: Column) -> Column:
        n_in, n_out = F.coalesce(F.get(acc["n"], p["add"]), F.lit(0)), F.coalesce(F.get(acc["n"], p["out"]), F.lit(0))
        same = p["add"] == p["out"]
        new = F.when(same, acc["sum"]).otherwise(acc["sum"] + _cln(n_in + 1) - _cln(n_in) + F.when(p["out"] >= 0, _cln(n_out - 1) - _cln(n_out)).otherwise(F.lit(0.0)))
        counts = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda v, j: F.when(j == p["add"], v + 1).when(j == p["out"], v - 1).otherwise(v)))
        hot = (acc["i"] >= window - 1) & (F.lit(most) - new / window >= F.lit(bits - 1e-9))
        lo = F.when(hot & (acc["lo"] < 0), acc["i"] - window + 1).otherwise(acc["lo"])
        return F.struct((acc["i"] + 1).alias("i"), counts.alias("n"), new.alias("sum"), lo.alias("lo"), F.when(hot, acc["i"] + 1).otherwise(acc["hi"]).alias("hi"))

    def scanned(cs: Column) -> Column:
        # each character with that which leaves the window for it
        left = F.slice(F.concat(F.array_repeat(F.lit(-1), window), cs), F.lit(1), F.size(cs))
        pairs = F.zip_with(cs, left, lambda x, y: F.struct(x.alias("add"), y.alias("out")))
        return F.aggregate(pairs, zero, step, lambda acc: F.when(acc["lo"] >= 0, F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))))

    return bound(codes, scanned)


def pieces(c: Column) -> Column:
    """(s, body) of what of a candidate is beyond the reach of allow-listed strings."""
    kind = "array<struct<s:int,body:string>>"
    whole = F.array(F.struct(c["s"].alias("s"), c["body"].alias("body"))).cast(kind)
    # what lies between two hits, less the reach of each; a pattern of one hit only, as one of many in a row would recurse
    rows = F.zip_with(F.split(c["body"], ALLOW, -1), F.regexp_extract_all(c["body"], F.lit(ALLOW), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), F.length(g).alias("n"), F.length(m).alias("hit")))

    def beyond(r: Column, x: Column, i: Column) -> Column:
        left = F.when(i > 0, REACH).otherwise(0)
        right = F.when(r["hit"].isNotNull(), REACH).otherwise(0)
        return F.struct((c["s"] + x + left).alias("s"), F.substring(r["gap"], left + 1, F.greatest(F.lit(0), r["n"] - left - right)).alias("body"))

    def placed(rs: Column) -> Column:
        at = sums_before(F.transform(rs, lambda r: r["n"] + F.coalesce(r["hit"], F.lit(0))))
        return F.transform(F.zip_with(rs, at, lambda r, x: F.struct(r.alias("r"), x.alias("x"))), lambda p, i: beyond(p["r"], p["x"], i))

    return F.when(c["body"].rlike(ALLOW), bound(rows, placed).cast(kind)).otherwise(whole)


def entropy_spans(text: Column, base: Column, rank: int) -> Column:
    """Spans of the entropy method that overlap none of ``base``."""
    cands = F.filter(spans(text, CANDIDATE, 0, WINDOW, "entropy", rank), lambda c: c["body"].rlike("[0-9]") & c["body"].rlike("[A-Za-z]"))
    parts = F.filter(F.flatten(F.transform(cands, pieces)), lambda c: F.length(c["body"]) >= WINDOW)

    def narrowed(c: Column) -> Column:
        hot = F.lit(None).cast("struct<lo:int,hi:int>")
        for _, looks, alphabet, bits in reversed(CLASSES):
            hot = F.when(c["body"].rlike(looks), hot_range(c["body"], alphabet, bits)).otherwise(hot)
        return F.struct(c["s"].alias("s"), hot.alias("hot"))

    found = F.filter(F.transform(parts, narrowed), lambda c: c["hot"].isNotNull())
    found = F.transform(found, lambda c: F.struct((c["s"] + c["hot"]["lo"]).alias("s"), F.lit(rank).alias("k"), (c["s"] + c["hot"]["hi"]).alias("e"), F.lit("entropy").alias("kind"), F.lit("").alias("body")))
    # the base spans in blocks of characters, so that each span meets those near it only
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / F.lit(NEAR)).cast("int")), lambda k: F.filter(base, lambda b: (b["s"] < (k + 1) * NEAR) & (b["e"] > k * NEAR)))
    first = lambda c: F.floor(c["s"] / F.lit(NEAR)).cast("int")
    last = lambda c: F.floor((c["e"] - 1) / F.lit(NEAR)).cast("int")
    near = lambda c, bs: F.flatten(F.slice(bs, first(c) + 1, last(c) - first(c) + 1))
    free = lambda xs: bound(blocks, lambda bs: F.filter(xs, lambda c: ~F.exists(near(c, bs), lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"]))))
    return bound(found, lambda xs: F.when((F.size(base) > 0) & (F.size(xs) > 0), free(xs)).otherwise(xs))


def told(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def scan(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ident, n_assign, n_access, n_hex, base_sha256, n_entropy, spans."""
    d = df.select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumns({f"_{kind}": spans(F.col("t"), rx, group, least, kind, k) for k, (kind, rx, group, least) in enumerate(PATTERNS)})
    d = d.withColumn("_base", F.concat(*[F.col(f"_{p[0]}") for p in PATTERNS]))
    looks = F.col("t").rlike(CANDIDATE)
    d = d.withColumn("_more", F.when(looks, entropy_spans(F.col("t"), F.col("_base"), len(PATTERNS))).otherwise(F.array().cast(SPAN)))
    return d.select(
        F.col("id").alias(ident),
        *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind, *_ in PATTERNS],
        F.sha2(told(F.col("_base")), 256).alias("base_sha256"),
        F.size("_more").cast("long").alias("n_entropy"),
        told(F.concat("_base", "_more")).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
