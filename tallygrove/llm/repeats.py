"""Repeated passages by column-wise construction of a collection's suffix order.

A byte goes if a string of ``SPAN`` bytes that covers it also starts anywhere else. Suffixes need to be told apart for ``SPAN`` symbols only, and
only where they can be equal, so the collection is made of passages:

1. *Anchors.* In each window of ``SPAN`` bytes the string of ``GRAM`` bytes with the least hash is its anchor. Equal windows have the
   same anchor at the same place, so what two passages share is aligned by their anchor, and passages whose anchors differ share nothing.
   Only anchors that occur again anywhere go on.
2. *Classes.* Passages (the bytes of all windows of one anchor) that are equal are one class; two of them suffice.
3. *Columns.* The classes that share an anchor are a collection whose suffixes are built from right to left: each round inserts one
   symbol for every passage. Sorting the symbols that precede the suffixes of the round before, in the order of these (the
   collection's Burrows-Wheeler transform, column by column), gives the order of the new suffixes, and the common
   prefix of neighbours is one more than the least one between their old places, or 0. As passages are aligned, only suffixes of one column can be
   equal: so a column of the transform is read and written once, one after the other, and earlier ones aren't needed again. A
   window is repeated if its suffix has ``SPAN`` symbols in common with a neighbour.

The external files are Spark's own: tables in the shared folder and sorted shuffle files by anchor, which tasks read from front to back in bounded lots of
collections. An anchor with more than ``MOST`` classes is split by the windows' halves, whose common bytes are longer, again and again;
a single window is its own class, so that ends.

Edge cases: a null or empty text, and one of less than ``SPAN`` bytes, loses nothing; overlapping repeats count, also within a text; equal rows are copies of each other;
rows that share an id, or have none, are texts of their own; texts are read whole, long ones in overlapping blocks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, parts, rows_apart, save, text_slices, tidy, word_hashes
from .ranks import sent_if_few

SPAN, GRAM = 200, 48
#: Windows that one anchor can have.
REACH = SPAN - GRAM + 1
#: Bytes whose anchors are sought at once; classes of one collection; passages that are built together.
BLOCK, MOST, LOT = 1 << 20, 5000, 10_000
#: Longs, and intervals, that go to all tasks if counted and fewer.
FEW = 1_000_000
_PLACE = 22


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts of a run: (text, anchor's place in it, least and most bytes before the anchor, anchor's hash, passage's hash)."""
    n = len(data) - SPAN + 1
    ends, starts = offs[1:], offs[:-1]
    long = ends - starts >= SPAN
    if n <= 0 or not long.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    live = np.zeros(n + 1, np.int32)
    np.add.at(live, starts[long], 1)
    np.add.at(live, ends[long] - SPAN + 1, -1)
    first = np.flatnonzero(np.cumsum(live[:n]))
    at = np.arange(len(data) - GRAM + 1)
    grams = word_hashes(data, at, at + GRAM)
    least = grams >> np.uint64(_PLACE) << np.uint64(_PLACE) | at.astype(np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: width - REACH], least[REACH - width :])
    place = (least[first] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    a, low, high = place[new], first[new], first[np.append(new[1:], len(first)) - 1]
    text = np.searchsorted(offs, a, side="right") - 1
    near, far = a - high, a - low
    with np.errstate(over="ignore"):
        whole = mixed(word_hashes(data, low, high + SPAN) ^ mixed((near * 1024 + far + 1).astype(np.uint64)))
    return text, a - offs[text], near, far, grams[a], whole


def blocks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts, (first row, bytes before, data, offsets); a long text comes in blocks that share all but one byte of a window."""
    for a, b, data, offs in text_slices(col, BLOCK):
        if b - a > 1 or len(data) <= 2 * BLOCK:
            yield a, 0, data, offs
        else:
            for x in range(0, len(data) - SPAN + 1, BLOCK):
                part = data[x : x + BLOCK + SPAN - 1]
                yield a, x, part, np.array([0, len(part)])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, x, data, offs in blocks(batch.column("t")):
            text, at, near, far, core, whole = anchors(data, offs)
            ids = batch.column("id").take(pa.array(text + a))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at + x), pa.array(near.astype(np.int16)), pa.array(far.astype(np.int16)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))], names=["id", "at", "near", "far", "core", "whole"])


def columns(group: np.ndarray, near: np.ndarray, far: np.ndarray, passages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each passage the least and the most bytes before the anchor of its windows that recur in its collection; -1 if none does.

    ``group`` rises: rows of one collection stand together. A passage has ``far`` bytes before its anchor and ``SPAN - near`` from it on.
    """
    m = len(group)
    rows = np.full((m, REACH - 1 + SPAN), 256, np.uint16)
    for i, (b, f) in enumerate(zip(passages, far.tolist(), strict=True)):
        rows[i, REACH - 1 - f : REACH - 1 - f + len(b)] = np.frombuffer(b, np.uint8)
    symbols = np.ascontiguousarray(rows.T)
    del rows
    base = group.astype(np.int64) * 512
    order, common = np.arange(m), np.zeros(m + 1, np.int16)  # the order of the suffixes; common[i]: of suffix i and the one before
    low, high = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    for c in range(REACH - 2 + SPAN, -1, -1):
        key = base + symbols[c][order]  # the transform's column: what precedes each suffix
        new = np.zeros(m + 1, np.int16)
        np.add(common[1:m], 1, out=new[1:m], where=key[1:] == key[:-1])
        down = np.flatnonzero(key[1:] < key[:-1])
        if len(down):
            torn = np.zeros(int(group[-1]) + 1, bool)
            torn[group[down]] = True
            at = np.flatnonzero(torn[group])
            was = at[np.argsort(key[at], kind="stable")]
            same = np.flatnonzero(key[was[1:]] == key[was[:-1]])
            x, y = was[same], was[same + 1]
            least = common[y]
            apart = np.flatnonzero(y - x > 1)
            if len(apart):
                least[apart] = np.minimum.reduceat(common, np.stack([x[apart] + 1, y[apart] + 1], axis=1).ravel())[::2]
            new[at] = 0
            new[at[same + 1]] = least + 1
            order[at], key[at] = order[was], key[was]
        new[:m][key & 511 == 256] = 0  # beyond a passage's end nothing is equal
        common = new
        before = REACH - 1 - c
        if before >= 0:
            again = common >= SPAN
            hit = order[again[:m] | again[1:]]
            low[hit] = np.where(low[hit] < 0, before, low[hit])
            high[hit] = before
    return low, high


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collections, which come one after the other, in lots."""
    held: list[pa.RecordBatch] = []
    n = 0

    def build() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        g = t.column("core").to_numpy()
        group = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])
        low, high = columns(group, t.column("near").to_numpy(), t.column("far").to_numpy(), t.column("passage").to_pylist())
        ok = np.flatnonzero(low >= 0)
        out = t.select(["key0", "key1"]).take(pa.array(ok))
        return out.append_column("low", pa.array(low[ok], pa.int32())).append_column("high", pa.array(high[ok], pa.int32())).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        # up to where the last collection of the batch begins, what is held is whole
        g = b.column("core").to_numpy()
        cut = int(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))[-1])
        if held and n + cut >= LOT and (cut or held[-1].column("core")[-1].as_py() != g[0]):
            held.append(b.slice(0, cut))
            yield from build()
            held, n = [], 0
            b = b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield from build()


def construct(rows: DataFrame) -> DataFrame:
    """(key0, key1, low, high) of the rows (core, key0, key1, near, far, passage) with windows that recur in their collection."""
    dealt = rows.select("core", "key0", "key1", "near", "far", "passage").repartition(parts(rows.sparkSession), "core").sortWithinPartitions("core")
    return dealt.mapInArrow(tidy(_built), "key0 long, key1 long, low int, high int")


def split(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key0, key1, n, near, far, passage) dealt to spans of ``size`` windows, whose common bytes are the new core.

    Adds core, own (the hash of the bytes of the windows that are left), and has near, far and passage of these.
    """
    b = lambda x, y: F.substring(F.col("passage"), F.col("far") - x + 1, x + SPAN - y)  # noqa: E731  of windows with x to y bytes before the anchor: from the farthest to the nearest
    spans = F.sequence(F.expr(f"near div {size}"), F.expr(f"far div {size}")).cast("array<int>")
    cut = rows.withColumn("_p", F.explode(spans)).withColumns({"_lo": F.col("_p") * size, "_hi": F.col("_p") * size + size - 1})
    # bytes that all windows of the span have
    cut = cut.withColumn("core", F.xxhash64("_p", b(F.col("_lo"), F.col("_hi"))))
    cut = cut.withColumns({"_lo": F.greatest("_lo", "near").cast("short"), "_hi": F.least("_hi", "far").cast("short")})
    cut = cut.withColumn("passage", F.substring(F.col("passage"), F.col("far") - F.col("_hi") + 1, F.col("_hi") + SPAN - F.col("_lo")))
    return cut.select("core", F.xxhash64("_lo", "_hi", "passage").alias("own"), "key0", "key1", "n", F.col("_lo").alias("near"), F.col("_hi").alias("far"), "passage")


def repeated_windows(docs: DataFrame, row: str, text: Column, most: int = MOST) -> DataFrame:
    """(id, s, e): spans of bytes that windows which recur cover; they overlap."""
    own = docs.select(F.col(row).alias("id"), text.alias("t"))
    found = save(own.where(F.octet_length("t") >= SPAN).mapInArrow(tidy(_anchored), "id long, at long, near short, far short, core long, whole long"), "anchors")
    again = save(found.groupBy("core").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("core"), "cores")
    few = again.count() <= FEW
    found = found.join(F.broadcast(again) if few else again, "core", "left_semi")
    found = found if few else save(found, "found")
    classes = save(found.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at", "near", "far")).alias("p")).select("core", "whole", "n", "p.*"), "classes")
    per = classes.groupBy("core").agg(F.count(F.lit(1)).alias("_d"), F.min("n").alias("_least")).where("_d > 1 and _least = 1").select("core", "_d")
    per = save(per, "collections")
    open_ = classes.join(sent_if_few(per, FEW), "core")
    # the passages' bytes, read once more from the texts that have any
    lists = open_.groupBy("id").agg(F.collect_list(F.struct("core", "whole", "n", "at", "near", "far", "_d")).alias("ps"))
    body = own.select("id", F.col("t").cast("binary").alias("t")).join(lists, "id")
    cut = F.transform("ps", lambda p: F.struct(p["core"].alias("core"), p["whole"].alias("whole"), p["n"].alias("n"), p["near"].alias("near"), p["far"].alias("far"), p["_d"].alias("_d"), F.substring(F.col("t"), (p["at"] - p["far"] + 1).cast("int"), (p["far"] + SPAN - p["near"]).cast("int")).alias("passage")))
    rows = body.select(F.explode(cut).alias("p")).select("p.*").withColumnsRenamed({"whole": "key1"}).withColumn("key0", F.col("core"))
    hot = per.where(F.col("_d") > most).limit(1).count() > 0
    rows = save(rows, "passages") if hot else rows
    done = [construct(rows.where(F.col("_d") <= most))]
    left, size = rows.where(F.col("_d") > most), REACH
    while hot:
        size = -(-size // 2)
        left = save(split(left, size), "split")
        one = left.groupBy("core", "own").agg(F.sum("n").alias("n"), F.min(F.struct("key0", "key1")).alias("first"))
        one = save(one, "owns")
        many = save(one.groupBy("core").agg(F.count(F.lit(1)).alias("_d"), F.min("n").alias("_least")), "spans")
        told = left.drop("n").join(one, ["core", "own"])
        twice = told.where("n > 1").select("key0", "key1", F.col("near").cast("int").alias("low"), F.col("far").cast("int").alias("high"))
        done.append(twice)
        alone = told.where((F.col("key0") == F.col("first.key0")) & (F.col("key1") == F.col("first.key1"))).drop("first").join(many.where("_d > 1 and _least = 1"), "core")
        done.append(construct(alone.where(F.col("_d") <= most)))
        left = alone.where(F.col("_d") > most)
        hot = many.where(f"_d > {most} and _least = 1").limit(1).count() > 0
    full = classes.where("n > 1").select(F.col("core").alias("key0"), F.col("whole").alias("key1"), F.col("near").cast("int").alias("low"), F.col("far").cast("int").alias("high"))
    for d in done:
        full = full.unionByName(d)
    # written, so that Spark can split a class of very many copies when they meet
    hits = save(full.groupBy("key0", "key1").agg(F.min("low").alias("low"), F.max("high").alias("high")), "hits")
    met = found.select("id", "at", "core", "whole").join(hits, (F.col("core") == F.col("key0")) & (F.col("whole") == F.col("key1")))
    return met.select("id", (F.col("at") - F.col("high")).alias("s"), (F.col("at") + SPAN - F.col("low")).alias("e"))


def _runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans joined where they meet."""
    out: list[tuple[int, int]] = []
    for x in sorted((d["s"], d["e"]) for d in spans or ()):
        if out and x[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x[1]))
        else:
            out.append(x)
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column("t").cast(pa.binary()), b.column("spans").to_pylist(), strict=True):
            data, cuts, at = memoryview(text.as_buffer() or b""), _runs(spans), 0
            sha = hashlib.sha256()
            for s, e in cuts:
                sha.update(data[at:s])
                at = e
            sha.update(data[at:])
            out.append((len(data), sum(e - s for s, e in cuts), len(cuts), sha.hexdigest(), cuts))
        cols = [pa.array([r[k] for r in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.string()))]
        yield pa.RecordBatch.from_arrays([b.column("id"), *cols, pa.array([[{"s": s, "e": e} for s, e in r[4]] for r in out], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def removals(docs: DataFrame, ident: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256 and removed, the maximal runs of bytes (s, e) that go."""
    rows, row = rows_apart(docs, ident)
    body = F.coalesce(F.col(text), F.lit(""))
    spans = repeated_windows(rows, row, body, most).groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = save(spans, "spans")
    few = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= FEW
    own = rows.select(F.col(ident).alias("id"), F.col(row).alias("_row"), body.alias("t"))
    told = own.join(F.broadcast(spans) if few else spans, F.col("_row") == F.col("_id"), "left").select("id", "t", "spans")
    out = told.mapInArrow(tidy(_kept), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<s:bigint,e:bigint>>")
    return out.withColumnRenamed("id", ident)


def query(spark, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")


#: Strings of 200 bytes as 400 hexadecimal digits, counted over all texts.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT k, o, substr(h, 2 * o + 1, 1398) AS h FROM (SELECT k, h, unnest(range(0, len(h) // 2 - 199, 500)) AS o FROM d)),
w AS (SELECT k, o + i AS s, md5_number(substr(h, 2 * i + 1, 400)) AS v FROM (SELECT k, o, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM x)),
a AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1),
c AS (SELECT k, s, s - row_number() OVER (PARTITION BY k ORDER BY s) AS z FROM w JOIN a USING (v)),
r AS (SELECT k, min(s) AS s, max(s) + 200 AS e FROM c GROUP BY k, z),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
n AS (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s) AS run FROM m),
u AS (SELECT k, run, min(s) AS s, max(e) AS e FROM n GROUP BY k, run),
g AS (SELECT k, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM u GROUP BY k)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes,
  coalesce(list_sum(es) - list_sum(ss), 0)::BIGINT AS n_removed, coalesce(len(ss), 0)::BIGINT AS n_spans,
  CASE WHEN ss IS NULL THEN sha256(unhex(h)) ELSE sha256(unhex(array_to_string(list_transform(range(1, len(ss) + 2),
    lambda i: CASE WHEN i > len(ss) THEN substr(h, 2 * es[len(ss)] + 1) WHEN i = 1 THEN substr(h, 1, 2 * ss[1]) ELSE substr(h, 2 * es[i - 1] + 1, 2 * (ss[i] - es[i - 1])) END), ''))) END AS kept_sha256
FROM d LEFT JOIN g USING (k)"""
