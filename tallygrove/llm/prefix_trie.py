"""Trie of conversations by their common first turns, from an LCP-aware external mergesort.

A conversation is a sequence of turns, each of which stands for itself by a 128-bit hash of its role and text. Tasks sort lots of them into
runs that carry the number of first turns each sequence shares with the one before (its LCP). Runs are cut at common bounds and
meet in ranges, where a loser tree merges them: of two sequences the one that shares more turns with the last output is
the smaller, so only turns beyond that are ever compared, and the merged stream carries LCPs too. It is read
with a stack of open nodes, a path from the root: what the next sequence doesn't share is finished and leaves the stack with its sums.

A node whose path is that of a range's bound may go on in the next range: its parts, a path a bound, are added up afterwards.
Sequences come in segments of ``SEGMENT`` turns, so no row grows with a conversation: what follows a segment is a trie of its own
below its last node, the deepest are built first, and a segment that nobody shares needs no merge.

Edge cases: a null turn stands first, turns with one number go by their hash; a null role or text is empty; rows without
a conv_id are in no conversation; rows that repeat are turns each; texts are hashed whole; no rows, no nodes; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, save, tidy
from .ranks import exact_places, hex_keys, long_keys, sent_if_few

SEGMENT, WIDTH = 256, 16
#: Sequences of a run; ids of a chunk of members that end at a node; sampled sequences a range.
RUN, CHUNK, SAMPLE = 20_000, 1000, 16
#: Sequences below which one range is enough.
SMALL = 2000
NONE = hashlib.sha256(b"").hexdigest()


# --- sorting and merging --------------------------------------------------------------------------


def units(p: bytes, seq: bytes) -> list[bytes]:
    """What is compared: where the segment hangs, then its turns."""
    return [p, *(seq[k : k + WIDTH] for k in range(0, len(seq), WIDTH))]


def shared(a: list[bytes], b: list[bytes], h: int = 0) -> int:
    """How many first units are equal, of which ``h`` are known to be."""
    n = min(len(a), len(b))
    while h < n and a[h] == b[h]:
        h += 1
    return h


@dataclass
class Head:
    """The first sequence that is left of a run, and what it shares with the last output."""

    rows: Iterator[tuple[list[bytes], int, int, dict]]
    own: tuple | None = None
    lcp: int = 0

    def next(self) -> None:
        self.own = next(self.rows, None)
        self.lcp = self.own[2] if self.own else -1


def beats(a: Head, b: Head) -> bool:
    """Whether ``a`` comes first; the other then has its LCP with the winner. Both have theirs with the last output."""
    if a.own is None or b.own is None:
        return b.own is None
    if a.lcp != b.lcp:
        return a.lcp > b.lcp
    x, y = a.own[0], b.own[0]
    h = shared(x, y, a.lcp)
    first = x[h : h + 1] < y[h : h + 1] if x[h:] or y[h:] else a.own[1] <= b.own[1]
    (b if first else a).lcp = h
    return first


def merged(runs: list[Iterator[tuple[list[bytes], int, int, dict]]]) -> Iterator[tuple[int, list[bytes], int, dict]]:
    """(LCP with the one before, units, id, the rest) of all runs in order; each run yields (units, id, LCP, rest)."""
    heads = [Head(r) for r in runs]
    for h in heads:
        h.next()
        h.lcp = min(h.lcp, 0)
    n = len(heads)
    losers: list[int | None] = [None] * n
    for k in range(n):  # each climbs until it meets a place that nobody has lost at yet
        win, at = k, (k + n) // 2
        while at:
            other = losers[at]
            if other is None:
                losers[at] = win
                break
            if not beats(heads[win], heads[other]):
                losers[at], win = win, other
            at //= 2
        else:
            losers[0] = win
    while n:
        win = losers[0]
        own = heads[win].own
        if own is None:
            return
        yield heads[win].lcp, own[0], own[1], own[3]
        heads[win].next()
        at = (win + n) // 2
        while at:
            if not beats(heads[win], heads[losers[at]]):
                losers[at], win = win, losers[at]
            at //= 2
        losers[0] = win


# --- nodes ----------------------------------------------------------------------------------------

NODE = "kind int, id binary, up binary, root binary, conv long, depth long, parent_conv long, n long, n_children long, leaves long, saved long, sha string, bytes long, rng int, nth int, chunk string, g_children long, g_leaves long, g_saved long"
DONE, OPEN, ENDS, ROOT = range(4)
ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (x.split() for x in NODE.split(", "))])


@dataclass
class Node:
    """A node on the open path. Sums are of what is finished below it."""

    depth: int
    bytes: int
    #: Whether its path is the first part of the range's lower or upper bound.
    low: bool
    high: bool
    id: bytes | None
    conv: int | None = None
    n: int = 0
    n_children: int = 0
    leaves: int = 0
    saved: int = 0
    sha: object = None
    ends: list[int] = field(default_factory=list)
    waiting: list[dict] = field(default_factory=list)
    graft: dict | None = None

    def add(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n


def nodes(stream: Iterator[tuple[int, list[bytes], int, dict]], base: int, rng: int, low: list[bytes] | None, high: list[bytes] | None) -> Iterator[dict]:
    """Rows of the nodes of a range's sequences; ``base``: turns before the segment, ``low`` and ``high``: the range's bounds."""
    path: list[Node] = []
    chain: list[bytes] = []

    def leave() -> Iterator[dict]:
        x = path.pop()
        p = chain[: len(path) + 1]
        if x.low or x.high:
            for k in range(0, len(x.ends), CHUNK):
                yield {"kind": ENDS, "id": x.id, "rng": rng, "nth": k, "chunk": ",".join(map(str, x.ends[k : k + CHUNK]))}
            g = x.graft or {}
            yield {"kind": OPEN, "id": x.id, "up": path[-1].id if path else None, "root": p[0] if not path else None, "conv": x.conv, "depth": base + x.depth, "n": x.n, "n_children": x.n_children, "leaves": x.leaves, "saved": x.saved, "bytes": x.bytes, "sha": g.get("sha"), "g_children": g.get("n_children"), "g_leaves": g.get("leaves"), "g_saved": g.get("saved")}
            return
        if x.graft:
            x.n_children, x.leaves, x.saved = x.graft["n_children"], x.graft["leaves"], x.graft["saved"]
        leaves, saved = x.leaves or 1, x.saved + (x.n - 1) * x.bytes
        own = {"kind": DONE, "conv": x.conv, "depth": base + x.depth, "n": x.n, "n_children": x.n_children, "leaves": leaves, "saved": saved, "sha": x.graft["sha"] if x.graft else x.sha.hexdigest() if x.sha else NONE}
        for row in x.waiting:
            row["parent_conv"] = x.conv
            yield row
        if not path:
            yield own | ({"kind": ROOT, "root": p[0]} if base else {})
            return
        up = path[-1]
        up.add(x.conv, x.n)
        up.n_children, up.leaves, up.saved = up.n_children + 1, up.leaves + leaves, up.saved + saved
        if up.id is None:
            up.waiting.append(own)
        else:
            yield own | {"up": up.id}

    for lcp, seq, conv, rest in stream:
        while len(path) > lcp:
            yield from leave()
        chain = seq
        for u in range(len(path), len(seq)):
            on = [(not u or getattr(path[-1], side)) and bound is not None and u < len(bound) and bound[u] == seq[u] for side, bound in (("low", low), ("high", high))]
            path.append(Node(u, rest["nb"][u - 1] if u else 0, on[0], on[1], hashlib.md5(b"".join(seq[: u + 1]), usedforsecurity=False).digest() if any(on) else None))
        top = path[-1]
        top.add(conv, 1)
        if rest["more"]:
            top.graft = rest
        elif top.id is not None:
            top.ends.append(conv)
        elif top.sha is None:
            top.sha = hashlib.sha256(str(conv).encode())
        else:
            top.sha.update(f",{conv}".encode())
    while path:
        yield from leave()


def joined(rows: list[dict]) -> list[dict]:
    """The nodes on bounds: parts of equal id are added up already; here children go to their parents, the deepest first."""
    by = {r["id"]: r for r in rows}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        if r["sha"] is not None:  # the next segment's trie hangs here
            r["n_children"], r["leaves"], r["saved"] = r["g_children"], r["g_leaves"], r["g_saved"]
        r["leaves"] = r["leaves"] or 1
        r["saved"] += (r["n"] - 1) * r["bytes"]
        up = by.get(r["up"])
        if up:
            up["conv"] = r["conv"] if up["conv"] is None else min(up["conv"], r["conv"])
            up["n"], up["n_children"] = up["n"] + r["n"], up["n_children"] + 1
            up["leaves"], up["saved"] = up["leaves"] + r["leaves"], up["saved"] + r["saved"]
    for r in rows:
        r["parent_conv"] = by[r["up"]]["conv"] if r["up"] in by else None
    return rows


# --- one segment's tries --------------------------------------------------------------------------

ITEM = "p binary, seq binary, nb array<int>, conv long, more boolean, n_children long, leaves long, saved long, sha string"


def _bounds(items: DataFrame, n: int) -> list[tuple[list[bytes], int]]:
    """Bounds of ranges with about equal numbers of sequences, from a sample by hash: ``SAMPLE`` sequences a range, whatever the input."""
    ranges = min(parts(items.sparkSession), -(-n // SMALL))
    if ranges < 2:
        return []
    every = max(1, n // (SAMPLE * ranges))
    some = items.where(F.pmod(F.xxhash64("conv", F.lit(5)), F.lit(every)) == 0).select("p", "seq", "conv").collect()
    keys = sorted((units(bytes(r["p"]), bytes(r["seq"])), r["conv"]) for r in some)
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)] if len(keys) >= ranges else keys


def band(items: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """(node rows, roots) of the tries of segments that begin after ``base`` turns. roots: root, n_children, leaves, saved, sha."""
    spark = items.sparkSession
    bounds = _bounds(items, items.count())

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, lot, held = TaskContext.get().partitionId(), 0, []

        def run() -> pa.RecordBatch:
            keyed = sorted(((units(r["p"], r["seq"]), r["conv"], r) for r in held), key=lambda x: x[:2])
            last: list[bytes] = []
            out = []
            for at, (key, conv, r) in enumerate(keyed):
                out.append(r | {"rng": bisect.bisect_right(bounds, (key, conv)), "run": task << 24 | lot, "at": at, "lcp": shared(last, key)})
                last = key
            return pa.RecordBatch.from_pylist(out, schema=schema)

        schema = None
        for b in batches:
            schema = pa.schema([*b.schema, ("rng", pa.int32()), ("run", pa.int64()), ("at", pa.int32()), ("lcp", pa.int32())])
            held += b.to_pylist()
            if len(held) >= RUN:
                yield run()
                held, lot = [], lot + 1
        if held:
            yield run()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: dict[int, list[pa.RecordBatch]] = {}
        rng = None
        for b in batches:
            if b.num_rows:
                rng, run = b.column("rng")[0].as_py(), b.column("run").to_numpy()
                cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    lots.setdefault(int(run[x]), []).append(b.slice(x, y - x))
        if rng is None:
            return

        def read(own: list[pa.RecordBatch]) -> Iterator[tuple[list[bytes], int, int, dict]]:
            first = True
            for b in own:
                for k in range(0, b.num_rows, 500):  # rows become objects as they are due
                    for r in b.slice(k, 500).to_pylist():
                        yield units(r["p"], r["seq"]), r["conv"], 0 if first else r["lcp"], r
                        first = False

        low, high = bounds[rng - 1][0] if rng else None, bounds[rng][0] if rng < len(bounds) else None
        out: list[dict] = []
        for row in nodes(merged([read(rows) for rows in lots.values()]), base, rng, low, high):
            out.append(row)
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    dealt = items.mapInArrow(tidy(runs), f"{ITEM}, rng int, run long, at int, lcp int")
    dealt = dealt.repartitionById(parts(spark), "rng").sortWithinPartitions("rng", "run", "at")
    got = save(dealt.mapInArrow(tidy(merge), NODE), "nodes")
    done = got.where(F.col("kind") == DONE)
    roots = got.where(F.col("kind") == ROOT).select("root", "conv", "n", "n_children", "leaves", "saved", "sha")
    if not bounds:
        return done.select("conv", "depth", "parent_conv", "n", "n_children", "leaves", "saved", "sha"), roots
    first = lambda c: F.max(c).alias(c)  # noqa: E731  equal in all parts, or null
    total = got.where(F.col("kind") == OPEN).groupBy("id").agg(first("up"), first("root"), F.min("conv").alias("conv"), first("depth"), *[F.sum(c).alias(c) for c in ("n", "n_children", "leaves", "saved")], *map(first, ("bytes", "sha", "g_children", "g_leaves", "g_saved")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in kept.names} for r in joined(rows)], schema=kept)

    kept = pa.schema([ARROW.field(c) for c in ("id", "root", "conv", "depth", "parent_conv", "n", "n_children", "leaves", "saved", "sha")])
    # a path a bound: as many rows as there are ranges, times a segment's turns at most
    opened = total.coalesce(1).mapInArrow(tidy(sums), "id binary, root binary, conv long, depth long, parent_conv long, n long, n_children long, leaves long, saved long, sha string")
    opened = save(opened.join(_ends(got), "id", "left").withColumn("sha", F.coalesce("sha", "ends", F.lit(NONE))).drop("ends"), "opened")
    rows = done.join(sent_if_few(opened.select(F.col("id").alias("up"), F.col("conv").alias("_conv"))), "up", "left").withColumn("parent_conv", F.coalesce("parent_conv", "_conv"))
    cols = ["conv", "depth", "parent_conv", "n", "n_children", "leaves", "saved", "sha"]
    at_root = F.col("root").isNotNull() & F.lit(base > 0)
    own = opened.where(~at_root).select(*cols)
    return rows.select(*cols).unionByName(own), roots.unionByName(opened.where(at_root).select("root", "conv", "n", "n_children", "leaves", "saved", "sha"))


def _ends(got: DataFrame) -> DataFrame:
    """(id, ends): the hash of the ids of members that end at a node on a bound; chunks stream through in order."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for b in batches:
            for key, chunk in zip(b.column("id").to_pylist(), b.column("chunk").to_pylist(), strict=True):
                if key != last:
                    if sha:
                        yield pa.RecordBatch.from_pydict({"id": pa.array([last], pa.binary()), "ends": [sha.hexdigest()]})
                    last, sha = key, hashlib.sha256(chunk.encode())
                else:
                    sha.update(b"," + chunk.encode())
        if sha:
            yield pa.RecordBatch.from_pydict({"id": pa.array([last], pa.binary()), "ends": [sha.hexdigest()]})

    chunks = got.where(F.col("kind") == ENDS).select("id", "rng", "nth", "chunk").repartition(parts(got.sparkSession), "id").sortWithinPartitions("id", "rng", "nth")
    return chunks.mapInArrow(tidy(told), "id binary, ends string")


# --- whole conversations --------------------------------------------------------------------------


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the conversations in ``lengths`` (conv, len), whose turns are (conv, at, d, nb): place from 0, hash, bytes of the text."""
    seg = turns.groupBy("conv", F.expr(f"at div {SEGMENT}").alias("k")).agg(F.sort_array(F.collect_list(F.struct("at", "d", "nb"))).alias("ts"))
    seg = seg.select("conv", "k", F.transform("ts", lambda t: t["d"]).alias("ds"), F.transform("ts", lambda t: t["nb"]).alias("nb"))
    # one more segment, empty, where the last is full: so every full segment has one after it
    last = lengths.where(f"len % {SEGMENT} = 0").select("conv", F.expr(f"len div {SEGMENT}").alias("k"), F.array().cast("array<binary>").alias("ds"), F.array().cast("array<int>").alias("nb"))
    seg = save(seg.unionByName(last).withColumn("more", F.size("nb") == SEGMENT).withColumn("seq", F.unhex(F.array_join(F.transform("ds", lambda d: F.hex(d)), ""))).drop("ds"), "segments")
    # where a segment hangs: a hash of all segments before it, of the few conversations that have any
    full = seg.where("more").select("conv", "k", F.md5("seq").alias("s"))
    grow = F.aggregate(F.array_sort(F.collect_list(F.struct("k", "s"))), F.array(F.lit("")), lambda a, x: F.concat(a, F.array(F.md5(F.concat(F.element_at(a, -1), x["s"]).cast("binary")))))
    chain = full.groupBy("conv").agg(grow.alias("ps")).select("conv", F.posexplode("ps").alias("k", "p")).select("conv", F.col("k").cast("long").alias("k"), F.unhex("p").alias("p"))
    chain = save(chain, "chain")
    deep = seg.where("k > 0").join(chain, ["conv", "k"])
    per = deep.groupBy("p").agg((F.count(F.lit(1)) == 1).alias("lone"))
    items = seg.where("k = 0").withColumns({"p": F.unhex(F.lit("")), "lone": F.lit(False)}).unionByName(deep.join(per, "p"))
    after = chain.select("conv", (F.col("k") - 1).alias("k"), F.col("p").alias("nxt"))
    items = save(items.join(after, ["conv", "k"], "left").join(lengths, "conv"), "items")
    lone = items.where("lone")
    sha = lambda ends: F.when(ends, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NONE))
    depth = F.col("k") * SEGMENT + F.col("i") + 1
    alone = lone.select("conv", "k", "len", F.posexplode("nb").alias("i", "b")).withColumn("depth", depth)
    one = F.lit(1).cast("long")
    out = alone.select("conv", "depth", F.col("conv").alias("parent_conv"), one.alias("n"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), one.alias("leaves"), F.lit(0).cast("long").alias("saved"), sha(F.col("depth") == F.col("len")).alias("sha"))
    stubs = lone.select("k", F.col("p").alias("root"), (F.size("nb") > 0).cast("long").alias("n_children"), one.alias("leaves"), F.lit(0).cast("long").alias("saved"), sha(F.size("nb") == 0).alias("sha"))
    deepest = items.where("not lone").agg(F.max("k")).first()[0]
    roots = None
    for k in range(deepest if deepest is not None else -1, -1, -1):
        below = stubs.where(F.col("k") == k + 1).drop("k")
        below = below.unionByName(roots.select(*below.columns)) if roots is not None else below
        own = items.where((F.col("k") == k) & ~F.col("lone")).join(below.withColumnRenamed("root", "nxt"), "nxt", "left")
        rows, roots = band(save(own.select("p", "seq", "nb", "conv", "more", "n_children", "leaves", "saved", "sha"), "band"), k * SEGMENT)
        out = out.unionByName(rows)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def turns_of(convs: DataFrame, ident: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, d, nb): the turns of each conversation in their order, by exact places, however many it has."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    hashed = F.md5(F.concat(F.octet_length(said(role)).cast("string"), F.lit(":"), said(role), said(text)).cast("binary"))
    rows = convs.where(F.col(ident).isNotNull()).select(F.col(ident).alias("conv"), F.col(turn).cast("long").alias("turn"), hashed.alias("h"), F.octet_length(said(text)).alias("nb"), F.monotonically_increasing_id().alias("row"))
    rows = save(rows, "turns")
    placed = exact_places(rows, "conv", [*long_keys(F.col("turn")), *hex_keys(F.col("h"), 32), F.col("row")], [F.col("turn").asc_nulls_first(), F.col("h"), F.col("row")])
    return save(placed.select("conv", F.col("place").alias("at"), F.unhex("h").alias("d"), "nb"), "placed")


def grafted(turns: DataFrame, kept: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first ``kept`` turns replaced by those of conversation ``base``; (turns, lengths) for ``trie``. ``kept`` is 8 at most."""
    n = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    own = n.withColumns({"h": kept, "b": base})
    own = save(own.join(n.select(F.col("conv").alias("b"), F.col("n").alias("nb_b")), "b", "left").select("conv", "b", "h", F.least("h", F.coalesce("nb_b", F.lit(0))).alias("from"), "n"), "heads")
    tail = turns.join(own.select("conv", "h", "from"), "conv").where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("from")).alias("at"), "d", "nb")
    head = turns.where("at < 8").withColumnRenamed("conv", "b").join(own.select("b", "conv", "h"), "b").where("at < h").select("conv", "at", "d", "nb")
    return tail.unionByName(head), own.select("conv", (F.greatest(F.lit(0), F.col("n") - F.col("h")) + F.col("from")).alias("len"))


def query(spark, sf_dir: str) -> DataFrame:
    turns = turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    c = F.col("conv")
    return trie(*grafted(turns, F.crc32(c.cast("string").cast("binary")) % 9, c - c % 5))


#: CRC-32 of a text of ASCII, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ord(ch)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
SQL = f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS nb FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 5 AS b, {CRC.format("c::VARCHAR")} % 9 AS f FROM (SELECT DISTINCT c FROM o)),
u AS (SELECT k.c, pos, h, nb FROM k JOIN o ON o.c = k.b AND pos < f UNION ALL SELECT k.c, pos, h, nb FROM k JOIN o ON o.c = k.c AND pos >= f),
s AS (SELECT c, list(h ORDER BY pos) AS hs, list(nb ORDER BY pos) AS bs FROM u GROUP BY c),
z AS (SELECT c, coalesce(hs, []) AS hs, coalesce(bs, []) AS bs FROM k LEFT JOIN s USING (c)),
n AS (SELECT c, d, len(hs) AS l, md5(array_to_string(hs[1:d], '')) AS id, CASE WHEN d > 0 THEN md5(array_to_string(hs[1:d - 1], '')) END AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS nb
    FROM (SELECT *, unnest(range(0, len(hs) + 1)) AS d FROM z)),
m AS (SELECT id, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(nb) AS nb, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = l), '') AS ends FROM n GROUP BY id),
g AS (SELECT up AS id, count(*) AS n FROM m WHERE up IS NOT NULL GROUP BY 1),
a AS (SELECT m.id AS below, n.id AS above FROM m JOIN n ON n.c = m.conv_id AND n.d <= m.depth),
t AS (SELECT above AS id, count(*) FILTER (WHERE g.n IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.nb)::BIGINT AS saved FROM a JOIN m ON m.id = below LEFT JOIN g ON g.id = below GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs, coalesce(g.n, 0)::BIGINT AS n_children, n_leaves, saved AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m LEFT JOIN m p ON p.id = m.up LEFT JOIN g ON g.id = m.id JOIN t ON t.id = m.id"""
