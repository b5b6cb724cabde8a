"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. Equal sets are one class. A set's
shingles are also dealt to groups by their leading bits; the counts a group are a point, of up to one
shingle a coordinate. Two sets share at most the sum of the smaller counts, and two nodes of a tree
at most that of their largest counts, which bounds every pair below a pair of nodes. The trees' nodes hold
counts of neighbouring groups summed; pairs of points that pass are bounded by all groups before they leave the tree.

As count vectors of unlike texts of one length lie close together in few dimensions, one tree over all points would
visit most pairs. So points are first dealt to cells: sets that reach a Jaccard of 0.75 share one of
the first ``n - ceil(0.75 n) + 1`` shingles of any fixed order. The order here puts frequent shingles
last. Each cell with points of more than one known component gets its own tree, without the points whose shingle comes so
late that no other of the cell can be near them; surviving pairs are
verified on the whole sets. A pair leaves the trees in the first of the cells that both sets are in, so hardly
any is told twice. To keep groups of near copies from meeting all against all, each set is first
verified against the best of its cells' smallest members and of their largest; components that still meet
in cells are then tried by one pair each, a few times, and only pairs between different components
remain for the trees. Nothing is left out: a pair of one component needs no link of its own.

Edge cases: a null, empty or blank text has no shingle, links with nothing and is its own component; fewer
than five words are one shingle; rows that repeat an id are documents of their own that share it; a null id
has the component of its group, null if all its ids are null; other columns are ignored; long texts count whole.
Classes are told apart by 64-bit hashes of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bloom_of, components, grouped, in_bloom, lowered, mixed, own_columns, rows_apart, save, split_hot, text_slices, tidy, without, word_bounds, word_hashes

WORDS = 5
#: Jaccard of at least UP / DOWN.
UP, DOWN = 3, 4
#: Shingles that are ordered last: at most so many, seen so often in a lot of texts.
FREQUENT, OFTEN = 1 << 17, 8
#: Passes at most that link components by one pair each, before all pairs that are left.
ROUNDS = 2
#: Shingles of so many texts (a power of two) are cells dealt by class, not by shingle.
HOT = 12
#: Shingles of a long set: counts of fewer groups tell long sets apart well enough.
LONG = 512
#: A set's first shingle is place 0, and one after its last this.
PLACES = 1000
#: Cells of a class that are looked through for the first that a pair shares; beyond these a pair may be told twice.
FIRSTS = 8
#: Prefix shingles a bucket holds on average; points of a block of a hot cell; points of a leaf, children of a node, and groups
#: that a tree's coordinate sums.
BUCKET, BLOCK, LEAF, FAN, COARSE = 200_000, 1500, 32, 8, 4
#: Pairs of longs that are sent to all tasks at most (16 MB).
MOST_SENT = 1_000_000
#: Texts that are sent to Python at a time.
ROWS = 1000
#: Points that are compared one by one rather than by a tree.
FEW = 8

_MULT = mixed(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    with np.errstate(over="ignore"):
        for a, b, data, offs in text_slices(col, 1 << 19):
            data = lowered(data)
            starts, ends = word_bounds(data, offs)
            h = word_hashes(data, starts, ends)
            cut = np.searchsorted(starts, offs)
            m = max(0, len(h) - WORDS + 1)
            s = np.zeros(m, np.uint64)
            for k in range(WORDS):
                s += h[k : k + m] * _MULT[k]
            s = mixed(s)
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if y - x >= WORDS:
                    yield np.unique(s[x : y - WORDS + 1])
                elif y > x:
                    yield mixed(np.array([(h[x:y] * _MULT[: y - x]).sum() + np.uint64(y - x)], np.uint64))
                else:
                    yield s[:0]


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def vector(s: np.ndarray) -> np.ndarray:
    """Counts of the groups, whose number is a power of two: as many as the shingles or more, or a quarter of that where a set is long.

    A byte holds a count.
    """
    k = max(4, math.ceil(math.log2(max(1, len(s)))) - (2 if len(s) > LONG else 0))
    n = np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    if n.max(initial=0) > 255:
        raise ValueError("shingle hashes aren't spread")
    return n.astype(np.uint8)


_SHIFTS = {2: np.array([0, 2, 4, 6], np.uint8), 4: np.array([0, 4], np.uint8)}
_CUT = {bits: ((np.arange(256)[:, None] >> at) & ((1 << bits) - 1)).astype(np.uint8) for bits, at in _SHIFTS.items()}


def packed(v: np.ndarray) -> bytes:
    """Counts in two bits each, or four where they are many; before them the groups of what is beyond that."""
    bits = 2 if v.sum(dtype=np.int64) <= len(v) else 4
    most = (1 << bits) - 1
    over = np.repeat(np.arange(len(v)), np.maximum(v.astype(np.int64) - most, 0)).astype(np.uint32)
    low = np.minimum(v, most).reshape(-1, 8 // bits)
    return np.array([bits, len(over)], np.uint32).tobytes() + over.tobytes() + (low << _SHIFTS[bits]).sum(axis=1, dtype=np.uint8).tobytes()


def unpacked(raw) -> np.ndarray:
    bits, n = np.frombuffer(raw, np.uint32, 2).tolist()
    v = _CUT[bits][np.frombuffer(raw, np.uint8, offset=8 + 4 * n)].ravel()
    if n:
        np.add.at(v, np.frombuffer(raw, np.uint32, n, 8), 1)
    return v


def prefix(n: int) -> int:
    return n - -(-UP * n // DOWN) + 1


def enough(shared, total):
    """Whether sets that share so many shingles, of so many together, reach the Jaccard."""
    return (UP + DOWN) * shared >= UP * total


# --- the tree ---------------------------------------------------------------------------------------


def fold(v: np.ndarray, width: int) -> np.ndarray:
    """Counts of fewer groups: neighbours summed. Rows stay rows."""
    return v if v.shape[-1] == width else v.reshape(*v.shape[:-1], width, -1).sum(axis=-1, dtype=np.int32)


def bounded(x: np.ndarray, y: np.ndarray, total: int) -> bool:
    """Whether two counts allow the Jaccard."""
    w = min(len(x), len(y))
    return bool(enough(int(np.minimum(fold(x, w), fold(y, w)).sum(dtype=np.int64)), total))


class CountTree:
    """A packed R-tree of points of one width: leaves of ``LEAF`` points, nodes of ``FAN`` children.

    Nodes hold the counts of ``COARSE`` neighbouring groups summed, unless the sets are long.
    """

    def __init__(self, at: np.ndarray, points: np.ndarray, n: np.ndarray, comp: np.ndarray) -> None:
        order = np.lexsort((points.argmax(axis=1), n, comp))  # near copies lie side by side
        self.at, self.full, self.n = at[order], points[order], n[order]
        self.points = fold(self.full, max(4, points.shape[1] // (COARSE if n.sum() <= points.size else 1))).astype(np.int32)
        self.levels: list[tuple[np.ndarray, ...]] = []
        comp = comp[order]
        low = (self.points, self.n, self.n, comp, comp)
        while not self.levels or len(self.levels[-1][0]) > 1:
            cuts = np.arange(0, len(low[0]), FAN if self.levels else LEAF)
            low = tuple(f.reduceat(x, cuts) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), low, strict=True))
            self.levels.append((cuts, np.append(cuts[1:], len(self.levels[-1][0]) if self.levels else len(at)), *low))

    def join(self, other: CountTree, asked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs whose counts allow the Jaccard and that ``asked(i, j)`` lets pass; of a tree with itself, both ways round."""
        width, wide = min(self.points.shape[1], other.points.shape[1]), min(self.full.shape[1], other.full.shape[1])
        todo = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while todo:
            la, a, lb, b = todo.pop()
            xa, ya, top_a, low_a, high_a, one_a, end_a = (x[a] for x in self.levels[la])
            xb, yb, top_b, low_b, high_b, one_b, end_b = (x[b] for x in other.levels[lb])
            if one_a == end_a == one_b == end_b:  # all of one component
                continue
            if DOWN * high_a < UP * low_b or DOWN * high_b < UP * low_a:
                continue
            if not enough(np.minimum(fold(top_a, width), fold(top_b, width)).sum(), low_a + low_b):
                continue
            if la == lb == 0:
                p, q = fold(self.points[xa:ya], width), fold(other.points[xb:yb], width)
                total = self.n[xa:ya, None] + other.n[None, xb:yb]
                i, j = np.nonzero(enough(np.minimum(p[:, None], q[None]).sum(axis=2), total))
                ok = asked(self.at[xa + i], other.at[xb + j])
                i, j = i[ok], j[ok]
                if len(i):
                    shared = np.minimum(fold(self.full[xa + i], wide), fold(other.full[xb + j], wide)).sum(axis=1, dtype=np.int64)
                    ok = enough(shared, total[i, j])
                    yield self.at[xa + i[ok]], other.at[xb + j[ok]]
            elif la >= lb:
                todo += [(la - 1, k, lb, b) for k in range(xa, ya)]
            else:
                todo += [(la, a, lb - 1, k) for k in range(xb, yb)]


def cell_pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a cell's block pair: columns cell, sig, n, vec, comp, home, blk, lo, hi, firsts."""
    sig, n, comp, home, blk = (t.column(c).to_numpy() for c in ("sig", "n", "comp", "home", "blk"))
    cell, lo, hi = (t.column(c)[0].as_py() for c in ("cell", "lo", "hi"))
    if len(sig) < 2 or comp.min() == comp.max():
        return
    raw = t.column("vec")
    asked = lambda i, j: (comp[i] != comp[j]) & (home[i] | home[j])
    if len(sig) <= FEW:  # less than a leaf
        i, j = np.triu_indices(len(sig), 1)
        ok = asked(i, j) & (DOWN * n[i] >= UP * n[j]) & (DOWN * n[j] >= UP * n[i]) & (np.minimum(blk[i], blk[j]) == lo) & (np.maximum(blk[i], blk[j]) == hi)
        vecs = {k: unpacked(raw[k].as_buffer()) for k in {*i[ok].tolist(), *j[ok].tolist()}}
        near = [(a, b) for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True) if bounded(vecs[a], vecs[b], n[a] + n[b])]
        some = [np.array(near, np.int64).T] if near else []
    else:
        vecs = [unpacked(x.as_buffer()) for x in raw]
        wide = np.array([len(v) for v in vecs])
        trees = {}
        for side in {lo, hi}:
            for w in np.unique(wide[blk == side]):
                at = np.flatnonzero((blk == side) & (wide == w))
                trees[side, w] = CountTree(at, np.stack([vecs[k] for k in at]), n[at], comp[at])
        some = (np.stack(p) for (sa, _), x in trees.items() for (sb, _), y in trees.items() if sa == lo and sb == hi for p in x.join(y, asked))
    del vecs
    firsts = t.column("firsts")
    before: dict[int, frozenset] = {}

    def earlier(k: int) -> frozenset:
        if k not in before:
            before[k] = frozenset(c for c in firsts[k].as_py() if c < cell)
        return before[k]

    found = []
    for i, j in some:
        ok = [earlier(a).isdisjoint(earlier(b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        found.append(np.stack([np.minimum(sig[i], sig[j])[ok], np.maximum(sig[i], sig[j])[ok]]))
    if found:
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


# --- passes over the texts --------------------------------------------------------------------------


def _summaries(docs: DataFrame) -> DataFrame:
    """Rows of three kinds: documents (id, n, sig), classes (sig, n, vec), and frequent shingles (sig, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            tok, n = np.unique(np.concatenate(held), return_counts=True)
            tok, n = tok[n >= OFTEN], n[n >= OFTEN]
            return rows(2, None, tok.astype(np.int64), n, None)

        def rows(kind, ids, sig, n, vec) -> pa.RecordBatch:
            m = len(sig)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.nulls(m, pa.int64()) if ids is None else ids, pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.nulls(m, pa.binary()) if vec is None else pa.array(vec, pa.binary())], names=["kind", "id", "sig", "n", "vec"])

        for b in batches:
            sig, n, own = [], [], ([], [], [])
            for s in shingle_sets(b.column("t")):
                c = class_of(s)
                sig.append(c)
                n.append(len(s))
                if c not in seen and len(s):
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(c)
                    for x, y in zip(own, (c, len(s), packed(vector(s))), strict=True):
                        x.append(y)
                    held.append(s)
                    size += len(s)
                    if size > 2_000_000:
                        yield frequent()
                        held, size = [], 0
            yield rows(0, b.column("id"), sig, n, None)
            yield rows(1, None, *own)
        if held:
            yield frequent()

    return docs.mapInArrow(tidy(run), "kind int, id long, sig long, n long, vec binary")


def _prefixes(docs: DataFrame, buckets: int, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Prefix shingles with their class, packed by bucket: payload is 32 bits a shingle, then 64 a class, then 8 a place. Those of hot shingles have buckets below 0, by class."""
    sent = docs.sparkSession.sparkContext.broadcast((often[0].tobytes(), often[1].tobytes()))  # FREQUENT entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, level = (np.frombuffer(x, k) for x, k in zip(sent.value, (np.uint64, np.int8), strict=True))
        maybe = np.zeros(1 << 20, bool)
        maybe[(tok & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        toks: list[np.ndarray] = []
        places: list[np.ndarray] = []
        hots: list[np.ndarray] = []
        sigs: list[tuple[int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = np.concatenate(toks)
            c = np.repeat(np.array([x for x, _ in sigs], np.int64), [y for _, y in sigs])
            into = (t % np.uint64(buckets)).astype(np.int64)
            warm = np.concatenate(hots)
            with np.errstate(over="ignore"):
                into[warm] = -1 - (mixed(c[warm].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(into, kind="stable")
            into, t, c, q = into[order], ((t >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], c[order], np.concatenate(places)[order]
            has, at = np.unique(into, return_index=True)
            ends = np.append(at[1:], len(t))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(has, pa.int64()), "payload": pa.array([t[x:y].tobytes() + c[x:y].tobytes() + q[x:y].tobytes() for x, y in zip(at, ends, strict=True)], pa.binary())})

        for b in batches:
            for s in shingle_sets(b.column("t")):
                if not len(s):
                    continue
                c = class_of(s)
                if c in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(c)
                p = prefix(len(s))
                hot = np.zeros(len(s), bool)
                hit = np.flatnonzero(maybe[(s & np.uint64((1 << 20) - 1)).astype(np.int64)]) if len(tok) else ()
                if len(hit):
                    at = np.minimum(np.searchsorted(tok, s[hit]), len(tok) - 1)
                    rank = np.zeros(len(s), np.int8)
                    rank[hit] = np.where(tok[at] == s[hit], level[at], 0)
                    order = np.argsort(rank, kind="stable")
                    s, hot = s[order], rank[order] >= HOT
                toks.append(s[:p])
                hots.append(hot[:p])
                places.append((np.arange(p) * PLACES // len(s)).astype(np.uint8))
                sigs.append((c, p))
                size += p
                if size > 1_000_000:
                    yield flush()
                    toks, places, hots, sigs, size = [], [], [], [], 0
        if toks:
            yield flush()

    return docs.mapInArrow(tidy(run), "bucket long, payload binary")


def _cells(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of a bucket: kind 0, (smallest class of a cell, other class, cells both are in); kind 2, the same of the largest; kind 1, (cell, class, first place of a shingle of the cell's among the class's, in thousandths).

    Shingles of one class fall away, and cells with equal members are one. Of a bucket of hot shingles: kind 1 only.
    """
    tok, sig, place = [], [], []
    for x in t.column("payload").to_pylist():
        n = len(x) // 13
        tok.append(np.frombuffer(x, np.uint32, n))
        sig.append(np.frombuffer(x[4 * n : 12 * n], np.int64))
        place.append(np.frombuffer(x, np.uint8, n, 12 * n))
    tok, sig, place = np.concatenate(tok), np.concatenate(sig), np.concatenate(place).astype(np.int64)
    order = np.lexsort((sig, tok))
    tok, sig, place = tok[order], sig[order], place[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
    tok, sig, place = tok[new], sig[new], place[new]
    if t.column("bucket")[0].as_py() < 0:  # whom else these shingles' cells hold isn't known here
        with np.errstate(over="ignore"):
            cell = mixed(tok.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(sig), np.int32)), pa.array(cell), pa.array(sig), pa.array(place)], names=["kind", "a", "b", "n"])
        return
    first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    size = np.diff(np.append(first, len(tok)))
    many = np.repeat(size, size) > 1
    sig, place, size = sig[many], place[many], size[size > 1]
    if not len(sig):
        return
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    with np.errstate(over="ignore"):
        cell = mixed(np.add.reduceat(mixed(sig.astype(np.uint64)), first) + size.astype(np.uint64)).astype(np.int64)
    for kind, centre in ((0, sig[first]), (2, sig[first + size - 1])):
        centre = np.repeat(centre, size)
        star = centre != sig
        pairs, n = np.unique(np.stack([centre[star], sig[star]]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n.astype(np.int64))], names=["kind", "a", "b", "n"])
    _, keep, same = np.unique(cell, return_index=True, return_inverse=True)
    np.minimum.at(place, np.repeat(first[keep[same]] - first, size) + np.arange(len(sig)), place)  # cells of equal members list them in one order
    take = np.isin(np.repeat(np.arange(len(size)), size), keep)
    a, b = np.repeat(cell, size)[take], sig[take]
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int32)), pa.array(a), pa.array(b), pa.array(place[take])], names=["kind", "a", "b", "n"])


def _some(pairs: DataFrame) -> DataFrame:
    """Written pairs of longs, sent to all tasks if they are counted and few."""
    return F.broadcast(pairs) if pairs.count() <= MOST_SENT else pairs


def _verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, keep: list[str]) -> DataFrame:
    """The pairs (a, b) of a written table that link, by their whole sets. Only the texts of classes in question are hashed again."""
    spark = docs.sparkSession
    need = save(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct(), "need", keep)
    need = _some(need)
    bits = bloom_of(need.join(classes.select("sig", "rep"), "sig"), "rep")
    sent = spark.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            ids = b.column("id")
            ask = in_bloom(own, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(ask)
            for part in np.array_split(at, -(-len(at) // 256)) if len(at) else ():
                sets = list(shingle_sets(b.column("t").take(pa.array(part))))
                yield pa.RecordBatch.from_pydict({"sig": pa.array([class_of(s) for s in sets], pa.int64()), "s": pa.array([s.tobytes() for s in sets], pa.binary())})

    with arrow_rows(spark, ROWS):
        sets = save(docs.mapInArrow(tidy(run), "sig long, s binary").join(need, "sig", "left_semi").dropDuplicates(["sig"]), "sets", keep)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                ok.append(bool(len(x)) and enough(shared, len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = _some(pairs).select("a", "b").join(sets.select(F.col("sig").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("s").alias("y")), "b")
    with arrow_rows(spark, 1000):
        return save(both.select("a", "b", "x", "y").mapInArrow(tidy(test), "a long, b long"), "links", keep)


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of a written table whose count vectors allow the Jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y, n in zip(b.column("x"), b.column("y"), b.column("n").to_pylist(), strict=True):
                ok.append(bounded(unpacked(x.as_buffer()), unpacked(y.as_buffer()), n))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = classes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("vec").alias("x"))
    two = classes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("y"))
    both = _some(pairs).select("a", "b").join(one, "a").join(two, "b").where(f"{DOWN} * na >= {UP} * nb and {DOWN} * nb >= {UP} * na")
    return both.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(run, "a long, b long")


def link_classes(df: DataFrame, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: id, n, sig), (classes: sig, n, vec, rep), (links between classes: a, b).

    The links connect exactly what all links of the join connect.
    """
    spark, keep = df.sparkSession, []
    docs = df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("t"))
    with arrow_rows(spark, ROWS):
        told = save(_summaries(docs), "summaries", keep)
    rows = told.where("kind = 0").select("id", "n", "sig")
    often = told.where("kind = 2").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * OFTEN).orderBy(F.desc("n"), "sig").limit(FREQUENT).collect()
    often.sort(key=lambda r: r["sig"] % (1 << 64))
    tok = np.array([r["sig"] for r in often], np.int64).astype(np.uint64)
    level = np.log2(np.array([r["n"] for r in often], float).clip(min=1)).astype(np.int8)
    reps = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"))
    vecs = told.where("kind = 1").groupBy("sig").agg(F.first("n").alias("n"), F.first("vec").alias("vec"))
    classes = save(vecs.join(reps, "sig"), "classes", keep)
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total * (DOWN - UP) / DOWN / BUCKET))
    with arrow_rows(spark, ROWS):
        cells = save(grouped(_prefixes(docs, buckets, (tok, level)), ["bucket"], _cells, "kind int, a long, b long, n long"), "cells", keep)
    # first links: every class against the smallest member that it shares most cells with
    star = cells.where("kind <> 1").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).groupBy("kind", "b").agg(F.max(F.struct("n", "a")).alias("m"))
    # these are only the first pairs to be tried, so those with little in common can wait
    star = star.join(classes.select(F.col("sig").alias("b"), F.col("n").alias("nb")), "b").where(f"m.n * {DOWN * DOWN} >= nb * {DOWN - UP}").select("b", "m.a")
    star = save(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars", keep)
    links = _verify(docs, save(_bounded(star, classes), "star", keep), classes, keep)
    member = save(cells.where("kind = 1").groupBy(F.col("a").alias("cell"), F.col("b").alias("sig")).agg(F.min("n").alias("place")), "members", keep)
    for k in range(ROUNDS):
        comps = save(components(links), "components", keep)
        known = classes.select("sig", "n").join(comps.select(F.col("v").alias("sig"), "root"), "sig", "left").select("sig", "n", F.coalesce("root", "sig").alias("comp"))
        at = save(member.join(known, "sig"), "at", keep)
        mixed_ = at.groupBy("cell").agg(F.min(F.struct("comp", F.xxhash64("sig", F.lit(k)).alias("h"), "sig", "n")).alias("c"), F.max("comp").alias("_hi")).where("c.comp < _hi").select("cell", "c")
        # components that meet in cells are tried by a pair of sets of like sizes, another one each time
        like = f"comp <> c.comp and {DOWN} * n >= {UP} * c.n and {DOWN} * c.n >= {UP} * n"
        met = at.join(mixed_, "cell").where(like).groupBy("comp", F.col("c.comp").alias("other"), F.col("c.sig").alias("a"), F.col("sig").alias("b")).agg(F.count(F.lit(1)).alias("m"))
        met = met.groupBy("comp", "other").agg(F.max_by(F.struct("a", "b"), F.struct("m", F.xxhash64("a", "b", F.lit(k)).alias("h"))).alias("p")).select("p.a", "p.b")
        met = save(met, "met", keep)
        more = save(_bounded(met, classes), "met", keep)
        new = _verify(docs, more, classes, keep)
        n = new.count()
        links = save(links.unionByName(new), "links", keep)
        if not n:
            break
    # what remains: pairs of different components within a cell, by trees
    comps = save(components(links), "components", keep)
    known = classes.select("sig", "n").join(comps.select(F.col("v").alias("sig"), "root"), "sig", "left").select("sig", "n", F.coalesce("root", "sig").alias("comp"))
    at = member.join(known, "sig")
    mixed_ = at.groupBy("cell").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("cell")
    # in the cell of the first shingle that sets a and b share they share no more than is left of either, so 4 n_a - 7 place_a >= 3 n_b
    left = (UP + DOWN) * (F.floor(F.col("place") * F.col("n") / PLACES)).cast("long")
    at = at.join(mixed_, "cell").withColumn("reach", DOWN * F.col("n") - left).drop("place")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(DOWN / UP)).cast("int")
    # sizes a quarter apart at most are in one band or in neighbours; each point also visits the next
    at = at.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("band", F.when(F.col("home"), band).otherwise(band + 1))
    both = [F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.max("home").alias("_home")]
    full = at.groupBy("cell", "band").agg(*both, F.min("n").alias("_least"), F.max("reach").alias("_most")).where("_lo < _hi and _home").select("cell", "band", "_least", "_most")
    at = save(at.join(full, ["cell", "band"]).where(f"reach >= {UP} * _least and _most >= {UP} * n").drop("_least", "_most", "reach"), "banded", keep)
    full = at.groupBy("cell", "band").agg(*both).where("_lo < _hi and _home").select("cell", "band")
    at = save(at.join(full, ["cell", "band"]), "banded", keep)
    firsts = at.groupBy("sig", "band").agg(F.slice(F.array_sort(F.collect_list("cell")), 1, FIRSTS).alias("firsts"))
    points = classes.select("sig", "vec").join(firsts, "sig")
    dealt = split_hot(at, ["cell", "band"], "sig", BLOCK).join(points, ["sig", "band"])
    more = save(grouped(dealt, ["cell", "band", "lo", "hi"], cell_pairs, "a long, b long").distinct(), "pairs", keep)
    return rows, classes, links.unionByName(_verify(docs, more, classes, keep)).distinct()


def join(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ident, n_shingles, component_id."""
    rows, classes, links = link_classes(df, ident, text)
    root = components(links).select(F.col("v").alias("sig"), "root")
    info = classes.select("sig", "rep").join(root, "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    low = info.groupBy("root").agg(F.min("rep").alias("component_id"))
    info = save(info.join(low, "root").select("sig", "component_id"), "told")
    linked = rows.where("n > 0").join(info, "sig").select("id", "n", "component_id")
    out = linked.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), "component_id")


def keep_one(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that with the smallest id, one without an id last. Rows that repeat an id, or have none, are rows like any other."""
    rows, row = rows_apart(df, ident)
    told = save(join(rows, row, text), "joined")
    if row == ident:
        return without(df, ident, told.where(F.col(ident) != F.col("component_id")).select(ident))
    of = rows.select(F.col(row).alias("_r"), F.col(ident).cast("long").alias("_id")).join(told.select(F.col(row).alias("_r"), F.col("component_id").alias("_c")), "_r")
    best = of.groupBy("_c").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_r")).alias("_b")).select(F.col("_b._r").alias(row))
    return rows.join(best, row, "left_semi").select(*own_columns(df))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n_shingles + nb.n_shingles - k)),
r(id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id)
SELECT n.doc_id, n.n_shingles, min(r.low) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY ALL"""
