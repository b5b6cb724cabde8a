"""Supervised subword embeddings in numpy: hashed word and character n-gram vectors, averaged, into a softmax.

A text's features are the n-grams of the bytes of its words (a word's edges count as bytes), and, for the
quality classifier, its words. A word that repeats the one before adds a mark there, and nothing else. Vectors and softmax are
trained jointly by stochastic gradient descent with per-row step sizes. As the softmax is linear in
the average, a trained model is folded into one number a bucket for scoring, which is then a
table look-up a feature, over whole texts, however long. Averages are over a whole text or, where a
few words decide, over each window of words, one of which begins at every word, the text's score being that of its highest window; such
a model is trained on whole texts first and then on the windows that it itself ranks highest.

Labels are learnt from a bounded sample (``TRAIN_ROWS`` rows a class, in the order of a hash of their ids,
and ``train_bytes`` bytes of text a class); class shares come from all labelled rows. Edge cases: a null
or empty text has no features and gets the share of label 1; with labels of one class, or none,
every text gets that class's share (0.5 for none); rows that repeat are scored each; a null id is not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lowered, mixed, quoted, text_slices, tidy, word_hashes

BITS, DIM = 18, 8
TRAIN_ROWS = 2000
#: Training documents that must hold a feature for it to get a vector; others add nothing to a score.
LEAST_DOCS = 8


@dataclass(frozen=True)
class Kind:
    """What a classifier looks at."""

    grams: tuple[int, ...] = (3, 4, 5)
    words: bool = False
    lower: bool = True
    #: Words a window holds; 0: averages are over whole texts.
    window: int = 0
    #: Blank features that every average also counts, so that a few chance features don't decide a short text.
    blanks: int = 100
    train_bytes: int = 8 << 20


_GAP = np.zeros(256, bool)
_GAP[[0, 32, 9, 10, 11, 12, 13]] = True
_AGAIN = int(mixed(np.array([77], np.uint64))[0] >> np.uint64(64 - BITS))


@dataclass
class Run:
    """A run of texts with an edge before, between and after them, its words and its units: texts, or words where averages are over windows."""

    data: np.ndarray
    solid: np.ndarray
    starts: np.ndarray
    #: Number of the word at a byte, minus one before the first.
    word: np.ndarray
    row: np.ndarray
    unit: np.ndarray
    #: First unit of each text, and the end.
    units: np.ndarray
    hashes: np.ndarray
    #: Whether a word differs from the one before it.
    fresh: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offs: np.ndarray, kind: Kind) -> Run:
        n = len(offs) - 1
        padded = np.insert(lowered(data) if kind.lower else data, offs, 32)
        solid = ~_GAP[padded]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        starts = np.flatnonzero(first)
        row = np.searchsorted(offs[:-1] + np.arange(n), starts, side="right") - 1
        word = np.cumsum(first, dtype=np.int32) - 1
        many = np.bincount(row, minlength=n)
        hashes = word_hashes(padded, starts, np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        if kind.window:
            return Run(padded, solid, starts, word, row, np.arange(len(starts)), np.concatenate([[0], np.cumsum(many)]), hashes, fresh)
        return Run(padded, solid, starts, word, row, row, np.arange(n + 1), hashes, fresh)

    def features(self, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(buckets, unit) of all features, in several lots."""
        data, solid = self.data, self.solid
        with np.errstate(over="ignore"):
            for n in sorted(kind.grams):
                m = len(data) - n + 1
                if m <= 0:
                    break
                ok = solid[1 : 1 + m].copy()
                for k in range(2, n - 1):
                    ok &= solid[k : k + m]
                at = np.flatnonzero(ok)
                word = self.word[at + 1]
                new = self.fresh[word]
                at, word = at[new], word[new]
                h = np.full(len(at), (2166136261 + n) & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h *= np.uint32(16777619)
                    h ^= data[at + k]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                yield h >> np.uint32(32 - BITS), self.unit[word]
            if kind.words and len(self.starts):
                yield (self.hashes[self.fresh] >> np.uint64(64 - BITS)).astype(np.uint32), self.unit[self.fresh]
                yield np.full(int((~self.fresh).sum()), _AGAIN, np.uint32), self.unit[~self.fresh]


def windows_of(units: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First units and ends of all windows of texts whose units begin at ``units``, one beginning at each unit, and the first window of each text.

    A text of fewer units than a window is one; one without any has none.
    """
    many = np.diff(units)
    n = np.where(many > 0, np.maximum(1, many - max(window, 1) + 1), 0)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(many)), n)
    a = units[text] + np.arange(len(text)) - first[text]
    return a, np.minimum(a + max(window, 1), units[text + 1]), first


def lots_of(col: pa.Array, kind: Kind) -> list[tuple[np.ndarray, np.ndarray]]:
    """For training, per text: buckets unit by unit, and the end of each unit."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b, data, offs in text_slices(col, 1 << 18):
        run = Run.of(data, offs, kind)
        lots = list(run.features(kind)) or [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        buckets, unit = (np.concatenate([x[k] for x in lots]) for k in (0, 1))
        order = np.lexsort((buckets, unit))
        buckets, ends = buckets[order], np.searchsorted(unit[order], np.arange(run.units[-1] + 1))
        for k in range(b - a):
            u = ends[run.units[k] : run.units[k + 1] + 1]
            out.append((buckets[u[0] : u[-1]], u[1:] - u[0]) if len(u) > 1 else (buckets[:0], np.zeros(0, np.int64)))
    return out


@dataclass
class Model:
    """The folded model: log odds of label 1 = bias + mean of ``table`` over the features and the blanks."""

    table: np.ndarray
    bias: float
    share: float

    def scores(self, col: pa.Array, kind: Kind) -> np.ndarray:
        out = []
        for a, b, data, offs in text_slices(col, 1 << 19):
            run = Run.of(data, offs, kind)
            size = int(run.units[-1])
            total, n = np.zeros(size), np.zeros(size)
            for buckets, unit in run.features(kind):
                total += np.bincount(unit, self.table[buckets], size)
                n += np.bincount(unit, minlength=size)
            x, y, first = windows_of(run.units, kind.window)
            if kind.window:
                total, n = (np.concatenate([[0.0], np.cumsum(v)]) for v in (total, n))
                total, n = total[y] - total[x], n[y] - n[x]
            odds = np.where(n > 0, self.bias + total / (n + kind.blanks), -np.inf)
            some = np.flatnonzero(np.diff(first) > 0)
            best = np.full(b - a, -np.inf)
            if len(some):
                best[some] = np.maximum.reduceat(odds, first[some])
            out.append(np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -500, 500))), self.share))
        return np.concatenate(out) if out else np.zeros(0)


class Trainer:
    """Vectors and softmax, and their steps."""

    def __init__(self, used: np.ndarray, blanks: int, seed: int = 7) -> None:
        self.rng = np.random.default_rng(seed)
        self.used, self.blanks = used, blanks
        self.vec = self.rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        self.out = self.rng.normal(0, 1, (DIM, 2)).astype(np.float32)
        self.off, self.seen, self.seen_out = np.zeros(2, np.float32), np.full(1 << BITS, 1e-8, np.float32), 1e-8

    def fit(self, bags: list[tuple[int, np.ndarray]], epochs: int, rate: float) -> None:
        """bags: label, buckets with repeats."""
        rows = []
        for y, at in bags:
            i, n = np.unique(at, return_counts=True)
            ok = self.used[i]
            if ok.any():
                rows.append((y, i[ok], (n[ok] / (len(at) + self.blanks)).astype(np.float32)))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for k in self.rng.permutation(len(rows)):
                y, at, w = rows[k]
                own = self.vec[at]
                mean = w @ own
                z = mean @ self.out + self.off
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1  # now the gradient of the loss by z
                back = self.out @ p
                self.seen[at] += w * w * float(back @ back)
                self.vec[at] = own - np.outer(step * w / np.sqrt(self.seen[at]), back)
                g = np.outer(mean, p)
                self.seen_out += float((g * g).sum())
                self.out -= step * g / np.sqrt(self.seen_out)
                self.off -= 0.05 * step * p

    def fold(self) -> tuple[np.ndarray, float]:
        return np.where(self.used, self.vec @ (self.out[:, 1] - self.out[:, 0]), 0).astype(np.float32), float(self.off[1] - self.off[0])


def _logit(x: float) -> float:
    return float(np.log(max(x, 1e-6) / max(1 - x, 1e-6)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float, kind: Kind) -> Model:
    """rows: label, buckets unit by unit, ends of units. share: of label 1 among all labelled rows."""
    rows = [r for r in rows if len(r[1])]
    ones = sum(r[0] for r in rows)
    if not 0 < ones < len(rows):
        return Model(np.zeros(1 << BITS, np.float32), _logit(share), share)
    docs = np.zeros(1 << BITS, np.int32)
    for _, at, _ in rows:
        docs[np.unique(at)] += 1
    t = Trainer(docs >= min(LEAST_DOCS, 1 + len(rows) // 50), kind.blanks)
    t.fit([(y, at) for y, at, _ in rows], 4, 3.0)
    prior = _logit(share) - _logit(ones / len(rows))
    if not kind.window:
        table, bias = t.fold()
        return Model(table, bias + prior, share)
    for _ in range(3):
        table, bias = t.fold()
        bags = []
        for y, at, ends in rows:
            odds, x, z = _odds(table, at, ends, kind)
            for k in _apart(odds, 1 if y else 3, kind.window):
                bags.append((y, at[x[k] : z[k]]))
        t.fit(bags, 3, 1.0)
    table, bias = t.fold()
    # the highest windows' odds, put on the scale of all documents by a ridge-bound logistic fit
    x = np.array([_odds(table, at, ends, kind)[0].max() + bias for _, at, ends in rows])
    y = np.array([r[0] for r in rows], float)
    weight = np.where(y > 0, share / ones, (1 - share) / (len(rows) - ones)) * len(rows)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 10 * (a - 1), (weight * (p - y)).sum()])
        v = weight * p * (1 - p) + 1e-9
        hess = np.array([[(v * x * x).sum() + 10, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        a, b = a - np.clip(d[0], -0.5, 0.5), b - np.clip(d[1], -2, 2)
    a = max(a, 0.05)
    return Model((table * a).astype(np.float32), float(a * bias + b), share)


def _odds(table: np.ndarray, at: np.ndarray, ends: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of a text: its odds, the place of its first feature and the end."""
    sums = np.concatenate([[0.0], np.cumsum(table[at], dtype=np.float64)])
    edges = np.concatenate([[0], ends])
    a, b, _ = windows_of(np.array([0, len(ends)]), kind.window)
    x, y = edges[a], edges[b]
    return np.where(y > x, (sums[y] - sums[x]) / (y - x + kind.blanks), -1e9), x, y


def _apart(odds: np.ndarray, n: int, window: int) -> list[int]:
    """The places of the highest odds, up to ``n`` of them, none within a window of a higher one."""
    out: list[int] = []
    odds = odds.copy()
    while len(out) < n and np.isfinite(odds).any():
        k = int(np.argmax(odds))
        out.append(k)
        odds[max(0, k - window + 1) : k + window] = -np.inf
    return out


def held_out(ident: str) -> Column:
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str, kind: Kind, ident: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learn ``label`` from rows of ``labels`` that aren't held out. Repeated labels of an id count as their largest."""
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & ~held_out(ident))
    known = known.groupBy(F.col(ident).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    order = F.xxhash64(F.col("_id"), F.lit(11))
    few = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(order, "_id").limit(rows)
        few = some if few is None else few.unionByName(some)
    some = docs.select(F.col(ident).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(few), "_id")  # 2 * rows rows at most
    run = Window.partitionBy("_y").orderBy(order, "_id", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = some.where(F.length("_t") > 0).withColumn("_run", F.sum(F.octet_length("_t")).over(run))
    some = some.where((F.col("_run") <= kind.train_bytes) | (F.col("_run") == F.octet_length("_t")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lots = lots_of(b.column("_t"), kind)
            yield pa.RecordBatch.from_pydict({"_id": b.column("_id"), "_y": b.column("_y"), "at": pa.array([x.tobytes() for x, _ in lots], pa.binary()), "ends": pa.array([x.astype(np.int64).tobytes() for _, x in lots], pa.binary())})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(i, y, at.as_buffer(), ends.as_buffer()) for b in batches for i, y, at, ends in zip(b.column("_id").to_pylist(), b.column("_y").to_pylist(), b.column("at"), b.column("ends"), strict=True)]
        got.sort(key=lambda r: (r[0], r[2].size, zlib.crc32(r[2])))
        own = train([(y, np.frombuffer(at, np.uint32), np.frombuffer(ends, np.int64)) for _, y, at, ends in got], share, kind)
        yield pa.RecordBatch.from_pydict({"table": pa.array([own.table.tobytes()], pa.binary()), "bias": pa.array([own.bias], pa.float64())})

    lots = some.select(F.col("_id").cast("long").alias("_id"), "_y", "_t").mapInArrow(tidy(extract), "_id long, _y int, at binary, ends binary")
    # in a task, as the sample is many times the model: the driver gets 1 MB
    told = lots.repartition(1).mapInArrow(tidy(learn), "table binary, bias double").collect()
    return Model(np.frombuffer(told[0]["table"], np.float32), told[0]["bias"], share) if told else train([], share, kind)


def score(docs: DataFrame, model: Model, kind: Kind, least: float, ident: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ident, held_out, score, predicted, and the columns of ``carry`` as ``c_<place>``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.table.tobytes(), model.bias, model.share))  # 1 MB, whatever the input
    cols = docs.select(F.col(ident).alias("id"), held_out(ident).alias("held_out"), F.col(text).alias("t"), *[F.col(quoted(c)).alias(f"c_{i}") for i, c in enumerate(carry)])
    extra = [f for f in cols.schema.fields if f.name.startswith("c_")]
    schema = T.StructType([T.StructField("id", cols.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias, share = sent.value
        own = Model(np.frombuffer(table, np.float32), bias, share)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(own.scores(b.column("t"), kind), pa.float64()), *[b.column(f.name) for f in extra]], names=["id", "held_out", "score", *[f.name for f in extra]])

    out = cols.mapInArrow(tidy(run), schema)
    return out.select(F.col("id").alias(ident), "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), *[f.name for f in extra])
