"""The conversation trie, the Merkle manifest and repeated passages against plain Python."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import merkle, prefix_trie, ranks, repeats

from ..oracle import differences, duck

SF = "/root/testdata/sf0.001"


def by_text(rows):
    return sorted(rows, key=str)


# --- exact places ------------------------------------------------------------------------------------


def test_places_are_exact(spark):
    """Of ids that crowd, repeat, lack or lie at the ends of a long, with parts of ten rows at most."""
    rng = random.Random(1)
    ids = [rng.choice([None, k, k * 10**15, 5, 5, 6, -(2**63), 2**63 - 1, -k]) for k in range(1500)]
    d = ranks.save(spark.createDataFrame([("a" if k % 3 else "b", x, k) for k, x in enumerate(ids)], "g string, id long, row long"), "t")
    got = ranks.exact_places(d, "g", [*ranks.long_keys(F.col("id")), F.col("row")], [F.col("id").asc_nulls_first(), "row"], most=10).collect()
    for g in "ab":
        own = sorted((r.place, r.id, r.row) for r in got if r.g == g)
        assert [(x, k) for _, x, k in own] == sorted(((r.id, r.row) for r in got if r.g == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [p for p, _, _ in own] == list(range(len(own)))
    words = [None, "", "a", "a\0", "ab", "é", "z" * 40, "z" * 41, *(rng.choice("xyz") * rng.randint(1, 9) for _ in range(300))]
    d = ranks.save(spark.createDataFrame([("g", w, k) for k, w in enumerate(words)], "g string, w string, row long"), "t")
    got = ranks.exact_places(d, "g", [*ranks.text_keys(F.col("w"), 41), F.col("row")], [F.col("w").asc_nulls_first(), "row"], most=5).collect()
    assert [(r.w, r.row) for r in sorted(got, key=lambda r: r.place)] == sorted(((r.w, r.row) for r in got), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))


# --- 11 ----------------------------------------------------------------------------------------------


def brute_trie(rows):
    def turns(rows):
        out = {}
        for c, t, r, x in rows:
            if c is not None:
                r, x = r or "", x or ""
                out.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
        return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in out.items()}

    own, built = turns(rows), {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    nodes, kids, sums, out = {}, {}, {}, []
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    for s in sorted(nodes, key=len, reverse=True):
        below, n = kids.get(s, []), len(nodes[s])
        sums[s] = (sum(sums[x][0] for x in below) or 1, sum(sums[x][1] for x in below) + ((n - 1) * len(s[-1][1].encode()) if s else 0))
        ends = ",".join(map(str, sorted(c for c in nodes[s] if len(built[c]) == len(s))))
        out.append((min(nodes[s]), len(s), min(nodes[s[:-1]]) if s else None, n, len(below), *sums[s], hashlib.sha256(ends.encode()).hexdigest()))
    return by_text(out)


def the_trie(df):
    c = F.col("conv")
    turns = prefix_trie.turns_of(df)
    return prefix_trie.trie(*prefix_trie.grafted(turns, F.crc32(c.cast("string").cast("binary")) % 9, c - c % 5))


def conversations():
    """Nulls, ties, turns that repeat, conversations that share much, copies, and some longer than a segment."""
    rng = random.Random(3)
    rows = [(None, 1, "x", "y")] * 3
    for c in range(-20, 150):
        for k in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            rows.append((c, rng.choice([None, k, k, k // 2]), rng.choice([None, "user", "bot"]), rng.choice([None, "", "a", "bé"])))
    for c in range(1000, 1050):
        rows += [(c, k, "user", f"t{k}") for k in range(rng.choice([0, 7, 8, 9, 16, 24, 33, 40]))]
    return rows + [(c, k, "user", f"t{k}") for c in range(2000, 2200, 5) for k in range(3)]


@pytest.mark.parametrize(("segment", "small"), [(256, 2000), (8, 2000), (8, 20), (256, 20)])
def test_trie(spark, monkeypatch, segment, small):
    """Whole, in segments of eight turns, and in ranges of few sequences, whose bounds cut nodes."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SMALL", small)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "conv": F.lit(2), "a.b": F.lit(3)})
    assert by_text(map(tuple, the_trie(df).collect())) == brute_trie(rows)


def test_trie_of_little_and_of_the_table(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert the_trie(spark.createDataFrame([], kind)).count() == 0
    for rows in ([(7, None, None, None)], [(1, 0, "a", "x" * 1_000_000)] * 2, [(None, 1, "a", "b")]):
        assert by_text(map(tuple, the_trie(spark.createDataFrame(rows, kind)).collect())) == brute_trie(rows)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_text(map(tuple, prefix_trie.query(spark, SF).collect())) == brute_trie(rows)


def test_runs_merge_in_order():
    rng = random.Random(2)
    for n in range(1, 9):
        items = sorted(([bytes([rng.randrange(3)]) for _ in range(rng.randint(0, 6))], k) for k in range(60))
        runs = [[] for _ in range(n)]
        for x in items:
            runs[rng.randrange(n)].append(x)

        def read(run):
            last = []
            for seq, k in run:
                yield seq, k, prefix_trie.shared(last, seq), {}
                last = seq

        got = list(prefix_trie.merged([read(r) for r in runs]))
        assert [(s, k) for _, s, k, _ in got] == items
        assert all(b[0] == prefix_trie.shared(a[1], b[1]) for a, b in itertools.pairwise(got))


# --- 12 ----------------------------------------------------------------------------------------------


def brute_manifest(rows):
    def H(*x):
        return hashlib.sha256("".join(x).encode()).hexdigest()

    def leaf(r):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def up(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    src, out = {}, []
    for r in rows:
        src.setdefault(r[1], []).append(r)
    names = sorted(src, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        src[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    tries = {s: up([leaf(r) for r in src[s]]) for s in names}
    top = up([tries[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(src[s]):
            steps = []
            for levels, at in ((tries[s], i), (top, k)):
                for row in levels[:-1]:
                    a = at - at % 3
                    steps.append((row[a:at], row[at + 1 : a + 3]))
                    at //= 3
            bent = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            f = leaf((*r[:4], r[4].replace("\n", "") if bent else r[4]))
            for left, right in steps:
                f = H(*left, f, *right)
            out.append((r[0], leaf(r), tries[s][-1][0], top[-1][0], H(*[x for pair in steps for side in pair for x in side]), f, f == top[-1][0]))
    return by_text(out)


FIELDS = "doc_id long, source string, lang string, n_chars int, text string"


def test_manifest(spark):
    rng = random.Random(1)
    rows = [(None if k % 7 == 0 else rng.choice([5, k, k - 40, -(2**63), 2**63 - 1, k * 10**15]), rng.choice([None, "", "a", "é", "b" * 30]), None if k % 3 else "en", k % 4 or None, rng.choice([None, "", "x\ny", "z"])) for k in range(3000)]
    rows += [(3, "a", "en", 1, "same")] * 2500 + [(4, f"s{k}", None, None, "l\n" * 100_000) for k in range(5)]  # equal rows are leaves each
    df = spark.createDataFrame(rows, FIELDS).withColumns({"grp": F.lit(1), "place": F.lit(1), "a.b": F.lit(1)})
    assert by_text(map(tuple, merkle.manifest(df, merkle.without_breaks).collect())) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 729, 730])
def test_manifest_of_few(spark, n):
    rows = [(k, "s", "en", 1, f"t\n{k}") for k in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, FIELDS), merkle.without_breaks)
    assert by_text(map(tuple, got.collect())) == brute_manifest(rows)
    assert n != 4 or all(r.verified for r in merkle.manifest(spark.createDataFrame(rows, FIELDS)).collect())


def test_manifest_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert by_text(map(tuple, merkle.query(spark, SF).collect())) == brute_manifest(rows)


# --- 13 ----------------------------------------------------------------------------------------------


def brute_repeats(texts, n=200):
    seen, out = {}, []
    data = [(t or "").encode() for t in texts]
    for k, b in enumerate(data):
        for i in range(len(b) - n + 1):
            seen.setdefault(b[i : i + n], []).append((k, i))
    gone = [np.zeros(len(b), bool) for b in data]
    for v in seen.values():
        for k, i in v if len(v) > 1 else ():
            gone[k][i : i + n] = True
    for b, g in zip(data, gone, strict=True):
        runs = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(g.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    return out


def passages():
    """Near and exact copies, passages of 195 to 206 bytes in many texts, periods, and texts too short or empty."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(200) for _ in range(6)]
    out = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 400, "abc" * 300]
    for _ in range(60):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "q", text(5)]) + t[i + rng.randint(0, 3) :]
        a = rng.randrange(len(t))
        out.append(text(rng.randint(0, 40)) + t[a : a + rng.randint(100, 700)] + text(rng.randint(0, 40)))
    shared = base[0][100:306]
    return out + [text(3) + shared[: 195 + k % 12] + text(3) for k in range(150)] + [base[1]] * 5


@pytest.mark.parametrize("most", [repeats.MOST, 8])
def test_repeats(spark, most):
    """With collections as they are, and so small that passages in many texts are split again and again."""
    texts = passages()
    df = spark.createDataFrame([(k if k % 5 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, core int").withColumns({"t": F.lit(1), "spans": F.lit(1), "a.b": F.lit(1)})
    got = repeats.removals(df, most=most).collect()
    assert by_text((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == by_text(brute_repeats(texts))
    assert sum(r.n_removed for r in got) > 20_000
    assert all(sum(x.e - x.s for x in r.removed) == r.n_removed for r in got)
    assert repeats.removals(df.limit(0)).count() == 0


def test_repeats_sql_and_long_texts(spark):
    assert differences(repeats.query(spark, SF), repeats.SQL, duck(SF)) == ""
    rng = np.random.default_rng(0)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    long = letters[rng.integers(0, 27, 3_300_000)].tobytes().decode()
    # passages on both sides of where blocks of a long text meet
    texts = [long, *(long[x - 150 : x + 150] for x in (1 << 20, 2 << 20, 3 << 20)), "a" * 300_000, long[5000:5199]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (3_300_000, 900, 3), **{k: (300, 300, 1) for k in (1, 2, 3)}, 4: (300_000, 300_000, 1), 5: (199, 0, 0)}


def test_columns_against_all_pairs():
    """Windows of aligned passages that recur, by comparing each passage with each."""
    rng = random.Random(8)
    for _ in range(6):
        core = "".join(rng.choice("ab") for _ in range(repeats.GRAM))
        rows = []
        for g in range(4):
            sides = [("".join(rng.choice("ab") for _ in range(repeats.REACH - 1)), "".join(rng.choice("ab") for _ in range(repeats.SPAN - repeats.GRAM))) for _ in range(3)]
            for _ in range(9):
                (left, right), near = rng.choice(sides), rng.randint(0, 100)
                k, j = rng.randrange(len(left)), rng.randrange(len(right))
                left, right = rng.choice([left, left[:k] + "c" + left[k + 1 :]]), rng.choice([right, right[:j] + "d" + right[j + 1 :]])
                far = rng.randint(near, repeats.REACH - 1)
                rows.append((g, near, far, (left + core + right).encode()[repeats.REACH - 1 - far : len(left) + repeats.SPAN - near]))
        low, high = repeats.columns(*(np.array([r[k] for r in rows]) for k in (0, 1, 2)), [r[3] for r in rows])
        for i, (g, near, far, b) in enumerate(rows):
            hit = [x for x in range(near, far + 1) for j, o in enumerate(rows) if j != i and o[0] == g and o[1] <= x <= o[2] and b[far - x : far - x + repeats.SPAN] == o[3][o[2] - x : o[2] - x + repeats.SPAN]]
            assert (low[i], high[i]) == ((min(hit), max(hit)) if hit else (-1, -1))
