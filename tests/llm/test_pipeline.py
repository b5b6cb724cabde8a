"""The pipeline's stages, and its run against plain Python on the same documents."""

import collections
import hashlib
import inspect
import math
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tallygrove.llm import decontaminate, quality, token_store
from tallygrove.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import brute_join

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5
    assert [list(inspect.signature(f).parameters) for _, f in corpus_pipeline.STAGES] == [["spark", "docs", "sf_dir"]] * 5
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) == 13


def brute_mix(rows):
    """(id, text) of the mix: sources weigh 5, 2, 1 by name, caps of twice their size, whole epochs and a cut in the order of a hash."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, live, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while live:
        level = left / sum(weight[s] for s in live)
        over = {s for s in live if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            target |= {s: level * weight[s] for s in live}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left, live = left - sum(target[s] for s in over), live - over
    out = []
    for s, size in sizes.items():
        budget = math.floor(target[s] + 1e-9)
        whole, rest = divmod(budget, size) if size else (0, 0)
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}\x1f{r[1] or ''}".encode()).hexdigest()):
            words = list(WORD.finditer(t or ""))
            out += [(i, t)] * (whole if words else 0)
            if words and rest > 0:
                n = min(rest, len(words))
                out.append((i, t if n == len(words) else t[: words[n - 1].end()]))
                rest -= n
    return sorted(out)


def test_odd_tables(spark, tmp_path):
    """Nulls, ids that repeat, equal rows, no rows, and columns with the stages' own names."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, _k int, _gone string, score double, row int, size long, shard int, component_id long, `a.b` int, `c``d` string"
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").where("n_chars > 600").limit(6).collect()]
    texts = [(1, good[0]), (1, good[1]), (None, good[2]), (None, good[3]), (2, good[0]), (5, good[4]), (5, good[4]), (6, None), (7, ""), (None, None), (8, good[5] * 40)]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "web", None, k, "g", 0.5, 1, 2, 3, 4, 5, "x") for k, (i, t) in enumerate(texts)]
    for name, some in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, kind).write.parquet(f"{d}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        cols = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = spark.createDataFrame(stage(spark, docs, d).collect(), None if k == 4 and some else docs.schema if k < 4 else "doc_id long, start long, n_tokens long, ids_crc32 long")
            assert k == 4 or docs.columns == cols
            if k == 1 and some:  # groups go by row: what shares an id but no words stays
                kept = collections.Counter((r.doc_id, r.text) for r in docs.collect() if r.text)
                assert kept == collections.Counter([(1, good[0]), (1, good[1]), (None, good[2]), (None, good[3]), (5, good[4]), (8, good[5] * 40)])
        assert corpus_pipeline.run(spark, d).count() == docs.count() and (docs.count() > 0) == bool(some)


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        rows = out.collect()
        before = {r.doc_id: r.text for r in rows}
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
        after = [(r.doc_id, r.text) for r in out.collect()]
        if k == 0:
            good = {r.doc_id for r in quality.assess(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
            assert dict(after) == {i: t for i, t in before.items() if i in good}
        if k == 1:
            assert {i for i, _ in after} == {i for i, _, c in brute_join(list(before.items())) if i == c}
        if k == 2:
            gone = {r.doc_id for r in decontaminate.find(spark.createDataFrame(list(before.items()), "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {i for i, _ in after} == set(before) - gone
        if k == 3:
            assert sorted(after) == brute_mix([(r.doc_id, r.text, r.source) for r in rows])
        out = spark.createDataFrame(out.collect(), docs.schema)
    n = out.count()
    last = corpus_pipeline.STAGES[4][1](spark, out, SF).collect()
    tok = Tokenizer.from_file(token_store.tokenizer_path())
    ids = {t: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in {r.text for r in out.collect()}}
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in last) == sorted((r.doc_id, len(ids[r.text]), zlib.crc32(ids[r.text].tobytes())) for r in out.collect())
    at = 0
    for r in sorted(last, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(last, key=lambda r: r.start)] == sorted(r.doc_id for r in last)
    assert corpus_pipeline.run(spark, SF).count() == n
