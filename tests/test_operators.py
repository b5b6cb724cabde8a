import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallygrove.functions import similarity
from tallygrove.functions import text as TX
from tallygrove.functions.lexicon import SUBJECT_EN
from tallygrove.operators import enrich, extract, fit, fuzzy, learn, search, signals, tables, views
from tallygrove.plans import ingest as ingest_queries
from tallygrove.plans import records as record_queries
from tallygrove.plans import texts
from tallygrove.sources import documents as D
from tallygrove.streaming.ingest import ingest

DOC = {"round": "R1", "archetype": "criteria", "programs": [
    {"tcas_code": "A1", "program_name_th": "หนึ่ง", "seats": 5, "weighted_components": [{"category": "A-Level", "test_or_subject_code": "61/64", "weight_percent": 30}, {"test_or_subject_code": "61", "weight_percent": "20"}, {"test_or_subject_code": "30", "weight_percent": "20%"}]},
    {"tcas_code": "A1", "program_name_th": "again", "seats": 9},
    {"tcas_code": "", "program_code": "P2", "faculty_major_th": "สอง", "gpax_min": "2.75", "subject_codes": ["64", "x", "99"], "weighted_subjects": [{"subject_code": "64", "weight_percent": "50"}]}]}


def test_documents_to_tables(spark, tmp_path):
    for name in ("001_R1.json", "001_R1_admission.json"):
        (tmp_path / name).write_text(json.dumps(DOC, ensure_ascii=False))
    (tmp_path / "002_R3.json").write_text(json.dumps({"items": [{"item_no": "1"}]}))
    docs = D.read_documents(spark, str(tmp_path))
    assert {(r.university_id, r["round"]) for r in docs.collect()} == {("001", "R1"), ("002", "R3")}
    rows = D.programs_of(docs)
    uni = spark.createDataFrame([("001", "One")], "id string, name_en string")
    t = tables.relational(rows, uni)
    prog = {r.tcas_code: r for r in t["program"].collect()}
    assert set(prog) == {"A1", "P2"} and prog["A1"].seats == 5 and prog["A1"].id == 1 and prog["P2"].min_gpax == 2.75
    parts = {(r.program_id, r.subject_code): r.weight_percent for r in t["program_subject"].collect()}
    assert parts == {(1, "61/64"): 30.0, (1, "61"): 20.0, (1, "30"): None, (2, "64"): 50.0, (2, "x"): None, (2, "99"): None}
    assert t["subject"].count() == len(set(SUBJECT_EN) | {"61/64", "30", "x", "99"})
    cols = tables.normalise_program(F.col("program"), F.col("program.subject_codes").isNotNull())
    norm = {r.tcas_code: r for r in rows.where("pos <> 1").select(*[c.alias(n) for n, c in cols.items()]).collect()}
    assert norm["A1"].subject_codes == ["61", "64"] and norm["A1"].weights == {"61": 50.0, "64": 30.0}
    assert norm["P2"].subject_codes == ["64", "99"] and norm["P2"].weights == {}
    D.write_tables(t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/program")).count() == 2


def test_fit_edges(spark):
    comps = spark.createDataFrame([(1, "61", 50.0), (1, "62", 50.0), (2, "GPAX", 100.0), (3, "61", 0.0), (4, "61", None), (5, "99", 10.0)], "pid int, code string, weight double")
    got = fit.fit(comps, fit.parse_scores(spark, ["61:80", "GPAX:4", "bad", "62:x"])).collect()
    assert [(r.pid, r.fit, r.coverage) for r in got] == [(1, 80.0, 0.5)]
    assert fit.parse_scores(spark, ["GPAX:3.0"]).first().score == 75.0


def test_search(spark):
    rows = [(1, "Chulalongkorn University", "Engineering physics", ["61", "64"], 120, "R1", 2.5), (2, "Chulalongkorn University", "Arts", ["82"], 300, "R1", None), (3, "Other", "Engineering", ["61", "64"], None, "R2", 3.0)]
    p = spark.createDataFrame(rows, "ord int, university string, name string, codes array<string>, seats int, round string, min_gpax double")
    sig, top = search.search(p, "engineering at chula with physics more than 100")
    assert sig["subjects"] == ["64"] and [r.ord for r in top.collect()] == [1]
    _, every = search.search(p, "")
    assert [r.ord for r in every.collect()] == [2, 1, 3]
    log = signals.signals_of(spark.createDataFrame([("math at cmu",), (None,), ("math at cmu",)], "text string"))
    assert [r.signals.university for r in log.where("text is not null").collect()] == ["Chiang Mai"] * 2


def test_extract(spark):
    wide = ["", "001", "Eng", "2.5", "20", "-", "", "", "", "", "", "", "", "", "", "", "61 / Math", "30", "-", "", "", "", "", "", "", "50", "12"]
    md = "\n".join(["x", "สาขาวิชา ก ข TCAS CODE: AB12 จำนวนรับตามแผน 30", "รหัสวิชา 61 รหัสวิชา 99", *["รหัสวิชา 62"] * 45, "1. รับสมัคร a", "| " + " | ".join(wide) + " |", "| " + " | ".join(wide[:20]) + " |", "| 12345678 | ชื่อยาว | 25 |"])
    d = spark.createDataFrame([("d", md), ("e", "")], "doc_id string, text string")
    c = extract.parse_criteria(d).first()
    assert (c.tcas_code, c.seats, c.subject_codes) == ("AB12", 30, ["61", "62"])
    m = extract.parse_matrix(d).collect()
    assert len(m) == 1 and m[0].seats == 12 and [(x.category, x.code, x.weight) for x in m[0].weighted_components] == [("GPAX", None, 20.0), ("A-Level", "61", 30.0)]
    assert [(r.tcas_code, r.program_name_th, r.seats) for r in extract.parse_index(d).collect()] == [("12345678", "ชื่อยาว", 25)]
    assert extract.parse_list(d).first().item_no == "1"
    assert {r.doc_id: (r.archetype, r.n) for r in extract.best_parse(d).collect()} == {"d": ("criteria", 1), "e": ("criteria", 0)}
    pages = spark.createDataFrame([("pre<!-- page 1 -->a<!-- page 2 -->b",)], "t string")
    assert pages.select(F.size(extract.split_pages(F.col("t"))), F.size(extract.chunk_pages(F.col("t"), 2))).first() == Row(3, 2)
    cmp = extract.compare(spark.createDataFrame([("1", 5), ("2", None)], "k string, v int"), spark.createDataFrame([("2", 0), ("3", 1)], "k string, v int"), "k", "v").first()
    assert tuple(cmp) == (1, 1, 1, 1)


def test_enrich(spark):
    rows = spark.createDataFrame([("u", "A", "one two", None), ("u", "B", "three", None), ("u", "C", "four", 4)], "u string, code string, name string, seats int")
    cat = spark.createDataFrame([(1, "u", "A", "zzz", 0), (2, "u", "Z", "One Two", 7), (3, "u", "Y", "threee", 9)], "ord int, u string, code string, name string, seats int")
    assert {r.code: r.seats for r in enrich.fill_exact(rows, cat, "u", "code", "name", "seats").collect()} == {"A": 7, "B": None, "C": 4}
    assert {r.code: r.seats for r in enrich.fill_fuzzy(rows, cat, "u", "name", "seats").collect()} == {"A": 7, "B": 9, "C": 4}


def test_learn(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], 3), ("b", [0.9, 0.1], 5), ("c", [0.0, 1.0], 1)], "l string, v array<double>, n int")
    got = {r.label: (r.cluster, r.representative) for r in learn.cluster_labels(v, "l", "v", "n").collect()}
    assert got["a"] == got["b"] and got["a"][1] == "b" and got["c"][1] == "c"
    d = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert sorted(tuple(r) for r in learn.standardise(d, ["x", "y"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_fuzzy_lexicon_takes_every_token(spark, tmp_path):
    lex = [(o, k, v) for o, k, v in texts.LEXICON]
    said = "The, der. que, éque qué tökén token1 token-2 passw0rd the_ 1the licensed\nthé the der"
    spark.createDataFrame([(1, said), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for t in set(said.lower().replace("\n", " ").split(" ")):
        near = [(far(t, k), o, v) for o, k, v in lex if t == k or (len(t) >= 4 and far(t, k) <= 1)]
        if near:
            want[t] = min(near)[2]
    got = {r.token: r.label for r in texts.lexicon_fuzzy_documents(spark, str(tmp_path)).collect()}
    assert got == want and {"the,", "der.", "éque", "token1", "passw0rd"} <= set(got) and "tökén" not in got


def average_linkage(vecs: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers of unit vectors, by one merge after the other of the least distance."""
    n = len(vecs)
    d = 1 - vecs @ vecs.T
    np.fill_diagonal(d, np.inf)
    size, owner = np.ones(n), np.arange(n)
    while True:
        i, j = sorted(divmod(int(d.argmin()), n))
        if not d[i, j] <= cut:
            return np.unique(owner, return_inverse=True)[1]
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        owner[owner == j] = i


def test_linkage_by_rounds_is_that_by_single_merges(spark):
    rng = np.random.default_rng(6)
    far = np.eye(12)[rng.integers(0, 12, 300)]
    v = far + rng.normal(size=far.shape) * 0.2
    v[7] = v[3]  # equal ones, and one without a direction
    v[9] = 0
    d = spark.createDataFrame([(str(k), [float(x) for x in r], 1) for k, r in enumerate(v)], "l string, v array<double>, n int")
    order = sorted(range(300), key=str)
    unit = v[order] / np.maximum(np.linalg.norm(v[order], axis=1), 1e-300)[:, None]
    want = {str(k): int(c) for k, c in zip(order, average_linkage(unit, 0.4), strict=True)}
    for block in (1000, 70):
        got = learn.cluster_labels(d, "l", "v", "n", block=block).collect()
        assert {r.label: r.cluster for r in got} == want and 12 < len(set(want.values())) < 290
    assert learn.cluster_labels(d.limit(0), "l", "v", "n").count() == 0


def test_similar_names_are_all_found(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["engineering", "engineeringphysics", "x", "ภาษาไทย"]

    def bent(x: str) -> str:
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(x) + 1)
            x = x[:k] + rng.choice(["", "a", "e", "z"]) + x[k + rng.randint(0, 1) :]
        return rng.choice(["", "", "cd", "aabb"]) + x

    left = [(k % 2, bent(rng.choice(base))) for k in range(150)]
    right = [(k % 2, bent(rng.choice(base))) for k in range(150)]
    a, b = (spark.createDataFrame(sorted(set(x)), "u int, name string") for x in (left, right))
    every = {(u, x, y): similarity.wratio(x, y) for u, x in set(left) for w, y in set(right) if u == w}
    for least in (90.0, 80.0, 70.0):
        got = {(r.u, r.name, r.best): r.score for r in fuzzy.similar(a, b, "u", least).collect()}
        assert got == {k: s for k, s in every.items() if s >= least} and got
    # what has to be scored is few of all pairs
    assert fuzzy.candidates(a, b, "u", 90.0).count() < 0.2 * len(every)
    for most in (1, 2, 3):
        got = {(r.u, r.name, r.best) for r in fuzzy.edit_pairs(a, b, "u", most).collect()}
        assert got == {(u, x, y) for u, x, y in every if edits(x, y) <= most}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_seats_are_filled_within_the_institution(spark):
    """The most similar name of the same institution, of those with seats, from a score of 90."""
    rows = [(1, "u", "Computer Engineering", None), (2, "u", "Arts", None), (3, "v", "Computer Enginering", None), (4, "u", "Law", 7), (5, "u", "computerengineerin", None), (6, None, "Law", None)]
    cat = [(1, "u", "computer engineering", 30), (2, "u", "Computer Engineerings", 99), (3, "v", "Arts", 5), (4, "u", "ARTSS", None), (5, "u", "computer engineering", 31), (6, "u", "Law", 8)]
    r = spark.createDataFrame(rows, "id int, block string, name string, seats int")
    c = spark.createDataFrame(cat, "ord int, block string, name string, seats int")
    got = {x.id: x.seats for x in enrich.fill_fuzzy(r, c, "block", "name", "seats").collect()}
    assert got == {1: 31, 2: None, 3: None, 4: 7, 5: 31, 6: None}


def test_splits_and_codes_without_one_task(spark):
    rows = [("a" if k < 57 else None if k < 60 else "b", k // 2) for k in range(100)]
    got = learn.stratified_split(spark.createDataFrame(rows, "l string, k int"), "l", ["k"]).collect()
    assert len(got) == 100
    for label in ("a", "b", None):
        own = sorted((r.k, not r.is_train) for r in got if r.l == label)
        n = int(len(own) * 0.8)
        assert sum(not x for _, x in own) == n and max(k for k, x in own if not x) <= min([k for k, x in own if x], default=99)
    got = learn.encode_label(spark.createDataFrame(rows, "l string, k int"), "l")
    assert {(r.l, r.label_id) for r in got.collect()} == {("a", 0), ("b", 1)} and got.count() == 97


def test_agglomerative_clusters_the_vectors(spark):
    sf = "/root/testdata/sf0.001"
    got = ingest_queries.agglomerative(spark, sf).collect()
    ids = {str(r.vec_id) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {r.label for r in got} == ids and len(got) == len(ids)


def test_linkage_of_copies_takes_few_rounds_and_leaves_no_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(learn, "checkpointed", lambda df: written.append(tables.checkpointed(df)) or written[-1])
    v = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]]
    d = spark.createDataFrame([(f"{k:02}", v[k % 3]) for k in range(45)] + [("z1", [0.0, 0.0]), ("z2", [0.0, 0.0])], "l string, v array<double>")
    got = {r.label: r.first for r in learn.linkage(d, "l", "v", 0.3, block=2).collect()}
    assert got == {f"{k:02}": "00" if k % 3 < 2 else "02" for k in range(45)} | {"z1": "z1", "z2": "z2"}
    there = lambda t: any(os.path.exists(f.removeprefix("file://")) for f in t.inputFiles())
    assert len(written) < 15 and sum(map(there, written)) <= 5


def test_many_rows_are_learnt_in_blocks(spark):
    rng = np.random.default_rng(3)
    m = learn.Perceptron([2, 4, 3, 3])
    x, y, n = rng.normal(size=(7, 2)), rng.integers(0, 3, 7), rng.integers(1, 4, 7).astype(float)
    _, g = m.slope(x, y, n)
    for k in range(len(m.w)):  # the gradient is that of differences
        m.w[k] += 1e-5
        up = m.slope(x, y, n)[0]
        m.w[k] -= 2e-5
        assert abs((up - m.slope(x, y, n)[0]) / 2e-5 - g[k]) < 1e-6
        m.w[k] += 1e-5
    assert np.allclose(m.slope(np.repeat(x, n.astype(int), axis=0), np.repeat(y, n.astype(int)), np.ones(int(n.sum())))[1], g)
    p = rng.normal(size=(400, 2))
    rows = [(float(a), float(b), int(a > 0) + 2 * int(b > 0), k % 5 > 0) for k, (a, b) in enumerate(p)]
    d = spark.createDataFrame(rows, "a double, b double, y int, is_train boolean")
    got = learn.classify(d, ["a", "b"], "y", (8,), 60, few=100)
    assert set(got.columns) == set(learn.classify(d, ["a", "b"], "y", (8,), 2).columns)
    got = got.collect()
    assert len(got) == 80 and sum(r.y == r.prediction for r in got) >= 74


def test_learning_queries_do_the_whole_job(spark, monkeypatch):
    d = spark.createDataFrame([(k, [float(k % 2), 1000.0 * (k * 7 % 40)]) for k in range(40)], "k int, v array<double>")
    for scale, n in ((False, 2), (True, 1)):
        got = {r.k: r.topic for r in learn.kmeans(d, vec="v", k=2, starts=10, scale=scale).collect()}
        assert len({got[k] for k in range(0, 40, 2)}) == n
    asked = {}
    monkeypatch.setattr(learn, "kmeans", lambda df, **kw: asked.update(kw) or df.withColumn("topic", F.lit(0)))
    monkeypatch.setattr(learn, "classify", lambda df, f, label, hidden=(64, 32), rounds=100: asked.update(hidden=hidden, rounds=rounds) or df.withColumn("prediction", F.lit(0)))
    ingest_queries.kmeans_topics(spark, "/root/testdata/sf0.001")
    ingest_queries.mlp_classify(spark, "/root/testdata/sf0.001")
    assert (asked["starts"], asked["scale"], asked["hidden"], asked["rounds"]) == (10, True, (64, 32), 400)


def test_views(spark):
    names = F.create_map(F.lit("61"), F.lit("Math"))
    assert spark.range(1).select(views.display_codes(F.array(F.lit("61"), F.lit("99")), names)).first()[0] == "Math, 99"
    assert [views.route(x) for x in ("compare", "career", None)] == ["comparison", "notice", "hits"]


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("001:R1\n\n 002:R3:4 \n")
    assert [tuple(r) for r in D.read_targets(spark, str(tmp_path / "t.txt")).collect()] == [("001", "R1", None), ("002", "R3", 4)]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/a.pdf").write_bytes(b"ok")
    (tmp_path / "bin/b.pdf").write_bytes(b"\xff")
    got = {r.path[-5:]: (r.text, (r.error or "")[:7]) for r in D.read_binary(spark, str(tmp_path / "bin"), lambda b: b.decode()).collect()}
    assert got == {"a.pdf": ("ok", ""), "b.pdf": (None, "Unicode")}
    chunks = spark.createDataFrame([("1", 0, "a"), ("1", 1, "")], "id string, chunk int, text string")
    rows = D.extract_with(chunks, lambda t: [{"code": t[0]}], "code string").collect()
    assert sorted(((r.code, r.error) for r in rows), key=str) == [("a", None), (None, "string index out of range")]
    for only in ([("1", 1, ""), ("2", 0, None)], [("1", 0, "a")], []):  # a batch that fails whole, one that doesn't, none
        some = spark.createDataFrame(only, "id string, chunk int, text string").coalesce(1)
        rows = D.extract_with(some, lambda t: [{"code": t[0], "n": 1, "other": 2}] * 2, "code string, n int").collect()
        assert [(r.id, r.chunk, r.code, r.n, r.error is None) for r in rows] == [x for i, k, t in only for x in ([(i, k, t[0], 1, True)] * 2 if t else [(i, k, None, None, False)])]
    rows = D.extract_with(chunks, lambda t: [{"code": "a", "n": "many"}], "code string, n int").collect()
    assert [(r.code, r.n) for r in rows] == [(None, None)] * 2 and all(r.error for r in rows)
    df = spark.createDataFrame([("001", "R1", 1), ("002", "R1", 2)], "university_id string, round string, n int")
    D.write_partitioned(df, str(tmp_path / "p"))
    D.write_partitioned(df.where("n = 2").withColumn("n", F.lit(3)), str(tmp_path / "p"))
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "p")).collect()) == [1, 3]


def test_sinks_and_readers(spark, tmp_path):
    rows = spark.createDataFrame([("ก", 1, None), ("b", 2, "x,y")], "name string, n int, t string")
    D.write_csv(rows, str(tmp_path / "c"), bom=True)
    told = sorted("".join(p.read_text(encoding="utf-8") for p in (tmp_path / "c").glob("*.csv")).splitlines())
    assert {"\ufeffname,n,t", "ก,1,", 'b,2,"x,y"'} == set(told)
    assert [D.write_version(rows, str(tmp_path / "v"), k) for k in (1, 2)] == [f"{tmp_path}/v/v00000{k}" for k in (1, 2)]
    assert spark.read.parquet(f"{tmp_path}/v/v000001").count() == 2
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        D.write_version(rows, str(tmp_path / "v"), 2)
    hits = spark.createDataFrame([("u", 5, {"61": 30.0}, ["61"])], "university string, seats int, weights map<string,double>, subject_codes array<string>")
    D.write_search_rows(hits, str(tmp_path / "s"))
    got = D.read_search_rows(spark, str(tmp_path / "s")).first()
    assert (got.university, got.seats, got.weights, got.subject_codes, got.topic) == ("u", 5, {"61": 30.0}, ["61"], None)
    (tmp_path / "t").mkdir()
    (tmp_path / "t/001_R2_x.md").write_text("a\nก\n", encoding="utf-8")
    assert [tuple(r) for r in D.read_texts(spark, str(tmp_path / "t")).collect()] == [("001_R2_x.md", "001", "R2", "a\nก\n")]
    parts = spark.createDataFrame([("001", "R1", 1), ("001", "R2", 2), ("002", "R1", 3)], "university_id string, round string, n int")
    D.write_partitioned(parts, str(tmp_path / "p"))
    junk = parts.where("n > 1").unionByName(spark.createDataFrame([("009", "R9", 0)], parts.schema))
    assert D.delete_partitions(junk, str(tmp_path / "p")) == 2
    assert [r.n for r in spark.read.json(str(tmp_path / "p")).collect()] == [1]


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(TX.encode_path(F.lit("https://h.th/ก ข/a+b.pdf?x=1"))) == "https://h.th/%E0%B8%81%20%E0%B8%82/a%2Bb.pdf"
    assert one(search.runtime_name(F.lit("en"), F.lit(None), F.lit("ไทย"))) == "en  ไทย"
    assert [one(TX.title(F.lit(x))) for x in ("", "aB c-d'e 1f", "ñandú")] == [x.title() for x in ("", "aB c-d'e 1f", "ñandú")]
    xs = [0.0, 1.0, -12.5, 100000.0, 1e6, 123456.7, 0.0001, 0.00001234, 2.5e-9, 999999.5, 33.333333333, 1e100, 64076450.0, 64076550.0]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(TX.general(F.col("x"))).collect()] == [f"{x:g}" for x in xs]
    assert one(TX.general(F.lit(None).cast("double"))) is None
    assert one(TX.tidy_lines(F.lit(" a \t\n\n\n\nb\n \n\n\nc\n\n"))) == "a\n\nb\n\nc"


def test_long_lexicons_and_zero_vectors(spark):
    lex = spark.createDataFrame([(k, f"k{k}!", f"l{k % 3}") for k in range(300, 0, -1)], "ord int, kw string, label string")
    d = spark.createDataFrame([(1, "k299! k7!"), (2, "none"), (3, None)], "id int, t string")
    for some in (lex, lex.where("ord in (7, 299)")):
        assert [tuple(r) for r in signals.lexicon_match(d, "id", "t", some).collect()] == [(1, "l1", 7)]
    assert signals.lexicon_match(d, "id", "t", lex.limit(0)).count() == 0
    c = spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.0, 3.0]), (5, [0.0, 0.0])], "label int, centroid array<double>")
    v = spark.createDataFrame([(1, [5.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.5])], "id int, v array<double>")
    assert {r.id: r.label for r in learn.nearest(v, c, "id", "v", "label").collect()} == {1: 2, 2: 1, 3: 1, 4: 1}


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(1, k), (k + 2, k)], "key int, v int").coalesce(1).write.mode("append").parquet(str(src))
        for _ in range(2):
            ingest(spark, str(src), "key int, v int", ["key"], ["v"], sink, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.key, r.v) for r in spark.read.parquet(sink).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_surrogate_is_dense(spark):
    d = tables.surrogate(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), ["x"])
    assert [(r.x, r.id) for r in d.orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]


def test_documents_are_bounded_by_their_keys(spark):
    """A document of an institution and round doesn't grow with the table; programs are numbered through its documents."""
    sf = "/root/testdata/sf0.01"
    docs = record_queries.raw_documents(spark, sf, 300)
    assert docs.agg(F.max(F.size("programs"))).first()[0] <= 300 < docs.count()
    told = lambda d: {(r.path, r.pos): (r.n, r.k) for r in d.select("path", "pos", F.col("program.program_name_th").alias("n"), F.size("program.weighted_components").alias("k")).collect()}
    whole, cut = told(record_queries.raw_programs(spark, sf)), told(record_queries.raw_programs(spark, sf, 300))
    assert whole == cut and len(whole) == spark.read.parquet(f"{sf}/part.parquet").count()
