"""Segmentation and signals as plans against plain Python on the same texts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrove.functions import lexicon as L
from tallygrove.functions import similarity
from tallygrove.operators import search, segment, signals

from . import typed


def texts(n: int) -> list[str | None]:
    rng = random.Random(6)
    terms = [k for t in (L.UNI, L.SUBJ, L.ROUND, L.FACULTY, L.MAJOR, L.FORMAT, L.INTENT, L.ABBREV) for k in t] + list(L.CORE) + sorted(L.STOP)
    more = ["phisics", "mathss", "chulalongkon", "more than 100", "over 5 seats", "> 30", "มากกว่า 20", "GPAX 2.75", "gpax: 3", "เกรด3.5", "international", "นานาชาติ", "กขค", "ะาิ", "ก", "๑๒", "12.5", "x1", "!!", "  ", "\n", "é", "ＧＰＡＸ　２", "_", "²"]
    out: list[str | None] = ["", None, " ", "phisics and math, more than 100 seats at chula", "วิศวกรรมคอมพิวเตอร์ รอบ 2 GPAX 2.75 international"]
    for _ in range(n):
        out.append("".join(rng.choice(terms if rng.random() < 0.7 else more) + rng.choice(["", "", " ", " "]) for _ in range(rng.randint(1, 7))))
    return out


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts(250))], "id int, text string, tokens int")


def test_segmentation(spark, some):
    words = spark.createDataFrame([(w,) for w in [*signals.own_words(), None, "x"]], "word string")
    got = {r.id: r.tokens for r in segment.segment(some.select("id", "text"), "id", "text", words).collect()}
    want = {r.id: typed.segmenter()(r.text or "") for r in some.collect()}
    assert got == want
    # without a word of the dictionary a run is one piece, and a long one is cut whole
    run = spark.createDataFrame([(1, "ก" * 3000), (2, "กขกข" * 200)], "id int, text string")
    few = spark.createDataFrame([("กข",)], "word string")
    got = {r.id: r.tokens for r in segment.segment(run, "id", "text", few).collect()}
    assert got == {1: ["ก" * 3000], 2: ["กข"] * 400}
    assert segment.segment(run, "id", "text", few.limit(0)).where("size(tokens) = 1").count() == 2


def test_signals(some):
    got = {r.id: r.signals.asDict() for r in signals.signals_of(some).collect()}
    assert len(got) == some.count()
    for r in some.collect():
        assert got[r.id] == typed.parse_signals(r.text), r.text


def test_general_words(spark):
    df = spark.createDataFrame([("อยากเรียนกขคงที่จุฬา",)], "text string")
    with_it = signals.signals_of(df, words=spark.createDataFrame([("กขคง",)], "word string")).first().signals
    assert "กขคง" in with_it.keywords and with_it.university == "Chulalongkorn"


def test_search_by_every_signal(spark):
    """Each text against plain predicates over the rows."""
    rows = [(k, ["Chulalongkorn University", "Mahidol", None][k % 3], ["Engineering ภาคพิเศษ", "วิศวกรรม นานาชาติ", "Arts International", None][k % 4], [["61", "64"], ["82"], None][k % 3], [None, 20, 120][k % 3], ["R1", "R2"][k % 2], [None, 2.5, 3.5][k % 3]) for k in range(48)]
    p = spark.createDataFrame(rows, "ord int, university string, name string, codes array<string>, seats int, round string, min_gpax double")
    tests = {
        "chula": lambda r: "Chulalongkorn" in (r[1] or ""),
        "math and physics": lambda r: {"61", "64"} <= set(r[3] or []),
        "more than 30 seats": lambda r: (r[4] or 0) >= 30,
        "รอบ 2": lambda r: r[5] == "R2",
        "GPAX 3.0": lambda r: (r[6] or 0) <= 3.0,
        "international": lambda r: "นานาชาติ" in (r[2] or "").lower() or "international" in (r[2] or "").lower(),
        "ภาคพิเศษ": lambda r: "ภาคพิเศษ" in (r[2] or "").lower(),
    }
    for text, keep in tests.items():
        sig, top = search.search(p, text, k=100)
        assert sorted(r.ord for r in top.collect()) == [r[0] for r in rows if keep(r)], text
    sig, top = search.search(p, "วิศวะ สาขาพลังงาน", k=5)
    assert sig["faculty"] == "Engineering" and "วิศวกรรม" in sig["keywords"]


def test_best_names_without_scoring_all(spark):
    rng = random.Random(9)
    words = ["engineering", "computer", "physics", "arts", "law", "วิศวกรรม", "nursing", "design", "data", "xyz", "bio", "chem", "zoo"]
    names = [None, "", *{" ".join(rng.choice(words)[: rng.randint(2, 12)] for _ in range(rng.randint(1, 4))) for _ in range(600)}]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for keywords in (["engineering"], ["computer", "physics"], ["วิศวกรรม", "law", "dat"], ["data design"], ["q"]):
        score = {n: sum(max(similarity.partial_ratio(k, n or ""), similarity.token_set_ratio(k, n or "")) for k in keywords) / len(keywords) for n in names}
        bound = {r.name: r.b for r in df.select("name", search.score_bound(F.col("name"), keywords).alias("b")).collect()}
        assert all(bound[n] >= s for n, s in score.items())
        some = {r.name for r in search.to_score(df, keywords, 8).collect()}
        best = sorted(score.values(), reverse=True)
        assert {n for n, s in score.items() if s >= best[7]} <= some
        assert len(some) < len(names) / 3 or keywords[0] in ("q", "data design")


def test_lexicons_of_any_size(spark):
    """A hundred thousand terms against a search for each of those that can be there."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeกข") for _ in range(n))
    terms = [word(rng.choice([3, 5, 7, 9])) for _ in range(100_000)]
    lex = spark.createDataFrame([(k, w, f"l{k}") for k, w in enumerate(terms)] + [(100_001, None, "x")], "ord int, kw string, label string")
    said = [None, "", "zz", *(word(rng.randint(1, 30)) for _ in range(60)), terms[5] + "zz" + terms[9]]
    df = spark.createDataFrame([(k % 50, t) for k, t in enumerate(said)], "id int, text string")
    want = sorted((k % 50, min(o for o, w in enumerate(terms) if w in t)) for k, t in enumerate(said) if t and any(w in t for w in terms))
    assert sorted((r.id, r.ord) for r in signals.lexicon_match(df, "id", "text", lex).collect()) == want and want
    some = spark.createDataFrame([(3, "ab", "p"), (2, "abcdef", "q"), (9, "", "r")], "ord int, kw string, label string")
    df = spark.createDataFrame([(1, "xab"), (2, "xabcdefx"), (3, "none"), (4, None), (5, "")], "id int, text string")
    assert {r.id: r.label for r in signals.match_by_grams(df, "id", "text", some).collect()} == {1: "p", 2: "q", 3: "r", 5: "r"}
    assert {r.id: r.label for r in signals.match_by_grams(df, "id", "text", some.where("ord < 9")).collect()} == {1: "p", 2: "q"}


def test_tokens_are_labelled_once_each(spark, monkeypatch):
    """The labels' filter must not bring the similarity below the distinct, where every text has its tokens labelled again."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("uni string, subj string")
    def counted(tokens: pd.Series) -> pd.DataFrame:
        seen.add(len(tokens))
        return pd.DataFrame([(None, "64" if t == "physics" else None) for t in tokens], columns=["uni", "subj"], dtype=object)

    monkeypatch.setattr(signals, "token_labels", counted)
    d = spark.createDataFrame([(f"physics {'x' * (k % 7)} seats{k}",) for k in range(200)], "text string")
    got = signals.signals_of(d).select("signals.subjects").collect()
    assert len(got) == 200 and all(r.subjects == ["64"] for r in got)
    # blanks, the words and each text's own number: far fewer than the tokens of all texts
    assert seen.value <= 2 * (200 + 20)
