import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrove.functions import similarity as S
from tallygrove.functions import text as T

WORD = st.text("abc é", max_size=9)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _step(row, x, b)
    return row[-1]


def _step(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


@given(WORD, WORD)
def test_lcs(a, b):
    assert S.lcs(a, b) == slow_lcs(a, b)


@given(WORD, WORD)
def test_bounds_and_symmetry(a, b):
    for f in (S.ratio, S.partial_ratio, S.token_sort_ratio, S.token_set_ratio, S.partial_token_ratio, S.wratio):
        assert 0 <= f(a, b) <= 100.0001
        assert f(a, b) == pytest.approx(f(b, a))
    if a:
        assert S.partial_ratio(a, a) == 100


def test_published_examples():
    assert S.ratio("this is a test", "this is a test!") == pytest.approx(96.551724)
    assert S.partial_ratio("this is a test", "this is a test!") == 100
    assert S.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert S.token_set_ratio("fuzzy was a bear but not a dog", "fuzzy was a bear") == 100


@pytest.mark.parametrize(("raw", "want"), [("2.5", 2.5), (" 7 ", 7.0), ("1e3", 1000.0), ("20%", None), ("2.5d", None), ("0x1p3", None), ("", None), (None, None), ("-", None)])
def test_num(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(T.num(F.col("x"))).first()[0] == want


def test_text_helpers(spark):
    d = spark.createDataFrame([("ก า  b c", "61 / Math", "| a |b | |", "a\r\nb c\n")], "a string, b string, c string, d string")
    code, name = T.code_name(F.col("b"))
    r = d.select(T.squeeze_between(F.col("a")), code, name, T.cells(F.col("c")), T.lines(F.col("d")), T.squash(F.lit("A  b"))).first()
    assert list(r) == ["กา  b c", "61", "Math", ["a", "b", ""], ["a", "b", "c"], "ab"]


@pytest.mark.parametrize(("code", "want"), [("GPAX", "GPAX"), ("TGAT1", "TGAT"), ("91", "TGAT"), ("30", "TPAT"), ("67", "A-Level"), ("89", "A-Level"), ("90", "TGAT"), ("x", "other"), (None, "other")])
def test_category(spark, code, want):
    assert spark.createDataFrame([(code,)], "x string").select(T.category(F.col("x"))).first()[0] == want


def test_numbers_are_written_by_arithmetic_as_by_digits(spark):
    """``generals`` gives what ``general`` does, halves, powers and extremes included."""
    xs = [0.0, -0.0, None, 99999.95, 999999.5, 999998.5, 1234565.0, -1234575.0, 1e-300, 1e300, 123456.5, 0.285, 1000.005, 9.9999949, *(10.0**k for k in range(-20, 30)), *(k * 1000.1 for k in range(1, 400, 7)), *(k / 700 for k in range(50))]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    got = T.generals(d, "x", "said").withColumn("other", T.general(F.col("x"))).collect()
    assert len(got) == len(xs) and all(r.said == r.other for r in got)
