"""Function semantics that differ from Spark's built-ins."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quern.functions import aggregates as A, dates as D, lists as L, nested as N, numeric as M, strings as S


@pytest.fixture
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first()["x"]


def test_strings(one):
    assert one(S.left(F.lit("hello"), -2)) == "hel" and one(S.right(F.lit("hello"), -2)) == "llo" and one(S.left(F.lit("hi"), -5)) == ""
    assert one(S.regexp_replace(F.lit("aXbX"), "X", "-")) == "a-bX" and one(S.regexp_replace(F.lit("aXbX"), "x", "-", "gi")) == "a-b-"
    assert one(S.regexp_replace(F.lit("a.b.c"), ".", "-", "l")) == "a-b.c"
    assert one(S.string_split(F.lit("a.b"), ".")) == ["a", "b"] and one(S.split_part(F.lit("a.b"), ".", -1)) == "b" and one(S.split_part(F.lit("a.b"), ".", 3)) == ""
    assert one(S.concat(F.lit("a"), F.lit(None), F.lit(1))) == "a1"
    assert one(S.glob(F.lit("a.txt"), "*.t[!a]t")) and not one(S.glob(F.lit("axtxt"), "*.txt"))
    assert one(S.damerau_levenshtein(F.lit("ca"), F.lit("abc"))) == 2
    assert one(S.strip_accents(F.lit("ménü"))) == "menu" and one(S.length_grapheme(F.lit("éx"))) == 2
    assert one(S.parse_filename(F.lit("/a/b.tar.gz"), True)) == "b.tar" and one(S.parse_dirname(F.lit("a/b/c"))) == "a"


def test_numbers(one):
    assert one(M.fdivide(1, 0)) == math.inf and one(M.fdivide(-1, 0)) == -math.inf and math.isnan(one(M.fdivide(0, 0))) and one(M.fdivide(F.lit(None), 0)) is None
    assert one(M.to_integer(F.lit(2.5))) == 2 and one(M.to_integer(F.lit(3.5))) == 4 and one(M.to_integer(F.lit(2.6))) == 3
    assert one(M.even(F.lit(2.1))) == 4 and one(M.even(F.lit(-3.0))) == -4 and one(M.trunc(F.lit(-1.7))) == -1
    assert one(M.mod(5, 0)) is None and one(M.idivide(7, 2)) == 3 and one(M.gcd(F.lit(12), F.lit(18))) == 6
    assert int(one(M.factorial(F.lit(25)))) == math.factorial(25)


def test_lists(one):
    x = F.array(F.lit(3), F.lit(None), F.lit(1), F.lit(3))
    assert one(L.list_distinct(x)) == [3, 1] and one(L.list_unique(x)) == 2
    assert one(L.list_contains(x, F.lit(9))) is False and one(L.list_contains(F.lit(None).cast("array<int>"), F.lit(1))) is None
    assert one(L.list_position(x, F.lit(9))) is None and one(L.list_extract(x, -1)) == 3 and one(L.list_extract(x, 0)) is None
    assert one(L.list_slice(x, 2, 3)) == [None, 1] and one(L.list_slice(x, 3, 99)) == [1, 3] and one(L.list_slice(x, 4, 2)) == []
    assert one(L.list_sort(x, True)) == [3, 3, 1, None] and one(L.list_concat(F.lit(None).cast("array<int>"), x)) == [3, None, 1, 3]
    assert one(L.list_reduce(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda a, b: a - b)) == -4
    assert one(L.list_transform(F.array(F.lit(5), F.lit(6)), lambda v, i: v * i)) == [5, 12]
    assert one(L.range_list(0, 3)) == [0, 1, 2] and one(L.range_list(3, 3)) == []


def test_dates(one):
    t = F.lit("2024-02-29 23:59:59.999999").cast("timestamp_ntz")
    assert one(D.dow(F.lit("2024-03-03").cast("date"))) == 0 and one(D.isodow(F.lit("2024-03-03").cast("date"))) == 7
    assert one(D.date_trunc("month", t)) == datetime.datetime(2024, 2, 1) and one(D.date_trunc("decade", t)) == datetime.datetime(2020, 1, 1)
    assert one(D.date_diff("month", F.lit("2024-01-31").cast("date"), F.lit("2024-02-01").cast("date"))) == 1
    assert one(D.date_sub("month", F.lit("2024-01-31").cast("date"), F.lit("2024-02-28").cast("date"))) == 0
    assert one(D.time_bucket("day", 2, F.lit("2000-01-02").cast("timestamp_ntz"))) == datetime.datetime(2000, 1, 1)
    assert one(D.strptime(F.lit("05/06/2020"), "%Y-%m-%d", "%d/%m/%Y")) == datetime.datetime(2020, 6, 5)
    assert one(D.strptime(F.lit("nope"), "%Y-%m-%d", strict=False)) is None


def test_nested(one):
    m = F.create_map(F.lit("a"), F.lit(1))
    assert one(N.map_extract(m, F.lit("a"))) == [1] and one(N.map_extract(m, F.lit("b"))) == []
    u = N.union_value({"num": "int", "str": "string"}, "num", F.lit(4))
    assert one(N.union_tag(u)) == "num" and one(N.union_extract(u, "str")) is None
    e = N.Enum(["low", "mid", "high"])
    assert one(e.code(F.lit("high"))) == 2 and one(e.code(F.lit("none"))) is None and one(e.range_boundary("mid", None)) == ["mid", "high"]
    assert one(N.json_type(F.lit('{"a":-1}'), "$.a")) == "BIGINT" and one(N.json_valid(F.lit("{"))) is False
    assert one(N.json_merge_patch(F.lit('{"a":{"b":1}}'), F.lit('{"a":{"b":null,"c":2}}'))) == '{"a":{"c":2}}'
    assert one(N.json_contains(F.lit('{"a":[1,{"b":2}]}'), F.lit('{"b":2}'))) is True


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", 5.0), ("b", None)], "k string, v double")
    shape = {r["k"]: r for r in df.groupBy("k").agg(A.skewness("v").alias("s"), A.kurtosis("v").alias("c")).collect()}
    assert shape["b"]["s"] is None and shape["b"]["c"] is None
    assert {r["k"]: r["f"] for r in A.fsum(df, ["k"], {"f": "v"}).collect()} == {"a": 14.0, "b": 5.0}
    assert {r["k"]: r["m"] for r in A.least_n(df, ["k"], "v", 2, "m").collect()} == {"a": [1.0, 2.0], "b": [5.0]}
    assert {r["k"]: r["mode"] for r in A.mode(df, ["k"], "v").collect()} == {"a": 2.0, "b": 5.0}
    assert {r["k"]: r["mad"] for r in A.mad(df, ["k"], "v").collect()} == {"a": 0.5, "b": 0.0}
    assert {r["bin"]: r["n"] for r in A.binned_histogram(df, "v", [5, 2, 3]).collect()} == {2.0: 3, 3.0: 0, 5.0: 1, math.inf: 1}


def test_compensated_sums(spark):
    cases = {1: [1e-12, 2e-12], 2: [1e30, 1.0, -1e30], 3: [0.1] * 10, 4: [5e-324, 1.7e308, -1.7e308], 5: [float("inf"), 1.0], 6: [None], 7: [1e16, 1.0, 1e16, -2e16], 8: [0.0, -0.0]}
    rows = [(k, v) for k, vs in cases.items() for v in vs]
    found = {r["k"]: (r["s"], r["s_n"]) for r in A.fsum(spark.createDataFrame(rows, "k int, v double").repartition(3), ["k"], {"s": "v"}).collect()}
    for k, vs in cases.items():
        known = [v for v in vs if v is not None]
        assert found[k] == ((math.fsum(known) if known else None), len(known)), k


def test_gcd_and_lcm_take_nulls(spark):
    df = spark.createDataFrame([(12, 18), (None, 4), (0, 0), (-4, 6), (5, None)], "a long, b long")
    assert [tuple(r) for r in df.select(M.gcd("a", "b"), M.lcm("a", "b")).collect()] == [(6, 36), (None, None), (0, 0), (2, 12), (None, None)]
    assert [r[0] for r in df.select(M.lgamma(F.col("b").cast("double"))).collect()][1:2] == [math.lgamma(4)]


def test_lgamma_at_its_poles(one):
    assert one(M.lgamma(F.lit(-1.0))) == one(M.lgamma(F.lit(-100.0))) == one(M.lgamma(F.lit(float("-inf")))) == math.inf
    assert one(M.lgamma(F.lit(-0.5))) == math.lgamma(-0.5)


def test_nan_by_zero_is_nan(one):
    for zero in (0, 0.0, -0.0):
        assert math.isnan(one(M.fdivide(F.lit(math.nan), F.lit(zero))))
    assert one(M.fdivide(F.lit(math.inf), F.lit(0))) == math.inf and one(M.fdivide(F.lit(-math.inf), F.lit(0))) == -math.inf


def test_pairs_side_by_side_equal_one_by_one():
    import random

    import pyarrow as pa

    random.seed(2)
    word = lambda n: "".join(random.choices("abc\u00e9\U0001f600", k=n))
    pairs = [(word(random.randint(0, 12)), word(random.randint(0, 12))) for _ in range(3000)] + [(word(130), word(3)), (word(128), word(90)), ("ca", "abc"), (None, "a"), ("", ""), ("", "a")]
    a, b = (pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))
    for one, block, kind in ((S._damerau, S._damerau_block, pa.int64()), (S._jaro, S._jaro_block, pa.float64())):
        assert S._pairs(one, block, a, b, kind).to_pylist() == [None if x is None else one(x, y) for x, y in pairs]
    # A block of many names takes few steps: none for each pair.
    taken = []
    S._pairs(lambda x, y: taken.append(x), S._damerau_block, pa.array(["Customer#1"] * 500), pa.array(["1#remotsuC"] * 500), pa.int64())
    assert not taken


def test_graphemes_of_plain_text(one):
    import regex

    for text in ("", "a\r\nb\n\r", "\r\r\n", "e\u0301x", "".join(map(chr, range(128)))):
        assert one(S.length_grapheme(F.lit(text))) == len(regex.findall(r"\X", text))
    assert one(S.strip_accents(F.lit(None).cast("string"))) is None
