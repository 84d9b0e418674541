import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import distance, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("Like… To_½!", "liketo1/2"), ("Mötley Crüe", "motleycrue"), ("Straße", "strasse"), ("Æon Œuvre", "aeonoeuvre"), ("Иванов", "ivanov"), ("Жук", "zhuk"), ("Ελλάδα", "ellada"),
        ("かな", "kana"), ("カナ", "kana"), ("한글", "hangeul"), ("!!!", ""), ("", ""), ("A_B c", "abc"), ("123", "123"), ("東京", ""),
    ],
)
def test_encode_name(spark, name, key):
    assert one(spark, text.encode_name(F.col("a")), a=name) == key


def test_romanised_text_is_ascii(spark):
    letters = [chr(c) for c in [*range(0x80, 0x590), *range(0x3041, 0x3100), *range(0xAC00, 0xAD00)] if unicodedata.category(chr(c))[0] in "LN"]
    got = spark.createDataFrame([(c,) for c in letters], "a string").select(text.encode_name(F.col("a")).alias("x")).collect()
    assert all(r.x.isascii() and r.x == r.x.lower() for r in got)


def test_symbols_and_bytes(spark):
    assert one(spark, text.encode_symbols(F.col("a")), a=" !\t 　A É") == "!aÉ"
    assert one(spark, F.length(text.byte_view(F.col("a"))), a="ガ!") == 4


@pytest.mark.parametrize(("a", "b", "flag"), [("Иванов Band", "Ivanov", True), ("Иванов", "Ivanov", False), ("Ivanov", "Ivanov", False), ("Иван X", "Иван", False)])
def test_transliterated(spark, a, b, flag):
    assert one(spark, text.is_transliterated(F.col("a"), F.col("b")), a=a, b=b) is flag


@pytest.mark.parametrize(("x", "grams"), [("", ["   "]), ("ab", ["ab "]), ("abc", ["abc"]), ("abcd", ["abc", "bcd"])])
def test_trigrams(spark, x, grams):
    assert one(spark, text.trigrams(F.col("a")), a=x) == grams


def test_lists_and_formats(spark):
    assert one(spark, text.split_list(F.col("a")), a="x, y,") == ["x", " y", ""]
    assert one(spark, text.split_list(F.col("a"), trim=True), a="x, y,") == ["x", "y", ""]
    assert one(spark, text.url_encode(F.col("a")), a="a b*~é/") == "a%20b%2A~%C3%A9%2F"
    assert one(spark, text.two_decimals(F.lit(1.005) + 1), a="") in ("2.00", "2.01")
    assert one(spark, text.to_int(F.col("a")), a="12x") is None and one(spark, text.to_int(F.col("a")), a="12") == 12
    assert one(spark, text.clip(F.col("a"), 3), a="abcdef") == "abc"
    assert one(spark, text.clean_name(F.col("a")), a="The Band (live) feat. Other") == "Band"
    assert one(spark, text.parse_array_literal(F.col("a")), a='{a,"b,c","d""e"}') == ["a", "b,c", 'd"e']
    assert one(spark, text.parse_array_literal(F.col("a")), a="a,b") == [] and one(spark, text.parse_array_literal(F.col("a")), a="{}") == [""]
    assert one(spark, text.strip_braces(F.col("a")), a="{a,b}") == "a,b" and one(spark, text.strip_braces(F.col("a")), a="{}") == "{}"
    assert one(spark, text.reduce_aliases(F.split("a", ","), F.col("b")), a="X,y,!,Y,z", b="Z") == ["x", "y"]
    assert one(spark, text.encode_or_keep(F.split("a", ",")), a="X,!,x") == ["!", "x"]
    assert one(spark, text.joined_sort_names(F.split("a", ","), F.split("b", ",")), a="p,q", b=" & ,") == "p & q"


def plain_indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else min(row[j], new[-1]) + 1)
        row = new
    return row[-1]


def test_distances(spark):
    r = random.Random(2)
    pairs = [("", ""), ("", "ab"), ("kitten", "sitting"), ("ab", "cd")] + [("".join(r.choice("abc") for _ in range(r.randint(0, 9))), "".join(r.choice("abc") for _ in range(r.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", distance.edit_distance(F.col("a"), F.col("b"), replace_cost_two=True).alias("d"), distance.edit_ops(F.col("a"), F.col("b")).alias("ops"), F.levenshtein("a", "b").alias("l"))
    for x in df.collect():
        assert x.d == plain_indel(x.a, x.b) and len(x.ops) == x.l
    assert one(spark, distance.distance_confidence(F.col("a"), F.col("b")), a="abcd", b="abce") == 0.5


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_scripts(a, b):
    out, at = [], 0
    for op, s, t in distance.script(a, b):
        out.append(a[at:s])
        out.append(b[t] if op != "delete" else "")
        at = s + (op != "insert")
    assert "".join(out) + a[at:] == b
    parts = distance.blocks(a, b)
    assert "".join(b[x[3] : x[4]] for x in parts) == b and "".join(a[x[1] : x[2]] for x in parts) == a
    assert all(a[x[1] : x[2]] == b[x[3] : x[4]] for x in parts if x[0] == "equal")
