"""Forms of texts that look the same."""

import pytest
from pyspark.sql import functions as F

from skein.llm import lookalike as L

SAME = [
    ("visit", "νіѕіt"), ("Ａ１！", "A1!"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "a﻿b⁠"), ("é", "é"), ("ё", "ë"), ("ﬁn", "fin"), ("ﬄ", "ffl"),
    ("ό", "ó"), ("ά", "ά"), ("so­ft", "soft"), ("ΝΟ", "NO"), ("ｶ", "カ"), ("a\tb", "a b"), ("ԁо", "do"), ("օո", "on"), ("ɡo", "go"), ("👩‍🌾", "👩🌾"),
]
APART = [("a", "A"), ("e", "é"), ("2", "²"), ("ſ", "s"), ("ſ", "f"), ("-", "—"), ("a b", "a  b"), ("a b", "a\nb"), ("0", "O"), ("1", "l"), ("I", "l"), ("rn", "m"), ("½", "1/2"), ("“", '"'), ("…", "..."), ("№", "No"), ("a\n", "a")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert L.skeleton(a) == L.skeleton(b)


@pytest.mark.parametrize("a,b", APART)
def test_apart(a, b):
    assert L.skeleton(a) != L.skeleton(b)


def test_letters_of_other_scripts():
    table = dict(L.letter_prototypes())
    for letter, drawn in zip("αγινορσυЬгѵӀՏառᎠᏟᏴⲞⲢⲤᴄᴏᴠ", "ayivopoubrvISwnDCBOPCcov"):
        assert L.skeleton(letter) == drawn == table[letter]
    assert len(table) > 500 and not set(table) & set(table.values()) and not any(c.isascii() for c in table)
    assert not any(L.unicodedata.category(c)[0] != "L" for pair in table.items() for c in pair)


def test_the_table_is_the_librarys(spark):
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    table = L.confusables()
    some = sorted(table)[:: max(1, len(table) // 400)]
    for char in some:
        if L.unicodedata.normalize("NFD", char) == char:
            assert L.unicodedata.normalize("NFD", table[char]) == checker.getSkeleton(char)


def test_skeleton_is_stable():
    for a, b in SAME + APART:
        for x in (a, b):
            assert L.skeleton(L.skeleton(x)) == L.skeleton(x)
    assert L.skeleton("") == "" and L.skeleton("plain text") == "plain text"


def docs(spark):
    rows = [(1, "one"), (2, "οne"), (3, "one"), (4, "оne"), (5, None), (6, ""), (7, " ​"), (8, " "), (9, "One"), (None, "οne"), (10, "two"), (10, "two"), (11, "tw​o"), (12, "x" * 200_000), (13, "х" + "x" * 199_999)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("look", F.lit("clash")).withColumn("form", F.lit("clash")).withColumn("group_id", F.lit("clash"))


def test_pairs(spark):
    got = [tuple(r) for r in L.same_look_pairs(docs(spark)).collect()]
    assert sorted(got) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11), (12, 13)]
    assert L.same_look_pairs(docs(spark).where("false")).count() == 0


def test_groups_and_forms(spark):
    got = {r.doc_id: (r.group_id, r.variants) for r in L.look_groups(docs(spark)).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (1, 3), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None), 9: (9, 1), None: (None, None), 10: (10, 2), 11: (10, 2), 12: (12, 2), 13: (12, 2)}
    assert L.look_groups(docs(spark)).count() == docs(spark).count()
    forms = {r.doc_id: r.form for r in L.consistent_forms(docs(spark)).collect()}
    assert forms[2] == forms[4] == "one" and forms[5] is None and forms[6] == "" and forms[7] == " "


def test_a_large_group_of_copies_makes_no_pairs(spark):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("the same page").alias("text"))
    assert L.same_look_pairs(many).count() == 0
    one = many.unionByName(spark.createDataFrame([(99_999, "the ѕame page")], "doc_id long, text string"))
    assert L.same_look_pairs(one).count() == 30_000
