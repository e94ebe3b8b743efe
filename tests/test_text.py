"""Scalar functions on the cases that their rules single out."""

import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.functions import similarity, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("fn", "given", "wanted"), [
    (text.normalize_isbn, '="9780439023481"', "9780439023481"),
    (text.normalize_isbn, None, ""),
    (text.normalize_isbn, "043902348x", "043902348X"),
    (text.humanize, "enemiesToLovers", "enemies to lovers"),
    (text.canonical_tag, "slow-burn", "slow burn"),
    (text.canonical_tag, "25-39 lead", "25-39 lead"),
    (text.canonical_tag, "a-b-c", "a b c"),
    (text.slugify, "Enemies to Lovers", "enemies-to-lovers"),
    (text.normalize_title, "The Many (Saga #2): A Tale", "many"),
    (text.parse_date, "2024/1/5", datetime.date(2024, 1, 5)),
    (text.parse_date, "25/12/2023", datetime.date(2023, 12, 25)),
    (text.parse_date, "soon", None),
    (text.parse_rating, "0", None),
    (text.parse_rating, "4.5", 4.5),
    (text.parse_rating, "abc", None),
    (text.format_author, "Melville, Herman, 1819-1891", "Herman Melville"),
    (text.clean_subject, "Ship captains -- Fiction", "ship captains"),
    (text.canonical_spice, "medium hot", "Explicit"),
    (text.canonical_spice, None, "N/A"),
    (text.split_outside_parens, "a (b, c), d", ["a (b, c)", "d"]),
])
def test_scalars(spark, fn, given, wanted):
    assert one(spark, fn, given) == wanted


def test_lcs_against_table():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    words = ["kitten", "sitting", "", "a", "loyalty", "royalty", "the many", "mandy", "aaaa", "abab"]
    for a in words:
        for b in words:
            assert similarity.lcs_length(a, b) == slow(a, b)
    assert round(similarity.ratio("many", "mandy"), 1) == 88.9
    assert similarity.partial("cat", "the cat sat") == 100.0


def test_union_by_key_never_shrinks(spark):
    df = spark.createDataFrame([(["A", "b"], ["a", "C", "c "])], "x array<string>, y array<string>")
    assert df.select(text.union_by_key(F.col("x"), F.col("y")).alias("z")).first()["z"] == ["A", "b", "C"]
