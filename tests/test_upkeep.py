"""Catalogue upkeep on small tables."""

from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import upkeep


def test_columns(spark):
    one = spark.range(1)
    row = one.select(
        upkeep.url_slug(F.lit("http://a.b/c/d-e/?x=1#y")).alias("slug"), upkeep.url_slug(F.lit(None).cast("string")).alias("none"), upkeep.headings(F.lit(" A -- b—c -- ")).alias("parts"),
        upkeep.with_source(F.lit(""), "x").alias("blank"), upkeep.with_source(F.lit("x"), "y").alias("more"), upkeep.with_source(F.lit("x + y"), "y").alias("once"),
        upkeep.implied(F.array(F.lit("a"), F.lit("b")), ["b"], "u", 10).alias("added"), upkeep.implied(F.array(F.lit("a"), F.lit("b")), ["b"], "u", 2).alias("cut"), text.clean_subject(F.lit("Sea stories -- FICTION")).alias("subject"),
    ).first()
    assert row.asDict() == {"slug": "d-e", "none": None, "parts": ["A", "b", "c"], "blank": "x", "more": "x + y", "once": "x + y", "added": ["a", "b", "u"], "cut": ["a", "b"], "subject": "sea stories"}


def test_accounts(spark):
    logins = spark.createDataFrame([(1, "g", "s1", "x"), (2, "g", "s9", "b"), (3, "g", "s8", None), (4, "g", None, "z")], "login_id long, provider string, sub string, email string")
    accounts = spark.createDataFrame([(10, "g", "s1", "a"), (12, "h", "s2", "b"), (11, "h", "s3", "b"), (13, "h", None, None)], "account_id long, provider string, sub string, email string")
    got = {r["login_id"]: (r["account_id"], r["how"]) for r in upkeep.link_accounts(logins, accounts).collect()}
    assert got == {1: (10, "subject"), 2: (11, "email"), 3: (None, "insert"), 4: (None, "insert")}


def test_new_entries_and_reports(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x")], "t string, a string")
    assert sorted(upkeep.new_entries(rows, rows.filter("a = 'x'"), ["t", "a"]).collect(), key=str) == sorted(rows.filter("t is null or a = 'y'").collect(), key=str)
    changes = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d"), ("b", "a")], "was string, becomes string")
    assert [tuple(r) for r in upkeep.directions(changes, 2).collect()] == [("a", "b", 2), ("b", "a", 1)]
    assert upkeep.run_report(spark.createDataFrame([], "run string, at date")).count() == 0
