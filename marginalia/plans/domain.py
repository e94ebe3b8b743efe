"""The driver's tables as a reading catalogue: books, reading histories, descriptions and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _more_tags():
    """Spellings, junk, moods and an age range for some books."""
    k, tags = F.col("p_partkey") % 7, lambda *x: F.array(*map(F.lit, x))
    return F.when(k == 0, tags("Slow-Burn romance", "slow_burn")).when(k == 1, tags("Kindle Unlimited", "My Favourites")).when(k == 2, tags("25-39 lead", "dark")).otherwise(F.array().cast("array<string>"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, author, genres, tropes, tags, pacing, spice_level, focus and status, from `part`."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    price = F.col("p_retailprice")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        F.when(F.col("p_partkey") % 13 == 0, F.array("p_type", F.lit("Best of 2020"))).when(F.col("p_partkey") % 89 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("genres"),
        F.array(F.get(words, F.lit(0))).alias("tropes"),
        F.concat(F.array(F.get(words, F.lit(1)), F.lower("p_type"), F.concat(F.lit("size-"), F.col("p_size") % 10)), _more_tags()).alias("tags"),
        F.when(F.col("p_size") % 4 == 0, "Slow").when(F.col("p_size") % 4 == 1, "Medium").when(F.col("p_size") % 4 == 2, "Fast").alias("pacing"),
        F.when(price < 925, "No Spice").when(price < 940, "Mild, later hot").when(price < 955, "Fade to black").when(price < 975, "Average").when(price < 990, "Explicit").alias("spice_level"),
        F.when(F.col("p_size") % 3 == 0, "Plot").when(F.col("p_size") % 3 == 1, "Character").otherwise("World").alias("focus"),
        F.when(F.col("p_partkey") % 97 == 0, "archived_nonenglish").alias("status"),
    )


def user_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, book_id, user_rating (null where returned, fractions and 6 among them), match_status, shelf, date_read and
    the title and author as typed, from orders and their lines. Unmatched rows have no book."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("l_orderkey") % 23 != 0, F.col("l_partkey")).alias("book_id"),
        F.when(F.col("l_returnflag") != "R", F.when(F.col("l_linenumber") == 6, 6.0).when(F.col("l_linenumber") == 5, F.col("l_quantity") / 10).otherwise(F.ceil(F.col("l_quantity") / 10).cast("double"))).alias("user_rating"),
        F.when(F.col("l_orderkey") % 23 == 0, "unmatched").when(F.col("l_linestatus") == "O", "ambiguous").otherwise("matched").alias("match_status"),
        F.when(F.col("o_orderstatus") == "P", "to-read").otherwise("read").alias("shelf"),
        F.when(F.col("l_orderkey") % 31 != 0, F.col("o_orderdate").cast("date")).alias("date_read"),
        F.concat(F.lit("Title "), (F.col("l_partkey") % 50).cast("string")).alias("raw_title"),
        F.concat(F.lit("Author "), (F.col("l_suppkey") % 10).cast("string")).alias("raw_author"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
    )


#: The same views for DuckDB.
BOOKS_SQL = """books AS (
  SELECT p_partkey AS id, p_name AS title, p_brand AS author, CASE WHEN p_partkey % 13 = 0 THEN [p_type, 'Best of 2020'] WHEN p_partkey % 89 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_type] END AS genres, [string_split(p_name, ' ')[1]] AS tropes,
         list_concat([string_split(p_name, ' ')[2], lower(p_type), 'size-' || (p_size % 10)], CASE p_partkey % 7 WHEN 0 THEN ['Slow-Burn romance', 'slow_burn'] WHEN 1 THEN ['Kindle Unlimited', 'My Favourites'] WHEN 2 THEN ['25-39 lead', 'dark'] ELSE CAST([] AS VARCHAR[]) END) AS tags,
         CASE p_size % 4 WHEN 0 THEN 'Slow' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Fast' END AS pacing,
         CASE WHEN p_retailprice < 925 THEN 'No Spice' WHEN p_retailprice < 940 THEN 'Mild, later hot' WHEN p_retailprice < 955 THEN 'Fade to black' WHEN p_retailprice < 975 THEN 'Average' WHEN p_retailprice < 990 THEN 'Explicit' END AS spice_level,
         CASE p_size % 3 WHEN 0 THEN 'Plot' WHEN 1 THEN 'Character' ELSE 'World' END AS focus,
         CASE WHEN p_partkey % 97 = 0 THEN 'archived_nonenglish' END AS status FROM part)"""
USER_BOOKS_SQL = """user_books AS (
  SELECT o_custkey AS user_id, CASE WHEN l_orderkey % 23 <> 0 THEN l_partkey END AS book_id,
         CASE WHEN l_returnflag <> 'R' THEN CASE l_linenumber WHEN 6 THEN 6.0 WHEN 5 THEN l_quantity / 10 ELSE ceil(l_quantity / 10) END END AS user_rating,
         CASE WHEN l_orderkey % 23 = 0 THEN 'unmatched' WHEN l_linestatus = 'O' THEN 'ambiguous' ELSE 'matched' END AS match_status,
         CASE WHEN o_orderstatus = 'P' THEN 'to-read' ELSE 'read' END AS shelf, CASE WHEN l_orderkey % 31 <> 0 THEN CAST(o_orderdate AS DATE) END AS date_read,
         'Title ' || (l_partkey % 50) AS raw_title, 'Author ' || (l_suppkey % 10) AS raw_author, l_orderkey AS order_key, l_linenumber AS line_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


#: Values of the rules as SQL, written from the rules and not from the columns above.
JUNK_SQL = "(lower({0}) IN ('all reviews & lists', 'books fiction', 'kindle unlimited', 'audiobook', 'kindle', 'ebook') OR regexp_matches(lower({0}), 'favourite|favorite|best of|recommended|review|to buy|tbr|wish list|wishlist'))"
_SPACED = "trim(regexp_replace(replace(regexp_replace(regexp_replace(lower({0}), '([a-z])-([a-z])', '\\1 \\2', 'g'), '([a-z])-([a-z])', '\\1 \\2', 'g'), '_', ' '), '\\s+', ' ', 'g'))"
CANON_SQL = f"CASE {_SPACED} WHEN 'slow burn romance' THEN 'slow burn' WHEN 'bisexual or pansexual' THEN 'bisexual' WHEN 'sapphic romance' THEN 'sapphic' WHEN 'mlm romance' THEN 'mlm' WHEN 'grumpy / sunshine' THEN 'grumpy sunshine' ELSE {_SPACED} END"
SPICE_SQL = "CASE WHEN regexp_matches(lower({0}), 'explicit|hot|spicy|high') THEN 'Explicit' WHEN regexp_matches(lower({0}), 'medium|average|moderate') THEN 'Medium Spice' WHEN regexp_matches(lower({0}), 'tame|euphemistic|low|mild|fade|closed door') THEN 'Tame' WHEN regexp_matches(lower({0}), 'no spice') THEN 'No Spice' ELSE 'N/A' END"
