"""Taste profiles: feature weights, preferences and counts from reading histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import canonical_spice, canonical_tag, is_junk_tag

WINDOW_DAYS = {"all": None, "6m": 183, "1y": 365}
PROFILE_SIZE = {"genre": 10, "trope": 10, "tag": 15}


def read_rows(history: DataFrame) -> DataFrame:
    return history.filter(F.lower(F.trim("shelf")) == "read")


def in_window(history: DataFrame, window: str, as_of: DataFrame) -> DataFrame:
    """Rows of the last days of `window` before as_of's one `as_of` date; without a window rows without a date as well."""
    days = WINDOW_DAYS[window]
    if days is None:
        return history
    return history.crossJoin(F.broadcast(as_of)).filter(F.col("date_read") >= F.date_sub("as_of", days)).drop("as_of")


def rating_weight(rating: Column, match_status: Column) -> Column:
    """2 to -2 for 5 to 1 whole stars, fractions cut off, and 0 for any other number; 0.5 unrated (null or 0); half of
    it for an ambiguous match."""
    stars = F.when(rating >= 0, F.floor(rating)).otherwise(F.ceil(rating))
    weight = F.when(F.coalesce(rating, F.lit(0.0)) == 0, 0.5).when(stars.between(1, 5), (stars - 3).cast("double")).otherwise(0.0)
    return F.when(match_status == "ambiguous", weight * 0.5).otherwise(weight)


def _kind(kind: str):
    return lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("feature"))


def features(books: DataFrame, junk: bool = False) -> DataFrame:
    """(book_id, kind, feature): genres and tropes as often as they occur, tags once after canonical spelling; junk tags
    only where asked for."""
    tags = F.col("tags") if junk else F.filter("tags", lambda t: ~is_junk_tag(t))
    lists = {"genre": F.col("genres"), "trope": F.col("tropes"), "tag": F.array_distinct(F.transform(tags, canonical_tag))}
    none = F.array().cast("array<struct<kind:string,feature:string>>")
    pairs = F.flatten(F.array(*(F.coalesce(F.transform(v, _kind(k)), none) for k, v in lists.items())))
    return books.select(F.col("id").alias("book_id"), F.explode(pairs).alias("f")).select("book_id", "f.kind", "f.feature")


def weighted_reads(history: DataFrame) -> DataFrame:
    return read_rows(history).filter("book_id IS NOT NULL").select("user_id", "book_id", rating_weight(F.col("user_rating"), F.col("match_status")).alias("w"))


def taste_weights(history: DataFrame, books: DataFrame) -> DataFrame:
    """(user_id, kind, feature, weight, n). A user's reads of one book are summed before its features are joined. These are
    many times the catalogue that Spark estimates them by, so they are never broadcast."""
    reads = weighted_reads(history).groupBy("user_id", "book_id").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    return reads.join(features(books).hint("merge"), "book_id").groupBy("user_id", "kind", "feature").agg(F.sum("w").alias("weight"), F.sum("n").alias("n"))


def top_features(weights: DataFrame) -> DataFrame:
    """The heaviest features of each user and kind, without junk and those of no positive weight; ties by name."""
    rank = F.row_number().over(Window.partitionBy("user_id", "kind").orderBy(F.desc("weight"), "feature"))
    size = F.element_at(F.create_map(*(F.lit(x) for kv in PROFILE_SIZE.items() for x in kv)), F.col("kind"))
    return weights.filter(~is_junk_tag("feature") & (F.col("weight") > 0)).withColumn("rank", rank).filter(F.col("rank") <= size)


def preference_histograms(history: DataFrame, books: DataFrame) -> DataFrame:
    """(user_id, preference, value, n) over reads of 4 stars or more; spice by its five levels, N/A among them."""
    liked = read_rows(history).filter("user_rating >= 4").join(books.select(F.col("id").alias("book_id"), "pacing", "spice_level", "focus").hint("merge"), "book_id")
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("preference"), v.alias("value")) for k, v in (("pacing", F.col("pacing")), ("spice", canonical_spice("spice_level")), ("focus", F.col("focus"))))))
    return liked.select("user_id", values.alias("v")).select("user_id", "v.*").filter("value <> ''").groupBy("user_id", "preference", "value").agg(F.count("*").alias("n"))


def profile_counts(history: DataFrame, books: DataFrame) -> DataFrame:
    """(user_id, total, rated, matched, avg_rating) of the read rows; matched are those whose book is in the catalogue,
    whatever their tier, and rows without one count for the rest."""
    found = read_rows(history).join(books.select(F.col("id").alias("book_id"), F.lit(True).alias("_found")), "book_id", "left")
    rating = F.nullif("user_rating", F.lit(0.0))
    return found.groupBy("user_id").agg(F.count("*").alias("total"), F.count(rating).alias("rated"), F.count("_found").alias("matched"), F.round(F.avg(rating), 6).alias("avg_rating"))


def idf(books: DataFrame) -> DataFrame:
    """(feature, df, idf): ln(N / df) over the distinct tropes and tags of recommendable books, junk included."""
    shown = recommendable(books)
    df = features(shown, junk=True).filter("kind <> 'genre'").select("book_id", "feature").distinct().groupBy("feature").agg(F.count("*").alias("df"))
    n = shown.agg(F.count("*").alias("n_books"))
    return df.crossJoin(F.broadcast(n)).select("feature", "df", F.log(F.col("n_books") / F.col("df")).alias("idf"))


def recommendable(books: DataFrame) -> DataFrame:
    """Books with a trope or tag that aren't archived."""
    return books.filter((F.coalesce(F.size("tropes") > 0, F.lit(False)) | F.coalesce(F.size("tags") > 0, F.lit(False))) & ~F.coalesce("status", F.lit("")).startswith("archived"))
