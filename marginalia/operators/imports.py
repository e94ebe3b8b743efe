"""Imports of shelf exports: matching cascade, re-import, flags and lists of what isn't matched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.matching import fuzzy_match, key_match


def import_rows(rows: DataFrame, books: DataFrame) -> DataFrame:
    """rows with book_id and match_status: by the first ISBN that a book has, else by the most similar title and author.

    rows: (row_id, raw_title, raw_author, isbn13, isbn10, …); books: (id, title, author, isbn). Only rows without an ISBN
    hit are compared.
    """
    keyed = key_match(rows, books, ("isbn13", "isbn10"))
    sure = keyed.filter("book_id IS NOT NULL").withColumn("match_status", F.lit("matched"))
    left = keyed.filter("book_id IS NULL").drop("book_id")
    found = fuzzy_match(left.select("row_id", F.col("raw_title").alias("title"), F.col("raw_author").alias("author")), books).select("row_id", "book_id", "match_status")
    return sure.unionByName(left.join(found, "row_id"))


def summary(imported: DataFrame) -> DataFrame:
    """One row: total_read, matched, ambiguous, unmatched."""
    return imported.agg(F.count("*").alias("total_read"), *(F.count_if(F.col("match_status") == s).alias(s) for s in ("matched", "ambiguous", "unmatched")))


def rematched(user_books: DataFrame, books: DataFrame) -> DataFrame:
    """user_books (row_id, …, raw_title, raw_author, book_id, match_status) with unmatched rows matched again."""
    open_ = user_books.filter("match_status = 'unmatched'")
    found = fuzzy_match(open_.select("row_id", F.col("raw_title").alias("title"), F.col("raw_author").alias("author")), books)
    new = found.filter("match_status <> 'unmatched'").select(F.col("row_id").alias("_row"), F.col("book_id").alias("_book"), F.col("match_status").alias("_status"))
    both = user_books.join(new, F.col("row_id") == F.col("_row"), "left")
    changed = {"book_id": F.coalesce("_book", "book_id"), "match_status": F.coalesce("_status", "match_status")}
    return both.select(*(changed.get(c, F.col(c)).alias(c) for c in user_books.columns))


def reimported(user_books: DataFrame, imported: DataFrame) -> DataFrame:
    """user_books after an import: the rows of every user of `imported` are replaced, others stay."""
    return user_books.join(imported.select("user_id").distinct(), "user_id", "left_anti").unionByName(imported.select(*user_books.columns))


def flagged(user_books: DataFrame, flags: DataFrame) -> DataFrame:
    """user_books with flagged rows (user_id, row_id) detached: no book, unmatched. Only a user's own matched rows are."""
    mine = flags.select(F.col("user_id").alias("_user"), F.col("row_id").alias("_row")).distinct()
    both = user_books.join(mine, (F.col("user_id") == F.col("_user")) & (F.col("row_id") == F.col("_row")), "left")
    hit = F.col("_row").isNotNull() & F.col("book_id").isNotNull()
    changed = {"book_id": F.when(~hit, F.col("book_id")), "match_status": F.when(hit, "unmatched").otherwise(F.col("match_status"))}
    return both.select(*(changed.get(c, F.col(c)).alias(c) for c in user_books.columns))


def pending_after(pending: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(user_id, raw_title, raw_author, seen_count, first_seen) after more unmatched rows (user_id, raw_title, raw_author,
    seen): counts add up, the first sight stays."""
    new = unmatched.groupBy("user_id", "raw_title", "raw_author").agg(F.count("*").alias("seen_count"), F.min("seen").alias("first_seen"))
    both = pending.select("user_id", "raw_title", "raw_author", "seen_count", "first_seen").unionByName(new)
    return both.groupBy("user_id", "raw_title", "raw_author").agg(F.sum("seen_count").alias("seen_count"), F.min("first_seen").alias("first_seen"))


def pending_list(pending: DataFrame, limit: int = 100) -> DataFrame:
    """The most seen first, of equal counts the newest; `limit` in all, 0 for all."""
    ordered = pending.orderBy(F.desc("seen_count"), F.desc_nulls_last("first_seen"), "user_id", "raw_title", "raw_author")
    return ordered.limit(limit) if limit > 0 else ordered


def matched_list(user_books: DataFrame, books: DataFrame) -> DataFrame:
    """Read rows with their catalogue entry, the newest first, rows without a date last."""
    b = books.select(F.col("id").alias("book_id"), "title", "author")
    return user_books.filter("shelf = 'read'").join(b, "book_id").orderBy(F.desc_nulls_last("date_read"), "book_id")
