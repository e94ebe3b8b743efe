"""Entity matching: exact keys first, then the most similar title and author."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.similarity import token_sort_ratio
from marginalia.functions.text import normalize_author, normalize_title
from marginalia.operators.similar import Rule, nearest

# Fixed values of the match rule.
FLOOR, TITLE_SHARE = 50.0, 0.7
MATCHED_TITLE, MATCHED_AUTHOR, AMBIGUOUS = 88.0, 75.0, 65.0


def key_match(rows: DataFrame, books: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with book_id by the first of the keys that a book has; of books that share a key the smallest id."""
    out = rows.withColumn("book_id", F.lit(None).cast("long"))
    side = books.filter("isbn <> ''").groupBy("isbn").agg(F.min("id").alias("found"))
    for key in keys:
        out = out.join(side.withColumnRenamed("isbn", "_key"), F.col(key) == F.col("_key"), "left").withColumn("book_id", F.coalesce("book_id", "found")).drop("found", "_key")
    return out


def fuzzy_match(rows: DataFrame, books: DataFrame, floor: float = FLOOR) -> DataFrame:
    """rows: (row_id, title, author); books: (id, title, author). (row_id, book_id, score, match_status) with the best
    book of each row by 0.7 title + 0.3 author, of those whose titles reach the floor; ties by id.

    Distinct texts of both sides are compared once, in blocks with a bound; see similar.nearest().
    """
    left = rows.select("row_id", normalize_title(F.coalesce("title", F.lit(""))).alias("one"), normalize_author(F.coalesce("author", F.lit(""))).alias("two"))
    asked = left.select("one", "two").distinct().withColumn("id", F.xxhash64("one", "two"))
    known = books.select("id", normalize_title(F.coalesce("title", F.lit(""))).alias("one"), normalize_author(F.coalesce("author", F.lit(""))).alias("two")).groupBy("one", "two").agg(F.min("id").cast("long").alias("id"))
    found = nearest(asked, known, 1, Rule(TITLE_SHARE, floor))
    tier = F.when((F.col("first") >= MATCHED_TITLE) & (F.col("second") >= MATCHED_AUTHOR), "matched").when(F.col("score") >= AMBIGUOUS, "ambiguous").otherwise("unmatched")
    best = found.select(F.col("left_id").alias("_left"), F.col("right_id").alias("_book"), "score", tier.alias("tier"))
    return left.withColumn("_asked", F.xxhash64("one", "two")).join(best, F.col("_asked") == F.col("_left"), "left").select(
        "row_id", F.when(F.col("tier") != "unmatched", F.col("_book")).alias("book_id"), "score", F.coalesce("tier", F.lit("unmatched")).alias("match_status")
    )


def accepted_match(rows: DataFrame, books: DataFrame, floor: float = 60.0) -> DataFrame:
    """(row_id, book_id): as fuzzy_match() with a higher floor, sure matches only."""
    return fuzzy_match(rows, books, floor).filter("match_status = 'matched'").select("row_id", "book_id")


def popular_match(hits: DataFrame, least: float = 80.0) -> DataFrame:
    """hits: (row_id, title, author, hit_id, hit_title, hit_author, users), what a search returned for each row. The best
    hit of each row whose title and author reach `least` (an author is needed only where the row has one), by title +
    author + users / 1e6; ties by hit_id."""
    own, other = normalize_author(F.coalesce("author", F.lit(""))), normalize_author(F.coalesce("hit_author", F.lit("")))
    scored = hits.withColumn("ts", token_sort_ratio(normalize_title("title"), normalize_title("hit_title"))).withColumn("au", F.when((own != "") & (other != ""), token_sort_ratio(own, other)).otherwise(0.0))
    fits = scored.filter((F.col("ts") >= least) & ((F.col("au") >= least) | (own == "")))
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc(F.round(F.col("ts") + F.col("au") + F.coalesce("users", F.lit(0)) / 1e6, 6)), "hit_id"))
    return fits.withColumn("rank", rank).filter("rank = 1").select("row_id", "hit_id")


def pending(rows: DataFrame) -> DataFrame:
    """Unmatched rows by user and book, how often they were seen and when first."""
    return rows.filter("match_status = 'unmatched'").groupBy("user_id", "raw_title", "raw_author").agg(F.count("*").alias("seen_count"), F.min("date_read").alias("first_seen"))


_NEAR = "query_id long, vec_id long, score double"


def _unit(rows: list[dict]) -> np.ndarray:
    own = np.array([r["e"] for r in rows], np.float64)
    return own / np.maximum(np.sqrt((own * own).sum(1, keepdims=True)), 1e-300)


def _products(k: int):
    """The k of highest cosine in each pair of blocks, others than the query itself; of equal ones the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                queries, vectors = row["queries"], sorted(row["vectors"], key=lambda r: r["id"])
                ids = np.array([r["id"] for r in vectors])
                value = np.round(_unit(queries) @ _unit(vectors).T, 6)
                out = [[], [], []]
                for q, own in zip(queries, value, strict=True):
                    best = np.argsort(-np.where(ids == q["id"], -2.0, own), kind="stable")[:k]
                    best = best[ids[best] != q["id"]]
                    for column, x in zip(out, ([q["id"]] * len(best), ids[best].tolist(), own[best].tolist()), strict=True):
                        column += x
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def embedding_nearest(queries: DataFrame, vectors: DataFrame, k: int = 1, per_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of highest cosine; both sides (id, embedding). Each pair of a block of
    queries and a block of vectors is one matrix product, of which k a query leave the task."""

    def blocks(df: DataFrame, name: str, own: int, other: int, away: str) -> DataFrame:
        packed = df.select(F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias(f"{name}_block"), F.struct(F.col("id").cast("long").alias("id"), F.col("embedding").alias("e")).alias("e")).groupBy(f"{name}_block").agg(F.collect_list("e").alias(name))
        return packed.withColumn(f"{away}_block", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    n, m = (max(1, -(-df.count() // per_block)) for df in (queries, vectors))
    pairs = blocks(queries, "queries", n, m, "vectors").join(blocks(vectors, "vectors", m, n, "queries"), ["queries_block", "vectors_block"])
    found = pairs.select("queries", "vectors").mapInArrow(_products(k), _NEAR)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
