"""Vocabulary: routing, canonicalising, merge chains, upserts and nearest terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_raw
from marginalia.operators.similar import Rule, nearest, single


def term_stats(terms: DataFrame) -> DataFrame:
    """terms: (term, genre), a row per use. (term, n, bucket, genres): bucket is the genre of at least half of the uses,
    else cross-genre; genres counts the different ones."""
    by_genre = terms.groupBy("term", "genre").agg(F.count("*").alias("n"))
    top = F.max(F.struct(F.col("n"), F.col("genre"))).alias("top")
    return by_genre.groupBy("term").agg(F.sum("n").alias("n"), top, F.count("*").alias("genres")).select(
        "term", "n", F.when(F.col("top.n") * 2 >= F.col("n"), F.col("top.genre")).otherwise("cross-genre").alias("bucket"), "genres"
    )


def route_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """terms: (book_id, pos, term); vocabulary: (alias, slug, kind). (book_id, tropes, tags, unknown): known terms by
    kind in order, each once; spelling is looked up in its normal form."""
    known = terms.join(vocabulary, normalize_raw("term") == F.col("alias"), "left")
    pick = lambda cond, value: F.array_distinct(F.transform(F.filter(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", value.alias("value"))))), lambda x: x.isNotNull()), lambda x: x["value"]))
    return known.groupBy("book_id").agg(
        pick(F.col("kind") == "trope", F.col("slug")).alias("tropes"), pick(F.col("slug").isNotNull() & (F.col("kind") != "trope"), F.col("slug")).alias("tags"), pick(F.col("slug").isNull(), F.col("term")).alias("unknown")
    )


def resolve_chains(merges: DataFrame, depth: int = 5) -> DataFrame:
    """merges: (slug, into). (slug, target): the end of each chain of merges, at most `depth` steps on; a cycle stops
    there. Each round follows one more merge."""
    pairs = merges.filter("slug <> into").select("slug", F.col("into").alias("target"), F.lit(1).alias("steps"))
    for _ in range(depth - 1):
        step = merges.filter("slug <> into").select(F.col("slug").alias("at"), "into")
        pairs = pairs.join(step, F.col("target") == F.col("at"), "left").select("slug", F.coalesce("into", "target").alias("target"), (F.col("steps") + F.col("into").isNotNull().cast("int")).alias("steps"))
    return pairs.select("slug", "target")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes take the place of rows with the same key; others are added. Columns that changes lack stay."""
    cur, new = current.alias("c"), changes.alias("n")
    out = [F.coalesce(F.col(f"n.{c}"), F.col(f"c.{c}")).alias(c) if c in changes.columns else F.col(f"c.{c}") for c in current.columns]
    return cur.join(new, F.col(f"c.{key}") == F.col(f"n.{key}"), "full_outer").select(*out)


def canonicalise(books: DataFrame, decisions: DataFrame) -> DataFrame:
    """books: (book_id, tags); decisions: (term, decision, target) with drop, merge or activate. Tags with the decisions
    applied, each once and in order."""
    tags = books.select("book_id", F.posexplode("tags").alias("pos", "term")).join(decisions, "term", "left")
    kept = tags.filter("decision IS NULL OR decision <> 'drop'").withColumn("tag", F.when(F.col("decision") == "merge", F.col("target")).otherwise(F.col("term")))
    lists = kept.groupBy("book_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"])).alias("tags"))
    return books.select("book_id").join(lists, "book_id", "left").select("book_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def nearest_terms(terms: DataFrame, vocabulary: DataFrame, k: int = 3, least: float = 0.0) -> DataFrame:
    """(term, rank, display, score): the k displays most like each term, of `least` or more; ties by display."""
    asked = terms.select("term").distinct().withColumn("id", F.xxhash64("term"))
    shown = vocabulary.select("display").distinct()
    shown = shown.withColumn("id", F.row_number().over(Window.orderBy("display")).cast("long"))  # a vocabulary is small, and its order breaks ties
    found = nearest(single(asked, F.col("id"), F.col("term")), single(shown, F.col("id"), F.col("display")), k, Rule(least=least))
    named = found.join(asked, F.col("left_id") == asked["id"]).drop("id").join(shown.withColumnRenamed("id", "_shown"), F.col("right_id") == F.col("_shown"))
    return named.select("term", "rank", "display", "score")
