"""Bulk metadata: works, authors and editions of a dump joined with the catalogue, and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.similarity import token_sort_ratio
from marginalia.functions.text import first_year, normalize_author, normalize_title


def works(dump: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, title, authors, description, subjects) of a dump's work records, after the columns to keep."""
    j = F.col("json")
    authors = F.coalesce(F.regexp_extract_all(F.get_json_object(j, "$.authors"), F.lit('"(/authors/[^"]+)"'), 1), F.array().cast("array<string>"))
    text = F.coalesce(F.get_json_object(j, "$.description.value"), F.get_json_object(j, "$.description"))
    return dump.filter("type = '/type/work'").select(*keep, F.get_json_object(j, "$.key").alias("key"), F.get_json_object(j, "$.title").alias("title"), authors.alias("authors"), F.nullif(F.trim(text), F.lit("")).alias("description"), F.from_json(F.get_json_object(j, "$.subjects"), "array<string>").alias("subjects"))


def confirm_works(books: DataFrame, work: DataFrame, author_names: DataFrame, least: float = 90.0) -> DataFrame:
    """(key, id, verified): works with a book's normal title whose authors' names, together, are alike enough or missing on
    a side; a work belongs to the smallest book id that it fits. Only authors of works with a title match are read."""
    b = books.select("id", normalize_title("title").alias("nt"), normalize_author(F.coalesce("author", F.lit(""))).alias("na")).filter("nt <> ''")
    b = b.groupBy("nt", "na").agg(F.min("id").alias("id"))  # books of one title and author fit the same works
    hit = work.select("key", normalize_title("title").alias("nt"), "authors").join(b, "nt")
    needed = hit.select("key", F.posexplode("authors").alias("pos", "author")).distinct()
    names = needed.join(author_names.select(F.col("key").alias("author"), "name"), "author").filter("name IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("names"))
    joined = hit.join(names, "key", "left").withColumn("nb", normalize_author(F.coalesce(F.array_join(F.transform("names", lambda x: x["name"]), ", "), F.lit(""))))
    missing = (F.col("na") == "") | (F.col("nb") == "")
    pairs = joined.filter(~missing).select("na", "nb").distinct().withColumn("alike", token_sort_ratio(F.col("na"), F.col("nb")))
    fits = joined.join(pairs, ["na", "nb"], "left").filter(missing | (F.col("alike") >= least))
    return fits.groupBy("key").agg(F.min_by(F.struct("id", (~missing).alias("verified")), "id").alias("b")).select("key", "b.id", "b.verified")


def work_rollup(confirmed: DataFrame, work: DataFrame) -> DataFrame:
    """(id, work_key, description, subjects): of a book's confirmed works (key, id), in the order of `seq`, the first
    description, all subjects sorted and once, and the last key. work: (key, seq, description, subjects)."""
    own = confirmed.select("key", "id").join(work, "key")
    subjects = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("subjects", F.array().cast("array<string>"))))))
    return own.groupBy("id").agg(F.max_by("key", "seq").alias("work_key"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("description"), subjects.alias("subjects"))


def editions_of(editions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(id, seq, isbn, date, pages), a row for each ISBN, of editions (seq, works, isbns, date, pages): an edition belongs
    to the book of its first work that is confirmed."""
    works_ = editions.select("seq", F.posexplode("works").alias("pos", "key")).join(confirmed.select("key", "id"), "key").groupBy("seq").agg(F.min_by("id", "pos").alias("id"))
    return editions.join(works_, "seq").select("id", "seq", F.explode_outer(F.filter(F.transform("isbns", lambda x: F.trim(F.replace(x, F.lit("-"), F.lit("")))), lambda x: x != "")).alias("isbn"), "date", F.when(F.col("pages") > 0, F.col("pages")).alias("pages"))


def fill_empty(books: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """books with the columns' nulls filled from found (id, …); nothing that a book has is changed."""
    new = found.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = books.join(new, F.col("id") == F.col("_id"), "left")
    return both.select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in books.columns))


def edition_rollup(editions: DataFrame) -> DataFrame:
    """editions: (id, seq, isbn, date, pages). (id, isbns, isbn, year, pages): all ISBNs sorted, the first of 13 digits
    or else the first, the earliest year, the first number of pages. `seq` orders a book's editions; where it may repeat,
    give a struct that tells them apart."""
    out = editions.groupBy("id").agg(F.array_sort(F.collect_set("isbn")).alias("isbns"), F.min(first_year("date")).alias("year"), F.min_by("pages", F.when(F.col("pages").isNotNull(), F.col("seq"))).alias("pages"))
    return out.select("id", "isbns", F.coalesce(F.get(F.filter("isbns", lambda x: F.length(x) == 13), F.lit(0)), F.get("isbns", F.lit(0))).alias("isbn"), "year", "pages")


def shared_keys(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """Keys that more than one id has."""
    return rows.select(key, id_).distinct().groupBy(key).agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).filter("n > 1")


def by_source(meta: DataFrame, sources: list[str], value: str) -> DataFrame:
    """(id, value): the first source that isn't null, in this order; a blank one hides the later ones."""
    wide = meta.groupBy("id").pivot("source", sources).agg(F.first(value, True))
    return wide.select("id", F.coalesce(*(F.col(f"`{s}`") for s in sources)).alias(value))


def priority_tiers(candidates: DataFrame) -> DataFrame:
    """candidates: (id, tier, rank). Each id once, in its first tier and by its best rank there, with its place in the
    tier. Rows are dealt by ranges of tier, rank and id, so no task needs a whole tier; places are counted in each range
    and the ranges' sizes added."""
    best = candidates.groupBy("id").agg(F.min(F.struct("tier", F.coalesce("rank", F.lit(10**9)).alias("rank"))).alias("b")).select("id", "b.tier", "b.rank")
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = best.repartitionByRange(parts, "tier", "rank", "id").withColumn("part", F.spark_partition_id())
    placed = step.withColumn("own", F.row_number().over(Window.partitionBy("part", "tier").orderBy("rank", "id")))
    sizes = step.groupBy("tier", "part").agg(F.count("*").alias("n"))  # a row for each range and tier
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("tier", "part", "before")
    return placed.join(F.broadcast(before), ["tier", "part"]).select("id", "tier", "rank", (F.col("own") + F.col("before")).cast("int").alias("place"))


def neighbour_scores(reads: DataFrame, books: DataFrame) -> DataFrame:
    """(id, score): 0.3 genres + 0.7 tags by IDF, of what a reader (book_id, user_rating) liked: 2 for 5 stars, 1 for 4 and
    0.5 without a rating, half stars cut off. The IDF is over all books' tags."""
    stars = F.floor(F.coalesce("user_rating", F.lit(0.0)))
    weight = F.when(stars == 5, 2.0).when(stars == 4, 1.0).when(stars.isin(3, 2, 1), 0.0).otherwise(0.5)
    rated = reads.groupBy("book_id").agg(F.last("user_rating").alias("user_rating")).select("book_id", weight.alias("w")).filter("w > 0")
    genres = books.select("id", F.explode("genres").alias("feature"), F.lit("genre").alias("kind"))
    tags = books.select("id", F.explode("tags").alias("feature"), F.lit("tag").alias("kind"))
    every = genres.unionByName(tags)
    liked = every.join(rated, F.col("id") == F.col("book_id")).groupBy("kind", "feature").agg(F.sum("w").alias("w"))
    df = tags.distinct().groupBy("feature").agg(F.count("*").alias("df")).crossJoin(F.broadcast(books.agg(F.count("*").alias("n")))).select(F.lit("tag").alias("kind"), "feature", F.log(F.col("n") / F.col("df")).alias("idf"))
    part = F.col("w") * F.when(F.col("kind") == "genre", 0.3).otherwise(0.7 * F.coalesce("idf", F.lit(1.0)))
    scored = every.join(liked, ["kind", "feature"]).join(df, ["kind", "feature"], "left").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.filter("score > 0")


def needs_tropes(books: DataFrame, tropes: DataFrame, least: int = 3) -> DataFrame:
    """Books (id, …, book_class) of a fiction-like class with fewer than `least` canonical tropes (slug)."""
    good = books.select("id", F.explode("tropes").alias("slug")).join(tropes.select("slug").distinct(), "slug").groupBy("id").agg(F.count("*").alias("_n"))
    return books.join(good, "id", "left").filter((F.coalesce("_n", F.lit(0)) < least) & F.col("book_class").isin("fiction", "childrens", "ambiguous")).drop("_n")
