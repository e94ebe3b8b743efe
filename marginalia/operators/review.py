"""Reviews: full pattern runs, batches from matches, exports and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import snippet
from marginalia.operators.lexical import Pattern, clean_description, matches

# Words of a decision that rejects.
REJECTING = ("reject", "no", "drop")
# Tags of identity, and the umbrella tag that follows from them.
IDENTITY_TAGS, UMBRELLA_TAG = ("lesbian", "sapphic", "bisexual", "transgender", "gay"), "lgbtq"


def described(books: DataFrame, metadata: DataFrame, sources: Sequence[str]) -> DataFrame:
    """books with the description of the first source that has one; a blank one hides the later ones, and books without
    text are left out. metadata: (book_id, source, description)."""
    firsts = [F.first(F.when(F.col("source") == s, F.col("description")), True).alias(f"_{i}") for i, s in enumerate(sources)]
    wide = metadata.groupBy("book_id").agg(*firsts).select(F.col("book_id").alias("_book"), F.coalesce(*(F.col(f"_{i}") for i in range(len(sources)))).alias("description"))
    return books.join(wide, F.col("id") == F.col("_book")).drop("_book").filter(F.trim("description") != "")


def in_genre(genres: Column, parts: Sequence[str]) -> Column:
    """Whether a genre holds one of the parts, in any ASCII case."""
    return F.coalesce(F.exists(genres, lambda g: F.lower(g).rlike("|".join(p.lower() for p in parts))), F.lit(False))


def run_pack(books: DataFrame, pack: Sequence[Pattern], limit: int | None, field: str = "tropes", clean: bool = True, veto: str | None = None, implied: bool = False) -> DataFrame:
    """(id, ord, slug, tier, phrase, context): the first `limit` patterns of the pack that hit each book's description, in
    the pack's order, all of one pass over the text.

    Boilerplate is cut first where `clean` is set, and texts that are no plot, or that `veto` hits, are left out. Slugs
    that the book's `field` has already aren't proposed again. With `implied` an identity tag adds the umbrella tag last.
    """
    text = clean_description(F.col("description"), F.col("title")) if clean else F.col("description")
    own = books.withColumn("_text", text).filter("_text IS NOT NULL")
    if veto:
        own = own.filter(~F.col("_text").rlike(f"(?iu){veto}"))
    have = F.coalesce(F.col(field), F.array().cast("array<string>"))
    found = F.filter(matches(F.col("_text"), pack, context=True), lambda m: ~F.array_contains(have, m["slug"]))
    if implied:
        slugs = F.transform("_found", lambda m: m["slug"])
        umbrella = F.struct(F.lit(len(pack)).alias("ord"), F.lit(UMBRELLA_TAG).alias("slug"), F.lit("A").alias("tier"), F.lit("(implied by identity tag)").alias("phrase"), F.lit("added because a specific identity tag fired").alias("context"))
        more = F.arrays_overlap(slugs, F.array(*map(F.lit, IDENTITY_TAGS))) & ~F.array_contains(slugs, UMBRELLA_TAG)
        own = own.withColumn("_found", found)
        found = F.when(more, F.array_append("_found", umbrella)).otherwise(F.col("_found"))
    rows = own.select("id", F.explode(F.slice(found, 1, limit) if limit else found).alias("m"))
    return rows.select("id", "m.*")


def tag_batch(rows: DataFrame, cap: int) -> DataFrame:
    """(id, slugs, tiers, confidence) of review rows (id, seq, slug, tier, decision) that weren't rejected: a book's slugs
    once and in order, at most `cap`; high where all tiers are A."""
    kept = rows.filter(~F.coalesce(F.lower(F.trim("decision")).isin(*REJECTING), F.lit(False)))
    first = kept.groupBy("id", "slug").agg(F.min("seq").alias("seq"), F.collect_set("tier").alias("tiers"))
    out = first.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "slug"))), lambda x: x["slug"]), 1, cap).alias("slugs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tiers")))).alias("tiers"))
    return out.select("id", "slugs", F.array_join("tiers", "/").alias("tiers"), F.when(F.array_join("tiers", "") == "A", "high").otherwise("medium").alias("confidence"))


def refiltered(rows: DataFrame, books: DataFrame, veto: str) -> DataFrame:
    """Review rows (id, …) whose book's cleaned description is a plot that `veto` doesn't hit. books: (id, title,
    description)."""
    text = clean_description(F.col("description"), F.col("title"))
    good = books.select("id", text.alias("_text")).filter(F.col("_text").isNotNull() & ~F.col("_text").rlike(f"(?iu){veto}")).select("id")
    return rows.join(good, "id", "left_semi")


def split_rows(rows: DataFrame, held: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, hold): rows by whether their slug is one of `held`."""
    hit = F.coalesce(F.col("slug").isin(*held), F.lit(False))
    return rows.filter(~hit), rows.filter(hit)


def export(staged: DataFrame, books: DataFrame, descriptions: DataFrame, status: str = "pending") -> DataFrame:
    """One row per staged book of a status for a reviewer: what it was, what it would get, and a snippet of its text.
    staged: (id, status, run, model, confidence, known, book_class, tropes, tags, before_image); descriptions: (id,
    description)."""
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    b = books.select("id", "title", "author", "genres")
    out = staged.filter(F.col("status") == status).join(b, "id").join(descriptions, "id", "left")
    text = F.coalesce("description", F.lit(""))
    return out.select(
        F.lit("").alias("decision"), "status", F.coalesce("run", F.lit("")).alias("promote_run"), F.col("id").alias("book_id"), "title", "author", "model", "confidence", F.when(F.coalesce("known", F.lit(True)), "yes").otherwise("NO").alias("known"), "book_class",
        join(F.col("genres")).alias("genres_before"), join(F.col("before_image.tropes")).alias("tropes_before"), join(F.col("before_image.tags")).alias("tags_before"), join(F.col("tropes")).alias("tropes_new"), join(F.col("tags")).alias("tags_new"),
        F.when(F.trim(text) != "", "yes").otherwise("no").alias("grounded"), snippet(text, 300).alias("snippet"),
    )


def coverage(books: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row of the catalogue's coverage: books, archived, recommendable, with tropes, with tags, with both, those with a
    trope or a tag that is no mood, those with moods only, and the recommendable share in whole percent. kinds: (slug,
    kind)."""
    live = books.withColumn("archived", F.coalesce(F.col("status").startswith("archived"), F.lit(False)))
    some = live.select("id", "archived", F.coalesce(F.size("tropes") > 0, F.lit(False)).alias("trope"), F.coalesce(F.size("tags") > 0, F.lit(False)).alias("tag"))
    tags = live.select("id", F.explode("tags").alias("slug")).join(kinds, "slug", "left").groupBy("id").agg(F.bool_or(F.coalesce(F.col("kind") != "mood", F.lit(False))).alias("real"), F.bool_and(F.coalesce(F.col("kind") == "mood", F.lit(False))).alias("moods"))
    one = some.join(tags, "id", "left").withColumn("real", F.col("trope") | F.coalesce("real", F.lit(False))).withColumn("moods", F.coalesce("moods", F.lit(False)) & ~F.col("trope"))
    count = lambda c: F.count_if(~F.col("archived") & c)
    out = one.agg(F.count("*").alias("books"), F.count_if("archived").alias("archived"), count(F.col("trope") | F.col("tag")).alias("recommendable"), count(F.col("trope")).alias("with_trope"), count(F.col("tag")).alias("with_tag"), count(F.col("trope") & F.col("tag")).alias("with_both"), count(F.col("real")).alias("meaningful"), count(F.col("moods")).alias("mood_only"))
    return out.withColumn("share", F.floor(F.col("recommendable") * 100 / F.nullif(F.col("books") - F.col("archived"), F.lit(0))).cast("int"))
