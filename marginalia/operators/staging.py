"""Staged enrichment: validated batches, promotion that only adds, and rollback from the image before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_raw, slugify, staged_spice, union_by_key
from marginalia.operators.resolve import normalized_warnings

ARRAYS, SCALARS = ("tropes", "tags"), ("pacing", "spice_level", "focus")


def _placed(kind: str):
    return lambda s, i: F.struct(F.lit(kind).alias("as"), i.alias("pos"), s.alias("slug"))


def ingest(results: DataFrame, vocabulary: DataFrame, books: DataFrame, trope_cap: int = 8) -> DataFrame:
    """results: (id, known, confidence, tropes, tags, pacing, spice_level, focus); vocabulary: (slug, kind).

    Staged rows keep slugs of the right kind, at most `trope_cap` tropes, and the book as it was; other slugs are
    proposed. A result for an unknown book without any slug is left out.
    """
    terms = results.select("id", F.explode(F.concat(*(F.transform(c, _placed(k)) for k, c in (("trope", "tropes"), ("tag", "tags"))))).alias("t")).select("id", "t.*")
    checked = terms.join(vocabulary, "slug", "left").withColumn("fits", F.coalesce((F.col("kind") == "trope") == (F.col("as") == "trope"), F.lit(False)))
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "slug")))), lambda x: x["slug"])
    lists = checked.groupBy("id").agg(F.slice(F.array_distinct(pick(F.col("fits") & (F.col("as") == "trope"))), 1, trope_cap).alias("ok_tropes"), F.array_distinct(pick(F.col("fits") & (F.col("as") == "tag"))).alias("ok_tags"), F.array_distinct(pick(~F.col("fits"))).alias("proposed"))
    none = F.array().cast("array<string>")
    before = books.select("id", F.struct(*ARRAYS, *SCALARS).alias("before_image"))
    staged = results.drop(*ARRAYS).join(lists, "id", "left").join(before, "id")
    staged = staged.select("id", "known", "confidence", F.coalesce("ok_tropes", none).alias("tropes"), F.coalesce("ok_tags", none).alias("tags"), *SCALARS, F.coalesce("proposed", none).alias("proposed"), "before_image")
    return staged.filter(F.col("known") | (F.size("tropes") + F.size("tags") > 0))


def promote(books: DataFrame, staged: DataFrame) -> DataFrame:
    """Books with the staged arrays added and empty scalars filled; nothing that a book has is taken or changed."""
    s = staged.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in (*ARRAYS, *SCALARS)))
    wide = books.join(s, F.col("id") == F.col("_id"), "left")
    new = {c: F.when(F.col("_id").isNotNull(), union_by_key(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)) for c in ARRAYS}
    new |= {c: F.when(F.col(c).isNull() | F.col(c).isin("", "N/A"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in SCALARS}
    return wide.select(*((new[c].alias(c) if c in new else F.col(c)) for c in books.columns))


def rollback(books: DataFrame, staged: DataFrame) -> DataFrame:
    """Books with the image before of every staged row put back."""
    wide = books.join(staged.select(F.col("id").alias("_id"), F.col("before_image").alias("_b")), F.col("id") == F.col("_id"), "left")
    old = {c: F.when(F.col("_id").isNotNull(), F.col(f"_b.{c}")).otherwise(F.col(c)) for c in (*ARRAYS, *SCALARS)}
    return wide.select(*((old[c].alias(c) if c in old else F.col(c)) for c in books.columns))


def changed(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Incoming rows that are new, or differ from the current row in one of the columns; with `action`."""
    cur = current.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    wide = incoming.join(cur, F.col(key) == F.col("_key"), "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(F.col("_key").isNull(), "insert").when(differs, "update")
    return wide.withColumn("action", action).filter("action IS NOT NULL").select(*incoming.columns, "action")


def repair_genres(books: DataFrame, source: DataFrame) -> DataFrame:
    """(id, genres): books that share no genre with their source get the source's before their own."""
    both = books.select("id", "genres").join(source.select(F.col("id").alias("_id"), F.col("genres").alias("_g")), F.col("id") == F.col("_id"), "left")
    lost = F.col("_g").isNotNull() & ~F.arrays_overlap("genres", "_g")
    return both.select("id", F.when(lost, F.array_union("_g", "genres")).otherwise(F.col("genres")).alias("genres"))


# What a staged scalar may be.
PACINGS, FOCUSES = ("Slow", "Medium", "Fast"), ("Plot", "Character", "World")


def staged_results(results: DataFrame, vocabulary: DataFrame, books: DataFrame, staged: DataFrame | None = None, trope_cap: int = 8) -> DataFrame:
    """Validated rows to stage: id, known, book_class, confidence, tropes, tags, content_warnings, pacing, spice_level,
    focus, proposed, stage and before_image.

    results: (id, known, book_class, confidence, tropes, tags, subjects, content_warnings, pacing, spice_level, focus);
    vocabulary: active (slug, kind); books: (id, book_class, tropes, tags, content_warnings, pacing, spice_level, focus).
    Slugs of another kind than their field's are proposed; subjects become tags. Non-fiction and poetry have no tropes,
    children's books no spice; other values than the known ones are left out. A result that is unsure or empty needs
    escalation, and one that doesn't know the book keeps no slugs. A result for no book, or one that doesn't
    know a book that has vocabulary, is left out. An image that was staged before stays.
    """
    none = F.array().cast("array<string>")
    fields = (("tropes", "trope"), ("tags", "tag"), ("subjects", "subject"), ("content_warnings", "warning"))
    lists = F.concat(*(F.transform(F.coalesce(f, none), _wanted(i, f, k)) for i, (f, k) in enumerate(fields)))
    own = books.select(F.col("id").alias("_id"), F.col("book_class").alias("_class"), (F.size(F.coalesce("tropes", none)) + F.size(F.coalesce("tags", none)) > 0).alias("_some"), F.struct(*ARRAYS, "content_warnings", *SCALARS).alias("before_image"))
    known = results.join(own, F.col("id") == F.col("_id")).filter(F.coalesce("known", F.lit(True)) | ~F.col("_some"))
    terms = known.select("id", F.posexplode(lists).alias("pos", "t")).select("id", "pos", "t.*").join(vocabulary.select("slug", "kind"), "slug", "left").withColumn("fits", F.coalesce(F.col("kind") == F.col("want"), F.lit(False)))
    pick = lambda cond: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("place", "pos", "slug")))), lambda x: x["slug"]))
    fit = lambda *names: F.col("fits") & F.col("field").isin(*names)
    sorted_ = terms.groupBy("id").agg(pick(fit("tropes")).alias("_tropes"), pick(fit("tags", "subjects")).alias("_tags"), pick(fit("content_warnings")).alias("_warnings"), pick(~F.col("fits")).alias("_proposed"))
    klass = F.coalesce(F.nullif("book_class", F.lit("")), "_class", F.lit("ambiguous"))
    joined = known.drop("tropes", "tags", "content_warnings").join(sorted_, "id", "left").withColumn("klass", klass)
    sure, level = F.coalesce("known", F.lit(True)), F.coalesce("confidence", F.lit("medium"))
    tropes = F.when(F.col("klass").isin("nonfiction", "poetry_drama"), none).otherwise(F.slice(F.coalesce("_tropes", none), 1, trope_cap))
    tags = F.coalesce("_tags", none)
    spice = F.when(F.col("klass") == "childrens", "N/A").otherwise(staged_spice("spice_level"))
    one_of = lambda c, values: F.when(F.col(c).isin(*values), F.col(c))
    stage = F.when(~sure | (level == "low") | (F.size(tropes) + F.size(tags) == 0), "needs_escalation").otherwise("enriched")
    out = joined.select(
        "id", sure.alias("known"), F.col("klass").alias("book_class"), level.alias("confidence"), F.when(sure, tropes).otherwise(none).alias("tropes"), F.when(sure, tags).otherwise(none).alias("tags"), F.coalesce("_warnings", none).alias("content_warnings"),
        one_of("pacing", PACINGS).alias("pacing"), spice.alias("spice_level"), one_of("focus", FOCUSES).alias("focus"), F.coalesce("_proposed", none).alias("proposed"), stage.alias("stage"), "before_image",
    )
    if staged is None:
        return out
    old = staged.select(F.col("id").alias("_old"), F.col("before_image").alias("_image"))
    return out.join(old, F.col("id") == F.col("_old"), "left").withColumn("before_image", F.coalesce("_image", "before_image")).drop("_old", "_image")


def _wanted(place: int, field: str, kind: str):
    return lambda s: F.struct(F.lit(place).alias("place"), F.lit(field).alias("field"), F.lit(kind).alias("want"), s.alias("slug"))


def selected(staged: DataFrame, decisions: DataFrame | None = None, auto: bool = False, medium: bool = False) -> DataFrame:
    """staged with `outcome`: rejected, left_pending, skipped_unknown or promote. decisions: (id, decision), a person's
    approve or reject; without one a row is promoted where `auto` holds and its confidence is high, or medium too."""
    own = staged if decisions is None else staged.join(decisions.select(F.col("id").alias("_id"), F.lower(F.trim("decision")).alias("_decision")).filter("_decision <> ''"), F.col("id") == F.col("_id"), "left").drop("_id")
    decision = F.lit(None).cast("string") if decisions is None else F.col("_decision")
    fine = F.lit(auto) & (F.col("confidence").isin("high", "medium") if medium else F.col("confidence") == "high")
    outcome = F.when(decision == "reject", "rejected").when(~F.coalesce(decision == "approve", F.lit(False)) & ~F.coalesce(fine, F.lit(False)), "left_pending").when(~F.coalesce("known", F.lit(True)), "skipped_unknown").otherwise("promote")
    return own.withColumn("outcome", outcome).drop("_decision")


def stamped(staged: DataFrame, run: str, at: Column) -> DataFrame:
    """Staged rows as from selected() with their status after the run, and the run and time of those it promoted."""
    hit = F.col("outcome") == "promote"
    status = F.when(hit, "approved").when(F.col("outcome") == "rejected", "rejected").otherwise("pending")
    return staged.withColumn("status", status).withColumn("run", F.when(hit, run)).withColumn("promoted_at", F.when(hit, at))


def rolled_back(books: DataFrame, staged: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """(books, staged) before a run: its rows' images put back, and the rows pending again."""
    hit = F.coalesce(F.col("run") == run, F.lit(False))
    again = staged.withColumn("status", F.when(hit, "pending").otherwise(F.col("status"))).withColumn("promoted_at", F.when(~hit, F.col("promoted_at"))).withColumn("run", F.when(~hit, F.col("run")))
    return rollback(books, staged.filter(hit)), again


def snapshot(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """The old values (id, columns) of the rows that an edit changes, to be stored before it."""
    new = after.select(F.col("id").alias("_id"), F.struct(*columns).alias("_new"))
    return before.join(new, F.col("id") == F.col("_id")).filter(~F.struct(*columns).eqNullSafe(F.col("_new"))).select("id", *columns)


def restored(current: DataFrame, saved: DataFrame) -> DataFrame:
    """current with the saved columns of saved (id, …) put back."""
    columns = [c for c in saved.columns if c != "id"]
    old = saved.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = current.join(old, F.col("id") == F.col("_id"), "left")
    return both.select(*(F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def reverted_flips(states: DataFrame, saved: DataFrame) -> DataFrame:
    """States (id, book_class) with flips to non-fiction taken back; rescues to fiction stay. saved: (id, old_class,
    new_class)."""
    back = saved.filter("new_class = 'nonfiction' AND old_class IS NOT NULL AND old_class <> 'nonfiction'").select(F.col("id").alias("_id"), "old_class")
    return states.join(back, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("old_class", "book_class").alias("book_class"))


def merged_source(books: DataFrame, entries: DataFrame, vocabulary: DataFrame, aliases: DataFrame, warnings: tuple[dict[str, str], list[str]] = ({}, [])) -> tuple[DataFrame, DataFrame]:
    """(books, proposed): books (id, tropes, tags, content_warnings, spice_level) with what a source's entries (id,
    tropes, tags, content_warnings, spice_level) add, and the raw terms, with their uses, that are no active slug.

    A term is its own slug, or that of its alias; kind trope goes to tropes, the rest to tags. Warnings are respelled as
    reviewed and added in any case once; an empty spice is filled. vocabulary: active (slug, kind).
    """
    none = F.array().cast("array<string>")
    terms = entries.select("id", F.posexplode(F.concat(F.coalesce("tropes", none), F.coalesce("tags", none))).alias("pos", "raw"))
    live = vocabulary.select("slug", "kind").dropDuplicates(["slug"])
    own = terms.withColumn("self", slugify("raw")).withColumn("norm", normalize_raw("raw"))
    own = own.join(live.select(F.col("slug").alias("self"), F.col("kind").alias("self_kind")), "self", "left")
    via = aliases.join(live, "slug").select(F.col("alias").alias("norm"), F.col("slug").alias("via"), F.col("kind").alias("via_kind")).dropDuplicates(["norm"])
    own = own.join(via, "norm", "left").withColumn("slug", F.when(F.col("self_kind").isNotNull(), F.col("self")).otherwise(F.col("via"))).withColumn("kind", F.coalesce("self_kind", "via_kind"))
    pick = lambda cond: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "slug")))), lambda x: x["slug"]))
    trope = F.coalesce(F.col("kind") == "trope", F.lit(False))
    lists = own.filter("slug IS NOT NULL").groupBy("id").agg(pick(trope).alias("_tropes"), pick(~trope).alias("_tags"))
    more = entries.select(F.col("id").alias("_id"), normalized_warnings(F.coalesce("content_warnings", none), *warnings).alias("_warnings"), F.col("spice_level").alias("_spice")).join(lists.withColumnRenamed("id", "_list"), F.col("_id") == F.col("_list"), "left")
    both = books.join(more, F.col("id") == F.col("_id"), "left")
    plus = lambda c, new: F.concat(F.coalesce(c, none), F.array_except(F.coalesce(new, none), F.coalesce(c, none)))
    spice = F.when(F.col("spice_level").isNull() | F.col("spice_level").isin("", "N/A"), F.coalesce(F.nullif("_spice", F.lit("")), "spice_level")).otherwise(F.col("spice_level"))
    changed = {"tropes": plus(F.col("tropes"), F.col("_tropes")), "tags": plus(F.col("tags"), F.col("_tags")), "content_warnings": union_by_key(F.col("content_warnings"), F.transform(F.coalesce("_warnings", none), lambda x: F.trim(x))), "spice_level": spice}
    proposed = own.filter("slug IS NULL").groupBy("raw").agg(F.count("*").alias("n"))
    return both.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in books.columns)), proposed
