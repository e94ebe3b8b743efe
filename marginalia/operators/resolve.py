"""Raw vocabulary to slugs: blocklist, aliases, nearest displays, review tiers and rulings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import genre_file, normalize_raw, percent, slugify
from marginalia.operators.taxonomy import nearest_terms
from marginalia.operators.upkeep import headings

# Scores from which a term is an alias, and from which it is worth a review; cosine for a suggestion.
ALIAS_SCORE, REVIEW_SCORE, CANON_REVIEW_SCORE, SUGGEST_COSINE = 92.0, 80.0, 70.0, 0.80
# Words of a new slug that make it a subgenre.
SUBGENRE_WORDS = ("romance", "thriller", "fantasy", "mystery", "horror", "fiction", "sci-fi", "scifi")
# Terms that are a pacing.
PACING_TERMS = {
    "fast-paced": "Fast", "fast paced": "Fast", "fastpaced": "Fast", "medium-paced": "Medium", "medium paced": "Medium",
    "slow-paced": "Slow", "slow paced": "Slow", "slowpaced": "Slow",
}


def is_blocked(raw: Column) -> Column:
    """Whether a raw term is a shelf, format, rating or number and no vocabulary."""
    low, norm = F.lower(F.trim(raw)), normalize_raw(raw)
    parts = low.contains(rules.BLOCKED_PARTS[0])
    for p in rules.BLOCKED_PARTS[1:]:
        parts = parts | low.contains(p)
    starts = low.startswith(rules.BLOCKED_PREFIXES[0])
    for p in rules.BLOCKED_PREFIXES[1:]:
        starts = starts | low.startswith(p)
    return (F.length(norm) < 2) | starts | norm.isin(*rules.BLOCKED_WHOLE) | low.isin(*rules.BLOCKED_WHOLE) | parts | norm.rlike("|".join(rules.BLOCKED_PATTERNS)) | norm.rlike(r"^[\d\s\-]+$")


def raw_vocabulary(books: DataFrame) -> DataFrame:
    """(raw, freq): every trope and tag that isn't blank, trimmed, with its uses."""
    none = F.array().cast("array<string>")
    return books.select(F.explode(F.concat(F.coalesce("tropes", none), F.coalesce("tags", none))).alias("raw")).select(F.trim("raw").alias("raw")).filter("raw <> ''").groupBy("raw").agg(F.count("*").alias("freq"))


def resolve(raw: DataFrame, vocabulary: DataFrame, aliases: DataFrame, cosines: DataFrame | None = None) -> DataFrame:
    """(raw, freq, method, slug, score) of raw terms (raw, freq); vocabulary: (slug, display, status); aliases: (alias,
    slug).

    Known aliases come first, then the blocklist, then the nearest active display: from 92 on it is an alias, and its
    spelling counts as one for later terms, by falling use. Without cosines the next tier is a review from 80 on; with
    cosines (norm, slug, score), the nearest term's by embedding, it is a suggestion from 0.80 on. The rest is proposed.
    """
    active = vocabulary.filter("status = 'active'").select("slug", "display")
    own = raw.withColumn("norm", normalize_raw("raw"))
    known = own.join(aliases.select(F.col("alias").alias("norm"), F.col("slug").alias("alias_slug")), "norm", "left").withColumn("blocked", is_blocked(F.col("raw")))
    open_ = known.filter("alias_slug IS NULL").select(F.col("norm").alias("term")).filter("term <> ''").distinct()
    near = nearest_terms(open_, active, 1, REVIEW_SCORE).join(active.groupBy("display").agg(F.min("slug").alias("near_slug")), "display").select(F.col("term").alias("norm"), "near_slug", F.col("score").alias("near"))
    joined = known.join(near, "norm", "left")
    order = Window.partitionBy("norm").orderBy(F.desc("freq"), "raw").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max((~F.col("blocked")).cast("int")).over(order), F.lit(0)) == 1
    fuzzy = F.coalesce(F.col("near") >= ALIAS_SCORE, F.lit(False))
    method = F.when(F.col("alias_slug").isNotNull(), "alias").when(fuzzy & earlier, "alias").when(F.col("blocked"), "blocklist").when(fuzzy, "fuzzy")
    tiered = joined.withColumn("method", method)
    if cosines is None:
        left = F.when(F.col("near") >= REVIEW_SCORE, "fuzzy_review").otherwise("proposed")
        slug, score = F.when(F.col("near") >= REVIEW_SCORE, F.col("near_slug")), F.col("near")
    else:
        tiered = tiered.join(cosines.select("norm", F.col("slug").alias("cos_slug"), F.col("score").alias("cosine")), "norm", "left")
        good = F.coalesce(F.col("cosine") >= SUGGEST_COSINE, F.lit(False))
        left, slug, score = F.when(good, "embed_suggest").otherwise("proposed"), F.when(good, F.col("cos_slug")), F.col("cosine")
    out = tiered.withColumn("how", F.coalesce("method", left))
    found = F.when(F.col("alias_slug").isNotNull(), F.col("alias_slug")).when(F.col("how").isin("alias", "fuzzy"), F.col("near_slug")).when(F.col("how").isin("fuzzy_review", "embed_suggest"), slug)
    points = F.when(F.col("how") == "alias", 100.0).when(F.col("how") == "fuzzy", F.col("near")).when(F.col("how") != "blocklist", score)
    return out.select("raw", "freq", F.col("how").alias("method"), F.when(F.col("how") == "proposed", slugify("raw")).otherwise(found).alias("slug"), points.alias("score"))


def subject_slugs(subjects: DataFrame, vocabulary: DataFrame, aliases: DataFrame, least: int = 3) -> DataFrame:
    """(id, slugs, resolved) of books' subject headings (id, subjects): their parts by alias or else by a display of 92 or
    more, each slug once in order; resolved with `least` of them."""
    parts = subjects.select("id", F.posexplode("subjects").alias("i", "subject")).select("id", "i", F.posexplode(headings(F.col("subject"))).alias("j", "part"))
    parts = parts.withColumn("part", F.btrim("part", F.lit(" .,;:"))).filter(F.length("part") >= 3).filter(~is_blocked(F.col("part"))).withColumn("norm", normalize_raw("part"))
    active = vocabulary.filter("status = 'active'").select("slug", "display")
    known = parts.join(aliases.select(F.col("alias").alias("norm"), F.col("slug").alias("alias_slug")), "norm", "left")
    near = nearest_terms(known.filter("alias_slug IS NULL").select(F.col("norm").alias("term")), active, 1, ALIAS_SCORE).join(active.groupBy("display").agg(F.min("slug").alias("near_slug")), "display").select(F.col("term").alias("norm"), "near_slug")
    found = known.join(near, "norm", "left").select("id", "i", "j", F.coalesce("alias_slug", "near_slug").alias("slug")).filter("slug IS NOT NULL")
    first = found.groupBy("id", "slug").agg(F.min(F.struct("i", "j")).alias("at"))
    lists = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "slug"))), lambda x: x["slug"]).alias("slugs"))
    return subjects.select("id").join(lists, "id", "left").select("id", F.coalesce("slugs", F.array().cast("array<string>")).alias("slugs"), F.coalesce(F.size("slugs") >= least, F.lit(False)).alias("resolved"))


def clean_terms(books: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, tropes, tags, pacing): every term as its slug in the one field that its kind says, in order and once. Terms of
    pacing fill an empty pacing and go; blocked terms go; others become a slug of their own. vocabulary: (slug, kind)."""
    none = F.array().cast("array<string>")
    terms = books.select("id", F.posexplode(F.concat(F.coalesce("tropes", none), F.coalesce("tags", none))).alias("pos", "raw")).filter(F.trim("raw") != "").withColumn("norm", normalize_raw("raw"))
    pacing = F.try_element_at(F.create_map(*(F.lit(x) for kv in PACING_TERMS.items() for x in kv)), F.col("norm"))
    known = terms.withColumn("pace", pacing).join(aliases.select(F.col("alias").alias("norm"), F.col("slug").alias("alias_slug")), "norm", "left")
    slug = F.when(F.col("pace").isNull(), F.coalesce("alias_slug", F.when(~is_blocked(F.col("raw")), F.nullif(slugify("raw"), F.lit("")))))
    kinds = vocabulary.select("slug", "kind").dropDuplicates(["slug"])
    own = known.withColumn("slug", slug).join(kinds, "slug", "left")
    ordered = lambda cond: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "slug")))), lambda x: x["slug"]))
    trope = F.coalesce(F.col("kind") == "trope", F.lit(False))
    lists = own.groupBy("id").agg(ordered(F.col("slug").isNotNull() & trope).alias("_tropes"), ordered(F.col("slug").isNotNull() & ~trope).alias("_tags"), F.min(F.when(F.col("pace").isNotNull(), F.struct("pos", "pace")))["pace"].alias("_pace"))
    return books.join(lists, "id", "left").select("id", F.coalesce("_tropes", none).alias("tropes"), F.coalesce("_tags", none).alias("tags"), F.coalesce(F.nullif("pacing", F.lit("")), "_pace").alias("pacing"))


def audit(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(book_id, before, after) of the rows that differ: what an append-only log keeps."""
    new = after.select(F.col("id").alias("_id"), F.struct(*columns).alias("after"))
    both = before.select("id", F.struct(*columns).alias("before")).join(new, F.col("id") == F.col("_id"))
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(F.col("id").alias("book_id"), "before", "after")


def term_review(books: DataFrame, vocabulary: DataFrame, prior: DataFrame, least: int = 3, in_mix: int = 3) -> DataFrame:
    """One row for each tag that isn't active or rejected and has `least` uses: tier, suggestion, the genre that holds half
    of its uses, the genres' shares, the three nearest terms and three books. vocabulary: (slug, display, status); prior:
    (term, ruling), which wins over the suggestion."""
    live = vocabulary.filter("status = 'active'")
    uses = books.select("id", "title", F.when(F.size("genres") > 0, F.transform("genres", genre_file)).otherwise(F.array(F.lit("(none)"))).alias("genres"), F.explode("tags").alias("term"))
    uses = uses.join(vocabulary.filter("status IN ('active', 'rejected')").select(F.col("slug").alias("term")), "term", "left_anti")
    often = uses.groupBy("term").agg(F.count("*").alias("books"), F.slice(F.transform(F.array_sort(F.collect_set(F.struct("id", "title"))), lambda x: x["title"]), 1, 3).alias("examples")).filter(F.col("books") >= least)
    genres = uses.select("term", F.explode("genres").alias("genre")).groupBy("term", "genre").agg(F.count("*").alias("n"))
    shares = genres.groupBy("term").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "genre", "n"))).alias("by"))
    mix = F.array_join(F.transform(F.slice("by", 1, in_mix), lambda g: F.concat(g["genre"], F.lit(" "), percent(g["n"], F.col("total")).cast("string"), F.lit("%"))), ", ")
    bucket = F.when(F.get("by", F.lit(0))["n"] * 2 >= F.col("total"), F.get("by", F.lit(0))["genre"]).otherwise("cross-genre")
    choices = live.select("display", "slug").unionByName(live.select(F.col("slug").alias("display"), "slug")).filter("display IS NOT NULL").groupBy("display").agg(F.min("slug").alias("slug"))
    asked = often.select("term", normalize_raw("term").alias("norm"))
    near = nearest_terms(asked.select(F.col("norm").alias("term")), choices, 3).withColumnRenamed("term", "norm").join(choices, "display")
    wide = near.groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("rank", "slug", F.floor("score").cast("int").alias("score")))).alias("near"), F.max("score").alias("top"))
    joined = often.join(shares, "term").join(asked, "term").join(wide, "norm", "left").join(prior, "term", "left")
    top = F.coalesce("top", F.lit(0.0))
    merge = F.concat(F.lit("merge:"), F.get("near", F.lit(0))["slug"])
    suggestion = F.when(top >= ALIAS_SCORE, merge).when(top >= CANON_REVIEW_SCORE, "").otherwise("activate")
    tier = F.when(F.col("ruling").isNotNull(), "prior-ruling").when(top >= ALIAS_SCORE, "auto-merge").when(top >= CANON_REVIEW_SCORE, "review").otherwise("new")
    nearest = [x for i in range(3) for x in (F.get("near", F.lit(i))["slug"].alias(f"nearest_{i + 1}"), F.get("near", F.lit(i))["score"].alias(f"score_{i + 1}"))]
    return joined.select("term", "books", tier.alias("tier"), F.when(F.col("ruling") == "drop", "drop").otherwise(suggestion).alias("suggestion"), bucket.alias("genre_bucket"), mix.alias("genre_mix"), F.coalesce("ruling", F.lit("")).alias("prior_decision"), *nearest, F.array_join("examples", " | ").alias("example_books"))


def apply_rulings(rulings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(raw, norm, target, outcome, new_kind) of rulings (raw, decision, suggested): accept takes the suggested slug,
    `remap:slug` that slug, which is made if it isn't active, anything else proposes the term itself. An accepted target
    that isn't active is invalid."""
    d = F.trim("decision")
    remap = d.startswith("remap:")
    target = F.when(d == "accept", F.col("suggested")).when(remap, F.trim(F.substring(d, 7, 1 << 20)))
    active = vocabulary.filter("status = 'active'").select(F.col("slug").alias("target"), F.lit(True).alias("_active"))
    out = rulings.withColumn("target", target).join(active, "target", "left")
    live = F.coalesce("_active", F.lit(False))
    made = remap & ~live
    outcome = F.when(F.col("target").isNull(), "proposed").when(live | made, F.when(remap, "remap").otherwise("accept")).otherwise("invalid")
    kind = F.when(made, F.when(F.col("target").rlike("|".join(SUBGENRE_WORDS)), "subgenre").otherwise("tag")).when(outcome == "proposed", "tag")
    return out.select("raw", normalize_raw("raw").alias("norm"), F.coalesce("target", slugify("raw")).alias("target"), outcome.alias("outcome"), kind.alias("new_kind"))


def refile(books: DataFrame, kinds: DataFrame, dropped: DataFrame) -> DataFrame:
    """(id, tropes, tags): each term of a book once, tropes by kind, the rest tags; dropped slugs go. kinds: (slug, kind);
    dropped: (slug)."""
    none = F.array().cast("array<string>")
    terms = books.select("id", F.posexplode(F.concat("tropes", "tags")).alias("pos", "slug")).join(dropped.select("slug").distinct(), "slug", "left_anti").join(kinds, "slug", "left")
    ordered = lambda cond: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "slug")))), lambda x: x["slug"]))
    trope = F.coalesce(F.col("kind") == "trope", F.lit(False))
    lists = terms.groupBy("id").agg(ordered(trope).alias("tropes"), ordered(~trope).alias("tags"))
    return books.select("id").join(lists, "id", "left").select("id", F.coalesce("tropes", none).alias("tropes"), F.coalesce("tags", none).alias("tags"))


def compile_decisions(decisions: DataFrame, merges: DataFrame, never: DataFrame, aliases: DataFrame, forced: DataFrame) -> DataFrame:
    """(term, decision) that may be applied, of a reviewer's (term, decision): keep, kill or merge:target.

    forced (term, decision) come first. A kept term that an extra merge (merges: slug, into; not those of `never`) or an
    alias (alias, slug) sends elsewhere is merged there. A merge into itself activates, any other goes to the end of its
    chain of merges; one without a target drops. Terms without a decision are left out.
    """
    low = F.lower(F.trim("decision"))
    extra = merges.join(never.select(F.col("term").alias("slug")), "slug", "left_anti").select("slug", "into").dropDuplicates(["slug"])
    own = decisions.withColumn("target", F.when(low.startswith("merge"), F.trim(F.substring(F.trim("decision"), 7, 1 << 20))))
    chain = own.filter("target IS NOT NULL AND target <> '' AND target <> term").select(F.col("term").alias("slug"), F.col("target").alias("into"))
    steps = extra.unionByName(chain.join(extra.select("slug"), "slug", "left_anti"))
    end = own.select("term", "target")
    for _ in range(5):
        step = steps.select(F.col("slug").alias("target"), "into")
        end = end.join(step, "target", "left").select("term", F.when(F.col("into") == F.col("term"), F.col("target")).otherwise(F.coalesce("into", "target")).alias("target"))
    joined = own.drop("target").join(own.select("term", F.col("target").alias("asked")), "term").join(end, "term")
    joined = joined.join(extra.select(F.col("slug").alias("term"), F.col("into").alias("extra")), "term", "left")
    joined = joined.join(aliases.select(F.col("alias").alias("_alias"), F.col("slug").alias("other")), F.replace("term", F.lit("-"), F.lit(" ")) == F.col("_alias"), "left")
    joined = joined.join(forced.select("term", F.col("decision").alias("forced")), "term", "left")
    merge = lambda c: F.concat(F.lit("merge:"), c)
    kept = F.when(F.col("extra").isNotNull(), merge(F.col("extra"))).when(F.col("other") != F.col("term"), merge(F.col("other"))).otherwise("activate")
    out = F.when(F.col("forced").isNotNull(), F.col("forced")).when(low.isin("keep", "activate", "accept", "yes"), kept).when(low.isin("kill", "drop", "reject", "no"), "drop")
    out = out.when(F.col("asked") == F.col("term"), "activate").when(low.startswith("merge"), F.when(F.coalesce(F.col("target"), F.lit("")) == "", "drop").otherwise(merge(F.col("target"))))
    return joined.select("term", out.alias("decision")).filter("decision IS NOT NULL")


def unmapped_terms(entries: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """(raw, books, from_field, kind): terms of entries (id, field, term) whose slug isn't in known (slug), with `least`
    uses; from_field is where most of them are, ties by name, and a content warning is of kind warning."""
    own = entries.withColumn("slug", slugify("term")).join(known.select("slug").distinct(), "slug", "left_anti")
    by = own.groupBy("term", "field").agg(F.count("*").alias("n"))
    found = by.groupBy(F.col("term").alias("raw")).agg(F.sum("n").alias("books"), F.min_by("field", F.struct(-F.col("n"), "field")).alias("from_field")).filter(F.col("books") >= least)
    return found.select("raw", "books", "from_field", F.when(F.col("from_field") == "contentWarnings", "warning").otherwise("tag").alias("kind"))


def normalized_warnings(warnings: Column, merge: dict[str, str], drop: list[str]) -> Column:
    """Content warnings with the reviewed spellings: some dropped, some merged, each once in any case."""
    key = lambda x: F.lower(F.trim(x))
    kept = F.filter(F.coalesce(warnings, F.array().cast("array<string>")), lambda x: ~key(x).isin(*drop)) if drop else warnings
    named = F.transform(kept, lambda x: F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in merge.items() for v in kv)), key(x)), x)) if merge else kept
    keys = F.transform(named, key)
    return F.filter(named, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def remapped(rows: DataFrame, remap: dict[str, str], to_tag: dict[str, str], drop: list[str]) -> DataFrame:
    """Review rows (…, trope) with `kind` and `slug`: some dropped, some tags now, some under another slug."""
    look = lambda values: F.try_element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), F.col("trope")) if values else F.lit(None).cast("string")
    tag = look(to_tag)
    left = rows.filter(~F.col("trope").isin(*drop)) if drop else rows
    return left.withColumn("kind", F.when(tag.isNotNull(), "tag").otherwise("trope")).withColumn("slug", F.coalesce(tag, look(remap), "trope"))


def slug_groups(uses: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, survey): each group's slugs in order with their uses; groups: (grp, pos, slug), uses: (slug, n)."""
    counted = groups.join(uses, "slug", "left").withColumn("entry", F.concat("slug", F.lit("="), F.coalesce("n", F.lit(0)).cast("string")))
    return counted.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]), "  ").alias("survey"))
