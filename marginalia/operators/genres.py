"""Genres from tag evidence, romance blends and repairs of lost genres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import canonical_spice, derived_tags, lookup


def _any(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda x: x.rlike(pattern))


def _evidence(genre: str, subgenre: str | None):
    return F.struct(F.lit(genre).alias("genre"), F.lit(subgenre).cast("string").alias("subgenre"))


def reclassified(books: DataFrame) -> DataFrame:
    """(id, genres, changed, confidence, tags, spice_level) of catalogue entries (id, genres, tropes, tags, pacing,
    spice_level).

    Tags support genres by whole words, in the order of the evidence; subgenres of romance only where the book is one. A
    source genre that is supported stays first; evidence against all of them is added after, never in their place. A
    romance in another genre shows it, and fantasy with romance is Romantasy. Spice tags fill an empty spice and go, as
    does junk; tags that follow from tropes and pacing are added.
    """
    none = F.array().cast("array<string>")
    source = F.filter(F.coalesce("genres", none), lambda g: g != "")
    tags, tropes = F.coalesce("tags", none), F.coalesce("tropes", none)
    base = books.select("id", source.alias("source"), tags.alias("tags"), tropes.alias("tropes"), "pacing", F.col("spice_level").alias("spice"), F.transform(tags, lambda t: F.lower(t)).alias("low"))
    normal = F.transform("tropes", lambda t: F.lower(F.trim(t)))
    romance = (
        F.exists("source", lambda g: F.lower(F.trim(g)) == "romance") | F.exists("low", lambda t: t.contains("romance"))
        | F.arrays_overlap("tropes", F.array(F.lit("sapphic"), F.lit("mlm"))) | F.arrays_overlap(normal, F.array(*map(F.lit, rules.ROMANCE_TROPES)))
    )
    base = base.withColumn("romance", F.coalesce(romance, F.lit(False)))
    pairs = [(rules.whole_words(words), genre, sub) for words, (genre, sub) in rules.GENRE_EVIDENCE]
    plain = lambda sub: rules.PLAIN_SUBGENRE.get(sub, sub)
    hits = F.array_compact(F.array(*(F.when(_any(F.col("low"), p), F.when(F.col("romance"), _evidence(g, s)).otherwise(_evidence(g, plain(s)))) for p, g, s in pairs)))
    base = base.withColumn("hits", hits)
    supported = F.filter("source", lambda g: F.exists("hits", lambda h: h["genre"] == g))
    base = base.withColumn("supported", supported)
    first = F.get("source", F.lit(0))
    found, against = F.size("hits") > 0, (F.size("hits") > 0) & (F.size("source") > 0) & (F.size("supported") == 0)
    primary = F.when(against, F.get("hits", F.lit(0))["genre"]).when(found, F.coalesce(F.get("supported", F.lit(0)), first, F.lit(""))).otherwise(F.coalesce(first, F.lit("")))
    base = base.withColumn("primary", primary).withColumn("against", against)
    own = F.filter("hits", lambda h: h["genre"] == F.col("primary"))
    sub = F.when(found & ~F.col("against") & (F.size(own) > 0), F.get(own, F.lit(0))["subgenre"]).when(found, F.get("hits", F.lit(0))["subgenre"])
    blend = F.col("romance") & (F.col("primary") != "Romance")
    base = base.withColumn("sub", F.when(blend, F.coalesce(lookup(rules.ROMANCE_BLEND, F.col("primary")), F.lit("romance"))).otherwise(sub))
    added = F.array_distinct(F.filter(F.array("primary", "sub"), lambda g: g.isNotNull() & (g != "")))
    genres = F.concat("source", F.array_except(added, F.col("source")))
    fantasy = F.exists("source", lambda g: F.lower(g).contains("fantasy")) | F.lower("primary").contains("fantasy") | F.coalesce(F.lower("sub").contains("fantasy"), F.lit(False))
    romantasy = fantasy & F.col("romance") & ~F.exists(genres, lambda g: F.lower(g) == "romantasy")
    confidence = F.concat(F.when(F.col("against"), "tag-evidence").when(found, "consistent").otherwise("no-evidence"), F.when(blend, "+romance").otherwise(""))
    spicy = lambda t: F.lower(t).rlike("|".join(rules.SPICE_TAG_PARTS))
    kept = F.filter("tags", lambda t: ~spicy(t) & ~F.lower(t).rlike("|".join(rules.RECLASS_JUNK_PARTS)))
    spice = canonical_spice(F.coalesce(F.nullif("spice", F.lit("")), F.get(F.filter("tags", spicy), F.lit(0))))
    return base.select("id", F.when(romantasy, F.array_append(genres, F.lit("Romantasy"))).otherwise(genres).alias("genres"), F.col("against").alias("changed"), confidence.alias("confidence"), derived_tags(F.col("tropes"), kept, F.col("pacing")).alias("tags"), spice.alias("spice_level"))


def restored_primary(books: DataFrame, source: DataFrame) -> DataFrame:
    """(id, genres): the source's first genre before a book's own, unless it is there in any case, or the book has a
    subgenre of romance."""
    own = books.select("id", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"))
    both = own.join(source.select(F.col("id").alias("_id"), F.get(F.filter("genres", lambda g: g != ""), F.lit(0)).alias("first")), F.col("id") == F.col("_id"), "left")
    low = F.transform("genres", lambda g: F.lower(g))
    lost = F.col("first").isNotNull() & ~F.array_contains(low, F.lower("first")) & ~F.arrays_overlap(low, F.array(*map(F.lit, rules.ROMANCE_SUBGENRES)))
    return both.select("id", F.when(F.coalesce(lost, F.lit(False)), F.concat(F.array("first"), "genres")).otherwise(F.col("genres")).alias("genres"))
