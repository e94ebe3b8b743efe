"""Pattern packs: regular expressions with a slug and a tier, all run in one pass over each text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 40  # patterns in one array expression, so that generated methods stay small


@dataclass(frozen=True)
class Pattern:
    slug: str
    tier: str
    regex: str


def read_pack(spark: SparkSession, path: str) -> list[Pattern]:
    """A pack from a CSV file with the columns slug, tier and regex, in the file's order: a pack is data, and small."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', schema="slug string, tier string, regex string", encoding="UTF-8").coalesce(1)
    pack = [Pattern(r["slug"].lstrip("\ufeff"), r["tier"], r["regex"]) for r in rows.collect() if r["slug"] and r["regex"]]
    for p in pack:
        re.compile(p.regex)
    return pack


def check_pack(pack: Sequence[Pattern], active: Iterable[str]) -> None:
    """Every slug is known, and none stands in two tiers; all faults are named at once."""
    active, tiers, faults = set(active), {}, []
    for p in pack:
        tiers.setdefault(p.slug, set()).add(p.tier)
    faults += [f"{slug} is not an active slug" for slug in tiers if slug not in active]
    faults += [f"{slug} is in two tiers" for slug, own in tiers.items() if len(own) > 1]
    if faults:
        raise ValueError("; ".join(faults))


def match_context(text: Column, regex: str, pad: int = 40) -> Column:
    """The first hit with `pad` characters on both sides, white space squeezed, between ellipses."""
    at, phrase = F.regexp_instr(text, F.lit(f"(?iu){regex}")), F.regexp_extract(text, f"(?iu){regex}", 0)
    around = F.substring(text, F.greatest(at - pad, F.lit(1)), F.length(phrase) + pad + F.least(at - 1, F.lit(pad)))
    return F.concat(F.lit("..."), F.trim(F.regexp_replace(around, r"\s+", " ")), F.lit("..."))


def matches(text: Column, pack: Sequence[Pattern], context: bool = False) -> Column:
    """Array of (ord, slug, tier, phrase[, context]), in the order of the pack; the first hit of each pattern, a hit being
    one sign or more."""

    def hit(i: int, p: Pattern) -> Column:
        phrase = F.nullif(F.regexp_extract(text, f"(?iu){p.regex}", 0), F.lit(""))
        fields = [F.lit(i).alias("ord"), F.lit(p.slug).alias("slug"), F.lit(p.tier).alias("tier"), phrase.alias("phrase")]
        return F.when(phrase.isNotNull(), F.struct(*fields, *([match_context(text, p.regex).alias("context")] if context else [])))

    chunks = [F.filter(F.array(*(hit(i + k, p) for k, p in enumerate(pack[i : i + CHUNK]))), lambda x: x.isNotNull()) for i in range(0, len(pack), CHUNK)]
    return F.concat(*chunks) if len(chunks) > 1 else chunks[0]


def match_rows(texts: DataFrame, pack: Sequence[Pattern], limit: int | None = 8, context: bool = True) -> DataFrame:
    """texts: (id, text). (id, ord, slug, tier, phrase[, context]) of the first `limit` patterns that hit each text."""
    found = matches(F.col("text"), pack, context)
    return texts.select("id", F.explode(F.slice(found, 1, limit) if limit else found).alias("m")).select("id", "m.*")


def tier_mix(rows: DataFrame) -> DataFrame:
    """(id, n, tiers, confidence): high when every hit is of tier A."""
    tiers = F.array_join(F.array_sort(F.collect_set("tier")), "+")
    return rows.groupBy("id").agg(F.count("*").alias("n"), tiers.alias("tiers")).withColumn("confidence", F.when(F.col("tiers") == "A", "high").otherwise("medium"))


def best_tier(reviews: DataFrame) -> DataFrame:
    """(id, slug, tier) of concatenated reviews: the highest tier of each."""
    return reviews.groupBy("id", "slug").agg(F.min("tier").alias("tier"))


# Texts that are no plot, and sentences that aren't about the book.
SERIES_INDEX = r"\*\*books in (this|the) series\*\*|books in this series|also in (this|the) series|other books in"
LINK = r"\[[^\]]{2,}\]\[[a-z0-9]+\]"
COLLECTION_TITLE = (
    r"collected (works|stories|tales|fiction)|complete (works|tales|stories|novels)|\banthology\b|treasury of|\bomnibus\b|book of .{0,25}(stories|tales)|"
    r"short (stories|fiction)|best of the|\bvol\.? ?[0-9ivx]+\b|volume [0-9ivx]+"
)
COMPARED = (
    r"(perfect |ideal |just )?for (fans|readers|lovers|admirers) of [^.!?]*[.!?]?|in the (vein|tradition) of [^.!?]*[.!?]?|"
    r"(if you (loved|liked|enjoyed)|fans of) [^.!?]*[.!?]?|\"[^\"]{15,}\"\s*[-—–]+\s*[A-Z][^.\n]{0,40}"
)
ABOUT_AUTHOR = (
    r"[^.!?]*\b(is|was) a \d{4}[^.!?]*\.|[^.!?]*\bis a [a-z\- ]{0,30}novel (written )?by[^.!?]*\.|[^.!?]*\bwon the [^.!?]{0,60}award[^.!?]*\.|"
    r"[^.!?]*\baward for [^.!?]*\.|[^.!?]*\bwas (born|appointed|educated|awarded)\b[^.!?]*\."
)


def clean_description(text: Column, title: Column) -> Column:
    """A description without what isn't this book's plot; null where nothing is left, for collections and for contents
    lists. Cut at a series index and at a list of three links or more; then comparisons and sentences about the author go,
    each tried only where a word of theirs occurs."""
    cut = lambda c, at: F.when(at > 0, F.substring(c, 1, at - 1)).otherwise(c)
    s = cut(text, F.regexp_instr(text, F.lit(f"(?iu){SERIES_INDEX}")))
    linked = s.contains("][") & (F.regexp_count(s, F.lit(f"(?iu){LINK}")) >= 3)
    s = F.when(linked, F.substring(s, F.lit(1), F.regexp_instr(s, F.lit(f"(?iu){LINK}")) - 1)).otherwise(s)
    low = F.lower(s)
    s = F.when(low.contains("fans of") | low.contains("vein of") | low.contains("tradition of") | s.contains('"'), F.regexp_replace(s, f"(?iu){COMPARED}", " ")).otherwise(s)
    low = F.lower(s)
    s = F.when(low.contains("award") | low.contains("novel by") | low.contains("born") | low.contains("appointed") | s.rlike(r"\b(is|was) a \d{4}"), F.regexp_replace(s, f"(?iu){ABOUT_AUTHOR}", " ")).otherwise(s)
    listed = (F.regexp_count(s, F.lit(" -- ")) >= 2) | (F.regexp_count(s, F.lit(" · ")) >= 2)
    collection = F.coalesce(title.rlike(f"(?iu){COLLECTION_TITLE}"), F.lit(False))
    return F.when(~collection & ~listed, F.nullif(F.trim(s), F.lit("")))
