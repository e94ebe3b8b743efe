"""Rule classifiers over labels, descriptions and languages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import latin_share

# The English stop words that the language check counts.
STOP_WORDS = {"en": ("the", "and", "of", "to"), "fr": ("le", "la", "et", "les", "des"), "de": ("der", "die", "und", "das"), "es": ("el", "la", "de", "que", "los")}


def triage(labels: Column, childrens: list[str], poetry: list[str], nonfiction: list[str], fiction: list[str]) -> Column:
    """Class by label sets: childrens, then poetry without fiction, then one of both kinds alone, else ambiguous."""
    has = lambda names: F.arrays_overlap(labels, F.array(*map(F.lit, names)))
    return (
        F.when(has(childrens), "childrens").when(has(poetry) & ~has(fiction), "poetry_drama")
        .when(has(nonfiction) & ~has(fiction), "nonfiction").when(has(fiction) & ~has(nonfiction), "fiction").otherwise("ambiguous")
    )


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How often any of the words occurs as a whole ASCII word."""
    return F.regexp_count(text, F.lit(r"(?i)\b(" + "|".join(words) + r")\b"))


def margin_class(text: Column, one: tuple[str, ...], two: tuple[str, ...], names: tuple[str, str], margin: int = 2) -> Column:
    """The side that leads by `margin` hits, else unsure."""
    d = hits(text, one) - hits(text, two)
    return F.when(d >= margin, names[0]).when(d <= -margin, names[1]).otherwise("unsure")


def stop_word_language(text: Column) -> Column:
    """non-latin by script, short under 20 characters, else the language with most stop words, else unknown. Words are
    runs of letters of any script."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    counts = [(lang, F.size(F.filter(words, _one_of(own)))) for lang, own in STOP_WORDS.items()]
    best = F.greatest(*(c for _, c in counts))
    lang = F.when(best <= 0, "unknown")
    for name, c in counts:
        lang = lang.when(c == best, name)
    return F.when(F.coalesce(latin_share(text), F.lit(1.0)) < 0.5, "non-latin").when(F.coalesce(F.length(text), F.lit(0)) < 20, "short").otherwise(lang)


def _one_of(words: Sequence[str]):
    return lambda w: w.isin(*words)


def archive_decision(language: Column) -> Column:
    return F.when(language == "non-latin", "archive_script").when(language.isin("fr", "de", "es"), "archive_language").when(language == "unknown", "review").otherwise("keep")


def over_cap(decisions: DataFrame, cap: float = 0.30) -> DataFrame:
    """One row: rows, archived, and whether the archived share is above the cap, in which case nothing may be applied."""
    n = decisions.agg(F.count("*").alias("n"), F.count_if(F.col("decision").startswith("archive")).alias("archived"))
    return n.select("n", "archived", (F.col("archived") > F.col("n") * cap).alias("abort"))


def _like(pattern: str):
    return lambda t: t.rlike(pattern)


def evidence_genre(tags: Column, rules: list[tuple[str, str]]) -> Column:
    """Genres whose pattern some tag has, in the order of the rules."""
    found = F.array(*(F.when(F.exists(tags, _like(p)), F.lit(g)) for g, p in rules))
    return F.filter(found, lambda g: g.isNotNull())


def doubt(reasons: list[tuple[int, str, Column]]) -> Column:
    """Struct of the summed weights and the names of the reasons that hold."""
    score = sum((F.when(cond, w).otherwise(0) for w, _, cond in reasons), F.lit(0))
    return F.struct(score.alias("score"), F.array_compact(F.array(*(F.when(cond, F.lit(name)) for _, name, cond in reasons))).alias("reasons"))


# --- rules over labels, headings, blurbs and categories ---------------------------------------------------------


def _lower_trimmed(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))


def _among(values: Column, names: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, names))), F.lit(False))


def book_class(genres: Column) -> Column:
    """The catalogue's class by its genre labels, spelt exactly."""
    own = F.transform(F.coalesce(genres, F.array().cast("array<string>")), lambda x: F.trim(x))
    return triage(own, list(rules.CHILDRENS_GENRES), list(rules.POETRY_GENRES), list(rules.NONFICTION_GENRES), list(rules.FICTION_GENRES))


def covered(books: DataFrame, vocabulary: DataFrame, least: int = 3) -> DataFrame:
    """(id, book_class, needs_enrichment, stage): skipped where a book has `least` active tropes and active tags and a
    pacing, else pending. vocabulary: (slug, kind, status)."""
    live = vocabulary.filter("status = 'active'").select(F.col("slug").alias("term"), "kind")
    terms = books.select("id", F.explode(F.concat(F.transform("tropes", lambda x: F.struct(F.lit("trope").alias("field"), x.alias("term"))), F.transform("tags", lambda x: F.struct(F.lit("tag").alias("field"), x.alias("term"))))).alias("t")).select("id", "t.*")
    known = terms.join(live, "term").groupBy("id").agg(F.count_if((F.col("field") == "trope") & (F.col("kind") == "trope")).alias("tropes_ok"), F.count_if(F.col("field") == "tag").alias("tags_ok"))
    full = (F.coalesce("tropes_ok", F.lit(0)) >= least) & (F.coalesce("tags_ok", F.lit(0)) >= least) & F.coalesce(F.col("pacing") != "", F.lit(False))
    return books.join(known, "id", "left").select("id", book_class(F.col("genres")).alias("book_class"), F.when(full, 0).otherwise(1).alias("needs_enrichment"), F.when(full, "skipped").otherwise("pending").alias("stage"))


def upsert_state(current: DataFrame, found: DataFrame) -> DataFrame:
    """States (id, book_class, needs_enrichment, stage) after triage; a terminal stage stays as it was."""
    both = current.select("id", F.col("stage").alias("_was")).join(found, "id", "full_outer")
    old = current.select("id", F.col("book_class").alias("_class"), F.col("needs_enrichment").alias("_needs"))
    stage = F.when(F.col("_was").isin("enriched", "grounded", "promoted", "unverifiable"), F.col("_was")).otherwise(F.coalesce("stage", "_was"))
    return both.join(old, "id", "left").select("id", F.coalesce("book_class", "_class").alias("book_class"), F.coalesce("needs_enrichment", "_needs").alias("needs_enrichment"), stage.alias("stage"))


@dataclass(frozen=True)
class BlurbSignals:
    """Patterns of a blurb: explicit fiction, narrative hints, expository markers."""

    explicit: str
    hints: str
    expository: str

    def counts(self, text: Column) -> tuple[Column, Column, Column]:
        return tuple(F.regexp_count(text, F.lit(f"(?iu){p}")) for p in (self.explicit, self.hints, self.expository))


def blurb_class(title: Column, blurb: Column, genres: Column, signals: BlurbSignals, margin: int = 2) -> Column:
    """fiction, nonfiction or null: unmixed explicit signals decide, else signals and genres with a lead of `margin`."""
    explicit, hints, expository = signals.counts(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(blurb, F.lit(""))))
    fic = _among(genres, rules.BLURB_FICTION_GENRES)
    non = _among(genres, rules.BLURB_NONFICTION_GENRES) & ~fic
    lead = 2 * explicit + hints + fic.cast("int") - expository - non.cast("int")
    return (
        F.when((explicit >= 1) & (expository == 0), "fiction").when((expository >= 2) & (explicit == 0) & (hints == 0), "nonfiction")
        .when(lead >= margin, "fiction").when(lead <= -margin, "nonfiction")
    )


def blurb_call(title: Column, blurb: Column, genres: Column, signals: BlurbSignals) -> Column:
    """fiction, nonfiction or uncertain by the sign of the score: a review's call, without early exits."""
    explicit, hints, expository = signals.counts(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(blurb, F.lit(""))))
    score = 2 * explicit + hints + _among(genres, rules.BLURB_FICTION_GENRES).cast("int") - expository
    return F.when(score >= 1, "fiction").when(score <= -1, "nonfiction").otherwise("uncertain")


def label_class(genres: Column) -> Column:
    """The class that labels in any case stand for, null where they don't agree."""
    own = _lower_trimmed(genres)
    fic, non = _among(own, rules.FICTION_LABELS), _among(own, rules.NONFICTION_LABELS)
    return F.when(_among(own, rules.CHILDRENS_LABELS), "childrens").when(_among(own, rules.POETRY_LABELS) & ~fic, "poetry_drama").when(fic & ~non, "fiction").when(non & ~fic, "nonfiction")


def subject_class(subjects: Column, scoped: Column, margin: int = 2) -> Column:
    """fiction, nonfiction or null by subject headings: decisive words first; then headings that resolve to a term scoped
    to non-fiction (`scoped`, their number) and weak words count, with a lead of `margin`."""
    own = _lower_trimmed(subjects)
    number = lambda pattern: F.size(F.filter(own, lambda s: s.rlike(pattern)))
    fic, non = number(rules.whole_words(rules.STRONG_FICTION)), number(rules.whole_words(rules.STRONG_NONFICTION))
    weak = number("|".join(map(re.escape, rules.WEAK_NONFICTION)))
    lead = fic - non - F.coalesce(scoped, F.lit(0)) - weak
    return F.when((fic > 0) & (non == 0), "fiction").when((non > 0) & (fic == 0), "nonfiction").when(lead >= margin, "fiction").when(lead <= -margin, "nonfiction")


def mystery_call(subjects: Column, blurb: Column) -> Column:
    """flip, review, keep or no_subjects for a mystery that may be non-fiction."""
    own = F.array_join(F.transform(F.coalesce(subjects, F.array().cast("array<string>")), lambda x: F.lower(x)), " || ")
    has = F.coalesce(blurb, F.lit("")) != ""
    fiction = own.rlike(rules.whole_words(rules.MYSTERY_FICTION)) | F.coalesce(blurb.rlike(f"(?iu){rules.MYSTERY_FICTION_BLURB}"), F.lit(False))
    weak = sum((own.rlike(rules.whole_words([w])).cast("int") for w in rules.MYSTERY_WEAK), F.lit(0))
    return (
        F.when(own == "", "no_subjects").when(fiction, "keep").when(own.rlike(rules.whole_words(rules.MYSTERY_DECISIVE)), "flip")
        .when((weak >= 2) & has, "review").when((weak >= 1) & ~has, "review").otherwise("keep")
    )


def page_class(categories: Column, intro: Column) -> Column:
    """Struct of the class that an encyclopedia page's categories, or else its intro, stand for, and the language that the
    intro names."""
    blob = F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " || ")
    fic, non = F.regexp_count(blob, F.lit(f"(?iu){rules.CATEGORY_FICTION}")), F.regexp_count(blob, F.lit(f"(?iu){rules.CATEGORY_NONFICTION}"))
    novel = F.coalesce(intro.rlike(f"(?iu){rules.INTRO_NOVEL}"), F.lit(False))
    kind = F.when((fic > 0) & (non == 0), "fiction").when((non > 0) & (fic == 0), "nonfiction").when(novel & (non == 0), "fiction")
    language = F.nullif(F.lower(F.regexp_extract(intro, f"(?iu){rules.INTRO_LANGUAGE}", 1)), F.lit(""))
    return F.struct(kind.alias("book_class"), language.alias("language"))


def category_class(categories: Column, nonfiction: Sequence[str]) -> Column:
    """fiction where a category names it, else nonfiction where one holds a word of `nonfiction`, else null."""
    own = F.coalesce(categories, F.array().cast("array<string>"))
    return F.when(F.exists(own, lambda c: c.contains("fiction")), "fiction").when(F.exists(own, lambda c: c.rlike("|".join(map(re.escape, nonfiction)))), "nonfiction")


def title_language(title: Column, guess: Column, guess_share: Column, english_share: Column) -> Column:
    """Struct (lang, english, basis) of a title. guess, guess_share and english_share are a detector's best language, its
    share and that of English; english is null where the title doesn't tell."""
    own = F.trim(F.coalesce(title, F.lit("")))
    letters = F.length(F.regexp_replace(own, "[^A-Za-zÀ-ÿ]", ""))
    words = F.size(F.filter(F.split(own, r"\s+"), lambda x: x != ""))
    out = lambda lang, english, basis: F.struct(lang.cast("string").alias("lang"), english.cast("boolean").alias("english"), F.lit(basis).alias("basis"))
    unknown = F.lit(None)
    return (
        F.when(own.rlike(rules.NONLATIN_SCRIPTS) & (latin_share(own) < 0.6), out(F.lit("nonlatin"), F.lit(False), "script"))
        .when((letters < 8) | (words < 2), out(F.lit("?"), unknown, "title-short"))
        .when(guess.isNull(), out(F.lit("?"), unknown, "detect-failed"))
        .when(guess == "en", out(guess, F.lit(True), "title"))
        .when((guess_share >= 0.9995) & (english_share < 0.02), out(guess, F.lit(False), "title"))
        .otherwise(out(guess, unknown, "title-lowconf"))
    )


def title_decision(title: Column, language: Column) -> Column:
    """archive, uncertain or keep; language as from title_language(). A foreign article or letter is a strong marker."""
    strong = F.coalesce(title.rlike(f"(?iu){rules.FOREIGN_ARTICLE}") | title.rlike(f"(?iu){rules.FOREIGN_LETTER}"), F.lit(False))
    lang, english = language["lang"], language["english"]
    return (
        F.when(language["basis"] == "script", "archive").when(F.coalesce(english, F.lit(False)), "keep").when((english == F.lit(False)) & strong, "archive")
        .when(english == F.lit(False), "uncertain").when(~lang.isin("en", "?") & strong, "uncertain").otherwise("keep")
    )


def enrichment_doubt(known: Column, confidence: Column, note: Column, blurb: Column, proposed: Column, author: Column, year: Column) -> Column:
    """Struct (score, reasons) of a staged row's reasons for doubt."""
    note, text = F.coalesce(note, F.lit("")), F.coalesce(blurb, F.lit(""))
    bad, junk = note.rlike(r"(?iu)wrong match|junk|not grounded|contradict|may be wrong"), F.lower(text).rlike("|".join(map(re.escape, rules.JUNK_DESCRIPTION)))
    found = [
        (2, F.lit("known=false"), ~F.coalesce(known, F.lit(True))),
        (1, F.lit("medium confidence"), F.coalesce(confidence == "medium", F.lit(False))),
        (3, F.lit("bad/absent description — enriched anyway"), bad),
        (2, F.lit("from memory, not description"), ~bad & F.lower(note).contains("from knowledge")),
        (1, F.lit("no description"), text == ""),
        (2, F.lit("description is junk/wrong-book metadata"), (text != "") & junk),
        (1, F.concat(F.lit("proposed new term: "), F.array_join(proposed, ", ")), F.coalesce(F.size(proposed) > 0, F.lit(False))),
        (1, F.lit("author field polluted"), F.regexp_count(F.coalesce(author, F.lit("")), F.lit(",")) >= 2),
        (1, F.concat(F.lit("suspect year "), year.cast("string")), F.coalesce((year > 2025) | (year < 1000) & (year != 0), F.lit(False))),
    ]
    score = sum((F.when(c, w).otherwise(0) for w, _, c in found), F.lit(0))
    return F.struct(score.alias("score"), F.array_compact(F.array(*(F.when(c, r) for _, r, c in found))).alias("reasons"))


def archetype(genres: Column, tropes: Column, tags: Column, spicy: Column) -> Column:
    """A reader's archetype by the top lists of the profile: the first rule that holds."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    own, moods = low(genres), low(tags)
    every = F.concat(low(tropes), moods)
    has = lambda c, *words: F.exists(c, lambda x: x.rlike("|".join(map(re.escape, words))))
    space, magic, love = has(own, "sci-fi", "science fiction"), has(own, "fantasy", "romantasy"), has(own, "romance")
    return (
        F.when(space & has(every, "human", "ai", "consciousness", "transhuman"), "The Cosmic Philosopher").when(space, "The Starfarer")
        .when(magic & (spicy | has(every, "fated", "mate", "court")), "The Realm Enchanted").when(magic & has(every, "found-family", "quest", "chosen"), "The Questbound").when(magic, "The Realm Wanderer")
        .when(love & spicy, "The Ardent Heart").when(love, "The Hopeless Romantic").when(has(own, "mystery", "thriller", "crime"), "The Midnight Sleuth").when(has(own, "horror"), "The Shadow Dweller")
        .when(has(own, "young adult"), "The Coming-of-Ager").when(has(moods, "dark", "tense"), "The Twilight Reader").when(has(moods, "reflective", "emotional", "hopeful"), "The Quiet Contemplative")
        .when(has(own, "biography", "memoir", "history"), "The Chronicle Keeper").otherwise("The Eclectic Reader")
    )


def rewritten(decisions: DataFrame, rulings: DataFrame) -> DataFrame:
    """decisions (term, decision, kind) with the rulings (term, decision, kind) in place of what was decided; a ruling
    without a decision only unsets one that was made, and one without a kind leaves the kind."""
    ruled = rulings.select("term", F.col("decision").alias("_d"), F.col("kind").alias("_k"), F.lit(True).alias("_ruled"))
    return decisions.join(ruled, "term", "left").select("term", F.when(F.col("_ruled"), F.coalesce("_d", F.lit(""))).otherwise(F.col("decision")).alias("decision"), F.coalesce("_k", "kind").alias("kind"))
