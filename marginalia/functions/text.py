"""Scalar functions over titles, authors, tags, dates and terms, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a tag that count as one.
TAG_ALIASES = {
    "slow burn romance": "slow burn",
    "bisexual or pansexual": "bisexual",
    "sapphic romance": "sapphic",
    "mlm romance": "mlm",
    "grumpy / sunshine": "grumpy sunshine",
}
# Tags that say nothing about a book, whole and in part.
JUNK_TAGS = ("all reviews & lists", "books fiction", "kindle unlimited", "audiobook", "kindle", "ebook")
JUNK_PARTS = ("favourite", "favorite", "best of", "recommended", "review", "to buy", "tbr", "wish list", "wishlist")
# Moods, which sit on nearly every book.
MOODS = ("dark", "emotional", "tense", "mysterious", "adventurous", "reflective", "funny", "sad", "challenging", "relaxing", "inspiring", "hopeful", "lighthearted")
# Words of a spice text by level; the first level with a word in the text counts.
SPICE_WORDS = (
    ("Explicit", ("explicit", "hot", "spicy", "high")),
    ("Medium Spice", ("medium", "average", "moderate")),
    ("Tame", ("tame", "euphemistic", "low", "mild", "fade", "closed door")),
    ("No Spice", ("no spice",)),
)
# Tropes that are also a tag, spelt as one.
TROPE_TAGS = {
    "enemiesToLovers": "enemies-to-lovers", "fakeDating": "fake-dating", "slowBurn": "slow-burn", "forcedProximity": "forced-proximity", "grumpySunshine": "grumpy-sunshine",
    "competenceKink": "competence-kink", "iceQueen": "ice-queen", "touchStarved": "touch-starved", "foundFamily": "found-family", "cinnamonRoll": "cinnamon-roll",
}
# Tags that follow from the pacing.
PACING_TAGS = {"Slow": "slow-paced", "Fast": "fast-paced"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_title(c: Column | str) -> Column:
    """Lower case, without parentheses, subtitle, ' a novel', punctuation and a leading 'the'."""
    s = F.regexp_replace(F.trim(F.lower(_col(c))), r"\(.*?\)", " ")
    s = F.replace(F.get(F.split(s, ":"), F.lit(0)), F.lit(" a novel"), F.lit(""))
    return F.regexp_replace(squeeze(F.regexp_replace(s, r"[^a-z0-9\s]", " ")), "^the ", "")


def normalize_author(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(_col(c)), r"[^a-z\s]", " "))


def normalize_isbn(c: Column | str) -> Column:
    """Ten or thirteen digits (or X), also out of a spreadsheet's quotes; else empty."""
    s = F.upper(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^0-9Xx]", ""))
    return F.when(F.length(s).isin(10, 13), s).otherwise("")


def parse_date(c: Column | str) -> Column:
    """The first of four formats that reads the text, else null."""
    s = F.trim(_col(c))
    return F.coalesce(*(F.try_to_date(s, f) for f in ("yyyy/M/d", "yyyy-M-d", "M/d/yyyy", "d/M/yyyy")))


def parse_rating(c: Column | str) -> Column:
    """A number other than 0, else null."""
    return F.nullif(_col(c).try_cast("double"), F.lit(0.0))


def de_camel(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "([a-z0-9])([A-Z])", "$1 $2")


def humanize(c: Column | str) -> Column:
    return F.lower(de_camel(c))


def canonical_tag(c: Column | str) -> Column:
    """Lower case; hyphens between letters and underscores to spaces; known spellings to one."""
    s = F.replace(F.regexp_replace(F.lower(_col(c)), "(?<=[a-z])-(?=[a-z])", " "), F.lit("_"), F.lit(" "))
    s = squeeze(s)
    known = F.create_map(*(F.lit(x) for pair in TAG_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, s), s)


def is_junk_tag(c: Column | str) -> Column:
    s = F.lower(_col(c))
    return s.isin(*JUNK_TAGS) | s.rlike("|".join(JUNK_PARTS))


def canonical_spice(c: Column | str) -> Column:
    """One of five levels; a null or empty text, and one without a known word, is N/A."""
    s = F.lower(_col(c))
    out = F
    for level, words in SPICE_WORDS:
        out = out.when(s.rlike("|".join(words)), level)
    return out.otherwise("N/A")


def derived_tags(tropes: Column, tags: Column, pacing: Column) -> Column:
    """tags, then those that follow from tropes and pacing, unless they are a tag or a trope already."""
    none = F.array().cast("array<string>")
    tropes, tags = F.coalesce(tropes, none), F.coalesce(tags, none)
    known = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    extra = F.array_compact(F.concat(F.transform(tropes, lambda t: F.try_element_at(known(TROPE_TAGS), t)), F.array(F.try_element_at(known(PACING_TAGS), pacing))))
    return F.concat(tags, F.array_except(F.array_distinct(extra), F.concat(tags, tropes)))


def slugify(c: Column | str) -> Column:
    s = F.replace(F.lower(de_camel(c)), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_raw(c: Column | str) -> Column:
    s = F.replace(F.lower(de_camel(c)), F.lit("_"), F.lit(" "))
    return squeeze(F.regexp_replace(s, r"[^a-z0-9\s]", " "))


def overlap_key(c: Column | str) -> Column:
    return F.regexp_replace(canonical_tag(humanize(c)), "[^a-z0-9]", "")


def first_year(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"(1[5-9]\d{2}|20\d{2})", 1), F.lit("")).cast("int")


def clean_subject(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_col(c), r"(?i)\s*--\s*Fiction\s*$", "")))


def format_author(c: Column | str) -> Column:
    """'Last, First, dates' to 'First Last'; parts that begin with a year go."""
    parts = F.filter(F.transform(F.split(_col(c), ","), lambda x: F.trim(x)), lambda x: ~x.rlike(r"^\d{3,4}\??-?"))
    return F.when(F.size(parts) >= 2, F.trim(F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))).otherwise(F.get(parts, F.lit(0)))


def latin_share(c: Column | str) -> Column:
    """Share of the letters that are Latin; 1 without letters, null for null."""
    letters = F.length(F.regexp_replace(_col(c), r"[^\p{L}]", ""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(_col(c), r"[^\p{IsLatin}&&\p{L}]|[^\p{IsLatin}]", "")), letters), F.when(_col(c).isNotNull(), 1.0))


def smart_title(c: Column | str) -> Column:
    """A title all in capitals with one capital a word (`DON'T STOP` to `Don't Stop`); any other as it is."""
    s = _col(c)
    words = F.regexp_extract_all(s, F.lit(r"([A-Za-z]+(?:'[A-Za-z]+)?|[^A-Za-z]+)"), 1)
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1 << 20)))), "")
    return F.when((s == F.upper(s)) & (s != F.lower(s)), joined).otherwise(s)


def plot_section(c: Column | str, most: int | None = None) -> Column:
    """The first plot section of an encyclopedia text, up to the next heading, white space squeezed; '' without one."""
    head = r"(?is)\n==+\s*(?:Plot|Synopsis|Plot summary|Story|Premise)\s*==+\n(.*?)(?:\n==+\s*[^=]+\s*==+\n|\z)"
    body = squeeze(F.regexp_extract(_col(c), head, 1))
    return F.substring(body, 1, most) if most else body


def is_disambiguation(page: Column, text: Column) -> Column:
    return F.lower(page).contains("(disambiguation)") | F.substring(text, 1, 400).rlike(r"(?iu)\bmay (also )?refer to\b")


def surname(author: Column) -> Column:
    """The last part of a name that has a letter, of three characters or more; else null."""
    parts = F.filter(F.split(author, r"[\s,]+"), lambda p: p.rlike("[A-Za-z]"))
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(F.length(last) >= 3, last)


def names_author(text: Column, author: Column) -> Column:
    """Whether the author's surname is a whole word of the text; without a surname it isn't."""
    quoted = F.concat(F.lit(r"(?iu)\b\Q"), surname(author), F.lit(r"\E\b"))
    return F.coalesce(F.regexp_like(text, quoted), F.lit(False))


def page_title(c: Column) -> Column:
    """A title for comparison with a page's: lower case, without parentheses and signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", ""), "[^a-z0-9 ]", ""))


# Spellings of genres in file names.
GENRE_FILES = {"sci-fi": "sci-fi", "science fiction": "sci-fi", "general fiction": "general-fiction", "children's": "childrens", "young adult": "young-adult", "literary fiction": "literary-fiction", "biography & memoir": "biography-memoir"}
# A staged spice level's spellings.
STAGED_SPICE = {
    "none": "No Spice", "no spice": "No Spice", "low": "Tame", "tame": "Tame", "medium": "Medium Spice", "medium spice": "Medium Spice",
    "high": "Explicit", "explicit": "Explicit", "n/a": "N/A", "na": "N/A",
}
SPICE_RANK = {"No Spice": 0, "Tame": 1, "Medium Spice": 2, "Explicit": 3}


def lookup(values: dict[str, object], key: Column) -> Column:
    """A value of a small fixed table, null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def genre_file(c: Column | str) -> Column:
    s = F.lower(F.trim(_col(c)))
    return F.coalesce(lookup(GENRE_FILES, s), F.replace(s, F.lit(" "), F.lit("-")))


def staged_spice(c: Column | str) -> Column:
    return lookup(STAGED_SPICE, F.lower(F.trim(_col(c))))


def hottest(levels: Column) -> Column:
    """The highest of an array of spice levels; others than the four ranked ones count for nothing."""
    ranked = F.transform(levels, lambda x: F.struct(lookup(SPICE_RANK, x).alias("rank"), x.alias("level")))
    return F.array_max(F.filter(ranked, lambda x: x["rank"].isNotNull()))["level"]


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, cut off."""
    return F.floor(part * 100 / whole).cast("int")


def snippet(c: Column | str, n: int) -> Column:
    """The first n characters with line breaks as spaces."""
    return F.substring(F.trim(F.replace(_col(c), F.lit("\n"), F.lit(" "))), 1, n)


def pretty(c: Column | str) -> Column:
    return F.initcap(F.replace(_col(c), F.lit("-"), F.lit(" ")))


def union_by_key(existing: Column, added: Column, key=lambda x: F.lower(F.trim(x))) -> Column:
    """existing, then what of added has a new key; the first spelling stays and nothing is taken out."""
    both = F.concat(F.coalesce(existing, F.array().cast("array<string>")), F.coalesce(added, F.array().cast("array<string>")))
    seen = F.transform(both, key)
    return F.filter(both, lambda x, i: (F.array_position(seen, key(x)) == i + 1) & (F.trim(x) != ""))


def split_outside_parens(c: Column | str) -> Column:
    """Comma-separated terms; commas within parentheses don't separate."""
    return F.filter(F.transform(F.split(_col(c), r",(?![^(]*\))"), lambda x: F.trim(x)), lambda x: x != "")
