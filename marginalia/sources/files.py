"""Sources: shelf exports, catalogue files, dumps, taxonomy documents and landed pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import MOODS, derived_tags, normalize_author, normalize_isbn, normalize_raw, normalize_title, parse_date, parse_rating

SHELF_COLUMNS = ("Title", "Author", "ISBN", "ISBN13", "My Rating", "Date Read", "Date Added", "Exclusive Shelf")
DUMP = "type string, key string, revision string, modified string, json string"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted CSV file with a header, all columns text; a byte-order mark is not part of the first name."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿").strip().strip('"') for c in df.columns))


def read_shelf(spark: SparkSession, path: str) -> DataFrame:
    """A shelf export's rows on the shelf `read`: raw_title, raw_author, isbn13, isbn10, user_rating, dates."""
    raw = read_csv(spark, path)
    for c in SHELF_COLUMNS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return raw.filter(F.lower(F.trim("Exclusive Shelf")) == "read").select(
        F.trim("Title").alias("raw_title"), F.trim("Author").alias("raw_author"), normalize_isbn("ISBN13").alias("isbn13"), normalize_isbn("ISBN").alias("isbn10"), parse_rating("My Rating").alias("user_rating"), parse_date("Date Read").alias("date_read"), parse_date("Date Added").alias("date_added")
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of books; `genre` may be one text or a list."""
    schema = "id string, title string, author string, genre string, tropes array<string>, tags array<string>, pacing string, focus string, spiceLevel string, contentWarnings array<string>, verifiedSource string, sourceUrl string"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    genres = F.when(F.col("genre").startswith("["), F.from_json("genre", "array<string>")).otherwise(F.filter(F.array("genre"), lambda g: g.isNotNull()))
    return raw.withColumn("genres", genres).drop("genre")


def read_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Tab-separated records of five fields; other lines are left out. A gzip file is one task's input, so it is dealt
    out afterwards when `partitions` is given."""
    parts = F.split("value", "\t", 5)
    rows = spark.read.text(path).filter(F.size(parts) == 5).select(*(F.get(parts, F.lit(i)).alias(n.split()[0]) for i, n in enumerate(DUMP.split(", "))))
    return rows.repartition(partitions) if partitions else rows


# The document's numbered sections by their genres, the section that is universal, the one of non-fiction,
# terms with a kind of their own and entries that are two terms.
SECTION_GENRES = {1: ("Romance",), 2: ("Fantasy",), 3: ("Sci-Fi",), 4: ("Mystery", "Thriller"), 5: ("Horror",), 6: ("Young Adult",), 7: ("Historical Fiction",), 8: ("Literary Fiction",), 9: (), 10: ()}
UNIVERSAL_SECTION, NONFICTION_SECTION = 9, 10
TERM_KINDS = {
    "hea": "tag", "hfn": "tag", "happily ever after": "tag", "happily for now": "tag", "dubcon": "warning", "closed door": "tag", "low spice": "tag", "fade to black": "tag",
    "moderate spice": "tag", "high spice": "tag", "explicit": "tag", "slow burn spice": "tag", "bdsm": "tag", "polyamory": "tag", "multiple pov intimacy scenes": "tag",
}
TWO_TERMS = {"hea hfn": ("HEA", "HFN")}
EDITORIAL = r"also|only|flag|note|see |context|cross-listed|e\.g\."
TAXONOMY = "pos int, slug string, display string, kind string, applies_to string, genres array<string>, aliases array<string>"


def _norm(term: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", re.sub(r"(?<=[a-z0-9])([A-Z])", r" \1", term).lower().replace("_", " ")).split())


def _slug(term: str) -> str:
    return "-".join(re.findall("[a-z0-9]+", re.sub(r"(?<=[a-z0-9])([A-Z])", r" \1", term).lower().replace("&", " and ")))


def term_and_aliases(entry: str) -> tuple[str, list[str]]:
    """A list's entry without remarks; short parentheses that aren't editorial are aliases."""
    body = re.split(r"\s+[—–]\s+", entry.strip())[0]
    notes = [p.strip() for p in re.findall(r"\(([^)]*)\)", body)]
    aliases = [p.strip(" .;:") for p in notes if len(p.split()) <= 4 and not re.search(EDITORIAL, p, re.I)]
    return re.sub(r"\s*\([^)]*(\)|$)", "", body).strip(" .;:"), [a for a in aliases if a]


def term_list(body: str) -> str:
    """The paragraph with most commas, three or more, that is no heading, quote or bullet; after a colon where the rest is
    still a list."""
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", body)]
    best = max((p for p in paragraphs if p and p[0] not in "#>-*"), key=lambda p: p.count(","), default="")
    if best.count(",") < 3:
        return ""
    tail = best.rpartition(":")[2]
    return (tail if tail.count(",") >= 3 else best).strip()


def parse_taxonomy(text: str) -> list[dict]:
    """Every term of the document once, in order: genres, then each section's terms by the kind of its part, then moods."""
    out: dict[str, dict] = {}

    def add(display: str, kind: str, applies: str, genres: tuple[str, ...], aliases: Sequence[str] = (), universal: bool = False) -> None:
        slug = _slug(display)
        if slug in out and universal:
            out[slug]["genres"] = []
        elif slug and slug not in out:
            out[slug] = {"slug": slug, "display": display, "kind": kind, "applies_to": applies, "genres": list(genres), "aliases": list(aliases)}

    for genre in dict.fromkeys(g for own in SECTION_GENRES.values() for g in own):
        add(genre, "genre", "fiction", ())
    for section in re.split(r"\n##\s+", text):
        head = re.match(r"(\d+)\.\s*[^\n]+\n(.*)", section, re.S)
        if not head or int(head[1]) not in SECTION_GENRES:
            continue
        number, parts = int(head[1]), re.split(r"\n###\s+", head[2])
        for i, part in enumerate(parts):
            title, _, rest = part.partition("\n") if i else ("", "", part)
            low, nonfiction = title.lower(), number == NONFICTION_SECTION
            kind = "subject" if nonfiction else "subgenre" if "subgenre" in low else "tag" if "spice" in low or "heat" in low else "trope"
            for entry in re.split(r",(?![^(]*\))", term_list(rest)):
                display, aliases = term_and_aliases(entry)
                norm = _norm(display)
                if len(display) < 2:
                    continue
                applies = "nonfiction" if nonfiction else "fiction"
                if norm in TWO_TERMS:
                    for one in TWO_TERMS[norm]:
                        add(one, "tag", applies, SECTION_GENRES[number])
                    continue
                own = TERM_KINDS.get(norm) or TERM_KINDS.get(norm.split(" ")[0]) or kind
                add(display, own, "both" if own == "warning" else applies, SECTION_GENRES[number], aliases, number == UNIVERSAL_SECTION)
    for mood in MOODS:
        add(mood, "mood", "both", ())
    return list(out.values())


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(pos, slug, display, kind, applies_to, genres, aliases) of a taxonomy document, a file of some kB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([{"pos": i} | t for i, t in enumerate(parse_taxonomy(text))], _TAXONOMY)

    return spark.read.text(path, wholetext=True).mapInArrow(run, TAXONOMY)


_TAXONOMY = pa.schema([("pos", pa.int32()), *((x, pa.string()) for x in ("slug", "display", "kind", "applies_to")), ("genres", pa.list_(pa.string())), ("aliases", pa.list_(pa.string()))])


def built_vocabulary(current: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, aliases) after a taxonomy document: its terms take the place of those with the same slug, and keep the
    status that they have; an alias belongs to the first term that names it."""
    old = current.select("slug", F.col("status").alias("_status"))
    new = parsed.join(old, "slug", "left").select("slug", "display", "kind", "applies_to", "genres", F.coalesce("_status", F.lit("active")).alias("status"))
    vocabulary = new.unionByName(current.select(*new.columns).join(parsed.select("slug"), "slug", "left_anti"))
    names = parsed.select("pos", "slug", F.posexplode(F.concat(F.array("display"), "aliases")).alias("at", "name")).select("slug", F.struct("pos", "at").alias("order"), normalize_raw("name").alias("alias"))
    return vocabulary, names.filter("alias <> ''").groupBy("alias").agg(F.min_by("slug", "order").alias("slug"))


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A review file's rows: read_csv() with `decision` under that name, whatever hint follows it in the header."""
    raw = read_csv(spark, path)
    return raw.toDF(*("decision" if c.startswith("decision") else c for c in raw.columns))


def catalogue_books(entries: DataFrame) -> DataFrame:
    """Catalogue entries as books: normal title and author, tags with those that follow from tropes and pacing."""
    none = F.array().cast("array<string>")
    return entries.select(
        "id", "title", "author", normalize_title("title").alias("norm_title"), normalize_author("author").alias("norm_author"), "genres", F.coalesce("tropes", none).alias("tropes"),
        derived_tags(F.col("tropes"), F.col("tags"), F.col("pacing")).alias("tags"), "pacing", F.col("spiceLevel").alias("spice_level"), "focus", F.coalesce("contentWarnings", none).alias("content_warnings"), F.lit(None).cast("string").alias("status"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """pages: (page_id, url, html). (page_id, title, h1, n_links, json_ld)."""
    first = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", p, 1), "<[^>]*>", "")), F.lit(""))
    return pages.select("page_id", first(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), first(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"), F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("int").alias("n_links"), first(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>').alias("json_ld"))
