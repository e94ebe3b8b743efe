"""Landed pages and responses of book sites to records: title, author, genres, tropes, tags, spice and warnings.

Pages are (url, html). Records are made by built-in expressions over the text; fetching isn't part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import canonical_spice, clean_subject, format_author, lookup, smart_title

# Labels of the sites and what they are here.
PACING_LABELS = {"fast-paced": "Fast", "action-packed": "Fast", "slow-paced": "Slow", "slow burn": "Slow", "medium-paced": "Medium", "moderately paced": "Medium"}
SHELF_DROP = ("Readers also downloaded", "Best Books Ever Listings", "Harvard Classics", "Contemporary Reviews", "Movie Books", "Novels", "Banned Books from Anne Haight's list", "Banned Books List from the American Library Association")
SHELF_GENRE = {
    "Science-Fiction & Fantasy": "Sci-Fi", "Precursors of Science Fiction": "Sci-Fi", "Science Fiction by Women": "Sci-Fi", "Fantasy": "Fantasy", "Gothic Fiction": "Horror", "Horror": "Horror",
    "Mystery Fiction": "Mystery", "Detective Fiction": "Mystery", "Crime, Thrillers and Mystery": "Mystery", "Romance": "Romance", "Adventure": "Adventure",
}
SHELF_TAG = {"Classics of Literature": "classic literature", "Plays/Films/Dramas": "plays and dramas"}
CATEGORY_GENRE = {
    "SCIENCE FICTION": "Sci-Fi", "SCIENCE FICTION & FANTASY": "Sci-Fi", "FANTASY": "Fantasy", "ROMANCE": "Romance", "MYSTERY": "Mystery", "MYSTERY & DETECTIVE": "Mystery", "DETECTIVE": "Mystery",
    "THRILLER": "Thriller", "THRILLER & SUSPENSE": "Thriller", "SUSPENSE": "Thriller", "HORROR": "Horror", "LITERARY FICTION": "Literary Fiction",
    "HISTORICAL FICTION": "Historical Fiction", "GENERAL FICTION": "Fiction", "GRAPHIC NOVELS & COMICS": "Graphic Novel", "GRAPHIC NOVELS": "Graphic Novel",
}
CATEGORY_DROP = ("FICTION", "NONFICTION", "BOOK REVIEWS")
SPICE_NUMBER = {"0": "No Spice", "1": "Tame", "2": "Tame", "3": "Medium Spice", "4": "Explicit", "5": "Explicit"}
SPICE_WORD = {"none": "No Spice", "low": "Tame", "mild": "Tame", "medium": "Medium Spice", "high": "Explicit", "extreme": "Explicit"}
COMMUNITY_GENRE = {
    "romance": "Romance", "fantasy": "Fantasy", "science fiction": "Sci-Fi", "sci-fi": "Sci-Fi", "horror": "Horror", "mystery": "Mystery", "thriller": "Thriller", "suspense": "Thriller",
    "historical fiction": "Historical Fiction", "young adult": "Young Adult", "literary fiction": "Literary Fiction", "paranormal": "Paranormal", "graphic novel": "Graphic Novel", "comics": "Graphic Novel",
    "poetry": "Poetry", "horror fiction": "Horror", "crime": "Mystery", "contemporary romance": "Romance", "fantasy romance": "Romance", "biography": "Biography & Memoir", "memoir": "Biography & Memoir",
    "history": "History", "self-help": "Self-Help", "adventure": "Adventure", "western": "Western", "erotica": "Erotica", "short stories": "Short Stories",
}
COMMUNITY_DROP = ("fiction", "nonfiction", "non-fiction", "arts & entertainment", "science fiction & fantasy", "adult", "audiobook", "ebook", "books", "general")
COMMUNITY_JUNK = ("driven", "character development", "loveable characters", "diverse characters", "a mix", "characters")


def _text(c: Column) -> Column:
    """Visible text of a piece of HTML; null where there is none."""
    s = F.regexp_replace(c, "(?s)<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&#39;", "'"), ("&#x27;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(sign))
    return F.nullif(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(""))


def _first(html: Column, pattern: str) -> Column:
    return _text(F.regexp_extract(html, pattern, 1))


def _all(html: Column, pattern: str) -> Column:
    """Texts of all hits of the pattern's group, without empty ones."""
    return F.array_compact(F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), _text))


def _links(block: Column, css: str | None = None) -> Column:
    return _all(block, rf'(?is)<a\b[^>]*class="[^"]*\b{css}\b[^"]*"[^>]*>(.*?)</a>' if css else r"(?is)<a\b[^>]*>(.*?)</a>")


def _h1(html: Column) -> Column:
    return _first(html, r"(?is)<h1[^>]*>(.*?)</h1>")


def _title(html: Column) -> Column:
    return _first(html, r"(?is)<title[^>]*>(.*?)</title>")


def _flat(c: Column) -> Column:
    return F.array_distinct(F.flatten(c))


def review_records(pages: DataFrame) -> DataFrame:
    """(url, title, author, genres, tropes, tags, pacing) of review pages with labelled groups of tags: the group `Key
    Tropes` holds tropes, any other tags, of which the first that is a pacing gives it."""
    html = F.col("html")
    author = F.coalesce(_first(html, r'(?is)<span[^>]*>[^<]*Author:.*?<a\b[^>]*class="[^"]*\bbook-details-link\b[^"]*"[^>]*>(.*?)</a>'), F.nullif(F.regexp_extract(_title(html), r"\bby\s+(.+?)\s*$", 1), F.lit("")))
    chips = _all(html, r'(?is)<div[^>]*class="(?=[^"]*\btag--link\b)(?![^"]*\btag--series-chip\b)[^"]*\btag\b[^"]*"[^>]*>.*?<a\b[^>]*>(.*?)</a>')
    groups = F.slice(F.split(html, r'<[a-z]+[^>]*class="[^"]*\bbook-tag-group(?!_)[^"]*"[^>]*>'), 2, 1 << 20)
    parts = F.transform(groups, lambda g: F.struct(F.coalesce(_first(g, r'(?is)class="[^"]*\bbook-tag-group__label\b[^"]*"[^>]*>(.*?)<'), F.lit("")).alias("label"), _links(g, "book-tag").alias("links")))
    picked = pages.select("url", _h1(html).alias("title"), author.alias("author"), F.transform(chips, lambda g: F.when(g.isin("Science Fiction", "Science-Fiction"), "Sci-Fi").otherwise(g)).alias("genres"), parts.alias("parts"))
    lists = lambda tropes: F.flatten(F.transform(F.filter("parts", lambda p: (p["label"] == "Key Tropes") == F.lit(tropes)), lambda p: p["links"]))
    paces = F.array_compact(F.transform("tags", lambda t: lookup(PACING_LABELS, F.lower(t))))
    return picked.select("url", "title", "author", "genres", lists(True).alias("tropes"), F.array_distinct(lists(False)).alias("tags")).withColumn("pacing", F.get(paces, F.lit(0)))


def trove_records(pages: DataFrame) -> DataFrame:
    """(url, title, author, genres, tropes) of trope pages; the author stands in the page's title behind the book's."""
    html, title = F.col("html"), _h1(F.col("html"))
    whole = _title(html)
    rest = F.when(F.lower(whole).startswith(F.lower(title)), F.substring(whole, F.length(title) + 1, F.lit(1 << 20))).otherwise(whole)
    blocks = lambda css: F.regexp_extract_all(html, F.lit(rf'(?is)<(?:div|section)[^>]*class="{css}"[^>]*>(.*?)</(?:div|section)>'), 1)
    genres = F.coalesce(_links(F.get(blocks("mb-5 flex flex-wrap items-center gap-2"), F.lit(0))), F.array().cast("array<string>"))
    tropes = _flat(F.transform(blocks("flex flex-wrap gap-4"), lambda b: _links(b)))
    return pages.select("url", title.alias("title"), F.nullif(F.regexp_extract(rest, r"^\s*(?::|by)\s*(.+?)\s*\|", 1), F.lit("")).alias("author"), genres.alias("genres"), tropes.alias("tropes"))


def shelf_labels(labels: Column) -> tuple[Column, Column]:
    """(genres, tags) of a library's shelf labels; reading lists are dropped."""
    kept = F.filter(labels, lambda x: ~x.isin(*SHELF_DROP))
    genres = F.array_distinct(F.array_compact(F.transform(kept, lambda x: lookup(SHELF_GENRE, x))))
    tags = F.array_distinct(F.transform(F.filter(kept, lambda x: lookup(SHELF_GENRE, x).isNull()), lambda x: F.coalesce(lookup(SHELF_TAG, x), F.lower(x))))
    return genres, tags


def library_records(pages: DataFrame) -> DataFrame:
    """(url, title, author, genres, tags) of a library's pages: the rows of its table, and the labels of similar books."""
    html = F.col("html")
    table = F.regexp_extract(html, r'(?is)<table[^>]*class="[^"]*\bbibrec\b[^"]*"[^>]*>(.*?)</table>', 1)
    rows = F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), lambda r: F.struct(_first(r, r"(?is)<th[^>]*>(.*?)</th>").alias("label"), _first(r, r"(?is)<td[^>]*>(.*?)</td>").alias("value")))
    values = lambda name: F.transform(F.filter("rows", lambda r: (r["label"] == name) & r["value"].isNotNull()), lambda r: r["value"])
    labels = F.coalesce(_links(F.regexp_extract(html, r'(?is)class="[^"]*\bsimilar-books-tags\b[^"]*"[^>]*>(.*?)</(?:div|ul|p)>', 1)), F.array().cast("array<string>"))
    base = pages.filter(table != "").select("url", rows.alias("rows"), labels.alias("labels"))
    genres, tags = shelf_labels(F.col("labels"))
    subjects = F.filter(F.transform(values("Subject"), lambda s: clean_subject(s)), lambda s: s != "")
    return base.select("url", F.get(values("Title"), F.lit(0)).alias("title"), F.nullif(F.array_join(F.array_compact(F.transform(values("Author"), lambda a: format_author(a))), ", "), F.lit("")).alias("author"), genres.alias("genres"), F.array_distinct(F.concat(subjects, tags)).alias("tags"))


_PERSONS = "array<struct<name:string>>"


def linked_book(html: Column) -> Column:
    """Struct (title, author, genre, rating) of the first book in a page's linked data: an object, a list or a graph."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)

    def objects(raw: Column) -> Column:
        body = F.trim(raw)
        listed = F.when(body.startswith("["), body).when(F.get_json_object(body, "$['@graph']").isNotNull(), F.get_json_object(body, "$['@graph']")).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        return F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))

    books = F.filter(F.flatten(F.transform(scripts, objects)), lambda o: F.get_json_object(o, "$['@type']") == "Book")
    book = F.get(books, F.lit(0))
    person = F.get_json_object(book, "$.author")
    names = F.array_join(F.transform(F.from_json(person, _PERSONS), lambda x: F.coalesce(x["name"], F.lit(""))), ", ")
    author = F.when(person.startswith("["), F.nullif(F.btrim(names, F.lit(", ")), F.lit(""))).otherwise(F.get_json_object(book, "$.author.name"))
    return F.struct(F.get_json_object(book, "$.name").alias("title"), author.alias("author"), F.get_json_object(book, "$.genre").alias("genre"), F.get_json_object(book, "$.contentRating").alias("rating"))


def category_labels(categories: Column) -> tuple[Column, Column]:
    """(genres, tags) of a reviewer's categories; headers are dropped."""
    kept = F.filter(categories, lambda x: ~F.upper(F.trim(x)).isin(*CATEGORY_DROP))
    genre = lambda x: lookup(CATEGORY_GENRE, F.upper(F.trim(x)))
    return F.array_distinct(F.array_compact(F.transform(kept, genre))), F.array_distinct(F.transform(F.filter(kept, lambda x: genre(x).isNull()), lambda x: F.lower(F.trim(x))))


def review_site_records(pages: DataFrame) -> DataFrame:
    """(url, title, author, genres, tags) of pages with linked data and category links."""
    html = F.col("html")
    block = F.regexp_extract(html, r"(?is)Categor(?:y|ies):(.*?)(?:</(?:div|ul|p|section)>|\z)", 1)
    categories = F.array_distinct(_all(block, r'(?is)<a\b[^>]*href="[^"]*/discover-books/[^/"]+/[^"]*"[^>]*>(.*?)</a>'))
    base = pages.select("url", linked_book(html).alias("book"), categories.alias("categories"))
    genres, tags = category_labels(F.col("categories"))
    return base.select("url", smart_title(F.col("book.title")).alias("title"), F.col("book.author").alias("author"), genres.alias("genres"), tags.alias("tags"))


def mood_records(pages: DataFrame) -> DataFrame:
    """(url, title, author, genres, tropes, tags, spice_level, content_warnings) of pages with a graph of linked data; pages
    without a book are left out."""
    html = F.col("html")

    def links(kind: str) -> Column:
        own = _all(html, rf'(?is)<a\b[^>]*href="/{kind}/[^?#"]+"[^>]*>(.*?)</a>')
        return F.array_distinct(F.filter(own, lambda t: ~t.contains("→") & ~F.lower(t).startswith("more ") & (F.length(t) <= 45)))

    base = pages.select("url", linked_book(html).alias("book"), _title(html).alias("page"), links("tropes").alias("tropes"), F.concat(links("mood"), links("creature")).alias("tags"), F.regexp_extract(html, r'Content warnings for [^:]+ include:\s*([^."<]+)', 1).alias("warned"))
    number = lookup(SPICE_NUMBER, F.regexp_extract("page", r"Spice(?:\s*Level)?\s*(\d)\s*/\s*5", 1))
    word = lookup(SPICE_WORD, F.lower(F.trim(F.regexp_replace("book.rating", r"(?i)spice[:\s]*", ""))))
    genre = F.col("book.genre")
    genres = F.when(genre.startswith("["), F.from_json(genre, "array<string>")).when(genre != "", F.array(genre)).otherwise(F.array().cast("array<string>"))
    warnings = F.filter(F.transform(F.split("warned", ","), lambda x: F.trim(x)), lambda x: x != "")
    return base.filter("book.title IS NOT NULL").select("url", "book.title", "book.author", F.coalesce(genres, F.array().cast("array<string>")).alias("genres"), "tropes", "tags", F.coalesce(number, word, canonical_spice("book.rating")).alias("spice_level"), warnings.alias("content_warnings"))


def linked_authors(pages: DataFrame) -> DataFrame:
    """(url, author): that of the linked data, else of the byline."""
    byline = F.filter(_all(F.col("html"), r'(?is)<a\b[^>]*href="[^"]*/authors/[a-z0-9-]+"[^>]*>(.*?)</a>'), lambda x: F.lower(x) != "authors")
    return pages.select("url", F.coalesce(linked_book(F.col("html"))["author"], F.get(byline, F.lit(0))).alias("author"))


COMMUNITY = "struct<id:string,title:string,author_names:array<string>,users_count:bigint,genres:array<string>,moods:array<string>,tags:array<string>,content_warnings:array<string>>"


def community_hits(responses: DataFrame) -> DataFrame:
    """(row_id, hit) of landed search responses (row_id, body): their documents, in order."""
    hits = F.from_json(F.get_json_object("body", "$.data.search.results.hits"), f"array<struct<document:{COMMUNITY}>>")
    return responses.select("row_id", F.posexplode(hits).alias("pos", "h")).select("row_id", "pos", F.col("h.document").alias("hit"))


def community_labels(hit: Column) -> Column:
    """Struct (genres, tags, content_warnings) of a community's document: known genres, everything else as tags without
    noise and votes."""
    none = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(c, none), lambda x: F.lower(F.trim(x)))
    genre = F.filter(low(hit["genres"]), lambda x: ~x.isin(*COMMUNITY_DROP))
    noise = lambda x: x.isin(*COMMUNITY_DROP) | x.rlike("|".join(COMMUNITY_JUNK))
    tags = F.concat(F.filter(genre, lambda x: lookup(COMMUNITY_GENRE, x).isNull()), low(hit["moods"]), F.filter(low(hit["tags"]), lambda x: ~noise(x)))
    warnings = F.filter(F.transform(F.coalesce(hit["content_warnings"], none), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.array_distinct(F.array_compact(F.transform(genre, lambda x: lookup(COMMUNITY_GENRE, x)))).alias("genres"), F.array_distinct(tags).alias("tags"), warnings.alias("content_warnings"))


def popular_new(listing: DataFrame, have: DataFrame, floor: int = 30) -> DataFrame:
    """Listed books (id, title, author, users, …) with `floor` users or more, a title and an author, whose normal title and
    author the catalogue (norm_title, norm_author) hasn't; of those with equal keys the most used."""
    from pyspark.sql import Window

    from marginalia.functions.text import normalize_author, normalize_title

    own = listing.filter((F.col("users") >= floor) & (F.col("title") != "") & (F.col("author") != "")).withColumn("norm_title", normalize_title("title")).withColumn("norm_author", normalize_author("author"))
    new = own.join(have.select("norm_title", "norm_author").distinct(), ["norm_title", "norm_author"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("norm_title", "norm_author").orderBy(F.desc("users"), "id"))
    return new.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def listing_urls(pages: DataFrame, pattern: str) -> DataFrame:
    """(url, page) of all links of landed listing pages (page, html) that the pattern fits, each once with its first page."""
    found = pages.select("page", F.explode(F.regexp_extract_all("html", F.lit(rf'(?i)href="({pattern})"'), 1)).alias("url"))
    return found.groupBy("url").agg(F.min("page").alias("page"))


def best_extract(pages: DataFrame) -> DataFrame:
    """(row_id, page, basis, description): of landed encyclopedia pages (row_id, pos, title, author, page, text) the first
    that is about the title and names the author; its plot of 200 characters or more, else its opening."""
    from marginalia.functions.similarity import token_sort_ratio
    from marginalia.functions.text import is_disambiguation, names_author, page_title, plot_section, squeeze

    a, b = page_title(F.col("title")), page_title(F.col("page"))
    alike = (a != "") & (b.contains(a) | a.contains(b) | (token_sort_ratio(a, b) >= 72))
    plot, intro = plot_section("text", 1500), F.substring(squeeze(F.col("text")), 1, 1200)
    basis = F.when(F.length(plot) >= 200, "plot").when(F.length(intro) >= 200, "intro")
    fits = pages.filter((F.length("text") >= 200) & ~is_disambiguation(F.col("page"), F.col("text")) & names_author(F.col("text"), F.col("author"))).filter(alike).withColumn("basis", basis).filter("basis IS NOT NULL")
    first = fits.groupBy("row_id").agg(F.min_by(F.struct("page", "basis", F.when(basis == "plot", plot).otherwise(intro).alias("description")), "pos").alias("b"))
    return first.select("row_id", "b.*")


def verified_subjects(docs: DataFrame, most: int = 25) -> DataFrame:
    """(row_id, subjects) of landed search results (row_id, title, author, found_title, found_authors, subjects): the first
    `most` where the titles (whole or in part, 85) and the authors (80) agree."""
    from marginalia.functions.similarity import partial_ratio, token_sort_ratio
    from marginalia.functions.text import normalize_raw

    a, b = normalize_raw("title"), normalize_raw(F.coalesce("found_title", F.lit("")))
    own, other = normalize_raw("author"), normalize_raw(F.array_join("found_authors", ", "))
    title = (F.coalesce("title", F.lit("")) == "") | (F.greatest(token_sort_ratio(a, b), partial_ratio(a, b)) >= 85)
    author = (F.coalesce("author", F.lit("")) == "") | (other == "") | (token_sort_ratio(own, other) >= 80)
    return docs.filter(title & author).select("row_id", F.slice("subjects", 1, most).alias("subjects"))
