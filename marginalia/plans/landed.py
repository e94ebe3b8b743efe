"""Queries of landed pages and responses, case by case, and of a table's own pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.plans.cases import case_query, spread
from marginalia.plans.domain import table
from marginalia.plans.register import query
from marginalia.sources import pages as P

_URL = "html string"


def _landed(df):
    return df.select(F.col("id").cast("string").alias("url"), "html")


def _out(df, *lists):
    return df.select(F.col("url").cast("long").alias("id"), *(F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in df.columns if c != "url"))


_REVIEWS = [
    ("""<title>Book review of Dune by F. Herbert</title><h1> Dune </h1><p><span class="x">Author: </span><a class="book-details-link" href="/a">Frank <b>Herbert</b></a></p>
<div class="tag-container"><div class="tag tag--link"><a href="/g">Science Fiction</a></div><div class="tag tag--link tag--series-chip"><a>Series</a></div><div class="tag"><a>Plain</a></div></div>
<div class="book-tag-group"><span class="book-tag-group__label">Key Tropes</span><a class="book-tag">Chosen One</a><a class="book-tag">Desert &amp; Sand</a></div>
<div class="book-tag-group"><span class="book-tag-group__label">Mood</span><a class="book-tag">Slow Burn</a><a class="book-tag">dark</a><a class="book-tag">fast-paced</a></div>
<div class="book-tag-group"><a class="book-tag">dark</a></div>""",),
    ("<title>Book review of Tales by Many Hands</title><h1>Tales</h1>",),
    ("<p>nothing</p>",),
]


@case_query(
    "page_reviews", _URL, _REVIEWS, "title, author, genres, tropes, tags, pacing",
    [("Dune", "Frank Herbert", "Sci-Fi", "Chosen One|Desert & Sand", "Slow Burn|dark|fast-paced", "Slow"), ("Tales", "Many Hands", "", "", "", None), (None, None, "", "", "", None)],
)
def page_reviews(df):
    return _out(P.review_records(_landed(df)), "genres", "tropes", "tags")


_TROVES = [
    ('<title>The Sea: Ann Lee | Trove</title><h1>The Sea</h1><div class="mb-5 flex flex-wrap items-center gap-2"><a>Romance</a><a>War</a></div><div class="flex flex-wrap gap-4"><a>Found Family</a><a>Secret</a></div><div class="flex flex-wrap gap-4"><a>Secret</a><a></a></div>',),
    ("<title>Salt by Bo Ray | Trove</title><h1>Salt</h1>",),
    ("<title>Other page</title>",),
]


@case_query("page_troves", _URL, _TROVES, "title, author, genres, tropes", [("The Sea", "Ann Lee", "Romance|War", "Found Family|Secret"), ("Salt", "Bo Ray", "", ""), (None, None, "", "")])
def page_troves(df):
    return _out(P.trove_records(_landed(df)), "genres", "tropes")


_LIBRARY = [
    ("""<table class="bibrec"><tr><th>Author</th><td>Melville, Herman, 1819-1891</td></tr><tr><th>Author</th><td>Doe, Jane</td></tr><tr><th>Title</th><td>Moby
Dick</td></tr><tr><th>Title</th><td>Second</td></tr><tr><th>Subject</th><td>Ship captains -- Fiction</td></tr><tr><th>Subject</th><td>Sea stories</td></tr><tr><th>Subject</th><td>Sea Stories -- fiction</td></tr></table>
<div class="similar-books-tags"><a>Adventure</a><a>Harvard Classics</a><a>Classics of Literature</a><a>Whaling</a><a>Gothic Fiction</a><a>Sea stories</a></div>""",),
    ('<table class="bibrec"><tr><th>Language</th><td>English</td></tr></table>',),
    ("<table><tr><th>Title</th><td>x</td></tr></table>",),
]


@query("page_library", "SELECT p_partkey AS id, title, author, genres, tags FROM part JOIN (VALUES (0, 'Moby Dick', 'Herman Melville, Jane Doe', 'Adventure|Horror', 'ship captains|sea stories|classic literature|whaling'), (1, NULL, NULL, '', '')) v(k, title, author, genres, tags) ON p_partkey % 3 = k")
def page_library(spark, d):
    return _out(P.library_records(_landed(spread(spark, d, _LIBRARY, _URL))), "genres", "tags")


_SITES = [
    ("""<script type="application/ld+json">{"@type":"Thing"}</script><script type="application/ld+json">[{"@type":"Review"},{"@type":"Book","name":"DON'T LOOK","author":[{"name":"Ann Lee"},{"name":"Bo Ray"}]}]</script>
<div><h1>x</h1><p>Categories: <a href="/discover-books/fantasy/a">FANTASY</a> <a href="/discover-books/b/">Book Reviews</a> <a href="/discover-books/c/">Family Sagas</a> <a href="/x/">No</a></p></div>""",),
    ('<script type="application/ld+json">{"@type":"Book","name":"Plain","author":{"name":"Cy"}}</script>',),
    ('<script type="application/ld+json">not json</script>Category: <a href="/discover-books/thriller/">thriller</a>',),
]


@case_query("page_review_site", _URL, _SITES, "title, author, genres, tags", [("Don't Look", "Ann Lee, Bo Ray", "Fantasy", "family sagas"), ("Plain", "Cy", "", ""), (None, None, "Thriller", "")])
def page_review_site(df):
    return _out(P.review_site_records(_landed(df)), "genres", "tags")


_MOODS = [
    ("""<title>Ember - Spice Level 4/5</title><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Book","name":"Ember","author":{"name":"Ann"},"genre":["Romance","Fantasy"],"contentRating":"Spice: low"}]}</script>
<a href="/tropes/fated">Fated Mates</a><a href="/tropes/fated">Fated Mates</a><a href="/tropes/all">More tropes →</a><a href="/mood/dark">Dark</a><a href="/creature/fae">Fae</a><a href="/mood/x?y=1">No</a> Content warnings for Ember include: gore, loss , .""",),
    ('<title>Salt</title><script type="application/ld+json">{"@type":"Book","name":"Salt","genre":"War","contentRating":"Spice: Mild"}</script>',),
    ('<script type="application/ld+json">{"@type":"Book","name":"Tin","contentRating":"very spicy"}</script>',),
    ("<title>none</title>",),
]


@query("page_moods", "SELECT p_partkey AS id, v.* EXCLUDE (k) FROM part JOIN (VALUES (0, 'Ember', 'Ann', 'Romance|Fantasy', 'Fated Mates', 'Dark|Fae', 'Explicit', 'gore|loss'), (1, 'Salt', NULL, 'War', '', '', 'Tame', ''), (2, 'Tin', NULL, '', '', '', 'Explicit', '')) v(k, title, author, genres, tropes, tags, spice_level, content_warnings) ON p_partkey % 4 = k")
def page_moods(spark, d):
    return _out(P.mood_records(_landed(spread(spark, d, _MOODS, _URL))), "genres", "tropes", "tags", "content_warnings")


@case_query(
    "page_authors", _URL, [('<script type="application/ld+json">{"@type":"Book","author":[{"name":"A"},{"name":"B"}]}</script>',), ('<a href="/authors">Authors</a> by <a href="/authors/bo-ray">Bo Ray</a>',), ("<a href='/x'>y</a>",)],
    "author", [("A, B",), ("Bo Ray",), (None,)],
)
def page_authors(df):
    return _out(P.linked_authors(_landed(df)))


_HITS = [
    ('{"data":{"search":{"results":{"hits":[{"document":{"id":"7","title":"T","genres":["Fantasy","Fiction","Heists"," Suspense "],"moods":["Dark"],"tags":["Plot driven","dark","cozy"],"content_warnings":[" gore ",""]}},{"document":{"id":"8"}}]}}}}',),
    ('{"errors":[]}',),
]


@query("community_hits", "SELECT p_partkey AS id, v.* EXCLUDE (k) FROM part JOIN (VALUES (0, 0, '7', 'Fantasy|Thriller', 'heists|dark|cozy', 'gore'), (0, 1, '8', '', '', '')) v(k, pos, hit, genres, tags, warnings) ON p_partkey % 2 = k")
def community_hits(spark, d):
    own = P.community_hits(spread(spark, d, _HITS, "body string").select(F.col("id").alias("row_id"), "body"))
    labels = P.community_labels(F.col("hit"))
    return own.select(F.col("row_id").alias("id"), "pos", F.col("hit.id").alias("hit"), *(F.array_join(labels[c], "|").alias(n) for c, n in (("genres", "genres"), ("tags", "tags"), ("content_warnings", "warnings"))))


@query("popular_new", "WITH l AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author, p_size AS users FROM part), h AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 50 = 0) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY title ORDER BY users DESC, id) AS r FROM l WHERE users >= 30 AND title NOT IN (SELECT p_name FROM h)) WHERE r = 1")
def popular_new(spark, d):
    """Brands differ by digits only, which an author's normal form hasn't."""
    from marginalia.functions.text import normalize_author, normalize_title

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_size").alias("users"))
    have = p.filter("id % 50 = 0").select(normalize_title("title").alias("norm_title"), normalize_author("author").alias("norm_author"))
    return P.popular_new(p, have, 30).select("id")


@query("listing_urls", "WITH u AS (SELECT page_id AS page, unnest(regexp_extract_all(html, '(?i)href=\"(/[^\"]+)\"', 1)) AS url FROM pages) SELECT url, min(page) AS page FROM u GROUP BY url")
def listing_urls(spark, d):
    return P.listing_urls(table(spark, d, "pages").select(F.col("page_id").alias("page"), "html"), r'/[^"]+')


_LONG = "word " * 60
_EXTRACTS = [
    ("The Sea", "Ann Lee", "The Sea (novel)", f"By Ann Lee. {_LONG}\n== Plot ==\n{_LONG}\n== Notes ==\nx"), ("The Sea", "Ann Lee", "Sea", f"Ann Lee wrote it. {_LONG}"), ("Dune", "Ann Lee", "Another Book", f"Ann Lee. {_LONG}"),
    ("Dune", "Frank Herbert", "Dune", f"A film by somebody. {_LONG}"), ("Mercury", "Ann Lee", "Mercury", f"Mercury may refer to Lee. {_LONG}"), ("Dune", "Ann Lee", "Dune", "Ann Lee."),
]


@query("best_extract", "SELECT p_partkey AS id, page, basis, n FROM part JOIN (VALUES (0, 'The Sea (novel)', 'plot', 299), (1, 'Sea', 'intro', 317)) v(k, page, basis, n) ON p_partkey % 6 = k")
def best_extract(spark, d):
    rows = spread(spark, d, _EXTRACTS, "title string, author string, page string, text string").withColumn("pos", F.lit(0)).withColumnRenamed("id", "row_id")
    return P.best_extract(rows).select(F.col("row_id").alias("id"), "page", "basis", F.length("description").alias("n"))


@query("verified_subjects", "SELECT p_partkey AS id, 's1|s2' AS subjects FROM part WHERE p_partkey % 4 IN (0, 1)")
def verified_subjects(spark, d):
    rows = [("Sapiens", "Yuval Harari", "Sapiens: A Brief History of Humankind", ["Yuval Harari"]), ("Dune", "", "Dune", []), ("Dune", "Frank Herbert", "Dune", ["Zed Qux"]), ("Dune", "", "Whales", [])]
    own = spread(spark, d, rows, "title string, author string, found_title string, found_authors array<string>").withColumn("subjects", F.array(F.lit("s1"), F.lit("s2"), F.lit("s3")))
    return P.verified_subjects(own.withColumnRenamed("id", "row_id"), 2).select(F.col("row_id").alias("id"), F.array_join("subjects", "|").alias("subjects"))
