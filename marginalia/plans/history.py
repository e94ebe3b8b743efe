"""Queries of imports, staging, promotion, histories, metadata and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import imports, matching, metadata, recommend, review, staging
from marginalia.operators.lexical import Pattern
from marginalia.plans.cases import case_query, outcome_sql, spread, values
from marginalia.plans.domain import BOOKS_SQL, USER_BOOKS_SQL, books, table, user_books
from marginalia.plans.register import query
from marginalia.plans.vocabulary import aliases, vocabulary
from marginalia.sources import sinks

WITH = f"WITH {BOOKS_SQL}, {USER_BOOKS_SQL}"

# Typed rows of customers: an ISBN hit, an exact title, one by somebody else, and one that nothing is like.
_TYPED = """typed AS (SELECT c_custkey AS row_id, c_custkey % 4 AS k, CASE c_custkey % 4 WHEN 3 THEN 'qqq zzz xxx' ELSE p_name END AS raw_title, CASE c_custkey % 4 WHEN 2 THEN 'zzz qqq' ELSE p_brand END AS raw_author,
  CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '9') ELSE '' END AS isbn13, CASE WHEN c_custkey % 8 = 4 THEN '123456789X' ELSE '' END AS isbn10 FROM customer JOIN part ON p_partkey = 1 + c_custkey % 150)"""


def _typed(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id")).withColumn("k", F.col("row_id") % 4)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("_p"), "p_name", "p_brand")
    j = c.join(p, F.col("_p") == 1 + F.col("row_id") % 150)
    isbn10 = F.when(F.col("row_id") % 8 == 4, "123456789X").otherwise("")
    return j.select("row_id", F.when(F.col("k") == 3, "qqq zzz xxx").otherwise(F.col("p_name")).alias("raw_title"), F.when(F.col("k") == 2, "zzz qqq").otherwise(F.col("p_brand")).alias("raw_author"), F.when(F.col("k") == 0, F.lpad(F.col("_p").cast("string"), 13, "9")).otherwise("").alias("isbn13"), isbn10.alias("isbn10"))


def _listed(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.when(F.col("p_partkey") % 2 == 0, F.lpad(F.col("p_partkey").cast("string"), 13, "9")).otherwise("").alias("isbn"))


# An author's digits don't count, so every brand is one name and the smallest id of a title is the best.
_MATCHED = f"""{_TYPED}, keyed AS (SELECT t.*, CASE WHEN isbn13 <> '' THEN (SELECT min(p_partkey) FROM part WHERE p_partkey % 2 = 0 AND lpad(CAST(p_partkey AS VARCHAR), 13, '9') = isbn13) END AS hit FROM typed t),
  firsts AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name),
  done AS (SELECT row_id, coalesce(hit, f.id) AS book_id, CASE WHEN hit IS NOT NULL THEN 'matched' WHEN k = 3 THEN 'unmatched' WHEN k = 2 THEN 'ambiguous' ELSE 'matched' END AS match_status FROM keyed LEFT JOIN firsts f ON f.p_name = raw_title)"""


@query("import_cascade", f"WITH {_MATCHED} SELECT * FROM done")
def import_cascade(spark, d):
    return imports.import_rows(_typed(spark, d), _listed(spark, d)).select("row_id", "book_id", "match_status")


@query("import_summary", f"WITH {_MATCHED} SELECT count(*) AS total_read, count(*) FILTER (match_status = 'matched') AS matched, count(*) FILTER (match_status = 'ambiguous') AS ambiguous, count(*) FILTER (match_status = 'unmatched') AS unmatched FROM done")
def import_summary(spark, d):
    return imports.summary(imports.import_rows(_typed(spark, d), _listed(spark, d)))


@query("rematch_unmatched", "SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 THEN -1 WHEN p_partkey % 3 = 1 THEN (SELECT min(p_partkey) FROM part q WHERE q.p_name = p.p_name) END AS book_id, CASE p_partkey % 3 WHEN 2 THEN 'unmatched' ELSE 'matched' END AS match_status FROM part p")
def rematch_unmatched(spark, d):
    b = _listed(spark, d)
    own = b.select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 2, "qqq zzz xxx").otherwise(F.col("title")).alias("raw_title"), F.col("author").alias("raw_author"), F.when(F.col("id") % 3 == 0, F.lit(-1).cast("long")).alias("book_id"), F.when(F.col("id") % 3 == 0, "matched").otherwise("unmatched").alias("match_status"))
    return imports.rematched(own, b).select("row_id", "book_id", "match_status")


_READ = "user_id, book_id, match_status, order_key, line_no"


@query("reimport", f"{WITH}, new AS (SELECT user_id, -1 AS book_id, 'matched' AS match_status, order_key, line_no FROM user_books WHERE user_id % 5 = 0 AND line_no = 1) SELECT {_READ} FROM user_books WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT {_READ} FROM new")
def reimport(spark, d):
    own = user_books(spark, d).select(*_READ.split(", "))
    new = own.filter("user_id % 5 = 0 AND line_no = 1").withColumn("book_id", F.lit(-1).cast("long")).withColumn("match_status", F.lit("matched"))
    return imports.reimported(own, new)


@query("flag_mismatch", f"{WITH}, r AS (SELECT *, order_key * 10 + line_no AS row_id FROM user_books) SELECT user_id, row_id, CASE WHEN line_no <> 2 THEN book_id END AS book_id, CASE WHEN line_no = 2 AND book_id IS NOT NULL THEN 'unmatched' ELSE match_status END AS match_status FROM r")
def flag_mismatch(spark, d):
    own = user_books(spark, d).withColumn("row_id", F.col("order_key") * 10 + F.col("line_no"))
    flags = own.filter("line_no = 2").select("user_id", "row_id").unionByName(own.filter("line_no = 1").select((F.col("user_id") + 1).alias("user_id"), "row_id"))
    return imports.flagged(own, flags).select("user_id", "row_id", "book_id", "match_status")


_PENDING = "seen AS (SELECT user_id, raw_title, raw_author, count(*) AS seen_count, min(date_read) AS first_seen FROM user_books WHERE match_status = 'unmatched' OR line_no = 2 GROUP BY ALL)"


def _pending(spark, d):
    own = user_books(spark, d)
    first = matching.pending(own)
    more = own.filter("line_no = 2 AND match_status <> 'unmatched'").select("user_id", "raw_title", "raw_author", F.col("date_read").alias("seen"))
    return imports.pending_after(first, more)


@query("pending_after_flags", f"{WITH}, {_PENDING} SELECT * FROM seen")
def pending_after_flags(spark, d):
    return _pending(spark, d)


@query("pending_list_100", f"{WITH}, {_PENDING} SELECT * FROM seen ORDER BY seen_count DESC, first_seen DESC NULLS LAST, user_id, raw_title, raw_author LIMIT 100")
def pending_list_100(spark, d):
    return imports.pending_list(_pending(spark, d), 100)


@query("matched_list", f"{WITH} SELECT user_id, book_id, title, author, user_rating, match_status, date_read FROM user_books JOIN books ON id = book_id WHERE shelf = 'read' ORDER BY date_read DESC NULLS LAST, book_id")
def matched_list(spark, d):
    return imports.matched_list(user_books(spark, d), books(spark, d)).select("user_id", "book_id", "title", "author", "user_rating", "match_status", "date_read")


@query("accepted_match", "SELECT p_partkey AS row_id, (SELECT min(p_partkey) FROM part q WHERE q.p_name = p.p_name) AS book_id FROM part p WHERE p_partkey % 2 = 0")
def accepted_match(spark, d):
    b = _listed(spark, d)
    return matching.accepted_match(b.select(F.col("id").alias("row_id"), "title", F.when(F.col("id") % 2 == 0, F.col("author")).otherwise("zzz qqq").alias("author")), b)


@query("popular_match", "SELECT p_partkey AS row_id, p_partkey * 10 + 2 AS hit_id FROM part WHERE p_partkey % 3 <> 2")
def popular_match(spark, d):
    """Three hits a row: one of few users, one of many, and another book; every third row's author fits none."""
    b = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, "").otherwise("zzz qqq").alias("author"), "p_brand")
    hits = F.array(*(F.struct(F.lit(i).alias("i"), t.alias("hit_title"), F.lit(u).alias("users")) for i, t, u in ((1, F.col("title"), 5), (2, F.concat(F.lit("The "), F.col("title")), 900), (3, F.lit("qqq"), 10**6))))
    h = b.select("row_id", "title", "author", F.col("p_brand").alias("hit_author"), F.explode(hits).alias("h")).select("row_id", "title", "author", "hit_author", "h.*")
    return matching.popular_match(h.withColumn("hit_id", F.col("row_id") * 10 + F.col("i")))


_RESULTS = [
    (True, None, "high", ["slow-burn", "court-intrigue", "slow-burn"], ["court-intrigue"], ["hopeful"], "Fast", "high", "Plot"),
    (False, None, "medium", ["slow-burn"], [], None, "Slow", None, None),
    (None, "nonfiction", None, ["slow-burn"], ["court-intrigue", "unheard"], None, "slow", "None", "Mood"),
    (True, "childrens", "low", ["found-family"], None, None, None, "explicit", "World"),
    (True, "fiction", "high", [], [], None, None, "hot", None),
]
_STAGED = [
    (True, "fiction", "high", "slow-burn", "court-intrigue", "court-intrigue|hopeful", "Fast", "Explicit", "Plot", "enriched"),
    None,
    (True, "nonfiction", "medium", "", "court-intrigue", "slow-burn-x", None, "No Spice", None, "enriched"),
    (True, "childrens", "low", "found-family", "", "", None, "N/A", "World", "needs_escalation"),
    (True, "fiction", "high", "", "", "", None, None, None, "needs_escalation"),
]
_STAGED[2] = (True, "nonfiction", "medium", "", "court-intrigue", "unheard", None, "No Spice", None, "enriched")
_STAGED_COLUMNS = "known, book_class, confidence, tropes, tags, proposed, pacing, spice_level, focus, stage"


def _staged(spark, d):
    none = F.array().cast("array<string>")
    b = books(spark, d).select("id", F.lit("fiction").alias("book_class"), "tropes", "tags", none.alias("content_warnings"), "pacing", "spice_level", "focus")
    results = spread(spark, d, _RESULTS, "known boolean, book_class string, confidence string, tropes array<string>, tags array<string>, subjects array<string>, pacing string, spice_level string, focus string").withColumn("content_warnings", none)
    return staging.staged_results(results, vocabulary(spark).filter("status = 'active'").select("slug", "kind"), b), b


@query("staged_results", f"SELECT p_partkey AS id, {_STAGED_COLUMNS} FROM part JOIN (VALUES {values([(i, *s) for i, s in enumerate(_STAGED) if s])}) v(k, {_STAGED_COLUMNS}) ON p_partkey % 5 = k")
def staged_results(spark, d):
    out, _ = _staged(spark, d)
    return out.select("id", "known", "book_class", "confidence", *(F.array_join(c, "|").alias(c) for c in ("tropes", "tags", "proposed")), "pacing", "spice_level", "focus", "stage")


_CHOSEN = [(True, "high", "reject", "rejected"), (True, "high", None, "promote"), (True, "medium", " ", "left_pending"), (True, "low", "Approve", "promote"), (False, "high", "approve", "skipped_unknown"), (None, "high", "hold", "promote")]


@query("promotion_outcome", outcome_sql("outcome, status, run", [(o, {"promote": "approved", "rejected": "rejected"}.get(o, "pending"), "run_1" if o == "promote" else None) for *_, o in _CHOSEN]))
def promotion_outcome(spark, d):
    rows = spread(spark, d, [c[:3] for c in _CHOSEN], "known boolean, confidence string, decision string")
    out = staging.selected(rows.drop("decision"), rows.select("id", "decision"), auto=True)
    return staging.stamped(out, "run_1", F.current_timestamp()).select("id", "outcome", "status", "run")


@query("rollback_run", f"{WITH} SELECT id, array_to_string(CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN ['new'] ELSE tropes END, '|') AS tropes, CASE WHEN id % 3 <> 0 THEN 'none' WHEN id % 2 = 0 THEN 'approved' ELSE 'pending' END AS status FROM books")
def rollback_run(spark, d):
    """Every third book was staged; even ones were promoted in run b, odd ones in run a, which is rolled back."""
    b = books(spark, d).select("id", "tropes", "tags", "pacing", "spice_level", "focus")
    image = F.struct("tropes", "tags", "pacing", "spice_level", "focus")
    own = b.filter("id % 3 = 0").select("id", image.alias("before_image"), F.when(F.col("id") % 2 == 0, "b").otherwise("a").alias("run"), F.lit("approved").alias("status"), F.current_timestamp().alias("promoted_at"))
    now = b.withColumn("tropes", F.when(F.col("id") % 3 == 0, F.array(F.lit("new"))).otherwise(F.col("tropes")))
    back, again = staging.rolled_back(now, own, "a")
    return back.select("id", F.array_join("tropes", "|").alias("tropes")).join(again.select("id", "status"), "id", "left").select("id", "tropes", F.coalesce("status", F.lit("none")).alias("status"))


@query("edit_backup", "SELECT p_partkey AS id, p_name AS title, p_brand AS author FROM part")
def edit_backup(spark, d):
    """An edit's old values are taken first; put back, every row is as it was."""
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    edited = b.withColumn("title", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("title")))
    return staging.restored(edited, staging.snapshot(b, edited, ["title"]))


@query("edit_backup_rows", "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey % 4 = 0")
def edit_backup_rows(spark, d):
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return staging.snapshot(b, b.withColumn("title", F.when(F.col("id") % 4 != 0, F.col("title"))), ["title"])


@query("reverted_flips", outcome_sql("book_class", [("fiction",), ("fiction",), ("nonfiction",), ("nonfiction",), ("poetry_drama",)]))
def reverted_flips(spark, d):
    rows = spread(spark, d, [("nonfiction", "fiction", "nonfiction"), ("fiction", "nonfiction", "fiction"), ("nonfiction", "nonfiction", "nonfiction"), ("nonfiction", None, "nonfiction"), ("poetry_drama", None, None)], "book_class string, old_class string, new_class string")
    return staging.reverted_flips(rows.select("id", "book_class"), rows.select("id", "old_class", "new_class"))


_SOURCED = [(["Slow Burn", "weird"], ["family found"], ["Gore", "drug us"], "Tame"), ([], ["court-intrigue", "OLD TERM"], ["BLOOD"], ""), (None, None, None, None)]


@query("merged_source", outcome_sql("tropes, tags, warnings, spice_level", [("x|slow-burn|found-family", "y", "Blood|Gore|drug use", "Tame"), ("x", "y|court-intrigue", "Blood", "N/A"), ("x", "y", "Blood", "N/A")]))
def merged_source(spark, d):
    entries = spread(spark, d, _SOURCED, "tropes array<string>, tags array<string>, content_warnings array<string>, spice_level string")
    one = lambda x: F.array(F.lit(x))
    b = entries.select("id", one("x").alias("tropes"), one("y").alias("tags"), one("Blood").alias("content_warnings"), F.lit("N/A").alias("spice_level"))
    out, _ = staging.merged_source(b, entries, vocabulary(spark).filter("status = 'active'").select("slug", "kind"), aliases(spark), ({"drug us": "drug use"}, []))
    return out.select("id", *(F.array_join(c, "|").alias(n) for c, n in (("tropes", "tropes"), ("tags", "tags"), ("content_warnings", "warnings"))), "spice_level")


@query("source_proposals", "WITH c AS (SELECT p_partkey % 3 AS k, count(*) AS n FROM part GROUP BY 1) SELECT 'weird' AS raw, (SELECT n FROM c WHERE k = 0) AS n UNION ALL SELECT 'OLD TERM', (SELECT n FROM c WHERE k = 1)")
def source_proposals(spark, d):
    entries = spread(spark, d, _SOURCED, "tropes array<string>, tags array<string>, content_warnings array<string>, spice_level string")
    return staging.merged_source(entries, entries, vocabulary(spark).filter("status = 'active'").select("slug", "kind"), aliases(spark))[1]


@query("review_export", f"{WITH} SELECT id AS book_id, title, array_to_string(genres, ', ') AS genres_before, array_to_string(tropes, ', ') AS tropes_before, 'new, ' || tropes[1] AS tropes_new, CASE WHEN id % 3 = 0 THEN 'NO' ELSE 'yes' END AS known, CASE WHEN id % 4 = 0 THEN 'no' ELSE 'yes' END AS grounded, CASE WHEN id % 4 = 0 THEN '' ELSE 'Line ' || id END AS snippet FROM books WHERE id % 2 = 0")
def review_export(spark, d):
    b = books(spark, d)
    own = b.select("id", F.when(F.col("id") % 2 == 0, "pending").otherwise("approved").alias("status"), F.lit(None).cast("string").alias("run"), F.lit("m").alias("model"), F.lit("high").alias("confidence"), (F.col("id") % 3 != 0).alias("known"), F.lit("fiction").alias("book_class"), F.concat(F.array(F.lit("new")), "tropes").alias("tropes"), "tags", F.struct("tropes", "tags").alias("before_image"))
    texts = b.select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("Line\n"), F.col("id").cast("string"))).alias("description"))
    return review.export(own, b, texts).select("book_id", "title", "genres_before", "tropes_before", "tropes_new", "known", "grounded", "snippet")


# --- packs -----------------------------------------------------------------------------------------------------

#: 120 made patterns: words by their opening, in ASCII signs that both engines read alike.
WIDE_PACK = [Pattern(f"{a}{b}", "A" if i % 2 == 0 else "B", rf" {a}{b}[a-z]*") for i, (a, b) in enumerate((a, b) for a in "bcdfghklmnprstvwaeioxyzj"[:24] for b in "aeiou")]
_WIDE_SQL = f"""pack AS (SELECT * FROM (VALUES {values([(i, p.slug, p.tier, p.regex) for i, p in enumerate(WIDE_PACK)])}) p(ord, slug, tier, regex)),
  hits AS (SELECT doc_id AS id, ord, slug, tier, regexp_extract(text, '(?i)' || regex, 0) AS phrase FROM documents, pack WHERE regexp_matches(text, '(?i)' || regex)),
  capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS r FROM hits) WHERE r <= 8)"""


@query("wide_pack", f"WITH {_WIDE_SQL} SELECT id, CAST(ord AS INT) AS ord, slug, tier, phrase FROM capped")
def wide_pack(spark, d):
    """A pack of 120 patterns over every text, in one pass, at most eight hits a text."""
    from marginalia.operators.lexical import match_rows

    return match_rows(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), WIDE_PACK, 8, context=False)


_TROPES = [Pattern("bet", "A", r"\bbet\b"), Pattern("lesbian", "A", r"\blesbian\b"), Pattern("queen", "B", r"\bqueens?\b"), Pattern("war", "B", r"\bwars?\b")]
_TEXTS = [
    ("Sea", ["Romance"], [], "wikipedia", "A bet. A queen."), ("Sea", ["Dark romance"], ["bet"], "ol_dump", "A bet and a war."), ("An anthology", ["Romance"], [], "wikipedia", "A bet."), ("Sea", ["Horror"], [], "wikipedia", "A bet."),
    ("Sea", ["Romance"], [], "wikipedia", "A lesbian bet on queens and wars."), ("Sea", ["Romance"], [], "wikipedia", " "), ("Sea", ["Romance"], [], "wikipedia", "A study of a bet."),
]
_PACKED = [(0, 0, "bet", "A", "bet"), (0, 2, "queen", "B", "queen"), (1, 3, "war", "B", "war"), (4, 0, "bet", "A", "bet"), (4, 1, "lesbian", "A", "lesbian"), (4, 2, "queen", "B", "queens"), (4, 3, "war", "B", "wars"), (4, 4, "lgbtq", "A", "(implied by identity tag)")]


def _pack_rows(spark, d, limit=8):
    rows = spread(spark, d, _TEXTS, "title string, genres array<string>, tropes array<string>, source string, description string")
    b, meta = rows.select("id", "title", "genres", "tropes"), rows.select(F.col("id").alias("book_id"), "source", "description")
    own = review.described(b, meta, ["wikipedia", "ol_dump"]).filter(review.in_genre(F.col("genres"), ["Romance"]))
    return review.run_pack(own, _TROPES, limit, veto=r"\ba study of\b", implied=True)


@query("pack_run", f"SELECT p_partkey AS id, ord, slug, tier, phrase FROM part JOIN (VALUES {values(_PACKED)}) v(k, ord, slug, tier, phrase) ON p_partkey % 7 = k")
def pack_run(spark, d):
    """Gate by genre, first description, boilerplate, veto, slugs that a book has, umbrella tag."""
    return _pack_rows(spark, d).drop("context")


@query("pack_batch", outcome_sql("slugs, tiers, confidence", [("bet|queen", "A/B", "medium"), ("war", "B", "medium"), (None, None, None), (None, None, None), ("bet|lesbian|queen", "A/B", "medium"), (None, None, None), (None, None, None)]).replace(" = k", " = k WHERE slugs IS NOT NULL"))
def pack_batch(spark, d):
    rows = _pack_rows(spark, d).withColumnRenamed("ord", "seq").withColumn("decision", F.when(F.col("slug") == "lgbtq", " Drop ").otherwise(""))
    out = review.tag_batch(rows, 3)
    return out.select("id", F.array_join("slugs", "|").alias("slugs"), "tiers", "confidence")


@query("pack_refiltered", "SELECT p_partkey AS id FROM part WHERE p_partkey % 7 IN (0, 1, 3, 4)")
def pack_refiltered(spark, d):
    rows = spread(spark, d, _TEXTS, "title string, genres array<string>, tropes array<string>, source string, description string")
    return review.refiltered(rows.select("id"), rows.select("id", "title", "description"), r"\ba study of\b")


@query("split_review", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 'hold' ELSE 'clean' END AS part FROM part")
def split_review(spark, d):
    clean, hold = review.split_rows(spread(spark, d, [("a",), ("b",), (None,)], "slug string"), ["b"])
    return clean.select("id", F.lit("clean").alias("part")).unionByName(hold.select("id", F.lit("hold").alias("part")))


# --- metadata --------------------------------------------------------------------------------------------------


@case_query(
    "dump_works", "json string",
    [('{"key":"/w/1","title":"T","authors":[{"author":{"key":"/authors/A1"}}],"description":{"value":" D "},"subjects":["s","t"]}',), ('{"key":"/w/2","title":"U","authors":[{"key":"/authors/A2"},{"author":"/authors/A3"}],"description":"x"}',),
     ('{"key":"/w/3","title":"V","authors":["/authors/A4","/x/1"],"description":"  "}',), ('{"key":"/w/4","title":"W"}',), ("not json",)],
    "key, title, authors, description, subjects", [("/w/1", "T", "/authors/A1", "D", "s|t"), ("/w/2", "U", "/authors/A2|/authors/A3", "x", None), ("/w/3", "V", "/authors/A4", None, None), ("/w/4", "W", "", None, None), (None, None, "", None, None)],
)
def dump_works(df):
    w = metadata.works(df.withColumn("type", F.lit("/type/work")).withColumn("json", F.col("json")), keep=("id",))
    return w.select("id", "key", "title", F.array_join("authors", "|").alias("authors"), "description", F.array_join("subjects", "|").alias("subjects"))


@query("confirmed_works", "WITH f AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name) SELECT '/w/' || p_partkey AS key, f.id, p_partkey % 3 <> 1 AS verified FROM part JOIN f USING (p_name) WHERE p_partkey % 3 <> 2")
def confirmed_works(spark, d):
    """Works with the right author, with none, and with somebody else."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 3
    work = p.select(F.concat(F.lit("/w/"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("title"), F.when(k == 0, F.array(F.lit("/authors/1"), F.lit("/authors/0"))).when(k == 1, F.array(F.lit("/authors/9"))).otherwise(F.array(F.lit("/authors/2"))).alias("authors"))
    names = spark.createDataFrame([("/authors/1", "Brand 11"), ("/authors/0", None), ("/authors/2", "Zzz Qqq"), ("/authors/3", "Unused")], "key string, name string")
    return metadata.confirm_works(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author")), work, names)


@query("work_rollup", "SELECT o_custkey AS id, 'w' || max(o_orderkey) AS work_key, min_by('d' || o_orderkey, o_orderkey) FILTER (o_orderkey % 3 = 0) AS description, array_to_string(list_sort(list_distinct(list(o_orderpriority) || list(o_orderstatus))), '|') AS subjects FROM orders GROUP BY o_custkey")
def work_rollup(spark, d):
    o = table(spark, d, "orders")
    key = F.concat(F.lit("w"), F.col("o_orderkey").cast("string"))
    work = o.select(key.alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))).alias("description"), F.array("o_orderpriority", "o_orderstatus").alias("subjects"))
    return metadata.work_rollup(o.select(key.alias("key"), F.col("o_custkey").alias("id")), work).select("id", "work_key", "description", F.array_join("subjects", "|").alias("subjects"))


@query("editions_of_works", "SELECT o_custkey % 20 AS id, count(*) AS n, min(lpad(CAST(o_custkey AS VARCHAR), 10, '0')) AS isbn FROM orders WHERE o_custkey % 20 < 10 GROUP BY 1")
def editions_of_works(spark, d):
    """Editions name an unknown work first and then one that half of the time is confirmed."""
    o = table(spark, d, "orders")
    digits = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    isbns = F.array(F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 10)), F.lit(" "))
    e = o.select(F.col("o_orderkey").alias("seq"), F.array(F.lit("/w/x"), F.concat(F.lit("/w/"), (F.col("o_custkey") % 20).cast("string"))).alias("works"), isbns.alias("isbns"), F.lit("1999").alias("date"), F.lit(0).alias("pages"))
    confirmed = spark.range(10).select(F.concat(F.lit("/w/"), F.col("id").cast("string")).alias("key"), F.col("id"))
    return metadata.editions_of(e, confirmed).groupBy("id").agg(F.count("*").alias("n"), F.min("isbn").alias("isbn"))


@query("fill_empty", f"{WITH} SELECT id, coalesce(pacing, 'Found') AS pacing, CASE WHEN spice_level IS NULL AND id % 2 = 0 THEN 'Tame' ELSE spice_level END AS spice_level FROM books")
def fill_empty(spark, d):
    b = books(spark, d).select("id", "pacing", "spice_level")
    found = b.select("id", F.lit("Found").alias("pacing"), F.when(F.col("id") % 2 == 0, "Tame").alias("spice_level"))
    return metadata.fill_empty(b, found, ["pacing", "spice_level"])


@query("neighbour_scores", f"""{WITH}, heavy AS (SELECT user_id FROM user_books GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
  rated AS (SELECT book_id, CASE floor(coalesce(max_by(user_rating, order_key * 10 + line_no), 0)) WHEN 5 THEN 2.0 WHEN 4 THEN 1.0 WHEN 3 THEN 0 WHEN 2 THEN 0 WHEN 1 THEN 0 ELSE 0.5 END AS w FROM (SELECT DISTINCT ON (book_id) * FROM user_books WHERE user_id IN (FROM heavy) AND book_id IS NOT NULL ORDER BY book_id, order_key, line_no) GROUP BY book_id),
  f AS (SELECT id, 'genre' AS kind, unnest(genres) AS feature FROM books UNION ALL SELECT id, 'tag', unnest(tags) FROM books), liked AS (SELECT kind, feature, sum(w) AS w FROM f JOIN rated ON book_id = id WHERE w > 0 GROUP BY ALL),
  idf AS (SELECT feature, ln((SELECT count(*) FROM books) / count(DISTINCT id)) AS idf FROM f WHERE kind = 'tag' GROUP BY feature)
  SELECT id, round(sum(l.w * CASE f.kind WHEN 'genre' THEN 0.3 ELSE 0.7 * idf END), 6) AS score FROM f JOIN liked l USING (kind, feature) LEFT JOIN idf i ON i.feature = f.feature GROUP BY id HAVING round(sum(l.w * CASE f.kind WHEN 'genre' THEN 0.3 ELSE 0.7 * idf END), 6) > 0""")
def neighbour_scores(spark, d):
    reads = user_books(spark, d)
    heavy = reads.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(1).select("user_id")
    own = reads.join(F.broadcast(heavy), "user_id", "left_semi").filter("book_id IS NOT NULL").groupBy("book_id").agg(F.min_by("user_rating", F.struct("order_key", "line_no")).alias("user_rating"))
    return metadata.neighbour_scores(own, books(spark, d))


@query("needs_tropes", f"{WITH} SELECT id FROM books WHERE id % 4 <> 0 AND id % 2 = 1")
def needs_tropes(spark, d):
    b = books(spark, d).select("id", F.when(F.col("id") % 4 == 0, "nonfiction").otherwise("fiction").alias("book_class"), F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, ("a", "b", "c")))).otherwise(F.array(*map(F.lit, ("a", "b", "zz")))).alias("tropes"))
    return metadata.needs_tropes(b, spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")).select("id")


# --- recommendations served, lists and sinks ----------------------------------------------------------------------


@query("served_fresh", """WITH l AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
  SELECT e.user_id, count(*) AS n FROM events e JOIN l ON l.user_id = e.user_id AND e.ts = l.newest, n WHERE floor(epoch(n.now)) - floor(epoch(l.newest)) < 86400 GROUP BY e.user_id""")
def served_fresh(spark, d):
    """The newest served list of each user, where it isn't older than a day at the last event's time."""
    e = table(spark, d, "events")
    log = recommend.served(e.select("user_id", F.col("event_id").alias("book_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"), F.lit("r").alias("reason"), "ts"), F.col("ts"), "all", ["b", "a"])
    now = e.agg(F.max("ts").alias("now"))
    own = log.crossJoin(F.broadcast(now))
    return recommend.fresh(own, F.col("now"), "all", ["a", "b"], 86400).groupBy("user_id").agg(F.count("*").alias("n"))


@query("work_list", "SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS first FROM customer ORDER BY first DESC, id LIMIT 50")
def work_list(spark, d):
    """A bounded list: rows of preferred segments first, then by id."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("first"))
    return c.orderBy(F.desc("first"), "id").limit(50)


@query("resumed_run", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0")
def resumed_run(spark, d):
    """What a run still has to do: not what is done, and not what failed for good."""
    o = table(spark, d, "orders")
    done = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "done").otherwise("miss").alias("status"))
    return imports_remaining(o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")), done)


def imports_remaining(todo, done):
    return todo.join(done.filter(F.col("status").isin("done", "miss")).select("id"), "id", "left_anti")


@query("noise_filter", f"{WITH}, t AS (SELECT unnest(tags) AS tag FROM books) SELECT tag, count(*) AS n FROM t GROUP BY tag HAVING count(*) >= 3")
def noise_filter(spark, d):
    return books(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).filter("n >= 3")


@query("new_by_id_or_key", "SELECT p_partkey AS id FROM part a WHERE p_partkey % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 4 = 0 AND lower(b.p_name) = lower(a.p_name) AND lower(b.p_brand) = lower(a.p_brand))")
def new_by_id_or_key(spark, d):
    from marginalia.operators.upkeep import new_entries

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("t"), F.lower("p_brand").alias("a"))
    have = p.filter("id % 4 = 0")
    return new_entries(new_entries(p, have, ["id"]), have, ["t", "a"]).select("id")


@query("class_of_books", f"{WITH} SELECT id, CASE WHEN id % 3 = 0 THEN 'fiction' END AS book_class FROM books WHERE id % 5 <> 0")
def class_of_books(spark, d):
    """Books with their state's class, and only those that no metadata source covers."""
    b = books(spark, d).select("id")
    states = b.filter("id % 3 = 0").select("id", F.lit("fiction").alias("book_class"))
    covered = b.filter("id % 5 = 0").select("id", F.lit("wikipedia").alias("source")).filter("source IN ('ol_dump', 'wikipedia')").select("id")
    return b.join(covered, "id", "left_anti").join(states, "id", "left")


def _scratch(spark) -> str:
    """A folder for a query's files: the shared one, or in tests one of this machine."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='marginalia-')).rstrip('/')}/sinks/{uuid.uuid4().hex}"


_PARTS = "SELECT p_partkey AS id, p_name AS title, p_brand AS author FROM part"


def _rows(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))


@query("sink_append", _PARTS)
def sink_append(spark, d):
    path, rows = _scratch(spark), _rows(spark, d)
    sinks.append(rows.filter("id % 2 = 0"), path)
    sinks.append(rows.filter("id % 2 = 1"), path)
    return spark.read.parquet(path)


@query("sink_replace", _PARTS)
def sink_replace(spark, d):
    path, rows = _scratch(spark), _rows(spark, d)
    sinks.replace(rows.limit(1), path)
    sinks.replace(rows, path)
    return sinks.newest(spark, path)


@query("sink_review", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' \"q\", ' || p_brand AS title FROM part")
def sink_review(spark, d):
    from marginalia.sources.files import read_csv

    path = _scratch(spark)
    sinks.write_review(_rows(spark, d).select(F.col("id").cast("string").alias("id"), F.concat("title", F.lit(' "q", '), "author").alias("title")), path)
    return read_csv(spark, path)


@query("sink_json", _PARTS)
def sink_json(spark, d):
    path, rows = _scratch(spark), _rows(spark, d)
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("sink_audit", "SELECT p_partkey AS book_id, p_name AS before, upper(p_name) AS after FROM part")
def sink_audit(spark, d):
    path = _scratch(spark)
    changes = table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("before"), F.upper("p_name").alias("after"))
    sinks.append_audit(changes.filter("book_id % 2 = 0"), path)
    sinks.append_audit(changes.filter("book_id % 2 = 1"), path)
    return spark.read.schema(changes.schema).json(path)


@query("sink_packed", _PARTS)
def sink_packed(spark, d):
    path = _scratch(spark)
    sinks.pack(_rows(spark, d), path)
    return spark.read.parquet(path)
