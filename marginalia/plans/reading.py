"""Queries over reading histories: profiles, recommendations, matching; each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import matching, profile, recommend
from marginalia.plans.catalogue import ratio_sql
from marginalia.plans.domain import BOOKS_SQL, CANON_SQL, JUNK_SQL, SPICE_SQL, USER_BOOKS_SQL, books, table, user_books
from marginalia.plans.register import query

WITH = f"WITH {BOOKS_SQL}, {USER_BOOKS_SQL}"

_READS = """reads AS (SELECT user_id, book_id, user_rating, match_status, date_read,
  CASE WHEN coalesce(user_rating, 0) = 0 THEN 0.5 ELSE CASE trunc(user_rating) WHEN 5 THEN 2.0 WHEN 4 THEN 1.0 WHEN 2 THEN -1.0 WHEN 1 THEN -2.0 ELSE 0.0 END END * CASE WHEN match_status = 'ambiguous' THEN 0.5 ELSE 1.0 END AS w
  FROM user_books WHERE shelf = 'read')"""
_TAGS = f"""raw_tags AS (SELECT id, unnest(tags) AS t FROM books), book_tags AS (SELECT DISTINCT id, {CANON_SQL.format("t")} AS tag FROM raw_tags),
  clean_tags AS (SELECT DISTINCT id, {CANON_SQL.format("t")} AS tag FROM raw_tags WHERE NOT {JUNK_SQL.format("t")})"""
_FEATURES = f"""{_TAGS}, listed AS (SELECT id AS book_id, 'genre' AS kind, unnest(genres) AS feature FROM books UNION ALL SELECT id, 'trope', unnest(tropes) FROM books),
  features AS (SELECT * FROM listed UNION ALL SELECT id, 'tag', tag FROM clean_tags), catalogue AS (SELECT * FROM listed UNION ALL SELECT id, 'tag', tag FROM book_tags)"""
_WEIGHTS = "weights AS (SELECT user_id, kind, feature, CAST(sum(w) AS DOUBLE) AS weight, count(*) AS n FROM reads JOIN features USING (book_id) GROUP BY ALL)"
_SHOWN = "shown AS (SELECT * FROM books WHERE (len(tropes) > 0 OR len(tags) > 0) AND coalesce(status, '') NOT LIKE 'archived%')"
_IDF = "idf AS (SELECT feature, count(DISTINCT book_id) AS df, ln((SELECT count(*) FROM shown) / count(DISTINCT book_id)) AS idf FROM catalogue WHERE kind <> 'genre' AND book_id IN (SELECT id FROM shown) GROUP BY feature)"
_AS_OF = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"


def _as_of(spark, d):
    return table(spark, d, "orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("as_of"))


@query("taste_weights", f"{WITH}, {_READS}, {_FEATURES}, {_WEIGHTS} SELECT user_id, kind, feature, weight, n FROM weights")
def taste_weights(spark, d):
    return profile.taste_weights(user_books(spark, d), books(spark, d))


@query("taste_window_1y", f"""{WITH}, {_READS}, {_FEATURES}, recent AS (SELECT * FROM reads WHERE date_read >= {_AS_OF} - 365)
  SELECT user_id, kind, feature, CAST(sum(w) AS DOUBLE) AS weight, count(*) AS n FROM recent JOIN features USING (book_id) GROUP BY ALL""")
def taste_window_1y(spark, d):
    return profile.taste_weights(profile.in_window(user_books(spark, d), "1y", _as_of(spark, d)), books(spark, d))


@query("profile_top_features", f"""{WITH}, {_READS}, {_FEATURES}, {_WEIGHTS},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY weight DESC, feature) AS rank FROM weights WHERE weight > 0 AND NOT {JUNK_SQL.format("feature")})
  SELECT user_id, kind, feature, weight, n, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= CASE kind WHEN 'tag' THEN 15 ELSE 10 END""")
def profile_top_features(spark, d):
    return profile.top_features(profile.taste_weights(user_books(spark, d), books(spark, d)))


@query("pref_histograms", f"""{WITH}, liked AS (SELECT user_id, pacing, {SPICE_SQL.format("spice_level")} AS spice, focus FROM user_books JOIN books ON id = book_id WHERE shelf = 'read' AND user_rating >= 4)
  SELECT user_id, preference, value, count(*) AS n FROM (SELECT user_id, 'pacing' AS preference, pacing AS value FROM liked UNION ALL SELECT user_id, 'spice', spice FROM liked UNION ALL SELECT user_id, 'focus', focus FROM liked)
  WHERE value IS NOT NULL GROUP BY ALL""")
def pref_histograms(spark, d):
    return profile.preference_histograms(user_books(spark, d), books(spark, d))


@query("profile_counts", f"""{WITH} SELECT user_id, count(*) AS total, count(user_rating) FILTER (user_rating <> 0) AS rated, count(book_id) FILTER (book_id IN (SELECT id FROM books)) AS matched,
  round(avg(user_rating) FILTER (user_rating <> 0), 6) AS avg_rating FROM user_books WHERE shelf = 'read' GROUP BY user_id""")
def profile_counts(spark, d):
    return profile.profile_counts(user_books(spark, d), books(spark, d))


@query("idf", f"{WITH}, {_SHOWN}, {_FEATURES}, {_IDF} SELECT feature, df, round(idf, 6) AS idf FROM idf")
def idf(spark, d):
    return profile.idf(books(spark, d)).withColumn("idf", F.round("idf", 6))


def _scored(days: int | None = None, chosen: str = "true") -> str:
    """SQL of every unread book's score, reasons and category, from the reads of so many days."""
    window = f"date_read >= {_AS_OF} - {days}" if days else "true"
    return f"""{WITH}, {_READS.replace("WHERE shelf = 'read'", f"WHERE shelf = 'read' AND {window}")}, {_SHOWN}, {_FEATURES}, {_WEIGHTS}, {_IDF},
  base AS (SELECT user_id, book_id, sum(weight * CASE kind WHEN 'genre' THEN 0.3 WHEN 'trope' THEN 0.3 * coalesce(idf, 1) ELSE 0.4 * coalesce(idf, 1) END) AS base
           FROM catalogue JOIN weights USING (kind, feature) LEFT JOIN idf USING (feature) GROUP BY ALL),
  liked AS (SELECT user_id, pacing, {SPICE_SQL.format("spice_level")} AS spice, focus FROM reads JOIN books ON id = book_id WHERE user_rating >= 4),
  total AS (SELECT user_id, greatest(count(pacing), 1) AS total FROM liked GROUP BY user_id),
  hp AS (SELECT user_id, pacing, count(*) AS n FROM liked GROUP BY ALL), hs AS (SELECT user_id, spice, count(*) AS n FROM liked GROUP BY ALL), hf AS (SELECT user_id, focus, count(*) AS n FROM liked GROUP BY ALL),
  readers AS (SELECT DISTINCT user_id FROM weights),
  scored AS (SELECT r.user_id, s.id AS book_id, CASE WHEN len(s.genres) > 0 THEN array_to_string(s.genres[1:2], ' · ') ELSE 'Other' END AS category,
     floor(round(coalesce(base, 0) + 1.5 * coalesce(hp.n, 0) / coalesce(total, 1) + coalesce(hs.n, 0) / coalesce(total, 1) + coalesce(hf.n, 0) / coalesce(total, 1), 6) * 100 + 0.5) / 100 AS score
     FROM readers r CROSS JOIN shown s LEFT JOIN base b ON b.user_id = r.user_id AND b.book_id = s.id LEFT JOIN total t ON t.user_id = r.user_id LEFT JOIN hp ON hp.user_id = r.user_id AND hp.pacing = s.pacing
     LEFT JOIN hs ON hs.user_id = r.user_id AND hs.spice = {SPICE_SQL.format("s.spice_level")} LEFT JOIN hf ON hf.user_id = r.user_id AND hf.focus = s.focus WHERE {chosen}),
  unread AS (SELECT * FROM scored a WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM user_books u WHERE u.user_id = a.user_id AND u.book_id = a.book_id)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY score DESC, book_id) AS place FROM unread),
  led AS (SELECT *, max(score) OVER c AS best, max(CASE WHEN place = 1 THEN book_id END) OVER c AS lead FROM placed WHERE place <= 3 WINDOW c AS (PARTITION BY user_id, category)),
  final AS (SELECT * FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY best DESC, lead, place) AS INT) AS rank, book_id, category, score FROM led) WHERE rank <= 15),
  shared AS (SELECT f.user_id, f.book_id, c.feature, c.kind = 'tag' AND c.feature IN ('dark', 'emotional', 'tense', 'mysterious', 'adventurous', 'reflective', 'funny', 'sad', 'challenging', 'relaxing', 'inspiring', 'hopeful', 'lighthearted') AS mood,
     c.kind = 'tag' AS tag, round(w.weight * coalesce(i.idf, 1), 6) AS w, lower(regexp_replace(c.feature, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS name
     FROM final f JOIN (SELECT DISTINCT * FROM catalogue WHERE kind <> 'genre') c USING (book_id) JOIN weights w ON w.user_id = f.user_id AND w.kind = c.kind AND w.feature = c.feature AND w.weight > 0 LEFT JOIN idf i ON i.feature = c.feature WHERE NOT {JUNK_SQL.format("c.feature")}),
  one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, book_id, regexp_replace({CANON_SQL.format("name")}, '[^a-z0-9]', '', 'g') ORDER BY mood, w DESC, tag, feature) AS nth FROM shared) WHERE nth = 1),
  lists AS (SELECT user_id, book_id, list(name ORDER BY mood, w DESC, tag, feature) AS names FROM one GROUP BY ALL)
  SELECT f.user_id, f.rank, f.book_id, f.category, f.score, CASE WHEN names IS NULL THEN 'Strong ' || coalesce(b.genres[1], 'genre') || ' match' ELSE 'Shares ' || array_to_string(names[1:3], ', ') || ' with your top-rated reads' END AS reason,
     coalesce(array_to_string(names[1:4], '|'), '') AS chips FROM final f JOIN books b ON b.id = f.book_id LEFT JOIN lists l ON l.user_id = f.user_id AND l.book_id = f.book_id"""


def _shown_columns(df):
    return df.select("user_id", "rank", "book_id", "category", "score", "reason", F.array_join("chips", "|").alias("chips"))


@query("recommend_topk", _scored())
def recommend_topk(spark, d):
    return _shown_columns(recommend.recommend(user_books(spark, d), books(spark, d)))


@query("recommend_filtered_1y", _scored(365, "list_has_any(list_concat(s.tropes, list_transform(s.tags, lambda t: " + CANON_SQL.format("t") + ")), ['slow burn', 'economy', 'size-3'])"))
def recommend_filtered_1y(spark, d):
    """Taste of the last year; only books with one of three selected tags; books read before that still count as had."""
    reads = user_books(spark, d)
    return _shown_columns(recommend.recommend(reads, books(spark, d), profile.in_window(reads, "1y", _as_of(spark, d)), ["slow burn", "economy", "size-3"]))


@query("exclude_read_anti", f"{WITH}, heavy AS (SELECT user_id FROM user_books GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1) SELECT id FROM books WHERE id NOT IN (SELECT book_id FROM user_books WHERE book_id IS NOT NULL AND user_id IN (FROM heavy))")
def exclude_read_anti(spark, d):
    """Books that the heaviest reader hasn't had."""
    reads = user_books(spark, d)
    heavy = reads.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(1).select("user_id")
    had = reads.join(F.broadcast(heavy), "user_id", "left_semi").filter("book_id IS NOT NULL").select(F.col("book_id").alias("id"))
    return books(spark, d).select("id").join(had, "id", "left_anti")


@query("matched_books", f"{WITH} SELECT user_id, book_id, title, author, user_rating, date_read FROM user_books JOIN books ON id = book_id WHERE match_status = 'matched' AND shelf = 'read'")
def matched_books(spark, d):
    b = books(spark, d).select(F.col("id").alias("book_id"), "title", "author")
    return profile.read_rows(user_books(spark, d)).filter("match_status = 'matched'").join(b, "book_id").select("user_id", "book_id", "title", "author", "user_rating", "date_read")


@query("shelf_totals", f"{WITH} SELECT shelf, count(*) AS n, count(DISTINCT user_id) AS users FROM user_books GROUP BY shelf")
def shelf_totals(spark, d):
    return user_books(spark, d).groupBy("shelf").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("heaviest_user", f"{WITH} SELECT user_id, count(*) AS n FROM user_books GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1")
def heaviest_user(spark, d):
    return user_books(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(1)


@query("match_filter_any", f"{WITH}, {_SHOWN} SELECT id, title FROM shown WHERE list_has_any(list_concat(tropes, tags), ['size-3', 'economy'])")
def match_filter_any(spark, d):
    return profile.recommendable(books(spark, d)).filter(F.arrays_overlap(F.array_union("tropes", "tags"), F.array(F.lit("size-3"), F.lit("economy")))).select("id", "title")


@query("isbn_match", """WITH b AS (SELECT p_partkey AS id, lpad(CAST(p_partkey % 1500 AS VARCHAR), 13, '9') AS isbn FROM part),
  k AS (SELECT isbn, min(id) AS id FROM b GROUP BY isbn), r AS (SELECT c_custkey AS row_id, lpad(CAST(c_custkey * 2 AS VARCHAR), 13, '9') AS isbn13 FROM customer)
  SELECT row_id, id AS book_id FROM r LEFT JOIN k ON isbn = isbn13""")
def isbn_match(spark, d):
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lpad((F.col("p_partkey") % 1500).cast("string"), 13, "9").alias("isbn"))
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.lpad((F.col("c_custkey") * 2).cast("string"), 13, "9").alias("isbn13"), F.lit("").alias("isbn10"))
    return matching.key_match(r, b, ("isbn13", "isbn10")).select("row_id", "book_id")


@query("pending_upsert", f"""{WITH} SELECT user_id, raw_title, raw_author, count(*) AS seen_count, min(date_read) AS first_seen
  FROM user_books WHERE match_status = 'unmatched' GROUP BY ALL""")
def pending_upsert(spark, d):
    return matching.pending(user_books(spark, d))


@query("embedding_top1", """WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(array_cosine_similarity(a.e, b.e), 6) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0)
  SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def embedding_top1(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return matching.embedding_nearest(v.filter("id % 100 = 0"), v, 3)


@query("fuzzy_match_tiers", f"""WITH n AS (SELECT p_partkey AS id, p_name AS title, p_name[1:length(p_name) - 1] AS typed FROM part), s AS (SELECT DISTINCT typed, title, array_to_string(list_sort(string_split(typed, ' ')), ' ') AS a, array_to_string(list_sort(string_split(title, ' ')), ' ') AS b FROM (SELECT DISTINCT typed FROM n), (SELECT DISTINCT title FROM n)),
  r AS (SELECT typed, title, {ratio_sql("a", "b")} AS ts FROM s), f AS (SELECT title, min(id) AS id FROM n GROUP BY title),
  best AS (SELECT typed, f.id, ts, row_number() OVER (PARTITION BY typed ORDER BY round(0.7 * ts + 30, 6) DESC, f.id) AS k FROM r JOIN f USING (title) WHERE ts >= 50)
  SELECT n.id AS row_id, CASE WHEN 0.7 * ts + 30 >= 65 THEN b.id END AS book_id, CAST(round(0.7 * ts + 30, 6) AS DOUBLE) AS score, CASE WHEN ts >= 88 THEN 'matched' WHEN 0.7 * ts + 30 >= 65 THEN 'ambiguous' ELSE 'unmatched' END AS match_status FROM n LEFT JOIN best b ON b.typed = n.typed AND k = 1""")
def fuzzy_match_tiers(spark, d):
    """Typed titles are the parts' names without their last letter. Brands are alike but for digits, which don't count."""
    b = books(spark, d).select("id", "title", "author")
    rows = b.select(F.col("id").alias("row_id"), F.expr("substring(title, 1, length(title) - 1)").alias("title"), "author")
    return matching.fuzzy_match(rows, b)


@query("feedback_counts", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def feedback_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("feedback_owned", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'view')")
def feedback_owned(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'click'").select("event_id", "user_id").join(e.filter("event_type = 'view'").select("user_id").distinct(), "user_id", "left_semi").select("event_id", "user_id")


@query("props_json", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def props_json(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
