"""Queries over the catalogue: text functions, vocabulary, classifiers, packs, staging, metadata; each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import similarity, text
from marginalia.operators import classify, lexical, metadata, staging, taxonomy
from marginalia.plans.domain import BOOKS_SQL, CANON_SQL, JUNK_SQL, SPICE_SQL, books, table
from marginalia.plans.register import query
from marginalia.sources.files import page_records

WITH = f"WITH {BOOKS_SQL}"


def _parts(spark, d, expr):
    return table(spark, d, "part").select("p_partkey", expr.alias("value"))


# A title with everything that normalising takes off.
_TITLE = "'The ' || p_name || ' (' || p_brand || ' #2): A Novel of ' || p_type"


@query("normalize_title", f"""SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(replace(string_split(regexp_replace(trim(lower({_TITLE})), '\\(.*?\\)', ' ', 'g'), ':')[1], ' a novel', ''), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^the ', '') AS value FROM part""")
def normalize_title(spark, d):
    return _parts(spark, d, text.normalize_title(F.expr(_TITLE)))


@query("normalize_author", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || ', J. R.'), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS value FROM part")
def normalize_author(spark, d):
    return _parts(spark, d, text.normalize_author(F.concat("p_brand", F.lit(", J. R."))))


_ISBN = "CASE p_partkey % 4 WHEN 0 THEN '=\"' || lpad(CAST(p_partkey AS VARCHAR), 13, '9') || '\"' WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 9, '0') || 'x' WHEN 2 THEN '' ELSE '12-34' END"


@query("normalize_isbn", f"WITH r AS (SELECT p_partkey, upper(regexp_replace({_ISBN}, '[^0-9Xx]', '', 'g')) AS s FROM part) SELECT p_partkey, CASE WHEN length(s) IN (10, 13) THEN s ELSE '' END AS value FROM r")
def normalize_isbn(spark, d):
    return _parts(spark, d, text.normalize_isbn(F.expr(_ISBN.replace("VARCHAR", "STRING"))))


@query("parse_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS value FROM orders""")
def parse_date(spark, d):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    forms = F.when(k == 0, F.date_format(day, "yyyy/M/d")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.date_format(day, "MM/dd/yyyy")).when(k == 3, F.date_format(day, "yyyy/MM/dd")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", text.parse_date(forms).alias("value"))


@query("parse_rating", "SELECT l_orderkey, l_linenumber, nullif(TRY_CAST(CASE WHEN l_linenumber = 1 THEN 'abc' WHEN l_linenumber = 2 THEN '0' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS DOUBLE), 0) AS value FROM lineitem")
def parse_rating(spark, d):
    raw = F.when(F.col("l_linenumber") == 1, "abc").when(F.col("l_linenumber") == 2, "0").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.parse_rating(raw).alias("value"))


_SPELT = "CASE p_partkey % 5 WHEN 0 THEN 'Slow-Burn  Romance' WHEN 1 THEN 'grumpy / sunshine' WHEN 2 THEN 'Sapphic_romance' ELSE replace(p_name, ' ', '-') || '_' || p_size || '-39' END"


@query("canonical_tag", f"SELECT p_partkey, {CANON_SQL.format(_SPELT)} AS value FROM part")
def canonical_tag(spark, d):
    return _parts(spark, d, text.canonical_tag(F.expr(_SPELT)))


@query("humanize", "SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', 'X'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS value FROM part")
def humanize(spark, d):
    return _parts(spark, d, text.humanize(F.replace("p_name", F.lit(" "), F.lit("X"))))


@query("slugify", "SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(p_name || ' & ' || p_type || '!'), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS value FROM part")
def slugify(spark, d):
    return _parts(spark, d, text.slugify(F.concat_ws(" & ", "p_name", F.concat(F.lower("p_type"), F.lit("!")))))


@query("normalize_raw", "SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_name || '_' || lower(p_brand)), '_', ' '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS value FROM part")
def normalize_raw(spark, d):
    return _parts(spark, d, text.normalize_raw(F.concat_ws("_", "p_name", F.lower("p_brand"))))


_HEAT = "CASE p_size % 9 WHEN 0 THEN 'None' WHEN 1 THEN 'Mild heat, later HOT' WHEN 2 THEN 'low to medium' WHEN 3 THEN 'Fade to black' WHEN 4 THEN '' WHEN 5 THEN 'Closed door' WHEN 6 THEN 'no spice' WHEN 7 THEN 'Average' END"


@query("canonical_spice", f"SELECT p_partkey, {SPICE_SQL.format('(' + _HEAT + ')')} AS value FROM part")
def canonical_spice(spark, d):
    return _parts(spark, d, text.canonical_spice(F.expr(_HEAT)))


@query("first_year", "SELECT o_orderkey, CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS value FROM orders")
def first_year(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.first_year(F.concat(F.lit("printed 12th "), F.date_format("o_orderdate", "MMM yyyy"))).alias("value"))


@query("format_author", "SELECT p_partkey, string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] AS value FROM part")
def format_author(spark, d):
    return _parts(spark, d, text.format_author(F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(", 1819-1891"))))


@query("junk_filter", f"{WITH}, t AS (SELECT id, unnest(list_concat(tags, ['TBR 2020', 'audiobook', 'Audiobook club', 'to-read'])) AS tag FROM books) SELECT id, tag FROM t WHERE NOT {JUNK_SQL.format('tag')}")
def junk_filter(spark, d):
    t = books(spark, d).select("id", F.explode(F.concat("tags", F.array(*map(F.lit, ("TBR 2020", "audiobook", "Audiobook club", "to-read"))))).alias("tag"))
    return t.filter(~text.is_junk_tag("tag"))


@query("recommendable", f"{WITH} SELECT id FROM books WHERE coalesce(status, '') NOT LIKE 'archived%'")
def recommendable(spark, d):
    from marginalia.operators.profile import recommendable as shown

    return shown(books(spark, d)).select("id")


@query("term_freq_genre_bucket", f"""{WITH}, t AS (SELECT unnest(list_concat(tropes, tags)) AS term, genres[1] AS genre FROM books), g AS (SELECT term, genre, count(*) AS n FROM t GROUP BY ALL),
  s AS (SELECT term, sum(n) AS n, max({{'n': n, 'genre': genre}}) AS top, count(*) AS genres FROM g GROUP BY term) SELECT term, CAST(n AS BIGINT) AS n, CASE WHEN top.n * 2 >= n THEN top.genre ELSE 'cross-genre' END AS bucket, genres FROM s""")
def term_freq_genre_bucket(spark, d):
    terms = books(spark, d).select(F.explode(F.concat("tropes", "tags")).alias("term"), F.get("genres", F.lit(0)).alias("genre"))
    return taxonomy.term_stats(terms)


def _vocabulary(spark, d):
    """Every second trope and all lower-case types are known."""
    b = books(spark, d)
    tropes = b.select(F.get("tropes", F.lit(0)).alias("slug")).distinct().filter(F.length("slug") % 2 == 0).withColumn("kind", F.lit("trope"))
    return tropes.unionByName(b.select(F.lower(F.get("genres", F.lit(0))).alias("slug")).distinct().withColumn("kind", F.lit("tag"))).withColumn("alias", text.normalize_raw("slug"))


_VOCAB = """vocabulary AS (SELECT DISTINCT tropes[1] AS slug, 'trope' AS kind FROM books WHERE length(tropes[1]) % 2 = 0 UNION ALL SELECT DISTINCT lower(genres[1]), 'tag' FROM books)"""


@query("clean_route_terms", f"""{WITH}, {_VOCAB}, t AS (SELECT id, unnest(list_concat(tropes, tags)) AS term, generate_subscripts(list_concat(tropes, tags), 1) AS pos FROM books),
  k AS (SELECT id, min(pos) AS pos, term, slug, kind FROM t LEFT JOIN vocabulary ON slug = term GROUP BY ALL)
  SELECT id AS book_id, coalesce(string_agg(slug, '|' ORDER BY pos) FILTER (kind = 'trope'), '') AS tropes, coalesce(string_agg(slug, '|' ORDER BY pos) FILTER (kind = 'tag'), '') AS tags, coalesce(string_agg(term, '|' ORDER BY pos) FILTER (slug IS NULL), '') AS unknown FROM k GROUP BY id""")
def clean_route_terms(spark, d):
    terms = books(spark, d).select(F.col("id").alias("book_id"), F.posexplode(F.concat("tropes", "tags")).alias("pos", "term"))
    out = taxonomy.route_terms(terms, _vocabulary(spark, d))
    return out.select("book_id", *(F.array_join(c, "|").alias(c) for c in ("tropes", "tags", "unknown")))


@query("canon_apply_arrays", f"""{WITH}, t AS (SELECT id, unnest(tags) AS term, generate_subscripts(tags, 1) AS pos FROM books),
  k AS (SELECT id, min(pos) AS pos, CASE WHEN term IN ('size-1', 'size-2') THEN 'small' ELSE term END AS tag FROM t WHERE term <> 'size-9' GROUP BY ALL)
  SELECT b.id AS book_id, coalesce(string_agg(tag, '|' ORDER BY pos), '') AS tags FROM books b LEFT JOIN k ON k.id = b.id GROUP BY b.id""")
def canon_apply_arrays(spark, d):
    decisions = spark.createDataFrame([("size-1", "merge", "small"), ("size-2", "merge", "small"), ("size-9", "drop", None), ("size-3", "activate", None)], "term string, decision string, target string")
    out = taxonomy.canonicalise(books(spark, d).select(F.col("id").alias("book_id"), "tags"), decisions)
    return out.select("book_id", F.array_join("tags", "|").alias("tags"))


@query("merge_chain", """WITH RECURSIVE m AS (SELECT n_nationkey AS slug, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey ELSE n_nationkey - 1 END AS target FROM nation),
  c AS (SELECT slug, target, 1 AS steps FROM m WHERE slug <> target UNION ALL SELECT c.slug, m.target, steps + 1 FROM c JOIN m ON m.slug = c.target WHERE m.slug <> m.target AND steps < 5)
  SELECT slug, target FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY steps DESC) AS r FROM c) WHERE r = 1""")
def merge_chain(spark, d):
    k = F.col("n_nationkey")
    return taxonomy.resolve_chains(table(spark, d, "nation").select(k.alias("slug"), F.when(k % 5 == 0, k).otherwise(k - 1).alias("into")))


@query("taxonomy_upsert", """SELECT coalesce(n.id, c.id) AS id, coalesce(n.name, c.name) AS name FROM (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 15) c
  FULL JOIN (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation WHERE n_nationkey >= 10) n ON n.id = c.id""")
def taxonomy_upsert(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return taxonomy.upsert(n.filter("id < 15"), n.filter("id >= 10").withColumn("name", F.lower("name")), "id")


@query("taxonomy_census", f"{WITH}, {_VOCAB} SELECT kind, count(*) AS n FROM vocabulary GROUP BY kind")
def taxonomy_census(spark, d):
    return _vocabulary(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("usage_with_zero", f"{WITH}, {_VOCAB}, u AS (SELECT unnest(tropes) AS slug FROM books) SELECT v.slug, count(u.slug) AS n FROM vocabulary v LEFT JOIN u ON u.slug = v.slug GROUP BY v.slug")
def usage_with_zero(spark, d):
    used = books(spark, d).select(F.explode("tropes").alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))
    return _vocabulary(spark, d).select("slug").join(used, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n"))


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence by its table, a row for each character of a."""
    rows = f"list_prepend([0 for z in range(length({b}) + 1)], list_transform(string_split({a}, ''), lambda c: [ord(c)]))"
    row = f"list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN ord({b}[j[1]]) = ch[1] THEN prev[j[1]] + 1 ELSE greatest(acc[-1], prev[j[1] + 1]) END))"
    return f"list_reduce({rows}, lambda prev, ch: {row})[-1]"


def ratio_sql(a: str, b: str) -> str:
    return f"200.0 * {lcs_sql(a, b)} / (length({a}) + length({b}))"


_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"


@query("nearest_terms_top3", f"""WITH t AS (SELECT DISTINCT p_name || 's' AS term, {_SORTED.format("p_name || 's'")} AS a FROM part), v AS (SELECT DISTINCT p_name AS display, {_SORTED.format("p_name")} AS b FROM part),
  s AS (SELECT term, display, round({ratio_sql("a", "b")}, 6) AS score FROM t, v), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, display) AS rank FROM s WHERE score >= 50)
  SELECT term, CAST(rank AS INT) AS rank, display, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 3""")
def nearest_terms_top3(spark, d):
    b = books(spark, d)
    return taxonomy.nearest_terms(b.select(F.concat("title", F.lit("s")).alias("term")), b.select(F.col("title").alias("display")), 3, 50.0)


@query("similarity_length_bound", f"SELECT a.p_partkey AS id, CAST(round({ratio_sql('a.s', 'b.s')}, 6) AS DOUBLE) AS score, {ratio_sql('a.s', 'b.s')} <= 200.0 * least(length(a.s), length(b.s)) / (length(a.s) + length(b.s)) AS bounded FROM (SELECT *, {_SORTED.format('p_name')} AS s FROM part) a JOIN (SELECT *, {_SORTED.format('p_name')} AS s FROM part) b ON b.p_partkey = a.p_partkey + 1")
def similarity_length_bound(spark, d):
    """The similarity of each title with the next one's, and that it keeps below its bound."""
    b = books(spark, d).select("id", "title")
    pairs = b.join(b.select((F.col("id") - 1).alias("id"), F.col("title").alias("other")), "id").withColumn("score", F.round(similarity.token_sort_ratio(F.col("title"), F.col("other")), 6))
    return pairs.select("id", "score", (F.col("score") <= similarity.length_bound(F.col("title"), F.col("other")) + 1e-6).alias("bounded"))


@query("triage_class", f"""{WITH} SELECT id, CASE WHEN genres[1] = 'PROMO' THEN 'childrens' WHEN genres[1] = 'SMALL' THEN 'poetry_drama' WHEN genres[1] IN ('ECONOMY') THEN 'nonfiction' WHEN genres[1] IN ('STANDARD', 'MEDIUM') THEN 'fiction' ELSE 'ambiguous' END AS book_class FROM books""")
def triage_class(spark, d):
    return books(spark, d).select("id", classify.triage(F.col("genres"), ["PROMO"], ["SMALL"], ["ECONOMY"], ["STANDARD", "MEDIUM"]).alias("book_class"))


@query("tag_evidence_genres", f"""{WITH} SELECT id, array_to_string(list_filter([CASE WHEN len(list_filter(tags, lambda t: regexp_matches(t, '^size-[0-4]$'))) > 0 THEN 'Short' END, CASE WHEN len(list_filter(tags, lambda t: regexp_matches(t, 'eco|promo'))) > 0 THEN 'Budget' END], lambda g: g IS NOT NULL), '|') AS genres FROM books""")
def tag_evidence_genres(spark, d):
    return books(spark, d).select("id", F.array_join(classify.evidence_genre(F.col("tags"), [("Short", "^size-[0-4]$"), ("Budget", "eco|promo")]), "|").alias("genres"))


_ONE, _TWO = ("the", "and"), ("that", "with", "from")


@query("class_score_regex", """WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(the|and)\\b')) - len(regexp_extract_all(text, '(?i)\\b(that|with|from)\\b')) AS d FROM documents)
  SELECT doc_id, CASE WHEN d >= 2 THEN 'plain' WHEN d <= -2 THEN 'bound' ELSE 'unsure' END AS book_class FROM s""")
def class_score_regex(spark, d):
    return table(spark, d, "documents").select("doc_id", classify.margin_class(F.col("text"), _ONE, _TWO, ("plain", "bound")).alias("book_class"))


_STOPPED = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)}))) AS n_{lang}" for lang, words in (("en", ("the", "and", "of", "to")), ("fr", ("le", "la", "et", "les", "des")), ("de", ("der", "die", "und", "das")), ("es", ("el", "la", "de", "que", "los"))))


@query("lang_archive", f"""WITH t AS (SELECT doc_id, lang, text, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents), n AS (SELECT *, {_STOPPED}, greatest(n_en, n_fr, n_de, n_es) AS best FROM t),
  l AS (SELECT doc_id, lang, CASE WHEN length(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g')) < 0.5 * length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) THEN 'non-latin' WHEN coalesce(length(text), 0) < 20 THEN 'short' WHEN best <= 0 THEN 'unknown' WHEN n_en = best THEN 'en' WHEN n_fr = best THEN 'fr' WHEN n_de = best THEN 'de' WHEN n_es = best THEN 'es' END AS language FROM n)
  SELECT *, CASE WHEN language = 'non-latin' THEN 'archive_script' WHEN language IN ('fr', 'de', 'es') THEN 'archive_language' WHEN language = 'unknown' THEN 'review' ELSE 'keep' END AS decision FROM l""")
def lang_archive(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", classify.stop_word_language(F.col("text")).alias("language"))
    return docs.withColumn("decision", classify.archive_decision(F.col("language")))


@query("lang_archive_cap", "SELECT count(*) AS n, count(*) FILTER (lang <> 'en') AS archived, count(*) FILTER (lang <> 'en') > count(*) * 0.3 AS abort FROM documents")
def lang_archive_cap(spark, d):
    return classify.over_cap(table(spark, d, "documents").select(classify.archive_decision(F.col("lang")).alias("decision")))


@query("doubt_score", f"""{WITH} SELECT id, (CASE WHEN pacing IS NULL THEN 3 ELSE 0 END) + (CASE WHEN status IS NOT NULL THEN 5 ELSE 0 END) + (CASE WHEN spice_level = 'Explicit' THEN 2 ELSE 0 END) AS score,
  concat_ws('|', CASE WHEN pacing IS NULL THEN 'no pacing' END, CASE WHEN status IS NOT NULL THEN 'archived' END, CASE WHEN spice_level = 'Explicit' THEN 'explicit' END) AS reasons FROM books""")
def doubt_score(spark, d):
    found = classify.doubt([(3, "no pacing", F.col("pacing").isNull()), (5, "archived", F.col("status").isNotNull()), (2, "explicit", F.col("spice_level") == "Explicit")])
    return books(spark, d).select("id", found.alias("r")).select("id", "r.score", F.array_join("r.reasons", "|").alias("reasons"))


PACK = [lexical.Pattern("relative", "A", r"\bthat\b"), lexical.Pattern("company", "A", r"\bwith (the|an?)\b"), lexical.Pattern("pointing", "B", r"\bthis\b"), lexical.Pattern("origin", "B", r"\bfrom\b")]
_PACK = """m AS (SELECT doc_id AS id, p.ord, p.slug, p.tier, regexp_extract(text, '(?i)' || p.regex, 0) AS phrase FROM documents,
  (VALUES (0, 'relative', 'A', '\\bthat\\b'), (1, 'company', 'A', '\\bwith (the|an?)\\b'), (2, 'pointing', 'B', '\\bthis\\b'), (3, 'origin', 'B', '\\bfrom\\b')) p(ord, slug, tier, regex)
  WHERE regexp_matches(text, '(?i)' || p.regex))"""


def _pack_rows(spark, d):
    return lexical.match_rows(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), PACK, 8, context=False)


@query("lexical_pack", f"WITH {_PACK} SELECT id, CAST(ord AS INT) AS ord, slug, tier, phrase FROM m")
def lexical_pack(spark, d):
    return _pack_rows(spark, d)


@query("lexical_tier_mix", f"WITH {_PACK}, t AS (SELECT id, count(*) AS n, array_to_string(list_sort(list_distinct(list(tier))), '+') AS tiers FROM m GROUP BY id) SELECT id, n, tiers, CASE WHEN tiers = 'A' THEN 'high' ELSE 'medium' END AS confidence FROM t")
def lexical_tier_mix(spark, d):
    return lexical.tier_mix(_pack_rows(spark, d))


@query("review_union", f"WITH {_PACK}, r AS (SELECT id, slug, tier FROM m UNION ALL SELECT id, slug, 'B' FROM m WHERE id % 2 = 0) SELECT id, slug, min(tier) AS tier FROM r GROUP BY ALL")
def review_union(spark, d):
    rows = _pack_rows(spark, d).select("id", "slug", "tier")
    return lexical.best_tier(rows.unionByName(rows.filter("id % 2 = 0").withColumn("tier", F.lit("B"))))


def _staged(spark, d):
    b = books(spark, d)
    results = b.filter("id % 3 = 0").select(
        "id", (F.col("id") % 2 == 0).alias("known"), F.lit("high").alias("confidence"), F.concat("tropes", F.array(F.lit("economy"))).alias("tropes"), F.array(F.lit("economy"), F.lit("never heard")).alias("tags"),
        F.lit("Fast").alias("pacing"), F.lit("Tame").alias("spice_level"), F.lit("Plot").alias("focus"),
    )
    return staging.ingest(results, _vocabulary(spark, d).select("slug", "kind"), b)


@query("ingest_validate", f"""{WITH}, {_VOCAB}, r AS (SELECT id, id % 2 = 0 AS known, tropes[1] AS t, tropes[1] IN (SELECT slug FROM vocabulary WHERE kind = 'trope') AS ok FROM books WHERE id % 3 = 0)
  SELECT id, known, CASE WHEN ok THEN t ELSE '' END AS tropes, 'economy' AS tags, CASE WHEN ok THEN 2 ELSE 3 END AS n_proposed FROM r""")
def ingest_validate(spark, d):
    return _staged(spark, d).select("id", "known", F.array_join("tropes", "|").alias("tropes"), F.array_join("tags", "|").alias("tags"), F.size("proposed").alias("n_proposed"))


@query("promote_union", f"""{WITH}, {_VOCAB} SELECT id, array_to_string(tropes, '|') AS tropes, array_to_string(CASE WHEN id % 3 = 0 AND NOT list_contains(tags, 'economy') THEN list_append(tags, 'economy') ELSE tags END, '|') AS tags, CASE WHEN id % 3 = 0 THEN coalesce(pacing, 'Fast') ELSE pacing END AS pacing FROM books""")
def promote_union(spark, d):
    return staging.promote(books(spark, d), _staged(spark, d)).select("id", F.array_join("tropes", "|").alias("tropes"), F.array_join("tags", "|").alias("tags"), "pacing")


@query("rollback_identity", f"{WITH} SELECT id, array_to_string(tropes, '|') AS tropes, array_to_string(tags, '|') AS tags, pacing, spice_level, focus FROM books")
def rollback_identity(spark, d):
    staged = _staged(spark, d)
    back = staging.rollback(staging.promote(books(spark, d), staged), staged)
    return back.select("id", F.array_join("tropes", "|").alias("tropes"), F.array_join("tags", "|").alias("tags"), "pacing", "spice_level", "focus")


@query("catalogue_sync", """WITH cur AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS author FROM part WHERE p_retailprice < 980),
  new AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS author FROM part)
  SELECT n.id, n.title, CASE WHEN c.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM new n LEFT JOIN cur c USING (id) WHERE c.id IS NULL OR n.title IS DISTINCT FROM c.title OR n.author IS DISTINCT FROM c.author""")
def catalogue_sync(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_brand", "p_size", "p_retailprice")
    cur = p.filter("p_retailprice < 980").select("id", "title", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("author"))
    new = p.select("id", "title", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("author"))
    return staging.changed(cur, new, "id", ["title", "author"]).select("id", "title", "action")


@query("genre_repair", f"{WITH} SELECT id, array_to_string(CASE WHEN id % 4 = 0 THEN list_prepend('Novel', genres) ELSE genres END, '|') AS genres FROM books")
def genre_repair(spark, d):
    b = books(spark, d)
    source = b.select("id", F.when(F.col("id") % 4 == 0, F.array(F.lit("Novel"))).otherwise(F.col("genres")).alias("genres"))
    return staging.repair_genres(b, source).select("id", F.array_join("genres", "|").alias("genres"))


@query("edition_rollup", """WITH e AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, lpad(CAST(l_suppkey AS VARCHAR), CASE WHEN l_linenumber % 2 = 0 THEN 13 ELSE 10 END, '0') AS isbn, CAST(year(CAST(l_shipdate AS DATE)) AS INT) AS y, CASE WHEN l_linenumber > 2 THEN CAST(l_quantity AS INT) END AS pages FROM lineitem)
  SELECT id, count(DISTINCT isbn) AS n_isbns, coalesce(min(isbn) FILTER (length(isbn) = 13), min(isbn)) AS isbn, min(y) AS year, min_by(pages, CASE WHEN pages IS NOT NULL THEN seq END) AS pages FROM e GROUP BY id""")
def edition_rollup(spark, d):
    """Lines of equal number count in the order of the table, as DuckDB's min_by takes them on one thread."""
    seq = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    e = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("id"), seq.alias("seq"), F.when(F.col("l_linenumber") % 2 == 0, F.lpad(F.col("l_suppkey").cast("string"), 13, "0")).otherwise(F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).alias("isbn"),
        F.date_format("l_shipdate", "MMMM yyyy").alias("date"), F.when(F.col("l_linenumber") > 2, F.rint("l_quantity").cast("int")).alias("pages"),
    )
    return metadata.edition_rollup(e).select("id", F.size("isbns").cast("long").alias("n_isbns"), "isbn", "year", "pages")


@query("dup_key_report", "SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS first_id FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def dup_key_report(spark, d):
    return metadata.shared_keys(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p")), "k", "p")


@query("metadata_by_source", "WITH m AS (SELECT doc_id // 10 AS id, source, min(n_chars) AS v FROM documents GROUP BY ALL) SELECT id, coalesce(max(v) FILTER (source = 'src2'), max(v) FILTER (source = 'src1'), max(v) FILTER (source = 'src3')) AS v FROM m GROUP BY id")
def metadata_by_source(spark, d):
    m = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("id"), "source").agg(F.min("n_chars").alias("v"))
    return metadata.by_source(m, ["src2", "src1", "src3"], "v")


@query("priority_tiers", """WITH c AS (SELECT c_custkey AS id, 1 AS tier, CAST(NULL AS BIGINT) AS r FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT c_custkey, 2, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 3, NULL FROM customer),
  b AS (SELECT id, min({'tier': tier, 'rank': coalesce(r, 1000000000)}) AS b FROM c GROUP BY id) SELECT id, b.tier AS tier, b.rank AS rank, CAST(row_number() OVER (PARTITION BY b.tier ORDER BY b.rank, id) AS INT) AS place FROM b""")
def priority_tiers(spark, d):
    c = table(spark, d, "customer")
    one = c.filter("c_acctbal > 8000").select(F.col("c_custkey").alias("id"), F.lit(1).alias("tier"), F.lit(None).cast("long").alias("rank"))
    two = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit(2).alias("tier"), F.col("c_nationkey").cast("long").alias("rank"))
    return metadata.priority_tiers(one.unionByName(two).unionByName(c.select(F.col("c_custkey").alias("id"), F.lit(3).alias("tier"), F.lit(None).cast("long").alias("rank"))))


@query("html_title_links", """SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')), '') AS title,
  nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), '') AS h1, CAST(len(regexp_extract_all(html, '(?i)<a\\s')) AS INT) AS n_links FROM pages""")
def html_title_links(spark, d):
    return page_records(table(spark, d, "pages")).drop("json_ld")


@query("stratified_sample", "SELECT doc_id, lang, CAST(rank AS INT) AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|7'), doc_id) AS rank FROM documents) WHERE rank <= 10")
def stratified_sample(spark, d):
    """Ten documents of each language, by a hash with seed 7."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|7"))), "doc_id"))
    return table(spark, d, "documents").select("doc_id", "lang", rank.alias("rank")).filter("rank <= 10")


@query("latin_share", "SELECT doc_id, round(coalesce(length(regexp_replace(t, '[^\\p{Latin}]', '', 'g')) / nullif(length(regexp_replace(t, '[^\\p{L}]', '', 'g')), 0), 1.0), 6) AS value FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'мир ' || left(text, 10) ELSE '12 - 3' END AS t FROM documents) WHERE t IS NOT NULL")
def latin_share(spark, d):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("мир "), F.expr("left(text, 10)"))).otherwise("12 - 3")
    return table(spark, d, "documents").select("doc_id", F.round(text.latin_share(t), 6).alias("value")).filter("value IS NOT NULL")


@query("array_union_ci", f"{WITH} SELECT id, array_to_string(list_append(tags, 'extra'), '|') AS tags FROM books")
def array_union_ci(spark, d):
    b = books(spark, d)
    return b.select("id", F.array_join(text.union_by_key(F.col("tags"), F.concat(F.transform("tags", F.upper), F.array(F.lit("extra"), F.lit("Extra ")))), "|").alias("tags"))
