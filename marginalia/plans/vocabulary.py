"""Queries of the vocabulary: blocklist to slugs, subjects, cleaning, reviews, rulings and re-filing."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions.text import normalize_raw
from marginalia.operators import classify, resolve, review
from marginalia.plans.cases import case_query, outcome_sql, spread, values
from marginalia.plans.domain import BOOKS_SQL, books, table
from marginalia.plans.register import query
from marginalia.sources.files import built_vocabulary

VOCABULARY = [("slow-burn", "slow burn", "active", "trope"), ("found-family", "found family", "active", "trope"), ("enemies-to-lovers", "enemies to lovers", "active", "trope"), ("court-intrigue", "Court Intrigue", "active", "tag"), ("old-term", "old term", "rejected", "tag"), ("hopeful", "hopeful", "active", "mood")]
ALIASES = [("slow burn", "slow-burn"), ("family found", "found-family"), ("hopeful", "hopeful")]


def vocabulary(spark):
    return spark.createDataFrame(VOCABULARY, "slug string, display string, status string, kind string")


def aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, slug string")


_RAW = [("Slow-Burn",), ("enemies to lover",), ("enemies to lover",), ("Enemies-To-Lover",), ("found families",), ("kindle",), ("zebra crossing",), ("reread",), ("court intrigues",), ("slow_burn",), ("enemies to lover",)]
_METHODS = [
    ("Slow-Burn", "alias", "slow-burn", 100.0), ("slow_burn", "alias", "slow-burn", 100.0), ("enemies to lover", "fuzzy", "enemies-to-lovers", 96.969697), ("Enemies-To-Lover", "alias", "enemies-to-lovers", 100.0), ("found families", "fuzzy_review", "found-family", 84.615385),
    ("kindle", "blocklist", None, None), ("zebra crossing", "proposed", "zebra-crossing", None), ("reread", "blocklist", None, None), ("court intrigues", "fuzzy_review", "court-intrigue", 82.758621),
]
_RAW_SQL = f"raw AS (SELECT r.raw, count(*) AS freq FROM part JOIN (VALUES {values([(i, *r) for i, r in enumerate(_RAW)])}) r(k, raw) ON p_partkey % {len(_RAW)} = k GROUP BY r.raw)"


@query("resolve_terms", f"WITH {_RAW_SQL} SELECT raw, freq, method, slug, score FROM raw JOIN (VALUES {values(_METHODS)}) m(raw, method, slug, score) USING (raw)")
def resolve_terms(spark, d):
    raw = spread(spark, d, _RAW, "raw string").groupBy("raw").agg(F.count("*").alias("freq"))
    return resolve.resolve(raw, vocabulary(spark), aliases(spark))


_COSINES = [("zebra crossing", "court-intrigue", 0.85), ("found families", "found-family", 0.79), ("court intrigues", "court-intrigue", 0.8)]
_EMBEDDED = [("zebra crossing", "embed_suggest", "court-intrigue", 0.85), ("found families", "proposed", "found-families", 0.79), ("court intrigues", "embed_suggest", "court-intrigue", 0.8)]


@query("resolve_terms_embedded", f"WITH {_RAW_SQL} SELECT raw, freq, method, slug, score FROM raw JOIN (VALUES {values([m for m in _METHODS if m[0] not in dict((e[0], 1) for e in _EMBEDDED)] + _EMBEDDED)}) m(raw, method, slug, score) USING (raw)")
def resolve_terms_embedded(spark, d):
    raw = spread(spark, d, _RAW, "raw string").groupBy("raw").agg(F.count("*").alias("freq"))
    return resolve.resolve(raw, vocabulary(spark), aliases(spark), spark.createDataFrame(_COSINES, "norm string, slug string, score double"))


@query("raw_vocabulary", f"WITH {BOOKS_SQL}, t AS (SELECT trim(unnest(list_concat(tropes, tags))) AS raw FROM books) SELECT raw, count(*) AS freq FROM t WHERE raw <> '' GROUP BY raw")
def raw_vocabulary(spark, d):
    return resolve.raw_vocabulary(books(spark, d))


@query("subject_slugs", outcome_sql("slugs, resolved", [("slow-burn|found-family|enemies-to-lovers", True), ("found-family", False), ("", False), ("enemies-to-lovers", False), ("", False)]))
def subject_slugs(spark, d):
    rows = [(["Slow burn -- family found", "Enemies to lover—Slow Burn"],), (["Family found.", "kindle", "xy"],), ([],), (["enemies, to lovers"],), (None,)]
    out = resolve.subject_slugs(spread(spark, d, rows, "subjects array<string>"), vocabulary(spark), aliases(spark))
    return out.select("id", F.array_join("slugs", "|").alias("slugs"), "resolved")


_CLEAN = [(["slowBurn", "Fast-Paced"], ["found-family", "kindle"], None), (["Found family"], ["Family Found", "slow paced"], "Fast"), ([], ["New Thing", "new thing", "hopeful", ""], ""), (None, None, "Slow"), (["dnf"], ["medium paced", "fast paced"], None)]


@query("clean_terms", outcome_sql("tropes, tags, pacing", [("slow-burn|found-family", "", "Fast"), ("found-family", "", "Fast"), ("", "new-thing|hopeful", None), ("", "", "Slow"), ("", "", "Medium")]))
def clean_terms(spark, d):
    b = spread(spark, d, _CLEAN, "tropes array<string>, tags array<string>, pacing string")
    known = aliases(spark).unionByName(vocabulary(spark).filter("status = 'active'").select(normalize_raw("slug").alias("alias"), "slug")).distinct()
    out = resolve.clean_terms(b, vocabulary(spark), known)
    return out.select("id", F.array_join("tropes", "|").alias("tropes"), F.array_join("tags", "|").alias("tags"), "pacing")


@query("clean_audit", "SELECT p_partkey AS book_id, p_name AS before, upper(p_name) AS after FROM part WHERE p_partkey % 3 = 0")
def clean_audit(spark, d):
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    after = b.withColumn("p_name", F.when(F.col("id") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return resolve.audit(b, after, ["p_name"]).select("book_id", F.col("before.p_name").alias("before"), F.col("after.p_name").alias("after"))


_TAGGED = [(["Romance"], ["found families", "slow-burn"]), (["Romance", "Science Fiction"], ["found families"]), (["Sci-Fi"], ["found families", "odd one"]), ([], ["slow burn", "odd one"]), (["Science Fiction"], ["odd one", "old-term"])]


@query(
    "term_review",
    f"""WITH c AS (SELECT p_partkey % 5 AS k FROM part), n AS (SELECT k, count(*) AS n FROM c GROUP BY k), t AS (SELECT (SELECT n FROM n WHERE k = 0) AS a, (SELECT n FROM n WHERE k = 1) AS b, (SELECT n FROM n WHERE k = 2) AS c, (SELECT n FROM n WHERE k = 3) AS d, (SELECT n FROM n WHERE k = 4) AS e)
  SELECT 'found families' AS term, a + b + c AS books, 'review' AS tier, '' AS suggestion, 'romance' AS genre_bucket, 'found-family' AS nearest_1, 84 AS score_1 FROM t
  UNION ALL SELECT 'slow burn', d, 'prior-ruling', 'drop', '(none)', 'slow-burn', 100 FROM t
  UNION ALL SELECT 'odd one', c + d + e, 'new', 'activate', 'sci-fi', 'court-intrigue', 38 FROM t""",
)
def term_review(spark, d):
    tagged = spread(spark, d, _TAGGED, "genres array<string>, tags array<string>").withColumn("title", F.concat(F.lit("T"), F.col("id").cast("string")))
    prior = spark.createDataFrame([("slow burn", "drop")], "term string, ruling string")
    out = resolve.term_review(tagged, vocabulary(spark), prior)
    return out.select("term", "books", "tier", "suggestion", "genre_bucket", "nearest_1", "score_1")


_RULINGS = [("slow burns", "accept", "slow-burn"), ("gone", "accept", "old-term"), ("x", "remap:new-thriller", None), ("y", " remap:court-intrigue", None), ("Bad Term", "reject", "slow-burn"), ("z", "remap:quiet", "a")]


@query("apply_rulings", outcome_sql("target, outcome, new_kind", [("slow-burn", "accept", None), ("old-term", "invalid", None), ("new-thriller", "remap", "subgenre"), ("court-intrigue", "remap", None), ("bad-term", "proposed", "tag"), ("quiet", "remap", "tag")]))
def apply_rulings(spark, d):
    rulings = spread(spark, d, _RULINGS, "raw string, decision string, suggested string")
    done = resolve.apply_rulings(rulings.select("raw", "decision", "suggested").distinct(), vocabulary(spark))
    return rulings.select("id", "raw").join(done, "raw").select("id", "target", "outcome", "new_kind")


@case_query("refile", "tropes array<string>, tags array<string>", [(["slow-burn", "x"], ["found-family", "x"]), (["gone"], ["gone", "a"]), ([], [])], "tropes, tags", [("slow-burn|found-family", "x"), ("", "a"), ("", "")])
def refile(df):
    spark = df.sparkSession
    out = resolve.refile(df, vocabulary(spark).select("slug", "kind"), spark.createDataFrame([("gone",)], "slug string"))
    return out.select("id", F.array_join("tropes", "|").alias("tropes"), F.array_join("tags", "|").alias("tags"))


_DECIDED = [("irish-literature", "merge:irish"), ("irish", "merge:ireland"), ("self", "merge:self"), ("keepme", "keep"), ("twin", "keep"), ("royalty", "keep"), ("junk", "kill"), ("blank", ""), ("nowhere", "merge:"), ("forced", "kill"), ("aliased", "yes"), ("loop-a", "merge:loop-b"), ("loop-b", "merge:loop-a")]
_COMPILED = [("irish-literature", "merge:ireland"), ("irish", "merge:ireland"), ("self", "activate"), ("keepme", "activate"), ("twin", "merge:other"), ("royalty", "activate"), ("junk", "drop"), ("nowhere", "drop"), ("forced", "activate"), ("aliased", "merge:real"), ("loop-a", "merge:loop-b"), ("loop-b", "merge:loop-a")]


@query("compile_decisions", f"SELECT p_partkey AS id, term, decision FROM part JOIN (VALUES {values([(i, t) for i, (t, _) in enumerate(_DECIDED)])}) t(k, term) ON p_partkey % {len(_DECIDED)} = k JOIN (VALUES {values(_COMPILED)}) o(term, decision) USING (term)")
def compile_decisions(spark, d):
    rows = spread(spark, d, _DECIDED, "term string, decision string")
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    done = resolve.compile_decisions(
        rows.select("term", "decision").distinct(), frame([("twin", "other"), ("royalty", "loyalty")], "slug string, into string"), frame([("royalty",)], "term string"), frame([("aliased", "real")], "alias string, slug string"), frame([("forced", "activate")], "term string, decision string")
    )
    return rows.select("id", "term").join(done, "term").select("id", "term", "decision")


@query("unmapped_terms", "WITH c AS (SELECT p_partkey % 4 AS k, count(*) AS n FROM part GROUP BY 1), t AS (SELECT (SELECT n FROM c WHERE k = 0) AS a, (SELECT n FROM c WHERE k = 1) AS b, (SELECT n FROM c WHERE k = 2) AS c FROM (SELECT 1)) SELECT 'Gore' AS raw, a + b AS books, 'contentWarnings' AS from_field, 'warning' AS kind FROM t UNION ALL SELECT 'odd one', b + c, 'tags', 'tag' FROM t")
def unmapped_terms(spark, d):
    rows = [(["Slow Burn"], ["Gore"]), (["odd one"], ["Gore"]), (["odd one"], []), (["found family"], [])]
    own = spread(spark, d, rows, "tags array<string>, warnings array<string>")
    entries = own.select("id", F.lit("tags").alias("field"), F.explode("tags").alias("term")).unionByName(own.select("id", F.lit("contentWarnings").alias("field"), F.explode("warnings").alias("term")))
    return resolve.unmapped_terms(entries, vocabulary(spark).select("slug"))


@case_query("normalized_warnings", "warnings array<string>", [(["Drug Us", "blood"],), (["BLOOD", "Blood ", "none"],), (["drug use", "drug us"],), ([],), (None,)], "warnings", [("drug use|blood",), ("BLOOD",), ("drug use",), ("",), ("",)])
def normalized_warnings(df):
    return df.select("id", F.array_join(resolve.normalized_warnings(F.coalesce("warnings", F.array().cast("array<string>")), {"drug us": "drug use"}, ["none"]), "|").alias("warnings"))


@query("remapped_slugs", f"SELECT p_partkey AS id, slug, kind FROM part JOIN (VALUES {values([(0, 'court-case', 'trope'), (1, 'spies', 'tag'), (3, 'kept', 'trope')])}) v(k, slug, kind) ON p_partkey % 4 = k")
def remapped_slugs(spark, d):
    rows = spread(spark, d, [("legal-thriller",), ("spy-thriller",), ("heist",), ("kept",)], "trope string")
    return resolve.remapped(rows, {"legal-thriller": "court-case"}, {"spy-thriller": "spies"}, ["heist"]).select("id", "slug", "kind")


@query("slug_groups", f"""WITH {BOOKS_SQL}, u AS (SELECT slug, count(*) AS n FROM (SELECT unnest(tropes) AS slug FROM books) GROUP BY slug), g AS (SELECT slug, length(slug) AS grp, row_number() OVER (PARTITION BY length(slug) ORDER BY slug DESC) AS pos FROM (SELECT slug FROM u UNION SELECT 'zzzz'))
  SELECT grp, string_agg(g.slug || '=' || coalesce(n, 0), '  ' ORDER BY pos) AS survey FROM g LEFT JOIN u USING (slug) GROUP BY grp""")
def slug_groups(spark, d):
    from pyspark.sql import Window

    uses = books(spark, d).select(F.explode("tropes").alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))
    every = uses.select("slug").unionByName(spark.createDataFrame([("zzzz",)], "slug string")).withColumn("grp", F.length("slug").cast("long"))
    return resolve.slug_groups(uses, every.withColumn("pos", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("slug")))))


_PARSED = [(0, "slow-burn", "Slow Burn", "trope", "fiction", ["Romance"], ["SB"]), (1, "gaslamp", "Gaslamp", "subgenre", "fiction", ["Fantasy"], ["slow burn", "gas lamp"])]


@query("built_vocabulary", f"SELECT * FROM (VALUES {values([('slow-burn', 'Slow Burn', 'trope', 'active', 'sb|slow burn'), ('gaslamp', 'Gaslamp', 'subgenre', 'active', 'gas lamp|gaslamp'), ('old-term', 'old term', 'tag', 'rejected', '')])}) v(slug, display, kind, status, aliases)")
def built_vocabulary_(spark, d):
    """A small document's terms over a small vocabulary: kept statuses, first come first served aliases."""
    parsed = spark.createDataFrame(_PARSED, "pos int, slug string, display string, kind string, applies_to string, genres array<string>, aliases array<string>")
    current = spark.createDataFrame([("slow-burn", "slow", "tag", "fiction", [], "active"), ("old-term", "old term", "tag", "both", [], "rejected")], "slug string, display string, kind string, applies_to string, genres array<string>, status string")
    vocab, names = built_vocabulary(current, parsed)
    lists = names.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("aliases"))
    return vocab.join(lists, "slug", "left").select("slug", "display", "kind", "status", F.coalesce("aliases", F.lit("")).alias("aliases"))


@query("rewritten_decisions", outcome_sql("decision, kind", [("merge:ya-fantasy", "tag"), ("activate", "subgenre"), ("", "tag"), ("keep", "tag")]))
def rewritten_decisions(spark, d):
    rows = spread(spark, d, [("young-adult-fantasy", "drop", "tag"), ("ya-fantasy", "", "tag"), ("juvenile-fiction", "drop", "tag"), ("other", "keep", "tag")], "term string, decision string, kind string")
    rulings = spark.createDataFrame([("young-adult-fantasy", "merge:ya-fantasy", None), ("ya-fantasy", "activate", "subgenre"), ("juvenile-fiction", None, None)], "term string, decision string, kind string")
    done = classify.rewritten(rows.select("term", "decision", "kind").distinct(), rulings)
    return rows.select("id", "term").join(done, "term").select("id", "decision", "kind")


@query("covered_states", outcome_sql("book_class, needs_enrichment, stage", [("fiction", 0, "skipped"), ("fiction", 1, "pending"), ("ambiguous", 1, "promoted"), ("nonfiction", 1, "pending")]))
def covered_states(spark, d):
    """Triage with its upsert: a terminal stage stays; unknown and rejected terms don't count."""
    three, tags = ["slow-burn", "found-family", "enemies-to-lovers"], ["court-intrigue", "hopeful", "slow-burn"]
    b = spread(spark, d, [(["Romance"], three, tags, "Slow", "pending"), (["Romance"], three, ["court-intrigue", "old-term", "hopeful"], "Slow", None), ([], [], [], None, "promoted"), (["Art"], three, tags, "", "skipped")], "genres array<string>, tropes array<string>, tags array<string>, pacing string, stage string")
    current = b.filter("stage IS NOT NULL").select("id", F.lit("ambiguous").alias("book_class"), F.lit(1).alias("needs_enrichment"), "stage")
    return classify.upsert_state(current, classify.covered(b, vocabulary(spark)))


@query("catalogue_coverage", f"""WITH {BOOKS_SQL}, l AS (SELECT *, coalesce(status LIKE 'archived%', false) AS gone, id % 5 <> 0 AS tr, CASE WHEN id % 3 = 0 THEN [] WHEN id % 3 = 1 THEN ['hopeful'] ELSE ['hopeful', 'court-intrigue'] END AS tg FROM books)
  SELECT count(*) AS books, count(*) FILTER (gone) AS archived, count(*) FILTER (NOT gone AND (tr OR len(tg) > 0)) AS recommendable, count(*) FILTER (NOT gone AND tr) AS with_trope, count(*) FILTER (NOT gone AND len(tg) > 0) AS with_tag, count(*) FILTER (NOT gone AND tr AND len(tg) > 0) AS with_both,
    count(*) FILTER (NOT gone AND (tr OR len(tg) = 2)) AS meaningful, count(*) FILTER (NOT gone AND NOT tr AND len(tg) = 1) AS mood_only, CAST(count(*) FILTER (NOT gone AND (tr OR len(tg) > 0)) * 100 // count(*) FILTER (NOT gone) AS INT) AS share FROM l""")
def catalogue_coverage(spark, d):
    k = F.col("id") % 3
    none = F.array().cast("array<string>")
    b = books(spark, d).select("id", "status", F.when(F.col("id") % 5 != 0, F.col("tropes")).otherwise(none).alias("tropes"), F.when(k == 1, F.array(F.lit("hopeful"))).when(k == 2, F.array(F.lit("hopeful"), F.lit("court-intrigue"))).otherwise(none).alias("tags"))
    return review.coverage(b, vocabulary(spark).select("slug", "kind"))
