"""Queries of catalogue upkeep, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import upkeep
from marginalia.plans.domain import BOOKS_SQL, books, table
from marginalia.plans.register import query

WITH = f"WITH {BOOKS_SQL}"


@query("pretty", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS value FROM part")
def pretty(spark, d):
    return table(spark, d, "part").select("p_partkey", text.pretty(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("value"))


@query("clean_subject", "SELECT p_partkey, lower(p_type) AS value FROM part")
def clean_subject(spark, d):
    subject = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" -- Fiction"))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", text.clean_subject(subject).alias("value"))


@query("url_slug", "SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$') AS value FROM pages")
def url_slug(spark, d):
    return table(spark, d, "pages").select("page_id", upkeep.url_slug(F.col("url")).alias("value"))


@query("subject_headings", "SELECT p_partkey, unnest([p_type, p_name, p_brand]) AS heading FROM part")
def subject_headings(spark, d):
    subject = F.concat("p_type", F.lit(" -- "), "p_name", F.lit("—"), "p_brand", F.lit(" --"))
    return table(spark, d, "part").select("p_partkey", F.explode(upkeep.headings(subject)).alias("heading"))


@query("source_append", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'Brand#11 + shelf' ELSE p_brand || ' + Brand#11 + shelf' END AS value FROM part")
def source_append(spark, d):
    first = upkeep.with_source(F.col("p_brand"), "Brand#11")
    return table(spark, d, "part").select("p_partkey", upkeep.with_source(upkeep.with_source(first, "shelf"), "shelf").alias("value"))


@query("implied_tag", f"""{WITH} SELECT id, CASE WHEN list_contains(tags, 'size-3') OR list_contains(tags, 'size-4') THEN array_to_string(list_append(tags, 'middle'), '|') ELSE array_to_string(tags, '|') END AS tags FROM books""")
def implied_tag(spark, d):
    return books(spark, d).select("id", F.array_join(upkeep.implied(F.col("tags"), ["size-3", "size-4"], "middle", 10), "|").alias("tags"))


@query("new_entries", "SELECT p_partkey, p_name, p_brand FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 3 = 0 AND b.p_name = a.p_name AND b.p_brand = a.p_brand)")
def new_entries(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return upkeep.new_entries(p, p.filter("p_partkey % 3 = 0"), ["p_name", "p_brand"])


@query("vocabulary_by_kind", f"{WITH}, v AS (SELECT 'trope' AS kind, tropes[1] AS slug FROM books UNION SELECT 'tag', unnest(tags) FROM books) SELECT kind, string_agg(slug, '|' ORDER BY slug) AS slugs FROM v GROUP BY kind")
def vocabulary_by_kind(spark, d):
    b = books(spark, d)
    v = b.select(F.lit("trope").alias("kind"), F.explode("tropes").alias("slug")).unionByName(b.select(F.lit("tag").alias("kind"), F.explode("tags").alias("slug")))
    return upkeep.by_kind(v.distinct()).select("kind", F.array_join("slugs", "|").alias("slugs"))


@query("run_report", "SELECT strftime(o_orderdate, '%Y-%m') AS run, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_at FROM orders GROUP BY 1")
def run_report(spark, d):
    return upkeep.run_report(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.col("o_orderdate").cast("date").alias("at")))


@query("correction_directions", "SELECT o_orderstatus AS was, o_orderpriority AS becomes, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, was, becomes LIMIT 12")
def correction_directions(spark, d):
    return upkeep.directions(table(spark, d, "orders").select(F.col("o_orderstatus").alias("was"), F.col("o_orderpriority").alias("becomes")))


@query("account_link", """SELECT c_custkey AS login_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS account_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'insert' WHEN c_custkey % 2 = 0 THEN 'subject' ELSE 'email' END AS how FROM customer""")
def account_link(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("one").alias("provider"), F.col("c_custkey").cast("string").alias("sub"), F.col("c_name").alias("email"))
    logins = c.withColumn("provider", F.when(F.col("c_custkey") % 2 == 0, F.col("provider")).otherwise("two")).withColumnRenamed("c_custkey", "login_id")
    return upkeep.link_accounts(logins, c.filter("c_custkey % 3 <> 0").withColumnRenamed("c_custkey", "account_id"))
