"""Operators on small tables, and invariants of the plans."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.similarity import ratio
from marginalia.operators import classify, lexical, matching, metadata, similar, staging, taxonomy
from marginalia.plans import phases
from marginalia.sources import files, sinks
from marginalia.streaming import counts

SF = "/root/testdata/sf0.001"


def test_chain_of_three_cycle_and_self(spark):
    merges = spark.createDataFrame([("irish-literature", "irish"), ("irish", "ireland"), ("x", "x"), ("p", "q"), ("q", "p")], "slug string, into string")
    got = {r["slug"]: r["target"] for r in taxonomy.resolve_chains(merges).collect()}
    assert got["irish-literature"] == "ireland" and got["irish"] == "ireland" and "x" not in got and set(got) == {"irish-literature", "irish", "p", "q"}


def test_fuzzy_equals_brute_force(spark):
    names = ["red widget", "blue widget", "red midget", "a saga of the red sea", "sea", "blue ring box", ""]
    books = spark.createDataFrame([(i, n, f"author {i % 3}") for i, n in enumerate(names)], "id long, title string, author string")
    rows = spark.createDataFrame([(i, n + "x", "author 1") for i, n in enumerate(names)], "row_id long, title string, author string")
    got = {r["row_id"]: (r["book_id"], r["match_status"]) for r in matching.fuzzy_match(rows, books).collect()}
    order = lambda s: " ".join(sorted(s.split()))
    for i, n in enumerate(names):
        best = None
        for k, b in enumerate(names):
            ts, au = ratio(order(n + "x"), order(b)), ratio(order("author"), order("author"))
            if ts >= 50 and (best is None or 0.7 * ts + 0.3 * au > best[0] + 1e-9):
                best = (0.7 * ts + 0.3 * au, ts, au, k)
        if best is None or not ((best[1] >= 88 and best[2] >= 75) or best[0] >= 65):
            assert got[i] == (None, "unmatched")
        else:
            assert got[i] == (best[3], "matched" if best[1] >= 88 else "ambiguous")


def test_promote_then_rollback_is_identity(spark):
    books = spark.createDataFrame([(1, ["a"], ["x"], None, "N/A", "Plot"), (2, [], [], "Slow", "Tame", None)], "id long, tropes array<string>, tags array<string>, pacing string, spice_level string, focus string")
    results = books.filter("id = 1").select("id", F.lit(True).alias("known"), F.lit("high").alias("confidence"), F.array(F.lit("b"), F.lit("tagged")).alias("tropes"), F.array(F.lit("tagged")).alias("tags"), F.lit("Fast").alias("pacing"), F.lit("Tame").alias("spice_level"), F.lit("World").alias("focus"))
    vocabulary = spark.createDataFrame([("b", "trope"), ("tagged", "tag")], "slug string, kind string")
    staged = staging.ingest(results, vocabulary, books)
    assert staged.first()["proposed"] == ["tagged"]  # a tag offered as a trope
    up = staging.promote(books, staged)
    row = up.filter("id = 1").first()
    assert (row["tropes"], row["tags"], row["pacing"], row["spice_level"], row["focus"]) == (["a", "b"], ["x", "tagged"], "Fast", "Tame", "Plot")
    assert sorted(map(str, staging.rollback(up, staged).collect())) == sorted(map(str, books.collect()))


def test_canonicalise_is_idempotent(spark):
    books = spark.createDataFrame([(1, ["small", "big", "huge", "big"]), (2, [])], "book_id long, tags array<string>")
    decisions = spark.createDataFrame([("huge", "merge", "big"), ("small", "drop", None)], "term string, decision string, target string")
    once = taxonomy.canonicalise(books, decisions)
    assert {r["book_id"]: r["tags"] for r in once.collect()} == {1: ["big"], 2: []}
    assert sorted(map(str, taxonomy.canonicalise(once, decisions).collect())) == sorted(map(str, once.collect()))


def test_pack_validation_and_limit(spark):
    pack = [lexical.Pattern("one", "A", r"\bfae\b"), lexical.Pattern("two", "B", r"\brob\w*\b")]
    lexical.check_pack(pack, {"one", "two"})
    with pytest.raises(ValueError):
        lexical.check_pack([*pack, lexical.Pattern("one", "B", "x")], {"one", "two"})
    texts = spark.createDataFrame([(1, "A cafe with problems."), (2, "The Fae rob a bank")], "id long, text string")
    assert [(r["id"], r["slug"], r["phrase"]) for r in lexical.match_rows(texts, pack).orderBy("id", "ord").collect()] == [(2, "one", "Fae"), (2, "two", "rob")]
    assert lexical.match_rows(texts, pack, limit=1).count() == 1


def test_triage_order(spark):
    df = spark.createDataFrame([(["Kids", "Novel"],), (["Poem"],), (["Poem", "Novel"],), (["Fact"],), (["Fact", "Novel"],), (["novel"],)], "labels array<string>")
    got = [r["c"] for r in df.select(classify.triage(F.col("labels"), ["Kids"], ["Poem"], ["Fact"], ["Novel"]).alias("c")).collect()]
    assert got == ["childrens", "poetry_drama", "fiction", "nonfiction", "ambiguous", "ambiguous"]


def test_dump_join(spark, tmp_path):
    rows = [
        ("/type/work", {"key": "/works/1", "title": "The Red Sea", "authors": [{"author": {"key": "/authors/1"}}], "description": {"value": " deep "}, "subjects": ["x"]}),
        ("/type/work", {"key": "/works/2", "title": "Red Sea", "authors": ["/authors/2"], "description": "plain"}),
        ("/type/work", {"key": "/works/3", "title": "Red Sea"}),
        ("/type/author", {"key": "/authors/1", "name": "Ann Lee"}),
    ]
    with gzip.open(tmp_path / "dump.txt.gz", "wt") as f:
        f.write("broken line\n")
        for kind, body in rows:
            f.write(f"{kind}\t{body['key']}\t1\t2020\t{json.dumps(body)}\n")
    dump = files.read_dump(spark, str(tmp_path / "dump.txt.gz"))
    work = metadata.works(dump)
    got = {r["key"]: (r["authors"], r["description"]) for r in work.collect()}
    assert got["/works/1"] == (["/authors/1"], "deep") and got["/works/2"] == (["/authors/2"], "plain")
    books = spark.createDataFrame([(7, "Red Sea", "Lee Ann")], "id long, title string, author string")
    names = spark.createDataFrame([("/authors/1", "Ann Lee"), ("/authors/2", "Bob Ray")], "key string, name string")
    assert sorted(r["key"] for r in metadata.confirm_works(books, work, names).collect()) == ["/works/1", "/works/3"]


def test_shelf_and_catalogue_sources(spark, tmp_path):
    (tmp_path / "shelf.csv").write_text('﻿Title,Author,ISBN,ISBN13,My Rating,Date Read,Date Added,Exclusive Shelf\n"A ""big"" book",Ann,="0439023483",="9780439023481",0,2024/1/5,,read\nB,Bob,,,4.5,,01/02/2023, Read \nC,Cid,,,3,,,to-read\n', encoding="utf-8")
    rows = files.read_shelf(spark, str(tmp_path / "shelf.csv")).orderBy("raw_title").collect()
    assert [(r["raw_title"], r["isbn13"], r["user_rating"]) for r in rows] == [('A "big" book', "9780439023481", None), ("B", "", 4.5)]
    (tmp_path / "books.json").write_text(json.dumps([{"id": "1", "title": "A", "genre": "Novel"}, {"id": "2", "title": "B", "genre": ["Fact", "Essay"]}]))
    got = {r["id"]: r["genres"] for r in files.read_catalogue(spark, str(tmp_path / "books.json")).collect()}
    assert got == {"1": ["Novel"], "2": ["Fact", "Essay"]}


DOCUMENT = """# Terms

## 1. Love

Intro, only one comma.

enemies to lovers (rivals to lovers, foes), HEA / HFN, slow burn — a remark, dubcon (see notes), fake dating.

### Subgenres

- no, list, of, terms, here

Categories: dark romance (also grim), light romance, warm romance, cold romance

### Heat level

closed door, open door, fade to black, none of it

## 9. Everywhere

fake dating, found family (chosen family), twist ending, heists

## 10. Facts

> quoted, list, of, words

economics, law & order, memoir writing, history

## 11. Unknown

a, b, c, d, e
"""


def test_taxonomy_source(spark, tmp_path):
    (tmp_path / "t.md").write_text(DOCUMENT)
    got = {r["slug"]: r for r in files.read_taxonomy(spark, str(tmp_path / "t.md")).collect()}
    kinds = {slug: (r["kind"], r["applies_to"], r["genres"]) for slug, r in got.items()}
    assert kinds["romance"] == ("genre", "fiction", []) and kinds["enemies-to-lovers"] == ("trope", "fiction", ["Romance"]) and got["enemies-to-lovers"]["aliases"] == ["rivals to lovers, foes"]
    assert kinds["hea"] == kinds["hfn"] == ("tag", "fiction", ["Romance"]) and got["slow-burn"]["display"] == "slow burn"
    assert kinds["dubcon"] == ("warning", "both", ["Romance"]) and got["dubcon"]["aliases"] == [] and kinds["dark-romance"] == ("subgenre", "fiction", ["Romance"]) and got["dark-romance"]["aliases"] == []
    assert kinds["open-door"] == ("tag", "fiction", ["Romance"]) and kinds["fake-dating"] == ("trope", "fiction", []) and got["found-family"]["aliases"] == ["chosen family"]
    assert kinds["law-and-order"] == ("subject", "nonfiction", []) and kinds["hopeful"] == ("mood", "both", []) and "a" not in got and "no" not in got


def test_review_source_and_pack_source(spark, tmp_path):
    (tmp_path / "review.csv").write_text("\ufeffdecision(keep/blank),tier,tag\nkeep,A,x\n,B,y\n")
    assert [tuple(r) for r in files.read_review(spark, str(tmp_path / "review.csv")).orderBy("tag").collect()] == [("keep", "A", "x"), (None, "B", "y")]
    (tmp_path / "pack.csv").write_text('slug,tier,regex\nbet,A,"\\bbets?\\b"\nqueen,B,"queen, (the|a)"\n')
    assert lexical.read_pack(spark, str(tmp_path / "pack.csv")) == [lexical.Pattern("bet", "A", r"\bbets?\b"), lexical.Pattern("queen", "B", "queen, (the|a)")]


def test_golden_texts_of_the_packs(spark):
    """Cases that patterns with word borders must not hit, and those that they must."""
    pack = [lexical.Pattern("alien", "A", r"\baliens?\b"), lexical.Pattern("virgin", "A", r"\bvirgin (bride|hero)"), lexical.Pattern("heist", "B", r"\brob\b"), lexical.Pattern("bet", "B", r"\bbet\b")]
    texts = spark.createDataFrame([(1, "Her alienation grows."), (2, "Virgin River"), (3, "problems"), (4, "makes a better hero"), (5, "An ALIEN lost a bet")], "id long, text string")
    assert [(r["id"], r["slug"]) for r in lexical.match_rows(texts, pack).orderBy("id", "ord").collect()] == [(5, "alien"), (5, "bet")]


def test_gzip_probe_and_versions(spark, tmp_path):
    with gzip.open(tmp_path / "good.gz", "wt") as f:
        f.write("a line\n")
    (tmp_path / "bad.gz").write_bytes(b"no gzip at all, just text\n")
    assert sinks.readable_gzip(spark, str(tmp_path / "good.gz")) and not sinks.readable_gzip(spark, str(tmp_path / "bad.gz"))
    rows = spark.range(5)
    sinks.replace(rows, str(tmp_path / "t"))
    sinks.replace(rows.filter("id > 2"), str(tmp_path / "t"))
    assert sinks.newest(spark, str(tmp_path / "t")).count() == 2
    sinks.write_review(spark.createDataFrame([("x", 'a "b", c')], "decision string, title string"), str(tmp_path / "review"))
    (part,) = (tmp_path / "review").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbf") and files.read_csv(spark, str(tmp_path / "review")).first().asDict() == {"decision": "x", "title": 'a "b", c'}


def test_nearest_equals_all_pairs(spark):
    """Bounds and blocks lose nothing: the k best of all pairs, on random texts."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 3)))
    left, right = [(i, text(), text()) for i in range(60)], [(i, text(), text()) for i in range(90)]
    rule = similar.Rule(0.7, 50.0, 40.0)
    found = similar.nearest(spark.createDataFrame(left, "id long, one string, two string"), spark.createDataFrame(right, "id long, one string, two string"), 2, rule).collect()
    order = lambda t: " ".join(sorted(t.split()))
    want = set()
    for i, a, b in left:
        scored = sorted((-round(0.7 * x + 0.3 * ratio(order(b), order(d)), 6), k) for k, c, d in right if (x := ratio(order(a), order(c))) >= 50)
        want |= {(i, k, -s) for s, k in scored[:2] if -s >= 40}
    assert want and {(r["left_id"], r["right_id"], r["score"]) for r in found} == want


def test_phases_go_on_after_a_failure(spark):
    done = phases.run_phases(spark, [("one", lambda s: 3), ("two", lambda s: 1 // 0), ("three", lambda s: s.range(4).count())])
    assert [(r["phase"], r["ok"], r["result"]) for r in done.orderBy("seq").collect()] == [("one", True, "3"), ("two", False, None), ("three", True, "4")] and "ZeroDivisionError" in done.filter("not ok").first()["error"]


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([("u", "A", "x"), ("u", "A", "x"), ("v", "B", "y")], "user_id string, raw_title string, raw_author string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = counts.seen_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("seen").collect())) == sorted(map(str, counts.seen_counts(rows).collect()))


def test_recommendations_hold_their_limits(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark).cache()
    assert df.count() > 0 and df.filter("score <= 0").isEmpty()
    assert df.groupBy("user_id", "category").count().agg(F.max("count")).first()[0] <= 3
    assert df.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 15


def test_windowed_feedback_and_merged_counts(spark):
    events = spark.createDataFrame([("click", "2024-01-01 00:10:00", 1.0), ("click", "2024-01-01 00:50:00", 2.5), ("view", "2024-01-01 01:10:00", 1.0)], "event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = counts.windowed_feedback(events).collect()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in got) == [("click", 2, 3.5), ("view", 1, 1.0)]
    have = spark.createDataFrame([("u", 2)], "user_id string, seen_count long")
    more = spark.createDataFrame([("u", 1), ("v", 4)], have.schema)
    assert sorted(tuple(r) for r in counts.merge_counts(have, more, "user_id", "seen_count").collect()) == [("u", 3), ("v", 4)]
