"""What the findings of round 2 named: each failed before its change."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marginalia.llm import common
from marginalia.operators import metadata
from marginalia.plans import registry

SF = "/root/testdata/sf0.001"


def _rows_out(df):
    """Rows that each operator of a plan made, its stages among them."""
    df.collect()
    plans, out = [df._jdf.queryExecution().executedPlan()], []
    while plans:
        p = plans.pop()
        for inner in ("finalPhysicalPlan", "plan"):
            if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec" and inner == "finalPhysicalPlan" or p.getClass().getSimpleName().endswith("QueryStageExec") and inner == "plan":
                plans.append(getattr(p, inner)())
        rows = p.metrics().get("numOutputRows")
        if rows.isDefined():
            out.append(rows.get().value())
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_edition_rollup_ties_in_table_order(spark, tmp_path):
    con = duckdb.connect(config={"threads": 1})
    rows = "(1, 5, 7, 3, 30.0), (2, 5, 7, 3, 41.0), (1, 5, 8, 3, 12.0), (2, 6, 8, 4, 2.7), (3, 5, 7, 3, 47.0), (4, 6, 8, 4, 9.0), (5, 6, 1, 2, 8.0)"
    con.execute(f"CREATE TABLE lineitem AS SELECT l_suppkey, l_partkey, l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, TIMESTAMP '1998-03-01' AS l_shipdate FROM (VALUES {rows}) t(l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    want = sorted(con.sql(registry.ORACLE_SQL["edition_rollup"]).fetchall())
    assert [r[4] for r in want] == [30, 3]
    assert sorted(tuple(r) for r in registry.QUERIES["edition_rollup"](spark, str(tmp_path)).collect()) == want


def test_confirmed_works_pairs_follow_titles_and_authors(spark):
    """300 books and 300 works of one title: a work meets the one author of the books, not each book."""
    books = spark.range(300).selectExpr("id", "'Red Sea' AS title", "concat('Brand#', id) AS author")
    work = spark.range(300).selectExpr("concat('/w/', id) AS key", "'red sea' AS title", "array('/authors/1') AS authors")
    names = spark.createDataFrame([("/authors/1", "Brand 11")], "key string, name string")
    out = metadata.confirm_works(books, work, names)
    assert {(r["id"], r["verified"]) for r in out.collect()} == {(0, True)} and out.count() == 300
    assert max(_rows_out(out)) <= 600


def test_taste_weights_broadcast_no_features(spark):
    plan = registry.QUERIES["taste_weights"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [book_id" not in plan and "SortMergeJoin [book_id" in plan


def test_large_rows_have_small_row_groups(spark):
    """30 rows of 2 MB in one task: row groups of about 16 MB, where the writer else looks at its size after 100 rows."""

    def noise(batches):
        for batch in batches:
            for _ in range(len(batch)):
                yield pa.RecordBatch.from_arrays([pa.array([random.randbytes(2 << 20)], pa.binary())], ["b"])

    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    table = common.stored(spark.range(0, 30, numPartitions=1).mapInArrow(noise, "b binary"), "noise", True)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 30 and max(groups) <= 9
    with common.single_rows(spark):
        assert [r["n"] for r in table.mapInArrow(lengths, "n long").collect()] == [1] * 30


def test_profile_top_features_broadcasts_no_features(spark):
    plan = registry.QUERIES["profile_top_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [book_id" not in plan and "SortMergeJoin [book_id" in plan


@pytest.mark.parametrize("name", ["recommend_topk", "recommend_filtered_1y"])
def test_recommenders_broadcast_no_blocks_of_books(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [u_block" not in plan and "SortMergeJoin [u_block" in plan
