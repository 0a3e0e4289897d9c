"""Ranked search: order, several fields, minimum length, sessions, streams, and the entry point without the llm folders."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tierseek.functions import fold as T
from tierseek.operators.match import Query
from tierseek.operators.search import FieldSpec, FuzzyIndex, fuzzy_join
from tierseek.plans import catalog
from tierseek.streaming.search import match_stream


def test_order_and_null(spark):
    rows = [(1, "xgreen tea"), (2, "green tea"), (3, None), (4, "Green Tea"), (5, "tea green"), (6, "green teapot")]
    index = FuzzyIndex(spark.createDataFrame(rows, "id long, name string").coalesce(1), "name", "id")
    assert [r["id"] for r in index.search("green tea").collect()] == [2, 4, 6, 5, 1]
    assert index.search("g").count() == 0 and index.search("  ").count() == 0


def test_fields_at_best(spark):
    rows = [(1, "red", "blue"), (2, "blue", None)]
    df = spark.createDataFrame(rows, "id long, title string, body string").coalesce(1)
    found = FuzzyIndex(df, [FieldSpec("title"), FieldSpec("body", at_best=2.0)], "id").search("blue").collect()
    assert [(r["id"], r["score"]) for r in found] == [(2, 0.0), (1, 2.0)]
    assert found[0]["fields"][1] is None and FuzzyIndex(df, []).search("blue").count() == 0


def test_fold_column_equals_string(spark):
    texts = ["Café ŁÓDŹ", "ΤΕΛΟΣ ς", "  “x” ’s ", "İstanbul", "Café", "𐐀 ß đ ø"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(T.normalise_text(df.t)).collect()] == [T.fold_str(t) for t in texts]


def test_catalogue_searches_every_row_of_part(spark, tmp_path):
    rows = [(i, "another widget") for i in range(1, 12)] + [(12, "blue widget"), (13, "wigdet"), (14, "red gadget"), (15, "red gadget")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.QUERIES["search_many"](spark, str(tmp_path)).collect()
    got = {q: [(r["rank"], r["p_partkey"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in "abc"}
    assert got == {"a": [(1, 14), (2, 15)], "b": [(1, 12)], "c": [(i, i) for i in range(1, 11)]}
    # blue widget comes first for blue and twelfth for widget
    assert catalog.QUERIES["mrr"](spark, str(tmp_path)).collect()[0]["mrr"] == 0.333333


def test_session_equals_fresh_searches(spark):
    rows = [(i, t) for i, t in enumerate(["wooden spoon", "wooden spork", "spoon rest", "silver spoon", "spo", "wodden bowl", None, "tin"] * 3)]
    index = FuzzyIndex(spark.createDataFrame(rows, "id long, name string").coalesce(2), "name", "id")
    session, before = index.session(), spark._jsc.getPersistentRDDs().size()
    for typed in ("sp", "spo", "spoo", "spoon", "spoon r", "wodn", "wooden"):
        found = [(r["id"], r["score"]) for r in session.search(typed).collect()]
        assert found == [(r["id"], r["score"]) for r in index.search(typed).collect()], typed
        assert spark._jsc.getPersistentRDDs().size() <= before + 1
    session.close()
    assert spark._jsc.getPersistentRDDs().size() == before


def test_join_equals_each_query_on_its_own(spark):
    texts = ["Wooden spoon", "spoon, wooden", "woodenspoon", " Café au lait", "cafe", "a b c", "b--a", "--", "", None, "spo", "wooden spoon", "x wooden y spoon z", "Ab", "aba", "\\E.*"]
    asked = ["wooden spoon", "Wooden Spoon", "spoon wooden", "café", "CAFE", "a b", "b a", "--", "ab", "oo", "x", "", None, "nowhere", "spo", "spo", "\\E", ".*"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, name string").coalesce(2)
    queries = spark.createDataFrame(list(enumerate(asked)), "id long, query string").coalesce(1)
    got = fuzzy_join(df, queries, "name").select("asked.id", "found.id", "score", "tier", F.to_json("ranges")).collect()
    want = []
    for i, q in enumerate(asked):
        found = FuzzyIndex(df, "name", "id").matches(Query.of(q or ""), False).where("score <= 2.0") if len(Query.of(q or "").text) > 1 else None
        rows = found.select("id", "score", F.col("fields")[0]["tier"], F.to_json(F.col("fields")[0]["ranges"])).collect() if found is not None else []
        want += [(i, *r) for r in rows]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 30


def test_join_limit_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(3, "tea"), (1, "tea"), (2, "tea cup"), (4, "steam")], "id long, name string").coalesce(1)
    queries = spark.createDataFrame([("a", "tea"), ("b", "tea"), ("c", "cup")], "name string, query string").coalesce(1)
    got = fuzzy_join(df, queries, "name", limit=2, key="id").select("asked.name", "found.id").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("a", 3), ("b", 1), ("b", 3), ("c", 2)]
    assert fuzzy_join(df, queries.limit(0), "name").count() == 0 == fuzzy_join(df.limit(0), queries, "name").count()


def test_search_is_lazy(spark):
    index = FuzzyIndex(spark.createDataFrame([(1, "wooden")], "id long, name string").select("id", F.assert_true(F.lit(False)).cast("string").alias("name")), "name", "id")
    index.search("wodden spoon")  # would fail if it ran anything


def test_stream(spark, tmp_path):
    spark.createDataFrame([("green tea",), ("black coffee",), (None,)], "t string").coalesce(1).write.parquet(f"{tmp_path}/in")
    found = match_stream(spark.readStream.schema("t string").parquet(f"{tmp_path}/in"), "t", "tea")
    query = found.writeStream.format("memory").queryName("matches").trigger(availableNow=True).start()
    assert query.awaitTermination(60) and [r["t"] for r in spark.table("matches").collect()] == ["green tea"]
    assert "stateoperators" not in str(query.lastProgress).lower() or not query.lastProgress["stateOperators"]


def test_core_stands_without_the_llm_folders():
    code = "import sys; sys.modules['tierseek.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
def test_join_broadcasts_nothing_that_grows(spark, tmp_path):
    """Files of repeated texts are far smaller than what is made from them, so Spark's estimate would have broadcast every row."""
    spark.range(3000).select("id", F.concat_ws(" ", F.lit("red"), F.lit("widget"), (F.col("id") % 7).cast("string")).alias("name")).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    found = fuzzy_join(df, df.select(F.explode(F.split("name", " ")).alias("query")).distinct(), "name")
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert any("SortMergeJoin" in x for x in joins) and all("SortMergeJoin" in x or "__row" in x for x in joins), joins
    assert found.count() == 6000  # each row for red and for widget; single digits are too short to be queries


