"""Queries over the test tables, each with DuckDB SQL written from the rules rather than from the expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierseek.functions import fold as T
from tierseek.functions.scores import SCORES
from tierseek.operators.match import Query, admits, fuzzy_match, matching
from tierseek.operators.search import FieldSpec, FuzzyIndex, funnel, fuzzy_join, mrr, search_many
from tierseek.plans.oracle import rows_sql
from tierseek.sources.tables import read


def _flat(df: DataFrame, key: str, m: Column) -> DataFrame:
    """key, score, tier, ranges (`start-end` joined by `;`), corrected of the rows that match."""
    found = matching(df, m, "m")
    ranges = F.array_join(F.transform("m.ranges", lambda r: F.concat_ws("-", r["start"], r["end"])), ";")
    return found.select(key, F.round("m.score", 4).alias("score"), F.col("m.tier").alias("tier"), ranges.alias("ranges"), F.coalesce("m.corrected", F.lit("")).alias("corrected"))


def _tier(table: str, key: str, column: str, query: str, tiers: tuple[str, ...], acronym: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        return _flat(df, key, fuzzy_match(column, query, acronym)).where(F.col("tier").isin(*tiers)).drop("corrected")

    return run


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_name")


def _corrected(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(_parts(spark, sf_dir), "p_partkey", fuzzy_match("p_name", query)).where("tier = 'corrected'")

    return run


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.normalise_text(F.col("text")).alias("folded"))


def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.split_words(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.array_join(w, " ").alias("words"))


def literal_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = FuzzyIndex(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").search("red")
    m = F.col("fields")[0]
    return found.select("p_partkey", F.round("score", 4).alias("score"), m["tier"].alias("tier"))


def search_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = FuzzyIndex(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").search("widget", limit=25)
    return found.select("p_partkey", "p_name", F.round("score", 4).alias("score"))


def search_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    found = FuzzyIndex(df, [FieldSpec("c_name"), FieldSpec("c_mktsegment", at_best=2.0)], "c_custkey").search("auto")
    return found.select("c_custkey", F.round("score", 4).alias("score"))


def _searched(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = FuzzyIndex(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", "n_nationkey").search(query)
        return found.select("n_nationkey", F.round("score", 4).alias("score"), F.col("fields")[0]["tier"].alias("tier"))

    return run


PROBES = {"a": "red", "b": "blue", "c": "widget"}
WANTED = {"a": "red widget", "b": "blue widget", "c": "blue widget"}


def search_many_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = FuzzyIndex(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")
    return search_many(index, PROBES, limit=10).select("query_id", F.col("rank").cast("long").alias("rank"), "p_partkey", "p_name", F.round("score", 4).alias("score"))


def search_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = FuzzyIndex(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")
    return mrr(search_many(index, PROBES, limit=10), WANTED, "p_name").select(F.round("mrr", 6).alias("mrr"))


def query_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word that occurs in a part's name as a query against all names."""
    parts = _parts(spark, sf_dir)
    words = parts.select(F.explode(F.split("p_name", " ")).alias("query")).distinct()
    found = fuzzy_join(parts, words, "p_name")
    return found.select("asked.query", "found.p_partkey", F.round("score", 4).alias("score"), "tier")


def gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel(read(spark, sf_dir, "documents"), "text", "licensed").select("n_rows", "n_gate", "n_literal")


ABSENT, PRESENT = "qxzwkvjq", "licensed"


def longtext_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """However long a text: a word that is absent matches nowhere, though many texts have all but one of its letters, a word that is there always does, and
    a real word beside the absent one makes no phrase."""
    df = read(spark, sf_dir, "documents")
    return df.agg(
        F.count(fuzzy_match("text", ABSENT)).alias("n_absent"),
        F.count_if(admits(F.col("text"), Query.of(ABSENT))).alias("n_admitted"),
        F.count_if(fuzzy_match("text", PRESENT)["score"] <= SCORES["CONTAINS"]).alias("n_present"),
        F.count(fuzzy_match("text", f"{PRESENT} {ABSENT}")).alias("n_phrase"),
    )


def fuzzy_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_parts(spark, sf_dir), "p_partkey", fuzzy_match("p_name", "rewid")).drop("corrected")


QUERIES = {
    "normalise_text": normalise_text,
    "split_words": split_words,
    "tier_exact": _tier("orders", "o_orderkey", "o_orderpriority", "1-URGENT", ("exact",)),
    "tier_normalised_exact": _tier("orders", "o_orderkey", "o_orderpriority", "1-urgent", ("normalised-exact",)),
    "tier_prefix": _tier("nation", "n_nationkey", "n_name", "nation_1", ("prefix",)),
    "tier_boundary_exact": _tier("orders", "o_orderkey", "o_orderpriority", "SPECIFIED", ("boundary-exact",)),
    "tier_boundary": _tier("orders", "o_orderkey", "o_orderpriority", "specified", ("boundary",)),
    "tier_multi_word": _tier("orders", "o_orderkey", "o_orderpriority", "specified 4", ("multi-word",)),
    "tier_acronym": _tier("orders", "o_orderkey", "o_orderpriority", "ns", ("acronym",), acronym=True),
    "tier_contains": _tier("orders", "o_orderkey", "o_orderpriority", "pecif", ("contains",)),
    "literal_ladder": literal_ladder,
    "fuzzy_chain": fuzzy_chain,
    "corrected_swap": _corrected("wigdet"),
    "corrected_deletion": _corrected("widgget"),
    "corrected_substitution": _corrected("wibget"),
    "corrected_insertion": _corrected("wdget"),
    "corrected_phrase": _corrected("red wigdet"),
    "search_top_k": search_top_k,
    "search_multi_field": search_multi_field,
    "rescue_budget": _searched("nation_1"),
    "rescue_within_budget": _searched("nation_2"),
    "search_many": search_many_ranked,
    "mrr": search_mrr,
    "query_join": query_join,
    "gate_funnel": gate_funnel,
    "longtext_guard": longtext_guard,
}

_FOLD = "replace(strip_accents(lower(trim({0}))), 'ł', 'l')"
_LADDER = """CASE WHEN {c} = '{q}' THEN 0.0 WHEN lower({c}) = '{l}' THEN 0.1 WHEN starts_with(lower({c}), '{l}') THEN 0.5
  WHEN regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}_]){q}') THEN 0.9 WHEN regexp_matches(lower({c}), '(^|[^\\p{{L}}\\p{{N}}_]){l}') THEN 1.0
  WHEN contains(lower({c}), '{l}') THEN 2.0 END"""


def _ladder(column: str, query: str) -> str:
    return _LADDER.format(c=column, q=query, l=query.lower())


def _at(table: str, key: str, score: float, tier: str, where: str, ranges: str) -> str:
    return f"SELECT {key}, CAST({score} AS DOUBLE) AS score, '{tier}' AS tier, {ranges} AS ranges FROM {table} WHERE {where}"


ORACLES = {
    "normalise_text": f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents",
    "split_words": r"""SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents)""",
    "tier_exact": _at("orders", "o_orderkey", 0.0, "exact", "o_orderpriority = '1-URGENT'", "'0-7'"),
    "tier_normalised_exact": _at("orders", "o_orderkey", 0.1, "normalised-exact", "o_orderpriority = '1-URGENT'", "'0-7'"),
    "tier_prefix": _at("nation", "n_nationkey", 0.5, "prefix", "starts_with(lower(n_name), 'nation_1') AND lower(n_name) <> 'nation_1'", "'0-7'"),
    "tier_boundary_exact": _at("orders", "o_orderkey", 0.9, "boundary-exact", "contains(o_orderpriority, ' SPECIFIED')", "(strpos(o_orderpriority, 'SPECIFIED') - 1) || '-' || (strpos(o_orderpriority, 'SPECIFIED') + 7)"),
    "tier_boundary": _at("orders", "o_orderkey", 1.0, "boundary", "contains(o_orderpriority, ' SPECIFIED')", "(strpos(o_orderpriority, 'SPECIFIED') - 1) || '-' || (strpos(o_orderpriority, 'SPECIFIED') + 7)"),
    "tier_multi_word": _at("orders", "o_orderkey", 1.5, "multi-word", "list_has_all(regexp_split_to_array(lower(o_orderpriority), '[^a-z0-9_]+'), ['specified', '4'])", "'0-0;' || (strpos(o_orderpriority, 'SPECIFIED') - 1) || '-' || (strpos(o_orderpriority, 'SPECIFIED') + 7)"),
    "tier_acronym": _at("orders", "o_orderkey", 1.8, "acronym", "contains(array_to_string(list_transform(regexp_extract_all(lower(o_orderpriority), '[a-z0-9_]+'), lambda x: x[1]), ''), 'ns')", "(strpos(o_orderpriority, 'NOT') - 1) || '-' || (strpos(o_orderpriority, 'NOT') - 1) || ';' || (strpos(o_orderpriority, 'SPEC') - 1) || '-' || (strpos(o_orderpriority, 'SPEC') - 1)"),
    "tier_contains": _at("orders", "o_orderkey", 2.0, "contains", "contains(lower(o_orderpriority), 'pecif')", "(strpos(lower(o_orderpriority), 'pecif') - 1) || '-' || (strpos(lower(o_orderpriority), 'pecif') + 3)"),
    "search_multi_field": f"""SELECT c_custkey, least(coalesce({_ladder("c_name", "auto")}, 99), coalesce({_ladder("c_mktsegment", "auto")} + 2, 99)) AS score
        FROM customer WHERE contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto')""",
    "literal_ladder": rows_sql("part", "p_partkey", "p_name", "red", "p_partkey, round(score, 4) AS score, tier", search=True),
    "search_top_k": rows_sql("part", "p_partkey", "p_name", "widget", "p_partkey, p_name, round(score, 4) AS score", search=True, end="ORDER BY m.score, p_partkey LIMIT 25"),
    "rescue_budget": rows_sql("nation", "n_nationkey", "n_name", "nation_1", "n_nationkey, round(score, 4) AS score, tier", search=True),
    "rescue_within_budget": rows_sql("nation", "n_nationkey", "n_name", "nation_2", "n_nationkey, round(score, 4) AS score, tier", search=True),
    "fuzzy_chain": rows_sql("part", "p_partkey", "p_name", "rewid", "p_partkey, round(score, 4) AS score, tier, ranges"),
    "gate_funnel": rf"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches({_FOLD.format("text")}, '(?s)(?:(?:^|[^\p{{L}}\p{{N}}_])l.*i.*c.*e.*n.*s.*e.*d|lic.*e.*n.*s.*e.*d)')) AS n_gate,
        count(*) FILTER (WHERE contains({_FOLD.format("text")}, 'licensed')) AS n_literal FROM documents""",
    "longtext_guard": f"""SELECT CAST(0 AS BIGINT) AS n_absent, count(*) FILTER (WHERE {" + ".join(f"CAST(NOT contains({_FOLD.format('text')}, '{c}') AS INTEGER)" for c in sorted({*ABSENT}))} <= 1) AS n_admitted,
        count(*) FILTER (WHERE contains({_FOLD.format("text")}, '{PRESENT}')) AS n_present, CAST(0 AS BIGINT) AS n_phrase FROM documents""",
}
_PART = "p_partkey, round(score, 4) AS score, tier, ranges, corrected"
for _name, _query in (("swap", "wigdet"), ("deletion", "widgget"), ("substitution", "wibget"), ("insertion", "wdget"), ("phrase", "red wigdet")):
    ORACLES[f"corrected_{_name}"] = rows_sql("part", "p_partkey", "p_name", _query, _PART, "tier = 'corrected'")

_RANKED = " UNION ALL ".join(
    f"SELECT '{k}' AS query_id, * FROM ({rows_sql('part', 'p_partkey', 'p_name', q, 'row_number() OVER (ORDER BY m.score, p_partkey) AS rank, p_partkey, p_name, round(score, 4) AS score', search=True)}) WHERE rank <= 10"
    for k, q in PROBES.items()
)
ORACLES["query_join"] = r"""WITH q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS query FROM part),
    s AS (SELECT query, p_partkey, CASE WHEN p_name = query THEN 0.0 WHEN lower(p_name) = lower(query) THEN 0.1 WHEN starts_with(lower(p_name), lower(query)) THEN 0.5
        WHEN regexp_matches(p_name, '(^|[^\p{L}\p{N}_])' || query) THEN 0.9 WHEN regexp_matches(lower(p_name), '(^|[^\p{L}\p{N}_])' || lower(query)) THEN 1.0 ELSE 2.0 END AS score
        FROM q JOIN part ON length(query) >= 2 AND contains(lower(p_name), lower(query)))
    SELECT query, p_partkey, CAST(score AS DOUBLE) AS score, CASE score WHEN 0.0 THEN 'exact' WHEN 0.1 THEN 'normalised-exact' WHEN 0.5 THEN 'prefix' WHEN 0.9 THEN 'boundary-exact'
        WHEN 1.0 THEN 'boundary' ELSE 'contains' END AS tier FROM s"""
ORACLES["search_many"] = _RANKED
_WANTED = ", ".join(f"('{k}', '{v}')" for k, v in WANTED.items())
ORACLES["mrr"] = f"""SELECT round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (SELECT w.q, min(s.rank) AS r FROM (VALUES {_WANTED}) AS w(q, want)
    LEFT JOIN ({_RANKED}) s ON s.query_id = w.q AND s.p_name = w.want GROUP BY w.q)"""
