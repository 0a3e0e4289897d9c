"""Ranked search over DataFrames: several weighted fields, the correction budget, typing sessions, many queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierseek.functions import fold as T
from tierseek.functions.fold import fold_table
from tierseek.functions.scores import BUDGET, MIN_QUERY, MIN_TYPO, SCORES
from tierseek.operators.match import MATCH, Query, W, _q, admits, fuzzy_match, ladder, let, match_of, matching, prepared

#: The longest runs of characters on which rows meet a table of queries.
GRAM = 3
#: Places of the filter of such runs (512 kB however many there are), and how many tasks share the texts that hold one run.
PLACES, PER_ROW, SHARES = 1 << 22, 1 << 15, 16


@dataclass(frozen=True)
class FieldSpec:
    """One field: a column name or expression, whether acronyms count, and the best score that it can give (added to each match)."""

    col: Column | str
    acronym: bool = False
    at_best: float = 0.0

    def column(self) -> Column:
        return F.col(self.col) if isinstance(self.col, str) else self.col


def _specs(fields) -> list[FieldSpec]:
    fields = [fields] if isinstance(fields, str | Column | FieldSpec) else list(fields)
    return [f if isinstance(f, FieldSpec) else FieldSpec(f) for f in fields]


def gate(norm: Column, query: Query) -> Column:
    """True for every text that the query can match without a correction or an acronym. False passes are possible.

    One word: its characters in order, the first of them at a word's start or with the next two behind it. Several words: each of their characters.
    """
    if len(query.words) > 1:
        return reduce(lambda a, b: a & b, [F.contains(norm, F.lit(c)) for c in dict.fromkeys("".join(query.words))], F.lit(True))
    c = [_q(x) for x in query.text]
    rest = "".join(f"[^{x}]*+{x}" for x in c[1:])
    return norm.rlike(f"(?:(?<!{W}){c[0]}{rest}|{''.join(c[:3])}{''.join(f'[^{x}]*+{x}' for x in c[3:])})")


def _covered(query: Query) -> bool:
    """One word whose characters the fold table reaches: ASCII ones."""
    return len(query.words) == 1 and query.text.isascii()


class FuzzyIndex:
    """A DataFrame and the fields to search. Rows come back with all their columns, score and fields (a MATCH or null for each field).

    prepare() writes the folded fields out once for repeated searches. key names the columns that break ties between equal scores.
    """

    def __init__(self, df: DataFrame, fields, key: str | list[str] | None = None):
        self.specs, self.key = _specs(fields), [key] if isinstance(key, str) else list(key or [])
        self.columns = df.columns
        self.source = df if not self.specs else df.withColumns({f"__p{i}": F.when(s.column().isNotNull(), prepared(s.column())) for i, s in enumerate(self.specs)})

    def prepare(self) -> FuzzyIndex:
        """Keep the folded fields: each later search reads them instead of folding again."""
        self.source = self.source.persist()
        return self

    def empty(self) -> DataFrame:
        out = self.source.where(F.lit(False)).select(*self.columns)
        return out.withColumns({"score": F.lit(0.0), "fields": F.array().cast(f"array<{MATCH}>")})

    def matches(self, query: Query, rescue: bool | Column, source: DataFrame | None = None) -> DataFrame:
        """The rows that match, unordered. rescue may be a column of one value, such as a scalar subquery."""

        def one(i: int, s: FieldSpec) -> Column:
            m = match_of(F.col(f"__p{i}"), query, s.acronym, rescue)
            priced = let(m, lambda x: F.when(x.isNotNull(), x.withField("score", x["score"] + s.at_best)))
            return F.when(F.col(f"__p{i}").isNotNull(), priced).cast(MATCH)

        rows = self.source if source is None else source
        lazily = isinstance(rescue, Column)
        if query.text:
            rows = rows.where(reduce(lambda a, b: a | b, [admits(s.column(), query, lazily or rescue) for s in self.specs]))
        if lazily:  # a subquery must not stand inside a lambda function
            rows, rescue = rows.withColumn("__on", rescue), F.col("__on")
        fields = F.array(*[one(i, s) for i, s in enumerate(self.specs)])
        best = lambda f: F.array_min(F.array_compact(F.transform(f, lambda m: m["score"])))
        hit = let(fields, lambda f: F.when(best(f).isNotNull(), F.struct(best(f).alias("score"), f.alias("fields"))))
        return matching(rows, hit, "__hit").select(*self.columns, "__hit.score", "__hit.fields")

    def ordered(self, found: DataFrame, limit: int | None) -> DataFrame:
        out = found.orderBy("score", *self.key)
        return out if limit is None else out.limit(limit)

    def rescues(self, query: Query, source: DataFrame | None = None) -> bool | Column:
        """Whether corrections are looked for: not for a short single word, nor once BUDGET rows hold the query literally.

        The count is a scalar subquery that stops at BUDGET rows: it runs with the search, not when the search is built.
        """
        if _covered(query) and len(query.text) < MIN_TYPO:
            return False
        if query.longest() < MIN_TYPO - 1:
            return False
        literal = self.matches(query, False, source).where(F.col("score") <= SCORES["CONTAINS"])
        return literal.limit(BUDGET).agg(F.count(F.lit(1)) < BUDGET).scalar()

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """Rows by score and then key, as one lazy plan. A folded query of under two characters, and an index without fields, find nothing."""
        q = Query.of(query)
        if len(q.text) < MIN_QUERY or not self.specs:
            return self.empty()
        return self.ordered(self.matches(q, self.rescues(q)), limit)

    def session(self) -> SearchSession:
        return SearchSession(self)


class SearchSession:
    """Searches while a query is typed. Results equal fresh searches; a query that extends the last one reads the rows that passed its gate."""

    def __init__(self, index: FuzzyIndex):
        self.index, self.last, self.survivors = index, None, None

    def _gate(self, q: Query) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(gate(F.col(f"__p{i}")["norm"], q), F.lit(False)) for i in range(len(self.index.specs))])

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        q, index = Query.of(query), self.index
        if len(q.text) < MIN_QUERY or not index.specs:
            return index.empty()
        extends = self.last is not None and q.text.startswith(self.last.text) and (len(q.words) > 1) == (len(self.last.words) > 1) and not any(s.acronym for s in index.specs)
        source = self.survivors if extends else index.source
        acronyms = any(s.acronym for s in index.specs)
        passed = index.source if acronyms else source.where(self._gate(q)).persist()
        found = index.matches(q, False, passed)
        # corrections look at rows that the gate drops, so whether they are wanted is settled first
        literal = found.where(F.col("score") <= SCORES["CONTAINS"]).limit(BUDGET).count()
        self._free()
        self.last, self.survivors = q, passed
        if not isinstance(index.rescues(q, passed), bool) and literal < BUDGET:
            return index.ordered(index.matches(q, True), limit)
        return index.ordered(found, limit)

    def _free(self) -> None:
        """Unpersist the last query's survivors; those of this query have been read from them by now."""
        if self.survivors is not None and self.survivors is not self.index.source:
            self.survivors.unpersist()

    def close(self) -> None:
        self._free()
        self.last = self.survivors = None


def parity(df: DataFrame, text: str, key: str, query: str) -> DataFrame:
    """key, side of the rows that search and the per-row match disagree on, for a query within the budget of corrections; none, if all is well."""
    index = FuzzyIndex(df.select(key, text), text, key)
    searched = index.matches(Query.of(query), True).select(key, F.round("score", 9).alias("score"))
    each = matching(df.select(key, text), fuzzy_match(text, query), "__m").select(key, F.round("__m.score", 9).alias("score"))
    return searched.exceptAll(each).withColumn("side", F.lit("search")).unionByName(each.exceptAll(searched).withColumn("side", F.lit("match")))


def search_many(index: FuzzyIndex, queries: dict[str, str], limit: int | None = None) -> DataFrame:
    """query_id, rank, score and the row, for each of a bounded list of queries. Ranks restart with each query."""
    parts = [index.search(text, limit).drop("fields").withColumn("query_id", F.lit(name)) for name, text in queries.items()]
    if not parts:
        return index.empty().drop("fields").withColumns({"query_id": F.lit(""), "rank": F.lit(0)})
    found = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", *index.key))
    return found.withColumn("rank", rank)


def fuzzy_join(df: DataFrame, queries: DataFrame, text: str, query: str = "query", limit: int | None = None, key: str | list[str] | None = None) -> DataFrame:
    """asked (a row of queries as a struct), found (a row of df as a struct), score, tier, ranges: the literal matches of a table of queries of any size.

    One lazy plan. A literal match holds every run of up to GRAM characters of the query's words, so texts meet a query on the one of these runs that
    fewest texts hold, and only they are matched; equal texts are matched once. Initials, the chain and corrections depend on a query that is known when
    the plan is built: see search(). Files say too little about the size of what is made from them, so only a filter of fixed size is ever broadcast.
    A null query, one of under two characters, and a null text match nothing; repeated queries are matched once and each get all rows. With a limit
    each query keeps its best rows, ties by the columns of df that key names.
    """
    keys = [key] if isinstance(key, str) else list(key or [])
    asked = queries.select(F.struct(*[queries[c] for c in queries.columns]).alias("asked"), T.trim(queries[query]).alias("raw"), T.normalise_text(queries[query]).alias("q"))
    asked = asked.where(F.length("q") >= MIN_QUERY)
    words = T.split_words(F.col("q"))
    # a query without any word characters is looked for by its own runs
    texts = asked.select("raw", "q", words.alias("words"), F.when(F.size(words) > 0, words).otherwise(F.array("q")).alias("units")).distinct()
    width = F.least(F.array_max(F.transform("units", lambda u: F.length(u))), F.lit(GRAM))
    runs = texts.withColumn("width", width).select("raw", F.explode(F.array_distinct(F.flatten(F.transform("units", lambda u: _runs(u, F.col("width")))))).alias("gram"))

    rows = df.where(df[text].isNotNull()).select(df[text].alias("text"), F.struct(*[df[c] for c in df.columns]).alias("found"))
    held = df.select(df[text].alias("text")).where("text is not null").distinct().select("text", prepared(F.col("text")).alias("p"))
    every = F.array_distinct(F.concat(*[_runs(F.col("p")["norm"], F.lit(n)) for n in range(1, GRAM + 1)]))
    counted = _perhaps(held.select(F.explode(every).alias("gram")), "gram", runs).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = runs.hint("merge").join(counted, "gram", "left").groupBy("raw").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))

    # a frequent run is shared out by the texts that hold it
    share = F.pmod(F.xxhash64("text"), F.lit(SHARES)).cast("int")
    meeting = texts.drop("units").hint("merge").join(rarest, "raw").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    near = _perhaps(held.select("text", "p", F.explode(every).alias("gram")), "gram", rarest).withColumn("share", share)
    near = near.hint("merge").join(meeting, ["gram", "share"])
    p = F.col("p")
    hit = F.when(F.contains(p["norm"], F.col("q")) | (F.size("words") > 1), ladder(p["field"], p["norm"], F.col("raw"), F.col("q"), F.col("words"), False).cast(MATCH))
    best = matching(near, hit, "m")
    shifted = F.transform("m.ranges", lambda r: F.struct((r["start"] + p["lead"]).alias("start"), (r["end"] + p["lead"]).alias("end")))
    best = best.select("raw", "text", "m.score", "m.tier", shifted.alias("ranges"))
    if limit is None:
        return rows.hint("merge").join(asked.select("asked", "raw").hint("merge").join(best, "raw"), "text").select("asked", "found", "score", "tier", "ranges")
    order = Window.partitionBy("raw").orderBy("score", *[F.col("found")[k] for k in keys])
    best = rows.hint("merge").join(best, "text").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return asked.select("asked", "raw").hint("merge").join(best, "raw").select("asked", "found", "score", "tier", "ranges")


def _perhaps(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key is in the column of the same name of wanted, and a few others: a bitmap of hashed keys, of a fixed size, is broadcast."""
    place = F.pmod(F.xxhash64(key), F.lit(PLACES))
    row, bit = F.floor(place / PER_ROW).cast("int"), (place % PER_ROW).cast("int")
    bits = wanted.select(row.alias("__row"), bit.alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.withColumn("__row", row).join(F.broadcast(bits), "__row").where(F.getbit(byte, bit % 8) == 1).select(df.columns)


def _runs(text: Column, n: Column) -> Column:
    """All runs of n characters; none of a shorter text."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def mrr(ranked: DataFrame, wanted: dict[str, object], column: str, at: int = 10) -> DataFrame:
    """Mean reciprocal rank of the wanted rows (query_id -> value of column); 0 past at and for what wasn't found."""
    spark = ranked.sparkSession
    want = spark.createDataFrame([(q, v) for q, v in wanted.items()], ["query_id", "__want"])
    first = ranked.join(F.broadcast(want), "query_id").where(F.col(column) == F.col("__want")).groupBy("query_id").agg(F.min("rank").alias("rank"))
    got = want.join(first, "query_id", "left")
    return got.agg(F.avg(F.when(F.col("rank") <= at, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"))


def funnel(df: DataFrame, text: str, query: str) -> DataFrame:
    """n_rows, n_gate, n_literal, n_match: rows that survive each step for one query, in one aggregate."""
    q = Query.of(query)
    rows = df.select(F.when(F.col(text).isNotNull(), prepared(F.col(text))).alias("p"))
    rows = rows.select(F.coalesce(gate(F.col("p")["norm"], q), F.lit(False)).alias("g"), match_of(F.col("p"), q, rescue=False)["score"].alias("s"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("g").alias("n_gate"), F.count_if(F.col("s") <= SCORES["CONTAINS"]).alias("n_literal"), F.count("s").alias("n_match"))


def unfold() -> dict[str, str]:
    """For each folded character, the characters that fold to it."""
    out: dict[str, str] = {}
    for a, b in zip(*fold_table(), strict=True):
        out[b] = out.get(b, "") + a
    return out
