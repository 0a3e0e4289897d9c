"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierseek.llm.common import let, words_of

SYMBOLS = r"[^#*$%&|<>]+"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with you "
    "auf das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "au aux ce dans de du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con del el es las lo los más no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if the metric lies outside [low, high]."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: metric: an SQL expression over the measured columns; ratios are of words or of lines that hold a word.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.3),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.01, None),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", None, 0.4),
)


def _repeat_words(words: Column, k: int) -> Column:
    """Words covered by k-word windows that occur twice or more: sort (hash, place), keep equal neighbours, merge."""
    n = F.size(words) - F.lit(k - 1)
    grams = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(k)]).alias("h"), i.alias("i")),
    )

    def covered(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        twice = F.filter(s, lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False)))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
        return F.aggregate(
            places,
            zero,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(k), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    return F.when(n < 2, F.lit(0)).otherwise(let(F.sort_array(grams), covered))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines.

    A null text counts as empty. Columns of these names in df are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(F.array_join(w, ""))).alias("word_chars"),
            long(_repeat_words(w, 3)).alias("n_repeat_words"),
            long(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))).alias("n_stop_words"),
        )

    of_lines = lambda x: F.struct(
        long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")
    )
    both = F.struct(let(words_of(F.col(text)), of_words).alias("w"), let(lines, of_lines).alias("l"))
    out = df.withColumns({"__m": both, "n_symbols": long(F.length(F.regexp_replace(t, SYMBOLS, "")))})
    names = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_stop_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    return out.withColumns({n: F.col(f"__m.{p}.{n}") for n, p in names.items()}).drop("__m")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule fails; a metric that can't be computed (no words) fails nothing by itself."""
    ok = F.lit(True)
    for r in rules:
        x = F.expr(r.metric.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"))
        if r.low is not None:
            ok = ok & F.coalesce(x >= F.lit(r.low), F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(x <= F.lit(r.high), F.lit(True))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with its measures, base_failed and kept. Row-local: one projection, no shuffle.

    Null and empty texts have no words, fail the base and aren't kept. Repeated rows are judged one by one;
    extra columns pass through, except that those with a measure's name are replaced.
    """
    m = measure(df, text)
    return m.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)})


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that quality() keeps, with all their columns as they are, whatever these are called."""
    # the row travels whole in one column, so that no measure can replace one of its columns
    judged = quality(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(text).alias("text")), "text", rules)
    return judged.where("kept").select("row.*")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The query in DuckDB."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ok = " AND ".join(
        f"coalesce({r.metric.replace('/ n_words', '/ nullif(n_words, 0)').replace('/ n_lines', '/ nullif(n_lines, 0)')} {op} {v}, true)"
        for r in rules
        for op, v in ((">=", r.low), ("<=", r.high))
        if v is not None
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM h, range(0, 3) AS x(j) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {ok} AS kept FROM b
"""
