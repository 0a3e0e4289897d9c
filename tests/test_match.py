"""fuzzy_match against plain loops over the rules, on made-up texts; the tier names of some own cases; invariants."""

import random

import pyref
import pytest
from pyspark.sql import functions as F

from tierseek.functions.scores import SCORES, TYPO_PENALTY
from tierseek.operators import match as M
from tierseek.operators.match import fuzzy_match
from tierseek.operators.search import parity
from tierseek.plans import probes as P

#: Own texts: one for each tier, and what stands in the way of some.
TEXTS = [
    "Harbour light", "harbour light", "Harbour lights", "Old harbour light", "OLD HARBOUR LIGHT", "light over the harbour", "unharboured lightning", "harb_our light",
    "harbuor light", "harbor light", "harbourr light", "hxrbour light", "h4rb0ur l1ght 1987", "  \tpadded harbour light\n", "Hafen Größe Straße ÉTÉ été", "Eté à la plage",
    "line one\nharbour\nlight", "\\Eharbour\\Q light \\E", "a.b*c(d)[e]{f}^$|?+", "o’clock “late”", "under_score_name 42_a", "ΤΕΛΟΣ ς", "", " ", None, "x",
    "Hilda's Lamp Ltd", "half lit harbour in the grey light of a cold morning " * 30 + "lantern",
]
QUERIES = [
    "harbour", "Harbour Light", "harbuor", "habour", "harbouur", "harbxur", "light harbour", "harbour ligth", "hl", "hll", "ete", "o'clock", "\\E", "name", "42", "1987", "1988", "lanterm", "hi", "τελος", "x",
]


def spoken(rows, text="t"):
    return {r["i"]: None if r["m"] is None else (round(r["m"]["score"], 6), r["m"]["tier"], r["m"]["corrected"], [(x["start"], x["end"]) for x in r["m"]["ranges"]]) for r in rows}


def told(texts, query, acronym):
    found = [pyref.match(t, query, acronym) for t in texts]
    return {i: None if m is None else (round(m[0], 6), *m[1:]) for i, m in enumerate(found)}


def answers(spark, texts, queries, acronym):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).persist()
    for q in queries:
        got = spoken(df.select("i", fuzzy_match("t", q, acronym).alias("m")).collect())
        want = told(texts, q, acronym)
        assert got == want, (q, [(texts[i], got[i], want[i]) for i in got if got[i] != want[i]][:3])
    df.unpersist()


@pytest.mark.parametrize("acronym", [False, True])
def test_own_texts_equal_plain_loops(spark, acronym):
    answers(spark, TEXTS, QUERIES if not acronym else ["hl", "hll", "olh", "harbour"], acronym)


def test_random_texts_equal_plain_loops(spark):
    r = random.Random(31)
    letters = "abcde" * 6 + "é_ 19-'\n" + "  "
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = [make(r.choice([3, 8, 20, 40, 90])) for _ in range(600)]
    some = lambda: (t := r.choice(texts))[(i := r.randrange(max(1, len(t) - 6))) : i + r.choice([3, 4, 5, 6, 8])]
    queries = [make(r.choice([2, 4, 5, 7])) for _ in range(6)] + [some() for _ in range(6)] + [P.transposed(some()) for _ in range(4)] + [P.doubled(some()) for _ in range(3)] + [some() + " " + P.substituted(some()) for _ in range(4)]
    answers(spark, texts, [q for q in queries if q.strip()], False)


def test_tiers_and_prices(spark):
    df = spark.createDataFrame([(0, "quiet river bank")], "i int, t string")
    tiers = {"quiet river bank": "exact", "QUIET river bank": "normalised-exact", "Qui": "prefix", "river": "boundary-exact", "River": "boundary", "bank quiet": "multi-word", "iver": "contains", "rivre": "corrected", "quban": "fuzzy"}
    got = {q: df.select(fuzzy_match("t", q)["tier"]).first()[0] for q in tiers}
    assert got == tiers and max(SCORES.values()) < TYPO_PENALTY
    assert df.select(fuzzy_match("t", "rivxx")).first()[0] is None  # two edits are refused


def test_variants_are_distinct_and_in_order():
    got = M._variants("aabbc", "AabbC")
    assert [v for v, *_ in got] == list(dict.fromkeys(v for v, *_ in got)) and [d for *_, d in got] == sorted(d for *_, d in got)
    assert got[0] == ("ababc", "AbabC", False) and ("aabb", "Aabb", True) in got and M._variants("abcd", "abcd")[-1][2] is False


def test_utf16_ranges(spark):
    df = spark.createDataFrame([("\U0001f600 red \U0001f600 tea",)], "t string")
    span = lambda **how: [tuple(x) for x in df.select(fuzzy_match("t", "tea", **how)["ranges"]).first()[0]]
    assert span() == [(8, 10)] and span(utf16=True) == [(10, 12)]


def test_char_mask(spark):
    masks = [r[0] for r in spark.createDataFrame([("abza",), ("0459",), ("é",), ("",)], "t string").select(M.char_mask(F.col("t"))).collect()]
    assert masks == [0b11 | 1 << 25, 1 << 26 | 1 << 27, 1 << (30 + ord("é") % 2), 0] and M.is_exact_mask(masks[0]) and not M.is_exact_mask(masks[1])


def test_probes_and_edit_kinds(spark):
    pairs = [("abcd", "abcd", "same"), ("abcd", "abxd", "substitution"), ("abcd", "acbd", "swap"), ("abd", "abcd", "insertion"), ("abccd", "abcd", "deletion"), ("abcd", "badc", None), ("abc", "abcde", None)]
    got = spark.createDataFrame(pairs, "a string, b string, k string").select(P.edit_kind(F.col("a"), F.col("b")).alias("got"), "k").collect()
    assert [r["got"] for r in got] == [r["k"] for r in got]
    df = spark.createDataFrame([(1, "blue kettle"), (2, None), (3, " ")], "id int, t string").coalesce(1)
    found = {k: q for k, _, q in P.probes(df, "t", "id")}
    assert found == {"text": "blue kettle", "first_word": "blue", "longest_word": "kettle", "transposed": "ktetle", "doubled": "keettle", "substituted": "kxttle", "every_other": "ktl"}


def test_search_equals_each_match(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string").coalesce(1)
    for q in ("harbuor", "harbour ligth", "lanterm"):
        assert parity(df, "t", "id", q).collect() == []
