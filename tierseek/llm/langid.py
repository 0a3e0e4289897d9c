"""Language identification: known words by their per-language log frequency, unseen ones by ever shorter character n-grams.

A text's units are its words and, of runs of over LONGEST letters, their slices. Every distinct unit of the table is counted once
and given what it says for each language: its own log frequencies if it is a known word, else those of the longest n-grams of it that were
seen in training. A text then adds up its units. Counts, n-grams and what units say are tables joined by key, of any size; only the
most frequent units, at most HEAD of them with HEAD_CELLS entries together, are broadcast, and the others meet their texts in a join.
So the split changes no result, and no joined unit is frequent.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierseek.llm.common import among, let, scratch, table


def _number_signs() -> str:
    """The characters that count as alphanumeric but are neither letters nor digits, as a character class's ranges."""
    signs = [c for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl")]
    starts = [c for i, c in enumerate(signs) if not i or signs[i - 1] != c - 1]
    ends = [c for i, c in enumerate(signs) if i + 1 == len(signs) or signs[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


#: A word is a run of letters. The first pattern also takes number signs such as a superscript two, and is much faster.
RUNS = re.compile(r"[^\W\d_]+")
WORDS = re.compile(rf"[^\W\d_{_number_signs()}]+")
ORDERS = (5, 4, 3, 2, 1)
FLUSH = 300_000
#: A longer run of letters is read in slices, each of which speaks like one unseen word.
LONGEST = 40
STARTS = LONGEST + 2
PRIOR = 0.5
#: Units that are broadcast, and entries (unit, language) of theirs.
HEAD, HEAD_CELLS = 200_000, 1_000_000
ENTRIES = "array<struct<l:int,v:double>>"


def slices_of(word: str) -> list[str]:
    """A word with its ends marked, in slices that share letters, so that each n-gram starts in one slice and lies whole in it."""
    w = f"^{word}$"
    return [w[i : i + STARTS + ORDERS[0] - 1] for i in range(0, max(1, len(w) - ORDERS[0] + 1), STARTS)]


def grams_of(part: str, order: int) -> list[str]:
    """The n-grams that start in a slice; one that is too short has none."""
    n = len(part) - order + 1
    return [part[i : i + order] for i in range(n if part.endswith("$") else min(n, STARTS))]


def units_of(text: str) -> list[str]:
    """The lower-case words of a text; those of over LONGEST letters as slices, with a space before each, which no word holds."""
    words = RUNS.findall(text.lower())
    if words and not "".join(words).isalpha():
        words = WORDS.findall(text.lower())
    if not words or max(map(len, words)) <= LONGEST:
        return words
    return [x for w in words for x in ([w] if len(w) <= LONGEST else [f" {part}" for part in slices_of(w)])]


def marked(unit: str) -> str:
    """A unit as n-grams see it, with the ends of words marked."""
    return unit[1:] if unit.startswith(" ") else f"^{unit}$"


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, lang, n) of the batches, added up in memory until there are FLUSH entries."""
    counts: dict[str | None, Counter] = {}

    def flush() -> pa.RecordBatch:
        sizes = [len(c) for c in counts.values()]
        units = pa.array(list(chain.from_iterable(counts.values())), pa.string())
        langs = pa.array(list(counts), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        n = pa.array(np.fromiter(chain.from_iterable(c.values() for c in counts.values()), np.int64, sum(sizes)))
        counts.clear()
        return pa.RecordBatch.from_arrays([units, langs, n], ["unit", "lang", "n"])

    held = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            c = counts.setdefault(lang, Counter())
            held -= len(c)
            c.update(units_of(text))
            held += len(c)
            if held > FLUSH:
                yield flush()
                held = 0
    yield flush()


def grams_column(order: int) -> Column:
    """grams_of(marked(unit), order) as a column."""
    is_slice = F.startswith("unit", F.lit(" "))
    part = F.when(is_slice, F.substring("unit", 2, 1 << 20)).otherwise(F.concat(F.lit("^"), "unit", F.lit("$")))
    return let(part, lambda p: F.transform(F.sequence(F.lit(1), n_grams(order)), lambda i: F.substring(p, i, F.lit(order))))


def n_grams(order: int) -> Column:
    """How many n-grams start in a unit; 0 for one that is too short."""
    is_slice = F.startswith("unit", F.lit(" "))
    n = F.when(is_slice, F.length("unit") - 1).otherwise(F.length("unit") + 2) - (order - 1)
    return F.greatest(F.lit(0), F.when(is_slice & ~F.endswith("unit", F.lit("$")), F.least(n, F.lit(STARTS))).otherwise(n))


def _exploded(units: DataFrame, order: int, *columns: Column | str) -> DataFrame:
    return units.where(n_grams(order) > 0).select(*columns, F.explode(grams_column(order)).alias("gram"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (unit, o, e) packed into one row for each batch, so that the driver holds bytes and no object for each unit. No unit has a line break."""
    for b in batches:
        e = b["e"]
        flat = e.flatten()
        parts = (b["o"], e.value_lengths(), flat.field("l"), flat.field("v"))
        arrays = [x.to_numpy(zero_copy_only=False).tobytes() for x in parts]
        if len(b):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in ("\n".join(b["unit"].to_pylist()).encode(), *arrays)], list(PACKED))


PACKED = ("units", "orders", "sizes", "langs", "vals")
#: Units of texts whose entries are added up at a time, and texts that are read at a time.
UNITS_AT_ONCE, TEXTS_AT_ONCE = 1 << 16, 256


class Head:
    """What the most frequent units say: their order, and (language, value) entries of each in one array. Pickled as packed, and laid out where it is used."""

    def __init__(self, packed: list[tuple[bytes, ...]], n_langs: int):
        self.packed, self.n_langs = packed, n_langs

    def __setstate__(self, state: dict):
        self.n_langs = state["n_langs"]
        units, *parts = zip(*state["packed"], strict=True) if state["packed"] else [()] * len(PACKED)
        self.at = {u: i for i, u in enumerate(x for block in units for x in block.decode().split("\n"))}
        self.order, self.sizes, self.langs, self.values = (
            np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in xs)]) for kind, xs in zip((np.int32, np.int32, np.int32, float), parts, strict=True)
        )
        self.sizes = self.sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[int]]]:
        """Units of each text, the sums over those of the head (how many of each order, then by language), the others and their counts."""
        counts = [Counter(units_of(t)) if t else {} for t in texts]
        sizes = np.array([len(c) for c in counts], np.int64)
        found = np.fromiter(map(self.at.get, chain.from_iterable(counts), repeat(-1)), np.int64, sizes.sum())
        times = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, sizes.sum())
        text = np.repeat(np.arange(len(texts)), sizes)
        width = len(ORDERS) + 2 + self.n_langs
        sums = np.zeros(len(texts) * width)
        known = np.flatnonzero(found >= 0)
        for k in range(0, len(known), UNITS_AT_ONCE):
            some = known[k : k + UNITS_AT_ONCE]
            i, n, row = found[some], times[some].astype(float), text[some] * width
            size = self.sizes[i]
            at = np.arange(size.sum()) + np.repeat(self.starts[i] - (np.cumsum(size) - size), size)
            keys = np.concatenate([row + self.order[i] + 1, np.repeat(row, size) + self.langs[at] + len(ORDERS) + 2])
            sums += np.bincount(keys, np.concatenate([n, self.values[at] * np.repeat(n, size)]), len(sums))
        rest, rest_times = [[] for _ in texts], [[] for _ in texts]
        others = [list(counts[t]) if few else None for t, few in enumerate(np.bincount(text[found < 0], minlength=len(texts)))]
        starts = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(found < 0).tolist():
            t = text[k]
            rest[t].append(others[t][k - starts[t]])
            rest_times[t].append(int(times[k]))
        return np.bincount(text, times, len(texts)).astype(np.int64), sums.reshape(len(texts), width), rest, rest_times


def _read(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, row = shared.value, TaskContext.get().partitionId() << 33
        for whole in batches:
            for k in range(0, len(whole), TEXTS_AT_ONCE):
                b = whole.slice(k, TEXTS_AT_ONCE)
                units, sums, rest, times = head.read(b["__text"].to_pylist())
                at, key = np.nonzero(sums)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(b)))]), pa.int32())
                state = {
                    "__row": pa.array(np.arange(row, row + len(b))), "__units": pa.array(units),
                    "__keys": pa.ListArray.from_arrays(ends, pa.array(key, pa.int32())), "__vals": pa.ListArray.from_arrays(ends, pa.array(sums[at, key])),
                    "__rest": pa.array(rest, pa.list_(pa.string())), "__times": pa.array(times, pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), *state.values()], [*columns, *state])
                row += len(b)

    return run


def _judge(langs: list[str], base: np.ndarray, columns: list[str]):
    """base[o]: what a unit of order o adds for each language whatever it is. Order -1, of units without any known n-gram, adds nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_orders = len(ORDERS) + 2
        for b in batches:
            out = []
            for units, *pairs in zip(b["__units"], b["__keys"], b["__vals"], b["__more_keys"], b["__more_vals"], strict=True):
                if not units or not langs:
                    out.append(("und", 0.0))
                    continue
                keys = np.concatenate([x for x in pairs[::2] if x is not None]).astype(np.int64)
                sums = np.bincount(keys, np.concatenate([x for x in pairs[1::2] if x is not None]), n_orders + len(langs))
                total = sums[n_orders:] + sums[1:n_orders] @ base
                best = int(total.argmax())
                # at the weight of sqrt(n) units, so that long texts do not all reach 1
                p = np.exp((total - total[best]) / max(1.0, math.sqrt(units)))
                out.append((langs[best], float(1.0 / p.sum())))
            yield b[columns].assign(lang_pred=[x for x, _ in out], score=[x for _, x in out])

    return run


def learn(units: DataFrame) -> tuple[list[str], np.ndarray, DataFrame]:
    """(languages, base, said) from units (unit, total, seen: array<struct<lang, n>>).

    said: unit, total, o, e for every unit: the order that speaks for it (0: itself, -1: nothing) and its entries by language.
    """
    spark = units.sparkSession
    is_word = ~F.startswith("unit", F.lit(" "))
    totals = units.where(is_word).select(F.explode("seen").alias("s")).groupBy("s.lang").agg(F.sum("s.n").alias("n"))
    counted = units.where(F.size("seen") > 0).select("unit", F.explode("seen").alias("s")).select("unit", "s.lang", "s.n")
    of_words = {r[0]: float(r[1]) for r in totals.collect()}  # a row for each language
    sums = counted.groupBy("lang").agg(*[F.sum(F.col("n") * n_grams(o)).alias(str(o)) for o in ORDERS]).collect()
    of_grams = {(o, r["lang"]): float(r[str(o)]) for r in sums for o in ORDERS if r[str(o)]}
    langs = sorted(of_words | {lang: 0.0 for _, lang in of_grams})
    weights = {0: 1.0} | {o: o / (ORDERS[0] + 1) for o in ORDERS}  # n-grams say less than a whole word, and shorter ones less still
    base = np.array([[-weights[o] * math.log((max(1.0, of_words.get(x, 1.0) if not o else of_grams.get((o, x), 1.0)) + PRIOR) / PRIOR) for x in langs] for o in range(len(ORDERS) + 1)])
    base = base.reshape(len(ORDERS) + 1, len(langs))
    if not langs:
        return [], base, units.select("unit", "total", F.lit(-1).alias("o"), F.array().cast(ENTRIES).alias("e"))
    index = F.map_from_arrays(F.array(*[F.lit(x) for x in langs]), F.array(*[F.lit(i) for i in range(len(langs))]))
    entries = F.transform("seen", lambda s: F.struct(F.element_at(index, s["lang"]).alias("l"), F.log((s["n"] + PRIOR) / PRIOR).alias("v"))).cast(ENTRIES)
    own = is_word & (F.size("seen") > 0)
    said = units.where(own).select("unit", "total", F.lit(0).alias("o"), entries.alias("e"))
    rest = units.where(~own).select("unit", "total")
    for o in ORDERS:
        pairs = table(_exploded(rest, o, "unit"))
        # only n-grams that some unit asks for are counted
        asked = among(_exploded(counted, o, "lang", "n"), "gram", pairs.select("gram").distinct())
        of_order = asked.groupBy("gram", "lang").agg(F.sum("n").alias("n")).groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("seen"))
        met = pairs.join(of_order.select("gram", entries.alias("e")), "gram")
        met = met.groupBy("unit").agg(F.count(F.lit(1)).alias("found"), F.flatten(F.collect_list("e")).alias("e"))
        scaled = F.transform("e", lambda x: F.struct(x["l"].alias("l"), (x["v"] * weights[o] / F.col("found")).alias("v"))).cast(ENTRIES)
        tried = table(rest.join(met, "unit", "left").select("unit", "total", "found", scaled.alias("e")))
        said = said.unionByName(tried.where("found is not null").select("unit", "total", F.lit(o).alias("o"), "e"))
        rest = tried.where("found is null").select("unit", "total")
        if not rest.limit(1).count():
            break
    return langs, base, said.unionByName(rest.select("unit", "total", F.lit(-1).alias("o"), F.array().cast(ENTRIES).alias("e")))


def identify(docs: DataFrame, teaches: Column, columns: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """columns of docs, lang_pred and score of each row, learnt from the rows where teaches is true.

    Rows with a null text or lang teach nothing. A prediction depends on the row's text alone. `und` with score 0 for a text that is null or has
    no letter, or when nothing could be learnt. Repeated rows count as often as they occur; ties go to the language that sorts first.
    An empty table gives no rows. Of languages there may be as many as fit a map literal and one array for each text.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        with scratch(spark) as keep_units:
            label = F.when(F.coalesce(teaches, F.lit(False)), F.col(lang)).cast("string")
            raw = docs.where(F.col(text).isNotNull()).select(label.alias("lang"), F.col(text).cast("string").alias("text"))
            # dealt by unit alone, so that both sums need one exchange
            counts = raw.mapInArrow(_count_units, "unit string, lang string, n long").repartition("unit")
            counts = counts.groupBy("unit", "lang").agg(F.sum("n").alias("n"))
            seen = F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "n"))).alias("seen")
            units = table(counts.groupBy("unit").agg(F.sum("n").alias("total"), seen))
            langs, base, said = learn(units)
            said = keep_units(said.withColumn("bin", F.floor(F.log2("total") * 8).cast("int")))
        # whole bins of frequency go to the head, from the top, as long as they fit
        first, n_units, n_cells = 1 << 30, 0, 0
        for b, n, cells in sorted(map(tuple, said.groupBy("bin").agg(F.count(F.lit(1)), F.sum(F.size("e"))).collect()), reverse=True):
            n_units, n_cells = n_units + n, n_cells + cells
            if n_units > HEAD or n_cells > HEAD_CELLS:
                break
            first = b
        packed = said.where(F.col("bin") >= first).select("unit", "o", "e").mapInArrow(_packed, ", ".join(f"{c} binary" for c in PACKED))
        shared = spark.sparkContext.broadcast(Head([tuple(map(bytes, r)) for r in packed.collect()], len(langs)))
        renamed = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)], F.col(text).cast("string").alias("__text"))
        names = renamed.columns[:-1]
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields[:-1])
        state = "__row long, __units long, __keys array<int>, __vals array<double>, __rest array<string>, __times array<long>"
        read = table(renamed.mapInArrow(_read(shared, names), f"{kinds}, {state}"))
        pairs = read.select("__row", F.explode(F.arrays_zip("__rest", "__times")).alias("p")).select("__row", F.col("p.__rest").alias("unit"), F.col("p.__times").alias("n"))
        met = pairs.join(said.where(F.col("bin") < first).select("unit", "o", "e"), "unit")
        keys = F.concat(F.array(F.col("o") + 1), F.transform("e", lambda x: x["l"] + len(ORDERS) + 2))
        vals = F.concat(F.array(F.col("n").cast("double")), F.transform("e", lambda x: x["v"] * F.col("n")))
        # a text's units are no more than its row holds
        more = met.select("__row", keys.alias("k"), vals.alias("v")).groupBy("__row").agg(F.flatten(F.collect_list("k")).alias("__more_keys"), F.flatten(F.collect_list("v")).alias("__more_vals"))
        both = read.drop("__rest", "__times").join(more, "__row", "left")
        done = keep(both.mapInPandas(_judge(langs, base, names), f"{kinds}, lang_pred string, score double"))
        shared.unpersist()
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def langid_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learnt from the rows that aren't held out.

    A null lang or text teaches nothing; a null doc_id counts as not held out but isn't learnt from. See identify() for other cases;
    extra columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(rows, ~F.col("held_out") & F.col("doc_id").isNotNull(), ["doc_id", "held_out"])
