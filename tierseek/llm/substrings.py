"""Substring dedup by suffix trees over the repeated parts of texts.

A window of ``window`` words is represented by its anchor: the GRAM-word run in it with the least hash. Equal windows have
equal anchors at equal places, so suffixes only need to meet where an anchor recurs, which leaves about 2 / (window - GRAM)
of all positions to shuffle. The words around an anchor that its windows reach are its context. Equal contexts collapse to one with
the smallest doc_id, so copies cost one row each. Different contexts of an anchor meet in one group of a bounded number of words, and the
group's suffixes make a subtree: their sorted order and the lengths of their common prefixes. Its deep internal nodes, those of
``window`` words or more, are the maximal repeats; the windows below one take its least doc_id.

The prefix that deals suffixes into groups has one of two lengths: the anchor's run, or, for an anchor with too many contexts, all words of the
window. Below a prefix of that length there is a single node, so its group is a sum and is added up before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierseek.llm.common import U64, gram_hashes, mix, scratch, table, word_hashes

GRAM = 8
#: Words of context in one group of suffixes, and contexts of one anchor that share a group.
GROUP_WORDS, MOST_CONTEXTS = 400_000, 20_000
#: What is known of a repeated context in a document.
MARK = ("start", "n", "c", "first", "plain", "others")
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


class Runs:
    """Hashes of runs of words, any start and length, from prefix sums modulo 2^64."""

    def __init__(self, h: np.ndarray):
        h = mix(h + U64(1))
        power = np.cumprod(np.full(len(h) + 1, BASE)) * BASE_INVERSE
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * power[: len(h)], dtype=U64)])
        self.back = np.cumprod(np.full(len(h) + 1, BASE_INVERSE)) * BASE

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + mix((end - start).astype(U64)))


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor's place, first window start, number of windows and hash, for each anchor of a text's words."""
    g = gram_hashes(h, min(GRAM, window))
    view = np.lib.stride_tricks.sliding_window_view(g, window - min(GRAM, window) + 1)
    at = np.arange(len(view)) + view.argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.diff(np.append(first, len(at))), g[at[first]]


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _find(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                h = word_hashes(_bytes(text))
                if len(h) < window:
                    continue
                at, first, n, a = anchors(h, window)
                parts.append((a.astype(np.int64), _prints(h, at, first, n, window), np.full(len(at), doc_id, np.int64), first, n))
            if parts:
                yield pd.DataFrame(dict(zip(("h", "c", "doc_id", "start", "n"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    return run


def _fetch(window: int):
    """The word hashes of the contexts that are asked for, from their documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, h, c, start, n, many in zip(*(b[x] for x in ("doc_id", "text", "h", "c", "start", "n", "many")), strict=True):
                x = word_hashes(_bytes(text))
                for i in np.flatnonzero(_holds(x, start, n, c, window)):
                    end = start[i] + n[i] + window - 1
                    out.append((h[i], c[i], doc_id, n[i], many[i], x[start[i] : end].tobytes()))
            yield pd.DataFrame(out, columns=["h", "c", "doc_id", "n", "many", "words"])

    return run


def _prints(h: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Hashes of contexts: their words and where the anchor stands in them."""
    return mix(Runs(h).of(first, first + n + window - 1) + (at - first).astype(U64)).astype(np.int64)


def _holds(h: np.ndarray, start: np.ndarray, n: np.ndarray, c: np.ndarray, window: int) -> np.ndarray:
    """Which contexts (start, number of windows, hash) a text has. Of rows that share a doc_id, another may be meant."""
    if len(h) < window:
        return np.zeros(len(start), bool)
    at, first, count, _ = anchors(h, window)
    i = np.minimum(np.searchsorted(first, start), len(first) - 1)
    return (first[i] == start) & (count[i] == n) & (_prints(h, at[i], first[i], count[i], window) == c)


def subtree(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of texts (arrays of word hashes): each one's place in sorted order, that order, and the common prefix with the next one.

    Suffixes are places in the texts put one after the other, and end with their text. Prefix doubling: names at 1, 2, 4, ... words, in the order of
    the words they stand for, until all words of the longest text are named; common prefixes are then read off the names from the longest down.
    """
    sizes = np.array([len(x) for x in texts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    _, name = np.unique(np.concatenate(texts), return_inverse=True)
    name = name.astype(np.int64) + 1
    levels, have = [name], 1
    n = len(name)
    while have < sizes.max():
        on = np.arange(n) + have
        behind = np.where(on < ends, name[np.minimum(on, n - 1)], 0)  # 0: the text is over
        _, name = np.unique(name * (n + 1) + behind, return_inverse=True)
        name = name.astype(np.int64) + 1
        levels.append(name)
        have *= 2
    order = np.argsort(name, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        # names of texts' ends stand for fewer words than their level says
        whole = (x + (1 << i) <= ends[a]) & (y + (1 << i) <= ends[b])
        same = whole & (levels[i][np.minimum(x, n - 1)] == levels[i][np.minimum(y, n - 1)])
        common[same] += 1 << i
    return place, order, common


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The topmost internal nodes of depth words or more: the node of each suffix in sorted order, and each node's own depth (0: a leaf alone)."""
    node = np.concatenate([[0], np.cumsum(common < depth)])
    length = np.full(int(node[-1]) + 1, np.iinfo(np.int64).max)
    inner = common >= depth
    np.minimum.at(length, node[1:][inner], common[inner])
    return node, np.where(length == np.iinfo(np.int64).max, 0, length)


def _tree(window: int):
    """Least doc_id over the suffixes below each deep node, for all contexts of a group of anchors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(x, U64) for x in rows["words"]]
        sizes = np.array([len(x) for x in texts])
        n = rows["n"].to_numpy()
        starts = np.cumsum(sizes) - sizes
        place, order, common = subtree(texts)
        node, _ = deep_nodes(common, window)
        which = np.repeat(np.arange(len(rows)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[which]
        # only suffixes of a whole window count; the others lie below no deep node
        docs = rows["doc_id"].to_numpy()
        low = np.full(int(node[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, node[place[at]], docs[which])
        least, ends = low[node[place[at]]], np.cumsum(n)
        return pd.DataFrame({"h": rows["h"], "c": rows["c"], "least": [least[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]})

    return run


def _windows(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for h, c, doc_id, n, words in zip(b["h"], b["c"], b["doc_id"], b["n"], b["words"], strict=True):
                i = np.arange(n)
                w = Runs(np.frombuffer(words, U64)).of(i, i + window)
                parts.append(pd.DataFrame({"h": h, "c": c, "i": i, "w": w.astype(np.int64), "doc_id": doc_id}))
            if parts:
                yield pd.concat(parts)

    return run


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, marks: array<struct<start, n, c, least, first>> of documents with windows that start in an earlier document.

    Of the n windows from start on, the i-th is a repeat if least[i] (or first, where least is null) is below doc_id.
    """
    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = table(known.mapInPandas(_find(window), "h long, c long, doc_id long, start long, n int"))
    contexts = found.groupBy("h", "c").agg(F.min(F.struct("doc_id", "start", "n")).alias("r"), F.max("doc_id").alias("last"))
    contexts = table(contexts.select("h", "c", F.col("r.doc_id").alias("first"), F.col("r.start").alias("start"), F.col("r.n").alias("n"), "last"))
    by_anchor = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("first").alias("low"), F.max("last").alias("high"), F.min("last").alias("x"))
    live = by_anchor.where("low < high").select("h", "k")
    live = table(contexts.join(live, "h"))
    # more than one context: get their words
    asked = live.where("k > 1").groupBy(F.col("first").alias("doc_id")).agg(F.collect_list(F.struct("h", "c", "start", "n", (F.col("k") > MOST_CONTEXTS).alias("many"))).alias("wanted"))
    words = known.join(asked, "doc_id").select("doc_id", "text", *[F.col(f"wanted.{x}").alias(x) for x in ("h", "c", "start", "n", "many")]).mapInPandas(_fetch(window), "h long, c long, doc_id long, n int, many boolean, words binary")
    words = table(words)
    total = words.where("not many").agg(F.sum(F.length("words")) / 8).first()[0] or 0
    group = F.pmod(F.xxhash64("h"), F.lit(1 + int(total // GROUP_WORDS)))
    trees = words.where("not many").dropDuplicates(["h", "c"]).groupBy(group.alias("g")).applyInPandas(_tree(window), "h long, c long, least binary")
    wide = words.where("many").mapInPandas(_windows(window), "h long, c long, i int, w long, doc_id long")
    low = wide.groupBy("w").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("times")).where("times > 1").select("w", "low")
    wide = wide.join(low, "w").where("low < doc_id").select("h", "c", F.struct("i", "low").alias("x"))
    wide = wide.groupBy("h", "c").agg(F.collect_set("x").alias("lows"))
    rule = live.select("h", "c", "first", "last", "k").join(trees, ["h", "c"], "left").join(wide, ["h", "c"], "left")
    # a context says nothing if all of its windows have their least document in the only document that holds it
    rule = rule.where("first < last or least is not null or lows is not null").select("h", "c", "first", "least", "lows")
    hits = found.join(rule, ["h", "c"]).where("first < doc_id or least is not null or lows is not null")
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "c", "first", "least", "lows")).alias("marks"))


def covered(h: np.ndarray, doc_id: int, marks: dict, window: int) -> np.ndarray:
    """Which words, given by their hashes, lie in a window that starts in an earlier document."""
    out = np.zeros(len(h) + 1, np.int64)
    start, n, first = marks["start"], marks["n"], marks["first"]
    own = _holds(h, start, n, marks["c"], window)
    plain, others = np.asarray(marks["plain"], bool), iter(marks["others"])
    # all windows start in the same earlier document
    whole = own & plain & (first < doc_id)
    np.add.at(out, start[whole], 1)
    np.add.at(out, start[whole] + n[whole] - 1 + window, -1)
    for i in np.flatnonzero(~plain):
        other = next(others)
        if not own[i]:
            continue
        least = np.full(n[i], first[i], np.int64) if other["least"] is None else np.frombuffer(other["least"], np.int64).copy()
        for low in other["lows"] if other["lows"] is not None else ():
            least[low["i"]] = min(least[low["i"]], low["low"])
        at = start[i] + np.flatnonzero(np.minimum(least, first[i]) < doc_id)
        np.add.at(out, at, 1)
        np.add.at(out, at + window, -1)
    return np.cumsum(out[:-1]) > 0


def _apply(window: int, digest: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, *marks in zip(b["doc_id"], b["text"], *(b[x] for x in MARK), strict=True):
                words = _bytes(text).split()
                gone = covered(word_hashes(_bytes(text)), doc_id, dict(zip(MARK, marks, strict=True)), window) if marks[0] is not None else np.zeros(len(words), bool)
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else b" ".join(words)
                out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"]).astype({"doc_id": "Int64"})

    return run


def dedup(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (with digest: their SHA-256) of each row.

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller doc_id.
    Windows are judged on the input. Rows that share a doc_id repeat nothing of each other; a row with a null doc_id neither loses words nor takes any
    from others. Null, empty and short texts keep all their words; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        marks = keep(repeats(docs, window)).withColumnRenamed("doc_id", "__d")
    # arrays of numbers reach Python as they are, structs one by one
    plain = lambda m: m["least"].isNull() & m["lows"].isNull()
    parts = [F.col(f"marks.{x}").alias(x) for x in MARK[:4]] + [F.transform("marks", plain).alias("plain"), F.filter("marks", lambda m: ~plain(m)).alias("others")]
    both = docs.join(marks, docs["doc_id"] == marks["__d"], "left").select("doc_id", "text", *parts)
    return both.mapInPandas(_apply(window, digest), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")


def dedup_digest(docs: DataFrame, window: int = 50) -> DataFrame:
    return dedup(docs, window, digest=True)
