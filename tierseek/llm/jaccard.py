"""N-gram Jaccard join by PartEnum signatures, and the connected components of its links.

Sets are put into bands of sizes such that two similar enough sets lie in the same or in adjacent bands. For a band with largest
size r, similar sets differ in at most k = 2r(1 - t)/(1 + t) shingles. The shingle domain is hashed into n1 parts of n2
subparts; some part then holds at most k2 differences, and some choice of n2 - k2 of its subparts holds none. A signature is
the hash of a set's shingles in such a choice, so similar sets share at least one. Candidates are verified exactly.

A passage that many texts hold makes signatures that many share, and pairs of those would grow with the square of the input. So what
the stars leave apart is looked for by rare shingles: in any one order of all shingles, similar sets share one of their first few.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierseek.llm.common import U64, among, bucketed, gram_hashes, mix, scratch, table, unbucketed, word_hashes
from tierseek.llm.graph import min_labels

FLUSH = 500_000
PER_BUCKET = 150_000
#: Groups of candidates up to this size are compared pair by pair; larger ones block by block.
SMALL, BLOCK = 40, 1024
#: Shingles whose frequency is known, at most; it only orders shingles, so that the others come first changes no result.
FREQUENT = 1 << 18


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased; of all its words if it has fewer."""
    if not text:
        return np.zeros(0, U64)
    return np.unique(gram_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower()), k))


class Scheme:
    """Bands and PartEnum parameters for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ends = [1]
        while self.ends[-1] < 1 << 40:
            first = self.ends[-1] + 1
            self.ends.append(max(first, first * den // num))

    def parameters(self, band: int) -> tuple[int, int, int]:
        """n1, n2, k2 for a band; n1 = 0 where similar sets can only be equal ones."""
        k = 2 * self.ends[band] * (self.den - self.num) // (self.den + self.num)
        if k == 0:
            return 0, 0, 0
        # where parts would hold few shingles, subsets of subparts make signatures more selective
        n2, k2 = (3, 1) if k < 12 else (1, 0)
        n1 = -(-(k + 1) // (k2 + 1))
        return n1 + n1 // 20 + 1, n2, k2  # some parts to spare, for the emptiest to be left out

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """A set's signatures, without those of its emptiest choices of subparts.

        With at most d differences to any partner, at most d // (k2 + 1) parts have more than k2. If more parts than that have
        ``least`` or more shingles in each choice, one of them has a choice that a partner shares. Of two similar sets the
        one with the larger ``least`` has such a choice, and as the other holds the same shingles in it, it keeps it too.
        """
        if len(x) == 0:
            return x
        own, out = int(np.searchsorted(self.ends, len(x))), []
        for band in (own, own + 1):
            n1, n2, k2 = self.parameters(band)
            if not n1:
                continue
            y = mix(x + U64(band * 2 + 1))
            slot = (y % U64(n1 * n2)).astype(np.int64)
            z = mix(y)
            low = np.bincount(slot, (z & U64(0xFFFFFFFF)).astype(float), n1 * n2).astype(U64)
            high = np.bincount(slot, (z >> U64(32)).astype(float), n1 * n2).astype(U64)
            sums = mix(low + (high << U64(32)) + U64(band)).reshape(n1, n2)
            name = mix(np.arange(n1, dtype=U64) + U64(band << 32))
            choices = list(itertools.combinations(range(n2), n2 - k2))
            sizes = np.bincount(slot, minlength=n1 * n2).reshape(n1, n2)
            held = np.stack([sizes[:, kept].sum(axis=1) for kept in choices])
            partner = min(self.ends[band], len(x) * self.den // self.num)
            spoilt = (len(x) + partner) * (self.den - self.num) // (self.den + self.num) // (k2 + 1)
            least = np.sort(held.min(axis=0))[max(0, n1 - spoilt - 1)]
            for i, kept in enumerate(choices):
                s = name + U64(i)
                for c in kept:
                    s = mix(s * U64(0x9E3779B97F4A7C15) + sums[:, c])
                out.append(s[held[i] >= least])
        return np.concatenate(out) if out else np.zeros(0, U64)

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common) and common > 0


def _stars(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures with their smallest node, and the pairs (node, that node) of the others."""
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    first = np.ones(len(sigs), bool)
    first[1:] = sigs[1:] != sigs[:-1]
    hub = nodes[first][np.cumsum(first) - 1] if len(sigs) else nodes
    other = nodes != hub
    pairs = np.unique(np.stack([nodes[other], hub[other]], axis=1), axis=0)
    return sigs[first], nodes[first], pairs


DESCRIBED = ("doc_id", "no_id", "n_shingles", "fa", "fb")
BLOCKS = ("bucket", "sigs", "places", "nodes", "pairs")


def _dealt(sigs: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its signatures."""
    at = _bucket(sigs, buckets)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(buckets + 1, dtype=U64))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        yield i, order[a:b]


def _bucket(sigs: np.ndarray, buckets: int) -> np.ndarray:
    return (sigs >> U64(32)) % U64(buckets)


def _short(sigs: np.ndarray) -> bytes:
    """Inside a bucket 32 bits name a signature: two that fall together only make a candidate more, which is verified."""
    return sigs.astype(np.uint32).tobytes()


def _places(where: np.ndarray, n: int) -> bytes:
    """Indexes into a list of n, in as few bytes as they need."""
    return where.astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes()


def _named(places: bytes, names: bytes) -> np.ndarray:
    found = np.frombuffer(names, np.int64)
    return found[np.frombuffer(places, np.uint16 if len(found) <= 1 << 16 else np.uint32)]


def _describe(k: int, scheme: Scheme, buckets: int):
    """Rows of two kinds from one pass over the texts: each row's set described, and blocks of signatures with a bucket.

    A block is (bucket, sigs, places, nodes, pairs): signatures met once each with an index into nodes, and stars of those that its texts share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs, nodes, held, seen = [], [], 0, set()

        def flush() -> pd.DataFrame:
            s, n, pairs = _stars(np.concatenate(sigs), np.concatenate(nodes))
            named, at_node = np.unique(n, return_inverse=True)
            at_pair = mix(pairs.view(U64).sum(1)) % U64(buckets) if len(pairs) else np.zeros(0, U64)
            rows = []
            for i, o in _dealt(s, buckets):
                p = pairs[at_pair == i] if len(pairs) else pairs
                if len(o) or len(p):
                    mine, where = np.unique(at_node[o], return_inverse=True)
                    rows.append((i, _short(s[o]), _places(where, len(mine)), named[mine].tobytes(), p.astype(np.int64).tobytes()))
            sigs.clear(), nodes.clear(), seen.clear()
            return pd.DataFrame(rows, columns=BLOCKS).reindex(columns=[*DESCRIBED, *BLOCKS]).astype(object).where(lambda x: x.notna(), None)

        for b in batches:
            described = []
            for doc_id, no_id, text in zip(b["doc_id"], b["no_id"], b["text"], strict=True):
                x = shingles(text, k)
                same = (len(x), int(mix(x + U64(1)).sum(dtype=U64)), int(mix(x + U64(2)).sum(dtype=U64)))
                described.append((doc_id, no_id, len(x), *np.array(same[1:], U64).astype(np.int64).tolist(), None, None, None, None, None))
                if no_id or same in seen:  # an exact copy: its class says all
                    continue
                seen.add(same)
                s = scheme.signatures(x)
                sigs.append(s)
                nodes.append(np.full(len(s), doc_id, np.int64))
                held += len(s)
                if held >= FLUSH:
                    yield flush()
                    held = 0
            yield pd.DataFrame(described, columns=[*DESCRIBED, *BLOCKS])
        if sigs:
            yield flush()

    return run


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """The stars of one bucket of signatures. It has at most one row for each flush of each input partition."""
    join = lambda c, t: np.frombuffer(b"".join(rows[c]), t)
    nodes = np.concatenate([np.zeros(0, np.int64), *map(_named, rows["places"], rows["nodes"])])
    _, _, pairs = _stars(join("sigs", np.uint32), nodes)
    pairs = np.unique(np.concatenate([pairs, join("pairs", np.int64).reshape(-1, 2)]), axis=0)
    return pd.DataFrame({"b": pairs[:, 0], "a": pairs[:, 1]})


def sketch(x: np.ndarray) -> bytes:
    """How many shingles fall into each slot of a hash, 255 at most; more slots for larger sets."""
    slots = 64
    while slots < len(x) and slots < 4096:
        slots *= 2
    return np.minimum(np.bincount((mix(x + U64(5)) % U64(slots)).astype(np.int64), minlength=slots), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in which two sets differ: the L1 distance of their sketches."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, n).sum(0) - y.reshape(-1, n).sum(0)).sum())


def _sketches(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, k) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(x) for x in sets], "sk": [sketch(x) for x in sets]})

    return run


def _near(scheme: Scheme):
    """Pairs whose sketches allow the similarity. Only pairs that cannot link are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            most = (p["na"] + p["nb"]) * (scheme.den - scheme.num) // (scheme.den + scheme.num)
            ok = np.array([least_difference(x, y) <= m for x, y, m in zip(p["ska"], p["skb"], most, strict=True)], bool)
            yield p.loc[ok, ["a", "b"]]

    return run


def _verify(k: int, scheme: Scheme):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x = None, None
        for rows in batches:
            out = []
            for a, b, ta, tb in zip(rows["a"], rows["b"], rows["ta"], rows["tb"], strict=True):
                if ta != last:
                    last, x = ta, shingles(ta, k)
                y = shingles(tb, k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                out.append((a, b, scheme.linked(common, len(x), len(y))))
            yield pd.DataFrame(out, columns=["a", "b", "linked"])

    return run


def prefix(x: np.ndarray, scheme: Scheme, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, rarest first, and how many of them will do where the other set isn't smaller.

    If two sets have o shingles in common, the first of them in any order is among the first |x| - o + 1 of each. Similar sets have
    |x| num / den at least, and 2 |x| num / (num + den) of the smaller one. ``frequent`` has shingles, sorted, and their counts.
    """
    known, counts = frequent
    rank = np.zeros(len(x), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        rank = np.where(known[at] == x, counts[at], 0)
    n, num, den = len(x), scheme.num, scheme.den
    return x[np.argsort(rank, kind="stable")[: n + (-n * num // den) + 1]], n + (-2 * n * num // (num + den)) + 1


def _counted(k: int):
    """(shingle, n) of shingles that several texts of the same flush hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, held = [], 0

        def flush() -> pd.DataFrame:
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            sets.clear()
            return pd.DataFrame({"shingle": found[n > 1].view(np.int64), "n": n[n > 1]})

        for b in batches:
            for text in b["text"]:
                sets.append(shingles(text, k))
                held += len(sets[-1])
                if held >= 4 * FLUSH:
                    yield flush()
                    held = 0
        if sets:
            yield flush()

    return run


def _frequent(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of texts, FREQUENT at most, and about how many texts hold each."""
    counts = table(texts.mapInPandas(_counted(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 8)
    least, total = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > FREQUENT:
            least = r["level"] + 1
            break
    most = counts.where(level >= least).toPandas()
    known = most["shingle"].to_numpy(np.int64).view(U64)
    order = np.argsort(known)
    return known[order], most["n"].to_numpy(np.int64)[order]


def _memberships(k: int, scheme: Scheme, buckets: int, frequent: tuple[np.ndarray, np.ndarray]):
    """(sig, node, n, first) for the rare shingles of texts, with a shingle's bucket and its name in there as one number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = [shingles(t, k) for t in rows["text"]]
            raw = [prefix(x, scheme, frequent) for x in sets]
            sigs = [((_bucket(s, buckets) << U64(32)) + s.astype(np.uint32)).astype(np.int64) for s, _ in raw]
            each = lambda c: np.repeat(c, [len(s) for s in sigs])
            first = [np.arange(len(s)) < few for s, few in raw]
            yield pd.DataFrame({"sig": np.concatenate([*sigs, np.zeros(0, np.int64)]), "node": each(rows["doc_id"].to_numpy()), "n": each(np.array([len(x) for x in sets], np.int64)), "first": np.concatenate([*first, np.zeros(0, bool)])})

    return run


def _extremes(sigs: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, the least low and greatest high of each, and whether any of its rows is a first one."""
    order = np.argsort(sigs, kind="stable")
    found, start = np.unique(sigs[order], return_index=True)
    if len(found) == 0:
        return found, low, high, first
    return found, np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start), np.maximum.reduceat(first[order], start)


def _spans(k: int, scheme: Scheme, buckets: int, frequent: tuple[np.ndarray, np.ndarray]):
    """Blocks (bucket, sigs, low, high, firsts, comps): rare shingles met once each, with the least and greatest component of their texts as indexes into comps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs, comps, firsts, held = [], [], [], 0

        def flush() -> pd.DataFrame:
            c = np.concatenate(comps)
            s, lows, highs, first = _extremes(np.concatenate(sigs), c, c, np.concatenate(firsts))
            sigs.clear(), comps.clear(), firsts.clear()
            rows = []
            for i, o in _dealt(s, buckets):
                if len(o):
                    mine, where = np.unique(np.concatenate([lows[o], highs[o]]), return_inverse=True)
                    rows.append((i, _short(s[o]), *(_places(x, len(mine)) for x in np.split(where, 2)), np.packbits(first[o]).tobytes(), mine.tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "sigs", "low", "high", "firsts", "comps"])

        for b in batches:
            for comp, text in zip(b["comp"], b["text"], strict=True):
                s, few = prefix(shingles(text, k), scheme, frequent)
                sigs.append(s)
                firsts.append(np.arange(len(s)) < few)
                comps.append(np.full(len(s), comp, np.int64))
                held += len(s)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if sigs:
            yield flush()

    return run


def _open_signatures(rows: pd.DataFrame) -> pd.DataFrame:
    """The shingles of one bucket with more than one component, first ones of some text. It has at most one row for each flush of each partition."""
    low, high = (np.concatenate([np.zeros(0, np.int64), *map(_named, rows[x], rows["comps"])]) for x in ("low", "high"))
    first = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(x) // 4) for f, x in zip(rows["firsts"], rows["sigs"], strict=True)]
    found, lows, highs, firsts = _extremes(np.frombuffer(b"".join(rows["sigs"]), np.uint32), low, high, np.concatenate([np.zeros(0, np.uint8), *first]))
    return pd.DataFrame({"sig": (int(rows["bucket"].iloc[0]) << 32) + found[(lows < highs) & (firsts > 0)].astype(np.int64)})


def _block_pairs(scheme: Scheme):
    """Pairs of the outsiders of one block and the rows of another whose sketches allow the similarity."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        raw = [np.frombuffer(x, np.uint8) for x in rows["sk"]]
        slots = min(map(len, raw))
        sketches = np.stack([x.reshape(-1, slots).sum(0, dtype=np.int32) for x in raw])
        n, comp, nodes, out = rows["n"].to_numpy(), rows["comp"].to_numpy(), rows["node"].to_numpy(), []
        side = rows["side"].to_numpy()
        right = np.flatnonzero(side == 1)
        sketches_right = sketches[right]
        for i in np.flatnonzero(side == 0):
            most = (n[i] + n[right]) * (scheme.den - scheme.num) // (scheme.den + scheme.num)
            other = np.flatnonzero((comp[right] != comp[i]) & (np.abs(n[right] - n[i]) <= most))
            ok = other[np.abs(sketches_right[other] - sketches[i]).sum(1) <= most[other]]
            out.append(np.stack([np.minimum(nodes[right[ok]], nodes[i]), np.maximum(nodes[right[ok]], nodes[i])], axis=1))
        found = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return run


def links(docs: DataFrame, words: int = 3, similarity: tuple[int, int] = (90, 100)) -> tuple[DataFrame, DataFrame]:
    """(described, labels): doc_id, n_shingles and set prints of each row; and for every linked doc_id its component.

    The links that are returned as components hold every pair of similar sets, by transitivity: rounds of verified stars
    join most; then rare shingles that texts of two components hold have all their pairs across components verified, pair by pair
    in groups of up to SMALL; in larger ones sketches choose the pairs, block by block.
    """
    scheme = Scheme(*similarity)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a word has rarely fewer than five bytes with the space after it; buckets of short words hold more
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    share = 3.0 * (scheme.den - scheme.num) / (scheme.den + scheme.num)
    buckets = max(12, int(total * 2 * share / PER_BUCKET))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    kinds = "doc_id long, no_id boolean, n_shingles long, fa long, fb long, bucket int, sigs binary, places binary, nodes binary, pairs binary"
    with scratch(docs.sparkSession) as keep:  # the blocks of signatures go as soon as their pairs are known
        both = table(rows.mapInPandas(_describe(words, scheme, buckets), kinds))
        blocks = both.where("bucket is not null").select(*BLOCKS)
        met = keep(blocks.groupBy("bucket").applyInPandas(_meet, "a long, b long").distinct())
        described = keep(both.where("bucket is null").select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_shingles", "fa", "fb"))
    known = docs.where("doc_id is not null and text is not null")
    # copies of a set
    classes = described.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "fa", "fb").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = described.join(classes, ["n_shingles", "fa", "fb"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    # of the copies of a set, one stands for all; ids whose rows differ stand for themselves
    several = described.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "fa", "fb")).alias("x"), F.max(F.struct("n_shingles", "fa", "fb")).alias("y")).where("x <> y")
    named = table(copies.distinct().join(several.select(F.col("doc_id").alias("b")), "b", "left_anti"))
    for end in ("a", "b"):
        met = met.join(named.select(F.col("b").alias(end), F.col("a").alias("rep")), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
    pairs = table(met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    ends = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
    # the joins by doc_id below read the texts where they lie, in buckets
    texts = bucketed(among(known, "doc_id", ends), "doc_id")
    sketches = table(texts.mapInPandas(_sketches(words), "doc_id long, n long, sk binary"))

    def verified(candidates: DataFrame) -> DataFrame:
        tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        end = lambda x: sketches.select(*[F.col(c).alias(n) for c, n in (("doc_id", x), ("n", f"n{x}"), ("sk", f"sk{x}"))])
        # a sketch is a few hundred bytes, a text may be any length: only pairs that pass meet with their texts
        near = table(candidates.join(end("b"), "b").join(end("a"), "a").mapInPandas(_near(scheme), "a long, b long").distinct())
        # a hub may be in many pairs: its side is dealt anew, so that Spark can split it
        hubs = among(unbucketed(texts), "doc_id", near.select(F.col("a").alias("doc_id")).distinct())
        both = near.join(tb, "b").join(hubs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")
        return table(both.mapInPandas(_verify(words, scheme), "a long, b long, linked boolean"))

    tested = verified(pairs)
    edges = table(tested.where("linked").select("a", "b").union(copies))
    labels = min_labels(edges)

    placed = texts.join(labels, texts["doc_id"] == labels["node"], "left").select("doc_id", F.coalesce("label", "doc_id").alias("comp"), "text")
    # one text of each component counts: copies don't make a shingle frequent
    frequent = _frequent(placed.where("doc_id = comp"), words)
    spans = placed.select("comp", "text").mapInPandas(_spans(words, scheme, buckets, frequent), "bucket int, sigs binary, low binary, high binary, firsts binary, comps binary")
    open_sigs = table(spans.groupBy("bucket").applyInPandas(_open_signatures, "sig long"))
    # only members of shingles that hold two components are shuffled
    members = among(texts.mapInPandas(_memberships(words, scheme, buckets, frequent), "sig long, node long, n long, first boolean"), "sig", open_sigs).distinct()
    found = members.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).select("sig", "node", "n", "first", "comp")
    still = table(found.join(found.groupBy("sig").agg(F.count(F.lit(1)).alias("m")), "sig"))
    small = still.where(F.col("m") <= SMALL)
    groups = small.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("node", "comp", "n", "first"))).alias("g"))

    def meets(x, y):
        """Whether a shingle that two rows have in common may be the first one of a pair of similar sets."""
        smaller = lambda a, b: a["first"] & (a["n"] <= b["n"]) & (b["n"] * scheme.num <= a["n"] * scheme.den)
        return (y["node"] > x["node"]) & (y["comp"] != x["comp"]) & (smaller(x, y) | smaller(y, x))

    each = groups.select(F.explode("g").alias("x"), "g").select("x", F.explode(F.filter("g", lambda y: meets(F.col("x"), y))).alias("y"))
    fresh = each.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = still.where(F.col("m") > SMALL).select("sig", "node", "comp")
    if large.limit(1).count():
        fresh = fresh.union(_large_groups(large, sketches, scheme))
    fresh = table(fresh.distinct().join(pairs, ["a", "b"], "left_anti"))
    more = verified(fresh).where("linked").select("a", "b")
    if more.limit(1).count():
        edges = table(edges.union(more))
        labels = min_labels(edges)
    return described, labels


def _large_groups(large: DataFrame, sketches: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) across components of the members of large groups that may be similar by size and sketch.

    Members of groups that overlap make one group. In each band of sizes, all but its largest component are compared with the members in the
    same and the adjacent bands, in blocks of about BLOCK rows; pairs within the largest component aren't looked at. Texts aren't read.
    """
    hubs = large.groupBy("sig").agg(F.min("node").alias("hub"))
    group = min_labels(large.join(hubs, "sig").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    # an id with several rows has a sketch for each
    sets = sketches.select(F.col("doc_id").alias("node"), "n", "sk").distinct()
    rows = large.select("node", "comp").distinct().join(group.withColumnRenamed("label", "g"), "node").join(sets, "node")
    band = F.size(F.filter(F.array(*[F.lit(x) for x in scheme.ends]), lambda x: x < F.col("n")))
    rows = table(rows.withColumn("band", band))
    sizes = rows.groupBy("g", "comp").count()
    top = sizes.groupBy("g").agg(F.max(F.struct("count", "comp"))["comp"].alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1").select("g", "top")
    rows = rows.join(top, "g")
    every = rows.withColumn("at", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK))
    outside = (F.col("band") == F.col("at")) & (F.col("comp") != F.col("top"))
    dealt = every.groupBy("g", "at").agg(blocks(F.count_if(outside)).alias("n_out"), blocks(F.count(F.lit(1))).alias("n_all"), F.count_if(outside).alias("left")).where("left > 0").drop("left")
    spot = lambda n: F.pmod(F.xxhash64("node"), n)
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = every.join(table(dealt), ["g", "at"])
    out = every.where(outside).withColumn("o", spot(F.col("n_out"))).withColumn("i", span("n_all")).withColumn("side", F.lit(0))
    every = every.withColumn("i", spot(F.col("n_all"))).withColumn("o", span("n_out")).withColumn("side", F.lit(1))
    both = out.unionByName(every).select("g", "at", "o", "i", "side", "node", "comp", "n", "sk")
    return both.groupBy("g", "at", "o", "i").applyInPandas(_block_pairs(scheme), "a long, b long")


def components(docs: DataFrame, words: int = 3, similarity: tuple[int, int] = (90, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text).

    n_shingles is the size of the row's set of distinct word shingles, A-Z lower-cased; a text with fewer words is one shingle, an empty or
    null text has none and links with nothing. Two rows link when the Jaccard similarity of their sets is similarity (num, den) or more;
    component_id is the smallest doc_id that links reach. Rows that share a doc_id are one document to links. A null doc_id
    has no links and a null component. An empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        described, labels = links(docs, words, similarity)
        found = described.join(labels, described.doc_id == labels.node, "left")
        return keep(found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs without the rows whose near-duplicate component has a smaller doc_id. All rows without shingles stay."""
    with scratch(docs.sparkSession) as keep:
        drop = keep(components(docs, words, similarity).where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct())
    return docs.join(drop, docs["doc_id"] == drop["__id"], "left_anti")
