"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances: with every vector x extended by sqrt(M^2 - |x|^2), M the largest norm, and a query by 0,
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest are the highest. A vector's key is its nearest pivot and its distance to it;
each pivot's vectors are sorted by that distance and cut into annuli. A query expands annuli in the order of their
triangle-inequality bounds, and stops where a bound is above the k-th best distance found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierseek.llm.common import table

PIVOTS, ANNULI, BLOCK, CHUNK = 48, 24, 1024, 128
PIVOT_SAMPLE = 4096
#: Blocks are searched by shards of SHARD blocks at most, and by LEAST_SHARDS shards where there are so many blocks; ASKED queries at a time meet a shard.
SHARD, LEAST_SHARDS, ASKED = 64, 24, 1 << 16
#: Slack for rounding in distances that are computed in doubles; scores themselves are whole numbers.
SLACK = 1e-6


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector is null or holds null, nan or infinity."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale)))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats or doubles while every sum fits their digits, else in Python integers."""
    top = lambda a: max(int(a.max()), -int(a.min())) if a.size else 0
    most = top(q) * top(x) * max(1, q.shape[1])
    for digits, kind in ((24, np.float32), (53, np.float64)):
        if most < 2**digits:
            return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)


def _extended(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of n pivots."""
    chosen, near = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return sample[chosen]


def top_k(vectors: DataFrame, k: int = 20, is_query: Column | None = None, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with all other rows; ties go to the smaller id.

    is_query: which rows are queries (default: id divisible by 20). Vectors that are null, or hold null or non-finite components,
    and rows with a null id take no part; shorter vectors count as padded with 0. Rows that repeat an id are candidates of
    their own and the query's id never is its own candidate; a repeated query id is asked once for each distinct vector.
    An empty table gives no rows; other columns are ignored.

    Pivots come from at most PIVOT_SAMPLE vectors. Every vector is indexed: PIVOTS * ANNULI cells at most, in blocks of at most
    BLOCK vectors each. The cells' bounds are the only thing that is collected.
    """
    spark = vectors.sparkSession
    is_query = F.col(id_col) % 20 == 0 if is_query is None else is_query
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), quantised(F.col(vector), scale).alias("x")).where("id is not null and x is not null")
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    rows = table(rows.withColumn("norm", norm))
    top, width, n_rows = rows.agg(F.max("norm"), F.max(F.size("x")), F.count(F.lit(1))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if top is None:
        return spark.createDataFrame([], out)
    kind = np.int16 if top < 32767**2 else np.int64  # of the components in blocks and chunks
    # about one cell for each BLOCK vectors, up to PIVOTS * ANNULI cells; beyond that cells get more blocks
    wanted = max(1, -(-n_rows // BLOCK))
    annuli = min(ANNULI, max(1, round((wanted / 2) ** 0.5)))
    n_pivots = min(PIVOTS, max(1, -(-wanted // annuli)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("x").toPandas()["x"]
    pivots = _pivots(_extended(_matrix(sample, width), top), n_pivots)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _distances(_extended(_matrix(b["x"], width), top), pivots) if len(b) else np.zeros((0, len(pivots)))
            near = d.argmin(1) if len(b) else np.zeros(0, int)
            yield b.assign(pivot=near.astype("int32"), d=d[np.arange(len(b)), near])

    keyed = rows.select("id", "x").mapInPandas(key, "id long, x array<long>, pivot int, d double")
    # annuli of equal counts, by approximate quantiles of distance; the bounds used below are exact
    keyed = table(keyed)
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("d", [i / annuli for i in range(1, annuli)] or [1.0], 1000).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: c < F.col("d")))
    cells = keyed.join(F.broadcast(cuts), "pivot").withColumn("cell", F.col("pivot") * annuli + F.least(ring, F.lit(annuli - 1)))
    # rows of a cell are dealt over enough blocks that none holds many more than BLOCK
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    bounds = sizes.select("cell", "n", "low", "high").toPandas().sort_values("cell", ignore_index=True)
    blocks = np.maximum(1, -(-bounds["n"].to_numpy() // BLOCK))
    of_cell = dict(zip(bounds["cell"].tolist(), blocks.tolist(), strict=True))
    many = F.get(F.array(*[F.lit(int(of_cell.get(c, 1))) for c in range(len(pivots) * annuli)]), F.col("cell"))
    part = F.pmod(F.xxhash64("id", "x"), many).cast("int")
    packed = cells.select("cell", part.alias("part"), "id", "x").groupBy("cell", "part").applyInPandas(_block(width, kind), "cell int, part int, ids binary, m binary")
    # blocks are numbered by cell and part, and so many in a row make a shard
    first_block, n_blocks = np.cumsum(blocks) - blocks, int(blocks.sum())
    per_shard = max(1, min(SHARD, n_blocks // LEAST_SHARDS))
    at_block = dict(zip(bounds["cell"].tolist(), first_block.tolist(), strict=True))
    number = F.get(F.array(*[F.lit(int(at_block.get(c, 0))) for c in range(len(pivots) * annuli)]), F.col("cell")) + F.col("part")
    groups = max(1, -(-rows.where("q").count() // ASKED))
    index = table(packed.select(F.floor(number / per_shard).cast("int").alias("shard"), (number % per_shard).cast("int").alias("at"), "ids", "m"))
    index = index.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell_ids, low, high = (bounds[c].to_numpy() for c in ("cell", "low", "high"))

    def bound(q: np.ndarray) -> np.ndarray:
        """The least distance from each query to any vector of each cell."""
        x = np.hstack([q.astype(float), np.zeros((len(q), 1))])
        d = _distances(x, pivots)[:, cell_ids // annuli]
        return np.maximum(0.0, np.maximum(d - high, low - d))

    # queries in chunks, near ones together: each chunk is one row
    asked = rows.where("q").dropDuplicates(["id", "x"]).select("id", "x").mapInPandas(key, "id long, x array<long>, pivot int, d double")
    n_asked = rows.where("q").count()
    chunk = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_asked // (CHUNK * len(pivots))))))
    chunks = table(asked.withColumn("chunk", chunk).groupBy("pivot", "chunk").applyInPandas(
        lambda g: pd.DataFrame([{"first": int(a["id"].iloc[0]), "ids": a["id"].to_numpy(np.int64).tobytes(), "m": _matrix(a["x"], width).astype(kind).tobytes()} for a in (g.iloc[i : i + CHUNK] for i in range(0, len(g), CHUNK))]),
        "first long, ids binary, m binary",
    ))

    def probe(first: bool):
        """A chunk's row for each shard with cells to visit: the nearest until they hold k + 1 rows, or all others within reach. Bits say which query visits which block."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    ids, q = np.frombuffer(r.ids, np.int64), np.frombuffer(r.m, kind).reshape(-1, width)
                    lows = bound(q)
                    order = np.argsort(lows, axis=1, kind="stable")
                    counts = np.cumsum(bounds["n"].to_numpy()[order], axis=1)
                    n_first = np.minimum((counts < 4 * (k + 1)).sum(1) + 1, len(cell_ids))
                    near = np.zeros(lows.shape, bool)
                    for i, n in enumerate(n_first):
                        near[i, order[i, :n]] = True
                    if first:
                        want = near
                    else:
                        least = np.frombuffer(r.least, np.int64)
                        full = least > np.iinfo(np.int64).min
                        squares = (q.astype(float) ** 2).sum(1) + top
                        reach = np.where(full, np.sqrt(np.maximum(0.0, squares - 2.0 * np.where(full, least, 0))), np.inf)
                        want = ~near & (lows <= (reach * (1 + SLACK) + SLACK)[:, None])
                    want, out = np.repeat(want, blocks, axis=1), []
                    for shard in range(-(-n_blocks // per_shard)):
                        here = want[:, shard * per_shard : (shard + 1) * per_shard]
                        pick = np.flatnonzero(here.any(1))
                        if len(pick):
                            floor = np.frombuffer(r.least, np.int64)[pick].tobytes() if not first else b""
                            out.append((shard, int(r.first % groups), ids[pick].tobytes(), q[pick].tobytes(), floor, np.packbits(here[pick]).tobytes(), here.shape[1]))
                    # a chunk at a time: what a task holds doesn't grow with the chunks
                    yield pd.DataFrame(out, columns=["shard", "asked", "q_ids", "q", "floor", "want", "n"])

        return run

    visit = "shard int, asked int, q_ids binary, q binary, floor binary, want binary, n int"

    def search(visits: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        """The k best of each query in a shard; what a chunk's queries reach so far is the floor of the blocks to come."""
        least = -np.iinfo(np.int64).max
        held = [(at, np.frombuffer(ids, np.int64), np.frombuffer(m, kind).reshape(-1, width)) for at, ids, m in zip(shard["at"], shard["ids"], shard["m"], strict=True)]
        none = np.zeros(0, np.int64)
        out = [(none, none, none)]
        for r in visits.itertuples(index=False):
            q_ids, q = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q, kind).reshape(-1, width)
            want = np.unpackbits(np.frombuffer(r.want, np.uint8), count=len(q_ids) * r.n).reshape(-1, r.n).astype(bool)
            floor = np.frombuffer(r.floor, np.int64).copy() if r.floor else np.full(len(q_ids), least + 1)
            floor = np.maximum(floor, least + 1)
            best = [(none, none)] * len(q_ids)
            for at, ids, x in held:
                pick = np.flatnonzero(want[:, at])
                if not len(pick):
                    continue
                s = _scores(q[pick], x)
                s[q_ids[pick][:, None] == ids[None]] = least
                hits = s >= floor[pick, None]
                for i in np.flatnonzero(hits.any(1)).tolist():
                    n = pick[i]
                    score, vec = np.concatenate([best[n][0], s[i, hits[i]]]), np.concatenate([best[n][1], ids[hits[i]]])
                    order = np.lexsort((vec, -score))[:k]
                    best[n] = score[order], vec[order]
                    if len(order) == k:
                        floor[n] = max(floor[n], score[order[-1]])
            out += [(np.full(len(v), i, np.int64), v, s) for i, (s, v) in zip(q_ids.tolist(), best, strict=True) if len(v)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    hit = "query_id long, vec_id long, score long"

    def merge(x: DataFrame) -> DataFrame:
        """The k best of each query, from those that each task found."""
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def searched(visits: DataFrame) -> DataFrame:
        return visits.groupBy("shard", "asked").cogroup(index.groupBy("shard", "asked")).applyInPandas(search, hit)

    near = searched(chunks.mapInPandas(probe(True), visit))
    near = table(merge(near).drop("rank"))
    # the k-th best score so far goes back to the chunks
    least = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    members = chunks.mapInPandas(_members, "first long, at int, query_id long")
    back = members.join(least, "query_id", "left").groupBy("first").applyInPandas(_gather, "first long, least binary")
    rest = searched(chunks.join(back, "first").mapInPandas(probe(False), visit))
    best = merge(near.unionByName(rest))
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _block(width: int, kind: type):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        return pd.DataFrame({"cell": [g["cell"].iloc[0]], "part": [g["part"].iloc[0]], "ids": [g["id"].to_numpy(np.int64).tobytes()], "m": [_matrix(g["x"], width).astype(kind).tobytes()]})

    return run


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(r.first, i, int(x)) for r in b.itertuples(index=False) for i, x in enumerate(np.frombuffer(r.ids, np.int64))]
        yield pd.DataFrame(rows, columns=["first", "at", "query_id"])


def _gather(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("at")
    none = np.iinfo(np.int64).min
    return pd.DataFrame({"first": [g["first"].iloc[0]], "least": [np.array([none if pd.isna(v) else int(v) for v in g["least"]], np.int64).tobytes()]})


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
