"""Mixing sources to target weights by pivotal dependent rounding, as a reduction tree over blocks of documents."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierseek.llm.common import WORD, scratch, table

BLOCK = 1000
#: The smallest fractions of a block that are handed on unrounded, so that a source's last block can settle what is left.
BALLAST = 24
#: A source's taken words may miss its target by this share of it before the last fraction's other outcome is tried too.
NEAR = 0.001
#: Levels that are tried at once when targets are filled up.
CUTS = 64


def pivotal(ids: Sequence[int], sizes: Sequence[float], p: Sequence[float], seed: str) -> tuple[list[float], int | None]:
    """Rounds copy probabilities p to 0 or 1, two at a time; at most one, whose index is returned, stays fractional.

    A pair trades words: what one's expected words (p * size) gain the other's lose, until one of the two is 0 or 1. The
    direction is drawn so that each p keeps its mean, and the sum of p * size never changes.
    """
    r, out, held = random.Random(seed), list(p), None
    for j in range(len(out)):
        if out[j] <= 0 or out[j] >= 1:
            continue
        if sizes[j] <= 0:
            out[j] = 0.0
            continue
        if held is None:
            held = j
            continue
        i = held
        a, b = out[i] * sizes[i], out[j] * sizes[j]
        up, down = min(sizes[i] - a, b), min(a, sizes[j] - b)
        if r.random() * (up + down) < down:  # words go from j to i
            i_done = sizes[i] - a <= b
            out[i], out[j] = (1.0, (b - up) / sizes[j]) if i_done else ((a + up) / sizes[i], 0.0)
        else:
            i_done = a <= sizes[j] - b
            out[i], out[j] = (0.0, (b + down) / sizes[j]) if i_done else ((a - down) / sizes[i], 1.0)
        held = next((x for x in (i, j) if 0 < out[x] < 1), None)
    return out, held


def settle(out: list[float], free: Sequence[bool], sizes: Sequence[float], held: int, draw: float) -> list[float]:
    """Rounds the last fraction and hands the words that this adds or drops to other rows, largest first as far as they fit.

    Only free rows change, and each once at most. The sum of out * size then misses the old one by less than the smallest row that
    could still change; the outcome that is drawn for the last fraction gives way to the other one only where it misses by more.
    """
    order = sorted((j for j in range(len(out)) if free[j] and j != held and sizes[j] > 0), key=lambda j: -sizes[j])
    whole = sum(a * b for a, b in zip(out, sizes, strict=True))

    def tried(value: float) -> tuple[float, list[float]]:
        new, over = list(out), (value - out[held]) * sizes[held]
        new[held] = value
        for j in order:
            if new[j] == 1 and sizes[j] <= over:
                new[j], over = 0.0, over - sizes[j]
            elif new[j] == 0 and sizes[j] <= -over:
                new[j], over = 1.0, over + sizes[j]
        return abs(over), new

    drawn = float(draw < out[held])
    first = tried(drawn)
    if first[0] <= NEAR * whole:
        return first[1]
    return min(first, tried(1.0 - drawn), key=lambda x: x[0])[1]


def _round_block(level: int, seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what stays fractional in the end is then small more often
        rows = rows.assign(words=-rows["size"] * rows["n"]).sort_values(["words", "key", "doc_id", "n"], kind="stable").drop(columns="words")
        first = rows.iloc[0]
        name = f"{seed}:{level}:{first['rank']}:{first['block']}"
        sizes, p = (rows["size"] * rows["n"]).tolist(), rows["p"].tolist()
        free = [0 < x < 1 for x in p]
        n = len(p)
        if not last:  # the smallest rows with words wait for the last block
            some = [i for i in range(n) if free[i] and sizes[i] > 0]
            n = some[-BALLAST] if len(some) > BALLAST else 0
        done, held = pivotal(rows["doc_id"].tolist()[:n], sizes[:n], p[:n], name)
        p = done + [x if sizes[n + i] > 0 else 0.0 for i, x in enumerate(p[n:])]
        if last and held is not None:
            p = settle(p, free, sizes, held, random.Random(name + ":last").random())
        return rows.assign(p=p)

    return run


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, rank, n_rows, source_size, target. sizes: (source, size) rows.

    Sources are ranked by code point, null last, and weigh weights[rank % len(weights)]. Together they get share of all
    sizes; a target stops at most times its source's size, and what is over goes to the others by weight, until none is above.
    Ranks come from a range partitioning. The level at which the targets are filled takes about log(sources) / log(CUTS) small aggregates.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    parts = table(totals.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    counts, before, base = sorted(map(tuple, parts.groupBy("part").count().collect())), {}, 0
    for part, n in counts:  # as many as there are shuffle partitions
        before[part], base = base, base + n
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    ranked = table(parts.withColumn("place", place).join(offsets, "part").withColumn("rank", F.col("before") + F.col("place")).withColumn("w", weight).select("source", "rank", "w", "n_rows", "source_size"))
    cap = F.col("source_size") * float(most)
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    # a source is full at the level full; level is found between two neighbouring values of full, by CUTS trial levels a job
    full = F.when(F.col("w") > 0, cap / F.col("w")).otherwise(0.0)
    low, high = -1.0, float("inf")
    while True:
        between = (full > low) & (full < high)
        cuts = ranked.where(between).agg(F.percentile_approx(full, [i / CUTS for i in range(CUTS + 1)], 10_000)).first()[0]
        if not cuts:
            break
        cuts = sorted({*cuts})
        filled = ranked.agg(*[F.sum(F.least(F.col("w") * c, cap)) for c in cuts]).first()
        low = max([low, *(c for c, x in zip(cuts, filled, strict=True) if x <= total)])
        high = min([high, *(c for c, x in zip(cuts, filled, strict=True) if x > total)])
    capped, weights_left = ranked.agg(F.sum(F.when(full <= low, cap).otherwise(0.0)), F.sum(F.when(full <= low, 0.0).otherwise(F.col("w")))).first()
    level = (total - capped) / weights_left if weights_left else max(low, 0.0)
    return ranked.select("source", "rank", "n_rows", "source_size", F.least(F.col("w") * level, cap).alias("target"))


def copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, n, source_size, target, copies: how often the mix takes each of the n equal rows of a document.

    size is the number of words of the text (null: 0). Rows that agree in doc_id, source and size share their number of
    copies. A null source is a source; a null doc_id a document. Documents without words get none. Other columns are ignored;
    an empty table gives none.

    Expected copies are target / source_size, so between 0 and most. Their whole part is taken; the fractions are rounded
    pairwise in blocks of about BLOCK documents, each block hands one fraction and its BALLAST smallest rows on, and these meet in blocks
    again, until each source has one block left, in which the last fraction is drawn and its words are made up for by small rows.
    A source's taken words so miss its target by less than its smallest such row holds, where it has more than a few rows.
    Reruns agree: blocks, order and draws come from hashes.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_copies(docs, weights, share, most, seed))


def _copies(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    sizes = docs.select(F.col("doc_id").cast("long"), "source", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("size"))
    units = table(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = table(targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64("doc_id", "size", F.lit(seed))
    goal = goal.withColumnRenamed("source", "of")
    rows = units.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumns({"key": key, "whole": F.floor(rate), "p": rate - F.floor(rate)})
    rows = rows.withColumn("block", F.pmod("key", F.ceil(F.col("n_rows") / BLOCK)))
    most_rows, out, level = goal.agg(F.max("n_rows")).first()[0] or 0, None, 0
    blocks, fewer = -(-most_rows // BLOCK), BLOCK // (BALLAST + 1)
    while True:
        # a source that is down to one block settles in it, whatever the others have left
        alone = F.col("n_blocks") <= 1
        rows = rows.withColumn("n_blocks", F.ceil(F.ceil(F.col("n_rows") / BLOCK) / F.lit(fewer**level)))
        settled = rows.where(alone).groupBy("rank", "block").applyInPandas(_round_block(level, seed, True), rows.schema)
        if blocks > 1:
            settled = settled.unionByName(rows.where(~alone).groupBy("rank", "block").applyInPandas(_round_block(level, seed, False), rows.schema))
        done = table(settled)
        whole = done if blocks <= 1 else done.where("p in (0, 1)")
        out = whole if out is None else out.unionByName(whole)
        if blocks <= 1:
            break
        rows = done.where("p not in (0, 1)").withColumn("block", F.expr(f"block div {fewer}"))
        blocks, level = -(-blocks // fewer), level + 1
    return out.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as copies() says, whatever its columns are called."""
    taken = copies(docs, **how).where("copies > 0").withColumnsRenamed({"doc_id": "d", "source": "s", "size": "z"})
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size.alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    # there is a row taken for about each document, so this side grows with the input and is not broadcast at any size
    both = rows.join(taken.select("d", "s", "z", "copies").hint("merge"), same)
    return both.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document: what the mix takes of it, in words."""
    c = copies(docs).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return c.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
