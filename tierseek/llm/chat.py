"""Chat formatting: logged snapshots that begin a longer conversation collapse into it, and what is left is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed template: one block for each turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _hash(*columns: Column) -> Column:
    """A 44-bit hash: a sum of up to 2^19 of them stays within a long."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 44) - 1))


def turns(df: DataFrame) -> DataFrame:
    """conv_id, k (1, 2, ...), role, text, a, b, n, whole_a, whole_b: turns with their rolling prefix hashes.

    (a, b) after turn k are two sums of hashes of (place, role, text) over the turns up to k, 88 bits together; they are equal
    for two conversations whose first k turns are equal. n, whole_a and whole_b are the conversation's own.
    """
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    rows = rows.withColumn("k", F.row_number().over(order))
    a, b = _hash(F.lit(1), "k", "role", "text"), _hash(F.lit(2), "role", "k", "text")
    rows = rows.withColumns({"ha": a, "hb": b})
    return rows.select(
        "conv_id", "k", "role", "text",
        F.sum("ha").over(upto).alias("a"), F.sum("hb").over(upto).alias("b"),
        F.count(F.lit(1)).over(whole).cast("int").alias("n"), F.sum("ha").over(whole).alias("whole_a"), F.sum("hb").over(whole).alias("whole_b"),
    )


def collapse(df: DataFrame) -> DataFrame:
    """conv_id, n of the maximal conversations: those whose turns aren't the first turns of a longer one.

    Of equal conversations the smallest conv_id stays. Both sides of the anti-join have one row for each distinct prefix,
    added up before any shuffle, so a conversation logged many times makes no large group.
    """
    rows = turns(df)
    whole = rows.where("k = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    shorter = rows.where("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    return whole.join(shorter, ["n", "a", "b"], "left_anti").select("conv_id", "n")


def render(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: each maximal conversation in one text, its turns in order.

    Turns are ordered by turn (null last), role and text; a row that repeats another's conv_id, turn, role and text counts once. A null role
    reads `unknown`, a null text is empty, rows without conv_id take no part. An empty table gives no rows; other columns are ignored.
    """
    kept = collapse(df).select("conv_id")
    block = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    rows = turns(df).select("conv_id", "k", block.alias("block")).join(kept, "conv_id", "left_semi")
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "block"))).alias("t"))
    return got.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["block"]), "\n").alias("text"))


RENDER_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, k, n, list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM o),
f AS (SELECT n, prefix, min(conv_id) AS conv_id FROM p WHERE k = n GROUP BY n, prefix),
m AS (SELECT conv_id FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = f.n AND p.prefix = f.prefix))
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY k) AS text
FROM o WHERE conv_id IN (SELECT conv_id FROM m) GROUP BY conv_id
"""
