"""Helpers that several operators share: lineage cuts, word hashing, lambda bindings."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. ``bytes.split()`` splits on the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tierseek-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Paths of the tables written in the innermost open scope; None outside of any.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def table(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files go when the innermost scratch() around the call ends, or when the JVM does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tierseek-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As table(), but in buckets by key: later joins by key don't shuffle it. A table of the session's catalogue over files in the shared folder."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/tierseek-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    name = "tierseek_" + path.rsplit("/", 1)[1]
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return spark.table(name)


def unbucketed(df: DataFrame) -> DataFrame:
    """A bucketed table read as plain files, which Spark deals out by need."""
    files = df.inputFiles()
    return df.sparkSession.read.schema(df.schema).parquet(files[0].rsplit("/", 1)[0]) if files else df


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more, and let Spark free the shuffle files of the plans that read them."""
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS tierseek_{path.rsplit('/', 1)[1]}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """A scope for table(): what is written in it is deleted at its end, also after an error.

    Yields keep(df), which writes df as a table of the scope around and returns it; only such results may leave.
    """
    paths: list[str] = []
    token = _scope.set(paths)

    def keep(df: DataFrame) -> DataFrame:
        kept = table(df)
        outer = token.old_value if isinstance(token.old_value, list) else None
        (outer if outer is not None else []).append(paths.pop())
        return kept

    try:
        yield keep
    finally:
        _scope.reset(token)
        drop_tables(spark, paths)


#: Places of a filter of ids: 2^26 bits, 8 MB at most however many ids there are.
PLACES, PER_ROW = 1 << 26, 1 << 15


def among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is in the column of the same name of ids (distinct), with few of the others shuffled.

    A bitmap of hashed ids, of a fixed size, is broadcast and drops most other rows first; the more ids, the fewer it drops.
    """
    place = F.pmod(F.xxhash64(key), F.lit(PLACES))
    row, bit = F.floor(place / PER_ROW).cast("int"), (place % PER_ROW).cast("int")
    bits = ids.select(row.alias("__row"), bit.alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = df.withColumn("__row", row).join(F.broadcast(bits), "__row").where(F.getbit(byte, bit % 8) == 1)
    # ids grow with the input, so they aren't broadcast at any size; a semi join would be moved below the filter
    return near.select(df.columns).join(ids.select(key).hint("merge"), key)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row instead of once for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), vectorised."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Texts are hashed in slices of about so many bytes.
SLICE = 1 << 20
_SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_NEXT_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _weights(places: np.ndarray) -> np.ndarray:
    return mix((places.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93)) | U64(1)


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTES[_SPACES] = 0
_IS_SPACE = np.isin(np.arange(256), _SPACES)
_PLACES = _weights(np.arange(1 << 12))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: sums over a word's bytes, each weighed by its place in the word."""
    if len(data) <= SLICE:
        return _slice_hashes(np.frombuffer(data, np.uint8))
    parts, at = [], 0
    while at < len(data):  # slices end at white space, so each word is whole
        space = _NEXT_SPACE.search(data, at + SLICE)
        end = space.start() if space else len(data)
        parts.append(_slice_hashes(np.frombuffer(data[at:end], np.uint8)))
        at = end
    return np.concatenate(parts)


def _slice_hashes(b: np.ndarray) -> np.ndarray:
    space = _IS_SPACE[b]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(b) else b
    if len(starts) == 0:
        return np.zeros(0, U64)
    place = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
    weight = _PLACES[place] if place.max() < len(_PLACES) else _weights(place)
    return mix(np.add.reduceat(_BYTES[b[starts[0] :]] * weight, starts - starts[0]))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes; the whole sequence as one if shorter.

    Runs of 1, 2, 4, ... words are put together as the binary digits of k say.
    """
    if len(h) == 0:
        return h
    k = min(k, len(h))
    power, width, out, have = mix(h + U64(k)), 1, None, 0
    while True:
        if k & width:
            n = len(h) - have - width + 1
            out = power if out is None else mix(out[:n] * GOLDEN + power[have : have + n])
            have += width
        if have == k:
            return out
        power = mix(power[:-width] * GOLDEN + power[width:])
        width *= 2
