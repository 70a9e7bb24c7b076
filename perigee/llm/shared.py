"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import threading

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh

#: Words of a shingle, and the likeness from which two documents count as near copies.
SHINGLE, LIKENESS = 5, 0.8
#: A table of at most this many narrow rows may be broadcast; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The blank characters between words, as in the class [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class _Recorded(threading.local):
    """Where recording() is in force in a thread: the paths that materialize() has written and discard() has not deleted."""

    def __init__(self) -> None:
        self.sets: list[set[str]] = []


_RECORDED = _Recorded()


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = fresh(df.sparkSession)
    df.write.parquet(path, compression=compression)
    for paths in _RECORDED.sets:
        paths.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._perigee_path = path
    return out


def delete(spark: SparkSession, paths) -> None:
    for p in list(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        for recorded in _RECORDED.sets:
            recorded.discard(p)


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote for these tables; nothing that is still to run may read them."""
    for t in tables:
        delete(t.sparkSession, [t._perigee_path])


@contextlib.contextmanager
def recording():
    """Gives the set of paths that materialize() writes inside and that are still there."""
    paths: set[str] = set()
    _RECORDED.sets.append(paths)
    try:
        yield paths
    finally:
        _RECORDED.sets[:] = [x for x in _RECORDED.sets if x is not paths]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores added until df has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df, written, with a column `name` that no two rows share; the number of a row stays what it is."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), compression)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (a written, narrow table) as a broadcast side if it has at most limit rows, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of doc_id as text, modulo buckets: the fold of a document."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of non-blank characters, A-Z lower-cased. bytes.lower and bytes.split know ASCII only, as wanted."""
    return text.lower().split() if text else []


def tidy(run):
    """run, a function for mapInArrow, giving freed memory back to the system after each partition."""

    def whole(batches):
        yield from run(batches)
        import ctypes

        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


#: Entries of a table of word hashes that a task keeps.
TABLE_ENTRIES = 60_000


class WordHashes(dict):
    """64-bit hashes of words, kept in a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def hashes_of(words: list[bytes], table: WordHashes) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], table: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the five-word shingles; fewer words make one shingle, none make none."""
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64) if words else np.zeros(0, np.uint64)
    w, n = hashes_of(words, table), len(words) - SHINGLE + 1
    total = w[:n] * _STEP[0]
    for i in range(1, SHINGLE):
        total += w[i : i + n] * _STEP[i]
    return np.unique(mix(total))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in edges (a, b): component is the smallest node reachable.

    In each round every node hooks onto its smallest neighbour, parents are followed twice, and the edges are
    contracted. In two rounds at least half of the nodes that still have edges vanish: a node onto which none hooks in
    the first has a neighbour that went to a smaller one, so it hooks itself in the second. Only edge tables are shuffled.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialize(edges)
    labels = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent")))
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        first = parent
        for _ in range(2):
            parent = parent.join(up, "parent").select("node", F.col("above").alias("parent"))
        parent = materialize(parent)
        discard(first)
        before = labels
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "parent")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = materialize(labels)
        a, b = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        old, edges = edges, materialize(moved.where("a < b").distinct())
        discard(old, parent, *([before] if before is not None else []))
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], "node bigint, component bigint").select(F.col("node").cast(kind), F.col("component").cast(kind))
    return labels
