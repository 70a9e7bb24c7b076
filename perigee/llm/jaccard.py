"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence, with size-derived bounds.

Two documents link when the Jaccard likeness of their sets of five-word shingles is at least 0.8. A set of n shingles can
only link with one that shares at least t = ceil(0.8 n) of its shingles. The steps, all exact:

1. Equal sets are one class, told by a digest, so copies make no pairs.
2. The incidence matrix is dealt into blocks by shingle. Each block counts the shingles that sets of two or more classes
   hold, and each class adds up how many of its own are among them. A class with fewer than t cannot link and goes; of
   ordinary texts few are left. A task first counts within itself, so a shingle of very many documents is one entry a task.
   Blocks hold parts of hashes, and err on the safe side: classes of one ref all stay, and so do shingles that clash count.
3. For the classes left, shingles get their exact frequency. In the order of rising frequency two linked sets meet first
   in the first n - t + 1 shingles of both: these incidences alone form the blocks of the product, one block a shingle.
4. Of each block first only the pairs with one hub are multiplied out, the class with the largest share of shingles that
   others hold (of a group of edited copies: the original). Linked classes are then one component.
5. Then the pairs of a block whose components still differ, within neighbouring bands of size. The join itself applies
   the bounds of size and of position: if two sets meet first at places i and j, they share at most the lesser of
   n_a - i and n_b - j shingles. Pairs that cannot link are never rows, nor are pairs within a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WordHashes, components, discard, materialize, shingle_hashes, small_side, tidy, words_of

#: Incidences of one block of step 2, and those that a task counts together before it deals them out.
BLOCK_INCIDENCES, TASK_INCIDENCES = 1_500_000, 500_000
#: Bytes of a shingle within its block and of a set (its ref), by which step 2 tells them apart: together 64 bits.
ENTRY, REF = 3, 5
#: Sizes of linked sets differ by a factor of at most 1.25, so they lie in the same band of size or in neighbouring ones.
BAND = 1.25


def least_shared(n):
    """The fewest shingles that a set of n shares with a set it links with: ceil(0.8 n), in whole numbers."""
    return (4 * n + 4) // 5


def _binaries(data: np.ndarray, sizes) -> pa.Array:
    """A binary array whose entries take sizes[i] elements of data each."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]) * data.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _ref(key: bytes, width: int) -> int:
    """The ref of a set, from its digest; 0 stands for several sets."""
    return max(1, int.from_bytes(key[:width], "little"))


def _sets(docs: DataFrame, per_batch, schema: str) -> DataFrame:
    """mapInArrow over (doc_id, text) where per_batch gets the ids, the shingle sets and their digests (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                sets = [shingle_hashes(words_of(t), table) for t in part.column(1).to_pylist()]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield per_batch(part.column(0), sets, keys)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, width: int = REF) -> DataFrame:
    """(doc_id, n, key, ref), written: the size, the digest and the ref, of width bytes, of the set of every document."""

    def narrow(ids, sets, keys):
        refs = [_ref(k, width) if k else None for k in keys]
        return pa.RecordBatch.from_arrays([ids, pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(refs, pa.int64())], ["doc_id", "n", "key", "ref"])

    return materialize(_sets(docs, narrow, "doc_id bigint, n bigint, key binary, ref bigint"))


def _whole(docs: DataFrame) -> DataFrame:
    """(key, n, set): the sorted shingle hashes of every document that has any, as 64-bit numbers."""

    def whole(ids, sets, keys):
        n = [len(s) for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), _binaries(np.concatenate(sets), n)], ["key", "n", "set"])

    return _sets(docs, whole, "key binary, n bigint, set binary").where("key is not null")


def _packed(numbers: np.ndarray, width: int) -> np.ndarray:
    """The `width` low-order bytes of each number, as one entry each."""
    raw = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(raw).view(f"V{width}").ravel()


def _unpacked(data: pa.Scalar, width: int) -> np.ndarray:
    raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end of the last."""
    return np.concatenate([np.zeros(1, np.int64), np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _task_blocks(held: dict[bytes, np.ndarray], blocks: int, widths: tuple[int, int]) -> pa.RecordBatch:
    """A row for each block with entries (part of the shingle, ref; ref 0: held by several sets here), and one of the shingles that
    each set shares here. held: the sets by their digests, so copies count once and sets of one ref are still two.

    A set's shingles that have one entry with another shingle here count as shared: within a block they may be taken for one.
    """
    entry_bytes, ref_bytes = widths
    refs, sets = np.array([_ref(k, ref_bytes) for k in held], np.uint64), list(held.values())
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, of = flat[order], of[order]
    at = _runs(flat)
    starts, many = at[:-1], np.diff(at) > 1
    here = np.bincount(of[np.repeat(many, np.diff(at))], minlength=len(refs))
    flat, of = flat[starts], of[starts]
    block = (flat >> np.uint64(32)) % np.uint64(blocks)
    cell = block << np.uint64(8 * entry_bytes) | flat & np.uint64(256**entry_bytes - 1)
    order = np.argsort(cell)
    cell = _runs(cell[order])
    clash = np.repeat(np.diff(cell) > 1, np.diff(cell)) & ~many[order]
    here += np.bincount(of[order][clash], minlength=len(refs))
    ref = np.where(many, np.uint64(0), refs[of])
    sizes = np.bincount(block.astype(np.int64), minlength=blocks)
    used, counted = np.flatnonzero(sizes), np.flatnonzero(here)
    sizes = np.append(sizes[used], len(counted))
    entries = np.concatenate([_packed(flat[order], entry_bytes), _packed(np.minimum(here[counted], 256**entry_bytes - 1), entry_bytes)])
    rows = [pa.array(np.append(used, int(refs[0]) % blocks).astype(np.int32)), _binaries(entries, sizes), _binaries(np.concatenate([_packed(ref[order], ref_bytes), _packed(refs[counted], ref_bytes)]), sizes), pa.array([False] * len(used) + [True])]
    return pa.RecordBatch.from_arrays(rows, ["block", "entries", "refs", "counts"])


def shared_counts(docs: DataFrame, total: int, widths: tuple[int, int] = (ENTRY, REF)) -> DataFrame:
    """(ref, shared): how many shingles of a set at least one other set holds, or more. total: the sizes of all sets.

    Never too few for a set whose ref no unlike set has: whatever else holds one of its shingles then has another ref, in its
    task or its block, and shingles of its own that clash are counted beforehand. Sets of one ref may be taken for one, so
    their count says nothing, and the caller must keep them. widths: the bytes of an entry and of a ref; counts end at 256**entry - 1.
    """
    entry_bytes, ref_bytes = widths
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, -(-total // BLOCK_INCIDENCES))
    parts = max(parts, blocks // 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = WordHashes(), {}, 0
        for batch in batches:
            for text in batch.column(0):
                s = shingle_hashes(words_of(text.as_py()), table)
                if len(s) and (key := xxhash.xxh3_128_digest(s.tobytes())) not in held:
                    held[key] = s
                    size += len(s)
                if size >= TASK_INCIDENCES:
                    yield _task_blocks(held, blocks, widths)
                    held, size = {}, 0
        if size:
            yield _task_blocks(held, blocks, widths)

    def count(table: pa.Table) -> pa.Table:
        keys, out = [], []
        for e, r, counts in zip(table.column("entries"), table.column("refs"), table.column("counts").to_pylist(), strict=True):
            if counts:
                out.append((_unpacked(r, ref_bytes), _unpacked(e, entry_bytes)))
            else:
                keys.append(_unpacked(e, entry_bytes) << np.uint64(8 * ref_bytes) | _unpacked(r, ref_bytes))
        if keys:
            key = np.unique(np.concatenate(keys))  # a copy in another task is the same set
            entry, ref = key >> np.uint64(8 * ref_bytes), key & np.uint64(256**ref_bytes - 1)
            at = _runs(entry)
            several = (np.diff(at) > 1) | (ref[at[:-1]] == 0)
            found, n = np.unique(ref[np.repeat(several, np.diff(at))], return_counts=True)
            out.append((found[found != 0], n[found != 0]))
        ref, n = np.concatenate([r for r, _ in out]), np.concatenate([n for _, n in out]).astype(np.int64)
        part = (ref % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        used, sizes = np.unique(part, return_counts=True)
        return pa.table({"part": pa.array(used, pa.int32()), "refs": _binaries(ref[order].astype(np.int64), sizes), "shared": _binaries(n[order], sizes)})

    def add(table: pa.Table) -> pa.Table:
        ref, n = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(c)]) for c in ("refs", "shared"))
        found, at = np.unique(ref, return_inverse=True)
        return pa.table({"ref": pa.array(found), "shared": pa.array(np.bincount(at, weights=n).astype(np.int64))})

    dealt = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(tidy(deal), "block int, entries binary, refs binary, counts boolean")
    counted = dealt.groupBy("block").applyInArrow(count, "part int, refs binary, shared binary")
    return counted.groupBy("part").applyInArrow(add, "ref bigint, shared bigint")


def sharing(classes: DataFrame, counts: DataFrame, entry_bytes: int = ENTRY) -> DataFrame:
    """The classes that share as many shingles as a link asks, or whose count does not say: one ref with another, or too large for it."""
    marked = classes.withColumn("alike", F.count("*").over(Window.partitionBy("ref")))
    return marked.join(counts, "ref", "left").where(f"5 * coalesce(shared, 0) >= 4 * n or alike > 1 or n >= {256**entry_bytes}")


def _incidences(left: DataFrame) -> DataFrame:
    """(shingle, class, n) of a table (class, n, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets, n = [np.frombuffer(s.as_buffer(), np.int64) for s in part.column(2)], part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(n, n))], ["shingle", "class", "n"])

    return left.select("class", "n", "set").mapInArrow(tidy(run), "shingle bigint, class bigint, n bigint")


def prefixes(left: DataFrame) -> DataFrame:
    """(shingle, class, n, place, alone), written: the incidences of step 3. place: of the shingle in the order of frequency;
    alone: the share of the class's shingles that no other holds. left: (class, n, set), written."""
    often = materialize(_incidences(left).groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"))
    found = _incidences(left).join(often, "shingle")
    own = found.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("s"))
    # shingles that no other class holds come first, and make no pair
    own = own.select("class", "n", (F.col("n") - F.size("s")).alias("first"), "s").where("5 * size(s) >= 4 * n")
    own = own.select("class", "n", "first", F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), (F.col("n") - F.expr("(4 * n + 4) div 5") + 1 - F.col("first")).cast("int")))).alias("i", "x"))
    out = materialize(own.select(F.col("x.shingle").alias("shingle"), "class", "n", (F.col("first") + F.col("i")).alias("place"), (F.col("first") / F.col("n")).alias("alone")))
    discard(often)
    return out


def _verified(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, written."""
    a, b = left.select(F.col("class").alias("a"), F.col("set").alias("set_a")), left.select(F.col("class").alias("b"), F.col("set").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= 80 * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")
    return materialize(both.mapInArrow(tidy(run), "a bigint, b bigint"))


_FITS = "5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a"
#: Linked sets share at least 4/9 of both sizes together, and no more than either has from their first meeting on.
_MEETS = "least(n_a - place_a, n_b - place_b) >= (4 * (n_a + n_b) + 8) div 9"


def links(inc: DataFrame, left: DataFrame) -> DataFrame:
    """(node, component) of all linked classes, of steps 4 and 5. inc: prefixes(left)."""
    hubs = inc.groupBy("shingle").agg(F.count("*").alias("m"), F.min(F.struct("alone", "class", F.col("n").alias("n_a"))).alias("hub")).where("m > 1")
    hubs = materialize(hubs.select("shingle", F.col("hub.class").alias("a"), F.col("hub.n_a").alias("n_a")))
    stars = inc.select("shingle", F.col("class").alias("b"), F.col("n").alias("n_b")).join(hubs, "shingle").where("a <> b").where(_FITS)
    stars = materialize(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    linked = _verified(stars, left)
    comps = components(linked)
    # the pairs of a block whose components differ; most of a block is of one component, and the rest meets all of it
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")
    named = inc.join(comps, F.col("class") == F.col("node"), "left").select("shingle", "class", "n", "place", F.coalesce("component", "class").alias("comp"), size.alias("band"))
    named = materialize(named)
    mixed = named.groupBy("shingle", "comp").count().groupBy("shingle").agg(F.count("*").alias("m"), F.max_by("comp", F.struct("count", "comp")).alias("main")).where("m > 1")
    mixed = materialize(named.join(materialize(mixed.select("shingle", "main")), "shingle"))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("n", "place", "comp")]
    few = mixed.where("comp <> main").select("shingle", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("class").alias("a"), *side("a"))
    rest = few.join(mixed.select("shingle", "band", F.col("class").alias("b"), *side("b")), ["shingle", "band"]).where("comp_a <> comp_b").where(_FITS).where(_MEETS)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = materialize(rest.join(stars, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = _verified(rest, left)
        if not more.isEmpty():
            comps = components(linked.unionByName(more))
    discard(hubs, stars, linked, named, mixed, rest)
    return comps


def join(docs: DataFrame, widths: tuple[int, int] = (ENTRY, REF)) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    component_id is the smallest doc_id reachable by links, the document's own included. A null or empty text, or one
    without words, has an empty set and is linked with nothing. Every row is a document: repeated rows link as equal texts
    do, rows of one doc_id with unlike texts only if these link. A null doc_id counts after all others; a component of none
    but null ones has null. An empty table gives no rows; other columns are ignored. Shingles are told apart by 64-bit hashes.
    widths: the bytes by which step 2 tells shingles and sets apart; fewer let more classes through to the steps after it, which
    are exact, and change no row.
    """
    docs = docs.select("doc_id", "text")
    rows = digests(docs, widths[1])
    classes = rows.where("key is not null").groupBy("key", "ref", "n").agg(F.min("doc_id").alias("least"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = materialize(sharing(classes, shared_counts(docs, total, widths), widths[0]).select("key", "class"))
    left = materialize(_whole(docs).join(small_side(kept), "key").select("class", "n", "set").dropDuplicates(["class"]), "uncompressed")
    inc = prefixes(left)
    comps = links(inc, left)
    named = materialize(classes.join(comps, F.col("class") == F.col("node"), "left").select("key", F.coalesce("component", "class").alias("component"), "least"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = materialize(named.join(lowest, "component").select("key", "component_id"))
    discard(classes, kept, left, inc, named)
    out = rows.join(answer, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
inc AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM inc a JOIN inc b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 80 * (na + nb - shared)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, w.b FROM reach r JOIN both_ways w ON w.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""
