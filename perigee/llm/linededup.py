"""Line dedup by a log-template tree of fixed depth.

A line goes down three levels: its token count, its leading token, and the rest of it. Every token that holds a digit is
generalised to <*>, if at least half of the line's tokens hold none; else the line is taken as it is, so rows of numbers are alike
only if they are equal. At the third level a line lies in several nodes: its rest, and the rest with fields of letters taken out.
In a line of GENERAL tokens or more these are one or two of four stretches, alike in length, any two of which may vary; in a
shorter line any one or two tokens after the first. What is left must hold CONSTANT tokens without a digit and half of the line
at least. A template that recurs across groups of near copies is dropped from all documents.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LIKENESS, SHINGLE, TABLE_ENTRIES, components, discard, free_names, materialize, mix, numbered, small_side, tidy

#: The tokens from which two of STRETCHES stretches may vary, and the fewest constant tokens beside a field of letters.
GENERAL, STRETCHES, CONSTANT = 8, 4, 3
#: Groups of near copies in which a template must recur, and the fewest tokens of a line that may be dropped.
RECURS, LEAST_TOKENS = 3, 1
#: Minima of a document's signature and those of one band. Of two documents of likeness 0.8, all but one pair in 4,000 share a band.
MINIMA, BAND = 64, 4
#: The most signatures that are broadcast.
SENT_SIGNATURES = 50_000


class _TokenHashes(dict):
    """Hashes of tokens, odd for those with a digit and even for the others."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token) & ~1 | (_DIGIT.search(token) is not None)
        return value


_DIGIT = re.compile(rb"[0-9]")
_VARIABLE = np.uint64(xxhash.xxh64_intdigest(b"<*>") | 1)


def template_keys(exact: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of all templates of lines of the given sizes, whose token hashes follow each other in exact.

    A key is a sum of the hashes, each times a factor of its place, so variable tokens are taken out by subtraction; it
    depends on the token count and, as the first token is never taken out, on the leading token.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    digit = (exact & np.uint64(1)).astype(bool)
    tokens = np.where(digit, _VARIABLE, exact)
    factors = (mix(np.arange(1, int(sizes.max(initial=0)) + 1, dtype=np.uint64)) | np.uint64(1))[np.arange(len(tokens)) - np.repeat(starts, sizes)]
    added = lambda x: np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    sums, wholes, constant = added(tokens * factors), added(exact * factors), added((~digit).astype(np.int64))
    total, constants, half = sums[ends] - sums[starts], constant[ends] - constant[starts], (sizes + 1) // 2
    salt = mix(sizes.astype(np.uint64) + np.uint64(1))
    line = np.flatnonzero(sizes >= LEAST_TOKENS)
    told = np.where(constants >= half, total, wholes[ends] - wholes[starts])
    lines, keys = [line], [mix(told[line] + salt[line])]

    def add(line: np.ndarray, form: int, *fields: tuple[np.ndarray, np.ndarray]) -> None:
        out, left = np.zeros(len(line), np.uint64), constants[line]
        for low, high in fields:
            out, left = out + sums[high] - sums[low], left - (constant[high] - constant[low])
        good = left >= np.maximum(CONSTANT, half[line])
        line, out = line[good], out[good]
        lines.append(line)
        keys.append(mix(total[line] - out + salt[line] * np.uint64(2 * form + 3)))

    form = 0
    for fields in [(p,) for p in range(1, GENERAL - 1)] + list(itertools.combinations(range(1, GENERAL - 1), 2)):
        form += 1
        line = np.flatnonzero((sizes >= max(CONSTANT + len(fields), LEAST_TOKENS)) & (sizes < GENERAL) & (sizes > fields[-1]))
        add(line, form, *[(starts[line] + p, starts[line] + p + 1) for p in fields])
    line = np.flatnonzero(sizes >= max(GENERAL, LEAST_TOKENS))
    borders = [starts[line] + 1 + (sizes[line] - 1) * k // STRETCHES for k in range(STRETCHES + 1)]
    for i, j in itertools.combinations(range(STRETCHES), 2):
        form += 1
        add(line, form, (borders[i], borders[i + 1]), (borders[j], borders[j + 1]))
    return np.concatenate(lines), np.concatenate(keys)


_ODD = mix(np.arange(1, SHINGLE + MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MINIMA minima, of 32 bits, over the five-token shingles of each document; fewer tokens make one shingle. sizes: their tokens, at least one."""
    padded = sizes + np.maximum(SHINGLE - sizes, 0)
    flat = np.zeros(int(padded.sum()), np.uint64)
    starts = np.cumsum(padded) - padded
    flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(tokens))] = tokens
    many = padded - SHINGLE + 1
    first = np.cumsum(many) - many
    at = np.repeat(starts - first, many) + np.arange(int(many.sum()))
    shingles = mix(sum(flat[at + i] * _ODD[i] for i in range(SHINGLE)))
    out = np.empty((len(sizes), MINIMA), np.uint32)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(shingles * _ODD[SHINGLE + k], first) >> np.uint64(32)
    return out


def _keys(docs: DataFrame) -> DataFrame:
    """(rid, node, key, line, first, sig). A row without sig for each line and template: line holds its number, first is 1 once
    for each document and template. A row with sig, the signature, for each document with tokens; node is a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _TokenHashes()
        names = ["rid", "node", "key", "line", "first", "sig"]
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                tokens: list[bytes] = []
                sizes, numbers, of = [], [], []
                for d, text in enumerate(part.column(1).to_pylist()):
                    for i, line in enumerate((text or b"").split(b"\n")):
                        found = line.split()
                        if found:
                            tokens += found
                            sizes.append(len(found))
                            numbers.append(i)
                            of.append(d)
                if not tokens:
                    continue
                sizes, numbers, of = np.array(sizes, np.int64), np.array(numbers, np.int32), np.array(of, np.int64)
                total = np.bincount(of, weights=sizes, minlength=part.num_rows).astype(np.int64)
                held = np.flatnonzero(total)
                exact = np.fromiter(map(table.__getitem__, tokens), np.uint64, len(tokens))
                marks = [m.tobytes() for m in signatures(exact, total[held])]
                node = np.zeros(part.num_rows, np.int64)
                node[held] = np.array([xxhash.xxh64_intdigest(m) for m in marks], np.uint64).view(np.int64)
                none = [pa.nulls(len(held), kind) for kind in (pa.int64(), pa.int32(), pa.int8())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(held)), pa.array(node[held]), *none, pa.array(marks, pa.binary())], names)
                line, key = template_keys(exact, sizes)
                doc = of[line]
                order = np.lexsort((key, doc))
                line, key, doc = line[order], key[order], doc[order]
                first = np.ones(len(key), np.int8)
                first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                columns = [part.column(0).take(pa.array(doc)), pa.array(node[doc]), pa.array(key.view(np.int64)), pa.array(numbers[line]), pa.array(first), pa.nulls(len(key), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("rid", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "rid bigint, node bigint, key bigint, line int, first tinyint, sig binary")


def near_copies(signed: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have near copies, from a written table (node, sig) of distinct nodes.

    Signatures that agree in a band are compared with the least node of that band; at least LIKENESS of the minima must
    be equal. No pairs are formed within a band, so a band of many documents costs as many rows.
    """
    bands = [F.xxhash64(F.lit(k), F.substring("sig", 4 * BAND * k + 1, 4 * BAND)) for k in range(MINIMA // BAND)]
    rows = materialize(signed.select("node", F.explode(F.array(*bands)).alias("band")))
    least = materialize(rows.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    pairs = materialize(rows.join(small_side(least), "band").where("node <> least").select("node", "least").distinct())
    tops = materialize(pairs.select("least").distinct())
    heads = materialize(signed.select(F.col("node").alias("least"), F.col("sig").alias("b")).join(small_side(tops), "least"))
    both = pairs.join(small_side(heads, SENT_SIGNATURES), "least").join(signed.select("node", F.col("sig").alias("a")), "node")
    same = sum(F.when(F.substring("a", 4 * k + 1, 4) == F.substring("b", 4 * k + 1, 4), 1).otherwise(0) for k in range(MINIMA))
    out = components(both.where(same >= LIKENESS * MINIMA).select(F.col("node").alias("a"), F.col("least").alias("b")))
    discard(rows, least, pairs, tops, heads)
    return out


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(rid, dropped), written: numbers of the lines, from 0, that go from each document (rid, text) with a recurring template."""
    made = materialize(_keys(docs))
    keys = made.where("sig is null").drop("sig")
    signed = materialize(made.where("sig is not null").groupBy("node").agg(F.min("sig").alias("sig")))
    near = materialize(near_copies(signed))
    often = materialize(keys.groupBy("key").agg(F.sum("first").alias("n")).where(F.col("n") >= RECURS).select("key"))
    found = materialize(keys.join(small_side(often), "key"))
    discard(made, signed)
    grouped = found.where("first = 1").join(small_side(near), "node", "left").select("key", F.coalesce("component", "node").alias("copies")).distinct()
    real = materialize(grouped.groupBy("key").count().where(F.col("count") >= RECURS).select("key"))
    gone = materialize(found.join(small_side(real), "key").groupBy("rid").agg(F.array_sort(F.collect_set("line")).alias("dropped")))
    discard(near, often, found, real)
    return gone


def dedup(docs: DataFrame) -> DataFrame:
    """docs without its recurring lines, with n_lines and dropped (line numbers from 0); n_chars is of the new text.

    Lines end at a line feed; tokens are what blanks separate, in their own case. Documents are first put into groups of
    near copies: five-token shingles of a likeness of 0.8 or more, estimated from MINIMA minima, and what such pairs connect.
    A template counts once a group, whatever share of a document is found elsewhere: copies of a document do not make its own
    lines recurring, so they are left whole for a later stage, but lose lines that recur in other groups. Empty and blank
    lines stay. A null text stays null, an empty one empty; a text that loses all its lines becomes empty. Every row counts
    by itself: equal rows are copies and fare alike. Columns of docs stay as they are; where it has an n_lines or dropped of
    its own, the new one gets an underscore. An empty table gives no rows. Very long texts and lines are taken whole.
    """
    number, cut, lines_name, dropped_name = (*free_names(docs, "row", "cut"), *free_names(docs, "n_lines", "dropped"))
    named = numbered(docs, number)
    gone = dropped_lines(named.select(F.col(number).alias("rid"), "text")).select(F.col("rid").alias(number), F.col("dropped").alias(cut))
    rows = named.join(gone.hint("merge"), number, "left")  # one plan at every size
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(cut, i)), "\n")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias(c) if c == "text" else F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return rows.select(*columns, lines.alias(lines_name), F.coalesce(cut, F.array().cast("array<int>")).alias(dropped_name))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped, and the text that is left."""
    rows = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped", "text")
