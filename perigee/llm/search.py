"""Ranked lexical search: dense blocked matrix products of item weights and document impacts, exact in float64.

Items come in blocks, and a block's items in tiles that share a compact vocabulary: the distinct terms of the tile alone. A
tile of documents gives a dense matrix of impacts over that vocabulary, and one BLAS product gives all scores of the two
tiles. Weights and impacts are whole numbers; so many terms are multiplied at a time that no partial sum reaches 2^53, and
the products of further terms are added as 64-bit integers. Each task keeps the best of every item, ties by doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import tidy

#: Answers of an item.
TOP = 10
#: Terms and repeats of a term in the items of one block; a block is a pass over the documents.
BLOCK_TERMS = 200_000
#: Items and documents of a tile, and the most terms that are multiplied at a time.
ITEM_TILE, DOC_TILE, TERM_TILE = 32, 512, 4096
#: Above every impact.
IMPACT = 1_000_000
#: Parts in which the tasks' answers of one item are ranked first.
PARTS = 32
#: Letters, digits and all bytes of other characters make terms; A-Z are lower-cased, the rest are blanks.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_CLEAN).split() if text else []


def _counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, list[int]]:
    """Documents with a term, all their terms, and for each term of the vocabulary the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, df = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = terms_of(text)
                if words:
                    held, total = held + 1, total + len(words)
                    ids = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
                    df[np.unique(ids[ids >= 0])] += 1
        seen = np.flatnonzero(df)
        term = np.concatenate([[-2, -1], seen])
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.concatenate([[held, total], df[seen]]))], ["term", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(tidy(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term of the block
    got = {r["term"]: r["n"] for r in rows}
    return got.get(-2, 0), got.get(-1, 0), [got.get(i, 0) for i in range(len(vocabulary))]


class _Best:
    """The best answers of the items of a tile so far: by score, falling, then by doc_id, null last."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.rows = top, [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * items
        self.least = np.ones(items, np.int64)  # a score below this is no answer

    def offer(self, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least[:, None]
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            at = np.flatnonzero(good[i])
            score, null, own = (np.concatenate([a, b]) for a, b in zip(self.rows[i], (scores[i, at], none[at], ids[at]), strict=True))
            if len(score) > 4 * self.top:  # what ties with the last place stays
                keep = score >= np.partition(score, len(score) - self.top)[len(score) - self.top]
                score, null, own = score[keep], null[keep], own[keep]
            order = np.lexsort((own, null, -score))[: self.top]
            self.rows[i] = score[order], null[order], own[order]
            if len(order) == self.top:
                self.least[i] = max(1, score[order[-1]])


def _tiles(items: list[list[int]], weights: np.ndarray, width: int, terms_at_once: int) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each tile of items its first item and, in parts of few enough terms, the terms and the items' weights of them."""
    out = []
    for first in range(0, len(items), width):
        tile = items[first : first + width]
        terms = np.unique(np.concatenate([np.array(t, np.int64) for t in tile]))
        most = max(1, min(terms_at_once, (2**53 - 1) // (max(1, int(weights[terms].max(initial=0))) * IMPACT)))
        parts = []
        for at in range(0, len(terms), most):
            own = terms[at : at + most]
            w = np.zeros((len(tile), len(own)))
            for i, t in enumerate(tile):
                t = np.intersect1d(np.array(t, np.int64), own)
                w[i, np.searchsorted(own, t)] = weights[t]
            parts.append((own, w))
        out.append((first, parts))
    return out


def _ranked(docs: DataFrame, items: list[tuple[int, list[int]]], vocabulary: dict[bytes, int], top: int) -> DataFrame:
    """(item_id, item, doc_id, score): every task's best answers of a block of items."""
    held, total, df = _counts(docs, vocabulary)
    weights = np.array([math.floor(1000 * math.log((2 * held + 2) / (2 * n + 1))) for n in df], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = _tiles([t for _, t in items], weights, ITEM_TILE, TERM_TILE)
        best = [_Best(min(ITEM_TILE, len(items) - first), top) for first, _ in tiles]
        column = np.full(len(vocabulary), -1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                ids = part.column(0)
                none, ids = np.array(ids.is_null()), ids.fill_null(0).to_numpy()
                which, term, impact = [], [], []
                for d, text in enumerate(part.column(1).to_pylist()):
                    words = terms_of(text)
                    if words:
                        m = 10 + 90 * len(words) * held // total
                        found = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
                        t, tf = np.unique(found[found >= 0], return_counts=True)
                        which.append(np.full(len(t), d))
                        term.append(t)
                        impact.append(1_000_000_000 * tf // (1000 * tf + 8 * m))
                if not which:
                    continue
                which, term, impact = np.concatenate(which), np.concatenate(term), np.concatenate(impact)
                for (_, parts), answers in zip(tiles, best, strict=True):
                    scores = None
                    for own, w in parts:
                        column[own] = np.arange(len(own))
                        at_column = column[term]
                        column[own] = -1
                        hit = at_column >= 0
                        tile = np.zeros((len(none), len(own)))
                        tile[which[hit], at_column[hit]] = impact[hit]
                        product = (w @ tile.T).astype(np.int64)
                        scores = product if scores is None else scores + product
                    if scores is not None:
                        answers.offer(scores, none, ids)
        for (first, _), answers in zip(tiles, best, strict=True):
            for i, (score, null, own) in enumerate(answers.rows, first):
                if len(score):
                    yield pa.RecordBatch.from_arrays([pa.array([items[i][0]] * len(score), pa.int64()), pa.array([i] * len(score), pa.int64()), pa.array(own, mask=null), pa.array(score)], ["item_id", "item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(tidy(run), "item_id bigint, item bigint, doc_id bigint, score bigint")


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, list[int]]], dict[bytes, int]]]:
    """Blocks of items (item_id, numbers of their distinct terms) with the block's vocabulary; an item is never cut."""
    block, vocabulary, size = [], {}, 0
    for r in items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary")).toLocalIterator():
        terms = dict.fromkeys(terms_of(bytes(r["text"]) if r["text"] is not None else None))
        if block and size + len(terms) > BLOCK_TERMS:
            yield block, vocabulary
            block, vocabulary, size = [], {}, 0
        if terms:
            block.append((r["item_id"], [vocabulary.setdefault(t, len(vocabulary)) for t in terms]))
            size += len(terms)
    if block:
        yield block, vocabulary


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for every row of items (item_id, text) its best documents with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A term's weight falls with the number of
    documents that hold it, its impact rises with its share of a document; counts are over all documents. Equal scores come
    by doc_id, rising, null last. A document or item that is null, empty or without terms meets nothing. Repeated documents
    are documents of their own, and each repeated item gets its own answers. Very long texts are read whole. Empty tables
    give no rows; other columns are ignored.

    Items are gathered at the driver a block at a time, at most BLOCK_TERMS terms or one item; a block reads the documents
    twice, for counts and for scores. A task sends at most `top` rows an item; these are ranked in PARTS parts, then by item.
    """
    out = None
    for number, (block, vocabulary) in enumerate(_blocks(items)):
        rows = _ranked(docs, block, vocabulary, top).withColumn("block", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    out = out.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("block", "item", "part").orderBy(*order))).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS.format(t="text")} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, row_number() OVER () AS num, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sized),
asked AS (SELECT item_id, unnest(list_distinct({_TERMS.format(t="text")})) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT num, doc_id, n, term, count(*) AS tf FROM (SELECT num, doc_id, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
scored AS (SELECT item_id, num, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term), whole GROUP BY item_id, num, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
