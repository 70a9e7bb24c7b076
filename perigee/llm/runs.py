"""Periodic runs of words: equal k-grams of a document seed diagonals, which are extended to maximal stretches.

A run of smallest period q and length l has w[i] = w[i + q] on l - q consecutive places: its overlap. Every lag below SEED
leaves an overlap of at least SEED words, so equal SEED-grams find it; there the next occurrence of a gram is at the
smallest period itself (Fine and Wilf), so only neighbouring occurrences are paired. Lags from k to 2k - 1, for k = SEED
and its doublings, leave an overlap of at least 2k: one of its k-grams starts at a multiple of k and recurs one lag on. So
only those grams are paired, with their occurrences from k to 2k - 1 words later: at most n pairs for each k, however
often a gram occurs. A pair inside a known run whose period divides the lag is that run again; along each lag, what has
been covered is not extended again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import TABLE_ENTRIES, mix, tidy

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: The least overlap that any period leaves.
SEED = min(max(LEAST - q, (TIMES - 1) * q) for q in range(1, LEAST))
SCHEMA = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """A number for each word, the same while the table is kept."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places whose value occurs more than once, by value and rising within one, and the number of each one's value."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return None
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    places = np.flatnonzero(twice[at] == h)
    group = at[places]
    order = np.argsort(group, kind="stable")
    return places[order], group[order]


def _stretch(w: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """The longest [a, b) around place i with w[j] = w[j + lag] on all of it; a = b if they differ at i."""
    ends = []
    for forward in (True, False):
        at, step = i, 64
        while True:
            m = min(step, len(w) - lag - at if forward else at)
            lo = at if forward else at - m
            same = w[lo : lo + m] == w[lo + lag : lo + lag + m]
            k = m if same.all() else int(same.argmin() if forward else same[::-1].argmin())
            at += k if forward else -k
            if k < m or m == 0:
                break
            step *= 2
        if forward and at == i:
            return i, i
        ends.append(at)
    return ends[1], ends[0]


def _extend(w: np.ndarray, places: np.ndarray, lags: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Extends the pairs (place, place + lag), by lag and place; found gets (start, end) with the smallest period."""
    order = np.lexsort((places, lags))
    covered: dict[int, int] = {}  # by lag, the end of the last stretch
    for i, lag in zip(places[order].tolist(), lags[order].tolist(), strict=True):
        if i < covered.get(lag, 0):
            continue
        a, b = _stretch(w, i, lag)
        covered[lag] = b
        if b > a and b - a + lag >= max(LEAST, TIMES * lag):
            found.setdefault((a, b + lag), lag)


def periodic_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in w, numbers of words, by start and period."""
    n, found = len(w), {}
    if n < LEAST:
        return []
    h, k = mix(w.astype(np.uint64) + _ODD), 1
    while k < SEED:
        h, k = h[:-k] * _ODD + mix(h[k:]), 2 * k
    seen = _repeats(h)
    if seen is None:
        return []
    places, group = seen
    lags = np.diff(places)
    near = (group[1:] == group[:-1]) & (lags < k)
    first, lags = places[:-1][near], lags[near]
    order = np.lexsort((first, lags))
    first, lags = first[order], lags[order]
    new = np.ones(len(first), bool)  # of seeds side by side on a diagonal the first is enough
    new[1:] = (lags[1:] != lags[:-1]) | (first[1:] != first[:-1] + 1)
    _extend(w, first[new], lags[new], found)
    while seen is not None and TIMES * k <= n:
        places, group = seen
        key = group * (n + 1) + places
        anchors = np.flatnonzero(places % k == 0)
        low = np.searchsorted(key, key[anchors] + k)
        high = np.searchsorted(key, group[anchors] * (n + 1) + np.minimum(places[anchors] + min(2 * k - 1, n // TIMES), n), side="right")
        many = np.maximum(0, high - low)
        i = np.repeat(places[anchors], many)
        lags = places[np.repeat(low, many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)] - i
        order = np.argsort(i, kind="stable")
        i, lags = i[order], lags[order]
        keep = np.ones(len(i), bool)
        for (start, end), q in found.items():
            if end - start >= 2 * k:
                at = slice(np.searchsorted(i, start), np.searchsorted(i, end))
                keep[at] &= (lags[at] % q != 0) | (i[at] + lags[at] + k > end)
        _extend(w, i[keep], lags[keep], found)
        if len(h) <= k:
            break
        h, k = h[:-k] * _ODD + mix(h[k:]), 2 * k
        seen = _repeats(h)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist())


def collapse(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period) and collapsed, the text without repetitions.

    Words are what blanks part; upper and lower case differ. A run is a stretch of consecutive words of smallest period q, of
    at least LEAST words and TIMES periods, that no neighbouring word extends. collapsed has, joined by one space, the words
    that no run contains after its first period. rewrite(doc_id, words), if given, changes a document's words before.
    A null or blank text has no words: no runs, and an empty collapsed text. Very long texts are read whole; time and memory
    of a text grow with its words, whatever repeats in it. Repeated rows give repeated results; an empty table gives none;
    other columns are ignored. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ends, spans, texts = [0], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (text or b"").split()
                    if rewrite is not None:
                        words = rewrite(doc_id, words)
                    if len(ids) > TABLE_ENTRIES:
                        ids.clear()
                    runs = periodic_runs(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                    spans += runs
                    ends.append(len(spans))
                    texts.append(_kept(words, runs))
                numbers = np.array(spans, np.int64).reshape(-1, 3)
                spans_of = pa.StructArray.from_arrays([pa.array(numbers[:, i]) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans_of), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(tidy(run), SCHEMA)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document of the query: of one in ten, by doc_id, the tail repeats a block of itself. A null id: as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapse(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeat_tail)
    # the greatest length / period, told by products; of ties the first
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    rows = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
