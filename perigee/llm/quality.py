"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every word has a fixed sparse random vector, drawn from its own hash, that it gives as a context. A word's vector is the sum
of those of the words within WINDOW of it over the whole corpus (random indexing). The VOCABULARY most frequent words of the
corpus have a vector of each kind; rarer ones, of which a document can say little, share BUCKETS of each kind by hash. So the
tables that tasks hold have a bounded size.
A document is the mean and the spread of its words' vectors. A network of two layers, trained in numpy, gives a logit,
and a temperature fitted on rows kept out of training makes it a calibrated probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_bucket, discard, free_names, materialize, mix, small_side, tidy

#: Words with a vector of their own, vectors that the others share, length of a vector, and the window to each side.
VOCABULARY, BUCKETS, DIM, WINDOW = 50_000, 4096, 48, 2
#: Entries of a context's vector that are not zero, and the fewest times that a word of the vocabulary occurs.
MARKS, LEAST_SEEN = 4, 5
#: The most labelled rows that the network is fitted on, hidden units, and the score from which a document is accepted.
FIT_ROWS, HIDDEN, ACCEPT = 20_000, 32, 0.3
FOLDS, SEED = 5, 7
#: Tokens whose rows, and words whose counts, a task keeps.
TOKENS = 250_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


class _Tokens(dict):
    """The row of a token in the word table, or without a vocabulary its hash. Words count in lower case; words of capitals are
    one token, and numbers another."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        super().__init__()
        self.rows = None if vocabulary is None else {word: row for row, word in enumerate(vocabulary.tolist())}

    def __missing__(self, token: str) -> int:
        if len(self) >= TOKENS:
            self.clear()
        if token[0].isalpha():
            word = "\x02" if len(token) > 1 and token.isupper() else token.lower()
        else:
            word = "\x03" if token[0].isdigit() else token
        value = xxhash.xxh64_intdigest(word) >> 1
        if self.rows is not None:
            value = self.rows.get(value, len(self.rows) + value % BUCKETS)
        self[token] = value
        return value


def tokens_of(text: str, table: _Tokens) -> np.ndarray:
    found = _TOKEN.findall(text)
    return np.fromiter(map(table.__getitem__, found), np.int64, len(found))


def context_vectors(vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the entries of the sparse ternary vectors that the vocabulary's words, then the BUCKETS, give as contexts.

    A vector hangs on the word's hash alone. Its places are MARKS different ones; the signs, by column, are those of all.
    """
    seeds = mix(np.concatenate([vocabulary.astype(np.uint64), np.arange(BUCKETS, dtype=np.uint64)]))
    draws = mix(seeds[:, None] + np.arange(DIM, dtype=np.uint64))
    return np.argsort(draws, axis=1)[:, :MARKS], np.tile([1, -1], MARKS // 2)


def _texts(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            yield batch.slice(at, 200), batch.slice(at, 200).column(column).to_pylist()


def vocabulary_of(docs: DataFrame) -> np.ndarray:
    """The sorted hashes of the most frequent words of all documents: as many words as fit VOCABULARY, all of a frequency or none.

    Tasks count their own words and Spark adds up. The driver sees the counts of frequencies, up to VOCABULARY, and the words chosen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = _Tokens(), Counter()

        def rows():
            words, n = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])

        for _, texts in _texts(batches, 0):
            found, n = np.unique(np.concatenate([tokens_of(t, table) for t in texts]), return_counts=True)
            for word, k in zip(found.tolist(), n.tolist(), strict=True):
                counts[word] += k
            if len(counts) >= TOKENS:
                yield rows()
        yield rows()

    found = docs.where("text is not null").select("text").mapInArrow(tidy(run), "word bigint, n bigint")
    words = materialize(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN))
    frequency = F.least(F.col("n"), F.lit(VOCABULARY))  # at most so many different values
    least, room = VOCABULARY + 1, VOCABULARY
    for r in sorted(words.groupBy(frequency.alias("n")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        least, room = r["n"], room - r["count"]
    out = np.sort(words.where(frequency >= least).select("word").toArrow().column("word").to_numpy())
    discard(words)
    return out


def word_table(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """The random-indexing vectors of the vocabulary's words, then of the BUCKETS; each row of length one.

    Each task adds up its own table; the sums, of one size, are added by Spark and reach the driver once.
    """
    rows, sent = len(vocabulary) + BUCKETS, docs.sparkSession.sparkContext.broadcast((vocabulary, *context_vectors(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places, signs = sent.value
        table, sums, columns = _Tokens(known), np.zeros(rows * DIM, np.int64), np.ascontiguousarray(places.T)
        for _, texts in _texts(batches, 0):
            parts = []
            for text in texts:
                parts += [tokens_of(text, table), np.full(WINDOW, -1)]  # windows do not cross documents
            flat = np.concatenate(parts)
            for d in range(1, WINDOW + 1):
                a, b = flat[:-d], flat[d:]
                ok = (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                for x, y in ((a * DIM, b), (b * DIM, a)):
                    for place, sign in zip(columns, signs.tolist(), strict=True):
                        np.add.at(sums, x + place[y], sign)
        vectors = sums.reshape(rows, DIM)
        used = np.flatnonzero(np.abs(vectors).sum(axis=1))
        for at in range(0, len(used), 5000):
            part = used[at : at + 5000]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors[part].ravel().astype(np.int32)), DIM).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), lists], ["row", "vector"])

    found = docs.where("text is not null").select("text").mapInArrow(tidy(run), "row int, vector array<int>")
    added = found.groupBy("row").agg(*[F.sum(F.get("vector", F.lit(i))).alias(f"v{i}") for i in range(DIM)])
    got, out = added.toArrow(), np.zeros((rows, DIM))
    if got.num_rows:
        out[got.column("row").to_numpy()] = np.stack([got.column(f"v{i}").to_numpy() for i in range(DIM)], axis=1)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vocabulary: np.ndarray, words: np.ndarray) -> DataFrame:
    """docs (all columns but text) with vector: mean and spread of the word vectors; zeros for a text without tokens."""
    kept = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vectors = _Tokens(sent.value[0]), sent.value[1]
        for part, texts in _texts(batches, len(kept)):
            out = np.zeros((len(texts), 2 * DIM), np.float32)
            for row, text in zip(out, texts, strict=True):
                if text:
                    bucket, n = np.unique(tokens_of(text, table), return_counts=True)
                    if len(bucket):
                        share, v = (n / n.sum()).astype(np.float32), vectors[bucket]
                        row[:DIM] = share @ v
                        row[DIM:] = np.sqrt(np.maximum(share @ (v * v) - row[:DIM] ** 2, 0))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), 2 * DIM).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*kept, "vector"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(tidy(run), f"{schema}, vector array<float>")


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60) -> dict[str, np.ndarray]:
    """The network, by Adam on the log loss; a fifth of the rows is kept for choosing the epoch and the temperature."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z, order = (x - mean) / scale, rng.permutation(len(x))
    held, rest = order[: len(x) // 5], order[len(x) // 5 :]
    held = held if len(held) else rest
    net = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step, best = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0, (np.inf, None)
    logit = lambda z, net: np.maximum(z @ net[0] + net[1], 0) @ net[2] + net[3]
    loss = lambda t, y: float(np.mean(np.logaddexp(0, t) - y * t))
    for _ in range(epochs):
        rng.shuffle(rest)
        for at in range(0, len(rest), 128):
            i = rest[at : at + 128]
            a = np.maximum(z[i] @ net[0] + net[1], 0)
            g = (1 / (1 + np.exp(-np.clip(a @ net[2] + net[3], -30, 30))) - y[i]) / len(i)
            ga = np.outer(g, net[2]) * (a > 0)
            step += 1
            for k, d in enumerate([z[i].T @ ga + 1e-4 * net[0], ga.sum(axis=0), a.T @ g, np.array([g.sum()])]):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                net[k] = net[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        now = loss(logit(z[held], net), y[held])
        if now < best[0]:
            best = (now, [p.copy() for p in net])
    net = best[1] or net
    t = logit(z[held], net)
    heat = min(np.geomspace(0.25, 8, 61), key=lambda h: loss(t / h, y[held]))
    return {"mean": mean, "scale": scale, "w1": net[0], "b1": net[1], "w2": net[2], "b2": net[3], "heat": np.array([heat])}


def probability(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    t = (np.maximum((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"]) / net["heat"]
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def _scores(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """The columns of docs (doc_id, others, text) but text, with score."""
    spark, own = docs.sparkSession, docs.columns[:-1]
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    vocabulary = vocabulary_of(docs)
    rows = materialize(pooled(docs, vocabulary, word_table(docs, vocabulary)))
    known = labels.select(F.col("doc_id").alias("_of"), F.col("quality").alias("_quality")).where("_quality is not null")
    learn = rows.where(crc_bucket(F.col("doc_id"), FOLDS) != 0).join(known, F.col("doc_id") == F.col("_of"))
    learn = learn.select("vector", "_quality", F.xxhash64("doc_id", F.lit(SEED)).alias("_at"))
    # a threshold of the hash leaves a few more rows than are wanted, so that no task or driver sorts more than that
    n = learn.count()
    share = 1.2 * fit_rows / max(n, 1)
    if share < 1:
        learn = learn.where(F.pmod("_at", F.lit(1 << 30)) < int(share * (1 << 30)))
    got = learn.orderBy(F.pmod("_at", F.lit(1 << 30)), "_at", "_quality").limit(fit_rows).select("vector", "_quality").toArrow()
    y = got.column("_quality").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    net, flat = None, float(y.mean()) if len(y) else 0.5
    if 0 < y.sum() < len(y):
        net = fit(np.stack(got.column("vector").to_numpy(zero_copy_only=False)).astype(float), y)
    sent = spark.sparkContext.broadcast((net, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, flat = sent.value
        for batch in batches:
            n = batch.num_rows
            x = batch.column(len(own)).flatten().to_numpy(zero_copy_only=False).reshape(n, 2 * DIM).astype(float)
            score = probability(x, net) if net else np.full(n, flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*own, "score"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
    return rows.select(*own, "vector").mapInArrow(tidy(run), f"{schema}, score double")


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Word vectors come from all texts. The network learns from at most fit_rows labelled rows outside the held-out fold,
    those of the least hash. A null text counts as empty; texts without tokens get the score of a zero vector. With no
    labelled row, or labels of one kind, the score is their mean (0.5 with none). Equal texts get equal scores. A
    doc_id with several labels is learnt with each, a null one with none. An empty table gives no rows; very long texts are
    read whole; other columns are ignored.
    """
    out = _scores(docs.select("doc_id", "text"), labels, fit_rows)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, all columns as they are, that the classifier accepts.

    A row is known by two hashes of doc_id and text, so repeated rows fare alike. Null and empty texts are judged by the
    score of a zero vector. An empty table gives no rows.
    """
    a, b = free_names(docs, "hash_a", "hash_b")
    named = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64("text", F.lit(1), "doc_id")})
    bad = materialize(_scores(named.select("doc_id", a, b, "text"), labels, fit_rows).where(F.col("score") < ACCEPT).select(a, b).distinct())
    return named.join(small_side(bad), [a, b], "left_anti").select(*docs.columns)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
