"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a text in both directions and labels every position with a probability of each language;
the document's probability is the mean over its positions. It is trained by backpropagation through time. Texts are read
whole, in segments of SEGMENT bytes that start WARM bytes early and end WARM bytes late, so that no position is labelled by
a cold state, and the bytes that fill up a batch of segments leave the states of shorter ones at rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_bucket, tidy

#: Units of each direction, bytes labelled in a segment and read before and after, and segments worked on at once.
UNITS, SEGMENT, WARM, BATCH = 8, 240, 8, 1024
#: The most documents of each language, and of all, that the network is fitted on (one a language at least), stretches of each,
#: length of a training stretch, and steps.
FIT_DOCS, FIT_TOTAL, PIECES, STRETCH, STEPS = 300, 30_000, 16, 48, 250
FOLDS, HELD, SEED, UNKNOWN = 4, 2, 11, "und"


def _sigmoid_of_minus(x: np.ndarray) -> np.ndarray:
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def new_net(languages: int) -> dict[str, np.ndarray]:
    """For both directions: what each byte adds to the update and reset gates (f) and to the candidate (n), recurrent weights
    of the gates (u) and of the candidate (c); then the output layer."""
    rng = np.random.default_rng(SEED)
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    h = UNITS
    return {"f": draw(2, 256, 2 * h, by=0.5), "n": draw(2, 256, h, by=0.5), "u": draw(2, h, 2 * h, by=1 / h**0.5), "c": draw(2, h, h, by=1 / h**0.5), "o": draw(2 * h, languages, by=1 / h**0.5), "b": np.zeros(languages, np.float32)}


def states(net: dict[str, np.ndarray], d: int, data: np.ndarray, keep: list | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """The states of direction d at every byte of data (time, batch), in the order of data. ends: where the texts of the batch end;
    the state stays zero from there on, so a text's states are those it has alone."""
    steps, n = data.shape
    h, shortest = UNITS, steps if ends is None else int(ends.min())
    out, state = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32)
    f, u, c, u2 = -net["f"][d], -net["u"][d], -2 * net["c"][d], -2 * net["n"][d]
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        gates = f.take(data[t], axis=0)
        gates += state @ u
        _sigmoid_of_minus(gates)
        update, reset = gates[:, :h], gates[:, h:]
        new = u2.take(data[t], axis=0)
        new += (reset * state) @ c
        _sigmoid_of_minus(new)  # tanh(x) = 2 sigmoid(2x) - 1
        new += new
        new -= 1
        if keep is not None:
            keep.append((t, state, gates, new))
        here = out[t]
        np.subtract(new, state, out=here)
        here *= update
        here += state
        if t >= shortest:
            here[ends <= t] = 0
        state = here
    return out


def position_probabilities(net: dict[str, np.ndarray], data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(language, time, batch): the probabilities at every byte of data (time, batch), whose texts end at ends."""
    h = UNITS
    p = net["o"][:h].T @ states(net, 0, data).reshape(-1, h).T
    p += net["o"][h:].T @ states(net, 1, data, ends=ends).reshape(-1, h).T
    p += net["b"][:, None]
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    return p.reshape(-1, *data.shape)


def gradients(net: dict[str, np.ndarray], data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean log loss over all positions, and its gradients, by backpropagation through time."""
    h, kept = UNITS, ([], [])
    outs = [states(net, d, data, kept[d]) for d in (0, 1)]
    logits = outs[0] @ net["o"][:h] + outs[1] @ net["o"][h:] + net["b"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    truth = np.eye(len(net["b"]), dtype=np.float32)[labels]
    loss = -float(np.log(np.maximum((p * truth).sum(axis=2), 1e-9)).mean())
    dl = (p - truth) / p[..., 0].size
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["b"] = dl.sum(axis=(0, 1))
    for d in (0, 1):
        grad["o"][d * h : (d + 1) * h] = np.einsum("tbh,tbl->hl", outs[d], dl)
        flow = np.zeros_like(outs[d][0])
        back = dl @ net["o"][d * h : (d + 1) * h].T
        for t, state, gates, new in reversed(kept[d]):
            update, reset = gates[:, :h], gates[:, h:]
            flow = flow + back[t]
            d_new = flow * update * (1 - new * new)
            d_held = d_new @ net["c"][d].T
            d_gates = np.concatenate([flow * (new - state), d_held * state], axis=1) * gates * (1 - gates)
            grad["c"][d] += (reset * state).T @ d_new
            grad["u"][d] += state.T @ d_gates
            np.add.at(grad["f"][d], data[t], d_gates)
            np.add.at(grad["n"][d], data[t], d_new)
            flow = flow * (1 - update) + d_held * reset + d_gates @ net["u"][d].T
    return loss, grad


def fit(texts: list[bytes], labels: np.ndarray, languages: int, steps: int = STEPS) -> dict[str, np.ndarray]:
    """The network, by Adam on stretches of random texts, as many of each language, with a bound on the gradient."""
    net, rng = new_net(languages), np.random.default_rng(SEED)
    m, v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))
    of = [[t for t, y in zip(texts, labels, strict=True) if y == k] for k in range(languages)]
    for step in range(1, steps + 1):
        y = np.arange(128) % languages
        data = np.full((STRETCH, len(y)), 32, np.int64)
        for i, k in enumerate(y):
            text = of[k][rng.integers(len(of[k]))]
            at = rng.integers(max(1, len(text) - STRETCH + 1))
            piece = np.frombuffer(text[at : at + STRETCH], np.uint8)
            data[: len(piece), i] = piece
        _, grad = gradients(net, data, np.broadcast_to(y, data.shape))
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1 / max(size, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net[k] = (net[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def document_probabilities(net: dict[str, np.ndarray], texts: list[bytes], segment: int = SEGMENT, warm: int = WARM) -> np.ndarray:
    """The mean of the position probabilities of each text; segments of all texts are worked on together."""
    sums, counts = np.zeros((len(texts), len(net["b"]))), np.zeros(len(texts))
    jobs = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), segment)]
    jobs.sort(key=lambda j: min(segment, len(texts[j[0]]) - j[1]))  # alike in length, so that little is padded
    for lo in range(0, len(jobs), BATCH):
        part = jobs[lo : lo + BATCH]
        cut = [texts[i][max(0, at - warm) : at + segment + warm] for i, at in part]
        data = np.full((len(part), max(map(len, cut))), 32, np.uint8)
        for row, c in zip(data, cut, strict=True):
            row[: len(c)] = np.frombuffer(c, np.uint8)
        p = position_probabilities(net, np.ascontiguousarray(data.T).astype(np.int64), np.array([len(c) for c in cut]))
        first = np.array([min(at, warm) for _, at in part])
        last = np.array([f + min(segment, len(texts[i]) - at) for f, (i, at) in zip(first, part, strict=True)])
        t = np.arange(data.shape[1])[:, None]
        p *= ((t >= first) & (t < last)).astype(np.float32)
        found = p.sum(axis=1).T
        own = np.array([i for i, _ in part])
        np.add.at(sums, own, found)
        np.add.at(counts, own, last - first)
    return sums / np.maximum(counts, 1)[:, None]


def training_sample(docs: DataFrame, fit_docs: int) -> list[tuple[str, list[str]]]:
    """(lang, stretches) of at most fit_docs different labelled documents of each language outside the held-out fold, those of the
    least hash; fewer of each where all together would pass FIT_TOTAL. The hashes are chosen first, by a threshold from counts and
    then exactly. PIECES stretches of each chosen text, at places by its hash, are cut in tasks and reach the driver, no whole text."""
    held = F.coalesce(crc_bucket(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    known = docs.where(~held & F.col("lang").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0))
    known = known.select("lang", F.xxhash64("doc_id", "text", F.lit(SEED)).alias("at"), "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n")).collect()}
    if not sizes:
        return []
    fit_docs = max(1, min(fit_docs, FIT_TOTAL // len(sizes)))
    place = F.pmod("at", F.lit(1 << 30))
    share = {k: min(1.0, (1.3 * fit_docs + 50) / n) for k, n in sizes.items()}
    under = F.coalesce(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 30)))])[F.col("lang")], F.lit(0))
    few = known.where(place < under).select("lang", place.alias("place"), "at").distinct()
    chosen = sorted((r["lang"], r["place"], r["at"]) for r in few.collect())
    chosen = [(k, at) for k in sizes for at in [x[2] for x in chosen if x[0] == k][:fit_docs]]
    table = docs.sparkSession.createDataFrame(chosen, "lang string, at bigint")
    starts = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: F.pmod(F.xxhash64("at", i), F.greatest(F.lit(1), F.length("text") - STRETCH + 1)) + 1)
    pieces = F.transform(starts, lambda i: F.substr("text", i.cast("int"), F.lit(STRETCH)))
    found = known.join(F.broadcast(table), ["lang", "at"]).select("lang", "at", pieces.alias("pieces")).groupBy("lang", "at").agg(F.min("pieces").alias("pieces"))
    return [(r["lang"], r["pieces"]) for r in found.orderBy("lang", "at").collect()]  # at most fit_docs a language


def predict(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    The network learns from stretches of at most fit_docs documents of each language outside the held-out fold. score is the mean
    probability of the predicted language. A null or empty text, or one without a letter, is und with score 0; so is
    every text if no labelled document is left to learn from. Equal texts, repeated rows included, get equal predictions
    (scores to the rounding of 32-bit floats, whatever else is in their batch); ties go to the language first in order. An empty table gives no rows; other columns are ignored. Very long texts are
    read whole, in segments. Nothing but the training sample is shuffled.
    """
    held = F.coalesce(crc_bucket(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    sample = training_sample(docs, fit_docs)
    languages = sorted({k for k, _ in sample})
    pieces = [(languages.index(k), t.encode("utf-8", "replace")) for k, cut in sample for t in cut]
    net = fit([t for _, t in pieces], np.array([k for k, _ in pieces]), len(languages)) if languages else None
    sent = docs.sparkSession.sparkContext.broadcast((net, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                texts = part.column(2).to_pylist()
                letters = [i for i, t in enumerate(texts) if t and net is not None and any(map(str.isalpha, t))]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                p = document_probabilities(net, [texts[i].encode("utf-8", "replace") for i in letters]) if letters else []
                for i, row in zip(letters, p, strict=True):
                    lang[i], score[i] = languages[int(row.argmax())], float(min(1.0, max(0.0, row.max())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), held.alias("held_out"), "text").mapInArrow(tidy(run), "doc_id bigint, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
