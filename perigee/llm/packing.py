"""Packing: cutting-stock column generation over the histogram of piece lengths.

Documents are cut into full pieces and one remainder. A linear program over patterns of length classes says how often
each pattern is cut; a knapsack prices new patterns. The rounded patterns, and the rest packed first-fit decreasing,
form a plan over classes only. Pieces are then ranked within their class, in parallel, and the rank names the sequence.
"""

from __future__ import annotations

import array
import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, small_side, tidy

#: Tokens of a sequence, the width of a length class (a length counts as the class's upper end), and the id that ends a document.
LENGTH, GRID, END_ID = 2048, 8, 1
_SPECIAL = "<|endoftext|>"
#: Encoded stretches that a task keeps, some 60 MB.
CHUNKS = 300_000


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Chunks(dict):
    """Ids, as little-endian 32-bit numbers, of the stretches between single spaces, each with its leading space.

    Such a stretch is encoded alike wherever it stands, unless it is empty or has a blank at an end: then None.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str):
        if len(self) >= CHUNKS:
            self.clear()
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            value = None
        else:
            value = _packed(self.encode(" " + chunk))
        self[chunk] = value
        return value


class Encoder:
    """Token ids of texts, equal to those of the tokenizer file; ranks is the same vocabulary as ranked byte strings.

    A text with the special token's own string, which the file maps to its id, goes to the tokenizer itself; so does
    nothing else, as the ranked form gives equal ids several times as fast.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import base64

        import tiktoken

        pairs = (line.split() for line in open(ranks, "rb") if line.strip())
        table = {base64.b64decode(a): int(b) for a, b in pairs}
        self._ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._path, self._chunks = path, _Chunks(self._ranked.encode_ordinary)

    @functools.cached_property
    def _whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text:
            return _packed(self._whole.encode(text, add_special_tokens=False).ids)
        first, *others = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return _packed(self._ranked.encode_ordinary(first)) + b"".join(map(self._chunks.__getitem__, others))
            except TypeError:  # a None: blanks stand together
                pass
        return _packed(self._ranked.encode_ordinary(text))


def default_encoder() -> tuple[str, str, str]:
    import public_tokenizers as P

    return str(P.path("byte_bpe_50k.json")), str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN


def pieces_of(docs: DataFrame, tokenizer: tuple[str, str, str], length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, class, part, place): full pieces of `length` ids and one remainder a document.

    ids are little-endian 32-bit numbers. place ranks the pieces of a class within their partition, part, from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, part_id, seen = Encoder(*tokenizer), END_ID.to_bytes(4, "little"), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text) + end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        kind = -(-(len(piece) // 4) // GRID)
                        place = seen[kind] = seen.get(kind, -1) + 1
                        rows.append((doc_id, start, len(piece) // 4, piece, n, kind, part_id, place))
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "class", "part", "place"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, class int, part int, place bigint")


def _price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth: an unbounded knapsack over the classes, by dynamic programming on the room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fit = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        if fit[r]:
            worth = best[r - sizes[: fit[r]]] + duals[: fit[r]]
            k = worth.argmax()
            if worth[k] > best[r] + 1e-12:
                best[r], took[r] = worth[k], k
    pattern, r = np.zeros(len(sizes), int), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            pattern[took[r]] += 1
            r -= int(sizes[took[r]])
    return float(best[room]), pattern


def plan(counts: dict[int, int], room: int, gap: float = 0.001, rounds: int = 3000) -> list[tuple[np.ndarray, list[int], int]]:
    """[(classes, how many of each, times)]: patterns that hold every piece exactly once. counts: pieces by class.

    Column generation by the revised simplex method: the basis starts with one pattern a class, the knapsack prices an
    entering pattern, and the ratio test says which one leaves. The optimum is rounded down; what is left, a few
    pieces a class, is packed first-fit decreasing.
    """
    classes = np.array(sorted(counts), int)
    if not len(classes):
        return []
    demand = np.array([counts[c] for c in classes], float)
    basis = np.diag((room // classes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(rounds):
        worth, pattern = _price(inverse.sum(axis=0), classes, room)
        if worth <= 1 + gap:  # the optimum is at least this one divided by worth
            break
        amount, move = (inverse * demand).sum(axis=1), (inverse * pattern).sum(axis=1)
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
    times = np.floor(np.clip((inverse * demand).sum(axis=1), 0, None) + 1e-6).astype(int)
    need, made = demand.astype(int), []
    for column, n in zip(basis.T.round().astype(int), times, strict=True):
        used = column > 0
        n = min(n, int((need[used] // column[used]).min()))  # rounding errors must not take more than there is
        if n:
            need = need - n * column
            made.append((classes[used], column[used].tolist(), int(n)))
    bins: list[tuple[int, dict[int, int]]] = []
    for i in np.argsort(-classes):
        for _ in range(need[i]):
            c = int(classes[i])
            at = next((k for k, (free, _) in enumerate(bins) if free >= c), None)
            if at is None:
                bins.append((room, {}))
                at = len(bins) - 1
            free, held = bins[at]
            held[c] = held.get(c, 0) + 1
            bins[at] = (free - c, held)
    return made + [(np.array(list(held)), list(held.values()), 1) for _, held in bins]


def _ranked(pieces: DataFrame) -> DataFrame:
    """pieces (written) with `rank`, from 0 without gaps within each class: the pieces of earlier partitions come first.

    The ids stay where they are: only counts by class and partition are shuffled, and these are met by a broadcast while
    they are at most BROADCAST_ROWS.
    """
    counts = pieces.groupBy("class", "part").count()
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("class", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    return pieces.join(small_side(starts), ["class", "part"]).withColumn("rank", F.col("first") + F.col("place")).drop("first", "place", "part")


def pack(docs: DataFrame, tokenizer: tuple[str, str, str] | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset of every piece; rows come sequence by sequence, in order.

    ids holds the piece's token ids as little-endian 32-bit numbers, ids_crc32 is worked out from it. The pieces of a
    sequence, joined by offset, are its content; what is left up to `length` is padding, the lengths are its boundaries.
    A null or empty text has the end id alone. A text longer than `length` ids is cut into full pieces and a remainder,
    so each id lies in exactly one piece. Equal rows are interchangeable, and each is packed. An empty table gives no
    rows; other columns are ignored. The ids are written once and shuffled once, to their sequence. The driver sees the histogram of at most length / GRID classes and the plan of it.
    """
    pieces = materialize(pieces_of(docs, tokenizer or default_encoder(), length), "zstd")
    counts = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    patterns = plan(counts, length // GRID)
    slots, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for p, (classes, many, times) in enumerate(patterns):
        for c, k in zip(classes.tolist(), many, strict=True):
            slots.append((int(c), used[c], used[c] + k * times, k, sequence, p))
            used[c] += k * times
        sequence += times
    table = pieces.sparkSession.createDataFrame(slots, "class int, low bigint, high bigint, many int, first_sequence bigint, pattern int")
    # the plan has at most a few patterns a class, whatever the input
    placed = _ranked(pieces).join(F.broadcast(table), "class").where("low <= rank and rank < high")
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("many")).cast("bigint"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "class", "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")
    placed = placed.withColumn("offset", offset)  # the ids have gone through the exchange to their sequence
    return placed.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all pieces, with the digest of the ids that pack() placed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
