"""Benchmark decontamination: a CGK random-walk embedding, bit-sampling LSH, and exact edit verification.

The embedding walks over the characters of a text: at step t it puts out the current character and goes on to the next one
if the random bit of (t, character) is set. Texts at a small edit distance walk into step again after an edit, so their
outputs differ in few places: edit distance becomes Hamming distance, which sampling of output positions catches.

A walk over a whole item would have to survive all of its edits at once, so short walks are taken: of an item from each of
its bytes, of a document from every few, whatever the words are, so that no place of an edit is worse than another. Blanks are
passed over, so one that is lost or put in changes nothing. Samples of each walk's outputs are its keys: of most steps where the
walk may stand still, of about half where it always goes on, which many edits miss. A document's window is found if one walk
agrees with the item's in the sampled places of one table. Hits whose surroundings are quite unlike go; the others propose windows
of the item's size, with room for its edits at both ends, which are verified by edit distance, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LIKENESS, free_names, materialize, small_side, tidy, words_of

#: (fewest bytes of an item; walks that may stand still: tables, steps, steps that a table leaves out, fewest bytes a walk must see to
#: be indexed; walks that always go on: tables, steps, steps that a table samples; bytes from one walk of a document to the next).
#: Items of few bytes have few walks, so all of a document's are taken.
TIERS = [(160, 1, 12, 1, 8, 2, 15, 8, 5), (100, 1, 12, 1, 8, 3, 15, 8, 4), (40, 2, 10, 1, 6, 3, 12, 7, 3), (8, 1, 6, 0, 0, 0, 0, 0, 1), (1, 1, 1, 0, 0, 0, 0, 0, 1)]
#: Characters of benchmark text in one block of items; the documents are read once a block.
BLOCK_CHARS = 16_000_000
#: Starts walked at once, candidates verified at once, the longest pattern, in 64-bit words, that is verified in a batch, and the
#: fewest candidates of a length for which a batch pays; fewer are verified one by one, by the same algorithm.
WALKED, VERIFIED, MOST_WORDS, FEW = 1 << 15, 4096, 32, 64
_FILTER_BITS = 20
#: Bytes of the piece of an item that is compared first around a hit, from one such piece to the next, by how much it may be
#: displaced, and the share of edits up to which the whole window is verified (a match has a fifth over all of the item).
PIECE, STRIDE, STRETCH, NEAR = 64, 40, 14, 0.36
PAD = max(max(t[2], t[6]) for t in TIERS) + 1


def _table(tier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the bits of a table's walk by step and character, the steps it samples). In the first tables of a tier a walk may stand
    still at every other step, which lets it fall into step again after an insertion or deletion; in the others it always goes
    on, and fewer steps are sampled, which passes over many replaced characters. From a zero none goes on."""
    _, still, steps, out, _, _, far, sampled, _ = TIERS[tier]
    rng = np.random.default_rng([17, tier, n])
    steps, sampled = (steps, steps - out) if n < still else (far, sampled)
    go = rng.integers(0, 2, (steps, 256)).astype(np.int64)
    go[1::2] = 1
    if n >= still:
        go[:] = 1
    go[:, 0] = 0
    return go, np.sort(rng.choice(steps, sampled, replace=False))


def walks(flat: np.ndarray, starts: np.ndarray, go: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the outputs of the walks from all starts, one row a step; where they end)."""
    at, out = starts.copy(), np.empty((len(go), len(starts)), np.uint8)
    for t, bits in enumerate(go):
        np.take(flat, at, out=out[t])
        at += bits.take(out[t])
    return out, at


def steady(flat: np.ndarray, starts: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """The sampled outputs of walks that always go on. From a zero none goes on, but behind one there are zeros alone."""
    return np.stack([flat.take(starts + t) for t in sample.tolist()])


def table_key(out: np.ndarray) -> np.ndarray:
    key = np.full(out.shape[1], len(out), np.uint64)
    for row in out:
        key += row
        key *= np.uint64(0xA0761D6478BD642F)
        key ^= key >> np.uint64(32)
    return key


def _squeezed(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of single spaces, each followed by zeros, without the spaces; and the place that each byte had."""
    places = np.flatnonzero(flat != 32)
    return flat[places], places


def index_items(items: list[tuple[int, str]]) -> dict:
    """The LSH tables of a block of items: sorted keys with the item and the walk's byte offset of each."""
    texts, tables, out = [b" ".join(words_of(t.encode("utf-8", "replace"))) for _, t in items], {}, {}
    for i, text in enumerate(texts):
        if not text:
            continue
        tier = next(k for k, t in enumerate(TIERS) if len(text) >= t[0])
        flat, places = _squeezed(np.frombuffer(text + b"\0" * PAD, np.uint8))
        size = len(flat) - PAD
        starts = np.arange(size)
        _, still, _, _, least, more, _, _, _ = TIERS[tier]
        for n in range(still + more):
            go, sample = _table(tier, n)
            walked, at = walks(flat, starts, go)
            inside = at <= size  # a walk that leaves the item would see other characters in a document
            wide = inside & (at - starts >= least)
            inside[0] |= not inside.any()
            good = wide if wide.any() else inside
            tables.setdefault((tier, n), []).append((table_key(walked[sample])[good], np.full(good.sum(), i), places[starts[good]]))
    for name, parts in tables.items():
        key, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        out[name] = (*_table(*name), key[order], item[order], offset[order], seen)
    return {"tables": out, "ids": [i for i, _ in items], "texts": texts}


def edit_distance_within(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of pattern to any stretch of text, its end), by Myers' bit-parallel algorithm."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def distances_within(patterns: list[str], of: np.ndarray, texts: list[str]) -> np.ndarray:
    """The least edit distance of patterns[of[i]] to any stretch of texts[i], for all i: the same algorithm on many pairs at once,
    a pattern of more than 64 characters in several words with a carry between them."""
    out = np.zeros(len(texts), np.int64)
    words = np.array([-(-len(p) // 64) for p in patterns], np.int64)[of] if len(of) else np.zeros(0, np.int64)
    for w in np.unique(words).tolist():
        group = np.flatnonzero(words == w)
        if w > MOST_WORDS or len(group) < FEW:
            for i in group.tolist():
                out[i] = edit_distance_within(patterns[of[i]], texts[i])[0]
            continue
        group = group[np.argsort([len(texts[i]) for i in group], kind="stable")]
        step = max(256, 4 * VERIFIED // max(4, w))  # long patterns in smaller batches
        for lo in range(0, len(group), step):
            part = group[lo : lo + step]
            out[part] = _batch(patterns, of[part], [texts[i] for i in part.tolist()], w)
    return out


def _batch(patterns: list[str], of: np.ndarray, texts: list[str], words: int) -> np.ndarray:
    points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    used, own = np.unique(of, return_inverse=True)
    forms = [points(patterns[u]) for u in used.tolist()]
    letters = np.unique(np.concatenate(forms))
    equal = np.zeros((len(used), len(letters) + 1, words), np.uint64)
    for row, form in zip(equal, forms, strict=True):
        at = np.arange(len(form))
        np.bitwise_or.at(row, (np.searchsorted(letters, form) + 1, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    flat = equal.reshape(-1, words)
    lengths = np.array([len(t) for t in texts])
    data = np.zeros((max(1, int(lengths.max())), len(texts)), np.int64)
    x = points("".join(texts))
    place = np.searchsorted(letters, x)
    known = letters[np.minimum(place, len(letters) - 1)] == x
    of_text = np.repeat(np.arange(len(texts)), lengths)
    # what is no letter of a pattern, padding too, matches nothing
    data[np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths), of_text] = np.where(known, place + 1, 0)
    data += own * equal.shape[1]
    sizes = np.array([len(f) for f in forms])[own]
    one, last = np.uint64(1), ((sizes - 1) & 63).astype(np.uint64)
    pv, mv = [np.full(len(texts), 2**64 - 1, np.uint64) for _ in range(words)], [np.zeros(len(texts), np.uint64) for _ in range(words)]
    score, best = sizes.copy(), sizes.copy()
    for row in data:
        eqs = flat[row]
        plus = minus = np.zeros(len(texts), np.uint64)
        for w in range(words):
            eq, p, m = eqs[:, w], pv[w], mv[w]
            xv = eq | m
            eq = eq | minus
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            if w == words - 1:
                score += ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64)
            up, down = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = ph << one | plus, mh << one | minus
            pv[w], mv[w] = mh | ~(xv | ph), ph & xv
            plus, minus = up, down
        np.minimum(best, score, out=best)
    return best


def _hits(flat: np.ndarray, begins: np.ndarray, index: dict) -> np.ndarray:
    """Rows (text, item, cell, piece, start, offset) of the hits, one for each window and piece of the item around a hit; windows
    of the item's size start in cells as long as the item's edits may be."""
    flat, places = _squeezed(flat)
    own = np.searchsorted(places, begins)  # where the texts begin now
    inside = np.flatnonzero(flat)
    since, found = inside - own[np.searchsorted(own, inside, "right") - 1], []
    room = np.array([_room(t) for t in index["texts"]], np.int64)
    taken = {n: inside[since % n == 0] for n in {TIERS[tier][-1] for tier, _ in index["tables"]}}
    for (tier, n_table), (go, sample, keys, item_of, offset_of, seen) in index["tables"].items():
        all_starts = taken[TIERS[tier][-1]]
        for lo in range(0, len(all_starts), WALKED):
            starts = all_starts[lo : lo + WALKED]
            key = table_key(walks(flat, starts, go)[0][sample] if n_table < TIERS[tier][1] else steady(flat, starts, sample))
            near = np.flatnonzero(seen[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            key = key[near]
            a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = b - a
            if n.any():
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                start, item, offset = np.repeat(places[starts[near]], n), item_of[at], offset_of[at]
                text = np.searchsorted(begins, start, "right") - 1
                start = start - begins[text]
                found.append(np.stack([text, item, (start - offset) // room[item], offset // STRIDE, start, offset], axis=1))
    if not found:
        return np.zeros((0, 6), np.int64)
    rows = np.concatenate(found)
    return rows[np.unique(rows[:, :4], axis=0, return_index=True)[1]]


def _near(rows: np.ndarray, plain: list[bytes], index: dict) -> np.ndarray:
    """The hits about which PIECE bytes of the item are alike as well, in at least one place; items not longer than that stay."""
    sizes = np.array([len(t) for t in index["texts"]], np.int64)
    long = sizes[rows[:, 1]] > PIECE
    tested = rows[long]
    kinds, of = np.unique(tested[:, [1, 3]], axis=0, return_inverse=True)
    lows = np.clip(kinds[:, 1] * STRIDE - (PIECE - STRIDE) // 2, 0, sizes[kinds[:, 0]] - PIECE)
    pieces = [index["texts"][i][lo : lo + PIECE].decode("utf-8", "ignore") for i, lo in zip(kinds[:, 0].tolist(), lows.tolist(), strict=True)]
    first = tested[:, 4] - tested[:, 5] + lows[of.ravel()]
    windows = [plain[t][max(0, at - STRETCH) : at + PIECE + STRETCH].decode("utf-8", "ignore") for t, at in zip(tested[:, 0].tolist(), first.tolist(), strict=True)]
    alike = distances_within(pieces, of.ravel(), windows) <= NEAR * np.array([len(x) for x in pieces])[of.ravel()]
    return np.concatenate([rows[~long], tested[alike]])


def _limit(pattern: str) -> int:
    """The most edits of a match: a fifth of the characters, rounded down."""
    return int((1 - LIKENESS) * len(pattern) + 1e-9)


def _room(text: bytes) -> int:
    """By how many bytes the edits of a match can move its ends."""
    return max(1, _limit(text.decode("utf-8", "replace")) * (1 if text.isascii() else 2))


def _matches(texts: list[bytes | None], index: dict) -> list[tuple[int, int, int, int]]:
    """(place of the text, place of the item, distance, first word of the window) of each verified pair, the best window."""
    plain = [b" ".join(words_of(t)) for t in texts]
    flat = np.frombuffer(b"".join(t + b"\0" * PAD for t in plain), np.uint8)
    begins = np.cumsum([0, *(len(t) + PAD for t in plain[:-1])])
    rows = _hits(flat, begins, index)
    if not len(rows):
        return []
    rows = np.unique(_near(rows, plain, index)[:, :3], axis=0)
    if not len(rows):
        return []
    used, of = np.unique(rows[:, 1], return_inverse=True)
    patterns = [index["texts"][i].decode("utf-8", "replace") for i in used.tolist()]
    windows, lows = [], []
    for text, item, cell in rows.tolist():
        target = index["texts"][item]
        room = _room(target)
        low, high = max(0, (cell - 1) * room), (cell + 2) * room + len(target)
        lows.append(low)
        windows.append(plain[text][low:high].decode("utf-8", "ignore"))
    distances = distances_within(patterns, of, windows)
    limits = np.array([_limit(p) for p in patterns])[of]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in np.flatnonzero(distances <= limits).tolist():
        pair, d = (int(rows[i, 0]), int(rows[i, 1])), int(distances[i])
        best[pair] = min(best.get(pair, (d, lows[i], i)), (d, lows[i], i))
    out = []
    for (text, item), (d, low, i) in best.items():
        start = window_start(patterns[of[i]], windows[i])
        out.append((text, item, d, plain[text][:low].count(b" ") + windows[i][:start].count(" ")))
    return out


def window_start(pattern: str, text: str) -> int:
    """Where the stretch of text that is nearest to pattern begins: of those the first to end, and of these the shortest."""
    end = edit_distance_within(pattern, text)[1]
    return end - edit_distance_within(pattern[::-1], text[:end][::-1])[1]


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of docs but text (the last, as bytes) with item_id, distance, start_word."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item")).where("item is not null")
    total = items.agg(F.coalesce(F.sum(F.char_length("item")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // BLOCK_CHARS)) if total > BLOCK_CHARS else 1
    kept, out = docs.columns[:-1], None
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", item_id bigint, distance int, start_word int"
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block) if blocks > 1 else items
        sent = docs.sparkSession.sparkContext.broadcast(index_items([tuple(r) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    rows = _matches(part.column(len(kept)).to_pylist(), index)
                    if rows:
                        text, item, distance, word = zip(*rows, strict=True)
                        own = [part.column(i).take(pa.array(text, pa.int32())) for i in range(len(kept))]
                        new = [pa.array([index["ids"][i] for i in item], pa.int64()), pa.array(distance, pa.int32()), pa.array(word, pa.int32())]
                        yield pa.RecordBatch.from_arrays([*own, *new], [*kept, "item_id", "distance", "start_word"])

        found = docs.mapInArrow(tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    return out


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start_word) of every document and benchmark item that match, the best window of each.

    They match if some stretch of the document is within an edit distance of a fifth of the item's characters, words
    lower-cased (A-Z) and joined by single spaces. start_word is the word, from 0, in which that stretch begins: of the nearest
    the first to end, and of these the shortest. Of such pairs at least 0.9 are found, by item length and kind of edit;
    what is found does match. A null or empty text or item matches nothing; repeated rows give repeated rows; ties of distance
    give the first window; empty tables give none; other columns are ignored. Very long texts are searched whole. Items are
    taken in blocks of BLOCK_CHARS characters, so what is sent to executors is bounded; documents are not shuffled.
    """
    return _found(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")), items)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that match no benchmark item.

    A row is known by two hashes of doc_id and text, so repeated rows fare alike and null doc_ids are judged by text, too.
    Null and empty texts stay; an empty table gives no rows.
    """
    a, b = free_names(docs, "hash_a", "hash_b")
    named = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64("text", F.lit(1), "doc_id")})
    leaks = materialize(_found(named.select(a, b, F.col("text").cast("binary").alias("text")), items).select(a, b).distinct())
    return named.join(small_side(leaks), [a, b], "left_anti").select(*docs.columns)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
