"""Periodic runs, archives and ranked search against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from perigee.llm import runs, search, shared, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, runs string, collapsed int, part int, `rank` int, item string"


def brute_runs(w):
    """Every stretch of each period, told to be its smallest by trying all smaller ones."""
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        a = 0
        while a + q < n:
            if w[a] != w[a + q]:
                a += 1
                continue
            b = a
            while b + q < n and w[b] == w[b + q]:
                b += 1
            length = b - a + q
            if length >= max(24, 3 * q) and not any(all(w[i] == w[i + r] for i in range(a, a + length - r)) for r in range(1, q)):
                out.append((a, length, q))
            a = b
    return sorted(out)


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(5)
    for case in range(1500):
        letters, w = rng.choice([1, 2, 2, 3, 9]), []
        while len(w) < rng.choice([24, 30, 80, 200]):
            block = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 40]))]
            for _ in range(rng.choice([1, 1, 2, 3, 4, 7])):
                w += block
            if rng.random() < 0.5:
                w += [rng.randrange(letters + 20) for _ in range(rng.randrange(9))]
            w += block[: rng.randrange(len(block) + 1)]
        assert runs.periodic_runs(np.array(w)) == brute_runs(w), (case, w)


def test_runs_of_blocks_with_repeats_inside():
    rng = random.Random(7)
    for _ in range(60):  # periods whose block repeats long parts of itself, so that a gram recurs before its period
        part, other = [rng.randrange(50) for _ in range(rng.randrange(15, 40))], [rng.randrange(50) for _ in range(rng.randrange(1, 30))]
        block = part + part + other + part[: rng.randrange(len(part))]
        w = [77] * rng.randrange(30) + block * rng.choice([2, 3, 4]) + block[: rng.randrange(len(block))] + [78]
        assert runs.periodic_runs(np.array(w)) == brute_runs(w)


def test_long_texts_of_one_word_take_few_steps():
    import time

    began = time.time()
    assert runs.periodic_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    w = np.tile(np.arange(7), 40_000)
    w[140_000] = 99
    assert [r[2] for r in runs.periodic_runs(w)] == [7, 7]
    assert time.time() - began < 10


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (None, "x " * 30), (5, "x\t" * 24), (6, "x " * 23), (7, "A a " * 12), (8, "é x y\x0b" * 12), (10, "lorem ipsum dolor sit amet " * 4000)]


def test_op11_is_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    short = [(r["doc_id"], r["text"]) for r in df.collect() if len(r["text"]) < 12_000]
    assert len(short) > 150
    got = {r["doc_id"]: tuple(r) for r in runs.op11_periodic_runs(spark, SF).collect()}
    want = {k: brute_row(k, t) for k, t in short}
    assert {k: got[k] for k in want} == want and sum(r[1] for r in want.values()) > 5


def test_runs_of_edge_rows(spark):
    rows = spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, "z") for i, t in EDGE], SCHEMA).repartition(3)
    got = Counter((r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in runs.collapse(rows).collect())
    assert got == Counter({(1, (), ""): 1, (2, (), ""): 1, (3, (), ""): 1, (4, (), "a b"): 2, (None, ((0, 30, 1),), "x"): 1, (5, ((0, 24, 1),), "x"): 1, (6, (), " ".join("x" * 23)): 1, (7, ((0, 24, 2),), "A a"): 1, (8, ((0, 24, 2),), "é x y"): 1, (10, ((0, 20_000, 5),), "lorem ipsum dolor sit amet"): 1})
    assert runs.repeat_tail(None, [b"a"]) == [b"a"] and runs.collapse(rows.limit(0)).count() == 0


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_archives_and_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    r = c.sql(warc.OP12_SQL)
    got = warc.op12_warc(spark, SF)
    assert sorted(map(tuple, r.fetchall()), key=str) == plain(got.select(*r.columns))


PAGES = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (9, "http://b/é", "same"), (9, "http://b/é", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1"), (None, "u", "same"), (None, "u", "alone"), (6, "u", "long " * 50_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in PAGES], "page_id bigint, url string, html string, sha string, held int").repartition(3)


def test_archive_of_edge_rows(spark, pages):
    a = warc.write_archive(pages, frame_bytes=400, bundle_bytes=1000)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.report(a).collect())
    d = {t: warc.digest_of(t.encode()) for t in ("same", "", "alone", PAGES[6][2], PAGES[9][2])}
    assert d[""] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    want = [(i, "revisit", 9, 4, d["same"]) for i in (1, 2, None)] + [(9, "response", None, 4, d["same"])] * 2 + [(3, "revisit", 4, 0, d[""]), (4, "response", None, 0, d[""]), (5, "response", None, 14, d[PAGES[6][2]]), (None, "response", None, 5, d["alone"]), (6, "response", None, 250_000, d[PAGES[9][2]])]
    assert got == Counter(want)
    whole = {(r["page_id"], r["uri"]): r["payload"] for r in warc.read_archive(a).where("record_type = 'response'").collect()}
    assert whole[5, "u"] == PAGES[6][2].encode() and whole[9, "http://b/é"] == b"same"
    # any Zstandard reader takes a bundle whole: the seek table is a frame that it skips
    from pyarrow.fs import FileSelector, FileSystem

    fs, base = FileSystem.from_uri(a.folder)
    files = fs.get_file_info(FileSelector(base))
    text = b"".join(zstandard.ZstdDecompressor().stream_reader(fs.open_input_stream(f.path, compression=None), read_across_frames=True).read() for f in files)
    assert text.count(b"WARC-Type: ") == len(PAGES) and len(files) > 1
    index = {r["record_id"]: r for r in a.index.collect()}
    assert len({(r["bundle"], r["frame"]) for r in index.values()}) > 3
    ids = spark.createDataFrame([("<urn:x-page:5>",), ("<urn:x-page:5>",), ("<urn:x-page:1>",), ("<urn:x-page:77>",)], "record_id string")
    assert {(r["page_id"], r["record_type"], bytes(r["payload"] or b"")) for r in warc.fetch(a, ids).collect()} == {(5, "response", PAGES[6][2].encode()), (1, "revisit", b"")}
    fs.open_output_stream(f"{base}/stray.warc.zst").close()
    assert warc.remove_strays(a) == 1 and warc.read_archive(a).count() == len(PAGES)
    with fs.open_input_file(files[0].path) as f:
        damaged = bytearray(f.read())
    damaged[8] ^= 1
    with fs.open_output_stream(files[0].path, compression=None) as f:
        f.write(bytes(damaged))
    with pytest.raises(Exception, match="damaged|corrupt|decompression"):
        warc.read_archive(a).count()


def test_short_payloads_are_not_revisited(spark, pages):
    a = warc.write_archive(pages, least_bytes=5)
    assert {r["record_type"] for r in warc.report(a).collect()} == {"response"}
    none = warc.write_archive(pages.limit(0))
    assert warc.report(none).count() == 0 and warc.remove_strays(none) == 0


def test_search_is_the_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        r = c.sql(search.OP13_SQL)
        got = search.op13_ranked_search(spark, sf)
        assert sorted(map(tuple, r.fetchall())) == sorted(map(tuple, got.select(*r.columns).collect()))


DOCS = [(1, None), (2, ""), (3, "!? \n"), (4, "red fish"), (5, "red fish"), (5, "red fish"), (None, "red fish"), (6, "RED, red; blue-fish é日本"), (7, "Éé É"), (8, "fish " * 9000), (9, "other words here")]
ITEMS = [(1, "Red fish!"), (1, "blue"), (2, "é日本 É"), (3, None), (4, ""), (5, "absent"), (None, "other"), (6, "x " * 3 + " ".join(f"w{i}" for i in range(300)) + " red")]


def brute_search(docs, items, top=10):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, out = sum(c.total() for _, c in held), []
    df = Counter(t for _, c in held for t in c)
    for item_id, text in items:
        scored = []
        for i, c in held:
            m = 10 + 90 * c.total() * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            scored += [(-s, i is None, i)] * (s > 0)
        out += [(item_id, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(200_000, 32, 512, 4096), (3, 1, 2, 1), (400, 2, 3, 7)])
def test_search_of_edge_rows(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_TERMS", "ITEM_TILE", "DOC_TILE", "TERM_TILE"), sizes, strict=True):
        monkeypatch.setattr(search, name, value)
    docs = spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, "z") for i, t in DOCS], SCHEMA).repartition(2)
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id bigint, text string, score int")
    for top in (2, 10):
        assert plain(search.search(docs, items, top)) == brute_search(DOCS, ITEMS, top)
    assert search.search(docs.limit(0), items).count() == 0 and search.search(docs, items.limit(0)).count() == 0


def test_partial_sums_stay_exact():
    weights = np.full(50, 2**40)
    ((_, parts),) = search._tiles([list(range(50))], weights, 32, 4096)
    assert len(parts) > 1 and all(len(own) == 1 or len(own) * 2**40 * search.IMPACT < 2**53 for own, _ in parts)


def test_many_ties_go_by_doc_id(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words here").otherwise(F.concat(F.lit("other "), F.col("id"))).alias("text"))
    items = spark.createDataFrame([(7, "words")], "item_id bigint, text string")
    assert [r["doc_id"] for r in search.search(docs, items).orderBy("rank").collect()] == [3 * i for i in range(10)]
