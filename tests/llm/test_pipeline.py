"""The pipeline against brute force, on a small fixture with copies, repeated rows and null ids."""

import threading
from collections import Counter

import numpy as np

import corpus_pipeline
from perigee.llm import packing
from test_operators import brute_components, brute_dropped

FOOT = "all rights reserved here"


def make(seed, n):
    return " ".join("".join(w) for w in np.random.default_rng(seed).choice(list("abcdefghijklmnop"), (n, 6)))


def fixture():
    rows = [(i, f"{make(i, 120)}\n{FOOT}") for i in range(1, 7)]
    rows += [(7, rows[0][1]), rows[1], rows[1], (8, rows[3][1].replace("\n", " more\n")), (None, rows[2][1])]
    rows += [(None, make(20, 90)), (None, make(20, 90)), (9, f"{make(9, 80)} {make(50, 30)} {make(10, 40)}")]
    rows += [(10, None), (11, ""), (12, make(12, 50)), (12, make(13, 50)), (13, make(14, 2500))]
    return rows, [(1, make(50, 30)), (2, make(51, 30))]


def groups_of(texts):
    return {k: top for k, (_, top) in brute_components(list(enumerate(texts))).items()}


def brute(rows, items):
    """Labels of one kind accept all rows; passages are planted word for word."""
    dropped = brute_dropped(rows)
    rows = [(k, t and "\n".join(line for n, line in enumerate(t.split("\n")) if n not in dropped[i])) for i, (k, t) in enumerate(rows)]
    first = {}
    for i, part in groups_of([t for _, t in rows]).items():
        place = (rows[i][0] is None, rows[i][0], i)
        first[part] = min(first.get(part, place), place)
    rows = [rows[i] for _, _, i in first.values()]
    rows = [(k, t) for k, t in rows if not any(x in (t or "") for _, x in items)]
    encode = packing.Encoder(*packing.default_encoder())
    out = Counter()
    for k, t in rows:
        ids = encode(t) + b"\1\0\0\0"
        out.update((k, n // 4, ids[n : n + 4 * 2048]) for n in range(0, len(ids), 4 * 2048))
    return out


def test_pipeline(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame([(k, t, "en", "x", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(1, 14)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(rows, items)
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in got) == want
    kept = Counter(k for k, start, _ in want.elements() if start == 0)
    assert kept == Counter([1, 2, 3, 4, 5, 6, None, 10, 11, 12, 12, 13])


def test_the_classifier_decides_with_labels_of_both_kinds(spark, tmp_path):
    """A trained network: what is like the documents labelled bad goes, what is like the good ones stays, labelled or not."""
    words = {q: [f"{c}{make(900 + q, 1)}{i}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(150)] for q, c in ((0, "z"), (1, "a"))}
    text = lambda k, q: " ".join(np.random.default_rng(k).choice(words[q], 120))
    rows, items = fixture()
    made = [(100 + k, text(k, k % 3 > 0)) for k in range(240)] + [(500, text(0, 0)), (None, text(3, 0)), (501, text(999, 1))]
    labelled = [(100 + k, int(k % 3 > 0), 0) for k in range(200)]
    spark.createDataFrame([(k, t, "en", "x", len(t or "")) for k, t in made], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute([(k, t) for k, t in made if t.startswith("a")], items) and len({k for k, _, _ in got}) == 161
    assert not corpus_pipeline._LEFT.get((threading.get_ident(), str(tmp_path)))


def test_runs_side_by_side_keep_their_tables(spark, tmp_path):
    """Two threads, a stage of one between two of the other: neither deletes what the other still reads."""
    rows, items = fixture()
    df = spark.createDataFrame([(k, t, "en", "x", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mine = corpus_pipeline.drop_lines(spark, df, str(tmp_path))
    other = threading.Thread(target=lambda: corpus_pipeline.drop_lines(spark, df.limit(3), str(tmp_path)).count())
    other.start()
    other.join()
    corpus_pipeline.drop_lines(spark, df.limit(2), f"{tmp_path}/other").count()
    assert mine.count() == len(rows)


NAMES = ["row", "row_", "at", "part", "place", "first", "n", "cut", "hash_a", "hash_b", "score", "vector", "class", "key", "node", "component_id", "dropped", "n_lines", "item_id", "_rid", "_quality"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Every stage but the last returns its input's columns, untouched, whatever they are called; and takes an empty table."""
    rows, items = fixture()
    extra = ", ".join(f"{c} string" for c in NAMES)
    df = spark.createDataFrame([(k, t, "en", "x", len(t or ""), *[f"{c}{i}" for c in NAMES]) for i, (k, t) in enumerate(rows)], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 14)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = {r["row"]: r for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.schema.names == df.schema.names, name
        for r in out.collect():
            assert all(r[c] == whole[r["row"]][c] for c in ["doc_id", "lang", "source", *NAMES]), name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
    got = {r["row"] for r in corpus_pipeline.drop_leaks(spark, df, str(tmp_path)).collect()}
    assert set(whole) - got == {r for r, x in whole.items() if any(t in (x["text"] or "") for _, t in items)}
    assert corpus_pipeline.pack(spark, df.limit(0), str(tmp_path)).count() == 0
