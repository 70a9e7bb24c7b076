"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Every five-word shingle is hashed once. The top bits of the hash name its bin, and each bin keeps its smallest hash.
An empty bin takes the value of the first non-empty bin in a probe order that depends on the bin alone, so equal sets
fill alike. Of each bin only BITS low-order bits are stored, as one hexadecimal digit. Two unlike bins agree by chance
once in 2**BITS, and the likeness takes that share out again.

All of it is DataFrame functions: sort, filter and transform of arrays inside one row; no row is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BLANKS, SHINGLE, let

#: Bins (a power of two), stored bits of each, and probes before the exhaustive choice of a donor.
BINS, BITS, PROBES = 256, 4, 8
_SHIFT = 63 - (BINS.bit_length() - 1)
#: Rows of one range of doc_id, where a document and the next one meet in a task.
RANGE_ROWS, MOST_RANGES = 20_000, 100_000


def shingles(text: Column) -> Column:
    """Non-negative 63-bit hashes of all shingles, repeats included; fewer words than five make one, none make none."""
    keep = F.lit((1 << 63) - 1)
    words = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), "[ \\t-\\r]+")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def combine(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        fives = lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, F.get(p, i + 2), F.get(h, i + 4)).bitwiseAND(keep))
        slides = let(pairs, fives)
        whole = F.array(F.xxhash64(F.concat_ws(",", F.transform(h, lambda x: x.cast("string"))), F.lit(1)).bitwiseAND(keep))
        return F.when(F.size(h) >= SHINGLE, slides).otherwise(whole)

    none = F.array().cast("array<bigint>")
    return F.when(F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))) == 0, none).otherwise(let(hashed, combine))


def _minima(hashes: Column) -> Column:
    """One entry for each bin, in order: its smallest hash, or null. A mark of the largest value stands in every bin,
    so that after sorting the first value of each bin is its minimum or, where it is empty, the mark."""
    low = (1 << _SHIFT) - 1
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("bigint"), _SHIFT).bitwiseOR(F.lit(low)))
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1).bitwiseXOR(x) > low))
    return F.transform(let(F.sort_array(F.concat(hashes, marks)), first), lambda x: F.when(x.bitwiseAND(F.lit(low)) != low, x.bitwiseAND(F.lit(low))))


def _densified(bins: Column) -> Column:
    """Fills empty bins. The probes are a fixed random walk over the bins for each empty bin; if all meet empty bins,
    the donor is the non-empty bin of the least hash together with this one. No shingle at all leaves nulls."""
    probe = lambda i, t: F.get(bins, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))
    full = lambda: F.filter(F.transform(bins, lambda v, j: F.when(v.isNotNull(), F.struct(j.alias("j"), v.alias("v")))), lambda s: s.isNotNull())

    def fill(donors: Column) -> Column:
        last = lambda i: F.array_min(F.transform(donors, lambda s: F.struct(F.xxhash64(i, s["j"]).alias("h"), s["v"].alias("v"))))["v"]
        return F.transform(bins, lambda v, i: F.coalesce(v, *[probe(i, t) for t in range(PROBES)], last(i)))

    return let(full(), fill)


def fingerprint(text: Column) -> Column:
    """BINS hexadecimal digits, one for each bin; a text without words has digit 0 throughout."""
    digits = lambda full: F.array_join(F.transform(full, lambda v: F.substring(F.lit("0123456789abcdef"), F.coalesce(v.bitwiseAND(F.lit(15)), F.lit(0)).cast("int") + 1, F.lit(1))), "")
    return digits(let(_minima(shingles(text)), _densified))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two fingerprints, from 0 to 1, corrected for chance agreement."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most doc_id, by binary search in a literal array; null: one range below all."""
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    table = F.lit(bounds).cast("array<bigint>")
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        right = F.coalesce(F.get(table, middle(s)) <= doc_id, F.lit(False))
        lo = F.when((s["lo"] < s["hi"]) & right, middle(s) + 1).otherwise(s["lo"])
        hi = F.when((s["lo"] < s["hi"]) & ~right, middle(s)).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.aggregate(steps, state, halve, lambda s: s["lo"]))


def next_documents(docs: DataFrame, carry: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """docs (doc_id and the carry columns, and those derived from these) with next_<c> of the document that follows in descending doc_id.

    After the last comes the first again. Equal doc_ids are ordered by the first carry column, descending, nulls
    last. Rows are dealt into ranges of doc_id; each range also gets the head of the range below, so nothing is
    ordered in one task. Only range borders, one number a range, reach the driver.
    """
    spark = docs.sparkSession
    n = docs.select("doc_id").where("doc_id is not null").count()
    ranges = min(MOST_RANGES, max(-(-n // RANGE_ROWS), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))}) if n else []
    docs = docs.select("doc_id", *carry, _range_of(F.col("doc_id"), bounds).alias("_range"))
    heads = sorted((r["_range"], r["top"]) for r in docs.groupBy("_range").agg(F.max("doc_id").alias("top")).collect())
    above = [(heads[i][1], heads[(i + 1) % len(heads)][0]) for i in range(len(heads))]
    sentinels = None
    if heads:
        target = F.broadcast(spark.createDataFrame(above, "top bigint, _to int"))  # one row a range
        top = docs.join(target, F.col("doc_id").eqNullSafe(F.col("top"))).select("_to", "doc_id", *carry)
        first = top.groupBy("_to").agg(F.max("doc_id").alias("doc_id"), F.max(F.struct(*carry)).alias("_s"))
        sentinels = first.select("doc_id", *[F.col("_s")[c].alias(c) for c in carry], F.col("_to").alias("_range"), F.lit(1).alias("_mark"))
    rows = docs.withColumn("_mark", F.lit(0))
    rows = rows.unionByName(sentinels) if sentinels is not None else rows
    rows, carry = rows.withColumns(derived or {}), [*carry, *(derived or {})]
    from pyspark.sql import Window

    order = Window.partitionBy("_range").orderBy("_mark", F.col("doc_id").desc_nulls_last(), F.col(carry[0]).desc_nulls_last())
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry]).where("_mark = 0").drop("_mark", "_range")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    A null text counts as empty; a text without words has a fingerprint of zeros. Equal texts, repeated rows
    included, have equal fingerprints. Very long texts are worked on whole. Other columns of docs are ignored. A lone
    document is its own next one; an empty table gives no rows. Texts are shuffled once, to meet the next document.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = next_documents(docs, ["text"], {"fingerprint": fingerprint(F.col("text"))})
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).cast(T.DoubleType()).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).cast(T.DoubleType()).alias("near_next"))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
