"""Secret scans: an Aho-Corasick prefilter, regular expressions anchored at its hits, and embedded checksums.

Runs of hexadecimal digits have no keyword, so they alone are sought over the whole text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidy

#: Kinds in the order in which spans of one start are listed; the last two are the method's own.
KINDS = ("assign", "access", "hex", "github", "npm")
_FLAGS = re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", _FLAGS)
HEX = re.compile(r"[0-9a-f]{24,}", _FLAGS)
#: Tokens of 30 random characters and 6 of a base-62 crc32 of those.
SIGNED = {"github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", _FLAGS), "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", _FLAGS)}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "npm_": "npm"} | {f"gh{c}_": "github" for c in "pousr"}
_UPPER = {i: i + 32 for i in range(65, 91)}


def base62_crc(body: str) -> str:
    """The six-digit base-62 form of crc32 that signed tokens end with."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        made.add_word(word, (len(word), kind))
    made.make_automaton()
    return made


def spans(text: str | None, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of all secrets of a text, in order, as code points, the end exclusive."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lower-cased; then only A-Z are
        low = text.translate(_UPPER)
    out, ends = [], dict.fromkeys(KINDS, 0)
    for start, kind in sorted((end - n + 1, kind) for end, (n, kind) in words.iter(low)):
        if start < ends[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                ends[kind] = m.end()
                if len(m[2]) >= 6:
                    out.append((start, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                ends[kind] = m.end()
                if m.end() - start >= 20:
                    out.append((start, 1, m.end()))
        elif (m := SIGNED[kind].match(text, start)) and base62_crc(m[1]) == m[2]:
            ends[kind] = m.end()
            out.append((start, KINDS.index(kind), m.end()))
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document.

    A null or empty text has no secrets: counts of 0 and the digest of no bytes. Very long texts are scanned whole.
    Repeated rows give repeated results; an empty table gives none; other columns are ignored. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [spans(t, words) for t in part.column(1).to_pylist()]
                base = [[x for x in f if x[1] < 3] for f in found]
                counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(3)]
                digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, pa.array(map(_joined, found), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
