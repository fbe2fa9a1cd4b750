"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed
to a wide vector and the document's fingerprint is the sum of those vectors, so
that the order of paragraphs doesn't matter and paragraphs can be added or
taken out later without the rest of the text. The vector has two parts:

- STRONG lanes modulo 2**64 from a cryptographic hash of the paragraph: equal
  sums mean equal multisets.
- SOFT lanes modulo 2**32: each distinct three-word shingle of the paragraph
  (the whole sequence where it has fewer words) adds to one lane, with a sign of
  its own, four times the root of how often it occurs there. For these sums the
  squared distance estimates how many shingles differ, which gives fingerprints
  a likeness between 0 and 1; the root keeps one word repeated a thousand times
  in a paragraph from outweighing all else. A lane leaves its range where one
  paragraph stands 2**29 times in a text, more than a text of 2**31 bytes holds
  but of single characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, mix, parts, powers, read_table, slices

STRONG, SOFT, WORDS = 8, 128, 3
_LANE = (1 << 32) - 1


def soft_vector(data: bytes) -> np.ndarray:
    """Sum of the SOFT lanes over the paragraphs (lines) of data."""
    out = np.zeros(SOFT, np.int64)
    for s, e in _line_cuts(data):
        _add_soft(out, data[s:e])
    return out


def _line_cuts(data: bytes) -> Iterator[tuple[int, int]]:
    """Pieces of about a megabyte that end with a line."""
    s = 0
    while s < len(data):
        e = data.find(b"\n", s + (1 << 20))
        e = len(data) if e < 0 else e + 1
        yield s, e
        s = e


def _add_soft(out: np.ndarray, data: bytes) -> None:
    x = np.frombuffer(data, np.uint8)
    blank = x <= 32
    inside = np.concatenate(([False], ~blank, [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return
    up, down = powers(len(x) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    word = mix((sums[ends] - sums[starts]) * down[starts])
    line = np.concatenate(([0], np.cumsum(x == 10)))[starts]
    n = len(word)
    full = np.flatnonzero(line[WORDS - 1 :] == line[: n - WORDS + 1]) if n >= WORDS else np.zeros(0, np.int64)
    h = [word[full] * np.uint64(3) + word[full + 1] * np.uint64(5) + word[full + 2] * np.uint64(7)]
    # lines of one or two words
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.append(first, n))
    h.append(word[first[size == 1]])
    h.append(word[first[size == 2]] * np.uint64(3) + word[first[size == 2] + 1] * np.uint64(11))
    h = mix(np.concatenate(h))
    at = np.concatenate((line[full], line[first[size == 1]], line[first[size == 2]]))
    # how often each shingle occurs in its paragraph
    _, one, often = np.unique(h + at.astype(np.uint64) * BASE, return_index=True, return_counts=True)
    h, weight = h[one], np.floor(np.sqrt(16.0 * often))
    weight[((h >> np.uint64(40)) & np.uint64(1)).astype(bool)] *= -1
    out += np.bincount((h & np.uint64(SOFT - 1)).astype(np.int64), weights=weight, minlength=SOFT).astype(np.int64)


class Fingerprint:
    """A sum of paragraph vectors; add() and subtract() take texts of whole
    paragraphs, in any order and at any time."""

    def __init__(self, text: str | None = None):
        self.strong, self.soft = np.zeros(STRONG, np.uint64), np.zeros(SOFT, np.int64)
        if text is not None:
            self.add(text)

    def _sum(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        data = text.encode("utf-8", "surrogatepass")
        digests = b"".join(hashlib.blake2b(p, digest_size=8 * STRONG).digest() for p in data.split(b"\n"))
        return np.frombuffer(digests, "<u8").reshape(-1, STRONG).sum(axis=0, dtype=np.uint64), soft_vector(data)

    def add(self, text: str) -> Fingerprint:
        strong, soft = self._sum(text)
        self.strong, self.soft = self.strong + strong, (self.soft + soft) & _LANE
        return self

    def subtract(self, text: str) -> Fingerprint:
        strong, soft = self._sum(text)
        self.strong, self.soft = self.strong - strong, (self.soft - soft) & _LANE
        return self

    def copy(self) -> Fingerprint:
        out = Fingerprint()
        out.strong, out.soft = self.strong, self.soft
        return out

    def __str__(self) -> str:
        return self.strong.astype("<u8").tobytes().hex() + self.soft.astype("<u4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints; else about twice the shared shingles over
        the shingles of both, 0 at least and below 1."""
        if np.array_equal(self.strong, other.strong) and np.array_equal(self.soft, other.soft):
            return 1.0
        a, b = (((x.soft + (1 << 31) & _LANE) - (1 << 31)).astype(np.float64) for x in (self, other))
        both = float((a * a).sum() + (b * b).sum())
        return min(max(2.0 * float((a * b).sum()) / both, 0.0), 1.0 - 2.0**-20) if both else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of another text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edited_fingerprint(own: Fingerprint, text: str, following: str) -> Fingerprint:
    """Of edited(text, following), from the paragraphs that change alone."""
    k = len(text) // 4
    start = text.rfind("\n", 0, len(text) - k) + 1
    return own.copy().subtract(text[start:]).add(text[start : len(text) - k] + following[:k])


def with_following(docs: DataFrame, run, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply run(rows of (id, text, next id, next text)) to all documents in
    ascending order of id, the last one followed by the first. Rows of one id
    come in order of their texts, those of an id so frequent that it fills
    several ranges in order of a digest of them.

    Rows are cut into ranges at approximate quantiles of their ids; an id that
    holds several quantiles, or rows without one, is cut further by the digest.
    The first document of a range is also sent to the range before it. The texts
    are read once and shuffled once; nothing but the range ends comes to the
    driver. Null ids come last."""
    spark = docs.sparkSession
    last = F.lit((1 << 63) - 1)
    ids = F.coalesce(F.col(id_col).cast("long"), last)
    ranges = 4 * parts(spark)
    shares = [k / ranges for k in range(1, ranges)]
    cuts = docs.select(ids.alias("o")).agg(F.percentile_approx("o", shares, max(10_000, 4 * ranges)).alias("c")).first().c if shares else []
    cuts = np.array(cuts or [], np.int64)
    held, often = np.unique(cuts, return_counts=True)
    hot = held[often > 1].tolist()
    # without a frequent id the digest is a constant, and the heads are found without reading texts
    digest = F.when(F.col("o").isin(hot), F.xxhash64("t")).otherwise(F.lit(0)) if hot else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), ids.alias("o")).withColumn("d", digest)

    @F.pandas_udf("int")
    def range_of(o: pd.Series, d: pd.Series) -> pd.Series:
        o, d = o.to_numpy(np.int64), d.to_numpy(np.int64)
        low, high = np.searchsorted(cuts, o), np.searchsorted(cuts, o, side="right")
        place = (d.astype(np.float64) + 2.0**63) / 2.0**64  # in order of d
        inner = np.minimum(low + 1 + np.floor(place * (high - low)).astype(np.int64), high)
        return pd.Series(np.where(high - low > 1, inner, high).astype(np.int32))

    heads = sorted((r.f.o, r.f.d, r.b) for r in rows.select("o", "d", range_of("o", "d").alias("b")).groupBy("b").agg(F.min(F.struct("o", "d")).alias("f")).collect())  # a row a range
    ranged = rows.withColumn("b", range_of("o", "d"))
    own = F.struct("b", F.lit(0).alias("s"))
    if heads:
        before = [heads[-1][2], *(b for _, _, b in heads[:-1])]
        to = spark.createDataFrame([(o, d, b) for (o, d, _), b in zip(heads, before)], "ho long, hd long, to int")  # a row a range
        ranged = ranged.join(F.broadcast(to), (F.col("o") == F.col("ho")) & (F.col("d") == F.col("hd")), "left")
        both = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("b"), F.lit(1).alias("s"))))
    else:
        both = F.array(own)
    dealt = ranged.select("i", "t", "o", "d", F.inline(both)).repartition("b").sortWithinPartitions("b", "s", "o", "d", "t").select("i", "t", "b", "s")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(_followed(batches))

    return dealt.mapInArrow(pairs, schema)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text, next id, next text) of sorted (id, text, range, sentinel) rows."""
    held = None
    for batch in slices(batches, "t"):
        for i, t, b, s in zip(*(batch.column(k).to_pylist() for k in ("i", "t", "b", "s"))):
            if held is not None and held[2] == b:
                yield held[0], held[1], i, t
            held = None if s else (i, t, b)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and its likeness
    to both the edited text's and the following document's. Null texts are
    empty; a lone document follows itself; repeated ids follow each other, and
    rows without an id come after all others."""

    def run(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out, known = [], (None, None)
        for i, text, j, following in rows:
            own = known[1] if known[0] is text else Fingerprint(text)
            nxt = Fingerprint(following)
            known = (following, nxt)
            changed = edited_fingerprint(own, text, following)
            sha = hashlib.sha256(edited(text, following).encode("utf-8", "surrogatepass")).hexdigest()
            out.append((i, len(text), sha, str(own), str(changed), own.likeness(changed), own.likeness(nxt)))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs, run, schema, id_col, text_col)


def op5_fingerprints(spark, sf_dir):
    return fingerprints(read_table(spark, sf_dir, "documents"))
