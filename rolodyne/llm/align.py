"""Two tokenizers' tokens of the same text, aligned by their bytes.

The tokens of either tile the text's bytes, so their ends cut it into elementary
intervals: the union of both arrays of ends, each interval owned by one token of
either side (searchsorted). An interval is one overlap, hence one link; where both
sides end, a group of tokens closes. All documents of a batch are handled as one
byte sequence, for every document's end is an end on both sides.

How often two ids are linked corpus-wide is counted without ever shuffling links:
the documents of a task are gathered into blocks, each with the list of the id
pairs that occur in it and, by document, how often. Only those lists meet in the
count, and only the counts of its own pairs come back to a block. Blocks have a
bounded number of entries, so neither a frequent pair nor a long document makes a
large group; they are written as a row a document and lists of LISTED pairs, so that
no row grows with the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table, slices
from .packing import tokenizer
from .pieces import _gather, codec, model_path

VOCABULARY, MODEL = "byte_bpe_50k", "piece_bpe_32k.model"
#: A pair of ids in one number; vocabularies have fewer than 2**BITS entries.
BITS = 20
#: A block is closed when it has so many (document, pair) entries or documents; a
#: slice of texts of about SLICE bytes is aligned at a time.
ENTRIES, DOCUMENTS, LISTED, SLICE = 500_000, 20_000, 4096, 256 << 10


class _Names:
    """Ids as decimal numbers with what follows them, to be joined."""

    def __init__(self, n: int):
        self.by_end = {end: np.array([b"%d%s" % (i, end) for i in range(n)], object) for end in (b",", b"|", b";", b"")}


@lru_cache(maxsize=2)
def _first(vocabulary: str):
    enc = tokenizer(vocabulary)
    sizes = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)
    return enc, sizes, _Names(enc.n_vocab)


@lru_cache(maxsize=2)
def _second(model: str):
    c = codec(model_path(model))
    return c, _Names(c.n)


class Alignment:
    """The aligned tokens of texts, each read with a space before it.

    fits: which texts have tokens; the others' bytes differ from a side's, or they
    are null or empty. a, b: the ids of all, with a_at, b_at where each text's begin;
    owner_a, owner_b: of each interval; text: the text of each interval; closes:
    whether a group ends with it; a_group, b_group: the group of each token."""

    def __init__(self, texts: list[str | None], vocabulary: str = VOCABULARY, model: str = MODEL):
        (enc, sizes, self.a_names), (c, self.b_names) = _first(vocabulary), _second(model)
        raw = [f" {t}".encode() if t else b"" for t in texts]
        b, b_at = c.encode([t or "" for t in texts])
        b_bytes, b_size = _gather(c.raw, c.raw_at, c.raw_len, b)
        b_upto = np.concatenate(([0], np.cumsum(b_size)))[b_at]
        b_bytes = b_bytes.tobytes()
        a = [enc.encode_ordinary(r.decode()) for r in raw]
        self.fits = np.array([bool(r) and b_bytes[s:e] == r and enc.decode_bytes(x) == r for r, x, s, e in zip(raw, a, b_upto, b_upto[1:])], bool)
        counts_a = np.array([len(x) if ok else 0 for x, ok in zip(a, self.fits)], np.int64)
        counts_b = np.where(self.fits, np.diff(b_at), 0).astype(np.int64)
        self.a = np.array([i for x, ok in zip(a, self.fits) if ok for i in x], np.int64)
        self.b = b[np.repeat(self.fits, np.diff(b_at))].astype(np.int64)
        self.a_at, self.b_at = (np.concatenate(([0], np.cumsum(n))) for n in (counts_a, counts_b))
        self.a_end, self.b_end = np.cumsum(sizes[self.a]), np.cumsum(c.raw_len[self.b])
        text_end = np.cumsum(np.where(self.fits, [len(r) for r in raw], 0))
        self.end = np.union1d(self.a_end, self.b_end)
        self.owner_a, self.owner_b = np.searchsorted(self.a_end, self.end), np.searchsorted(self.b_end, self.end)
        self.text = np.searchsorted(text_end, self.end)
        self.closes = (self.a_end[self.owner_a] == self.end) & (self.b_end[self.owner_b] == self.end)
        shared = self.end[self.closes]
        self.a_group, self.b_group = np.searchsorted(shared, self.a_end), np.searchsorted(shared, self.b_end)
        self.n = len(texts)

    def per_text(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=self.n)

    def groups_text(self) -> list[bytes]:
        """Per text its groups, as a1,a2|b1;a3|b2,b3."""
        out = np.empty(len(self.a) + len(self.b), object)
        a_put = np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group)
        b_put = np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, side="right")
        for group, ids, put, names, at, ends in ((self.a_group, self.a, a_put, self.a_names, self.a_at, (b"|", b"|")), (self.b_group, self.b, b_put, self.b_names, self.b_at, (b";", b""))):
            last = np.append(group[1:] != group[:-1], True)[: len(group)]
            out[put] = np.where(last, names.by_end[ends[0]][ids], names.by_end[b","][ids])
            final = at[1:][np.diff(at) > 0] - 1  # the last token of each text
            out[put[final]] = names.by_end[ends[1]][ids[final]]
        at = self.a_at + self.b_at
        return [b"".join(out[s:e].tolist()) for s, e in zip(at, at[1:])]

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens (a, b) of each group, whether or not they overlap."""
        groups = int(self.closes.sum())
        n_a, n_b = (np.bincount(g, minlength=groups) for g in (self.a_group, self.b_group))
        first_b = np.cumsum(n_b) - n_b
        times = n_b[self.a_group]  # each a token meets the b tokens of its group
        left = np.repeat(np.arange(len(self.a)), times)
        nth = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        return left, first_b[self.a_group[left]] + nth


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", products: bool = False, vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """-> (id_col, a array<int>, b array<int>, group_ends array<long>, links
    array<struct<a, b>>), one row per row: the ids of both sides, the byte offsets
    (in the text with a space before it) where groups end, and the links as numbers
    of tokens; with products all pairs of a group instead of those that overlap.
    Null and empty texts, and those one side doesn't give back, have empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE):
            x = Alignment(batch.column("t").to_pylist(), vocabulary, model)
            left, right = x.products() if products else (x.owner_a, x.owner_b)
            of = np.searchsorted(x.a_at, left, side="right") - 1
            closed = np.flatnonzero(x.closes)
            lengths = np.zeros(x.n + 1, np.int64)
            lengths[1:] = np.cumsum(np.bincount(x.text, weights=np.diff(x.end, prepend=0), minlength=x.n))
            lists = lambda n, values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values, kind))
            link = pa.StructArray.from_arrays([pa.array(left - x.a_at[of], pa.int32()), pa.array(right - x.b_at[of], pa.int32())], ["a", "b"])
            offsets = pa.array(np.concatenate(([0], np.cumsum(x.per_text(of)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), lists(np.diff(x.a_at), x.a, pa.int32()), lists(np.diff(x.b_at), x.b, pa.int32()), lists(x.per_text(x.text[closed]), x.end[closed] - lengths[x.text[closed]], pa.int64()), pa.ListArray.from_arrays(offsets, link)],
                ["i", "a", "b", "group_ends", "links"],
            )

    schema = "i long, a array<int>, b array<int>, group_ends array<long>, links array<struct<a:int,b:int>>"
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("i", id_col)


_BLOCK = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, entry_pair array<long>, entry_n array<int>, pairs array<long>, totals array<long>"
_PER_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """A row a document (pairs is null): its block, its figures, the id pairs it holds
    and how often; and rows of at most LISTED pairs of a block with their number in
    it (entry_pair is null). Documents of a task are in one block until it has
    ENTRIES entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, documents, pair, times, entries = TaskContext.get().partitionId() << 32, 0, [], [], 0
        longs, names = pa.list_(pa.int64()), ["block", *_PER_DOC, "entry_pair", "entry_n", "pairs", "totals"]
        kinds = dict(zip(_PER_DOC, (pa.int64(),) * 5 + (pa.string(),)))
        lists = lambda values, bounds: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))

        def listed() -> Iterator[pa.RecordBatch]:
            known, which = np.unique(np.concatenate(pair), return_inverse=True)
            totals = np.zeros(len(known), np.int64)
            np.add.at(totals, which, np.concatenate(times))
            for at in range(0, len(known), LISTED):
                some = [pa.array([x[at : at + LISTED]], longs) for x in (known, totals)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.nulls(1, kinds[k]) for k in _PER_DOC), pa.nulls(1, longs), pa.nulls(1, pa.list_(pa.int32())), *some], names)

        for batch in slices(batches, "t", SLICE):
            x = Alignment(batch.column("t").to_pylist(), vocabulary, model)
            links = (x.a[x.owner_a] << BITS) | x.b[x.owner_b]
            order = np.lexsort((links, x.text))
            links, of = links[order], x.text[order]
            first = np.flatnonzero(np.append(True, (links[1:] != links[:-1]) | (of[1:] != of[:-1]))[: len(links)])
            pair.append(links[first])
            times.append(np.diff(np.append(first, len(links))))
            bounds = np.searchsorted(of[first], np.arange(x.n + 1))
            values = (batch.column("i"), np.diff(x.a_at), np.diff(x.b_at), x.per_text(x.text[x.closes]), x.per_text(x.text), [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups_text()])
            figures = [v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in zip(_PER_DOC, values)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(x.n, number)), *figures, lists(pair[-1], bounds), lists(times[-1].astype(np.int32), bounds), pa.nulls(x.n, longs), pa.nulls(x.n, longs)], names)
            documents, entries = documents + x.n, entries + len(first)
            if entries >= ENTRIES or documents >= DOCUMENTS:
                yield from listed()
                number, documents, pair, times, entries = number + 1, 0, [], [], 0
        if documents:
            yield from listed()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _BLOCK)


def pair_counts(found: DataFrame) -> DataFrame:
    """blocks() -> (pair, n, best): how often ids are linked, and whether that is the
    most of its second id. Second ids are no more than the vocabulary has."""
    listed = found.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).select(F.col("x.pairs").alias("pair"), "x.totals")
    counts = materialize(listed.groupBy("pair").agg(F.sum("totals").alias("n")))
    second = F.col("pair").bitwiseAND((1 << BITS) - 1)
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), second == F.col("second")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """-> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256),
    one row per row: sizes, the links whose ids are linked more often than any other
    first id with that second one (ties included), and the sum of the links' counts
    over the corpus. Rows without tokens have zeros and an empty digest; repeated
    rows and ids count as often as they are there."""
    found = materialize(blocks(docs, id_col, text_col, vocabulary, model))
    counts = materialize(pair_counts(found))
    asked = found.where("pairs is not null").select(F.col("block").alias("of"), F.explode("pairs").alias("asked"))
    answers = asked.join(counts, F.col("asked") == counts.pair).select("of", "pair", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        known, n, best = (right.column(k).to_numpy() for k in ("pair", "n", "best"))
        out = []
        for rows in left.to_batches():
            pairs, times = rows.column("entry_pair"), rows.column("entry_n").flatten().to_numpy()
            which, bounds = np.searchsorted(known, pairs.flatten().to_numpy()), np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy())))
            sums = [np.diff(np.concatenate(([0], np.cumsum(v, dtype=np.int64)))[bounds]) for v in (times * best[which], times * n[which])]
            out.append(pa.table([*(rows.column(k) for k in _PER_DOC[:5]), *map(pa.array, sums), rows.column("groups_sha256")], [*_PER_DOC[:5], "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    each = found.where("pairs is null").drop("pairs", "totals")
    return each.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def op13_alignment(spark, sf_dir):
    return summary(read_table(spark, sf_dir, "documents"))
