"""Packing tokenised documents into sequences of a fixed size.

What bin packing needs of the corpus is only how many pieces have each length,
at most `capacity` numbers; the driver gets those, reduces the instance by
Martello-Toth dominance (piece sets that some optimal solution contains are
fixed at once: pieces nothing fits beside, pairs that fill a sequence, and
pairs where no two smaller pieces could do better), and packs the remainder
best-fit decreasing. The plan is a table of runs (so many sequences of this
composition); each piece finds its place by its rank among those of its length,
counted in two levels so that a frequent length never meets in one task. Pieces
of the full size, the most of a corpus of long texts, need no rank: each is a
sequence.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts, read_table, rekey, slices

CAPACITY, END = 1024, 2


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = "byte_bpe_50k"):
    """The byte-level BPE of byte_bpe_50k.json; the same vocabulary as ranks
    gives the same ids several times faster. The JSON's added tokens are matched
    in a text as the library does."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None) -> np.ndarray:
    ids = tokenizer().encode(text or "", allowed_special="all", disallowed_special=())
    ids.append(END)
    return np.array(ids, "<u4")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """-> (doc_id, piece, start, length, ids_crc32[, ids]). Only documents of
    more than `capacity` tokens are cut; the first piece takes the remainder.
    A null text is empty: one piece with the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 2 << 20):
            rows, ids = [], []
            for doc, text in zip(b.column("i").to_pylist(), b.column("t").to_pylist()):
                all_ids = token_ids(text)
                n = len(all_ids)
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, s, e - s, zlib.crc32(all_ids[s:e].tobytes())))
                    if keep_ids:
                        ids.append(all_ids[s:e])
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often each length occurs -> runs (number of sequences, [(length, how
    often in each)]). Needs no more memory than the number of lengths squared."""
    left = {w: n for w, n in counts.items() if n}
    runs = _reduce(left, capacity)
    return runs + _best_fit(left, capacity)


def _reduce(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Take the sets that dominate all others out of `left`."""
    runs = []

    def take(m: int, *items: int) -> None:
        for w in items:
            left[w] -= m
            if not left[w]:
                del left[w]
        runs.append((m, [(items[0], 2)] if len(items) == 2 and items[0] == items[1] else [(w, 1) for w in items]))

    def smallest(k: int, but: int) -> list[int]:
        out = []
        for w in sorted(left):
            out += [w] * min(k - len(out), left[w] - (w == but))
            if len(out) >= k:
                break
        return out

    again = True
    while again:
        again = False
        for w in sorted(left, reverse=True):
            while w in left:
                room = capacity - w
                low = smallest(3, w)
                fits = sum(1 for s in np.cumsum(low) if s <= room)
                if not fits:  # nothing fits beside it
                    take(left[w], w)
                    again = True
                    break
                best = max(p for p in left if p <= room and left[p] - (p == w) > 0)
                if best != room and fits > 1:
                    if fits > 2 or best < _best_pair(left, w, room):
                        break
                if best == w:
                    m = left[w] // 2
                    left[w] -= 2 * m
                    if not left[w]:
                        del left[w]
                    runs.append((m, [(w, 2)]))
                else:
                    take(min(left[w], left[best]), w, best)
                again = True
    return runs


def _best_pair(left: dict[int, int], but: int, room: int) -> int:
    """The largest sum of two pieces (besides one of `but`) within room, or 0."""
    ws = sorted(w for w, n in left.items() if n - (w == but) > 0)
    best, i, j = 0, 0, len(ws) - 1
    while i <= j:
        total = ws[i] + ws[j]
        if total > room:
            j -= 1
            continue
        if i < j or left[ws[i]] - (ws[i] == but) > 1:
            best = max(best, total)
        i += 1
    return best


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing, many equal pieces and sequences at a time."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for w in sorted(left, reverse=True):
        n = left[w]
        rooms = sorted(r for r in open_ if r >= w) + [capacity]
        for r in rooms:
            fill = r // w  # a sequence that took one is the best fit for the next
            groups = open_.pop(r, []) if r < capacity else [(-(-n // fill) if n else 0, [])]
            while groups and n:
                m, items = groups.pop()
                full = min(m, n // fill)
                if full:
                    open_[r - fill * w].append((full, [*items, (w, fill)]))
                    n -= full * fill
                    m -= full
                if m and n:
                    open_[r - n * w].append((1, [*items, (w, n)]))
                    m, n = m - 1, 0
                if m and r < capacity:
                    groups.append((m, items))
            if groups and r < capacity:
                open_[r] += groups
            if not n:
                break
    return [g for groups in open_.values() for g in groups]


def places(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Per length: (first rank, ranks, first sequence, of it in each, offset)."""
    out, used, first = defaultdict(list), defaultdict(int), 0
    for m, items in runs:
        offset = 0
        for w, q in items:
            out[w].append((used[w], m * q, first, q, offset))
            used[w] += m * q
            offset += w * q
        first += m
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """-> pieces() with sequence_id and offset: sequences are gapless from
    offset 0 and hold at most `capacity` tokens. Every row gives its pieces,
    repeated rows and ids too; an empty table gives none. Sequences of one full
    piece have negative ids, the others ids from 0 on."""
    spark = docs.sparkSession
    # numbered once, where they are written: whatever else they share, rows are told apart and dealt out evenly
    found = materialize(pieces(docs, id_col, text_col, capacity, keep_ids).withColumn("row", F.monotonically_increasing_id()))
    salts = parts(spark)
    salted = found.where(F.col("length") < capacity).withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
    sizes = materialize(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), capacity * salts)
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(rekey("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("r", F.row_number().over(own) - 1).join(base, (F.col("length") == base.l) & (F.col("salt") == base.s)).withColumn("rank", F.col("base") + F.col("r"))
    schema = "w long, slots array<struct<at:long,n:long,first:long,q:long,offset:long>>"
    where = F.broadcast(spark.createDataFrame(sorted(table.items()), schema))  # one row a length, a few thousand slots in all
    slot = F.filter("slots", lambda x: (x.at <= F.col("rank")) & (F.col("rank") < x.at + x.n))[0]
    placed = ranked.join(where, ranked.length == where.w).withColumn("slot", slot).withColumn("k", F.col("rank") - F.col("slot.at"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    mixed = placed.select(*names, (F.col("slot.first") + F.floor(F.col("k") / F.col("slot.q"))).alias("sequence_id"), (F.col("slot.offset") + F.pmod("k", F.col("slot.q")) * F.col("length")).alias("offset"))
    full = found.where(F.col("length") == capacity).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return mixed.unionByName(full)


def op6_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"))
