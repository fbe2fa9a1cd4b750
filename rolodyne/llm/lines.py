"""Line dedup: of lines that equal each other or differ by a few edits, directly
or through a chain, the earliest stays.

A line is normalised (runs of spaces become one, white space at the ends goes).
All but blank lines take part (MIN_CHARS). Two lines are linked when they are
equal or, from FUZZY_CHARS characters on, the least whose segments have four
each, when their edit distance is EDITS at most.

Links between different lines come from a segment-partition join: each line is
cut into EDITS + 1 even segments, of which a line within EDITS edits must hold
one unchanged, at a place that the segment's position and the difference in
length confine (multi-match-aware selection). Segments and the substrings
probed are hashed together with the indexed length and segment number; rows of
one hash meet after one shuffle and a sort, in a stream that holds LIST lines at
most. Longer lists are set aside and compared block by block, each pair of
blocks on its own, so that no list meets in one task and only links come out.
Candidates are verified by edit distance, bit-parallel over a band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, mix, powers, read_table, rekey, slices

EDITS, MIN_CHARS, FUZZY_CHARS, LIST, BLOCK = 2, 1, 12, 48, 256
#: Up to so many rows a side of a join is broadcast; its rows are a few longs.
SMALL = 500_000
NO_ID = (1 << 63) - 1
_spaces = re.compile("  +")


def normalise(line: str) -> str:
    line = line.strip()
    return _spaces.sub(" ", line) if "  " in line else line


def line_id(line: str) -> tuple[int, int]:
    """A line's digest of 128 bits as two longs. Equal lines are told by both;
    the first alone numbers candidates, whose texts are then compared."""
    high, low = divmod(xxhash.xxh3_128_intdigest(line), 1 << 64)
    return low - (1 << 63), high - (1 << 63)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 segments of a line; later ones take the remainder."""
    k = edits + 1
    size, more = divmod(length, k)
    out, at = [], 0
    for i in range(k):
        n = size + (i >= k - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings by which a line
    finds equally long or shorter lines; own segments are left out."""
    out = []
    for short in range(length - edits, length + 1):
        gap = length - short
        for i, (p, n) in enumerate(segments(short, edits)):
            low = max(0, p - i, p + gap - (edits - i))
            high = min(length - n, p + i, p + gap + (edits - i))
            out += [(short, i, s, n) for s in range(low, high + 1) if gap or s != p]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: common ends are stripped,
    then one bit for each diagonal of the band is kept per number of edits."""
    if len(a) > len(b):
        a, b = b, a
    gap = len(b) - len(a)
    if gap > edits:
        return False
    if a == b:
        return True
    lo, hi = 0, len(a)
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    while hi > lo and a[hi - 1] == b[hi - 1 + gap]:
        hi -= 1
    a, b = a[lo:hi], b[lo : hi + gap]
    n, m, band = len(a), len(b), 2 * edits + 1
    if m <= edits:
        return True
    full = (1 << band) - 1
    # bit d of states[e]: the first i characters of a become the first i + d - edits of b with e edits
    states = [((1 << (e + 1)) - 1) << edits & full for e in range(edits + 1)]
    padded = "\0" * edits + b + "\0" * (band + 1)
    for i in range(n):
        c, match = a[i], 0
        for d in range(band):
            j = i + d - edits
            if 0 <= j < m and padded[i + d] == c:
                match |= 1 << d
        before = states
        states = [before[0] & match]
        for e in range(1, edits + 1):
            changed = before[e - 1]
            row = (before[e] & match) | changed | (changed >> 1)
            row |= states[e - 1] << 1 & full  # a further character of b
            states.append(row)
        if not states[-1]:
            return False
    return bool(states[edits] >> (m - n + edits) & 1)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("o"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("t")).where("t is not null")


def occurrences(rows: DataFrame, min_chars: int) -> DataFrame:
    """-> (o, th, line, h, g): the lines that take part, by document and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            row, number, ids = [], [], []
            for k, text in enumerate(b.column("t").to_pylist()):
                for at, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(line := normalise(line)) >= min_chars:
                        row.append(k)
                        number.append(at)
                        ids.append(line_id(line))
            take = pa.array(row, pa.int32())
            both = np.array(ids, np.int64).reshape(-1, 2)
            cols = [b.column("o").take(take), b.column("th").take(take), pa.array(number, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(cols, ["o", "th", "line", "h", "g"])

    return rows.mapInArrow(run, "o long, th long, line int, h long, g long")


def _fuzzy_lines(batches: Iterator[pa.RecordBatch], fuzzy_chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """Distinct lines of a task that may have near ones; what was seen is forgotten now and then."""
    seen: set[int] = set()
    for b in slices(batches, "t"):
        ids, lines = [], []
        for text in b.column("t").to_pylist():
            for line in text.split("\n"):
                if len(line) >= fuzzy_chars and len(line := normalise(line)) >= fuzzy_chars:
                    h = line_id(line)[0]
                    if h not in seen:
                        seen.add(h)
                        ids.append(h)
                        lines.append(line)
        if len(seen) > 300_000:
            seen.clear()
        yield ids, lines


def substring_hashes(text: str, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of text[start:end], mixed with a seed: from prefix sums of a
    polynomial modulo 2**64, so that no substring is copied."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = powers(len(x) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * down[start] + seed.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def postings(rows: DataFrame, edits: int, fuzzy_chars: int) -> DataFrame:
    """-> (key, h, probe): own segments (probe 0) and probed substrings (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple[np.ndarray, ...]] = {}
        for ids, lines in _fuzzy_lines(batches, fuzzy_chars):
            for at in range(0, len(lines), 4000):
                some = lines[at : at + 4000]
                lens = list(map(len, some))
                for n in set(lens) - plans.keys():
                    own = [(n, i, s, k) for i, (s, k) in enumerate(segments(n, edits))]
                    plan = np.array([(s, s + k, length * 8 + i) for length, i, s, k in own + probes(n, edits)], np.int64)
                    plans[n] = (*plan.T, (np.arange(len(plan)) > edits).astype(np.int8))
                mine = [plans[n] for n in lens]
                per = np.fromiter((len(m[0]) for m in mine), np.int64, len(mine))
                start, end, seed, probe = (np.concatenate([m[k] for m in mine]) for k in range(4))
                first = np.repeat(np.cumsum(lens) - np.array(lens), per)
                keys = substring_hashes("".join(some), start + first, end + first, seed)
                h = np.repeat(np.array(ids[at : at + 4000], np.int64), per)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(h), pa.array(probe)], ["key", "h", "probe"])

    return rows.mapInArrow(run, "key long, h long, probe byte")


def _meet(dealt: DataFrame, most: int) -> DataFrame:
    """Sorted postings -> (a, b, key): a pair of lines to compare (key null), or
    a member a of a list longer than `most` (b: whether it only probes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["a", "b", "key"], None  # the last list's rows so far
        long_key = None

        def cut(key: np.ndarray, h: np.ndarray, probe: np.ndarray, last: bool) -> tuple[list, tuple | None]:
            nonlocal long_key
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(starts[1:], len(key))
            rest = None
            if not last and len(starts):
                s = starts[-1]
                if ends[-1] - s <= most and key[s] != long_key:
                    rest = (key[s:], h[s:], probe[s:])
                    starts, ends = starts[:-1], ends[:-1]
            out = []
            size = ends - starts
            two = starts[size == 2]
            if long_key is not None:
                two = two[key[two] != long_key]
            two = two[(probe[two] == 0) | (probe[two + 1] == 0)]
            if len(two):
                out.append((h[two], h[two + 1], None))
            more = size > 2 if long_key is None else (size > 2) | (key[starts] == long_key)
            for s, e in zip(starts[more], ends[more]):
                if key[s] == long_key or e - s > most:
                    long_key = key[s]
                    out.append((h[s:e], probe[s:e].astype(np.int64), np.full(e - s, key[s])))
                else:
                    i, j = np.triu_indices(e - s, 1)
                    p = probe[s:e]
                    good = (p[i] == 0) | (p[j] == 0)
                    out.append((h[s:e][i[good]], h[s:e][j[good]], None))
            return out, rest

        def batch(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            key = pa.concat_arrays([pa.nulls(len(x[0]), pa.int64()) if x[2] is None else pa.array(x[2]) for x in found])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), key], names)

        for b in batches:
            if not b.num_rows:
                continue
            now = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in ("key", "h", "probe"))
            now = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            # the same line from several tasks, or with own segment and probe alike: the first row, an index row if there is one
            fresh = np.concatenate(([True], (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])))
            now = tuple(x[fresh] for x in now)
            found, held = cut(*now, False)
            if found:
                yield batch(found)
        if held is not None:
            found, _ = cut(*held, True)
            if found:
                yield batch(found)

    return dealt.mapInArrow(run, "a long, b long, key long")


def _texts(rows: DataFrame, wanted: DataFrame, count: int, fuzzy_chars: int) -> DataFrame:
    """(h, line) of the lines in wanted (h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lines in _fuzzy_lines(batches, fuzzy_chars):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["h", "line"])

    lines = rows.select("t").mapInArrow(run, "h long, line string")
    found = lines.join(F.broadcast(wanted) if count <= SMALL else wanted, "h", "left_semi")
    return materialize(found.groupBy("h").agg(F.first("line").alias("line")), 20 * count)


def links(rows: DataFrame, edits: int = EDITS, fuzzy_chars: int = FUZZY_CHARS, most: int = LIST, count: int | None = None) -> DataFrame:
    """-> (src, dst): ids of different lines within `edits` edits. From longer
    lists of candidates come enough links to keep their classes whole. count:
    about how many lines there are."""
    if fuzzy_chars < 4 * (edits + 1):
        raise ValueError("segments would be shorter than four characters")
    dealt = postings(rows.select("t"), edits, fuzzy_chars).repartition("key").sortWithinPartitions("key", "h", "probe")
    met = materialize(_meet(dealt, most))
    pairs = materialize(met.where("key is null").select("a", "b").distinct(), count)
    hot = met.where("key is not null").select("key", F.col("a").alias("h"), F.col("b").cast("int").alias("probe")).distinct()
    wanted = materialize(pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).union(hot.select("h")).distinct(), count)
    texts = _texts(rows, wanted, wanted.count(), fuzzy_chars)
    left = texts.select(rekey("h").alias("ha"), F.col("line").alias("x"))
    right = texts.select(rekey("h").alias("hb"), F.col("line").alias("y"))
    both = pairs.join(left, pairs.a == left.ha).select("a", "b", "x").join(right, F.col("b") == right.hb).select("a", "b", "x", "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            good = pa.array([within(p, q, edits) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], ["src", "dst"])

    close = both.mapInArrow(verify, "src long, dst long")
    # long lists: a member goes to the pairs of blocks that its own takes part in
    sizes = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.select(F.col("key").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    keyed = hot.join(blocks, hot.key == blocks.k).withColumn("own", own)
    spread = keyed.select("key", "h", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "h")
    filled = spread.join(texts.select(rekey("h").alias("g"), "line"), spread.h == F.col("g")).select("key", "i", "j", "own", "h", "line")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("h").sort_values("h")
        i, j = int(block.i.iloc[0]), int(block.j.iloc[0])
        a, b = block[block.own == i], block[block.own == j]
        up: dict[int, int] = {}
        out = []

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for h, x in zip(a.h.tolist(), a.line):
            for g, y in zip(b.h.tolist(), b.line):
                if (i != j or h < g) and h != g and abs(len(x) - len(y)) <= edits and top(h) != top(g) and within(x, y, edits):
                    up[top(h)] = top(g)
                    out.append((h, g))
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    dense = filled.groupBy("key", "i", "j").applyInPandas(compare, "src long, dst long")
    return materialize(close.unionByName(dense).distinct(), count)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, fuzzy_chars: int = FUZZY_CHARS, most: int = LIST) -> DataFrame:
    """-> (o, th, lines, kept): per document the numbers of the lines to take
    out, and the document that keeps the line for each. The earliest of a class
    is the one with the smallest (id, digest of the text, line number)."""
    rows = _rows(docs, id_col, text_col)
    found = materialize(occurrences(rows, min_chars))
    count = found.count()
    place = F.struct("o", "th", "line")
    firsts = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    comp = connected_components(links(rows, edits, fuzzy_chars, most, count))
    comp = comp.select(rekey("node").alias("node"), "component")
    # a class is a component of near lines, or else a line's digest; classes of one line that occurs once need no further step
    near = F.col("component").isNotNull()
    classed = firsts.join(comp, firsts.h == comp.node, "left").where((F.col("n") > 1) | near)
    classed = materialize(classed.select("h", "g", "first", F.coalesce("component", "h").alias("c"), F.when(near, F.lit(0).cast("long")).otherwise(F.col("g")).alias("d")), count)
    lead = classed.groupBy("c", "d").agg(F.min("first").alias("lead")).select(rekey("c").alias("lc"), F.col("d").alias("ld"), "lead")
    known = classed.join(lead, (classed.c == F.col("lc")) & (classed.d == F.col("ld"))).select(rekey("h").alias("kh"), F.col("g").alias("kg"), "lead")
    gone = found.join(known, (found.h == F.col("kh")) & (found.g == F.col("kg"))).where(place != F.col("lead"))
    return gone.groupBy("o", "th").agg(F.array_sort(F.collect_list(F.struct("line", F.col("lead.o").alias("kept")))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The input with the later lines of each class taken out of the text, and a
    column lines_removed: array of (line number, id of the document that keeps
    the earliest). Rows are never dropped; a text may end up empty.

    Null texts stay null. Rows with equal id and text are one document: both
    lose the same lines. Null ids rank last. An input column of the name
    lines_removed is replaced."""
    gone = materialize(removals(docs, id_col, text_col, **limits))
    names = [c for c in docs.columns if c.lower() != "lines_removed"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("o"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    gone = gone.select(rekey("o").alias("go"), F.col("th").alias("gth"), "gone")
    joined = packed.join(gone, (packed.o == F.col("go")) & (packed.th == F.col("gth")), "left")
    # the numbers that stay by one pass over a hash set, so that a text of many removed lines costs no more than its lines
    cut = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(F.col(f"row.`{text_col}`").cast("string"), "\n", -1)))
    joined = cut.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda g: g.line)))
    kept = F.array_join(F.transform("stay", lambda k: F.get("lines", k)), "\n")
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).when(F.size("stay") > 0, kept).otherwise(F.lit(""))
    out = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    return joined.select(*out, F.coalesce("gone", F.array().cast("array<struct<line:int,kept:bigint>>")).alias("lines_removed"))


def op10_lines(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("lines_removed").alias("n_removed"), F.array_distinct(F.transform("lines_removed", lambda x: x.kept)).alias("kept_by"), F.sha2("text", 256).alias("text_sha256"))
