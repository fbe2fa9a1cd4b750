"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked when
they differ in a few bits at most (`bits`: two unless the caller says otherwise).

Method: an inverted index of positional bytes with count filtering. Two
fingerprints that differ in at most `bits` bits share POSITIONS - bits of their
POSITIONS positional bytes at least, so that at most `bits` of the positions
before their last shared one are not shared. A posting list is named by a path:
the positions p1 < p2 < ... that its members share, each with its byte, where
`bits` positions at most are left out. A pair belongs to one path of each length,
that of its first shared positions, so that no pair is met twice.

Lists of one byte hold 1/256 of all rows and would grow with the square. The
index therefore begins with paths so long that an even list has one member at
most, so that unlike rows seldom meet however many there are, and every list of
over MAX_LIST members is split by a further positional byte, until the guaranteed
number is shared. A pair that meets in a list has its shared
bytes tallied over all positions; those below that number are dropped before the
rest is verified by the number of differing bits. Lists that no further byte may
split (for two bits they differ in two bytes only, hence have 65,536 members at
most) hold pairs that all reach the tally; they are verified block against block,
each pair of blocks in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, mix, read_table, rekey, remove, slices

SEED, WORDS, MAX_BITS, POSITIONS, MAX_LIST = 42, 3, 2, 8, 64

#: Members of one block of a long list.
BLOCK = 4096

NO_ID = (1 << 63) - 1


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words (or null)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - words]))
    m, h = len(starts), xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, m)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 1 << 15):
        block = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, digest: Column | None = None) -> DataFrame:
    """-> (id_col, fp[, h]): fp holds the unsigned fingerprint's bits as a long,
    h what `digest` says of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            fps = np.fromiter((fingerprint(t, words) for t in b.column("t").to_pylist()), np.uint64, b.num_rows)
            more = [c for c in b.schema.names if c == "h"]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(fps.view(np.int64)), *(b.column(c) for c in more)], ["i", "fp", *more])

    more = [] if digest is None else [digest.alias("h")]
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), *more)
    return rows.mapInArrow(run, "i long, fp long" + ", h long" * len(more)).withColumnRenamed("i", id_col)


def _mask(positions: tuple[int, ...]) -> int:
    """The bits of some byte positions, as a signed long."""
    m = sum(255 << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def paths(depth: int, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(mask, last position) of all paths of so many shared positions."""
    return [(_mask(c), c[-1]) for c in combinations(range(POSITIONS), depth) if c[-1] + 1 - depth <= bits]


def _postings(fps: DataFrame, depth: int, bits: int) -> DataFrame:
    """(fp) -> (fp, mask, last, v): v holds the bytes that the path names."""
    each = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(p).alias("last")) for m, p in paths(depth, bits)))
    return fps.select("fp", F.inline(each)).withColumn("v", F.col("fp").bitwiseAND(F.col("mask")))


def _longer(members: DataFrame, depth: int, bits: int) -> DataFrame:
    """Postings of `depth` positions, split by a further one."""
    further = F.sequence(F.col("last") + 1, F.lit(depth + bits))
    split = members.select("fp", "mask", F.explode(further).alias("last"))
    mask = F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(255).cast("long"), F.col("last") * 8))
    return split.select("fp", mask.alias("mask"), "last").withColumn("v", F.col("fp").bitwiseAND(F.col("mask")))


def _pairs(grouped: DataFrame, depth: int, bits: int) -> DataFrame:
    """(last, fps) of short lists -> (src, dst) verified pairs."""
    pairs = grouped.select("last", F.posexplode("fps").alias("at", "src"), "fps").select("last", "src", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("dst"))
    x = pairs.withColumn("x", F.col("src").bitwiseXOR(F.col("dst")))
    shared = [(F.shiftrightunsigned(F.col("x"), 8 * k).bitwiseAND(255) == 0).cast("int") for k in range(POSITIONS)]
    first = sum((F.when(F.lit(k) <= F.col("last"), s).otherwise(0) for k, s in enumerate(shared)), F.lit(0))
    tallied = x.withColumn("shared", sum(shared, F.lit(0))).where((first == depth) & (F.col("shared") >= POSITIONS - bits))
    return tallied.where(F.bit_count("x") <= bits).select("src", "dst")


def _spanning_links(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Of the links among some fingerprints as many as keep them connected."""
    fps = np.unique(group.fp.to_numpy(np.int64)).view(np.uint64)
    up = np.arange(len(fps))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    out = []
    for s in range(0, len(fps), 512):
        i, j = np.nonzero(np.bitwise_count(fps[s : s + 512, None] ^ fps[None, s:]) <= bits)
        for a, b in zip((s + i[i < j]).tolist(), (s + j[i < j]).tolist()):
            x, y = top(a), top(b)
            if x != y:
                up[y] = x
                out.append((fps[a], fps[b]))
    return pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), columns=["src", "dst"])


def _links_of_long_lists(long: DataFrame, bits: int) -> DataFrame:
    """(mask, v, n, fp) -> (src, dst): lists are dealt into blocks of about BLOCK
    members, and every two blocks of a list meet in a group of their own."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    met = long.select("mask", "v", "fp", own.alias("a"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"))
    met = met.select("mask", "v", "fp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.groupBy("mask", "v", "a", "b").applyInPandas(lambda g: _spanning_links(g, bits), "src long, dst long")


def link_edges(fps: DataFrame, rows: int | None = None, bits: int = MAX_BITS) -> DataFrame:
    """Distinct fp -> (src, dst): all pairs within `bits` (0 to 7), and of lists
    that no further byte may split as many as keep them connected.
    rows: about how many fingerprints there are."""
    n, deepest = fps.count() if rows is None else rows, POSITIONS - bits
    depth = 1
    while depth < deepest and n > 1 << (8 * depth):
        depth += 1
    postings, out = _postings(fps, depth, bits), None
    while True:
        sizes = materialize(postings.groupBy("mask", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), n)
        sizes = sizes.select(F.col("mask").alias("m"), rekey("v").alias("k"), "n")
        here = (F.col("mask") == F.col("m")) & (F.col("v") == F.col("k"))
        short = postings.join(sizes.where(f"n <= {MAX_LIST}"), here, "left_semi")
        found = _pairs(short.groupBy("mask", "v", "last").agg(F.array_sort(F.collect_list("fp")).alias("fps")), depth, bits)
        out = found if out is None else out.unionByName(found)
        if sizes.where(f"n > {MAX_LIST}").isEmpty():
            return out
        long = postings.join(sizes.where(f"n > {MAX_LIST}"), here)
        if depth == deepest:
            return out.unionByName(_links_of_long_lists(long, bits))
        postings, depth = materialize(_longer(long, depth, bits)), depth + 1


def grouped_fingerprints(rows: DataFrame, words: int = WORDS, digest: Column | None = None, bits: int = MAX_BITS) -> DataFrame:
    """(i, t) -> (i, fp, c[, h]): c is the same for linked fingerprints; h the
    digest asked for. Written to the shared folder."""
    found = fingerprints(rows, "i", "t", words, digest)
    fp = materialize(found)
    n = fp.count()
    distinct = materialize(fp.select("fp").distinct(), n)
    comp = connected_components(link_edges(distinct, n, bits))
    named = distinct.join(comp, distinct.fp == comp.node).select(F.col("fp").alias("f"), F.col("component").alias("c"))
    named = materialize(named, n).select(rekey("f").alias("f"), "c")
    return fp.join(named, fp.fp == named.f, "left").select(*fp.columns, F.coalesce("c", "fp").alias("c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = MAX_BITS) -> DataFrame:
    """-> (id_col, fp, component_id) per input row: component_id is the smallest
    id whose fingerprint is reachable over links.

    Null and wordless texts have fingerprint zero and link like any other. Rows
    with equal ids or texts each give a row; null ids take part and are never
    the smallest unless the group has no other (then component_id is null)."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    fp = materialize(grouped_fingerprints(rows, words, bits=bits))
    least = fp.groupBy("c").agg(F.min("i").alias("component_id")).select(rekey("c").alias("g"), "component_id")
    return fp.join(least, fp.c == least.g).select(F.col("i").alias(id_col), "fp", "component_id")


def hex_fingerprint(col: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


#: Parts of a text's shingles that are fingerprinted by themselves, and how many
#: shingles a part has at least on the finer of two levels.
PARTS, PART_SHINGLES = 16, 3
#: Shingle hashes a text keeps for the comparison: all of up to so many, else the least.
SKETCH = 512
#: Share of common shingles from which on two texts are near copies.
SIMILAR = 0.8
_SEEDS = mix(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted; none without a word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)][:n], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts, h = np.concatenate(([0], ends[: n - words])), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts)))


def _majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of each stretch of hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    size = np.diff(np.append(starts, len(hashes)))
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def part_fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-> (fingerprints of parts, a number that similar texts share with each).

    Part k of a text on level l holds the shingles whose k-th hash falls into one
    of 2**l ranges. Levels are chosen by the number of shingles, two next to each
    other, so that texts of nearly the same size have one in common. A part is
    untouched by a change of the other shingles; its SimHash then stays the same."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    fine = max(0, int(np.log2(n / PART_SHINGLES))) if n > PART_SHINGLES else 0
    own = mix(hashes[None, :] ^ _SEEDS[:, None])
    least, fps, orders = own.min(axis=1), [], []
    for level in {fine, max(0, fine - 1)}:
        part, at = np.nonzero(own < np.uint64((1 << (64 - level)) - 1)) if level else (np.zeros(n, np.int64), np.arange(n))
        if len(part):
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            which = part[starts]
            salt = mix(np.uint64(level * PARTS + 1) + which.astype(np.uint64))
            fps.append(mix(_majority(hashes[at], starts) ^ salt))
            orders.append(least[(which + 1) % PARTS])
    return (np.concatenate(fps), np.concatenate(orders)) if fps else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """The least SKETCH values of 32 bits of the hashes, sorted."""
    return np.unique(mix(hashes) >> np.uint64(32)).astype("<u4")[:SKETCH].tobytes()


def sketch_similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity: of all shingles where both texts have few, else of the
    least ones of their union."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        both = both[:SKETCH]
    if not len(both):
        return 1.0
    return len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), both, assume_unique=True)) / len(both)


def _described(rows: DataFrame, words: int) -> DataFrame:
    """(i, t) -> (i, h, fp, parts, orders, sketch): h tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda arrays: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))
        for b in slices(batches, "t"):
            fps, parts, orders, sketches = [], [], [], []
            for t in b.column("t").to_pylist():
                hashes = shingle_hashes(t, words)
                p, o = part_fingerprints(hashes)
                parts.append(p)
                orders.append(o)
                sketches.append(sketch(hashes))
                fps.append(fingerprint(t, words))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), pa.array(np.array(fps, np.uint64).view(np.int64)), lists(parts), lists(orders), pa.array(sketches, pa.binary())], ["i", "h", "fp", "parts", "orders", "sketch"])

    return rows.select("i", text_digest("t").alias("h"), "t").mapInArrow(run, "i long, h long, fp long, parts array<long>, orders array<long>, sketch binary")


def text_digest(col: str) -> Column:
    """Tells texts apart; those without a word are all the same."""
    t = F.coalesce(F.col(col), F.lit(""))
    return F.when(t.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(t)).otherwise(F.lit(0).cast("long"))


def similar_texts(texts: DataFrame, bits: int = MAX_BITS, least: float = SIMILAR) -> DataFrame:
    """Distinct texts (i, h, fp, parts, orders, sketch) -> verified links (src, dst).

    Compared are texts whose fingerprints lie within `bits`, told by the index of
    positional bytes, and texts of which a part's fingerprint agrees in all eight
    bytes. Of the texts that share such a fingerprint each is compared with the
    first of them and with the first that also shares a least hash: never all with
    all. A pair is linked if the share of common shingles is `least` at least."""
    first = lambda *by: [*by, F.min(F.struct("i", "h")).alias("f"), F.count(F.lit(1)).alias("n")]
    parts = materialize(texts.select("i", "h", F.explode(F.arrays_zip("parts", "orders")).alias("x")).select("i", "h", F.col("x.parts").alias("p"), F.col("x.orders").alias("o")))
    shared = parts.groupBy("p").agg(*first()).where("n > 1").select(rekey("p").alias("k"), F.col("f.h").alias("lead"))
    met = materialize(parts.join(shared, F.col("p") == F.col("k")).select("i", "h", "p", "o", "lead"))
    remove(parts)
    second = met.groupBy("p", "o").agg(*first()).where("n > 1").select(rekey("p").alias("k"), rekey("o").alias("l"), F.col("f.h").alias("nearer"))
    pairs = met.select("h", "lead").unionByName(met.join(second, (F.col("p") == F.col("k")) & (F.col("o") == F.col("l"))).select("h", F.col("nearer").alias("lead")))
    # whole fingerprints: texts with the same one, and the first texts of linked ones
    whole = materialize(texts.groupBy("fp").agg(*first()).select("fp", F.col("f.h").alias("lead"), "n"))
    same = texts.select("h", "fp").join(whole.where("n > 1").select(rekey("fp").alias("k"), "lead"), F.col("fp") == F.col("k")).select("h", "lead")
    links = link_edges(whole.select("fp"), None, bits)
    of = lambda s: whole.select(F.col("fp").alias(f"fp_{s}"), F.col("lead").alias(s))
    near = links.join(of("a"), F.col("src") == F.col("fp_a")).join(of("b"), F.col("dst") == F.col("fp_b")).select(F.col("a").alias("h"), F.col("b").alias("lead"))
    pairs = materialize(pairs.unionByName(same).unionByName(near).where("h <> lead").select(F.least("h", "lead").alias("src"), F.greatest("h", "lead").alias("dst")).distinct())

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sketch_similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    sketches = lambda s: texts.select(F.col("h").alias(f"h_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    both = pairs.join(sketches("a"), F.col("src") == F.col("h_a")).join(sketches("b"), F.col("dst") == F.col("h_b"))
    return both.where(similarity("sketch_a", "sketch_b") >= least).select("src", "dst")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = MAX_BITS, least: float = SIMILAR) -> DataFrame:
    """One document of each group of similar texts stays: the one with the smallest
    doc_id (null ids last), of rows that share that id the one with the smallest
    digest of the text. Groups are what verified links of similar_texts() connect;
    texts of a similarity of 0.8 meet with a probability of 0.95 or more, more alike
    ones surely but for a few in a thousand, and none goes without a link to one
    that has `least` of its shingles (estimated from 512 for longer texts, which
    near `least` may be off by 0.02). What a row shares its id with doesn't matter:
    rows without an id, or with one that others have, are judged by their own text.
    Of wordless or null texts one stays. Columns stay as they are, whatever their
    names."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    named = docs.select(order.alias("i"), F.col("text").cast("string").alias("t"))
    described = materialize(_described(named, words))
    # of the rows with one text the first is described once
    texts = materialize(described.groupBy("h").agg(F.min("i").alias("i"), F.min("fp").alias("fp"), F.first("parts").alias("parts"), F.first("orders").alias("orders"), F.first("sketch").alias("sketch")))
    comp = connected_components(similar_texts(texts, bits, least)).select(rekey("node").alias("node"), "component")
    grouped = materialize(texts.select("i", "h").join(comp, F.col("h") == F.col("node"), "left").select("i", "h", F.coalesce("component", "h").alias("c")))
    first = materialize(grouped.groupBy("c").agg(F.min(F.struct("i", "h")).alias("f")).select(F.col("f.i").alias("_fi"), F.col("f.h").alias("_fh")))
    remove(described)
    remove(texts)
    packed = docs.select(F.struct("*").alias("_row"), order.alias("_o"), text_digest("text").alias("_h"))
    kept = packed.join(first, (packed._o == F.col("_fi")) & (packed._h == F.col("_fh")))
    # rows equal in id and text: one of them; only the few ids that have such rows are numbered
    twice = materialize(named.groupBy("i", text_digest("t").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(rekey("i").alias("_ti"), F.col("h").alias("_th")))
    if twice.isEmpty():
        return kept.select("_row.*")
    at = (F.col("_o") == F.col("_ti")) & (F.col("_h") == F.col("_th"))
    once = kept.join(twice, at, "left_anti").select("_row")
    again = kept.join(twice, at, "left_semi").groupBy("_o", "_h").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(again).select("_row.*")


def op2_simhash(spark, sf_dir):
    near = near_duplicates(read_table(spark, sf_dir, "documents"))
    return near.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")
