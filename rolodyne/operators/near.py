"""Pairs of similar short texts without comparing all with all.

A ratio of T percent means that two texts of lengths m and n share a common
subsequence of at least T (m + n) / 200 characters, hence that at most so many
characters d are inserted or deleted between them. One text, cut into d + SHARED
segments, then keeps SHARED of them whole, and it is known how far those can have
moved: reading from the left, the first time the segments without an edit are one
more than the edits, the k-th such segment i has exactly i - k edits before it.
The index therefore holds, for each text and number of edits, every SHARED of its
segments; a probe looks each of them up by length at the few places where they
can be. What meets there is compared by counts of characters (a 64-bit signature,
of which d edits change d bits at most) before any similarity is computed. Pairs
found are a superset of those that reach T, none is missed.

Names that have most of their characters in common with very many others (a few
frequent words) make lists of the index as long as the table, and each pair meets in
many of them. Up to DIRECT pairs both sides are therefore dealt into cells of about
ROWS rows each, which compare the signatures of all pairs of equal lengths at once and
then the texts of those that are left: a pair meets in one cell only, once, and nothing
but what reaches T leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import py_ratio
from ..shared import materialize, parts

#: So many whole segments are looked up together; one for texts of over LONG edits.
SHARED, LONG = 2, 8
#: Pairs are compared in cells of ROWS rows a side up to DIRECT of them (some nanoseconds
#: each), by the index beyond. Names of one prefix are together in one of GROUPS groups;
#: of the rows with a name's characters COPIES are, beyond that they are dealt over cells.
ROWS, DIRECT, GROUPS, COPIES = 4096, 10**12, 4096, 256
#: RUN * RUN pairs are worked on at once.
RUN = 512
#: So much of a ratio of words in another order counts for a weighted one (similarity.weighted).
TOKENS = 0.95


def least_common(m: int, n: int, threshold: float) -> int:
    """Length of the common subsequence that a ratio of `threshold` needs."""
    return -int(-(threshold * (m + n) / 200.0 - 1e-9) // 1)


@lru_cache(maxsize=4096)
def partners(length: int, threshold: float) -> dict[int, int]:
    """Lengths that a text can reach the threshold with -> edits between them at most."""
    out, n = {}, max(1, int(length * threshold / (200.0 - threshold)))
    while True:
        need = least_common(length, n, threshold)
        if need <= min(length, n):
            out[n] = length + n - 2 * need
        elif n > length:
            return out
        n += 1


def _cuts(length: int, segments: int) -> list[int]:
    return [length * k // segments for k in range(segments + 1)]


@lru_cache(maxsize=65536)
def placements(length: int, other: int, edits: int) -> list[tuple[tuple[int, int, int], ...]]:
    """For an indexed text of `length` and a probing one of `other`: the segments
    (number, size, place in the probing text) to look up together."""
    shared = SHARED if edits <= LONG else 1
    segments = edits + shared
    cuts, gain = _cuts(length, segments), other - length
    deleted, inserted = (edits - gain) // 2, (edits + gain) // 2
    out = []
    for chosen in combinations(range(segments), shared):
        found: list[tuple[tuple[int, ...], int]] = [((), 0)]
        for k, i in enumerate(chosen):
            step = i - k - (chosen[k - 1] - (k - 1) if k else 0)  # edits since the last one
            found = [((*moves, at + s), at + s) for moves, at in found for s in range(-step, step + 1, 2) if -deleted <= at + s <= inserted]
        left = edits - (chosen[-1] - (shared - 1))
        for moves, at in found:
            places = [(i, cuts[i + 1] - cuts[i], cuts[i] + move) for i, move in zip(chosen, moves)]
            if abs(gain - at) <= left and all(0 <= p and p + size <= other for _, size, p in places):
                out.append(tuple(places))
    return out


def signature(s: str) -> int:
    """Two bits for each of 32 classes of characters: at least one, at least two."""
    out = 0
    for c in s:
        bit = 1 << 2 * (ord(c) % 32)
        out |= bit << 1 if out & bit else bit
    return out - (1 << 64) if out >> 63 else out


def _key(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def index_keys(s: str, threshold: float, prefix: int = 0) -> set[int]:
    out = set()
    for edits in set(partners(len(s), threshold).values()):
        shared = SHARED if edits <= LONG else 1
        cuts = _cuts(len(s), edits + shared)
        for chosen in combinations(range(edits + shared), shared):
            out.add(_key(len(s), edits, s[:prefix], *chosen, *(s[cuts[i] : cuts[i + 1]] for i in chosen)))
    return out


def probe_keys(s: str, threshold: float, prefix: int = 0) -> set[int]:
    out = set()
    for length, edits in partners(len(s), threshold).items():
        for places in placements(length, len(s), edits):
            out.add(_key(length, edits, s[:prefix], *(i for i, _, _ in places), *(s[p : p + size] for _, size, p in places)))
    return out


def token_sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def set_characters(s: str) -> str:
    """The characters of a name's different words and of the blanks between them: in
    whatever order the words of two names are put, their edits are edits here, too."""
    return "".join(sorted(" ".join(set(s.split()))))


def _entries(names: DataFrame, col: str, keys: Callable, forms: tuple, threshold: float, prefix: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):  # a name has some hundred entries
                rows = []
                for name in b.column(0).slice(at, 500).to_pylist():
                    for s in dict.fromkeys(f(name) for f in forms):
                        if s:
                            sig, n = signature(s), len(s)
                            rows += [(k, name, n, sig) for k in keys(s, threshold, prefix)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["k", "name", "n", "sig"])

    # a name is small and its entries are many: however few the names' bytes, all tasks share them
    dealt = names.select(F.col(col).cast("string")).where(f"`{col}` <> ''").repartition(parts(names.sparkSession))
    return dealt.mapInArrow(run, "k long, name string, n int, sig long")


def edits_allowed(m: Column, n: Column, threshold: float) -> Column:
    return m + n - 2 * F.ceil((m + n) * (threshold / 200.0) - 1e-9)


class _Texts:
    """Texts as numbers: their lengths, and the classes of their characters."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.cumsum(self.size) - self.size

    def rank(self, alphabet: np.ndarray) -> None:
        self.codes = np.searchsorted(alphabet, self.codes)
        row = np.repeat(np.arange(len(self.texts)), self.size)
        n = np.bincount(row * 32 + self.codes % 32, minlength=32 * len(self.texts)).reshape(-1, 32)
        bit = np.uint64(1) << np.arange(0, 64, 2, dtype=np.uint64)
        self.sign = ((n > 0) * bit | (n > 1) * (bit << np.uint64(1))).sum(axis=1, dtype=np.uint64)

    def columns(self, which: np.ndarray, size: int) -> np.ndarray:
        """The characters of texts of one size, a row for each place."""
        return self.codes[self.at[which][None, :] + np.arange(size)[:, None]]


def _common(masks: np.ndarray, m: int, i: np.ndarray, b: np.ndarray, j: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those with a common subsequence of `need` characters, and
    its length; bit-parallel as similarity.lcs, all pairs at once. masks: for each
    character where it is in each text of m; b: the other texts' characters by place."""
    full = np.uint64((1 << m) - 1)
    v, n, width = np.full(len(i), full), len(b), masks.shape[1]
    flat = masks.ravel()
    for t in range(n):
        u = v & flat[b[t][j] * width + i]
        v = (v + u) | (v - u)
        if t % 3 == 2 or t == n - 1:  # what can't get there any more is left out
            keep = np.flatnonzero(m - np.bitwise_count(v & full).astype(np.int64) + (n - 1 - t) >= need)
            if len(keep) < len(i):
                i, j, v = i[keep], j[keep], v[keep]
    return i, j, m - np.bitwise_count(v & full).astype(np.int64)


def _runs(sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, where each one's rows begin in an order of all rows, how many there
    are, and that order; a signature of over RUN rows comes again for the next ones."""
    order = np.argsort(sign, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(sign[order]) != 0))
    n = np.diff(np.append(first, len(sign)))
    times = -(-n // RUN)
    begin = np.repeat(first, times) + RUN * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    return sign[order][begin], begin, np.minimum(RUN, np.repeat(first + n, times) - begin), order


def _near_signs(x: np.ndarray, y: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of signatures that differ in `edits` bits at most, some at
    a time; equal signatures are compared once for all their rows."""
    (sx, at_x, n_x, order_x), (sy, at_y, n_y, order_y) = _runs(x), _runs(y)
    wide = max(1, RUN * RUN // len(sx))
    for at in range(0, len(sy), wide):
        some = sy[at : at + wide]
        near = np.flatnonzero(np.bitwise_count(sx[:, None] ^ some[None, :]) <= edits)
        p, q = near // len(some), near % len(some) + at
        ends = np.cumsum(n_x[p] * n_y[q])
        lo = 0
        while lo < len(p):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN * RUN, side="right")))
            u, v = p[lo:hi], q[lo:hi]
            times = n_x[u] * n_y[v]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            of = np.repeat(n_y[v], times)
            yield order_x[np.repeat(at_x[u], times) + nth // of], order_y[np.repeat(at_y[v], times) + nth % of]
            lo = hi


def _alike(x: _Texts, y: _Texts, threshold: float, same: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in x, place in y, ratio) of all pairs that reach the threshold; same:
    numbers of both sides' texts that have to be equal, too."""
    alphabet = np.unique(np.concatenate((x.codes, y.codes)))
    x.rank(alphabet)
    y.rank(alphabet)
    for m in np.unique(x.size[x.size > 0]).tolist():
        of_m = np.flatnonzero(x.size == m)
        allowed = partners(m, threshold)
        others = [n for n in np.unique(y.size).tolist() if n in allowed]
        step = max(16, (1 << 22) // (len(alphabet) + 1))
        for rows in (of_m[s : s + step] for s in range(0, len(of_m), step)):
            if not others:
                break
            if m <= 64:
                masks = np.zeros((len(alphabet), len(rows)), np.uint64)
                for place, codes in enumerate(x.columns(rows, m)):
                    masks[codes, np.arange(len(rows))] |= np.uint64(1 << place)
            for n in others:
                cols, need = np.flatnonzero(y.size == n), least_common(m, n, threshold)
                places = y.columns(cols, n) if m <= 64 else None
                for i, j in _near_signs(x.sign[rows], y.sign[cols], allowed[n]):
                    if same is not None:
                        alike = same[0][rows[i]] == same[1][cols[j]]
                        i, j = i[alike], j[alike]
                    if m <= 64:
                        i, j, common = _common(masks, m, i, places, j, need)
                        ratio = 200.0 * common / (m + n)
                    else:
                        ratio = np.array([py_ratio(x.texts[k], y.texts[q]) for k, q in zip(rows[i], cols[j])], np.float64)
                    keep = ratio >= threshold
                    yield rows[i[keep]], cols[j[keep]], ratio[keep]


def matches(a: list[str], b: list[str], threshold: float, forms: tuple[Callable[[str], str], ...], prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, the best ratio of a form in both) of every pair of
    names with the same prefix that reaches the threshold."""
    same = None
    if prefix:
        number = {p: k for k, p in enumerate({t[:prefix] for t in (*a, *b)})}
        same = tuple(np.array([number[t[:prefix]] for t in side], np.int64) for side in (a, b))
    found = [f for form in forms for f in _alike(_Texts([form(t) for t in a]), _Texts([form(t) for t in b]), threshold, same) if len(f[0])]
    return _best(found, len(b), len(forms) > 1)


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, again: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All that was found in one; again: pairs may come more than once, their best counts."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, ratio = (np.concatenate(c) for c in zip(*found))
    if again and len(i):
        pair = i * width + j
        order = np.argsort(pair, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(pair[order]) != 0))
        i, j, ratio = i[order][first], j[order][first], np.maximum.reduceat(ratio[order], first)
    return i, j, ratio


def _by_token_sets(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As matches(), by the ratio of both names' different words, the common ones in
    front. Names of the same characters meet, and then their words are compared."""
    i, j, _ = matches(a, b, threshold, (set_characters,))
    x, y = ({k: frozenset(side[k].split()) for k in np.unique(at).tolist()} for side, at in ((a, i), (b, j)))

    def ratio(u: frozenset, v: frozenset) -> float:
        both = sorted(u & v)
        left, right = " ".join(both + sorted(u - v)), " ".join(both + sorted(v - u))
        if left != right and len(left) == len(right) == least_common(len(left), len(right), threshold):
            return 0.0  # short ones may have no edit at all
        return py_ratio(left, right)

    score = np.fromiter((ratio(x[p], y[q]) for p, q in zip(i.tolist(), j.tolist())), np.float64, len(i))
    keep = score >= threshold
    return i[keep], j[keep], score[keep]


def weighted_matches(a: list[str], b: list[str], cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As matches(), where the plain ratio reaches the cutoff or, at TOKENS, that of
    the sorted words or of the sets of words."""
    found = [matches(a, b, cutoff, (str,))]
    if cutoff / TOKENS <= 100:
        for i, j, ratio in (matches(a, b, cutoff / TOKENS - 1e-9, (token_sorted,)), _by_token_sets(a, b, cutoff / TOKENS - 1e-9)):
            found.append((i, j, TOKENS * ratio))
    return _best(found, len(b), True)


def _dealt(rows: DataFrame, name: str, prefix: int) -> DataFrame:
    """rows with the group of their prefix and a number that deals them over the
    shards of it: names of the same characters are together, as far as there aren't
    very many, as their signatures are compared once."""
    rows = rows.where(F.coalesce(F.col(name), F.lit("")) != "").withColumn("_key", F.xxhash64(F.array_sort(F.split(name, ""))))
    many = rows.groupBy(F.col("_key").alias("_many")).agg(F.floor(F.count(F.lit(1)) / COPIES).alias("_times")).where("_times > 0")
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("_times", F.lit(0)) + 1)
    group = F.pmod(F.xxhash64(F.left(name, F.lit(prefix))), F.lit(GROUPS)).cast("int") if prefix else F.lit(0)
    # the sides are dealt apart, or near names would fill the cells of equal numbers
    deal = F.xxhash64(F.lit(name), "_key", salt)
    return materialize(rows.join(many, F.col("_key") == F.col("_many"), "left").withColumn("_deal", deal).withColumn("_group", group).drop("_key", "_many", "_times"))


def near_rows(a: DataFrame, b: DataFrame, threshold: float, forms: tuple[Callable[[str], str], ...] = (str, token_sorted), prefix: int = 0, names: bool = True) -> DataFrame:
    """Rows a (na, ...), b (nb, ...) -> (na, ..., nb, ..., score): every pair of rows
    of whose names the same form reaches `threshold` percent on both sides, with the
    best such ratio; empty and null names are in none. forms: what is compared of a
    name; with a prefix only names that begin with the same so many characters.
    Other columns are told apart by their names; without `names` only they come out."""
    if not 0 < threshold <= 100:
        raise ValueError("a threshold above 0 and up to 100")
    ratio = _best_ratio(forms)
    indexed = lambda x, y: _indexed_pairs(x, y, threshold, forms, prefix).withColumn("score", ratio("na", "nb")).where(F.col("score") >= threshold)
    return _met(a, b, lambda x, y: matches(x, y, threshold, forms, prefix), indexed, prefix, names=names)


def weighted_pairs(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """Distinct names a (na), b (nb), words with single blanks between them -> (na, nb):
    every pair of which the plain ratio reaches the cutoff or, at TOKENS, that of the
    sorted words or of the sets of words, common ones in front; and few others."""

    def indexed(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = _indexed_pairs(x, y, cutoff, (str,), 0)
        if cutoff / TOKENS <= 100:
            pairs = pairs.unionByName(_indexed_pairs(x, y, cutoff / TOKENS - 1e-9, (token_sorted, set_characters), 0)).distinct()
        return pairs.withColumn("score", F.lit(None).cast("double"))

    return _met(a.select("na"), b.select("nb"), lambda x, y: weighted_matches(x, y, cutoff), indexed, 0, 4).select("na", "nb")


def _met(a: DataFrame, b: DataFrame, find: Callable, indexed: Callable, prefix: int, side: int = 1, names: bool = True) -> DataFrame:
    """near_rows(), with what finds the pairs of two lists of names, in cells, and
    those of two tables of distinct names, by the index. Cells have side * ROWS rows
    a side: larger ones where few pairs are found."""
    spark, columns = a.sparkSession, (a.columns, b.columns)
    out = [[c for c in of if names or c not in ("na", "nb")] for of in columns]
    types = [f for f in (*a.schema.fields, *b.schema.fields) if f.name in out[0] + out[1]]
    a, b = _dealt(a, "na", prefix), _dealt(b, "nb", prefix)
    sizes = [{r._group: r.n for r in side.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).collect()} for side in (a, b)]  # GROUPS numbers at most
    both = sorted(sizes[0].keys() & sizes[1].keys())
    score = F.lit(None).cast("double").alias("score")
    if not both:
        return a.select(*out[0]).join(b.select(*out[1]), F.lit(False)).select("*", score)
    if sum(sizes[0][g] * sizes[1][g] for g in both) > DIRECT:
        pairs = indexed(a.select("na").distinct(), b.select("nb").distinct())
        return a.join(pairs, "na").join(b, "nb").select(*out[0], *out[1], "score")
    layout = [(g, -(-sizes[0][g] // (side * ROWS)), -(-sizes[1][g] // (side * ROWS))) for g in both]
    cells = F.broadcast(spark.createDataFrame(layout, "_group int, _p int, _q int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(cells, "_group").select("_group", F.pmod("_deal", "_p").cast("int").alias("_x"), every("_q").alias("_y"), *columns[0])
    right = b.join(cells, "_group").select("_group", every("_p").alias("_x"), F.pmod("_deal", "_q").cast("int").alias("_y"), *columns[1])
    number = sum(p * q for _, p, q in layout)
    tasks = max(parts(spark), min(number, 8 * parts(spark)), min(2000, side * side * number // 8))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        (texts, own), (others, theirs) = (np.unique(np.array(t.column(c).to_pylist(), object), return_inverse=True) for t, c in ((x, "na"), (y, "nb")))
        i, j, ratio = find(texts.tolist(), others.tolist())
        # the rows of each name
        (order, n), (order_y, n_y) = ((np.argsort(w, kind="stable"), np.bincount(w, minlength=k)) for w, k in ((own, len(texts)), (theirs, len(others))))
        times = n[i] * n_y[j]
        pair = np.repeat(np.arange(len(i)), times)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        rows = order[(np.cumsum(n) - n)[i[pair]] + nth // n_y[j[pair]]]
        rows_y = order_y[(np.cumsum(n_y) - n_y)[j[pair]] + nth % n_y[j[pair]]]
        return pa.table([*x.select(out[0]).take(pa.array(rows)).columns, *y.select(out[1]).take(pa.array(rows_y)).columns, pa.array(ratio[pair], pa.float64())], [*out[0], *out[1], "score"])

    by = ["_group", "_x", "_y"]
    # the work of a cell isn't told by its bytes: as many tasks as asked for
    met = left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by))
    return met.applyInArrow(meet, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types) + ", score double")


def _best_ratio(forms: tuple[Callable[[str], str], ...]) -> Callable[[str, str], Column]:
    @F.pandas_udf("double")
    def best(x, y):
        return x.combine(y, lambda p, q: max(py_ratio(f(p), f(q)) for f in forms)).astype("float64")

    return best


def near_pairs(a: DataFrame, b: DataFrame, threshold: float, forms: tuple[Callable[[str], str], ...] = (str, token_sorted), prefix: int = 0) -> DataFrame:
    """Distinct names a (na), b (nb) -> (na, nb): near_rows() without the score."""
    return near_rows(a.select("na"), b.select("nb"), threshold, forms, prefix).select("na", "nb")


def _indexed_pairs(a: DataFrame, b: DataFrame, threshold: float, forms: tuple[Callable[[str], str], ...], prefix: int) -> DataFrame:
    """Distinct names a (na), b (nb) -> (na, nb): every pair of which some two
    forms reach `threshold` percent, and few others; empty and null names are in
    none. forms: what is compared of a name; with a prefix only names that begin
    with the same so many characters. The larger side is best given as a, which
    is indexed; b's names are looked up. Work and memory of a name grow with the
    square of the number of edits, which is a share of its length."""
    indexed = _entries(a, "na", index_keys, forms, threshold, prefix).select("k", F.col("name").alias("na"), F.col("n").alias("m"), F.col("sig").alias("x"))
    asked = _entries(b, "nb", probe_keys, forms, threshold, prefix).select(F.col("k").alias("asked"), F.col("name").alias("nb"), "n", "sig")
    alike = F.bit_count(F.col("x").bitwiseXOR(F.col("sig"))) <= edits_allowed(F.col("m"), F.col("n"), threshold)
    # a list of short names has very many entries: never sent whole to the driver
    return indexed.join(asked.hint("shuffle_hash"), (F.col("k") == F.col("asked")) & alike).select("na", "nb").distinct()
