"""Approximate nearest neighbours by cosine: an inverted file with product
quantisation and exact reranking.

A bounded sample of the vectors (SAMPLE rows at most) fits the coarse quantiser
and the codebooks of the residuals, and sets how many lists a query probes: as
few as hold at least TARGET of the sample's true neighbours. The coarse quantiser
has two levels, centroids and centroids of what they leave over, so that the
number of lists grows with the root of the number of rows (up to COARSE * FINE)
though the sample is bounded; small tables need one level. All rows are assigned
and coded. A query meets the lists it probes in cells: a long list is dealt over
several cells by a hash of the row, and so are the queries of a list many of them
probe, so that a cell never holds more than about CELL rows of either. In a cell,
asymmetric distance tables (query against codewords) rank the rows; the best
RERANK of each query are scored exactly on the original vectors, and so are all rows
that could be nearer than the last wanted of those: a row's nearness by codes is off by
a share of what its codes leave over, and that share is measured on the sample's
true neighbours. Queries that find too few rows probe all lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts, read_table

SAMPLE, COARSE, FINE, SUBSPACES, CODES, CELL, RERANK, TARGET = 20_000, 2048, 256, 16, 256, 4096, 32, 0.99


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from a sample of distinct rows; empty clusters keep their centre."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(x.dtype)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[s : s + 4096] @ c.T - half, axis=1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse quantiser, codebooks and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, lists: int, top: int, seed: int = 1):
        x = unit(sample)
        self.dim = x.shape[1]
        first = min(lists, COARSE, max(1, len(x) // 8))
        self.coarse = kmeans(x, first, seed=seed)
        rest = x - self.coarse[nearest(x, self.coarse)]
        second = min(FINE, -(-lists // first))
        self.fine = kmeans(rest, second, seed=seed) if second > 1 and len(x) > 8 * FINE else np.zeros((1, self.dim), np.float32)
        self.lists = len(self.coarse) * len(self.fine)
        own, rest = self._assign(x)
        self.cuts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.books = [kmeans(np.ascontiguousarray(rest[:, c]), CODES, seed=seed) for c in self.cuts]
        self.probe = self._calibrate(x, own, top)
        self.margin = self._margin(x, own, top)

    def _assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each unit vector, and what its centroids leave over."""
        one = nearest(x, self.coarse)
        rest = x - self.coarse[one]
        two = nearest(rest, self.fine)
        return one * len(self.fine) + two, rest - self.fine[two]

    def nearness(self, q: np.ndarray) -> np.ndarray:
        """Queries by all lists."""
        return ((q @ self.coarse.T)[:, :, None] + (q @ self.fine.T)[:, None, :]).reshape(len(q), -1)

    def centre(self, which: int) -> np.ndarray:
        return self.coarse[which // len(self.fine)] + self.fine[which % len(self.fine)]

    def _calibrate(self, x: np.ndarray, own: np.ndarray, top: int) -> int:
        """Lists to probe so that TARGET of the true neighbours within the sample are met."""
        needed = []
        for k in np.linspace(0, len(x) - 1, min(300, len(x))).astype(int):
            near = self.nearness(x[k : k + 1])[0]
            true = own[np.argsort(-(x @ x[k]))[: top + 1]]
            needed.append((near[None, :] > near[true][:, None]).sum(axis=1))
        needed = np.sort(np.concatenate(needed))
        at = min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)
        return int(min(self.lists, needed[at] + 2))

    def _margin(self, x: np.ndarray, own: np.ndarray, top: int) -> float:
        """What codes miss of a true neighbour's nearness, as a share of what they
        leave over of it: TARGET of the sample's true neighbours miss no more."""
        about = self.decode(own, self.code(x)[1])
        over, shares = np.sqrt(((x - about) ** 2).sum(axis=1)), []
        for k in np.linspace(0, len(x) - 1, min(300, len(x))).astype(int):
            near = x @ x[k]
            near[k] = -np.inf
            true = np.argsort(-near)[: min(top, len(x) - 1)]
            shares.append((near[true] - about[true] @ x[k]) / np.maximum(over[true], 1e-9))
        shares = np.concatenate(shares)
        return float(np.clip(np.quantile(shares, TARGET), 0, 1)) if len(shares) else 1.0

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Unit vectors as their lists and codes tell them."""
        out = self.coarse[own // len(self.fine)] + self.fine[own % len(self.fine)]
        for k, (c, b) in enumerate(zip(self.cuts, self.books)):
            out[:, c] += b[codes[:, k]]
        return out

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors -> list and residual codes of each."""
        own, rest = self._assign(x)
        return own, np.stack([nearest(np.ascontiguousarray(rest[:, c]), b) for c, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)

    def probes(self, q: np.ndarray) -> np.ndarray:
        """The lists nearest to each query, a few queries at a time."""
        step, out = max(1, (1 << 22) // self.lists), []
        for s in range(0, len(q), step):
            near = -self.nearness(q[s : s + step])
            take = np.argpartition(near, self.probe - 1, axis=1)[:, : self.probe] if self.probe < self.lists else np.tile(np.arange(self.lists), (len(near), 1))
            out.append(take)
        return np.concatenate(out)

    def table(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, c] @ b.T for c, b in zip(self.cuts, self.books)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in 32-bit floats."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square over- or underflows
    x = x.astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same sum order for every row."""
    with np.errstate(all="ignore"):
        out = (q * x).sum(axis=-1) / (np.sqrt((q * q).sum(axis=-1)) * np.sqrt((x * x).sum(axis=-1)))
        odd = np.flatnonzero(~np.isfinite(out))
        if len(odd):  # squares out of range: the same on scaled vectors
            a, b = q[odd] / np.abs(q[odd]).max(axis=1, keepdims=True), x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True)
            out[odd] = (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))
    return out


def search_cell(index: Index, which: int, base: tuple[np.ndarray, np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray], top: int) -> list[tuple[np.ndarray, ...]]:
    """The best `top` rows of a cell for each query: (query, id, score). Of the
    rows that equal the query in id and vector one is the query's own."""
    ids, codes, x = base
    order = np.argsort(ids, kind="stable")
    ids, codes, x = ids[order], codes[order], x[order]
    x64, xu, out = x.astype(np.float64), unit(x), []
    over = np.sqrt(((xu - index.decode(np.full(len(ids), which), codes)) ** 2).sum(axis=1))
    for s in range(0, len(queries[0]), 128):
        qid, q = queries[0][s : s + 128], queries[1][s : s + 128]
        qu = unit(q)
        near = np.repeat((qu @ index.centre(which))[:, None], len(ids), axis=1)
        for k, t in enumerate(index.table(qu)):
            near += t[:, codes[:, k]]
        lo, hi = np.searchsorted(ids, qid), np.searchsorted(ids, qid, side="right")
        for k in np.flatnonzero(hi > lo):
            same = np.flatnonzero((x[lo[k] : hi[k]] == q[k]).all(axis=1))
            near[k, lo[k] + same[:1]] = -np.inf
        take = min(RERANK, len(ids))
        last = np.partition(near, len(ids) - take, axis=1)[:, len(ids) - take]
        exact = np.where((near >= last[:, None]) & np.isfinite(near), qu @ xu.T, -np.inf)
        wanted = lambda m: np.partition(m, len(ids) - min(top, len(ids)), axis=1)[:, len(ids) - min(top, len(ids))][:, None] - 1e-5
        exact = np.where((near + index.margin * over >= wanted(exact)) & np.isfinite(near), qu @ xu.T, exact)
        i, j = np.nonzero((exact >= wanted(exact)) & np.isfinite(exact))
        score = cosine(q[i].astype(np.float64), x64[j])
        best = np.lexsort((ids[j], -score, i))
        i, j, score = i[best], j[best], score[best]
        starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, int)
        nth = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        keep = nth < top
        out.append((qid[i[keep]], ids[j[keep]], score[keep]))
    return out


def nearest_neighbours(vectors: DataFrame, every: int = 50, top: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """-> (query_id, rank, vec_id, score): for each row whose id is divisible by
    `every`, its `top` nearest found among all other rows, ties to smaller ids;
    always `top` of them, or all where there are fewer.

    Rows with a null id and vectors that are null, empty, zero or hold null or
    non-finite components take no part. Vectors of different dimensions have no
    nearness; each dimension is searched by itself. A repeated id is one query, that of its
    vector that sorts first; its other rows are candidates like all others, and
    repeated candidates stay separate rows."""
    spark = vectors.sparkSession
    # vectors keep their precision for the exact scores
    wide = dict(vectors.dtypes)[vec_col] == "array<double>"
    kind = np.dtype(np.float64 if wide else np.float32)
    v = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>" if wide else "array<float>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where(F.col("i").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = {r.dim: r.n for r in v.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one a dimension
    if not sizes:
        return spark.createDataFrame([], schema)
    if len(sizes) > 1:
        each = [nearest_neighbours(vectors.where(F.size(vec_col) == d), every, top, id_col, vec_col) for d in sorted(sizes)]
        out = each[0]
        for more in each[1:]:
            out = out.unionByName(more)
        return out
    dim, n = next(iter(sizes.items()))
    draw = F.xxhash64("i", "v")
    share = min(1.0, 1.2 * SAMPLE / n)
    few = v.where(F.pmod(draw, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    drawn = few.orderBy(draw, "i", "v").limit(SAMPLE).toPandas()  # SAMPLE rows at most
    if not len(drawn):
        drawn = v.orderBy(draw, "i", "v").limit(1000).toPandas()
    sample = np.stack(list(drawn.v)).astype(kind)
    index = Index(sample, max(1, int(np.sqrt(n))), top)
    send = spark.sparkContext.broadcast(index)  # COARSE + FINE centroids and CODES codewords a subspace at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = send.value
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                own, codes = ix.code(unit(x))
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["i", "list", "code", "x"])

    coded = materialize(v.mapInArrow(assign, "i long, list int, code binary, x binary"))
    rows_in = {r.list: r.n for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list

    def search(queries: DataFrame, every_list: bool) -> DataFrame:
        """(i, x) -> (query_id, vec_id, score), `top` rows a probed cell at most."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = send.value
            for b in batches:
                if b.num_rows:
                    x = np.frombuffer(b"".join(b.column("x").to_pylist()), kind).reshape(-1, dim)
                    near = np.tile(np.arange(ix.lists), (len(x), 1)) if every_list else ix.probes(unit(x))
                    take = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column("i").take(take), pa.array(near.ravel().astype(np.int32)), b.column("x").take(take)], ["q", "list", "x"])

        probes = materialize(queries.mapInArrow(probe, "q long, list int, x binary"))
        queries_in = {r.list: r.n for r in probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
        most = int(min(CELL, max(32, n / (2 * parts(spark)))))
        # cells of a list: shards of its rows times blocks of its queries, numbered over all lists
        layout, first = [], 0
        for c in sorted(rows_in.keys() & queries_in.keys()):
            shards, blocks = -(-rows_in[c] // most), -(-queries_in[c] // CELL)
            layout.append((c, shards, blocks, first))
            first += shards * blocks
        cells = F.broadcast(spark.createDataFrame(layout, "list int, shards int, blocks int, first long"))  # COARSE * FINE rows of four numbers at most
        base = coded.join(cells, "list")
        base = base.select("list", "i", "code", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), (F.col("first") + F.pmod(F.xxhash64("i", "x"), "shards")).alias("at"), "shards")
        base = base.select((F.col("at") + F.col("block") * F.col("shards")).alias("cell"), "list", "i", "code", "x")
        asked = probes.join(cells, "list")
        asked = asked.select("q", "x", "first", "shards", F.pmod(F.xxhash64("q"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        asked = asked.select((F.col("first") + F.col("block") * F.col("shards") + F.col("shard")).alias("cell"), "q", "x")

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
            flat = lambda s, t, w: np.frombuffer(b"".join(s), t).reshape(-1, w)
            ix = send.value
            rows = (a.i.to_numpy(), flat(a.code, np.uint8, len(ix.cuts)), flat(a.x, kind, dim))
            found = search_cell(ix, int(a.list.iloc[0]), rows, (b.q.to_numpy(), flat(b.x, kind, dim)), top)
            return pd.DataFrame({k: np.concatenate([f[c] for f in found]) for c, k in enumerate(("query_id", "vec_id", "score"))})

        return base.groupBy("cell").cogroup(asked.groupBy("cell")).applyInPandas(meet, "query_id long, vec_id long, score double")

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

    queries = coded.where(F.col("i") % every == 0).groupBy("i").agg(F.min("x").alias("x"))
    got = materialize(best(search(queries, False)))
    there = min(top, sum(rows_in.values()) - 1)
    full = got.where(F.col("rank") == there).select(F.col("query_id").alias("i"))
    short = materialize(queries.join(full, "i", "left_anti"))
    if there == 0 or index.probe == index.lists or short.isEmpty():
        return got
    again = best(search(short, True))
    return got.join(short.select(F.col("i").alias("query_id")), "query_id", "left_anti").unionByName(again)


def op4_neighbours(spark, sf_dir):
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))
