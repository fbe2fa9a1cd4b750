"""Language identification by a byte convolutional network in numpy.

Text is read as bytes, in windows of WINDOW bytes over its whole length. Filters
of widths 2, 3 and 4 slide over learned byte embeddings, each filter's maximum
over a window goes through a softmax layer, and a document's language is the one
with the largest sum of log-probabilities over its windows. For prediction the
embeddings and filters are folded into tables indexed by pairs of bytes, so that
a filter of four bytes costs two lookups.

Training uses a bounded sample of the documents allowed for learning: windows of
different texts, PER_LANGUAGE of each language at most, and TOTAL at most over
all languages, which then share them evenly. Every language is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, remove, slices

WINDOW, EMBED, FILTERS, WIDTHS = 256, 12, 16, (2, 3, 4)
PER_LANGUAGE, TOTAL, EPOCHS = 1500, 60_000, 12
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")
#: A-Z as a-z, digits as one, so that shouting and numbers don't look like another language.
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[48:58] = 48


def windows(text: str) -> np.ndarray:
    """Rows of WINDOW bytes that cover the whole text. A short text is filled up
    with zeros; what full windows leave over is in a last one that overlaps them."""
    x = _fold[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(x) < WINDOW:
        return np.pad(x, (0, WINDOW - len(x)))[None]
    full = x[: len(x) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return full if len(x) % WINDOW == 0 else np.concatenate((full, x[None, -WINDOW:]))


class ByteConv:
    """Embedding, filters, biases and the softmax layer of a trained network."""

    def __init__(self, names: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.names = names
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"e": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"], self.p[f"b{w}"] = f(w * EMBED, FILTERS), np.zeros(FILTERS, np.float32)
        self.p["o"], self.p["c"] = f(FILTERS * len(WIDTHS), len(names)), np.zeros(len(names), np.float32)
        self._tables = None

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64, seed: int = 2) -> ByteConv:
        """Adam on cross-entropy; gradients pass through the maxima only."""
        rng, m, v, t, p = np.random.default_rng(seed), {}, {}, 0, self.p
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                take = order[s : s + batch]
                g = self._gradient(x[take], y[take])
                t += 1
                step = rate * (0.85**epoch) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k, d in g.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    p[k] = (p[k] - step * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        self._tables = None
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, where, views = [], {}, {}
        for w in WIDTHS:
            cols = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            z = cols @ p[f"f{w}"] + p[f"b{w}"]
            where[w], views[w] = z.argmax(axis=1), cols
            pooled.append(np.take_along_axis(z, where[w][:, None, :], axis=1)[:, 0])
        h0 = np.concatenate(pooled, axis=1)
        h = np.maximum(h0, 0)
        out = _softmax(h @ p["o"] + p["c"])
        out[np.arange(n), y] -= 1
        out /= n
        g = {"o": h.T @ out + 1e-4 * p["o"], "c": out.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = (out @ p["o"].T) * (h0 > 0)
        rows = np.arange(n)[:, None]
        for j, w in enumerate(WIDTHS):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            at = where[w]
            picked = views[w][rows, at]  # (n, filters, w * embed)
            g[f"f{w}"] = np.einsum("nf,nfi->if", d, picked, optimize=True)
            g[f"b{w}"] = d.sum(axis=0)
            back = (d[:, :, None] * p[f"f{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            for k in range(w):
                np.add.at(g["e"], x[rows, at + k].ravel(), back[:, :, k].reshape(-1, EMBED))
        return g

    def tables(self) -> dict:
        """Filters by pairs of bytes: sums of what the network does byte by byte."""
        if self._tables is None:
            p, t = self.p, {}
            one = lambda w, k: p["e"] @ p[f"f{w}"][k * EMBED : (k + 1) * EMBED]
            pair = lambda w, k: (one(w, k)[:, None] + one(w, k + 1)[None]).reshape(-1, FILTERS).astype(np.float32)
            t["2"], t["3a"], t["3b"], t["4a"], t["4b"] = pair(2, 0), pair(3, 0), one(3, 2).astype(np.float32), pair(4, 0), pair(4, 2)
            self._tables = t
        return self._tables

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Windows -> log-probabilities of the languages, batch by batch."""
        t, p, out = self.tables(), self.p, []
        for s in range(0, len(x), 256):
            w = x[s : s + 256].astype(np.int32)
            two = w[:, :-1] * 256 + w[:, 1:]
            z2 = t["2"][two].max(axis=1)
            z3 = t["3a"][two[:, :-1]]
            z3 += t["3b"][w[:, 2:]]
            z4 = t["4a"][two[:, :-2]]
            z4 += t["4b"][two[:, 2:]]
            h = np.maximum(np.concatenate((z2 + p["b2"], z3.max(axis=1) + p["b3"], z4.max(axis=1) + p["b4"]), axis=1), 0)
            out.append(np.log(np.maximum(_softmax(h @ p["o"] + p["c"]), 1e-9)))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability per text; UNKNOWN and 0 without a letter."""
        real = [k for k, t in enumerate(texts) if t and _letter.search(t)]
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if real and self.names:
            found = [windows(texts[k]) for k in real]
            counts = np.array([len(f) for f in found])
            logs = self.log_probabilities(np.concatenate(found))
            mean = np.add.reduceat(logs, np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]
            prob = _softmax(mean)
            best = prob.argmax(axis=1)
            for k, b, pr in zip(real, best, prob):
                names[k], score[k] = self.names[b], float(pr[b])
        return names, score


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> pd.DataFrame:
    """(text, lang) -> (lang, r, window) of a bounded sample: of each language the
    different texts of smallest hash, one window at a hashed place of each.

    A first pass estimates how many different texts each language has; the second
    keeps those whose hash lies so low that about three times as many as wanted
    remain, whatever the size of the table and however often a text is repeated."""
    hashed = docs.select("text", "lang", F.xxhash64("text").alias("r"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("r").alias("n"))
    sizes = materialize(sizes, 1)
    n_langs = sizes.count()
    if not n_langs:
        return pd.DataFrame({"lang": [], "r": [], "window": []})
    most = max(1, min(per_language, total // n_langs))
    share = sizes.select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(3.0 * most) / F.col("n")).alias("share"))
    place = (F.col("r").cast("double") + 2.0**63) / 2.0**64
    low = hashed.join(share, F.col("lang") == F.col("l")).where(place <= F.col("share")).select("text", "lang", "r")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for text, lang, r in zip(*(b.column(k).to_pylist() for k in ("text", "lang", "r"))):
                if _letter.search(text):
                    w = windows(text)
                    rows.append((lang, r, w[r % len(w)].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["lang", "r", "window"])

    once = low.mapInArrow(cut, "lang string, r long, window binary").groupBy("lang", "r").agg(F.min("window").alias("window"))
    first = Window.partitionBy("lang").orderBy("r")  # about three times `most` rows a language
    found = once.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).drop("k").toPandas()  # `total` rows, or one a language, at most
    remove(sizes)
    return found


def train(docs: DataFrame) -> ByteConv:
    """(text, lang), neither null -> network; without rows one that knows no language."""
    sample = training_windows(docs).sort_values(["lang", "r", "window"])
    names = sorted(set(sample.lang))
    net = ByteConv(names)
    if len(names):
        x = np.frombuffer(b"".join(sample.window), np.uint8).reshape(-1, WINDOW)
        # every window also cut short, for short texts
        rng = np.random.default_rng(3)
        short = x.copy()
        short[np.arange(WINDOW)[None, :] >= rng.integers(8, 96, len(x))[:, None]] = 0
        y = np.searchsorted(names, sample.lang.to_numpy().astype(str))
        net.train(np.concatenate((x, short)), np.concatenate((y, y)))
    return net


def identify(docs: DataFrame, net: ByteConv, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id_col, lang_pred, score) per row. A null text or one without a letter
    is `und` with score 0, as is everything when no language was learned."""
    send = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 1 << 20):
            names, score = send.value.predict(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(names, pa.string()), pa.array(score)], ["i", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "i long, lang_pred string, score double").withColumnRenamed("i", id_col)


def op9_langid(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    net = train(docs.where(~held & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang"))
    return identify(docs, net).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
